"""Feature store, score sinks, model store and run log."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BUCKET = "day_bucket"


def save_features(df: DataFrame, path: str, day: str = "d", bucket_days: int = 365) -> None:
    """Write features as parquet, partitioned by a day bucket so day filters prune files.

    A table without days is one bucket.
    """
    bucket = F.floor(F.col(day) / bucket_days).cast("int") if day in df.columns else F.lit(0)
    # Rebalancing splits large buckets over tasks and keeps small ones in one file each.
    placed = df.withColumn(_BUCKET, bucket).hint("rebalance", F.col(_BUCKET))
    placed.write.partitionBy(_BUCKET).mode("overwrite").parquet(path)


def load_features(spark: SparkSession, path: str, first_day: int | None = None,
                  last_day: int | None = None, day: str = "d", bucket_days: int = 365) -> DataFrame:
    """Read features back; a day range also limits the buckets that are listed."""
    df = spark.read.parquet(path)
    if first_day is not None:
        df = df.filter((F.col(_BUCKET) >= first_day // bucket_days) & (F.col(day) >= first_day))
    if last_day is not None:
        df = df.filter((F.col(_BUCKET) <= last_day // bucket_days) & (F.col(day) <= last_day))
    return df.drop(_BUCKET)


def save_scores(df: DataFrame, path: str, digits: int = 4) -> None:
    """Scores or search results as CSV, floats rounded, lists as JSON text."""
    out = {}
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            out[c] = F.round(c, digits)
        elif kind.startswith(("array", "struct", "map")):
            out[c] = F.to_json(c)
    df.withColumns(out).write.mode("overwrite").option("header", True).csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A fitted model by path (S7); a bad path raises ValueError."""
    try:
        return PipelineModel.load(path)
    except Exception as error:
        raise ValueError(f"cannot load a model from {path}: {error}") from error


def append_run(spark: SparkSession, path: str, run_id: str, config: Mapping,
               metrics: Sequence[tuple[str, float]] = (), n_rows: int | None = None) -> None:
    """Append one row to the run log."""
    row = [(run_id, json.dumps(config, default=str, sort_keys=True),
            {k: float(v) for k, v in metrics if v is not None}, n_rows)]
    schema = "run_id string, config string, metrics map<string,double>, n_rows bigint"
    spark.createDataFrame(row, schema).withColumn("logged_at", F.current_timestamp()).write.mode(
        "append").parquet(path)
