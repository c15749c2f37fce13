"""Fitting a linear text classifier on a bounded sample of labelled rows, scoring all rows.

A model is one weight per hashed feature and a bias. ``SHARDS`` models are fitted side by side, each on its
share of the sample in an order given by hashes, and averaged; no task holds more than its
share, and the driver holds ``SHARDS`` weight vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelyard.plans import stage

#: Labelled rows that a fit takes at most, and the tasks that share them.
SAMPLE, SHARDS = 8_000, 4


def remainder(key: Column, of: int) -> Column:
    """crc32 of the key's text modulo ``of``; 0 for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(of)), F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE,
                    learn: Column | None = None) -> DataFrame:
    """(id, text, label, h) of at most ``rows`` different labelled (id, text) pairs, chosen by a hash of the id, then of both.

    Null ids, texts and labels are left out; an id with several labels counts as 1 if one of them is. ``learn``
    restricts the label rows. An id may have any number of rows: they are told apart by a hash of their text, and equal ones
    are learnt from once.
    """
    known = labels if learn is None else labels.where(learn)
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    # ``rows`` is a parameter: the chosen ids cannot outgrow a broadcast, nor can the chosen pairs.
    known = known.withColumn("h", F.xxhash64("id", F.lit(7)))
    # Hashes above a bound cannot be among the smallest ones: few rows are sorted, however many there are.
    share = (rows + 8 * math.sqrt(rows)) / max(1, known.count())
    if share < 1:
        known = known.where(F.col("h") < F.lit(int(share * 2.0**64) - (1 << 63)))
    chosen = stage(known.orderBy("h", "id").limit(rows), "labelled")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    found = texts.join(F.broadcast(chosen), "id").withColumn("t", F.xxhash64("text", F.lit(11)))
    pairs = found.select("id", "t", F.xxhash64("id", "t").alias("order")).distinct()
    pairs = stage(pairs.orderBy("order", "id", "t").limit(rows).select("id", "t"), "labelled")
    found = found.join(F.broadcast(pairs), ["id", "t"])
    return found.groupBy("id", "t").agg(*[F.min(c).alias(c) for c in ("text", "label", "h")]).select("id", "text", "label", "h")


def shard_names(spark: SparkSession, shards: int = SHARDS) -> list[int]:
    """A number for each shard, such that ``shards`` hash partitions get one each."""
    spread = spark.range(64 * shards).select(F.col("id").cast("int").alias("id"), F.pmod(
        F.hash(F.col("id").cast("int")), F.lit(shards)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    return [r.id for r in sorted(spread, key=lambda r: r.p)]


def fit(sample: DataFrame, learn: Callable[[list[str], np.ndarray], np.ndarray | None], width: int) -> np.ndarray:
    """Averaged weights, the bias last. Without two classes in any share, the bias alone, by the share of ones."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "id", "text"])
        y = frame.label.to_numpy(np.int64)
        w = learn(frame.text.tolist(), y) if 0 < y.sum() < len(y) else None
        made = None if w is None else w.astype(np.float32).tobytes()
        return pd.DataFrame({"shard": frame.shard[:1], "w": [made], "n": [len(y)], "ones": [int(y.sum())]})

    names = F.array(*[F.lit(n) for n in shard_names(sample.sparkSession)])
    dealt = sample.withColumn("shard", F.get(names, F.pmod("h", F.lit(SHARDS)).cast("int"))).repartition(SHARDS, "shard")
    parts = dealt.groupBy("shard").applyInPandas(one, "shard int, w binary, n long, ones long").collect()
    parts.sort(key=lambda r: r.shard)
    weights = [np.frombuffer(p.w, np.float32).astype(np.float64) for p in parts if p.w is not None]
    if weights:
        return np.mean(weights, axis=0).astype(np.float32)
    n, ones = sum(p.n for p in parts), sum(p.ones for p in parts)
    out = np.zeros(width + 1, np.float32)
    out[-1] = np.log((ones + 1) / (n - ones + 1))
    return out


def score(docs: DataFrame, weights: np.ndarray, scorer: Callable[[], Callable[[str, np.ndarray], float]],
          text_col: str, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every row, in [0, 1]; a null text scores as the empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, w = scorer(), shared.value
        for batch in batches:
            z = np.array([margin(text.as_py() or "", w) for text in batch.column(place)], np.float64) + float(w[-1])
            found = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
