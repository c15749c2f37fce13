"""Sequence anomalies: scale, split by time, cut windows, reconstruct, flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators import encode, sequences, split
from panelyard.plans import stage


def analyse(df: DataFrame, order: Sequence[str], value: str, length: int = 50, share: float = 0.7,
            percentile: float = 0.95) -> dict[str, DataFrame]:
    """Errors and flags of the later windows under both baselines, and the mean losses."""
    scaled = encode.min_max_scale(stage(df.select(*order, value), "series"), [value], "")
    parts = split.chronological_fraction(scaled, order, share)
    windows = stage(sequences.sliding_windows(parts, order, value, length, ["split"]), "windows")
    train, val = (windows.filter(F.col("split") == s) for s in ("train", "val"))
    mean = stage(sequences.mean_reconstruction(val).drop("window"), "errors")
    pca = stage(sequences.pca_reconstruction(train, val, max(1, length // 10)).drop("window"), "errors")
    losses = mean.agg(F.lit("mean").alias("baseline"), F.avg("error").alias("loss")).unionByName(
        pca.agg(F.lit("pca").alias("baseline"), F.avg("error").alias("loss")))
    return {
        "losses": losses,
        "mean": sequences.flag_errors(mean, percentile=percentile),
        "pca": sequences.flag_errors(pca, percentile=percentile),
    }
