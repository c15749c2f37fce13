"""Samples that come out the same on every run and on every partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.plans import attach, hash_cut, hash_key, with_global_index


def every_kth(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Rows 0, step, 2*step, ... with step = max(1, N // size), at most ``size`` rows (M1).

    ``order`` must be a total order without nulls. Only its columns are sorted; the sampled keys
    then pick their rows.
    """
    step = max(1, df.count() // size)
    i = F.col("__idx")
    indexed = with_global_index(df.select(*order), order, "__idx")
    keys = indexed.filter((F.pmod(i, F.lit(step)) == 0) & (i < step * size)).drop("__idx")
    return attach(df, keys, order, "left_semi")


def keys_per_group(df: DataFrame, group: str, key: str, n: int, seed=0) -> DataFrame:
    """All rows of up to ``n`` random keys per group.

    The keys are distinct first; a top-n per group is cut in every map task before the shuffle.
    """
    keys = df.select(group, key).distinct()
    place = F.row_number().over(Window.partitionBy(group).orderBy(hash_key(key, seed), key))
    chosen = keys.withColumn("__r", place).filter(F.col("__r") <= n).select(key).distinct()
    return attach(df, chosen, [key], "left_semi")


def keep_share_of_keys(df: DataFrame, key: str, rate: float, seed=42) -> DataFrame:
    """All rows of ``max(1, int(rate * number of keys))`` random keys; rate >= 1 keeps all (M3).

    The chosen keys are those whose hash is below a cut, so the fact table is only filtered. Rows
    without a key go.
    """
    if rate >= 1:
        return df
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    keys = keys.select(hash_key(key, seed).alias("h"))
    cuts = hash_cut(keys, "h", lambda n: [max(1, int(n * rate))] if n else [])
    return df.filter(F.col(key).isNotNull() & (hash_key(key, seed) <= F.lit(cuts[0] if cuts else "")))


def random_rows(df: DataFrame, key: str | Sequence[str], n: int, seed=0) -> DataFrame:
    """``n`` random rows (M4, V8), by a cut in hash order; all rows if there are no more."""
    hashed = df.withColumn("__h", hash_key(key, seed))
    cuts = hash_cut(hashed, "__h", lambda rows: [n] if n < rows else [])
    return hashed.filter(F.col("__h") <= F.lit(cuts[0])).drop("__h") if cuts else df


def passthrough(df: DataFrame) -> DataFrame:
    """Identity stage (M0)."""
    return df
