"""Bring per-key statistics back onto the rows they came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.plans.staging import stage


def attach(fact: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``stats`` (one row per key) onto ``fact``.

    ``stats`` is staged first. Its size on disk is then known, so Catalyst broadcasts it when it
    is small and the fact table does not move; when it is large the join is a shuffle join whose
    hot keys AQE splits (the fact side is the outer side, which is the side it may split).
    """
    return fact.join(stage(stats, "stats"), list(keys), how)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (a global aggregate) to every row, as a scalar
    subquery."""
    packed = row.select(F.struct(*row.columns).alias("__row")).scalar()
    out = df.withColumn("__row", packed)
    return out.select(*df.columns, *[F.col("__row")[c].alias(c) for c in row.columns])
