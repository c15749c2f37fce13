"""Positions and running totals over a total order, with no single-task window.

The frame is range-partitioned on its order columns and sorted inside each partition.
``monotonically_increasing_id`` then holds the partition number (upper bits) and the position
inside the partition (lower 33 bits). Both are frozen in a staged table, because a second
evaluation may sample other range bounds. What is left is a table of one row per partition
(times groups) whose running sums are the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.plans.staging import stage

_SLOT = "__slot"
_PART = "__slot_part"
_POS = "__slot_pos"


def _range_slots(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn(_SLOT, F.monotonically_increasing_id())
    return (
        stage(placed, "ranged")
        .withColumn(_PART, F.shiftright(_SLOT, 33))
        .withColumn(_POS, F.col(_SLOT).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(_SLOT)
    )


def with_global_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """Add the 0-based position of each row in ``order`` (which must be a total order)."""
    slots = _range_slots(df, order)
    # One row per range partition: the window below sees a few thousand rows at most.
    sizes = slots.groupBy(_PART).agg(F.count("*").alias("__n"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        _PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("bigint").alias("__offset")
    )
    return (
        slots.join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col("__offset") + F.col(_POS))
        .drop(_PART, _POS, "__offset")
    )


def with_running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column, name: str
) -> DataFrame:
    """Add the running sum of ``weight`` inside each ``by`` group along ``order``.

    A group may span any number of range partitions, so its size is not bounded by a task.
    """
    slots = _range_slots(df.withColumn("__w", weight), [*by, *order])
    inside = Window.partitionBy(_PART, *by).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        slots.groupBy(_PART, *by)
        .agg(F.sum("__w").alias("__s"))
        .select(_PART, *by, F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__carry"))
    )
    local = slots.withColumn("__run", F.sum("__w").over(inside))
    same = F.col(f"l.{_PART}") == F.col(f"r.{_PART}")
    for key in by:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    kept = [F.col(f"l.{c}") for c in df.columns]
    return (
        local.alias("l")
        .join(carried.alias("r"), same)
        .select(*kept, (F.col("l.__run") + F.col("r.__carry")).alias(name))
    )


def with_series_position(
    df: DataFrame, series: Sequence[str], order: Sequence[str], name: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row inside its series."""
    total = with_running_total(df, series, order, F.lit(1).cast("bigint"), name)
    return total.withColumn(name, F.col(name) - 1)
