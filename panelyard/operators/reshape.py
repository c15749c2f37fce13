"""Wide to long, long to wide, score matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var="d", value="sold") -> DataFrame:
    """Value columns to rows, right after the scan.

    The values of a row are packed into one array and taken apart again, so the plan has one projection, however many
    columns there are.
    """
    packed = F.posexplode(F.array(*[F.col(f"`{c}`") for c in values])).alias("__i", value)
    names = F.array(*[F.lit(c) for c in values])
    return df.select(*ids, packed).select(*ids, F.element_at(names, F.col("__i") + 1).alias(var), value)


def widen(df: DataFrame, ids: Sequence[str], column: str, labels: Sequence, value: str,
          prefix: str = "") -> DataFrame:
    """Sum of ``value`` per label as one column each; known labels save the extra pass."""
    wide = df.groupBy(*ids).pivot(column, list(labels)).agg(F.sum(value))
    return wide.select(*ids, *[F.col(f"`{x}`").alias(f"{prefix}{x}") for x in labels])


def weekday_week_table(df: DataFrame, date_col: str, value: str) -> DataFrame:
    """Sum per weekday and ISO week in long form, with the Monday-first position (R2).

    The week carries no year, so years add up. 7 x 53 cells at most.
    """
    day = F.weekday(date_col) + 1
    week = F.weekofyear(date_col)
    return df.groupBy(day.alias("weekday_no"), week.alias("iso_week")).agg(F.sum(value).alias(value))


def weekday_week_matrix(df: DataFrame, date_col: str, value: str) -> DataFrame:
    """The same table with one column per ISO week, rows Monday to Sunday."""
    long = weekday_week_table(df, date_col, value)
    return widen(long, ["weekday_no"], "iso_week", list(range(1, 54)), value, "w").orderBy(
        "weekday_no")


def without_diagonal(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("feature_name") != F.col("target_name"))


def lower_triangle(scores: DataFrame) -> DataFrame:
    """Pairs on or below the diagonal, in name order."""
    return scores.filter(F.col("feature_name") >= F.col("target_name"))


def score_matrix(scores: DataFrame, targets: Sequence[str], value: str) -> DataFrame:
    """Long scores to a feature x target matrix."""
    return scores.groupBy("feature_name").pivot("target_name", list(targets)).agg(F.first(value))
