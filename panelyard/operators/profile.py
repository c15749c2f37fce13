"""Aggregations, column profiles and distribution summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.plans import attach, exact_quantiles, quantiles_of_table, stage, with_row


def distinct_per_group(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """Distinct values per group (A1). De-duplicated first, so a hot group is counted in pieces."""
    return df.select(*keys, col).distinct().groupBy(*keys).agg(F.count(col).alias(name))


def hierarchy_counts(df: DataFrame, levels: Sequence[str], col: str) -> DataFrame:
    """Distinct values of ``col`` per leaf, summed up the hierarchy (A2); ``level`` is the depth
    of the node (0 = root)."""
    leaves = distinct_per_group(df, levels, col, "n")
    depth = F.lit(len(levels)) - F.bit_count(F.grouping_id())
    return leaves.rollup(*levels).agg(depth.cast("int").alias("level"), F.sum("n").alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))


def column_profile(df: DataFrame) -> DataFrame:
    """Name, type, nulls and distinct values per column (A7), in one pass."""
    aggs = []
    for c in df.columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"),
                 F.count_distinct(F.col(c)).alias(f"distinct_{c}")]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"),
                     F.col(f"nulls_{c}").alias("n_null"), F.col(f"distinct_{c}").alias("n_distinct"))
            for c, kind in df.dtypes]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column and whether there is any."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = wide.unpivot([], df.columns, "column_name", "n_null")
    return long.withColumn("any_null", F.col("n_null") > 0)


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max per column (A8), optionally per group."""
    by = list(by)
    df = stage(df.select(*by, *dict.fromkeys(c for c in cols if c not in by)), "values")
    moments = df.groupBy(*by).agg(*[
        F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                 F.min(F.col(c).cast("double")).alias("min"),
                 F.max(F.col(c).cast("double")).alias("max")).alias(c) for c in cols])
    long = moments.select(*by, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("m")) for c in cols])))
    q = quantiles_of_table(df, cols, [0.25, 0.5, 0.75], by)
    joined = _match(long, q, [*by, "column"])
    return joined.select(
        *by, F.col("column").alias("column_name"), "m.count", "m.mean", "m.std", "m.min",
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "m.max")


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join where null keys match, keeping the left key columns."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    extra = [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return left.alias("a").join(right.alias("b"), same, "left").select("a.*", *extra)


def mode_value(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value, ties to the smallest.

    Values are counted first, so a hot group reaches the last step as its distinct values only;
    the pick itself is an ordinary partial aggregate.
    """
    by = list(by)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("__n"))
    # Largest count, then smallest value: the minimum of (-count, value).
    best = F.min(F.struct((-F.col("__n")).alias("o"), F.col(col).alias("v")))
    return counts.groupBy(*by).agg(best.alias("__b")).select(
        *by, F.col("__b.v").alias(f"{col}_mode"), (-F.col("__b.o")).alias("n"))


def medians(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exact medians (A12): rows (*by, column, median)."""
    q = exact_quantiles(df, cols, [0.5], by)
    return q.select(*by, "column", F.col("q")[0].alias("median"))


def shape_statistics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population skewness and excess kurtosis."""
    wide = df.agg(*[F.struct(F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurt")).alias(c)
                    for c in cols])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c)["skew"].alias("skewness"),
                 F.col(c)["kurt"].alias("kurtosis")) for c in cols])))


def box_statistics(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), whis=1.5) -> DataFrame:
    """Quartiles, whiskers and fliers per column (A14), optionally per group."""
    by = list(by)
    df = stage(df.select(*by, *dict.fromkeys(c for c in cols if c not in by)), "values")
    q = quantiles_of_table(df, cols, [0.25, 0.5, 0.75], by).select(
        *by, "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"),
        F.col("q")[2].alias("q3"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                      for c in cols])
    long = df.select(*by, F.inline(pairs)).filter(F.col("x").isNotNull())
    x = F.col("x")
    reach = whis * (F.col("q3") - F.col("q1"))
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    joined = attach(long, q, [*by, "column"])
    return joined.groupBy(*by, F.col("column").alias("column_name")).agg(
        F.first("q1").alias("q1"), F.first("med").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"))


def tukey_outliers(df: DataFrame, col: str, whis=1.5) -> DataFrame:
    """Rows outside the Tukey fences (N2). The fences are two numbers, a scalar subquery; without
    values there is no row outside them."""
    q = exact_quantiles(df, [col], [0.25, 0.75]).select(F.col("q").alias("__q"))
    low, high = F.col("__q")[0], F.col("__q")[1]
    reach = F.lit(whis) * (high - low)
    outside = (F.col(col) < low - reach) | (F.col(col) > high + reach)
    return with_row(df, q).filter(outside).select(*df.columns)


def contingency(df: DataFrame, a: str, b: str | None = None) -> DataFrame:
    """Rows per category, or per pair of categories."""
    keys = [a] if b is None else [a, b]
    return df.groupBy(*keys).agg(F.count("*").alias("n"))
