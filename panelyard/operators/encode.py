"""Category codes, imputation and scaling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from panelyard.operators.profile import mode_value
from panelyard.plans import attach, quantiles_of_table, stage, with_global_index, with_row


def _sort_key(df: DataFrame, col: str) -> tuple[Column, Column, Column]:
    """A value as (number, double, text) of which one is set; its order is that of the column."""
    kind, c = df.schema[col].dataType, F.col(f"`{col}`")
    number, double, text = F.lit(None).cast("decimal(38,18)"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(kind, T.StringType):
        text = c
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        double = c.cast("double")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(c).cast("decimal(38,18)")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_micros(c.cast("timestamp")).cast("decimal(38,18)")
    elif isinstance(kind, T.BooleanType):
        number = c.cast("int").cast("decimal(38,18)")
    elif isinstance(kind, T.NumericType):
        number = c.cast("decimal(38,18)")
    else:
        raise ValueError(f"{col} has no sorted values: {kind.simpleString()}")
    return number, double, text


_KEY = ("__number", "__double", "__text")


def category_dictionary(df: DataFrame, cols: Sequence[str], first: int = 0) -> DataFrame:
    """(column, number, double, text, code): the distinct values of all columns, numbered per column in sorted order.

    The columns share one exchange of their distinct values and one range sort, so an id column with billions of
    values does not end up in one task. ``column`` is the place in ``cols``; codes count from ``first`` on.
    """
    each = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("__column"), *[k.alias(n) for k, n in zip(_sort_key(df, c), _KEY)]) for i, c in enumerate(cols)])))
    known = each.where(" or ".join(f"{k} is not null" for k in _KEY)).distinct()
    placed = stage(with_global_index(known, ["__column", *_KEY], "__place"), "dictionary", partition_by="__column")
    starts = placed.groupBy("__column").agg(F.min("__place").alias("__start"))  # a row for each column
    return placed.join(F.broadcast(starts), "__column").select(
        "__column", *_KEY, (F.col("__place") - F.col("__start") + F.lit(first)).alias("code"))


def category_mapping(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of one column numbered from 0 in sorted order."""
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    return with_global_index(values, [col], "code").select(col, "code")


def category_codes(df: DataFrame, cols: Sequence[str], suffix: str = "_code", first: int = 0) -> DataFrame:
    """BIGINT codes, missing values -1; one dictionary serves all columns."""
    known = category_dictionary(df, cols, first)
    for i, c in enumerate(cols):
        # The files of one column are all that is read, so its size decides how it is joined.
        mine = known.where(F.col("__column") == i).drop("__column").withColumnRenamed("code", "__code")
        place = _KEY.index(_used(df, c))
        df = df.join(mine, _sort_key(df, c)[place] == F.col(_KEY[place]), "left").withColumn(f"{c}{suffix}", F.coalesce("__code", F.lit(-1))).drop(*_KEY, "__code")
    return df


def _used(df: DataFrame, col: str) -> str:
    kind = df.schema[col].dataType
    if isinstance(kind, T.StringType):
        return "__text"
    return "__double" if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else "__number"


def one_hot(df: DataFrame, col: str, values: Sequence, drop=None) -> DataFrame:
    """0/1 columns for the given values (E3), without the ``drop`` value."""
    flags = {f"{col}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0))
             for v in values if v != drop}
    return df.withColumns(flags)


def impute_mode(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Fill missing values by the mode, global or per group (E5)."""
    modes = mode_value(df, col, by).drop("n")
    if not by:
        value = modes.first()
        return df if value is None else df.withColumn(col, F.coalesce(col, F.lit(value[0])))
    out = attach(df, modes, by)
    return out.withColumn(col, F.coalesce(F.col(col), F.col(f"{col}_mode"))).drop(f"{col}_mode")


def impute_median(df: DataFrame, col: str, series: str) -> DataFrame:
    """Fill by the median of the series, then what is left by the median of the result."""
    table = stage(df.select(series, col), "values")
    own = quantiles_of_table(table, [col], [0.5], [series]).select(F.col(series).alias("__series"), F.col("q")[0].alias("__own"))
    same = F.col(series).eqNullSafe(F.col("__series"))
    half = table.join(own, same, "left").select(F.coalesce(F.col(col).cast("double"), F.col("__own")).alias("__v"))
    rest = quantiles_of_table(half, ["__v"], [0.5]).select(F.col("q")[0].alias("__rest"))
    out = with_row(df.join(own, same, "left"), rest)
    return out.withColumn(col, F.coalesce(F.col(col), F.col("__own"), F.col("__rest"))).select(*df.columns)


def standard_scale(df: DataFrame, cols: Sequence[str], suffix="_scaled") -> DataFrame:
    """(x - mean) / population std; a constant column is only centred."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return df.withColumns({
        f"{c}{suffix}": (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)
        for c in cols})


def min_max_scale(df: DataFrame, cols: Sequence[str], suffix="_scaled") -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    stats = df.agg(*[F.min(c).cast("double").alias(f"a_{c}") for c in cols],
                   *[F.max(c).cast("double").alias(f"b_{c}") for c in cols]).first()
    out = {}
    for c in cols:
        low, high = stats[f"a_{c}"], stats[f"b_{c}"]
        width = (high - low) if low is not None else None
        out[f"{c}{suffix}"] = (F.col(c) - F.lit(low)) / F.lit(width or 1.0)
    return df.withColumns(out)


def batch_min_max(df: DataFrame, col: str, order: Sequence[str], batch_rows: int,
                  keep_fitting=True, suffix="_scaled") -> DataFrame:
    """Min-max scaling refitted on every batch of ``batch_rows`` consecutive rows, or with the
    parameters of the first batch when fitting is frozen (E11)."""
    indexed = with_global_index(df, order, "__idx")
    indexed = indexed.withColumn("batch", F.floor(F.col("__idx") / batch_rows).cast("bigint"))
    if keep_fitting:
        # A batch never has more than ``batch_rows`` rows, so a window per batch is bounded.
        w = Window.partitionBy("batch")
        low, high = F.min(col).over(w).cast("double"), F.max(col).over(w).cast("double")
    else:
        first = indexed.filter("batch = 0").agg(
            F.min(col).cast("double"), F.max(col).cast("double")).first()
        low, high = F.lit(first[0]), F.lit(first[1])
    out = indexed.withColumn("__lo", low).withColumn("__hi", high)
    width = F.col("__hi") - F.col("__lo")
    scaled = (F.col(col) - F.col("__lo")) / F.when(width == 0, 1.0).otherwise(width)
    return out.withColumn(f"{col}{suffix}", scaled).drop("__idx", "__lo", "__hi")


def fourier_weights(width: int, components=100, gamma=1.0, seed=0) -> tuple[np.ndarray, np.ndarray]:
    """W ~ N(0, 2 gamma), one row for each of ``width`` values, and b ~ U(0, 2 pi)."""
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2.0 * gamma), (width, components)), rng.uniform(0.0, 2.0 * np.pi, components)


def random_fourier(df: DataFrame, cols: str | Sequence[str], components=100, gamma=1.0, seed=0, output="rff") -> DataFrame:
    """sqrt(2/m) cos(xW + b) of numeric columns or of one vector column (E12); see ``fourier_weights``.

    The rows go through numpy in Arrow batches.
    """
    x = vector_to_array(F.col(cols)) if isinstance(cols, str) else F.array(*[F.col(c).cast("double") for c in cols])

    @pandas_udf("array<double>")
    def project(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        x = np.stack(rows.to_list()).astype(float)
        w, b = fourier_weights(x.shape[1], components, gamma, seed)
        return pd.Series(list(np.sqrt(2.0 / components) * np.cos(x @ w + b)))

    return df.withColumn(output, array_to_vector(project(x)))


def multiply_columns(df: DataFrame, cols: Sequence[str], factor: float) -> DataFrame:
    """Every column times a constant."""
    return df.withColumns({c: F.col(c) * F.lit(float(factor)) for c in cols})
