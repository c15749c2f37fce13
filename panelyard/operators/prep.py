"""Projections, type narrowing, input checks and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.operators.encode import category_codes, category_dictionary
from panelyard.plans import attach, stage

# Type ranges used by the narrowing rule.
INT_RANGES = [
    ("tinyint", -128, 127),
    ("smallint", -32768, 32767),
    ("int", -2147483648, 2147483647),
]
FLOAT16_MAX = 65504.0
FLOAT32_MAX = 3.4028234663852886e38


def split_target(df: DataFrame, target: str) -> tuple[list[str], str]:
    """Feature names and the target name; both stay in one frame so rows cannot drift apart."""
    if target not in df.columns:
        raise ValueError(f"no target column {target}")
    return [c for c in df.columns if c != target], target


def columns_by_cardinality(df: DataFrame, cut: int = 8, approximate: bool = False) -> DataFrame:
    """One row per column: distinct values and 'continuous' (> cut) or 'discrete' (P4)."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(*[count(F.col(c)).alias(c) for c in df.columns])
    long = wide.unpivot([], df.columns, "column_name", "n_distinct")
    kind = F.when(F.col("n_distinct") > cut, "continuous").otherwise("discrete")
    return long.withColumn("kind", kind)


def sentinel_to_null(df: DataFrame, sentinels: Mapping[str, object]) -> DataFrame:
    """Replace a sentinel value by null, per column."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(v)) for c, v in sentinels.items()})


def update_join(df: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overwrite values by key where the change is not null."""
    cols = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in cols])
    out = df.join(new, list(keys), "left")
    out = out.withColumns({c: F.coalesce(F.col(f"__new_{c}"), F.col(c)) for c in cols})
    return out.select(*df.columns)


def align(features: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Features and target in one frame, by key."""
    return features.join(target, list(keys), "inner")


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only; empty when two frames are aligned."""
    count = F.sum("__side")
    sides = left.select(*keys, F.lit(1).alias("__side")).unionByName(
        right.select(*keys, F.lit(-1).alias("__side")))
    return sides.groupBy(*keys).agg(count.alias("surplus")).filter("surplus != 0")


# --- narrowing --------------------------------------------------------------------------------


def narrowing_plan(df: DataFrame) -> DataFrame:
    """Recommended type per column (P9): smallest type with ten-fold head-room, 'category' for
    strings with fewer distinct values than half the rows, 'timestamp' for a text ``date``."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.FractionalType)]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    aggs = [F.count("*").alias("__rows")]
    for c in ints + floats:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    for c in texts:
        # A missing value counts as one more distinct value.
        missing = F.max(F.col(c).isNull().cast("int"))
        aggs.append((F.count_distinct(F.col(c)) + missing).alias(f"nd_{c}"))
    wide = df.agg(*aggs)
    rows = []
    for field in df.schema:
        c = field.name
        if c in ints:
            lo, hi = [F.col(f"{m}_{c}").cast("decimal(38,0)") * 10 for m in ("min", "max")]
            kind = F.lit("bigint")
            for name, low, high in reversed(INT_RANGES):
                kind = F.when((lo > low) & (hi < high), name).otherwise(kind)
        elif c in floats:
            lo, hi = [F.col(f"{m}_{c}").cast("double") * 10 for m in ("min", "max")]
            kind = F.when((lo > -FLOAT16_MAX) & (hi < FLOAT16_MAX), "float16").when(
                (lo > -FLOAT32_MAX) & (hi < FLOAT32_MAX), "float").otherwise("double")
        elif c in texts and c == "date":
            kind = F.lit("timestamp")
        elif c in texts:
            kind = F.when(F.col(f"nd_{c}") / F.col("__rows") < 0.5, "category").otherwise("string")
        else:
            kind = F.lit(field.dataType.simpleString())
        rows.append(F.struct(F.lit(c).alias("column_name"),
                             F.lit(field.dataType.simpleString()).alias("from_type"),
                             kind.alias("to_type")))
    return wide.select(F.inline(F.array(*rows)))


def narrow(df: DataFrame, plan: Mapping[str, str] | None = None) -> DataFrame:
    """Apply ``narrowing_plan``. Spark has no 16-bit float, so that bucket becomes FLOAT; ``encode_frame`` also
    turns categories into codes."""
    plan = plan or {r["column_name"]: r["to_type"] for r in narrowing_plan(df).collect()}
    out = {}
    for c, kind in plan.items():
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            out[c] = F.col(c).cast(kind)
        elif kind == "float16":
            out[c] = F.col(c).cast("float")
        elif kind == "timestamp":
            out[c] = F.try_to_timestamp(F.col(c))
    return df.withColumns(out)


def encode_frame(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``narrow`` with categories as codes (P9): the frame, and the dictionary (column, code, value) that decodes it.

    Codes are positions in the sorted values, -1 for a missing one, in the smallest integer type that holds them.
    """
    plan = {r["column_name"]: r["to_type"] for r in narrowing_plan(df).collect()}
    texts = [c for c, kind in plan.items() if kind == "category"]
    frame = narrow(df, plan)
    if not texts:
        return frame, df.sparkSession.createDataFrame([], "column string, code bigint, value string")
    coded = category_codes(frame, texts, "__code")
    names = F.array(*[F.lit(c) for c in texts])
    known = category_dictionary(frame, texts)
    known = stage(known.select(F.element_at(names, F.col("__column") + 1).alias("column"), "code", F.col("__text").alias("value")), "codes")
    last = {r["column"]: r["last"] for r in known.groupBy("column").agg(F.max("code").alias("last")).collect()}  # a row per column
    for c in texts:
        kind = next((name for name, _, high in INT_RANGES if last.get(c, 0) <= high), "bigint")
        coded = coded.withColumn(c, F.col(f"{c}__code").cast(kind)).drop(f"{c}__code")
    return coded.select(*df.columns), known


def decode_frame(frame: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The values of an encoded frame in place of its codes."""
    coded = {r["column"] for r in dictionary.select("column").distinct().collect()}
    out = frame
    for c in [c for c in frame.columns if c in coded]:
        mine = dictionary.where(F.col("column") == c).select(F.col("code").alias("__code"), F.col("value").alias("__value"))
        out = out.join(mine, F.col(c) == F.col("__code"), "left").withColumn(c, F.col("__value")).drop("__code", "__value")
    return out.select(*frame.columns)


# --- checks -----------------------------------------------------------------------------------


def pick_columns(df: DataFrame, wanted: Sequence[str] | None) -> list[str]:
    """Wanted columns that exist, or all columns when none does (P10)."""
    chosen = [c for c in wanted or [] if c in df.columns]
    return chosen or df.columns


def require_numeric(df: DataFrame, cols: Sequence[str]) -> None:
    kinds = {f.name: f.dataType for f in df.schema}
    bad = [c for c in cols if not isinstance(kinds[c], T.NumericType)]
    if bad:
        raise ValueError(f"columns must be numeric: {bad}")


def require_counts(df: DataFrame, cols: Sequence[str]) -> None:
    """Integer columns without negative values, as the sum-based chi-square score needs."""
    kinds = {f.name: f.dataType for f in df.schema}
    bad = [c for c in cols if not isinstance(kinds[c], T.IntegralType)]
    if bad:
        raise ValueError(f"columns must be integers: {bad}")
    low = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    negative = [c for c in cols if low[c] is not None and low[c] < 0]
    if negative:
        raise ValueError(f"columns must not be negative: {negative}")


def require_mask(mask: Sequence[bool], cols: Sequence[str]) -> None:
    if len(mask) != len(cols):
        raise ValueError("the mask must have one entry per column")


def group_statistic(df: DataFrame, keys: Sequence[str], **stats) -> DataFrame:
    """Per-group aggregates on every row (J7): aggregate, then join back."""
    aggs = [col.alias(name) for name, col in stats.items()]
    return attach(df, df.groupBy(*keys).agg(*aggs), keys)


def input_checks(df: DataFrame) -> DataFrame:
    """Per column: numeric, integer, and free of negative values (P10)."""
    aggs, rows = [], []
    for f in df.schema:
        numeric = isinstance(f.dataType, T.NumericType)
        whole = isinstance(f.dataType, T.IntegralType)
        low = F.min(f.name) if numeric else F.min(F.lit(None).cast("double"))
        aggs.append((low >= 0).alias(f.name))
        rows.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(numeric).alias("is_numeric"),
                             F.lit(whole).alias("is_integer"),
                             F.coalesce(F.col(f.name), F.lit(False)).alias("non_negative")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
