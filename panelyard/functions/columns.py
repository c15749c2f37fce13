"""Scalar column helpers built from Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weekday names and their numbers, Monday first.
WEEKDAYS = {
    "Monday": 1,
    "Tuesday": 2,
    "Wednesday": 3,
    "Thursday": 4,
    "Friday": 5,
    "Saturday": 6,
    "Sunday": 7,
}


def clean_names(names: Sequence[str], first: str = "id") -> list[str]:
    """Lower-case names with underscores; an unnamed first column becomes ``first``."""
    out = []
    for i, name in enumerate(names):
        unnamed = i == 0 and name in ("", "_c0", "Unnamed: 0")
        out.append(first if unnamed else name.replace(" ", "_").lower())
    return out


def names_matching(df: DataFrame, pattern: str) -> list[str]:
    """Column names that match ``pattern`` from their start."""
    return [c for c in df.columns if re.match(pattern, c)]


def names_of_type(df: DataFrame, *types: str) -> list[str]:
    """Column names whose Spark type is one of ``types`` (P5)."""
    return [name for name, kind in df.dtypes if kind in types]


def flag(col: str, equals) -> Column:
    """1 where the column equals the value, else 0; a null counts as different."""
    return F.coalesce((F.col(col) == F.lit(equals)).cast("int"), F.lit(0))


def lookup(col: Column, table: Mapping) -> Column:
    """Dictionary lookup, null for unknown keys."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), col)


def weekday_number(date: Column) -> Column:
    """1 for Monday to 7 for Sunday, by name."""
    return lookup(F.date_format(date, "EEEE"), WEEKDAYS)


def day_number(col: Column) -> Column:
    """``d_17`` to 17."""
    return F.split_part(col, F.lit("_"), F.lit(2)).cast("int")


def digits(col: Column) -> Column:
    return F.regexp_extract(col, r"(\d+)", 1).cast("int")


def without_suffix(col: Column, suffix: str) -> Column:
    return F.regexp_replace(col, re.escape(suffix) + "$", "")


def count_label(name: Column, n: Column) -> Column:
    """``name (n)``."""
    return F.concat(name, F.lit(" ("), n.cast("string"), F.lit(")"))


def clip_round(col: Column) -> Column:
    """Clip at 0 and round half to even."""
    return F.rint(F.greatest(col, F.lit(0.0)))


def stable_round(col: Column, digits: int) -> Column:
    """Round and turn -0.0 into 0.0."""
    return F.round(col, digits) + F.lit(0.0)


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation over complete pairs, null for constant columns (``corr`` raises on
    them in ANSI mode)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))
