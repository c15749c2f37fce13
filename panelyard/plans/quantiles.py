"""Exact interpolated quantiles of groups of any size, by selection.

A mergeable rank sketch brackets every wanted rank in one scan. A second scan counts: a value inside a bracket by itself, the
values between two brackets together. Running sums over what is left give exact ranks. Values are neither sorted nor
shuffled as a whole: what moves is one sketch per group and task, and the few values inside brackets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.plans.staging import stage

#: Counted values of a group that may stand in brackets; the sketch is as fine as that asks for, within these limits.
WALKED, LEAST_ACCURACY, MOST_ACCURACY = 1 << 20, 1000, 1_000_000
#: A group of so many values is one bracket.
SMALL = 4096
#: Half the width of a bracket, in units of the sketch's error.
REACH = 2.5


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, column, q)``: ``q`` lists the linear-interpolation quantiles at ``probs``.

    Every group of the input has a row for each column; without any value its quantiles are null. Without ``by`` the whole
    table is one group, an empty table too. NaN is the largest value.
    """
    return quantiles_of_table(stage(df.select(*by, *dict.fromkeys(c for c in cols if c not in by)), "values"), cols, probs, by)


def quantiles_of_table(table: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The same for a table that is cheap to read three times."""
    by, cols = list(by), list(cols)
    rows = table.select(*by, *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(cols)])
    accuracy = min(MOST_ACCURACY, max(LEAST_ACCURACY, 4 * int(REACH + 1) * len(probs) * rows.count() // WALKED))
    reach = REACH / accuracy
    while True:
        found = stage(_selected(rows, cols, probs, by, accuracy, reach), "quantiles")
        if found.where("not sure").isEmpty():
            return found.select(*by, "column", "q")
        reach *= 32  # a sketch was worse than it promises


def _selected(rows: DataFrame, cols: Sequence[str], probs: Sequence[float], by: list[str], accuracy: int, reach: float) -> DataFrame:
    """(*by, column, q, sure): ``sure`` is false where a bracket missed its rank."""
    places = [min(1.0, max(0.0, float(p) + side * reach)) for p in probs for side in (-1, 1)]

    def sketch(c: str):
        x = F.col(c)
        whole = F.array(*[F.min(x), F.max(x)] * len(probs))
        bounds = F.percentile_approx(x, places, accuracy)
        return F.struct(F.count(x).alias("n"), F.when(F.count(x) > SMALL, bounds).otherwise(whole).alias("bounds"))

    names = [f"__c{i}" for i in range(len(cols))]
    wide = rows.groupBy(*by).agg(*[sketch(c).alias(c) for c in names])
    brackets = stage(wide.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("__i"), F.col(f"{c}.n").alias("__size"), F.col(f"{c}.bounds").alias("__bounds"))
        for i, c in enumerate(names)]))), "brackets")

    long = rows.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("__i"), F.col(c).alias("__v")) for i, c in enumerate(names)]))).where("__v is not null")
    same = F.col("r.__i") == F.col("b.__i")
    for key in by:
        same = same & F.col(f"r.{key}").eqNullSafe(F.col(f"b.{key}"))
    joined = long.alias("r").join(brackets.alias("b"), same).select("r.*", "__bounds")
    bounds, v = [F.col("__bounds")[i] for i in range(len(places))], F.col("__v")
    inside = reduce(lambda p, q: p | q, [(lo <= v) & (v <= hi) for lo, hi in zip(bounds[::2], bounds[1::2])])
    # A value between brackets stands behind the last bound below it.
    behind = F.greatest(*[F.when(b < v, b) for b in bounds])
    counted = joined.select(*by, "__i", inside.alias("__own"), F.when(inside, F.col("__v")).otherwise(behind).alias("__at"))
    counted = counted.groupBy(*by, "__i", "__own", "__at").agg(F.count("*").alias("__n"))

    order = Window.partitionBy(*by, "__i").orderBy(F.asc_nulls_first("__at"), F.desc("__own"))
    walked = counted.withColumn("__upto", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    all_of_them = F.sum("__n").over(Window.partitionBy(*by, "__i"))
    walked = walked.withColumn("__size", all_of_them)
    picks, values, sure = [], [], F.lit(True)
    for k, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("__size") - 1)
        for name, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            covers = (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto"))
            picks += [F.max(F.when(covers, F.col("__at"))).alias(f"__{name}{k}"),
                      F.coalesce(F.bool_and(F.when(covers, F.col("__own"))), F.lit(False)).alias(f"__s{name}{k}")]
            sure = sure & F.col(f"__s{name}{k}")
        picks.append(F.max(place - F.floor(place)).alias(f"__f{k}"))
        lo, hi, part = F.col(f"__lo{k}"), F.col(f"__hi{k}"), F.col(f"__f{k}")
        values.append(F.when(lo == hi, lo).otherwise((1 - part) * lo + part * hi))
    picked = walked.groupBy(*by, "__i").agg(*picks).select(*by, "__i", F.array(*values).alias("q"), sure.alias("sure"))

    same = F.col("b.__i") == F.col("p.__i")
    for key in by:
        same = same & F.col(f"b.{key}").eqNullSafe(F.col(f"p.{key}"))
    none = F.array(*[F.lit(None).cast("double") for _ in probs])
    column = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("b.__i") + 1)
    return brackets.alias("b").join(picked.alias("p"), same, "left").select(
        *[F.col(f"b.{k}") for k in by], column.alias("column"), F.coalesce("q", none).alias("q"),
        F.coalesce("sure", F.col("__size") == 0).alias("sure"))
