"""Association between columns and shape of series.

Each operator makes one aggregation pass over the rows; pairs of columns are handled on the
small tables that come out of it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.columns import safe_corr
from panelyard.functions.special import chi2_tail_udf, f_tail_udf
from panelyard.operators.encode import standard_scale
from panelyard.operators.prep import require_counts, require_numeric
from panelyard.operators.profile import _match
from panelyard.plans import (
    attach,
    exact_quantiles,
    stage,
    with_row,
    with_running_total,
    with_series_position,
)


def _pair_rows(wide: DataFrame, entries) -> DataFrame:
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("feature_name"), F.lit(b).alias("target_name"),
                 expr.cast("double").alias("score")) for a, b, expr in entries])))


def pearson(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """Signed correlation of all pairs, or of every column with ``target`` (K1).

    One aggregation; a constant column scores 0.
    """
    require_numeric(df, [*cols, *([target] if target else [])])
    targets = [target] if target else list(cols)
    wanted = sorted({tuple(sorted((a, b))) for a in cols for b in targets})
    wide = df.agg(*[
        F.coalesce(safe_corr(a, b), F.lit(0.0)).alias(f"{a}|{b}")
        for a, b in wanted])
    return _pair_rows(wide, [
        (a, b, F.col(f"`{min(a, b)}|{max(a, b)}`")) for a in cols for b in targets])


def average_ranks(df: DataFrame, cols: Sequence[str], weight: str) -> DataFrame:
    """Average rank (from 1) of every distinct value per column: rows (column, value, rank)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                      for c in cols])
    counts = df.select(weight, F.inline(pairs)).groupBy("column", "value").agg(
        F.sum(weight).alias("__n"))
    walked = with_running_total(counts, ["column"], ["value"], F.col("__n"), "__upto")
    rank = F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2
    return walked.select("column", "value", rank.alias("rank"))


def spearman(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """Rank correlation with average ranks (K2); 0 for constant columns and for columns with
    missing values.

    Equal rows are merged first. Ranks come from distributed running totals over the distinct
    values, so neither ties nor long columns gather in one task.
    """
    used = sorted({*cols, *([target] if target else [])})
    require_numeric(df, used)
    targets = [target] if target else list(cols)
    rows = stage(df.groupBy(*used).agg(F.count("*").alias("__w")), "tuples")
    total, *known = rows.agg(F.sum("__w"), *[
        F.sum(F.when(F.col(c).isNotNull(), F.col("__w"))) for c in used]).first()
    full = {c for c, n in zip(used, known) if n == total}
    if not full:
        return _pair_rows(df.sparkSession.range(1), [
            (a, b, F.lit(0.0)) for a in cols for b in targets])
    # One folder per column, so the ranks of a column with few values are broadcast on their own
    # size whatever the other columns hold.
    ranks = stage(average_ranks(rows, sorted(full), "__w"), "ranks", "column")
    middle = (total + 1) / 2.0
    for c in sorted(full):
        own = ranks.filter(F.col("column") == c).select(
            F.col("value").alias(f"__v_{c}"), (F.col("rank") - middle).alias(f"__r_{c}"))
        rows = rows.join(own, F.col(c).cast("double") == F.col(f"__v_{c}")).drop(f"__v_{c}")
    w = F.col("__w")
    wanted = sorted({tuple(sorted((a, b))) for a in cols for b in targets if {a, b} <= full})
    aggs = [F.sum(w * F.col(f"__r_{c}") ** 2).alias(f"__q_{c}") for c in sorted(full)]
    aggs += [F.sum(w * F.col(f"__r_{a}") * F.col(f"__r_{b}")).alias(f"__x_{a}|{b}")
             for a, b in wanted]
    wide = rows.agg(*aggs)

    def score(a: str, b: str) -> Column:
        if not {a, b} <= full:
            return F.lit(0.0)
        norm = F.sqrt(F.col(f"__q_{a}")) * F.sqrt(F.col(f"__q_{b}"))
        return F.coalesce(F.try_divide(F.col(f"`__x_{min(a, b)}|{max(a, b)}`"), norm), F.lit(0.0))

    return _pair_rows(wide, [(a, b, score(a, b)) for a in cols for b in targets])


# --- variance ratios ---------------------------------------------------------------------------


def _f_from_groups(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """F and p from per-group n, mean and population variance."""
    n, m = F.col("n"), F.col("mean")
    sums = groups.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n").alias("rows"),
        (F.sum(n * m) / F.sum("n")).alias("grand"), F.sum(n * F.col("var")).alias("within"),
        F.sum(n * m * m).alias("__nmm"))
    # Between sum of squares, from deviations joined back to keep precision.
    joined = groups.join(sums.select(*by, "grand"), list(by))
    between = joined.groupBy(*by).agg(
        F.sum(n * (m - F.col("grand")) ** 2).alias("between"))
    out = sums.drop("__nmm").join(between, list(by))
    d1, d2 = F.col("k") - 1, F.col("rows") - F.col("k")
    f = F.try_divide(F.try_divide(F.col("between"), d1), F.try_divide(F.col("within"), d2))
    out = out.withColumn("f_score", f).withColumn("dof1", d1).withColumn("dof2", d2)
    return out.withColumn(
        "p_value", F.when(F.col("f_score").isNotNull(), f_tail_udf("f_score", "dof1", "dof2")))


def f_classif(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """F and p of each numeric column against the classes of ``target`` (K3)."""
    require_numeric(df, cols)
    stats = df.groupBy(target).agg(*[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var")).alias(c)
        for c in cols])
    long = stats.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature_name"), F.col(c).alias("s")) for c in cols])))
    groups = stage(long.select("feature_name", "s.*").filter("n > 0"), "groups")
    return _f_from_groups(groups, ["feature_name"]).select(
        "feature_name", F.lit(target).alias("target_name"), "f_score", "p_value")


def f_regression(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """F = r^2 / (1 - r^2) * (n - 2) and p (K4)."""
    require_numeric(df, [*cols, target])
    wide = df.agg(*[F.struct(safe_corr(c, target).alias("r"),
                             F.count(F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), 1))
                             .alias("n")).alias(c) for c in cols])
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature_name"), F.col(c)["r"].alias("r"), F.col(c)["n"].alias("n"))
        for c in cols])))
    r2 = F.col("r") * F.col("r")
    f = F.try_divide(r2, 1 - r2) * (F.col("n") - 2)
    out = long.withColumn("f_score", f)
    p = f_tail_udf(F.col("f_score"), F.lit(1), F.col("n") - 2)
    return out.select("feature_name", F.lit(target).alias("target_name"), "f_score",
                      F.when(F.col("f_score").isNotNull(), p).alias("p_value"))


def chi2_score(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Sum-based chi-square (K5): observed = sum of x per class, expected = class share times
    the total of x. Integer, non-negative columns only."""
    require_counts(df, cols)
    per_class = df.groupBy(target).agg(
        F.count("*").alias("n"), *[F.sum(c).cast("double").alias(c) for c in cols])
    long = stage(per_class.select("n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature_name"), F.col(c).alias("observed")) for c in cols]))),
        "classes")
    totals = long.groupBy("feature_name").agg(
        F.sum("n").alias("rows"), F.sum("observed").alias("total"), F.count("*").alias("k"))
    expected = F.col("n") / F.col("rows") * F.col("total")
    cells = long.join(totals, "feature_name").withColumn("expected", expected)
    out = cells.groupBy("feature_name").agg(
        F.sum(F.try_divide((F.col("observed") - F.col("expected")) ** 2, F.col("expected")))
        .alias("chi2"), (F.max("k") - 1).alias("dof"))
    return out.select("feature_name", F.lit(target).alias("target_name"), "chi2",
                      F.when(F.col("chi2").isNotNull(), chi2_tail_udf("chi2", "dof")).alias("p_value"))


# --- categorical against target ----------------------------------------------------------------


def complete_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns without a missing value."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] == 0]


def category_rows(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows (*keep, column_name, level): one per row and category column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level"))
                      for c in cols])
    return df.select(*keep, F.inline(pairs))


def chi2_independence(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Contingency test of a categorical target against each complete column (K6), with the
    continuity correction for 2 x 2 tables.

    Uses sum(o^2 / e) - N, so only cells that occur are visited.
    """
    df = df.filter(F.col(target).isNotNull())
    usable = complete_columns(df, [c for c in cols if c != target])
    # Merged first: the table of distinct tuples is what gets unpivoted.
    merged = df.groupBy(target, *usable).agg(F.count("*").alias("w"))
    cells = stage(
        category_rows(merged, usable, [target, "w"])
        .groupBy("column_name", "level", target).agg(F.sum("w").alias("o")), "cells")
    rows = cells.groupBy("column_name", "level").agg(F.sum("o").alias("r"))
    classes = cells.groupBy("column_name", target).agg(F.sum("o").alias("c"))
    sizes = rows.groupBy("column_name").agg(
        F.sum("r").alias("n"), F.count("*").alias("n_rows"), F.sum(1 / F.col("r")).alias("inv_r"))
    sizes = sizes.join(
        classes.groupBy("column_name").agg(
            F.count("*").alias("n_cols"), F.sum(1 / F.col("c")).alias("inv_c")), "column_name")
    full = (cells.join(rows, ["column_name", "level"]).join(classes, ["column_name", target])
            .join(sizes.select("column_name", "n"), "column_name"))
    expected = F.col("r") * F.col("c") / F.col("n")
    sums = full.groupBy("column_name").agg(
        F.sum(F.col("o") * F.col("o") / expected).alias("s"),
        F.max(F.abs(F.col("o") - expected)).alias("gap"))
    out = sums.join(sizes, "column_name")
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    plain = F.greatest(F.col("s") - F.col("n"), F.lit(0.0))
    corrected = F.when(F.col("gap") == 0, 0.0).otherwise(
        (F.col("gap") - 0.5) ** 2 * F.col("n") * F.col("inv_r") * F.col("inv_c"))
    out = out.select("column_name", dof.cast("bigint").alias("dof"),
                     F.when(dof == 1, corrected).otherwise(plain).alias("chi2"))
    return out.withColumn("p_value", chi2_tail_udf("chi2", "dof")).orderBy("p_value", "column_name")


def anova_by_category(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """One-way ANOVA of a numeric target over each complete categorical column (K7)."""
    df = df.filter(F.col(target).isNotNull())
    usable = complete_columns(df, [c for c in cols if c != target])
    groups = stage(
        category_rows(df, usable, [target]).groupBy("column_name", "level").agg(
            F.count("*").alias("n"), F.avg(target).alias("mean"), F.var_pop(target).alias("var")),
        "groups")
    return _f_from_groups(groups, ["column_name"]).select(
        "column_name", "f_score", "p_value").orderBy("p_value", "column_name")


def categorical_relationship(df: DataFrame, target: str) -> DataFrame:
    """Chi-square for a text target, ANOVA for a numeric one, over all text columns."""
    texts = [c for c, kind in df.dtypes if kind == "string" and c != target]
    if dict(df.dtypes)[target] == "string":
        return chi2_independence(df, target, texts)
    return anova_by_category(df, target, texts)


# --- mutual information ------------------------------------------------------------------------


def mutual_information(df: DataFrame, cols: Sequence[str], target: str | None = None) -> DataFrame:
    """Mutual information (nats) of discrete columns (K8): H(a) + H(b) - H(a, b).

    One grouping-sets pass counts the cells of every single column and every needed pair. Cells are added up in the tasks
    first, so what is shuffled grows with the cells and not with the rows, however many of them differ.
    """
    targets = [target] if target else list(cols)
    used = sorted({*cols, *targets})
    pairs = [p for p in combinations(used, 2)
             if (p[0] in cols and p[1] in targets) or (p[1] in cols and p[0] in targets)]
    sets = [(c,) for c in used] + pairs
    counted = df.select(*used).groupingSets([[F.col(c) for c in s] for s in sets], *used).agg(
        F.grouping_id().alias("__set"), F.count("*").alias("__n"))
    n = F.col("__n")
    sums = counted.groupBy("__set").agg(
        F.sum(n * F.log(n)).alias("nlogn"), F.sum("__n").alias("rows"))
    # Entropy = ln N - sum(n ln n) / N; one row per set.
    sums = sums.select("__set", (F.log("rows") - F.col("nlogn") / F.col("rows")).alias("h"))

    def set_id(names) -> int:
        return sum(0 if c in names else 1 << (len(used) - 1 - i) for i, c in enumerate(used))

    def entropy(names) -> Column:
        return F.max(F.when(F.col("__set") == set_id(names), F.col("h")))

    wide = sums.agg(*[entropy(s).alias("|".join(s)) for s in sets])

    def score(a: str, b: str) -> Column:
        if a == b:
            return F.col(f"`{a}`")
        both = F.col(f"`{min(a, b)}|{max(a, b)}`")
        return F.greatest(F.col(f"`{a}`") + F.col(f"`{b}`") - both, F.lit(0.0))

    return _pair_rows(wide, [(a, b, score(a, b)) for a in cols for b in targets]).withColumnRenamed(
        "score", "mi")


def quantile_bins(df: DataFrame, cols: Sequence[str], bins: int = 10, suffix="_bin") -> DataFrame:
    """Bin number = how many inner quantile edges lie below the value."""
    probs = [i / bins for i in range(1, bins)]
    edges = {row["column"]: row["q"] for row in exact_quantiles(df, cols, probs).collect()}

    def bin_of(c: str) -> Column:
        inner = F.array(*[F.lit(e) for e in edges[c]])
        below = F.size(F.filter(inner, lambda edge: edge < F.col(c)))
        return F.when(F.col(c).isNotNull(), below)

    return df.withColumns({f"{c}{suffix}": bin_of(c) for c in cols})


def mixed_mutual_information(df: DataFrame, discrete: Sequence[str], continuous: Sequence[str],
                             target: str | None = None, bins: int = 10) -> DataFrame:
    """Mutual information with continuous sides (K9): continuous columns are cut at their exact
    quantiles, then counted like discrete ones. A nearest-neighbour estimate would need all
    pairs of rows."""
    binned = quantile_bins(df, continuous, bins, "") if continuous else df
    return mutual_information(binned, [*discrete, *continuous], target)


# --- cycles ------------------------------------------------------------------------------------

#: Points that a task transforms at once; one short transform of a long series may have more, but never above twice the
#: root of four times its points.
POINTS = 1 << 12


def _chirp(t: np.ndarray, n: int) -> np.ndarray:
    """exp(i pi t^2 / n), the angle reduced first."""
    return np.exp(1j * np.pi * (t * t % (2 * n)) / n)


class _Grid:
    """How a series of ``n`` points is laid out: a power of two M >= 2 n - 1, as A times B.

    A time is r + A s, a frequency q + B p; tasks take some of the r, then some of the q, then some of the r.
    """

    def __init__(self, n: int, points: int):
        bits = (2 * n - 2).bit_length()
        self.n, self.m = n, 1 << bits
        self.a, self.b = 1 << bits // 2, 1 << bits - bits // 2
        self.rows, self.columns = max(1, points // self.b), max(1, points // self.a)

    def block(self, number: int, step: int, end: int) -> np.ndarray:
        return np.arange(number * step, min(end, (number + 1) * step))


def seasonal_cycles(df: DataFrame, order: str, value: str, series: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    """Magnitude of the Fourier transform of regularly spaced series, without the zero frequency
    (K10): rows (*series, k, period, amplitude, share).

    Chirp transform: with n k = (n^2 + k^2 - (k - n)^2) / 2 the sum over n is a convolution with a chirp, which is
    taken as a circular one of a power of two, whatever the length. That one is done in three rounds of short transforms: over time,
    over frequency and back in one task, over time again. No task holds a series. Null and NaN values make the
    whole spectrum of their series NaN.
    """
    series = list(series)
    rows = df.select(*series, order, F.col(value).cast("double").alias("__x"))
    placed = with_series_position(rows, series, [order], "__t").drop(order)
    placed = stage(placed, "placed")
    sizes = placed.groupBy(*series).agg(F.count("*").alias("__n"), F.avg("__x").alias("__mean")).where("__n > 1")
    placed = _match(placed, stage(sizes, "sizes"), series).where("__n > 1") if series else with_row(placed, sizes).where("__n > 1")
    # The constant part adds to the zero frequency only; without it the others lose no digits to it.
    placed = placed.withColumn("__x", F.coalesce(F.col("__x") - F.col("__mean"), F.lit(float("nan"))))
    bits = F.length(F.bin(2 * F.col("__n") - 2))
    a, b = (F.expr(f"shiftleft(1L, {e})") for e in ("__bits div 2", "__bits - __bits div 2"))
    placed = placed.withColumn("__bits", bits).withColumn(
        "__block", F.floor(F.pmod("__t", a) / F.greatest(F.lit(1), F.floor(F.lit(points) / b))).cast("bigint"))

    kinds = dict(df.dtypes)
    head = [f"`{c}` {kinds[c]}" for c in series]
    between = ", ".join([*head, "__n bigint", "__block bigint", "__at bigint", "__part bigint", "__values binary"])

    def out_of(pdf: pd.DataFrame, columns: dict) -> pd.DataFrame:
        found = pd.DataFrame(columns)
        for c in series:
            found[c] = pdf[c].iloc[0]
        return found

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = _Grid(int(pdf["__n"].iloc[0]), points)
        r = grid.block(int(pdf["__block"].iloc[0]), grid.rows, grid.a)
        t = pdf["__t"].to_numpy()
        x = np.zeros((2, len(r), grid.b), complex)
        x[0, t % grid.a - r[0], t // grid.a] = pdf["__x"].to_numpy() * np.conj(_chirp(t, grid.n))
        at = r[:, None] + grid.a * np.arange(grid.b)
        away = np.minimum(at, grid.m - at)
        x[1] = np.where(away < grid.n, _chirp(away, grid.n), 0)
        x = np.fft.fft(x, axis=2) * np.exp(-2j * np.pi * (r[:, None] * np.arange(grid.b)) / grid.m)
        parts = range(-(-grid.b // grid.columns))
        cut = [(i, p, x[:, k, p * grid.columns:(p + 1) * grid.columns].tobytes()) for k, i in enumerate(r.tolist()) for p in parts]
        at, part, values = zip(*cut)
        return out_of(pdf, {"__n": grid.n, "__block": part, "__at": at, "__part": 0, "__values": values})[names]

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__at")
        grid, block = _Grid(int(pdf["__n"].iloc[0]), points), int(pdf["__block"].iloc[0])
        q = grid.block(block, grid.columns, grid.b)
        x = np.frombuffer(b"".join(pdf["__values"]), complex).reshape(grid.a, 2, len(q))
        x = np.fft.fft(x, axis=0)
        y = np.fft.ifft(x[:, 0] * x[:, 1], axis=0) * np.exp(2j * np.pi * (np.arange(grid.a)[:, None] * q) / grid.m)
        at = np.arange(grid.a)
        return out_of(pdf, {"__n": grid.n, "__block": at // grid.rows, "__at": at, "__part": block,
                            "__values": [row.tobytes() for row in y]})[names]

    def third(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__at", "__part"])
        grid = _Grid(int(pdf["__n"].iloc[0]), points)
        r = grid.block(int(pdf["__block"].iloc[0]), grid.rows, grid.a)
        y = np.fft.ifft(np.frombuffer(b"".join(pdf["__values"]), complex).reshape(len(r), grid.b), axis=1)
        k = r[:, None] + grid.a * np.arange(grid.b)
        keep = (k >= 1) & (k <= grid.n // 2)
        k = k[keep]
        return out_of(pdf, {"k": k, "period": grid.n / k, "amplitude": np.abs(y[keep])})[[*series, "k", "period", "amplitude"]]

    names = [*series, "__n", "__block", "__at", "__part", "__values"]
    full = ", ".join([*head, "k bigint", "period double", "amplitude double"])
    out = (placed.groupBy(*series, "__block").applyInPandas(first, between)
           .groupBy(*series, "__block").applyInPandas(second, between)
           .groupBy(*series, "__block").applyInPandas(third, full))
    out = stage(out, "cycles")
    total = out.groupBy(*series).agg(F.sum("amplitude").alias("__total"))
    out = _match(out, stage(total, "totals"), series) if series else with_row(out, total)
    share = F.try_divide("amplitude", F.col("__total"))
    return out.withColumn("share", share).drop("__total")


def top_cycles(cycles: DataFrame, n: int = 5) -> DataFrame:
    """The strongest cycles (O2)."""
    return cycles.orderBy(F.col("amplitude").desc(), "k").limit(n)


def leading_cycles(cycles: DataFrame, cut: float = 0.5) -> DataFrame:
    """Strongest cycles while their cumulative share stays below ``cut`` (O2)."""
    walked = with_running_total(
        cycles.withColumn("__down", -F.col("amplitude")), [], ["__down", "k"], F.col("share"),
        "cum_share")
    return walked.filter(F.col("cum_share") < cut).drop("__down")


# --- calendar checks ---------------------------------------------------------------------------


def calendar_report(df: DataFrame, date_col: str, day_col: str) -> DataFrame:
    """Duplicates, order, spacing and bounds of a calendar (K11), one row.

    The rows are reduced to one per calendar date before any ordering.
    """
    dates = df.groupBy(date_col).agg(
        F.count("*").alias("n"), F.min(day_col).alias("lo"), F.max(day_col).alias("hi"))
    w = Window.orderBy(date_col)
    steps = dates.withColumn("gap", F.datediff(date_col, F.lag(date_col).over(w))).withColumn(
        "rises", F.col("lo") > F.lag("hi").over(w))
    by_date = steps.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_dates"),
        F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date"),
        F.coalesce(F.bool_and("rises"), F.lit(True)).alias("day_increases"),
        F.count_distinct("gap").alias("n_gaps"), F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"))
    days = df.select(day_col).distinct().agg(F.count(day_col).alias("n_days"))
    return with_row(by_date, days).select(
        "n_rows", (F.col("n_rows") > F.col("n_dates")).alias("has_duplicate_dates"),
        (F.col("n_rows") > F.col("n_days")).alias("has_duplicate_days"), "day_increases",
        (F.col("n_gaps") == 1).alias("equispaced"), "min_gap", "max_gap", "first_date", "last_date")


# --- projection --------------------------------------------------------------------------------


def pca_projection(df: DataFrame, cols: Sequence[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Standardized columns on their first ``k`` principal components (K12), with the cumulative
    explained variance. The largest weight of a component is positive."""
    scaled = standard_scale(df, cols, "__z")
    assembled = VectorAssembler(
        inputCols=[f"{c}__z" for c in cols], outputCol="__vec").transform(scaled)
    model = PCA(k=k, inputCol="__vec", outputCol="__pc").fit(assembled)
    axes = model.pc.toArray()
    signs = [1.0 if axes[np.argmax(np.abs(axes[:, i])), i] > 0 else -1.0 for i in range(k)]
    pcs = vector_to_array("__pc")
    out = model.transform(assembled).withColumns({f"pc{i + 1}": pcs[i] * F.lit(signs[i]) for i in range(k)})
    shares = [float(v) for v in model.explainedVariance]
    cumulative = [math.fsum(shares[: i + 1]) for i in range(len(shares))]
    return out.drop("__vec", "__pc", *[f"{c}__z" for c in cols]), cumulative
