"""Recursive multi-step forecast of a panel.

The state is one row per series: the last ``look_back`` values as an array, and the running sum
and count of the whole history. The features of one day are then expressions over that row, so a
step needs no window over history and no join of predictions back to rows; only the group means
need a small aggregate over the series rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.columns import clip_round
from panelyard.operators.panel import ENCODINGS, LAGS, LOOK_BACK, ROBUST_LAGS, ROLLING
from panelyard.plans import stage


def initial_state(panel: DataFrame, series: str, attrs: Sequence[str], start_day: int,
                  look_back: int = LOOK_BACK + 1, value="sold", day="d") -> DataFrame:
    """State at ``start_day``: history up to and including that day.

    Sums and counts combine map-side; the array holds at most ``look_back`` values per series.
    """
    known = panel.filter(F.col(day) <= start_day)
    recent = F.when(F.col(day) > start_day - look_back, F.struct(F.col(day), F.col(value)))
    return known.groupBy(series, *attrs).agg(
        F.sum(value).alias("__sum"), F.count(value).alias("__count"),
        F.transform(F.array_sort(F.collect_list(recent)), lambda s: s[value]).alias("__hist"),
    ).withColumn("__out", F.array().cast("array<double>")).withColumn(day, F.lit(start_day))


class History:
    """Expressions over one series' state: value array (oldest first), running sum and count."""

    def __init__(self, values: Column, total: Column, count: Column):
        self.values, self.total, self.count = values, total, count

    def back(self, k: int) -> Column:
        """Value ``k`` rows before the current one, null before the start of the history."""
        return F.get(self.values, F.size(self.values) - 1 - k)

    def mean(self, n: int, shift: int = 0, need: int = 1) -> Column:
        """Mean of up to ``n`` values ending ``shift`` rows back; null below ``need`` values."""
        end = F.size(self.values) - shift
        start = F.greatest(end - n, F.lit(0))
        part = F.slice(self.values, start + 1, F.greatest(end - start, F.lit(0)))
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
        known = F.aggregate(
            part, zero,
            lambda a, v: F.struct((a["s"] + F.coalesce(v, F.lit(0.0))).alias("s"),
                                  (a["n"] + v.isNotNull().cast("int")).alias("n")),
            lambda a: F.when(a["n"] >= F.lit(max(need, 1)), a["s"] / a["n"]))
        return known

    def maximum(self, n: int) -> Column:
        size = F.size(self.values)
        return F.when(size >= n, F.array_max(
            F.slice(self.values, F.greatest(size - (n - 1), F.lit(1)), n)))

    def features(self, value="sold") -> dict[str, Column]:
        """The features that need only the series itself, named as in ``panel_features``."""
        out = {value: self.back(0)}
        out |= {f"{value}_lag_{k}": self.back(k) for k in LAGS}
        out |= {f"{value}_robustlag_{k}": self.mean(max(1, int(k * 0.5)), k) for k in ROBUST_LAGS}
        out |= {f"{value}_avg_{n}d": self.mean(n, 0, n) for n in ROLLING}
        out[f"{value}_max_14d"] = self.maximum(14)
        out[f"{value}_avg_expanding"] = F.try_divide(self.total, self.count)
        return out


def state_features(value="sold") -> dict[str, Column]:
    """The series' own features as expressions over the state columns."""
    return History(F.col("__hist"), F.col("__sum"), F.col("__count")).features(value)


def day_features(state: DataFrame, value="sold", groups=ENCODINGS,
                 own_features: dict[str, Column] | None = None) -> DataFrame:
    """The panel features of the state's current day, under the names of ``panel_features``.

    ``groups`` are the group means to compute; each is one small aggregate over the series rows.
    """
    out = state.withColumns(state_features(value) if own_features is None else own_features)
    for name, cols in groups.items():
        mean = F.try_divide(F.sum("__sum"), F.sum("__count")).alias(f"{value}_avg_{name}")
        out = out.join(state.groupBy(*cols).agg(mean), list(cols), "left")
    own = F.try_divide("__sum", "__count")
    for name, base in (("", f"{value}_avg_item"), ("_30d", f"{value}_avg_30d")):
        if base in out.columns:
            out = out.withColumn(f"{value}_daily_deviation_from_avg{name}", own - F.col(base))
    return out


def expression_forecast(panel: DataFrame, model: Callable[[dict[str, Column]], Column],
                        start_day: int, steps: int, series="id", attrs: Sequence[str] = (),
                        value="sold", day="d", look_back: int = LOOK_BACK + 1) -> DataFrame:
    """Recursive forecast by a model that is an expression of the series' own features.

    Such a model needs no job per day: the steps are folded over the state array, so the whole
    horizon is one pass over the series rows. Same result as ``recursive_forecast``.
    """
    state = initial_state(panel, series, attrs, start_day, look_back, value, day)
    begin = F.struct(F.col("__hist").alias("h"), F.col("__sum").cast("double").alias("s"),
                     F.col("__count").alias("n"), F.col("__out").alias("o"))

    def one_day(acc: Column, _: Column) -> Column:
        features = History(acc["h"], acc["s"], acc["n"]).features(value)
        said = F.array(clip_round(model(features).cast("double")))
        # The prediction is computed once and bound by a one-element transform.
        return F.transform(said, lambda p: F.struct(
            F.when(F.size(acc["h"]) < look_back, F.concat(acc["h"], F.array(p)))
            .otherwise(F.concat(F.slice(acc["h"], 2, look_back - 1), F.array(p))).alias("h"),
            (acc["s"] + p).alias("s"), (acc["n"] + F.lit(1)).alias("n"),
            F.concat(acc["o"], F.array(p)).alias("o")))[0]

    said = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, one_day, lambda acc: acc["o"])
    return _forecast_rows(state.withColumn("__out", said), series, attrs, start_day, value, day)


def _forecast_rows(state: DataFrame, series, attrs, start_day, value, day) -> DataFrame:
    name = f"{value}_next_day"
    return state.select(series, *attrs, F.posexplode("__out").alias("__i", name)).select(
        series, *attrs, (F.col("__i") + F.lit(start_day)).cast("int").alias(day), name)


def linear_expression(coefficients: dict[str, float], intercept: float):
    """A fitted linear model as an expression; missing features count as 0."""
    def model(features: dict[str, Column]) -> Column:
        total = F.lit(float(intercept))
        for name, weight in coefficients.items():
            total = total + F.lit(float(weight)) * F.coalesce(features[name], F.lit(0.0))
        return total

    return model


def recursive_forecast(panel: DataFrame, predict: Callable[[DataFrame], DataFrame], start_day: int,
                       steps: int, series="id", attrs: Sequence[str] = (), value="sold", day="d",
                       look_back: int = LOOK_BACK + 1, groups=ENCODINGS,
                       features: Sequence[str] | None = None) -> DataFrame:
    """Predict day by day: rows (series, d, sold_next_day) for ``steps`` days from ``start_day``.

    ``predict`` adds a ``prediction`` column to a frame of one-day features and keeps the other
    columns. The prediction is clipped at 0, rounded half to even and becomes the next day's
    value. The steps depend on each other, so each is one job over the series rows; its state is
    staged, which keeps the plan of every step the same size. ``groups`` and ``features`` limit the
    group means and the series' own features to those the model reads.
    """
    state = stage(initial_state(panel, series, attrs, start_day, look_back, value, day), "state")
    columns = state.columns
    wanted = None if features is None else {
        *features, *([f"{value}_avg_30d"] if f"{value}_daily_deviation_from_avg_30d" in features else [])}
    own_features = {k: v for k, v in state_features(value).items() if wanted is None or k in wanted}
    for _ in range(steps):
        feats = day_features(state, value, groups, own_features)
        said = predict(feats).withColumn("__next", clip_round(F.col("prediction").cast("double")))
        longer = F.concat("__hist", F.array("__next"))
        state = stage(said.select(
            *[c for c in columns if c not in ("__hist", "__sum", "__count", "__out", day)],
            F.when(F.size("__hist") < look_back, longer)
            .otherwise(F.slice(longer, 2, look_back)).alias("__hist"),
            (F.col("__sum") + F.col("__next")).alias("__sum"),
            (F.col("__count") + 1).alias("__count"),
            F.concat("__out", F.array("__next")).alias("__out"),
            (F.col(day) + 1).alias(day)), "state")
    return _forecast_rows(state, series, attrs, start_day, value, day)


def moving_average_model(window: int = 7, value="sold") -> Callable[[DataFrame], DataFrame]:
    """A model without parameters: tomorrow is the mean of the last ``window`` days."""
    history = History(F.col("__hist"), F.col("__sum"), F.col("__count"))
    return lambda df: df.withColumn("prediction", history.mean(window))


def mllib_model(model) -> Callable[[DataFrame], DataFrame]:
    """A fitted MLlib model; features that are still missing count as 0."""
    return lambda df: model.transform(df.fillna(0.0))
