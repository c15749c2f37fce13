"""Daily retail sales: preparation, exploration, features and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions import columns as C
from panelyard.operators import association, encode, forecast, metrics, panel, profile, reshape, split
from panelyard.operators.models import ModelSpec, predict
from panelyard.plans import stage

EVENTS = ["event_name_1", "event_type_1", "event_name_2", "event_type_2"]
CATEGORIES = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]
USELESS = ["date", "wm_yr_wk", "weekday"]


def prepare(sales: DataFrame, prices: DataFrame, calendar: DataFrame, suffix: str = "_evaluation",
            week: str = "wm_yr_wk") -> DataFrame:
    """Long sales joined with calendar and prices; numbers for days and weekdays, 'NoEvent' for
    days without an event, prices imputed by series median and then overall."""
    events = [c for c in EVENTS if c in calendar.columns]
    out = sales.join(calendar.fillna("NoEvent", subset=events), "d", "left")
    out = out.join(prices, ["store_id", "item_id", week], "left")
    ends = sales.agg(F.bool_and(F.endswith("id", F.lit(suffix)))).first()[0]
    if ends:
        out = out.withColumn("id", C.without_suffix(F.col("id"), suffix))
    out = out.withColumns({"d": C.day_number(F.col("d")), "wday": C.lookup(F.col("weekday"), C.WEEKDAYS)})
    return encode.impute_median(out, "sell_price", "id")


def features(df: DataFrame, last_known_day: int, series_rows: int | None = None,
             categories: Sequence[str] | None = None) -> DataFrame:
    """All panel features, flags as booleans, categories as codes, the next-day target; sales
    columns after ``last_known_day`` are 0 until a forecast fills them."""
    out = panel.panel_features(df, series_rows=series_rows)
    flags = [c for c in out.columns if c.startswith("snap")]
    out = out.withColumns({c: F.col(c).cast("boolean") for c in flags})
    names = categories or [c for c in [*CATEGORIES, *EVENTS] if c in out.columns]
    coded = encode.category_codes(out, ["id", *names])
    for c in ["id", *names]:
        coded = coded.withColumn(c, F.col(f"{c}_code")).drop(f"{c}_code")
    return panel.zero_after(coded, last_known_day).drop(*USELESS)


def parts(df: DataFrame, train_end: int = 1911, val_end: int = 1940, look_back: int = 380):
    return split.panel_split(df, train_end, val_end, look_back)


def forecast_and_score(df: DataFrame, spec: ModelSpec, train_end: int, last_known_day: int, horizon: int,
                       series_rows: int | None = None) -> DataFrame:
    """Fit on the training days, predict the validation days in one pass and the horizon day by
    day, and score all three: rows (score, value).

    Nothing after ``last_known_day`` reaches the features; the sales of the horizon are only used
    as truth.
    """
    past = stage(df.filter(F.col("d") <= last_known_day).select("id", *CATEGORIES, "d", "sold"), "past")
    # The target of the last known day lies in the horizon.
    rows = panel.panel_features(past, series_rows=series_rows).filter(F.col("d") < last_known_day)
    rows = stage(rows.fillna(0.0), "features")
    model = spec.fit(rows.filter(F.col("d") <= train_end))
    seen = predict(model, rows, ["id", "d", spec.label]).select(
        F.when(F.col("d") <= train_end, "train").otherwise("val").alias("split"),
        F.col(spec.label).alias("actual"), C.clip_round(F.col("prediction")).alias("predicted"))
    groups = {n: cols for n, cols in panel.ENCODINGS.items()
              if f"sold_avg_{n}" in spec.features
              or (n == "item" and "sold_daily_deviation_from_avg" in spec.features)}
    said = forecast.recursive_forecast(past, forecast.mllib_model(model), last_known_day, horizon,
                                       "id", CATEGORIES, groups=groups, features=spec.features)
    truth = df.filter(F.col("d") > last_known_day).select(
        "id", (F.col("d") - 1).alias("d"), F.col("sold").alias("actual"))
    ahead = said.join(truth, ["id", "d"]).select(
        F.lit("test").alias("split"), "actual", F.col("sold_next_day").alias("predicted"))
    scored = stage(seen.unionByName(ahead), "scored")
    table = metrics.regression_metrics(scored, "actual", "predicted", ["split"])
    return metrics.score_table(table, "split", metrics.REGRESSION)


def explore(df: DataFrame, store: str, date: str = "date") -> dict[str, DataFrame]:
    """The tables behind the figures of the sales exploration."""
    revenue = F.sum(F.col("sold") * F.col("sell_price")).alias("total_revenue")
    by_category = df.groupBy("store_id", "state_id", "cat_id", date).agg(revenue)
    one_store = by_category.filter(F.col("store_id") == store)
    cycles = association.seasonal_cycles(df.groupBy("d").agg(F.avg("sold").alias("sold")), "d", "sold")
    tables = {
        "items_per_state": profile.distinct_per_group(df, ["state_id"], "item_id", "unique_items"),
        "items_per_store": profile.distinct_per_group(df, ["store_id"], "item_id", "unique_items"),
        "items_per_category": profile.distinct_per_group(df, ["cat_id"], "item_id", "unique_items"),
        "item_hierarchy": profile.hierarchy_counts(df, ["state_id", "store_id", "cat_id"], "item_id"),
        "daily_sales": df.groupBy("state_id", "store_id", date).agg(F.sum("sold").alias("sold")),
        "daily_revenue": df.groupBy("store_id", "state_id", date).agg(revenue),
        "daily_revenue_by_category": by_category,
        "store_weeks": reshape.weekday_week_table(one_store, date, "total_revenue"),
        "top_cycles": association.top_cycles(cycles),
        "leading_cycles": association.leading_cycles(cycles),
    }
    for flag in [c for c in df.columns if c.startswith("snap")]:
        tables[f"revenue_by_{flag}"] = df.filter(F.col("store_id") == store).groupBy(
            "store_id", "cat_id", flag, date).agg(revenue)
        tables[f"days_with_{flag}"] = df.filter(F.col(flag).cast("int") == 1).select(date).distinct()
    return tables
