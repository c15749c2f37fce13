"""Panel window features.

Sales are whole numbers, so sums are exact and means compare without rounding; the ``_real`` queries
divide them by the root of 11, which makes no sum a tie at the digits they are rounded to.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.cases.base import PANEL_SQL, SERIES_ATTRS, Tables, case, day_list, r, rsql, sales_panel
from panelyard.operators import panel
from panelyard.operators.panel import ENCODINGS, LAGS, ROBUST_LAGS, ROLLING

W = "OVER (PARTITION BY id ORDER BY d)"


def frame(start: str, end: str) -> str:
    return f"OVER (PARTITION BY id ORDER BY d ROWS BETWEEN {start} AND {end})"


def filled(expr: str) -> str:
    """Next non-null value of the series."""
    return f"first_value({expr} IGNORE NULLS) {frame('CURRENT ROW', 'UNBOUNDED FOLLOWING')}"


def robust_sql(k: int) -> str:
    n = max(1, int(k * 0.5))
    return f"avg(sold) {frame(f'{k + n - 1} PRECEDING', f'{k} PRECEDING')}"


def rolling_sql(n: int, fn: str = "avg") -> str:
    over = frame(f"{n - 1} PRECEDING", "CURRENT ROW")
    return f"CASE WHEN count(sold) {over} >= {n} THEN {fn}(sold) {over} END"


LAG_COLS = {f"sold_lag_{k}": f"lag(sold, {k}) {W}" for k in LAGS}
ROBUST_COLS = {f"sold_robustlag_{k}": robust_sql(k) for k in ROBUST_LAGS}
ROLLING_COLS = {f"sold_avg_{n}d": rolling_sql(n) for n in ROLLING}
MAX_COLS = {"sold_max_14d": rolling_sql(14, "max")}


def raw_sql(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in cols.items())


def with_fill(cols: dict[str, str]) -> str:
    """Window columns first, then the backward fill, over the panel."""
    out = [f"{filled(c)} AS {c}" for c in cols]
    return (f"WITH {PANEL_SQL}, w AS (SELECT id, d, {raw_sql(cols)} FROM panel)\n"
            f"SELECT id, d, {', '.join(out)} FROM w")


def _panel(spark, sf):
    return sales_panel(Tables(spark, sf))[0]


@case("w1_lags", with_fill(LAG_COLS))
def _(spark, sf):
    df = panel.backfill(panel.add_lags(_panel(spark, sf)), list(LAG_COLS))
    return df.select("id", "d", *LAG_COLS)


@case("w2_robust_lags", with_fill(ROBUST_COLS))
def _(spark, sf):
    df = panel.backfill(panel.add_robust_lags(_panel(spark, sf)), list(ROBUST_COLS))
    return df.select("id", "d", *ROBUST_COLS)


@case("w3_rolling_means", with_fill(ROLLING_COLS))
def _(spark, sf):
    df = panel.backfill(panel.add_rolling_means(_panel(spark, sf)), list(ROLLING_COLS))
    return df.select("id", "d", *ROLLING_COLS)


REAL_COLS = ROBUST_COLS | ROLLING_COLS


@case("w2_w3_means_real", f"WITH {PANEL_SQL.replace('coalesce(daily.sold, 0e0) AS sold', 'coalesce(daily.sold, 0e0) / 3.3166247903554e0 AS sold')}, "
      f"w AS (SELECT id, d, {raw_sql(REAL_COLS)} FROM panel) SELECT id, d, {', '.join(rsql(c, c) for c in REAL_COLS)} FROM w")
def _(spark, sf):
    df = _panel(spark, sf).withColumn("sold", F.col("sold") / F.lit(3.3166247903554))
    df = panel.add_rolling_means(panel.add_robust_lags(df))
    return df.select("id", "d", *[r(c) for c in REAL_COLS])


@case("w4_rolling_max", with_fill(MAX_COLS))
def _(spark, sf):
    df = panel.backfill(panel.add_rolling_max(_panel(spark, sf)), list(MAX_COLS))
    return df.select("id", "d", *MAX_COLS)


@case("w5_expanding_mean", f"WITH {PANEL_SQL} SELECT id, d, "
      f"avg(sold) {frame('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS sold_avg_expanding FROM panel")
def _(spark, sf):
    return panel.add_expanding_mean(_panel(spark, sf)).select("id", "d", "sold_avg_expanding")


@case("w6_lead_target", f"WITH {PANEL_SQL} SELECT id, d, coalesce(lead(sold) {W}, 0e0) AS sold_next_day FROM panel")
def _(spark, sf):
    return _panel(spark, sf).select("id", "d", panel.lead_target("sold", ["id"]).alias("sold_next_day"))


@case("w7_backward_fill", f"WITH {PANEL_SQL}, g AS (SELECT id, d, nullif(sold, 0e0) AS seen FROM panel) "
      f"SELECT id, d, {filled('seen')} AS next_sale FROM g")
def _(spark, sf):
    df = _panel(spark, sf).withColumn("next_sale", F.nullif(F.col("sold"), F.lit(0.0)))
    return panel.backfill(df, ["next_sale"]).select("id", "d", "next_sale")


def mean_sql(cols) -> str:
    return f"avg(sold) OVER (PARTITION BY {', '.join(cols)})"


@case("w8_deviations", f"WITH {PANEL_SQL}, w AS (SELECT id, d, {mean_sql(['id'])} AS own, "
      f"{mean_sql(['item_id'])} AS item, {rolling_sql(30)} AS m30 FROM panel), "
      "v AS (SELECT id, d, own - item AS a, own - m30 AS b FROM w) SELECT id, d, "
      f"a AS sold_daily_deviation_from_avg, {filled('b')} AS sold_daily_deviation_from_avg_30d FROM v")
def _(spark, sf):
    from panelyard.plans import attach

    df = _panel(spark, sf)
    out = panel.add_rolling_means(df, windows=(30,))
    out = attach(out, panel.series_profile(df), ["id"])
    return panel.add_deviations(out).select(
        "id", "d", "sold_daily_deviation_from_avg", "sold_daily_deviation_from_avg_30d")


def _slope_sql(window: int, every: int) -> str:
    m = -(-window // every)
    points = [f"lag(sold, {window - 1 - i * every}) {W}" if window - 1 - i * every else "sold"
              for i in range(m)]
    mid = (m - 1) / 2
    spread = sum((i - mid) ** 2 for i in range(m))
    dot = " + ".join(f"({p}) * {i - mid}e0" for i, p in enumerate(points))
    return f"CASE WHEN count(*) {frame(f'{window - 1} PRECEDING', 'CURRENT ROW')} >= {window} THEN ({dot}) / {spread}e0 END"


@case("w9_slope", f"WITH {PANEL_SQL} SELECT id, d, " + rsql(_slope_sql(30, 5), "sold_slope_30d") + ", "
      + rsql(_slope_sql(7, 1), "sold_slope_7d") + " FROM panel")
def _(spark, sf):
    df = panel.add_slope(_panel(spark, sf), window=30, every=5)
    return panel.add_slope(df, window=7, every=1).select("id", "d", r("sold_slope_30d"), r("sold_slope_7d"))


@case("w10_day_gap", """
WITH s AS (SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS dt FROM lineitem)
SELECT l_suppkey, dt, CAST(dt - lag(dt) OVER (PARTITION BY l_suppkey ORDER BY dt) AS INTEGER) AS gap_days FROM s""")
def _(spark, sf):
    df = Tables(spark, sf).lineitem.select("l_suppkey", F.col("l_shipdate").cast("date").alias("dt"))
    return panel.day_gap(df.distinct(), "dt", ["l_suppkey"])


@case("w11_season_terms", f"WITH {PANEL_SQL} SELECT d, " + rsql("sin(2 * pi() * d / 7e0)", "season_sin")
      + ", " + rsql("cos(2 * pi() * d / 7e0)", "season_cos") + " FROM days")
def _(spark, sf):
    df = panel.add_season_terms(day_list(Tables(spark, sf)), 7)
    return df.select("d", r("season_sin"), r("season_cos"))


@case("e2_mean_encodings", f"WITH {PANEL_SQL} SELECT id, d, " + ", ".join(
    f"{mean_sql(cols)} AS sold_avg_{name}" for name, cols in ENCODINGS.items()) + " FROM panel")
def _(spark, sf):
    df = panel.add_mean_encodings(_panel(spark, sf))
    return df.select("id", "d", *[f"sold_avg_{n}" for n in ENCODINGS])


@case("e2_mean_encodings_train_only", f"WITH {PANEL_SQL}, m AS (SELECT max(d) - 28 AS cut FROM days) "
      "SELECT id, d, " + ", ".join(
          f"avg(CASE WHEN d <= cut THEN sold END) OVER (PARTITION BY {', '.join(cols)}) AS sold_avg_{name}" for name, cols in ENCODINGS.items()) + " FROM panel CROSS JOIN m")
def _(spark, sf):
    df, n = sales_panel(Tables(spark, sf))
    df = panel.add_mean_encodings(df, fit_filter=F.col("d") <= n - 28)
    return df.select("id", "d", *[f"sold_avg_{n}" for n in ENCODINGS])


FILLED = {**LAG_COLS, **ROBUST_COLS, **ROLLING_COLS, **MAX_COLS}
OTHER = [f"sold_avg_{n}" for n in ENCODINGS] + [
    "sold_avg_expanding", "sold_next_day", "sold_daily_deviation_from_avg",
    "sold_daily_deviation_from_avg_30d"]

ALL_SQL = (
    f"WITH {PANEL_SQL}, w AS (SELECT *, {raw_sql(FILLED)}, {mean_sql(['id'])} AS own, "
    + ", ".join(f"{mean_sql(c)} AS sold_avg_{n}" for n, c in ENCODINGS.items())
    + f", avg(sold) {frame('UNBOUNDED PRECEDING', 'CURRENT ROW')} AS sold_avg_expanding"
    + f", coalesce(lead(sold) {W}, 0e0) AS sold_next_day FROM panel), "
    + "f AS (SELECT id, d, sold, own, " + ", ".join(f"{filled(c)} AS {c}" for c in FILLED) + ", "
    + ", ".join(f"sold_avg_{n}" for n in ENCODINGS) + ", sold_avg_expanding, sold_next_day FROM w) "
    + "SELECT id, d, sold, " + ", ".join(FILLED) + ", " + ", ".join(f"sold_avg_{n}" for n in ENCODINGS)
    + ", sold_avg_expanding, sold_next_day, own - sold_avg_item AS sold_daily_deviation_from_avg, "
    + "own - sold_avg_30d AS sold_daily_deviation_from_avg_30d FROM f")


@case("w_all_panel_features", ALL_SQL)
def _(spark, sf):
    df, n = sales_panel(Tables(spark, sf))
    out = panel.panel_features(df, series_rows=n)
    return out.select("id", "d", "sold", *FILLED, *OTHER)


@case("w_all_long_series", ALL_SQL)
def _(spark, sf):
    """The same features by the chunked way for very long series."""
    df, _ = sales_panel(Tables(spark, sf))
    out = panel.long_panel_features(df.select("id", *SERIES_ATTRS, "d", "sold"), chunk=700)
    return out.select("id", "d", "sold", *FILLED, *OTHER)
