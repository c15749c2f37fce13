"""The worked analyses on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard import runner
from panelyard.analyses import anomaly, credit as credit_analysis, retail
from panelyard.cases.base import SERIES_ATTRS, Tables, case, r, sales_panel
from panelyard.cases.modelling import FEATURES, FORECAST_SQL
from panelyard.cases.sequences import WINDOWS_SQL
from panelyard.cases.summaries import MODE_SQL, taxi
from panelyard.cases.tables import CALENDAR_SQL, CREDIT_SQL, PRICED_SQL, calendar, credit, prices
from panelyard.cases.windows import W, filled
from panelyard.operators import metrics, panel as P
from panelyard.operators.models import ModelSpec
from panelyard.plans import stage


def retail_rows(t: Tables):
    """The stand-in panel in the shape of the retail tables: day labels, calendar, prices."""
    df, n = sales_panel(t)
    sales = df.select(F.concat("id", F.lit("_evaluation")).alias("id"), *SERIES_ATTRS,
                      F.concat(F.lit("d_"), F.col("d").cast("string")).alias("d"), "sold")
    days = stage(calendar(t).select(
        F.concat(F.lit("d_"), F.col("d").cast("string")).alias("d"), F.col("dt").alias("date"),
        F.col("week_key").alias("wm_yr_wk"), "weekday", F.col("event").alias("event_name_1"), "snap"), "calendar")
    price = stage(prices(t).withColumnRenamed("week_key", "wm_yr_wk"), "prices")
    return stage(retail.prepare(sales, price, days), "prepared"), n


IMPUTED_SQL = f"""WITH {PRICED_SQL}, {CALENDAR_SQL},
s AS (SELECT priced.*, weekday, coalesce(event, 'NoEvent') AS event_name_1, snap, coalesce(sell_price,
  median(sell_price) OVER (PARTITION BY id)) AS own FROM priced JOIN calendar USING (d)),
prepared AS (SELECT * EXCLUDE (sell_price, own), coalesce(own, (SELECT median(own) FROM s)) AS sell_price FROM s)
"""


@case("x2_retail_prepare", IMPUTED_SQL + """
SELECT id, d, sold, sell_price, event_name_1, CAST(isodow(dt) AS INTEGER) AS wday, snap FROM prepared""")
def _(spark, sf):
    rows, _ = retail_rows(Tables(spark, sf))
    return rows.select("id", "d", "sold", "sell_price", "event_name_1", "wday", "snap")


def code_sql(c: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}"


@case("x2_retail_features", IMPUTED_SQL + f""", m AS (SELECT max(d) - 28 AS cut FROM days),
w AS (SELECT *, lag(sold, 7) {W} AS lag7, coalesce(lead(sold) {W}, 0e0) AS nxt FROM prepared),
f AS (SELECT *, {filled('lag7')} AS lag7f FROM w)
SELECT {code_sql('id')}, {code_sql('item_id')}, {code_sql('state_id')}, {code_sql('event_name_1')}, d, snap = 1 AS snap,
  CASE WHEN d > cut THEN 0e0 ELSE sold END AS sold, CASE WHEN d > cut THEN 0e0 ELSE lag7f END AS sold_lag_7,
  CASE WHEN d > cut THEN 0e0 ELSE nxt END AS sold_next_day FROM f CROSS JOIN m""")
def _(spark, sf):
    rows, n = retail_rows(Tables(spark, sf))
    out = retail.features(rows, n - 28, n)
    codes = [F.col(c).cast("int").alias(c) for c in ("id", "item_id", "state_id", "event_name_1")]
    return out.select(*codes, "d", "snap", "sold", "sold_lag_7", "sold_next_day")


@case("x2_retail_forecast_and_score")
def _(spark, sf):
    df, n = sales_panel(Tables(spark, sf))
    spec = ModelSpec("ridge", FEATURES, "sold_next_day")
    return retail.forecast_and_score(df, spec, n - 57, n - 28, 28, n)


RUN_SQL = FORECAST_SQL.rstrip() + """,
y AS (SELECT id, d, lead(sold) OVER (PARTITION BY id ORDER BY d) AS y FROM panel),
s AS (SELECT f.sold_next_day AS p, y.y FROM forecast f JOIN y ON y.id = f.id AND y.d = f.d),
m2 AS (SELECT avg(abs(y - p)) AS mae, avg(pow(y - p, 2)) AS mse, sqrt(avg(pow(y - p, 2))) AS rmse,
  sqrt(avg(pow(y - p, 2))) / (quantile_cont(p, 0.75) - quantile_cont(p, 0.25)) AS nrmse,
  1 - avg(pow(y - p, 2)) / var_pop(y) AS r2, 0e0 AS bsl_r2 FROM s)
"""


@case("x2_run_panel", RUN_SQL + "\nUNION ALL ".join(
    f"SELECT '{c}_test' AS score, round({c}, 5) + 0e0 AS value FROM m2" for c in metrics.REGRESSION))
def _(spark, sf):
    """The whole run: chronological split, a forecast of 28 days that feeds on itself, scores."""
    df, n = sales_panel(Tables(spark, sf))
    rows = df.withColumn("sold_next_day", P.lead_target("sold", ["id"])).filter(F.col("d") < n)
    scores = runner.run(spark, {
        "label": "sold_next_day", "split": ("split_panel", {"train_end": n - 57, "val_end": n - 29}),
        "predict": ("predict_recursive", {"start_day": n - 28, "steps": 28})}, data=rows)
    return scores.select("score", r("value", 5))


def all_rows(tables):
    """(name, row): the rows of all tables, each as JSON with its nulls."""
    out = None
    for name, table in tables.items():
        row = table.select(F.lit(name).alias("name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        out = row if out is None else out.unionByName(row)
    return out


@case("x2_retail_explore")
def _(spark, sf):
    rows, _ = retail_rows(Tables(spark, sf))
    return all_rows(retail.explore(rows, "ASIA"))


@case("x2_credit_prepare", "WITH" + CREDIT_SQL + MODE_SQL.format(by="", part="") + """,
f AS (SELECT id, coalesce(saving_accounts, v) AS saving_accounts, risk FROM credit LEFT JOIN b ON p = 1)
SELECT id, CAST(dense_rank() OVER (ORDER BY saving_accounts) - 1 AS INTEGER) AS saving_accounts,
  CAST(risk = 'good' AS INTEGER) AS good_risk FROM f""")
def _(spark, sf):
    rows = credit_analysis.prepare(credit(Tables(spark, sf)), impute=["saving_accounts"])
    return rows.select(F.col("id").cast("bigint"), F.col("saving_accounts").cast("int"), F.col("good_risk").cast("int"))


@case("x2_credit_explore")
def _(spark, sf):
    rows = stage(credit_analysis.prepare(credit(Tables(spark, sf)), impute=["saving_accounts"]), "credit")
    return all_rows(credit_analysis.explore(rows))


@case("x2_anomaly_mean_loss", WINDOWS_SQL + """
SELECT 'mean' AS baseline, round(avg(error), 8) + 0e0 AS loss FROM errors WHERE split = 'val'""")
def _(spark, sf):
    tables = anomaly.analyse(taxi(Tables(spark, sf)), ["hour"], "value")
    return tables["losses"].filter("baseline = 'mean'").select("baseline", r("loss", 8))


@case("x2_anomaly_flags")
def _(spark, sf):
    tables = anomaly.analyse(taxi(Tables(spark, sf)), ["hour"], "value")
    return tables["mean"].select("start", F.lit("mean").alias("baseline"), "error", "anomaly").unionByName(
        tables["pca"].select("start", F.lit("pca").alias("baseline"), "error", "anomaly"))
