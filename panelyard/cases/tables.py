"""Sources, projections, joins and reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.cases.base import PANEL_SQL, SERIES_ATTRS, Tables, case, day_list, r, raw_sales, sales_panel
from panelyard.functions import columns as C
from panelyard.operators import models, panel, prep, reshape
from panelyard.plans import attach, stage
from panelyard.plans.staging import new_path
from panelyard import sources

ATTRS = ", ".join(SERIES_ATTRS)


def daily_wide(t: Tables):
    """One row per series, one column d_1..d_n per day."""
    days = day_list(t)
    labels = list(range(1, days.count() + 1))
    wide = reshape.widen(raw_sales(t).join(days, "dt"), ["id", *SERIES_ATTRS], "d", labels, "sold", "d_")
    return wide.fillna(0.0), [f"d_{i}" for i in labels]


PRICE_SQL = """
price AS (SELECT item_id, store_id, CAST(isoyear(dt) * 100 + week(dt) AS INTEGER) AS week_key,
  round(avg(round(amount / sold))) AS sell_price FROM raw GROUP BY ALL)
"""


def week_key(dt):
    return (F.extract(F.lit("YEAROFWEEK"), dt) * 100 + F.weekofyear(dt)).cast("int")


def prices(t: Tables):
    """Mean unit price per item, store and ISO week, in whole cents."""
    return (raw_sales(t).withColumn("week_key", week_key(F.col("dt")))
            .groupBy("item_id", "store_id", "week_key")
            .agg(F.round(F.avg(F.round(F.col("amount") / F.col("sold")))).alias("sell_price")))


def calendar(t: Tables):
    days = day_list(t)
    return days.select(
        "d", "dt", F.date_format("dt", "EEEE").alias("weekday"),
        F.weekofyear("dt").alias("iso_week"), week_key(F.col("dt")).alias("week_key"),
        F.when(F.dayofmonth("dt") == 1, "MonthStart").alias("event"),
        (F.dayofmonth("dt") <= 10).cast("int").alias("snap"))


CALENDAR_SQL = """
calendar AS (SELECT d, dt, dayname(dt) AS weekday, CAST(week(dt) AS INTEGER) AS iso_week,
  CAST(isoyear(dt) * 100 + week(dt) AS INTEGER) AS week_key,
  CASE WHEN day(dt) = 1 THEN 'MonthStart' END AS event,
  CAST(day(dt) <= 10 AS INTEGER) AS snap FROM days)
"""


def credit(t: Tables):
    """Customers as a credit table; the segment BUILDING plays the 'not available' sentinel."""
    return prep.sentinel_to_null(t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("saving_accounts"),
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
        F.when(F.col("c_acctbal") > 0, "good").otherwise("bad").alias("risk")),
        {"saving_accounts": "BUILDING"})


CREDIT_SQL = """
credit AS (SELECT c_custkey AS id, nullif(c_mktsegment, 'BUILDING') AS saving_accounts,
  c_nationkey AS nation, c_acctbal AS balance,
  CASE WHEN c_acctbal > 0 THEN 'good' ELSE 'bad' END AS risk FROM customer)
"""


# --- sources and sinks ------------------------------------------------------------------------


@case("s1_csv_with_target", """
SELECT l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem""")
def _(spark, sf):
    t = Tables(spark, sf)
    path = new_path(spark, "csv")
    rows = t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    rows.write.option("header", True).csv(path)
    df, features, target = sources.load_with_target(
        spark, path, "l_extendedprice",
        "l_quantity double, l_discount double, l_tax double, l_extendedprice double")
    return df.select(*features, target)


@case("s2_csv_clean_names", """
SELECT c_custkey AS id, c_name AS customer_name, c_nationkey AS nation_key, c_acctbal AS acct_bal,
  c_mktsegment AS mkt_segment FROM customer""")
def _(spark, sf):
    path = new_path(spark, "csv")
    names = ["Unnamed: 0", "Customer Name", "Nation Key", "Acct Bal", "Mkt Segment"]
    Tables(spark, sf).customer.toDF(*names).write.option("header", True).csv(path)
    return sources.load_table(
        spark, path, "`Unnamed: 0` bigint, `Customer Name` string, `Nation Key` int, "
                     "`Acct Bal` double, `Mkt Segment` string")


def _folder_sql(sales: str, keep: str = "true") -> str:
    return f"""WITH {PANEL_SQL}, {PRICE_SQL}, {CALENDAR_SQL},
kept AS (SELECT item_id, row_number() OVER (PARTITION BY cat_id ORDER BY md5(item_id || '|0'), item_id) AS p
  FROM (SELECT DISTINCT cat_id, item_id FROM raw))
SELECT 'sales' AS tab, id AS name, 'd_' || d AS d, sold AS value FROM ({sales}) WHERE {keep}
UNION ALL SELECT 'prices', item_id || '|' || store_id, CAST(week_key AS VARCHAR), sell_price FROM price WHERE {keep}
UNION ALL SELECT 'calendar', weekday, CAST(d AS VARCHAR), iso_week + 0e0 FROM calendar"""


def _loaded_folder(spark, sf, **options):
    t = Tables(spark, sf)
    folder = new_path(spark, "folder")
    for name, df in [("sales", daily_wide(t)[0]), ("prices", prices(t)), ("calendar", calendar(t))]:
        df.write.option("header", True).csv(f"{folder}/{name}.csv")
    loaded = sources.load_panel_folder(spark, folder, "sales.csv", "prices.csv", "calendar.csv",
                                       value_type="double", **options)
    row = lambda tab, name, d, value: loaded[tab].select(
        F.lit(tab).alias("tab"), name.alias("name"), F.col(d).cast("string").alias("d"), F.col(value).cast("double").alias("value"))
    return (row("sales", F.col("id"), "d", "sold").unionByName(row("prices", F.concat_ws("|", "item_id", "store_id"), "week_key", "sell_price"))
            .unionByName(row("calendar", F.col("weekday"), "d", "iso_week")))


@case("s3_panel_folder", _folder_sql("SELECT * FROM panel"))
def _(spark, sf):
    return _loaded_folder(spark, sf)


@case("s3_panel_folder_trial", _folder_sql("""
SELECT id, item_id, d, sold FROM panel
UNION ALL SELECT id, item_id, CAST(last + i AS INTEGER), 0e0 FROM series CROSS JOIN (SELECT max(d) AS last FROM days) m
  CROSS JOIN range(1, 29) h(i)""", "item_id IN (SELECT item_id FROM kept WHERE p <= 2)"))
def _(spark, sf):
    """Two items per category, and 28 empty days ahead."""
    return _loaded_folder(spark, sf, horizon=28, keys_per_category=2)


@case("s4_horizon_extension", f"WITH {PANEL_SQL}" + f"""
SELECT id, {ATTRS}, d, sold FROM panel
UNION ALL
SELECT id, {ATTRS}, CAST(m.last + i AS INTEGER), 0e0
FROM series CROSS JOIN (SELECT max(d) AS last FROM days) m CROSS JOIN range(1, 29) h(i)""")
def _(spark, sf):
    t = Tables(spark, sf)
    df, n = sales_panel(t)
    return panel.extend_horizon(df, raw_sales(t), ["id"], SERIES_ATTRS, n + 1, 28)


@case("s5_feature_store", f"WITH {PANEL_SQL} SELECT id, d, sold FROM panel")
def _(spark, sf):
    df, n = sales_panel(Tables(spark, sf))
    path = new_path(spark, "features")
    sources.save_features(df, path)
    return sources.load_features(spark, path, 1, n).select("id", "d", "sold")


@case("s6_score_sink", """
SELECT l_returnflag AS split, round(avg(l_discount), 4) + 0e0 AS mean_discount,
  round(stddev_samp(l_tax), 4) + 0e0 AS std_tax FROM lineitem GROUP BY 1""")
def _(spark, sf):
    path = new_path(spark, "scores")
    scores = Tables(spark, sf).lineitem.groupBy(F.col("l_returnflag").alias("split")).agg(
        F.avg("l_discount").alias("mean_discount"), F.stddev_samp("l_tax").alias("std_tax"))
    sources.save_scores(scores, path)
    return spark.read.option("header", True).schema(
        "split string, mean_discount double, std_tax double").csv(path)


LINE_SQL = """
fitted AS (SELECT regr_slope(l_extendedprice, l_quantity) AS w,
  regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
"""


def _price_model(t: Tables):
    spec = models.ModelSpec("linear_regression", ["l_quantity"], "l_extendedprice")
    return spec.fit(t.lineitem.select("l_quantity", "l_extendedprice"))


@case("s7_model_store", f"WITH {LINE_SQL}" + """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(w * l_quantity + b, 3) + 0e0 AS prediction FROM lineitem CROSS JOIN fitted""")
def _(spark, sf):
    t = Tables(spark, sf)
    path = new_path(spark, "model")
    sources.save_model(_price_model(t), path)
    scored = models.predict(sources.load_model(path), t.lineitem)
    return scored.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r("prediction", 3))


@case("s8_run_log", """
SELECT 'credit' AS run_id, count(*) AS n_rows, round(avg(CAST(c_acctbal > 0 AS INTEGER)), 6) + 0e0
  AS share_good FROM customer""")
def _(spark, sf):
    path = new_path(spark, "runs")
    rows = credit(Tables(spark, sf))
    n, share = rows.agg(F.count("*"), F.avg(C.flag("risk", "good"))).first()
    sources.append_run(spark, path, "credit", {"table": "customer"}, [("share_good", share)], n)
    log = spark.read.parquet(path)
    return log.select("run_id", "n_rows", F.round(F.col("metrics")["share_good"], 6).alias("share_good"))


@case("s9_series_scan", "SELECT event_id, value FROM events")
def _(spark, sf):
    path = new_path(spark, "series")
    Tables(spark, sf).events.select("event_id", "value").write.option("header", True).csv(path)
    return sources.load_series(spark, path).select(F.col("event_id").cast("bigint"), "value")


# --- projections and filters --------------------------------------------------------------------


@case("p1_drop_rename", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment AS segment FROM customer")
def _(spark, sf):
    df = Tables(spark, sf).customer.drop("c_name", "wm_yr_wk", "weekday")
    return df.withColumnRenamed("c_mktsegment", "segment")


@case("p2_flag", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS finished FROM orders")
def _(spark, sf):
    return Tables(spark, sf).orders.select("o_orderkey", C.flag("o_orderstatus", "F").alias("finished"))


@case("p3_columns_by_pattern", f"WITH {PANEL_SQL} SELECT id, sum(sold) AS sold FROM panel GROUP BY id")
def _(spark, sf):
    wide, _ = daily_wide(Tables(spark, sf))
    days = C.names_matching(wide, r"d_\d+")
    total = F.aggregate(F.array(*days), F.lit(0.0), lambda a, v: a + v)
    return wide.select("id", total.alias("sold"))


def _profile_sql(table: str, columns: list[str], template: str) -> str:
    return "\nUNION ALL ".join(template.format(c=c, t=table) for c in columns)


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@case("p4_columns_by_cardinality", _profile_sql("customer", CUSTOMER, """
SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct,
  CASE WHEN count(DISTINCT {c}) > 8 THEN 'continuous' ELSE 'discrete' END AS kind FROM {t}"""))
def _(spark, sf):
    return prep.columns_by_cardinality(Tables(spark, sf).customer)


@case("p5_columns_by_type", """
SELECT 'o_orderstatus' AS column_name, max(length(o_orderstatus)) AS longest FROM orders
UNION ALL SELECT 'o_orderpriority', max(length(o_orderpriority)) FROM orders""")
def _(spark, sf):
    df = Tables(spark, sf).orders
    texts = C.names_of_type(df, "string")
    wide = df.agg(*[F.max(F.length(c)).cast("bigint").alias(c) for c in texts])
    return wide.unpivot([], texts, "column_name", "longest")


@case("p6_value_filter", f"WITH {PANEL_SQL}, {CALENDAR_SQL}" + """
SELECT id, panel.d, sold FROM panel JOIN calendar USING (d) WHERE store_id = 'ASIA' AND snap = 1""")
def _(spark, sf):
    t = Tables(spark, sf)
    df, _ = sales_panel(t)
    cal = stage(calendar(t).select("d", "snap"), "calendar")
    return df.join(cal, "d").filter((F.col("store_id") == "ASIA") & (F.col("snap") == 1)).select(
        "id", "d", "sold")


@case("p7_day_range", f"WITH {PANEL_SQL} SELECT id, d, sold FROM panel WHERE d BETWEEN 366 AND 730")
def _(spark, sf):
    df, _ = sales_panel(Tables(spark, sf))
    return df.filter(F.col("d").between(366, 730)).select("id", "d", "sold")


@case("p8_zero_out", f"WITH {PANEL_SQL}, m AS (SELECT max(d) - 28 AS cut FROM days)" + """
SELECT id, d, CASE WHEN d > cut THEN 0e0 ELSE sold END AS sold,
  CASE WHEN d > cut THEN 0e0 ELSE coalesce(lead(sold) OVER (PARTITION BY id ORDER BY d), 0e0) END
    AS sold_next_day
FROM panel CROSS JOIN m""")
def _(spark, sf):
    df, n = sales_panel(Tables(spark, sf))
    df = df.withColumn("sold_next_day", panel.lead_target("sold", ["id"]))
    return panel.zero_after(df, n - 28).select("id", "d", "sold", "sold_next_day")


def _int_type(c: str, t: str) -> str:
    return f"""SELECT '{c}' AS column_name, CASE
      WHEN min({c}) * 10 > -128 AND max({c}) * 10 < 127 THEN 'tinyint'
      WHEN min({c}) * 10 > -32768 AND max({c}) * 10 < 32767 THEN 'smallint'
      WHEN min({c}) * 10 > -2147483648 AND max({c}) * 10 < 2147483647 THEN 'int'
      ELSE 'bigint' END AS to_type FROM {t}"""


def _float_type(c: str, t: str) -> str:
    return f"""SELECT '{c}' AS column_name, CASE
      WHEN min({c}) * 10 > -65504 AND max({c}) * 10 < 65504 THEN 'float16' ELSE 'float' END AS to_type
      FROM {t}"""


def _text_type(c: str, t: str) -> str:
    return f"""SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) < 0.5 * count(*)
      THEN 'category' ELSE 'string' END AS to_type FROM {t}"""


@case("p9_narrowing_plan", "\nUNION ALL ".join(
    [_int_type(c, "lineitem") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
    + [_float_type(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    + [_text_type(c, "lineitem") for c in ("l_returnflag", "l_linestatus")]))
def _(spark, sf):
    return prep.narrowing_plan(Tables(spark, sf).lineitem.drop("l_shipdate")).select(
        "column_name", "to_type")


PART = {"p_partkey": _int_type, "p_name": _text_type, "p_brand": _text_type, "p_type": _text_type, "p_size": _int_type,
        "p_retailprice": _float_type}


def _stored_type(c: str) -> str:
    """SQL for the type that a column of part is stored in: codes in the type that holds them, the 16-bit float as FLOAT."""
    return f"""(SELECT CASE to_type WHEN 'float16' THEN 'float' WHEN 'category' THEN (SELECT CASE WHEN count(DISTINCT {c}) <= 128
      THEN 'tinyint' WHEN count(DISTINCT {c}) <= 32768 THEN 'smallint' ELSE 'int' END FROM part) ELSE to_type END
      FROM ({PART[c](c, "part")}))"""


@case("p9_narrow", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, "
      "CAST(p_retailprice AS FLOAT) AS p_retailprice, concat_ws(' ', " + ", ".join(f"'{c}', {_stored_type(c)}" for c in PART)
      + ") AS stored FROM part")
def _(spark, sf):
    """All columns in their narrow types, with the values that the codes stand for."""
    frame, dictionary = prep.encode_frame(Tables(spark, sf).part)
    stored = " ".join(f"{c} {kind}" for c, kind in frame.dtypes)
    out = prep.decode_frame(frame, dictionary).withColumn("stored", F.lit(stored))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("p_partkey", "p_size")})


@case("p10_input_checks", """
SELECT 'c_custkey' AS column_name, TRUE AS is_numeric, TRUE AS is_integer, min(c_custkey) >= 0 AS non_negative FROM customer
UNION ALL SELECT 'c_name', FALSE, FALSE, FALSE
UNION ALL SELECT 'c_nationkey', TRUE, TRUE, min(c_nationkey) >= 0 FROM customer
UNION ALL SELECT 'c_acctbal', TRUE, FALSE, min(c_acctbal) >= 0 FROM customer
UNION ALL SELECT 'c_mktsegment', FALSE, FALSE, FALSE""")
def _(spark, sf):
    return prep.input_checks(Tables(spark, sf).customer)


@case("p11_to_boolean", "SELECT p_partkey, (p_size <= 10) AS small FROM part")
def _(spark, sf):
    flags = Tables(spark, sf).part.select("p_partkey", (F.col("p_size") <= 10).cast("int").alias("small"))
    return flags.withColumn("small", F.col("small").cast("boolean")).withColumn(
        "small", F.col("small").cast("boolean"))


# --- joins ----------------------------------------------------------------------------------------


@case("j1_join_calendar", f"WITH {PANEL_SQL}, {CALENDAR_SQL}" + """
SELECT id, panel.d, sold, weekday, iso_week, event, snap FROM panel LEFT JOIN calendar USING (d)""")
def _(spark, sf):
    t = Tables(spark, sf)
    df, _ = sales_panel(t)
    return df.drop("dt").join(stage(calendar(t), "calendar"), "d", "left").select(
        "id", "d", "sold", "weekday", "iso_week", "event", "snap")


def priced_panel(t: Tables):
    df, _ = sales_panel(t)
    df = df.withColumn("week_key", week_key(F.col("dt")))
    return attach(df, prices(t), ["store_id", "item_id", "week_key"])


PRICED_SQL = PANEL_SQL + "," + PRICE_SQL + """,
priced AS (SELECT p.*, sell_price FROM panel p LEFT JOIN price
  ON price.item_id = p.item_id AND price.store_id = p.store_id
  AND price.week_key = isoyear(p.dt) * 100 + week(p.dt))
"""


@case("j2_join_prices", f"WITH {PRICED_SQL}" + """
SELECT id, d, sold, sell_price FROM priced""")
def _(spark, sf):
    return priced_panel(Tables(spark, sf)).select("id", "d", "sold", "sell_price")


@case("j3_semi_join", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(spark, sf):
    t = Tables(spark, sf)
    keys = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@case("j4_align_target", """
SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)""")
def _(spark, sf):
    t = Tables(spark, sf)
    return prep.align(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", "quality"), ["doc_id"])


@case("j4_unmatched_keys", """
SELECT doc_id, CAST(1 AS BIGINT) AS surplus FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    t = Tables(spark, sf)
    return prep.unmatched_keys(t.documents, t.labels, ["doc_id"])


@case("j5_update_join", """
SELECT c_custkey, coalesce(biggest, c_acctbal) AS c_acctbal, c_mktsegment FROM customer
LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS biggest FROM orders WHERE o_orderstatus = 'F'
  GROUP BY 1) ON o_custkey = c_custkey""")
def _(spark, sf):
    t = Tables(spark, sf)
    changes = t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("c_acctbal"))
    rows = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    return prep.update_join(rows, changes, ["c_custkey"])


@case("j6_weekday_lookup", """
SELECT o_orderkey, CAST(isodow(o_orderdate) AS INTEGER) AS wday FROM orders""")
def _(spark, sf):
    return Tables(spark, sf).orders.select("o_orderkey", C.weekday_number(F.col("o_orderdate")).alias("wday"))


@case("j7_group_statistic", """
SELECT o_orderkey, avg(round(o_totalprice * 100)) OVER (PARTITION BY o_custkey) AS mean_price,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders""")
def _(spark, sf):
    df = prep.group_statistic(Tables(spark, sf).orders, ["o_custkey"],
                              mean_price=F.avg(F.round(F.col("o_totalprice") * 100)), n=F.count("*"))
    return df.select("o_orderkey", "mean_price", "n")


# --- reshape ----------------------------------------------------------------------------------------


@case("r1_melt", f"WITH {PANEL_SQL} SELECT id, {ATTRS}, 'd_' || d AS d, sold FROM panel")
def _(spark, sf):
    wide, days = daily_wide(Tables(spark, sf))
    return reshape.melt(wide, ["id", *SERIES_ATTRS], days)


@case("r2_weekday_week", """
SELECT CAST(isodow(l_shipdate) AS INTEGER) AS weekday_no, CAST(week(l_shipdate) AS INTEGER) AS iso_week,
  sum(round(l_extendedprice * 100)) AS revenue FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    df = Tables(spark, sf).lineitem.select("l_shipdate", F.round(F.col("l_extendedprice") * 100).alias("revenue"))
    return reshape.weekday_week_table(df, "l_shipdate", "revenue")


@case("r2_weekday_week_matrix", "SELECT CAST(isodow(l_shipdate) AS INTEGER) AS weekday_no, " + ", ".join(
    f"sum(l_quantity) FILTER (week(l_shipdate) = {w}) AS w{w}" for w in range(1, 54))
    + " FROM lineitem GROUP BY 1")
def _(spark, sf):
    return reshape.weekday_week_matrix(Tables(spark, sf).lineitem, "l_shipdate", "l_quantity")


@case("r3_score_matrix", """
WITH c AS (SELECT corr(l_quantity, l_discount) AS qd, corr(l_quantity, l_tax) AS qt,
  corr(l_discount, l_tax) AS dt FROM lineitem)
SELECT 'l_quantity' AS feature_name, round(qd, 6) + 0e0 AS l_discount, NULL::DOUBLE AS l_quantity,
  NULL::DOUBLE AS l_tax FROM c
UNION ALL SELECT 'l_tax', round(dt, 6) + 0e0, round(qt, 6) + 0e0, NULL FROM c""")
def _(spark, sf):
    from panelyard.operators.association import pearson

    cols = ["l_discount", "l_quantity", "l_tax"]
    scores = pearson(Tables(spark, sf).lineitem, cols)
    below = reshape.lower_triangle(reshape.without_diagonal(scores))
    return reshape.score_matrix(below.withColumn("score", r("score")), cols, "score")


@case("r4_dense_panel", f"WITH {PANEL_SQL} SELECT id, {ATTRS}, d, dt, sold FROM panel")
def _(spark, sf):
    df, _ = sales_panel(Tables(spark, sf))
    return df.select("id", *SERIES_ATTRS, "d", "dt", "sold")
