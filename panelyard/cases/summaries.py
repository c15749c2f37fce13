"""Aggregations, profiles, encodings, imputation, scaling and scalar functions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelyard.cases.base import PANEL_SQL, Tables, case, r, raw_sales, rsql, sales_panel
from panelyard.cases.tables import CALENDAR_SQL, CREDIT_SQL, PRICED_SQL, calendar, credit, priced_panel
from panelyard.functions import columns as C
from panelyard.operators import encode, prep, profile, sampling
from panelyard.plans import stage

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def taxi(t: Tables):
    """Hourly mean of the event values (in whole cents, so sums are exact)."""
    return t.events.groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(
        F.avg(F.round(F.col("value") * 100)).alias("value"))


TAXI_SQL = """
taxi AS (SELECT date_trunc('hour', ts) AS hour, avg(round(value * 100)) AS value FROM events GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY hour) - 1 AS i, count(*) OVER () AS n FROM taxi)
"""


@case("a1_distinct_per_group", f"WITH {PANEL_SQL} SELECT state_id, store_id, cat_id, "
      "count(DISTINCT item_id) AS unique_items FROM raw GROUP BY ALL")
def _(spark, sf):
    return profile.distinct_per_group(raw_sales(Tables(spark, sf)), ["state_id", "store_id", "cat_id"],
                                      "item_id", "unique_items")


@case("a2_hierarchy_counts", f"WITH {PANEL_SQL}, leaf AS (SELECT state_id, store_id, cat_id, "
      "count(DISTINCT item_id) AS n FROM raw GROUP BY ALL) "
      "SELECT state_id, store_id, cat_id, CAST(3 - bit_count(grouping(state_id, store_id, cat_id)) AS INTEGER) AS level, "
      "CAST(sum(n) AS BIGINT) AS n FROM leaf GROUP BY ROLLUP (state_id, store_id, cat_id)")
def _(spark, sf):
    return profile.hierarchy_counts(raw_sales(Tables(spark, sf)), ["state_id", "store_id", "cat_id"], "item_id")


@case("a3_sum_per_group", f"WITH {PANEL_SQL} SELECT state_id, store_id, dt, sum(sold) AS sold FROM raw GROUP BY ALL")
def _(spark, sf):
    return raw_sales(Tables(spark, sf)).groupBy("state_id", "store_id", "dt").agg(F.sum("sold").alias("sold"))


@case("a4_revenue", f"WITH {PRICED_SQL} SELECT store_id, state_id, cat_id, dt, "
      "sum(sold * sell_price) AS total_revenue FROM priced GROUP BY ALL")
def _(spark, sf):
    return priced_panel(Tables(spark, sf)).groupBy("store_id", "state_id", "cat_id", "dt").agg(
        F.sum(F.col("sold") * F.col("sell_price")).alias("total_revenue"))


@case("a4_revenue_by_snap", f"WITH {PRICED_SQL}, {CALENDAR_SQL} SELECT store_id, cat_id, snap, "
      "sum(sold * sell_price) AS total_revenue FROM priced JOIN calendar USING (d) GROUP BY ALL")
def _(spark, sf):
    t = Tables(spark, sf)
    cal = stage(calendar(t).select("d", "snap"), "calendar")
    return priced_panel(t).join(cal, "d").groupBy("store_id", "cat_id", "snap").agg(
        F.sum(F.col("sold") * F.col("sell_price")).alias("total_revenue"))


@case("a5_mean_per_day", f"WITH {PANEL_SQL} SELECT d, avg(sold) AS sold FROM panel GROUP BY d")
def _(spark, sf):
    return sales_panel(Tables(spark, sf))[0].groupBy("d").agg(F.avg("sold").alias("sold"))


@case("a6_value_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return profile.value_counts(Tables(spark, sf).orders, "o_orderpriority")


@case("a7_column_profile", "WITH" + CREDIT_SQL + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS data_type, count(*) - count({c}) AS n_null, "
    f"count(DISTINCT {c}) AS n_distinct FROM credit"
    for c, k in [("id", "bigint"), ("saving_accounts", "string"), ("nation", "int"),
                 ("balance", "double"), ("risk", "string")]))
def _(spark, sf):
    return profile.column_profile(credit(Tables(spark, sf)))


def describe_sql(c: str, table: str, by: str = "") -> str:
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (f"SELECT {lead}'{c}' AS column_name, count({c}) AS count, {rsql(f'avg({c})', 'mean', 4)}, "
            f"{rsql(f'stddev_samp({c})', 'std', 4)}, min({c}) + 0e0 AS min, "
            + ", ".join(rsql(f"quantile_cont({c}, 0.{p})", f"q{p}", 4) for p in (25, 50, 75))
            + f", max({c}) + 0e0 AS max FROM {table}{group}")


def described():
    return ["count", "min", "max", *[r(c, 4) for c in ("mean", "std", "q25", "q50", "q75")]]


@case("a8_describe", "\nUNION ALL ".join(describe_sql(c, "lineitem") for c in LINE))
def _(spark, sf):
    return profile.describe(Tables(spark, sf).lineitem, LINE).select("column_name", *described())


@case("a8_describe_by_group", "\nUNION ALL ".join(
    describe_sql(c, "orders", "o_orderstatus") for c in ["o_totalprice", "o_custkey"]))
def _(spark, sf):
    df = profile.describe(Tables(spark, sf).orders, ["o_totalprice", "o_custkey"], ["o_orderstatus"])
    return df.select("o_orderstatus", "column_name", *described())


@case("a8_describe_running_totals", "\nUNION ALL ".join(describe_sql(c, "lineitem") for c in LINE))
def _(spark, sf):
    """Columns with as many values as rows, by the one way that all quantiles take."""
    return profile.describe(Tables(spark, sf).lineitem, LINE).select("column_name", *described())


@case("a9_null_counts", "WITH" + CREDIT_SQL + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, count(*) > count({c}) AS any_null FROM credit"
    for c in ["id", "saving_accounts", "nation", "balance", "risk"]))
def _(spark, sf):
    return profile.null_counts(credit(Tables(spark, sf)))


@case("a10_shape", "SELECT count(*) AS n_rows, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders")
def _(spark, sf):
    return Tables(spark, sf).orders.agg(F.count("*").alias("n_rows"), F.min("o_orderdate").alias("first_date"),
                                        F.max("o_orderdate").alias("last_date"))


@case("a11_mode", "WITH" + CREDIT_SQL + ", c AS (SELECT nation, saving_accounts, count(*) AS n FROM credit "
      "WHERE saving_accounts IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER "
      "(PARTITION BY nation ORDER BY n DESC, saving_accounts) AS p FROM c) "
      "SELECT nation, saving_accounts AS saving_accounts_mode, n FROM k WHERE p = 1")
def _(spark, sf):
    return profile.mode_value(credit(Tables(spark, sf)), "saving_accounts", ["nation"])


@case("a12_median", "SELECT c_nationkey, 'c_acctbal' AS \"column\", " + rsql("median(c_acctbal)", "median", 4)
      + " FROM customer GROUP BY 1")
def _(spark, sf):
    return profile.medians(Tables(spark, sf).customer, ["c_acctbal"], ["c_nationkey"]).select(
        "c_nationkey", "column", r("median", 4))


def shape_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column_name, {rsql('avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5)', 'skewness')}, "
            f"{rsql('avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) - 3', 'kurtosis')} "
            f"FROM (SELECT {c} AS x, avg({c}) OVER () AS m FROM lineitem)")


@case("a13_shape_statistics", "\nUNION ALL ".join(shape_sql(c) for c in LINE))
def _(spark, sf):
    return profile.shape_statistics(Tables(spark, sf).lineitem, LINE).select(
        "column_name", r("skewness"), r("kurtosis"))


@case("a14_box_statistics", """
WITH q AS (SELECT o_orderstatus, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS median,
  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
j AS (SELECT *, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM orders JOIN q USING (o_orderstatus))
SELECT o_orderstatus, 'o_totalprice' AS column_name, round(any_value(q1), 4) + 0e0 AS q1,
  round(any_value(median), 4) + 0e0 AS median, round(any_value(q3), 4) + 0e0 AS q3,
  min(o_totalprice) FILTER (inside) AS whisker_low, max(o_totalprice) FILTER (inside) AS whisker_high,
  count(*) FILTER (NOT inside) AS n_fliers FROM j GROUP BY 1""")
def _(spark, sf):
    df = profile.box_statistics(Tables(spark, sf).orders, ["o_totalprice"], ["o_orderstatus"])
    return df.select("o_orderstatus", "column_name", r("q1", 4), r("median", 4), r("q3", 4),
                     "whisker_low", "whisker_high", "n_fliers")


@case("a15_contingency", "SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def _(spark, sf):
    t = Tables(spark, sf)
    df = prep.align(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), ["doc_id"])
    return profile.contingency(df, "lang", "quality")


@case("a16_percentile", "SELECT event_type, " + rsql("quantile_cont(value, 0.95)", "p95", 4) + " FROM events GROUP BY 1")
def _(spark, sf):
    from panelyard.plans import exact_quantiles

    q = exact_quantiles(Tables(spark, sf).events, ["value"], [0.95], ["event_type"])
    return q.select("event_type", F.col("q")[0].alias("p95")).select("event_type", r("p95", 4))


@case("a17_distinct", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt, l_returnflag FROM lineitem")
def _(spark, sf):
    return Tables(spark, sf).lineitem.select(F.col("l_shipdate").cast("date").alias("dt"), "l_returnflag").distinct()


@case("n2_tukey_fences", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events CROSS JOIN q
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def _(spark, sf):
    return profile.tukey_outliers(Tables(spark, sf).events, "value").select("event_id", "value")


# --- encodings ----------------------------------------------------------------------------------


@case("e1_category_codes", "WITH" + CREDIT_SQL + """, m AS (SELECT saving_accounts AS v,
  row_number() OVER (ORDER BY saving_accounts) - 1 AS code
  FROM (SELECT DISTINCT saving_accounts FROM credit WHERE saving_accounts IS NOT NULL))
SELECT id, coalesce(code, -1) AS saving_accounts_code FROM credit LEFT JOIN m ON v = saving_accounts""")
def _(spark, sf):
    return encode.category_codes(credit(Tables(spark, sf)), ["saving_accounts"]).select("id", "saving_accounts_code")


@case("e1_category_mapping", """
SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code
FROM (SELECT DISTINCT c_name FROM customer)""")
def _(spark, sf):
    return encode.category_mapping(Tables(spark, sf).customer, "c_name")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@case("e3_one_hot", "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{v}' AS INTEGER) AS c_mktsegment_{v}" for v in SEGMENTS[1:]) + " FROM customer")
def _(spark, sf):
    df = encode.one_hot(Tables(spark, sf).customer, "c_mktsegment", SEGMENTS, "AUTOMOBILE")
    return df.select("c_custkey", *[f"c_mktsegment_{v}" for v in SEGMENTS[1:]])


@case("e4_constant_imputation", f"WITH {PANEL_SQL}, {CALENDAR_SQL} SELECT d, coalesce(event, 'NoEvent') AS event FROM calendar")
def _(spark, sf):
    return calendar(Tables(spark, sf)).select("d", "event").fillna({"event": "NoEvent"})


MODE_SQL = """, c AS (SELECT {by}saving_accounts AS v, count(*) AS k FROM credit WHERE saving_accounts IS NOT NULL GROUP BY ALL),
b AS (SELECT *, row_number() OVER ({part}ORDER BY k DESC, v) AS p FROM c)
"""


@case("e5_mode_imputation", "WITH" + CREDIT_SQL + MODE_SQL.format(by="", part="")
      + "SELECT id, coalesce(saving_accounts, v) AS saving_accounts FROM credit LEFT JOIN b ON p = 1")
def _(spark, sf):
    return encode.impute_mode(credit(Tables(spark, sf)), "saving_accounts").select("id", "saving_accounts")


@case("e5_mode_imputation_by_group", "WITH" + CREDIT_SQL + MODE_SQL.format(by="nation, ", part="PARTITION BY nation ")
      + "SELECT id, coalesce(saving_accounts, v) AS saving_accounts FROM credit LEFT JOIN b ON p = 1 AND b.nation = credit.nation")
def _(spark, sf):
    return encode.impute_mode(credit(Tables(spark, sf)), "saving_accounts", ["nation"]).select("id", "saving_accounts")


@case("e6_median_imputation", f"WITH {PRICED_SQL}, s AS (SELECT id, d, coalesce(sell_price, "
      "median(sell_price) OVER (PARTITION BY id)) AS sell_price FROM priced) "
      "SELECT id, d, coalesce(sell_price, (SELECT median(sell_price) FROM s)) AS sell_price FROM s")
def _(spark, sf):
    rows = stage(priced_panel(Tables(spark, sf)).select("id", "d", "sell_price"), "priced")
    return encode.impute_median(rows, "sell_price", "id").select("id", "d", "sell_price")


@case("e8_sentinel_to_missing", "WITH" + CREDIT_SQL + "SELECT id, saving_accounts FROM credit")
def _(spark, sf):
    return credit(Tables(spark, sf)).select("id", "saving_accounts")


KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@case("e9_standard_scaling", "SELECT " + ", ".join(KEY) + ", " + ", ".join(
    rsql(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", f"{c}_scaled") for c in LINE) + " FROM lineitem")
def _(spark, sf):
    return encode.standard_scale(Tables(spark, sf).lineitem, LINE).select(*KEY, *[r(f"{c}_scaled") for c in LINE])


@case("e10_min_max_scaling", "SELECT " + ", ".join(KEY) + ", " + ", ".join(
    rsql(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())", f"{c}_scaled") for c in LINE)
    + " FROM lineitem")
def _(spark, sf):
    return encode.min_max_scale(Tables(spark, sf).lineitem, LINE).select(*KEY, *[r(f"{c}_scaled") for c in LINE])


def batch_sql(lo: str, hi: str) -> str:
    return ("WITH n AS (SELECT event_id, value, (row_number() OVER (ORDER BY ts, event_id) - 1) // 500 AS batch FROM events), "
            "f AS (SELECT min(value) AS flo, max(value) AS fhi FROM n WHERE batch = 0) "
            "SELECT event_id, CAST(batch AS BIGINT) AS batch, "
            + rsql(f"(value - {lo}) / ({hi} - {lo})", "value_scaled") + " FROM n CROSS JOIN f")


@case("e11_batch_scaling", batch_sql("min(value) OVER (PARTITION BY batch)", "max(value) OVER (PARTITION BY batch)"))
def _(spark, sf):
    df = Tables(spark, sf).events.select("event_id", "ts", "value")
    return encode.batch_min_max(df, "value", ["ts", "event_id"], 500).select("event_id", "batch", r("value_scaled"))


@case("e11_batch_scaling_frozen", batch_sql("flo", "fhi"))
def _(spark, sf):
    df = Tables(spark, sf).events.select("event_id", "ts", "value")
    return encode.batch_min_max(df, "value", ["ts", "event_id"], 500, keep_fitting=False).select(
        "event_id", "batch", r("value_scaled"))


def fourier_sql() -> str:
    """The projection with the seeded weights as literals."""
    w, b = encode.fourier_weights(3, 100, 1.0, 0)
    terms = [" + ".join(f"x{i} * CAST({w[i, j]!r} AS DOUBLE)" for i in range(3)) + f" + CAST({b[j]!r} AS DOUBLE)" for j in range(100)]
    scaled = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS x{i}" for i, c in enumerate(LINE[:3]))
    values = ", ".join(f"round(sqrt(0.02e0) * cos({t}), 6) + 0e0" for t in terms)
    return f"SELECT {', '.join(KEY)}, [{values}] AS rff FROM (SELECT {', '.join(KEY)}, {scaled} FROM lineitem)".replace("np.float64(", "(")


@case("e12_random_fourier", fourier_sql())
def _(spark, sf):
    df = encode.min_max_scale(Tables(spark, sf).lineitem, LINE[:3], "")
    out = encode.random_fourier(df, LINE[:3], 100, 1.0, 0)
    return out.select(*KEY, F.transform(vector_to_array("rff"), lambda v: F.round(v, 6) + F.lit(0.0)).alias("rff"))


@case("e13_constant_multiplier", "SELECT " + ", ".join(KEY) + ", l_quantity * 0.5 AS l_quantity, l_tax * 0.5 AS l_tax FROM lineitem")
def _(spark, sf):
    return encode.multiply_columns(Tables(spark, sf).lineitem, ["l_quantity", "l_tax"], 0.5).select(
        *KEY, "l_quantity", "l_tax")


# --- scalar functions ------------------------------------------------------------------------------


@case("f_text_functions", """
SELECT p_partkey, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS after_mark,
  CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS brand_no, regexp_replace(p_name, 'widget$', '') AS stem,
  ends_with(p_name, 'widget') AS is_widget, lower(replace(p_name, ' ', '_')) AS clean_name,
  p_brand || ' (' || CAST(p_size AS VARCHAR) || ')' AS label FROM part""")
def _(spark, sf):
    return Tables(spark, sf).part.select(
        "p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int").alias("after_mark"),
        C.digits(F.col("p_brand")).alias("brand_no"), C.without_suffix(F.col("p_name"), "widget").alias("stem"),
        F.endswith("p_name", F.lit("widget")).alias("is_widget"),
        F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("clean_name"),
        C.count_label(F.col("p_brand"), F.col("p_size")).alias("label"))


@case("f_text_all_end_with", "SELECT p_type, bool_and(ends_with(p_name, 'widget')) AS all_widgets FROM part GROUP BY 1")
def _(spark, sf):
    return Tables(spark, sf).part.groupBy("p_type").agg(
        F.bool_and(F.endswith("p_name", F.lit("widget"))).alias("all_widgets"))


@case("f_date_functions", """
SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS parsed,
  dayname(o_orderdate) AS day_name, CAST(week(o_orderdate) AS INTEGER) AS iso_week,
  CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS INTEGER) AS day_diff FROM orders""")
def _(spark, sf):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return Tables(spark, sf).orders.select(
        "o_orderkey", F.to_date(text, "yyyy-MM-dd").alias("parsed"), F.date_format("o_orderdate", "EEEE").alias("day_name"),
        F.weekofyear("o_orderdate").alias("iso_week"),
        F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("day_diff"))


@case("f_math_functions", """
SELECT c_custkey, round_even(c_acctbal, 0) + 0e0 AS nearest, greatest(c_acctbal, 0e0) AS clipped, abs(c_acctbal) AS magnitude,
  round(sqrt(abs(c_acctbal)), 6) + 0e0 AS root, round(c_acctbal / nullif(c_nationkey, 0), 8) + 0e0 AS share,
  round(sin(c_nationkey), 6) + 0e0 AS s, round(cos(c_nationkey), 6) + 0e0 AS c FROM customer""")
def _(spark, sf):
    x = F.col("c_acctbal")
    return Tables(spark, sf).customer.select(
        "c_custkey", (F.rint(x) + F.lit(0.0)).alias("nearest"), F.greatest(x, F.lit(0.0)).alias("clipped"),
        F.abs(x).alias("magnitude"), C.stable_round(F.sqrt(F.abs(x)), 6).alias("root"),
        C.stable_round(F.try_divide(x, F.col("c_nationkey")), 8).alias("share"),
        C.stable_round(F.sin("c_nationkey"), 6).alias("s"), C.stable_round(F.cos("c_nationkey"), 6).alias("c"))


@case("f_null_functions", "WITH" + CREDIT_SQL + """
SELECT id, coalesce(saving_accounts, 'none') AS saving_accounts, saving_accounts IS NULL AS was_missing
FROM credit WHERE balance IS NOT NULL""")
def _(spark, sf):
    df = credit(Tables(spark, sf)).na.drop(subset=["balance"])
    return df.select("id", F.coalesce("saving_accounts", F.lit("none")).alias("saving_accounts"),
                     F.col("saving_accounts").isNull().alias("was_missing"))


@case("f_map_and_mask", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS status_no,
  CASE WHEN o_totalprice > 400000 THEN 0e0 ELSE o_totalprice END AS masked FROM orders""")
def _(spark, sf):
    return Tables(spark, sf).orders.select(
        "o_orderkey", C.lookup(F.col("o_orderstatus"), {"F": 1, "O": 2, "P": 3}).alias("status_no"),
        F.when(F.col("o_totalprice") > 400000, 0.0).otherwise(F.col("o_totalprice")).alias("masked"))


@case("f_array_functions", """
SELECT vec_id, len(embedding[1:50]) AS n, round(list_avg([CAST(v AS DOUBLE) FOR v IN embedding[1:50]]), 5) + 0e0 AS mean
FROM embeddings""")
def _(spark, sf):
    part = F.transform(F.slice("embedding", 1, 50), lambda v: v.cast("double"))
    return Tables(spark, sf).embeddings.select("vec_id", F.size(part).cast("bigint").alias("n"), C.stable_round(
        F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / F.size(part), 5).alias("mean"))


# --- sort, top, union, samples ---------------------------------------------------------------------


@case("o1_sorted", f"WITH {PANEL_SQL} SELECT id, d, sold FROM panel ORDER BY id, d")
def _(spark, sf):
    return sales_panel(Tables(spark, sf))[0].select("id", "d", "sold").orderBy("id", "d")


@case("o3_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5")
def _(spark, sf):
    return Tables(spark, sf).orders.orderBy("o_orderdate", "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@case("u1_union", """
SELECT c_custkey AS k, c_acctbal AS balance, 'customer' AS side FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier""")
def _(spark, sf):
    t = Tables(spark, sf)
    left = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.lit("customer").alias("side"))
    right = t.supplier.select(F.lit("supplier").alias("side"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("k"))
    return left.unionByName(right)


@case("m0_passthrough", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", "c_acctbal").transform(sampling.passthrough)


@case("m1_regular_interval", """
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i,
  greatest(1, count(*) OVER () // 1000) AS step FROM orders)
SELECT o_orderkey FROM n WHERE i % step = 0 AND i // step < 1000""")
def _(spark, sf):
    df = Tables(spark, sf).orders.select("o_orderkey", "o_orderdate")
    return sampling.every_kth(df, ["o_orderdate", "o_orderkey"], 1000).select("o_orderkey")


@case("m2_keys_per_group", f"WITH {PANEL_SQL}, k AS (SELECT item_id, row_number() OVER (PARTITION BY cat_id "
      "ORDER BY md5(item_id || '|0'), item_id) AS p FROM (SELECT DISTINCT cat_id, item_id FROM raw)) "
      "SELECT id, dt, sum(sold) AS sold FROM raw WHERE item_id IN (SELECT item_id FROM k WHERE p <= 2) GROUP BY ALL")
def _(spark, sf):
    kept = sampling.keys_per_group(raw_sales(Tables(spark, sf)), "cat_id", "item_id", 2)
    return kept.groupBy("id", "dt").agg(F.sum("sold").alias("sold"))


@case("m3_share_of_keys", """
WITH k AS (SELECT o_custkey, row_number() OVER (ORDER BY md5(CAST(o_custkey AS VARCHAR) || '|42')) AS p,
  count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM k WHERE p <= greatest(1, CAST(floor(n * 0.6e0) AS BIGINT)))""")
def _(spark, sf):
    return sampling.keep_share_of_keys(Tables(spark, sf).orders, "o_custkey", 0.6, 42).select("o_orderkey", "o_custkey")


@case("m4_random_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|7') LIMIT 1000")
def _(spark, sf):
    return sampling.random_rows(Tables(spark, sf).orders, "o_orderkey", 1000, 7).select("o_orderkey", "o_totalprice")
