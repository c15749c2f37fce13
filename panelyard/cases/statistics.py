"""Association and shape statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.cases.base import PANEL_SQL, Tables, case, day_list, r, rsql, sales_panel
from panelyard.cases.summaries import LINE
from panelyard.operators import association as K

FEATURES = LINE


def pair_sql(template: str, cols=FEATURES, targets=None) -> str:
    return "\nUNION ALL ".join(
        template.format(a=a, b=b) for a in cols for b in (targets or cols))


@case("k1_pearson", pair_sql("SELECT '{a}' AS feature_name, '{b}' AS target_name, "
                             "round(corr({a}, {b}), 6) + 0e0 AS score FROM lineitem"))
def _(spark, sf):
    return K.pearson(Tables(spark, sf).lineitem, FEATURES).withColumn("score", r("score"))


@case("k1_pearson_target", pair_sql("SELECT '{a}' AS feature_name, '{b}' AS target_name, "
                                    "round(corr({a}, {b}), 6) + 0e0 AS score FROM lineitem",
                                    targets=["l_extendedprice"]))
def _(spark, sf):
    return K.pearson(Tables(spark, sf).lineitem, FEATURES, "l_extendedprice").withColumn("score", r("score"))


RANKED = "WITH k AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0 AS {c}" for c in FEATURES
) + " FROM lineitem)\n"


@case("k2_spearman", RANKED + pair_sql("SELECT '{a}' AS feature_name, '{b}' AS target_name, "
                                       "round(corr({a}, {b}), 6) + 0e0 AS score FROM k"))
def _(spark, sf):
    return K.spearman(Tables(spark, sf).lineitem, FEATURES).withColumn("score", r("score"))


def anova_sql(feature: str, group: str, table: str) -> str:
    return (f"(SELECT (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) FROM "
            f"(SELECT *, sum(n * m) OVER () / sum(n) OVER () AS g FROM (SELECT count({feature}) AS n, "
            f"avg({feature}) AS m, var_pop({feature}) AS v FROM {table} GROUP BY {group})))")


@case("k3_f_classif", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature_name, 'l_returnflag' AS target_name, round({anova_sql(c, 'l_returnflag', 'lineitem')}, 5) + 0e0 AS f_score"
    for c in FEATURES))
def _(spark, sf):
    df = K.f_classif(Tables(spark, sf).lineitem, FEATURES, "l_returnflag")
    return df.select("feature_name", "target_name", r("f_score", 5))


# With three classes the tail of F(2, m) is (1 + 2 F / m) ** (-m / 2).
@case("k3_f_classif_p_values", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS feature_name, 'l_returnflag' AS target_name, round(f, 5) + 0e0 AS f_score,
      round(exp(-m / 2 * ln(1 + 2 * f / m)), 6) + 0e0 AS p_value
    FROM (SELECT {anova_sql(c, 'l_returnflag', 'lineitem')} AS f, (SELECT count(*) - 3e0 FROM lineitem) AS m)""" for c in FEATURES))
def _(spark, sf):
    df = K.f_classif(Tables(spark, sf).lineitem, FEATURES, "l_returnflag")
    return df.select("feature_name", "target_name", r("f_score", 5), r("p_value"))


@case("k4_f_regression", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature_name, 'l_extendedprice' AS target_name, "
    f"round(pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2), 4) + 0e0 AS f_score FROM lineitem"
    for c in ["l_quantity", "l_discount", "l_tax"]))
def _(spark, sf):
    df = K.f_regression(Tables(spark, sf).lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return df.select("feature_name", "target_name", r("f_score", 4))


@case("k5_chi2_score", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature_name, 'p_type' AS target_name, round(sum(pow(o - e, 2) / e), 5) + 0e0 AS chi2 FROM "
    f"(SELECT o, n / sum(n) OVER () * sum(o) OVER () AS e FROM (SELECT count(*) AS n, sum({c}) AS o FROM part GROUP BY p_type))"
    for c in ["p_size", "p_partkey"]))
def _(spark, sf):
    return K.chi2_score(Tables(spark, sf).part, ["p_size", "p_partkey"], "p_type").select(
        "feature_name", "target_name", r("chi2", 5))


def docs(t: Tables):
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")


DOCS_SQL = "docs AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


def independence_sql(a: str, b: str, table: str) -> str:
    return (f"SELECT '{b}' AS column_name, CAST((count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS BIGINT) AS dof, "
            f"round(greatest(sum(o * o * n / (rx * cy)) - any_value(n), 0e0), 5) + 0e0 AS chi2 FROM "
            f"(SELECT *, sum(o) OVER (PARTITION BY x) AS rx, sum(o) OVER (PARTITION BY y) AS cy, sum(o) OVER () AS n FROM "
            f"(SELECT {a} AS x, {b} AS y, count(*) + 0e0 AS o FROM {table} GROUP BY ALL))")


@case("k6_chi2_independence", f"WITH {DOCS_SQL} " + independence_sql("lang", "source", "docs")
      + " UNION ALL " + independence_sql("lang", "toxic", "docs"))
def _(spark, sf):
    df = K.chi2_independence(docs(Tables(spark, sf)), "lang", ["source", "toxic"])
    return df.select("column_name", "dof", r("chi2", 5))


@case("k6_chi2_continuity", f"WITH {DOCS_SQL}, c AS (SELECT quality, toxic, count(*) + 0e0 AS o FROM docs GROUP BY ALL), "
      "m AS (SELECT *, sum(o) OVER (PARTITION BY quality) AS rx, sum(o) OVER (PARTITION BY toxic) AS cy, sum(o) OVER () AS n FROM c) "
      "SELECT 'toxic' AS column_name, CAST(1 AS BIGINT) AS dof, round(pow(max(abs(o - rx * cy / n)) - 0.5, 2) * any_value(n) "
      "* (SELECT sum(1 / s) FROM (SELECT sum(o) AS s FROM c GROUP BY quality)) "
      "* (SELECT sum(1 / s) FROM (SELECT sum(o) AS s FROM c GROUP BY toxic)), 5) + 0e0 AS chi2 FROM m")
def _(spark, sf):
    return K.chi2_independence(docs(Tables(spark, sf)), "quality", ["toxic"]).select(
        "column_name", "dof", r("chi2", 5))


@case("k7_anova_by_category", f"WITH {DOCS_SQL} " + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, round({anova_sql('n_chars', c, 'docs')}, 5) + 0e0 AS f_score" for c in ["lang", "source"]))
def _(spark, sf):
    return K.anova_by_category(docs(Tables(spark, sf)), "n_chars", ["lang", "source"]).select(
        "column_name", r("f_score", 5))


@case("k7_categorical_relationship", independence_sql("p_type", "p_brand", "part") + " UNION ALL "
      + independence_sql("p_type", "p_name", "part"))
def _(spark, sf):
    rows = Tables(spark, sf).part.select("p_type", "p_brand", "p_name")
    return K.categorical_relationship(rows, "p_type").select("column_name", "dof", r("chi2", 5))


def mi_sql(a: str, b: str, table: str) -> str:
    return (f"SELECT '{a}' AS feature_name, '{b}' AS target_name, "
            f"round(greatest(sum(c / n * ln(c * n / (ca * cb))), 0e0), 6) + 0e0 AS mi FROM "
            f"(SELECT *, sum(c) OVER (PARTITION BY x) AS ca, sum(c) OVER (PARTITION BY y) AS cb, sum(c) OVER () AS n FROM "
            f"(SELECT {a} AS x, {b} AS y, count(*) + 0e0 AS c FROM {table} GROUP BY ALL))")


DISCRETE = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]


@case("k8_mutual_information", "\nUNION ALL ".join(mi_sql(a, b, "lineitem") for a in DISCRETE for b in DISCRETE))
def _(spark, sf):
    return K.mutual_information(Tables(spark, sf).lineitem, DISCRETE).withColumn("mi", r("mi"))


def bin_sql(c: str) -> str:
    return "(" + " + ".join(f"CAST({c} > {c}_q[{i}] AS INTEGER)" for i in range(1, 10)) + ")"


MIXED = ["balance", "segment", "nation"]
MIXED_SQL = ("WITH q AS (SELECT quantile_cont(c_acctbal, [" + ", ".join(f"0.{i}" for i in range(1, 10))
             + "]) AS balance_q FROM customer), x AS (SELECT " + bin_sql("balance").replace("balance >", "c_acctbal >")
             + " AS balance, c_mktsegment AS segment, c_nationkey AS nation FROM customer CROSS JOIN q)\n")


@case("k9_mixed_mutual_information", MIXED_SQL + "\nUNION ALL ".join(mi_sql(a, "balance", "x") for a in MIXED))
def _(spark, sf):
    df = Tables(spark, sf).customer.select(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
                                           F.col("c_nationkey").alias("nation"))
    return K.mixed_mutual_information(df, ["segment", "nation"], ["balance"], "balance").withColumn("mi", r("mi"))


CYCLES_SQL = PANEL_SQL + """,
s AS (SELECT d - 1 AS t, avg(sold) AS x, count(*) OVER () AS n FROM panel GROUP BY d),
c AS (SELECT k, any_value(n) / CAST(k AS DOUBLE) AS period,
  sqrt(pow(sum(x * cos(2 * pi() * ((t * k) % n) / n)), 2) + pow(sum(x * sin(2 * pi() * ((t * k) % n) / n)), 2)) AS amplitude
  FROM s, range(1, (SELECT max(n) FROM s) // 2 + 1) ks(k) GROUP BY k),
cycles AS (SELECT *, amplitude / sum(amplitude) OVER () AS share FROM c)
"""


def daily_mean(t: Tables):
    return sales_panel(t)[0].groupBy("d").agg(F.avg("sold").alias("sold"))


CYCLE_COLS = "k, round(period, 6) + 0e0 AS period, round(amplitude, 5) + 0e0 AS amplitude, round(share, 7) + 0e0 AS share"


@case("k10_seasonal_cycles", f"WITH {CYCLES_SQL} SELECT {CYCLE_COLS} FROM cycles")
def _(spark, sf):
    df = K.seasonal_cycles(daily_mean(Tables(spark, sf)), "d", "sold")
    return df.select("k", r("period"), r("amplitude", 5), r("share", 7))


@case("k10_seasonal_cycles_two_rounds", f"WITH {CYCLES_SQL} SELECT {CYCLE_COLS} FROM cycles")
def _(spark, sf):
    """The same spectrum by the way for series that do not fit one task."""
    df = K.seasonal_cycles(daily_mean(Tables(spark, sf)), "d", "sold", points=64)
    return df.select("k", r("period"), r("amplitude", 5), r("share", 7))


@case("k10_cycles_per_series")
def _(spark, sf):
    return K.seasonal_cycles(sales_panel(Tables(spark, sf))[0], "d", "sold", ["id"])


@case("o2_top_cycles", f"WITH {CYCLES_SQL} SELECT {CYCLE_COLS} FROM cycles ORDER BY cycles.amplitude DESC LIMIT 5")
def _(spark, sf):
    df = K.top_cycles(K.seasonal_cycles(daily_mean(Tables(spark, sf)), "d", "sold"))
    return df.select("k", r("period"), r("amplitude", 5), r("share", 7))


@case("o2_leading_cycles", f"WITH {CYCLES_SQL}, w AS (SELECT k, sum(share) OVER (ORDER BY amplitude DESC, k "
      "ROWS UNBOUNDED PRECEDING) AS cum_share FROM cycles) SELECT k, round(cum_share, 6) + 0e0 AS cum_share FROM w WHERE cum_share < 0.5")
def _(spark, sf):
    df = K.leading_cycles(K.seasonal_cycles(daily_mean(Tables(spark, sf)), "d", "sold"))
    return df.select("k", r("cum_share"))


@case("k11_calendar_report", f"""WITH {PANEL_SQL}, g AS (SELECT dt, d, dt - lag(dt) OVER (ORDER BY dt) AS gap, d > lag(d) OVER (ORDER BY dt) AS up FROM days)
SELECT count(*) AS n_rows, count(*) > count(DISTINCT dt) AS has_duplicate_dates, count(*) > count(DISTINCT d) AS has_duplicate_days,
  bool_and(up) AS day_increases, count(DISTINCT gap) = 1 AS equispaced, CAST(min(gap) AS INTEGER) AS min_gap,
  CAST(max(gap) AS INTEGER) AS max_gap, min(dt) AS first_date, max(dt) AS last_date FROM g""")
def _(spark, sf):
    return K.calendar_report(day_list(Tables(spark, sf)), "dt", "d")


def _axis_sql(source: str, name: str, width: int, squarings: int = 16) -> str:
    """CTEs for the leading axis of the matrix in ``source`` (c00, c01, ...): its powers, squared again and again, tend to the projection
    on it. ``name``: the axis v0, v1, ... with its largest weight positive, the eigenvalue l, and what is left of the matrix."""
    x = range(width)
    cell = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    upper = [(i, j) for i in x for j in x if i <= j]
    steps, last = [], source
    for k in range(squarings):
        trace = " + ".join(cell(i, i) for i in x)
        square = ", ".join("(" + " + ".join(f"{cell(i, m)} * {cell(m, j)}" for m in x) + f") / (({trace}) * ({trace})) AS c{i}{j}" for i, j in upper)
        steps.append(f"{name}_{k} AS (SELECT {square} FROM {last})")
        last = f"{name}_{k}"
    biggest = f"greatest({', '.join(cell(i, i) for i in x)})"
    column = lambda i: "CASE " + " ".join(f"WHEN {cell(j, j)} = {biggest} THEN {cell(i, j)}" for j in x) + " END"
    steps.append(f"{name}_raw AS (SELECT {', '.join(f'{column(i)} AS w{i}' for i in x)} FROM {last})")
    norm = "sqrt(" + " + ".join(f"w{i} * w{i}" for i in x) + ")"
    top = f"greatest({', '.join(f'abs(w{i})' for i in x)})"
    sign = f"CASE WHEN greatest({', '.join(f'w{i}' for i in x)}) = {top} THEN 1e0 ELSE -1e0 END"
    steps.append(f"{name}_v AS (SELECT {', '.join(f'{sign} * w{i} / {norm} AS v{i}' for i in x)} FROM {name}_raw)")
    value = " + ".join(f"v{i} * {cell(i, j)} * v{j}" for i in x for j in x)
    steps.append(f"{name}_l AS (SELECT *, {value} AS l FROM {name}_v CROSS JOIN (SELECT {', '.join(f'c{i}{j}' for i, j in upper)} FROM {source}))")
    left = ", ".join(f"c{i}{j} - l * v{i} * v{j} AS c{i}{j}" for i, j in upper)
    steps.append(f"{name} AS (SELECT {', '.join(f'v{i}' for i in x)}, l, {left} FROM {name}_l)")
    return ",\n".join(steps)


def _pca_sql() -> str:
    x = range(len(FEATURES))
    corr = ", ".join(f"corr({FEATURES[i]}, {FEATURES[j]}) AS c{i}{j}" if i != j else f"1e0 AS c{i}{i}" for i in x for j in x if i <= j)
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(FEATURES))
    return (f"WITH m AS (SELECT {corr} FROM lineitem),\n{_axis_sql('m', 'first', len(FEATURES))},\n{_axis_sql('first', 'second', len(FEATURES))},\n"
            f"z AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {scaled} FROM lineitem),\n"
            "p AS (SELECT z.*, " + ", ".join(" + ".join(f"z{i} * {t}.v{i}" for i in x) + f" AS {n}" for t, n in (("a", "pc1"), ("b", "pc2")))
            + ", a.l AS l1, b.l AS l2 FROM z CROSS JOIN first a CROSS JOIN second b)\n")


@case("k12_pca_projection", _pca_sql() + f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {rsql('pc1', 'pc1', 4)}, {rsql('pc2', 'pc2', 4)} FROM p")
def _(spark, sf):
    df, _ = K.pca_projection(Tables(spark, sf).lineitem, FEATURES)
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", r("pc1", 4), r("pc2", 4))


@case("k12_explained_variance", _pca_sql() + "SELECT " + ", ".join([
    rsql("var_pop(pc1)", "var_pc1"), rsql("var_pop(pc2)", "var_pc2"), rsql(f"any_value(l1) / {len(FEATURES)}", "cumulative_1"),
    rsql(f"any_value(l1 + l2) / {len(FEATURES)}", "cumulative_2")]) + " FROM p")
def _(spark, sf):
    df, explained = K.pca_projection(Tables(spark, sf).lineitem, FEATURES)
    out = df.agg(F.var_pop("pc1").alias("var_pc1"), F.var_pop("pc2").alias("var_pc2"),
                 *[F.lit(v).alias(f"cumulative_{i + 1}") for i, v in enumerate(explained)])
    return out.select(*[r(c) for c in out.columns])
