"""Model fits, search, forecasts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.cases.base import PANEL_SQL, SERIES_ATTRS, Tables, case, r, rsql, sales_panel
from panelyard.cases.tables import credit
from panelyard.functions import columns as C
from panelyard.operators import encode, forecast, metrics, models, panel, prep, sampling, split, trees
from panelyard.plans import stage
from panelyard.plans.staging import new_path
from panelyard.runner import run

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
HOUSE = ["l_quantity", "l_discount", "l_tax"]


def housing(t: Tables):
    return t.lineitem.select(*KEY, *HOUSE, "l_extendedprice")


def _fit_predict(spark, sf, model, hparams=None, transformers=(), features=HOUSE):
    df = housing(Tables(spark, sf))
    spec = models.ModelSpec(model, features, "l_extendedprice", transformers, hparams or {}, 0)
    return models.predict(spec.fit(df), df).select(*KEY, "prediction")


ONE_FEATURE_SQL = """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS w, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(w * l_quantity + b, 3) + 0e0 AS prediction FROM lineitem CROSS JOIN f"""


@case("l1_linear_regression", ONE_FEATURE_SQL)
def _(spark, sf):
    return _fit_predict(spark, sf, "linear_regression", features=["l_quantity"]).withColumn("prediction", r("prediction", 3))


def _det(rows) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def least_squares_sql() -> str:
    """Normal equations of the three housing features by Cramer's rule, on centred columns."""
    cov = {(a, b): f"covar_pop({a}, {b})" for a in HOUSE for b in [*HOUSE, "l_extendedprice"]}
    named = ", ".join(f"{v} AS c{i}" for i, v in enumerate(cov.values()))
    at = {k: f"c{i}" for i, k in enumerate(cov)}
    matrix = [[at[(a, b)] for b in HOUSE] for a in HOUSE]
    right = [at[(a, "l_extendedprice")] for a in HOUSE]
    weights = []
    for j in range(3):
        swapped = [[right[i] if k == j else matrix[i][k] for k in range(3)] for i in range(3)]
        weights.append(f"{_det(swapped)} / {_det(matrix)} AS w{j}")
    line = " + ".join(f"w{j} * ({c} - m{j})" for j, c in enumerate(HOUSE))
    means = ", ".join(f"avg({c}) AS m{j}" for j, c in enumerate(HOUSE))
    return (f"WITH c AS (SELECT {named}, {means}, avg(l_extendedprice) AS my FROM lineitem), "
            f"w AS (SELECT {', '.join(weights)}, m0, m1, m2, my FROM c) "
            f"SELECT {', '.join(KEY)}, round(my + {line}, 3) + 0e0 AS prediction FROM lineitem CROSS JOIN w")


@case("l1_linear_regression_all", least_squares_sql())
def _(spark, sf):
    return _fit_predict(spark, sf, "linear_regression").withColumn("prediction", r("prediction", 3))


RIDGE_SQL = """
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem),
f AS (SELECT sum((l_quantity - mx) * (l_extendedprice - my)) / (sum(pow(l_quantity - mx, 2)) + 1e6) AS w,
  any_value(mx) AS mx, any_value(my) AS my FROM lineitem CROSS JOIN m)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(w * (l_quantity - mx) + my, 3) + 0e0 AS prediction FROM lineitem CROSS JOIN f"""


@case("l2_ridge", RIDGE_SQL)
def _(spark, sf):
    return _fit_predict(spark, sf, "ridge", {"ridge__alpha": 1e6}, features=["l_quantity"]).withColumn(
        "prediction", r("prediction", 3))


def _search_sql(rows: str, folds: list[int], draws: list[dict], alpha: str, standardized: bool) -> str:
    """Ridge fits of all draws and folds from their moments, by Cramer's rule; ``rows`` has x0, x1, x2, y and fold."""
    x = range(3)
    moments = [*[f"avg(x{i}) AS m{i}" for i in x], "avg(y) AS my", "var_pop(y) AS vy", *[f"covar_pop(x{i}, y) AS r{i}" for i in x],
               *[f"covar_pop(x{i}, x{j}) AS c{i}{j}" for i in x for j in x]]
    unit = [f"sqrt(c{i}{i} * n / (n - 1))" if standardized else "1e0" for i in x]
    scaled = [*[f"{unit[i]} AS s{i}" for i in x], *[f"n * r{i} / {unit[i]} AS b{i}" for i in x],
              *[f"n * c{i}{j} / ({unit[i]} * {unit[j]}){' + alpha' if i == j else ''} AS a{i}{j}" for i in x for j in x]]
    matrix = [[f"a{i}{j}" for j in x] for i in x]
    weights = [f"({_det([[f'b{i}' if k == j else matrix[i][k] for k in x] for i in x])}) / ({_det(matrix)}) / s{j} AS w{j}" for j in x]
    left = lambda t: (f"({t}.vy - 2 * (" + " + ".join(f"w{i} * {t}.r{i}" for i in x) + ") + "
                      + " + ".join(f"w{i} * w{j} * {t}.c{i}{j}" for i in x for j in x) + ")")
    off = "(h.my - t.my - (" + " + ".join(f"w{i} * (h.m{i} - t.m{i})" for i in x) + "))"
    values = ", ".join(f"({i}, '{str(d).replace(chr(39), 2 * chr(39))}', CAST({d[alpha]!r} AS DOUBLE))" for i, d in enumerate(draws))
    r4 = lambda e: f"round({e}, 4)"
    return f"""
WITH rows AS ({rows}), folds AS (SELECT unnest({folds}) AS f),
draws AS (SELECT * FROM (VALUES {values}) v(draw, params, alpha)),
t AS (SELECT f, count(*) + 0e0 AS n, {", ".join(moments)} FROM rows JOIN folds ON fold <> f GROUP BY f),
h AS (SELECT f, count(*) + 0e0 AS n, {", ".join(moments)} FROM rows JOIN folds ON fold = f GROUP BY f),
a AS (SELECT draw, params, f, {", ".join(scaled)} FROM t CROSS JOIN draws),
w AS (SELECT draw, params, f, {", ".join(weights)} FROM a),
s AS (SELECT draw, params, f, 1 - {left("t")} / t.vy AS train, 1 - ({left("h")} + {off} * {off}) / h.vy AS val
  FROM w JOIN t USING (f) JOIN h USING (f)),
g AS (SELECT draw, params, list({r4("train")} ORDER BY f) AS train_scores, list({r4("val")} ORDER BY f) AS val_scores,
  avg(train) AS mt, stddev_pop(train) AS st, avg(val) AS mv, stddev_pop(val) AS sv FROM s GROUP BY draw, params)
SELECT CAST(draw AS INTEGER) AS draw, params, train_scores, val_scores, {r4("mt")} AS mean_train_score, {r4("st")} AS std_train_score,
  {r4("mv")} AS mean_val_score, {r4("sv")} AS std_val_score, CAST(rank() OVER (ORDER BY mv DESC) AS INTEGER) AS rank FROM g"""


_ROWS = "SELECT l_quantity AS x0, l_discount AS x1, l_tax AS x2, l_extendedprice AS y, {fold} AS fold FROM {of}"
_BY_HASH = "ORDER BY md5(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|0')"
_ALPHA = "ridge__alpha"
SEARCHED = {_ALPHA: "loguniform(1e-2, 1e3)"}, {_ALPHA: "uniform(0, 100)"}


@case("l3_kernel_svc")
def _(spark, sf):
    df = credit(Tables(spark, sf)).withColumn("good", C.flag("risk", "good").cast("double"))
    df = encode.category_codes(df, ["saving_accounts"])
    features = ["saving_accounts_code", "nation", "balance"]
    spec = models.ModelSpec("svc", features, "good", ["standard_scaler"], seed=0)
    return models.predict(spec.fit(df), df).select("id", "good", "prediction")


@case("l4_random_forest")
def _(spark, sf):
    return _fit_predict(spark, sf, "random_forest", {"random_forest__n_estimators": 100, "random_forest__max_depth": 6})


@case("l5_hist_boosting")
def _(spark, sf):
    return _fit_predict(spark, sf, "hist_boosting")


@case("l6_light_boosting_regressor")
def _(spark, sf):
    return _fit_predict(spark, sf, "light_boosting_regressor")


@case("l6_light_boosting_classifier")
def _(spark, sf):
    t = Tables(spark, sf)
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    docs = encode.category_codes(docs, ["lang", "source"])
    known = prep.align(docs, t.labels.select("doc_id", F.col("quality").cast("double").alias("quality")), ["doc_id"])
    spec = models.ModelSpec("light_boosting_classifier", ["lang_code", "source_code", "n_chars"], "quality", seed=0,
                            categorical=["lang_code", "source_code"])
    return models.predict(spec.fit(known), docs).select("doc_id", "prediction")


@case("l7_scaled_linear", ONE_FEATURE_SQL)
def _(spark, sf):
    out = _fit_predict(spark, sf, "scaled_linear", {"scaled_linear__custom_parameter": 2.5}, features=["l_quantity"])
    return out.withColumn("prediction", r("prediction", 3))


@case("l8_transformers_and_model", ONE_FEATURE_SQL)
def _(spark, sf):
    out = _fit_predict(spark, sf, "linear_regression", transformers=["min_max_scaler", "standard_scaler"],
                       features=["l_quantity"])
    return out.withColumn("prediction", r("prediction", 3))


@case("l9_random_search", _search_sql(_ROWS.format(fold=f"ntile(3) OVER ({_BY_HASH}) - 1", of="lineitem"), [0, 1, 2],
                                      models.draw_params(SEARCHED[0], 5, 0), _ALPHA, True))
def _(spark, sf):
    df = split.k_fold(housing(Tables(spark, sf)), KEY, 3, 0)
    spec = models.ModelSpec("ridge", HOUSE, "l_extendedprice", ["standard_scaler"],
                            SEARCHED[0], 0)
    return models.random_search(df, spec, 5, seed=0)[0]


@case("l9_random_search_predefined", _search_sql(_ROWS.format(fold="CAST(p > floor(0.7e0 * n) AS INTEGER)", of=f"""(
  SELECT *, row_number() OVER ({_BY_HASH}) AS p, count(*) OVER () AS n FROM lineitem)
  WHERE p <= n - ceil(0.5 * (n - floor(0.7e0 * n)))"""), [1], models.draw_params(SEARCHED[1], 5, 0), _ALPHA, False))
def _(spark, sf):
    df = split.train_val_test(housing(Tables(spark, sf)), KEY, seed=0)
    rows = split.predefined_split(df.filter("split = 'train'"), df.filter("split = 'val'"))
    spec = models.ModelSpec("ridge", HOUSE, "l_extendedprice", (), SEARCHED[1], 0)
    return models.random_search(rows, spec, 5, predefined=True, seed=0)[0]


@case("l10_batch_predict", ONE_FEATURE_SQL.replace("SELECT l_orderkey", """
, k AS (SELECT *, row_number() OVER (ORDER BY md5(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|0')) AS p,
  count(*) OVER () AS n FROM lineitem)
SELECT CASE WHEN p <= floor(0.8e0 * n) THEN 'train' ELSE 'test' END AS split, l_orderkey""").replace(
    "FROM lineitem CROSS JOIN f", "FROM k CROSS JOIN f"))
def _(spark, sf):
    df = split.train_test(housing(Tables(spark, sf)), KEY, 80, 20, 0)
    model = models.ModelSpec("linear_regression", ["l_quantity"], "l_extendedprice").fit(df)
    return models.predict(model, df).select("split", *KEY, r("prediction", 3))


@case("l11_zero_baseline", "SELECT o_orderkey, 0e0 AS prediction FROM orders")
def _(spark, sf):
    return models.predict_zero(Tables(spark, sf).orders).select("o_orderkey", "prediction")


@case("l13_clip_round", """
SELECT c_custkey, round_even(greatest(c_acctbal / 100, 0e0), 0) AS prediction FROM customer""")
def _(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", C.clip_round(F.col("c_acctbal") / 100).alias("prediction"))


# --- recursive forecast ---------------------------------------------------------------------------

FORECAST_SQL = f"""WITH RECURSIVE {PANEL_SQL}, m AS (SELECT max(d) AS n FROM days),
h AS (SELECT id, list(sold ORDER BY d) AS hist FROM panel CROSS JOIN m WHERE d > n - 35 AND d <= n - 28 GROUP BY id),
steps AS (
  SELECT id, 0 AS i, hist, round_even(list_sum(hist) / 7, 0) AS p FROM h
  UNION ALL
  SELECT id, i + 1, list_append(hist[2:7], p), round_even(list_sum(list_append(hist[2:7], p)) / 7, 0)
  FROM steps WHERE i < 27),
forecast AS (SELECT id, CAST(n - 28 + i AS INTEGER) AS d, p AS sold_next_day FROM steps CROSS JOIN m)
"""


def _history(t: Tables):
    df, n = sales_panel(t)
    return stage(df.select("id", *SERIES_ATTRS, "d", "sold"), "panel"), n


@case("l12_recursive_forecast", FORECAST_SQL + "SELECT id, d, sold_next_day FROM forecast")
def _(spark, sf):
    df, n = sales_panel(Tables(spark, sf))
    return forecast.expression_forecast(df, lambda f: f["sold_avg_7d"], n - 28, 28)


@case("l12_recursive_forecast_by_day", FORECAST_SQL + "SELECT id, d, sold_next_day FROM forecast")
def _(spark, sf):
    rows, n = _history(Tables(spark, sf))
    return forecast.recursive_forecast(rows, forecast.moving_average_model(7), n - 28, 28, groups={},
                                       features=[])


FEATURES = ["sold", "sold_lag_1", "sold_lag_7", "sold_lag_30", "sold_robustlag_7", "sold_avg_7d", "sold_avg_30d",
            "sold_max_14d", "sold_avg_expanding", "sold_avg_item", "sold_daily_deviation_from_avg"]


@case("l12_recursive_forecast_model")
def _(spark, sf):
    rows, n = _history(Tables(spark, sf))
    feats = panel.panel_features(rows, series_rows=n).filter(F.col("d") < n - 28).fillna(0.0)
    model = models.ModelSpec("ridge", FEATURES, "sold_next_day").fit(feats)
    return forecast.recursive_forecast(rows, forecast.mllib_model(model), n - 28, 28, "id", SERIES_ATTRS,
                                       groups={"item": panel.ENCODINGS["item"]},
                                       features=FEATURES)


OWN = [c for c in FEATURES if c not in ("sold_avg_item", "sold_daily_deviation_from_avg")]


@case("l12_forecast_linear_expression")
def _(spark, sf):
    """A fitted linear model folded over the horizon in one job."""
    rows, n = _history(Tables(spark, sf))
    feats = panel.add_expanding_mean(panel.add_window_features(rows))
    feats = feats.withColumn("sold_next_day", panel.lead_target("sold", ["id"]))
    feats = feats.filter(F.col("d") < n - 28).select(*OWN, "sold_next_day").fillna(0.0)
    fitted = models.ModelSpec("ridge", OWN, "sold_next_day").fit(feats).stages[-1]
    said = forecast.linear_expression(dict(zip(OWN, fitted.coefficients)), fitted.intercept)
    return forecast.expression_forecast(rows, said, n - 28, 28)


@case("l12_forecast_boosted_expression")
def _(spark, sf):
    """Twenty fitted boosted trees folded over the horizon in one job."""
    rows, n = _history(Tables(spark, sf))
    feats = panel.add_expanding_mean(panel.add_window_features(rows))
    feats = feats.withColumn("sold_next_day", panel.lead_target("sold", ["id"]))
    feats = feats.filter(F.col("d") < n - 28).select(*OWN, "sold_next_day").fillna(0.0)
    spec = models.ModelSpec("light_boosting_regressor", OWN, "sold_next_day", seed=0,
                            hparams={"light_boosting_regressor__n_estimators": 20})
    fitted = spec.fit(stage(feats, "features")).stages[-1]
    return forecast.expression_forecast(rows, trees.tree_expression(fitted, OWN), n - 28, 28)


# --- scores -----------------------------------------------------------------------------------------


def baseline_rows(t: Tables):
    """The last 7 days' mean against the next day, with chronological splits."""
    df, n = sales_panel(t)
    df = panel.backfill(panel.add_rolling_means(df, windows=(7,)), ["sold_avg_7d"])
    df = df.withColumn("sold_next_day", panel.lead_target("sold", ["id"]))
    part = F.when(F.col("d") <= n - 57, "train").when(F.col("d") <= n - 28, "val").otherwise("test")
    return df.filter(F.col("d") < n).select("id", "d", part.alias("split"), "sold_avg_7d", "sold_next_day")


W7 = "OVER (PARTITION BY id ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
BASELINE_SQL = f"""WITH {PANEL_SQL}, m AS (SELECT max(d) AS n FROM days),
w AS (SELECT id, d, n, CASE WHEN count(*) {W7} >= 7 THEN avg(sold) {W7} END AS a,
  lead(sold) OVER (PARTITION BY id ORDER BY d) AS y FROM panel CROSS JOIN m),
s AS (SELECT CASE WHEN d <= n - 57 THEN 'train' WHEN d <= n - 28 THEN 'val' ELSE 'test' END AS split, d, n, y,
  first_value(a IGNORE NULLS) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM w),
metric AS (SELECT split, count(*) AS n, avg(abs(y - p)) AS mae, avg(pow(y - p, 2)) AS mse, sqrt(avg(pow(y - p, 2))) AS rmse,
  sqrt(avg(pow(y - p, 2))) / (quantile_cont(p, 0.75) - quantile_cont(p, 0.25)) AS nrmse,
  1 - avg(pow(y - p, 2)) / var_pop(y) AS r2, 0e0 AS bsl_r2 FROM s WHERE d < n GROUP BY split)
"""
SCORES = metrics.REGRESSION


@case("v1_panel_baseline", BASELINE_SQL + "SELECT split, n, " + ", ".join(rsql(c, c, 5) for c in SCORES) + " FROM metric")
def _(spark, sf):
    rows = stage(baseline_rows(Tables(spark, sf)), "scored")
    out = metrics.regression_metrics(rows, "sold_next_day", "sold_avg_7d", ["split"])
    return out.select("split", "n", *[r(c, 5) for c in SCORES])


def target_sql(name: str, y: str, p: str) -> str:
    return (f"SELECT '{name}' AS target, count(*) AS n, avg(abs({y} - {p})) AS mae, avg(pow({y} - {p}, 2)) AS mse, "
            f"sqrt(avg(pow({y} - {p}, 2))) AS rmse, sqrt(avg(pow({y} - {p}, 2))) / (quantile_cont({p}, 0.75) - quantile_cont({p}, 0.25)) AS nrmse, "
            f"1 - avg(pow({y} - {p}, 2)) / var_pop({y}) AS r2, 0e0 AS bsl_r2 FROM lineitem")


@case("v2_multi_target", f"WITH e AS ({target_sql('a', 'l_discount', 'l_tax')} UNION ALL {target_sql('b', 'l_tax', 'l_discount')}), "
      "u AS (SELECT * FROM e UNION ALL SELECT 'Aggregated', CAST(sum(n) AS BIGINT), "
      + ", ".join(f"avg({c})" for c in SCORES) + " FROM e) SELECT target, n, " + ", ".join(rsql(c, c) for c in SCORES) + " FROM u")
def _(spark, sf):
    out = metrics.multi_target_metrics(Tables(spark, sf).lineitem, {"a": ("l_discount", "l_tax"), "b": ("l_tax", "l_discount")})
    return out.select("target", "n", *[r(c) for c in SCORES])


def labelled(t: Tables):
    """Long documents taken for good ones."""
    rows = prep.align(t.documents.select("doc_id", "lang", "n_chars"), t.labels.select("doc_id", "quality", "toxic"), ["doc_id"])
    return rows.withColumn("said", (F.col("n_chars") > 500).cast("int"))


LABELLED_SQL = """
x AS (SELECT doc_id, lang, n_chars, quality, toxic, CAST(n_chars > 500 AS INTEGER) AS said FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) AS n, count(*) FILTER (quality = 1 AND said = 1) AS tp, count(*) FILTER (quality = 0 AND said = 0) AS tn,
  count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg, count(*) FILTER (said = 1) AS yes FROM x)
"""


@case("v3_classification_metrics", "WITH" + LABELLED_SQL + "SELECT n, " + ", ".join([
    rsql("(tp + tn) / n", "accuracy"), rsql("coalesce(tp / nullif(yes, 0), 0e0)", "precision"),
    rsql("coalesce(tp / nullif(pos, 0), 0e0)", "recall"), rsql("coalesce(2 * tp / nullif(pos + yes, 0), 0e0)", "f1"),
    rsql("(tp / pos + tn / neg) / 2", "roc_auc")]) + " FROM c")
def _(spark, sf):
    out = metrics.classification_metrics(labelled(Tables(spark, sf)), "quality", "said")
    return out.select("n", *[r(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


MACRO_SQL = """WITH x AS (SELECT l_returnflag AS a, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS p FROM lineitem),
l AS (SELECT DISTINCT a AS k FROM x), n AS (SELECT count(*) + 0e0 AS n FROM x),
e AS (SELECT k, count(*) FILTER (a = k AND p = k) + 0e0 AS tp, count(*) FILTER (a = k) + 0e0 AS sup, count(*) FILTER (p = k) + 0e0 AS said
  FROM x CROSS JOIN l GROUP BY k)
SELECT CAST(any_value(n) AS BIGINT) AS n, round(sum(tp) / any_value(n), 6) + 0e0 AS accuracy,
  round(avg(coalesce(tp / nullif(said, 0), 0)), 6) + 0e0 AS precision, round(avg(tp / sup), 6) + 0e0 AS recall,
  round(avg(2 * tp / (sup + said)), 6) + 0e0 AS f1,
  round(avg((tp / sup + (n - sup - (said - tp)) / (n - sup)) / 2), 6) + 0e0 AS roc_auc FROM e CROSS JOIN n"""


@case("v3_macro_metrics", MACRO_SQL)
def _(spark, sf):
    q = F.col("l_quantity")
    df = Tables(spark, sf).lineitem.select(
        F.col("l_returnflag").alias("a"), F.when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("p"))
    out = metrics.classification_metrics(df, "a", "p")
    return out.select("n", *[r(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


@case("v4_score_auc", "WITH" + LABELLED_SQL + """, k AS (SELECT quality, rank() OVER (ORDER BY n_chars)
  + (count(*) OVER (PARTITION BY n_chars) - 1) / 2e0 AS rk FROM x)
SELECT round((sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2e0)
  / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) + 0e0 AS roc_auc FROM k""")
def _(spark, sf):
    return metrics.score_auc(labelled(Tables(spark, sf)), "quality", "n_chars").select(r("roc_auc"))


@case("v5_baseline_auc", "WITH" + LABELLED_SQL + """, g AS (SELECT quality,
  CASE WHEN CAST('0x' || substr(md5(doc_id || '|42'), 1, 8) AS BIGINT) / 4294967296e0 < (SELECT neg / n FROM c) THEN 0 ELSE 1 END AS guess FROM x)
SELECT round((count(*) FILTER (quality = 1 AND guess = 1) / count(*) FILTER (quality = 1)
  + count(*) FILTER (quality = 0 AND guess = 0) / count(*) FILTER (quality = 0)) / 2, 6) + 0e0 AS bsl_roc_auc FROM g""")
def _(spark, sf):
    return metrics.baseline_auc(labelled(Tables(spark, sf)), "quality", "doc_id").select(r("bsl_roc_auc"))


@case("v6_confusion", "WITH" + LABELLED_SQL + """
SELECT quality AS actual, said AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0e0 AS share
FROM x GROUP BY ALL""")
def _(spark, sf):
    return metrics.confusion(labelled(Tables(spark, sf)), "quality", "said").withColumn("share", r("share"))


@case("v7_score_table", BASELINE_SQL + "\nUNION ALL ".join(
    f"SELECT '{c}_' || split AS score, round({c}, 5) + 0e0 AS value FROM metric" for c in SCORES))
def _(spark, sf):
    rows = stage(baseline_rows(Tables(spark, sf)), "scored")
    table = metrics.regression_metrics(rows, "sold_next_day", "sold_avg_7d", ["split"])
    return metrics.score_table(table, "split", SCORES).withColumn("value", r("value", 5))


@case("v8_actual_and_predicted", ONE_FEATURE_SQL.replace("SELECT l_orderkey", "SELECT l_extendedprice, l_orderkey") + """
ORDER BY md5(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|3') LIMIT 1000""")
def _(spark, sf):
    df = housing(Tables(spark, sf))
    model = models.ModelSpec("linear_regression", ["l_quantity"], "l_extendedprice").fit(df)
    sample = sampling.random_rows(models.predict(model, df), KEY, 1000, 3)
    return sample.select(*KEY, "l_extendedprice", r("prediction", 3))


# --- stage catalogue and runner -------------------------------------------------------------------


@case("x1_stage_catalogue", """
SELECT c_custkey, coalesce(c_mktsegment, 'none') AS c_mktsegment FROM customer""")
def _(spark, sf):
    from panelyard.runner import default_catalogue

    book = default_catalogue()
    book.register("prepare_fill", lambda df: df.fillna({"c_mktsegment": "none"}))
    df = Tables(spark, sf).customer.select("c_custkey", "c_mktsegment")
    for name in ("load_passthrough", "prepare_fill"):
        df = df.transform(book.get(name))
    return df


@case("x2_run_stages")
def _(spark, sf):
    return run(spark, {
        "key": KEY, "model": "ridge", "features": HOUSE, "label": "l_extendedprice",
        "transformers": ["standard_scaler"], "hparams": {"ridge__alpha": "loguniform(0.01, 100)"},
        "split": ("split_train_val_test", {}), "draws": 5, "seed": 0, "output": new_path(spark, "run"),
    }, data=housing(Tables(spark, sf)))


@case("x3_group_function", f"WITH {PANEL_SQL} SELECT id, " + rsql("avg(sold)", "trimmed") + " FROM (SELECT id, sold, "
      "row_number() OVER (PARTITION BY id ORDER BY sold) AS lo, row_number() OVER (PARTITION BY id ORDER BY sold DESC) AS hi FROM panel) "
      "WHERE lo > 25 AND hi > 25 GROUP BY id")
def _(spark, sf):
    """A user function per group; a dense series is bounded by its number of days."""
    df, _ = sales_panel(Tables(spark, sf))

    def trimmed(pdf):
        x = pdf["sold"].sort_values().to_numpy()[25:-25]
        return pdf[["id"]].iloc[:1].assign(trimmed=x.mean())

    return df.select("id", "sold").groupBy("id").applyInPandas(trimmed, "id string, trimmed double").select("id", r("trimmed"))
