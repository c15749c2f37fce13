import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from panelyard.cases import load_cases
from panelyard.catalogue import Catalogue
from panelyard.functions import columns as C
from panelyard.operators import bootstrap, forecast, metrics, models, outliers, panel, sequences, split, trees
from panelyard.plans.staging import new_path
from panelyard.runner import run
from panelyard.streaming.scaling import scale_batches

ATTRS = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = x @ [2.0, -1.0, 0.5] + 3 + rng.normal(size=400) * 0.1
    return pd.DataFrame({"key": np.arange(400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y,
                         "good": (y > 3).astype(float)})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


COLS = ["a", "b", "c"]


@pytest.mark.parametrize("alpha", [0.0, 1.0, 250.0])
def test_ridge_closed_form(df, pdf, alpha):
    model = models.ModelSpec("ridge", COLS, "y", hparams={"ridge__alpha": alpha}).fit(df).stages[-1]
    x = pdf[COLS] - pdf[COLS].mean()
    w = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ (pdf["y"] - pdf["y"].mean()))
    np.testing.assert_allclose(model.coefficients.toArray(), w, rtol=1e-9)


def test_scaled_linear_undoes_its_factor(df):
    plain = models.ModelSpec("linear_regression", COLS, "y").fit(df).stages[-1]
    scaled = models.ModelSpec("scaled_linear", COLS, "y", hparams={"scaled_linear__custom_parameter": 4.0}).fit(df)
    np.testing.assert_allclose(scaled.stages[-1].coefficients.toArray() * 4, plain.coefficients.toArray())


@pytest.mark.parametrize("name", ["random_forest", "hist_boosting", "light_boosting_regressor"])
def test_trees_beat_the_mean(df, name):
    few = {f"{name}__max_iter" if name == "hist_boosting" else f"{name}__n_estimators": 5, f"{name}__max_depth": 5}
    out = models.predict(models.ModelSpec(name, COLS, "y", hparams=few, seed=1).fit(df), df)
    assert models.model_score(out, "y", "regression") > 0.4


@pytest.mark.parametrize("name,leaf", [("hist_boosting", "min_samples_leaf"), ("light_boosting_regressor", "min_child_samples")])
def test_boosting_on_cells_is_boosting_on_rows(spark, name, leaf):
    """Few different features: the trees are grown from one row for each, with leaves of as many rows as asked for."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.integers(0, 6, 900).astype(float), "b": rng.integers(0, 4, 900).astype(float)})
    pdf["y"] = pdf["a"] * 3 - pdf["b"] ** 2 + rng.normal(size=900)
    pdf.loc[:5, ["a", "b"]] = [[50.0, 9.0]] * 6  # a cell of fewer rows than a leaf has
    df = spark.createDataFrame(pdf)
    rounds = "max_iter" if name == "hist_boosting" else "n_estimators"
    for least in (1, 6, 7, 40):
        spec = models.ModelSpec(name, ["a", "b"], "y", hparams={f"{name}__{rounds}": 6, f"{name}__{leaf}": least}, seed=1)
        cells, rows = spec.as_cells(df)
        assert rows == 900 and cells.count() == 25 and cells.agg(F.sum(models.ROWS)).first()[0] == 900
        fitted = spec.fit(df)
        assert fitted.stages[-1].getWeightCol() == models.ROWS
        got = models.predict(fitted, df).toPandas()
        want = models.predict(spec.build().fit(df), df).toPandas()
        np.testing.assert_allclose(got["prediction"], want["prediction"], rtol=1e-9)
    assert spec.as_cells(df.withColumn("a", F.col("y")))[1] is None
    drawn = models.ModelSpec("light_boosting_regressor", ["a", "b"], "y", hparams={"light_boosting_regressor__subsample": 0.5})
    assert drawn.as_cells(df)[1] is None


def test_forest_on_drawn_cells_is_a_forest_on_drawn_rows(spark):
    """Few different features: every tree draws its rows as sums per cell, and grows as it would from the rows one by one."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 6, 3000).astype(float), "b": rng.integers(0, 4, 3000).astype(float), "key": np.arange(3000)})
    pdf["y"] = pdf["a"] * 3 - pdf["b"] ** 2 + rng.normal(size=3000)
    df = spark.createDataFrame(pdf).repartition(3)
    hparams = {"random_forest__n_estimators": 30, "random_forest__max_depth": 4, "random_forest__min_samples_leaf": 40}
    spec = models.ModelSpec("random_forest", ["a", "b"], "y", hparams=hparams, seed=1)
    drawn, counts = spec.draws(df)
    assert len(counts) == 30 and abs(sum(counts) / 30 - 3000) < 5 * (3000 / 30) ** 0.5 and len(set(counts)) > 10
    cells = drawn.toPandas()
    assert len(cells) == 30 * 24 and not cells.duplicated([models.TREE, "a", "b"]).any() and (cells[models.ROWS] % 1 == 0).all()
    forest = spec.fit(df)
    assert forest.stages[-1].getNumTrees == 30 and len(forest.stages[-1].trees) == 30
    got = models.predict(forest, df, ["key"]).orderBy("key").toPandas()["prediction"]
    each = []
    for i in range(30):
        rows = drawn.filter(F.col(models.TREE) == i).withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col(models.ROWS).cast("int"))))
        tree = spec.with_params({"random_forest__n_estimators": 1, "random_forest__bootstrap": False}).fit(rows)
        each.append(models.predict(tree, df, ["key"]).orderBy("key").toPandas()["prediction"].to_numpy())
    np.testing.assert_allclose(got, np.mean(each, axis=0), rtol=1e-9)
    assert np.std(each, axis=0).mean() > 0.01
    by_rows = models.predict(spec.build().fit(df), df, ["key"]).orderBy("key").toPandas()["prediction"]
    assert np.abs(got - by_rows).mean() < 0.1
    path = new_path(spark, "model")
    forest.write().overwrite().save(path)
    again = models.predict(PipelineModel.load(path), df, ["key"]).orderBy("key").toPandas()["prediction"]
    np.testing.assert_allclose(again, got, rtol=1e-12)
    assert spec.draws(df.withColumn("a", F.col("y"))) is None
    assert spec.with_params({"random_forest__bootstrap": False}).draws(df) is None
    for column in ("y", "a"):  # what MLlib refuses in a row it refuses in a cell, whether a tree has drawn it or not
        with pytest.raises(Exception, match="MUST NOT be"):
            spec.fit(df.withColumn(column, F.when(F.col("key") != 7, F.col(column))))


def test_bootstrap_numbers_are_poisson_numbers(monkeypatch):
    """Frequencies, and sums per cell and sample that are those of the rows whatever the portions."""
    for rate in (1.0, 0.3):
        drawn = bootstrap.Poisson(rate, [3, 0]).draw(4000, 200)
        want = [math.exp(-rate) * rate ** k / math.factorial(k) for k in range(6)]
        np.testing.assert_allclose(np.bincount(drawn.ravel(), minlength=6)[:6] / drawn.size, want, atol=0.002)
        assert abs(np.corrcoef(drawn[:, 0], drawn[:, 1])[0, 1]) < 0.08
    monkeypatch.setattr(bootstrap, "AT_ONCE", 7)
    monkeypatch.setattr(bootstrap, "HANDED", 20)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 3, (100, 2)).astype(float), rng.normal(size=100)
    x[:4, 0] = -0.0
    sums = bootstrap.Sums(2, 5)
    sums.add(x[:60], y[:60], bootstrap.Poisson(1.0, [1, 2]))
    sums.add(x[60:], y[60:], bootstrap.Poisson(1.0, [1, 3]))
    times, total = np.zeros((3, 3, 5)), np.zeros((3, 3, 5))
    for part, source in ((slice(0, 60), bootstrap.Poisson(1.0, [1, 2])), (slice(60, 100), bootstrap.Poisson(1.0, [1, 3]))):
        slots = pd.Series(list(map(tuple, x[part] + 0.0))).map({tuple(np.frombuffer(k)): i for k, i in sums.slots.items()})
        order = np.argsort(slots.to_numpy(), kind="stable")
        for at in range(0, len(order), 7):
            for row, drawn in zip(order[at:at + 7], source.draw(len(order[at:at + 7]), 5).astype(float)):
                a, b = x[part][row].astype(int)
                times[a, b] += drawn
                total[a, b] += drawn * y[part][row]
    out = pd.concat(sums.frames(["sample", "a", "b", "times", "label"]))
    where = tuple(out[c].astype(int) for c in ("a", "b", "sample"))
    assert len(out) == (times > 0).sum() and (out["times"] == times[where]).all()
    np.testing.assert_allclose(out["label"], total[where], atol=1e-12)


def test_kernel_fits_read_few_rows_a_task(df, monkeypatch):
    """One file or partition of any size is dealt out before its rows become Fourier features; the fit stays the same."""
    spec = models.ModelSpec("svc", COLS, "good", ["standard_scaler"], {"svc__max_iter": 10}, 1)
    one, n = df.coalesce(1), df.count()
    whole = spec.fit(one).stages[-1]
    monkeypatch.setattr(models, "WIDENED", 100)
    held = [len(part) for part in spec.dealt(one, n).rdd.glom().collect()]
    assert sum(held) == n and len(held) == -(-n // 100) and max(held) <= 110
    parts = spec.fit(one).stages[-1]
    np.testing.assert_allclose(parts.coefficients.toArray(), whole.coefficients.toArray(), rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("name", ["svc", "light_boosting_classifier"])
def test_classifiers(df, name):
    spec = models.ModelSpec(name, COLS, "good", ["standard_scaler"],
                            {"svc__gamma": 0.2, "svc__C": 10.0} if name == "svc" else {f"{name}__n_estimators": 5}, 1)
    out = models.predict(spec.fit(df), df)
    assert models.model_score(out, "good", "classification") > 0.8


def test_rbf_sampler_step(df):
    spec = models.ModelSpec("linear_regression", COLS, "y", ["standard_scaler", "rbf_sampler"],
                            {"rbf_sampler__n_components": 20, "rbf_sampler__gamma": 0.1})
    out = models.predict(spec.fit(df), df)
    assert models.model_score(out, "y", "regression") > 0.3


def test_distributions():
    rng = np.random.default_rng(0)
    ints = {models.parse_distribution("randint(2, 5)")(rng) for _ in range(200)}
    assert ints == {2, 3, 4}
    uni = [models.parse_distribution("uniform(1, 2)")(rng) for _ in range(500)]
    assert 1 <= min(uni) and max(uni) <= 3 and max(uni) > 2.5
    logs = [models.parse_distribution("loguniform(1e-3, 1e3)")(rng) for _ in range(500)]
    assert 1e-3 <= min(logs) and max(logs) <= 1e3 and 0.3 < np.mean(np.array(logs) < 1) < 0.7
    with pytest.raises(ValueError):
        models.parse_distribution("normal(0, 1)")


@pytest.mark.parametrize("name, steps, hparams", [
    ("ridge", ["standard_scaler"], {"ridge__alpha": "loguniform(0.01, 1000)"}),
    ("ridge", ["min_max_scaler", "standard_scaler"], {"ridge__alpha": "uniform(0, 50)", "standard_scaler__with_mean": False}),
    ("ridge", [], {"ridge__alpha": "uniform(0, 50)", "ridge__fit_intercept": False}),
    ("linear_regression", ["min_max_scaler"], {"linear_regression__fit_intercept": False}),
    ("scaled_linear", [], {"scaled_linear__custom_parameter": "uniform(1, 5)"})])
def test_search_from_moments_equals_the_fits(df, name, steps, hparams):
    rows = df.withColumn("fold", (F.col("key") % 3).cast("int"))
    spec = models.ModelSpec(name, COLS, "y", steps, hparams)
    draws = models.draw_params(spec.hparams, 2, 1)
    fitted = models._scores_by_fits(rows, spec, draws, [0, 2], "fold", 4)
    found = models.linear_search.fold_moments(rows, spec.features, "y", "fold")
    assert sum(m.n for m in found.values()) == rows.count()
    for i, fold, train, val in fitted:
        got = models.linear_search.scores(found, spec.with_params(draws[i]), fold)
        assert got == pytest.approx((train, val), abs=1e-9)


def test_search_from_moments_with_a_constant_feature(df):
    rows = df.withColumn("fold", (F.col("key") % 3).cast("int")).withColumn("same", F.lit(2.5))
    spec = models.ModelSpec("ridge", [*COLS, "same"], "y", ["standard_scaler"], {"ridge__alpha": 3.0})
    found = models.linear_search.fold_moments(rows, spec.features, "y", "fold")
    alone = models.linear_search.fold_moments(rows, COLS, "y", "fold")
    without = models.ModelSpec("ridge", COLS, "y", ["standard_scaler"], {"ridge__alpha": 3.0})
    assert models.linear_search.scores(found, spec, 1) == pytest.approx(models.linear_search.scores(alone, without, 1), abs=1e-12)
    with pytest.raises(Exception, match="without nulls"):
        models.linear_search.fold_moments(rows.withColumn("a", F.when(F.col("key") > 5, F.col("a"))), COLS, "y", "fold")


def test_parameters_are_taken_or_refused(df):
    for name, params in (("ridge", {"max_depth": 3}), ("random_forest", {"max_depth": 31}), ("hist_boosting", {"subsample": 0.5}),
                         ("light_boosting_regressor", {"reg_alpha": 1.0}), ("svc", {"kernel": "poly"})):
        with pytest.raises(ValueError):
            models.ModelSpec(name, COLS, "y", hparams={f"{name}__{k}": v for k, v in params.items()}).build()
    with pytest.raises(ValueError):
        models.ModelSpec("ridge", COLS, "y", hparams={"rigde__alpha": 1.0})
    with pytest.raises(ValueError):
        models.ModelSpec("ridge", COLS, "y", categorical=COLS[:1])
    with pytest.raises(ValueError):
        models.ModelSpec("random_forest", COLS, "y", categorical=["nope"])
    light = models.ModelSpec("light_boosting_regressor", COLS, "y", hparams={
        "light_boosting_regressor__max_bin": 20, "light_boosting_regressor__max_depth": 3, "light_boosting_regressor__subsample": 0.5})
    stage = light.build().getStages()[-1]
    assert (stage.getMaxBins(), stage.getMaxDepth(), stage.getSubsamplingRate()) == (20, 3, 0.5)
    assert models.ModelSpec("random_forest", COLS, "y").build().getStages()[-1].getMaxDepth() == models.DEEPEST


def test_kernel_width_follows_the_features(df):
    gamma = lambda spec: spec.build(*spec.kernel_statistics(df)).getStages()[-2].getOrDefault("gamma")
    # Scaled features have variance 1.
    assert gamma(models.ModelSpec("svc", COLS, "good", ["standard_scaler"])) == pytest.approx(1 / len(COLS), rel=0.01)
    x = df.select(*COLS).toPandas().to_numpy(float)
    assert gamma(models.ModelSpec("svc", COLS, "good")) == pytest.approx(1 / (len(COLS) * x.var()))
    assert gamma(models.ModelSpec("svc", COLS, "good", hparams={"svc__gamma": 0.3})) == 0.3
    assert models.ModelSpec("svc", COLS, "good").kernel_statistics(df.limit(0))[1] is None


def test_categories_by_name(spark):
    """Forty unordered stores are split as categories, a count with few values is not; unseen codes are scored."""
    rng = np.random.default_rng(6)
    store, n = rng.integers(0, 40, 3000), rng.integers(0, 5, 3000)
    effect = rng.permutation(40) % 2 * 10.0
    pdf = pd.DataFrame({"store": store, "n": n, "y": effect[store] + n})
    df = spark.createDataFrame(pdf)
    spec = models.ModelSpec("light_boosting_regressor", ["store", "n"], "y", categorical=["store"], seed=1, hparams={
        "light_boosting_regressor__n_estimators": 2, "light_boosting_regressor__max_depth": 2, "light_boosting_regressor__learning_rate": 1.0})
    model = spec.fit(df)
    assert model.stages[-1].getMaxBins() == 255
    nodes = model.stages[-1].toDebugString
    assert "feature 0 in {" in nodes and "feature 1 in {" not in nodes
    out = models.predict(model, df)
    assert models.model_score(out, "y", "regression") > 0.95
    strange = spark.createDataFrame([(99, 1, 0.0), (-1, 1, 0.0), (None, 1, 0.0)], "store long, n long, y double")
    said = {r.prediction for r in models.predict(model, strange).collect()}
    assert len(said) == 1
    path = new_path(spark, "model")
    model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    assert models.predict(back, strange).first().prediction in said


@pytest.mark.parametrize("name", ["light_boosting_regressor", "random_forest"])
def test_tree_expression_is_the_model(spark, df, name):
    rows = df.withColumn("shop", (F.col("key") % 7).cast("long"))
    spec = models.ModelSpec(name, [*COLS, "shop"], "y", categorical=["shop"], seed=2, hparams={f"{name}__n_estimators": 5, f"{name}__max_depth": 4})
    model = spec.fit(rows)
    said = trees.tree_expression(model.stages[-1], [*COLS, "shop"])({c: F.col(c) for c in [*COLS, "shop"]})
    got = models.predict(model, rows).withColumn("said", said).agg(F.max(F.abs(F.col("said") - F.col("prediction")))).first()[0]
    assert got < 1e-9


def test_boosted_forecast_in_one_job_equals_day_by_day(spark):
    rng = np.random.default_rng(9)
    rows = [(f"s{s}", d, float(rng.poisson(3 + s + d % 7))) for s in range(4) for d in range(1, 61)]
    history = spark.createDataFrame(rows, "id string, d int, sold double")
    own = ["sold", "sold_lag_1", "sold_lag_7", "sold_avg_7d", "sold_max_14d"]
    feats = panel.add_window_features(history).withColumn("sold_next_day", panel.lead_target("sold", ["id"]))
    model = models.ModelSpec("light_boosting_regressor", own, "sold_next_day", seed=0, hparams={
        "light_boosting_regressor__n_estimators": 4}).fit(feats.filter("d < 55").fillna(0.0))
    one = forecast.expression_forecast(history, trees.tree_expression(model.stages[-1], own), 55, 5).collect()
    each = forecast.recursive_forecast(history, forecast.mllib_model(model), 55, 5, groups={}, features=own).collect()
    assert sorted(one) == sorted(each) and len(one) == 20


def test_random_search_ranks_by_validation_score(df):
    rows = split.k_fold(df, "key", 3)
    spec = models.ModelSpec("ridge", COLS, "y", hparams={"ridge__alpha": "loguniform(0.001, 100000)"})
    table, best = models.random_search(rows, spec, 4, seed=3)
    got = table.toPandas()
    assert len(got) == 4 and (got["val_scores"].str.len() == 3).all()
    assert got.loc[got["rank"] == 1, "params"].tolist() == [str(best)]
    assert got.loc[got["rank"] == 1, "mean_val_score"].iloc[0] == got["mean_val_score"].max()


def test_search_on_one_predefined_split(df):
    rows = split.predefined_split(df.filter("key < 300"), df.filter("key >= 300"))
    assert {r["fold"] for r in rows.filter("key < 300").collect()} == {0}
    spec = models.ModelSpec("ridge", COLS, "y", hparams={"ridge__alpha": "uniform(0, 1)"})
    table, _ = models.random_search(rows, spec, 2, predefined=True)
    assert [len(r["val_scores"]) for r in table.collect()] == [1, 1]


def test_clip_and_round_half_even(spark):
    df = spark.createDataFrame([(v,) for v in (-1.5, 0.5, 1.5, 2.5, 2.6)], "x double")
    assert [r[0] for r in df.select(C.clip_round(F.col("x"))).collect()] == [0.0, 0.0, 2.0, 2.0, 3.0]


# --- forecast ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sales(spark):
    rng = np.random.default_rng(7)
    rows = [(f"s{i}", f"i{i % 2}", "d", "c", f"st{i}", "x", d, float(rng.integers(0, 9)))
            for i in range(4) for d in range(1, 621)]
    return spark.createDataFrame(rows, "id string, " + ", ".join(f"{a} string" for a in ATTRS) + ", d int, sold double")


def by_hand(pdf, start, steps, window=7):
    out = {}
    for s, g in pdf.groupby("id"):
        hist = list(g.sort_values("d").query("d <= @start")["sold"])
        for i in range(steps):
            hist.append(float(np.rint(max(np.mean(hist[-window:]), 0))))
            out[(s, start + i)] = hist[-1]
    return out


def test_forecasts_match_a_plain_loop(sales):
    want = by_hand(sales.toPandas(), 600, 6)
    a = forecast.expression_forecast(sales, lambda f: f["sold_avg_7d"], 600, 6)
    b = forecast.recursive_forecast(sales, forecast.moving_average_model(7), 600, 6, groups={})
    for out in (a, b):
        assert {(r["id"], r["d"]): r["sold_next_day"] for r in out.collect()} == want


def test_one_day_features_equal_the_panel_features(sales):
    """The state's features for a day are the panel's features for that day, given the same past."""
    state = forecast.initial_state(sales, "id", ATTRS, 610)
    got = forecast.day_features(state).toPandas().sort_values("id")
    want = panel.panel_features(sales.filter("d <= 610")).filter("d = 610").toPandas().sort_values("id")
    for c in want.columns:
        if c.startswith("sold") and c != "sold_next_day":
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, err_msg=c)


def test_group_means_follow_the_predictions(sales):
    """A model that says the item mean: the mean must include earlier predictions."""
    model = lambda df: df.withColumn("prediction", F.col("sold_avg_item") * 3)
    out = forecast.recursive_forecast(sales, model, 600, 3, "id", ATTRS, groups={"item": ["item_id"]}).collect()
    pdf = sales.toPandas().query("d <= 600")
    sums = pdf.groupby("id")["sold"].agg(["sum", "count"])
    item = pdf.groupby("id")["item_id"].first()
    got = {(r["id"], r["d"]): r["sold_next_day"] for r in out}
    for i in range(3):
        group = sums.groupby(item).sum()
        said = np.rint(item.map(group["sum"] / group["count"]) * 3)
        for s in sums.index:
            assert got[(s, 600 + i)] == said[s]
        sums["sum"] += said
        sums["count"] += 1


def test_linear_expression_equals_the_model(sales):
    cols = ["sold", "sold_lag_7", "sold_avg_7d", "sold_max_14d"]
    feats = panel.add_rolling_max(panel.add_rolling_means(panel.add_lags(sales), windows=(7,)))
    feats = feats.withColumn("y", panel.lead_target("sold", ["id"])).filter("d > 20 and d < 600")
    model = models.ModelSpec("ridge", cols, "y").fit(feats)
    line = forecast.linear_expression(dict(zip(cols, model.stages[-1].coefficients)), model.stages[-1].intercept)
    a = forecast.expression_forecast(sales, line, 600, 4)
    b = forecast.recursive_forecast(sales, forecast.mllib_model(model), 600, 4, groups={})
    assert a.exceptAll(b).count() == 0 and a.count() == 16


# --- scores ----------------------------------------------------------------------------------------------


def test_regression_metrics(spark):
    rng = np.random.default_rng(4)
    y, p = rng.normal(size=200), rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    row = metrics.regression_metrics(df, "y", "p").first()
    mse = np.mean((y - p) ** 2)
    iqr = np.subtract(*np.percentile(p, [75, 25]))
    want = {"mae": np.mean(abs(y - p)), "mse": mse, "rmse": mse**0.5, "nrmse": mse**0.5 / iqr,
            "r2": 1 - mse / y.var(), "bsl_r2": 0.0}
    for k, v in want.items():
        assert row[k] == pytest.approx(v)


def test_classification_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (0, 0)], "y int, p int")
    row = metrics.classification_metrics(df, "y", "p").first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    assert row["accuracy"] == pytest.approx(1 / 3) and row["roc_auc"] == 0.5


def test_score_auc_with_ties(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.normal(size=300) + y, 1)
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    assert metrics.score_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(want)


def test_stratified_guess_keeps_class_shares(spark):
    df = spark.range(20000).withColumn("y", F.when(F.col("id") % 10 < 2, 0).when(F.col("id") % 10 < 5, 1).otherwise(2))
    out = metrics.stratified_guess(df, "y", "id").groupBy("guess").count().collect()
    shares = {r["guess"]: r["count"] / 20000 for r in out}
    assert shares == pytest.approx({0: 0.2, 1: 0.3, 2: 0.5}, abs=0.02)


# --- outliers and sequences --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [300, 40000])
def test_isolation_forest_finds_planted_outliers(spark, n):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 2))
    x[:3] = [[9, 9], [-9, 8], [10, -9]]
    df = spark.createDataFrame(pd.DataFrame({"key": np.arange(n), "a": x[:, 0], "b": x[:, 1]}))
    out = outliers.isolation_forest(df, "key", ["a", "b"], trees=50, sample=128).toPandas()
    planted = out["key"] < 3
    # A row that no tree has seen falls into the leaf of the outermost row that it has.
    assert out.loc[planted, "score"].min() >= out.loc[~planted, "score"].quantile(0.999)
    assert out.loc[out["key"] < 3, "outlier"].eq(1).all()
    assert out["score"].between(0, 1).all() and out["outlier"].mean() < 0.5


@pytest.mark.parametrize("n", [100, 1000, 20_000])
def test_tree_samples_are_exact(spark, n):
    """Each tree has the rows of its smallest hashes, as many as asked for, by one rule for every size."""
    df = spark.range(n).select(F.col("id").alias("key"), F.col("id").cast("double").alias("a"))
    got = outliers.tree_samples(df, "key", ["a"], 20, 128, 3).toPandas()
    sizes = got.groupby("tree").size()
    assert list(sizes.index) == list(range(20)) and set(sizes) == {min(n, 128)}
    assert not got.duplicated().any()
    again = outliers.tree_samples(df.repartition(5), "key", ["a"], 20, 128, 3).toPandas()
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, again.to_numpy()))
    every = outliers.tree_samples(df, "key", ["a"], 20, n, 3).groupBy("tree").count().collect()
    assert {r["count"] for r in every} == {n}


def test_trees_by_levels_end_where_their_nodes_end(spark):
    """Levels are the nodes of a tree from the root on, NaN goes right, and few rows are dealt to trees."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    feature, cut, left, right, size, depth = (np.array(v) for v in zip(*outliers._grow(x, rng, 8)))
    levels, end = outliers._levels(feature, cut, left, right, depth + outliers._path_norm(size))
    assert len(levels) <= 8 and len(end) == 2 ** len(levels)
    for row in [*x, *rng.normal(size=(50, 2)) * 3, np.array([np.nan, 0.0]), np.array([np.inf, -np.inf])]:
        node, at = 0, 0
        while feature[node] >= 0:
            node = left[node] if row[feature[node]] <= cut[node] else right[node]
        for features, cuts in levels:
            at = 2 * at + int(not row[features[at]] <= cuts[at])
        assert end[at] == depth[node] + outliers._path_norm(size[node])
    df = spark.range(50_000).select(F.col("id").alias("key"), F.col("id").cast("double").alias("a"))
    plan = outliers.tree_samples(df, "key", ["a"], 20, 8, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "least(xxhash64" in plan


def test_forest_on_constant_data(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(50)], "key int, a double")
    assert outliers.isolation_forest(df, "key", ["a"], trees=5).agg(F.countDistinct("score")).first()[0] == 1


@pytest.mark.parametrize("chunk", [5, 7, 1000])
def test_windows_cross_chunk_borders(spark, chunk):
    df = spark.createDataFrame([(s, i, float(i)) for s in "ab" for i in range(23)], "s string, i int, v double")
    out = sequences.sliding_windows(df, ["i"], "v", 5, ["s"], chunk=chunk).collect()
    got = {(r["s"], r["start"]): r["window"] for r in out}
    assert got == {(s, k): [float(k + j) for j in range(5)] for s in "ab" for k in range(19)}


def test_series_shorter_than_the_window(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(3)], "i int, v double")
    assert sequences.sliding_windows(df, ["i"], "v", 5).count() == 0


def test_reconstruction_errors(spark):
    x = np.random.default_rng(0).normal(size=200).cumsum()
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double")
    w = sequences.sliding_windows(df, ["i"], "v", 20)
    want = np.lib.stride_tricks.sliding_window_view(x, 20)
    got = sequences.mean_reconstruction(w).orderBy("start").toPandas()["error"]
    np.testing.assert_allclose(got, want.var(axis=1))
    sums = [sequences.pca_reconstruction(w, w, k).agg(F.sum("error")).first()[0] for k in (1, 3, 8)]
    assert sums[0] > sums[1] > sums[2] >= 0
    flags = sequences.flag_errors(sequences.mean_reconstruction(w))
    cut = np.percentile(want.var(axis=1), 95)
    assert flags.filter("anomaly = 1").count() == (want.var(axis=1) > cut).sum()


# --- streaming and runs ------------------------------------------------------------------------------------


def feed(spark, values):
    path = new_path(spark, "in")
    for batch in values:
        spark.createDataFrame([(float(v),) for v in batch], "v double").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("v double").option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("keep", [True, False])
def test_stream_scaling(spark, keep):
    stream = feed(spark, [[0, 10], [0, 5, 20]])
    out, params = new_path(spark, "out"), new_path(spark, "params")
    scale_batches(stream, "v", out, params, new_path(spark, "ck"), keep).awaitTermination()
    got = spark.read.parquet(out).toPandas()
    assert len(got) == 5
    for _, g in got.groupby("batch_id"):
        low, high = (g["v"].min(), g["v"].max())
        if not keep:
            first = got[got["batch_id"] == 0]["v"]
            low, high = first.min(), first.max()
        np.testing.assert_allclose(g["v_scaled"], (g["v"] - low) / (high - low))


def test_catalogue():
    book = Catalogue()
    book.register("load_x", len)
    with pytest.raises(ValueError):
        book.register("load_x", max)
    assert book.get("load_x") is len and book.get("nope") is None and book.names("load") == ["load_x"]


def test_run_searches_scores_and_saves(spark, df):
    out = new_path(spark, "run")
    scores = run(spark, {"key": "key", "model": "ridge", "features": COLS, "label": "y", "folds": 3, "draws": 2,
                         "transformers": ["standard_scaler"], "hparams": {"ridge__alpha": "loguniform(0.01, 1)"},
                         "split": ("split_train_test", {"train_prc": 75, "test_prc": 25}), "output": out}, data=df)
    got = {r["score"]: r["value"] for r in scores.collect()}
    assert got["r2_test"] > 0.98 and got["r2_train"] > 0.98
    assert spark.read.parquet(f"{out}/runs").count() == 1
    assert spark.read.option("header", True).csv(f"{out}/search/run").count() == 2


def test_run_classification_with_validation_split(spark, df):
    scores = run(spark, {"key": "key", "model": "svc", "features": COLS, "label": "good",
                         "hparams": {"svc__C": "uniform(1, 5)"}, "draws": 1,
                         "split": ("split_train_val_test", {})}, data=df)
    got = {r["score"]: r["value"] for r in scores.collect()}
    assert got["accuracy_test"] > 0.8 and set(got) >= {"accuracy_val", "f1_train"}


def test_features_are_saved_and_reloaded(spark, df):
    out = new_path(spark, "run")
    config = {"key": "key", "model": "ridge", "features": COLS, "label": "y", "output": out, "save_features": True}
    rows = df.withColumn("d", (F.col("key") % 900).cast("int"))
    first = {r["score"]: r["value"] for r in run(spark, config, data=rows).collect()}
    stored = f"{out}/features/run"
    assert spark.read.parquet(stored).count() == rows.count()
    again = run(spark, {k: v for k, v in config.items() if k not in ("output", "save_features")} | {"reload_features": stored})
    assert {r["score"]: r["value"] for r in again.collect()} == pytest.approx(first)
    plain = run(spark, config | {"run_id": "plain"}, data=df)
    assert {r["score"]: r["value"] for r in plain.collect()} == pytest.approx(first)


def test_unknown_stage(spark, df):
    with pytest.raises(ValueError):
        run(spark, {"key": "key", "stages": [("nope", {})]}, data=df)


def test_search_needs_validation_rows(spark, df):
    config = {"key": "key", "model": "ridge", "features": COLS, "label": "y", "hparams": {"ridge__alpha": "uniform(0, 1)"}}
    with pytest.raises(ValueError, match="validation"):
        run(spark, config, data=df)


def test_run_subsamples_reloads_and_evaluates_by_name(spark, df):
    out = new_path(spark, "run")
    config = {"key": "key", "model": "ridge", "features": COLS, "label": "y", "output": out,
              "subsample": ("subsample_keys", {"key": "key", "rate": 0.5}), "evaluate": ("evaluate_regression", {})}
    first = {r["score"]: r["value"] for r in run(spark, config, data=df).collect()}
    again = run(spark, {"key": "key", "label": "y", "reload": f"{out}/models/run"}, data=df)
    assert {r["score"]: r["value"] for r in again.collect()} == pytest.approx(first)
    with pytest.raises(ValueError, match="no stage"):
        run(spark, {**config, "evaluate": "nope"}, data=df)


def test_run_panel_with_a_model(spark):
    rows = [("a" if i < 60 else "b", i % 60 + 1, float(i % 7)) for i in range(120)]
    data = spark.createDataFrame(rows, "id string, d int, sold double")
    data = panel.add_lags(data, lags=(7,)).withColumn("sold_next_day", panel.lead_target("sold", ["id"])).fillna(0.0)
    scores = run(spark, {
        "model": "ridge", "features": ["sold", "sold_lag_7"], "label": "sold_next_day",
        "split": ("split_panel", {"train_end": 40, "val_end": 49}),
        "predict": ("predict_recursive", {"start_day": 50, "steps": 10, "features": ["sold", "sold_lag_7"]})}, data=data)
    assert {r["score"] for r in scores.collect()} >= {"mae_train", "mae_val", "mae_test"}


def test_stratified_guess_of_many_classes(spark):
    df = spark.range(4000).withColumn("y", F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id")))
    got = metrics.stratified_guess(df, "y", "id")
    assert got.count() == 4000 and got.where("guess is null").count() == 0
    assert 1850 < got.where("guess = 0").count() < 2150
    assert got.select("guess").distinct().count() > 1000
    none = metrics.stratified_guess(df.withColumn("y", F.lit(None).cast("int")), "y", "id")
    assert none.count() == none.where("guess is null").count() == 4000


@pytest.mark.parametrize("name", ["l5_hist_boosting", "l6_light_boosting_regressor", "l6_light_boosting_classifier"])
def test_boosted_queries_fit_all_rounds(spark, folder, monkeypatch, name):
    class Fitted(Exception):
        pass

    def fit(self, df):
        raise Fitted(self.build().getStages()[-1].getMaxIter())

    monkeypatch.setattr(models.ModelSpec, "fit", fit)
    with pytest.raises(Fitted, match="^100$"):
        load_cases()[0][name](spark, folder)


@pytest.mark.parametrize("name, table, columns", [
    ("x2_retail_explore", "items_per_state", {"state_id", "unique_items"}),
    ("x2_credit_explore", "contingency", {"column_name", "level", "good_risk", "n"})])
def test_exploration_delivers_its_rows(spark, folder, name, table, columns):
    rows = [json.loads(r.row) for r in load_cases()[0][name](spark, folder).collect() if r.name == table]
    assert len(rows) > 1 and all(set(r) == columns for r in rows)
