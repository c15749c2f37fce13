"""End-to-end run from a configuration (X2): load, prepare, features, split, search, fit,
predict, score, save."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.analyses import credit, retail
from panelyard.catalogue import Catalogue
from panelyard.operators import encode, forecast, metrics, models, panel, sampling, split
from panelyard.plans import stage
from panelyard.sources import append_run, load_features, load_model, load_table, save_features, save_model, save_scores


def panel_parts(df: DataFrame, key=None, seed=0, *, train_end: int, val_end: int, day="d") -> DataFrame:
    """Adds ``split`` by day, as ``split.panel_split`` cuts it; key and seed play no part."""
    d = F.col(day)
    part = F.when(d <= train_end, "train").when(d <= val_end, "val").otherwise("test")
    return df.withColumn("split", part)


def predict_recursive(model, df: DataFrame, *, start_day: int, steps: int, series="id", attrs=(), value="sold", day="d",
                      groups=None, features=None) -> DataFrame:
    """Batch predictions up to ``start_day``, then a forecast of ``steps`` days that feeds on itself.

    From ``start_day`` on nothing that was sold is read. ``model`` is a fitted MLlib model, or None for the mean of
    the last seven days. The rows keep their columns; days beyond the horizon are left out.
    """
    if model is None:
        one_day, known = forecast.moving_average_model(7, value), None
    else:
        one_day, known = forecast.mllib_model(model), models.predict(model, df.where(F.col(day) < start_day))
    history = df.select(series, *attrs, day, value)
    said = forecast.recursive_forecast(history, one_day, start_day, steps, series, attrs, value, day,
                                       groups=groups or {}, features=features or [])
    said = said.select(F.col(series).alias("__series"), F.col(day).alias("__day"), F.col(f"{value}_next_day").alias("prediction"))
    ahead = df.join(said, (F.col(series) == F.col("__series")) & (F.col(day) == F.col("__day"))).drop("__series", "__day")
    return ahead if known is None else known.unionByName(ahead)


def default_catalogue() -> Catalogue:
    book = Catalogue()
    for kind in ("load", "prepare", "features", "split", "subsample", "predict", "evaluate"):
        book.register(f"{kind}_passthrough", sampling.passthrough)
    book.register("load_csv", lambda spark, path: load_table(spark, path))
    book.register("load_parquet", lambda spark, path: spark.read.parquet(path))
    book.register("prepare_codes", encode.category_codes)
    book.register("prepare_mode", encode.impute_mode)
    book.register("prepare_median", encode.impute_median)
    book.register("prepare_credit", credit.prepare)
    book.register("prepare_retail", retail.prepare)
    book.register("features_retail", retail.features)
    book.register("features_panel", panel.panel_features)
    book.register("split_panel", panel_parts)
    book.register("split_train_test", split.train_test)
    book.register("split_train_val_test", split.train_val_test)
    book.register("subsample_keys", sampling.keep_share_of_keys)
    book.register("predict_model", models.predict)
    book.register("predict_recursive", predict_recursive)
    book.register("predict_zeros", lambda model, df: models.predict_zero(df))
    book.register("evaluate_regression", metrics.regression_metrics)
    book.register("evaluate_classification", metrics.classification_metrics)
    return book


def run(spark: SparkSession, config: Mapping, catalogue: Catalogue | None = None,
        data: DataFrame | None = None) -> DataFrame:
    """Run one analysis and return its scores, rows (score, value).

    Keys of ``config``: ``load`` and ``path`` (or pass ``data``); ``stages``: list of (name,
    keyword arguments) applied in turn; ``split``: (name, keyword arguments); ``key``;
    ``subsample``: (name, keyword arguments) for the training rows; ``model`` (None: no fit),
    ``features``, ``categorical`` (those that are codes); ``label``; ``transformers``; ``hparams``; ``folds`` (``stratify``: the label they keep the
    shares of), ``draws``, ``search_rate``, ``search_key``; ``reload``: path of a saved model that replaces search
    and fit; ``predict``: a name or (name, keyword arguments); ``evaluate``: (name, keyword arguments);
    ``kind``: regression or classification where no model says it; ``seed``; ``output`` folder; ``run_id``;
    ``save_features``: keep the rows after the stages in the feature store of ``output``; ``reload_features``: path of such a
    store, which takes the place of load and stages.

    A search needs folds or validation rows.
    """
    book = catalogue or default_catalogue()

    def named(entry):
        """The function and the keyword arguments of a name or a (name, arguments) pair."""
        name, options = (entry, {}) if isinstance(entry, str) else entry
        found = book.get(name)
        if found is None:
            raise ValueError(f"no stage {name}")
        return found, options

    seed = config.get("seed", 0)
    if "reload_features" in config:
        df = load_features(spark, config["reload_features"], day=config.get("day", "d"))
    else:
        df = data if data is not None else named(config["load"])[0](spark, config["path"])
        for entry in config.get("stages", []):
            function, options = named(entry)
            df = function(df, **options)
    if config.get("save_features"):
        store = f"{config['output']}/features/{config.get('run_id', 'run')}"
        save_features(df, store, day=config.get("day", "d"))
        df = load_features(spark, store, day=config.get("day", "d"))
    function, options = named(config.get("split", "split_train_test"))
    df = stage(function(df, config.get("key"), seed=seed, **options), "split")
    train = df.filter(F.col("split") == "train")
    if "subsample" in config:
        function, options = named(config["subsample"])
        train = stage(function(train, **options), "subsample")

    spec, model, results = None, None, None
    if config.get("model") is not None:
        spec = models.ModelSpec(config["model"], config["features"], config["label"],
                                config.get("transformers", ()), config.get("hparams", {}), seed, config.get("categorical", ()))
    if "reload" in config:
        model = load_model(config["reload"])
    elif spec is not None:
        if any(isinstance(v, str) for v in spec.hparams.values()):
            spec, results = _searched(config, spec, df, train, seed)
        model = spec.fit(train)
    function, options = named(config.get("predict", "predict_model"))
    scored = function(model, df, **options)
    kind = config.get("kind", spec.kind if spec is not None else "regression")
    default = "evaluate_classification" if kind == "classification" else "evaluate_regression"
    function, options = named(config.get("evaluate", default))
    table = function(scored, config["label"], "prediction", ["split"], **options)
    known = ["accuracy", "precision", "recall", "f1", "roc_auc"] if kind == "classification" else metrics.REGRESSION
    scores = stage(metrics.score_table(table, "split", [c for c in known if c in table.columns]), "scores")

    output = config.get("output")
    if output:
        run_id = config.get("run_id", "run")
        if model is not None and "reload" not in config:
            save_model(model, f"{output}/models/{run_id}")
        save_scores(scores, f"{output}/scores/{run_id}")
        if results is not None:
            save_scores(results, f"{output}/search/{run_id}")
        # A handful of scores, one per metric and split.
        pairs = [(r["score"], r["value"]) for r in scores.collect()]
        append_run(spark, f"{output}/runs", run_id, {k: v for k, v in config.items()}, pairs,
                   df.count())
    return scores


def _searched(config: Mapping, spec: models.ModelSpec, df: DataFrame, train: DataFrame, seed: int):
    """The spec with the best parameters found, and the results of the search."""
    predefined = "folds" not in config
    if predefined:
        val = df.filter(F.col("split") == "val")
        if val.isEmpty():
            raise ValueError("a search needs folds or a split with validation rows")
        rows = split.predefined_split(train, val)
    elif "stratify" in config:
        rows = split.stratified_k_fold(train, config["key"], config["stratify"], config["folds"], seed)
    else:
        rows = split.k_fold(train, config["key"], config["folds"], seed)
    rate = config.get("search_rate", 1.0)
    if rate < 1.0:
        rows = sampling.keep_share_of_keys(rows, config["search_key"], rate, seed)
    results, best = models.random_search(rows, spec, config.get("draws", 5), "fold", predefined, seed)
    return spec.with_params(best), results
