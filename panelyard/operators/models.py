"""MLlib models behind one interface: transformers, model, random search, batch predict."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import SparkContext, keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC
from pyspark.ml.feature import (
    ElementwiseProduct,
    MinMaxScaler,
    StandardScaler,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.operators import bootstrap, linear_search
from panelyard.operators.encode import random_fourier
from panelyard.operators.metrics import classification_metrics
from panelyard.plans import stage


class Ridge(Estimator):
    """Ridge regression with penalty ``alpha * |w|^2`` on the sum of squares (L2).

    MLlib penalizes the mean loss of a label scaled to unit variance, so the penalty is
    alpha * std(y) / n there.
    """

    def __init__(self, alpha: float = 1.0, featuresCol="features", labelCol="label", fitIntercept=True):
        super().__init__()
        self.alpha, self.features, self.label, self.intercept = alpha, featuresCol, labelCol, fitIntercept

    def _fit(self, dataset: DataFrame):
        std, n = dataset.agg(F.stddev_pop(self.label), F.count(self.label)).first()
        return LinearRegression(
            featuresCol=self.features, labelCol=self.label, solver="normal", elasticNetParam=0.0,
            standardization=False, regParam=self.alpha * (std or 0.0) / max(n, 1), fitIntercept=self.intercept).fit(dataset)


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable,
                      DefaultParamsWritable):
    """Random Fourier features of a vector column."""

    n_components = Param(Params._dummy(), "n_components", "", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, n_components=100, gamma=1.0, seed=0):
        super().__init__()
        self._setDefault(n_components=100, gamma=1.0, seed=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        m, gamma, seed = (self.getOrDefault(p) for p in (self.n_components, self.gamma, self.seed))

        return random_fourier(dataset, self.getInputCol(), m, gamma, seed, self.getOutputCol())


class Categories(Transformer, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Codes as nominal columns, which tree models split by subsets: column i has the codes below ``sizes[i]``.

    Missing, negative and larger codes share one more value, so rows with values that the fit has not seen can be scored.
    """

    sizes = Param(Params._dummy(), "sizes", "", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, sizes=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for c, name, size in zip(self.getInputCols(), self.getOutputCols(), self.getOrDefault(self.sizes)):
            code = F.when((F.col(c) >= 0) & (F.col(c) < size), F.col(c)).otherwise(F.lit(size)).cast("double")
            dataset = dataset.withColumn(name, code).withMetadata(
                name, {"ml_attr": {"type": "nominal", "name": name, "num_vals": size + 1}})
        return dataset


# --- model catalogue ---------------------------------------------------------------------------
# Parameter names follow the usual ones of the single-machine models; each factory maps those it can honour
# and refuses the others.

#: MLlib grows no deeper trees.
DEEPEST = 30


class _Params(dict):
    """Hyper-parameters of one step; ``done`` raises for those that nobody took."""

    def __init__(self, step: str, given: Mapping[str, object]):
        super().__init__(given)
        self.step = step

    def take(self, name: str, default, kind=float):
        value = self.pop(name, default)
        return None if value is None else kind(value)

    def depth(self, name: str, default: int | None) -> int:
        """A depth; None (or -1) is the deepest that there is."""
        depth = self.take(name, default, int)
        if depth is None or depth == -1:
            return DEEPEST
        if not 0 <= depth <= DEEPEST:
            raise ValueError(f"{self.step}: {name} must be between 0 and {DEEPEST}")
        return depth

    def done(self, stages: list) -> list:
        if left := sorted(self):
            raise ValueError(f"{self.step} has no parameters {left}")
        return stages


def _linear(label, p, context):
    return [LinearRegression(labelCol=label, solver="normal", fitIntercept=p.take("fit_intercept", True, bool))]


def _ridge(label, p, context):
    return [Ridge(p.take("alpha", 1.0), labelCol=label, fitIntercept=p.take("fit_intercept", True, bool))]


def _svc(label, p, context):
    """Kernel classifier: Fourier features for the RBF kernel, then a linear margin. C scales the
    summed hinge loss, so the penalty per row is 1 / (C n). Without ``gamma`` it is 1 / (features x variance)."""
    gamma = p.take("gamma", None)
    fourier = FourierFeatures(inputCol="features", outputCol="__rff", n_components=p.take("n_components", 100, int),
                              gamma=context["gamma"] if gamma is None else gamma, seed=p.take("seed", 0, int))
    return [fourier, LinearSVC(featuresCol="__rff", labelCol=label, standardization=False, maxIter=p.take("max_iter", 100, int),
                               tol=p.take("tol", 1e-6), regParam=1.0 / (p.take("C", 1.0) * context["n_rows"]))]


def _forest(label, p, context):
    """A forest, or one tree of it where its rows are drawn already (``ModelSpec.grow_from_draws``)."""
    sampling = {"numTrees": p.take("n_estimators", 100, int), "subsamplingRate": p.take("max_samples", 1.0),
                "bootstrap": p.take("bootstrap", True, bool)}
    subset, seed = p.take("max_features", "all", str), p.take("seed", 0, int)
    if context["tree"] is not None:
        if subset == "auto" and sampling["numTrees"] > 1:  # what it means in a forest
            subset = "onethird"
        sampling, seed = {"numTrees": 1, "subsamplingRate": 1.0, "bootstrap": False}, seed + context["tree"]
    return [RandomForestRegressor(
        labelCol=label, maxDepth=p.depth("max_depth", None), featureSubsetStrategy=subset, **sampling,
        minInfoGain=p.take("min_impurity_decrease", 0.0), maxBins=max(p.take("max_bins", 32, int), context["categories"]),
        **_leaf_rows(p, "min_samples_leaf", 1, context), seed=seed)]


def _forest_of(forest: RandomForestRegressor, grown: Sequence[RandomForestRegressionModel]) -> RandomForestRegressionModel:
    """Forests of one tree each as the one that ``forest`` describes, an MLlib model like any other."""
    one = grown[0]._java_obj
    jvm, gateway = SparkContext._active_spark_context._jvm, SparkContext._active_spark_context._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(grown))
    for i, model in enumerate(grown):
        trees[i] = model._java_obj.trees()[0]
    model = forest._copyValues(RandomForestRegressionModel(
        jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(forest.uid, trees, one.numFeatures())))
    model._transfer_params_to_java()
    return model


def _leaf_rows(p, name, default, context):
    """The least number of rows in a leaf, where a row of the table may stand for many (``ModelSpec.as_cells``)."""
    least = p.take(name, default, int)
    if context["weighted"] is None:
        return {"minInstancesPerNode": least}
    return {"weightCol": ROWS, "minWeightFractionPerNode": max(0.0, least - 0.5) / context["weighted"]}


def _leaves_to_depth(leaves: int) -> int:
    return max(1, min(DEEPEST, round(math.log2(max(leaves, 2)))))


def _boosting(label, p, context):
    leaves = _leaves_to_depth(p.take("max_leaf_nodes", 31, int))
    return [GBTRegressor(
        labelCol=label, maxIter=p.take("max_iter", 100, int), stepSize=p.take("learning_rate", 0.1),
        maxBins=max(p.take("max_bins", 256, int), context["categories"]), maxDepth=min(leaves, p.depth("max_depth", None)),
        **_leaf_rows(p, "min_samples_leaf", 20, context), seed=p.take("seed", 0, int))]


def _light(classifier, label, p, context):
    """A column of categories needs as many bins as it has values; other columns have ``max_bin`` of them."""
    leaves = _leaves_to_depth(p.take("num_leaves", 31, int))
    model = GBTClassifier if classifier else GBTRegressor
    return [model(
        labelCol=label, maxIter=p.take("n_estimators", 100, int), stepSize=p.take("learning_rate", 0.1),
        maxBins=max(p.take("max_bin", 255, int), context["categories"]), maxDepth=min(leaves, p.depth("max_depth", None)),
        subsamplingRate=p.take("subsample", 1.0), featureSubsetStrategy=p.take("colsample_bytree", "all", str),
        minInfoGain=p.take("min_split_gain", 0.0), **_leaf_rows(p, "min_child_samples", 20, context),
        seed=p.take("seed", 0, int))]


def _scaled_linear(label, p, context):
    """Every feature times ``custom_parameter``, then a linear fit."""
    product = ElementwiseProduct(scalingVec=Vectors.dense([p.take("custom_parameter", 1.0)] * context["width"]),
                                 inputCol="features", outputCol="__product")
    return [product, LinearRegression(featuresCol="__product", labelCol=label, solver="normal")]


MODELS = {
    "linear_regression": (_linear, "regression"),
    "ridge": (_ridge, "regression"),
    "svc": (_svc, "classification"),
    "random_forest": (_forest, "regression"),
    "hist_boosting": (_boosting, "regression"),
    "light_boosting_regressor": (lambda *a: _light(False, *a), "regression"),
    "light_boosting_classifier": (lambda *a: _light(True, *a), "classification"),
    "scaled_linear": (_scaled_linear, "regression"),
}
#: Models of squared loss that use all rows in every tree, with the names of their least rows in a leaf.
WHOLE_TREES = {"hist_boosting": ("min_samples_leaf", 20), "light_boosting_regressor": ("min_child_samples", 20)}
#: Rows of Fourier features in one task of a kernel fit, about.
WIDENED = 1 << 16
#: Rows that a cell stands for, and how many they must be on average.
ROWS, LEAST_CELL = "__rows", 4
#: The number of the tree that drew a row, and trees of a forest that grow at a time.
TREE, AT_A_TIME = "__tree", 8
TREES = ("random_forest", "hist_boosting", "light_boosting_regressor", "light_boosting_classifier")
#: Models without a random choice, which take no seed.
UNSEEDED = ("linear_regression", "ridge", "scaled_linear", "standard_scaler", "min_max_scaler")


def _standard(src, dst, p):
    return StandardScaler(inputCol=src, outputCol=dst, withMean=p.take("with_mean", True, bool), withStd=p.take("with_std", True, bool))


def _min_max(src, dst, p):
    return MinMaxScaler(inputCol=src, outputCol=dst)


def _rbf(src, dst, p):
    return FourierFeatures(inputCol=src, outputCol=dst, n_components=p.take("n_components", 100, int),
                           gamma=p.take("gamma", 1.0), seed=p.take("seed", 0, int))


TRANSFORMERS = {"standard_scaler": _standard, "min_max_scaler": _min_max, "rbf_sampler": _rbf}


@dataclass
class ModelSpec:
    """Named transformers and a model with ``step__param`` hyper-parameters.

    ``categorical`` names the features that hold codes (E1); only tree models take them. A parameter that a step cannot
    honour raises.
    """

    model: str
    features: Sequence[str]
    label: str
    transformers: Sequence[str] = ()
    hparams: Mapping[str, object] = field(default_factory=dict)
    seed: int | None = None
    categorical: Sequence[str] = ()

    def __post_init__(self):
        if self.categorical and (self.model not in TREES or self.transformers):
            raise ValueError("categories are for tree models without transformers")
        if missing := set(self.categorical) - set(self.features):
            raise ValueError(f"categories that are no features: {sorted(missing)}")
        steps = {self.model, *self.transformers}
        if strange := sorted(k for k in self.hparams if k.split("__", 1)[0] not in steps):
            raise ValueError(f"no step has the parameters {strange}")

    @property
    def kind(self) -> str:
        return MODELS[self.model][1]

    def params_of(self, step: str) -> _Params:
        out = {k.split("__", 1)[1]: v for k, v in self.hparams.items()
               if k.split("__", 1)[0] == step and not (isinstance(v, str) and _DISTRIBUTION.match(v))}
        if self.seed is not None and step not in UNSEEDED:
            out.setdefault("seed", self.seed)
        return _Params(step, out)

    def with_params(self, params: Mapping[str, object]) -> ModelSpec:
        return replace(self, hparams={**self.hparams, **params})

    def build(self, n_rows: int | None = None, variance: float | None = None, sizes: Sequence[int] = (),
              weighted: int | None = None, tree: int | None = None) -> Pipeline:
        """The unfitted pipeline. Kernel models need the number of rows and the variance of their features, categories
        the number of their codes, cells the number of rows they stand for (``weighted``); ``fit`` finds them. With ``tree``
        it is the one of this number in a forest."""
        names = list(self.transformers)
        columns = ["__raw", *[f"__{n}" for n in names[:-1]], "features"] if names else ["features"]
        stages = []
        for i, name in enumerate(names):
            p = self.params_of(name)
            stages += p.done([TRANSFORMERS[name](columns[i], columns[i + 1], p)])
        width = len(self.features)
        if "rbf_sampler" in names:
            width = self.params_of("rbf_sampler").take("n_components", 100, int)
        inputs = [f"__category_{c}" if c in self.categorical else c for c in self.features]
        first = [VectorAssembler(inputCols=inputs, outputCol=columns[0], handleInvalid="keep" if self.model in TREES else "error")]
        if self.categorical:
            first.insert(0, Categories(inputCols=list(self.categorical), sizes=list(sizes),
                                       outputCols=[f"__category_{c}" for c in self.categorical]))
        context = {"width": width, "n_rows": n_rows or 1, "gamma": 1.0 / (width * variance) if variance else 1.0,
                   "categories": max(sizes, default=0) + 1, "weighted": weighted, "tree": tree}
        p = self.params_of(self.model)
        return Pipeline(stages=[*first, *stages, *p.done(MODELS[self.model][0](self.label, p, context))])

    def kernel_statistics(self, df: DataFrame) -> tuple[int, float | None]:
        """Number of rows, and variance of all values of the features as the model sees them (None: there is none)."""
        before = Pipeline(stages=self.build().getStages()[:-2])
        rows = df.select(*self.features)
        if rows.isEmpty():
            return 0, None
        seen = before.fit(rows).transform(rows)
        stats = seen.select(Summarizer.metrics("count", "mean", "normL2").summary(F.col("features")).alias("s")).select("s.*").first()
        mean = stats["mean"].toArray()
        variance = (stats.normL2.toArray() ** 2).sum() / stats["count"] / len(mean) - mean.mean() ** 2
        return stats["count"], variance if variance > 0 else None

    def as_cells(self, df: DataFrame) -> tuple[DataFrame, int | None]:
        """Rows of equal features as one row with their mean label and their number, staged, and the number of all rows.

        Trees of squared loss split such cells as they split the rows: what the labels vary within a cell is in both sides
        of every comparison. Rows stay as they are (and the number is None) where cells are hardly fewer, where each tree
        draws rows, where transformers count rows, or where no leaf could hold half of them.
        """
        if self.model not in WHOLE_TREES or self.transformers or float(self.params_of(self.model).get("subsample", 1.0)) < 1:
            return df, None
        name, default = WHOLE_TREES[self.model]
        about, rows = self.about_cells(df)
        if about * LEAST_CELL > rows or 2 * int(self.params_of(self.model).get(name, default)) >= rows:
            return df, None
        known = F.count(self.label) == F.count("*")  # a missing label is an error, as it is in a row
        cells = df.groupBy(*self.features).agg(F.when(known, F.avg(self.label)).alias(self.label), F.count("*").cast("double").alias(ROWS))
        return stage(cells, "cells"), rows

    def about_cells(self, df: DataFrame) -> tuple[int, int]:
        """About how many different features there are, and the number of rows."""
        return tuple(df.agg(F.approx_count_distinct(F.xxhash64(*self.features)), F.count("*")).first())

    def draws(self, df: DataFrame) -> tuple[DataFrame, list[int]] | None:
        """The rows that each tree of a forest draws, as cells of equal features (``bootstrap_cells``), and the number of draws of
        each tree. A split of the cells is a split of the drawn rows, as in ``as_cells``.

        None where features are vectors, where each tree takes rows without drawing them, where cells are hardly fewer than rows or more than a task can
        hold for all trees, and where no leaf could hold half of the rows; such forests draw their rows in MLlib.
        """
        if self.model != "random_forest" or self.transformers:
            return None
        if any(isinstance(f.dataType, VectorUDT) for f in df.select(*self.features).schema):
            return None
        forest = self.build().getStages()[-1]
        if not forest.getBootstrap():
            return None
        about, rows = self.about_cells(df)
        trees = forest.getNumTrees()
        if about * LEAST_CELL > rows or 2 * trees * about > bootstrap.HELD or 2 * forest.getMinInstancesPerNode() >= rows:
            return None
        drawn = bootstrap.bootstrap_cells(df, self.features, self.label, ROWS, trees, forest.getSubsamplingRate(), forest.getSeed(), TREE)
        counts = {r[0]: int(r[1]) for r in drawn.groupBy(TREE).agg(F.sum(ROWS)).collect()}  # a row per tree
        return (drawn, [counts[i] for i in range(trees)]) if len(counts) == trees else None

    def grow_from_draws(self, drawn: DataFrame, counts: Sequence[int], sizes: Sequence[int]) -> PipelineModel:
        """A forest whose trees are fitted one by one, a few at a time, each on its own draws."""

        def grow(i: int) -> PipelineModel:
            return self.build(sizes=sizes, weighted=counts[i], tree=i).fit(drawn.filter(F.col(TREE) == i))

        with ThreadPoolExecutor(max_workers=AT_A_TIME) as pool:
            grown = list(pool.map(grow, range(len(counts))))
        forest = self.build(sizes=sizes).getStages()[-1]
        return PipelineModel([*grown[0].stages[:-1], _forest_of(forest, [model.stages[-1] for model in grown])])

    def dealt(self, df: DataFrame, rows: int) -> DataFrame:
        """The columns of the fit, dealt out so that no task holds more than ``WIDENED`` rows, whatever files they come from:
        a few columns become many components, and every step of the fit reads these."""
        parts = -(-rows // WIDENED)
        return df if parts <= 1 else df.select(*self.features, self.label).repartition(parts)

    def fit(self, df: DataFrame) -> PipelineModel:
        if self.model == "svc":
            rows, variance = self.kernel_statistics(df)
            return self.build(rows, variance).fit(self.dealt(df, rows))
        found = self.draws(df)
        df, weighted = self.as_cells(df)
        sizes = ()
        if self.categorical:
            last = df.agg(*[F.max(c).alias(c) for c in self.categorical]).first()
            sizes = [max(0, int(-1 if v is None else v) + 1) for v in last]
        if found:
            return self.grow_from_draws(*found, sizes)
        return self.build(sizes=sizes, weighted=weighted).fit(df)


def predict(model, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Batch prediction (L10); the rows of every split go through one transform."""
    out = model.transform(df)
    return out.select(*(keep if keep is not None else df.columns), "prediction")


def predict_zero(df: DataFrame) -> DataFrame:
    """Zero baseline."""
    return df.withColumn("prediction", F.lit(0.0))


# --- random search -----------------------------------------------------------------------------

_NUMBER = r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"
_DISTRIBUTION = re.compile(rf"^(uniform|loguniform|randint)\(({_NUMBER}),\s*({_NUMBER})\)$")


def parse_distribution(text: str):
    """``randint(a, b)``: integers a..b-1; ``uniform(a, b)``: from a to a + b;
    ``loguniform(a, b)``: log-uniform from a to b."""
    found = _DISTRIBUTION.match(text)
    if not found:
        raise ValueError(f"not a distribution: {text}")
    name, a, b = found.group(1), float(found.group(2)), float(found.group(3))
    if name == "randint":
        return lambda rng: int(rng.integers(int(a), int(b)))
    if name == "uniform":
        return lambda rng: float(rng.uniform(a, a + b))
    return lambda rng: float(math.exp(rng.uniform(math.log(a), math.log(b))))


def model_score(predictions: DataFrame, label: str, kind: str) -> float:
    """R2 of a regression, accuracy of a classification."""
    if kind == "classification":
        return float(classification_metrics(predictions, label, "prediction").first()["accuracy"])
    mse, var = predictions.agg(
        F.avg((F.col(label) - F.col("prediction")) ** 2), F.var_pop(label)).first()
    return 1.0 - mse / var if var else 0.0


def draw_params(hparams: Mapping[str, object], n_draws: int, seed: int) -> list[dict]:
    """``n_draws`` values for each parameter that is given as the text of a distribution, in the order of their names."""
    dists = {k: parse_distribution(v) for k, v in sorted(hparams.items()) if isinstance(v, str) and _DISTRIBUTION.match(v)}
    rng = np.random.default_rng(seed)
    return [{k: draw(rng) for k, draw in dists.items()} for _ in range(n_draws)]


def _scores_by_fits(rows: DataFrame, spec: ModelSpec, draws: list[dict], folds: list, fold_col: str, parallelism: int) -> list:
    """(draw, fold, training score, validation score) by one fit for each."""

    def run(task):
        i, fold = task
        held = rows.filter(F.col(fold_col) == fold)
        rest = rows.filter(F.col(fold_col) != fold)
        model = spec.with_params(draws[i]).fit(rest)
        return i, fold, *[model_score(predict(model, part, [spec.label]), spec.label, spec.kind)
                          for part in (rest, held)]

    tasks = [(i, fold) for i in range(len(draws)) for fold in folds]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(run, tasks))


def random_search(df: DataFrame, spec: ModelSpec, n_draws: int = 5, fold_col: str = "fold",
                  predefined: bool = False, seed: int = 0, parallelism: int = 4):
    """Random search over the ``step__param`` distributions given as text in the spec.

    ``predefined`` means one split: fold 0 trains, fold 1 validates; otherwise every fold is
    held out once. Returns (results frame, best parameters). Linear models on features as they are or scaled need one scan of
    the rows, whatever the number of draws and folds (``linear_search``); others are fitted once for each, as independent Spark
    jobs started from a few driver threads.
    """
    draws = draw_params(spec.hparams, n_draws, seed)
    rows = stage(df.select(*spec.features, spec.label, fold_col), "search")
    present = sorted(r[0] for r in rows.select(fold_col).distinct().collect())
    folds = [1] if predefined else present
    if not set(folds) <= set(present) or len(present) < 2:
        raise ValueError("a search needs rows to train on and rows to validate on")
    if linear_search.serves(spec.model, spec.transformers):
        found = linear_search.fold_moments(rows, spec.features, spec.label, fold_col)
        scores = [(i, fold, *linear_search.scores(found, spec.with_params(params), fold)) for i, params in enumerate(draws) for fold in folds]
    else:
        scores = _scores_by_fits(rows, spec, draws, folds, fold_col, parallelism)
    table = []
    for i, params in enumerate(draws):
        train = [s[2] for s in scores if s[0] == i]
        val = [s[3] for s in scores if s[0] == i]
        table.append([i, str(params), train, val, np.mean(train), np.std(train), np.mean(val),
                      np.std(val)])
    means = sorted((row[6] for row in table), reverse=True)
    out = [(i, params, [round(float(v), 4) for v in train], [round(float(v), 4) for v in val],
            *[round(float(v), 4) for v in rest], means.index(rest[2]) + 1)
           for i, params, train, val, *rest in table]
    best = draws[max(range(n_draws), key=lambda i: table[i][6])]
    frame = df.sparkSession.createDataFrame(
        out, "draw int, params string, train_scores array<double>, val_scores array<double>, "
             "mean_train_score double, std_train_score double, mean_val_score double, "
             "std_val_score double, rank int")
    return frame, best
