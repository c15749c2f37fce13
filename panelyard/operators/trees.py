"""Fitted tree ensembles as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelyard.plans.staging import new_path


def tree_expression(model: GBTRegressionModel | RandomForestRegressionModel, features: Sequence[str]) -> Callable[[Mapping[str, Column]], Column]:
    """The prediction of a fitted forest or boosted regression from its features by name; missing features count as 0.

    The trees are read from the model's own table of nodes. A model of this kind can be used wherever an expression can, e.g. folded over the
    days of a forecast. ``features`` are the names behind the places of the feature vector.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = new_path(spark, "trees")
    model.write().overwrite().save(path)
    # As many nodes as the model has, which the driver holds anyway.
    nodes = {(r.treeID, r.id): r for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()}
    weights = model.treeWeights if isinstance(model, GBTRegressionModel) else [1.0 / len(model.trees)] * len(model.trees)

    def value_of(tree: int, node: int, row: Mapping[str, Column]) -> Column:
        here = nodes[tree, node]
        if here.leftChild < 0:
            return F.lit(float(weights[tree] * here.prediction))
        x = row[features[here.split.featureIndex]]
        given = here.split.leftCategoriesOrThreshold
        goes_left = x <= F.lit(given[0]) if here.split.numCategories < 0 else x.isin([float(v) for v in given])
        return F.when(goes_left, value_of(tree, here.leftChild, row)).otherwise(value_of(tree, here.rightChild, row))

    def predict(row: Mapping[str, Column]) -> Column:
        # The features are computed once and bound by a one-element transform; the nodes only read them.
        known = F.array(F.struct(*[F.coalesce(row[name].cast("double"), F.lit(0.0)).alias(name) for name in features]))
        trees = lambda f: F.array(*[value_of(tree, 0, {name: f[name] for name in features}) for tree in range(len(weights))])
        return F.transform(known, lambda f: F.aggregate(trees(f), F.lit(0.0), lambda total, v: total + v))[0]

    return predict
