"""Isolation forest on DataFrames."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panelyard.operators.profile import describe
from panelyard.plans import hash_key, stage

EULER_GAMMA = 0.5772156649015329


def _path_norm(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    value = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def tree_samples(df: DataFrame, key, cols: Sequence[str], trees: int, sample: int,
                 seed: int) -> DataFrame:
    """Rows (tree, *cols): for each tree the ``sample`` rows with the smallest hash of key and tree; all, if there are fewer.

    Hashes above a bound cannot be among them, so a row is only sent to the trees where it may be one; what
    each tree then ranks is little more than its sample.
    """
    hashed = df.select(hash_key(key, seed).alias("__h"), *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(cols)])
    share = (sample + 8 * math.sqrt(sample) + 8) / max(1, df.count())
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("__h", t).alias("at")))
    if share < 1:
        bound = F.lit(int(share * 2.0**64) - (1 << 63))
        draws = F.filter(draws, lambda d: d["at"] < bound)
        # Most rows are in no tree; one plain comparison drops them before the draws are listed.
        first = [F.xxhash64("__h", F.lit(t)) for t in range(trees)]
        hashed = hashed.where((F.least(*first) if trees > 1 else first[0]) < bound)
    names = [f"__c{i}" for i in range(len(cols))]
    dealt = hashed.select("__h", *names, F.explode(draws).alias("__d")).select("__d.tree", "__d.at", "__h", *names)
    least = F.row_number().over(Window.partitionBy("tree").orderBy("at", "__h"))
    chosen = dealt.withColumn("__place", least).where(F.col("__place") <= sample)
    return chosen.select("tree", *[F.col(n).alias(c) for n, c in zip(names, cols)])


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, size, depth); feature -1 marks a leaf."""
    nodes: list[tuple] = []

    def add(part: np.ndarray, depth: int) -> int:
        here = len(nodes)
        nodes.append((-1, 0.0, -1, -1, len(part), depth))
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
        if depth >= limit or len(part) <= 1 or not (high > low).any():
            return here
        feature = int(rng.choice(np.flatnonzero(high > low)))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= cut
        left = add(part[goes_left], depth + 1)
        right = add(part[~goes_left], depth + 1)
        nodes[here] = (feature, cut, left, right, len(part), depth)
        return here

    add(x, 0)
    return nodes


FOREST = "tree int, size int, features binary, cuts binary, lefts binary, rights binary, ends binary"


def fit_forest(df: DataFrame, key, cols: Sequence[str], trees=100, sample=256, seed=0) -> DataFrame:
    """A row for each tree, staged; the trees grow in parallel, from at most ``sample`` rows each.

    ``size`` is the number of rows of the tree; the others list its nodes: feature (-1: a leaf), cut, children and, for a
    leaf, the depth at which a row that ends there would be alone.
    """
    cols = list(cols)
    depth_limit = int(np.ceil(np.log2(max(sample, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf[cols].sort_values(cols).to_numpy()
        nodes = _grow(rows, np.random.default_rng([seed, 1, tree]), depth_limit)
        feature, cut, left, right, size, depth = (np.array(x) for x in zip(*nodes))
        ends = depth + _path_norm(size)
        parts = [feature.astype(np.int32), cut.astype(float), left.astype(np.int32), right.astype(np.int32), ends.astype(float)]
        return pd.DataFrame([(tree, len(pdf), *[p.tobytes() for p in parts])])

    samples = tree_samples(df, key, cols, trees, sample, seed)
    return stage(samples.groupBy("tree").applyInPandas(build, FOREST), "forest")


def _levels(feature, cut, left, right, end) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """A tree as (features, cuts) of each level and the depths below the last one, where the children of place i are 2i and 2i + 1.

    A leaf above the last level is the same leaf on both of its sides.
    """
    here, levels = np.zeros(1, np.int64), []
    while (feature[here] >= 0).any():
        leaf = feature[here] < 0
        levels.append((np.where(leaf, 0, feature[here]).astype(np.int64), np.where(leaf, 0.0, cut[here])))
        here = np.stack([np.where(leaf, here, left[here]), np.where(leaf, here, right[here])], axis=1).ravel()
    return levels, end[here]


def score_forest(df: DataFrame, forest: DataFrame, cols: Sequence[str], name="score") -> DataFrame:
    """Anomaly score 2 ** (-mean path / norm) of every row; the tasks get the trees, whose size is that of their samples."""
    kinds = (np.int32, float, np.int32, np.int32, float)
    rows = sorted(forest.collect(), key=lambda r: r.tree)
    grown = [_levels(*(np.frombuffer(raw, kind) for raw, kind in zip(r[2:], kinds))) for r in rows]
    shared = df.sparkSession.sparkContext.broadcast(
        {"trees": grown, "norm": float(_path_norm(max((r["size"] for r in rows), default=0)))})

    @pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        model = shared.value
        flat, rows = np.concatenate([s.to_numpy(dtype=float) for s in series]), np.arange(len(series[0]))
        total = np.zeros(len(rows))
        for levels, end in model["trees"]:
            at = np.zeros(len(rows), np.int64)
            for feature, cut in levels:
                value = flat.take(feature.take(at) * len(rows) + rows)
                at = 2 * at + ~(value <= cut.take(at))
            total += end.take(at)
        mean = total / max(len(model["trees"]), 1)
        return pd.Series(2.0 ** (-mean / (model["norm"] or 1.0)))

    return df.withColumn(name, score(*[F.col(c).cast("double") for c in cols]))


def isolation_forest(df: DataFrame, key, cols: Sequence[str], trees=100, sample=256,
                     seed=0, partitions: int | None = None) -> DataFrame:
    """Adds ``score`` and ``outlier`` (1 when the score is above 0.5).

    Scoring is bound by the work of the tasks: ``partitions`` deals the rows out first, for tables that few tasks would read.
    """
    rows = df if partitions is None else df.repartition(partitions)
    scored = score_forest(rows, fit_forest(df, key, cols, trees, sample, seed), cols)
    return scored.withColumn("outlier", (F.col("score") > 0.5).cast("int"))


def outlier_profile(flagged: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Describe outliers and the rest apart (A8 by flag)."""
    return describe(flagged, cols, ["outlier"])
