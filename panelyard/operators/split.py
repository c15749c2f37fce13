"""Train / validation / test splits and folds as columns of the frame.

Random splits are cuts in md5 order (``plans.hashing``): two counting passes, then a projection.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.plans import (
    hash_cut,
    hash_key,
    stage,
    with_global_index,
    with_row,
    with_running_total,
)


def _labelled(h: Column, cuts: Sequence[str], labels: Sequence) -> Column:
    """Label of the first cut the hash does not exceed; the last label beyond all cuts."""
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels))):
        out = F.when(h <= F.lit(cut), F.lit(label)).otherwise(out)
    return out


def train_test(df: DataFrame, key, train_prc=80.0, test_prc=20.0, seed=0) -> DataFrame:
    """Adds ``split``: floor(train * N) random rows 'train', the rest 'test' (T1)."""
    if train_prc + test_prc != 100:
        raise ValueError("percentages must sum to 100")
    hashed = df.withColumn("__h", hash_key(key, seed))
    cuts = hash_cut(hashed, "__h", lambda n: [math.floor(train_prc / 100 * n)])
    return hashed.withColumn("split", _labelled(F.col("__h"), cuts, ["train", "test"])).drop("__h")


def train_val_test(df: DataFrame, key, train_prc=70.0, val_prc=15.0, test_prc=15.0,
                   seed=0) -> DataFrame:
    """Adds ``split`` with three labels (T2): the train count is rounded down, the test share of
    the remainder is rounded up."""
    if train_prc + val_prc + test_prc != 100:
        raise ValueError("percentages must sum to 100")
    share = (test_prc / 100) / (test_prc / 100 + val_prc / 100) if train_prc < 100 else 0

    def ends(n: int) -> list[int]:
        n_train = math.floor(train_prc / 100 * n)
        return [n_train, n - math.ceil(share * (n - n_train))]

    hashed = df.withColumn("__h", hash_key(key, seed))
    cuts = hash_cut(hashed, "__h", ends)
    labels = ["train", "val", "test"]
    return hashed.withColumn("split", _labelled(F.col("__h"), cuts, labels)).drop("__h")


def fold_ends(n: int, k: int) -> list[int]:
    """Last 1-based rank of the folds 0..k-2; the first n mod k folds are one larger."""
    small, larger = divmod(n, k)
    return [small * (i + 1) + min(i + 1, larger) for i in range(k - 1)]


def k_fold(df: DataFrame, key, k: int, seed=0) -> DataFrame:
    """Adds ``fold`` 0..k-1."""
    hashed = df.withColumn("__h", hash_key(key, seed))
    cuts = hash_cut(hashed, "__h", lambda n: fold_ends(n, k))
    return hashed.withColumn("fold", _labelled(F.col("__h"), cuts, list(range(k)))).drop("__h")


def stratified_k_fold(df: DataFrame, key, label: str, k: int, seed=0) -> DataFrame:
    """Adds ``fold`` with the class shares kept in every fold (T4).

    Labels and hashes are ranked inside their class with distributed running totals, once for all
    classes; the hashes at the ends of the folds (k - 1 per class) are then joined to the rows.
    Equal hashes on both sides of an end raise, as no cut gives the exact sizes.
    """
    hashed = df.withColumn("__h", hash_key(key, seed))
    narrow = hashed.select(F.col(label).alias("__c"), "__h")
    sizes = stage(narrow.groupBy("__c").agg(F.count("*").alias("__n")), "classes")
    ranked = with_running_total(narrow, ["__c"], ["__h"], F.lit(1).cast("bigint"), "__p")
    same = F.col("r.__c").eqNullSafe(F.col("s.__c"))
    sized = ranked.alias("r").join(sizes.alias("s"), same).select("r.__c", "r.__h", "r.__p", "s.__n")
    # Sizes as in ``fold_ends``: the first n mod k folds hold one more row.
    small, larger = F.floor(F.col("__n") / k), F.col("__n") % k
    ends = F.transform(F.sequence(F.lit(1), F.lit(k - 1)) if k > 1 else F.array().cast("array<int>"),
                       lambda i: small * i + F.least(i.cast("bigint"), larger))
    at_end = F.array_contains(ends, F.col("__p"))
    after_end = F.array_contains(ends, F.col("__p") - 1)
    cuts = stage(sized.where(at_end | after_end).groupBy("__c").agg(
        F.array_sort(F.collect_list(F.when(at_end, F.struct("__p", "__h")))).alias("__cuts"),
        F.collect_list(F.when(after_end, F.struct((F.col("__p") - 1).alias("__p"), F.col("__h")))).alias("__next")), "cuts")
    if not cuts.where(F.arrays_overlap("__cuts", "__next")).isEmpty():
        raise ValueError("the keys do not identify rows: equal hashes at the end of a fold; add a column to the key")
    table = cuts.select("__c", F.col("__cuts")["__h"].alias("__cuts"))
    out = hashed.join(table, F.col(label).eqNullSafe(F.col("__c")), "left")
    beyond = F.size(F.filter("__cuts", lambda cut: cut < F.col("__h")))
    return out.withColumn("fold", F.when(F.col("__cuts").isNull(), 0).otherwise(beyond)).drop("__h", "__c", "__cuts")


def panel_split(df: DataFrame, train_end: int, val_end: int, look_back: int,
                day="d") -> dict[str, DataFrame]:
    """Chronological split of a panel (T5). The test features reach ``look_back`` days back, so
    the parts overlap and come as separate frames (filters on the same input)."""
    if look_back is None or look_back < 0:
        raise ValueError("look_back must be given and not negative")
    d = F.col(day)
    return {
        "train": df.filter(d <= train_end),
        "val": df.filter(d.between(train_end + 1, val_end)),
        "test_features": df.filter(d >= val_end + 1 - look_back),
        "test": df.filter(d > val_end),
    }


def chronological_fraction(df: DataFrame, order: Sequence[str], share=0.7) -> DataFrame:
    """Adds ``split``: the first int(share * N) rows 'train', the rest 'val' (T6).

    ``order`` must be a total order without nulls. Only its columns are sorted, to find the last
    training row; the split itself is a comparison with that row.
    """
    indexed = with_global_index(df.select(*order), order, "__idx")
    cut = int(share * df.count())
    last = indexed.filter(F.col("__idx") == cut - 1)
    out = with_row(df, last.select(*[F.col(c).alias(f"__last_{c}") for c in order]))
    edge = F.struct(*[F.col(f"__last_{c}").alias(c) for c in order])
    part = F.when(F.struct(*order) <= edge, "train").otherwise("val")
    return out.select(*df.columns, part.alias("split"))


def predefined_split(train: DataFrame, val: DataFrame) -> DataFrame:
    """One frame with ``fold`` 0 for training rows and 1 for validation rows."""
    return train.withColumn("fold", F.lit(0)).unionByName(val.withColumn("fold", F.lit(1)))
