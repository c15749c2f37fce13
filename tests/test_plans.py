import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard import plans
from panelyard.plans.hashing import _nth
from panelyard.plans.staging import shared_dir


def skewed(spark, n=3000):
    """A third of all rows share one key; half of its values are equal."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.integers(0, 40)}"
        value = 5.0 if i % 6 == 0 else float(rng.normal())
        rows.append((i, key, value))
    return spark.createDataFrame(rows, "i int, k string, v double").repartition(7)


def test_global_index_is_the_sorted_position(spark):
    df = skewed(spark)
    out = plans.with_global_index(df, ["v", "i"]).collect()
    want = {r["i"]: p for p, r in enumerate(sorted(df.collect(), key=lambda r: (r["v"], r["i"])))}
    assert {r["i"]: r["idx"] for r in out} == want


def test_running_total_inside_hot_groups(spark):
    df = skewed(spark)
    out = plans.with_running_total(df, ["k"], ["v", "i"], F.col("i"), "s").toPandas()
    out = out.sort_values(["k", "v", "i"])
    assert (out.groupby("k")["i"].cumsum() == out["s"]).all()


def test_running_total_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    out = plans.with_running_total(df, ["k"], ["v"], F.lit(1), "n").collect()
    assert sorted((str(r["k"]), r["v"], r["n"]) for r in out) == [("None", 1, 1), ("None", 2, 2), ("a", 3, 1)]


def test_series_position(spark):
    out = plans.with_series_position(skewed(spark), ["k"], ["i"]).toPandas().sort_values(["k", "i"])
    assert (out.groupby("k").cumcount() == out["pos"]).all()


def test_quantiles_match_numpy(spark):
    df = skewed(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    out = plans.exact_quantiles(df, ["v"], probs, ["k"]).collect()
    pdf = df.toPandas()
    assert len(out) == pdf["k"].nunique()
    for row in out:
        want = np.quantile(pdf.loc[pdf["k"] == row["k"], "v"], probs)
        np.testing.assert_allclose(row["q"], want, rtol=1e-12, atol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), (None, float("inf")), (None, float("inf"))], "k string, v double")
    got = {r.k: r.q for r in plans.exact_quantiles(df, ["v"], [0.5, 0.9], ["k"]).collect()}
    assert got == {"a": [None, None], "b": [2.0, 2.0], None: [float("inf")] * 2}
    empty = df.limit(0)
    assert plans.exact_quantiles(empty, ["v"], [0.5], ["k"]).count() == 0
    assert [tuple(r) for r in plans.exact_quantiles(empty, ["v"], [0.5]).collect()] == [("v", [None])]


def interpolated(values, probs):
    x = np.sort(np.asarray(values))
    place = np.asarray(probs) * (len(x) - 1)
    lo, hi = x[np.floor(place).astype(int)], x[np.ceil(place).astype(int)]
    part = place - np.floor(place)
    return [a if a == b else (1 - p) * a + p * b for a, b, p in zip(lo, hi, part)]


def test_quantiles_by_selection(spark, monkeypatch):
    """Brackets of large groups: ties, infinities, NaN, tiny groups beside large ones; a sketch that is worse than it says."""
    rng = np.random.default_rng(4)
    parts = {"big": rng.normal(size=60_000), "ties": rng.integers(0, 5, 30_000).astype(float), "odd": np.r_[rng.normal(size=9000), [np.inf] * 50],
             "one": np.array([3.0]), "two": np.array([1.0, 2.0])}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v, "w": v[::-1] ** 2}) for k, v in parts.items()])
    df = spark.createDataFrame(pdf).repartition(7)
    probs = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    for reach in (2.5, 1e-6):
        monkeypatch.setattr("panelyard.plans.quantiles.REACH", reach)
        for r in plans.exact_quantiles(df, ["v", "w"], probs, ["k"]).collect():
            np.testing.assert_allclose(r.q, interpolated(pdf.loc[pdf.k == r.k, r.column], probs), rtol=1e-12)
        whole = {r.column: r.q for r in plans.exact_quantiles(df, ["v", "w"], probs).collect()}
        np.testing.assert_allclose(whole["v"], interpolated(pdf.v, probs), rtol=1e-12)
    nan = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("v"))
    got = plans.exact_quantiles(nan, ["v"], [0.5, 0.9]).first().q
    want = np.sort([i for i in range(20_000) if i % 4])
    assert got[0] == pytest.approx((want[9999] + want[10000]) / 2, abs=0.5) and np.isnan(got[1])


def test_quantiles_do_not_sort_the_values(spark):
    df = spark.range(50_000).select(F.rand(3).alias("v"))
    found = plans.quantiles._selected(df.select(F.col("v").alias("__c0")), ["v"], [0.5], [], 1000, 0.0025)
    assert "rangepartitioning" not in found._jdf.queryExecution().toString()


def test_hash_cuts_match_a_full_sort(spark):
    n = 5000
    df = spark.range(n).select(plans.hash_key("id", 9).alias("h"))
    hashes = sorted(hashlib.md5(f"{i}|9".encode()).hexdigest() for i in range(n))
    ranks = [0, 1, 17, 2500, n]
    assert plans.hash_cut(df, "h", ranks) == ["", *[hashes[r - 1] for r in ranks[1:]]]


def test_hash_cut_narrows_crowded_prefixes(spark, monkeypatch):
    import panelyard.plans.hashing as hashing

    monkeypatch.setattr(hashing, "_DIGITS", 1)
    monkeypatch.setattr(hashing, "_SMALL", 3)
    df = spark.range(2000).select(plans.hash_key("id", 1).alias("h"))
    hashes = sorted(hashlib.md5(f"{i}|1".encode()).hexdigest() for i in range(2000))
    assert _nth(df, "h", lambda _: [1, 999, 2000])[1] == {1: hashes[0], 999: hashes[998], 2000: hashes[1999]}


def test_attach_keeps_every_row(spark):
    df = skewed(spark)
    out = plans.attach(df, df.groupBy("k").agg(F.count("*").alias("n")), ["k"])
    assert out.count() == df.count()
    assert out.filter("k = 'hot'").first()["n"] == 1000


def test_attach_broadcasts_only_small_statistics(spark):
    df = skewed(spark)
    stats = df.groupBy("k").agg(F.count("*").alias("n"))
    small = plans.attach(df, stats, ["k"])._jdf.queryExecution().simpleString()
    assert "BroadcastHashJoin" in small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10)
    try:
        large = plans.attach(df, stats, ["k"])._jdf.queryExecution().simpleString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in large


def test_with_row(spark):
    df = spark.range(5)
    out = plans.with_row(df, df.agg(F.max("id").alias("m"), F.count("*").alias("n")))
    assert {(r["m"], r["n"]) for r in out.collect()} == {(4, 5)}


def test_shared_dir_comes_from_the_session(spark):
    old = spark.conf.get("spark.checkpoint.dir", None)
    if old:
        assert shared_dir(spark).startswith(old)
    else:
        assert shared_dir(spark)
