import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard import sources
from panelyard.functions import columns as C
from panelyard.operators import encode, prep, profile, reshape, sampling, split
from panelyard.plans.staging import new_path


def test_narrowing_leaves_head_room(spark):
    df = spark.createDataFrame(
        [(12, 13, 40000, 3 * 10**8, 6550.0, 6551.0, "a", "2024-01-05"),
         (-12, 1, 1, 1, 0.0, 0.0, "a", "not a date"),
         (0, 1, 1, 1, 0.0, 0.0, "a", None)],
        "i8 int, i16 int, i32 int, i64 bigint, h double, f double, c string, date string")
    plan = {r["column_name"]: r["to_type"] for r in prep.narrowing_plan(df).collect()}
    assert plan == {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "h": "float16",
                    "f": "float", "c": "category", "date": "timestamp"}
    out = prep.narrow(df)
    assert dict(out.dtypes)["i8"] == "tinyint" and dict(out.dtypes)["h"] == "float"
    assert [r["date"] for r in out.orderBy(F.col("i8").desc()).collect()][1:] == [None, None]


def test_sizes_are_checked(spark):
    df = spark.createDataFrame([(1, "a", -2.0)], "i int, s string, x double")
    assert prep.pick_columns(df, ["s", "zz"]) == ["s"] and prep.pick_columns(df, ["zz"]) == ["i", "s", "x"]
    with pytest.raises(ValueError):
        prep.require_numeric(df, ["s"])
    with pytest.raises(ValueError):
        prep.require_mask([True], ["i", "s"])
    with pytest.raises(ValueError):
        prep.split_target(df, "zz")


def test_update_join_ignores_null_changes(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b"), (3, 3.0, "c")], "k int, x double, s string")
    new = spark.createDataFrame([(1, 9.0), (2, None), (7, 7.0)], "k int, x double")
    got = sorted(tuple(r) for r in prep.update_join(old, new, ["k"]).collect())
    assert got == [(1, 9.0, "a"), (2, 2.0, "b"), (3, 3.0, "c")]


def test_unmatched_keys_counts_duplicates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert sorted(tuple(r) for r in prep.unmatched_keys(a, b, ["k"]).collect()) == [(1, 1), (3, -1)]


def test_weekday_numbers(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1 + i),) for i in range(7)], "x date")
    assert [r[0] for r in df.orderBy("x").select(C.weekday_number(F.col("x"))).collect()] == list(range(1, 8))


def test_column_names():
    assert C.clean_names(["Unnamed: 0", "Saving accounts", "Risk"]) == ["id", "saving_accounts", "risk"]


def test_melt_and_widen_are_inverse(spark):
    wide = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "id string, d_1 double, d_2 double")
    long = reshape.melt(wide, ["id"], ["d_1", "d_2"]).withColumn("d", C.day_number(F.col("d")))
    back = reshape.widen(long, ["id"], "d", [1, 2], "sold", "d_")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wide.collect()))


def test_mode_takes_the_smallest_tie(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "b"), ("g", "a"), ("g", "a"), ("g", None), ("h", None)],
                               "k string, v string")
    assert [tuple(r) for r in profile.mode_value(df, "v", ["k"]).collect()] == [("g", "a", 2)]
    assert profile.mode_value(df, "v").first()["v_mode"] == "a"


def test_describe_matches_pandas(spark):
    x = np.random.default_rng(1).normal(size=501)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "k": np.arange(501) % 3}))
    got = profile.describe(df, ["x"]).first()
    want = pd.Series(x).describe()
    for a, b in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                 ("q50", "50%"), ("q75", "75%"), ("max", "max")]:
        assert got[a] == pytest.approx(want[b])
    assert profile.describe(df, ["x"], ["k"]).count() == 3


def test_box_statistics_and_fences(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    row = profile.box_statistics(df, ["x"]).first()
    assert (row["q1"], row["median"], row["q3"]) == (2.25, 3.5, 4.75)
    assert (row["whisker_low"], row["whisker_high"], row["n_fliers"]) == (1.0, 5.0, 1)
    assert [r["x"] for r in profile.tukey_outliers(df, "x").collect()] == [100.0]


def test_category_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "i int, c string")
    got = {r["i"]: r["c_code"] for r in encode.category_codes(df, ["c"]).collect()}
    assert got == {1: 1, 2: -1, 3: 0, 4: 1}


def test_codes_of_columns_of_every_kind(spark):
    """One dictionary: numbers sort as numbers, texts as texts; codes past 2**31 fit."""
    rows = [(i, None if i == 5 else (i * 7) % 11, f"v{(i * 3) % 13}", float((i * 5) % 4) - 1.5, i % 2 == 0, 9_007_199_254_740_993 + i % 2)
            for i in range(40)]
    df = spark.createDataFrame(rows, "i int, n int, t string, x double, b boolean, big long").withColumns({
        "day": F.date_add(F.lit("2024-02-27").cast("date"), F.col("i") % 5), "at": F.timestamp_seconds(F.col("i") % 3 * 86400),
        "m": (F.col("i") % 6).cast("decimal(9,2)")})
    cols = ["n", "t", "x", "b", "big", "day", "at", "m"]
    got = encode.category_codes(df, cols).toPandas()
    assert dict(encode.category_codes(df, cols).dtypes)["t_code"] == "bigint"
    pdf = df.toPandas()
    for c in cols:
        values = pdf[c]
        places = {v: i for i, v in enumerate(sorted(values.dropna().unique()))}
        assert [places.get(v, -1) for v in got.sort_values("i")[c]] == got.sort_values("i")[f"{c}_code"].tolist(), c
    far = encode.category_codes(df, ["t"], first=1 << 31).agg(F.min("t_code"), F.max("t_code")).first()
    assert tuple(far) == (1 << 31, (1 << 31) + 12)
    one = encode.category_mapping(df, "n").orderBy("code").collect()
    assert [(r.n, r.code) for r in one] == [(v, i) for i, v in enumerate(sorted({r[1] for r in rows if r[1] is not None}))]
    assert encode.category_codes(df.limit(0), cols).count() == 0


def test_encoded_frames_decode(spark):
    rows = [(i, f"c{i % 3}" if i % 7 else None, f"unique {i}", i * 1e30) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, c string, u string, x double")
    frame, dictionary = prep.encode_frame(df)
    assert dict(frame.dtypes) == {"i": "smallint", "c": "tinyint", "u": "string", "x": "float"}
    assert {(r["column"], r.code, r.value) for r in dictionary.collect()} == {("c", i, f"c{i}") for i in range(3)}
    back = prep.decode_frame(frame, dictionary)
    assert sorted((r.i, r.c or "", r.u) for r in back.collect()) == sorted((i, c or "", u) for i, c, u, _ in rows)
    plain, none = prep.encode_frame(df.select("i"))
    assert plain.columns == ["i"] and none.count() == 0
    assert sorted(r.i for r in prep.decode_frame(plain, none).collect()) == list(range(60))


def test_wide_tables_melt_in_one_plan(spark):
    wide = spark.range(3).select("id", *[(F.col("id") * 1000 + i).alias(f"d_{i}") for i in range(1500)])
    long = reshape.melt(wide, ["id"], wide.columns[1:])
    assert long.count() == 4500 and long.where("sold <> id * 1000 + cast(substr(d, 3) as int)").count() == 0
    assert long._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_median_imputation_second_step_sees_the_first(spark):
    rows = [("a", 1.0), ("a", None), ("a", 3.0), ("b", None), ("c", 10.0), ("c", 10.0)]
    df = spark.createDataFrame(rows, "id string, p double")
    got = sorted((r["id"], r["p"]) for r in encode.impute_median(df, "p", "id").collect())
    # The global median is over 1, 2, 3, 10, 10.
    assert got == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 3.0), ("c", 10.0), ("c", 10.0)]


def test_scalers_on_constant_columns(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "c double, x double")
    std = sorted(tuple(r) for r in encode.standard_scale(df, ["c", "x"]).select("c_scaled", "x_scaled").collect())
    assert std == [(0.0, -1.0), (0.0, 1.0)]
    low = sorted(tuple(r) for r in encode.min_max_scale(df, ["c", "x"]).select("c_scaled", "x_scaled").collect())
    assert low == [(0.0, 0.0), (0.0, 1.0)]


def test_batch_scaling(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "i int, v double")
    fresh = {r["i"]: r["v_scaled"] for r in encode.batch_min_max(df, "v", ["i"], 4).collect()}
    assert [fresh[i] for i in (0, 3, 4, 7, 8, 9)] == [0.0, 1.0, 0.0, 1.0, 0.0, 1.0]
    frozen = {r["i"]: r["v_scaled"] for r in encode.batch_min_max(df, "v", ["i"], 4, keep_fitting=False).collect()}
    assert frozen[9] == pytest.approx(3.0)


def test_random_fourier_approximates_the_kernel(spark):
    x = np.random.default_rng(0).normal(size=(30, 2))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    z = np.array([r["rff"].toArray() for r in encode.random_fourier(df, ["a", "b"], 4000, 0.5, 1).collect()])
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-0.5 * d2)).max() < 0.1


# --- samples and splits ----------------------------------------------------------------------------


def test_key_subsample_fixture(spark):
    items = [7, 4, 8, 5, 7, 3, 7, 8, 5, 4]
    df = spark.createDataFrame([(i, k, i / 10, i % 2) for i, k in enumerate(items)],
                               "row int, item_id int, feature1 double, target int")
    out = sampling.keep_share_of_keys(df, "item_id", 0.6, 42).collect()
    kept = {r["item_id"] for r in out}
    assert len(kept) == max(1, int(5 * 0.6))
    assert sorted(r["row"] for r in out) == [i for i, k in enumerate(items) if k in kept]
    assert sampling.keep_share_of_keys(df, "item_id", 1.0).count() == 10
    assert sampling.keep_share_of_keys(df, "item_id", 0.01).select("item_id").distinct().count() == 1


@pytest.mark.parametrize("n,size", [(10, 3), (10, 4), (10, 20), (9, 2)])
def test_regular_interval(spark, n, size):
    step = max(1, n // size)
    got = sorted(r["id"] for r in sampling.every_kth(spark.range(n), ["id"], size).collect())
    assert got == list(range(n))[::step][:size]


def test_keys_per_group(spark):
    df = spark.createDataFrame([(f"c{i % 2}", f"i{i}", r) for i in range(20) for r in range(3)], "c string, k string, r int")
    out = sampling.keys_per_group(df, "c", "k", 4).toPandas()
    assert out.groupby("c")["k"].nunique().to_dict() == {"c0": 4, "c1": 4}
    assert (out.groupby("k").size() == 3).all()


@pytest.mark.parametrize("train,test", [(70, 30), (80, 20), (75, 25), (90, 10)])
def test_exact_split_sizes(spark, train, test):
    out = split.train_test(spark.range(100), "id", train, test, 3).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"train": train, "test": test}


def test_three_way_sizes_and_bad_shares(spark):
    out = split.train_val_test(spark.range(101), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"train": 70, "val": 15, "test": 16}
    with pytest.raises(ValueError):
        split.train_test(spark.range(10), "id", 70, 20)
    with pytest.raises(ValueError):
        split.train_val_test(spark.range(10), "id", 70, 20, 20)


@pytest.mark.parametrize("n,k", [(11, 3), (10, 5), (3, 5), (100, 7)])
def test_fold_sizes(spark, n, k):
    out = split.k_fold(spark.range(n), "id", k).groupBy("fold").count().collect()
    want = [n // k + (i < n % k) for i in range(k)]
    assert [dict((r["fold"], r["count"]) for r in out).get(i, 0) for i in range(k)] == want


def test_stratified_folds_keep_class_shares(spark):
    df = spark.range(100).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    out = split.stratified_k_fold(df, "id", "y", 5).groupBy("fold", "y").count().collect()
    assert {(r["fold"], r["y"]): r["count"] for r in out} == {
        **{(f, 1): 2 for f in range(5)}, **{(f, 0): 18 for f in range(5)}}


def test_folds_of_many_small_and_null_classes(spark):
    df = spark.range(700).withColumn("y", F.when(F.col("id") % 11 > 0, F.col("id") % 301))
    out = split.stratified_k_fold(df, "id", "y", 4, 2)
    assert out.count() == 700 and out.columns == ["id", "y", "fold"]
    sizes = {}
    for r in out.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], [0] * 4)[r["fold"]] = r["count"]
    for n in sizes.values():
        assert n == [sum(n) // 4 + (i < sum(n) % 4) for i in range(4)]
    assert {r["fold"] for r in split.stratified_k_fold(df, "id", "y", 1).collect()} == {0}
    assert split.stratified_k_fold(df.limit(0), "id", "y", 4).count() == 0


def test_random_rows(spark):
    a = sampling.random_rows(spark.range(500), "id", 120, 5)
    b = sampling.random_rows(spark.range(500).repartition(9), "id", 120, 5)
    assert a.exceptAll(b).count() == 0 and b.count() == 120
    assert sampling.random_rows(spark.range(5), "id", 9).count() == 5
    assert sampling.random_rows(spark.range(0), "id", 9).count() == 0


def test_equal_keys_are_refused_where_a_cut_needs_them_apart(spark):
    same = spark.range(30_000).select(F.lit(1).alias("k"))
    with pytest.raises(ValueError, match="identify"):
        split.train_test(same, "k")
    with pytest.raises(ValueError, match="identify"):
        split.stratified_k_fold(same.withColumn("y", F.lit(0)), "k", "y", 3)
    few = spark.createDataFrame([(1,), (1,), (2,), (2,)], "k int")
    assert sorted(r["count"] for r in split.train_test(few, "k", 50, 50).groupBy("split").count().collect()) == [2, 2]


def test_empty_tables_are_split_and_sampled(spark):
    df = spark.range(0)
    assert split.train_test(df, "id").count() == split.k_fold(df, "id", 3).count() == 0
    assert split.train_val_test(df, "id").count() == sampling.keep_share_of_keys(df, "id", 0.5).count() == 0


def test_different_keys_have_different_hashes(spark):
    from panelyard.plans import hash_key

    rows = [("a", None), (None, "a"), ("a|b", "c"), ("a", "b|c"), ("a\\", "b"), ("a", "\\b"), ("\\N", None), (None, "\\N"), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(hash_key(["x", "y"], 0).alias("h")).distinct().count() == len(rows)


def test_splits_do_not_depend_on_partitioning(spark):
    a = split.train_test(spark.range(500).repartition(3), "id", 60, 40, 1)
    b = split.train_test(spark.range(500).repartition(11), "id", 60, 40, 1)
    assert a.exceptAll(b).count() == 0


def test_panel_split(spark):
    df = spark.range(1, 101).select(F.col("id").cast("int").alias("d"))
    parts = split.panel_split(df, 70, 90, 30)
    bounds = {k: tuple(v.agg(F.min("d"), F.max("d")).first()) for k, v in parts.items()}
    assert bounds == {"train": (1, 70), "val": (71, 90), "test_features": (61, 100), "test": (91, 100)}
    with pytest.raises(ValueError):
        split.panel_split(df, 70, 90, None)


def test_chronological_fraction(spark):
    out = split.chronological_fraction(spark.range(10).repartition(4), ["id"], 0.7).collect()
    assert sorted(r["id"] for r in out if r["split"] == "train") == list(range(7))
    none = split.chronological_fraction(spark.range(10), ["id"], 0.01)
    assert none.filter("split = 'train'").count() == 0


def test_chronological_fraction_in_another_time_zone(spark):
    df = spark.range(10).select(
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT))").alias("h"), "id")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = split.chronological_fraction(df, ["h"], 0.5).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert sorted(r["id"] for r in out if r["split"] == "train") == list(range(5))


# --- sources -----------------------------------------------------------------------------------------


def test_feature_store_prunes_buckets(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("int").alias("d"), (F.col("id") * 2.0).alias("x"))
    path = new_path(spark, "store")
    sources.save_features(df, path)
    out = sources.load_features(spark, path, 400, 420)
    assert sorted(r["d"] for r in out.collect()) == list(range(400, 421))
    assert "PartitionFilters: [isnotnull(day_bucket" in out._jdf.queryExecution().toString()


def test_panel_folder(spark):
    folder = new_path(spark, "retail")
    wide = spark.createDataFrame(
        [(f"{i}_{c}", f"i{i}", c, i, i + 1) for i in range(6) for c in ("A", "B")],
        "id string, item_id string, cat_id string, d_1 int, d_2 int")
    price = spark.createDataFrame([(f"i{i}", 1.5) for i in range(6)], "item_id string, sell_price double")
    calendar = spark.createDataFrame([("d_1", "2024-01-01")], "d string, date string")
    for name, df in [("s", wide), ("p", price), ("c", calendar)]:
        df.write.option("header", True).csv(f"{folder}/{name}.csv")
    out = sources.load_panel_folder(spark, folder, "s.csv", "p.csv", "c.csv", horizon=3)
    assert out["sales"].count() == 12 * 5
    assert out["sales"].filter("d in ('d_3', 'd_4', 'd_5')").agg(F.sum("sold")).first()[0] == 0
    few = sources.load_panel_folder(spark, folder, "s.csv", "p.csv", "c.csv", keys_per_category=2)
    assert few["sales"].select("item_id").distinct().count() <= 4
    assert few["prices"].count() == few["sales"].select("item_id").distinct().count()


def test_series_with_bad_values(spark):
    path = new_path(spark, "series")
    spark.createDataFrame([("1.5",), ("oops",)], "value string").write.option("header", True).csv(path)
    assert sorted(str(r["value"]) for r in sources.load_series(spark, path).collect()) == ["1.5", "None"]


def test_missing_model_raises(spark):
    with pytest.raises(ValueError):
        sources.load_model(new_path(spark, "nothing"))


def test_fences_flags_and_medians_of_empty_tables(spark):
    from panelyard.operators import encode, sequences

    empty = spark.createDataFrame([], "x double, k string")
    nulls = spark.createDataFrame([(None, "a"), (None, None)], "x double, k string")
    for df in (empty, nulls):
        assert profile.tukey_outliers(df, "x").count() == 0
        assert {r["anomaly"] for r in sequences.flag_errors(df, "x").collect()} <= {None}
        assert encode.impute_median(df, "x", "k").where("x is not null").count() == 0


def test_two_step_median(spark):
    from panelyard.operators import encode

    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("b", 10.0), ("c", None), (None, 7.0), (None, None)]
    got = encode.impute_median(spark.createDataFrame(rows, "k string, x double"), "x", "k").collect()
    assert sorted((str(r.k), r.x) for r in got) == [
        ("None", 7.0), ("None", 7.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 10.0), ("c", 5.0)]
