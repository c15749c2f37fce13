import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.operators import panel

ATTRS = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(6):
        for d in range(1, 701):
            rows.append((f"s{i}", f"i{i % 3}", f"d{i % 2}", "c", f"st{i // 3}", "x", d, float(rng.integers(0, 9))))
    return pd.DataFrame(rows, columns=["id", *ATTRS, "d", "sold"])


@pytest.fixture(scope="module")
def sdf(spark, frame):
    return spark.createDataFrame(frame.sample(frac=1, random_state=1)).withColumn("d", F.col("d").cast("int"))


def expected(pdf):
    """The same features by pandas, one series at a time."""
    pdf = pdf.sort_values(["id", "d"]).copy()
    g = pdf.groupby("id")["sold"]
    fill = {}
    for k in panel.LAGS:
        fill[f"sold_lag_{k}"] = g.shift(k)
    for k in panel.ROBUST_LAGS:
        n = max(1, int(k * 0.5))
        fill[f"sold_robustlag_{k}"] = g.transform(lambda x: x.shift(k).rolling(n, min_periods=1).mean())
    for n in panel.ROLLING:
        fill[f"sold_avg_{n}d"] = g.transform(lambda x: x.rolling(n).mean())
    fill["sold_max_14d"] = g.transform(lambda x: x.rolling(14).max())
    for name, col in fill.items():
        pdf[name] = col.groupby(pdf["id"]).bfill()
    pdf["sold_avg_expanding"] = g.transform(lambda x: x.expanding().mean())
    for name, cols in panel.ENCODINGS.items():
        pdf[f"sold_avg_{name}"] = pdf.groupby(list(cols))["sold"].transform("mean")
    own = g.transform("mean")
    pdf["sold_daily_deviation_from_avg"] = own - pdf["sold_avg_item"]
    pdf["sold_daily_deviation_from_avg_30d"] = own - pdf["sold_avg_30d"]
    pdf["sold_next_day"] = g.shift(-1).fillna(0)
    return pdf.reset_index(drop=True)


def check(out, want):
    got = out.toPandas().sort_values(["id", "d"]).reset_index(drop=True)
    assert len(got) == len(want)
    for c in want.columns:
        if c.startswith("sold"):
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_all_features_match_pandas(sdf, frame):
    check(panel.panel_features(sdf), expected(frame))


@pytest.mark.parametrize("chunk", [600, 5000])
def test_chunked_features_match_pandas(sdf, frame, chunk):
    check(panel.long_panel_features(sdf, chunk=chunk), expected(frame))


def test_long_series_take_the_chunked_way(sdf, frame):
    check(panel.panel_features(sdf, max_series_rows=100), expected(frame))


def test_windows_with_missing_values(spark, frame):
    holes = frame.copy()
    holes.loc[holes.index % 7 == 0, "sold"] = np.nan
    df = spark.createDataFrame(holes).withColumn("sold", F.nanvl("sold", F.lit(None).cast("double")))
    got = panel.add_rolling_means(df, windows=(7, 40)).toPandas().sort_values(["id", "d"])
    ordered = holes.sort_values(["id", "d"])
    for n in (7, 40):
        want = ordered.groupby("id")["sold"].transform(lambda x: x.rolling(n).mean())
        np.testing.assert_allclose(got[f"sold_avg_{n}d"].to_numpy(float), want.to_numpy(float))
    got = panel.add_robust_lags(df, lags=(90,)).toPandas().sort_values(["id", "d"])
    want = ordered.groupby("id")["sold"].transform(lambda x: x.shift(90).rolling(45, min_periods=1).mean())
    np.testing.assert_allclose(got["sold_robustlag_90"].to_numpy(float), want.to_numpy(float))


def test_backfill_keeps_trailing_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None)], "id string, d int, v double")
    got = [r["v"] for r in panel.backfill(df, ["v"]).orderBy("d").collect()]
    assert got == [5.0, 5.0, None]


@pytest.mark.parametrize("every", [1, 5])
def test_slope(sdf, frame, every):
    got = panel.add_slope(sdf, window=30, every=every).toPandas().sort_values(["id", "d"])["sold_slope_30d"]

    def slope(x):
        y = x[::every]
        return np.polyfit(np.arange(len(y)), y, 1)[0]

    want = frame.sort_values(["id", "d"]).groupby("id")["sold"].transform(
        lambda x: x.rolling(30).apply(slope, raw=True))
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), atol=1e-9)


def test_dense_panel_fills_every_day(spark):
    sales = spark.createDataFrame(
        [("a", "x", 12, 3.0), ("a", "x", 12, 1.0), ("b", "y", 11, 2.0), ("b", "y", 15, 4.0)],
        "id string, item string, dt int, sold double")
    days = panel.day_table(spark.range(11, 16).select(F.col("id").cast("int").alias("dt")), "dt")
    observed = panel.observed_days(sales, "id", ["item"], "dt", "sold")
    rows = panel.dense_panel(observed, days, "id", ["item"], "sold").collect()
    got = {(r["id"], r["d"]): r["sold"] for r in rows}
    assert len(rows) == 10
    assert {k: v for k, v in got.items() if v} == {("a", 2): 4.0, ("b", 1): 2.0, ("b", 5): 4.0}


def test_dense_panel_moves_sparse_rows_once(spark):
    """After the staged sums one exchange serves the panel and all windows on it."""
    sales = spark.createDataFrame([("a", "x", 2, 3.0)], "id string, item string, dt int, sold double")
    days = panel.day_table(spark.range(5).select(F.col("id").cast("int").alias("dt")), "dt")
    observed = panel.observed_days(sales, "id", ["item"], "dt", "sold")
    out = panel.add_lags(panel.dense_panel(observed, days, "id", ["item"], "sold"), lags=(1, 2))
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(id") == 1


def test_zero_after(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0), (9, 2.0, 3.0, 4.0)], "d int, sold double, sold_x double, price double")
    got = {r["d"]: (r["sold"], r["sold_x"], r["price"]) for r in panel.zero_after(df, 5).collect()}
    assert got == {1: (2.0, 3.0, 4.0), 9: (0.0, 0.0, 4.0)}


def test_encodings_fitted_on_training_days(sdf, frame):
    got = panel.add_mean_encodings(sdf, fit_filter=F.col("d") <= 300).toPandas().sort_values(["id", "d"])
    want = frame[frame["d"] <= 300].groupby("item_id")["sold"].mean()
    np.testing.assert_allclose(got["sold_avg_item"], got["item_id"].map(want))


def test_means_of_real_huge_and_infinite_values(spark):
    """A huge or infinite value changes the frames that hold it and no other."""
    values = [0.1] * 900
    values[100], values[450] = 1e17, float("inf")
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)], "id string, d int, sold double")
    got = panel.add_rolling_means(panel.add_robust_lags(df)).toPandas().sort_values("d").set_index("d")
    for n in panel.ROLLING:
        clean = [i for i in range(n - 1, 900) if not {100, 450} & set(range(i - n + 1, i + 1))]
        np.testing.assert_allclose(got[f"sold_avg_{n}d"].iloc[clean], 0.1, rtol=1e-12)
        assert np.isinf(got[f"sold_avg_{n}d"].iloc[max(450, n - 1)]) and got[f"sold_avg_{n}d"].iloc[n - 2 if n > 1 else 0:n - 1].isna().all()
    n, k = 182, 365
    clean = [i for i in range(k, 900) if not {100, 450} & set(range(i - k - n + 1, i - k + 1))]
    np.testing.assert_allclose(got[f"sold_robustlag_{k}"].iloc[clean], 0.1, rtol=1e-12)


def test_means_of_random_values_match_pandas(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=800) * 10.0 ** rng.integers(-3, 6, 800)
    df = spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(values)], "id string, d int, sold double")
    got = panel.add_rolling_means(df).toPandas().sort_values("d")
    for n in panel.ROLLING:
        want = [values[i - n + 1:i + 1].mean() if i >= n - 1 else np.nan for i in range(800)]
        np.testing.assert_allclose(got[f"sold_avg_{n}d"], want, rtol=1e-9)
