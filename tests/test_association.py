import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.functions.special import chi2_tail, f_tail
from panelyard.operators import association as K


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(5)
    n = 900
    y = rng.integers(0, 3, n)
    x = rng.normal(size=n) + y
    return pd.DataFrame({"x": x, "t": np.where(np.arange(n) % 3 == 0, 1.0, np.round(x, 1)), "n": rng.integers(0, 9, n),
                         "y": y, "c": np.array(["a", "b", "c", "d"])[rng.integers(0, 4, n)], "const": 1.0})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


def pairs(out, value="score"):
    return {(r["feature_name"], r["target_name"]): r[value] for r in out.collect()}


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations(df, pdf, method):
    cols = ["x", "t", "n", "y"]
    got = pairs(getattr(K, method)(df, cols))
    want = pdf[cols].corr(method)
    for (a, b), v in got.items():
        assert v == pytest.approx(want.loc[a, b], abs=1e-9)


def test_constant_and_incomplete_columns_score_zero(df):
    holes = df.withColumn("h", F.when(F.col("n") > 2, F.col("x")))
    assert pairs(K.pearson(df, ["const"], "x")) == {("const", "x"): 0.0}
    assert pairs(K.spearman(holes, ["const", "h", "t"], "x"))[("h", "x")] == 0.0
    assert pairs(K.spearman(holes, ["const", "h"], "x"))[("const", "x")] == 0.0


def test_text_columns_are_refused(df):
    with pytest.raises(ValueError):
        K.pearson(df, ["x", "c"])
    with pytest.raises(ValueError):
        K.chi2_score(df, ["x"], "y")
    with pytest.raises(ValueError):
        K.chi2_score(df.withColumn("m", -F.col("n")), ["m"], "y")


@pytest.mark.parametrize("f,d1,d2,p", [
    # Table values: F and chi-square quantiles.
    (4.9646, 1, 10, 0.05), (3.4928, 2, 20, 0.05), (8.0960, 1, 20, 0.01), (2.0, 3, 1e6, 0.1117)])
def test_f_tail(f, d1, d2, p):
    assert f_tail(f, d1, d2) == pytest.approx(p, abs=2e-4)


@pytest.mark.parametrize("x,dof,p", [(3.8415, 1, 0.05), (18.307, 10, 0.05), (6.6349, 1, 0.01), (124.342, 100, 0.05)])
def test_chi2_tail(x, dof, p):
    assert chi2_tail(x, dof) == pytest.approx(p, abs=1e-5)


def test_tail_edges():
    assert f_tail(0.0, 2, 5) == 1.0 and chi2_tail(0.0, 3) == 1.0 and chi2_tail(5.0, 0) == 1.0
    assert f_tail(float("inf"), 2, 5) == 0.0


def anova(groups):
    allx = np.concatenate(groups)
    between = sum(len(g) * (g.mean() - allx.mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    return between / (len(groups) - 1) / (within / (len(allx) - len(groups)))


def test_f_classif_and_anova(df, pdf):
    row = K.f_classif(df, ["x"], "y").first()
    assert row["f_score"] == pytest.approx(anova([g.to_numpy() for _, g in pdf.groupby("y")["x"]]))
    row = K.anova_by_category(df, "x", ["c"]).first()
    assert row["f_score"] == pytest.approx(anova([g.to_numpy() for _, g in pdf.groupby("c")["x"]]))
    assert 0 <= row["p_value"] <= 1


def test_chi2_independence(df, pdf):
    table = pd.crosstab(pdf["c"], pdf["y"]).to_numpy()
    e = np.outer(table.sum(1), table.sum(0)) / table.sum()
    row = K.chi2_independence(df.withColumn("yy", F.col("y").cast("string")), "yy", ["c"]).first()
    assert row["chi2"] == pytest.approx(((table - e) ** 2 / e).sum()) and row["dof"] == 6


def test_two_by_two_uses_the_continuity_correction(spark):
    cells = {("u", "p"): 10, ("u", "q"): 20, ("v", "p"): 30, ("v", "q"): 5}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "a string, b string")
    o = np.array([[10, 20], [30, 5]])
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    want = ((np.abs(o - e) - 0.5) ** 2 / e).sum()
    assert K.chi2_independence(df, "a", ["b"]).first()["chi2"] == pytest.approx(want)


def test_columns_with_missing_values_are_left_out(df):
    holes = df.withColumn("h", F.when(F.col("n") > 2, F.col("c")))
    assert [r["column_name"] for r in K.anova_by_category(holes, "x", ["c", "h"]).collect()] == ["c"]


def mi(a, b):
    t = pd.crosstab(a, b, normalize=True).to_numpy()
    e = np.outer(t.sum(1), t.sum(0))
    m = t > 0
    return (t[m] * np.log(t[m] / e[m])).sum()


def test_mutual_information(df, pdf):
    got = pairs(K.mutual_information(df, ["c", "n", "y"]), "mi")
    for (a, b), v in got.items():
        assert v == pytest.approx(mi(pdf[a], pdf[b]), abs=1e-10)


def test_mixed_mutual_information(df, pdf):
    edges = np.quantile(pdf["x"], [0.25, 0.5, 0.75])
    binned = np.searchsorted(edges, pdf["x"], side="left")
    got = pairs(K.mixed_mutual_information(df, ["y"], ["x"], "y", bins=4), "mi")
    assert got[("x", "y")] == pytest.approx(mi(binned, pdf["y"]), abs=1e-10)


@pytest.mark.parametrize("n", [2, 3, 9, 64, 97, 360, 4001])
def test_cycles_of_any_length(spark, n):
    x = np.random.default_rng(n).normal(size=n) + np.sin(np.arange(n)) + 1e6
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "d int, v double")
    want = np.abs(np.fft.rfft(x))[1:]
    for points in (K.POINTS, 1):
        got = K.seasonal_cycles(df, "d", "v", points=points).orderBy("k").toPandas()
        np.testing.assert_allclose(got["amplitude"], want, atol=1e-8)
        np.testing.assert_allclose(got["period"], n / np.arange(1, n // 2 + 1))
        np.testing.assert_allclose(got["share"], want / want.sum(), atol=1e-8)


def test_cycles_of_many_series(spark):
    rows = [(s, i, float(np.cos(2 * np.pi * i / p))) for s, p in (("a", 4), ("b", 6)) for i in range(24)]
    df = spark.createDataFrame(rows, "s string, d int, v double")
    rows += [(None, i, float(i % 2)) for i in range(8)] + [("one", 1, 1.0)] + [("gap", i, None if i == 3 else 1.0) for i in range(7)]
    df = df.unionByName(spark.createDataFrame(rows[48:], df.schema))
    for points in (100, 1):
        out = K.seasonal_cycles(df, "d", "v", ["s"], points=points).toPandas()
        assert sorted(out.groupby("s", dropna=False).size()) == [3, 4, 12, 12]
        assert out.loc[out.s == "gap", "amplitude"].isna().all()
        out = out[out.s != "gap"]
        best = out.loc[out.groupby("s", dropna=False)["amplitude"].idxmax()].set_index("s")["period"]
        assert list(best) == [4.0, 6.0, 2.0]
    assert K.seasonal_cycles(df.limit(0), "d", "v", ["s"]).count() == 0
    assert K.seasonal_cycles(df.limit(0), "d", "v").count() == 0


@pytest.mark.parametrize("n", [1_048_583, 2 * 524_309, 1 << 20])
def test_cycles_of_long_series(spark, n):
    """A prime, twice a prime and a power of two, above a million points."""
    df = spark.range(n).select("id", (F.sin(F.col("id") * 0.37) * 3 + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("v"))
    x = df.orderBy("id").toPandas()["v"].to_numpy()
    got = K.seasonal_cycles(df, "id", "v").orderBy("k").toPandas()
    want = np.abs(np.fft.rfft(x))[1:]
    np.testing.assert_allclose(got["amplitude"], want, atol=1e-9 * want.max())
    grid = K._Grid(n, K.POINTS)
    assert max(grid.rows * grid.b, grid.columns * grid.a, grid.a, grid.b) <= 4 * np.sqrt(n)


def test_calendar_report(spark):
    good = spark.sql("SELECT DATE'2024-01-01' + CAST(id AS INT) AS dt, CAST(id AS INT) + 1 AS d FROM range(10)")
    row = K.calendar_report(good, "dt", "d").first()
    assert row["equispaced"] and row["day_increases"] and not row["has_duplicate_dates"]
    bad = good.unionByName(good.limit(1)).filter("d <> 5")
    row = K.calendar_report(bad, "dt", "d").first()
    assert row["has_duplicate_dates"] and row["has_duplicate_days"] and not row["equispaced"]
    back = good.withColumn("d", -F.col("d"))
    assert not K.calendar_report(back, "dt", "d").first()["day_increases"]


def test_pca_projection(df, pdf):
    cols = ["x", "t", "n"]
    out, explained = K.pca_projection(df, cols)
    z = (pdf[cols] - pdf[cols].mean()) / pdf[cols].std(ddof=0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.to_numpy().T)))[::-1]
    np.testing.assert_allclose(explained, np.cumsum(values)[:2] / values.sum(), rtol=1e-9)
    got = out.agg(F.var_samp("pc1"), F.var_samp("pc2")).first()
    np.testing.assert_allclose(list(got), values[:2], rtol=1e-9)
