"""Splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.cases.base import PANEL_SQL, Tables, case, sales_panel
from panelyard.cases.summaries import TAXI_SQL, taxi
from panelyard.operators import prep, split

RANKED = """WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|1')) AS p,
  count(*) OVER () AS n FROM orders)
"""


@case("t1_train_test", RANKED + """
SELECT o_orderkey, CASE WHEN p <= floor(0.7e0 * n) THEN 'train' ELSE 'test' END AS split FROM k""")
def _(spark, sf):
    return split.train_test(Tables(spark, sf).orders, "o_orderkey", 70, 30, 1).select("o_orderkey", "split")


@case("t2_train_val_test", RANKED + """
SELECT o_orderkey, CASE WHEN p <= floor(0.7e0 * n) THEN 'train'
  WHEN p <= n - ceil(0.5 * (n - floor(0.7e0 * n))) THEN 'val' ELSE 'test' END AS split FROM k""")
def _(spark, sf):
    return split.train_val_test(Tables(spark, sf).orders, "o_orderkey", seed=1).select("o_orderkey", "split")


@case("t3_k_fold", """
SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|1')) - 1 AS INTEGER) AS fold FROM orders""")
def _(spark, sf):
    return split.k_fold(Tables(spark, sf).orders, "o_orderkey", 7, 1).select("o_orderkey", "fold")


@case("t4_stratified_k_fold", """
SELECT doc_id, quality, CAST(ntile(5) OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|1')) - 1
  AS INTEGER) AS fold FROM documents JOIN labels USING (doc_id)""")
def _(spark, sf):
    t = Tables(spark, sf)
    df = prep.align(t.documents.select("doc_id"), t.labels.select("doc_id", "quality"), ["doc_id"])
    return split.stratified_k_fold(df, "doc_id", "quality", 5, 1).select("doc_id", "quality", "fold")


@case("t5_panel_split", f"WITH {PANEL_SQL}, m AS (SELECT max(d) AS n FROM days) " + "\nUNION ALL ".join(
    f"SELECT '{name}' AS part, id, d, sold FROM panel CROSS JOIN m WHERE {cond}" for name, cond in [
        ("train", "d <= n - 57"), ("val", "d BETWEEN n - 56 AND n - 28"),
        ("test_features", "d >= n - 27 - 365"), ("test", "d > n - 28")]))
def _(spark, sf):
    df, n = sales_panel(Tables(spark, sf))
    parts = split.panel_split(df.select("id", "d", "sold"), n - 57, n - 28, 365)
    out = None
    for name, part in parts.items():
        part = part.withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@case("t6_chronological_fraction", f"WITH {TAXI_SQL} SELECT hour, "
      "CASE WHEN i < CAST(floor(0.7e0 * n) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM numbered")
def _(spark, sf):
    return split.chronological_fraction(taxi(Tables(spark, sf)), ["hour"]).select("hour", "split")


@case("t7_predefined_split", """
SELECT o_orderkey, CAST(o_orderdate >= TIMESTAMP '1997-01-01' AS INTEGER) AS fold FROM orders""")
def _(spark, sf):
    rows = Tables(spark, sf).orders.select("o_orderkey", "o_orderdate")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    return split.predefined_split(rows.filter(F.col("o_orderdate") < cut), rows.filter(F.col("o_orderdate") >= cut)).select(
        "o_orderkey", "fold")
