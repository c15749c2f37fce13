"""Outliers, sequence anomalies and micro-batch scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.cases.base import Tables, case, r, rsql
from panelyard.cases.modelling import HOUSE, KEY, housing
from panelyard.cases.summaries import TAXI_SQL, taxi
from panelyard.operators import encode, metrics, outliers, sequences, split
from panelyard.plans import stage
from panelyard.plans.staging import new_path
from panelyard.streaming.scaling import scale_batches

LENGTH = 50

WINDOWS_SQL = "WITH" + TAXI_SQL + """,
scaled AS (SELECT hour, i, n, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM numbered),
parts AS (SELECT *, CASE WHEN i < CAST(floor(0.7e0 * n) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM scaled),
placed AS (SELECT split, value, row_number() OVER (PARTITION BY split ORDER BY hour) - 1 AS pos FROM parts),
win AS (SELECT split, pos - 49 AS start, list(value) OVER (PARTITION BY split ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS w FROM placed),
windows AS (SELECT split, start, w FROM win WHERE start >= 0),
errors AS (SELECT split, start, list_avg([pow(v - list_avg(w), 2) FOR v IN w]) AS error FROM windows)
"""


def windows(t: Tables):
    scaled = encode.min_max_scale(taxi(t), ["value"], "")
    parts = split.chronological_fraction(scaled, ["hour"])
    return sequences.sliding_windows(parts, ["hour"], "value", LENGTH, ["split"])


@case("w12_sliding_windows", WINDOWS_SQL + """
SELECT split, start, [round(v, 6) + 0e0 FOR v IN w] AS w FROM windows""")
def _(spark, sf):
    rounded = F.transform("window", lambda v: F.round(v, 6) + F.lit(0.0))
    return windows(Tables(spark, sf)).select("split", "start", rounded.alias("w"))


@case("w12_sliding_windows_events", """
WITH o AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events),
w AS (SELECT pos - 49 AS start, list(value) OVER (ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS w FROM o)
SELECT start, w FROM w WHERE start >= 0""")
def _(spark, sf):
    """One series of the whole table, in chunks."""
    df = Tables(spark, sf).events
    return sequences.sliding_windows(df, ["ts", "event_id"], "value", LENGTH, chunk=1000).select(
        "start", F.col("window").alias("w"))


@case("n1_isolation_forest")
def _(spark, sf):
    flagged = outliers.isolation_forest(housing(Tables(spark, sf)), KEY, [*HOUSE, "l_extendedprice"],
                                        partitions=spark.sparkContext.defaultParallelism)
    return flagged.select(*KEY, "score", "outlier")


@case("n1_outlier_profile")
def _(spark, sf):
    cols = [*HOUSE, "l_extendedprice"]
    flagged = stage(outliers.isolation_forest(housing(Tables(spark, sf)), KEY, cols), "flagged")
    return outliers.outlier_profile(flagged, cols)


@case("n3_mean_reconstruction", WINDOWS_SQL + f"SELECT split, start, {rsql('error', 'error')} FROM errors")
def _(spark, sf):
    return sequences.mean_reconstruction(windows(Tables(spark, sf))).select("split", "start", r("error"))


@case("n4_pca_reconstruction")
def _(spark, sf):
    df = stage(windows(Tables(spark, sf)), "windows")
    train, val = df.filter("split = 'train'"), df.filter("split = 'val'")
    return sequences.pca_reconstruction(train, val, LENGTH // 10).select("start", "error")


def _flags(t: Tables):
    val = windows(t).filter("split = 'val'")
    errors = stage(sequences.mean_reconstruction(val).drop("window"), "errors")
    return sequences.flag_errors(errors)


@case("n5_error_flags", WINDOWS_SQL + """
SELECT start, CAST(error > (SELECT quantile_cont(error, 0.95) FROM errors WHERE split = 'val') AS INTEGER) AS anomaly
FROM errors WHERE split = 'val'""")
def _(spark, sf):
    return _flags(Tables(spark, sf)).select("start", "anomaly")


N6_SQL = WINDOWS_SQL + """, f AS (SELECT CAST(error > (SELECT quantile_cont(error, 0.95) FROM errors WHERE split = 'val') AS INTEGER) AS said,
  CAST(list_max(w) > 0.8 AS INTEGER) AS truth FROM errors JOIN windows USING (split, start) WHERE split = 'val'),
c AS (SELECT count(*) AS n, count(*) FILTER (truth = 1 AND said = 1) AS tp, count(*) FILTER (truth = said) AS hits,
  count(*) FILTER (truth = 1) AS pos, count(*) FILTER (said = 1) AS yes FROM f)
SELECT n, """ + ", ".join([
    rsql("hits / n", "accuracy"), rsql("coalesce(tp / nullif(yes, 0), 0e0)", "precision"),
    rsql("coalesce(tp / nullif(pos, 0), 0e0)", "recall"),
    rsql("coalesce(2 * tp / nullif(pos + yes, 0), 0e0)", "f1")]) + " FROM c"


@case("n6_scores_against_truth", N6_SQL)
def _(spark, sf):
    """A window with a value above 0.8 plays the true anomaly."""
    val = stage(windows(Tables(spark, sf)).filter("split = 'val'"), "windows")
    flagged = sequences.flag_errors(sequences.mean_reconstruction(val))
    rows = flagged.withColumn("truth", (F.array_max("window") > 0.8).cast("int"))
    out = metrics.classification_metrics(rows, "truth", "anomaly")
    return out.select("n", *[r(c) for c in ("accuracy", "precision", "recall", "f1")])


def _stream(spark, sf, keep_fitting: bool):
    """The events arrive one event type after the other; each arrival is one micro-batch."""
    source, output, params, progress = (new_path(spark, n) for n in ("in", "scaled", "params", "progress"))
    rows = Tables(spark, sf).events.select("event_id", "event_type", "value")
    for kind in sorted(r[0] for r in rows.select("event_type").distinct().collect()):
        rows.filter(F.col("event_type") == kind).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        scale_batches(stream, "value", output, params, progress, keep_fitting).awaitTermination()
    return spark.read.parquet(output).select("event_id", "batch_id", r("value_scaled"))


def stream_sql(lo: str, hi: str) -> str:
    return ("WITH b AS (SELECT event_id, value, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS batch_id FROM events), "
            "f AS (SELECT min(value) AS flo, max(value) AS fhi FROM b WHERE batch_id = 0) "
            f"SELECT event_id, batch_id, {rsql(f'(value - {lo}) / ({hi} - {lo})', 'value_scaled')} FROM b CROSS JOIN f")


@case("z1_stream_scaling", stream_sql("min(value) OVER (PARTITION BY batch_id)", "max(value) OVER (PARTITION BY batch_id)"))
def _(spark, sf):
    return _stream(spark, sf, True)


@case("z1_stream_scaling_frozen", stream_sql("flo", "fhi"))
def _(spark, sf):
    return _stream(spark, sf, False)
