"""Sliding windows of ordered series and reconstruction errors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from panelyard.operators.panel import CHUNK, chunked
from panelyard.plans import exact_quantiles, with_global_index, with_row, with_series_position


def sliding_windows(df: DataFrame, order: Sequence[str], value: str, length: int,
                    series: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """All windows of ``length`` consecutive values, stride 1 (W12): rows (*series, start, window).

    Rows are numbered without a global window, cut into chunks that overlap by ``length - 1``
    rows, and each chunk makes its own windows, so one series may have any length.
    """
    series = list(series)
    df = df.select(*series, *[c for c in order if c not in series], F.col(value).alias("__v"))
    if series:
        placed = with_series_position(df, series, order, "__pos")
    else:
        placed = with_global_index(df, order, "__pos")

    def collect(frame: DataFrame, chunk_col: str) -> DataFrame:
        w = Window.partitionBy(*series, chunk_col).orderBy("__pos").rowsBetween(-(length - 1), 0)
        return frame.withColumn("window", F.collect_list("__v").over(w))

    out = chunked(placed, "__pos", length - 1, collect, 0, max(chunk, length))
    out = out.filter(F.size("window") == length)
    return out.select(*series, (F.col("__pos") - (length - 1)).alias("start"), "window")


def _array_mean(col: str | Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda a, v: a + v) / F.size(col)


def mean_reconstruction(windows: DataFrame, window="window", name="error") -> DataFrame:
    """Mean squared error of replacing a window by its own mean."""
    out = windows.withColumn("__mean", _array_mean(window))
    squares = F.transform(window, lambda v: (v - F.col("__mean")) * (v - F.col("__mean")))
    return out.withColumn(name, _array_mean(squares)).drop("__mean")


def pca_reconstruction(train: DataFrame, windows: DataFrame, components: int, window="window",
                       name="error") -> DataFrame:
    """Mean squared error after projecting on the leading components of the training windows."""
    vectors = train.select(array_to_vector(window).alias("__vec"))
    center = vectors.select(Summarizer.mean(F.col("__vec")).alias("m")).first()["m"].toArray()
    axes = PCA(k=components, inputCol="__vec", outputCol="__pc").fit(vectors).pc.toArray()

    @pandas_udf("double")
    def error(series: pd.Series) -> pd.Series:
        if len(series) == 0:
            return pd.Series([], dtype=float)
        x = np.stack(series.to_list()) - center
        return pd.Series(np.mean((x - (x @ axes) @ axes.T) ** 2, axis=1))

    return windows.withColumn(name, error(F.col(window)))


def flag_errors(errors: DataFrame, error="error", percentile=0.95, name="anomaly") -> DataFrame:
    """1 where the error is above its percentile (A16, N5); null without any error value."""
    cut = exact_quantiles(errors, [error], [percentile]).select(F.col("q")[0].alias("__cut"))
    return with_row(errors, cut).withColumn(name, (F.col(error) > F.col("__cut")).cast("int")).drop("__cut")
