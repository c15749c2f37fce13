"""Min-max scaling per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_PARAMS = "lo double, hi double"


def _read_params(spark: SparkSession, path: str):
    try:
        return spark.read.schema(_PARAMS).parquet(path).first()
    except AnalysisException:
        return None


def scale_batches(stream: DataFrame, col: str, output: str, params: str, checkpoint: str,
                  keep_fitting: bool = True, suffix: str = "_scaled"):
    """Start a query that scales ``col`` of every micro-batch and writes it to ``output``.

    While ``keep_fitting`` each batch is scaled by its own minimum and maximum; otherwise the
    first fitted parameters, kept in the small table ``params``, apply from then on. A batch
    overwrites its own folder, so a batch that is run again after a failure is not written twice.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        frozen = None if keep_fitting else _read_params(spark, params)
        if frozen is None:
            low, high = batch.agg(
                F.min(col).cast("double"), F.max(col).cast("double")).first()
            if low is None:
                return
            fitted = spark.range(1).select(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
            fitted.coalesce(1).write.mode("overwrite").parquet(params)
        else:
            low, high = frozen
        width = (high - low) or 1.0
        scaled = batch.withColumn(f"{col}{suffix}", (F.col(col) - F.lit(low)) / F.lit(width))
        scaled.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
