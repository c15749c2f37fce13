"""Written intermediate tables.

A staged table cuts lineage, survives a lost executor (it lives in the shared folder, not on
an executor) and gives Catalyst its true size, so a join against it is broadcast only when the
files are under ``spark.sql.autoBroadcastJoinThreshold`` and shuffled otherwise.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where one process does all the work."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/panelyard/{spark.sparkContext.applicationId}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # one machine, one process
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _LOCAL_FOLDER:
        _LOCAL_FOLDER.append(tempfile.TemporaryDirectory(prefix="panelyard-"))
    return _LOCAL_FOLDER[0].name


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str = "staged", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    With ``partition_by`` a filter on that column prunes files, and the size Catalyst sees is
    that of the files left.
    """
    path = new_path(df.sparkSession, tag)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete this application's staged tables; frames that read them are unusable afterwards."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
