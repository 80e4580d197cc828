"""Tables between the steps of a plan, in the folder that all nodes of a cluster share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scratch_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it names none, a local folder on one machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"docql-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _at(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored_parts(spark: SparkSession, schema: StructType, parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all parts as one table; each part is written when it is made, and none has to be kept."""
    at = f"{scratch_dir(spark)}/docql-{uuid.uuid4().hex}"
    path, system = _at(spark, at)
    system.deleteOnExit(path)
    spark.createDataFrame([], schema).write.parquet(at)
    for part in parts:
        part.write.mode("append").parquet(at)
    return spark.read.schema(schema).parquet(at)


def stored(df: DataFrame, *used_up: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; used_up are stored tables that nothing needs afterwards.

    This cuts lineage: a lost executor costs its running tasks only, and a table that is used
    several times is computed once, with one result. The files go when the application ends, those of used_up at once.
    """
    spark = df.sparkSession
    at = f"{scratch_dir(spark)}/docql-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path, system = _at(spark, at)
    system.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._scratch = at
    for gone in used_up:
        if held := getattr(gone, "_scratch", None):
            path, system = _at(spark, held)
            system.delete(path, True)
    return out
