"""Small helpers shared by the corpus operators: reading, scratch tables, shipping code."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docql.operators.dynamic import ship as ship_package
from docql.sources.scratch import stored, stored_parts

__all__ = ["held", "id_crc", "ship", "stored", "stored_parts", "table"]


#: A table of fewer bytes is often one file of one row group, which one task would read alone.
SMALL_TABLE = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of Parquet files; a small one is dealt out to all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size < SMALL_TABLE else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, and bound the batches that go to and from Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship_package(spark)


def id_crc(doc_id="doc_id"):
    """crc32 of the id written as decimal text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


#: Rows of a batch that goes to or from Python; texts can be long, so fewer than Spark's 10,000.
BATCH_ROWS = 1_000
_HELD: list[tuple[Hashable, Any]] = []


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker process's one kept model: made if the last one asked for was another, which goes first.

    Workers serve one stage after the other, and models of stages gone by would fill their memory.
    """
    if not _HELD or _HELD[0][0] != key:
        _HELD.clear()
        give_back()
        _HELD.append((key, make()))
        give_back()  # what making it took
    return _HELD[0][1]


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
