"""JSON in: lines, streams of documents, whole files, raw lines, bytes, database columns, Python values.

Readers give a column value of JSON text (or raw text), which programs take; as_variant() and typed() parse it.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docql.operators.dynamic import ship
from docql.sources.embedded import in_process, read_rows

#: The most bytes of JSON that slurp() puts into one row.
SLURP_BYTES = 64 << 20
#: Documents of a file that go on at once.
DOCUMENTS = 1_000


def json_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """A document per line; blank lines are none. Files are split, so one large file is read by many tasks."""
    return spark.read.text([*paths]).where(F.trim("value") != "")


def json_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """Documents parted by white space or nothing, on any lines: (_file, _pos, value).

    A file is read by one task, as one string (of 2 GB at most), since nothing tells where a document begins; its documents
    go on in batches. Files of a document per line are split: json_lines().
    """
    ship(spark)

    def run(batches):
        from docql.functions.values import dumps, each_document

        for batch in batches:
            for name, text in zip(*batch.columns, strict=True):
                docs, at = each_document(text.as_py()), 0
                while part := [dumps(v) for v in islice(docs, DOCUMENTS)]:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(part), pa.string()), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.string())], names=["_file", "_pos", "value"])
                    at += len(part)

    files = spark.read.text([*paths], wholetext=True).select(F.input_file_name().alias("_file"), "value")
    return files.mapInArrow(run, "_file string, _pos long, value string")


def raw_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Each line as a JSON string."""
    lines = spark.read.text([*paths])
    quoted = F.to_json(F.struct(F.col("value").alias("v")))
    return lines.select(F.substring(quoted, F.lit(6), F.length(quoted) - 6).alias("value"))


def json_bytes(spark: SparkSession, *paths: str) -> DataFrame:
    """A document per file, its bytes read as UTF-8: (_file, value)."""
    return spark.read.format("binaryFile").load([*paths]).select(F.col("path").alias("_file"), F.col("content").cast("string").alias("value"))


def json_table(spark: SparkSession, url: str, table: str, column: str, **options: str) -> DataFrame:
    """A database column of JSON text or UTF-8 bytes, as value with the other columns.

    A server's table is read by the executors, when rows are asked for; a table of the driver's own process now, by the driver.
    """
    df = read_rows(spark, url, table, options) if in_process(url) else spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.withColumn("value", F.col(column).cast("string")).drop(*({column} - {"value"}))


def null_input(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("null").alias("value"))


def from_values(spark: SparkSession, values: Iterable[Any]) -> DataFrame:
    from docql.functions.values import dumps

    return spark.createDataFrame([(dumps(v),) for v in values], "value string")


def to_values(df: DataFrame, column: str = "value") -> list[Any]:
    from docql.functions.values import parse

    return [None if r[0] is None else parse(r[0]) for r in df.select(column).toLocalIterator()]


def slurp(df: DataFrame, column: str = "value", order: Iterable[str] = (), limit: int = SLURP_BYTES) -> DataFrame:
    """One row: the array of all documents, in the given order. Refused beyond limit bytes: use Program.dataset()."""
    size = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    if size > limit:
        raise ValueError(f"{size} bytes are too many for one array (limit {limit}); a program over the dataset needs none")
    keys = [*order]
    rows = F.array_sort(F.collect_list(F.struct(*keys, F.col(column).alias("_v")))) if keys else F.collect_list(F.struct(F.col(column).alias("_v")))
    joined = F.array_join(F.transform(rows, lambda r: F.coalesce(r["_v"], F.lit("null"))), ",")
    return df.agg(F.concat(F.lit("["), joined, F.lit("]")).alias("value"))


def as_variant(column: str = "value", strict: bool = True) -> Column:
    return F.parse_json(column) if strict else F.try_parse_json(column)


def typed(df: DataFrame, schema: T.StructType | str, column: str = "value") -> DataFrame:
    """JSON text as typed columns, which tiers 1 and 2 work on."""
    return df.select(F.from_json(column, schema).alias("v")).select("v.*")
