"""Typed tables as datasets of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def seconds_of(c: Column) -> Column:
    """Seconds from 1970 to a timestamp without zone or a date, read as UTC whatever the session's zone is."""
    t = c.cast("timestamp_ntz")
    days = F.date_diff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def as_json_types(df: DataFrame) -> DataFrame:
    """Timestamps and dates, which JSON has not, as seconds since 1970 in UTC; other columns as they are.

    A conversion of a column nobody asks for is pruned with the column.
    """
    made = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampNTZType, T.DateType)):
            c = seconds_of(c)
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_seconds(c)
        made.append(c.alias(f.name))
    return df.select(*made)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return as_json_types(spark.read.parquet(f"{folder}/{name}.parquet"))
