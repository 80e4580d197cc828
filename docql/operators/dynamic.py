"""Tier 3: any program over JSON texts, by the interpreter, in Arrow batches on the executors."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docql.plans import nodes as N

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    files = sorted(top.rglob("*.py"))
    mark = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    out = os.path.join(tempfile.mkdtemp(), f"docql-core-{mark}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in files:
            z.write(p, str(p.relative_to(top.parent)))
    context.addPyFile(out)
    _SHIPPED.add(context.applicationId)


#: A table of fewer bytes is often one file of one row group, which one task would interpret alone.
SMALL_TABLE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores, unless it is sorted or a stream."""
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) >= SMALL_TABLE or "Sort [" in plan.toString():
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def outputs(df: DataFrame, program: N.Node, column: str = "value", variables: dict[str, Any] | None = None, mode: str = "failfast", keep: tuple[str, ...] = (), extra: dict | None = None) -> DataFrame:
    """A row for each output of the program for each JSON text of column: the columns of keep, _pos, value (JSON text), _error.

    Outputs before an error are kept. mode "permissive" then gives a row with the error's JSON in _error; "failfast"
    fails. A null text is the value null. extra: further functions of values.
    """
    if mode not in ("failfast", "permissive"):
        raise ValueError(f"unknown mode {mode}")
    ship(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("_pos", T.LongType()), T.StructField("value", T.StringType()), T.StructField("_error", T.StringType())])
    held, more = dict(variables or {}), dict(extra or {})

    def run(batches):
        from docql.functions.interpret import Context, Env, values
        from docql.functions.values import JqError, dumps, parse

        env = Env(Context(extra=more), held)
        for batch in batches:
            rows, places, texts, errors = [], [], [], []
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                pos = 0
                try:
                    for v in values(program, None if text is None else parse(text), env):
                        rows.append(i)
                        places.append(pos)
                        texts.append(dumps(v))
                        errors.append(None)
                        pos += 1
                except JqError as e:
                    if mode == "failfast":
                        raise
                    rows.append(i)
                    places.append(pos)
                    texts.append(None)
                    errors.append(dumps(e.value))
            picked = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*picked, pa.array(places, pa.int64()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=schema.names)

    return spread(df.select(*keep, F.col(column).cast("string"))).mapInArrow(run, schema)


def structures(df: DataFrame, column: str = "value") -> DataFrame:
    """One row: the merged type structure of all JSON texts of column, as JSON text (null where there are none).

    Each task merges its own rows and sends one structure on; one more task merges these.
    """
    ship(df.sparkSession)

    def run(batches):
        from docql.functions.values import dumps, merge_structures, parse, type_structure

        out = None
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    s = type_structure(parse(x.as_py()))
                    out = s if out is None else merge_structures(out, s)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([dumps(out)])], names=["structure"])

    def merge(batches):
        from docql.functions.values import dumps, merge_structures, parse

        found = [parse(x.as_py()) for batch in batches for x in batch.column(0)]
        out = found[0] if found else None
        for s in found[1:]:
            out = merge_structures(out, s)
        yield pa.RecordBatch.from_arrays([pa.array([dumps(out) if found else None], pa.string())], names=["structure"])

    parts = spread(df.select(F.col(column).cast("string"))).mapInArrow(run, "structure string")
    return parts.repartition(1).mapInArrow(merge, "structure string")
