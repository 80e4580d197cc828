"""Programs over unbounded input, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docql.engine import Program
from docql.operators.dynamic import outputs, ship


def json_line_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of new files of a folder, as JSON texts."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).where(F.trim("value") != "")


def stream_rows(df: DataFrame, program: Program, column: str = "value", mode: str = "permissive", keep: tuple[str, ...] = (), variables: dict | None = None) -> DataFrame:
    """The outputs for every row as it comes; an error is a row with _error, so that it does not end the stream."""
    return outputs(df, program.ast, column, variables, mode, keep)


def to_consumer(df: DataFrame, consumer: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, mode: str = "append") -> StreamingQuery:
    """consumer gets each micro-batch; its number stays the same when a batch is repeated after a failure. Once: all that is there now."""
    writer = df.writeStream.outputMode(mode).foreachBatch(consumer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_fold(df: DataFrame, key: str, program: Program, start: str = "null", column: str = "value", watermark: tuple[str, str] | None = None) -> DataFrame:
    """A state for each key across batches: program gets {state, value} and its first output is the new state.

    Rows: (key, state, n) after each batch in which the key occurs. With a watermark (column, delay) a key that has
    been silent for longer than the delay is forgotten; without one, states stay.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ship(df.sparkSession)
    tree, begin = program.ast, start
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("state", T.StringType()), T.StructField("n", T.LongType())])
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    if watermark:
        df = df.withWatermark(*watermark)

    def step(k, frames, state: GroupState):
        import pandas as pd

        from docql.functions.interpret import first, run
        from docql.functions.values import dumps, parse

        if state.hasTimedOut:
            state.remove()
            return
        text, n = state.get if state.exists else (begin, 0)
        held, latest = parse(text), 0
        for frame in frames:
            for v in frame[column]:
                held = first(run(tree, {"state": held, "value": parse(v)}), held)
                n += 1
            if watermark:
                latest = max(latest, int(frame[watermark[0]].max().timestamp() * 1000))
        state.update((dumps(held), n))
        if watermark:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "state": [dumps(held)], "n": [n]})

    return df.groupBy(key).applyInPandasWithState(step, schema, "state string, n long", "update", timeout)


def windowed_counts(df: DataFrame, time: str, key: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts by key and window of event time; rows later than delay are dropped by the watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.withWatermark(time, delay).groupBy(w.alias("window"), key).agg(F.count("*").alias("n"))


def session_counts(df: DataFrame, time: str, key: str, gap: str, delay: str) -> DataFrame:
    """Counts by key and session: rows of a key belong together where none is later than gap after the one before."""
    return df.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count("*").alias("n"))
