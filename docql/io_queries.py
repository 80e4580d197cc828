"""Registered queries for sources, sinks, streams and the value API, and the same in SQL.

What is read is first written to the shared scratch folder from the driver's tables.
"""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docql import cli
from docql.engine import Program, ProgramError, Registry, compile_program
from docql.functions import api
from docql.functions.values import JqError, dumps
from docql.language_queries import DOCUMENT
from docql.plans import sqljson
from docql.sources import readers, writers
from docql.sources.scratch import scratch_dir
from docql.sources.tables import read_table
from docql.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def place(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/docql-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_nationkey, value): a JSON text for each nation."""
    return read_table(spark, sf_dir, "nation").select("n_nationkey", F.expr(DOCUMENT).alias("value"))


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select(F.col("props").alias("value"))


K_OF_PROPS = "SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events"

# Sources


@query(K_OF_PROPS)
def source_json_lines(spark, sf_dir):
    at = place(spark)
    props(spark, sf_dir).write.text(at)
    return compile_program(".k").rows(readers.json_lines(spark, at)).select("value")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS value FROM nation")
def source_json_documents(spark, sf_dir):
    """Documents on several lines, and several on one."""
    at = place(spark)
    documents(spark, sf_dir).select(F.concat(F.replace("value", F.lit(","), F.lit(",\n")), F.lit(" "))).write.option("lineSep", " ").text(at)
    return compile_program(".k").rows(readers.json_documents(spark, at)).select("value")


@query("""SELECT '"' || lower(n_name) || '"' AS value FROM nation""")
def source_raw_lines(spark, sf_dir):
    at = place(spark)
    read_table(spark, sf_dir, "nation").select("n_name").write.text(at)
    return compile_program("ascii_downcase").rows(readers.raw_lines(spark, at)).select("value")


@query("SELECT '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS value FROM nation")
def source_slurp(spark, sf_dir):
    return compile_program("map(.k)").rows(readers.slurp(documents(spark, sf_dir), order=["n_nationkey"])).select("value")


@query("SELECT '10' AS value")
def source_null_input(spark, sf_dir):
    return compile_program("[range(5)] | add").rows(readers.null_input(spark)).select("value")


@query("SELECT CAST(count(*) AS VARCHAR) AS value FROM nation")
def source_bytes(spark, sf_dir):
    at = place(spark)
    readers.slurp(documents(spark, sf_dir)).coalesce(1).write.text(at)
    return compile_program("length").rows(readers.json_bytes(spark, f"{at}/*.txt")).select("value")


@query("SELECT CAST(x AS VARCHAR) AS value FROM (VALUES (1), (2)) t(x)")
def source_values(spark, sf_dir):
    return compile_program(".a").rows(readers.from_values(spark, [{"a": 1}, {"a": 2}])).select("value")


@query("SELECT n_nationkey AS k, n_name AS s FROM nation")
def source_typed(spark, sf_dir):
    return readers.typed(documents(spark, sf_dir), "k long, s string")


@query("SELECT n_nationkey, n_nationkey + 1 AS value FROM nation")
def source_variant(spark, sf_dir):
    """Strict parsing to VARIANT, and a program over that column."""
    df = documents(spark, sf_dir).withColumn("value", readers.as_variant())
    return compile_program(".k + 1").rows(df, keep=("n_nationkey",)).select("n_nationkey", F.col("value").cast("bigint"))


# Sinks


@query("SELECT 25 AS n, true AS same")
def sink_lines(spark, sf_dir):
    at, df = place(spark), documents(spark, sf_dir).select("value")
    writers.write_lines(df, at)
    back = spark.read.text(at)
    return back.join(df.withColumn("there", F.lit(True)), "value", "left").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("there", F.lit(False))).alias("same"))


@query("SELECT n_name AS value FROM nation")
def sink_raw_lines(spark, sf_dir):
    at = place(spark)
    writers.write_raw(compile_program(".s").rows(documents(spark, sf_dir)).select("value"), at)
    return spark.read.text(at)


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region""")
def sink_compact(spark, sf_dir):
    return writers.compact(read_table(spark, sf_dir, "region"))


@query("SELECT n_nationkey AS value FROM nation")
def database_column(spark, sf_dir):
    """JSON texts into a database table and back; the database that Spark brings, in the driver's process."""
    url, name, driver = "jdbc:derby:memory:docql;create=true", f"t{uuid.uuid4().hex[:12]}", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    writers.write_table(documents(spark, sf_dir).select("value"), url, name, **driver)
    rows = compile_program(".k").rows(readers.json_table(spark, url, name, "value", **driver))
    return rows.select(F.col("value").cast("int").alias("value"))


# Streams


def ran(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream gives for what is there now."""
    at = place(spark)
    spark.createDataFrame([], df.schema).write.parquet(at)
    streams.to_consumer(df, lambda rows, n: rows.write.mode("append").parquet(at), f"{at}-state", once=True, mode=mode).awaitTermination()
    return spark.read.parquet(at)


@query(K_OF_PROPS)
def stream_rows(spark, sf_dir):
    at = place(spark)
    props(spark, sf_dir).repartition(4).write.text(at)
    return ran(spark, streams.stream_rows(streams.json_line_stream(spark, at, 1), compile_program(".k"))).select("value")


@query("SELECT CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS BIGINT) AS key, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS VARCHAR) AS state, count(*) AS n FROM events GROUP BY 1")
def stream_state(spark, sf_dir):
    """A sum for each key across batches; the last state of each."""
    at = place(spark)
    props(spark, sf_dir).repartition(4).write.text(at)
    lines = streams.json_line_stream(spark, at, 1).withColumn("key", F.get_json_object("value", "$.k").cast("bigint") % 10)
    states = ran(spark, streams.running_fold(lines, "key", compile_program(".state + .value.k"), "0"), "update")
    return states.groupBy("key").agg(F.max_by("state", "n").alias("state"), F.max("n").alias("n"))


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = place(spark)
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(at)
    return spark.readStream.schema("ts timestamp, event_type string").parquet(at)


@query("SELECT event_type, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) AS windows FROM events GROUP BY 1")
def stream_windows(spark, sf_dir):
    """Counts by hour of event time; all windows, so in mode complete."""
    counts = ran(spark, streams.windowed_counts(timed(spark, sf_dir), "ts", "event_type", "1 hour", "1 day"), "complete")
    return counts.groupBy("event_type").agg(F.sum("n").alias("n"), F.count_distinct("window").alias("windows"))


@query(
    """WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts))
    SELECT event_type, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS n FROM g GROUP BY 1"""
)
def stream_sessions(spark, sf_dir):
    counts = ran(spark, streams.session_counts(timed(spark, sf_dir), "ts", "event_type", "30 minutes", "1 day"), "complete")
    return counts.groupBy("event_type").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


# Values


def variants(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, F.Column]:
    return documents(spark, sf_dir), F.parse_json("value")


@query(
    """SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS k, n_name AS s, CAST(n_nationkey AS DOUBLE) AS f, 3 AS third, 7 AS missing, CAST(n_nationkey AS VARCHAR) AS text, true AS yes,
    'array' AS kind_a, 'object' AS kind, 'number' AS kind_k, 'string' AS kind_s, 'null' AS kind_none, '"' || n_name || '"' AS needed FROM nation"""
)
def value_accessors(spark, sf_dir):
    df, v = variants(spark, sf_dir)
    kinds = [api.type_of(api.at(v, p)).alias(n) for p, n in (("/a", "kind_a"), ("", "kind"), ("/k", "kind_k"), ("/s", "kind_s"), ("/zz", "kind_none"))]
    return df.select(
        "n_nationkey", api.as_long(v, "/k").alias("k"), api.as_string(v, "/s").alias("s"), api.as_double(v, "/d/e/f").alias("f"), api.as_int(v, "/a/2").alias("third"), api.as_long(v, "/zz", 7).alias("missing"),
        api.as_string(v, "/k").alias("text"), (api.as_boolean(F.parse_json(F.lit("true")))).alias("yes"), *kinds, F.to_json(api.required(v, "/s")).alias("needed"),
    )


@query(
    """SELECT n_nationkey, n_nationkey + 1 AS changed, CAST('{"n_name":"' || n_name || '"}' AS VARCHAR) AS less, n_nationkey AS a, 2 AS b, n_nationkey AS deep_x, n_regionkey AS deep_y, 'z' AS deep_z,
    [n_nationkey, 9] AS made, 'q' AS built FROM nation"""
)
def value_updates(spark, sf_dir):
    df = read_table(spark, sf_dir, "nation")
    row = F.struct("n_nationkey", "n_name")
    one, two = F.struct(F.struct(F.col("n_nationkey").alias("x"), F.lit(0).alias("y")).alias("d")), F.struct(F.struct(F.col("n_regionkey").alias("y"), F.lit("z").alias("z")).alias("d"))
    types = [df.select(c.alias("c")).schema["c"].dataType for c in (one, two)]
    deep = api.deep_merge(one, two, *types)["d"]
    merged = api.merge(F.create_map(F.lit("a"), "n_nationkey"), F.create_map(F.lit("b"), F.lit(2)))
    return df.select(
        "n_nationkey", api.with_field(row, "n_nationkey", F.col("n_nationkey") + 1)["n_nationkey"].alias("changed"), F.to_json(api.without(row, "n_nationkey")).alias("less"), merged["a"].alias("a"), merged["b"].alias("b"),
        deep["x"].alias("deep_x"), deep["y"].alias("deep_y"), deep["z"].alias("deep_z"), api.array_of(F.col("n_nationkey"), 9).alias("made"), api.object_of(q="q")["q"].alias("built"),
    )


@query("SELECT n_nationkey, [1, n_nationkey, 3] AS items, ['e'] AS names, 3 AS size FROM nation")
def value_iteration(spark, sf_dir):
    df, v = variants(spark, sf_dir)
    items = api.elements(v, "/a")
    return df.select("n_nationkey", F.transform(items, lambda x: x.cast("int")).alias("items"), F.transform(api.entries(v, "/d"), lambda e: e["key"]).alias("names"), F.size(items).alias("size"))


@query("SELECT n_nationkey, '1' AS first, '[1,' || n_nationkey || ',3]' AS every FROM nation")
def path_first_and_array(spark, sf_dir):
    """A path's first match, and the array of all."""
    df, tree = documents(spark, sf_dir), compile_program("$.a[*]", "jsonpath").ast
    first, every = (Program("", of(tree)).rows(df, keep=("n_nationkey",)).select("n_nationkey", F.col("value").alias(name)) for of, name in ((sqljson.first_of, "first"), (sqljson.array_of, "every")))
    return first.join(every, "n_nationkey")


@query("SELECT n_nationkey, n_nationkey * 10 AS value FROM nation UNION ALL SELECT n_nationkey, n_nationkey * 100 FROM nation")
def registered_functions(spark, sf_dir):
    """A function of values, and a generator that gets its arguments unevaluated."""
    registry = Registry()
    registry.register("tenfold", 0, value_fn=lambda x: x * 10)
    registry.register("both", 2, generator_fn=lambda x, run, a, b: (y for g in (a, b) for y in run(g, x)))
    program = compile_program(".k | both(tenfold; tenfold | tenfold)", registry=registry)
    return program.rows(documents(spark, sf_dir), keep=("n_nationkey",)).select("n_nationkey", F.col("value").cast("int").alias("value"))


# The API and the command line, on the driver


@query("""SELECT * FROM (VALUES ('apply', '5'), ('apply_all', '[5,6]'), ('stream', '[1,2]'), ('inputs', '[1,2]'), ('variables', '7'), ('text', '".a"'), ('tiers', '"T1"'), ('error', '"refused"')) t(name, value)""")
def program_api(spark, sf_dir):
    field, outs = compile_program(".a"), compile_program("$t | map(.r_name)")
    try:
        compile_program(".a |")
        refused = "taken"
    except ProgramError:
        refused = "refused"
    found = {
        "apply": field.apply({"a": 5}),
        "apply_all": field.apply_all([{"a": 5}, {"a": 6}]),
        "stream": [*compile_program(".[]").stream([1, 2])],
        "inputs": compile_program("[inputs]").apply_null_input([1, 2])[0],
        "variables": compile_program("$x + 1").apply(None, variables={"x": 6}),
        "text": field.text,
        "tiers": outs.explain_tier(read_table(spark, sf_dir, "nation"), datasets={"t": read_table(spark, sf_dir, "region")})[0][0],
        "error": refused,
    }
    return spark.createDataFrame([(k, dumps(v)) for k, v in found.items()], "name string, value string")


REFUSED = ["$eval('1')", "a@$x.b", "a#$i.b", "%.a", "|$|{}|", "$f(?)", "$nonsense(1)", "1 +"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, 'refused')" for i in range(len(REFUSED))) + ") t(i, said)")
def jsonata_refused(spark, sf_dir):
    """What JSONata has and this package hasn't is an error, not another meaning."""

    def said(text: str) -> str:
        try:
            compile_program(text, "jsonata").apply({"a": [1]})
        except (ProgramError, JqError):
            return "refused"
        return "taken"

    return spark.createDataFrame([(i, said(text)) for i, text in enumerate(REFUSED)], "i int, said string")


@query(
    """SELECT * FROM (VALUES ('-c', '{"b":1,"a":[2]}', 0), ('-S', '{\n  "a": [\n    2\n  ],\n  "b": 1\n}', 0), ('-n', '3', 0), ('-r', 'x y', 0), ('-s', '[1,2]', 0), ('-R', '"1 2"', 0), ('--arg', '"v"', 0),
    ('--argjson', '[1]', 0), ('-f', '2', 0), ('-j', '12', 0), ('--tab', '{\\n\\t"a": 1\\n}', 0), ('halt', '', 0), ('halt_error', '1', 5), ('-e', '', 4), ('bad', '', 5)) t(option, output, status)""".replace("\\n", "' || chr(10) || '").replace("\\t", "' || chr(9) || '")
)
def command_line(spark, sf_dir):
    """Options of the command line, what they print, and the exit status."""
    with tempfile.TemporaryDirectory() as folder:
        paths = {}
        for name, text in (("o", '{"b":1,"a":[2]}'), ("two", "1 2"), ("s", '"x y"'), ("program", ".a[0]")):
            paths[name] = os.path.join(folder, name)
            with open(paths[name], "w", encoding="utf-8") as f:
                f.write(text)
        runs = [
            ("-c", ["-c", ".", paths["o"]]), ("-S", ["-S", ".", paths["o"]]), ("-n", ["-n", "1 + 2"]), ("-r", ["-r", ".", paths["s"]]), ("-s", ["-c", "-s", ".", paths["two"]]), ("-R", ["-R", ".", paths["two"]]),
            ("--arg", ["-n", "--arg", "x", "v", "$x"]), ("--argjson", ["-n", "-c", "--argjson", "x", "[1]", "$x"]), ("-f", ["-f", paths["program"], paths["o"]]),
            ("-j", ["-j", ".", paths["two"]]), ("--tab", ["--tab", "-n", "{a: 1}"]), ("halt", ["-n", "halt"]), ("halt_error", ["1, halt_error", paths["two"]]), ("-e", ["-e", "empty", paths["o"]]), ("bad", [".a |", paths["o"]]),
        ]
        rows = []
        for option, args in runs:
            out = io.StringIO()
            with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
                status = cli.main(args)
            rows.append((option, out.getvalue().rstrip("\n"), status))
    return spark.createDataFrame(rows, "option string, output string, status int")
