"""Programs on Spark: tiers against each other, plans, sources and sinks, streams, the command line, and SQL."""

import io
import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as contract
from docql import cli, queries
from docql.engine import Registry, Unsupported, compile_program
from docql.functions import api
from docql.operators.columns import COMPILE, Many, One, Scope
from docql.operators.dynamic import outputs, structures
from docql.functions.values import dumps
from docql.operators.ordkey import ordkey
from docql.sources import embedded, readers, writers
from docql.streaming import streams

DATA = "/root/testdata/sf0.001"
ROWS = [
    {"id": 1, "s": "a,b", "n": 2.5, "t": True, "xs": [3, 1, 2], "o": {"k": "v", "z": 1}, "os": [{"k": "a", "v": 1}, {"k": "b", "v": 2}]},
    {"id": 2, "s": "  B1 ", "n": -7.0, "t": False, "xs": [], "o": {"k": None, "z": 2}, "os": []},
    {"id": 3, "s": None, "n": None, "t": None, "xs": [5, None, 5], "o": {"k": "w", "z": None}, "os": [{"k": "a", "v": None}]},
    {"id": 4, "s": "1425599507", "n": 100.0, "t": True, "xs": [10], "o": {"k": "", "z": 0}, "os": [{"k": "c", "v": 3}]},
]
SCHEMA = "id long, s string, n double, t boolean, xs array<long>, o struct<k string, z long>, os array<struct<k string, v long>>"
#: Programs that have a column form; their outputs must be the interpreter's.
PROGRAMS = """
.id
.missing
.o.k
.xs[0], .xs[-1], .xs[9]
.xs[1:], .xs[:-1]
.s[1:3]
[.xs[] | . * 2]
[.xs[] | select(. > 1)]
.xs | map(. + 1)
.xs | length
.xs | add
.xs | sort
.xs | unique
.xs | reverse
.xs | min
.xs | max
.xs | any(. == 5)
.xs | all(. > 0)
.xs | index(5)
.xs | indices(5)
.xs | contains([5])
.xs | has(1)
.xs | first
[.xs | last]
.xs - [5]
.xs + [1]
.os | map(.k)
.os | map({k, w: (.v + 1)})
.os | sort_by(.k) | map(.v)
.os | group_by(.k) | map(length)
.os | unique_by(.k) | length
.os | max_by(.k)
.os | min_by(.k) | .k
.os[] | .k
[.os[] | select(.v == 2) | .k]
.id + 1, .id - 1, .id * 2, .id / 2, .id % 2
.id == 1, .id < 2, .n > 0, .n <= 100, .s == null, .s != "a"
.t and (.id > 0), (.t or false), (.t | not)
.n // 5
if .n > 0 then "pos" elif .n == null then "none" else "neg" end
{id, s, two: (.id * 2)}
{a: {b: .id}}
.id as $x | [.xs[] | . + $x]
reduce .xs[] as $x (0; . + ($x // 0))
[foreach .xs[] as $x (0; . + 1; [., $x])]
def f(g): g + 1; f(.id)
def f(g; $y): g * $y; f(.id; 3)
. as {id: $i, o: {z: $z}} | [$i, $z]
.o.z = 5 | .o
.o.z += 1 | .o
.id |= . * 2 | .id
del(.s, .n, .t, .xs, .os)
.o | keys
.o | has("k")
"\\(.id): \\(.o.z)"
.id | tostring
.o | tojson | length > 3
.xs | tojson
.id | type
[.xs[] | numbers]
[.xs[] | values]
[.xs[] | nulls]
[range(.id)]
[range(1; .id)]
[limit(2; .xs[])]
[first(.xs[])]
[.id, 2, 3] | IN([1, 2, 3], [9])
.id | IN(1, 2)
isempty(.xs[])
[[1, 2], [3]] | flatten
[[1, 2], [3]] | transpose
.xs | @csv
.id | floor
.id | sqrt, pow(.; 2), exp2
.id | [sin, cos] | map(. * 1000 | floor)
.id * 86400 | todate
.id * 86400 | strftime("%Y-%m-%d")
.id * 86400 | todate | fromdate
.id * 86400 | gmtime | mktime
.id * 86400 | dateadd("months"; 1)
""".strip().split("\n")
TEXTS = """
ascii_upcase
ascii_downcase
split(",")
split(",") | join("-")
test("b")
test("B"; "i")
startswith("a")
endswith("b")
ltrimstr("a")
rtrimstr("b")
trim
ltrim
rtrim
length
utf8bytelength
explode
gsub("[a-z]"; "x")
[scan("[a-z]")]
[splits(",")]
index("b")
contains("b")
@base64
@base64 | @base64d
@html
@uri
@json
@sh
try tonumber catch -1
. + "x"
. * 2
.[0:2]
""".strip().split("\n")


def one_number(v):
    return json.loads(json.dumps(v), parse_float=lambda t: int(float(t)) if float(t).is_integer() else float(t))


@pytest.mark.parametrize("program", [*PROGRAMS, *(f".s | {t}" for t in TEXTS)])
def test_columns_agree_with_the_interpreter(spark, program):
    rows = ROWS if not program.startswith(".s") else [r for r in ROWS if r["s"] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    p = compile_program(program)
    scope = Scope(One(F.struct(*df.columns), df.schema), {}, {})
    out = COMPILE(p.ast, scope)
    got = df.select(F.to_json(F.struct(out.col.alias("v")), {"ignoreNullFields": "false"}).alias("v")).collect()
    for r, x in zip(rows, got, strict=True):
        want = [*p.stream(r)]
        v = one_number(json.loads(x["v"])["v"])
        assert (v if isinstance(out, Many) else [v]) == one_number(want), (program, r)


#: Programs over a dataset; what they give must be what the interpreter gives of the array of its rows.
DATASET_PROGRAMS = """
map(.id)
map(select(.v > 3)) | length
map(select(.v < 3)) | map(.id)
map(select(.v <= 3 and .k != "a")) | map(.id)
map(select(.k == null)) | map(.id)
map(select(.t)) | map(.id)
map(select(.t | not)) | map(.id)
group_by(.k) | map({k: .[0].k, n: length, s: (map(.v) | add), m: (map(.v) | max), mi: (map(.v) | min)})
group_by(.k) | map({k: .[0].k, u: (map(.v) | unique | length)})
group_by(.t) | map({t: .[0].t, all: (map(.v > 2) | all), any: (map(.v > 7) | any)})
group_by(.v) | map(length)
group_by(.k, .t) | length
group_by(.k) | length
[.[] | .v] | add
[.[] | .v] | max
[.[] | .v] | min
map(.v) | unique
map(.k) | unique | length
sort_by(.v, .id) | map(.id)
sort_by(-.id) | .[:3] | map(.id)
sort_by(.id) | .[2:5] | map(.id)
sort_by(.id) | first | .id
sort_by(.id) | .[3].id
sort_by(.id) | reverse | .[:2] | map(.id)
max_by(.x) | .id
min_by(.x) | .id
.[] | select(.id < 3) | {id, d: (.x * 2)}
.[] | select(.id == 1) | .id, .x
[.[] | {k, v}] | unique | length
map(select(.k | IN($o[] | .k))) | map(.id)
map(select(.k | IN($o[] | .k) | not)) | map(.id)
.[] as $a | $o[] as $b | select($a.k == $b.k) | {i: $a.id, w: $b.w}
.[] as $a | $o[] as $b | select($a.k == $b.k and $a.v > $b.w) | [$a.id, $b.w]
map({k}) - ($o | map({k})) | length
(map({k}) + ($o | map({k}))) | length
reduce .[] as $r (0; . + $r.id)
reduce .[] as $r (10; . + ($r.v // 0))
length
map(.x) | add / length
{n: length, s: (map(.v) | add)}
map(.v) | map(. + 1)
[.[] | select(.v != null) | .v * 2] | add
map(if .v > 4 then "hi" elif .v == null then "none" else "lo" end) | group_by(.) | map({b: .[0], n: length})
def big: select(.v > 4); map(big) | map(.id)
5 as $n | map(select(.v > $n)) | map(.id)
any(.[]; .v > 7)
all(.[]; .id >= 0)
map(.t) | all
map(.t) | any
[limit(3; sort_by(.id) | .[] | .id)]
unique_by(.k) | map(.k)
map(.k | length) | add
map([.id, .v]) | map(.[1]) | add
map({id, l: [range(.id % 3)]}) | map(.l | length) | add
map(.k | tostring) | unique
map(.id) | sort | .[:2]
map(.v) | sort
""".strip().split("\n")


def test_datasets_agree_with_the_interpreter(spark):
    rows = [{"id": i, "k": ["a", "b", None, "c"][i % 4], "v": [None, 5, 3, 8, 1][i % 5], "x": i * 1.5, "t": [True, False, None][i % 3]} for i in range(23)]
    other = [{"k": "a", "w": 1}, {"k": "b", "w": 2}, {"k": "zz", "w": 3}, {"k": None, "w": 4}]
    df, side = spark.createDataFrame(rows, "id long, k string, v long, x double, t boolean"), spark.createDataFrame(other, "k string, w long")
    for program in DATASET_PROGRAMS:
        p = compile_program(program)
        want = [*p.stream(rows, variables={"o": other})]
        want = want[0] if len(want) == 1 and isinstance(want[0], list) else want
        out = p.dataset(df, datasets={"o": side}, order=("id",))
        got = [r["value"] if out.columns == ["value"] else r.asDict(True) for r in out.collect()]
        assert sorted(map(dumps, one_number(got))) == sorted(map(dumps, one_number(want))), program


def test_interpreter_runs_on_spark(spark):
    df = readers.from_values(spark, [{"a": 1}, {"a": "x"}, 5])
    p = compile_program(".a + 1")
    got = outputs(df, p.ast, mode="permissive").collect()
    assert [(r["value"], r["_error"] is None) for r in got] == [("2", True), (None, False), (None, False)]
    with pytest.raises(Exception, match="cannot be added|Cannot index"):
        p.rows(df).collect()
    assert readers.to_values(compile_program("..|numbers").rows(df)) == [1, 5]
    variant = df.select(F.parse_json("value").alias("value"))
    assert readers.to_values(compile_program("[.]|length").rows(variant)) == [1, 1, 1]
    assert structures(readers.from_values(spark, [{"a": 1}, {"a": 1.5, "b": "x"}])).first()[0] == '{"a":"number","b":"string"}'


def test_a_dataset_program_may_fall_to_the_interpreter(spark):
    df = spark.createDataFrame([(1, "a1"), (2, "b22")], "id long, s string")
    p = compile_program(".[] | {id, hit: (.s | capture(\"([a-z])(\\\\d)\"))}")
    assert [json.loads(r["value"]) for r in p.dataset(df).collect()] == [{"id": 1, "hit": {"1": "a", "2": "1"}}, {"id": 2, "hit": {"1": "b", "2": "2"}}]
    assert ("T3", "Build") in p.explain_tier()
    p = compile_program("map(select(.id > 1)) | length")
    p.dataset(df)
    assert {t for t, _ in p.explain_tier()} <= {"T1", "T2"}
    p = compile_program("[.[].id] | transpose? // reverse, ($o | length)")
    assert [r["value"] for r in p.dataset(df, datasets={"o": df}, order=("id",)).collect()] == ["[2,1]", "2"]
    assert p.explain_tier() == [("T3", "whole dataset")]
    with pytest.raises(Unsupported, match="too many"):
        compile_program("reverse").dataset(df, whole=10)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 as b", "id * 3 as c", "cast(id as string) as d").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = compile_program("map(select(.b > 50 and .c < 90)) | group_by(.b % 3) | map({k: (.[0].b % 3), n: length})")
    plan = compile_program("map(select(.b > 50 and .d == \"7\") | {b})").dataset(df)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(b,50)" in plan and "ReadSchema: struct<b:bigint,d:string>" in plan
    assert out is not None
    joined = compile_program(".[] as $a | $o[] as $b | select($a.id == $b.id) | {x: $a.b, y: $b.c}").dataset(df, datasets={"o": df})
    assert "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


def test_registry_variables_and_null_input(spark):
    r = Registry()
    r.register("twice", 0, value_fn=lambda x: x * 2)
    r.register("plus3", 1, column_fn=lambda c, a: c + a + 3, returns=T.LongType())
    assert compile_program("twice", registry=r).apply(4) == 8
    df = spark.createDataFrame([(1,)], "v long")
    assert df.select(compile_program("plus3(1)", registry=r).column(df, "v")).first()[0] == 5
    p = compile_program(". + $d")
    assert p.apply(1, variables={"d": 2}) == 3 and p.apply_all([1, 2], variables={"d": 1}) == [2, 3]
    seen = []
    p.apply_all([1], seen.append, variables={"d": 1})
    assert seen == [2]
    assert compile_program("[inputs]").apply_null_input([1, 2]) == [[1, 2]]
    assert compile_program("$sum(o.p)", "jsonata").rows(spark.createDataFrame([([(1,), (2,)],)], "o array<struct<p:long>>").select(F.struct("o").alias("value"))).first()[0] == 3


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":1}\n{"a":\n2} [3]\n')
    (tmp_path / "b.jsonl").write_text('{"a":1}\n\n{"a":"é\\"x"}\n')
    docs = readers.json_documents(spark, str(tmp_path / "a.json"))
    assert [r["value"] for r in docs.orderBy("_pos").collect()] == ['{"a":1}', '{"a":2}', "[3]"]
    (tmp_path / "many.json").write_text(" ".join(map(str, range(2500))))
    assert [tuple(r) for r in readers.json_documents(spark, str(tmp_path / "many.json")).select("_pos", "value").orderBy("_pos").collect()] == [(i, str(i)) for i in range(2500)]
    lines = readers.json_lines(spark, str(tmp_path / "b.jsonl"))
    assert lines.count() == 2
    assert json.loads(readers.slurp(docs, order=["_pos"]).first()[0]) == [{"a": 1}, {"a": 2}, [3]]
    with pytest.raises(ValueError, match="too many"):
        readers.slurp(docs, limit=3)
    assert json.loads(readers.raw_lines(spark, str(tmp_path / "b.jsonl")).collect()[2][0]) == '{"a":"é\\"x"}'
    assert readers.json_bytes(spark, str(tmp_path / "b.jsonl")).first()["value"].startswith('{"a":1}')
    assert readers.typed(lines, "a string").collect()[1]["a"] == 'é"x' and lines.select(readers.as_variant()).count() == 2
    assert readers.to_values(readers.null_input(spark)) == [None]
    writers.write_lines(lines, str(tmp_path / "out"))
    assert readers.json_lines(spark, str(tmp_path / "out")).count() == 2
    writers.write_lines(spark.createDataFrame([(1, None)], "a long, b string"), str(tmp_path / "rows"))
    assert spark.read.text(str(tmp_path / "rows")).first()[0] == '{"a":1,"b":null}'
    writers.write_raw(readers.from_values(spark, ["x y", 5]), str(tmp_path / "raw"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "raw")).collect()) == ["5", "x y"]
    assert [*writers.texts(readers.from_values(spark, [{"b": 1}]), indent="\t")] == ['{\n\t"b": 1\n}']
    assert "\x1b[" in writers.shown({"a": [None]}, color=True)


def test_tables_within_the_process(spark, monkeypatch):
    monkeypatch.setattr(embedded, "LOOK", 10)
    monkeypatch.setattr(embedded, "PART_BYTES", 1_000)
    url, driver = "jdbc:derby:memory:tests;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    texts = ['"a\\nb"', "", None, '{"k":"é😀\\\\ \'q\' ?"}', "two\nlines\r\n", json.dumps("x" * 100_000), *map(str, range(60))]
    df = spark.createDataFrame([(t,) for t in texts], "value string").repartition(3)
    read = lambda name, column="value": sorted((r["value"] for r in readers.json_table(spark, url, name, column, **driver).collect()), key=repr)
    writers.write_table(df, url, "t", **driver)
    assert read("t") == sorted(texts, key=repr)
    with pytest.raises(AnalysisException):
        writers.write_table(df, url, "t", **driver)
    writers.write_table(df, url, "t", mode="ignore", **driver)
    assert len(read("t")) == len(texts)
    writers.write_table(df.limit(1), url, "t", mode="append", **driver)
    assert len(read("t")) == len(texts) + 1
    writers.write_table(df.limit(0), url, "t", mode="overwrite", **driver)
    assert read("t") == []
    made = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    made.createStatement().execute("CREATE TABLE u (value CLOB, n DECIMAL(9,2) DEFAULT 1.5, ts TIMESTAMP DEFAULT '2020-01-02 03:04:05', b VARCHAR(9) FOR BIT DATA DEFAULT X'C3A9')")
    made.close()
    writers.write_table(df, url, "u", mode="append", **driver)
    assert read("u") == sorted(texts, key=repr) and set(read("u", "b")) == {"é"}
    rows = readers.json_table(spark, url, "u", "VALUE", **driver).select("N", F.col("TS").cast("string")).distinct()
    assert [tuple(map(str, r)) for r in rows.collect()] == [("1.50", "2020-01-02 03:04:05")]
    broken = spark.range(60).select(F.when(F.col("id") < 59, "1").otherwise(F.raise_error(F.lit("broken"))).cast("string").alias("value"))
    with pytest.raises(Exception, match="broken"):
        writers.write_table(broken.repartition(2, "value"), url, "t", mode="append", **driver)
    assert read("t") == []


def test_which_databases_are_within_the_process():
    assert all(map(embedded.in_process, ["jdbc:derby:memory:a", "jdbc:derby:/tmp/a", "jdbc:h2:mem:a", "jdbc:hsqldb:file:a", "jdbc:sqlite:a.db", "jdbc:duckdb:"]))
    assert not any(map(embedded.in_process, ["jdbc:derby://h:1527/a", "jdbc:h2:tcp://h/a", "jdbc:hsqldb:hsql://h/a", "jdbc:postgresql://h/a", "jdbc:mysql://h/a"]))


def test_order_keys_and_column_helpers(spark):
    values = [None, False, True, float("-inf"), -3, 2.5, 10**17, 10**17 + 1, "", "a", "b", [], [1], {}, {"a": 1}]
    df = readers.from_values(spark, values[::-1])
    assert [r[0] for r in df.orderBy(ordkey("value")).select("value").collect()][4:] == [dumps(v) for v in values[4:]]
    v = F.parse_json(F.lit('{"a":[{"b/c":"7"}],"n":null}'))
    row = spark.range(1).select(api.as_string(v, "/a/0/b~1c"), api.as_long(v, "/a/0/b~1c"), api.as_long(v, "/x", 4), api.type_of(api.at(v, "/a")), api.type_of(v), api.type_of(api.at(v, "/n"))).first()
    assert [*row] == ["7", 7, 4, "array", "object", "null"]
    with pytest.raises(Exception, match="missing"):
        spark.range(1).select(api.required(v, "/zz").cast("string")).collect()
    m = spark.range(1).select(api.merge(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)))).first()[0]
    assert m == {"a": 2, "b": 3}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"k":"a","v":1}\n{"k":"b","v":2}\n')
    (source / "2.json").write_text('{"k":"a","v":3}\nnot json\n')
    lines = streams.json_line_stream(spark, str(source), files_per_trigger=1)
    rows = streams.stream_rows(lines, compile_program(".v * 10"))
    got = []
    streams.to_consumer(rows, lambda df, n: got.extend(df.collect()), str(tmp_path / "c1"), once=True).awaitTermination(120)
    assert sorted(r["value"] for r in got if r["value"]) == ["10", "20", "30"] and sum(r["_error"] is not None for r in got) == 1
    keyed = lines.where("value like '{%'").select(F.get_json_object("value", "$.k").alias("k"), "value")
    folded = streams.running_fold(keyed, "k", compile_program(".state + .value.v"))
    last = {}
    writer = folded.writeStream.outputMode("update").foreachBatch(lambda df, n: last.update({r["k"]: (r["state"], r["n"]) for r in df.collect()}))
    writer.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert last == {"a": ("4", 2), "b": ("2", 1)}


def run_cli(monkeypatch, capsys, text, *args):
    monkeypatch.setattr(sys, "stdin", io.StringIO(text))
    code = cli.main([*args])
    return code, capsys.readouterr().out


def test_command_line(monkeypatch, capsys, tmp_path):
    def go(*a):
        return run_cli(monkeypatch, capsys, *a)

    assert go('{"b":1,"a":2}', ".") == (0, '{\n  "b": 1,\n  "a": 2\n}\n')
    assert go('{"b":1,"a":2}', "-S", "--indent", "1", ".") == (0, '{\n "a": 2,\n "b": 1\n}\n')
    assert go('{"b":1}', "-c", ".") == (0, '{"b":1}\n') and go("[1]", "--tab", ".") == (0, "[\n\t1\n]\n")
    assert go('"x" "y"', "-r", ".") == (0, "x\ny\n") and go('"x" "y"', "-j", ".") == (0, "xy")
    assert go("1 2", "-s", "-c", ".") == (0, "[1,2]\n") and go("a\nb", "-R", ".") == (0, '"a"\n"b"\n') and go("", "-n", "1+1") == (0, "2\n")
    assert go("", "-n", "--arg", "x", "1", "--argjson", "y", "[2]", "-c", "[$x,$y]") == (0, '["1",[2]]\n')
    assert go("1", "-e", "empty") == (4, "") and go("1", "error")[0] == 5 and go("1", "1 +")[0] == 5 and go("null", '"m" | halt_error(3)')[0] == 3
    (tmp_path / "p.jq").write_text(". * 2 # double")
    (tmp_path / "d.json").write_text("4")
    assert go("", "-f", str(tmp_path / "p.jq"), str(tmp_path / "d.json")) == (0, "8\n")
    assert go('{"a":[1,2]}', "--language", "jsonata", "$sum(a)") == (0, "3\n")
    assert go("{}", "-C", "-c", ".")[1].startswith("\x1b")


needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are missing")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def tidy(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(tidy, v)) if isinstance(v, list) else v


@needs_data
@pytest.mark.parametrize("name", [*queries.oracle_sql()])
def test_queries_equal_their_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    found = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(tidy(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(tidy(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr) == want


@needs_data
def test_database_of_the_driver_on_a_cluster(tmp_path):
    """Executors in processes of their own, which have no part in a database in the driver's memory."""
    text = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
made = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", {tmp_path.as_uri()!r})
spark = made.config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").getOrCreate()
from docql import queries
print("FOUND", sorted(r[0] for r in queries.queries()["database_column"](spark, {DATA!r}).collect()))
"""
    run = subprocess.run([sys.executable, "-c", text], cwd=tmp_path, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, text=True, timeout=300)
    assert f"FOUND {[*range(25)]}" in run.stdout, run.stderr[-3000:]


@needs_data
def test_contract(spark):
    assert contract.entry(spark).count() == 3
    assert set(contract.oracle_sql()) <= set(contract.queries())
