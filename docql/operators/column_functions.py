"""Builtin functions of tier 2, one entry for each name and arity: (compiler, argument nodes, scope) to a compiled expression."""

from __future__ import annotations

import math
import string as letters
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docql.operators.columns import BOOL, DOUBLE, LONG, NULL, STRING, Many, One, Unsupported, add, common, compare, is_array, is_number, literal, many, one, split, truthy
from docql.sources.tables import seconds_of

FUNCTIONS: dict[tuple[str, int], Callable] = {}


def on_value(name: str, arity: int = 0):
    """A function of the input and of arguments' single values, given as One."""

    def add_it(f):
        def run(compiler, args, s):
            given = [one(compiler(a, s)) for a in args]
            return compiler.each(s.dot, lambda v: f(v, *given))

        FUNCTIONS[name, arity] = run
        return f

    return add_it


def with_nodes(name: str, arity: int):
    """A function that compiles its arguments itself: (compiler, one input, argument nodes, scope)."""

    def add_it(f):
        FUNCTIONS[name, arity] = lambda compiler, args, s: compiler.each(s.dot, lambda v: f(compiler, v, args, s))
        return f

    return add_it


def want(v: One, test: Callable[[T.DataType], bool], what: str) -> One:
    if not test(v.type):
        raise Unsupported(what)
    return v


def array(v: One) -> One:
    return want(v, is_array, "an array is needed")


def text(v: One) -> One:
    return want(v, lambda t: isinstance(t, T.StringType), "a string is needed")


def number(v: One) -> One:
    return want(v, is_number, "a number is needed")


def constant(v: One, kind: type = str):
    if not isinstance(v.literal, kind):
        raise Unsupported("the argument must be constant")
    return v.literal


# Types


@on_value("length")
def length(v):
    if isinstance(v.type, T.StringType):
        return One(F.coalesce(F.length(v.col), F.lit(0)).cast("long"), LONG)
    if isinstance(v.type, (T.ArrayType, T.MapType)):
        return One(F.when(v.col.isNull(), 0).otherwise(F.size(v.col)).cast("long"), LONG)
    if isinstance(v.type, T.StructType):
        return literal(len(v.type.fields))
    return One(F.coalesce(F.abs(number(v).col), F.lit(0).cast(v.type)), v.type)


on_value("utf8bytelength")(lambda v: One(F.octet_length(text(v).col).cast("long"), LONG))
on_value("not")(lambda v: One(~truthy(v), BOOL))
for _name, _value in (("null", None), ("true", True), ("false", False), ("nan", math.nan), ("infinite", math.inf), ("have_decnum", True), ("input_line_number", None)):
    on_value(_name)(lambda v, x=_value: literal(x))
NAMES = ((T.NullType, "null"), (T.BooleanType, "boolean"), (T.NumericType, "number"), (T.StringType, "string"), (T.ArrayType, "array"), ((T.StructType, T.MapType), "object"))


def type_name(t: T.DataType) -> str:
    for kinds, name in NAMES:
        if isinstance(t, kinds):
            return name
    raise Unsupported(f"the type {t.simpleString()}")


on_value("type")(lambda v: One(F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(type_name(v.type))), STRING))
FUNCTIONS["tostring", 0] = lambda c, args, s: c.each(s.dot, lambda v: One(c.text(v), STRING))
FUNCTIONS["tojson", 0] = lambda c, args, s: c.each(s.dot, lambda v: One(c.json(v), STRING))
on_value("tonumber")(lambda v: v if is_number(v.type) else One(text(v).col.cast("double"), DOUBLE))
on_value("toboolean")(lambda v: v if isinstance(v.type, T.BooleanType) else One(F.when(text(v).col.isin("true", "false"), v.col == "true").otherwise(F.raise_error(F.lit("cannot be parsed as a boolean")).cast("boolean")), BOOL))
on_value("ascii")(lambda v: One(F.chr(number(v).col), STRING))


def only(test: Callable[[One], Column | bool]):
    def run(compiler, args, s):
        def keep(v: One) -> Many:
            t = test(v)
            empty = F.array().cast(T.ArrayType(v.type))
            return Many(F.when(t if isinstance(t, Column) else F.lit(t), F.array(v.col)).otherwise(empty), v.type)

        if isinstance(s.dot, Many):
            return Many(F.filter(s.dot.col, lambda x: t if isinstance(t := test(One(x, s.dot.type)), Column) else F.lit(t)), s.dot.type)
        return keep(s.dot)

    return run


def of_kind(*names: str):
    return only(lambda v: v.col.isNotNull() if type_name(v.type) in names else False)


for _name, _kinds in {"booleans": ("boolean",), "numbers": ("number",), "strings": ("string",), "arrays": ("array",), "objects": ("object",), "iterables": ("array", "object")}.items():
    FUNCTIONS[_name, 0] = of_kind(*_kinds)
FUNCTIONS["nulls", 0] = only(lambda v: v.col.isNull())
FUNCTIONS["values", 0] = only(lambda v: v.col.isNotNull())
FUNCTIONS["scalars", 0] = only(lambda v: v.col.isNull() if type_name(v.type) in ("array", "object") else True)
FUNCTIONS["empty", 0] = lambda c, args, s: Many(F.array(), NULL)


@with_nodes("select", 1)
def select(c, v, args, s):
    return Many(F.when(truthy(one(c(args[0], s.at(v)))), F.array(v.col)).otherwise(F.array().cast(T.ArrayType(v.type))), v.type)


# Arrays


@with_nodes("map", 1)
def map_(c, v, args, s):
    out = many(c.each(Many(array(v).col, v.type.elementType), lambda x: c(args[0], s.at(x))) if not _is_select(args[0]) else Many(F.filter(v.col, lambda x: truthy(one(c(args[0].args[0], s.at(One(x, v.type.elementType)))))), v.type.elementType))
    return One(out.col, T.ArrayType(out.type))


def _is_select(n) -> bool:
    return getattr(n, "name", None) == "select" and len(getattr(n, "args", ())) == 1


@with_nodes("map_values", 1)
def map_values(c, v, args, s):
    if isinstance(v.type, T.MapType):
        t = one(c(args[0], s.at(One(F.lit(None).cast(v.type.valueType), v.type.valueType)))).type
        return One(F.transform_values(v.col, lambda k, x: one(c(args[0], s.at(One(x, v.type.valueType)))).col), T.MapType(STRING, t))
    return map_(c, v, args, s)


def total(v: One) -> One:
    t = v.type.elementType
    if is_number(t):
        kind = LONG if isinstance(t, T.IntegralType) else DOUBLE
        return One(F.aggregate(v.col, F.lit(None).cast(kind), lambda a, x: F.coalesce(a + x.cast(kind), a, x.cast(kind))), kind)
    return One(F.aggregate(v.col, F.lit(None).cast(t), lambda a, x: add(One(a, t), One(x, t)).col), t)


on_value("add")(lambda v: total(array(v)))


@with_nodes("add", 1)
def add_of(c, v, args, s):
    m = many(c(args[0], s.at(v)))
    return total(One(m.col, T.ArrayType(m.type)))


def quantify(name: str, every: bool):
    def over(col: Column, t: T.DataType, test) -> One:
        f = F.forall if every else F.exists
        return One(F.coalesce(f(col, lambda x: test(One(x, t))), F.lit(every)), BOOL)

    FUNCTIONS[name, 0] = lambda c, args, s: c.each(s.dot, lambda v: over(array(v).col, v.type.elementType, truthy))
    FUNCTIONS[name, 1] = lambda c, args, s: c.each(s.dot, lambda v: over(array(v).col, v.type.elementType, lambda x: truthy(one(c(args[0], s.at(x))))))

    def generated(c, args, s):
        def run(v):
            m = many(c(args[0], s.at(v)))
            return over(m.col, m.type, lambda x: truthy(one(c(args[1], s.at(x)))))

        return c.each(s.dot, run)

    FUNCTIONS[name, 2] = generated


quantify("any", False)
quantify("all", True)


@on_value("min")
def least(v):
    array(v)
    return One(F.when(F.exists(v.col, lambda x: x.isNull()), F.lit(None)).otherwise(F.array_min(v.col)), v.type.elementType)


on_value("max")(lambda v: One(F.array_max(array(v).col), v.type.elementType))
on_value("sort")(lambda v: One(F.sort_array(array(v).col), v.type))
on_value("reverse")(lambda v: One(F.reverse(v.col), v.type) if isinstance(v.type, T.StringType) else One(F.reverse(array(v).col), v.type))
on_value("unique")(lambda v: One(F.sort_array(F.array_distinct(array(v).col)), v.type))


def keyed(c, v, node, s) -> tuple[Column, T.DataType]:
    """Elements as structs (key, place, element), to be ordered by them."""
    t = array(v).type.elementType
    key = lambda x: one(c(node, s.at(One(x, t)))).col
    return F.transform(v.col, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))), t


@with_nodes("sort_by", 1)
def sort_by(c, v, args, s):
    pairs, t = keyed(c, v, args[0], s)
    return One(F.transform(F.sort_array(pairs), lambda e: e["x"]), T.ArrayType(t))


@with_nodes("min_by", 1)
def min_by(c, v, args, s):
    pairs, t = keyed(c, v, args[0], s)
    return One(F.get(F.sort_array(pairs), F.lit(0))["x"], t)


@with_nodes("max_by", 1)
def max_by(c, v, args, s):
    pairs, t = keyed(c, v, args[0], s)
    return One(F.array_max(pairs)["x"], t)


@with_nodes("unique_by", 1)
def unique_by(c, v, args, s):
    pairs, t = keyed(c, v, args[0], s)
    first = F.filter(pairs, lambda e, i: ~F.coalesce(F.exists(F.slice(pairs, F.lit(1), i), lambda o: o["k"].eqNullSafe(e["k"])), F.lit(False)))
    return One(F.transform(first, lambda e: e["x"]), T.ArrayType(t))


@with_nodes("group_by", 1)
def group_by(c, v, args, s):
    pairs, t = keyed(c, v, args[0], s)
    keys = F.sort_array(F.array_distinct(F.transform(pairs, lambda e: e["k"])))
    return One(F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda e: e["k"].eqNullSafe(k)), lambda e: e["x"])), T.ArrayType(T.ArrayType(t)))


def flat(v: One, depth: int) -> One:
    while depth and is_array(array(v).type.elementType):
        v, depth = One(F.flatten(v.col), v.type.elementType), depth - 1
    return v


on_value("flatten")(lambda v: flat(v, -1))
on_value("flatten", 1)(lambda v, n: flat(v, constant(n, int)))


@on_value("transpose")
def transpose(v):
    rows = array(v)
    width = F.coalesce(F.array_max(F.transform(rows.col, F.size)), F.lit(0))
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    return One(F.transform(places, lambda i: F.transform(rows.col, lambda r: F.get(r, i))), rows.type)


@with_nodes("range", 1)
def range_to(c, v, args, s):
    return range_from(c, v, (None, args[0]), s)


@with_nodes("range", 2)
def range_from(c, v, args, s):
    a = one(c(args[0], s.at(v))).col.cast("long") if args[0] is not None else F.lit(0).cast("long")
    b = one(c(args[1], s.at(v))).col.cast("long")
    return Many(F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>")), LONG)


@with_nodes("first", 1)
def first_of(c, v, args, s):
    m = many(c(args[0], s.at(v)))
    return Many(F.slice(m.col, 1, 1), m.type)


@with_nodes("last", 1)
def last_of(c, v, args, s):
    m = many(c(args[0], s.at(v)))
    return Many(F.when(F.size(m.col) > 0, F.slice(m.col, -1, 1)).otherwise(m.col), m.type)


on_value("first")(lambda v: Many(F.slice(array(v).col, 1, 1), v.type.elementType))
on_value("last")(lambda v: Many(F.when(F.size(array(v).col) > 0, F.slice(v.col, -1, 1)).otherwise(v.col), v.type.elementType))


@with_nodes("limit", 2)
def limit(c, v, args, s):
    n, m = one(c(args[0], s.at(v))), many(c(args[1], s.at(v)))
    return Many(F.slice(m.col, F.lit(1), F.greatest(n.col.cast("int"), F.lit(0))), m.type)


@with_nodes("skip", 2)
def skip(c, v, args, s):
    n, m = one(c(args[0], s.at(v))), many(c(args[1], s.at(v)))
    return Many(F.slice(m.col, n.col.cast("int") + 1, F.size(m.col)), m.type)


@with_nodes("nth", 2)
def nth(c, v, args, s):
    n, m = one(c(args[0], s.at(v))), many(c(args[1], s.at(v)))
    return Many(F.slice(m.col, n.col.cast("int") + 1, F.lit(1)), m.type)


@with_nodes("isempty", 1)
def isempty(c, v, args, s):
    return One(F.size(many(c(args[0], s.at(v))).col) == 0, BOOL)


@with_nodes("IN", 1)
def in_(c, v, args, s):
    m = many(c(args[0], s.at(v)))
    return One(F.coalesce(F.exists(m.col, lambda x: x.eqNullSafe(v.col)), F.lit(False)), BOOL)


@with_nodes("IN", 2)
def in_both(c, v, args, s):
    a, b = many(c(args[0], s.at(v))), many(c(args[1], s.at(v)))
    return One(F.coalesce(F.exists(a.col, lambda x: F.exists(b.col, lambda y: x.eqNullSafe(y))), F.lit(False)), BOOL)


def places(v: One, part: One) -> Column:
    if isinstance(v.type, T.StringType):
        raise Unsupported("places in a string")
    array(v)
    size = F.size(v.col)
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    if is_array(part.type):
        n = F.size(part.col)
        return F.filter(every, lambda i: (n > 0) & (i + n <= size) & F.slice(v.col, i + 1, n).eqNullSafe(part.col))
    return F.filter(every, lambda i: F.get(v.col, i).eqNullSafe(part.col))


on_value("indices", 1)(lambda v, p: One(places(v, p).cast("array<bigint>"), T.ArrayType(LONG)))


@on_value("index", 1)
def index(v, p):
    if isinstance(v.type, T.StringType):
        return One(F.nullif(F.instr(v.col, p.col) if p.literal is None else F.locate(p.literal, v.col), F.lit(0)).cast("long") - 1, LONG)
    return One(F.get(places(v, p), F.lit(0)).cast("long"), LONG)


on_value("rindex", 1)(lambda v, p: One(F.array_max(places(v, p)).cast("long"), LONG))


def contains(v: One, w: One) -> Column:
    if isinstance(v.type, T.StringType) and isinstance(w.type, T.StringType):
        return F.contains(v.col, w.col)
    if is_array(v.type) and is_array(w.type):
        a, b = v.type.elementType, w.type.elementType
        return F.forall(w.col, lambda y: F.exists(v.col, lambda x: contains(One(x, a), One(y, b))))
    if isinstance(v.type, T.StructType) and isinstance(w.type, T.StructType):
        out = F.lit(True)
        for f in w.type.fields:
            if f.name not in v.type.names:
                return F.lit(False)
            out = out & contains(One(v.col[f.name], v.type[f.name].dataType), One(w.col[f.name], f.dataType))
        return out
    return compare("==", v, w).col


on_value("contains", 1)(lambda v, w: One(contains(v, w), BOOL))
on_value("inside", 1)(lambda v, w: One(contains(w, v), BOOL))


@on_value("bsearch", 1)
def bsearch(v, w):
    below = F.size(F.filter(array(v).col, lambda x: x < w.col))
    return One(F.when(F.array_contains(v.col, w.col), below).otherwise(-1 - below).cast("long"), LONG)


@on_value("combinations")
def combinations(v):
    raise Unsupported("combinations of an array whose length isn't known")


# Objects


@on_value("keys")
def keys(v):
    if isinstance(v.type, T.MapType):
        return One(F.sort_array(F.map_keys(v.col)), T.ArrayType(STRING))
    if isinstance(v.type, T.StructType):
        return One(F.array(*map(F.lit, sorted(v.type.names))), T.ArrayType(STRING))
    n = F.size(array(v).col).cast("long")
    return One(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG))


on_value("keys_unsorted")(lambda v: One(F.map_keys(v.col), T.ArrayType(STRING)) if isinstance(v.type, T.MapType) else One(F.array(*map(F.lit, v.type.names)), T.ArrayType(STRING)) if isinstance(v.type, T.StructType) else _no("keys"))


def _no(what: str):
    raise Unsupported(what)


@on_value("has", 1)
def has(v, k):
    if isinstance(v.type, T.MapType):
        return One(F.map_contains_key(v.col, k.col), BOOL)
    if isinstance(v.type, T.StructType):
        return literal(constant(k) in v.type.names)
    return One((number(k).col >= 0) & (k.col < F.size(array(v).col)), BOOL)


on_value("in", 1)(lambda k, v: has(v, k))
ENTRY = lambda t: T.StructType([T.StructField("key", STRING), T.StructField("value", t)])


@on_value("to_entries")
def to_entries(v):
    if isinstance(v.type, T.MapType):
        return One(F.map_entries(v.col), T.ArrayType(ENTRY(v.type.valueType)))
    want(v, lambda t: isinstance(t, T.StructType), "an object is needed")
    t: T.DataType = NULL
    for f in v.type.fields:
        t = common(t, f.dataType)
    return One(F.array(*(F.struct(F.lit(f.name).alias("key"), v.col[f.name].cast(t).alias("value")) for f in v.type.fields)), T.ArrayType(ENTRY(t)))


def as_map(v: One) -> One:
    t = array(v).type.elementType
    want(One(v.col, t), lambda t: isinstance(t, T.StructType) and "value" in t.names and ("key" in t.names or "name" in t.names), "entries are needed")
    key = "key" if "key" in t.names else "name"
    pairs = F.transform(v.col, lambda e: F.struct(e[key].cast("string"), e["value"]))
    # Of equal keys the last one's value holds, at the first one's place.
    return One(F.aggregate(pairs, F.expr(f"cast(map() as map<string,{t['value'].dataType.simpleString()}>)"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, x: k != e["col1"]), F.map_from_arrays(F.array(e["col1"]), F.array(e["col2"])))), T.MapType(STRING, t["value"].dataType))


on_value("from_entries")(as_map)


@with_nodes("with_entries", 1)
def with_entries(c, v, args, s):
    entries = to_entries(v)
    return as_map(map_(c, entries, args, s.at(entries)))


on_value("getpath", 1)(lambda v, p: _no("a path that isn't known"))


@with_nodes("del", 1)
def delete(c, v, args, s):
    from docql.plans import nodes as N

    names, todo = set(), [args[0]]
    while todo:
        n = todo.pop()
        if isinstance(n, N.Comma):
            todo += [n.left, n.right]
        elif isinstance(n, N.Field) and isinstance(n.base, N.Identity):
            names.add(n.name)
        else:
            raise Unsupported("del of other than fields")
    if isinstance(v.type, T.MapType):
        return One(F.map_filter(v.col, lambda k, x: ~k.isin(*names)), v.type)
    want(v, lambda t: isinstance(t, T.StructType), "an object is needed")
    fields = [f for f in v.type.fields if f.name not in names]
    return One(F.struct(*(v.col[f.name].alias(f.name) for f in fields)), T.StructType(fields))


# Strings

on_value("ascii_downcase")(lambda v: One(F.translate(text(v).col, letters.ascii_uppercase, letters.ascii_lowercase), STRING))
on_value("ascii_upcase")(lambda v: One(F.translate(text(v).col, letters.ascii_lowercase, letters.ascii_uppercase), STRING))
on_value("split", 1)(lambda v, by: split(text(v), by))
on_value("explode")(lambda v: One(F.transform(F.filter(F.split(text(v).col, ""), lambda x: x != ""), F.ascii).cast("array<bigint>"), T.ArrayType(LONG)))
FUNCTIONS["join", 1] = lambda c, args, s: c.each(s.dot, lambda v: One(F.array_join(F.transform(array(v).col, lambda x: F.when(x.isNull(), F.lit("")).otherwise(c.text(One(x, v.type.elementType)))), constant(one(c(args[0], s)))), STRING))
on_value("startswith", 1)(lambda v, w: One(F.startswith(text(v).col, text(w).col), BOOL))
on_value("endswith", 1)(lambda v, w: One(F.endswith(text(v).col, text(w).col), BOOL))
on_value("ltrimstr", 1)(lambda v, w: One(F.when(F.startswith(text(v).col, text(w).col), F.substring(v.col, F.length(w.col) + 1, F.length(v.col))).otherwise(v.col), STRING))
on_value("rtrimstr", 1)(lambda v, w: One(F.when(F.endswith(text(v).col, text(w).col), F.substring(v.col, F.lit(1), F.length(v.col) - F.length(w.col))).otherwise(v.col), STRING))
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]+"
on_value("trim")(lambda v: One(F.regexp_replace(text(v).col, f"^{SPACE}|{SPACE}$", ""), STRING))
on_value("ltrim")(lambda v: One(F.regexp_replace(text(v).col, f"^{SPACE}", ""), STRING))
on_value("rtrim")(lambda v: One(F.regexp_replace(text(v).col, f"{SPACE}$", ""), STRING))


def regex(p: One, flags: One | None = None) -> str:
    wanted = "".join(c for c in (constant(flags) if flags else "") if c in "ismx")
    return (f"(?{wanted})" if wanted else "") + constant(p)


on_value("test", 1)(lambda v, p: One(text(v).col.rlike(regex(p)), BOOL))
on_value("test", 2)(lambda v, p, f: One(text(v).col.rlike(regex(p, f)), BOOL))
on_value("splits", 1)(lambda v, p: Many(F.split(text(v).col, regex(p), -1), STRING))
on_value("splits", 2)(lambda v, p, f: Many(F.split(text(v).col, regex(p, f), -1), STRING))


@on_value("scan", 1)
def scan(v, p):
    import re

    if re.compile(constant(p)).groups:
        raise Unsupported("scan with groups")
    return Many(F.regexp_extract_all(text(v).col, F.lit(regex(p)), F.lit(0)), STRING)


@on_value("gsub", 2)
def gsub(v, p, new):
    plain = constant(new).replace("\\", "\\\\").replace("$", "\\$")
    return One(F.regexp_replace(text(v).col, regex(p), plain), STRING)


# Mathematics


def real(f):
    return lambda v: One(f(number(v).col.cast("double")), DOUBLE)


def whole(f):
    return lambda v: v if isinstance(v.type, T.IntegralType) else One(f(number(v).col).cast("long"), LONG)


on_value("floor")(whole(F.floor))
on_value("ceil")(whole(F.ceil))
on_value("round")(whole(lambda c: F.floor(c + 0.5)))
on_value("abs")(lambda v: One(F.abs(v.col), v.type) if is_number(v.type) else v)
LN = lambda f: lambda c: F.when(c == 0, F.lit(-math.inf)).when(c < 0, F.lit(math.nan)).otherwise(f(c))
EXPONENT = lambda c: F.floor(F.log2(F.abs(c))).cast("double")
for _name, _f in {
    "sqrt": F.sqrt, "log": LN(F.ln), "log2": LN(F.log2), "log10": LN(F.log10), "exp": F.exp, "exp2": lambda c: F.pow(F.lit(2.0), c), "exp10": lambda c: F.pow(F.lit(10.0), c), "fabs": F.abs,
    "rint": F.rint, "nearbyint": F.rint, "trunc": lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("double"), "cbrt": F.cbrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin,
    "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "exponent": EXPONENT, "logb": EXPONENT,
    "significand": lambda c: c / F.pow(F.lit(2.0), EXPONENT(c)),
}.items():
    on_value(_name)(real(_f))
for _name, _f in {"pow": F.pow, "atan2": F.atan2, "hypot": F.hypot, "drem": lambda a, b: a - b * F.rint(a / b), "remainder": lambda a, b: a - b * F.rint(a / b)}.items():
    on_value(_name, 2)(lambda v, a, b, f=_f: One(f(number(a).col.cast("double"), number(b).col.cast("double")), DOUBLE))
on_value("fma", 3)(lambda v, a, b, c: One(a.col.cast("double") * b.col.cast("double") + c.col.cast("double"), DOUBLE))
on_value("isnan")(lambda v: One(F.isnan(number(v).col.cast("double")), BOOL))
on_value("isinfinite")(lambda v: One(F.abs(number(v).col) == math.inf, BOOL))
on_value("isfinite")(lambda v: One(~F.isnan(number(v).col.cast("double")) & (F.abs(v.col) < math.inf), BOOL))
on_value("isnormal")(lambda v: One(~F.isnan(number(v).col.cast("double")) & (F.abs(v.col) < math.inf) & (v.col != 0), BOOL))

# Dates: seconds since 1970 in UTC

DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "I": "hh", "p": "a", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm", "Z": "'UTC'", "z": "'+0000'", "%": "'%'"}


def date_pattern(form: str) -> str:
    out, i = "", 0
    while i < len(form):
        if form[i] == "%" and i + 1 < len(form):
            if form[i + 1] not in DIRECTIVES:
                raise Unsupported(f"%{form[i + 1]}")
            out, i = out + DIRECTIVES[form[i + 1]], i + 2
        else:
            c = form[i]
            out, i = out + (f"'{c}'" if c.isalpha() else "''" if c == "'" else c), i + 1
    return out


def moment(v: One) -> Column:
    """A timestamp without zone, so that the session's zone plays no part."""
    c = number(v).col.cast("double")
    return F.timestamp_add("MICROSECOND", F.round(c * 1_000_000).cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


on_value("todate")(lambda v: One(F.date_format(moment(v), "yyyy-MM-dd'T'HH:mm:ss'Z'"), STRING))
on_value("fromdate")(lambda v: One(seconds_of(F.to_timestamp_ntz(F.regexp_replace(text(v).col, "Z$", ""))), LONG))
for _name in ("strftime", "strflocaltime"):
    on_value(_name, 1)(lambda v, f: One(F.date_format(moment(v), date_pattern(constant(f))), STRING))
on_value("now")(lambda v: One(F.unix_millis(F.current_timestamp()) / 1000.0, DOUBLE))


def broken(t: Column) -> One:
    seconds = F.second(t) + F.extract(F.lit("SECOND"), t).cast("double") % 1.0
    parts = [F.year(t), F.month(t) - 1, F.dayofmonth(t), F.hour(t), F.minute(t), seconds, F.dayofweek(t) - 1, F.dayofyear(t) - 1]
    return One(F.array(*(p.cast("double") for p in parts)), T.ArrayType(DOUBLE))


on_value("gmtime")(lambda v: broken(moment(v)))
on_value("strptime", 1)(lambda v, f: broken(F.to_timestamp_ntz(text(v).col, F.lit(date_pattern(constant(f))))))


@on_value("mktime")
def mktime(v):
    part = lambda i: F.get(array(v).col, F.lit(i)).cast("int")
    t = F.make_timestamp_ntz(part(0), part(1) + 1, part(2), part(3), part(4), part(5))
    return One(seconds_of(t), LONG)


def shifted(sign: int):
    def run(v, unit, n):
        word = constant(unit).upper().removesuffix("S")
        if word not in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"):
            raise Unsupported(f"the unit {unit.literal}")
        return One(seconds_of(F.timestamp_add(word, n.col.cast("long") * sign, moment(v))), LONG)

    return run


on_value("dateadd", 2)(shifted(1))
on_value("datesub", 2)(shifted(-1))


# JSONata and SQL/JSON path, where types are known


def boolean(v: One) -> Column:
    t = v.type
    if isinstance(t, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if is_number(t):
        return F.coalesce(v.col != 0, F.lit(False))
    if isinstance(t, T.StringType):
        return F.coalesce(v.col != "", F.lit(False))
    if isinstance(t, T.NullType):
        return F.lit(False)
    raise Unsupported("the truth of this type")


def stepped(v: One, name: str) -> One:
    from docql.operators.columns import pick_field

    if not is_array(v.type):
        return pick_field(v, name)
    t = v.type.elementType
    inner = stepped(One(F.lit(None).cast(t), t), name).type
    out = F.transform(v.col, lambda x: stepped(One(x, t), name).col)
    out = F.flatten(out) if is_array(inner) else out
    return One(F.filter(out, lambda x: x.isNotNull()), inner if is_array(inner) else T.ArrayType(inner))


@with_nodes("jsonata:field", 1)
def jsonata_field(c, v, args, s):
    return stepped(v, args[0].value)


@with_nodes("jsonata:map", 2)
def jsonata_map(c, v, args, s):
    left = one(c(args[0], s.at(v)))
    if not is_array(left.type):
        return c(args[1], s.at(left))
    t = left.type.elementType
    inner = one(c(args[1], s.at(One(F.lit(None).cast(t), t)))).type
    out = F.transform(left.col, lambda x: one(c(args[1], s.at(One(x, t)))).col)
    return One(F.flatten(out) if is_array(inner) else out, inner if is_array(inner) else T.ArrayType(inner))


@with_nodes("jsonata:arithmetic", 3)
def jsonata_arithmetic(c, v, args, s):
    from docql.operators.columns import arithmetic

    a, b = number(one(c(args[1], s.at(v)))), number(one(c(args[2], s.at(v))))
    out = arithmetic(args[0].value, a, b)
    return One(F.when(a.col.isNotNull() & b.col.isNotNull(), out.col), out.type)


@with_nodes("jsonata:compare", 3)
def jsonata_compare(c, v, args, s):
    a, b = one(c(args[1], s.at(v))), one(c(args[2], s.at(v)))
    out = compare(args[0].value, a, b)
    return out if args[0].value in ("==", "!=") else One(F.when(a.col.isNotNull() & b.col.isNotNull(), out.col), BOOL)


@with_nodes("jsonata:concat", 2)
def jsonata_concat(c, v, args, s):
    a, b = (one(c(n, s.at(v))) for n in args)
    return One(F.concat(*(F.when(e.col.isNull(), F.lit("")).otherwise(c.text(e)) for e in (a, b))), STRING)


FUNCTIONS["jsonata:boolean", 1] = lambda c, args, s: One(boolean(one(c(args[0], s))), BOOL)
FUNCTIONS["jsonata:block", 1] = lambda c, args, s: c(args[0], s)
FUNCTIONS["jsonata:assign", 2] = lambda c, args, s: c(args[1], s)


def jsonata_variable(c, args, s):
    if args[0].value not in s.variables:
        raise Unsupported(f"${args[0].value}")
    return s.variables[args[0].value]


FUNCTIONS["jsonata:variable", 1] = jsonata_variable
CALLS = {"sum": "add", "max": "max", "min": "min", "count": "length", "length": "length", "uppercase": None, "lowercase": None, "string": "tostring", "floor": "floor", "ceil": "ceil", "abs": "abs", "sqrt": "sqrt", "average": None}


@with_nodes("jsonata:call", 2)
def jsonata_call(c, v, args, s):
    f = args[0]
    name = f.args[0].value if getattr(f, "name", None) == "jsonata:variable" else None
    if name not in CALLS:
        raise Unsupported(f"${name}")
    x = one(c(args[1], s.at(v)))
    if name in ("uppercase", "lowercase"):
        return One((F.upper if name == "uppercase" else F.lower)(text(x).col), STRING)
    if name == "average":
        return One(total(array(x)).col / F.size(x.col), DOUBLE)
    return FUNCTIONS[CALLS[name], 0](c, (), s.at(x))
