"""Tier 2: expressions over typed columns, compiled to Column expressions that stay in the JVM.

A compiled expression is One (a column with one value) or Many (an array column holding the outputs of a
generator, in order). What has no typed form raises Unsupported, and the caller goes on to the interpreter.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docql.plans import nodes as N


class Unsupported(Exception):
    """The expression has no form in this tier."""


@dataclass(frozen=True)
class One:
    col: Column
    type: T.DataType
    literal: Any = None


@dataclass(frozen=True)
class Many:
    """col: an array column; type: of its elements."""

    col: Column
    type: T.DataType


Compiled = One | Many


@dataclass(frozen=True)
class Scope:
    """What `.` and variables stand for, and the user's functions (parameters, body, scope of definition)."""

    dot: Compiled
    variables: dict[str, One]
    functions: dict[tuple[str, int], tuple]

    def at(self, dot: Compiled) -> Scope:
        return replace(self, dot=dot)

    def bound(self, **new: One) -> Scope:
        return replace(self, variables={**self.variables, **new})


NULL, BOOL, LONG, DOUBLE, STRING = T.NullType(), T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def truthy(e: One) -> Column:
    if isinstance(e.type, T.NullType):
        return F.lit(False)
    return F.coalesce(e.col, F.lit(False)) if isinstance(e.type, T.BooleanType) else e.col.isNotNull()


def common(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if is_number(a) and is_number(b):
        integral = isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType)
        return LONG if integral else DOUBLE
    if is_array(a) and is_array(b):
        return T.ArrayType(common(a.elementType, b.elementType))
    raise Unsupported(f"values of types {a.simpleString()} and {b.simpleString()} in one place")


def cast(e: One, t: T.DataType) -> Column:
    return e.col if e.type == t else e.col.cast(t)


def literal(v: Any) -> One:
    if v is None:
        return One(F.lit(None), NULL)
    kind = BOOL if isinstance(v, bool) else LONG if isinstance(v, int) else DOUBLE if isinstance(v, float) else STRING
    return One(F.lit(v).cast(kind) if kind == LONG else F.lit(v), kind, v)


def one(e: Compiled) -> One:
    if isinstance(e, Many):
        raise Unsupported("a generator where one value is needed")
    return e


def many(e: Compiled) -> Many:
    return e if isinstance(e, Many) else Many(F.array(e.col), e.type)


# Order of the language: null before all; then by value, NaN last.


def less(a: One, b: One, or_equal: bool) -> Column:
    t = common(a.type, b.type)
    x, y = cast(a, t), cast(b, t)
    body = x <= y if or_equal else x < y
    if b.literal is not None:
        return body | x.isNull()
    if a.literal is not None:
        return F.coalesce(body, F.lit(False))
    return F.when(x.isNull(), F.lit(True) if or_equal else y.isNotNull()).when(y.isNull(), F.lit(False)).otherwise(body)


def compare(op: str, a: One, b: One) -> One:
    try:
        t = common(a.type, b.type)
    except Unsupported:
        if op in ("==", "!="):
            both_null = a.col.isNull() & b.col.isNull()
            return One(both_null if op == "==" else ~both_null, BOOL)
        raise
    if op in ("==", "!="):
        if a.literal is not None or b.literal is not None:
            same = F.coalesce(cast(a, t) == cast(b, t), F.lit(False))
        else:
            same = cast(a, t).eqNullSafe(cast(b, t))
        return One(same if op == "==" else ~same, BOOL)
    if op in (">", ">="):
        a, b = b, a
    return One(less(a, b, op in ("<=", ">=")), BOOL)


def add(a: One, b: One) -> One:
    t = common(a.type, b.type)
    x, y = cast(a, t), cast(b, t)
    if isinstance(t, T.NullType):
        return a
    if is_number(t):
        t = t if t in (LONG, DOUBLE) else (LONG if isinstance(t, T.IntegralType) else DOUBLE)
        x, y = x.cast(t), y.cast(t)
        out = x + y
    elif isinstance(t, (T.StringType, T.ArrayType)):
        out = F.concat(x, y)
    elif isinstance(t, T.MapType):
        out = F.map_concat(x, y)
    else:
        raise Unsupported("+ of these types")
    if a.literal is not None or b.literal is not None:
        return One(F.coalesce(out, x, y), t)
    return One(F.coalesce(out, x, y), t)


def merge_structs(a: One, b: One) -> One:
    mine = {f.name: (a.col[f.name], f.dataType) for f in a.type.fields} | {f.name: (b.col[f.name], f.dataType) for f in b.type.fields}
    return One(F.struct(*(c.alias(n) for n, (c, _) in mine.items())), T.StructType([T.StructField(n, t) for n, (_, t) in mine.items()]))


def arithmetic(op: str, a: One, b: One) -> One:
    if op == "+":
        if isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
            return merge_structs(a, b)
        return add(a, b)
    if is_array(a.type) and is_array(b.type) and op == "-":
        return One(F.filter(a.col, lambda x: ~F.coalesce(F.exists(b.col, lambda y: x.eqNullSafe(y)), F.lit(False))), a.type)
    if isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType) and op == "/":
        return split(a, b)
    if op == "*" and isinstance(a.type, T.StringType) and is_number(b.type):
        return One(F.when(b.col >= 0, F.repeat(a.col, b.col.cast("int"))), STRING)
    if not (is_number(a.type) and is_number(b.type)):
        raise Unsupported(f"{op} of these types")
    integral = isinstance(a.type, T.IntegralType) and isinstance(b.type, T.IntegralType)
    t = LONG if integral and op != "/" else DOUBLE
    x, y = a.col.cast(t), b.col.cast(t)
    if op == "%":
        x, y = a.col.cast(LONG), b.col.cast(LONG)
        return One(x % F.abs(y), LONG)
    return One(x - y if op == "-" else x * y if op == "*" else x / y, t)


def split(a: One, by: One) -> One:
    if by.literal is None:
        raise Unsupported("a separator that isn't constant")
    quoted = "".join(c if c.isalnum() else f"\\{c}" for c in by.literal)
    return One(F.when(a.col == "", F.array().cast("array<string>")).otherwise(F.split(a.col, quoted, -1)), T.ArrayType(STRING))


def pick_field(base: One, name: str) -> One:
    if isinstance(base.type, T.NullType):
        return base
    if isinstance(base.type, T.StructType):
        if name not in base.type.names:
            return literal(None)
        return One(base.col[name], base.type[name].dataType)
    if isinstance(base.type, T.MapType):
        return One(F.try_element_at(base.col, F.lit(name)), base.type.valueType)
    raise Unsupported(f".{name} of {base.type.simpleString()}")


def pick_index(base: One, key: One) -> One:
    if isinstance(base.type, (T.StructType, T.MapType)) and isinstance(key.literal, str):
        return pick_field(base, key.literal)
    if isinstance(base.type, T.StructType) and base.type.names == ["0", "1"] and key.literal in (0, 1):
        return pick_field(base, str(key.literal))  # a pair, of values of two types
    if isinstance(base.type, T.MapType) and isinstance(key.type, T.StringType):
        return One(F.try_element_at(base.col, key.col), base.type.valueType)
    if is_array(base.type) and is_number(key.type):
        k = F.floor(key.col).cast("int") if not isinstance(key.type, T.IntegralType) else key.col.cast("int")
        return One(F.get(base.col, F.when(k < 0, k + F.size(base.col)).otherwise(k)), base.type.elementType)
    raise Unsupported("this index")


def cut(base: One, start: One | None, end: One | None) -> One:
    text = isinstance(base.type, T.StringType)
    if not (text or is_array(base.type)):
        raise Unsupported("a slice of this type")
    size = F.length(base.col) if text else F.size(base.col)

    def bound(e: One | None, default: Column, up: bool) -> Column:
        if e is None:
            return default
        v = (F.ceil if up else F.floor)(e.col).cast("int")
        v = F.when(v < 0, v + size).otherwise(v)
        return F.coalesce(F.greatest(F.lit(0), F.least(v, size)), default)

    s, e = bound(start, F.lit(0), False), bound(end, size, True)
    n = F.greatest(F.lit(0), e - s)
    return One(F.substring(base.col, s + 1, n) if text else F.slice(base.col, s + 1, n), base.type)



class Compiler:
    def __call__(self, n: N.Node, s: Scope) -> Compiled:
        do = getattr(self, f"do_{type(n).__name__.lower()}", None)
        if do is None:
            raise Unsupported(type(n).__name__)
        return do(n, s)

    def each(self, base: Compiled, f: Callable[[One], Compiled]) -> Compiled:
        """f for one value, or for every value of a generator."""
        if isinstance(base, One):
            return f(base)
        made: list[Compiled] = []

        def body(x: Column) -> Column:
            out = f(One(x, base.type))
            made.append(out)
            return out.col

        out = F.transform(base.col, body)
        if isinstance(made[0], Many):
            return Many(F.flatten(out), made[0].type)
        return Many(out, made[0].type)

    def two(self, left: N.Node, right: N.Node, s: Scope, f: Callable[[One, One], One]) -> Compiled:
        """The right operand is the outer loop, the left the inner."""
        return self.each(self(right, s), lambda b: self.each(self(left, s), lambda a: f(a, b)))

    def do_identity(self, n, s):
        return s.dot

    def do_literal(self, n, s):
        return literal(n.value)

    def do_variable(self, n, s):
        if n.name not in s.variables:
            raise Unsupported(f"${n.name}")
        return s.variables[n.name]

    def do_field(self, n, s):
        return self.each(self(n.base, s), lambda b: pick_field(b, n.name))

    def do_index(self, n, s):
        return self.each(self(n.base, s), lambda b: pick_index(b, one(self(n.key, s))))

    def do_slice(self, n, s):
        start = one(self(n.start, s)) if n.start else None
        end = one(self(n.end, s)) if n.end else None
        return self.each(self(n.base, s), lambda b: cut(b, start, end))

    def do_iterate(self, n, s):
        def items(b: One) -> Many:
            if is_array(b.type):
                return Many(b.col, b.type.elementType)
            if isinstance(b.type, T.MapType):
                return Many(F.map_values(b.col), b.type.valueType)
            raise Unsupported("iteration over this type")

        return self.each(self(n.base, s), items)

    def do_pipe(self, n, s):
        if isinstance(n.right, N.Call) and n.right.name == "select" and len(n.right.args) == 1:
            left = self(n.left, s)
            if isinstance(left, Many):
                return Many(F.filter(left.col, lambda x: truthy(one(self(n.right.args[0], s.at(One(x, left.type)))))), left.type)
        return self.each(self(n.left, s), lambda v: self(n.right, s.at(v)))

    def do_comma(self, n, s):
        a, b = many(self(n.left, s)), many(self(n.right, s))
        t = common(a.type, b.type)
        return Many(F.concat(a.col.cast(T.ArrayType(t)), b.col.cast(T.ArrayType(t))), t)

    def do_collect(self, n, s):
        if n.body is None:
            return One(F.array(), T.ArrayType(NULL))
        m = many(self(n.body, s))
        return One(m.col, T.ArrayType(m.type))

    def do_build(self, n, s):
        columns, fields = [], []
        for key, value in n.entries:
            if not isinstance(key, N.Literal):
                raise Unsupported("a computed key")
            v = one(self(value, s))
            columns.append((v.col.cast("string") if isinstance(v.type, T.NullType) else v.col).alias(str(key.value)))
            fields.append(T.StructField(str(key.value), STRING if isinstance(v.type, T.NullType) else v.type))
        last = {f.name: i for i, f in enumerate(fields)}
        keep = sorted(last.values())
        return One(F.struct(*(columns[i] for i in keep)), T.StructType([fields[i] for i in keep]))

    def do_interpolate(self, n, s):
        parts = []
        for p in n.parts:
            parts.append(F.lit(p) if isinstance(p, str) else self.formatted(n.format or "text", one(self(p, s))))
        return One(F.concat(*parts) if parts else F.lit(""), STRING)

    def do_format(self, n, s):
        return self.each(s.dot, lambda v: One(self.formatted(n.name, v), STRING))

    def do_negate(self, n, s):
        return self.each(self(n.body, s), lambda v: One(-v.col, v.type) if is_number(v.type) else self.refuse("-"))

    def refuse(self, what: str):
        raise Unsupported(what)

    def do_arithmetic(self, n, s):
        return self.two(n.left, n.right, s, lambda a, b: arithmetic(n.op, a, b))

    def do_compare(self, n, s):
        return self.two(n.left, n.right, s, lambda a, b: compare(n.op, a, b))

    def do_logic(self, n, s):
        a, b = one(self(n.left, s)), one(self(n.right, s))
        return One(truthy(a) & truthy(b) if n.op == "and" else truthy(a) | truthy(b), BOOL)

    def do_alternative(self, n, s):
        a, b = one(self(n.left, s)), one(self(n.right, s))
        t = common(a.type, b.type)
        return One(F.when(truthy(a), cast(a, t)).otherwise(cast(b, t)), t)

    def do_if(self, n, s):
        test, a, b = one(self(n.test, s)), self(n.then, s), self(n.other, s)
        if isinstance(a, Many) or isinstance(b, Many):
            a, b = many(a), many(b)
            t = common(a.type, b.type)
            return Many(F.when(truthy(test), a.col.cast(T.ArrayType(t))).otherwise(b.col.cast(T.ArrayType(t))), t)
        t = common(a.type, b.type)
        return One(F.when(truthy(test), cast(a, t)).otherwise(cast(b, t)), t)

    def do_try(self, n, s):
        """Only of conversions, whose failure has a column form."""
        body = n.body if isinstance(n.body, N.Pipe) else N.Pipe(N.Identity(), n.body)
        if body.right == N.Call("tonumber", ()):
            v = one(self(body.left, s))
            parsed = One(v.col.try_cast("double"), DOUBLE)
            if n.handler is None:
                return Many(F.when(parsed.col.isNotNull(), F.array(parsed.col)).otherwise(F.array().cast("array<double>")), DOUBLE)
            other = one(self(n.handler, s.at(literal("error"))))
            t = common(DOUBLE, other.type)
            return One(F.coalesce(parsed.col.cast(t), cast(other, t)), t)
        if not isinstance(n.body, (N.Field, N.Iterate, N.Identity)):
            raise Unsupported("try")
        return self(n.body, s)

    def do_reduce(self, n, s):
        if not isinstance(n.pattern, N.VarPattern):
            raise Unsupported("a pattern in reduce")
        source, start = many(self(n.source, s)), one(self(n.start, s))
        t = start.type
        for _ in range(3):  # until the state's type holds
            step = one(self(n.update, s.at(One(F.lit(None).cast(t), t)).bound(**{n.pattern.name: One(F.lit(None).cast(source.type), source.type)})))
            if step.type == t:
                break
            t = common(t, step.type)

        def update(state: Column, x: Column) -> Column:
            return cast(one(self(n.update, s.at(One(state, t)).bound(**{n.pattern.name: One(x, source.type)}))), t)

        return One(F.aggregate(source.col, cast(start, t), update), t)

    def do_foreach(self, n, s):
        folded = self.do_reduce(N.Reduce(n.source, n.pattern, n.start, n.update), s)
        source, t = many(self(n.source, s)), folded.type
        start = one(self(n.start, s))
        kept = T.ArrayType(t)

        def update(states: Column, x: Column) -> Column:
            now = F.when(F.size(states) > 0, F.get(states, F.size(states) - 1)).otherwise(cast(start, t))
            return F.concat(states, F.array(cast(one(self(n.update, s.at(One(now, t)).bound(**{n.pattern.name: One(x, source.type)}))), t)))

        states = Many(F.aggregate(source.col, F.array().cast(kept), update), t)
        if n.extract is None:
            return states
        made: list[Compiled] = []

        def shown(state: Column, i: Column) -> Column:
            inner = s.at(One(state, t)).bound(**{n.pattern.name: One(F.get(source.col, i), source.type)})
            made.append(self(n.extract, inner))
            return made[-1].col

        out = F.transform(states.col, shown)
        return Many(F.flatten(out) if isinstance(made[0], Many) else out, made[0].type)

    def do_bind(self, n, s):
        if len(n.patterns) > 1:
            raise Unsupported("alternative patterns")

        def bindings(p, v: One) -> dict[str, One]:
            if isinstance(p, N.VarPattern):
                return {p.name: v}
            out: dict[str, One] = {}
            if isinstance(p, N.ArrayPattern):
                for i, q in enumerate(p.items):
                    out |= bindings(q, pick_index(v, literal(i)))
                return out
            for key, var, q in p.entries:
                part = pick_index(v, one(self(key, s)))
                out |= ({var: part} if var else {}) | (bindings(q, part) if q else {})
            return out

        return self.each(self(n.source, s), lambda v: self(n.body, s.bound(**bindings(n.patterns[0], v))))

    def do_define(self, n, s):
        return self(n.rest, replace(s, functions={**s.functions, (n.name, len(n.params)): (n.params, n.body, s)}))

    def do_assign(self, n, s):
        """Of a path of fields of structs."""
        path, t = [], n.target
        while isinstance(t, N.Field):
            path.insert(0, t.name)
            t = t.base
        if not path or not isinstance(t, N.Identity):
            raise Unsupported("an assignment to other than fields")

        def put(base: One, names: list[str]) -> One:
            old = pick_field(base, names[0])
            if len(names) > 1:
                new = put(old, names[1:])
            elif n.op == "|=":
                new = one(self(n.value, s.at(old)))
            elif n.op == "=":
                new = one(self(n.value, s))
            elif n.op == "//=":
                right = one(self(n.value, s))
                kind = common(old.type, right.type)
                new = One(F.when(truthy(old), cast(old, kind)).otherwise(cast(right, kind)), kind)
            else:
                new = arithmetic(n.op[0], old, one(self(n.value, s)))
            if not isinstance(base.type, T.StructType):
                raise Unsupported("an assignment into this type")
            fields = [f for f in base.type.fields if f.name != names[0]] if names[0] not in base.type.names else list(base.type.fields)
            made = T.StructField(names[0], new.type)
            fields = [made if f.name == names[0] else f for f in fields] + ([] if names[0] in base.type.names else [made])
            return One(F.struct(*((new.col if f.name == names[0] else base.col[f.name]).alias(f.name) for f in fields)), T.StructType(fields))

        return self.each(s.dot, lambda v: put(v, path))

    def do_call(self, n, s):
        user = s.functions.get((n.name, len(n.args)))
        if user is not None:
            params, body, home = user
            if params is None:
                return self(body, home.at(s.dot))  # an argument: its own scope, the input of here
            inner = {**home.functions, **{(p, 0): (None, a, s) for p, a in zip(params, n.args, strict=True)}}
            return self(body, replace(home, dot=s.dot, functions=inner))
        from docql.operators.column_functions import FUNCTIONS

        f = FUNCTIONS.get((n.name, len(n.args)))
        if f is None:
            raise Unsupported(f"{n.name}/{len(n.args)}")
        return f(self, n.args, s)

    # Text

    def text(self, v: One) -> Column:
        if isinstance(v.type, T.StringType):
            return F.coalesce(v.col, F.lit("null"))
        return self.json(v)

    def json(self, v: One) -> Column:
        t = v.type
        if isinstance(t, T.NullType):
            return F.lit("null")
        if isinstance(t, (T.BooleanType, T.IntegralType)):
            out = v.col.cast("string")
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
            plain = F.rtrim(F.lit("0"), F.format_number(v.col, "0.####################"))
            out = F.when(F.isnan(v.col) | (F.abs(v.col) == math.inf), F.lit("null")).when(whole, v.col.cast("long").cast("string")).when(F.abs(v.col) >= 1e-3, v.col.cast("string")).otherwise(plain)
        elif isinstance(t, T.StringType):
            out = F.to_json(F.struct(v.col.alias("v")))  # {"v":...}
            out = F.substring(out, F.lit(6), F.length(out) - 6)
        else:
            out = F.to_json(v.col, {"ignoreNullFields": "false"})
        return F.when(v.col.isNull(), F.lit("null")).otherwise(out)

    def formatted(self, name: str, v: One) -> Column:
        if name == "text":
            return self.text(v)
        if name == "json":
            return self.json(v)
        if name in ("csv", "tsv"):
            if not is_array(v.type):
                raise Unsupported(f"@{name} of other than an array")

            def cell(x: Column) -> Column:
                e = One(x, v.type.elementType)
                if name == "csv" and isinstance(e.type, T.StringType):
                    return F.when(x.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')))
                out = self.text(e)
                for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")) if name == "tsv" else ():
                    out = F.replace(out, F.lit(a), F.lit(b))
                return out

            return F.array_join(F.transform(v.col, cell), "," if name == "csv" else "\t")
        text = self.text(v)
        if name == "html":
            for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
                text = F.replace(text, F.lit(a), F.lit(b))
            return text
        if name == "uri":
            return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
        if name == "urid":
            return F.url_decode(text)
        if name == "base64":
            return F.base64(text.cast("binary"))
        if name == "base64d":
            return F.unbase64(text).cast("string")
        if name == "sh":
            return F.when(text.rlike(r"^[A-Za-z0-9_./:=@%^,+-]+$"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))
        raise Unsupported(f"@{name}")


COMPILE = Compiler()
PLAIN = {"==": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "!=": lambda a, b: a != b}
TURNED = {"==": "==", "!=": "!=", ">": "<", ">=": "<=", "<": ">", "<=": ">="}


def predicate(n: N.Node, s: Scope) -> Column:
    """The truth of n for a filter, where null drops a row as false does: comparisons with constants stay in a form that scans take."""
    if isinstance(n, N.Logic):
        a, b = predicate(n.left, s), predicate(n.right, s)
        return a & b if n.op == "and" else a | b
    if isinstance(n, N.Compare):
        a, b, op = one(COMPILE(n.left, s)), one(COMPILE(n.right, s)), n.op
        if a.literal is not None and b.literal is None:
            a, b, op = b, a, TURNED[op]
        if b.literal is not None and a.literal is None and (is_number(a.type) and is_number(b.type) or a.type == b.type):
            test = PLAIN[op](a.col, F.lit(b.literal))
            return test | a.col.isNull() if op in ("<", "<=", "!=") else test
    return truthy(one(COMPILE(n, s)))
