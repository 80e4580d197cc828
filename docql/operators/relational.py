"""Tier 1: programs that walk a dataset, compiled to DataFrame operations.

A dataset is what a slurped program sees as one array. A Frame is a DataFrame with what it stands for: the
array of its rows or the stream of them, and the order of rows where a program has set one. Row by row
expressions are tier 2 columns; those beyond it are interpreted (tier 3) on the rows' JSON.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docql.functions.interpret import run
from docql.functions.values import JqError
from docql.operators import columns as C
from docql.operators.columns import COMPILE, LONG, Many, One, Scope, Unsupported, literal, many, one, truthy
from docql.operators.dynamic import outputs
from docql.plans import nodes as N
from docql.plans.parser import ProgramError
from docql.sources.scratch import stored

IDENTITY = N.Identity()
EVERY = N.Iterate(IDENTITY)


@dataclass(frozen=True)
class Key:
    """A sort key: a column, ascending (nulls first) or descending (nulls last)."""

    col: Column
    down: bool = False

    def sorted(self) -> Column:
        return self.col.desc_nulls_last() if self.down else self.col.asc_nulls_first()


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    flat: bool = True  # a row is an object of its columns, else the value of its only column
    stream: bool = False
    order: tuple[Key, ...] = ()
    single: bool = False  # the one row is the value itself, not an array's element
    json: bool = False  # the column value holds JSON texts of values without a known type
    hidden: tuple[str, ...] = ()  # columns that are no part of a row: of the order, or of what was joined

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.hidden]

    @property
    def type(self) -> T.DataType:
        return T.StructType([f for f in self.df.schema.fields if f.name not in self.hidden]) if self.flat else self.df.schema["value"].dataType

    @property
    def row(self) -> One:
        if self.json:
            raise Unsupported("values without a known type")
        if self.flat:
            return One(F.struct(*(F.col(f"`{c}`").alias(c) for c in self.names)), self.type)
        return One(F.col("value"), self.type)

    @property
    def shown(self) -> DataFrame:
        """The rows in their order, without hidden columns."""
        df = self.df.orderBy(*(k.sorted() for k in self.order)) if self.order and not self.single else self.df
        return df.select(*(F.col(f"`{c}`") for c in self.names)) if self.hidden else df

    def kept_order(self) -> dict[str, Key]:
        """Names for the columns that carry the order through a projection."""
        return {} if self.single else {f"_o{i}": k for i, k in enumerate(self.order)}


@dataclass(frozen=True)
class Grouped:
    """The groups of a frame, an array of arrays; stream: one array after the other."""

    frame: Frame
    keys: tuple[tuple[N.Node, One], ...]
    stream: bool = False


def reverse(order: tuple[Key, ...]) -> tuple[Key, ...]:
    return tuple(Key(k.col, not k.down) for k in order)


def rank_of(f: Frame, *first: One) -> Column | None:
    """A column whose order is that of first and then of the frame; None where neither sets any."""
    parts = [x.col for x in first]
    for k in f.order:
        if not k.down:
            parts.append(k.col)
        elif f.df.select(k.col.alias("k")).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            parts += [k.col.isNull(), -k.col]  # downwards nulls are last
        else:
            raise Unsupported("a descending order of other than numbers within groups")
    return F.struct(*(p.alias(f"_{i}") for i, p in enumerate(parts))) if parts else None


@dataclass
class Tiers:
    """Which tier each part of a program went to."""

    parts: list[tuple[str, str]] = field(default_factory=list)

    def note(self, tier: str, n: Any) -> None:
        self.parts.append((tier, type(n).__name__ + (f" {n.name}" if isinstance(n, N.Call) else "")))


class Planner:
    def __init__(self, datasets: dict[str, Frame] | None = None, variables: dict[str, Any] | None = None, mode: str = "failfast", extra: dict | None = None):
        self.extra = extra
        self.datasets, self.mode = dict(datasets or {}), mode
        self.plain = dict(variables or {})
        self.variables = {k: literal(v) for k, v in self.plain.items() if v is None or isinstance(v, (str, int, float, bool))}
        self.functions: dict = {}
        self.indexes: dict[str, tuple[Frame, N.Node]] = {}
        self.tiers = Tiers()

    def scope(self, frame: Frame) -> Scope:
        return Scope(frame.row, self.variables, self.functions)

    # From a frame to a frame

    def plan(self, n: N.Node, f: Frame | Grouped) -> Frame | Grouped:
        if isinstance(f, Grouped):
            return self.on_groups(n, f)
        if isinstance(n, N.Identity):
            return f
        if isinstance(n, N.Define):
            self.functions[n.name, len(n.params)] = (n.params, n.body, Scope(literal(None), self.variables, self.functions))
            return self.plan(n.rest, f)
        if isinstance(n, N.Variable) and n.name in self.datasets:
            return self.datasets[n.name]
        if isinstance(n, N.Pipe):
            return self.plan(n.right, self.plan(n.left, f))
        if isinstance(n, N.Bind):
            joined = self.bound(n, f)
            if joined is not None:
                return joined
        if isinstance(n, N.Call) and (n.name, len(n.args)) == ("limit", 2):
            got = self.plan(n.args[1], f)
            return self.sliced(got, 0, self.number(n.args[0]), stream=True)
        if isinstance(n, N.Call) and (n.name, len(n.args)) == ("skip", 2):
            return self.sliced(self.plan(n.args[1], f), self.number(n.args[0]), None, stream=True)
        if isinstance(n, N.Call) and (n.name, len(n.args)) == ("first", 1):
            return self.sliced(self.plan(n.args[0], f), 0, 1, stream=True)
        if isinstance(n, N.Call) and (n.name, len(n.args)) == ("last", 1) and not f.stream and self.walks(n.args[0]):
            return replace(self.at_place(self.plan(n.args[0], f), -1), stream=True, single=False)
        if isinstance(n, N.Call) and (n.name, len(n.args)) == ("nth", 2) and not f.stream and self.walks(n.args[1]):
            return replace(self.at_place(self.plan(n.args[1], f), max(0, self.number(n.args[0]))), stream=True, single=False)
        if isinstance(n, N.Comma) and not f.stream and self.walks(n.left) and self.walks(n.right):
            return replace(self.union(self.plan(n.left, f), self.plan(n.right, f)), stream=True)
        if f.stream or f.single:
            return self.on_rows(n, f)
        self.tiers.note("T1", n)
        return self.on_array(n, f)

    def is_dataset(self, n: N.Node) -> bool:
        """Whether n, of a dataset, gives an array of rows again."""
        if isinstance(n, N.Pipe):
            return (self.is_dataset(n.left) or isinstance(n.left, N.Variable)) and self.is_dataset(n.right)
        if isinstance(n, N.Call):
            return n.name in ("map", "sort_by", "sort", "reverse", "unique", "unique_by")
        return isinstance(n, (N.Identity, N.Slice)) or isinstance(n, N.Arithmetic) and n.op in "+-" and self.is_dataset(n.left) and self.is_dataset(n.right) or self.walks(n) and not isinstance(n, N.Iterate)

    def walks(self, n: N.Node) -> bool:
        """Whether n goes through a dataset."""
        if isinstance(n, N.Iterate):
            return isinstance(n.base, N.Identity) or self.walks(n.base)
        if isinstance(n, N.Variable):
            return n.name in self.datasets
        return isinstance(n, N.Pipe) and self.walks(n.left) or isinstance(n, N.Collect) and n.body is not None and self.walks(n.body)

    def number(self, n: N.Node) -> int:
        try:
            v = next(run(n, None, self.plain), None)
        except (JqError, ProgramError):
            v = None
        if not isinstance(v, int):
            raise Unsupported("a bound that isn't constant")
        return v

    def on_array(self, n: N.Node, f: Frame) -> Frame | Grouped:
        if isinstance(n, N.Iterate):
            return replace(self.plan(n.base, f), stream=True)
        if isinstance(n, N.Collect) and n.body is not None:
            got = self.plan(n.body, f)
            return replace(got, stream=False) if isinstance(got, Grouped) else replace(got, stream=False, single=False)
        if isinstance(n, N.Slice):
            base = self.plan(n.base, f)
            start = self.number(n.start) if n.start else 0
            end = self.number(n.end) if n.end else None
            if start < 0 or (end is not None and end < 0):
                if end is None and base.order:
                    # The last -start rows: the first ones of the opposite order, put right again.
                    return replace(self.sliced(replace(base, order=reverse(base.order)), 0, -start), order=base.order)
                raise Unsupported("a slice from the end of an unordered dataset")
            return self.sliced(base, start, end)
        if isinstance(n, N.Index):
            return self.at_place(self.plan(n.base, f), self.number(n.key))
        if isinstance(n, N.Field):
            base = self.plan(n.base, f)
            if base.single:
                return self.on_rows(N.Field(IDENTITY, n.name), base)
        if isinstance(n, N.Arithmetic) and n.op in "+-":
            if self.is_dataset(n.left) and self.is_dataset(n.right):
                left, right = self.plan(n.left, f), self.plan(n.right, f)
                return self.union(left, right) if n.op == "+" else self.difference(left, right)
        if isinstance(n, N.Bind) and n.source == N.Call("range", (N.Call("length", ()),)) and isinstance(n.patterns[0], N.VarPattern):
            return self.by_place(n, f)
        if isinstance(n, N.Reduce):
            return self.reduced(n, f)
        if isinstance(n, N.Foreach):
            return self.running(n, f)
        if isinstance(n, N.Call):
            do = getattr(self, f"array_{n.name}", None)
            if do is not None:
                return do(n, f)
        return self.aggregated(n, f)

    def on_rows(self, n: N.Node, f: Frame) -> Frame:
        """An expression for every row of a stream."""
        if isinstance(n, N.Call) and n.name == "select" and len(n.args) == 1:
            return self.selected(n.args[0], f)
        if isinstance(n, N.Reduce | N.Foreach) and self.walks(n.source):
            raise Unsupported("a fold over a dataset for every row")
        looked_up = self.with_lookups(n, f)
        if looked_up is not None:
            n, f = looked_up
        try:
            out = COMPILE(n, self.scope(f))
            self.tiers.note("T2", n)
        except Unsupported:
            self.tiers.note("T3", n)
            return self.interpreted(n, f)
        return self.shown(out, f)

    def shown(self, out: One | Many, f: Frame) -> Frame:
        held = f.kept_order()
        carried = [k.col.alias(c) for c, k in held.items()]
        order = tuple(Key(F.col(c), k.down) for c, k in held.items())
        if isinstance(out, Many):
            df = f.df.select(F.posexplode(out.col).alias("_p", "value"), *carried) if held else f.df.select(F.explode(out.col).alias("value"))
            order, held = (*order, Key(F.col("_p"))) if held else (), {**held, "_p": None} if held else {}
            out, f = One(F.col("value"), out.type), replace(f, single=False, stream=True)
            carried = [F.col(c) for c in held]
        else:
            df = f.df
        flat = isinstance(out.type, T.StructType)
        columns = [out.col[c].alias(c) for c in out.type.names] if flat else [out.col.alias("value")]
        return Frame(df.select(*columns, *carried), flat, f.stream, order, f.single, hidden=tuple(held))

    def interpreted(self, n: N.Node, f: Frame) -> Frame:
        held = f.kept_order()
        rows = f.df.select(self.text(f).alias("value"), *(k.col.alias(c) for c, k in held.items()))
        got = outputs(rows, n, variables=self.plain, mode=self.mode, keep=tuple(held), extra=self.extra)
        hidden = (*held, "_pos") if held else ()
        order = tuple(Key(F.col(c), c in held and held[c].down) for c in hidden)
        return Frame(got.select("value", *["_error"] * (self.mode == "permissive"), *hidden), False, True, order, json=True, hidden=hidden)

    def selected(self, cond: N.Node, f: Frame) -> Frame:
        semi = self.membership(cond, f)
        if semi is not None:
            return semi
        try:
            test = C.predicate(cond, self.scope(f))
        except Unsupported:
            return self.interpreted(N.Call("select", (cond,)), f)
        self.tiers.note("T2", cond)
        return replace(f, df=f.df.where(test))

    # Order and number

    def at_place(self, f: Frame, k: int) -> Frame:
        """Row k of the array, from the end if below 0; no row where the language has null."""
        if isinstance(f, Grouped):
            raise Unsupported("one of the groups")
        if k < 0:
            if not f.order:
                raise Unsupported("a place from the end of an unordered dataset")
            f, k = replace(f, order=reverse(f.order)), -k - 1
        return replace(self.sliced(f, k, k + 1), single=True)

    def sliced(self, f: Frame, start: int, end: int | None, stream: bool | None = None) -> Frame:
        df = f.df.orderBy(*(k.sorted() for k in f.order)) if f.order else f.df
        if end is not None:
            df = df.limit(max(0, end))
        if start:
            df = df.offset(start)
        return replace(f, df=df, stream=f.stream if stream is None else stream)

    def keys(self, nodes: tuple[N.Node, ...], f: Frame) -> list[One]:
        return [one(COMPILE(n, self.scope(f))) for n in _key_parts(nodes[0])]

    def sort_keys(self, nodes: tuple[N.Node, ...], f: Frame) -> tuple[Key, ...]:
        """-x, of a number, sorts downwards by x."""
        out = []
        todo = list(nodes)
        while todo:
            n = todo.pop(0)
            if isinstance(n, N.Comma):
                todo = [n.left, n.right, *todo]
            elif isinstance(n, N.Negate):
                out.append(Key(one(COMPILE(n.body, self.scope(f))).col, True))
            else:
                out.append(Key(one(COMPILE(n, self.scope(f))).col))
        return tuple(out)

    def array_sort_by(self, n, f):
        return replace(f, order=(*self.sort_keys(n.args, f), *f.order))

    def array_sort(self, n, f):
        return replace(f, order=tuple(Key(F.col(f"`{c}`")) for c in f.names))

    def array_reverse(self, n, f):
        if not f.order:
            raise Unsupported("the reverse of an unordered dataset")
        return replace(f, order=reverse(f.order))

    def array_last(self, n, f):
        if n.args:
            raise Unsupported("last of a generator")
        return self.at_place(f, -1)

    def array_nth(self, n, f):
        if len(n.args) != 1:
            raise Unsupported("nth of a generator")
        return self.at_place(f, self.number(n.args[0]))

    def array_map(self, n, f):
        return self.plan(N.Collect(N.Pipe(EVERY, n.args[0])), f)

    def array_first(self, n, f):
        return self.at_place(f, 0)

    def array_unique(self, n, f):
        df = f.df.select(*(F.col(f"`{c}`") for c in f.names)).distinct()
        return Frame(df, f.flat, False, tuple(Key(F.col(f"`{c}`")) for c in df.columns))

    def array_unique_by(self, n, f):
        keys = self.keys(n.args, f)
        try:
            rank = rank_of(f)
        except Unsupported:
            place = Window.partitionBy(*(k.col for k in keys)).orderBy(*(k.sorted() for k in f.order))
            return replace(f, df=f.df.withColumn("_first", F.row_number().over(place)).where("_first = 1").drop("_first"))
        # An aggregate meets halfway in each task, so a frequent key is no hot one.
        held = f.kept_order()
        row = F.struct(f.row.col.alias("value"), *(k.col.alias(c) for c, k in held.items()))
        found = f.df.groupBy(*(k.col.alias(f"_k{i}") for i, k in enumerate(keys))).agg((F.first(row) if rank is None else F.min_by(row, rank)).alias("_first"))
        columns = [F.col("_first.value")[c].alias(c) for c in f.names] if f.flat else [F.col("_first.value").alias("value")]
        df = found.select(*columns, *(F.col(f"_first.{c}").alias(c) for c in held))
        return replace(f, df=df, order=tuple(Key(F.col(c), k.down) for c, k in held.items()), hidden=tuple(held))

    def array_group_by(self, n, f):
        return Grouped(f, tuple((k, one(COMPILE(k, self.scope(f)))) for k in _key_parts(n.args[0])))

    def array_min_by(self, n, f):
        """Of equal ones the first."""
        return self.at_place(replace(f, order=(*(Key(k.col) for k in self.keys(n.args, f)), *f.order)), 0)

    def array_max_by(self, n, f):
        """Of equal ones the last."""
        return self.at_place(replace(f, order=(*(Key(k.col, True) for k in self.keys(n.args, f)), *reverse(f.order))), 0)

    def array_JOIN(self, n, f):
        """JOIN($i; key): pairs of each row and what the index holds for its key, by a left join."""
        held = n.args[0]
        if not (len(n.args) == 2 and isinstance(held, N.Variable) and held.name in self.indexes):
            raise Unsupported("JOIN of other than an INDEX of a dataset")
        node, frame = self.with_lookups(N.Index(held, n.args[1]), f)
        found = self.variables[node.name]
        return Frame(frame.df.select(f.row.col.alias("0"), found.col.alias("1")), True, False)

    def array_combinations(self, n, f):
        raise Unsupported("combinations of a dataset")

    # Sets

    def union(self, a: Frame, b: Frame) -> Frame:
        """Values of unlike types, or objects of unlike fields, go on as JSON texts."""
        if a.json or b.json or self.unlike(a, b):
            texts = [x.df.select(self.text(x).alias("value")) for x in (a, b)]
            return Frame(texts[0].union(texts[1]), False, a.stream, json=True)
        rows = [x.df.select(*(F.col(f"`{c}`") for c in x.names)) for x in (a, b)]
        return Frame(rows[0].unionByName(rows[1]), a.flat, a.stream)

    def unlike(self, a: Frame, b: Frame) -> bool:
        if a.flat != b.flat or set(a.names) != set(b.names):
            return True
        for c in a.names:
            x, y = a.df.schema[c].dataType, b.df.schema[c].dataType
            if x != y and not (C.is_number(x) and C.is_number(y)):
                return True
        return False

    def text(self, f: Frame) -> Column:
        """The JSON text of each row."""
        if f.json:
            return F.col("value")
        if isinstance(f.type, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(f.row.col, {"ignoreNullFields": "false"})
        return COMPILE.json(f.row)

    def difference(self, a: Frame, b: Frame) -> Frame:
        """Rows of a that equal none of b; a's own repeats stay. Objects of unlike fields are never equal."""
        if a.json or b.json:
            raise Unsupported("the difference of values without a known type")
        if self.unlike(a, b):
            return a
        other = b.df.select(*(F.col(f"`{c}`").alias(f"_r_{c}") for c in b.names)).distinct()
        same = F.lit(True)
        for c in a.names:
            same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`_r_{c}`"))
        return replace(a, df=a.df.join(other, same, "left_anti"))

    def membership(self, cond: N.Node, f: Frame) -> Frame | None:
        """select(e | IN($t[] | g)), select(e as $x | any($t[] | g; . == $x)) and their opposites: semi and anti joins."""
        how, cond = "left_semi", _rotated(cond)
        if isinstance(cond, N.Pipe) and cond.right == N.Call("not", ()):
            cond, how = cond.left, "left_anti"
        if isinstance(cond, N.Pipe) and isinstance(cond.right, N.Call) and cond.right.name == "IN" and len(cond.right.args) == 1:
            of, among = cond.left, cond.right.args[0]
        elif isinstance(cond, N.Bind) and len(cond.patterns) == 1 and isinstance(x := cond.patterns[0], N.VarPattern) and isinstance(cond.body, N.Call) and cond.body.name == "any" and len(cond.body.args) == 2:
            of, among = cond.source, cond.body.args[0]
            if cond.body.args[1] not in (N.Compare("==", IDENTITY, N.Variable(x.name)), N.Compare("==", N.Variable(x.name), IDENTITY)):
                return None
        else:
            return None
        if not self.walks(_source(among)):
            return None
        value = one(COMPILE(of, self.scope(f)))
        side = self.plan(among, replace(f, stream=False))
        if side.flat:
            raise Unsupported("IN of objects")
        other = side.df.select(F.col("value").alias("_in")).distinct()
        self.tiers.note("T1", N.Call("IN", ()))
        return replace(f, df=f.df.join(other, value.col.eqNullSafe(F.col("_in")), how))

    # Joins

    def bound(self, n: N.Bind, f: Frame) -> Frame | None:
        """INDEX(..) as $i | ..; datasets[] as $x | datasets[] as $y | select(..) | ..."""
        if len(n.patterns) != 1 or not isinstance(n.patterns[0], N.VarPattern):
            return None
        name = n.patterns[0].name
        source = n.source
        if isinstance(source, N.Call) and source.name == "INDEX" and len(source.args) == 2:
            held = self.plan(source.args[0], f)
            self.indexes[name] = (held, source.args[1])
            return self.plan(n.body, f)
        if isinstance(source, N.Iterate) and self.walks(source) or self.walks(source) and isinstance(source, N.Pipe):
            return self.product(n, f)
        if self.walks(source) or isinstance(source, N.Identity) and not f.stream:
            got = self.plan(source, f)
            if not got.single and not got.stream:
                self.datasets[name] = got
                return self.plan(n.body, f)
        if not f.stream and isinstance(source, N.Literal):
            self.variables[name] = literal(source.value)
            self.plain[name] = source.value
            return self.plan(n.body, f)
        return None

    def product(self, n: N.Node, f: Frame) -> Frame:
        sides: dict[str, Frame] = {}
        while isinstance(n, N.Bind) and self.walks(n.source) and isinstance(n.patterns[0], N.VarPattern):
            sides[n.patterns[0].name] = self.plan(n.source, f)
            n = n.body
        conditions: list[N.Node] = []
        while isinstance(n, N.Pipe) and isinstance(n.left, N.Call) and n.left.name == "select":
            conditions += _conjuncts(n.left.args[0])
            n = n.right
        made: DataFrame | None = None
        known: dict[str, One] = {}
        left = list(conditions)
        for name, side in sides.items():
            column = f"_b_{name}"
            wrapped = side.df.select(side.row.col.alias(column))
            known[name] = One(F.col(column), side.type)
            ready = [c for c in left if _uses(c) <= {*known, *self.variables}]
            left = [c for c in left if c not in ready]
            scope = Scope(literal(None), {**self.variables, **known}, self.functions)
            tests = [C.predicate(c, scope) if not _equality(c) else self.equal(c, scope) for c in ready]
            if made is None:
                made = wrapped
                for t in tests:
                    made = made.where(t)
            elif tests:
                both = tests[0]
                for t in tests[1:]:
                    both = both & t
                made = made.join(wrapped, both)
            else:
                made = made.crossJoin(wrapped)
        scope = Scope(literal(None), {**self.variables, **known}, self.functions)
        self.tiers.note("T1", N.Bind(EVERY, (), IDENTITY))
        return self.shown(COMPILE(n, scope), Frame(made, True, True))

    def equal(self, c: N.Compare, scope: Scope) -> Column:
        """Null-safe, in the form that the optimizer knows as an equi-join's."""
        a, b = one(COMPILE(c.left, scope)), one(COMPILE(c.right, scope))
        t = C.common(a.type, b.type)
        return C.cast(a, t).eqNullSafe(C.cast(b, t))

    def with_lookups(self, n: N.Node, f: Frame) -> tuple[N.Node, Frame] | None:
        """Each $i[key] of an INDEX becomes a left join; the found object is then a column's value."""
        uses = [m for m in _all(n) if isinstance(m, N.Index) and isinstance(m.base, N.Variable) and m.base.name in self.indexes]
        if not uses:
            return None
        df = f.df
        for i, m in enumerate(dict.fromkeys(uses)):
            held, by = self.indexes[m.base.name]
            key_node = _untext(m.key)
            key = one(COMPILE(key_node, self.scope(f)))
            own = one(COMPILE(_untext(by), self.scope(held)))
            # Of equal keys the last counts, any one where the dataset has no order.
            rank = rank_of(held)
            found = held.df.select(own.col.cast("string").alias(f"_k{i}"), held.row.col.alias(f"_v{i}"), (F.lit(0) if rank is None else rank).alias("_r"))
            found = found.groupBy(f"_k{i}").agg((F.last(f"_v{i}") if rank is None else F.max_by(f"_v{i}", "_r")).alias(f"_v{i}"))
            df = df.join(found, key.col.cast("string") == F.col(f"_k{i}"), "left").drop(f"_k{i}")
            self.variables[f"_v{i}"] = One(F.col(f"_v{i}"), held.type)
            n = _replace(n, m, N.Variable(f"_v{i}"))
            self.tiers.note("T1", m)
        return n, _narrow(df, f)

    # Aggregation

    def aggregated(self, n: N.Node, f: Frame) -> Frame:
        """One value of the whole dataset."""
        out = Aggregates(self, f, ()).value(n)
        return self._one_row(out, f.df.agg)

    def _one_row(self, out: One, agg: Callable) -> Frame:
        if isinstance(out.type, T.StructType):
            df = agg(out.col.alias("value")).select(*(F.col("value")[c].alias(c) for c in out.type.names))
            return Frame(df, True, False, (), True)
        return Frame(agg(out.col.alias("value")), False, False, (), True)

    def on_groups(self, n: N.Node, g: Grouped) -> Frame | Grouped:
        if g.stream:
            return self.per_group(n, g)
        if isinstance(n, N.Identity):
            return g
        if isinstance(n, N.Pipe):
            return self.plan(n.right, self.on_groups(n.left, g))
        if n == N.Call("length", ()):
            return self._one_row(One(F.count_distinct(F.struct(*(k.col for _, k in g.keys))), LONG), g.frame.df.agg)
        if isinstance(n, N.Call) and n.name == "map":
            return replace(self.plan(n.args[0], replace(g, stream=True)), stream=False)
        if isinstance(n, N.Collect) and n.body is not None:
            return replace(self.plan(n.body, g), stream=False)
        if isinstance(n, N.Iterate) and isinstance(n.base, N.Identity):
            return replace(g, stream=True)
        raise Unsupported("this use of groups")

    def per_group(self, body: N.Node, g: Grouped) -> Frame | Grouped:
        """body for every group: as much of its pipe as there are aggregates for, the rest for each of their rows."""
        parts = _parts(body)
        if parts == [IDENTITY]:
            return g
        having = []
        while parts and isinstance(parts[0], N.Call) and parts[0].name == "select" and len(parts[0].args) == 1:
            having.append(parts.pop(0).args[0])
        names = [f"_g{i}" for i in range(len(g.keys))]
        frame = replace(g.frame, df=g.frame.df.withColumns({name: k.col for name, (_, k) in zip(names, g.keys, strict=True)}))
        keys = tuple((n, One(F.col(name), k.type)) for name, (n, k) in zip(names, g.keys, strict=True))
        of_groups = Aggregates(self, _narrow(frame.df, g.frame), keys)
        kept = [truthy(of_groups.value(c)) for c in having]
        out, used = None, len(parts)
        while out is None:
            try:
                out = of_groups.value(_pipe(parts[:used]))
            except Unsupported:
                used -= 1
                if used < 1:
                    raise
        self.tiers.note("T1", N.Call("group_by", ()))
        made = frame.df.groupBy(*names).agg(out.col.alias("value"), *(c.alias(f"_h{i}") for i, c in enumerate(kept)))
        for i in range(len(kept)):
            made = made.where(F.col(f"_h{i}"))
        flat = isinstance(out.type, T.StructType)
        columns = [F.col("value")[c].alias(c) for c in out.type.names] if flat else ["value"]
        made = Frame(made.select(*columns, *names), flat, True, tuple(Key(F.col(c)) for c in names), hidden=tuple(names))
        return self.plan(_pipe(parts[used:]), made) if used < len(parts) else made

    def reduced(self, n: N.Reduce, f: Frame) -> Frame:
        """reduce .[] as $x with . + e, [., e] | max or min, and by key .[k] += e and .[k] = e (a row for each key of the object)."""
        source = self.plan(n.source, f)
        if not isinstance(n.pattern, N.VarPattern) or not source.stream:
            raise Unsupported("this reduce")
        try:
            start = next(run(n.start, None, self.plain), None)
        except (JqError, ProgramError):
            raise Unsupported("a start of reduce that isn't constant") from None
        scope = Scope(literal(None), {**self.variables, n.pattern.name: source.row}, self.functions)
        u = n.update
        if isinstance(u, N.Assign) and u.op == "+=" and isinstance(u.target, N.Index) and isinstance(u.target.base, N.Identity):
            key, value = one(COMPILE(u.target.key, scope)), one(COMPILE(u.value, scope))
            if not isinstance(key.type, T.StringType) or not C.is_number(value.type) or not (start is None or isinstance(start, dict)):
                raise Unsupported("this update in reduce")
            if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in (start or {}).values()):
                raise Unsupported("a start of other than numbers")
            named = F.when(key.col.isNotNull(), key.col).otherwise(F.raise_error(F.lit("null is no key of an object")))
            kind = LONG if isinstance(value.type, T.IntegralType) and all(isinstance(v, int) for v in (start or {}).values()) else C.DOUBLE
            rows = source.df.select(named.alias("key"), value.col.cast(kind).alias("value"))
            if start:
                rows = rows.union(f.df.sparkSession.createDataFrame([*start.items()], T.StructType([T.StructField("key", C.STRING), T.StructField("value", kind)])))
            return Frame(rows.groupBy("key").agg(F.sum("value").alias("value")), True, False, (Key(F.col("key")),))
        if isinstance(u, N.Arithmetic) and u.op == "+" and isinstance(u.left, N.Identity) and not isinstance(start, (dict, list, str)):
            value, first = one(COMPILE(u.right, scope)), literal(start)
            if not C.is_number(value.type):
                raise Unsupported("this update in reduce")
            t = C.common(first.type, value.type)
            total = F.sum(value.col.cast(t))
            return self._one_row(One(total if start is None else F.coalesce(total, F.lit(0).cast(t)) + first.col, t), source.df.agg)
        if isinstance(u, N.Assign) and u.op == "=" and isinstance(u.target, N.Index) and isinstance(u.target.base, N.Identity) and start in (None, {}):
            key, value, rank = one(COMPILE(u.target.key, scope)), one(COMPILE(u.value, scope)), rank_of(source)
            if rank is None or not isinstance(key.type, T.StringType):
                raise Unsupported("the last of an unordered dataset")
            named = F.when(key.col.isNotNull(), key.col).otherwise(F.raise_error(F.lit("null is no key of an object")))
            out = source.df.groupBy(named.alias("key")).agg(F.max_by(F.struct(value.col.alias("v")), rank)["v"].alias("value"))
            return Frame(out, True, False, (Key(F.col("key")),))
        if isinstance(u, N.Pipe):
            node, fold = _folded(u)
            value, first = one(COMPILE(node, scope)), literal(start)
            t = C.common(first.type, value.type)
            if not C.is_number(t):
                raise Unsupported("the greatest or least of other than numbers")
            if fold == "max":
                return self._one_row(One(F.greatest(F.max(value.col.cast(t)), first.col.cast(t)), t), source.df.agg)
            holes = F.coalesce(F.max(value.col.isNull()), F.lit(False)) | F.lit(start is None)  # null is less than any number
            return self._one_row(One(F.when(~holes, F.least(F.min(value.col.cast(t)), first.col.cast(t))), t), source.df.agg)
        raise Unsupported("this update in reduce")

    def dealt(self, f: Frame, extra: dict[str, Column], names: list[str]) -> tuple[DataFrame, list[Column]]:
        """The columns of names and of extra, dealt by ranges of the order (number _part) and stored; and the order in it.

        Stored, as a range's borders are sampled anew in each run of a plan.
        """
        if not f.order:
            raise Unsupported("places in an unordered dataset")
        held = {f"_o{i}": k.col for i, k in enumerate(f.order)}
        keys = [Key(F.col(f"_o{i}"), k.down).sorted() for i, k in enumerate(f.order)]
        rows = f.df.select(*(F.col(f"`{c}`") for c in names), *(c.alias(name) for name, c in {**held, **extra}.items()))
        return stored(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())), keys

    def numbered(self, f: Frame, names: list[str]) -> DataFrame:
        """The columns of names with the rows' places _i, from 0, in order: ranges are counted, none is sorted with others."""
        dealt, keys = self.dealt(f, {}, names)
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
        rows = dealt.withColumn("_at", place).join(F.broadcast(counts), "_part").withColumn("_i", (F.col("_at") + F.col("_before")).cast("long"))
        return rows.select("_i", *(F.col(f"`{c}`") for c in names))

    def by_place(self, n: N.Bind, f: Frame) -> Frame:
        """range(length) as $i | .. .[$i + k] ..: row numbers, the rows k places on, and slices .[$i : $i + k].

        As in an array, a negative place counts from the end, and one beyond the end has null. Rows with constant k are
        found by a window over runs of PLACES rows, each with the rows next to it; others by a join on the place.
        """
        name = n.patterns[0].name
        found = [m for m in dict.fromkeys(_all(n.body)) if isinstance(m, N.Index) and isinstance(m.base, N.Identity) and name in _uses(m.key)]
        slices = {m: span for m in dict.fromkeys(_all(n.body)) if (span := _span(m, name)) is not None}
        used = _fields_of(n.body, [*found, *slices])
        names = [c for c in f.names if not f.flat or used is None or c in used]
        rows = stored(self.numbered(f, names))
        seen = _narrow(rows, f)
        size = rows.count()
        known = {**self.variables, name: One(F.col("_i"), LONG)}
        steps = [_step(m.key, name) for m in found]
        body = n.body
        if slices and (None in steps or any(end > PLACES for _, end in slices.values())):
            raise Unsupported("these places and slices together")
        if all(k is not None and abs(k) <= PLACES for k in steps):
            df = _with_neighbours(rows.select("_i", seen.row.col.alias("_w")), size, sorted({*steps, 0}), sorted({*slices.values()}))
            for m, (a, b) in slices.items():
                known[f"_s{a}_{b}"] = One(F.col(f"_s{a}_{b}"), T.ArrayType(seen.type))
                body = _replace(body, m, N.Variable(f"_s{a}_{b}"))
            for m, k in zip(found, steps, strict=True):
                known[f"_w{k}"] = One(F.col(f"_w{k}"), seen.type)
                body = _replace(body, m, N.Variable(f"_w{k}"))
        else:
            df = rows.select("_i", seen.row.col.alias("_w0"))
            for k, m in enumerate(found, 1):
                at = one(COMPILE(m.key, Scope(literal(None), known, self.functions)))
                other = rows.select(F.col("_i").alias(f"_j{k}"), seen.row.col.alias(f"_w{k}"))
                wanted = F.when(at.col < 0, at.col + size).otherwise(at.col)
                df = df.join(other, wanted == F.col(f"_j{k}"), "left").drop(f"_j{k}")
                known[f"_w{k}"] = One(F.col(f"_w{k}"), seen.type)
                body = _replace(body, m, N.Variable(f"_w{k}"))
        self.tiers.note("T1", n)
        return self.shown(COMPILE(body, Scope(literal(None), known, self.functions)), Frame(df, True, True, (Key(F.col("_i")),)))

    def running(self, n: N.Foreach, f: Frame) -> Frame:
        """foreach .[] as $x (a; . + e; out) and (a; [., e] | max; out), or min: a running sum, maximum or minimum over the order of rows.

        A window without partition puts all rows into one task, so rows are dealt by ranges of the order,
        folded per range, and every row adds what the ranges before its own give.
        """
        source = self.plan(n.source, f)
        if not (isinstance(n.pattern, N.VarPattern) and source.stream and source.order):
            raise Unsupported("this foreach")
        step_node, fold = _folded(n.update)
        name = n.pattern.name
        scope = Scope(literal(None), {**self.variables, name: source.row}, self.functions)
        step, start = one(COMPILE(step_node, scope)), one(COMPILE(n.start, Scope(literal(None), self.variables, self.functions)))
        t = C.common(start.type, step.type)
        if not C.is_number(t):
            raise Unsupported("a running value of other than numbers")
        used = _fields_of(n.extract or IDENTITY, [N.Variable(name)])
        names = [c for c in source.names if not source.flat or used is None or c in used]
        dealt, keys = self.dealt(source, {"_step": step.col.cast(t)}, names)
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        within = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
        first = F.lit(None).cast(t) if isinstance(start.type, T.NullType) else start.col.cast(t)

        def folded(over: Callable, combine: Callable, step: str) -> Column:
            """over: the aggregate; combine: of the parts, each of which may be null."""
            ranges = dealt.groupBy("_part").agg(over(step).alias("_s")).withColumn("_before", over("_s").over(before)).drop("_s")
            return dealt.withColumn("_run", over(step).over(within)).join(F.broadcast(ranges), "_part").withColumn("_state", combine(F.col("_run"), F.col("_before"), first))

        if fold == "+":
            added = lambda *parts: F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(x, F.lit(0).cast(t)) for x in parts[1:]), F.coalesce(parts[0], F.lit(0).cast(t))))
            made = folded(F.sum, added, "_step")
        elif fold == "max":
            made = folded(F.max, F.greatest, "_step")
        else:  # null is less than any number
            made = folded(F.min, F.least, "_step")
            nulls = F.max(F.col("_step").isNull()).over(within)
            ranges = dealt.groupBy("_part").agg(F.max(F.col("_step").isNull()).alias("_s")).withColumn("_holes", F.max("_s").over(before)).drop("_s")
            holes = nulls | F.coalesce(F.col("_holes"), F.lit(False)) | first.isNull()
            made = made.join(F.broadcast(ranges), "_part").withColumn("_state", F.when(~holes, F.col("_state")))
        state = One(F.col("_state"), t)
        seen = _narrow(made, source)
        out = state if n.extract is None else COMPILE(n.extract, Scope(state, {**self.variables, name: seen.row}, self.functions))
        order = tuple(Key(F.col(f"_o{i}"), k.down) for i, k in enumerate(source.order))
        return self.shown(out, Frame(made, True, True, order))


class Aggregates:
    """Expressions whose input is all rows (of a group) as an array, compiled to aggregate columns."""

    def __init__(self, planner: Planner, frame: Frame, keys: tuple[tuple[N.Node, One], ...]):
        self.p, self.f, self.keys = planner, frame, keys

    def value(self, n: N.Node) -> One:
        if isinstance(n, N.Literal):
            return literal(n.value)
        if isinstance(n, N.Variable) and n.name in self.p.variables:
            return self.p.variables[n.name]
        if isinstance(n, N.Build):
            made = [(str(k.value), self.value(v)) for k, v in n.entries]
            return One(F.struct(*(v.col.alias(k) for k, v in made)), T.StructType([T.StructField(k, v.type) for k, v in made]))
        if isinstance(n, N.Arithmetic):
            return C.arithmetic(n.op, self.value(n.left), self.value(n.right))
        if isinstance(n, N.Compare):
            return C.compare(n.op, self.value(n.left), self.value(n.right))
        key = self.key_of(n)
        if key is not None:
            return key
        base, name = (n.base, n.name) if isinstance(n, N.Field) else (None, None)
        if base is not None:
            return C.pick_field(self.value(base), name)
        if n in (N.Index(IDENTITY, N.Literal(0)), N.Call("first", ())):
            rank = rank_of(self.f)
            return One(F.first(self.f.row.col) if rank is None else F.min_by(self.f.row.col, rank), self.f.type)
        if n in (N.Index(IDENTITY, N.Negate(N.Literal(1))), N.Index(IDENTITY, N.Literal(-1)), N.Call("last", ())) and (rank := rank_of(self.f)) is not None:
            return One(F.max_by(self.f.row.col, rank), self.f.type)
        if isinstance(n, N.Call) and n.name in ("min_by", "max_by") and len(n.args) == 1:
            by = [one(COMPILE(k, self.p.scope(self.f))) for k in _key_parts(n.args[0])]
            rank = rank_of(self.f, *by)  # of equal keys the first, or the last
            return One((F.min_by if n.name == "min_by" else F.max_by)(self.f.row.col, rank), self.f.type)
        if isinstance(n, N.Pipe):
            n = _rotated(n)
            if isinstance(n.left, N.Pipe) and (n.left.right, n.right) == (N.Call("unique", ()), N.Call("length", ())) and (rows := self.elements(n.left.left)) is not None:
                row, cond = rows
                holes = row.col.isNull() if cond is None else cond & row.col.isNull()
                return One(F.count_distinct(row.col if cond is None else F.when(cond, row.col)) + F.coalesce(F.max(holes.cast("long")), F.lit(0)), LONG)
            rows = self.elements(n.left)
            if rows is not None and isinstance(n.right, N.Call) and (done := self.terminal(n.right, *rows)) is not None:
                return done
            left = self.value(n.left) if rows is None else self.collected(*rows)
            return one(COMPILE(n.right, Scope(left, self.p.variables, self.p.functions)))
        if isinstance(n, N.Call):
            done = self.terminal(n, self.f.row, None)
            if done is not None:
                return done
            if n.name in ("any", "all") and n.args:
                rows = (self.f.row, None) if len(n.args) == 1 else self.elements(N.Collect(n.args[0]))
                if rows is not None:
                    return self.terminal(N.Call(n.name, ()), *self.each(n.args[-1], *rows))
            if n.name == "add" and len(n.args) == 1:
                rows = self.elements(N.Collect(n.args[0]))
                if rows is not None:
                    return self.terminal(N.Call("add", ()), *rows)
        if (rows := self.elements(n)) is not None:
            return self.collected(*rows)
        if isinstance(n, N.Collect) and n.body is not None:
            made = [self.value(x) for x in _commas(n.body)]
            t = made[0].type
            for x in made[1:]:
                t = C.common(t, x.type)
            return One(F.array(*(C.cast(x, t) for x in made)), T.ArrayType(t))
        raise Unsupported(f"{type(n).__name__} of a group")

    def collected(self, row: One, cond: Column | None) -> One:
        """The array of what the rows of a group give, in their order. All rows of a dataset are no such group."""
        if not self.keys:
            raise Unsupported("an array of all rows")
        rank = rank_of(self.f)
        held = F.struct((F.lit(0) if rank is None else rank).alias("r"), row.col.alias("v"))
        found = F.collect_list(held if cond is None else F.when(cond, held))
        return One((found if rank is None else F.array_sort(found, lambda a, b: F.when(a["r"] < b["r"], -1).when(a["r"] > b["r"], 1).otherwise(0)))["v"], T.ArrayType(row.type))

    def key_of(self, n: N.Node) -> One | None:
        """.[0].k of a group: the group's key, if k is one."""
        for k, v in self.keys:
            for start in (N.Index(IDENTITY, N.Literal(0)), N.Call("first", ())):
                if n in (_replace(k, IDENTITY, start), N.Pipe(start, k)):
                    return v
        return None

    def elements(self, n: N.Node) -> tuple[One, Column | None] | None:
        """What each row gives, and which rows count, of .[], map(..), [.[] | ..] and pipes of them."""
        if isinstance(n, N.Identity):
            return self.f.row, None
        if isinstance(n, N.Pipe):
            rows = self.elements(n.left)
            if rows is None or not (isinstance(n.right, N.Call) and n.right.name in ("map", "unique", "sort") or isinstance(n.right, N.Collect)):
                return None
            if isinstance(n.right, N.Call) and n.right.name != "map":
                return None
            inner = n.right.args[0] if isinstance(n.right, N.Call) else _after_every(n.right)
            return None if inner is None else self.each(inner, *rows)
        if isinstance(n, N.Call) and n.name == "map":
            return self.each(n.args[0], self.f.row, None)
        if isinstance(n, N.Collect) and n.body is not None and (inner := _after_every(n)) is not None:
            return self.each(inner, self.f.row, None)
        return None

    def each(self, n: N.Node, row: One, cond: Column | None) -> tuple[One, Column | None]:
        scope = Scope(row, self.p.variables, self.p.functions)
        if isinstance(n, N.Pipe):
            row, cond = self.each(n.left, row, cond)
            return self.each(n.right, row, cond)
        if isinstance(n, N.Call) and n.name == "select":
            test = truthy(one(COMPILE(n.args[0], scope)))
            return row, test if cond is None else cond & test
        return one(COMPILE(n, scope)), cond

    def terminal(self, n: N.Call, row: One, cond: Column | None) -> One | None:
        col = row.col if cond is None else F.when(cond, row.col)
        number = C.is_number(row.type)
        if n == N.Call("length", ()):
            return One(F.count(F.lit(1)) if cond is None else F.count(F.when(cond, 1)), LONG)
        if n == N.Call("add", ()) and number:
            return One(F.sum(col), LONG if isinstance(row.type, T.IntegralType) else C.DOUBLE)
        if n == N.Call("max", ()):
            return One(F.max(col), row.type)
        if n == N.Call("min", ()):
            holes = row.col.isNull() if cond is None else cond & row.col.isNull()
            return One(F.when(F.max(holes), F.lit(None)).otherwise(F.min(col)), row.type)
        if n == N.Call("any", ()):
            return One(F.coalesce(F.bool_or(truthy(One(col, row.type))), F.lit(False)), C.BOOL)
        if n == N.Call("all", ()):
            test = truthy(row)
            return One(F.coalesce(F.bool_and(test if cond is None else F.when(cond, test)), F.lit(True)), C.BOOL)
        if n == N.Call("unique", ()):
            hole = row.col.isNull() if cond is None else cond & row.col.isNull()
            none = F.array().cast(T.ArrayType(row.type))
            nulls = F.when(F.max(hole), F.array(F.lit(None).cast(row.type))).otherwise(none)
            return One(F.concat(nulls, F.sort_array(F.collect_set(col))), T.ArrayType(row.type))
        return None


def _key_parts(n: N.Node) -> list[N.Node]:
    """The parts of an array as a key; of a generator the first output is the key."""
    while isinstance(n, N.Comma):
        n = n.left
    if not (isinstance(n, N.Collect) and n.body is not None):
        return [n]
    parts, todo = [], [n.body]
    while todo:
        n = todo.pop(0)
        if isinstance(n, N.Comma):
            todo = [n.left, n.right, *todo]
        else:
            parts.append(n)
    return parts


def _folded(u: N.Node) -> tuple[N.Node, str]:
    """What each row adds to the state, and how: "+" of . + e, "max" of [., e] | max."""
    if isinstance(u, N.Arithmetic) and u.op == "+" and isinstance(u.left, N.Identity):
        return u.right, "+"
    if isinstance(u, N.Pipe) and u.right in (N.Call("max", ()), N.Call("min", ())) and isinstance(u.left, N.Collect) and isinstance(u.left.body, N.Comma) and isinstance(u.left.body.left, N.Identity):
        return u.left.body.right, u.right.name
    raise Unsupported("this update in foreach")


#: Rows of a run whose neighbours are looked up together.
PLACES = 50_000


def _step(key: N.Node, name: str) -> int | None:
    """k of $i + k, None for other places."""
    if key == N.Variable(name):
        return 0
    if isinstance(key, N.Arithmetic) and key.op in "+-" and key.left == N.Variable(name) and isinstance(key.right, N.Literal) and type(key.right.value) is int:
        return key.right.value if key.op == "+" else -key.right.value
    return None


def _span(n: N.Node, name: str) -> tuple[int, int] | None:
    """a and b of .[$i + a : $i + b], neither below 0."""
    if not (isinstance(n, N.Slice) and isinstance(n.base, N.Identity) and n.start and n.end):
        return None
    a, b = _step(n.start, name), _step(n.end, name)
    return None if a is None or b is None or a < 0 or b < 0 else (a, b)


def _with_neighbours(rows: DataFrame, size: int, steps: list[int], spans: list[tuple[int, int]]) -> DataFrame:
    """rows (_i, _w) of places 0 to size - 1, with _w<k> of the row k places on for every step k, and _s<a>_<b> of the rows of every span.

    Each run of PLACES places gets the rows just before and after it, and the first run the last rows, as places below 0.
    """
    reach = max([*map(abs, steps), *(b for _, b in spans)])
    i, n = F.col("_i"), F.lit(PLACES)
    run_of = F.floor(i / n)
    copies = [(F.lit(True), run_of, i)]
    if reach:
        copies += [(i % n < reach, run_of - 1, i), (i % n >= n - reach, run_of + 1, i), (i >= size - reach, F.lit(0), i - size)]
    placed = F.array(*(F.when(test, F.struct(run.cast("long").alias("run"), at.cast("long").alias("at"))) for test, run, at in copies))
    each = rows.withColumn("_p", F.explode(F.filter(placed, lambda x: x.isNotNull()))).select("_w", F.col("_p.run").alias("_run"), F.col("_p.at").alias("_i"))
    over = Window.partitionBy("_run").orderBy("_i")
    each = each.withColumns({f"_w{k}": F.lead("_w", k).over(over) if k > 0 else F.lag("_w", -k).over(over) if k else F.col("_w") for k in steps})
    part = lambda a, b: F.collect_list(F.struct("_w")).over(over.rowsBetween(a, b - 1))["_w"] if a < b else F.slice(F.array("_w"), 1, 0)
    each = each.withColumns({f"_s{a}_{b}": part(a, b) for a, b in spans}) if spans else each
    return each.where((F.col("_i") >= 0) & (F.floor(i / n) == F.col("_run"))).drop("_run", "_w")


def _fields_of(n: N.Node, wholes: list[N.Node]) -> set[str] | None:
    """The fields that n uses of the objects that wholes stand for; None where it may use all."""
    if n in wholes:
        return None
    if isinstance(n, N.Field) and n.base in wholes:
        return {n.name}
    out: set[str] = set()
    for c in n.children():
        found = _fields_of(c, wholes)
        if found is None:
            return None
        out |= found
    return out


def _parts(n: N.Node) -> list[N.Node]:
    return [*_parts(n.left), *_parts(n.right)] if isinstance(n, N.Pipe) else [n]


def _commas(n: N.Node) -> list[N.Node]:
    return [*_commas(n.left), *_commas(n.right)] if isinstance(n, N.Comma) else [n]


def _pipe(parts: list[N.Node]) -> N.Node:
    if not parts:
        return IDENTITY
    out = parts[0]
    for p in parts[1:]:
        out = N.Pipe(out, p)
    return out


def _narrow(df: DataFrame, f: Frame) -> Frame:
    """df as the frame's rows: its columns that are none of theirs are hidden."""
    return replace(f, df=df, hidden=tuple(c for c in df.columns if c not in f.names))


def _source(n: N.Node) -> N.Node:
    while isinstance(n, (N.Pipe, N.Field)):
        n = n.left if isinstance(n, N.Pipe) else n.base
    return n


def _after_every(n: N.Collect) -> N.Node | None:
    """f of [.[] | f], and of [.[].a]."""
    b = n.body
    if b == EVERY:
        return IDENTITY
    if isinstance(b, N.Pipe):
        if b.left == EVERY:
            return b.right
        head = _after_every(N.Collect(b.left))
        return None if head is None else N.Pipe(head, b.right)
    if isinstance(b, N.Field):
        head = _after_every(N.Collect(b.base))
        return None if head is None else N.Field(head, b.name) if isinstance(head, N.Identity) else N.Pipe(head, N.Field(IDENTITY, b.name))
    return None


def _all(n: N.Node):
    yield n
    for c in n.children():
        yield from _all(c)


def _rotated(n: N.Node) -> N.Node:
    """A pipe's first parts together: (a | b) | c."""
    while isinstance(n, N.Pipe) and isinstance(n.right, N.Pipe):
        n = N.Pipe(N.Pipe(n.left, n.right.left), n.right.right)
    return n


def _uses(n: N.Node) -> set[str]:
    return {m.name for m in _all(n) if isinstance(m, N.Variable)}


def _conjuncts(n: N.Node) -> list[N.Node]:
    return [*_conjuncts(n.left), *_conjuncts(n.right)] if isinstance(n, N.Logic) and n.op == "and" else [n]


def _equality(n: N.Node) -> bool:
    return isinstance(n, N.Compare) and n.op == "==" and len(_uses(n)) > 1


def _untext(n: N.Node) -> N.Node:
    return n.left if isinstance(n, N.Pipe) and n.right == N.Call("tostring", ()) else n


def _replace(n: Any, old: N.Node, new: N.Node) -> Any:
    if n == old:
        return new
    if isinstance(n, tuple):
        return tuple(_replace(x, old, new) for x in n)
    if isinstance(n, N.Node):
        from dataclasses import fields

        return type(n)(*(_replace(getattr(n, f.name), old, new) for f in fields(n)))
    return n
