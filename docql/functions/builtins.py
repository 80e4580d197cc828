"""Builtin functions of the interpreter. Each takes (input, argument nodes, environment) and yields outputs."""

from __future__ import annotations

import calendar
import datetime as dt
import math
import re
import time
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

from docql.functions import formats
from docql.functions import values as V
from docql.functions.interpret import NONE, Env, Halt, first, iterate, places, recurse_places, truthy, values
from docql.functions.values import JqError, kind, number, whole
from docql.plans import nodes as N

Builtin = Callable[[Any, tuple, Env], Iterator[Any]]
BUILTINS: dict[tuple[str, int], Builtin] = {}
PLACE_BUILTINS: dict[tuple[str, int], Callable] = {}
STEPS = 10_000


def plain(name: str, arity: int = 0):
    """Registers a function of the input and of the arguments' values; once for each combination of these."""

    def add(f):
        def run(x, args, env):
            def rest(i, done):
                if i < 0:
                    try:
                        out = f(x, *done)
                    except (TypeError, AttributeError, KeyError, IndexError, ValueError):
                        raise JqError(f"{kind(x)} ({V.short(x)}) cannot be given to {name}/{arity}") from None
                    yield out
                else:
                    for v in values(args[i], x, env):
                        yield from rest(i - 1, [v, *done])

            return rest(len(args) - 1, [])

        BUILTINS[name, arity] = run
        return f

    return add


def generator(name: str, arity: int = 0):
    def add(f):
        BUILTINS[name, arity] = f
        return f

    return add


def at_places(name: str, arity: int = 0):
    def add(f):
        PLACE_BUILTINS[name, arity] = f
        return f

    return add


def need(v: Any, *kinds: str, what: str = "used here") -> Any:
    if kind(v) not in kinds:
        raise JqError(f"{kind(v)} ({V.short(v)}) cannot be {what}")
    return v


# Types and conversion


@plain("length")
def length(x):
    if x is None:
        return 0
    if isinstance(x, str):
        return len(x.encode("utf-16-le", "surrogatepass")) // 2
    if isinstance(x, (list, dict)):
        return len(x)
    return abs(need(x, "number", what="measured: it has no length"))


plain("utf8bytelength")(lambda x: len(need(x, "string", what="measured in bytes").encode()))
plain("not")(lambda x: not truthy(x))
plain("type")(kind)
for _name, _value in (("null", None), ("true", True), ("false", False), ("nan", math.nan), ("infinite", math.inf), ("have_decnum", True), ("input_line_number", None)):
    plain(_name)(lambda x, v=_value: v)
plain("tostring")(formats.text)
plain("tojson")(V.dumps)
plain("fromjson")(lambda x: V.parse(need(x, "string", what="parsed"), strict=True))
plain("ascii")(lambda x: chr(int(need(x, "number", what="a character"))))
plain("abs")(lambda x: abs(x) if number(x) else x)
plain("builtins")(lambda x: sorted(f"{n}/{a}" for n, a in BUILTINS))
_KINDS = {"nulls": "null", "booleans": "boolean", "numbers": "number", "strings": "string", "arrays": "array", "objects": "object"}
TESTS = {name: (lambda x, k=k: kind(x) == k) for name, k in _KINDS.items()} | {
    "values": lambda x: x is not None,
    "iterables": lambda x: isinstance(x, (list, dict)),
    "scalars": lambda x: not isinstance(x, (list, dict)),
}
for _name, _test in TESTS.items():
    generator(_name)(lambda x, args, env, t=_test: iter((x,) if t(x) else ()))
    at_places(_name)(lambda at, args, env, t=_test: iter((at,) if t(at[1]) else ()))


@plain("tonumber")
def tonumber(x):
    if number(x):
        return x
    text = need(x, "string", what="parsed as a number").strip()
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        raise JqError(f"Cannot parse '{x}' as a number")
    return int(text) if re.fullmatch(r"[+-]?\d+", text) and abs(int(text)) < 2**63 else whole(float(text))


@plain("toboolean")
def toboolean(x):
    if isinstance(x, bool):
        return x
    if x in ("true", "false"):
        return x == "true"
    raise JqError(f"{kind(x)} ({V.short(x)}) cannot be parsed as a boolean")


@plain("type_error")
def type_error(x):
    raise JqError(f"{kind(x)} is not valid")


# Control


generator("empty")(lambda x, args, env: iter(()))
at_places("empty")(lambda at, args, env: iter(()))


@generator("error")
def error(x, args, env):
    raise JqError(x)
    yield


@generator("error", 1)
def error_with(x, args, env):
    raise JqError(first(values(args[0], x, env)))
    yield


at_places("error")(lambda at, args, env: error(at[1], args, env))
at_places("error", 1)(lambda at, args, env: error_with(at[1], args, env))


def _halt(code, value=None):
    raise Halt(code, value)


plain("halt")(lambda x: _halt(0))
plain("halt_error")(lambda x: _halt(5, x))
plain("halt_error", 1)(lambda x, code: _halt(int(code), x))


def _say(name: str, arity: int, show):
    @generator(name, arity)
    def run(x, args, env):
        for m in values(args[0], x, env) if args else (x,):
            env.context.say(show(m))
        yield x


_say("debug", 0, lambda m: V.dumps(["DEBUG:", m]))
_say("debug", 1, lambda m: V.dumps(["DEBUG:", m]))
_say("stderr", 0, V.dumps)


@generator("select", 1)
def select(x, args, env):
    return (x for t in values(args[0], x, env) if truthy(t))


at_places("select", 1)(lambda at, args, env: (at for t in values(args[0], at[1], env) if truthy(t)))
generator("env")(lambda x, args, env: iter((env.context.environment,)))


@generator("input")
def one_input(x, args, env):
    v = next(env.context.inputs, NONE) if env.context.inputs is not None else NONE
    if v is NONE:
        raise JqError("break")
    yield v


@generator("inputs")
def all_inputs(x, args, env):
    if env.context.inputs is None:
        raise JqError("No inputs")
    yield from env.context.inputs


plain("now")(lambda x: round(time.time(), 3))

# Streams of outputs


def _limited(n, it: Iterator) -> Iterator:
    if n < 0:
        raise JqError("Invalid arguments: negative limit")
    return islice(it, math.ceil(n))


generator("limit", 2)(lambda x, args, env: (v for n in values(args[0], x, env) for v in _limited(n, values(args[1], x, env))))
at_places("limit", 2)(lambda at, args, env: (p for n in values(args[0], at[1], env) for p in _limited(n, places(args[1], at, env))))


def _skipped(n, it: Iterator) -> Iterator:
    if n < 0:
        raise JqError("Invalid arguments: negative skip")
    return islice(it, math.ceil(n), None)


generator("skip", 2)(lambda x, args, env: (v for n in values(args[0], x, env) for v in _skipped(n, values(args[1], x, env))))
at_places("skip", 2)(lambda at, args, env: (p for n in values(args[0], at[1], env) for p in _skipped(n, places(args[1], at, env))))
generator("first")(lambda x, args, env: iter(x[:1] if isinstance(x, list) else ()))
generator("last")(lambda x, args, env: iter(x[-1:] if isinstance(x, list) else ()))
at_places("first")(lambda at, args, env: iter([([*at[0], 0], at[1][0])] if at[1] else []))
at_places("last")(lambda at, args, env: iter([([*at[0], -1], at[1][-1])] if at[1] else []))
generator("first", 1)(lambda x, args, env: islice(values(args[0], x, env), 1))
at_places("first", 1)(lambda at, args, env: islice(places(args[0], at, env), 1))


def _last(it: Iterator) -> Iterator:
    v = NONE
    for v in it:  # noqa: B007
        pass
    return iter(() if v is NONE else (v,))


generator("last", 1)(lambda x, args, env: _last(values(args[0], x, env)))
at_places("last", 1)(lambda at, args, env: _last(places(args[0], at, env)))
generator("nth", 1)(lambda x, args, env: (x[int(n)] for n in values(args[0], x, env) if isinstance(x, list) and 0 <= n < len(x)))


def _nth(n, it: Iterator) -> Iterator:
    if n < 0:
        raise JqError("Out of bounds negative array index")
    return islice(it, int(n), int(n) + 1)


generator("nth", 2)(lambda x, args, env: (v for n in values(args[0], x, env) for v in _nth(n, values(args[1], x, env))))
at_places("nth", 2)(lambda at, args, env: (p for n in values(args[0], at[1], env) for p in _nth(n, places(args[1], at, env))))
generator("isempty", 1)(lambda x, args, env: iter((first(values(args[0], x, env), NONE) is NONE,)))


def _range(start, end, step=1):
    if not (number(start) and number(end) and number(step)):
        raise JqError("Range bounds must be numeric")
    if step == 0:
        return
    if all(isinstance(v, int) for v in (start, end, step)):
        yield from range(start, end, step)
        return
    v = start
    while v < end if step > 0 else v > end:
        yield whole(v)
        v += step


generator("range", 1)(lambda x, args, env: (v for n in values(args[0], x, env) for v in _range(0, int(n) if number(n) and math.isfinite(n) else n)))
generator("range", 2)(lambda x, args, env: (v for b in values(args[1], x, env) for a in values(args[0], x, env) for v in _range(int(a), int(b))))
generator("range", 3)(lambda x, args, env: (v for s in values(args[2], x, env) for b in values(args[1], x, env) for a in values(args[0], x, env) for v in _range(a, b, s)))


def _following(x, step, test=None, emit_all=True):
    """x, step(x), ... while test holds; ends after STEPS."""
    for _ in range(STEPS):
        if test and not truthy(test(x)):
            return
        yield x
        x = first(step(x), NONE)
        if x is NONE:
            return


generator("repeat", 1)(lambda x, args, env: _following(x, lambda v: values(args[0], v, env)))
generator("while", 2)(lambda x, args, env: _following(x, lambda v: values(args[1], v, env), lambda v: first(values(args[0], v, env))))


@generator("until", 2)
def until(x, args, env):
    for _ in range(STEPS):
        if truthy(first(values(args[0], x, env))):
            break
        x = first(values(args[1], x, env), x)
    yield x


generator("recurse")(lambda x, args, env: values(N.RecurseAll(), x, env))
at_places("recurse")(lambda at, args, env: recurse_places(at))


@generator("recurse", 1)
def recurse_with(x, args, env):
    """Before its descendants, each value once; an error ends its branch."""
    seen: set[str] = set()
    todo = [iter((x,))]
    while todo:
        try:
            v = next(todo[-1], NONE)
        except JqError:
            v = NONE
        if v is NONE:
            todo.pop()
        elif (text := V.dumps(v)) not in seen:
            seen.add(text)
            yield v
            todo.append(values(args[0], v, env))


@generator("recurse", 2)
def recurse_while(x, args, env):
    todo = [iter((x,))]
    while todo:
        try:
            v = next(todo[-1], NONE)
            good = v is not NONE and truthy(first(values(args[1], v, env)))
        except JqError:
            v, good = NONE, False
        if v is NONE:
            todo.pop()
        elif good:
            yield v
            todo.append(values(args[0], v, env))


@at_places("recurse", 1)
def recurse_places_with(at, args, env):
    yield at
    for p in places(args[0], at, env):
        yield from recurse_places_with(p, args, env)


# Arrays


def array(x, what="used as an array"):
    return need(x, "array", what=what)


generator("map", 1)(lambda x, args, env: iter(([w for v in array(x, "mapped") for w in values(args[0], v, env)],)))
at_places("map", 1)(lambda at, args, env: (q for i, v in iterate(at[1]) for q in places(args[0], ([*at[0], i], v), env)))


@generator("map_values", 1)
def map_values(x, args, env):
    if isinstance(x, dict):
        yield {k: w for k, v in x.items() for w in islice(values(args[0], v, env), 1)}
    else:
        yield [w for v in array(x, "mapped") for w in values(args[0], v, env)]


def _sum(items):
    out = None
    for v in items:
        out = V.add(out, v)
    return out


plain("add")(lambda x: _sum(x.values() if isinstance(x, dict) else array(x, "added up")))
generator("add", 1)(lambda x, args, env: iter((_sum(values(args[0], x, env)),)))
plain("any")(lambda x: any(truthy(v) for _, v in iterate(x)))
plain("all")(lambda x: all(truthy(v) for _, v in iterate(x)))
generator("any", 1)(lambda x, args, env: iter((any(truthy(t) for _, v in iterate(x) for t in values(args[0], v, env)),)))
generator("all", 1)(lambda x, args, env: iter((all(any(truthy(t) for t in values(args[0], v, env)) for _, v in iterate(x)),)))
generator("any", 2)(lambda x, args, env: iter((any(truthy(t) for v in values(args[0], x, env) for t in values(args[1], v, env)),)))
generator("all", 2)(lambda x, args, env: iter((all(truthy(t) for v in values(args[0], x, env) for t in values(args[1], v, env)),)))


def _flat(x, depth):
    for v in x:
        if isinstance(v, list) and depth != 0:
            yield from _flat(v, depth - 1)
        else:
            yield v


plain("flatten")(lambda x: [*_flat(array(x, "flattened"), -1)])


@plain("flatten", 1)
def flatten(x, depth):
    if depth < 0:
        raise JqError("flatten depth must not be negative")
    return [*_flat(array(x, "flattened"), depth)]


plain("sort")(lambda x: sorted(array(x, "sorted, as it is not an array"), key=V.order_key))


def _all(node, v, env):
    return [*values(node, v, env)]


def _one(node, v, env):
    return first(values(node, v, env))


generator("sort_by", 1)(lambda x, args, env: iter((sorted(array(x, "sorted"), key=lambda v: V.order_key(_all(args[0], v, env))),)))


@generator("group_by", 1)
def group_by(x, args, env):
    keyed = sorted(((_one(args[0], v, env), v) for v in array(x, "grouped")), key=lambda e: V.order_key(e[0]))
    groups: dict[str, list] = {}
    for k, v in keyed:
        groups.setdefault(V.dumps(k), []).append(v)
    yield [*groups.values()]


@plain("unique")
def unique(x):
    out: list = []
    for v in sorted(array(x, "made unique"), key=V.order_key):
        if not out or not V.equal(out[-1], v):
            out.append(v)
    return out


@generator("unique_by", 1)
def unique_by(x, args, env):
    kept: dict[str, Any] = {}
    for v in array(x, "made unique"):
        kept.setdefault(V.dumps(_one(args[0], v, env)), v)
    yield [*kept.values()]


plain("min")(lambda x: min(array(x, "compared"), key=V.order_key, default=None))
plain("max")(lambda x: max(array(x, "compared"), key=V.order_key, default=None))
generator("min_by", 1)(lambda x, args, env: iter((min(array(x), key=lambda v: V.order_key(_one(args[0], v, env)), default=None),)))
generator("max_by", 1)(lambda x, args, env: iter((max(reversed(array(x)), key=lambda v: V.order_key(_one(args[0], v, env)), default=None),)))
plain("reverse")(lambda x: x[::-1] if isinstance(x, str) else [] if x is None else array(x, "reversed")[::-1])
plain("transpose")(lambda x: [[r[i] if i < len(r) else None for r in x] for i in range(max(map(len, array(x)), default=0))])


@plain("bsearch", 1)
def bsearch(x, target):
    keys = [V.order_key(v) for v in array(x, "searched")]
    i = bisect_left(keys, V.order_key(target))
    return i if i < len(x) and V.equal(x[i], target) else -1 - i


def _combinations(lists):
    if not lists:
        yield []
        return
    for v in array(lists[0], "combined"):
        for rest in _combinations(lists[1:]):
            yield [v, *rest]


generator("combinations")(lambda x, args, env: _combinations(array(x, "combined")))
generator("combinations", 1)(lambda x, args, env: (c for n in values(args[0], x, env) for c in _combinations([array(x, "combined")] * int(n))))


def contains(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(kind(x) == kind(y) and contains(x, y) for x in a) for y in b)
    if isinstance(a, str) and isinstance(b, str):
        return b in a
    if kind(a) == kind(b):
        return V.equal(a, b)
    raise JqError(f"{kind(a)} ({V.short(a)}) and {kind(b)} ({V.short(b)}) cannot have their containment checked")


plain("contains", 1)(contains)
plain("inside", 1)(lambda x, other: contains(other, x))
plain("indices", 1)(V.positions)
plain("index", 1)(lambda x, part: next(iter(V.positions(x, part) or ()), None))
plain("rindex", 1)(lambda x, part: next(iter(reversed(V.positions(x, part) or ())), None))


def has(x, key):
    if isinstance(x, dict) and isinstance(key, str):
        return key in x
    if isinstance(x, list) and number(key):
        return key == key and 0 <= key < len(x)
    raise JqError(f"Cannot check whether {kind(x)} has a {kind(key)} key")


plain("has", 1)(has)
plain("in", 1)(lambda x, holder: has(holder, x))
generator("IN", 1)(lambda x, args, env: iter((any(V.equal(v, x) for v in values(args[0], x, env)),)))


@generator("IN", 2)
def in_both(x, args, env):
    known = {V.order_key(v) for v in values(args[1], x, env)}
    yield any(V.order_key(v) in known for v in values(args[0], x, env))


generator("INDEX", 2)(lambda x, args, env: iter(({formats.text(_one(args[1], v, env)): v for v in values(args[0], x, env)},)))


@generator("JOIN", 2)
def join_lookup(x, args, env):
    for held in values(args[0], x, env):
        yield [[v, need(held, "object", what="looked up in").get(formats.text(_one(args[1], v, env)))] for v in array(x, "joined")]


# Objects and paths

plain("keys")(lambda x: sorted(x, key=V.text_key) if isinstance(x, dict) else [*range(len(need(x, "array", what="asked for keys: it has none")))])
plain("keys_unsorted")(lambda x: [*need(x, "object", what="asked for keys: it has none")])
plain("to_entries")(lambda x: [{"key": k, "value": v} for k, v in need(x, "object", what="made into entries").items()])


def _entry(e):
    if not isinstance(e, dict):
        raise JqError(f"Cannot index {kind(e)} with \"key\"")
    key = next((e[k] for k in ("key", "Key", "name", "Name") if e.get(k) is not None and e.get(k) is not False), e.get("key"))
    return formats.text(key), next((e[k] for k in ("value", "Value") if k in e), None)


plain("from_entries")(lambda x: dict(map(_entry, array(x, "made into an object"))))


@generator("with_entries", 1)
def with_entries(x, args, env):
    yield dict(_entry(w) for k, v in need(x, "object", what="made into entries").items() for w in values(args[0], {"key": k, "value": v}, env))


generator("path", 1)(lambda x, args, env: (p for p, _ in places(args[0], ([], x), env)))


def path_of(v):
    return need(v, "array", what="used as a path")


plain("getpath", 1)(lambda x, p: V.get_path(x, path_of(p)))
at_places("getpath", 1)(lambda at, args, env: (([*at[0], *p], V.get_path(at[1], p)) for p in values(args[0], at[1], env)))
plain("setpath", 2)(lambda x, p, v: V.set_path(x, path_of(p), v))
plain("delpaths", 1)(lambda x, ps: V.delete_paths(x, array(ps)))
generator("del", 1)(lambda x, args, env: iter((V.delete_paths(x, [p for p, _ in places(args[0], ([], x), env)]),)))


@generator("pick", 1)
def pick(x, args, env):
    out = None
    for p, v in places(args[0], ([], x), env):
        out = V.set_path(out, p, v)
    yield out


generator("paths")(lambda x, args, env: (p for p, _ in recurse_places(([], x)) if p))
generator("paths", 1)(lambda x, args, env: (p for p, v in recurse_places(([], x)) if truthy(_one(args[0], v, env))))
generator("leaf_paths")(lambda x, args, env: (p for p, v in recurse_places(([], x)) if not isinstance(v, (list, dict))))


@generator("walk", 1)
def walk(x, args, env):
    def inner(v):
        if isinstance(v, dict):
            v = {k: w for k, c in v.items() for w in islice(inner(c), 1)}
        elif isinstance(v, list):
            v = [w for c in v for w in islice(inner(c), 1)]
        return values(args[0], v, env)

    return inner(x)


def _events(x, path=()):
    if isinstance(x, (list, dict)) and x:
        last = None
        for k, v in iterate(x):
            yield from _events(v, (*path, k))
            last = k
        yield [[*path, last]]
    else:
        yield [[*path], x]


@generator("tostream")
def tostream(x, args, env):
    for e in _events(x):
        yield e if len(e) == 2 else [e[0][:-1], not e[0][:-1]]


@generator("fromstream", 1)
def fromstream(x, args, env):
    """Leaves [path, value] build a document; [path, bool] of a container's end, or one-element events, close it at the top."""
    out, began = None, False
    for e in values(args[0], x, env):
        path = e[0]
        closing = len(e) == 1 and len(path) == 1 or len(e) == 2 and e == [[], True] and began
        if closing:
            yield out
            out, began = None, False
        elif len(e) == 2 and not path:
            yield e[1]
        elif len(e) == 2 and not (isinstance(e[1], bool) and isinstance(V.get_path(out, path), (list, dict))):
            out, began = V.set_path(out, path, e[1]), True


@generator("truncate_stream", 1)
def truncate_stream(x, args, env):
    for e in values(args[0], x, env):
        if len(e[0]) > 1:
            yield [e[0][1:], *e[1:]]


# Strings

UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def string(x, what="used as a string"):
    return need(x, "string", what=what)


plain("ascii_downcase")(lambda x: string(x, "lowered").translate(LOWER))
plain("ascii_upcase")(lambda x: string(x, "raised").translate(UPPER))
plain("split", 1)(lambda x, by: V.split(string(x, "split"), string(by, "a separator")))
plain("explode")(lambda x: [*map(ord, string(x, "exploded"))])
plain("implode")(lambda x: "".join(chr(c) if 0 <= (c := int(need(v, "number", what="a code point"))) < 0x110000 and not 0xD800 <= c < 0xE000 else "�" for v in array(x, "imploded")))


@plain("join", 1)
def join(x, by):
    parts = []
    for v in array(x, "joined"):
        need(v, "null", "string", "number", "boolean", what="joined")
        parts.append("" if v is None else formats.text(v))
    return string(by, "a separator").join(parts)


plain("startswith", 1)(lambda x, s: string(x, "tested: startswith() requires strings").startswith(string(s, "tested: startswith() requires strings")))
plain("endswith", 1)(lambda x, s: string(x, "tested: endswith() requires strings").endswith(string(s, "tested: endswith() requires strings")))
plain("ltrimstr", 1)(lambda x, s: string(x, "trimmed").removeprefix(string(s, "trimmed")))
plain("rtrimstr", 1)(lambda x, s: string(x, "trimmed").removesuffix(string(s, "trimmed")))


@plain("trimstr", 1)
def trimstr(x, s):
    string(x, "trimmed")
    while string(s, "trimmed") and x.startswith(s):
        x = x[len(s) :]
    while s and x.endswith(s):
        x = x[: -len(s)]
    return x


plain("trim")(lambda x: string(x, "trimmed").strip())
plain("ltrim")(lambda x: string(x, "trimmed").lstrip())
plain("rtrim")(lambda x: string(x, "trimmed").rstrip())

SPACE_RUN = re.compile(r"\s+")
FLAGS = {"i": re.I, "s": re.S, "m": re.M, "x": re.X}


def pattern(text: str, flags: str | None = None) -> re.Pattern:
    bits = 0
    for c in flags or "":
        bits |= FLAGS.get(c, 0)
    try:
        return re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", string(text, "a pattern")), bits)
    except re.error as e:
        raise JqError(f"{text} (at offset 0) is not a valid regex: {e}") from None


def found(m: re.Match) -> dict:
    captures = [{"offset": m.start(i), "length": len(m[i] or ""), "string": m[i], "name": None} for i in range(1, m.re.groups + 1)]
    return {"offset": m.start(), "length": len(m[0]), "string": m[0], "captures": captures}


plain("test", 1)(lambda x, p: pattern(p).search(string(x, "matched")) is not None)
plain("test", 2)(lambda x, p, f: pattern(p, f).search(string(x, "matched")) is not None)
plain("match", 1)(lambda x, p: found(m) if (m := pattern(p).search(string(x, "matched"))) else None)


@generator("match", 2)
def match_flags(x, args, env):
    for f in values(args[1], x, env):
        for p in values(args[0], x, env):
            some = pattern(p, f).finditer(string(x, "matched"))
            hits = [found(m) for m in (some if "g" in (f or "") else islice(some, 1))]
            yield from hits or ([] if "g" in (f or "") else [None])


plain("capture", 1)(lambda x, p: {str(i): m[i] for i in range(1, m.re.groups + 1)} if (m := pattern(p).search(string(x, "matched"))) else None)
generator("scan", 1)(lambda x, args, env: ([*m.groups()] if m.re.groups else m[0] for p in values(args[0], x, env) for m in pattern(p).finditer(string(x, "matched"))))


def _pieces(x, p, f=None):
    at = 0
    for m in pattern(p, f).finditer(string(x, "split")):
        yield x[at : m.start()]
        at = m.end()
    yield x[at:]


generator("splits", 1)(lambda x, args, env: (s for p in values(args[0], x, env) for s in _pieces(x, p)))
generator("splits", 2)(lambda x, args, env: (s for f in values(args[1], x, env) for p in values(args[0], x, env) for s in _pieces(x, p, f)))


def _substitute(count):
    def run(x, args, env):
        for p in values(args[0], x, env):
            yield pattern(p).sub(lambda m: string(_one(args[1], m[0], env), "a replacement"), string(x, "matched"), count=count)

    return run


generator("sub", 2)(_substitute(1))
generator("gsub", 2)(_substitute(0))

# Mathematics


def _safe(f, bad=math.nan):
    def run(*a):
        for v in a:
            need(v, "number", what="computed with: number required")
        try:
            return whole(f(*map(float, a)))
        except OverflowError:
            return math.inf
        except (ValueError, ZeroDivisionError):
            return bad

    return run


def _whole(f):
    return lambda x: int(f(x)) if math.isfinite(need(x, "number", what="rounded: number required")) else x


def _log(f):
    return lambda v: -math.inf if v == 0 else math.nan if v < 0 else f(v)


def _exponent(v: float) -> float:
    return -math.inf if v == 0 else math.frexp(v)[1] - 1 if math.isfinite(v) else abs(v)


def _bessel(order: int):
    """The defining integral, by the trapezoidal rule, which converges fast for periodic integrands."""

    def run(v: float) -> float:
        n = 64 + int(2 * min(abs(v), 1e4))
        return sum(math.cos(order * t - v * math.sin(t)) for t in (math.pi * (k + 0.5) / n for k in range(n))) / n

    return run


plain("floor")(_whole(math.floor))
plain("ceil")(_whole(math.ceil))
plain("round")(_whole(lambda v: math.floor(v + 0.5)))
for _name, _f in {
    "sqrt": math.sqrt, "log": _log(math.log), "log2": _log(math.log2), "log10": _log(math.log10), "exp": math.exp, "exp2": lambda v: 2.0**v, "exp10": lambda v: 10.0**v, "fabs": abs,
    "significand": lambda v: v if v == 0 or not math.isfinite(v) else v / 2.0 ** _exponent(v), "exponent": _exponent, "logb": _exponent, "lgamma": math.lgamma, "tgamma": math.gamma,
    "j0": _bessel(0), "j1": _bessel(1), "rint": lambda v: float(round(v)) if math.isfinite(v) else v, "nearbyint": lambda v: float(round(v)) if math.isfinite(v) else v,
    "trunc": lambda v: float(math.trunc(v)) if math.isfinite(v) else v, "cbrt": math.cbrt, "sin": math.sin, "cos": math.cos, "tan": math.tan, "asin": math.asin, "acos": math.acos, "atan": math.atan,
    "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh, "asinh": math.asinh, "acosh": math.acosh, "atanh": math.atanh,
}.items():
    plain(_name)(_safe(_f))
for _name, _f in {"pow": math.pow, "drem": math.remainder, "remainder": math.remainder, "atan2": math.atan2, "hypot": math.hypot}.items():
    plain(_name, 2)(lambda x, a, b, f=_safe(_f): f(a, b))
plain("fma", 3)(lambda x, a, b, c: _safe(lambda p, q, r: math.fma(p, q, r))(a, b, c))
_number = lambda x: need(x, "number", what="tested: number required")
plain("isinfinite")(lambda x: math.isinf(_number(x)))
plain("isnan")(lambda x: _number(x) != x)
plain("isfinite")(lambda x: math.isfinite(_number(x)))
plain("isnormal")(lambda x: math.isfinite(_number(x)) and x != 0)

# Dates, all in UTC

EPOCH = dt.datetime(1970, 1, 1)


def _moment(seconds) -> dt.datetime:
    return EPOCH + dt.timedelta(seconds=need(seconds, "number", what="a time: number required"))


def _broken(t: dt.datetime) -> list:
    return [t.year, t.month - 1, t.day, t.hour, t.minute, whole(t.second + t.microsecond / 1e6), t.isoweekday() % 7, t.timetuple().tm_yday - 1]


def _seconds(parts) -> int:
    if not (isinstance(parts, list) and len(parts) >= 6 and all(map(number, parts))):
        raise JqError("mktime requires array of 6 numbers")
    y, mo, d, h, mi, s = map(int, parts[:6])
    return calendar.timegm((y, mo + 1, d, h, mi, s))


def strftime(x, form):
    t = _moment(_seconds(x) if isinstance(x, list) else x)
    form = string(form, "a date format")
    return t.replace(tzinfo=dt.UTC).strftime(form.replace("%e", f"{t.day:2d}").replace("%s", str(int((t - EPOCH).total_seconds()))).replace("%Z", "UTC"))


@plain("fromdate")
def fromdate(x):
    try:
        t = dt.datetime.fromisoformat(string(x, "a date"))
    except ValueError:
        raise JqError(f'date "{x}" does not match format "%Y-%m-%dT%H:%M:%SZ"') from None
    return whole(math.floor((t.replace(tzinfo=t.tzinfo or dt.UTC) - EPOCH.replace(tzinfo=dt.UTC)).total_seconds()))


plain("todate")(lambda x: _moment(math.trunc(need(x, "number", what="a time"))).strftime("%Y-%m-%dT%H:%M:%SZ"))
plain("strftime", 1)(strftime)
plain("strflocaltime", 1)(strftime)
plain("gmtime")(lambda x: _broken(_moment(x)))
plain("mktime")(_seconds)


@plain("strptime", 1)
def strptime(x, form):
    try:
        t = dt.datetime.strptime(string(x, "a date"), form)
    except ValueError:
        raise JqError(f'date "{x}" does not match format "{form}"') from None
    return _broken(t.astimezone(dt.UTC).replace(tzinfo=None) if t.tzinfo else t)


def date_add(x, unit, n):
    t, n = _moment(x), int(n)
    if unit in ("years", "months"):
        m = t.year * 12 + t.month - 1 + n * (12 if unit == "years" else 1)
        y, m = divmod(m, 12)
        t = t.replace(year=y, month=m + 1, day=min(t.day, calendar.monthrange(y, m + 1)[1]))
    elif unit in ("days", "hours", "minutes", "seconds"):
        t += dt.timedelta(**{unit: n})
    else:
        raise JqError(f"Unknown date unit: {unit}")
    return whole((t - EPOCH).total_seconds())


plain("dateadd", 2)(date_add)
plain("datesub", 2)(lambda x, unit, n: date_add(x, unit, -n))

from docql.functions import jsonata, sqljson  # noqa: E402, F401  they register builtins of their own
