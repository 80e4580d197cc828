"""The interpreter of programs whose shape isn't known beforehand (tier 3): one value in, a stream out.

Generators do what the language means by a stream. Every construct can be asked for values, and those
that denote places also for (path, value) pairs, which assignments use.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from typing import Any

from docql.functions import values as V
from docql.functions.values import JqError, kind, truthy
from docql.plans import nodes as N
from docql.plans.parser import ProgramError, parse

sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
Place = tuple[list, Any]


class BreakOut(Exception):
    def __init__(self, mark: object):
        self.mark = mark


class Halt(Exception):
    def __init__(self, code: int, value: Any = None):
        super().__init__(f"halted with {code}")
        self.code, self.value = code, value


@dataclass
class Context:
    """What a run shares: remaining inputs, further builtins, messages of debug and stderr, visible environment."""

    inputs: Iterator[Any] | None = None
    extra: dict[tuple[str, int], Callable] = field(default_factory=dict)
    say: Callable[[str], None] = lambda text: print(text, file=sys.stderr)
    shown: dict[str, str] | None = None  # the environment variables to be seen; None: all

    @property
    def environment(self) -> dict[str, str]:
        return dict(os.environ if self.shown is None else self.shown)


@dataclass(frozen=True)
class Env:
    context: Context
    variables: dict[str, Any] = field(default_factory=dict)
    functions: dict[tuple[str, int], Any] = field(default_factory=dict)

    def bind(self, **new: Any) -> Env:
        return Env(self.context, {**self.variables, **new}, self.functions)

    def bound(self, new: dict[str, Any]) -> Env:
        return Env(self.context, {**self.variables, **new}, self.functions)

    def define(self, name: str, arity: int, what: Any) -> Env:
        return Env(self.context, self.variables, {**self.functions, (name, arity): what})


@dataclass(frozen=True)
class Closure:
    """A filter argument: a body with the environment it came from."""

    body: N.Node
    env: Env


@dataclass(frozen=True)
class Function:
    params: tuple[str, ...]
    body: N.Node
    env: Env


def values(n: N.Node, x: Any, env: Env) -> Iterator[Any]:
    return EVAL[type(n)](n, x, env)


def places(n: N.Node, at: Place, env: Env) -> Iterator[Place]:
    do = PLACES.get(type(n))
    if do is None:
        raise JqError(f"Invalid path expression with result {V.short(next(iter(values(n, at[1], env)), None))}")
    return do(n, at, env)


def first(it: Iterable[Any], default: Any = None) -> Any:
    return next(iter(it), default)


NONE = object()


def iterate(x: Any) -> Iterator[tuple[Any, Any]]:
    if isinstance(x, list):
        return iter(enumerate(x))
    if isinstance(x, dict):
        return iter(x.items())
    raise JqError(f"Cannot iterate over {kind(x)}" + (f" ({V.short(x)})" if x is not None else ""))


# Values


def _recurse(x: Any) -> Iterator[Any]:
    todo = [x]
    while todo:
        v = todo.pop()
        yield v
        if isinstance(v, (list, dict)):
            todo += reversed([c for _, c in iterate(v)])


def _index(n: N.Index, x, env):
    for base in values(n.base, x, env):
        for key in values(n.key, x, env):
            yield V.index(base, key)


def _maybe(n: N.Node | None, x, env) -> Iterator[Any]:
    return iter((None,)) if n is None else values(n, x, env)


def _slice(n: N.Slice, x, env):
    for base in values(n.base, x, env):
        for end in _maybe(n.end, x, env):
            for start in _maybe(n.start, x, env):
                yield V.cut(base, start, end)


def _build(n: N.Build, x, env):
    def rest(i: int, done: dict):
        if i == len(n.entries):
            yield done
            return
        key, value = n.entries[i]
        for k in values(key, x, env):
            if not isinstance(k, str):
                raise JqError(f"Object keys must be strings, not {kind(k)}")
            for v in values(value, x, env):
                yield from rest(i + 1, {**done, k: v})

    return rest(0, {})


def _interpolate(n: N.Interpolate, x, env):
    from docql.functions.formats import apply_format

    def rest(i: int, done: str):
        if i == len(n.parts):
            yield done
        elif isinstance(n.parts[i], str):
            yield from rest(i + 1, done + n.parts[i])
        else:
            for v in values(n.parts[i], x, env):
                yield from rest(i + 1, done + apply_format(n.format or "text", v))

    return rest(0, "")


def _arithmetic(n: N.Arithmetic, x, env):
    do = V.ARITHMETIC[n.op]
    for right in values(n.right, x, env):
        for left in values(n.left, x, env):
            yield do(left, right)


def compare(op: str, a: Any, b: Any) -> bool:
    if op in ("==", "!="):
        return V.equal(a, b) is (op == "==")
    if V.number(a) and V.number(b) and a == a and b == b:
        i, j = a, b
    else:
        i, j = V.order_key(a), V.order_key(b)
    return i < j if op == "<" else i <= j if op == "<=" else i > j if op == ">" else i >= j


def _compare(n: N.Compare, x, env):
    for right in values(n.right, x, env):
        for left in values(n.left, x, env):
            yield compare(n.op, left, right)


def _logic(n: N.Logic, x, env):
    decided = n.op == "or"
    for left in values(n.left, x, env):
        if truthy(left) is decided:
            yield decided
        else:
            for right in values(n.right, x, env):
                yield truthy(right)


def _alternative(n: N.Alternative, x, env):
    some = False
    for v in values(n.left, x, env):
        if truthy(v):
            some = True
            yield v
    if not some:
        yield from values(n.right, x, env)


def _if(n: N.If, x, env):
    for test in values(n.test, x, env):
        yield from values(n.then if truthy(test) else n.other, x, env)


def _try(n: N.Try, x, env):
    try:
        yield from values(n.body, x, env)
    except JqError as e:
        if n.handler is not None:
            yield from values(n.handler, e.value, env)


def match(pattern: Any, v: Any, env: Env, x: Any) -> Iterator[dict[str, Any]]:
    """Bindings of a pattern's variables, one set for each way its keys come out."""
    if isinstance(pattern, N.VarPattern):
        yield {pattern.name: v}
        return
    if isinstance(pattern, N.ArrayPattern):
        parts = [(lambda e, i=i: iter((V.index(v, i),)), None, p) for i, p in enumerate(pattern.items)]
        if v is not None and not isinstance(v, list):
            raise JqError(f"Cannot index {kind(v)} with number")
    else:
        parts = [(lambda e, k=k: (V.index(v, key) for key in values(k, x, e)), var, p) for k, var, p in pattern.entries]

    def rest(i: int, done: dict[str, Any]):
        if i == len(parts):
            yield done
            return
        get, var, inner = parts[i]
        for part in get(env.bound(done)):
            here = {**done, var: part} if var else done
            if inner is None:
                yield from rest(i + 1, here)
            else:
                for more in match(inner, part, env.bound(here), x):
                    yield from rest(i + 1, {**here, **more})

    yield from rest(0, {})


def _bind(n: N.Bind, x, env, run=None, seed=None):
    run = run or (lambda e: values(n.body, x, e))
    none = dict.fromkeys((name for p in n.patterns for name in N.pattern_names(p)), None) if len(n.patterns) > 1 else {}
    for v in values(n.source, x, env):
        for i, pattern in enumerate(n.patterns):
            try:
                for found in match(pattern, v, env, x):
                    yield from run(env.bound({**none, **found}))
                break
            except JqError:
                if i == len(n.patterns) - 1:
                    raise


def _reduce(n: N.Reduce, x, env):
    state = first(values(n.start, x, env), NONE)
    if state is NONE:
        return
    for v in values(n.source, x, env):
        for found in match(n.pattern, v, env, x):
            state = first(values(n.update, state, env.bound(found)), state)
    yield state


def _foreach(n: N.Foreach, x, env):
    for state in values(n.start, x, env):
        for v in values(n.source, x, env):
            for found in match(n.pattern, v, env, x):
                inner = env.bound(found)
                for state in values(n.update, state, inner):  # noqa: B020
                    if n.extract is None:
                        yield state
                    else:
                        yield from values(n.extract, state, inner)


def _define(n: N.Define, env: Env) -> Env:
    inner = dict(env.functions)
    made = Env(env.context, env.variables, inner)
    inner[n.name, len(n.params)] = Function(n.params, n.body, made)
    return made


def _label(n: N.Label, x, env, run=None):
    mark = object()
    inner = env.bound({f"*{n.name}": mark})
    try:
        yield from run(inner) if run else values(n.body, x, inner)
    except BreakOut as e:
        if e.mark is not mark:
            raise


def _break(n: N.Break, x, env):
    mark = env.variables.get(f"*{n.name}")
    if mark is None:
        raise ProgramError(f"$*label-{n.name} is not defined")
    raise BreakOut(mark)
    yield


def _variable(n: N.Variable, x, env):
    if n.name in env.variables:
        yield env.variables[n.name]
    elif n.name == "ENV":
        yield env.context.environment
    elif n.name == "__loc__":
        yield {"file": "<top-level>", "line": 1}
    else:
        raise ProgramError(f"${n.name} is not defined")


def called(n: N.Call, env: Env):
    """("user", body, environment) of a defined function or argument, or ("builtin", function)."""
    key = n.name, len(n.args)
    if env.functions and (f := env.functions.get(key)) is not None:
        if isinstance(f, Closure):
            return "user", f.body, f.env
        inner = dict(f.env.functions)
        for p, a in zip(f.params, n.args, strict=True):
            inner[p, 0] = Closure(a, env)
        return "user", f.body, Env(f.env.context, f.env.variables, inner)
    f = env.context.extra.get(key) if env.context.extra else None
    if f is None:
        known = builtins()
        f = known.get(key) or known.get((n.name, None))
        if f is None:
            raise ProgramError(f"{n.name}/{len(n.args)} is not defined")
    return "builtin", f, None


@cache
def builtins() -> dict:
    """Of a module that needs this one."""
    from docql.functions.builtins import BUILTINS

    return BUILTINS


def _call(n: N.Call, x, env):
    how, f, inner = called(n, env)
    return values(f, x, inner) if how == "user" else f(x, n.args, env)


def _format(n: N.Format, x, env):
    from docql.functions.formats import apply_format

    yield apply_format(n.name, x)


def _assign(n: N.Assign, x, env):
    if n.op == "|=":
        yield update(n.target, x, env, lambda v: values(n.value, v, env))
    elif n.op == "=":
        for v in values(n.value, x, env):
            out = x
            for path, _ in places(n.target, ([], x), env):
                out = V.set_path(out, path, v)
            yield out
    else:
        right = first(values(n.value, x, env), NONE)
        if right is NONE:
            return
        do = (lambda v: v if truthy(v) else right) if n.op == "//=" else (lambda v: V.ARITHMETIC[n.op[0]](v, right))
        yield update(n.target, x, env, lambda v: iter((do(v),)))


def update(target: N.Node, x: Any, env: Env, f: Callable[[Any], Iterator[Any]]) -> Any:
    gone, out = [], x
    for path, _ in [*places(target, ([], x), env)]:
        v = first(f(V.get_path(out, path)), NONE)
        if v is NONE:
            gone.append(path)
        else:
            out = V.set_path(out, path, v)
    return V.delete_paths(out, gone) if gone else out


def _collect(n: N.Collect, x, env):
    yield [] if n.body is None else [*values(n.body, x, env)]


def _negate(n: N.Negate, x, env):
    for v in values(n.body, x, env):
        if not V.number(v):
            raise JqError(f"{kind(v)} ({V.short(v)}) cannot be negated")
        yield -v


EVAL: dict[type, Callable] = {
    N.Identity: lambda n, x, env: iter((x,)),
    N.RecurseAll: lambda n, x, env: _recurse(x),
    N.Literal: lambda n, x, env: iter((n.value,)),
    N.Field: lambda n, x, env: (V.index(v, n.name) for v in values(n.base, x, env)),
    N.Index: _index,
    N.Slice: _slice,
    N.Iterate: lambda n, x, env: (c for v in values(n.base, x, env) for _, c in iterate(v)),
    N.Pipe: lambda n, x, env: (w for v in values(n.left, x, env) for w in values(n.right, v, env)),
    N.Comma: lambda n, x, env: (v for side in (n.left, n.right) for v in values(side, x, env)),
    N.Collect: _collect,
    N.Build: _build,
    N.Interpolate: _interpolate,
    N.Negate: _negate,
    N.Arithmetic: _arithmetic,
    N.Compare: _compare,
    N.Logic: _logic,
    N.Alternative: _alternative,
    N.If: _if,
    N.Try: _try,
    N.Reduce: _reduce,
    N.Foreach: _foreach,
    N.Define: lambda n, x, env: values(n.rest, x, _define(n, env)),
    N.Call: _call,
    N.Bind: _bind,
    N.Variable: _variable,
    N.Assign: _assign,
    N.Label: _label,
    N.Break: _break,
    N.Format: _format,
}

# Places


def _p_field(n: N.Field, at, env):
    for path, v in places(n.base, at, env):
        yield [*path, n.name], V.index(v, n.name)


def _p_index(n: N.Index, at, env):
    for path, v in places(n.base, at, env):
        for key in values(n.key, at[1], env):
            yield [*path, key], V.index(v, key)


def _p_slice(n: N.Slice, at, env):
    for path, v in places(n.base, at, env):
        for end in _maybe(n.end, at[1], env):
            for start in _maybe(n.start, at[1], env):
                yield [*path, {"start": start, "end": end}], V.cut(v, start, end)


def _p_iterate(n: N.Iterate, at, env):
    for path, v in places(n.base, at, env):
        if v is None:
            continue
        for k, c in iterate(v):
            yield [*path, k], c


def recurse_places(at: Place) -> Iterator[Place]:
    todo = [at]
    while todo:
        path, v = todo.pop()
        yield path, v
        if isinstance(v, (list, dict)):
            todo += reversed([([*path, k], c) for k, c in iterate(v)])


def _p_alternative(n: N.Alternative, at, env):
    some = False
    for place in places(n.left, at, env):
        if truthy(place[1]):
            some = True
            yield place
    if not some:
        yield from places(n.right, at, env)


def _p_try(n: N.Try, at, env):
    try:
        yield from places(n.body, at, env)
    except JqError as e:
        if n.handler is not None:
            yield from places(n.handler, ([], e.value), env)


def _p_if(n: N.If, at, env):
    for test in values(n.test, at[1], env):
        yield from places(n.then if truthy(test) else n.other, at, env)


def _p_reduce(n: N.Reduce, at, env):
    state = first(places(n.start, at, env))
    for v in values(n.source, at[1], env):
        for found in match(n.pattern, v, env, at[1]):
            state = first(places(n.update, state, env.bound(found)), state)
    yield state


def _p_foreach(n: N.Foreach, at, env):
    for state in places(n.start, at, env):
        for v in values(n.source, at[1], env):
            for found in match(n.pattern, v, env, at[1]):
                inner = env.bound(found)
                for state in places(n.update, state, inner):  # noqa: B020
                    yield from places(n.extract, state, inner) if n.extract is not None else iter((state,))


def _p_call(n: N.Call, at, env):
    from docql.functions.builtins import PLACE_BUILTINS

    how, f, inner = called(n, env)
    if how == "user":
        return places(f, at, inner)
    do = PLACE_BUILTINS.get((n.name, len(n.args)))
    if do is None:
        raise JqError(f"Invalid path expression with result {V.short(first(f(at[1], n.args, env)))}")
    return do(at, n.args, env)


def _p_literal(n: N.Literal, at, env):
    if n.value is None:
        yield [], None
        return
    raise JqError(f"Invalid path expression with result {V.short(n.value)}")


PLACES: dict[type, Callable] = {
    N.Identity: lambda n, at, env: iter((at,)),
    N.RecurseAll: lambda n, at, env: recurse_places(at),
    N.Literal: _p_literal,
    N.Field: _p_field,
    N.Index: _p_index,
    N.Slice: _p_slice,
    N.Iterate: _p_iterate,
    N.Pipe: lambda n, at, env: (q for p in places(n.left, at, env) for q in places(n.right, p, env)),
    N.Comma: lambda n, at, env: (p for side in (n.left, n.right) for p in places(side, at, env)),
    N.Alternative: _p_alternative,
    N.If: _p_if,
    N.Try: _p_try,
    N.Reduce: _p_reduce,
    N.Foreach: _p_foreach,
    N.Define: lambda n, at, env: places(n.rest, at, _define(n, env)),
    N.Call: _p_call,
    N.Bind: lambda n, at, env: _bind(n, at[1], env, run=lambda e: places(n.body, at, e)),
    N.Label: lambda n, at, env: _label(n, at[1], env, run=lambda e: places(n.body, at, e)),
    N.Break: lambda n, at, env: _break(n, at[1], env),
}


def run(program: str | N.Node, x: Any, variables: dict[str, Any] | None = None, inputs: Iterable[Any] | None = None, extra: dict | None = None) -> Iterator[Any]:
    """All outputs of a program for one input."""
    tree = parse(program) if isinstance(program, str) else program
    context = Context(iter(inputs) if inputs is not None else None, extra or {})
    return values(tree, x, Env(context, dict(variables or {})))
