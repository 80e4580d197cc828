"""Builtins that SQL/JSON paths are translated to. A path's result is a stream; predicates give true, false or null (unknown)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Any

from docql.functions import values as V
from docql.functions.builtins import BUILTINS
from docql.functions.interpret import values
from docql.functions.values import JqError, kind, number, whole

PREDICATES = frozenset(f"path:{n}" for n in "or and not exists compare starts like unknown".split())


def builtin(name: str, *arities: int):
    def add(f):
        for n in arities:
            BUILTINS[f"path:{name}", n] = f
        return f

    return add


def unwrapped(vs: Iterator[Any], lax: bool) -> Iterator[Any]:
    for v in vs:
        if lax and isinstance(v, list):
            yield from v
        else:
            yield v


@builtin("run", 2)
def run(x, args, env):
    """Lax: what structural errors remain end the stream quietly."""
    try:
        yield from values(args[1], x, env)
    except JqError:
        if not args[0].value:
            raise


@builtin("member", 3)
def member(x, args, env):
    lax, key = args[0].value, args[2].value
    for v in unwrapped(values(args[1], x, env), lax):
        if isinstance(v, dict) and key in v:
            yield v[key]
        elif not lax:
            raise JqError(f'JSON object does not contain key "{key}"' if isinstance(v, dict) else "jsonpath member accessor can only be applied to an object")


@builtin("values", 2)
def wildcard(x, args, env):
    for v in unwrapped(values(args[1], x, env), args[0].value):
        if isinstance(v, dict):
            yield from v.values()
        elif not args[0].value:
            raise JqError("jsonpath wildcard member accessor can only be applied to an object")


@builtin("elements", 2)
def elements(x, args, env):
    for v in values(args[1], x, env):
        if isinstance(v, list):
            yield from v
        elif args[0].value:
            yield v
        else:
            raise JqError("jsonpath wildcard array accessor can only be applied to an array")


@builtin("descend", 3)
def descend(x, args, env):
    low, high = args[1].value, args[2].value

    def walk(v, level):
        inner = isinstance(v, (list, dict)) and v
        if low is None:  # the leaves
            if not inner:
                yield v
        elif level >= low and (high is None or level <= high):
            yield v
        if inner and (high is None or low is None or level < high):
            for c in v if isinstance(v, list) else v.values():
                yield from walk(c, level + 1)

    for v in values(args[0], x, env):
        yield from walk(v, 0)


def one_number(n, x, env) -> int:
    got = [*values(n, x, env)]
    if len(got) != 1 or not number(got[0]):
        raise JqError("jsonpath array subscript is not a single numeric value")
    return math.trunc(got[0])


@builtin("places", *range(4, 24, 2))
def places(x, args, env):
    lax = args[0].value
    for v in values(args[1], x, env):
        if not isinstance(v, list):
            if not lax:
                raise JqError("jsonpath array accessor can only be applied to an array")
            v = [v]
        inner = env.bind(last=len(v) - 1)
        for a, b in zip(args[2::2], args[3::2], strict=True):
            start = one_number(a, x, inner)
            end = start if getattr(b, "value", 0) is None else one_number(b, x, inner)
            if not lax and (start < 0 or end >= len(v) or start > end):
                raise JqError("jsonpath array subscript is out of bounds")
            yield from v[max(0, start) : max(0, end + 1)]


def truth(n, x, env) -> bool | None:
    got = [*values(n, x, env)]
    return got[0] if len(got) == 1 and (got[0] is None or isinstance(got[0], bool)) else None


@builtin("filter", 3)
def filter_(x, args, env):
    for v in unwrapped(values(args[1], x, env), args[0].value):
        try:
            if truth(args[2], v, env) is True:
                yield v
        except JqError:
            continue  # an error in a filter is unknown


def tested(f):
    def run(x, args, env):
        try:
            yield f(x, args, env)
        except JqError:
            yield None

    return run


@builtin("or", 2)
@tested
def or_(x, args, env):
    a, b = truth(args[0], x, env), truth(args[1], x, env)
    return True if a is True or b is True else None if a is None or b is None else False


@builtin("and", 2)
@tested
def and_(x, args, env):
    a, b = truth(args[0], x, env), truth(args[1], x, env)
    return False if a is False or b is False else None if a is None or b is None else True


builtin("not", 1)(tested(lambda x, args, env: None if (a := truth(args[0], x, env)) is None else not a))
builtin("exists", 1)(tested(lambda x, args, env: len([*values(args[0], x, env)]) > 0))
builtin("unknown", 1)(lambda x, args, env: iter((truth(args[0], x, env) is None,)))


def compared(op: str, a: Any, b: Any) -> bool | None:
    if isinstance(a, (list, dict)) or isinstance(b, (list, dict)):
        return None
    if kind(a) != kind(b):
        if a is None or b is None:
            return op == "!="
        return None
    if op in ("==", "!="):
        return V.equal(a, b) is (op == "==")
    i, j = V.order_key(a), V.order_key(b)
    return i < j if op == "<" else i <= j if op == "<=" else i > j if op == ">" else i >= j


@builtin("compare", 3)
@tested
def compare(x, args, env):
    """True if some pair of items compares so; unknown if none does and some pair can't be compared."""
    left = [*unwrapped(values(args[1], x, env), True)]
    right = [*unwrapped(values(args[2], x, env), True)]
    got = [compared(args[0].value, a, b) for a in left for b in right]
    return True if True in got else None if None in got else False


def some(f):
    @tested
    def run(x, args, env):
        got = [f(v, args, x, env) for v in unwrapped(values(args[0], x, env), True)]
        return True if True in got else None if None in got else False

    return run


builtin("starts", 2)(some(lambda v, args, x, env: v.startswith(next(values(args[1], x, env))) if isinstance(v, str) else None))


def like(v, args, x, env):
    if not isinstance(v, str):
        return None
    bits = 0
    for c in args[2].value:
        bits |= {"i": re.I, "s": re.S, "m": re.M, "x": re.X}.get(c, 0)
    pattern = re.escape(args[1].value) if "q" in args[2].value else args[1].value
    return re.search(pattern, v, bits) is not None


builtin("like", 3)(some(like))


def single(n, x, env, op: str) -> Any:
    got = [*unwrapped(values(n, x, env), True)]
    if len(got) != 1 or not number(got[0]):
        raise JqError(f"operand of jsonpath operator {op} is not a single numeric value")
    return got[0]


@builtin("arithmetic", 3)
def arithmetic(x, args, env):
    op = args[0].value
    a, b = single(args[1], x, env, op), single(args[2], x, env, op)
    if b == 0 and op in "/%":
        raise JqError("division by zero")
    yield whole(math.fmod(a, b)) if op == "%" else V.ARITHMETIC[op](a, b)


@builtin("sign", 2)
def sign(x, args, env):
    for v in unwrapped(values(args[1], x, env), True):
        if not number(v):
            raise JqError(f"operand of unary jsonpath operator {args[0].value} is not a numeric value")
        yield -v if args[0].value == "-" else v


TRUE, FALSE = ("t", "true", "y", "yes", "on", "1"), ("f", "false", "n", "no", "off", "0")


def method(name: str, v: Any) -> Any:
    if name in ("double", "number", "integer", "bigint"):
        if isinstance(v, str) and re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", v):
            v = whole(float(v))
        if not number(v):
            raise JqError(f"jsonpath item method .{name}() can only be applied to a string or numeric value")
        return round(v) if name in ("integer", "bigint") else v
    if name == "string":
        if isinstance(v, (list, dict)) or v is None:
            raise JqError("jsonpath item method .string() can only be applied to a boolean, string, numeric, or datetime value")
        return v if isinstance(v, str) else V.dumps(v)
    if name == "boolean":
        if isinstance(v, bool):
            return v
        if number(v) and v == int(v):
            return v != 0
        if isinstance(v, str) and v.lower() in TRUE + FALSE:
            return v.lower() in TRUE
        raise JqError("jsonpath item method .boolean() can only be applied to a boolean, string, or numeric value")
    if not number(v):
        raise JqError(f"jsonpath item method .{name}() can only be applied to a numeric value")
    return math.ceil(v) if name == "ceiling" else math.floor(v) if name == "floor" else abs(v)


@builtin("method", 3)
def methods(x, args, env):
    lax, name = args[0].value, args[2].value
    if name == "type":
        yield from map(kind, values(args[1], x, env))
    elif name == "size":
        for v in values(args[1], x, env):
            if not lax and not isinstance(v, list):
                raise JqError("jsonpath item method .size() can only be applied to an array")
            yield len(v) if isinstance(v, list) else 1
    elif name == "keyvalue":
        for v in unwrapped(values(args[1], x, env), lax):
            if not isinstance(v, dict):
                raise JqError("jsonpath item method .keyvalue() can only be applied to an object")
            yield from ({"key": k, "value": w} for k, w in v.items())
    else:
        for v in unwrapped(values(args[1], x, env), lax):
            yield method(name, v)
