"""JSON values as Python ones: reading, writing, order, equality, arithmetic, paths.

Numbers are int (64 bits) or float, a whole float in that range being an int. Objects keep the order of insertion.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

MAX_TEXT = 100_000_000
MAX_INDEX = 536_870_911


class JqError(Exception):
    """A program's error; value is any JSON value."""

    def __init__(self, value: Any):
        super().__init__(value if isinstance(value, str) else dumps(value))
        self.value = value


def kind(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def truthy(v: Any) -> bool:
    return v is not None and v is not False


def number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def whole(x: float) -> int | float:
    return int(x) if isinstance(x, float) and math.isfinite(x) and x.is_integer() and abs(x) < 2**63 else x


# Text


def show_number(v: int | float) -> str:
    if isinstance(v, int):
        return str(v)
    if not math.isfinite(v):
        return "null"
    plain = format(Decimal(repr(v)), "f")
    _, _, after = plain.partition(".")
    if len(after) > 20:
        return repr(v)
    return plain.rstrip("0").rstrip(".") if after else plain


quoted = json.JSONEncoder(ensure_ascii=False).encode


def dumps(v: Any) -> str:
    """Compact text."""
    if v is None or v is True or v is False:
        return "null" if v is None else "true" if v else "false"
    if isinstance(v, str):
        return quoted(v)
    if isinstance(v, (int, float)):
        return show_number(v)
    if isinstance(v, list):
        return "[" + ",".join(map(dumps, v)) + "]"
    return "{" + ",".join([f"{quoted(k)}:{dumps(x)}" for k, x in v.items()]) + "}"


def pretty(v: Any, indent: str = "  ", sort_keys: bool = False, depth: int = 0) -> str:
    inner, outer = "\n" + indent * (depth + 1), "\n" + indent * depth
    if isinstance(v, list) and v:
        return "[" + inner + f",{inner}".join(pretty(x, indent, sort_keys, depth + 1) for x in v) + outer + "]"
    if isinstance(v, dict) and v:
        items = sorted(v.items(), key=lambda e: text_key(e[0])) if sort_keys else v.items()
        return "{" + inner + f",{inner}".join(f"{dumps(k)}: {pretty(x, indent, sort_keys, depth + 1)}" for k, x in items) + outer + "}"
    return dumps(v)


def _integer(text: str) -> int | float:
    n = int(text)
    return n if -(2**63) <= n < 2**63 else float(text)


DECODER = json.JSONDecoder(parse_int=_integer, parse_float=lambda t: whole(float(t)), strict=False)


def _lenient(text: str) -> str:
    return text.replace("nan", "NaN") if text[:3] == "nan" else text


def each_document(text: str) -> Iterator[Any]:
    """The documents of a text, parted by white space or nothing, one after the other."""
    text = _lenient(text.removeprefix("\ufeff").lstrip(" \t\r\n"))
    at = 0
    while True:
        while at < len(text) and text[at] in " \t\r\n\x1e":
            at += 1
        if at >= len(text):
            return
        try:
            v, at = DECODER.raw_decode(text, at)
        except ValueError as e:
            raise JqError(f"Invalid JSON: {e}") from None
        yield v


def parse_stream(text: str) -> list[Any]:
    return [*each_document(text)]


def parse(text: str, strict: bool = False) -> Any:
    """One document; what follows it is an error only if strict. No text is null."""
    text = _lenient(text.removeprefix("\ufeff").strip(" \t\r\n"))
    if not text:
        return None
    try:
        v, at = DECODER.raw_decode(text)
    except ValueError as e:
        raise JqError(f"Invalid JSON: {e}") from None
    if strict and at < len(text):
        raise JqError("Invalid JSON: text after the document")
    return v


# Order

RANK = {"null": 0, "boolean": 1, "number": 2, "string": 3, "array": 4, "object": 5}


def text_key(s: str) -> bytes:
    """Orders as UTF-16 code units."""
    return s.encode("utf-16-be", "surrogatepass")


def order_key(v: Any) -> tuple:
    """A key of Python's order that sorts values: null, booleans, numbers (NaN last), strings, arrays, objects (by size, keys, values)."""
    k = kind(v)
    r = RANK[k]
    if k == "null":
        return (r,)
    if k == "boolean":
        return (r, v)
    if k == "number":
        return (r, v != v, 0 if v != v else v)
    if k == "string":
        return (r, text_key(v))
    if k == "array":
        return (r, tuple(map(order_key, v)))
    keys = sorted(v, key=text_key)
    return (r, len(keys), tuple(map(text_key, keys)), tuple(order_key(v[x]) for x in keys))


def equal(a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(x, b[k]) for k, x in a.items())
    if number(a) and number(b):
        return a == b or (a != a and b != b)
    return type(a) is type(b) and a == b


# Arithmetic


def _exact(op: str, a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int):
        out = a + b if op == "+" else a - b if op == "-" else a * b
        if abs(out) > 2**63 - 1 and out != -(2**63):
            raise ArithmeticError("long overflow")
        return out
    if math.isfinite(a) and math.isfinite(b):
        x, y = Decimal(repr(a)), Decimal(repr(b))
        return whole(float(x + y if op == "+" else x - y if op == "-" else x * y))
    return a + b if op == "+" else a - b if op == "-" else a * b


def deep_merge(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def short(v: Any) -> str:
    s = dumps(v)
    return s if len(s) <= 11 else s[:10] + "..."


def _refuse(what: str, a: Any, b: Any):
    raise JqError(f"{kind(a)} ({short(a)}) and {kind(b)} ({short(b)}) cannot be {what}")


def add(a: Any, b: Any) -> Any:
    if a is None:
        return b
    if b is None:
        return a
    if number(a) and number(b):
        return _exact("+", a, b)
    if type(a) is type(b):
        if isinstance(a, (str, list)):
            return a + b
        if isinstance(a, dict):
            return {**a, **b}
    return _refuse("added", a, b)


def subtract(a: Any, b: Any) -> Any:
    if a is None and b is None:
        return 0
    if number(a) and number(b):
        return _exact("-", a, b)
    if isinstance(a, list) and isinstance(b, list):
        gone = {order_key(x) for x in b}
        return [x for x in a if order_key(x) not in gone]
    return _refuse("subtracted", a, b)


def multiply(a: Any, b: Any) -> Any:
    if a is None or b is None:
        return None
    if number(a) and number(b):
        return _exact("*", a, b)
    if isinstance(a, dict) and isinstance(b, dict):
        return deep_merge(a, b)
    if isinstance(b, str) and number(a):
        a, b = b, a
    if isinstance(a, str) and number(b):
        if b != b or b < 0:
            return None
        n = 1 if 0 < b < 1 else int(min(b, MAX_TEXT + 1))
        if len(a) * n > MAX_TEXT:
            raise JqError("Repeat string result too long")
        return a * n
    return _refuse("multiplied", a, b)


def divide(a: Any, b: Any) -> Any:
    if number(a) and number(b):
        if b == 0:
            raise JqError(f"{kind(a)} ({short(a)}) and {kind(b)} ({short(b)}) cannot be divided because the divisor is zero")
        if math.isfinite(a) and math.isfinite(b):
            return whole(float(Decimal(repr(a)) / Decimal(repr(b)))) if not (isinstance(a, int) and isinstance(b, int) and a % b == 0) else a // b
        return whole(a / b)
    if isinstance(a, str) and isinstance(b, str):
        return split(a, b)
    return _refuse("divided", a, b)


def split(text: str, by: str) -> list[str]:
    if not text:
        return []
    return list(text) if by == "" else text.split(by)


def modulo(a: Any, b: Any) -> Any:
    if not (number(a) and number(b)):
        return _refuse("divided", a, b)
    if a != a or b != b:
        return math.nan
    big = lambda x: max(-(2**63), min(2**63 - 1, x if isinstance(x, int) else int(x) if math.isfinite(x) else 2**63 * int(math.copysign(1, x))))
    x, y = big(a), abs(big(b))
    if y == 0:
        raise JqError(f"{kind(a)} ({short(a)}) and {kind(b)} ({short(b)}) cannot be divided because the divisor is zero")
    return abs(x) % y * (-1 if x < 0 else 1)


ARITHMETIC = {"+": add, "-": subtract, "*": multiply, "/": divide, "%": modulo}

# Paths


def index(v: Any, key: Any) -> Any:
    if v is None and (key is None or isinstance(key, (str, dict)) or number(key)):
        return None
    if isinstance(v, dict) and isinstance(key, str):
        return v.get(key)
    if isinstance(v, list) and number(key):
        if key != key:
            return None
        i = math.floor(key) if math.isfinite(key) else MAX_INDEX + 1
        i += len(v) if i < 0 else 0
        return v[i] if 0 <= i < len(v) else None
    if isinstance(key, dict) and (v is None or isinstance(v, (list, str))):
        return cut(v, key.get("start"), key.get("end"))
    if isinstance(v, list) and isinstance(key, list):
        return positions(v, key)
    raise JqError(f'Cannot index {kind(v)} with "{key}"' if isinstance(key, str) else f"Cannot index {kind(v)} with {kind(key)}")


def bounds(start: Any, end: Any, size: int) -> tuple[int, int]:
    def at(x: Any, default: int, up: bool) -> int:
        if x is None or (isinstance(x, float) and x != x):
            return default
        if not number(x):
            raise JqError("Start and end indices of an array slice must be numbers")
        i = (math.ceil(x) if up else math.floor(x)) if math.isfinite(x) else (size if x > 0 else -size)
        return max(0, min(size, i + size if i < 0 else i))

    s = at(start, 0, False)
    return s, max(s, at(end, size, True))


def cut(v: Any, start: Any, end: Any) -> Any:
    if v is None:
        return None
    if not isinstance(v, (list, str)):
        raise JqError(f"Cannot index {kind(v)} with object")
    s, e = bounds(start, end, len(v))
    return v[s:e]


def positions(v: Any, part: Any) -> Any:
    """Where part occurs in v: of a text in code points, overlapping; of an array a part array or an element."""
    if v is None:
        return None
    if isinstance(v, str):
        if not isinstance(part, str):
            raise JqError("indices of a string need a string")
        out, at = [], v.find(part) if part else -1
        while at >= 0:
            out.append(at)
            at = v.find(part, at + 1)
        return out
    if not isinstance(v, list):
        raise JqError(f"Cannot determine indices of {kind(v)}")
    if isinstance(part, list):
        n = len(part)
        return [i for i in range(len(v) - n + 1) if equal(v[i : i + n], part)] if n else []
    return [i for i, x in enumerate(v) if equal(x, part)]


def get_path(v: Any, path: list) -> Any:
    for p in path:
        if v is None:
            return None
        try:
            v = index(v, p)
        except JqError:
            return None
    return v


def set_path(v: Any, path: list, new: Any) -> Any:
    if len(path) > 10_000:
        raise JqError("Path too deep")
    return _set(v, path, 0, new)


def _set(v: Any, path: list, at: int, new: Any) -> Any:
    if at == len(path):
        return new
    p = path[at]
    if isinstance(p, str):
        if v is not None and not isinstance(v, dict):
            raise JqError(f'Cannot index {kind(v)} with "{p}"')
        return {**(v or {}), p: _set((v or {}).get(p), path, at + 1, new)}
    if isinstance(p, dict):
        if v is not None and not isinstance(v, list):
            raise JqError(f"Cannot update slice of {kind(v)}")
        old = v or []
        s, e = bounds(p.get("start"), p.get("end"), len(old))
        part = _set(old[s:e] if v is not None else None, path, at + 1, new)
        if not isinstance(part, list):
            raise JqError("A slice of an array can only be assigned another array")
        return old[:s] + part + old[e:]
    if not number(p):
        raise JqError(f"Invalid path component of type {kind(p)}")
    if v is not None and not isinstance(v, list):
        raise JqError(f"Cannot index {kind(v)} with number")
    old = list(v or [])
    i = math.floor(p)
    if i < 0:
        i += len(old)
        if i < 0:
            raise JqError("Out of bounds negative array index")
    if i > MAX_INDEX:
        raise JqError("Array index too large")
    old += [None] * (i + 1 - len(old))
    old[i] = _set(old[i], path, at + 1, new)
    return old


def delete_paths(v: Any, paths: list[list]) -> Any:
    """Later and deeper places first, so that earlier deletions shift nothing."""
    for path in sorted(paths, key=order_key, reverse=True):
        v = _delete(v, path)
    return v


def _delete(v: Any, path: list) -> Any:
    if v is None or not path:
        return None
    p, rest = path[0], path[1:]
    if isinstance(v, dict) and isinstance(p, str):
        if p not in v:
            return v
        if rest:
            return {**v, p: _delete(v[p], rest)}
        return {k: x for k, x in v.items() if k != p}
    if isinstance(v, list) and number(p):
        i = math.floor(p)
        i += len(v) if i < 0 else 0
        if not 0 <= i < len(v):
            return v
        return [*v[:i], *([_delete(v[i], rest)] if rest else []), *v[i + 1 :]]
    if isinstance(v, list) and isinstance(p, dict):
        s, e = bounds(p.get("start"), p.get("end"), len(v))
        return v[:s] + (_delete(v[s:e], rest) if rest else []) + v[e:]
    raise JqError(f"Cannot delete field of {kind(v)}")


# Structure


def type_structure(v: Any) -> Any:
    """The shape of a value: type names in place of scalars; an array has at most one, merged, element."""
    if isinstance(v, dict):
        return {k: type_structure(x) for k, x in v.items()}
    if isinstance(v, list):
        out: list = []
        for x in v:
            out = [merge_structures(out[0], type_structure(x))] if out else [type_structure(x)]
        return out
    return ("integer" if isinstance(v, int) else "number") if number(v) else kind(v)


def merge_structures(a: Any, b: Any) -> Any:
    if isinstance(a, dict) and isinstance(b, dict):
        return {**{k: merge_structures(x, b[k]) if k in b else x for k, x in a.items()}, **{k: x for k, x in b.items() if k not in a}}
    if isinstance(a, list) and isinstance(b, list):
        return [merge_structures(a[0], b[0])] if a and b else a or b
    return "number" if {a if isinstance(a, str) else "", b if isinstance(b, str) else ""} == {"integer", "number"} else a
