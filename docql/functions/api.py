"""Helpers for columns of VariantType and typed columns: safe and coercing accessors, JSON pointers, updates."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_of_pointer(pointer: str) -> str:
    """An RFC 6901 pointer as a variant path: /a/0/b~1c to $.a[0]['b/c']."""
    if pointer == "":
        return "$"
    if not pointer.startswith("/"):
        raise ValueError(f"not a JSON pointer: {pointer}")
    out = "$"
    for part in pointer[1:].split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        out += f"[{part}]" if re.fullmatch(r"0|[1-9]\d*", part) else f".{part}" if re.fullmatch(r"[A-Za-z_]\w*", part) else "['" + part.replace("'", "\\'") + "']"
    return out


def at(v: Column, pointer: str) -> Column:
    """The variant at a pointer, null where there is none."""
    return F.try_variant_get(v, path_of_pointer(pointer), "variant")


def required(v: Column, pointer: str) -> Column:
    found = at(v, pointer)
    return F.coalesce(found, F.raise_error(F.lit(f"missing: {pointer}")).cast("variant"))


def _as(kind: str):
    def read(v: Column, pointer: str = "", default: Any = None) -> Column:
        got = F.try_variant_get(v, path_of_pointer(pointer), kind)
        return got if default is None else F.coalesce(got, F.lit(default))

    return read


as_string, as_long, as_int, as_double, as_boolean = map(_as, ("string", "bigint", "int", "double", "boolean"))


def type_of(v: Column) -> Column:
    """null, boolean, number, string, array or object."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), "null")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "STRING", "string")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def with_field(s: Column, name: str, value: Column) -> Column:
    return s.withField(name, value)


def without(s: Column, *names: str) -> Column:
    return s.dropFields(*names)


def merge(a: Column, b: Column) -> Column:
    """Of two maps; b's values win, a's order of keys holds."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def deep_merge(a: Column, b: Column, a_type: T.StructType, b_type: T.StructType) -> Column:
    """Of two objects of the given types: fields of b win, save that objects in both are merged in turn; a's order of fields holds.

    Where one of the objects is null, the other counts.
    """
    made = []
    for f in [*a_type.fields, *(f for f in b_type.fields if f.name not in a_type.names)]:
        if f.name not in b_type.names:
            made.append(a[f.name].alias(f.name))
        elif f.name not in a_type.names:
            made.append(b[f.name].alias(f.name))
        else:
            other = b_type[f.name].dataType
            both = isinstance(f.dataType, T.StructType) and isinstance(other, T.StructType)
            made.append((deep_merge(a[f.name], b[f.name], f.dataType, other) if both else F.when(b.isNull(), a[f.name]).otherwise(b[f.name])).alias(f.name))
    return F.when(a.isNotNull() | b.isNotNull(), F.struct(*made))


def object_of(**fields: Any) -> Column:
    """An object of columns or plain values, in the order given."""
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()))


def array_of(*items: Any) -> Column:
    return F.array(*(v if isinstance(v, Column) else F.lit(v) for v in items))


def elements(v: Column, pointer: str = "") -> Column:
    """The elements of a variant's array, each a variant; null where there is no array."""
    return F.try_variant_get(v, path_of_pointer(pointer), "array<variant>")


def entries(v: Column, pointer: str = "") -> Column:
    """The fields of a variant's object as (key, value), in the order of keys; null where there is no object."""
    return F.map_entries(F.try_variant_get(v, path_of_pointer(pointer), "map<string, variant>"))
