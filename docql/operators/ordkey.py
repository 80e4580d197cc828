"""A binary key that orders, groups and joins values of any type as the language does (VARIANT can't be ordered)."""

from __future__ import annotations

import struct
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docql.functions import values as V


def encode(v: Any) -> bytes:
    """Bytes whose order is that of values: a tag, then the value so that longer or greater comes later.

    Numbers are compared as doubles, then exactly; strings by UTF-16 unit.
    """
    k = V.kind(v)
    tag = bytes([V.RANK[k] + 1])
    if k == "null":
        return tag
    if k == "boolean":
        return tag + bytes([v])
    if k == "number":
        x = float(v)
        if x != x:
            return tag + b"\xff" * 9
        bits = struct.unpack(">Q", struct.pack(">d", x + 0.0))[0]
        bits = bits ^ 0xFFFFFFFFFFFFFFFF if bits >> 63 else bits | 1 << 63
        rest = int(v) - int(x) if isinstance(v, int) else 0
        return tag + bits.to_bytes(8, "big") + (rest + 0x8000).to_bytes(2, "big")
    if k == "string":
        return tag + text(v)
    if k == "array":
        return tag + b"".join(b"\x01" + encode(x) for x in v) + b"\x00"
    keys = sorted(v, key=V.text_key)
    return tag + len(keys).to_bytes(4, "big") + b"".join(map(text, keys)) + b"".join(encode(v[x]) for x in keys)


def text(s: str) -> bytes:
    """Units of UTF-16 with 00 00 escaped, and an end that sorts before any unit."""
    raw = V.text_key(s)
    return b"".join(raw[i : i + 2] if raw[i : i + 2] != b"\x00\x00" else b"\x00\x00\xff\xff" for i in range(0, len(raw), 2)) + b"\x00\x00\x00\x00"


@F.pandas_udf(T.BinaryType())
def _keys(column: pd.Series) -> pd.Series:
    return column.map(lambda t: encode(None if t is None else V.parse(t)))


def ordkey(json_text: Column | str) -> Column:
    return _keys(json_text)
