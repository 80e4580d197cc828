"""The formats @text @json @csv @tsv @html @uri @urid @base64 @base64d @base32 @base32d @sh."""

from __future__ import annotations

import base64
import re
from typing import Any
from urllib.parse import quote_plus, unquote_plus

from docql.functions.values import JqError, dumps, kind

ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "'": "&apos;", '"': "&quot;"}
TSV = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r"}


def text(v: Any) -> str:
    return v if isinstance(v, str) else dumps(v)


def _rows(v: Any, name: str) -> list:
    if not isinstance(v, list):
        raise JqError(f"{kind(v)} cannot be formatted as {name}, only an array can")
    return v


def _decode(v: Any, do) -> str:
    try:
        return do(text(v)).decode("utf-8", "replace")
    except ValueError:
        raise JqError(f"{kind(v)} ({dumps(v)[:10]}) is not valid base data") from None


def _shell(v: Any) -> str:
    s = text(v)
    return s if re.fullmatch(r"[A-Za-z0-9_./:=@%^,+-]+", s) else "'" + s.replace("'", "'\\''") + "'"


def _pad(s: str, n: int) -> str:
    return s + "=" * (-len(s) % n)


FORMATS = {
    "text": text,
    "json": dumps,
    "csv": lambda v: ",".join('"' + x.replace('"', '""') + '"' if isinstance(x, str) else dumps(x) for x in _rows(v, "csv")),
    "tsv": lambda v: "\t".join("".join(TSV.get(c, c) for c in text(x)) for x in _rows(v, "tsv")),
    "html": lambda v: "".join(ENTITIES.get(c, c) for c in text(v)),
    "uri": lambda v: quote_plus(text(v), safe="*-._").replace("~", "%7E").replace("+", "%20"),
    "urid": lambda v: unquote_plus(text(v)),
    "base64": lambda v: base64.b64encode(text(v).encode()).decode(),
    "base64d": lambda v: _decode(v, lambda s: base64.b64decode(_pad(s.rstrip("="), 4), validate=True)),
    "base32": lambda v: base64.b32encode(text(v).encode()).decode(),
    "base32d": lambda v: _decode(v, lambda s: base64.b32decode(_pad(s.rstrip("="), 8))),
    "sh": _shell,
}


def apply_format(name: str, v: Any) -> str:
    if name not in FORMATS:
        raise JqError(f"{name} is not a valid format")
    return FORMATS[name](v)
