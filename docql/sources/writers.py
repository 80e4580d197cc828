"""JSON out: compact, pretty, raw and joined text; files and tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docql.functions import values as V
from docql.sources.embedded import in_process, write_texts

COLORS = {"null": "1;30", "boolean": "0;39", "number": "0;39", "string": "0;32", "array": "1;39", "object": "1;39"}


def compact(df: DataFrame) -> DataFrame:
    """A column value of JSON text: of value itself where that is the only column of text, else of whole rows as objects."""
    if df.columns == ["value"] and isinstance(df.schema["value"].dataType, T.StringType):
        return df
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """A document per line, by all tasks."""
    compact(df).write.mode(mode).text(path, compression=compression)


def write_raw(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Strings without quotes; other values as JSON."""
    unquoted = F.when(F.col("value").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v string")["v"]).otherwise(F.col("value"))
    compact(df).select(unquoted.alias("value")).write.mode(mode).text(path)


def write_table(df: DataFrame, url: str, table: str, mode: str = "errorifexists", **options: str) -> None:
    """A row per document, by all tasks; into a database of the driver's own process, by the driver."""
    if in_process(url):
        write_texts(compact(df), url, table, mode, options)
    else:
        compact(df).write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def colored(v, indent: str | None, sort_keys: bool = False, depth: int = 0) -> str:
    k = V.kind(v)
    paint = lambda s: f"\x1b[{COLORS[k]}m{s}\x1b[0m"
    if k not in ("array", "object") or not v:
        return paint(V.dumps(v))
    gap, end = ("\n" + indent * (depth + 1), "\n" + indent * depth) if indent is not None else ("", "")
    if k == "array":
        parts = [colored(x, indent, sort_keys, depth + 1) for x in v]
    else:
        items = sorted(v.items(), key=lambda e: V.text_key(e[0])) if sort_keys else v.items()
        parts = [f"{V.dumps(a)}:{' ' if indent is not None else ''}{colored(b, indent, sort_keys, depth + 1)}" for a, b in items]
    left, right = "[]" if k == "array" else "{}"
    return paint(left) + gap + f",{gap}".join(parts) + end + paint(right)


def shown(v, raw: bool = False, indent: str | None = "  ", sort_keys: bool = False, color: bool = False) -> str:
    """A value's text; indent None is compact. Keys are sorted only where text is indented."""
    if raw and isinstance(v, str):
        return v
    if color:
        return colored(v, indent, sort_keys)
    return V.dumps(v) if indent is None else V.pretty(v, indent, sort_keys)


def texts(df: DataFrame, **how) -> Iterator[str]:
    """The rows' texts on the driver, a partition at a time."""
    for r in compact(df).toLocalIterator():
        yield shown(V.parse(r["value"]), **how)
