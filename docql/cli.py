"""The command line: docql [options] PROGRAM [FILE...]; python -m docql.cli does the same."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from typing import Any

from docql.engine import ProgramError, compile_program
from docql.functions.interpret import Halt
from docql.functions.values import JqError, dumps, parse, parse_stream
from docql.sources.writers import shown


def arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("docql", description="Query JSON documents.")
    p.add_argument("-n", "--null-input", action="store_true", help="take null as the only input")
    p.add_argument("-R", "--raw-input", action="store_true", help="take each line as a string")
    p.add_argument("-s", "--slurp", action="store_true", help="take all inputs as one array")
    p.add_argument("-r", "--raw-output", action="store_true", help="show strings without quotes")
    p.add_argument("-j", "--join-output", action="store_true", help="as -r, without newlines")
    p.add_argument("-c", "--compact-output", action="store_true")
    p.add_argument("-S", "--sort-keys", action="store_true", help="sort keys of indented output")
    p.add_argument("-C", "--color-output", action="store_true")
    p.add_argument("-M", "--monochrome-output", action="store_true")
    p.add_argument("--tab", action="store_true")
    p.add_argument("--indent", type=int, default=2)
    p.add_argument("-e", "--exit-status", action="store_true", help="4 where there was no output")
    p.add_argument("--arg", nargs=2, action="append", default=[], metavar=("NAME", "TEXT"))
    p.add_argument("--argjson", nargs=2, action="append", default=[], metavar=("NAME", "JSON"))
    p.add_argument("-f", "--from-file", metavar="FILE", help="read the program from a file")
    p.add_argument("--language", default="jq", choices=["jq", "jsonata", "jsonpath"])
    p.add_argument("--spark", action="store_true", help="read the files (JSON lines) by Spark, row by row")
    p.add_argument("rest", nargs="*", metavar="PROGRAM FILE")
    return p.parse_args(args)


def inputs(o: argparse.Namespace, files: list[str]) -> Iterator[Any]:
    texts = (sys.stdin.read() if f == "-" else open(f, encoding="utf-8").read() for f in files or ["-"])  # noqa: SIM115
    if o.raw_input:
        text = "".join(texts)
        yield from [text] if o.slurp else text.split("\n")
    elif o.slurp:
        yield [v for t in texts for v in parse_stream(t)]
    else:
        for t in texts:
            yield from parse_stream(t)


def main(args: list[str] | None = None) -> int:
    o = arguments(sys.argv[1:] if args is None else args)
    rest = list(o.rest)
    text = open(o.from_file, encoding="utf-8").read() if o.from_file else rest.pop(0) if rest else "."  # noqa: SIM115
    how = {"raw": o.raw_output or o.join_output, "indent": None if o.compact_output else "\t" if o.tab else " " * o.indent, "sort_keys": o.sort_keys, "color": o.color_output and not o.monochrome_output}
    some = False
    try:
        program = compile_program(text, o.language)
        variables = {**dict(o.arg), **{k: parse(v, strict=True) for k, v in o.argjson}}
        if o.spark:
            from pyspark.sql import SparkSession

            from docql.sources.readers import json_lines
            from docql.sources.writers import texts

            spark = SparkSession.builder.getOrCreate()
            found = texts(program.rows(json_lines(spark, *rest), variables=variables).select("value"), **how)
        else:
            found = (shown(v, **how) for x in ([None] if o.null_input else inputs(o, rest)) for v in program.stream(x, variables))
        for line in found:
            some = True
            sys.stdout.write(line if o.join_output else line + "\n")
    except Halt as e:
        if e.value is not None:
            sys.stderr.write(e.value if isinstance(e.value, str) else dumps(e.value) + "\n")
        return e.code
    except (JqError, ProgramError, OSError) as e:
        sys.stderr.write(f"docql: error: {e}\n")
        return 5
    return 4 if o.exit_status and not some else 0


if __name__ == "__main__":
    sys.exit(main())
