"""Programs: compiled once, run over values, columns, datasets and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docql.functions import interpret
from docql.functions.values import parse as parse_json
from docql.operators.columns import COMPILE, Many, Scope, Unsupported, literal
from docql.operators.columns import One as Typed
from docql.operators.dynamic import outputs, structures
from docql.operators.relational import Frame, Grouped, Planner
from docql.plans import nodes as N
from docql.plans.parser import ProgramError, parse
from docql.sources.readers import SLURP_BYTES, slurp

__all__ = ["Program", "ProgramError", "Registry", "Unsupported", "compile_program", "structures"]

FRONT_ENDS: dict[str, Callable[[str], N.Node]] = {"jq": parse}


def front_end(name: str) -> Callable[[str], N.Node]:
    if name == "jsonata" and name not in FRONT_ENDS:
        from docql.plans.jsonata import translate

        FRONT_ENDS[name] = translate
    elif name == "jsonpath" and name not in FRONT_ENDS:
        from docql.plans.sqljson import translate

        FRONT_ENDS[name] = translate
    if name not in FRONT_ENDS:
        raise ProgramError(f"unknown language {name}")
    return FRONT_ENDS[name]


class Registry:
    """Further functions: of columns (tier 2), or of values for the interpreter (tier 3)."""

    def __init__(self):
        self.columns: dict[tuple[str, int], Callable] = {}
        self.values: dict[tuple[str, int], Callable] = {}

    def register(self, name: str, arity: int, column_fn: Callable[..., Column] | None = None, returns: T.DataType | None = None, value_fn: Callable | None = None, generator_fn: Callable | None = None) -> None:
        """column_fn: of the input's and arguments' columns, giving one of type returns. value_fn: (input, *arguments) to a value.

        generator_fn: (input, run, *arguments) to any number of values, the arguments unevaluated: run(argument, value) gives
        the outputs of one.
        """
        from docql.operators.column_functions import FUNCTIONS, on_value

        if column_fn is not None:
            on_value(name, arity)(lambda v, *a: Typed(column_fn(v.col, *(x.col for x in a)), returns))
            self.columns[name, arity] = FUNCTIONS[name, arity]
        if value_fn is not None:

            def run(x, args, env):
                yield value_fn(x, *(interpret.first(interpret.values(a, x, env)) for a in args))

            self.values[name, arity] = run
        if generator_fn is not None:

            def generate(x, args, env):
                yield from generator_fn(x, lambda a, v: interpret.values(a, v, env), *args)

            self.values[name, arity] = generate


class Program:
    def __init__(self, text: str, tree: N.Node, registry: Registry | None = None):
        self.text, self.ast, self.registry = text, tree, registry
        self.tiers: list[tuple[str, str]] = []

    @property
    def extra(self) -> dict | None:
        return self.registry.values if self.registry else None

    # One value

    def stream(self, value: Any, variables: dict[str, Any] | None = None, inputs: Iterable[Any] | None = None) -> Iterator[Any]:
        """The outputs for one value (None, bool, int, float, str, list, dict)."""
        return interpret.run(self.ast, value, variables, inputs, self.extra)

    def apply(self, value: Any, **more: Any) -> Any:
        """The first output, None where there is none."""
        return next(self.stream(value, **more), None)

    def apply_all(self, values: Iterable[Any], consumer: Callable[[Any], None] | None = None, **more: Any) -> list[Any]:
        out = []
        for v in values:
            for w in self.stream(v, **more):
                out.append(w) if consumer is None else consumer(w)
        return out

    def apply_null_input(self, inputs: Iterable[Any], **more: Any) -> list[Any]:
        return [*self.stream(None, inputs=inputs, **more)]

    # Columns

    def compiled(self, column: Column, kind: T.DataType, variables: dict[str, Any] | None = None):
        return COMPILE(self.ast, Scope(Typed(column, kind), {k: literal(v) for k, v in (variables or {}).items()}, {}))

    def column(self, df: DataFrame, name: str, variables: dict[str, Any] | None = None) -> Column:
        """The program's only output for a typed column; an array of its outputs if it is a generator."""
        return self.compiled(F.col(name), df.schema[name].dataType, variables).col

    def rows(self, df: DataFrame, name: str = "value", variables: dict[str, Any] | None = None, mode: str = "failfast", keep: tuple[str, ...] = ()) -> DataFrame:
        """A row per output. A typed column stays in the JVM where it can; a text column holds JSON and is interpreted."""
        if not isinstance(df.schema[name].dataType, (T.StringType, T.VariantType)):
            try:
                out = self.compiled(F.col(name), df.schema[name].dataType, variables)
                self.tiers = [("T2", "program")]
                return df.select(*keep, F.explode(out.col).alias("value")) if isinstance(out, Many) else df.select(*keep, out.col.alias("value"))
            except Unsupported:
                df = df.withColumn(name, F.to_json(name, {"ignoreNullFields": "false"}))
        elif isinstance(df.schema[name].dataType, T.VariantType):
            df = df.withColumn(name, F.to_json(name))
        self.tiers = [("T3", "program")]
        return outputs(df, self.ast, name, variables, mode, keep, self.extra)

    # Datasets

    def dataset(self, df: DataFrame, datasets: dict[str, DataFrame] | None = None, variables: dict[str, Any] | None = None, mode: str = "failfast", order: tuple[str, ...] = (), whole: int = SLURP_BYTES) -> DataFrame:
        """The program over the array of all rows of df; $name of datasets are further arrays.

        order names columns in which the rows of df are to be seen. The result has a row for each element (or
        output); an object's fields become columns, another value the column value.

        A program without a distributed form is interpreted over one array of all rows, if their JSON has whole bytes
        at most (0: never): a row with JSON text in value for each output. Beyond that it is refused as Unsupported.
        """
        try:
            return self._planned(df, datasets, variables, mode, order)
        except Unsupported as e:
            try:
                return self._as_one(df, datasets or {}, variables, mode, order, whole)
            except ValueError as too_large:
                raise Unsupported(f"{e}; {too_large}") from None

    def _as_one(self, df: DataFrame, datasets: dict[str, DataFrame], variables: dict[str, Any] | None, mode: str, order: tuple[str, ...], whole: int) -> DataFrame:
        def array(d: DataFrame, keys: tuple[str, ...]) -> DataFrame:
            row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in d.columns)), {"ignoreNullFields": "false"})
            return slurp(d.select(*(F.col(f"`{k}`").alias(f"_{i}") for i, k in enumerate(keys)), row.alias("value")), order=[f"_{i}" for i in range(len(keys))], limit=whole)

        held = dict(variables or {}) | {name: parse_json(array(d, ()).first()["value"]) for name, d in datasets.items()}
        self.tiers = [("T3", "whole dataset")]
        out = outputs(array(df, order), self.ast, variables=held, mode=mode, extra=self.extra)
        return out.select("value") if mode == "failfast" else out.select("value", "_error")

    def _planned(self, df: DataFrame, datasets: dict[str, DataFrame] | None, variables: dict[str, Any] | None, mode: str, order: tuple[str, ...]) -> DataFrame:
        from docql.operators.relational import Key

        planner = Planner({k: Frame(d) for k, d in (datasets or {}).items()}, variables, mode, self.extra)
        out = planner.plan(self.ast, Frame(df, order=tuple(Key(F.col(c)) for c in order)))
        self.tiers = planner.tiers.parts
        if isinstance(out, Grouped):  # arrays of rows
            out = planner.per_group(N.Collect(N.Iterate(N.Identity())), replace(out, stream=True))
        return out.shown

    def explain_tier(self, df: DataFrame | None = None, **more: Any) -> list[tuple[str, str]]:
        """(tier, part) of the last run, or of a plan for df made now."""
        if df is not None:
            self.dataset(df, **more)
        return self.tiers


def compile_program(text: str, language: str = "jq", registry: Registry | None = None) -> Program:
    return Program(text, front_end(language)(text), registry)
