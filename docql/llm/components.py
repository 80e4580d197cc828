"""Connected components of a graph of links, by alternating large and small stars.

Each round joins every node to the least of its neighbours: large stars move the greater
neighbours, small stars the others, until nothing changes (about log of the size rounds). Rounds are
written to the shared folder; minima are pre-aggregated, and only the join of links with minima sees
a hot node, which is a sort-merge join that adaptive execution splits. Links that are few, by count, are
joined by one task, as rounds of jobs would take longer than the work in them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docql.llm.common import ship, stored

MAX_ROUNDS = 64
#: So many links go to one task (two numbers each).
FEW_LINKS = 100_000


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links, stored and used up: a > b. Large: both directions, greater neighbours join the least; small: b's of every a."""
    both = stored(links.union(links.select("b", "a")).toDF("u", "v") if large else links.toDF("u", "v").distinct(), links)
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return stored(out.where("a > b").distinct(), both, least)


def joined(links: Iterable[tuple]) -> Iterator[tuple]:
    """(node, root) of all nodes of links (a > b), by union-find."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        for x in (a, b):
            parent.setdefault(x, x)
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return ((x, root(x)) for x in parent)


def in_one_task(links: DataFrame) -> DataFrame:
    ship(links.sparkSession)
    kind = links.schema["a"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("root", kind)])

    def run(batches):
        names = None
        pairs: list[tuple] = []
        for batch in batches:
            names = batch.schema.field(0).type
            pairs += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        found = [*joined(pairs)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], names) for k in range(2)], names=schema.names)

    return links.repartition(1).mapInArrow(run, schema)


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(a, b) links of one orderable type to (node, root): the least node reachable, for every node in a link.

    Links are undirected; loops, repeats and nulls are ignored. No links give no rows.
    """
    links = links.toDF("x", "y").where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    links = stored(links)
    mark = _mark(links)
    if mark[0] <= few:
        return in_one_task(links)
    for _ in range(MAX_ROUNDS):
        links = _star(_star(links, True), False)
        now = _mark(links)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b")).distinct()
