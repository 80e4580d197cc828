"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number in (0, 1) from the key and its own name; the shard with the least
-ln(draw)/weight wins. A record's shard depends on its key and the shards alone, so a further
shard takes records only into itself, and a share of the records that equals its share of weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docql.llm.common import stored

ROWS_PER_CELL, REPEATS_PER_ROW = 50_000, 10_000


def draw(key: Column, shard: Column) -> Column:
    """52 bits of md5("key:shard") as a number in (0, 1): the same on every engine that has md5."""
    digits = F.substring(F.md5(F.concat_ws(":", key, shard.cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The number of the winning shard. Ties (never seen: 52 bits) go to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and at least one")
    costs = F.array(*(F.struct((-F.ln(draw(key, F.lit(i))) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)))
    return F.array_min(costs)["shard"]


def with_slots(df: DataFrame, shard: str, *order: str) -> DataFrame:
    """Number the rows of every shard from 0 without gaps, no shard being sorted in one task.

    The first order column must be a hex digest: its leading digits cut every shard into cells of
    about ROWS_PER_CELL rows, the cells' counts give each cell's first slot, and rows are numbered
    within cells. There are as many cells as rows demand, so tasks stay small at any size. Rows that are equal
    are counted first, each task its own, and get their slots together, REPEATS_PER_ROW in a row at most on the way.
    """
    counted = stored(df.groupBy(*df.columns).agg(F.count("*").alias("_n")))
    rows, shards = counted.count(), max(1, counted.select(shard).distinct().count())
    digits = 1
    while 16**digits * shards * ROWS_PER_CELL < rows:
        digits += 1
    cut = counted.withColumn("_cell", F.substring(order[0], 1, digits))
    cells = cut.groupBy(shard, "_cell").agg(F.sum("_n").alias("_all"))
    before = Window.partitionBy(shard).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_first", F.coalesce(F.sum("_all").over(before), F.lit(0))).drop("_all")
    within = Window.partitionBy(shard, "_cell").orderBy(*order)
    placed = cut.withColumn("_at", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).join(cells, [shard, "_cell"])
    placed = placed.withColumn("_at", F.col("_first") + F.col("_at")).withColumn("_end", F.col("_at") + F.col("_n") - 1)
    parts = placed.withColumn("_at", F.explode(F.sequence("_at", "_end", F.lit(REPEATS_PER_ROW).cast("long"))))
    if counted.where(F.col("_n") > REPEATS_PER_ROW).head(1):
        parts = parts.hint("rebalance")
    slots = F.sequence("_at", F.least("_end", F.col("_at") + F.lit(REPEATS_PER_ROW - 1)))
    return parts.withColumn("slot", F.explode(slots)).drop("_cell", "_at", "_end", "_first", "_n")


def shard_documents(docs: DataFrame, shards: int = 40, weights: list[float] | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Nulls: a null doc_id hashes as the empty key; a null text has no bytes (size 16, crc32 0).
    Repeated rows share a shard and get a slot each. Other columns are not looked at. weights, if
    given, has one more entry than shards: that of the shard grown_shard counts.
    """
    weights = weights or [1.0] * (shards + 1)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary")).cast("bigint")
    out = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"),
        crc.alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, weights[:shards]).alias("shard"),
        shard_of(key, weights).alias("grown_shard"),
        F.md5(F.concat_ws(":", key, crc.cast("string")).cast("binary")).alias("_order"),
    )
    return with_slots(out, "shard", "_order", "doc_id", "text_crc32", "size").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
