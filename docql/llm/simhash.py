"""SimHash near-duplicates, linked by meet-in-the-middle ball hashing.

Two fingerprints link at 3 or fewer differing bits. Every fingerprint sends out variants of itself
within half that radius, variants are shuffled, and fingerprints that meet in one are close. Half
of 3 isn't whole, so one of two fingerprints at distance 3 must flip two bits and the other one:
at an odd distance their parities differ, so those of even parity flip two and those of odd
parity flip one. Of three bits two lie in the same half of the word, so only pairs of bits within a
half are flipped (992 of 2016). Single flips of all fingerprints find the pairs at distance 2.

What meets in a variant at flips p and q differs by p + q bits at most. So all that flip one bit (or,
in the variants of even parity, none) are close to all that meet there, and links from one of them to
all others join the group: as many links as members. Two that flip two bits each need not be close.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docql.llm.common import ship, stored
from docql.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Variants in one reduce group, about; groups that one task reads (10 MB each).
GROUP_VARIANTS, GROUPS_PER_TASK = 1_000_000, 4
#: Fingerprints whose variants are made at once, which bounds a task's memory.
PART = 500
#: Groups that one step of sending tells apart, bytes of variants that a later step sorts at once, fingerprints of a task.
FAN, STEP_BYTES, TASK_PRINTS = 1_000, 32 << 20, 20_000
SELF = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _lanes() -> np.ndarray:
    """For a byte, its 8 bits as 8 byte lanes of a 64-bit number."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


LANES = _lanes()


def fingerprint(text: str | None) -> int:
    """Unsigned 64 bits; 0 where there is no word."""
    words = words_of(text)
    if not words:
        return 0
    parts = [b" ".join(t) for t in zip(words, words[1:], words[2:])] or [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))
    n, counts = len(parts), np.zeros(64, np.int64)
    if n < 32:
        counts = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0)
    else:
        starts = np.arange(0, n, 255)  # lanes of a byte hold sums of up to 255
        octets = hashes.view(np.uint8).reshape(n, 8)
        for k in range(8):
            sums = np.add.reduceat(LANES[octets[:, k]], starts)
            counts[8 * k : 8 * k + 8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per input row: doc_id, th (a hash of the text), fp (the fingerprint as a signed long)."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("th", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "th", "fp"])

    return docs.select("doc_id", text_hash().alias("th"), "text").mapInArrow(run, schema)


def flips() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Masks and codes (i + 64 j) of single bits, and of pairs of bits within a half."""
    one = np.arange(64)
    pairs = np.array([(i, j) for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)])
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return bit, (one * 65).astype(np.uint16), bit[pairs[:, 0]] | bit[pairs[:, 1]], (pairs[:, 0] + 64 * pairs[:, 1]).astype(np.uint16)


def mask_of(code: np.ndarray) -> np.ndarray:
    i, j = (code % 64).astype(np.uint64), (code // 64 % 64).astype(np.uint64)
    one = np.uint64(1)
    return np.where(code == SELF, np.uint64(0), np.where(i == j, one << i, (one << i) | (one << j)))


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the fingerprints send out: variants, and codes of the flips that made them."""
    one, one_code, two, two_code = flips()
    even = fps[np.bitwise_count(fps) % 2 == 0]
    values = [(fps[:, None] ^ one).ravel(), even, (even[:, None] ^ two).ravel()]
    codes = [np.tile(one_code, len(fps)), np.full(len(even), SELF, np.uint16), np.tile(two_code, len(even))]
    return np.concatenate(values), np.concatenate(codes)


def met(values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints that meet in a variant, as stars; repeats removed."""
    order = np.argsort(values)
    values = values[order]
    same = np.concatenate([[False], values[1:] == values[:-1]])
    part = same | np.concatenate([same[1:], [False]])
    values, codes, first = values[part], codes[order][part], ~same[part]
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    near = (codes == SELF) | (codes % 64 == codes // 64)
    groups = np.cumsum(first) - 1
    center = np.full(groups[-1] + 1, -1)
    places = np.flatnonzero(near)
    center[groups[places][::-1]] = places[::-1]  # the first of each group that is near all others
    held = center[groups] >= 0
    fps = values ^ mask_of(codes)
    a, b = fps[held], fps[center[groups[held]]]
    pairs = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1]


def packed(parts: np.ndarray, values: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    """A row (part, packed) for every part that has variants, none for others."""
    order = np.argsort(parts, kind="stable")
    parts, values, codes = parts[order], values[order], codes[order]
    starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.zeros(0, np.int64)
    rows = [values[s:e].tobytes() + codes[s:e].tobytes() for s, e in zip(starts, [*starts[1:], len(parts)])]
    return pa.RecordBatch.from_arrays([pa.array(parts[starts].astype(np.int64)), pa.array(rows, pa.binary())], names=["part", "packed"])


def unpacked(rows: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    values, codes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
    for x in rows:
        raw = x.as_buffer()
        n = len(raw) // 10
        values.append(np.frombuffer(raw, np.uint64, n))
        codes.append(np.frombuffer(raw, np.uint16, n, 8 * n))
    return np.concatenate(values), np.concatenate(codes)


def sent(fps: DataFrame, n: int, group_variants: int = GROUP_VARIANTS, fan: int = FAN) -> DataFrame:
    """The variants of n fingerprints, packed by group: (part, packed).

    A task can't send a row to each of any number of groups, or rows would grow with the square of n. So groups
    are reached in steps of fan at most, each a shuffle of all variants: PART fingerprints send fan rows a step, and
    steps grow with the logarithm of n only (one up to FAN groups, that is 1.8 million fingerprints; two up to
    1.8 billion).
    """
    groups = max(1, n * 560 // group_variants)
    steps = 1
    while fan**steps < groups:
        steps += 1

    def part_of(values: np.ndarray, step: int) -> np.ndarray:
        return ((values * MIX) >> np.uint64(24)) % np.uint64(groups) // np.uint64(fan ** (steps - 1 - step))

    def first(batches):
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), PART):
                values, codes = variants(all_fps[at : at + PART])
                yield packed(part_of(values, 0), values, codes)

    def further(step: int):
        def run(batches):
            held, size = [], 0
            for batch in batches:
                for x in batch.column(0):
                    held.append(x)
                    size += len(x.as_buffer())
                    if size > STEP_BYTES:
                        values, codes = unpacked(held)
                        yield packed(part_of(values, step), values, codes)
                        held, size = [], 0
            values, codes = unpacked(held)
            yield packed(part_of(values, step), values, codes)

        return run

    schema = "part long, packed binary"
    spread = max(fps.sparkSession.sparkContext.defaultParallelism, n // TASK_PRINTS)
    out = fps.select("fp").repartition(spread).mapInArrow(first, schema)
    for step in range(1, steps):
        out = out.repartition(spread, "part").select("packed").mapInArrow(further(step), schema)
    return out


def links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that join all within the radius, directly or through others."""
    ship(fps.sparkSession)

    def meet(table: pa.Table) -> pa.Table:
        a, b = met(*unpacked(table.column("packed")))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    n = fps.count()
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, n * 560 // GROUP_VARIANTS // GROUPS_PER_TASK)
    return sent(fps, n).repartition(tasks, "part").groupBy("part").applyInArrow(meet, "a long, b long")


def roots_of(classes: DataFrame) -> DataFrame:
    """The rows of classes, distinct fingerprints (fp) and more, with the root of each one's component."""
    roots = stored(components(stored(links(classes.select("fp")).distinct())))
    return stored(classes.join(roots, classes["fp"] == roots["node"], "left").select(*classes.columns, F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of fingerprints at RADIUS or fewer
    differing bits. Null and empty texts have fingerprint zero and link like others. Rows are kept,
    repeated ones too. A null doc_id is never the smallest unless a component holds no other.
    """
    prints = stored(fingerprints(docs))
    of = roots_of(stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"))))
    named = stored(of.groupBy("root").agg(F.min("least").alias("component_id")))
    of = stored(of.join(named, "root").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their near-duplicates: the smallest doc_id (under one doc_id, the
    smallest hash of the text) of each component.

    Rows of one doc_id with unrelated texts are documents of their own. Exact repeats of a row's doc_id and text are
    reduced to one; rows without doc_id are kept.
    """
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("least")
    of = roots_of(stored(fingerprints(docs).groupBy("fp").agg(least)))
    kept = of.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("_kept_id"), F.col("least.th").alias("_kept_th"))
    rows = docs.withColumn("_text_hash", text_hash())
    rows = rows.join(stored(kept), (F.col("doc_id") == F.col("_kept_id")) & (F.col("_text_hash") == F.col("_kept_th")), "left_semi")
    return rows.dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash").union(docs.where("doc_id is null"))
