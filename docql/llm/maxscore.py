"""Exact top-k search by inner product, with MaxScore.

A vector is a document whose terms are its dimensions. Each shard of candidates keeps a posting list per
term, ordered by document, with the list's least and greatest weight; so a query weight bounds what
the term can add to any score in the shard. For a query, terms are sorted by the spread of what they
add. The terms whose spreads together can't lift a document past the k-th best score so far are
non-essential: only the other, essential lists are traversed. Documents that could still get among the k
best are then probed in one non-essential list after the other, the widest first, and dropped as soon as the
rest of the bounds can't save them. The k-th best score grows on the way, so more terms become
non-essential from block to block of documents. Shards' best lists are merged.

Queries go in blocks, one block after the other: a block is sent to all workers, which read the stored candidates
shard by shard. So no candidate is shuffled for a block. The first shard is searched before the others, and each
query's k-th best score there is the floor that its search of any shard begins with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docql.llm.common import ship, stored, stored_parts

K = 5
SCALE = 256
#: Candidates in a shard, queries in a block, documents in a block of a shard's lists.
SHARD_ROWS, BLOCK_QUERIES, LIST_BLOCK = 20_000, 20_000, 2_000
#: Queries that go through a shard's long lists together.
TOGETHER = 500
#: Lists are probed for up to one of so many documents.
PROBED = 16


class Shard:
    """Posting lists of one shard. A term that a document lacks has weight 0 there."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        rows = np.repeat(np.arange(len(ids)), sizes)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        self.ids = ids[order]
        docs = rank[rows]
        by = np.lexsort((docs, terms))
        self.docs, self.weights = docs[by], weights[by].astype(np.int64)
        self.terms, first = np.unique(terms[by], return_index=True)
        self.lists = {int(t): (self.docs[s:e], self.weights[s:e]) for t, s, e in zip(self.terms, first, [*first[1:], len(by)])}
        # A list that holds all documents can be read by place; others need 0 in their bounds.
        self.full = {t: len(d) == len(ids) and len(np.unique(d)) == len(ids) for t, (d, _) in self.lists.items()}
        self.bounds = {t: (min(w.min(), w.max() if self.full[t] else 0), max(w.max(), w.min() if self.full[t] else 0)) for t, (_, w) in self.lists.items()}

        self.matrix = None
        if self.lists and 4 * len(by) >= len(self.lists) * len(ids):  # long lists are laid out by place
            self.matrix = np.zeros((len(self.lists), len(ids)))
            for row, (d, w) in zip(self.matrix, self.lists.values()):
                row[d] = w

    def weights_of(self, term: int, docs: np.ndarray) -> np.ndarray:
        have, weights = self.lists[term]
        if self.full[term]:
            return weights[docs]
        at = np.minimum(np.searchsorted(have, docs), len(have) - 1)
        return np.where(have[at] == docs, weights[at], 0)

    def add_range(self, term: int, start: int, end: int, into: np.ndarray, weight: int) -> None:
        have, weights = self.lists[term]
        if self.full[term]:
            into += weight * weights[start:end]
        else:
            s, e = np.searchsorted(have, (start, end))
            np.add.at(into, have[s:e] - start, weight * weights[s:e])

    def best(self, query: dict[int, int], own: int | None, k: int = K, least: int | None = None) -> list[tuple[int, int]]:
        """The k greatest (score, id), ties to the smaller id, without the document own; only scores from least on are asked for."""
        used = [(t, q) for t, q in query.items() if q and t in self.lists]
        low = {t: min(q * self.bounds[t][0], q * self.bounds[t][1]) for t, q in used}
        spread = {t: max(q * self.bounds[t][0], q * self.bounds[t][1]) - low[t] for t, q in used}
        used.sort(key=lambda x: spread[x[0]])
        base = sum(low.values())  # what every document scores at least
        reach = np.cumsum([0, *(spread[t] for t, _ in used)])  # what the first terms can add to that
        top: list[tuple[int, int]] = []
        for start in range(0, len(self.ids), LIST_BLOCK):
            end = min(start + LIST_BLOCK, len(self.ids))
            # What a score must exceed; at the k-th best an earlier document, with a smaller id, stays.
            floors = (None if least is None else least - 1, -top[-1][0] if len(top) == k else None)
            floor = max((x for x in floors if x is not None), default=None)
            # Terms before `split` are non-essential: alone they lift nothing above the floor.
            split = 0 if floor is None else max(0, int(np.searchsorted(reach, floor - base, side="right")) - 1)
            scores = np.full(end - start, base, np.int64)
            for t, q in used[split:]:
                self.add_range(t, start, end, scores, q)
                scores -= low[t]
            docs = np.arange(start, end)
            if floor is not None:
                keep = scores + reach[split] > floor
                docs, scores = docs[keep], scores[keep]
            for i in range(split - 1, -1, -1):
                if not len(docs):
                    break
                t, q = used[i]
                scores = scores + q * self.weights_of(t, docs) - low[t]
                keep = scores + reach[i] > floor
                docs, scores = docs[keep], scores[keep]
            if own is not None:
                other = self.ids[docs] != own
                docs, scores = docs[other], scores[other]
            top = kept_best(top, scores, self.ids[docs], k)
        return [(-s, i) for s, i in top]


def kept_best(top: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """top, (-score, id) in order, with the scores of further ids, which rise."""
    if len(ids) > k:
        part = np.argpartition(-scores, k - 1)[:k]
        last = scores[part].min()
        # Of equal scores at the cut the smaller ids, which come first, are wanted.
        above = np.flatnonzero(scores > last)
        part = np.concatenate([above, np.flatnonzero(scores == last)[: k - len(above)]])
        ids, scores = ids[part], scores[part]
    return sorted([*top, *zip((-scores).astype(np.int64).tolist(), ids.tolist())])[:k]


class Together:
    """MaxScore for many queries at once in a shard with long lists: a product of matrices goes through the essential lists.

    A query's non-essential terms have no part in that product. Sums are whole numbers below 2**53, so doubles are exact.
    """

    def __init__(self, shard: Shard, queries: list[dict[int, int]]):
        self.shard, row = shard, {int(t): i for i, t in enumerate(shard.terms)}
        self.q = np.zeros((len(queries), len(row)))
        for i, query in enumerate(queries):
            for t, x in query.items():
                if t in row:
                    self.q[i, row[t]] = x
        ends = np.stack([self.q * shard.matrix.min(axis=1), self.q * shard.matrix.max(axis=1)])
        self.low = ends.min(axis=0)
        spread = ends.max(axis=0) - self.low
        self.order = np.argsort(spread, axis=1, kind="stable")
        self.rank = np.argsort(self.order, axis=1, kind="stable")
        self.reach = np.concatenate([np.zeros((len(queries), 1)), np.cumsum(np.take_along_axis(spread, self.order, axis=1), axis=1)], axis=1)
        self.base = self.low.sum(axis=1)

    @staticmethod
    def fits(shard: Shard, queries: list[dict[int, int]]) -> bool:
        most = max((abs(x) for q in queries for x in q.values()), default=0)
        return shard.matrix is not None and most * float(np.abs(shard.matrix).max()) * len(shard.terms) < 2**52

    def best(self, owns: list[int], least: list[int | None], k: int) -> list[list[tuple[int, int]]]:
        shard, n = self.shard, len(owns)
        top: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        floors = np.array([-np.inf if x is None else x - 1 for x in least])
        for start in range(0, len(shard.ids), LIST_BLOCK):
            lists = shard.matrix[:, start : start + LIST_BLOCK]
            split = [max(0, int(np.searchsorted(self.reach[i], floors[i] - self.base[i], side="right")) - 1) for i in range(n)]
            essential = self.rank >= np.array(split)[:, None]
            # Non-essential terms are at their least here.
            sums = (self.q * essential) @ lists + (self.base - (self.low * essential).sum(axis=1))[:, None]
            likely = sums + self.reach[np.arange(n), split][:, None] > floors[:, None]
            # Where many documents are still competitive, going through the other lists, too, is less work than probing them.
            many = likely.sum(axis=1) * PROBED > lists.shape[1]
            if many.any():
                rest = ~essential[many]
                sums[many] += (self.q[many] * rest) @ lists - (self.low[many] * rest).sum(axis=1)[:, None]
                likely[many] = sums[many] > floors[many][:, None]
            for i in np.flatnonzero(likely.any(axis=1)).tolist():
                docs, floor = np.flatnonzero(likely[i]), floors[i]
                scores = sums[i, docs]
                for r in range(-1 if many[i] else split[i] - 1, -1, -1):  # probes, from the widest of the other lists on
                    t = self.order[i, r]
                    scores = scores + self.q[i, t] * lists[t, docs] - self.low[i, t]
                    keep = scores + self.reach[i, r] > floor
                    if not keep.all():
                        docs, scores = docs[keep], scores[keep]
                        if not len(docs):
                            break
                ids = shard.ids[start + docs]
                other = ids != owns[i]
                top[i] = kept_best(top[i], scores[other], ids[other], k)
                if len(top[i]) == k:
                    floors[i] = max(floors[i], -top[i][-1][0])
        return [[(-s, x) for s, x in found] for found in top]


def weights(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for vectors that are null or hold null or non-finite ones."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    lists = table.column("w").combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    places = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    used = values != 0
    counts = np.bincount(np.repeat(np.arange(len(ids)), sizes)[used], minlength=len(ids))
    return ids, places[used], values[used], counts


class Block:
    """Queries, and what a task has found for each so far."""

    def __init__(self, table: pa.Table, floors: dict[int, int], k: int):
        self.ids, terms, values, sizes = arrays(table)
        ends = np.cumsum(sizes)
        self.queries = [dict(zip(terms[s:e].tolist(), values[s:e].tolist())) for s, e in zip(ends - sizes, ends)]
        self.floors, self.k = floors, k
        self.top: list[list[tuple[int, int]]] = [[] for _ in self.queries]

    def search(self, shard: Shard) -> None:
        ids = self.ids.tolist()
        for at in range(0, len(ids), TOGETHER):
            owns, queries = ids[at : at + TOGETHER], self.queries[at : at + TOGETHER]
            least = [self.floor(i) for i in range(at, at + len(owns))]
            if Together.fits(shard, queries):
                found = Together(shard, queries).best(owns, least, self.k)
            else:
                found = [shard.best(query, own, self.k, x) for query, own, x in zip(queries, owns, least)]
            for i, got in enumerate(found, at):
                if got:
                    self.top[i] = sorted([*self.top[i], *got], key=lambda x: (-x[0], x[1]))[: self.k]

    def floor(self, i: int) -> int | None:
        known = (self.floors.get(int(self.ids[i])), self.top[i][-1][0] if len(self.top[i]) == self.k else None)
        return max((x for x in known if x is not None), default=None)

    def found(self) -> pa.RecordBatch:
        rows = [(own, vec, score) for own, top in zip(self.ids.tolist(), self.top) for score, vec in top]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])


def searched(candidates: DataFrame, queries: pa.Table, floors: dict[int, int], k: int, shard_rows: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of the candidates of each task for each query of a block, none below its floor."""
    shared = candidates.sparkSession.sparkContext.broadcast((queries, floors))  # at most a block of queries

    def run(batches):
        block = Block(*shared.value, k)
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= shard_rows:
                block.search(Shard(*arrays(pa.Table.from_batches(held))))
                held, rows = [], 0
        if rows:
            block.search(Shard(*arrays(pa.Table.from_batches(held))))
        yield block.found()

    return candidates.select("id", "w").mapInArrow(run, "query_id long, vec_id long, score long")


def search(queries: DataFrame, candidates: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Frames of (id long, w array<long>) to (query_id, rank, vec_id, score): each query's k greatest inner products.

    All candidates with another id than the query's are looked at; ties go to the smaller id. Null ids or weights
    take no part. Of rows that repeat an id and a vector one counts; an id with different vectors is refused by
    neither side: each is scored. Fewer than k candidates give fewer rows. Components beyond the shorter vector count as 0.
    """
    spark = queries.sparkSession
    ship(spark)
    queries, candidates = (x.where("id is not null and w is not null").select("id", "w").distinct() for x in (queries, candidates))
    candidates = stored(candidates)
    n = candidates.count()
    shards = max(4 * spark.sparkContext.defaultParallelism, -(-n // shard_rows))
    spread = stored(candidates.repartition(shards), candidates)
    first = stored(spread.where(F.pmod(F.xxhash64("id"), F.lit(max(8, n // shard_rows))) == 0).repartition(spark.sparkContext.defaultParallelism))
    asked = stored(queries)
    blocks = max(1, -(-asked.count() // block_queries))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def parts() -> Iterator[DataFrame]:
        for b in range(blocks):
            block = asked.where(F.col("block") == b).select("id", "w").toArrow()
            if not block.num_rows:
                continue
            begun = searched(first, block, {}, k, shard_rows).withColumn("rank", rank).where(F.col("rank") == k)
            # Results are by id: of an id with several vectors the k best of all are wanted, which this floor is below, too.
            floors = {r["query_id"]: r["score"] for r in begun.collect()}
            found = searched(spread, block, floors, k, shard_rows)
            yield found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    return stored_parts(spark, schema, parts())


def top_vectors(vectors: DataFrame, k: int = K) -> DataFrame:
    """search() of the rows of (vec_id, embedding) whose vec_id is divisible by 50, among all rows."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), weights(F.col("embedding")).alias("w"))
    return search(rows.where("id % 50 = 0"), rows, k)
