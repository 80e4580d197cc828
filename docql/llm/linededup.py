"""Line deduplication by pairwise alignment.

The two documents of a pair are aligned with patience diff (lines unique in both are anchors, their
longest common order holds, between anchors the same again), and aligned common blocks of enough words
are deleted from the later document.

Which documents are paired: partners="every" deletes what alignment with every earlier document would
delete, without aligning all pairs. A block that is deleted is a run of lines that both documents hold, and
it is made up of its shortest runs of enough words (windows, from a line on or up to a line). So
* documents without a common window are no pair;
* the first holder of each window is paired with every later one, n - 1 pairs for n holders;
* only where a line of a repeated window is still kept after that (its window lies across another one, or its
  lines recur in a document) the other earlier holders of that window follow. Holders that differ only in
  lines which can't be aligned there (no other holder has them) are one kind, and kinds are aligned
  instead of documents.
partners="first" pairs the first holder of each line with every later one, and nothing more: lines stay
where the first holder has them in another order, or where the lines of a block have different first holders.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docql.llm.common import ship, stored

#: Blocks of fewer words stay: short lines recur by chance.
MIN_WORDS = 5


def anchors(a: list[int], b: list[int], al: int, ah: int, bl: int, bh: int) -> list[tuple[int, int]]:
    """Lines unique in both ranges, in their longest common order."""
    in_a, in_b = Counter(a[al:ah]), Counter(b[bl:bh])
    place = {a[i]: i for i in range(al, ah) if in_a[a[i]] == 1 and in_b.get(a[i]) == 1}
    tails: list[int] = []  # least last place in a of an increasing run of each length
    ends: list[int] = []  # its index in met
    back: list[int] = []
    met: list[tuple[int, int]] = []
    for j in range(bl, bh):
        i = place.get(b[j])
        if i is None:
            continue
        k = bisect_left(tails, i)
        back.append(ends[k - 1] if k else -1)
        met.append((i, j))
        if k == len(tails):
            tails.append(i)
            ends.append(len(met) - 1)
        else:
            tails[k], ends[k] = i, len(met) - 1
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(met[at])
        at = back[at]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of aligned equal lines, both increasing."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            pairs.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            pairs.append((ah, bh))
        if al == ah or bl == bh:
            continue
        if held := anchors(a, b, al, ah, bl, bh):
            for i, j in held:
                todo.append((al, i, bl, j))
                pairs.append((i, j))
                al, bl = i + 1, j + 1
            todo.append((al, ah, bl, bh))
    return sorted(pairs)


def repeated(first: list[int], later: list[int], words: list[int], least: int = MIN_WORDS) -> list[int]:
    """The lines of later that lie in aligned common blocks of at least so many words."""
    out: list[int] = []
    block: list[int] = []
    before = None
    for i, j in [*patience(first, later), (-9, -9)]:
        if before != (i - 1, j - 1):
            if sum(words[k] for k in block) >= least:
                out += block
            block = []
        block.append(j)
        before = (i, j)
    return out


def windows(words: list[int], least: int = MIN_WORDS) -> set[tuple[int, int]]:
    """(start, end) of the shortest runs of at least so many words from each line on and up to each line."""

    def runs(words: list[int]) -> list[tuple[int, int]]:
        out, end, total = [], 0, 0
        for start in range(len(words)):
            while end < len(words) and (total < least or end == start):
                total += words[end]
                end += 1
            if total < least:
                break
            out.append((start, end))
            total -= words[start]
        return out

    n = len(words)
    return {*runs(words), *((n - end, n - start) for start, end in runs(words[::-1]))}


#: Of the windows' hash: a polynomial of the lines' hashes.
PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51


def hashed(lines: list[int], spans: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(hash, start, end) of each span, at the same cost for long and short ones."""
    sums, powers = [0], [1]
    for h in lines:
        sums.append((sums[-1] * BASE + h % PRIME + 1) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
    return [((sums[end] - sums[start] * powers[end - start]) % PRIME, start, end) for start, end in spans]


def row_id() -> Column:
    return F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def aligned(pairs: DataFrame, lines: DataFrame, least_words: int) -> DataFrame:
    """(rid, at): the lines to delete of the later documents of pairs (rid, first)."""
    later = lines.select("rid", F.col("lines.h").alias("b"), F.col("lines.w").alias("w"))
    earlier = lines.select(F.col("rid").alias("first"), F.col("lines.h").alias("a"))
    both = stored(pairs.join(later, "rid")).join(earlier, "first").select("rid.doc_id", "rid.th", "a", "b", "w")

    def run(batches):
        for batch in batches:
            found = [repeated(a.as_py(), b.as_py(), w.as_py(), least_words) for a, b, w in zip(*batch.columns[2:], strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "th", "gone"])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    schema = f"{id_fields(lines)}, gone array<int>"
    return both.mapInArrow(run, schema).select(F.struct("doc_id", "th").alias("rid"), F.explode("gone").alias("at")).distinct()


def id_fields(lines: DataFrame) -> str:
    return f"doc_id {lines.schema['rid'].dataType['doc_id'].dataType.simpleString()}, th long"


def first_pairs(lines: DataFrame) -> DataFrame:
    """(rid, first): later documents and the first holder of each of their lines."""
    each = lines.select("rid", F.explode(F.array_distinct(F.filter("lines", lambda x: x["w"] > 0)["h"])).alias("h"))
    each = stored(each)
    shared = stored(each.groupBy("h").agg(F.min("rid").alias("first"), F.max("rid").alias("last")).where("first < last").select("h", "first"))
    return stored(each.join(shared, "h").where("rid > first").select("rid", "first").distinct())


def every_window(lines: DataFrame, least_words: int) -> DataFrame:
    """(rid, h, at, end): the windows of each document."""

    def run(batches):
        for batch in batches:
            found = [hashed(h.as_py(), windows(w.as_py(), least_words)) for h, w in zip(*batch.columns[2:], strict=True)]
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            columns = [pa.array([x[k] for f in found for x in f], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), *columns], names=["doc_id", "th", "h", "at", "end"])

    schema = f"{id_fields(lines)}, h long, at int, end int"
    return lines.select("rid.doc_id", "rid.th", "lines.h", "lines.w").mapInArrow(run, schema).select(F.struct("doc_id", "th").alias("rid"), "h", "at", "end")


def uncovered(again: DataFrame, gone: DataFrame) -> DataFrame:
    """(rid, h): the windows of again with a line that is not in gone."""
    spans = again.groupBy("rid").agg(F.collect_list(F.struct("h", "at", "end")).alias("s"))
    both = spans.join(gone.groupBy("rid").agg(F.collect_list("at").alias("gone")), "rid", "left")

    def run(batches):
        for batch in batches:
            keys, found = [], []
            for k, row in enumerate(zip(*batch.columns[2:], strict=True)):
                h, at, end, gone = (x.as_py() for x in row)
                lost = np.zeros(max(end) + 1, np.int64)
                lost[[x for x in gone or [] if x < len(lost)]] = 1
                sums = np.concatenate([[0], np.cumsum(lost)])
                at, end = np.array(at), np.array(end)
                kept = {h[x] for x in np.flatnonzero(sums[end] - sums[at] < end - at)}
                keys += [k] * len(kept)
                found += kept
            keys = pa.array(keys, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keys), batch.column(1).take(keys), pa.array(found, pa.int64())], names=["doc_id", "th", "h"])

    schema = f"{id_fields(again)}, h long"
    return both.select("rid.doc_id", "rid.th", "s.h", "s.at", "s.end", "gone").mapInArrow(run, schema).select(F.struct("doc_id", "th").alias("rid"), "h")


def rest(lines: DataFrame, holders: DataFrame, left: DataFrame, least_words: int) -> DataFrame:
    """(rid, at): what the documents of left (rid, h) lose by alignment with every earlier holder (rid, h) of that h.

    By h, holders are cut down to the lines that a document of left and another holder have; what is equal then is
    one kind, named by its first document. Kinds are aligned, and each place of a later kind gets the first document
    on account of which it goes.
    """
    each = stored(holders.join(lines, "rid").select("h", "rid", F.posexplode("lines").alias("at", "x")).select("h", "rid", "at", F.col("x.h").alias("x"), F.col("x.w").alias("w")))
    own = each.join(left, ["h", "rid"], "left_semi").select("h", "x").distinct()
    met = each.select("h", "x", "rid").distinct().groupBy("h", "x").count().where("count > 1").select("h", "x").join(own, ["h", "x"], "left_semi").withColumn("met", F.lit(True))
    lone = F.named_struct(F.lit("x"), F.lit(0).cast("bigint"), F.lit("w"), F.lit(0), F.lit("met"), F.lit(False))
    rows = each.join(stored(met), ["h", "x"], "left").select("h", "rid", F.struct("at", F.when(F.col("met"), F.struct("x", "w", "met")).otherwise(lone).alias("x")).alias("l"))
    rows = rows.groupBy("h", "rid").agg(F.array_sort(F.collect_list("l")).alias("l"))
    rows = rows.withColumn("l", F.filter("l", lambda y, i: y["x"]["met"] | (i == 0) | F.get("l", F.when(i > 0, i - 1))["x"]["met"]))
    rows = stored(rows.select("h", "rid", F.col("l.x").alias("form"), F.col("l.at").alias("places")))
    kinds = stored(rows.groupBy("h", "form").agg(F.min("rid").alias("first")))
    later = stored(rows.join(left, ["h", "rid"], "left_semi").join(kinds, ["h", "form"]).select("h", "rid", F.col("first").alias("kind"), "form", "places"))
    ours = stored(later.groupBy("h", "kind", "form").agg(F.max("rid").alias("latest")))
    both = ours.join(kinds.select("h", "first", F.col("form").alias("a")), "h").where("first < latest")
    both = both.select("h", "kind", "first", "a.x", "a.met", F.col("form.x").alias("x2"), F.col("form.met").alias("met2"), "form.w").hint("rebalance")

    def run(batches):
        for batch in batches:
            found = []
            for row in zip(*batch.columns[3:], strict=True):
                x, met, x2, met2, w = (c.as_py() for c in row)
                a, b = [y if m else "a" for y, m in zip(x, met)], [y if m else "b" for y, m in zip(x2, met2)]
                found.append(repeated(a, b, w, least_words))
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=["h", "kind", "first", "gone"])
            yield out.filter(pa.array([bool(x) for x in found], pa.bool_()))

    rid = lines.schema["rid"].dataType.simpleString()
    found = both.mapInArrow(run, f"h long, kind {rid}, first {rid}, gone array<int>").select("h", "kind", "first", F.explode("gone").alias("k"))
    found = stored(found.groupBy("h", "kind", "k").agg(F.min("first").alias("first")))
    places = later.select("h", "kind", "rid", F.posexplode("places").alias("k", "at"))
    return places.join(found, ["h", "kind", "k"]).where("first < rid").select("rid", "at").distinct()


def every_gone(lines: DataFrame, least_words: int) -> DataFrame:
    """(rid, at): what alignment with every earlier document deletes."""
    held = stored(every_window(lines, least_words))
    shared = stored(held.groupBy("h").agg(F.min("rid").alias("first"), F.max("rid").alias("last")).where("first < last").select("h", "first"))
    again = stored(held.join(shared, "h").where("rid > first"))
    pairs = stored(again.select("rid", "first").distinct())
    gone = stored(aligned(pairs, lines, least_words))
    left = stored(uncovered(again, gone))
    if left.isEmpty():
        return gone
    holders = stored(held.join(left.select("h").distinct(), "h").select("rid", "h").distinct())
    return gone.union(rest(lines, holders, left, least_words)).distinct()


def deletions(docs: DataFrame, least_words: int = MIN_WORDS, partners: str = "first") -> DataFrame:
    """(rid, gone): the numbers of the lines to delete, for each document that loses some."""
    if partners not in ("first", "every"):
        raise ValueError(f"partners: first or every, not {partners!r}")
    ship(docs.sparkSession)
    line = lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h"), F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(F.trim(x), "\\s+"))).alias("w"))
    lines = docs.where("doc_id is not null and text is not null").select(row_id().alias("rid"), F.transform(F.split("text", "\n"), line).alias("lines"))
    lines = stored(lines.groupBy("rid").agg(F.first("lines").alias("lines")))
    found = every_gone(lines, least_words) if partners == "every" else aligned(first_pairs(lines), lines, least_words)
    return stored(found.groupBy("rid").agg(F.sort_array(F.collect_list("at")).alias("gone")))


def dedup_lines(docs: DataFrame, least_words: int = MIN_WORDS, partners: str = "first") -> DataFrame:
    """The rows of docs, text without the lines repeated from earlier documents; n_lines and n_removed are added.

    partners: "every" for all earlier documents (op6 and the pipeline), "first" for the first holder of each line.

    Earlier means a smaller doc_id (under one doc_id, a smaller hash of the text). A document that
    loses all lines keeps its row, with an empty text. Rows that repeat a document exactly are one document:
    nothing is deleted on account of each other. Rows with null doc_id or text stay as they are, and nothing is
    deleted on account of them. Blank lines go only within a deleted block. Texts are compared as stored, before
    any deletion. Columns n_lines and n_removed of the input are replaced.
    """
    gone = deletions(docs, least_words, partners).toDF("_rid_gone", "_gone")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    out = docs.drop("n_lines", "n_removed").withColumn("_rid", row_id()).join(gone, F.col("_rid") == F.col("_rid_gone"), "left")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("text")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*(text if c == "text" else F.col(c) for c in names), n, F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"))
