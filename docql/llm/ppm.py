"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A text is its words, A-Z in lower case, each followed by a space, and an end mark after the last. The
model codes byte after byte. A context is the ORDER bytes before (spaces before the text), across words.
The trie of contexts holds counts of the whole training corpus, nothing pruned. A byte that was not seen
in a context costs an escape (method D: half a count for each different byte seen) and goes to the
context one byte shorter, where the bytes seen in the longer one are excluded; below order 0 all
remaining bytes are alike. The result is a proper distribution over texts.

Trie nodes are rows keyed by their packed bytes, so counting, exclusion and escapes are joins and
aggregates, and all that a byte costs after its context is one number for each gram (context and byte).
Counts are pre-aggregated in each task. Frequent words (at most HOT_WORDS: a word counts as one if it
makes up a HOT_WORDS-th of all) are resolved where texts are read; of all others each task sends one
row with the list of its documents, joined with the words' counts. Grams are treated alike: all
are sent to the workers if they are SENT_GRAMS at most, else the frequent ones, and others are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docql.llm.common import id_crc, ship, stored

ORDER = 5
HOT_WORDS = 500_000
#: The most gram costs that are sent to the workers (16 bytes each).
SENT_GRAMS = 4_000_000
#: Different words a task holds before it sends them on.
HELD_WORDS = 250_000
#: Different grams a task holds, and bytes of text it looks at in one go.
HELD_GRAMS, PART_BYTES = 2_000_000, 2_000_000
#: Bytes without white space, the space that ends a word, the end mark.
SYMBOLS = 256 - 6 + 2
END = 0x0A
PAD = b" " * ORDER


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stream(words: list[bytes]) -> bytes:
    return b" ".join([*words, b"\n"])


def grams(streams: list[bytes]) -> np.ndarray:
    """The grams (ORDER bytes of context and a byte, packed) of all streams, one after the other; a stream has as many as bytes."""
    raw = np.frombuffer(PAD + PAD.join(streams), np.uint8).astype(np.int64)
    packed = raw.copy()
    for k in range(1, ORDER + 1):
        packed[k:] |= raw[:-k] << (8 * k)
    inside = np.ones(len(raw), bool)
    inside[:ORDER] = False
    ends = np.flatnonzero(raw == END)[:-1]
    for k in range(1, ORDER + 1):
        inside[ends + k] = False
    return packed[inside]


def count_words(docs: DataFrame) -> DataFrame:
    """docs (text, train) to (word, c_all, c_train), a row for each different word."""

    def run(batches):
        total, other = Counter(), Counter()  # other: of texts not learned from, the fewer

        def flush():
            n, less = np.fromiter(total.values(), np.int64, len(total)), np.fromiter(map(other.get, total, repeat(0)), np.int64, len(total))
            out = pa.RecordBatch.from_arrays([pa.array(total, pa.binary(), size=len(total)), pa.array(n), pa.array(n - less)], names=["word", "c_all", "c_train"])
            total.clear()
            other.clear()
            return out

        for batch in batches:
            for text, used in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = words_of(text.as_py())
                total.update(words)
                if not used:
                    other.update(words)
                if len(total) > HELD_WORDS:
                    yield flush()
        if total:
            yield flush()

    parts = docs.select("text", "train").mapInArrow(run, "word binary, c_all long, c_train long")
    return stored(parts.groupBy("word").agg(F.sum("c_all").alias("c_all"), F.sum("c_train").alias("c_train")))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """docs (text, train) to (g, n): all grams with their counts in training texts, which may be 0."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        texts: dict[bool, list[bytes]] = {True: [], False: []}
        size = 0

        def count():
            for used, streams in texts.items():
                if streams:
                    keys, n = np.unique(grams(streams), return_counts=True)
                    held.append((keys, n if used else np.zeros_like(n)))
                streams.clear()
            if sum(len(x[0]) for x in held) > HELD_GRAMS:
                held[:] = [merged(held)]

        def rows():
            keys, n = merged(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["g", "n"])

        for batch in batches:
            for text, used in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                texts[used].append(s := stream(words_of(text.as_py())))
                size += len(s)
                if size > PART_BYTES:
                    count()
                    size = 0
                    if held and len(held[0][0]) > HELD_GRAMS:
                        yield rows()
        count()
        if held:
            yield rows()

    return stored(docs.select("text", "train").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")))


def gram_costs(counted: DataFrame) -> DataFrame:
    """(g, cost): log10 of the probability of each gram's last byte after its context."""
    orders = F.explode(F.array(*map(F.lit, range(ORDER + 1)))).alias("j")
    key = F.expr("g & (shiftleft(1L, 8 * (j + 1)) - 1)")
    nodes = stored(counted.where("n > 0").select("g", "n", orders).select("j", key.alias("key"), "n").groupBy("j", "key").agg(F.sum("n").alias("n")))
    below = nodes.select((F.col("j") + 1).alias("j"), F.col("key").alias("low"), F.col("n").alias("n_low"))
    up = nodes.withColumn("low", F.expr("key & (shiftleft(1L, 8 * j) - 1)")).join(below, ["j", "low"], "left")
    contexts = stored(up.groupBy("j", F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("t"), F.count("*").alias("d"), F.sum("n_low").alias("x")))
    asked = counted.select("g", orders).select("g", "j", key.alias("key")).withColumn("ctx", F.shiftright("key", 8))
    asked = asked.join(nodes, ["j", "key"], "left").join(contexts, ["j", "ctx"], "left")
    at = lambda name, j: F.max(F.when(F.col("j") == j, F.col(name))).alias(f"{name}{j}")
    wide = asked.groupBy("g").agg(*(at(name, j) for name in "ntdx" for j in range(ORDER + 1)))

    def or_zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("double")

    cost = -F.log10(F.lit(float(SYMBOLS)) - or_zero("d0"))
    for j in range(ORDER + 1):
        # What the longer context saw is excluded here; where that context is new, nothing is.
        t, d = (or_zero(f"t{j}") - or_zero(f"x{j + 1}"), or_zero(f"d{j}") - or_zero(f"d{j + 1}")) if j < ORDER else (or_zero(f"t{j}"), or_zero(f"d{j}"))
        escape = F.when(d > 0, F.log10(d / (2 * t))).otherwise(0.0)
        cost = F.when(F.col(f"n{j}").isNotNull(), F.log10((2 * F.col(f"n{j}") - 1) / (2 * t))).otherwise(escape + cost)
    return stored(wide.select("g", cost.alias("cost")))


OWN = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
SENT = "word binary, keys array<long>, own array<struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,score:double>>"


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def lists(terms: list[bytes], of: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Rows of SENT for terms: the keys that go with each one's number in of."""
    ends = np.cumsum(np.bincount(of, minlength=len(terms)))
    found = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), keys[np.argsort(of, kind="stable")])
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), found, pa.nulls(len(terms), pa.list_(OWN))], names=["word", "keys", "own"])


def inverted(docs: DataFrame, hot: tuple[list[bytes], np.ndarray, np.ndarray], costs: tuple[np.ndarray, np.ndarray], end: tuple[float, int]) -> DataFrame:
    """docs (key, doc_id, held_out, text) to rows of SENT: what frequent words and grams make of each document, and of each other term the documents, as often as it occurs."""
    context = docs.sparkSession.sparkContext
    sent_words, sent_grams = context.broadcast(hot), context.broadcast(costs)

    def run(batches):
        names, base_of, known_of = sent_words.value
        base_of, known_of = np.append(base_of, 0.0), np.append(known_of, 0)
        n_hot = len(names)
        first = {w: i for i, w in enumerate(names)}
        numbers = Numbers(first)
        find, cost = pd.Index(sent_grams.value[0]).get_indexer, sent_grams.value[1]
        part: list[tuple[int, int, bool, list[bytes]]] = []
        rare: list[tuple[np.ndarray, np.ndarray]] = []  # words' numbers and keys
        new: list[tuple[np.ndarray, np.ndarray]] = []  # grams and keys
        own: list[pa.StructArray] = []
        own_keys: list[np.ndarray] = []

        def looked_at():
            if not part:
                return
            ids, held = pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.bool_())
            keys = np.array([x[0] for x in part], np.int64)
            sizes = np.array([len(x[3]) for x in part], np.int64)
            owner = np.repeat(np.arange(len(part)), sizes)
            number = np.fromiter(map(numbers.__getitem__, chain.from_iterable(x[3] for x in part)), np.int64, len(owner))
            frequent = np.minimum(number, n_hot)
            base = np.bincount(owner, base_of[frequent], len(part)) + end[0]
            known = np.bincount(owner, known_of[frequent], len(part)).astype(np.int64) + end[1]
            left = number >= n_hot
            rare.append((number[left] - n_hot, keys[owner[left]]))
            streams = [stream(x[3]) for x in part]
            got = grams(streams)
            at = find(got)
            starts = np.cumsum([0, *map(len, streams[:-1])])
            if (unknown := at < 0).any():
                new.append((got[unknown], keys[np.searchsorted(starts, np.flatnonzero(unknown), side="right") - 1]))
                each = np.where(unknown, 0.0, cost[at])
            else:
                each = cost[at]
            own.append(pa.StructArray.from_arrays([ids, held, pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(np.add.reduceat(each, starts))], fields=list(OWN)))
            own_keys.append(keys)
            part.clear()

        def flush():
            looked_at()
            if not own:
                return
            yield lists([*islice(numbers, n_hot, None)], *map(np.concatenate, zip(*rare)))
            if new:
                names, of = np.unique(np.concatenate([x[0] for x in new]), return_inverse=True)
                yield lists([term_of(g) for g in names], of, np.concatenate([x[1] for x in new]))
            keys = np.concatenate(own_keys)
            one = lambda values: pa.ListArray.from_arrays(np.array([0, len(keys)], np.int32), values)
            # No word and no gram is called so; its hash spreads these rows.
            yield pa.RecordBatch.from_arrays([pa.array([b"  %d" % keys[0]], pa.binary()), one(pa.array(keys)), one(pa.concat_arrays(own))], names=["word", "keys", "own"])
            for x in (rare, new, own, own_keys, numbers):
                x.clear()
            numbers.update(first)

        size = 0
        for batch in batches:
            for key, doc_id, held, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                words = words_of(text.as_py())
                part.append((key, doc_id, held, words))
                size += sum(map(len, words)) + len(words)
                if size > PART_BYTES:
                    looked_at()
                    size = 0
                    if len(numbers) > n_hot + HELD_WORDS:
                        yield from flush()
        yield from flush()

    return docs.select("key", "doc_id", "held_out", "text").mapInArrow(run, SENT)


def term_of(gram) -> bytes:
    """A gram's name among words: it begins with a space, as no word does."""
    return b" " + int(gram).to_bytes(8, "big")


def score(docs: DataFrame, train: Column, sent: int = SENT_GRAMS, hot_words: int = HOT_WORDS) -> DataFrame:
    """Per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    train tells the rows learned from; held_out is its opposite. A null text is the empty one, whose only
    token is the end. Repeated rows count as often as they occur and give as many rows. If nothing
    is learned from, every byte costs the same and base_score is 0.1 / (0.1 * 1) for each token.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(train, F.lit(True)).alias("train")).withColumn("held_out", ~F.col("train"))
    words = count_words(docs)
    ends = docs.where("train").count()
    got = words.agg(F.coalesce(F.sum("c_all"), F.lit(0)), F.coalesce(F.sum("c_train"), F.lit(0)), F.count(F.when(F.col("c_train") > 0, 1))).first()
    every, tokens, different = got[0], got[1] + ends, got[2] + (ends > 0)
    below = tokens + 0.1 * (different + 1)
    base_of = F.log10((F.coalesce("c_train", F.lit(0)) + F.lit(0.1)) / F.lit(below))
    # At most hot_words words can have so large a share, and at most sent grams.
    hot = words.where(F.col("c_all") * hot_words >= every).select("word", base_of.alias("base"), "c_train").toArrow()
    hot = hot.column("word").to_pylist(), hot.column("base").to_numpy(), (hot.column("c_train").to_numpy() > 0).astype(np.int64)
    end = (float(np.log10((ends + 0.1) / below)), int(ends > 0))
    counted = count_grams(docs)
    costs = gram_costs(counted)
    terms = words.select(F.col("word").alias("term"), "c_train", F.lit(None).cast("double").alias("cost"))
    known = costs
    if costs.count() > sent:
        total = counted.agg(F.sum("n")).first()[0]
        frequent = counted.where(F.col("n") * sent >= total).where("n > 0").select("g")
        known = costs.join(frequent, "g", "left_semi")
        name = F.concat(F.lit(b" "), F.unhex(F.lpad(F.hex("g"), 16, "0")))
        terms = terms.union(costs.join(frequent, "g", "left_anti").select(name, F.lit(None), "cost"))
    table = known.toArrow()
    rows = inverted(docs, hot, (table.column("g").to_numpy(), table.column("cost").to_numpy()), end)
    rows = rows.join(terms, rows["word"] == terms["term"], "left")
    rows = rows.select("term", "c_train", "cost", "own", F.posexplode("keys").alias("i", "key")).withColumn("own", F.get("own", F.col("i")))
    own = F.col("own")
    word = own.isNull() & F.col("cost").isNull()
    parts = rows.select(
        "key",
        own["doc_id"].alias("doc_id"),
        own["held_out"].alias("held_out"),
        F.when(own.isNotNull(), 1).otherwise(0).alias("m"),
        F.coalesce(own["n_tokens"], F.lit(0)).alias("n_tokens"),
        F.coalesce(own["n_known"], F.when(F.col("c_train") > 0, 1).otherwise(0)).alias("n_known"),
        F.coalesce(own["base"], F.when(word, base_of).otherwise(0.0)).alias("base"),
        F.coalesce(own["score"], F.col("cost"), F.lit(0.0)).alias("score"),
    )
    summed = parts.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("m").alias("m"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")))
    m = F.col("m")
    return summed.select(
        "doc_id",
        "held_out",
        (F.col("n_tokens") / m).cast("bigint").alias("n_tokens"),
        (F.col("n_known") / m).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") / m).alias("base_score"),
        (F.col("score") / m).alias("score"),
        F.explode(F.sequence(F.lit(1), m)).alias("_copy"),
    ).drop("_copy")


def score_documents(docs: DataFrame) -> DataFrame:
    """score(), learning from the documents whose crc32 of the id leaves a remainder other than 0 by 10."""
    return score(docs, id_crc() % 10 != 0)


def code_lengths(text: bytes, counts: dict[bytes, Counter]) -> Iterator[float]:
    """For tests and small texts: log10 probability of every byte of a padded text, straight from the definition."""
    for i in range(ORDER, len(text)):
        excluded: set[int] = set()
        total = 0.0
        for j in range(ORDER, -1, -1):
            seen = counts.get(text[i - j : i])
            if seen is None or not (left := {s: n for s, n in seen.items() if s not in excluded}):
                continue
            size = 2 * sum(left.values())
            if text[i] in left:
                total += np.log10((2 * left[text[i]] - 1) / size)
                break
            total += np.log10(len(left) / size)
            excluded |= set(left)
        else:
            total -= np.log10(SYMBOLS - len(excluded))
        yield float(total)
