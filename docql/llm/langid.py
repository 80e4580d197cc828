"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built of labelled text. A text to be classified is parsed
against each: phrases are the longest matches, one after the other, and the language that needs the
fewest phrases, each weighed by the bits that point into its labelled text, wins. Symbols are the bytes of
letters in UTF-8, so that no script has more than some 70 of them and no letter is merged with another. The
automaton's transitions are laid out as a table whose missing entries lead on as a new phrase would, marked by
the number of phrases ended, so that many blocks of text step through it at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docql.llm.common import held, id_crc, ship

#: Bounds of the sample that is fitted: documents of each language, and bytes of letters, of one document too.
SAMPLE_DOCS, SAMPLE_BYTES = 200, 30_000
#: Bytes that all tables of a worker may take (about TABLE_COST for a byte of sample): with many languages, samples are
#: smaller, 30,000 bytes each for up to 29 languages, 4,400 for 200.
TABLE_BYTES, TABLE_COST = 300_000_000, 340
#: The most languages that are learned, the commonest.
MAX_LANGS = 500
#: No phrase crosses the end of a block of so many bytes.
BLOCK = 512
UNKNOWN = "und"
COLUMNS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def letters(text: str) -> bytes:
    """Lower case, every run of other than letters as one space, in UTF-8."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return spaced(codes).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")


_IS_LETTER: np.ndarray | None = None


def is_letter() -> np.ndarray:
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _IS_LETTER


def spaced(codes: np.ndarray) -> np.ndarray:
    inside = is_letter()[codes]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the first of a run of others stands for it
    return np.where(inside, codes, np.uint32(32))[keep]


def automaton(codes: np.ndarray, classes: int) -> tuple[np.ndarray, int]:
    """Transitions (state * classes + class -> state, -1 where none) of the suffix automaton."""
    nexts: list[list[int]] = [[-1] * classes]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(nexts)
        nexts.append([-1] * classes)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and nexts[p][c] < 0:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(nexts[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p][c] == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return np.array(nexts, np.int32).ravel(), len(nexts)


@dataclass
class Automaton:
    """One language: the classes of the bytes that its sample has, the table of steps, and a phrase's bits."""

    classes: np.ndarray  # of each byte: 0 for those that the sample lacks; the last is beyond the text
    table: np.ndarray
    bits: float

    @classmethod
    def of(cls, sample: bytes) -> Automaton:
        used = sorted(set(sample))
        classes = np.zeros(257, np.uint8)
        classes[used] = np.arange(1, len(used) + 1)
        w = len(used) + 2
        pad = classes[END] = w - 1
        flat, states = automaton(classes[np.frombuffer(sample, np.uint8)], w)
        table = flat.reshape(states, w)
        missing, known = table < 0, table[0] >= 0
        start = np.where(known, table[0], 0)
        ended = (np.arange(states) > 0)[:, None].astype(np.int32) + ~known[None, :]
        step = np.where(missing, ((start * w) << 2) + ended, (table * w) << 2)
        step[:, pad] = (np.arange(states) * w) << 2
        return cls(classes, step.astype(np.int32).ravel(), math.log2(max(2, len(sample))))


#: Stands after a block's last byte.
END = 256


@dataclass
class Model:
    """Languages and their sampled letters; tables are built on first use."""

    samples: dict[str, bytes]
    automata: list[Automaton] = field(default_factory=list)

    def __post_init__(self):
        self.langs = sorted(self.samples)

    def built(self) -> Model:
        self.automata = [Automaton.of(self.samples[lang]) for lang in self.langs]
        return self

    def costs(self, texts: list[str]) -> np.ndarray:
        """Bits for each text (row) and language (column); rows of texts without letters are NaN."""
        if not self.automata:
            self.built()
        parts = [np.frombuffer(letters(t), np.uint8) for t in texts]
        spans = [-(-len(p) // BLOCK) for p in parts]
        out = np.full((len(texts), len(self.langs)), np.nan)
        owners = np.repeat(np.arange(len(texts)), spans)
        grid = np.full((len(owners), BLOCK), END, np.uint16)
        flat, at = grid.ravel(), 0
        for p, n in zip(parts, spans, strict=True):
            flat[at : at + len(p)] = p
            at += n * BLOCK
        lettered = np.array([(p != 32).any() for p in parts], bool)
        used = (grid != END).sum(axis=1)
        order = np.argsort(-used, kind="stable")  # full blocks first, so that ended ones are no longer stepped
        grid, used, owners = np.ascontiguousarray(grid[order].T), used[order], owners[order]
        alive = np.searchsorted(-used, -np.arange(1, BLOCK + 1), side="right")
        for k, lang in enumerate(self.automata):
            table, own = lang.table, np.take(lang.classes, grid)
            state, phrases = np.zeros(len(owners), np.int32), np.zeros(len(owners), np.int32)
            for t in range(BLOCK):
                n = alive[t]
                if not n:
                    break
                now = state[:n]
                np.right_shift(now, 2, out=now)
                now += own[t, :n]
                np.take(table, now, out=now, mode="clip")
                phrases[:n] += now & 3
            phrases += (state >> 2) > 0
            out[:, k] = np.bincount(owners, phrases, minlength=len(texts)) * lang.bits
        out[~lettered] = np.nan
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score: how much fewer bits than the runner-up, as a share of the runner-up's."""
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        found = []
        for row in self.costs([t or "" for t in texts]):
            if np.isnan(row[0]):
                found.append((UNKNOWN, 0.0))
            elif len(row) == 1:
                found.append((self.langs[0], 1.0))
            else:
                best = int(np.argmin(row))
                second = float(np.min(np.delete(row, best)))
                found.append((self.langs[best], float(1 - row[best] / second) if second else 0.0))
        return found


def sample_bytes(langs: int) -> int:
    return min(SAMPLE_BYTES, TABLE_BYTES // (TABLE_COST * max(1, langs)))


def fit(labelled: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows (doc_id, text, lang).

    Of each of the MAX_LANGS commonest languages (ties by name): documents in the order of a hash of id and text, at most
    SAMPLE_DOCS of them, each cut to as many characters as the sample has bytes, until sample_bytes() characters are
    reached. Which documents they are depends on ids and texts alone; repeated rows count once. The driver
    gets two samples' worth of text for a language at most. Rows whose lang or text is null, or whose text has no letter, are
    no labels.
    """
    spark = labelled.sparkSession
    ship(spark)
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    distinct = F.approx_count_distinct(F.xxhash64("doc_id", "text"))
    counts = labelled.groupBy("lang").agg(distinct.alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return Model({})
    size = sample_bytes(len(counts))
    # The hash is uniform, so a threshold for each language leaves about twice the rows wanted.
    least = [(r["lang"], int(-(2**63) + min(1.0, 2 * SAMPLE_DOCS / r["n"]) * (2**64 - 1)) if r["n"] > 2 * SAMPLE_DOCS else 2**63 - 1) for r in counts]
    wanted = F.broadcast(spark.createDataFrame(least, "lang string, most long"))
    rows = labelled.select("lang", F.substring("text", 1, size).alias("text"), F.xxhash64(F.lit("langid"), "doc_id", "text").alias("h"))
    rows = rows.join(wanted, "lang").where("h <= most").dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("h")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_k", F.row_number().over(order)).withColumn("_before", before).where((F.col("_k") <= SAMPLE_DOCS) & (F.col("_before") < size))
    samples: dict[str, list[bytes]] = {}
    for row in sorted(rows.select("lang", "h", "text").collect(), key=lambda r: (r["lang"], r["h"])):
        if text := letters(row["text"]).strip():
            samples.setdefault(row["lang"], []).append(text)
    return Model({k: b" ".join(v)[:size] for k, v in samples.items()})


def groups(texts: pa.Array, limit: int = 2_000_000) -> Iterator[list[str | None]]:
    part: list[str | None] = []
    total = 0
    for x in texts:
        part.append(x.as_py())
        total += len(part[-1] or "")
        if total >= limit:
            yield part
            part, total = [], 0
    yield part


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The input's columns, then lang_pred and score; columns of these names are replaced.

    A null or empty text, or one without letters, is "und" with score 0, and so is every text if the
    model knows no language. Ties go to the language whose name sorts first. Rows are neither merged
    nor dropped. Only text is looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*COLUMNS.names)
    shared = spark.sparkContext.broadcast(model.samples)  # bounded: a few letters times the number of languages
    schema = T.StructType([*docs.schema.fields, *COLUMNS.fields])

    def run(batches):
        ready = held(("langid", tuple(sorted(shared.value.items()))), lambda: Model(shared.value).built())
        for batch in batches:
            got = [x for part in groups(batch.column(batch.schema.get_field_index("text"))) for x in ready.predict(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return id_crc(doc_id) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents that aren't held out, predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return predict(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model).drop("text")
