"""Byte-pair encoding with a word-end marker, from a public vocabulary file, and its decoding.

Encoding a word: its symbols form a doubly linked list; a priority queue holds the rank and place
of every adjacent pair that the vocabulary merges. The least rank is merged first, the leftmost
first among equals; queue entries whose symbols have changed since are stale and skipped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docql.llm.common import held, ship

CACHED_WORDS = 320_000
DIGESTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def byte_letters() -> list[str]:
    """A printable letter for every byte: itself where printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class _Words(dict):
    """Encoded words, in two generations: the older half goes when the newer is full, save for words used since."""

    def __init__(self, owner: Codec):
        self.owner, self.old = owner, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS // 2:
            self.old = dict(self)
            self.clear()
        if (found := self.old.get(word)) is None:
            vocab = self.owner.vocab
            found = b"".join([vocab[s].to_bytes(4, "little") for s in self.owner.merge(word)])
        self[word] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary file (the JSON format of the tokenizers library).

    Supports what the word vocabulary uses: NFC, white space to one space, lower case; words by
    a pattern; bytes as letters; an end-of-word suffix; special tokens found in the raw text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings: dict[int, str] = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.letters = byte_letters()
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words_of = regex.compile(pattern).findall
        self.space = regex.compile(r"\s+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = _Words(self)

    def normal(self, text: str) -> str:
        # Lower case goes letter by letter: a final capital sigma has no form of its own.
        return self.space.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def merge(self, word: str) -> list[str]:
        symbols: list[str | None] = [self.letters[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        n, ranks = len(symbols), self.ranks
        if n == 1:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(ranks[p], i, p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in ranks]
        heapq.heapify(queue)
        while queue:
            _, i, (left, right) = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (symbols[i], symbols[k])) in ranks:
                    heapq.heappush(queue, (ranks[p], i, p))
            if (h := before[i]) >= 0 and (p := (symbols[h], symbols[i])) in ranks:
                heapq.heappush(queue, (ranks[p], h, p))
        return [s for s in symbols if s is not None]

    def encode_bytes(self, text: str) -> bytes:
        """All ids as little-endian 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.cache.__getitem__, self.words_of(self.normal(text))))
        out: list[bytes] = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out += map(self.cache.__getitem__, self.words_of(self.normal(part)))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, special tokens included, joined by spaces; unknown ids give nothing."""
        try:
            return " ".join(map(self.strings.__getitem__, ids))
        except KeyError:
            return " ".join(self.strings[i] for i in ids if i in self.strings)


def codec(path: str) -> Codec:
    return held(("bpe", path), lambda: Codec(path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text encodes as the empty one (no tokens). Repeated rows give repeated results. The
    vocabulary is read by every worker from path, which must exist on all nodes.
    """
    ship(docs.sparkSession)

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            out: list[list] = [[], [], []]
            for x in texts:
                raw = bpe.encode_bytes(x.as_py() or "")
                shown = bpe.decode(np.frombuffer(raw, "<u4").tolist())
                out[0].append(len(raw) // 4)
                out[1].append(hashlib.sha256(raw).hexdigest())
                out[2].append(hashlib.sha256(shown.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=DIGESTS.names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The input's columns with n_tokens, token_ids array<int> and decoded text; columns of these names are replaced.

    Nulls and repeats as in digests().
    """
    ship(docs.sparkSession)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    docs = docs.drop(*(f.name for f in added))
    schema = T.StructType([*docs.schema.fields, *added])
    at = docs.columns.index("text")

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            done = [bpe.encode_bytes(x.as_py() or "") for x in batch.column(at)]
            sizes = np.array([len(raw) // 4 for raw in done], np.int64)
            ids = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(done), "<i4"))
            shown = [bpe.decode(np.frombuffer(raw, "<u4").tolist()) for raw in done]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), ids.cast(pa.list_(pa.int32())), pa.array(shown, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)
