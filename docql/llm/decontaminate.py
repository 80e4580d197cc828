"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds a posting (term, doc_id, pos) for every corpus token whose term some test phrase
has, and one for each document's end. It is written once, straight from the scan, with no shuffle. The
postings give the terms' frequencies. Of every window of a test phrase the rarest term is looked up
first: an occurrence at pos of the term at offset o fixes where the phrase would begin (pos - o). A
posting also has 16 bits of hash of the two words on either side, one of which pairs a window of four
or more words around it must hold; so most chance places go before any join. At the other
offset-adjusted places the lists of all terms are intersected, by a join on document, place and
term; unbroken runs that are as long as a window are exact matches.

Only postings of documents with such a place are shuffled, and of few others. They are recognised by bits at
hashes of their ids, 16 bits or more for each document until MOST_BITS are reached (8 MB, for 4 million documents).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docql.llm.common import stored

WINDOW = 8
#: Sides of a join with at most so many rows are broadcast; larger ones are shuffled.
SMALL_ROWS = 200_000
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Stands after a document's last word; no word holds it.
END = "\x00"
OTHERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case; no words for null."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(low, OTHERS), ""), F.array().cast("array<string>"))


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows, now counted, are few."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def marks(words: Column, at: Column) -> list[Column]:
    """16 bits of hash of the two words after, and of the two before, a place in words."""
    pair = lambda i, j: F.pmod(F.xxhash64(F.get(words, at + i), F.get(words, at + j)), F.lit(1 << 16)).cast("int")
    return [pair(1, 2).alias("after"), pair(-2, -1).alias("before")]


def phrase_words(items: DataFrame, window: int) -> DataFrame:
    """(ik, item_id, size, n, ipos, term, after, before): a row for every word of every item of n words; size is the window's length.

    ik tells items apart that share an id but not a text. Items without id or words are left out.
    """
    named = items.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    named = stored(named.withColumn("ik", F.xxhash64(F.col("item_id").cast("string"), F.concat_ws(" ", "w"))))
    return stored(named.select("ik", "item_id", F.least(F.lit(window), F.size("w")).alias("size"), F.size("w").alias("n"), "w", F.posexplode("w").alias("ipos", "term")).select("ik", "item_id", "size", "n", "ipos", "term", *marks(F.col("w"), F.col("ipos"))))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index (doc_id, pos, term, after, before) of the given terms (column term), and END at each document's length."""
    terms = terms.select("term").distinct().union(docs.sparkSession.range(1).select(F.lit(END)))
    listed = docs.select("doc_id", F.concat(words(F.col("text")), F.array(F.lit(END))).alias("w")).select("doc_id", "w", F.posexplode("w").alias("pos", "term"))
    return stored(listed.join(small(stored(terms)), "term", "left_semi").select("doc_id", "pos", "term", *marks(F.col("w"), F.col("pos"))))


def frequencies(index: DataFrame) -> DataFrame:
    """(term, freq), stored."""
    return stored(index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("freq")))


def seeds(phrases: DataFrame, often: DataFrame) -> DataFrame:
    """(ik, term, ipos): for every window of every phrase its rarest term by frequencies(); none for windows with a term the corpus lacks."""
    first = F.greatest(F.lit(0), F.col("ipos") - F.col("size") + 1)
    last = F.least(F.col("ipos"), F.col("n") - F.col("size"))
    covered = phrases.join(often, "term", "left").select("ik", "term", "ipos", F.coalesce("freq", F.lit(0)).alias("freq"), F.explode(F.sequence(first, last)).alias("start"))
    rarest = covered.groupBy("ik", "start").agg(F.min(F.struct("freq", "term", "ipos")).alias("r"))
    return rarest.where("r.freq > 0").select("ik", "r.term", "r.ipos").distinct()


def of_documents(index: DataFrame, places: DataFrame) -> DataFrame:
    """The postings of the documents of places, and of few others."""
    ids = stored(places.select("doc_id").distinct())
    bits = LEAST_BITS
    while bits < min(MOST_BITS, 16 * ids.count()):
        bits *= 2
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    masks = stored(ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_mask")))
    found = index.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(masks), "_word")
    return found.where(F.col("_mask").bitwiseAND(F.col("_bit")) != 0).drop("_word", "_bit", "_mask")


def phrase_matches(index: DataFrame, phrases: DataFrame, often: DataFrame) -> DataFrame:
    """Exact matches (doc_id, ik, start, length): maximal runs of at least size words that equal consecutive words of the phrase."""
    first = small(stored(seeds(phrases, often).join(phrases, ["ik", "ipos", "term"])))
    likely = (F.col("size") < 4) | ((F.col("ipos") + 2 < F.col("n")) & (index["after"] == first["after"])) | ((F.col("ipos") >= 2) & (index["before"] == first["before"]))
    places = stored(index.join(first, "term").where(likely).select("doc_id", "ik", (F.col("pos") - F.col("ipos")).alias("diag")).distinct())
    wanted = places.join(small(phrases.select("ik", "size", "ipos", "term")), "ik").withColumn("pos", F.col("diag") + F.col("ipos")).where("pos >= 0")
    found = wanted.join(of_documents(index.select("doc_id", "pos", "term"), places), ["doc_id", "pos", "term"]).select("doc_id", "ik", "diag", "size", "ipos").distinct()
    run = F.col("ipos") - F.row_number().over(Window.partitionBy("doc_id", "ik", "diag").orderBy("ipos"))
    runs = found.withColumn("run", run).groupBy("doc_id", "ik", "diag", "run").agg(F.min("ipos").alias("at"), F.count("*").alias("length"), F.first("size").alias("size"))
    return runs.where("length >= size").select("doc_id", "ik", (F.col("diag") + F.col("at")).alias("start"), "length")


def proximity_matches(index: DataFrame, phrases: DataFrame, often: DataFrame, width: int | Column) -> DataFrame:
    """(doc_id, ik, start): places of a phrase's words from which the next width words hold all its different terms, in any order.

    width: a number, or a column of phrases (n, the phrase's words). Begins with the documents of each phrase's rarest term. In those
    that have all terms somewhere, only what stands within width of the rarest one is looked at, in arrays.
    """
    width = F.lit(width) if isinstance(width, int) else width
    terms = stored(phrases.groupBy("ik", "term").agg(F.first(width).cast("int").alias("width")))
    known = terms.join(often, "term", "left").groupBy("ik").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "term")).alias("r"), F.count("*").alias("terms"))
    known = stored(known.where("r.freq > 0").select("ik", F.col("r.term").alias("rare"), "terms"))
    pairs = stored(index.join(small(known.select("ik", F.col("rare").alias("term"))), "term").select("doc_id", "ik").distinct())
    found = of_documents(index.select("doc_id", "pos", "term"), pairs).join(small(terms), "term").join(pairs, ["doc_id", "ik"], "left_semi")
    found = found.groupBy("doc_id", "ik").agg(F.collect_set(F.struct("pos", "term")).alias("at"), F.count_distinct("term").alias("terms"), F.first("width").alias("width"))
    found = found.join(small(known), ["ik", "terms"])
    within = lambda x, start, end: F.filter(x, lambda b: (b["pos"] >= start) & (b["pos"] < end))
    full = lambda x, start: F.size(F.array_distinct(within(x, start, start + F.col("width"))["term"])) == F.col("terms")
    near = F.transform(F.filter("at", lambda a: a["term"] == F.col("rare")), lambda a: F.struct(a["pos"].alias("pos"), within(F.col("at"), a["pos"] - F.col("width") + 1, a["pos"] + F.col("width")).alias("x")))
    starts = F.flatten(F.transform(near, lambda a: F.filter(a["x"], lambda s: (s["pos"] <= a["pos"]) & full(a["x"], s["pos"]))["pos"]))
    return found.select("doc_id", "ik", F.explode(F.array_distinct(starts)).alias("start"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_items: int = 2, near: bool = False) -> DataFrame:
    """Per doc_id: n_words, n_hit, n_items, items_sha256, contaminated (n_items >= least_items), items (sorted ids).

    near adds n_near: the items all of whose different words lie within twice as many words as the item has, in any order.

    Null texts have no words. Rows that repeat a doc_id are one document: repeats change nothing, and
    different texts under one id count where either has a word. A null doc_id is one document of that
    name without hits. Items without id or words match nothing. No items: nothing is hit.
    """
    phrases = phrase_words(items, window)
    index = postings(docs, phrases)
    often = frequencies(index)
    matches = stored(phrase_matches(index, phrases, often))
    ids = small(stored(phrases.select("ik", F.col("item_id").cast("string").alias("item")).distinct()))
    named = matches.join(ids, "ik").groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = matches.select("doc_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    lengths = index.where(F.col("term") == END).groupBy("doc_id").agg(F.max("pos").cast("bigint").alias("n_words"))
    found = named.join(hit, "doc_id")
    out = lengths.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    further = []
    if near:
        close = proximity_matches(index, phrases, often, F.col("n") * 2).join(ids, "ik").groupBy("doc_id").agg(F.count_distinct("item").alias("n_near"))
        out = out.join(close.withColumnRenamed("doc_id", "_near_id"), F.col("doc_id") == F.col("_near_id"), "left")
        further = [F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near")]
    ids_of = F.coalesce("items", F.array().cast("array<string>"))
    n_items = F.size(ids_of).cast("bigint")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), n_items.alias("n_items"), F.sha2(F.concat_ws(",", ids_of), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"), ids_of.alias("items"), *further)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_items: int = 1) -> DataFrame:
    """The rows of docs without contamination. Rows without doc_id are told apart by a hash of their text."""
    bad = contamination(docs, items, window, least_items).where("contaminated").select("doc_id")
    out = docs.join(bad, "doc_id", "left_anti")
    nameless = docs.where("doc_id is null")
    if not nameless.head(1):
        return out
    named = stored(nameless.withColumn("_id", F.xxhash64("text")))
    bad = contamination(named.select(F.col("_id").alias("doc_id"), "text"), items, window, least_items).where("contaminated").select(F.col("doc_id").alias("_id"))
    return out.where("doc_id is not null").unionByName(named.join(bad, "_id", "left_anti").drop("_id"))
