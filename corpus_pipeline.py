"""A corpus pipeline of five stages over documents; each stage works on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), docs with the columns of
documents, and all but the last return these columns. run() writes each stage's result as Parquet to the
shared folder and reads it again for the next, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docql.llm import bpe, decontaminate, langid, linededup, simhash
from docql.llm.common import stored, table
from docql.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or text) go; lang becomes the predicted language of the others."""
    found = langid.predict(docs.select(*COLUMNS), langid.fit(docs))
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted from texts; a document goes that has no word left."""
    done = linededup.dedup_lines(docs.select(*COLUMNS), partners="every")
    done = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return done.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.first_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a window of any benchmark item."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), least_items=1)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and the decoded text of every document."""
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary()).drop("text")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]

#: The stages are beyond SQL (automata, patience diff, XXH64); tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
