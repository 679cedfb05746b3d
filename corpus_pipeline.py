"""A training corpus from raw documents: five stages, each a DataFrame in and a DataFrame out.

All stages but the last return the columns of ``documents`` (``doc_id``, ``text``, ``lang``, ``source``, ``n_chars``; further columns stay as
they are); ``n_chars`` follows the text. A stage works on all rows its predecessor kept:

1. toxicity: documents predicted toxic go (class models learned from ``labels`` of the same folder, see ``llm.toxicity``).
2. line_dedup: lines on more than a fifth of the documents of a source, and on three at least, go from the texts.
3. simhash_dedup: of each group of documents within 2 bits of each other's 3-word SimHash the document with the smallest id stays, once.
4. suffix_dedup: bytes of 50-byte strings that also start in a document with a smaller id go; what is left stays a document.
5. packing: token pieces of all documents in sequences of at most 2048 tokens.

Documents without an id take part where no order of ids is needed: they are scored, lose boilerplate and are packed, but are
neither copies nor originals of others. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import lines, packing, simhash, suffixes, toxicity
from lexispark.llm.catalog import table, tokenizer
from lexispark.session import stage


def _with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.filter("predicted = 0").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_size(lines.drop_boilerplate(docs, "doc_id", "text", "source", ratio=0.2, line_pages=3).select(docs.columns))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_near_duplicates(docs, size=3, budget=2)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_size(suffixes.remove_repeats(docs, size=50).select(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

# class models, trie joins and packing have no SQL form; tests/llm compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
