"""Term features: counts, document-term matrices, tf-idf, pruned vocabularies, hashing.

Input is the tokenised review table. Counts per document are row-local (`count_rows`); only the
statistics per term are shuffled, after partial aggregation. A vocabulary is staged before the
text is matched with it, so Spark knows its size when it chooses the join.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from lexispark.functions import text as tx
from lexispark.operators.describe import normalize_by
from lexispark.operators.joins import frequency_join
from lexispark.operators.ranking import assign_row_id
from lexispark.session import stage

REVIEW = ("review_id",)


def doc_term_count(docs: DataFrame, keep: Iterable[str] = REVIEW, word: str = "word") -> DataFrame:
    """Count per (review, word)."""
    return tx.count_rows(docs, "tokens", keep, word)


def ngram_counts(docs: DataFrame, n_max: int = 2, sep: str = " ", keep: Iterable[str] = REVIEW) -> DataFrame:
    """Count per (review, n-gram) for n = 1..n_max, as `keep, term, n`."""
    return tx.count_rows(docs, tx.ngrams("tokens", 1, n_max, sep), keep)


def term_statistics(term_counts: DataFrame) -> DataFrame:
    """Per term: occurrences and documents (a document has each term once in `term_counts`)."""
    return term_counts.groupBy("term").agg(F.sum("n").alias("term_count"), F.count(F.lit(1)).alias("doc_count"))


def document_frequency(term_counts: DataFrame) -> DataFrame:
    return term_statistics(term_counts).select("term", F.col("doc_count").alias("df"))


def dtm_vocabulary(
    docs: DataFrame, n_max: int = 2, min_df: int = 10, sparse: float = 0.99, min_chars: int = 3
) -> DataFrame:
    """Terms in at least `min_df` documents and in more than N * (1 - sparse), staged.

    A document with an n-gram has the shorter ones in it, so only n-grams out of two kept (n-1)-grams are counted over all documents:
    what is shuffled is the words and few n-grams, not every n-gram of the corpus.
    """
    n_docs = docs.count()
    often = (F.col("doc_count") >= min_df) & (F.col("doc_count") > F.lit(n_docs * (1.0 - sparse)))
    kept = [stage(term_statistics(ngram_counts(docs, 1)).where(often), "dtm-level")]
    for n in range(2, n_max + 1):
        rows = tx.count_rows(docs, tx.ngrams("tokens", n, n), REVIEW)
        for part in (n - 1, 1 - n):  # the first and the last n - 1 words
            shorter = kept[-1].select(F.col("term").alias("_part"))
            rows = frequency_join(rows.withColumn("_part", F.substring_index("term", " ", part)), shorter, "_part", "left_semi").drop("_part")
        kept.append(stage(term_statistics(rows).where(often), "dtm-level"))
    whole = reduce(DataFrame.unionByName, kept)
    return stage(whole.where(F.length("term") >= min_chars), "dtm-vocabulary")


def dtm(
    docs: DataFrame,
    n_max: int = 2,
    min_df: int = 10,
    sparse: float = 0.99,
    min_chars: int = 3,
    keep: Iterable[str] = REVIEW,
) -> DataFrame:
    """Document-term counts on the reduced vocabulary, as triplets `review_id, term, n`."""
    vocab = dtm_vocabulary(docs, n_max, min_df, sparse, min_chars)
    return dtm_with_dictionary(docs, vocab, n_max, keep)


def dtm_with_dictionary(docs: DataFrame, vocab: DataFrame, n_max: int = 2, keep: Iterable[str] = REVIEW) -> DataFrame:
    """Counts restricted to a given vocabulary, without a frequency bound of their own."""
    return align_vocabulary(ngram_counts(docs, n_max, keep=keep), vocab)


def align_vocabulary(test_terms: DataFrame, train_vocab: DataFrame) -> DataFrame:
    """Triplets whose term is in the vocabulary; absent terms read as zero in sparse form.

    The vocabulary should be a stored table, as its size is asked for.
    """
    return frequency_join(test_terms, train_vocab.select("term"), "term", "left_semi").select(*test_terms.columns)


def term_rank(docs: DataFrame, keep: Iterable[str] = REVIEW) -> DataFrame:
    """`review_id, word, n, rank, total, tf`: rank by count (ties by word), tf = n / total.

    Rank and total concern one document, so they are array expressions in its row.
    """
    keep = list(keep)
    by_count = F.sort_array(
        F.transform(
            "_starts", lambda at, k: F.struct((-tx.run_length(at, k)).alias("neg"), F.get("_sorted", at).alias("word"))
        )
    )
    ranked = tx.sorted_runs(docs, "tokens", keep).select(
        *keep, F.size("_sorted").cast("long").alias("total"), F.posexplode(by_count).alias("_at", "_e")
    )
    return ranked.select(
        *keep,
        F.col("_e.word").alias("word"),
        (-F.col("_e.neg")).alias("n"),
        (F.col("_at") + 1).cast("long").alias("rank"),
        "total",
        (-F.col("_e.neg") / F.col("total")).alias("tf"),
    )


def inverse_document_frequency(docs: DataFrame) -> DataFrame:
    """`word, df, idf` with idf = ln(N / df), N = documents with at least one token; staged.

    A NULL word per document carries N through the same aggregation, which saves a second pass.
    """
    marked = F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))
    df = stage(
        docs.select(F.explode(F.when(F.size("tokens") > 0, marked)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("df")),
        "document-frequency",
    )
    n_docs = df.where("word is null").select("df").scalar()
    return df.where("word is not null").withColumn("idf", F.ln(n_docs / F.col("df")))


def tfidf(
    docs: DataFrame, cut: float | None = 0.03, keep: Iterable[str] = REVIEW, idf: DataFrame | None = None
) -> DataFrame:
    """`review_id, word, n, rank, total, tf, idf, tf_idf`, rows above `cut` (None keeps all).

    `idf` from another corpus may be given to weight new documents (fold-in).
    """
    own = idf is None
    idf = inverse_document_frequency(docs) if own else idf
    # a word has as many rows as documents, so the documents' own table names the frequent ones
    rows_of = idf.select("word", F.col("df").alias("n")) if own else None
    weighted = frequency_join(term_rank(docs, keep), idf.select("word", "idf"), "word", rows_of=rows_of)
    out = weighted.withColumn("tf_idf", F.col("tf") * F.col("idf")).select(
        *keep, "word", "n", "rank", "total", "tf", "idf", "tf_idf"
    )
    return out if cut is None else out.where(F.col("tf_idf") > cut)


def pruned_vocabulary(
    docs: DataFrame,
    n_max: int = 2,
    count_min: int = 10,
    p_min: float = 0.001,
    p_max: float = 0.5,
    sep: str = "_",
) -> DataFrame:
    """`term, term_count, doc_count` of the n-grams within the bounds, staged.

    Stop words have to be absent from `tokens` already, so that n-grams close over the gaps.
    """
    n_docs = docs.count()
    share = F.col("doc_count") / F.lit(float(max(n_docs, 1)))
    vocab = term_statistics(ngram_counts(docs, n_max, sep)).where(
        (F.col("term_count") >= count_min) & (share >= p_min) & (share <= p_max)
    )
    return stage(vocab.select("term", "term_count", "doc_count"), "pruned-vocabulary")


def vocab_vectorize(
    docs: DataFrame, vocab: DataFrame, n_max: int = 2, sep: str = "_", keep: Iterable[str] = REVIEW
) -> DataFrame:
    """`review_id, term, weight`: counts on the vocabulary, each review's weights summing to 1.

    A review without a term of the vocabulary has one row with a NULL term and weight 0.
    """
    keep = list(keep)
    weights = l1_normalize(align_vocabulary(ngram_counts(docs, n_max, sep, keep), vocab))
    weights = weights.withColumnRenamed("review_id", "_id").select("_id", "term", "weight")
    rows = docs.select(*keep).join(weights, F.col("review_id") == F.col("_id"), "left")
    return rows.select(*keep, "term", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def l1_normalize(term_counts: DataFrame) -> DataFrame:
    """n over the review's sum, as `weight` in place of `n`."""
    return normalize_by(term_counts, "n", "review_id", "weight").drop("n")


def hash_bucket(term, n_buckets: int = 2**14) -> Column:
    """Bucket from the first 32 bits of the term's MD5."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % n_buckets


def feature_hashing(
    docs: DataFrame, n_buckets: int = 2**14, n_max: int = 2, sep: str = "_", keep: Iterable[str] = REVIEW
) -> DataFrame:
    """`review_id, bucket, weight`: n-grams hashed into buckets, weights summing to 1. No shuffle.

    A review without tokens has one row with a NULL bucket and weight 0.
    """
    keep = list(keep)
    buckets = docs.select(*keep, tx.ngrams("tokens", 1, n_max, sep).alias("_terms")).select(
        *keep, F.transform("_terms", lambda t: hash_bucket(t, n_buckets)).alias("_buckets")
    )
    weights = F.transform(
        "_starts", lambda at, k: F.struct(F.get("_sorted", at), tx.run_length(at, k) / F.size("_sorted"))
    )
    rows = tx.sorted_runs(buckets, "_buckets", keep).select(*keep, F.inline_outer(weights).alias("bucket", "weight"))
    return rows.withColumn("weight", F.coalesce("weight", F.lit(0.0)))


# --- vectors ---
def vocabulary_index(vocab: DataFrame) -> DataFrame:
    """`term, idx` with dense 0-based positions in term order."""
    ids = assign_row_id(vocab.select("term"), ["term"], "idx")
    return ids.select("term", (F.col("idx") - 1).cast("int").alias("idx"))


def sparse_triplets(triplets: DataFrame, index: DataFrame, value: str = "n") -> DataFrame:
    """Triplets with the term's position: `review_id, idx, value`."""
    return frequency_join(triplets, index, "term").select("review_id", "idx", F.col(value).cast("double").alias("value"))


@F.pandas_udf(VectorUDT())
def _sparse_vector(size: pd.Series, indices: pd.Series, values: pd.Series) -> pd.DataFrame:
    # a vector column travels through Arrow as its storage struct; type 0 is sparse
    return pd.DataFrame({"type": 0, "size": size, "indices": indices, "values": values})


def cast_sparse(triplets: DataFrame, index: DataFrame, value: str = "n") -> DataFrame:
    """`review_id, features` with one sparse vector per review."""
    size = index.count()
    cells = sparse_triplets(triplets, index, value).groupBy("review_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("cells")
    )
    return cells.select(
        "review_id", _sparse_vector(F.lit(size), F.col("cells.idx"), F.col("cells.value")).alias("features")
    )


@F.arrow_udf(ArrayType(StructType().add("idx", IntegerType()).add("value", DoubleType())))
def sparse_cells(vectors: pa.Array) -> pa.Array:
    """The stored entries of sparse vectors."""
    # whole columns, as an object for each entry of a batch would take some hundred bytes; a NULL vector has no entries
    indices, values = vectors.field("indices"), vectors.field("values")
    offsets = np.concatenate([[0], np.cumsum(indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    cells = pa.StructArray.from_arrays([indices.flatten().cast(pa.int32()), values.flatten()], ["idx", "value"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), cells)


def transpose(triplets: DataFrame) -> DataFrame:
    """Terms x documents from documents x terms and back: the triplet's keys change places."""
    first, second, *rest = triplets.columns
    return triplets.select(second, first, *rest)


def count_vectors(
    docs: DataFrame, vocab: DataFrame, n_max: int = 2, sep: str = " ", keep: Iterable[str] = REVIEW
) -> tuple[DataFrame, list[str]]:
    """(reviews with sparse count vectors `features`, terms).

    For vocabularies bounded by a document share s: these have at most 1 / s times the mean number of different terms of
    a review, whatever the corpus, and so can be held by the driver. `cast_sparse` has no such need.
    """
    rows = vocab.select("term").collect()
    if not rows:
        raise ValueError("the vocabulary is empty")
    terms = sorted(r["term"] for r in rows)
    model = CountVectorizerModel.from_vocabulary(terms, "_terms", "features")
    with_terms = docs.select(*keep, tx.ngrams("tokens", 1, n_max, sep).alias("_terms"))
    return model.transform(with_terms).drop("_terms"), terms
