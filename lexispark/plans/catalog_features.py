"""Queries: term features, word-vector features given a vector table, protocols."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions.text import PRONOUNS
from lexispark.operators import cleaning, embeddings, terms
from lexispark.plans import fixture as fx
from lexispark.plans import protocols
from lexispark.plans.fixture import bucket_sql, with_sql
from lexispark.plans.registry import query
from lexispark.session import stage

_N = "(SELECT count(*) FROM docs)"


def _vocab(grams: str, min_df: int, sparse: float, name: str = "vocab") -> str:
    return f"""{name} AS (SELECT term, count(*) AS df, sum(n) AS term_count FROM {grams} WHERE length(term) >= 3 GROUP BY term
    HAVING count(*) >= {min_df} AND count(*) > {_N} * (1::DOUBLE - {sparse}::DOUBLE))"""


_TRIGRAMS = """trigrams AS (SELECT review_id, term, count(*) AS n FROM (SELECT review_id, word AS term FROM pairs
    UNION ALL SELECT review_id, word || ' ' || word2 FROM pairs WHERE word2 IS NOT NULL
    UNION ALL SELECT review_id, word || ' ' || word2 || ' ' || word3 FROM pairs WHERE word3 IS NOT NULL) GROUP BY ALL)"""
_KEEP_VOCAB = "SELECT review_id, term, n FROM {0} WHERE term IN (SELECT term FROM vocab)"


@query("dtm", with_sql(_KEEP_VOCAB.format("grams"), "grams", extra=(_vocab("grams", 10, 0.99),)))
def _(spark, sf):
    return terms.dtm(fx.docs(spark, sf))


@query("dtm_tm_trigram", with_sql(_KEEP_VOCAB.format("trigrams"), "pairs", extra=(_TRIGRAMS, _vocab("trigrams", 5, 0.99))))
def _(spark, sf):
    return terms.dtm(fx.docs(spark, sf), n_max=3, min_df=5)


_WORDS = "words AS (SELECT review_id, word AS term, n FROM counts)"


@query("tdm_unigram", with_sql(_KEEP_VOCAB.format("words"), "counts", extra=(_WORDS, _vocab("words", 1, 0.98))))
def _(spark, sf):
    return terms.dtm(fx.docs(spark, sf), n_max=1, min_df=1, sparse=0.98)


_TRAIN_DOCS = "SELECT review_id FROM typed WHERE type = '{0}'"
_TRAIN_VOCAB = """vocab AS (SELECT term FROM grams WHERE length(term) >= 3 AND review_id IN (SELECT review_id FROM typed WHERE type = 'train')
    GROUP BY term HAVING count(*) >= 10 AND count(*) > (SELECT count(*) FROM typed WHERE type = 'train') * (1::DOUBLE - 0.99::DOUBLE))"""


@query(
    "dtm_with_dictionary",
    with_sql(
        f"{_KEEP_VOCAB.format('grams')} AND review_id IN ({_TRAIN_DOCS.format('test')})", "typed", "grams", extra=(_TRAIN_VOCAB,),
    ),
)
def _(spark, sf):
    docs = cleaning.tokenized(fx.typed(spark, sf), fx.STOP)
    vocab = terms.dtm_vocabulary(docs.where("type = 'train'"))
    return terms.dtm_with_dictionary(docs.where("type = 'test'"), vocab)


# --- tf-idf ---
def _tfidf_sql(source: str, by: str = "") -> str:
    over = f"PARTITION BY {by}, word" if by else "PARTITION BY word"
    group = by or "1"
    return f"""sizes AS MATERIALIZED (SELECT {group} AS part, count(DISTINCT review_id) AS n_docs FROM {source} GROUP BY 1),
    weighted AS MATERIALIZED (SELECT t.*, n / total::DOUBLE AS tf, ln(n_docs::DOUBLE / df) AS idf FROM (SELECT *,
    row_number() OVER (PARTITION BY review_id ORDER BY n DESC, word) AS rank, CAST(sum(n) OVER (PARTITION BY review_id) AS BIGINT) AS total,
    count(*) OVER ({over}) AS df FROM {source}) t JOIN sizes ON part = {f"t.{by}" if by else "1"})"""


_TFIDF_COLS = "review_id, {0}word, n, rank, total, round(tf, 6) AS tf, round(idf, 6) AS idf, round(tf * idf, 6) AS tf_idf"


@query("tfidf", with_sql(f"SELECT {_TFIDF_COLS.format('')} FROM weighted WHERE tf * idf > 0.03", "counts", extra=(_tfidf_sql("counts"),)))
def _(spark, sf):
    return fx.round6(terms.tfidf(fx.docs(spark, sf)), "tf", "idf", "tf_idf")


@query("tfidf_unfiltered", with_sql(f"SELECT {_TFIDF_COLS.format('')} FROM weighted", "counts", extra=(_tfidf_sql("counts"),)))
def _(spark, sf):
    return fx.round6(terms.tfidf(fx.docs(spark, sf), cut=None), "tf", "idf", "tf_idf")


@query(
    "term_rank",
    with_sql(
        """SELECT review_id, word, n, row_number() OVER (PARTITION BY review_id ORDER BY n DESC, word) AS rank,
        CAST(sum(n) OVER (PARTITION BY review_id) AS BIGINT) AS total, round(n / sum(n) OVER (PARTITION BY review_id), 6)::DOUBLE AS tf FROM counts""",
        "counts",
    ),
)
def _(spark, sf):
    return fx.round6(terms.term_rank(fx.docs(spark, sf)), "tf")


# --- vocabulary and hashing ---
_PRUNED = f"""vocab AS (SELECT term, CAST(sum(n) AS BIGINT) AS term_count, count(*) AS doc_count FROM ugrams GROUP BY term HAVING sum(n) >= 10
    AND count(*) / {_N}::DOUBLE BETWEEN 0.001::DOUBLE AND 0.5::DOUBLE)"""
_L1 = """SELECT docs.review_id, term, coalesce(weight, 0) AS weight FROM docs LEFT JOIN (SELECT review_id, term,
    round(n / sum(n) OVER (PARTITION BY review_id), 6)::DOUBLE AS weight FROM {0} WHERE term IN (SELECT term FROM vocab)) w USING (review_id)"""


@query("pruned_vocabulary", with_sql("SELECT * FROM vocab", "ugrams", extra=(_PRUNED,)))
def _(spark, sf):
    return terms.pruned_vocabulary(fx.docs(spark, sf))


_PRONOUN_IN = ", ".join(f"'{w}'" for w in PRONOUNS)
_STRIPPED = rf"""words AS (SELECT review_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT review_id, list_filter(
    string_split_regex(translate(lower(review_text), '{fx.PUNCTUATION_SQL}', ''), '\s+'), lambda x: x <> '' AND x NOT IN ({_PRONOUN_IN})) AS w FROM docs)),
    next AS (SELECT review_id, word, lead(word) OVER (PARTITION BY review_id ORDER BY pos) AS word2 FROM words),
    ugrams AS (SELECT review_id, term, count(*) AS n FROM (SELECT review_id, word AS term FROM next
    UNION ALL SELECT review_id, word || '_' || word2 FROM next WHERE word2 IS NOT NULL) GROUP BY ALL)"""


@query("pruned_vocabulary_stripped", with_sql("SELECT * FROM vocab", "docs", extra=(_STRIPPED, _PRUNED)))
def _(spark, sf):
    return terms.pruned_vocabulary(cleaning.stripped_tokens(fx.documents(spark, sf), PRONOUNS))


@query("vocab_vectorize", with_sql(_L1.format("ugrams"), "docs", "ugrams", extra=(_PRUNED,)))
def _(spark, sf):
    docs = fx.docs(spark, sf)
    return fx.round6(terms.vocab_vectorize(docs, terms.pruned_vocabulary(docs)), "weight")


@query(
    "feature_hashing",
    with_sql(
        f"""SELECT docs.review_id, bucket, coalesce(weight, 0) AS weight FROM docs LEFT JOIN (
        SELECT review_id, bucket, round(sum(n) / total, 6)::DOUBLE AS weight FROM (SELECT review_id, n,
        {bucket_sql("term", 8)} % 16384 AS bucket, sum(n) OVER (PARTITION BY review_id) AS total FROM ugrams) GROUP BY review_id, bucket, total) w
        USING (review_id)""",
        "docs", "ugrams",
    ),
)
def _(spark, sf):
    return fx.round6(terms.feature_hashing(fx.docs(spark, sf)), "weight")


@query("l1_normalize", with_sql("SELECT review_id, term, round(n / sum(n) OVER (PARTITION BY review_id), 6)::DOUBLE AS weight FROM words", "counts", extra=(_WORDS,)))
def _(spark, sf):
    return fx.round6(terms.l1_normalize(terms.doc_term_count(fx.docs(spark, sf), word="term")), "weight")


@query(
    "align_vocabulary",
    with_sql(
        """SELECT review_id, word, n FROM counts WHERE review_id IN (SELECT review_id FROM typed WHERE type = 'test') AND word IN
        (SELECT word FROM counts JOIN typed USING (review_id) WHERE type = 'train')""", "counts", "typed",
    ),
)
def _(spark, sf):
    docs = cleaning.tokenized(fx.typed(spark, sf), fx.STOP)
    counts = terms.doc_term_count(docs, ["review_id", "type"], "term")
    train = stage(counts.where("type = 'train'").select("term").distinct(), "train-terms")
    return terms.align_vocabulary(counts.where("type = 'test'"), train).select("review_id", F.col("term").alias("word"), "n")


# every term has a column; the count vectors are for vocabularies bounded by a document share
_ALL_TERMS = "vocab AS (SELECT DISTINCT term FROM words)"
_INDEX = "idx AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM vocab)"
_CELLS = "SELECT review_id, idx, n::DOUBLE AS value FROM words JOIN idx USING (term)"


@query("cast_sparse", with_sql(_CELLS, "counts", extra=(_WORDS, _ALL_TERMS, _INDEX)))
def _(spark, sf):
    counts = terms.doc_term_count(fx.docs(spark, sf), word="term")
    index = stage(terms.vocabulary_index(counts.select("term").distinct()), "term-index")
    return terms.cast_sparse(counts, index).select("review_id", F.inline(terms.sparse_cells("features")))


@query("count_vectors", with_sql(_CELLS, "counts", extra=(_WORDS, _vocab("words", 1, 0.99), _INDEX)))
def _(spark, sf):
    docs = fx.docs(spark, sf)
    vectors, _terms = terms.count_vectors(docs, terms.dtm_vocabulary(docs, 1, 1, 0.99), 1)
    return vectors.select("review_id", F.inline(terms.sparse_cells("features")))


@query("transpose", with_sql("SELECT term, review_id, n FROM grams", "grams"))
def _(spark, sf):
    return terms.transpose(terms.ngram_counts(fx.docs(spark, sf)))


# --- word vectors and clusters: row i of `embeddings` belongs to the i-th most frequent word ---
def word_table(spark, sf):
    words = embeddings.frequent_words(fx.docs(spark, sf))
    vecs = fx.table(spark, sf, "embeddings").select(
        (F.col("vec_id") + 1).alias("word_no"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("cluster")
    )
    # a vector table is a stored table: its size decides how it is joined
    return stage(words.join(vecs, "word_no").select("word_no", "word", "vector", "cluster"), "word-vectors")


@query(
    "word_vector_join",
    with_sql("SELECT review_id, CAST(pos AS INTEGER) AS pos, word, round(embedding[1]::DOUBLE, 6) AS v0 FROM kept JOIN vectors USING (word)", "kept", "vectors"),
)
def _(spark, sf):
    rows = cleaning.token_rows(fx.docs(spark, sf, ())).where(~F.col("word").isin(fx.STOP))
    joined = embeddings.word_vector_join(rows, word_table(spark, sf).select("word", "vector"))
    return fx.round6(joined.select("review_id", "pos", "word", F.get("vector", F.lit(0)).alias("v0")), "v0")


@query(
    "word_cluster_join",
    with_sql("SELECT review_id, CAST(pos AS INTEGER) AS pos, word, cluster FROM kept JOIN vectors USING (word)", "kept", "vectors"),
)
def _(spark, sf):
    rows = cleaning.token_rows(fx.docs(spark, sf, ())).where(~F.col("word").isin(fx.STOP))
    return embeddings.word_cluster_join(rows, word_table(spark, sf).drop("vector")).select("review_id", "pos", "word", "cluster")


@query(
    "vector_average",
    with_sql(
        f"""SELECT review_id, CAST(d - 1 AS INTEGER) AS dim, round(coalesce(avg(embedding[d]::DOUBLE), 0), 6) AS value
        FROM docs LEFT JOIN (SELECT review_id, embedding FROM kept JOIN vectors USING (word)) h USING (review_id),
        range(1, {fx.DIM + 1}) r(d) GROUP BY review_id, d""", "docs", "kept", "vectors",
    ),
)
def _(spark, sf):
    means = embeddings.vector_average(fx.docs(spark, sf, ()), word_table(spark, sf), fx.DIM, fx.STOP)
    return fx.round6(means.select("review_id", F.posexplode_outer("vector").alias("dim", "value")), "value")


@query(
    "bag_of_centroids",
    with_sql(
        """SELECT review_id, cluster, count(cluster) AS n FROM docs LEFT JOIN (SELECT review_id, cluster FROM kept JOIN vectors USING (word)) h
        USING (review_id) GROUP BY ALL""", "docs", "kept", "vectors",
    ),
)
def _(spark, sf):
    return embeddings.bag_of_centroids(fx.docs(spark, sf), word_table(spark, sf).drop("vector"))


# --- protocols ---
def _split(spark, sf):
    df = fx.typed(spark, sf)
    return df.where("type = 'train'"), df.where("type = 'test'")


def _tfidf_builder(df):
    return terms.tfidf(cleaning.tokenized(df, fx.STOP), keep=["review_id", "type"])


_TYPED_COUNTS = "tcounts AS (SELECT counts.*, type FROM counts JOIN typed USING (review_id))"


@query(
    "protocol_mix",
    with_sql(f"SELECT {_TFIDF_COLS.format('type, ')} FROM weighted WHERE tf * idf > 0.03", "counts", "typed", extra=(_TYPED_COUNTS, _tfidf_sql("tcounts"))),
)
def _(spark, sf):
    return fx.round6(protocols.protocol_mix(*_split(spark, sf), _tfidf_builder), "tf", "idf", "tf_idf")


@query(
    "protocol_blind",
    with_sql(
        f"""SELECT {_TFIDF_COLS.format('type, ')} FROM weighted WHERE tf * idf > 0.03 AND (type = 'train' OR word IN
        (SELECT word FROM weighted WHERE type = 'train' AND tf * idf > 0.03))""", "counts", "typed",
        extra=(_TYPED_COUNTS, _tfidf_sql("tcounts", "type")),
    ),
)
def _(spark, sf):
    return fx.round6(protocols.protocol_blind(*_split(spark, sf), _tfidf_builder, "word"), "tf", "idf", "tf_idf")


_FOLD_VOCAB = """vocab AS (SELECT term FROM ugrams WHERE review_id IN (SELECT review_id FROM typed WHERE type = 'train') GROUP BY term
    HAVING sum(n) >= 10 AND count(*) / (SELECT count(*) FROM typed WHERE type = 'train')::DOUBLE BETWEEN 0.001::DOUBLE AND 0.5::DOUBLE)"""


@query(
    "protocol_foldin",
    with_sql(f"SELECT f.*, type FROM ({_L1.format('ugrams')}) f JOIN typed USING (review_id)", "docs", "ugrams", "typed", extra=(_FOLD_VOCAB,)),
)
def _(spark, sf):
    train, test = (cleaning.tokenized(d, fx.STOP) for d in _split(spark, sf))
    transform = lambda vocab, docs: terms.vocab_vectorize(docs, vocab).select("review_id", "term", "weight")
    return fx.round6(protocols.protocol_foldin(train, test, terms.pruned_vocabulary, transform), "weight")
