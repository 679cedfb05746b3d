"""Queries: projections, filters, joins by key, sets, samples, row ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import corpus, describe, ranking, sampling, terms
from lexispark.operators.cleaning import filter_short_reviews, remove_stopwords, token_rows
from lexispark.operators.lexicon import lexicon_lookup
from lexispark.plans import fixture as fx
from lexispark.plans import protocols
from lexispark.plans.fixture import bucket_sql, with_sql
from lexispark.plans.registry import query

MD5 = "md5('42-' || review_id)"


# --- projections and filters ---
@query("composite_key", "SELECT role || '_' || conv_id || '_' || turn AS review_id, text AS review_text FROM conversations")
def _(spark, sf):
    df = corpus.composite_key(fx.table(spark, sf, "conversations"), ["role", "conv_id", "turn"])
    return df.select("review_id", F.col("text").alias("review_text"))


@query("binary_label_gt3", with_sql("SELECT review_id, rating, CAST(rating > 3 AS INTEGER) AS binary_rating FROM stars", "stars"))
def _(spark, sf):
    return corpus.binary_label_gt3(fx.stars(spark, sf)).select("review_id", "rating", "binary_rating")


@query(
    "binary_label_drop_neutral",
    with_sql(
        "SELECT review_id, rating, CASE WHEN rating > 3 THEN 1 ELSE 0 END AS binary_rating FROM stars WHERE rating <> 3", "stars"
    ),
)
def _(spark, sf):
    return corpus.binary_label_drop_neutral(fx.stars(spark, sf)).select("review_id", "rating", "binary_rating")


@query(
    "recode_sentiment",
    """SELECT conv_id, turn, CAST(CASE role WHEN 'assistant' THEN 1 ELSE 0 END AS DOUBLE) AS rating,
    CASE role WHEN 'assistant' THEN 1 ELSE 0 END AS binary_rating FROM conversations WHERE role IN ('assistant', 'user')""",
)
def _(spark, sf):
    df = corpus.recode_sentiment(fx.table(spark, sf, "conversations"), "role", {"assistant": 1, "user": 0})
    return df.select("conv_id", "turn", "rating", "binary_rating")


@query(
    "select_rename_reorder",
    "SELECT doc_id AS review_id, n_chars AS length, text AS review_text FROM documents",
)
def _(spark, sf):
    mapping = {"doc_id": "review_id", "n_chars": "length", "text": "review_text"}
    return corpus.select_rename_reorder(fx.table(spark, sf, "documents"), mapping)


@query("filter_source", "SELECT doc_id, source, text FROM documents WHERE source = 'src7'")
def _(spark, sf):
    return corpus.filter_source(fx.table(spark, sf, "documents"), "source", "src7").select("doc_id", "source", "text")


@query(
    "assign_row_id",
    """SELECT row_number() OVER (ORDER BY doc_id) AS review_id, doc_id, text AS review_text
    FROM (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text)""",
)
def _(spark, sf):
    df = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("review_text"))
    return ranking.assign_row_id(ranking.dedup_first(df, "review_text", ["doc_id"]), ["doc_id"])


@query(
    "tag_type",
    """SELECT item_id AS id, 'test' AS type FROM benchmark UNION ALL SELECT doc_id, 'train' FROM documents""",
)
def _(spark, sf):
    test = corpus.tag_type(fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), "test")
    train = corpus.tag_type(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id")), "train")
    return corpus.union_rows(train, test)


def _wide_vectors(spark, sf):
    vec = [F.get("embedding", F.lit(i)).cast("double").alias(f"V{i + 1}") for i in range(fx.DIM)]
    df = fx.table(spark, sf, "embeddings")
    label = (F.col("label") % 2).cast("int").alias("binary_rating")
    return df.select(F.col("vec_id").cast("string").alias("review_id"), label, *vec)


_WIDE = ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS \"feat_V{i + 1}\"" for i in range(fx.DIM))


@query(
    "prefix_feature_columns",
    f"SELECT CAST(vec_id AS VARCHAR) AS review_id, CAST(label % 2 AS INTEGER) AS binary_rating, {_WIDE} FROM embeddings",
)
def _(spark, sf):
    df = corpus.prefix_feature_columns(_wide_vectors(spark, sf))
    return fx.round6(df, *[c for c in df.columns if c.startswith("feat_")])


@query("filter_by_type", with_sql("SELECT review_id, type, review_text FROM typed WHERE type = 'test'", "typed"))
def _(spark, sf):
    return corpus.filter_by_type(fx.typed(spark, sf), "test").select("review_id", "type", "review_text")


_LONG_FEATURES = """SELECT CAST(vec_id AS VARCHAR) AS review_id, CAST(label % 2 AS DOUBLE) AS label,
    CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS idx, round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings"""


def _long_features(df):
    from pyspark.ml.functions import vector_to_array

    rows = df.select("review_id", "label", F.posexplode(vector_to_array("features")).alias("idx", "value"))
    return fx.round6(rows, "value")


@query("split_features_label", _LONG_FEATURES)
def _(spark, sf):
    return _long_features(corpus.split_features_label(_wide_vectors(spark, sf)))


@query("model_matrix_no_intercept", _LONG_FEATURES)
def _(spark, sf):
    return _long_features(corpus.model_matrix_no_intercept(_wide_vectors(spark, sf)))


@query("filter_short_reviews", "SELECT conv_id, turn, text AS review_text FROM conversations WHERE length(text) < 145")
def _(spark, sf):
    df = fx.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("review_text"))
    return filter_short_reviews(df, 144)


@query(
    "filter_empty_documents",
    with_sql(
        """SELECT review_id, review_text FROM docs WHERE review_id IN (SELECT review_id FROM counts
        WHERE word IN (SELECT word FROM counts GROUP BY word HAVING count(*) >= 10 AND count(*) <= 15))""",
        "docs", "counts",
    ),
)
def _(spark, sf):
    d = fx.docs(spark, sf)
    counts = terms.doc_term_count(d, word="term")
    vocab = terms.document_frequency(counts).where("df between 10 and 15")
    return corpus.filter_empty_documents(fx.documents(spark, sf), terms.align_vocabulary(counts, vocab))


# --- joins ---
_TOKENS_KEPT = with_sql("SELECT review_id, CAST(pos AS INTEGER) AS pos, word FROM kept", "kept")


@query("remove_stopwords", _TOKENS_KEPT)
def _(spark, sf):
    return remove_stopwords(token_rows(fx.docs(spark, sf, ())), fx.stop_table(spark))


@query("remove_stopwords_in", _TOKENS_KEPT)
def _(spark, sf):
    return token_rows(fx.docs(spark, sf, ())).where(~F.col("word").isin(fx.STOP))


@query(
    "lexicon_lookup",
    with_sql("SELECT review_id, CAST(pos AS INTEGER) AS pos, word, sentiment FROM kept JOIN emotions USING (word)", "kept", "emotions"),
)
def _(spark, sf):
    rows = remove_stopwords(token_rows(fx.docs(spark, sf, ())), fx.stop_table(spark))
    return lexicon_lookup(rows, fx.emotion_lexicon(spark)).select("review_id", "pos", "word", "sentiment")


@query(
    "merge_by_review",
    with_sql("SELECT r.review_id, r.rating, t.type FROM reviews r JOIN typed t USING (review_id) ORDER BY 1", "reviews", "typed"),
)
def _(spark, sf):
    merged = corpus.merge_by_review(fx.reviews(spark, sf), fx.typed(spark, sf).select("review_id", "type"))
    return merged.select("review_id", "rating", "type").orderBy("review_id")


_FREQUENT = "SELECT review_id FROM counts WHERE word IN ('from', 'this', 'nicht')"


def _featured(spark, sf):
    words = terms.doc_term_count(fx.docs(spark, sf))
    return words.where(F.col("word").isin("from", "this", "nicht"))


@query("align_labels", with_sql(f"SELECT review_id, binary_rating FROM reviews WHERE review_id IN ({_FREQUENT}) ORDER BY 1", "reviews", "counts"))
def _(spark, sf):
    return corpus.align_labels(fx.reviews(spark, sf).select("review_id", "binary_rating"), _featured(spark, sf))


@query(
    "orphan_features",
    with_sql(
        """SELECT review_id, word, n FROM counts WHERE word IN ('from', 'this', 'nicht')
        AND review_id NOT IN (SELECT review_id FROM reviews)""", "reviews", "counts",
    ),
)
def _(spark, sf):
    return corpus.orphan_features(_featured(spark, sf), fx.reviews(spark, sf))


@query(
    "lookup_by_keys",
    with_sql(
        """SELECT CAST(item_id * 10 AS VARCHAR) AS review_id, rating FROM benchmark
        LEFT JOIN reviews ON review_id = CAST(item_id * 10 AS VARCHAR)""", "reviews",
    ),
)
def _(spark, sf):
    ids = fx.table(spark, sf, "benchmark").select((F.col("item_id") * 10).cast("string").alias("review_id"))
    return corpus.lookup_by_keys(fx.reviews(spark, sf).select("review_id", "rating"), ids)


@query(
    "positional_bind",
    with_sql(
        """SELECT review_id, type, rating, binary_rating FROM typed LEFT JOIN (SELECT review_id, rating, binary_rating FROM reviews)
        USING (review_id)""", "typed", "reviews",
    ),
)
def _(spark, sf):
    left = fx.typed(spark, sf).select("review_id", "type")
    return corpus.bind_by_key(left, fx.reviews(spark, sf).drop("review_text"))


_TECHNIQUES = ["tfidf", "LSA", "LDA"]
_SIZES = [1000, 2500, 5000, 10000, 20000, 50000, 100000]
_GRID_SQL = f"""grid AS (SELECT technique, dataset, CAST(size AS BIGINT) AS size
    FROM (SELECT DISTINCT source AS dataset FROM documents), unnest({_TECHNIQUES}) t(technique), unnest({_SIZES}) s(size)
    WHERE NOT (dataset = 'src3' AND size >= 50000))"""


def _grid(spark, sf):
    sources = fx.table(spark, sf, "documents").select(F.col("source").alias("dataset")).distinct()
    impossible = (F.col("dataset") == "src3") & (F.col("size") >= 50000)
    return protocols.parameter_grid(sources, _TECHNIQUES, _SIZES, impossible)


@query("parameter_grid", f"WITH {_GRID_SQL} SELECT * FROM grid ORDER BY size")
def _(spark, sf):
    return _grid(spark, sf)


@query(
    "missing_inputs",
    f"""WITH {_GRID_SQL}, have AS (SELECT source AS dataset, lang, count(*) * 100 AS docs FROM documents GROUP BY ALL)
    SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.dataset = g.dataset
    AND h.docs >= g.size AND g.technique = CASE h.lang WHEN 'en' THEN 'tfidf' WHEN 'de' THEN 'LSA' ELSE 'LDA' END)""",
)
def _(spark, sf):
    # pretend that a feature set of a size is stored where a source has a hundredth as many documents of a language
    stored = (
        fx.table(spark, sf, "documents")
        .groupBy(F.col("source").alias("dataset"), "lang")
        .agg((F.count(F.lit(1)) * 100).alias("docs"))
        .withColumn("technique", F.when(F.col("lang") == "en", "tfidf").when(F.col("lang") == "de", "LSA").otherwise("LDA"))
        .withColumn("size", F.explode(F.array(*[F.lit(s).cast("long") for s in _SIZES])))
        .where("docs >= size")
    )
    return protocols.missing_inputs(_grid(spark, sf), stored)


@query(
    "alignment_check",
    with_sql(
        f"""SELECT (SELECT count(*) FROM reviews WHERE review_id NOT IN ({_FREQUENT}))
        + (SELECT count(DISTINCT review_id) FROM ({_FREQUENT}) WHERE review_id NOT IN (SELECT review_id FROM reviews)) AS n_mismatch""",
        "reviews", "counts",
    ),
)
def _(spark, sf):
    return corpus.alignment_check(_featured(spark, sf), fx.reviews(spark, sf))


# --- windows, order, sets ---
@query(
    "dedup_first",
    """SELECT doc_id, text AS review_text FROM documents
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def _(spark, sf):
    df = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("review_text"))
    return ranking.dedup_first(df, "review_text", ["doc_id"])


@query("order_by_id_string", with_sql("SELECT review_id, binary_rating FROM reviews ORDER BY review_id", "reviews"))
def _(spark, sf):
    return corpus.order_by_id_string(fx.reviews(spark, sf).select("review_id", "binary_rating"))


@query(
    "union_rows",
    """SELECT doc_id AS id, text AS review_text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark""",
)
def _(spark, sf):
    a = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("review_text"), "lang")
    b = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("review_text"))
    return corpus.union_rows(a, b)


@query("except_ids", with_sql("SELECT review_id FROM docs EXCEPT SELECT review_id FROM reviews", "docs", "reviews"))
def _(spark, sf):
    return corpus.except_ids(fx.documents(spark, sf).select("review_id"), fx.reviews(spark, sf))


@query("distinct_texts", "SELECT DISTINCT text AS review_text FROM documents")
def _(spark, sf):
    return corpus.distinct_texts(fx.documents(spark, sf))


@query(
    "split_mix_after_features",
    with_sql("SELECT type, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_tokens FROM counts JOIN typed USING (review_id) GROUP BY type", "counts", "typed"),
)
def _(spark, sf):
    mixed = terms.doc_term_count(fx.tokenized(fx.typed(spark, sf), fx.STOP), ["review_id", "type"])
    both = corpus.union_rows(*corpus.split_mix_after_features(mixed))
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_tokens"))


# --- samples ---
@query("sample_n", with_sql(f"SELECT review_id, review_text FROM docs ORDER BY {MD5}, review_id LIMIT 150", "docs"))
def _(spark, sf):
    return sampling.sample_n(fx.documents(spark, sf), 150)


@query(
    "balanced_sample",
    with_sql(
        f"""SELECT review_id, binary_rating FROM reviews
        QUALIFY row_number() OVER (PARTITION BY binary_rating ORDER BY {MD5}, review_id) <= 50""", "reviews",
    ),
)
def _(spark, sf):
    return sampling.balanced_sample(fx.reviews(spark, sf), "binary_rating", 50).select("review_id", "binary_rating")


@query(
    "holdout_split_n",
    with_sql(f"SELECT review_id, CASE WHEN row_number() OVER (ORDER BY {MD5}, review_id) <= 100 THEN 'test' ELSE 'train' END AS type FROM docs", "docs"),
)
def _(spark, sf):
    return sampling.holdout_split_n(fx.documents(spark, sf), 100).select("review_id", "type")


@query("fraction_split", with_sql("SELECT review_id, type FROM typed", "typed"))
def _(spark, sf):
    return sampling.fraction_split(fx.documents(spark, sf), 0.8).select("review_id", "type")


@query(
    "stratified_split",
    with_sql(
        f"""SELECT review_id, binary_rating, CASE WHEN row_number() OVER (PARTITION BY binary_rating ORDER BY {MD5}, review_id)
        <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY binary_rating)) THEN 'test' ELSE 'train' END AS type FROM reviews""", "reviews",
    ),
)
def _(spark, sf):
    return sampling.stratified_split(fx.reviews(spark, sf), "binary_rating", 0.2).select("review_id", "binary_rating", "type")


@query(
    "assign_folds",
    with_sql(
        f"""SELECT review_id, binary_rating, CAST((row_number() OVER (PARTITION BY binary_rating ORDER BY {MD5}, review_id) - 1) % 5
        AS INTEGER) AS fold FROM reviews""", "reviews",
    ),
)
def _(spark, sf):
    folded = sampling.assign_folds(fx.reviews(spark, sf), "binary_rating")
    return folded.select("review_id", "binary_rating", "fold")
