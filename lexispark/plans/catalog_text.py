"""Queries: string functions, tokens, cleaning, corpus description."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.operators import cleaning, corpus, describe, terms
from lexispark.operators.runlog import stage_duration
from lexispark.plans import fixture as fx
from lexispark.plans.fixture import with_sql
from lexispark.plans.registry import query
from lexispark.plans.stem_sql import PORTER2_CTES
from lexispark.session import stage

def _text(spark, sf, column):
    return fx.documents(spark, sf).select("review_id", column.alias("review_text"))


@query("space_after_period", with_sql("SELECT review_id, replace(review_text, '.', '. ') AS review_text FROM docs", "docs"))
def _(spark, sf):
    return _text(spark, sf, tx.space_after_period("review_text"))


@query("hyphen_to_space", with_sql("SELECT review_id, replace(review_text, '-', ' ') AS review_text FROM docs", "docs"))
def _(spark, sf):
    return _text(spark, sf, tx.hyphen_to_space("review_text"))


@query("tokenize_words", with_sql("SELECT review_id, CAST(pos AS INTEGER) AS pos, word FROM tok", "tok"))
def _(spark, sf):
    return cleaning.token_rows(fx.docs(spark, sf, ()))


@query(
    "normalize_alnum",
    with_sql(
        r"""SELECT review_id, regexp_replace(regexp_replace(lower(review_text), '[^\p{L}\p{N}]', ' ', 'g'), '\s+', ' ', 'g')
        AS review_text FROM docs""", "docs",
    ),
)
def _(spark, sf):
    return _text(spark, sf, tx.normalize_alnum("review_text"))


@query("strip_punct_lower", with_sql(f"SELECT review_id, translate(lower(review_text), '{fx.PUNCTUATION_SQL}', '') AS review_text FROM docs", "docs"))
def _(spark, sf):
    return _text(spark, sf, tx.strip_punct_lower("review_text"))


_TM_SQL = r"""tm AS (SELECT review_id, pos, word FROM (SELECT review_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
    FROM (SELECT review_id, string_split_regex(regexp_replace(replace(lower(review_text), '-', ' '), '[\p{P}\p{S}]', '', 'g'), '\s+')
    AS words FROM docs)) WHERE word <> '' AND word NOT IN (SELECT word FROM stop))"""


@query(
    "clean_corpus_tm",
    with_sql(
        """SELECT review_id, coalesce(string_agg(word_stem, ' ' ORDER BY pos), '') AS review_text
        FROM docs LEFT JOIN (SELECT * FROM tm JOIN english USING (word)) USING (review_id) GROUP BY review_id""", "docs", "stop",
        extra=(_TM_SQL, "kept AS (SELECT * FROM tm)", *PORTER2_CTES),
    ),
)
def _(spark, sf):
    return cleaning.clean_corpus_tm(fx.documents(spark, sf), fx.STOP).select("review_id", "review_text")


@query(
    "clean_corpus_tm_no_stem",
    with_sql(
        """SELECT review_id, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS review_text
        FROM docs LEFT JOIN tm USING (review_id) GROUP BY review_id""", "docs", "stop", extra=(_TM_SQL,),
    ),
)
def _(spark, sf):
    cleaned = cleaning.clean_corpus_tm(fx.documents(spark, sf), fx.STOP, stems=False)
    return cleaned.select("review_id", "review_text")


# a (word, stem) table out of the vocabulary itself: a final s, ed or ing is cut off longer words
_STEMS_SQL = r"stems AS (SELECT DISTINCT word, regexp_replace(word, '^(.{3,}?)(ing|ed|s)$', '\1') AS word_stem FROM kept)"


def _stems(docs):
    words = cleaning.words_of(docs, ()).distinct()
    return stage(words.withColumn("word_stem", F.regexp_replace("word", "^(.{3,}?)(ing|ed|s)$", "$1")), "stems")


@query(
    "stem_words_table",
    with_sql("SELECT review_id, CAST(pos AS INTEGER) AS pos, word, word_stem FROM kept JOIN stems USING (word)", "kept", extra=(_STEMS_SQL,)),
)
def _(spark, sf):
    rows = cleaning.token_rows(fx.docs(spark, sf, ())).where(~F.col("word").isin(fx.STOP))
    return cleaning.stem_words(rows, _stems(fx.docs(spark, sf)))


@query(
    "stem_words",
    with_sql("SELECT review_id, CAST(pos AS INTEGER) AS pos, word, word_stem FROM kept JOIN english USING (word)", "kept", extra=PORTER2_CTES),
)
def _(spark, sf):
    rows = cleaning.token_rows(fx.docs(spark, sf, ())).where(~F.col("word").isin(fx.STOP))
    return cleaning.stem_words(rows)


def _ngram_sql(rows: str) -> str:
    return with_sql(f"SELECT review_id, term, count(*) AS n FROM ({rows}) GROUP BY ALL", "pairs")


_UNI = "SELECT review_id, word AS term FROM pairs"
_BI = "SELECT review_id, word || ' ' || word2 AS term FROM pairs WHERE word2 IS NOT NULL"
_TRI = "SELECT review_id, word || ' ' || word2 || ' ' || word3 AS term FROM pairs WHERE word3 IS NOT NULL"


@query("ngrams", _ngram_sql(f"{_UNI} UNION ALL {_BI} UNION ALL {_TRI}"))
def _(spark, sf):
    return terms.ngram_counts(fx.docs(spark, sf), 3)


@query(
    "split_trim",
    with_sql(
        """SELECT review_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, trim(unnest(w)) AS word
        FROM (SELECT review_id, string_split(review_text, ' ') AS w FROM docs)""", "docs",
    ),
)
def _(spark, sf):
    return fx.documents(spark, sf).select("review_id", F.posexplode(tx.split_trim("review_text")).alias("pos", "word"))


@query(
    "label_from_name",
    """SELECT doc_id, regexp_replace('pred_' || source || '_pred_' || lang, 'pred_', '') AS model,
    concat_ws('_', 'tfidf', 'mix', source, lang, n_chars) AS file_name, string_split(concat_ws('_', 'tfidf', 'mix', source, lang), '_')[3] AS dataset
    FROM documents""",
)
def _(spark, sf):
    df = fx.table(spark, sf, "documents")
    name = F.concat(F.lit("pred_"), "source", F.lit("_pred_"), "lang")
    parts = (F.lit("tfidf"), F.lit("mix"), "source", "lang")
    return df.select(
        "doc_id",
        tx.label_from_name(name).alias("model"),
        tx.joined_name(*parts, "n_chars").alias("file_name"),
        tx.name_part(tx.joined_name(*parts), 2).alias("dataset"),
    )


@query(
    "clean_reviews_table",
    with_sql(
        """SELECT review_id, binary_rating, rating, string_agg(word_stem, ' ' ORDER BY pos) AS review_text
        FROM rkept JOIN stems USING (word) GROUP BY ALL""", "kept", "rkept", extra=(_STEMS_SQL,),
    ),
)
def _(spark, sf):
    cleaned = cleaning.clean_reviews(fx.reviews(spark, sf), fx.STOP, _stems(fx.docs(spark, sf)))
    return cleaned.drop("tokens")


@query(
    "clean_reviews_no_stem",
    with_sql(
        "SELECT review_id, binary_rating, rating, string_agg(word, ' ' ORDER BY pos) AS review_text FROM rkept GROUP BY ALL", "rkept",
    ),
)
def _(spark, sf):
    return cleaning.clean_reviews(fx.reviews(spark, sf), fx.stop_table(spark), stems=False).drop("tokens")


@query(
    "clean_reviews",
    with_sql("SELECT review_id, string_agg(word_stem, ' ' ORDER BY pos) AS review_text FROM kept JOIN english USING (word) GROUP BY review_id", "kept", extra=PORTER2_CTES),
)
def _(spark, sf):
    return cleaning.clean_reviews(fx.documents(spark, sf), fx.STOP, keys=["review_id"]).drop("tokens")


# --- tokens in long form ---
@query("word_order", with_sql("SELECT review_id, CAST(pos AS INTEGER) AS pos, word FROM kept", "kept"))
def _(spark, sf):
    rows = cleaning.token_rows(fx.docs(spark, sf, ()))
    return cleaning.remove_stopwords(rows, fx.stop_table(spark))


@query("order_tokens", with_sql("SELECT review_id, CAST(pos AS INTEGER) AS pos, word FROM tok ORDER BY review_id, pos", "tok"))
def _(spark, sf):
    return cleaning.order_tokens(cleaning.token_rows(fx.docs(spark, sf, ())))


@query("collapse_tokens", with_sql("SELECT review_id, string_agg(word, ' ' ORDER BY pos) AS review_text FROM kept GROUP BY review_id", "kept"))
def _(spark, sf):
    rows = cleaning.remove_stopwords(cleaning.token_rows(fx.docs(spark, sf, ())), fx.stop_table(spark))
    return cleaning.collapse_tokens(rows).drop("tokens")


# --- description ---
@query("word_count", with_sql("SELECT word, count(*) AS n FROM tok GROUP BY word ORDER BY n DESC", "tok"))
def _(spark, sf):
    return describe.word_count(fx.docs(spark, sf, ()))


@query("doc_term_count", with_sql("SELECT review_id, word, n FROM counts", "counts"))
def _(spark, sf):
    return terms.doc_term_count(fx.docs(spark, sf))


@query(
    "sentiment_word_count",
    with_sql(
        """SELECT word, sentiment, count(*) AS n FROM kept JOIN emotions USING (word) WHERE sentiment = 'negative'
        GROUP BY ALL ORDER BY n DESC""", "kept", "emotions",
    ),
)
def _(spark, sf):
    return describe.sentiment_word_count(fx.docs(spark, sf), fx.emotion_lexicon(spark), "negative")


@query("distinct_words_per_review", with_sql("SELECT review_id, count(*) AS n FROM counts GROUP BY review_id", "counts"))
def _(spark, sf):
    return describe.distinct_words_per_review(fx.docs(spark, sf, ()), fx.STOP)


@query(
    "distinct_words_summary",
    with_sql(
        """SELECT round(avg(n), 6) AS mean_n, quantile_cont(n, 0.5)::DOUBLE AS median_n
        FROM (SELECT review_id, count(*) AS n FROM counts GROUP BY review_id)""", "counts",
    ),
)
def _(spark, sf):
    return fx.round6(describe.distinct_words_summary(fx.docs(spark, sf, ()), fx.STOP), "mean_n")


@query("corpus_shape", with_sql("SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_cols FROM rtok", "rtok"))
def _(spark, sf):
    return describe.corpus_shape(cleaning.tokenized(fx.reviews(spark, sf)))


@query(
    "class_distribution",
    with_sql("SELECT rating, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6)::DOUBLE AS n_pp FROM stars GROUP BY rating", "stars"),
)
def _(spark, sf):
    return fx.round6(describe.class_distribution(fx.stars(spark, sf)), "n_pp")


@query(
    "share_of_total",
    """SELECT source, n, round(n / sum(n) OVER (), 6)::DOUBLE AS share FROM
    (SELECT source, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY source)""",
)
def _(spark, sf):
    sums = fx.table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return fx.round6(describe.share_of_total(sums, "n"), "share")


@query(
    "column_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(min({c}), 6)::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6)::DOUBLE AS q1,
        round(quantile_cont({c}, 0.5), 6)::DOUBLE AS median, round(quantile_cont({c}, 0.75), 6)::DOUBLE AS q3,
        round(max({c}), 6)::DOUBLE AS max, round(avg({c}), 6)::DOUBLE AS mean FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def _(spark, sf):
    df = describe.column_summary(fx.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return fx.round6(df, "min", "q1", "median", "q3", "max", "mean")


@query("top_terms", with_sql("SELECT word AS term, count(*) AS n FROM kept GROUP BY word ORDER BY n DESC, word LIMIT 20", "kept"))
def _(spark, sf):
    return describe.top_terms(terms.doc_term_count(fx.docs(spark, sf), word="term"), 20)


@query("frequent_terms", with_sql("SELECT word AS term, count(*) AS n FROM kept GROUP BY word HAVING count(*) >= 200", "kept"))
def _(spark, sf):
    return describe.top_terms(terms.doc_term_count(fx.docs(spark, sf), word="term"), None, 200)


@query(
    "row_and_column_totals",
    with_sql(
        """SELECT 'row' AS kind, review_id AS key, CAST(sum(n) AS BIGINT) AS total FROM grams GROUP BY ALL
        UNION ALL SELECT 'column', term, CAST(sum(n) AS BIGINT) FROM grams GROUP BY ALL""", "grams",
    ),
)
def _(spark, sf):
    rows, cols = describe.row_and_column_totals(fx.docs(spark, sf))
    named = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "total")
    return corpus.union_rows(named(rows, "row", "review_id"), named(cols, "column", "term"))


@query("document_frequency", with_sql("SELECT term, count(*) AS df FROM grams GROUP BY term", "grams"))
def _(spark, sf):
    return terms.document_frequency(terms.ngram_counts(fx.docs(spark, sf)))


@query(
    "stage_duration",
    """SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6)::DOUBLE AS duration FROM events GROUP BY user_id""",
)
def _(spark, sf):
    spans = fx.table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return fx.round6(stage_duration(spans).select("user_id", "duration"), "duration")
