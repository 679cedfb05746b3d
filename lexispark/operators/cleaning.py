"""Tokenising and cleaning of reviews.

Reviews carry `review_id`, `review_text` and any other columns; tokenised reviews add `tokens ARRAY<STRING>`.
The array form stays in the review's own row, so cleaning is a projection. The long form has one
row per token: `review_id, pos, word`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.functions.stem import stem_tokens, stem_word
from lexispark.operators.joins import frequency_join
from lexispark.session import stage

StopWords = Iterable[str] | DataFrame | None

# stop lists up to this many words become a literal set; longer ones are joined
MAX_LITERAL_WORDS = 20_000


def literal_words(stopwords: StopWords) -> list[str] | None:
    """The stop list as literals, or None when it is a table too long for that."""
    if stopwords is None:
        return []
    if not isinstance(stopwords, DataFrame):
        return sorted(set(stopwords))
    rows = stopwords.select("word").where("word is not null").distinct().limit(MAX_LITERAL_WORDS + 1).collect()
    return sorted(r["word"] for r in rows) if len(rows) <= MAX_LITERAL_WORDS else None


def tokenized(reviews: DataFrame, stopwords: Iterable[str] = (), lower: bool = True, text: str = "review_text") -> DataFrame:
    """Adds `tokens`, without the literal stop words."""
    return reviews.withColumn("tokens", tx.drop_words(tx.tokenize_words(text, lower), stopwords))


def stripped_tokens(reviews: DataFrame, stopwords: Iterable[str] = tx.PRONOUNS) -> DataFrame:
    """Adds `tokens`: the lower-cased text without punctuation, split at whitespace, without the stop words."""
    words = F.filter(F.split(F.coalesce(tx.strip_punct_lower("review_text"), F.lit("")), r"\s+"), lambda w: w != "")
    return reviews.withColumn("tokens", tx.drop_words(words, stopwords))


# The long forms use outer generators and drop the NULL row of empty reviews: for an inner one Spark
# infers a `size(tokens) > 0` filter and pushes it below the tokenizer, which would then run twice.


def words_of(docs: DataFrame, keep: Iterable[str] = ("review_id",)) -> DataFrame:
    """One row per token: `keep, word`."""
    return docs.select(*keep, F.explode_outer("tokens").alias("word")).where("word is not null")


def token_rows(docs: DataFrame, keep: Iterable[str] = ("review_id",)) -> DataFrame:
    """Tidy form: one row per token with its 1-based position in the review."""
    rows = docs.select(*keep, F.posexplode_outer("tokens").alias("_at", "word")).where("word is not null")
    return rows.select(*keep, (F.col("_at") + 1).alias("pos"), "word")


def remove_stopwords(tokens: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Long-form tokens without the listed words; the gaps in `pos` stay."""
    return tokens.join(stopwords.select("word"), "word", "left_anti").select(*tokens.columns)


def order_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.orderBy("review_id", "pos")


def collapse_tokens(tokens: DataFrame, by: Iterable[str] = ("review_id",), word: str = "word") -> DataFrame:
    """Tokens of a review joined by one space, in order of `pos` (a group is one document)."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.col(word).alias("word"))))
    return tokens.groupBy(*by).agg(F.transform(ordered, lambda x: x["word"]).alias("tokens")).select(
        *by, "tokens", F.array_join("tokens", " ").alias("review_text")
    )


def stem_words(tokens: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """Adds `word_stem` to long-form tokens, from a (word, word_stem) table where one is given.

    Words the table does not know stay as they are. Without a table each distinct word is stemmed once, which makes one.
    """
    if stems is None:
        words = tokens.select("word").where("word is not null").distinct()
        stems = stage(words.withColumn("word_stem", stem_word("word")), "stems")
    joined = frequency_join(tokens, stems.select("word", "word_stem"), "word", "left")
    return joined.select(*tokens.columns, F.coalesce("word_stem", "word").alias("word_stem"))


def clean_reviews(
    reviews: DataFrame,
    stopwords: StopWords = None,
    stems: DataFrame | bool | None = None,
    keys: Iterable[str] = ("review_id", "binary_rating", "rating"),
) -> DataFrame:
    """Cleaned reviews: `keys, tokens, review_text`. Reviews left without a token disappear.

    `stems`: None uses the built-in stemmer, False keeps the words (for lexicon look-ups),
    a table (word, word_stem) is joined. Each input row stays a review of its own, also where ids repeat, however
    long the stop list is. The usual `.` and `-` replacements are implied: neither
    character can be part of a token.
    """
    keys = list(keys)
    words = literal_words(stopwords)
    if words is not None and not isinstance(stems, DataFrame):
        docs = tx.where_computed(tokenized(reviews, words).select(*keys, "tokens"), F.size("tokens") > 0)
        if stems is not False:
            docs = docs.withColumn("tokens", stem_tokens("tokens"))
        return docs.withColumn("review_text", F.array_join("tokens", " "))
    # a row number fixed by writing it keeps rows with equal keys apart
    numbered = tokenized(reviews, words or ()).select(*keys, "tokens", F.monotonically_increasing_id().alias("_row"))
    rows, by = token_rows(stage(numbered, "numbered-reviews"), [*keys, "_row"]), [*keys, "_row"]
    if words is None:
        rows = remove_stopwords(rows, stopwords)
    if stems is False:
        return collapse_tokens(rows, by).drop("_row")
    return collapse_tokens(stem_words(rows, stems if isinstance(stems, DataFrame) else None), by, "word_stem").drop("_row")


def clean_corpus_tm(
    reviews: DataFrame, stopwords: Iterable[str], stems: DataFrame | bool | None = None, keep: Iterable[str] = ("review_id",)
) -> DataFrame:
    """The older cleaning chain: hyphens to spaces, all punctuation deleted (so `don't` gives `dont`),

    whitespace squeezed, stop words removed, words stemmed. Every review stays, empty or not.
    """
    keep = list(keep)
    bare = F.regexp_replace(tx.hyphen_to_space(F.lower("review_text")), r"[\p{P}\p{S}]", "")
    words = F.filter(F.split(F.coalesce(bare, F.lit("")), r"\s+"), lambda w: w != "")
    docs = reviews.select(*keep, tx.drop_words(words, stopwords).alias("tokens"))
    if isinstance(stems, DataFrame):
        numbered = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-reviews")
        rows = numbered.select(*keep, "_row", F.posexplode_outer("tokens").alias("pos", "word"))
        # an outer row without a word stands for an empty review
        out = collapse_tokens(stem_words(rows, stems), [*keep, "_row"], "word_stem").drop("_row")
        return out.withColumn("tokens", F.filter("tokens", lambda w: w.isNotNull()))
    if stems is not False:
        docs = docs.withColumn("tokens", stem_tokens("tokens"))
    return docs.withColumn("review_text", F.array_join("tokens", " "))


def filter_short_reviews(df: DataFrame, max_chars: int = 144) -> DataFrame:
    return df.where(F.length("review_text") <= max_chars)
