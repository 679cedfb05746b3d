"""Corpus description: counts, shares and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.text import drop_words, ngrams, where_computed
from lexispark.operators.cleaning import words_of
from lexispark.operators.ranking import exact_quantiles, quantiles_of_counts
from lexispark.session import stage

FIVE_NUMBERS = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def word_count(docs: DataFrame) -> DataFrame:
    """Occurrences per word over the corpus, most frequent first."""
    return words_of(docs, ()).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word")


def sentiment_word_count(docs: DataFrame, lexicon: DataFrame, sentiment: str) -> DataFrame:
    """Occurrences of the lexicon's words of one sentiment.

    The words are counted before the join, which then sees the vocabulary instead of the text.
    """
    counts = words_of(docs, ()).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    wanted = lexicon.where(F.col("sentiment") == sentiment).select("word", "sentiment")
    found = counts.join(wanted, "word").groupBy("word", "sentiment").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "word")


def distinct_words_per_review(docs: DataFrame, stopwords=()) -> DataFrame:
    """Distinct words per review (reviews without any drop out)."""
    n = F.size(F.array_distinct(drop_words("tokens", stopwords)))
    return where_computed(docs.select("review_id", n.cast("long").alias("n")), F.col("n") > 0)


def distinct_words_summary(docs: DataFrame, stopwords=()) -> DataFrame:
    """Mean and median of `distinct_words_per_review`."""
    per_review = distinct_words_per_review(docs, stopwords)
    # one row per distinct count, so the text is read once for both figures
    merged = stage(per_review.groupBy("n").agg(F.count(F.lit(1)).alias("rows")), "distinct-words")
    mean = merged.agg(F.try_divide(F.sum(F.col("n") * F.col("rows")), F.sum("rows")).alias("m"))
    return quantiles_of_counts(merged, "n", {"median_n": 0.5}).select(
        mean.scalar().cast("double").alias("mean_n"), "median_n"
    )


def corpus_shape(docs: DataFrame) -> DataFrame:
    """Rows and columns of the tidy token table."""
    columns = len([c for c in docs.columns if c != "review_text"])  # the word replaces the text
    return docs.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("n_rows")).withColumn(
        "n_cols", F.lit(columns).cast("long")
    )


def share_of_total(df: DataFrame, col: str, name: str = "share") -> DataFrame:
    """Value over the overall sum, for small aggregated tables."""
    return df.withColumn(name, F.col(col) / F.nullif(F.sum(col).over(Window.partitionBy()), F.lit(0)))


def class_distribution(df: DataFrame, col: str = "rating") -> DataFrame:
    """Count and percentage per class."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return share_of_total(counts, "n", "n_pp").withColumn("n_pp", F.col("n_pp") * 100)


def boxplot_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Five-number summary per group, from exact interpolated quantiles."""
    return exact_quantiles(df, value, FIVE_NUMBERS, [by]).drop("n")


def column_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Minimum, quartiles, mean and maximum of numeric columns, one row per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    long = df.select(F.inline(pairs)).where("value is not null")
    means = long.groupBy("column").agg(F.avg("value").alias("mean"))
    return exact_quantiles(long, "value", FIVE_NUMBERS, ["column"]).join(means, "column").drop("n")


def row_and_column_totals(docs: DataFrame, n_max: int = 2, sep: str = " ") -> tuple[DataFrame, DataFrame]:
    """(review_id, total) and (term, total) of the document-term matrix of n-grams, both largest first.

    Totals need no counts per document: each n-gram counts once. A NULL term per document carries the document's own total
    through the same aggregation, so the text is read once for both.
    """
    marked = docs.select("review_id", F.concat(ngrams("tokens", 1, n_max, sep), F.array(F.lit(None).cast("string"))).alias("_terms"))
    long = marked.select("review_id", F.size("_terms").alias("_size"), F.explode_outer("_terms").alias("term"))
    is_row = F.col("term").isNull()
    n = F.when(is_row, F.greatest(F.col("_size") - 1, F.lit(0))).otherwise(1).cast("long")
    keyed = long.select(is_row.alias("is_row"), F.when(is_row, F.col("review_id").cast("string")).otherwise(F.col("term")).alias("key"), n.alias("n"))
    totals = stage(keyed.groupBy("is_row", "key").agg(F.sum("n").alias("total")).where("total > 0"), "matrix-totals")
    part = lambda kind, key, dtype: totals.where(kind).select(F.col("key").cast(dtype).alias(key), "total").orderBy(F.desc("total"), key)
    return part("is_row", "review_id", docs.schema["review_id"].dataType), part("not is_row", "term", "string")


def top_terms(term_counts: DataFrame, k: int | None = 20, min_freq: int | None = None) -> DataFrame:
    """The k most frequent terms, or all with at least `min_freq` occurrences."""
    totals = term_counts.groupBy("term").agg(F.sum("n").alias("n"))
    if min_freq is not None:
        totals = totals.where(F.col("n") >= min_freq)
    totals = totals.orderBy(F.desc("n"), "term")
    return totals.limit(k) if k is not None else totals


def normalize_by(df: DataFrame, value: str, by: str, name: str) -> DataFrame:
    """Value over its group's sum; groups that sum to zero stay zero."""
    total: Column = F.sum(value).over(Window.partitionBy(by))
    return df.withColumn(name, F.coalesce(F.col(value) / F.nullif(total, F.lit(0)), F.lit(0.0)))
