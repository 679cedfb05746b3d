"""Lexicon look-ups and scores. Lexicons are tables the caller gives; Spark broadcasts them by their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.assessment import confusion_matrix
from lexispark.operators.cleaning import clean_reviews, words_of
from lexispark.session import stage

EMOTIONS = ("anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust")
POLARITIES = ("negative", "positive")


def lexicon_lookup(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Long-form tokens with the lexicon's columns; a word listed twice gives two rows."""
    return tokens.join(lexicon, "word")


def afinn_score(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean score over a review's matched tokens; reviews without a match drop out."""
    return lexicon_lookup(words_of(docs), lexicon).groupBy("review_id").agg(F.avg("afinn_score").alias("afinn_score"))


def nrc_emotions(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Counts of 8 emotions and 2 polarities per review, their sum and the valence.

    Reviews without a hit stay, through the outer explode and the left join.
    """
    words = docs.select("review_id", F.explode_outer("tokens").alias("word"))
    hits = words.join(lexicon.select("word", "sentiment"), "word", "left")
    names = (*EMOTIONS, *POLARITIES)
    counts = hits.groupBy("review_id").agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in names])
    return counts.withColumn("count", sum((F.col(s) for s in names), F.lit(0))).withColumn(
        "valence", F.col("positive") - F.col("negative")
    )


def emotion_shares(nrc: DataFrame) -> DataFrame:
    """Share of every emotion among all emotion hits, smallest first."""
    sums = nrc.agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(e) for e in EMOTIONS])
    total = sum((F.col(e) for e in EMOTIONS), F.lit(0))
    shares = F.array(*[F.struct(F.lit(e).alias("emotion"), F.try_divide(F.col(e), total).alias("share")) for e in EMOTIONS])
    return sums.select(F.inline(shares)).orderBy("share", "emotion")


def threshold_at_mean(df: DataFrame, col: str, name: str = "predicted") -> DataFrame:
    """1 where the score is above the mean over all scored rows (a one-value subquery), else 0.

    The input is read twice: give it a stored table where scores cost more than reading them.
    """
    mean = df.agg(F.avg(col)).scalar()
    return df.withColumn(name, (F.col(col) > mean).cast("int"))


def afinn_classifier(reviews: DataFrame, lexicon: DataFrame, stopwords=None) -> DataFrame:
    """`review_id, rating, binary_rating, afinn_score, predicted` for every scored review."""
    keys = ["review_id", "rating", "binary_rating"]
    words = words_of(clean_reviews(reviews, stopwords, stems=False), keys)
    scored = lexicon_lookup(words, lexicon).groupBy(*keys).agg(F.avg("afinn_score").alias("afinn_score"))
    return threshold_at_mean(stage(scored, "afinn-scores"), "afinn_score")


def afinn_confusion(classified: DataFrame) -> DataFrame:
    return confusion_matrix(classified, "predicted", "binary_rating")
