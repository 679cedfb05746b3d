"""Sinks. Every one is a distributed write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import joined_name, squeeze_breaks

FEATURE_SET = ("technique", "approach", "dataset", "type", "size")


def write_feature_set(
    df: DataFrame, root: str, technique: str, approach: str, dataset: str, size: int, type: str | None = None
) -> str:
    """Parquet below root/technique=/approach=/dataset=/type=/size=.

    `type` may be left to the rows' own column. Values take the place of the usual file-name parts.
    """
    tagged = df if type is None else df.withColumn("type", F.lit(type))
    tagged = tagged.withColumns(
        {"technique": F.lit(technique), "approach": F.lit(approach), "dataset": F.lit(dataset), "size": F.lit(size).cast("long")}
    )
    tagged.write.mode("append").partitionBy(*FEATURE_SET).parquet(root)
    return root


def log_name(technique, dataset, size, at: Column | None = None) -> Column:
    """`<date>_<technique>_<dataset>_<size>.log`, the date without colons."""
    at = F.current_timestamp() if at is None else at
    return F.concat(joined_name(F.date_format(at, "yyyy-MM-dd'T'HHmmss"), technique, dataset, size), F.lit(".log"))


def write_run_log(logs: DataFrame, root: str, name: Column) -> str:
    """One pretty JSON document per log, in a folder `log_name=<name>`."""
    document = F.to_json(F.struct(*logs.columns), {"pretty": "true"})
    logs.select(name.alias("log_name"), document.alias("value")).write.mode("append").partitionBy("log_name").text(root)
    return root


def fasttext_line(rating: str = "rating", text: str = "review_text") -> Column:
    """`__label__<rating> <text>` on one line."""
    return F.concat(F.lit("__label__"), F.col(rating).cast("string"), F.lit(" "), squeeze_breaks(text))


def write_fasttext(df: DataFrame, path: str, rating: str = "rating", text: str = "review_text") -> str:
    df.select(fasttext_line(rating, text).alias("value")).write.text(path)
    return path


def write_corpus_text(docs: DataFrame, path: str) -> str:
    """One cleaned review per line."""
    docs.select(F.array_join("tokens", " ").alias("value")).write.text(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path
