"""Readers. Schemas are fixed; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.operators.runlog import RUN_LOG_SCHEMA
from lexispark.sources.csvrecords import csv_records

REVIEW_SCHEMA = "review_id STRING, rating DOUBLE, binary_rating INT, review_text STRING"


def read_reviews_ndjson(spark: SparkSession, path: str, schema: str, mapping: dict[str, str]) -> DataFrame:
    """Newline-delimited JSON; only the mapped fields (old -> new name) are parsed into columns."""
    raw = spark.read.schema(schema).json(path)
    return raw.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def read_tsv_noheader(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated values without header or quoting."""
    return spark.read.schema(schema).csv(path, sep="\t", header=False, quote="", escape="")


def read_csv_header(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """CSV with header. Quoted fields may span lines, and a large file is still read by a task for each of its splits (see `csvrecords`).

    `multi_line=False`, for files where no field contains a line break, saves the pass over the quotes.
    """
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if not multi_line:
        return spark.read.schema(schema).csv(path, header=True, multiLine=False, **options)
    parsed = csv_records(spark, path).select(F.from_csv("record", schema, {**options, "multiLine": "true"}).alias("row"))
    return parsed.select("row.*")


def read_table(spark: SparkSession, root: str, **partition_values) -> DataFrame:
    """A stored feature set; the given partition values (technique, approach, dataset, type, size) prune the scan."""
    df = spark.read.parquet(root)
    for name, value in partition_values.items():
        df = df.where(F.col(name) == value)
    return df


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """All run logs below a folder, one JSON document per file, with the file's path."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    parsed = text.select(F.from_json("value", RUN_LOG_SCHEMA).alias("log"), F.col("_metadata.file_path").alias("file"))
    return parsed.select("log.*", "file")


def read_word_vectors_text(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Space-separated `word v1 .. vn` lines; the first line of a file is its header, missing numbers are 0."""
    # a separator that no line has: the CSV reader skips the first line of each file and splits nothing
    lines = spark.read.schema("value STRING").csv(path, header=True, sep="\u0001", quote="", enforceSchema=True)
    parts = lines.select(F.split("value", " ").alias("p"))
    numbers = F.transform(
        F.sequence(F.lit(1), F.lit(dim)), lambda i: F.coalesce(F.get("p", i).try_cast("double"), F.lit(0.0))
    )
    return parts.select(F.get("p", F.lit(0)).alias("word"), numbers.alias("vector"))


def read_cluster_csv(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """`word_no, word, cluster` from a CSV (word_no, cluster) and the numbered word list."""
    clusters = spark.read.schema("word_no BIGINT, cluster INT").csv(path, header=True)
    return clusters.join(words.select("word_no", "word"), "word_no").select("word_no", "word", "cluster")
