"""Paged reading and streaming use of the row-local operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def review_pages(
    spark: SparkSession, path: str, schema: str, mapping: dict[str, str], files_per_page: int = 1
) -> DataFrame:
    """Newline-delimited JSON as a stream that takes a bounded number of files per micro-batch."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_page).json(path)
    return raw.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def write_pages(pages: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Run all available pages through `prepare` (cleaning, fold-in scoring: projections) into Parquet.

    The checkpoint makes the write exactly-once over restarts.
    """
    prepared = pages if prepare is None else prepare(pages)
    query = (
        prepared.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
