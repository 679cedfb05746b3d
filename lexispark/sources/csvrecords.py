"""Records of CSV files whose quoted fields may span lines, read by as many tasks as a file has splits.

A line starts a record where the number of quotes before it in its file is even. A first pass counts the quotes of each split; their running sum
says whether a split begins inside a quoted field. A second pass joins the lines to records; only records that cross the end of a split
are shuffled, as fragments. No text is held beyond one record. There is one row for each split, as many as Spark's own plan of the scan has.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.session import stage

RECORDS = "file STRING, origin BIGINT, split BIGINT, header BOOLEAN, whole BOOLEAN, record STRING"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """`file, split, value`: the lines, those of a split in their order."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The stretches of a batch that come from one split."""
    files, splits = batch.column("file").to_pylist(), batch.column("split").to_pylist()
    start = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or (files[i], splits[i]) != (files[start], splits[start]):
            yield (files[start], splits[start]), batch.slice(start, i - start)
            start = i


def _odd_lines(values: pa.Array) -> list[int]:
    return pc.bit_wise_and(pc.count_substring(values, '"'), 1).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`file, split, odd, even_starts, odd_starts`: parity of a split's quotes, and its records if it begins outside or inside a quoted field."""
    found: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for key, run in _runs(batch):
            state = found.setdefault(key, [0, 0, 0])
            for odd in _odd_lines(run.column("value")):
                state[1 + state[0]] += 1  # a start if the quotes before the split are of the same parity
                state[0] ^= odd
    rows = [(file, split, *state) for (file, split), state in found.items()]
    columns = list(zip(*rows)) or [()] * 5
    kinds = [pa.string(), *[pa.int64()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["file", "split", "odd", "even_starts", "odd_starts"])


def _splits(lines: DataFrame) -> DataFrame:
    """`file, split, inside, origin`: whether a split begins inside a quoted field, and the split where that field's record starts."""
    counted = stage(lines.mapInArrow(_count, "file STRING, split BIGINT, odd BIGINT, even_starts BIGINT, odd_starts BIGINT"), "csv-splits")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    parity = counted.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    starting = F.when(F.when(F.col("inside") == 0, F.col("even_starts")).otherwise(F.col("odd_starts")) > 0, F.col("split"))
    return stage(parity.select("file", "split", "inside", F.last(starting, ignorenulls=True).over(earlier).alias("origin")), "csv-origins")


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and, at the ends of a split, fragments of records."""
    key, inside, origin, header, held, out = None, 0, 0, False, [], []

    def close(whole: bool) -> None:
        nonlocal held, origin, header
        if held:
            out.append((key[0], origin, key[1], header, whole and origin == key[1], "\n".join(held)))
            held, origin, header = [], key[1], False

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["file", "origin", "split", "header", "whole", "record"])

    for batch in batches:
        for own, run in _runs(batch):
            if own != key:
                close(whole=False)
                key, inside = own, run.column("inside")[0].as_py()
                # lines before the first start belong to a record of an earlier split; a file's first record is its header
                origin, header = (run.column("origin")[0].as_py(), False) if inside else (own[1], own[1] == 0)
            for line, odd in zip(run.column("value").to_pylist(), _odd_lines(run.column("value"))):
                held.append(line)
                inside ^= odd
                if not inside:
                    close(whole=True)
        if out:
            yield batch_of(out)
            out = []
    close(whole=False)
    if out:
        yield batch_of(out)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """`file, record`: the records below `path` without each file's header line, each with the line breaks of its quoted fields.

    Quotes are doubled inside quoted fields and stand nowhere else. A file whose last quote is missing ends in one long record. Lines end in
    `\\n` or `\\r\\n`; empty lines are left out.
    """
    lines = _lines(spark, path)
    # one row for each split of the scan; broadcast, so that the lines stay in order
    placed = lines.join(F.broadcast(_splits(lines)), ["file", "split"]).select("file", "split", "value", "inside", "origin")
    found = stage(placed.mapInArrow(_join_lines, RECORDS), "csv-records")
    pieces = F.sort_array(F.collect_list(F.struct("split", "record")))
    crossing = found.where("NOT whole").groupBy("file", "origin").agg(F.bool_or("header").alias("header"), F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"))
    columns = ["file", "header", "record"]
    records = found.where("whole").select(columns).unionByName(crossing.select(columns)).where("NOT header")
    return records.select("file", F.regexp_replace("record", "\r\\z", "").alias("record")).where("record != ''")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
