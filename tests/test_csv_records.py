"""CSV files cut into splits give the rows of the one-task reader."""

import random

import pytest

from lexispark.sources import readers
from lexispark.sources.csvrecords import _lines

SCHEMA = "review_id STRING, rating DOUBLE, review_text STRING"


def _one_task(spark, path):
    return spark.read.schema(SCHEMA).csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _field(text):
    return '"' + text.replace('"', '""') + '"'


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def small_splits(spark):
    before = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(name, str(n)) for name, n in zip(before, (size, 0))]
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("size", [16, 1000, 1 << 20])
def test_same_rows_for_any_splits(spark, small_splits, tmp_path, size):
    rng = random.Random(size)
    parts = ["a", "é", '"', '""', "\n", "\n\n", ",", " ", "word", "\t", '",\n"', "x" * 40]
    for name in ("one", "two"):
        rows = [f"{name}{i},{i / 4},{_field(''.join(rng.choices(parts, k=rng.randrange(12))))}" for i in range(15 if size < 100 else 60)]
        rows += ["plain,1.5,no quotes", "", "short", f'{_field("id" + chr(10) + "2")},,""']
        (tmp_path / f"{name}.csv").write_text('review_id,rating,"review\ntext"\n' + "\n".join(rows) + ("\n" if name == "one" else ""))
    want = _rows(_one_task(spark, str(tmp_path)))
    small_splits(size)
    assert _rows(readers.read_csv_header(spark, str(tmp_path), SCHEMA)) == want


def test_large_file_is_read_by_several_tasks(spark, small_splits, tmp_path):
    text = "one line\nanother " * 20
    (tmp_path / "a.csv").write_text("review_id,rating,review_text\n" + "".join(f"{i},2,{_field(text)}\n" for i in range(2000)))
    small_splits(50_000)
    assert _lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    back = readers.read_csv_header(spark, str(tmp_path), SCHEMA)
    assert back.count() == 2000 and back.where("review_text = " + repr(text)).count() == 2000


def test_a_record_over_many_splits_and_windows_breaks(spark, small_splits, tmp_path):
    long = "\r\n".join(["line"] * 500)
    (tmp_path / "a.csv").write_bytes(f"review_id,rating,review_text\r\n1,1,{_field(long)}\r\n2,2,b\r\n".encode())
    small_splits(100)
    assert _rows(readers.read_csv_header(spark, str(tmp_path), SCHEMA)) == [("1", 1.0, long), ("2", 2.0, "b")]


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("review_id,rating,review_text\n")
    assert readers.read_csv_header(spark, str(tmp_path), SCHEMA).count() == 0
    assert readers.read_csv_header(spark, str(tmp_path / "b.csv"), SCHEMA).count() == 0
