import os

import pytest
from pyspark.sql import functions as F

from lexispark.operators import cleaning, runlog
from lexispark.session import drop_staged, new_folder, shared_folder, stage
from lexispark.sources import readers, writers
from lexispark.streaming import paged


def put(spark, name, text, file="part.txt"):
    path = new_folder(spark, name).removeprefix("file://")
    os.makedirs(path)
    with open(os.path.join(path, file), "w") as f:
        f.write(text)
    return "file://" + path


def test_tsv_keeps_quotes(spark):
    path = put(spark, "tsv", '1\tsay "hi\n0\tit\'s "bad"\n')
    rows = readers.read_tsv_noheader(spark, path, "rating INT, review_text STRING").collect()
    assert {(r[0], r[1]) for r in rows} == {(1, 'say "hi'), (0, 'it\'s "bad"')}


def test_csv_round_trip_of_awkward_text(spark):
    rows = [("1", 'a "quoted", line\nbreak'), ("2", " padded "), ("3", None), ("4", "back\\slash")]
    df = spark.createDataFrame(rows, "review_id STRING, review_text STRING")
    path = writers.write_csv(df, new_folder(spark, "csv"))
    back = readers.read_csv_header(spark, path, "review_id STRING, review_text STRING")
    assert {tuple(r) for r in back.collect()} == set(rows)


def test_word_vectors(spark):
    path = put(spark, "vectors", "2 3\ncat 1.5 NA -2\ndog 0 0.25 1e-3\n")
    rows = {r["word"]: r["vector"] for r in readers.read_word_vectors_text(spark, path, 3).collect()}
    assert rows == {"cat": [1.5, 0.0, -2.0], "dog": [0.0, 0.25, 0.001]}


def test_word_vectors_of_one_dimension_and_short_lines(spark):
    path = put(spark, "vectors", "3 1\ncat 1.5\ndog\nbird -2\n")
    rows = {r["word"]: r["vector"] for r in readers.read_word_vectors_text(spark, path, 1).collect()}
    assert rows == {"cat": [1.5], "dog": [0.0], "bird": [-2.0]}


def test_ndjson_fields(spark):
    path = put(spark, "json", '{"id": "x", "overall": 4.0, "other": 1}\n{"id": "y", "overall": 1.0}\n')
    df = readers.read_reviews_ndjson(spark, path, "id STRING, overall DOUBLE", {"id": "review_id", "overall": "rating"})
    assert df.columns == ["review_id", "rating"] and df.count() == 2


def test_feature_set_partitions_prune(spark):
    root = new_folder(spark, "features")
    df = spark.createDataFrame([("1", 0.5, "train"), ("2", 0.1, "test")], "review_id STRING, weight DOUBLE, type STRING")
    writers.write_feature_set(df, root, "tfidf", "mix", "d", 1000)
    writers.write_feature_set(df.drop("type"), root, "LSA", "mix", "d", 1000, type="train")
    got = readers.read_table(spark, root, technique="tfidf", type="test")
    assert [r["review_id"] for r in got.collect()] == ["2"]
    assert "PartitionFilters: [isnotnull(technique" in got._jdf.queryExecution().executedPlan().toString()
    assert readers.read_table(spark, root, technique="LSA").count() == 2


def test_boxed_run_logs_flatten(spark):
    # scalars as one-element arrays, results as arrays of records
    log = """{"file_path": {"technique": ["LDA"], "dataset": ["yelp"], "size": ["1e+05"]},
      "params_xg": {"eta": [0.1]}, "results": {"mix": [[{"model": "glmnet", "acc_max": 0.8}, {"model": "xgboost", "acc_max": 0.9}],
      [{"model": "glmnet", "auc": 0.85}, {"model": "xgboost", "auc": 0.95}]], "foldin": [[{"model": "glmnet", "acc_max": 0.5}], []]}}"""
    path = put(spark, "logs", log, "a.log")
    with open(os.path.join(path.removeprefix("file://"), "b.log"), "w") as f:
        f.write(log.replace("0.95", "0.75"))
    flat = runlog.flatten_results(readers.read_run_logs(spark, path))
    assert flat.count() == 10 and flat.first()["size"] == 100000
    means = runlog.mean_metric_by_group(flat)
    assert means.count() == 5
    curve = runlog.learning_curve(means).collect()
    assert [(r["dataset"], r["approach"], r["size"], round(r["value"], 6)) for r in curve] == [("yelp", "mix", 100000, 0.85)]


def test_fasttext_lines(spark):
    df = spark.createDataFrame([(5, "two\nlines\there")], "rating INT, review_text STRING")
    assert df.select(writers.fasttext_line()).first()[0] == "__label__5 two lines here"


def test_paged_stream_cleans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id as string) id", "text")
    source = new_folder(spark, "source")
    docs.repartition(5).write.json(source)
    pages = paged.review_pages(spark, source, "id STRING, text STRING", {"id": "review_id", "text": "review_text"}, 2)
    clean = lambda df: cleaning.clean_reviews(df, ["the", "of"], keys=["review_id"]).drop("tokens")
    out = new_folder(spark, "cleaned")
    paged.write_pages(pages, out, new_folder(spark, "progress"), clean)
    batch = clean(docs.selectExpr("id review_id", "text review_text"))
    assert spark.read.parquet(out).exceptAll(batch).count() == 0 and spark.read.parquet(out).count() == batch.count()


def test_stage_uses_the_named_folder(spark):
    df = stage(spark.range(3), "probe")
    assert df.inputFiles()[0].replace("file:///", "/").startswith(shared_folder(spark).removeprefix("file://"))
    assert df.count() == 3
    drop_staged(spark)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_durations(spark):
    df = spark.createDataFrame([("r", "dtm", "2017-01-01 00:00:00", "2017-01-01 00:00:01.5")], "run STRING, stage STRING, s STRING, e STRING")
    stages = df.select("run", "stage", F.to_timestamp("s").alias("start"), F.to_timestamp("e").alias("end"))
    assert runlog.stage_duration(stages).first()["duration"] == 1.5
    nested = runlog.nest_computation_time(stages, ["run"]).first()["computation_time"]
    assert nested["dtm"]["duration"] == 1.5
