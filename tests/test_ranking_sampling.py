import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.operators import corpus, describe, ranking, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; one class holds most rows."""
    rng = random.Random(5)
    rows = [(str(i), "hot" if i % 10 else "rare", 0.25 if i % 3 == 0 else rng.random()) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "review_id STRING, label STRING, value DOUBLE").repartition(6)


def test_running_totals(skewed):
    rows, df = skewed
    merged = df.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))
    got = {(r["label"], r["value"]): (r["cum_n"], r["total_n"]) for r in ranking.running_totals(merged, ["value"], ["n"], ["label"]).collect()}
    for label in ("hot", "rare"):
        values = sorted(v for _, l, v in rows if l == label)
        for v in set(values):
            assert got[(label, v)] == (sum(x <= v for x in values), len(values))


def test_running_totals_with_null_group(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("a", 1.0, 5)], "g STRING, v DOUBLE, n LONG")
    rows = ranking.running_totals(df, ["v"], ["n"], ["g"]).collect()
    assert {(r["g"], r["v"], r["cum_n"], r["total_n"]) for r in rows} == {(None, 1.0, 2, 5), (None, 2.0, 5, 5), ("a", 1.0, 5, 5)}


def test_exact_quantiles(skewed):
    rows, df = skewed
    got = {r["label"]: r for r in describe.boxplot_stats(df, "value", "label").collect()}
    for label in ("hot", "rare"):
        want = np.percentile([v for _, l, v in rows if l == label], [0, 25, 50, 75, 100])
        assert np.allclose([got[label][c] for c in ("min", "q1", "median", "q3", "max")], want)


def test_row_ids_are_dense_and_ordered(skewed):
    rows, df = skewed
    out = ranking.assign_row_id(df.drop("review_id"), ["value"], "id").collect()
    assert sorted(r["id"] for r in out) == list(range(1, len(rows) + 1))
    assert [r["value"] for r in sorted(out, key=lambda r: r["id"])] == sorted(v for _, _, v in rows)


def test_dedup_first_of_a_hot_text(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("review_text"))
    out = ranking.dedup_first(df, "review_text", ["id"])
    assert out.count() == 2001 and out.where("review_text = 'copy'").first()["id"] == 0
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def md5_order(ids):
    return sorted(ids, key=lambda i: (hashlib.md5(f"42-{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [0, 1, 777, 3000, 5000])
def test_sample_n(skewed, n):
    rows, df = skewed
    got = {r["review_id"] for r in sampling.sample_n(df, n).collect()}
    assert got == set(md5_order(r[0] for r in rows)[:n])


def test_balanced_sample(skewed):
    rows, df = skewed
    for n in (250, 400):  # 300 rare rows
        got = {r["review_id"] for r in sampling.balanced_sample(df, "label", n).collect()}
        want = {i for l in ("hot", "rare") for i in md5_order(r[0] for r in rows if r[1] == l)[:n]}
        assert got == want


def test_stratified_split(skewed):
    rows, df = skewed
    out = sampling.stratified_split(df, "label", 0.21)
    counts = {(r["label"], r["type"]): r["n"] for r in out.groupBy("label", "type").agg(F.count(F.lit(1)).alias("n")).collect()}
    for label in ("hot", "rare"):
        total = sum(r[1] == label for r in rows)
        assert counts[(label, "test")] == math.ceil(0.21 * total)
        assert counts[(label, "train")] == total - math.ceil(0.21 * total)


def test_splits_are_reproducible_and_whole(skewed):
    rows, df = skewed
    a = {(r["review_id"], r["type"]) for r in sampling.fraction_split(df, 0.8).collect()}
    b = {(r["review_id"], r["type"]) for r in sampling.fraction_split(df.repartition(3), 0.8).collect()}
    assert a == b and len(a) == len(rows)
    assert 0.77 < sum(t == "train" for _, t in a) / len(a) < 0.83
    assert sampling.holdout_split_n(df, 500).where("type = 'test'").count() == 500


def test_folds_keep_class_shares(skewed):
    _, df = skewed
    sizes = sampling.assign_folds(df, "label", 5).groupBy("label", "fold").count().collect()
    assert len(sizes) == 10
    for label, share in (("hot", 540), ("rare", 60)):
        assert all(r["count"] == share for r in sizes if r["label"] == label)


def test_texts_are_told_apart_by_digests(spark):
    long = "x" * 100000
    rows = [(1, None, "a"), (2, "", "b"), (3, None, "c"), (4, "", "d"), (5, long, "e"), (6, long + "y", "f"), (7, long, "g"), (8, " ", "h")]
    df = spark.createDataFrame(rows, "id LONG, review_text STRING, other STRING").repartition(3)
    first = ranking.dedup_first(df, "review_text", ["id"])
    assert first.columns == df.columns and sorted(r["id"] for r in first.collect()) == [1, 2, 5, 6, 8]
    assert sorted(len(r["review_text"] or "-") for r in corpus.distinct_texts(df).collect()) == [1, 1, 1, 100000, 100001]
    assert corpus.distinct_texts(df.limit(0)).count() == 0 and ranking.dedup_first(df, "id", ["other"]).count() == 8
