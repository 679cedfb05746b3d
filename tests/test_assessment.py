import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from lexispark.operators import assessment as ass
from lexispark.operators import lexicon

SCHEMA = "review_id STRING, model STRING, prob DOUBLE, actual INT"


@pytest.fixture(scope="module")
def pred(spark):
    rng = random.Random(3)
    rows = [(str(i), m, rng.choice([0.0, 0.07, 0.5, 0.57, 1.0, round(rng.random(), 3)]), rng.randrange(2)) for i in range(400) for m in ("a", "b")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_sweep_is_strict_on_both_sides(pred):
    rows, df = pred
    sweep = {(r["model"], round(r["cut"] * 100)): r for r in ass.threshold_sweep(df).collect()}
    assert len(sweep) == 202
    for model in ("a", "b"):
        mine = [(p, y) for _, m, p, y in rows if m == model]
        pos, neg = sum(y for _, y in mine), sum(1 - y for _, y in mine)
        for i in range(101):
            c = i / 100
            tp, tn = sum(p > c and y for p, y in mine), sum(p < c and not y for p, y in mine)
            r = sweep[(model, i)]
            assert math.isclose(r["sens"], tp / pos) and math.isclose(r["spec"], tn / neg)
            assert math.isclose(r["acc"], (tp + tn) / len(mine))


def test_accuracy_by_cut_and_best_cut(pred):
    rows, df = pred
    got = {(r["model"], round(r["cut"] * 99)): r["acc"] for r in ass.accuracy_by_cut(df).collect()}
    assert len(got) == 200
    for (model, i), acc in got.items():
        mine = [(p, y) for _, m, p, y in rows if m == model]
        assert math.isclose(acc, sum((p > i / 99) == bool(y) for p, y in mine) / len(mine))
    best = ass.best_cut(ass.accuracy_by_cut(df)).collect()
    assert {(r["model"], r["acc"]) for r in best} == {(m, max(a for (k, _), a in got.items() if k == m)) for m in "ab"}
    applied = ass.apply_best_cut(df, df).collect()
    assert len(applied) == 2 and all(r["acc_train"] == r["acc_test"] for r in applied)


def test_auc_counts_pairs(pred):
    rows, df = pred
    got = {r["model"]: r for r in ass.auc(df).collect()}
    for model in ("a", "b"):
        pos = [p for _, m, p, y in rows if m == model and y]
        neg = [p for _, m, p, y in rows if m == model and not y]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert math.isclose(got[model]["auc"], want)
        assert got[model]["auc_symmetric"] == max(got[model]["auc"], 1 - got[model]["auc"])
        one = df.where(F.col("model") == model).withColumn("label", F.col("actual").cast("double"))
        spark_auc = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", numBins=0).evaluate(one)
        assert math.isclose(want, spark_auc, rel_tol=1e-9)


def test_hard_auc_is_auc_of_rounded_scores(pred):
    _, df = pred
    rounded = df.withColumn("prob", F.bround("prob", 0))
    hard = {r["model"]: r["auc"] for r in ass.hard_auc(df).collect()}
    full = {r["model"]: r["auc"] for r in ass.auc(rounded).collect()}
    assert all(math.isclose(hard[m], full[m]) for m in "ab")


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([("1", "a", 0.3, 1), ("2", "a", 0.9, 1)], SCHEMA)
    assert ass.auc(df).first()["auc"] is None and ass.hard_auc(df).first()["auc"] is None
    row = ass.threshold_sweep(df).where("cut = 0.5").first()
    assert row["spec"] is None and row["sens"] == 0.5 and row["acc"] == 0.5


def test_confusion_matrix(spark):
    df = spark.createDataFrame([(1, 1)] * 4 + [(1, 0)] + [(0, 0)] * 3 + [(0, 1)] * 2, "p INT, y INT")
    r = ass.confusion_matrix(df, "p", "y").first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (4, 1, 3, 2)
    assert math.isclose(r["accuracy"], 0.7) and math.isclose(r["sens"], 4 / 6) and math.isclose(r["spec"], 0.75)
    assert math.isclose(r["kappa"], (0.7 - 0.5) / 0.5)


def test_histogram_and_failure(spark):
    df = spark.createDataFrame([("1", "a", 1.0, 1), ("2", "a", 0.0, 0), ("3", "b", 0.0, 1)], SCHEMA)
    bins = {(r["model"], r["bin"]): r["n"] for r in ass.score_histogram(df).collect()}
    assert bins == {("a", 30): 1, ("a", 1): 1, ("b", 1): 1}
    metrics = spark.createDataFrame([("a", 0.9), ("b", 0.8)], "model STRING, auc DOUBLE")
    assert {r["model"]: r["auc"] for r in ass.zero_on_failure(df, metrics).collect()} == {"a": 0.9, "b": 0.0}


def test_lexicon_scores(spark):
    reviews = spark.createDataFrame(
        [("1", 5.0, 1, "good good bad"), ("2", 1.0, 0, "bad"), ("3", 2.0, 0, "unknown"), ("4", 4.0, 1, "good")],
        "review_id STRING, rating DOUBLE, binary_rating INT, review_text STRING",
    )
    scores = spark.createDataFrame([("good", 3), ("bad", -3)], "word STRING, afinn_score INT")
    got = {r["review_id"]: (r["afinn_score"], r["predicted"]) for r in lexicon.afinn_classifier(reviews, scores).collect()}
    assert got == {"1": (1.0, 1), "2": (-3.0, 0), "4": (3.0, 1)}  # the mean over scored reviews is 1/3
    assert lexicon.afinn_confusion(lexicon.afinn_classifier(reviews, scores)).first()["accuracy"] == 1.0

    emotions = spark.createDataFrame([("good", "joy"), ("good", "positive"), ("bad", "negative")], "word STRING, sentiment STRING")
    from lexispark.operators.cleaning import tokenized

    nrc = lexicon.nrc_emotions(tokenized(reviews), emotions)
    rows = {r["review_id"]: (r["joy"], r["count"], r["valence"]) for r in nrc.collect()}
    assert rows == {"1": (2, 5, 1), "2": (0, 1, -1), "3": (0, 0, 0), "4": (1, 2, 1)}
    shares = lexicon.emotion_shares(nrc).collect()
    assert len(shares) == 8 and shares[-1].asDict() == {"emotion": "joy", "share": 1.0}
