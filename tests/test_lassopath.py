import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lexispark.operators import lassopath, models
from lexispark.session import stage


def _rows(spark, n, p, seed, sparse, parts=3):
    """Labels by a few features; one feature is constant, one has a large mean; sparse and dense rows may be mixed."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1 + j % 3) if rng.random() < 0.4 else 0.0 for j in range(p)]
        x[p - 1], x[p - 2] = 3.0, 50 + rng.gauss(0, 1)
        z = x[0] - 0.8 * x[1] + 0.5 * x[2] + rng.gauss(0, 1) - 0.3
        vector = Vectors.sparse(p, [(j, v) for j, v in enumerate(x) if v]) if sparse and i % 7 else Vectors.dense(x)
        rows.append((str(i), vector, float(z > 0), i % 3))
    return stage(spark.createDataFrame(rows, ["review_id", "features", "label", "fold"]).repartition(parts))


@pytest.fixture(scope="module")
def rows(spark):
    return _rows(spark, 400, 30, 5, True)


def test_the_path_equals_single_fits(rows):
    fits, tops = lassopath.fold_scales(rows, 3)
    assert models.largest_penalty(rows) == pytest.approx(tops.max(), rel=0.02)
    penalties = [float(x) for x in np.geomspace(tops.max(), tops.max() * 0.01, 4)]
    path = lassopath.fit_path(rows, penalties, 3, tol=1e-6)
    assert set(path) == {-1, 0, 1, 2} and all(len(x) == 4 for x in path.values())
    for fold, k in [(-1, 3), (0, 2)]:
        part = rows.where(F.col("fold") != fold)
        single = LogisticRegression(elasticNetParam=1.0, regParam=penalties[k], tol=1e-10, maxIter=300).fit(part)
        intercept, beta = path[fold][k]
        assert np.abs(beta - single.coefficients.toArray()).max() < 1e-4
        assert intercept == pytest.approx(single.intercept, abs=5e-3)  # moves with the feature of mean 50
    assert (path[-1][0][1] == 0).all() and (path[-1][3][1] != 0).sum() > 10


def test_a_small_working_set_takes_more_passes_to_the_same_end(rows):
    only = [f for f in lassopath.fold_scales(rows, 3)[0] if f.fold == -1]
    whole = lassopath.fit_path(rows, [0.05], 3, tol=1e-3, fits=only)[-1][0]
    only = [f for f in lassopath.fold_scales(rows, 3)[0] if f.fold == -1]
    parts = lassopath.fit_path(rows, [0.05], 3, tol=1e-3, max_working=3, fits=only)[-1][0]
    assert (whole[1] != 0).sum() > 3 and np.abs(whole[1] - parts[1]).max() < 2e-3


def test_more_features_than_rows_and_separable_classes(spark):
    few = _rows(spark, 40, 120, 8, True, parts=1)
    fits, tops = lassopath.fold_scales(few, 3)
    penalties = [float(x) for x in np.geomspace(tops.max(), tops.max() * 0.01, 5)]
    path = lassopath.fit_path(few, penalties, 3)
    assert all(np.isfinite(b).all() and np.isfinite(i) for fit in path.values() for i, b in fit)
    single = LogisticRegression(elasticNetParam=1.0, regParam=penalties[2], tol=1e-8, maxIter=100).fit(few)
    loss = lambda i, b: _objective(few, i, b, penalties[2], fits[0].scale)
    assert loss(*path[-1][2]) <= loss(single.intercept, single.coefficients.toArray()) * (1 + 1e-2)


def _objective(rows, intercept, beta, penalty, scale):
    data = rows.select("features", "label").collect()
    z = np.array([r.features.toArray() for r in data]) @ beta + intercept
    y = np.array([r.label for r in data])
    return (np.logaddexp(0, z) - y * z).mean() + penalty * np.abs(beta * scale).sum()


def test_held_out_scores_are_margins_of_the_other_folds(rows):
    path = lassopath.fit_path(rows, [0.05, 0.01], 3)
    got = lassopath.held_out_scores(rows, path)
    assert got.count() == 2 * rows.count()
    want = sorted(
        (k, r.fold, round(float(path[r.fold][k][1] @ r.features.toArray() + path[r.fold][k][0]), 9)) for r in rows.collect() for k in (0, 1)
    )
    have = sorted((r.model, r.fold, round(r.prob, 9)) for r in got.collect())
    assert np.allclose(np.array(have), np.array(want), atol=1e-8)


def test_constant_features_give_the_intercept_alone(spark):
    rows = spark.createDataFrame([(str(i), Vectors.dense([2.0]), float(i % 4 == 0)) for i in range(40)], ["review_id", "features", "label"])
    model = models.lasso_logistic_cv(rows, folds=2, n_lambda=3)
    assert model.coefficients.toArray().tolist() == [0.0] and model.intercept == pytest.approx(np.log(10 / 30), abs=1e-3)


def test_one_class_is_refused(spark):
    rows = spark.createDataFrame([(str(i), Vectors.dense([float(i)]), 1.0) for i in range(10)], ["review_id", "features", "label"])
    with pytest.raises(ValueError, match="one class"):
        models.lasso_logistic_cv(rows, folds=2, n_lambda=3)
