"""k-means with a table of centres next to plain rounds from the same start."""

import numpy as np
import pyarrow as pa
import pytest

from lexispark.operators import centres, embeddings


def _points(spark, x):
    return spark.createDataFrame(pa.table({"word": [f"w{i}" for i in range(len(x))], "vector": pa.array(x.tolist(), pa.list_(pa.float64()))})).repartition(3)


def _start(spark, c):
    return spark.createDataFrame(pa.table({"cluster": list(range(len(c))), "centre": pa.array(c.tolist(), pa.list_(pa.float64()))}))


def _plain(x, c, rounds):
    """Labels and centres of Lloyd's rounds; a centre without points stays."""
    c = c.copy()
    for _ in range(rounds):
        labels = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        moved = np.array([x[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(len(c))])
        if np.abs(moved - c).max() < 1e-9:
            break
        c = moved
    return ((x[:, None] - c[None]) ** 2).sum(2).argmin(1), c


@pytest.mark.parametrize(("group", "block"), [(8192, 16384), (7, 60)])
def test_same_as_plain_rounds(spark, monkeypatch, group, block):
    monkeypatch.setattr(centres, "GROUP_CENTRES", group)
    monkeypatch.setattr(centres, "BLOCK_POINTS", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) + rng.integers(0, 4, (400, 1)) * 3
    start = np.concatenate([x[:39], np.full((1, 5), 1e3)])  # the last one gets no point
    assigned, found = centres.fit_centres(_points(spark, x), _start(spark, start), max_iter=6, tol=0.0)
    labels, want = _plain(x, start, 6)
    assert {r["word"]: r["cluster"] for r in assigned.collect()} == {f"w{i}": int(c) for i, c in enumerate(labels)}
    got = np.array([r["centre"] for r in found.orderBy("cluster").collect()])
    assert np.allclose(got, want)


def test_equal_vectors_in_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(centres, "GROUP_CENTRES", 3)
    monkeypatch.setattr(centres, "BLOCK_POINTS", 50)
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (300, 3)).astype(float)
    x[::3] = 1.0
    start = x[:12]  # equal centres among them: the smaller number takes the points
    labels, _ = _plain(x, start, 0)
    assigned, _ = centres.fit_centres(_points(spark, x), _start(spark, start), max_iter=0)
    assert {r["word"]: r["cluster"] for r in assigned.collect()} == {f"w{i}": int(c) for i, c in enumerate(labels)}


def test_planted_clusters_and_awkward_tables(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(np.eye(6) * 20, 20, axis=0) + rng.normal(size=(120, 6)) * 0.01
    df = _points(spark, x)
    rows = embeddings.word_clusters(df.unionByName(spark.createDataFrame([("none", None)], df.schema)), k=40).collect()
    assert len(rows) == 120
    meaning = {}
    for r in rows:  # no cluster mixes two of the planted ones
        meaning.setdefault(r["cluster"], set()).add(int(r["word"][1:]) // 20)
    assert all(len(m) == 1 for m in meaning.values())
    assert embeddings.word_clusters(df.limit(0)).count() == 0
    one = embeddings.word_clusters(spark.createDataFrame([("a", [1.0, 2.0])], df.schema)).collect()
    assert [(r["word"], r["cluster"]) for r in one] == [("a", 0)]


def test_a_later_round_compares_what_can_differ():
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(300, 4)), rng.normal(size=(30, 4))
    distances = lambda c: ((x[:, None] - c[None]) ** 2).sum(2)
    before, bound = distances(c).argmin(1), distances(c).min(1)
    moved = np.arange(30) % 10 == 0
    c[moved] += rng.normal(size=(3, 4)) * 0.5
    columns = {"row": np.arange(300), "vector": pa.array(x.tolist()), "block": np.zeros(300, np.int32), "cluster": before, "d2": bound}
    block, compared = centres.Block([pa.RecordBatch.from_pydict(columns)]), []
    take = block._take
    block._take = lambda at, ids, c: (compared.append(len(at) * len(ids)), take(at, ids, c))
    for part in (moved, ~moved):
        block.meet(np.flatnonzero(part), c[part], moved[part])
    done = block.done()
    assert np.array_equal(done.column("cluster"), distances(c).argmin(1)) and np.allclose(done.column("d2"), distances(c).min(1))
    assert np.array_equal(done.column("was"), before) and 0 < sum(compared) < 0.3 * 300 * 30


def test_a_vector_that_is_not_finite_spoils_no_cluster(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    start = x[:6]
    want = {r["word"]: r["cluster"] for r in centres.fit_centres(_points(spark, x), _start(spark, start), max_iter=3)[0].collect()}
    rows = _points(spark, x).unionByName(spark.createDataFrame([("nan", [float("nan"), 0.0, 0.0]), ("inf", [float("inf"), 0.0, 0.0])], "word STRING, vector ARRAY<DOUBLE>"))
    got = {r["word"]: r["cluster"] for r in centres.fit_centres(rows, _start(spark, start), max_iter=3)[0].collect()}
    assert got == {**want, "nan": None, "inf": None}
