"""Vector searches against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from lexispark.llm.kdtree import Tree, top_k
from lexispark.llm.multiindex import Index, nearest, walk


def _table(spark, rows):
    ids, vectors = [r[0] for r in rows], [r[1] for r in rows]
    return spark.createDataFrame(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "v": pa.array(["x"] * len(rows)), "score": pa.array([1] * len(rows))}))


def _rows(n=700, dim=8, odd=True):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:90] = x[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1100, []), (1200, [float("nan")] * dim), (1300, [float("inf")] + [0.0] * (dim - 1)), (1400, [None] * dim), (None, [1.0] * dim)]
    return rows, rows + (bad + [(1500, [0.0] * dim), (3, [9.0] * dim), rows[10]] if odd else [])


def _valid(rows, zero):
    """The rows that take part, as (id, vector); repeated ids and repeated rows stay."""
    return [(i, v) for i, v in rows if i is not None and v and not any(c is None or not np.isfinite(c) for c in v) and (zero or any(v))]


def _integers(v):
    return np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)


def _best(rows, measure, k=10):
    """Brute force: for each query row the (query_id, rank, id, score) of its best other rows of the same length, smallest ``measure`` first."""
    out = []
    for at, (q, x) in enumerate(rows):
        if q % 100 == 0:
            scored = sorted((measure(x, y), j) for b, (j, y) in enumerate(rows) if b != at and len(y) == len(x))[:k]
            out += [(q, r + 1, j, s) for r, (s, j) in enumerate(scored)]
    return out


def _product(x, y):
    return -int(_integers(x) @ _integers(y))


def _distance(x, y):
    return float(np.sqrt(((np.array(x, np.float32).astype(float) - np.array(y, np.float32).astype(float)) ** 2).sum()))


REPEATED = [(0, [0.5] * 8), (1, [5.0] * 8), (1, [4.0] * 8), (200, [0.25] * 8), (200, [0.25] * 8)]
SHORT = [(0, [1.0, 2.0, 3.0]), (100, [1.0, 1.0, 1.0]), (7, [2.0, 2.0, 2.0]), (8, [2.0, 2.0, 2.0]), (300, [4.0])]


def test_top_k_by_inner_product(spark):
    rows = _rows()[1] + REPEATED + SHORT
    want = [(q, r, j, -s) for q, r, j, s in _best(_valid(rows, True), _product)]
    for settings in ({"shard_rows": 100_000, "block_rows": 1000}, {"shard_rows": 150, "block_rows": 3}, {"shard_rows": 50, "sample_rows": 100}):
        got = top_k(_table(spark, rows), **settings).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_of_a_vector_in_a_third_of_all_rows(spark):
    rows = [(i, [1.0, 0.0, 0.5] if i % 3 else [i / 100, -i / 50, 0.1]) for i in range(600)]
    want = [(q, r, j, -s) for q, r, j, s in _best(rows, _product)]
    got = top_k(_table(spark, rows), shard_rows=64).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_far_shards_are_not_asked():
    from lexispark.llm.kdtree import _route

    boxes = pa.table({"region": pa.array([1, 2], pa.int32()), "part": pa.array([0, 0], pa.int32()), "low": [[0, 0], [-9, -9]], "high": [[5, 5], [-1, -1]]})
    asked = {"row": [1, 2], "id": [0, 100], "dim": pa.array([2, 2], pa.int32()), "v": [[1, 1], [-1, 0]], "kth": [3, 4], "lane": pa.array([0, 0], pa.int32())}
    queries = pa.table({**asked, "region": pa.array([5, 5], pa.int32()), "part": pa.array([0, 0], pa.int32())})
    routed = _route(boxes, queries)
    assert list(zip(routed.column("id").to_pylist(), routed.column("region").to_pylist())) == [(0, 1), (100, 2)]


def test_packed_trees_are_the_same_trees():
    rng = np.random.default_rng(5)
    tree = Tree(np.arange(500), rng.integers(-50, 50, (500, 4)), leaf=10)
    same = Tree.unpacked(tree.packed(), 4)
    queries = rng.integers(-50, 50, (9, 4))
    lowest = np.full(9, -(1 << 62))
    assert same.search(queries, np.arange(9), 5, lowest) == tree.search(queries, np.arange(9), 5, lowest)


def test_top_k_of_small_and_mixed_tables(spark):
    assert top_k(_table(spark, [])).count() == 0
    assert top_k(_table(spark, [(0, [1.0])])).count() == 0
    got = top_k(_table(spark, [(0, [1.0]), (5, [2.0]), (6, [1.0, 1.0]), (100, [-1.0])])).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(0, 5, 2 * 1024**2), (0, 100, -(1024**2)), (100, 0, -(1024**2)), (100, 5, -2 * 1024**2)]


def test_tree_bounds_hold():
    rng = np.random.default_rng(2)
    points, queries = rng.integers(-50, 50, (900, 5)), rng.integers(-50, 50, (20, 5))
    tree = Tree(np.arange(900), points, leaf=10)
    bounds = tree.bounds(queries)
    for node, (a, b) in enumerate(zip(tree.first, tree.last)):
        assert ((queries @ tree.points[a:b].T).max(1) <= bounds[:, node]).all()


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(3)
    d1, d2 = rng.random(6), rng.random(5)
    sizes = rng.integers(0, 4, 30)
    cells = walk(d1, d2, sizes, int(sizes.sum()))
    assert sorted(cells) == np.flatnonzero(sizes).tolist()
    sums = [d1[c // 5] + d2[c % 5] for c in cells]
    assert sums == sorted(sums)


@pytest.mark.parametrize("share", [1.0, 0.6, None])
def test_nearest(spark, share):
    rows = _rows(n=1500)[1] + REPEATED + SHORT
    want = _best(_valid(rows, False), _distance)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(_table(spark, rows), share=share, least=100, codes=8).collect()]
    if share == 1.0:
        assert [r[:3] for r in sorted(got)] == [r[:3] for r in sorted(want)]
        assert np.allclose([r[3] for r in sorted(got)], [r[3] for r in sorted(want)])
    else:
        assert len(got) == len(want)
        assert len({(q, j) for q, _, j, _ in got} & {(q, j) for q, _, j, _ in want}) >= 0.9 * len({(q, j) for q, _, j, _ in want})


def test_lengths_outside_the_sample_and_large_cells(spark, monkeypatch):
    monkeypatch.setattr("lexispark.llm.multiindex.GROUP_ROWS", 40)
    rows = _rows(n=400)[1] + REPEATED + SHORT
    want = _best(_valid(rows, False), _distance)
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest(_table(spark, rows), share=1.0, codes=3, sample_rows=5).collect()]
    assert sorted(got) == sorted(r[:3] for r in want)


def test_clustered_vectors_need_a_small_share():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 10
    clustered = (centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 8)) * 0.1)
    spread = rng.normal(size=(2000, 8))
    assert Index(clustered, 16).share_for(clustered, 10, 0.97) < 0.1 < Index(spread, 16).share_for(spread, 10, 0.97)


def test_nearest_of_small_tables(spark):
    assert nearest(_table(spark, [])).count() == 0
    assert nearest(_table(spark, [(0, [0.0, 0.0])])).count() == 0
    got = nearest(_table(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (100, None)])).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]
