"""Exact top-k search by inner product: a KD-tree per shard.

Shards are regions of space: median splits of the widest dimension, learned from a bounded sample, name a region for each
vector, and regions with more rows than a shard may hold are dealt into parts by row. The sample decides only how rows are
grouped, never the result. The tree of a shard splits at the median of the widest dimension down to small leaves, keeps the
tight bounding box of every node and is built once and written. For a query q and a box [lo, hi] no inner product is over
sum(max(q lo, q hi)); nodes are visited best bound first until none can beat the k-th score.

Searches run in two waves. In the first each query searches its own shard, which gives it a k-th score that is a bound for
the whole table. Then blocks of queries meet the root boxes of the other shards, and the second wave takes a query only to
shards whose box can still beat its k-th score. Queries are a stated set; a tree is copied once per block of queries that needs it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.shipping import ship
from lexispark.llm.vectors import valid_vectors
from lexispark.session import stage

LEAF = 128
ROUTE_BOXES, ROUTE_QUERIES = 64, 2048
LOWEST = -(1 << 62)
SHARD = ["dim", "region", "part"]


class Tree:
    """KD-tree over integer vectors: node arrays, points reordered so that each node is a range of them."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, rows: np.ndarray | None = None):
        rows = np.arange(len(ids)) if rows is None else rows
        order = np.lexsort((rows, ids))
        ids, points, rows = ids[order], points[order], rows[order]
        place = np.arange(len(ids))
        self.first, self.last, self.children, boxes = [], [], [], []

        def build(lo: int, hi: int) -> int:
            node = len(self.first)
            own = points[place[lo:hi]]
            low, high = own.min(0), own.max(0)
            self.first.append(lo)
            self.last.append(hi)
            self.children.append((-1, -1))
            boxes.append((low, high))
            axis = int(np.argmax(high - low))
            if hi - lo > leaf and high[axis] > low[axis]:
                mid = (lo + hi) // 2
                place[lo:hi] = place[lo:hi][np.argpartition(own[:, axis], mid - lo)]
                self.children[node] = (build(lo, mid), build(mid, hi))
            return node

        build(0, len(ids))
        self.ids, self.points, self.rows = ids[place], points[place], rows[place]
        self.low = np.array([b[0] for b in boxes])
        self.high = np.array([b[1] for b in boxes])

    def packed(self) -> dict[str, bytes]:
        """The tree as byte strings, for a table of trees."""
        nodes = np.column_stack([self.first, self.last, np.array(self.children)]).astype(np.int64)
        arrays = {"ids": self.ids, "rows": self.rows, "points": self.points, "nodes": nodes, "boxes": np.concatenate([self.low, self.high])}
        return {name: np.ascontiguousarray(a, np.int64).tobytes() for name, a in arrays.items()}

    @classmethod
    def unpacked(cls, parts: dict[str, bytes], dim: int) -> Tree:
        tree = cls.__new__(cls)
        read = {name: np.frombuffer(raw, np.int64) for name, raw in parts.items()}
        tree.ids, tree.rows, tree.points = read["ids"], read["rows"], read["points"].reshape(-1, dim)
        nodes, boxes = read["nodes"].reshape(-1, 4), read["boxes"].reshape(-1, dim)
        tree.first, tree.last, tree.children = nodes[:, 0].tolist(), nodes[:, 1].tolist(), nodes[:, 2:].tolist()
        tree.low, tree.high = boxes[: len(nodes)], boxes[len(nodes) :]
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, a number no inner product with a point of the node is over."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, queries: np.ndarray, own_rows: np.ndarray, k: int, least: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query its best (score, id) pairs, at most ``k``, none of them below ``least``; the query's own row is left out."""
        bounds = self.bounds(queries)
        out = []
        for q, own, bound, kth in zip(queries, own_rows.tolist(), bounds, least.tolist()):
            best: list[tuple[int, int]] = []  # (score, -id), the worst on top
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                limit = max(kth, best[0][0]) if len(best) == k else kth
                if -top < limit:
                    break
                left, right = self.children[node]
                if left >= 0:
                    heapq.heappush(heap, (-bound[left], left))
                    heapq.heappush(heap, (-bound[right], right))
                    continue
                a, b = self.first[node], self.last[node]
                scores = self.points[a:b] @ q
                for at in np.flatnonzero(scores >= limit).tolist():
                    if self.rows[a + at] == own:
                        continue
                    entry = (int(scores[at]), -int(self.ids[a + at]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            out.append([(score, -i) for score, i in best])
        return out


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _exact(points: np.ndarray, queries: np.ndarray) -> type:
    """Doubles hold every sum as long as no one can pass 2**53; 64-bit integers otherwise."""
    most = np.abs(points).max(initial=0) * float(np.abs(queries).max(initial=0)) * points.shape[1]
    return np.float64 if most < 2**52 else np.int64


class Regions:
    """Median splits of the widest dimension of a sample, until a region holds at most ``most`` of its points."""

    def __init__(self, points: np.ndarray, most: int):
        self.splits: list[tuple[int, int, int, int]] = []  # axis, cut, node below or at the cut, node over it; a region: -1, number

        def build(own: np.ndarray) -> int:
            node = len(self.splits)
            self.splits.append((-1, node, -1, -1))
            axis = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
            if len(own) > most:
                cut = int(np.partition(own[:, axis], (len(own) - 1) // 2)[(len(own) - 1) // 2])
                if cut == own[:, axis].max():  # more than half are equal there: these make a side of their own
                    cut = int(max(own[own[:, axis] < cut, axis], default=cut - 1))
                below = own[:, axis] <= cut
                if below.any():
                    self.splits[node] = (axis, cut, build(own[below]), build(own[~below]))
            return node

        build(points)

    def locate(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            axis, cut, left, right = self.splits[node]
            if axis < 0:
                out[at] = node
                continue
            below = points[at, axis] <= cut
            todo += [(left, at[below]), (right, at[~below])]
        return out


def _regions(ints: DataFrame, sizes: dict[int, int], shard_rows: int, sample_rows: int) -> dict[int, Regions]:
    """Regions for each length the sample holds, so many that an even share of the rows fills a shard, 16 sample rows each at least."""
    sample = ints.orderBy(F.xxhash64("row"), "row").limit(sample_rows).select("dim", "v").toArrow()
    dims = sample.column("dim").to_numpy()
    out = {}
    for dim in np.unique(dims).tolist():
        points = _numbers(sample.filter(pa.array(dims == dim)).column("v"))
        out[dim] = Regions(points, max(16, len(points) * shard_rows // sizes[dim]))
    return out


def _place(ints: DataFrame, regions: dict[int, Regions]) -> DataFrame:
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims, v, region = batch.column("dim").to_numpy(), batch.column("v"), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                if dim in regions:  # lengths the sample lacks are one region
                    at = np.flatnonzero(dims == dim)
                    region[at] = regions[dim].locate(_numbers(pa.chunked_array([v.take(pa.array(at))])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=[*batch.schema.names, "region"])

    return ints.mapInArrow(locate, "row long, id long, dim int, v array<long>, region int")


def _build(table: pa.Table) -> pa.Table:
    points = _numbers(table.column("v"))
    tree = Tree(table.column("id").to_numpy(), points, rows=table.column("row").to_numpy())
    key = {name: pa.array([table.column(name)[0].as_py()], pa.int32()) for name in SHARD}
    box = {"low": pa.array([tree.low[0].tolist()], pa.list_(pa.int64())), "high": pa.array([tree.high[0].tolist()], pa.list_(pa.int64()))}
    return pa.table({**key, **box, **{name: pa.array([raw], pa.binary()) for name, raw in tree.packed().items()}})


def _route(boxes: pa.Table, queries: pa.Table) -> pa.Table:
    """The queries of one block once for each of some shards, but their own, whose box can still beat their k-th score."""
    if not boxes.num_rows or not queries.num_rows:
        return queries.slice(0, 0).select(["row", "id", "dim", "v", "kth", "region", "part", "lane"])
    q = _numbers(queries.column("v"))
    low, high = _numbers(boxes.column("low")), _numbers(boxes.column("high"))
    own = [boxes.column(name).to_numpy()[:, None] == queries.column(name).to_numpy() for name in ("region", "part")]
    bound = high @ np.maximum(q, 0).T + low @ np.minimum(q, 0).T
    box, query = np.nonzero((bound >= queries.column("kth").to_numpy()) & ~(own[0] & own[1]))
    out = queries.take(pa.array(query)).select(["row", "id", "dim", "v", "kth", "lane"])
    for name in ("region", "part"):
        out = out.append_column(name, boxes.column(name).take(pa.array(box)))
    return out.select(["row", "id", "dim", "v", "kth", "region", "part", "lane"])


def top_k(
    vectors: DataFrame, k: int = 10, scale: int = 1024, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = 8192, block_rows: int = 8192, sample_rows: int = 20_000,
) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by ``every`` the ``k`` other rows of largest inner product.

    Components are floor(``scale`` x) as integers; scores are exact, ties go to the smaller id. Rows without id and vectors
    that are null, empty or hold a null or non-finite component take no part. Every other row is a candidate, also one that
    repeats an id or a whole row: a query leaves out its own row only, and several rows of one query id are queries each, whose
    results all stand under that id. Vectors meet those of their own length only. Fewer than ``k`` others give fewer rows, an empty
    table none. Scaled components are taken to be below 2**28, so that sums fit into 64 bits.
    """
    spark = vectors.sparkSession
    ship(spark)
    valid = valid_vectors(vectors, id_col, vector_col)
    ints = stage(valid.select("row", "id", "dim", F.transform("vector", lambda x: F.floor(x * scale)).alias("v")), "kd-vectors")
    sizes = {r.dim: r.n for r in ints.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length that occurs
    if not sizes:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    placed = stage(_place(ints, _regions(ints, sizes, shard_rows, sample_rows)), "kd-placed")
    held = placed.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))  # at most a row for each region
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part")
    points = placed.join(held, ["dim", "region"]).select("row", "id", "dim", "v", "region", part)
    kinds = ", ".join(f"{name} binary" for name in ("ids", "rows", "points", "nodes", "boxes"))
    trees = stage(points.groupBy(*SHARD).applyInArrow(_build, f"dim int, region int, part int, low array<long>, high array<long>, {kinds}"), "kd-trees")

    def search(tree_rows: pa.Table, asked: pa.Table) -> pa.Table:
        """``tree_rows``: the tree of one shard; ``asked``: a block of queries with their k-th score so far."""
        found: list[tuple[int, int, int, int]] = []
        if tree_rows.num_rows and asked.num_rows:
            q = _numbers(asked.column("v"))
            tree = Tree.unpacked({name: tree_rows.column(name)[0].as_py() for name in ("ids", "rows", "points", "nodes", "boxes")}, q.shape[1])
            kind = _exact(tree.points, q)
            tree.points, tree.low, tree.high = tree.points.astype(kind), tree.low.astype(kind), tree.high.astype(kind)
            rows, ids = asked.column("row").to_numpy(), asked.column("id").to_pylist()
            best = tree.search(q.astype(kind), rows, k, asked.column("kth").to_numpy().astype(kind))
            found = [(row, i, j, score) for row, i, own in zip(rows.tolist(), ids, best) for score, j in own]
        columns = list(zip(*found)) or [()] * 4
        return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["row", "query_id", "id", "score"])

    schema = "row long, query_id long, id long, score long"
    queries = points.filter(F.col("id") % every == 0)
    home = queries.withColumn("kth", F.lit(LOWEST))
    first = stage(trees.groupBy(*SHARD).cogroup(home.groupBy(*SHARD)).applyInArrow(search, schema), "kd-first")
    found = first
    n_shards = trees.count()
    if n_shards > len(sizes):  # some length has more than one shard
        kth = first.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k).select("row", "s")
        lanes, chunks, blocks = (max(1, -(-n // most)) for n, most in ((queries.count(), block_rows), (n_shards, ROUTE_BOXES), (queries.count(), ROUTE_QUERIES)))
        dealt = lambda salt, n, *by: F.pmod(F.xxhash64(*by, F.lit(salt)), F.lit(n)).cast("int").alias(salt)
        known = queries.join(kth, "row", "left").select("row", "id", "dim", "v", "region", "part", F.coalesce("s", F.lit(LOWEST)).alias("kth"))
        known = stage(known.select("*", dealt("lane", lanes, "row"), dealt("block", blocks, "row")), "kd-known")
        boxes = trees.select(*SHARD, "low", "high", dealt("chunk", chunks, "region", "part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        meeting = ["dim", "chunk", "block"]
        asking = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
        routed = boxes.groupBy(*meeting).cogroup(asking.groupBy(*meeting)).applyInArrow(
            _route, "row long, id long, dim int, v array<long>, kth long, region int, part int, lane int"
        )
        routed = stage(routed, "kd-routed")
        unit = [*SHARD, "lane"]
        needed = trees.drop("low", "high").join(routed.select(*unit).distinct().toDF(*unit), SHARD)
        found = first.unionByName(needed.groupBy(*unit).cogroup(routed.groupBy(*unit)).applyInArrow(search, schema))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
