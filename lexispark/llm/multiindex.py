"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own k-means codebook, so k + k centroids name k * k cells.
A query walks the cells in the order of the summed distances of its halves to the two centroids, with a
heap over centroid pairs, until the cells it has met hold the wanted share of all rows. The entries of these cells are
reranked by their exact distance.

The codebooks are fitted on a bounded sample (``sample_rows`` rows, smallest hashes first); every row is indexed, each length of
vectors by an index of its own. How much of the table a query meets follows from the data: it is the share within which the sample's
own nearest neighbours are found with the wanted recall. What all tasks get is bounded by the codebooks: 2 k centroids and
at most k * k cell sizes for a length. Neighbouring small cells make a group, large ones are cut into groups of bounded size by
a hash, so a vector that stands in a third of all rows is spread, and nothing in a cell is left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.llm.kdtree import _numbers
from lexispark.llm.shipping import ship
from lexispark.llm.vectors import valid_vectors
from lexispark.session import stage

GROUP_ROWS = 16384
BLOCK_ROWS = 8192


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to the few rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def kmeans(x: np.ndarray, k: int, seed: int = 1, rounds: int = 20) -> np.ndarray:
    """At most ``k`` centroids of the rows of ``x``; an empty cluster takes the row farthest from its centroid."""
    x = np.unique(x, axis=0) if len(x) <= k else x
    if len(x) <= k:
        return x
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        d = squared(x, centroids)
        near = d.argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        for empty in np.flatnonzero(counts == 0):
            far = int(d[np.arange(len(x)), near].argmax())
            moved[empty], d[far] = x[far], 0
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def walk(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells (i * len(d2) + j) in the order of d1[i] + d2[j] until they hold ``wanted`` rows; empty cells are passed."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen = [(float(d1[o1[0]] + d2[o2[0]]), 0, 0)], {(0, 0)}
    cells, held = [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * len(d2) + int(o2[j])
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (float(d1[o1[a]] + d2[o2[b]]), a, b))
    return cells


class Index:
    """The codebooks of the vectors of one length and, once they are counted, the sizes of its cells."""

    def __init__(self, sample: np.ndarray, codes: int):
        self.half = sample.shape[1] // 2
        self.books = [kmeans(sample[:, : self.half], codes) if self.half else np.zeros((1, 0)), kmeans(sample[:, self.half :], codes)]
        self.width = len(self.books[1])
        self.held = np.zeros(len(self.books[0]) * self.width, np.int64)
        self.wanted = 0

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.books[0]), squared(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.distances(x)
        return (d1.argmin(1) * self.width + d2.argmin(1)).astype(np.int32)

    def share_for(self, sample: np.ndarray, k: int, recall: float, probes: int = 200) -> float:
        """The share of the rows a query has to meet for ``recall`` of the sample's own ``k`` nearest neighbours.

        The sample is sparser than the table, so neighbours in the table are nearer and their cells are met earlier.
        """
        cells = self.cells(sample)
        sizes = np.bincount(cells, minlength=len(self.held))
        d1, d2 = self.distances(sample[:probes])
        needed = []
        for i, d in enumerate(squared(sample, sample[:probes]).T):
            d[i] = np.inf
            order = walk(d1[i], d2[i], sizes, len(sample))
            met = np.zeros(len(sizes))
            met[order] = np.cumsum(sizes[order])
            needed += met[cells[np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]]].tolist()
        return float(np.quantile(needed, recall, method="higher")) / len(sample) if needed else 1.0

    def fill(self, sizes: dict[int, int], share: float, least: int) -> None:
        for cell, n in sizes.items():
            self.held[cell] = n
        total = int(self.held.sum())
        self.wanted = min(total, max(least, int(np.ceil(share * total))))
        # a cell starts a group where the cells before it fill one; a larger cell takes several groups of its own
        self.parts = np.maximum(1, -(-self.held // GROUP_ROWS))
        self.group, group, room = np.zeros(len(self.held), np.int64), -1, 0
        for cell, (n, parts) in enumerate(zip(self.held.tolist(), self.parts.tolist())):
            if parts > 1 or n > room:
                group, room = group + 1, GROUP_ROWS
            self.group[cell] = group
            group, room = group + parts - 1, 0 if parts > 1 else room - n

    def probe(self, x: np.ndarray) -> tuple[list[int], list[int], list[list[int]]]:
        """Places in ``x``, groups, and the cells wanted there: a query once for each group it meets."""
        at, groups, cells = [], [], []
        d1, d2 = self.distances(x)
        for i in range(len(x)):
            spots: dict[int, list[int]] = {}
            for cell in walk(d1[i], d2[i], self.held, self.wanted):
                for part in range(int(self.parts[cell])):
                    spots.setdefault(int(self.group[cell]) + part, []).append(cell)
            at += [i] * len(spots)
            groups += spots
            cells += spots.values()
        return at, groups, cells


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """The rows of each length in a batch, with their vectors as a matrix."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        own = batch.take(pa.array(np.flatnonzero(dims == dim)))
        yield dim, own, _numbers(pa.chunked_array([own.column("vector")]))


def _nearest_of(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``k`` rows nearest to ``q``, without the row ``own``; ties to the smaller id."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    others = np.flatnonzero(rows != own)
    d = d[others]
    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    near = near[np.lexsort((ids[others[near]], d[near]))][:k]
    return others[near], d[near]


def nearest(
    vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding",
    codes: int = 32, share: float | None = None, recall: float = 0.97, least: int = 2000, sample_rows: int = 20_000,
) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by ``every`` its ``k`` nearest other rows found, by Euclidean distance.

    A query meets cells until they hold ``share`` of all rows of its length and ``least`` rows at least. Without a ``share`` the
    one that finds ``recall`` of the sample's own neighbours is taken. Scores are exact, ties go to the smaller id. Rows without id
    and vectors that are null, empty, zero or hold a null or non-finite component take no part. Every other row is a candidate,
    also one that repeats an id or a whole row: a query leaves out its own row only, and several rows of one query id are queries
    each, whose results all stand under that id. Vectors meet those of their own length only; a length the sample lacks is one cell,
    searched whole. A single component is one half, the other half is empty. Fewer than ``k`` others give fewer rows, an
    empty table none.
    """
    spark = vectors.sparkSession
    ship(spark)
    valid = valid_vectors(vectors, id_col, vector_col).filter(F.exists("vector", lambda x: x != 0))
    rows = stage(valid.select("row", "id", "dim", "vector"), "mi-vectors")
    # bounded sample for the codebooks
    sample = rows.orderBy(F.xxhash64("row"), "row").select("dim", "vector").limit(sample_rows).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    indexes, shares = {}, {}
    dims = sample.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        x = _numbers(sample.filter(pa.array(dims == dim)).column("vector"))
        indexes[dim] = Index(x, codes)
        shares[dim] = share if share is not None else indexes[dim].share_for(x, k, recall)
    fields = "row long, id long, dim int, vector array<double>"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own, x in _by_length(batch):
                cells = indexes[dim].cells(x) if dim in indexes else np.zeros(len(x), np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cells)], names=[*own.schema.names, "cell"])

    entries = stage(rows.mapInArrow(assign, f"{fields}, cell int"), "mi-entries")
    counted: dict[int, dict[int, int]] = {}
    for r in entries.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect():  # at most codes * codes rows for a length
        counted.setdefault(r.dim, {})[r.cell] = r.n
    for dim, sizes in counted.items():
        if dim not in indexes:
            indexes[dim] = Index(np.zeros((1, dim)), 1)
        indexes[dim].fill(sizes, shares.get(dim, 1.0), least)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The group of each entry; in large cells a hash of the row picks the part."""
        for batch in batches:
            dims, cells, at = (batch.column(name).to_numpy() for name in ("dim", "cell", "salt"))
            group = np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                group[own] = indexes[dim].group[cells[own]] + at[own] % indexes[dim].parts[cells[own]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(group)], names=[*batch.schema.names[:-1], "grp"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own, x in _by_length(batch):
                for start in range(0, len(x), 256):  # bounds what leaves at once
                    at, groups, cells = indexes[dim].probe(x[start : start + 256])
                    whole = own.take(pa.array([start + i for i in at], pa.int64()))
                    columns = [*whole.columns, pa.array(groups, pa.int64()), pa.array(cells, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*whole.schema.names, "grp", "cells"])

    n_queries = entries.filter(F.col("id") % every == 0).count()
    blocks = max(1, -(-n_queries // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)).cast("int").alias("block")
    asked = rows.filter(F.col("id") % every == 0).select("row", "id", "dim", "vector", block)
    asked = stage(asked.mapInArrow(probe, f"{fields}, block int, grp long, cells array<int>"), "mi-asked")
    placed = entries.withColumn("salt", F.xxhash64("row").bitwiseAND(0x7FFFFFFF)).mapInArrow(spread, f"{fields}, cell int, grp long")
    unit = ["dim", "grp", "block"]
    # a group is copied for the blocks that ask for it only
    placed = placed.join(asked.select(*unit).distinct().toDF(*unit), ["dim", "grp"])

    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        """``left``: entries of one group of cells; ``right``: queries of one block with their cells here."""
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            cell = left.column("cell").to_numpy()
            order = np.lexsort((left.column("row").to_numpy(), cell))
            x, ids, rows = _numbers(left.column("vector"))[order], left.column("id").to_numpy()[order], left.column("row").to_numpy()[order]
            cell = cell[order]
            asking = zip(_numbers(right.column("vector")), right.column("row").to_pylist(), right.column("id").to_pylist(), right.column("cells").to_pylist())
            for q, row, i, cells in asking:
                lo, hi = np.searchsorted(cell, cells), np.searchsorted(cell, cells, side="right")
                take = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)])
                near, d = _nearest_of(x[take], ids[take], rows[take], q, row, k)
                out += [(row, i, int(j), float(s)) for j, s in zip(ids[take[near]], d)]
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["row", "query_id", "id", "score"])

    found = placed.groupBy(*unit).cogroup(asked.groupBy(*unit)).applyInArrow(rerank, "row long, query_id long, id long, score double")
    best = Window.partitionBy("row").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
