"""k-means whose centres are a table, for as many clusters as a tenth of the points.

Points are dealt into blocks, and each block meets the centres as they stream past it: a task holds one block and `GROUP_CENTRES` centres at a
time. Later rounds compare only what can differ. A point is compared with the centres that have moved; with the others only if no moved one is
nearer than its centre was before, as an unmoved centre was not nearer then. So the assignment is exact, and its work falls with the
number of moved centres. New centres are grouped means of the clusters whose points have changed. Nothing but counts is on the driver.
Points with their clusters and centres are written tables after each round.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.session import stage

GROUP_CENTRES = 8192
BLOCK_POINTS = 16384
LEAST_BLOCK = 1024  # smaller blocks are not worth a task
CHUNK = 128  # points and
STRIP = 1024  # centres whose distances are held at once
STATE = "row BIGINT, vector ARRAY<DOUBLE>, block INT, cluster BIGINT, d2 DOUBLE, was BIGINT"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1).astype(float, copy=False)


class Block:
    """The points of a block, each with the nearest centre so far; equally near ones by number."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.table = pa.Table.from_batches(batches).combine_chunks()
        self.x = _matrix(self.table.column("vector"))
        self.before, self.bound = (self.table.column(name).to_numpy() for name in ("cluster", "d2"))
        self.own = np.full(len(self.x), -1, np.int64)
        self.d2 = np.full(len(self.x), np.inf)
        self.lengths = np.einsum("ij,ij->i", self.x, self.x)
        self.stays = np.ones(len(self.x), bool)  # the own centre has not been met among the moved ones
        self.open: np.ndarray | None = None

    def _take(self, at: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        """Compares the points `at` with centres: a product finds the ones that may be nearest, their distances are then taken by differences."""
        squared = np.einsum("ij,ij->i", c, c)
        finite = np.isfinite(squared)
        ids, c, squared = ids[finite], c[finite], squared[finite]
        right = np.vstack([-2 * c.T, squared])
        for start in range(0, len(at), CHUNK):
            part = at[start : start + CHUNK]
            left = np.hstack([self.x[part], np.ones((len(part), 1))])
            for first in range(0, len(ids), STRIP):
                strip = slice(first, first + STRIP)
                d = left @ right[:, strip]  # without the points' own squares
                slack = 1e-11 * (self.lengths[part] + squared[strip].max())
                least, bound = d.min(1), self.d2[part] - self.lengths[part]
                near = np.flatnonzero(least <= bound + slack)  # most strips have nothing nearer for most points
                if not len(near):
                    continue
                point, centre = np.nonzero(d[near] <= (np.minimum(least, bound) + slack)[near, None])
                point = near[point]
                gap = self.x[part[point]] - c[strip][centre]
                exact, number = np.einsum("ij,ij->i", gap, gap), ids[strip][centre]
                order = np.lexsort((number, exact, point))
                point, best = np.unique(point[order], return_index=True)
                exact, number, who = exact[order][best], number[order][best], part[point]
                better = (exact < self.d2[who]) | ((exact == self.d2[who]) & (number < self.own[who]))
                self.d2[who[better]], self.own[who[better]] = exact[better], number[better]

    def meet(self, ids: np.ndarray, c: np.ndarray, moved: np.ndarray) -> None:
        """A batch of centres; all moved ones come before the others."""
        if moved.any():
            self._take(np.arange(len(self.x)), ids[moved], c[moved])
            self.stays &= ~np.isin(self.before, ids[moved])
        if not moved.all():
            if self.open is None:
                self._keep()
            self._take(self.open, ids[~moved], c[~moved])

    def _keep(self) -> None:
        """After the moved centres: unmoved own centres count as before, other points are open for all unmoved ones unless something is nearer now."""
        old = self.stays & ((self.bound < self.d2) | ((self.bound == self.d2) & (self.before < self.own)))
        self.d2[old], self.own[old] = self.bound[old], self.before[old]
        self.open = np.flatnonzero(~self.stays & (self.d2 >= self.bound))

    def done(self) -> pa.RecordBatch:
        if self.open is None:
            self._keep()
        kept = [self.table.column(name).chunk(0) for name in ("row", "vector", "block")]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(self.own), pa.array(self.d2), self.table.column("cluster").chunk(0)], ["row", "vector", "block", "cluster", "d2", "was"]
        )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by block and kind: the points of a block, then its moved centres, then the others."""
    number, held, block = None, [], None
    for whole in batches:
        if not whole.num_rows:
            continue
        blocks, kinds = whole.column("block").to_numpy(), whole.column("kind").to_numpy()
        cuts = np.flatnonzero((np.diff(blocks) != 0) | ((np.diff(kinds) != 0) & (kinds[:-1] == 0))) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
            if blocks[start] != number:
                if held or block:
                    yield (block or Block(held)).done()
                number, held, block = blocks[start], [], None
            part = whole.slice(start, end - start)
            if kinds[start] == 0:
                held.append(part)
                continue
            if not held and block is None:  # a block without points
                continue
            if block is None:
                block, held = Block(held), []
            for first in range(0, part.num_rows, GROUP_CENTRES):
                group = part.slice(first, GROUP_CENTRES)
                block.meet(group.column("row").to_numpy(), _matrix(group.column("vector")), group.column("kind").to_numpy() == 1)
    if held or block:
        yield (block or Block(held)).done()


def assign(points: DataFrame, centres: DataFrame, blocks: int) -> DataFrame:
    """`points` with the nearest of `centres` (`cluster, centre, moved`) as `cluster`, ties to the smaller number, and with the one they had as `was`.

    Points (`row, vector, block, cluster, d2`) come with their cluster and distance before the marked centres have moved; at first all have.
    """
    parts = points.select("block", F.lit(0).alias("kind"), "row", "vector", "cluster", "d2")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    kind = F.when(F.col("moved"), 1).otherwise(2)
    copies = centres.select(
        everywhere, kind.alias("kind"), F.col("cluster").alias("row"), F.col("centre").alias("vector"), F.lit(-1).cast("long").alias("cluster"), F.lit(0.0).alias("d2")
    )
    rows = parts.unionByName(copies).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
    return rows.mapInArrow(_stream, STATE)


def _means(points: DataFrame, dim: int) -> DataFrame:
    """`cluster, mean`: sums of plain columns, which are added up in a hash table."""
    means = ", ".join(f"sum(vector[{i}]) / count(*)" for i in range(dim))  # as text, which is parsed at once
    return points.groupBy("cluster").agg(F.expr(f"array({means})").alias("mean"))


def fit_centres(vectors: DataFrame, start: DataFrame, max_iter: int = 150, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Lloyd's rounds from the centres `start` (`cluster, centre`): `word, cluster` for `vectors` (`word, vector`), and the centres.

    The rounds end when no word changes its cluster, when no centre moves further than `tol`, or after `max_iter`. A centre without words stays
    where it is. Rows without a vector take no part; all vectors have one length. A word whose vector is not finite has a NULL cluster.
    """
    spark = vectors.sparkSession
    centres = stage(start.select(F.col("cluster").cast("long").alias("cluster"), F.col("centre").cast("array<double>").alias("centre")), "kmeans-centres")
    numbered = vectors.where("vector IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), "word", F.col("vector").cast("array<double>").alias("vector")
    )
    points = stage(numbered, "kmeans-points")
    n_points, k = points.count(), centres.count()
    if not n_points or not k:
        return spark.createDataFrame([], "word STRING, cluster BIGINT"), centres
    dim = len(points.select("vector").first()["vector"])
    cores = spark.sparkContext.defaultParallelism
    blocks = max(-(-n_points // BLOCK_POINTS), min(2 * cores, -(-n_points // LEAST_BLOCK)))
    points = points.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    state = points.select("row", "vector", "block", F.lit(-1).cast("long").alias("cluster"), F.lit(float("inf")).alias("d2"))
    centres, furthest = centres.withColumn("moved", F.lit(True)), float("inf")
    for done in range(max_iter + 1):
        state = stage(assign(state, centres, blocks), "kmeans-assigned")
        if done == max_iter or furthest <= tol:
            break
        changed = stage(
            state.where("cluster <> was").select(F.explode(F.array("cluster", "was")).alias("cluster")).distinct(), "kmeans-changed"
        )
        if changed.isEmpty():
            break
        means = _means(state.join(changed, "cluster", "left_semi"), dim)
        next_ = centres.select("cluster", "centre").join(means, "cluster", "left").withColumn("next", F.coalesce("mean", "centre"))
        step = F.aggregate(F.zip_with("centre", "next", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
        moved = stage(next_.select("cluster", F.col("next").alias("centre"), step.alias("step")), "kmeans-centres")
        furthest = moved.agg(F.sqrt(F.max("step"))).first()[0]
        centres = moved.select("cluster", "centre", (F.col("step") > 0).alias("moved"))
    found = points.select("row", "word").join(state, "row").select("word", F.when(F.col("cluster") >= 0, F.col("cluster")).alias("cluster"))
    return found, centres.select("cluster", "centre")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
