"""Joins of token-sized rows with a vocabulary of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.operators.ranking import assign_row_id
from lexispark.session import stage

# a vocabulary of at most this many bytes is broadcast whole
BROADCAST_BYTES = 64 << 20
# so many of the most frequent keys of the rows are settled without a shuffle
HEAVY_KEYS = 1000
# so many slices of a larger vocabulary are broadcast, its most frequent words first
SLICES = 6


def table_bytes(table: DataFrame, on: str) -> int:
    """About the size of a table of unique keys with fixed-width columns and arrays of numbers beside them."""
    widths = [
        F.coalesce(F.size(f.name), F.lit(0)) * 8 if f.dataType.typeName() == "array"
        else F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(8)
        for f in table.schema
    ]
    return table.agg(F.sum(sum((w for w in widths), F.lit(16)).cast("long")).alias("b")).first()["b"] or 0


def heavy_keys(rows: DataFrame, on: str, k: int) -> list[int]:
    """Hashes of at most `k` keys: every key with over 1 / (4 k) of the rows whose rank is within k.

    A frequent-items sketch of bounded size; one row reaches the driver.
    """
    top = rows.where(F.col(on).isNotNull()).agg(F.expr(f"approx_top_k(xxhash64(`{on}`), {k}, {4 * k})").alias("top")).first()["top"]
    return [r["item"] for r in top or []]


def frequency_join(
    rows: DataFrame, table: DataFrame, on: str, how: str = "inner", heavy: int | None = None, rows_of: DataFrame | None = None
) -> DataFrame:
    """`rows` joined (inner, left, left_semi or left_anti) with a stored table of unique keys.

    A small table is broadcast whole. For a larger one the most frequent keys of `rows` are looked up first, whether the
    table has them or not: their rows meet the few table rows of these keys by broadcast, so the ones that the table
    rejects go there as well. Only the other rows are shuffled, and no key among them has more than a few thousandths
    of all rows. Keys are told apart by a hash, so their length plays no part. Where the number of rows of each key is known, `rows_of` (a stored
    table `<on>, n`) names the frequent ones and saves the pass over the rows.
    """
    if table_bytes(table, on) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on, how)
    if rows_of is None:
        keys = heavy_keys(rows, on, heavy or HEAVY_KEYS)
    else:
        top = rows_of.where(F.col(on).isNotNull()).select(F.xxhash64(on).alias("h"), "n").orderBy(F.desc("n"), "h").limit(heavy or HEAVY_KEYS)
        keys = sorted({r["h"] for r in top.collect()})
    is_heavy = F.coalesce(F.xxhash64(on).isin(keys), F.lit(False)) if keys else F.lit(False)
    settled = rows.where(is_heavy).join(F.broadcast(table.where(is_heavy)), on, how)
    return settled.unionByName(rows.where(~is_heavy).join(table.where(~is_heavy), on, how))


def sliced_join(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Inner join of `rows` with a stored table whose rows are wide (vectors), without wide rows in a shuffle, as far as words are frequent.

    A table beyond the broadcast limit is ranked by the number of rows of each key and cut into slices of that size. The rows meet
    `SLICES` of them by broadcast, one after the other, and stay where they are; so those of a document can be added up before
    anything is shuffled. Only rows of still rarer keys are shuffled by their key. `rows` should be a stored table: each slice reads it.
    """
    size = table_bytes(table, on)
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on)
    counts = rows.groupBy(on).agg((-F.count(F.lit(1))).alias("_rows"))
    ranked = stage(assign_row_id(table.join(counts, on), ["_rows", on], "_rank").drop("_rows"), "ranked-keys")
    known = ranked.count()
    width = max(1, BROADCAST_BYTES * table.count() // size)  # keys of a slice
    slices = min(SLICES, math.ceil(known / width))
    number = F.col("_rank")
    parts = [rows.join(F.broadcast(ranked.where((number > at * width) & (number <= (at + 1) * width)).drop("_rank")), on) for at in range(slices)]
    if known > slices * width or not parts:
        parts.append(rows.join(ranked.where(number > slices * width).drop("_rank"), on))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
