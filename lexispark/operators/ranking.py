"""Global order without a one-task sort: running totals, row ids, exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.session import stage


def running_totals(df: DataFrame, order: Sequence[str], values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add `cum_<v>` (inclusive running total in `order`) and `total_<v>` for each value, within `by`.

    The rows are range partitioned, so that one group may be spread over many tasks, and staged so that
    the slots stay fixed. Totals per slot (one small row each) give every slot its offset; only the
    running sum inside a slot is a window.
    """
    by, order = list(by), list(order)
    slots = stage(
        df.repartitionByRange(*by, *order).withColumn("_slot", F.spark_partition_id()), "running-totals"
    )
    per_slot = slots.groupBy(*by, "_slot").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    names = {b: f"_by{i}" for i, b in enumerate(by)}
    offsets = per_slot.select(
        *[F.col(b).alias(names[b]) for b in by],
        F.col("_slot").alias("_at"),
        *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(whole).alias(f"total_{v}") for v in values],
    )
    match = F.col("_slot") == F.col("_at")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(names[b]))
    inside = (
        Window.partitionBy(*by, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        slots.join(offsets, match)
        .withColumns({f"cum_{v}": F.sum(v).over(inside) + F.col(f"_before_{v}") for v in values})
        .drop("_slot", "_at", *names.values(), *[f"_before_{v}" for v in values])
    )


def assign_row_id(df: DataFrame, order_by: Sequence[str], name: str = "review_id") -> DataFrame:
    """Dense ids 1..n in `order_by` order. One range shuffle; the offsets have one row per partition."""
    order_by = list(order_by)
    placed = stage(
        df.repartitionByRange(*order_by, F.xxhash64(*df.columns))
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id()),
        "row-ids",
    )
    # monotonically_increasing_id: partition number above bit 33, position in the partition below
    slot = F.shiftright("_place", 33)
    position = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slot", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_slot", slot)
        .join(F.broadcast(offsets), "_slot")  # one row per shuffle partition
        .withColumn(name, F.col("_before") + position + 1)
        .drop("_slot", "_place", "_before")
        .select(name, *[c for c in df.columns if c != name])
    )


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles (position (n-1)*p) per group; one output column per entry of `probs`.

    Equal values are merged first, then the ranks come from running totals, so no task ever
    holds all the values of a group.
    """
    merged = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("rows"))
    return quantiles_of_counts(merged, value, probs, by)


def quantiles_of_counts(merged: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """`exact_quantiles` of a table that has each value once per group, with its number of `rows`."""
    by = list(by)
    merged = merged.select(*by, F.col(value).cast("double").alias("_value"), "rows")
    ranked = running_totals(merged, ["_value"], ["rows"], by)
    first = F.col("cum_rows") - F.col("rows")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("cum_rows")), F.col("_value")))

    picks = []
    for name, p in probs.items():
        target = (F.col("total_rows") - 1) * F.lit(float(p))
        picks += [
            at(F.floor(target)).alias(f"_lo_{name}"),
            at(F.ceil(target)).alias(f"_hi_{name}"),
            F.max(target - F.floor(target)).alias(f"_frac_{name}"),
        ]
    spread = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_frac_{n}")).alias(n) for n in probs
    ]
    return ranked.groupBy(*by).agg(*picks, F.max("total_rows").alias("n")).select(*by, "n", *spread)


def digest(col: str) -> Column:
    """256 bits that stand for a text as a key of shuffles and sorts; NULL for NULL."""
    return F.unhex(F.sha2(F.col(col).cast("binary"), 256))


def dedup_first(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """First row per value of `key`. Spark limits each group before the shuffle (WindowGroupLimit),

    so a text that makes up a large share of the rows sends one row per input partition. Texts are told apart by a digest:
    rows are sorted and dealt by 32 bytes however long the texts are.
    """
    text = df.schema[key].dataType.typeName() in ("string", "binary")
    keyed = df.withColumn("_key", digest(key) if text else F.col(key))
    w = Window.partitionBy("_key").orderBy(*order_by)
    return keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_key")
