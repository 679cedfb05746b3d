"""Reproducible samples and splits, ordered by a hash of the row key.

Keys are expected to be unique. The n smallest hashes of a class are found from counts per hash
prefix (at most 65,536 per class), so neither a class nor the sample itself is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.operators.ranking import running_totals
from lexispark.session import stage


def hash_key(key: str = "review_id", seed: int = 42) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))


def hash_fraction(key: str = "review_id", seed: int = 42) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _cut_points(df: DataFrame, quota: Column, key: str, seed: int, by: str | None) -> DataFrame:
    """Last (hash, key) inside the quota per class; classes that fit whole have no row.

    `quota` may use the class size as column `class_rows`.
    """
    groups = [by] if by else []
    keyed = df.select(
        *groups, F.col(key).cast("string").alias("_key"), hash_key(key, seed).alias("_hash")
    ).withColumn("_prefix", F.substring("_hash", 1, 4))
    counts = keyed.groupBy(*groups, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*groups).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*groups)
    cut = (
        counts.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("class_rows", F.sum("_n").over(whole))
        .withColumn("_quota", quota)
        .where("_upto >= _quota and _upto - _n < _quota and _quota < class_rows")
        .select(*groups, "_prefix", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    # only the rows of one prefix per class are ranked
    edge = keyed.join(stage(cut, "sample-cut"), [*groups, "_prefix"])
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy("_hash", "_key"))
    return (
        edge.withColumn("_rank", rank)
        .where("_rank = _need")
        .select(*groups, F.col("_hash").alias("_cut_hash"), F.col("_key").alias("_cut_key"))
    )


def _inside(key: str, seed: int, cut_hash: Column, cut_key: Column) -> Column:
    h = hash_key(key, seed)
    return (h < cut_hash) | ((h == cut_hash) & (F.col(key).cast("string") <= cut_key))


def _flag_smallest(df: DataFrame, n: int, key: str, seed: int) -> Column:
    if n <= 0:
        return F.lit(False)
    cut = _cut_points(df, F.lit(n), key, seed, None).first()
    if cut is None:  # the sample is the whole table
        return F.lit(True)
    return _inside(key, seed, F.lit(cut["_cut_hash"]), F.lit(cut["_cut_key"]))


def sample_n(df: DataFrame, n: int, key: str = "review_id", seed: int = 42) -> DataFrame:
    """Exactly n rows without replacement (all rows where there are fewer)."""
    return df.where(_flag_smallest(df, n, key, seed))


def _sample_classes(df: DataFrame, label: str, quota: Column, key: str, seed: int) -> DataFrame:
    """Adds `_sampled`: whether the row is among the first `quota` of its class."""
    labelled = df.where(F.col(label).isNotNull())
    cuts = stage(_cut_points(labelled, quota, key, seed, label), "class-cuts")
    inside = F.col("_cut_hash").isNull() | _inside(key, seed, F.col("_cut_hash"), F.col("_cut_key"))
    return labelled.join(cuts, label, "left").withColumn("_sampled", inside).drop("_cut_hash", "_cut_key")


def balanced_sample(
    df: DataFrame, label: str, n_per_class: int, key: str = "review_id", seed: int = 42
) -> DataFrame:
    """n rows of every class without replacement."""
    return (
        _sample_classes(df, label, F.lit(n_per_class), key, seed).where("_sampled").select(*df.columns)
    )


def stratified_split(
    df: DataFrame, label: str, frac: float = 0.2, key: str = "review_id", seed: int = 42
) -> DataFrame:
    """Adds `type`: ceil(frac * class size) rows of every class are `test`, the rest `train`."""
    quota = F.ceil(F.lit(float(frac)) * F.col("class_rows"))
    flagged = _sample_classes(df, label, quota, key, seed)
    return flagged.withColumn("type", F.when(F.col("_sampled"), "test").otherwise("train")).drop("_sampled").select(
        *df.columns, "type"
    )


def holdout_split_n(df: DataFrame, n_test: int, key: str = "review_id", seed: int = 42) -> DataFrame:
    """Adds `type`: exactly n_test rows are `test`, the rest `train`."""
    return df.withColumn("type", F.when(_flag_smallest(df, n_test, key, seed), "test").otherwise("train"))


def fraction_split(df: DataFrame, frac: float = 0.8, key: str = "review_id", seed: int = 42) -> DataFrame:
    """Adds `type` from the row's own hash: no count, no shuffle, stable when rows are added."""
    return df.withColumn("type", F.when(hash_fraction(key, seed) < frac, "train").otherwise("test"))


def assign_folds(
    df: DataFrame, label: str, folds: int = 5, key: str = "review_id", seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Adds a fold number 0..folds-1 that keeps the class shares in every fold."""
    ranked = running_totals(
        df.withColumn("_hash", hash_key(key, seed)).withColumn("_one", F.lit(1)), ["_hash", key], ["_one"], [label]
    )
    return ranked.withColumn(name, ((F.col("cum__one") - 1) % folds).cast("int")).select(*df.columns, name)
