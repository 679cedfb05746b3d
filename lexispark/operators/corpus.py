"""Shaping of review tables: keys, labels, tags, joins by key, set operations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.feature import RFormula, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.ranking import digest

KEYS = ("review_id", "rating", "binary_rating", "type")


# --- projections and filters ---
def composite_key(df: DataFrame, cols: list[str], sep: str = "_", name: str = "review_id") -> DataFrame:
    return df.withColumn(name, F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]))


def binary_label_gt3(df: DataFrame) -> DataFrame:
    """1 above three stars, else 0: three stars count as negative."""
    return df.withColumn("binary_rating", (F.col("rating") > 3).cast("int"))


def binary_label_drop_neutral(df: DataFrame) -> DataFrame:
    """1 above three stars, 0 below; three stars are dropped."""
    return binary_label_gt3(df.where(F.col("rating") != 3))


def recode_sentiment(df: DataFrame, col: str, mapping: dict[str, int]) -> DataFrame:
    """`rating` and `binary_rating` from a text label; rows with other labels are left out."""
    code = reduce(lambda acc, kv: acc.when(F.col(col) == kv[0], F.lit(kv[1])), mapping.items(), F)
    return df.where(F.col(col).isin(list(mapping))).withColumn("binary_rating", code.cast("int")).withColumn(
        "rating", F.col("binary_rating").cast("double")
    )


def select_rename_reorder(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns `mapping` names (old -> new), in its order; all others are dropped."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def filter_source(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == value)


def tag_type(df: DataFrame, value: str | Column) -> DataFrame:
    return df.withColumn("type", F.lit(value) if isinstance(value, str) else value)


def tag_type_by_rank(df: DataFrame, rank: str, n_train: int) -> DataFrame:
    """The first n_train rows by their row number are train, the rest test."""
    return tag_type(df, F.when(F.col(rank) <= n_train, "train").otherwise("test"))


def prefix_feature_columns(df: DataFrame, prefix: str = "feat_") -> DataFrame:
    """Prefix on every column whose name has a digit."""
    return df.toDF(*[prefix + c if re.search(r"[0-9]", c) else c for c in df.columns])


def filter_by_type(df: DataFrame, type: str) -> DataFrame:
    return df.where(F.col("type") == type)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS]


def split_features_label(df: DataFrame, label: str = "binary_rating") -> DataFrame:
    """`review_id, features, label`: every non-key column goes into the feature vector."""
    assembled = VectorAssembler(inputCols=feature_columns(df), outputCol="features").transform(df)
    return assembled.select("review_id", "features", F.col(label).cast("double").alias("label"))


def model_matrix_no_intercept(df: DataFrame, label: str = "binary_rating") -> DataFrame:
    """Design matrix `label ~ . - 1` of the non-key columns, as `review_id, features, label`."""
    formula = RFormula(formula=f"{label} ~ . - 1", featuresCol="features", labelCol="label")
    fitted = formula.fit(df.select(label, *feature_columns(df)))
    return fitted.transform(df).select("review_id", "features", "label")


def filter_empty_documents(reviews: DataFrame, term_counts: DataFrame) -> DataFrame:
    """Reviews that have at least one counted term."""
    return reviews.join(reviews_of(term_counts), "review_id", "left_semi")


def reviews_of(rows: DataFrame) -> DataFrame:
    """Ids in term-level rows, reduced to one per review before they are shuffled."""
    return rows.select("review_id").distinct()


# --- joins by key ---
def merge_by_review(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join by review; unmatched rows drop out."""
    return left.join(right, "review_id")


def bind_by_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """Column bind. Rows are matched by key, never by position; every left row stays."""
    shared = [c for c in right.columns if c in left.columns and c != "review_id"]
    return left.join(right.drop(*shared), "review_id", "left")


def align_labels(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Labels whose review survived feature building, ordered by id as text."""
    kept = labels.join(reviews_of(features), "review_id", "left_semi")
    return order_by_id_string(kept)


def orphan_features(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature rows without a label (to be dropped)."""
    return features.join(labels.select("review_id"), "review_id", "left_anti")


def lookup_by_keys(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `df` for every requested id; ids without a row give NULLs."""
    return ids.select("review_id").join(df, "review_id", "left")


def alignment_check(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Number of ids that occur on one side only; 0 where features and labels fit together."""
    f = features.select("review_id").distinct().withColumn("_f", F.lit(1))
    l = labels.select("review_id").distinct().withColumn("_l", F.lit(1))
    both = f.join(l, "review_id", "full")
    return both.agg(F.count_if(F.col("_f").isNull() | F.col("_l").isNull()).alias("n_mismatch"))


def assert_aligned(features: DataFrame, labels: DataFrame) -> None:
    n = alignment_check(features, labels).first()["n_mismatch"]
    if n:
        raise ValueError(f"features and labels differ in {n} reviews")


# --- order, sets ---
def order_by_id_string(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("review_id").cast("string"))


def union_rows(*dfs: DataFrame) -> DataFrame:
    """Stack by column name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def except_ids(all_ids: DataFrame, ids: DataFrame) -> DataFrame:
    return all_ids.join(ids.select("review_id"), "review_id", "left_anti")


def distinct_texts(df: DataFrame) -> DataFrame:
    """Each text once; a digest is the key, the text itself is only carried along."""
    return df.select("review_text", digest("review_text").alias("_key")).dropDuplicates(["_key"]).select("review_text")


def split_mix_after_features(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of features that were built on both together."""
    return filter_by_type(features, "train"), filter_by_type(features, "test")
