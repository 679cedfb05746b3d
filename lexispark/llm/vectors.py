"""Vector tables for the searches: valid rows, each with a number of its own and its dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row long, id long, vector array<double>, dim int): rows with an id and a vector of finite components only.

    ``row`` tells rows apart that share an id or are equal. It depends on the partitioning, so it holds once the result is staged.
    """
    vector = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector", F.size("vector").alias("dim"))
