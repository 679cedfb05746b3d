"""Run logs: nested results of benchmark runs, flattened to metric rows and learning curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRIC = "STRUCT<model: STRING, acc_max: DOUBLE, auc: DOUBLE>"
RUN_LOG_SCHEMA = (
    "file_path STRUCT<technique: STRING, dataset: STRING, size: STRING>, "
    "params_xg MAP<STRING, STRING>, params_glm MAP<STRING, STRING>, paths_used MAP<STRING, STRING>, "
    f"results MAP<STRING, ARRAY<ARRAY<{METRIC}>>>, "
    "computation_time MAP<STRING, STRUCT<start: TIMESTAMP, end: TIMESTAMP, duration: DOUBLE>>"
)


def nest_results(metrics: DataFrame) -> DataFrame:
    """`technique, dataset, size, approach, model, acc_max, auc` rows to one run log per technique, dataset, size.

    `results` maps the approach to [[{model, acc_max}..], [{model, auc}..]]; a run has a handful of rows.
    """
    keys = ["technique", "dataset", "size"]

    def table(value: str) -> Column:
        empty = F.lit(None).cast("double")
        fields = {"acc_max": empty, "auc": empty, value: F.col(value)}
        return F.sort_array(F.collect_list(F.struct("model", *[v.alias(k) for k, v in fields.items()])))

    runs = metrics.groupBy(*keys, "approach").agg(F.array(table("acc_max"), table("auc")).alias("tables"))
    return runs.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("approach", "tables")))).alias("results")
    ).select(F.struct("technique", "dataset", F.col("size").cast("string").alias("size")).alias("file_path"), "results")


def _unbox(c: str) -> Column:
    """Scalars that were written as one-element arrays."""
    return F.regexp_replace(F.col(c), r'^\["?|"?\]$', "")


def flatten_results(log: DataFrame) -> DataFrame:
    """`approach, model, metric, value, technique, dataset, size` rows out of nested run logs."""
    per_table = log.select("file_path", F.explode("results").alias("approach", "tables")).select(
        "file_path", "approach", F.explode("tables").alias("rows")
    )
    rows = per_table.select("file_path", "approach", F.inline("rows"))
    return unpivot_metrics(rows, ["file_path", "approach", "model"], ["acc_max", "auc"]).select(
        "approach",
        "model",
        "metric",
        F.col("value").cast("double").alias("value"),
        _unbox("file_path.technique").alias("technique"),
        _unbox("file_path.dataset").alias("dataset"),
        _unbox("file_path.size").cast("double").cast("long").alias("size"),
    )


def unpivot_metrics(df: DataFrame, ids: list[str], values: list[str] | None = None) -> DataFrame:
    """`ids, metric, value`: every other column becomes a row; missing values give none."""
    values = values or [c for c in df.columns if c not in ids]
    return df.unpivot(ids, values, "metric", "value").where("value is not null")


def mean_metric_by_group(metrics: DataFrame) -> DataFrame:
    keys = ["model", "approach", "metric", "technique", "dataset", "size"]
    return metrics.groupBy(*keys).agg(F.avg("value").alias("value"))


def learning_curve(metrics: DataFrame, metric: str = "auc", model: str = "xgboost") -> DataFrame:
    """`dataset, approach, size, value` of one metric and model, by size."""
    wanted = metrics.where((F.col("metric") == metric) & (F.col("model") == model))
    return wanted.select("dataset", "approach", "size", "value").orderBy("dataset", "approach", "size")


def seconds_between(start, end) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def stage_duration(stages: DataFrame) -> DataFrame:
    """Adds `duration` in seconds to rows with `start` and `end`."""
    return stages.withColumn("duration", seconds_between(F.col("start"), F.col("end")))


def nest_computation_time(stages: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with `computation_time` mapping stage to start, end and duration (a few stages per run)."""
    entry = F.struct("stage", F.struct("start", "end", "duration").alias("times"))
    return stage_duration(stages).groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("computation_time")
    )
