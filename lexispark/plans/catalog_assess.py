"""Queries: assessment of predictions, lexicon classifier, run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions.text import round_prediction
from lexispark.operators import assessment as ass
from lexispark.operators import describe, lexicon, runlog
from lexispark.plans import fixture as fx
from lexispark.plans.fixture import with_sql
from lexispark.plans.registry import query
from lexispark.session import new_folder
from lexispark.sources.readers import read_run_logs
from lexispark.sources.writers import log_name, write_run_log


def _sweep_sql(by: str) -> str:
    cols = "".join(f"{c}, " for c in by.split(", "))
    return f"""sweep AS (SELECT {cols} i / 100::DOUBLE AS cut,
    sum(CASE WHEN prob < i / 100::DOUBLE AND actual = 0 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(1 - actual), 0) AS spec,
    sum(CASE WHEN prob > i / 100::DOUBLE AND actual = 1 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(actual), 0) AS sens,
    sum(CASE WHEN (prob > i / 100::DOUBLE AND actual = 1) OR (prob < i / 100::DOUBLE AND actual = 0) THEN 1 ELSE 0 END)::DOUBLE
    / count(*) AS acc FROM pred, range(0, 101) r(i) GROUP BY ALL)"""


def _auc_sql(by: str, score: str = "prob", name: str = "area") -> str:
    return f"""{name} AS (SELECT {by}, sum(neg * (p - upto + pos / 2::DOUBLE)) / nullif(max(p) * max(n), 0) AS auc FROM (
    SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY s)::DOUBLE AS upto, sum(pos) OVER (PARTITION BY {by})::DOUBLE AS p,
    sum(neg) OVER (PARTITION BY {by})::DOUBLE AS n FROM (SELECT {by}, {score} AS s, sum(actual) AS pos, sum(1 - actual) AS neg
    FROM pred GROUP BY ALL)) GROUP BY {by})"""


def _cuts_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT model, i / 99::DOUBLE AS cut,
    sum(CASE WHEN (prob > i / 99::DOUBLE) = (actual = 1) THEN 1 ELSE 0 END)::DOUBLE / count(*) AS acc
    FROM {source}, range(0, 100) r(i) GROUP BY ALL)"""


@query("threshold_sweep", with_sql("SELECT model, cut, round(spec, 6) AS spec, round(sens, 6) AS sens, round(acc, 6) AS acc FROM sweep", "pred", extra=(_sweep_sql("model"),)))
def _(spark, sf):
    return fx.round6(ass.threshold_sweep(fx.predictions(spark, sf)), "spec", "sens", "acc")


@query("auc", with_sql("SELECT model, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS auc_symmetric FROM area", "pred", extra=(_auc_sql("model"),)))
def _(spark, sf):
    return fx.round6(ass.auc(fx.predictions(spark, sf)), "auc", "auc_symmetric")


@query(
    "hard_auc",
    with_sql(
        "SELECT model, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS auc_symmetric FROM area", "pred",
        extra=(_auc_sql("model", "round_even(prob, 0)"),),
    ),
)
def _(spark, sf):
    return fx.round6(ass.hard_auc(fx.predictions(spark, sf)), "auc", "auc_symmetric")


@query("accuracy_by_cut", with_sql("SELECT model, cut, round(acc, 6) AS acc FROM cuts", "pred", extra=(_cuts_sql("cuts", "pred"),)))
def _(spark, sf):
    return fx.round6(ass.accuracy_by_cut(fx.predictions(spark, sf)), "acc")


@query(
    "best_cut",
    with_sql("SELECT model, cut, round(acc, 6) AS acc FROM cuts QUALIFY acc = max(acc) OVER (PARTITION BY model)", "pred", extra=(_cuts_sql("cuts", "pred"),)),
)
def _(spark, sf):
    return fx.round6(ass.best_cut(ass.accuracy_by_cut(fx.predictions(spark, sf))), "acc")


@query(
    "apply_best_cut",
    with_sql(
        """SELECT model, b.cut, round(b.acc, 6) AS acc_train, round(e.acc, 6) AS acc_test FROM
        (SELECT model, min(cut) AS cut, max(acc) AS acc FROM (SELECT * FROM train QUALIFY acc = max(acc) OVER (PARTITION BY model))
        GROUP BY model) b JOIN test e USING (model, cut)""", "pred",
        extra=(
            _cuts_sql("train", "(SELECT * FROM pred WHERE approach <> 'foldin')"),
            _cuts_sql("test", "(SELECT * FROM pred WHERE approach = 'foldin')"),
        ),
    ),
)
def _(spark, sf):
    pred = fx.predictions(spark, sf)
    out = ass.apply_best_cut(pred.where("approach <> 'foldin'"), pred.where("approach = 'foldin'"))
    return fx.round6(out, "acc_train", "acc_test")


@query("roc_points", with_sql("SELECT model, cut, round(1 - spec, 6) AS fpr, round(sens, 6) AS tpr FROM sweep", "pred", extra=(_sweep_sql("model"),)))
def _(spark, sf):
    return fx.round6(ass.roc_points(ass.threshold_sweep(fx.predictions(spark, sf))), "fpr", "tpr")


_ASSESS_SQL = (_sweep_sql("approach, model"), _auc_sql("approach, model"))


@query(
    "assess_runs",
    with_sql(
        """SELECT approach, model, round(acc_max, 6) AS acc_max, round(greatest(auc, 1 - auc), 6) AS auc FROM
        (SELECT approach, model, max(acc) AS acc_max FROM sweep GROUP BY ALL) JOIN area USING (approach, model)""", "pred", extra=_ASSESS_SQL,
    ),
)
def _(spark, sf):
    return fx.round6(ass.assess_runs(fx.predictions(spark, sf)), "acc_max", "auc")


@query("max_accuracy", with_sql("SELECT model, round(max(acc), 6) AS acc_max FROM sweep GROUP BY model", "pred", extra=(_sweep_sql("model"),)))
def _(spark, sf):
    return fx.round6(ass.max_accuracy(ass.threshold_sweep(fx.predictions(spark, sf))), "acc_max")


@query(
    "confusion_matrix",
    with_sql(
        """SELECT model, tp, fp, tn, fn, round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fn, 0), 6) AS sens,
        round(tn / nullif(tn + fp, 0), 6) AS spec,
        round(((tp + tn) / n - pe) / (1 - pe), 6) AS kappa FROM (SELECT *, (tp + fp + tn + fn)::DOUBLE AS n,
        ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn))::DOUBLE AS pe FROM
        (SELECT model, CAST(count(*) FILTER (prob > 0.5 AND actual = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (prob > 0.5 AND actual = 0) AS BIGINT) AS fp,
        CAST(count(*) FILTER (prob <= 0.5 AND actual = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (prob <= 0.5 AND actual = 1) AS BIGINT) AS fn
        FROM pred GROUP BY model))""", "pred",
    ),
)
def _(spark, sf):
    pred = fx.predictions(spark, sf).withColumn("predicted", (F.col("prob") > 0.5).cast("int"))
    return fx.round6(ass.confusion_matrix(pred, "predicted", "actual", ["model"]), "accuracy", "sens", "spec", "kappa")


@query(
    "score_histogram",
    with_sql("SELECT model, actual, CAST(least(floor(prob * 30), 29) + 1 AS INTEGER) AS bin, count(*) AS n FROM pred GROUP BY ALL", "pred"),
)
def _(spark, sf):
    return ass.score_histogram(fx.predictions(spark, sf))


@query("correct_count", with_sql("SELECT model, count(*) AS n FROM pred WHERE round_even(prob, 0) = actual GROUP BY model", "pred"))
def _(spark, sf):
    return ass.correct_count(fx.predictions(spark, sf))


@query("round_prediction", with_sql("SELECT review_id, model, CAST(round_even(prob, 0) AS INTEGER) AS predicted FROM pred", "pred"))
def _(spark, sf):
    return fx.predictions(spark, sf).select("review_id", "model", round_prediction("prob").alias("predicted"))


@query(
    "zero_on_failure",
    with_sql(
        """SELECT model, CASE WHEN model = 'glmnet' THEN 0 ELSE round(greatest(auc, 1 - auc), 6) END AS auc,
        CASE WHEN model = 'glmnet' THEN 0 ELSE round(acc_max, 6) END AS acc_max FROM area
        JOIN (SELECT model, max(acc) AS acc_max FROM sweep GROUP BY model) USING (model)""", "pred",
        extra=(_sweep_sql("model"), _auc_sql("model")),
    ),
)
def _(spark, sf):
    pred = fx.predictions(spark, sf)
    metrics = ass.assess_runs(pred, ["model"]).select("model", "auc", "acc_max")
    failed = pred.withColumn("prob", F.when(F.col("model") == "glmnet", 0.0).otherwise(F.col("prob")))
    return fx.round6(ass.zero_on_failure(failed, metrics), "auc", "acc_max")


# --- lexicon scores ---
_SCORED = """scored AS (SELECT review_id, rating, binary_rating, avg(afinn_score) AS score FROM rkept JOIN scores USING (word) GROUP BY ALL)"""


@query("afinn_score", with_sql("SELECT review_id, round(avg(afinn_score), 6) AS afinn_score FROM kept JOIN scores USING (word) GROUP BY review_id", "kept", "scores"))
def _(spark, sf):
    return fx.round6(lexicon.afinn_score(fx.docs(spark, sf), fx.score_lexicon(spark)), "afinn_score")


def _classified(spark, sf):
    return lexicon.afinn_classifier(fx.reviews(spark, sf), fx.score_lexicon(spark), fx.STOP)


@query(
    "threshold_at_mean",
    "SELECT doc_id, CAST(n_chars > (SELECT avg(n_chars) FROM documents) AS INTEGER) AS predicted FROM documents",
)
def _(spark, sf):
    df = lexicon.threshold_at_mean(fx.table(spark, sf, "documents"), "n_chars")
    return df.select("doc_id", "predicted")


@query(
    "afinn_classifier",
    with_sql(
        """SELECT review_id, rating, binary_rating, round(score, 6) AS afinn_score,
        CAST(score > (SELECT avg(score) FROM scored) AS INTEGER) AS predicted FROM scored""", "rkept", "scores", extra=(_SCORED,),
    ),
)
def _(spark, sf):
    return fx.round6(_classified(spark, sf), "afinn_score")


@query(
    "afinn_confusion",
    with_sql(
        """SELECT tp, fp, tn, fn, round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fn, 0), 6) AS sens,
        round(tn / nullif(tn + fp, 0), 6) AS spec, round(((tp + tn) / n - pe) / (1 - pe), 6) AS kappa FROM (SELECT *,
        (tp + fp + tn + fn)::DOUBLE AS n, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + tn + fn) * (tp + fp + tn + fn))::DOUBLE AS pe
        FROM (SELECT CAST(count(*) FILTER (p AND binary_rating = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (p AND binary_rating = 0) AS BIGINT) AS fp,
        CAST(count(*) FILTER (NOT p AND binary_rating = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (NOT p AND binary_rating = 1) AS BIGINT) AS fn
        FROM (SELECT *, score > (SELECT avg(score) FROM scored) AS p FROM scored)))""", "rkept", "scores", extra=(_SCORED,),
    ),
)
def _(spark, sf):
    return fx.round6(lexicon.afinn_confusion(_classified(spark, sf)), "accuracy", "sens", "spec", "kappa")


@query(
    "boxplot_stats",
    with_sql(
        """SELECT rating, round(min(score), 6) AS min, round(quantile_cont(score, 0.25), 6) AS q1, round(quantile_cont(score, 0.5), 6) AS median,
        round(quantile_cont(score, 0.75), 6) AS q3, round(max(score), 6) AS max FROM scored GROUP BY rating""", "rkept", "scores", extra=(_SCORED,),
    ),
)
def _(spark, sf):
    scored = _classified(spark, sf)
    return fx.round6(describe.boxplot_stats(scored, "afinn_score", "rating"), "min", "q1", "median", "q3", "max")


_NRC_COLS = ", ".join(
    f"CAST(count(*) FILTER (sentiment = '{s}') AS BIGINT) AS {s}" for s in (*lexicon.EMOTIONS, *lexicon.POLARITIES)
)
_NRC_SQL = f"""nrc AS (SELECT review_id, {_NRC_COLS}, CAST(count(sentiment) AS BIGINT) AS "count",
    CAST(count(*) FILTER (sentiment = 'positive') - count(*) FILTER (sentiment = 'negative') AS BIGINT) AS valence
    FROM docs LEFT JOIN (SELECT review_id, sentiment FROM kept JOIN emotions USING (word)) h USING (review_id) GROUP BY review_id)"""


@query("nrc_emotions", with_sql("SELECT * FROM nrc", "docs", "kept", "emotions", extra=(_NRC_SQL,)))
def _(spark, sf):
    return lexicon.nrc_emotions(fx.docs(spark, sf), fx.emotion_lexicon(spark))


@query(
    "emotion_shares",
    with_sql(
        """SELECT emotion, round(n / sum(n) OVER (), 6)::DOUBLE AS share FROM (SELECT sentiment AS emotion, count(*) AS n FROM kept
        JOIN emotions USING (word) WHERE sentiment NOT IN ('positive', 'negative') GROUP BY sentiment) ORDER BY share""", "kept", "emotions",
    ),
)
def _(spark, sf):
    return fx.round6(lexicon.emotion_shares(lexicon.nrc_emotions(fx.docs(spark, sf), fx.emotion_lexicon(spark))), "share")


# --- run logs ---
_RUNS_SQL = (_sweep_sql("dataset, approach, model"), _auc_sql("dataset, approach, model"))
_METRICS_SQL = """metrics AS (UNPIVOT (SELECT approach, model, 'pseudo' AS technique, dataset, CAST(1000 AS BIGINT) AS size,
    acc_max, greatest(auc, 1 - auc) AS auc FROM (SELECT dataset, approach, model, max(acc) AS acc_max FROM sweep GROUP BY ALL)
    JOIN area USING (dataset, approach, model)) ON acc_max, auc INTO NAME metric VALUE value)"""


def _run_metrics(spark, sf):
    runs = ass.assess_runs(fx.predictions(spark, sf), ["dataset", "approach", "model"])
    return runs.withColumn("technique", F.lit("pseudo")).withColumn("size", F.lit(1000).cast("long"))


def _logged(spark, sf):
    """The runs written as JSON logs and read back."""
    logs = runlog.nest_results(_run_metrics(spark, sf))
    at = F.to_timestamp(F.lit("2017-06-01 12:30:00"))
    path = new_folder(spark, "run-logs")
    write_run_log(logs, path, log_name(F.col("file_path.technique"), F.col("file_path.dataset"), F.col("file_path.size"), at))
    return read_run_logs(spark, path)


_FLAT_COLS = "approach, model, metric, round(value, 6) AS value, technique, dataset, size"
_FLAT = with_sql(f"SELECT {_FLAT_COLS} FROM metrics", "pred", extra=(*_RUNS_SQL, _METRICS_SQL))


@query("flatten_results", _FLAT)
def _(spark, sf):
    return fx.round6(runlog.flatten_results(_logged(spark, sf)), "value")


@query("unpivot_metrics", _FLAT)
def _(spark, sf):
    df = runlog.unpivot_metrics(_run_metrics(spark, sf), ["approach", "model", "technique", "dataset", "size"])
    return fx.round6(df, "value")


@query(
    "mean_metric_by_group",
    with_sql(
        """SELECT model, approach, metric, technique, 'all' AS dataset, size, round(avg(value), 6) AS value FROM metrics GROUP BY ALL""",
        "pred", extra=(*_RUNS_SQL, _METRICS_SQL),
    ),
)
def _(spark, sf):
    flat = runlog.flatten_results(_logged(spark, sf)).withColumn("dataset", F.lit("all"))
    return fx.round6(runlog.mean_metric_by_group(flat), "value")


@query(
    "learning_curve",
    with_sql(
        "SELECT dataset, approach, size, round(value, 6) AS value FROM metrics WHERE metric = 'auc' AND model = 'xgboost'",
        "pred", extra=(*_RUNS_SQL, _METRICS_SQL),
    ),
)
def _(spark, sf):
    means = runlog.mean_metric_by_group(runlog.flatten_results(_logged(spark, sf)))
    return fx.round6(runlog.learning_curve(means), "value")


_LOG_FILES = """SELECT DISTINCT '2017-06-01T123000_pseudo_' || lang || '_1000.log' AS log, lang AS dataset, 'pseudo' AS technique
    FROM labels JOIN documents USING (doc_id)"""


def _log_files(logs):
    log = F.regexp_extract(F.col("file"), r"log_name=([^/]+)/", 1)
    return logs.select(log.alias("log"), "file_path.dataset", "file_path.technique")


@query("write_run_log", _LOG_FILES)
def _(spark, sf):
    return _log_files(_logged(spark, sf))


@query(
    "read_run_logs",
    with_sql("SELECT dataset, approach, CAST(count(*) AS BIGINT) AS n_models FROM (SELECT DISTINCT dataset, approach, model FROM pred) GROUP BY ALL", "pred"),
)
def _(spark, sf):
    logs = _logged(spark, sf)
    tables = logs.select("file_path.dataset", F.explode("results").alias("approach", "tables"))
    return tables.select("dataset", "approach", F.size(F.get("tables", F.lit(0))).cast("long").alias("n_models"))
