"""Plan properties that matter at scale."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from lexispark.operators import cleaning, corpus, joins, ranking, terms
from lexispark.plans import fixture as fx
from lexispark.session import spread_scan, stage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id as string) review_id", "text review_text")


def test_row_local_work_has_no_shuffle(spark, sf):
    docs = cleaning.tokenized(scan(spark, sf), fx.STOP)
    for df in (
        docs, terms.doc_term_count(docs), terms.ngram_counts(docs), terms.term_rank(docs), terms.feature_hashing(docs),
        cleaning.token_rows(docs), cleaning.clean_reviews(scan(spark, sf), fx.STOP, False, ["review_id"]),
        fx.fraction_split(scan(spark, sf)),
    ):
        assert "Exchange" not in plan(df)


def test_tokenizer_runs_once(spark, sf):
    docs = cleaning.tokenized(scan(spark, sf), fx.STOP)
    for df in (
        cleaning.words_of(docs), cleaning.token_rows(docs), terms.doc_term_count(docs), terms.ngram_counts(docs),
        cleaning.clean_reviews(scan(spark, sf), fx.STOP, False, ["review_id"]), terms.feature_hashing(docs),
    ):
        assert plan(df).count("regexp_extract_all") == 1


def test_scan_reads_only_needed_columns(spark, sf):
    text = plan(fx.documents(spark, sf).select("review_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in text
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src7)]" in plan(
        corpus.filter_source(spark.read.parquet(f"{sf}/documents.parquet"), "source", "src7")
    )


def test_vocabulary_join_follows_its_size(spark, sf, monkeypatch):
    docs = cleaning.tokenized(scan(spark, sf), fx.STOP)
    vocab = terms.dtm_vocabulary(docs)
    small = terms.dtm_with_dictionary(docs, vocab)
    assert "BroadcastHashJoin" in plan(small) and "hashpartitioning" not in plan(small)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10)
    try:
        wide = terms.dtm_with_dictionary(docs, vocab)
        assert "SortMergeJoin" in plan(wide) and "BroadcastHashJoin" in plan(wide)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert wide.exceptAll(small).count() == 0 and wide.count() == small.count()


def test_dedup_limits_groups_before_the_shuffle(spark, sf):
    text = plan(ranking.dedup_first(scan(spark, sf), "review_text", ["review_id"]))
    exchange = text.index("Exchange")
    assert "WindowGroupLimit" in text[exchange:]  # below the exchange: on the map side


def test_no_cartesian_products(spark, sf):
    import __spark_entry__ as entry

    for name in ("threshold_at_mean", "parameter_grid", "threshold_sweep", "distinct_words_summary", "tfidf", "sample_n"):
        text = plan(entry.queries()[name](spark, sf))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_spread_scan_leaves_wide_tables_alone(spark, sf):
    wide = stage(scan(spark, sf).repartition(40))
    assert "Exchange" not in plan(spread_scan(wide, "review_id"))
    few = spread_scan(scan(spark, sf), "review_id")
    assert "REPARTITION_BY_NUM" in plan(few)


def test_staged_table_has_its_size(spark):
    staged = stage(spark.range(1000).withColumn("x", F.col("id") * 2))
    assert staged._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 100_000


def test_workers_do_not_need_the_package(sf, tmp_path):
    """Run from elsewhere, so that Python workers can not import the library."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from lexispark.session import build_session
import __spark_entry__ as entry
spark = build_session(master="local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
for name in ("clean_reviews", "stem_words", "cast_sparse", "lsa_foldin"):
    assert entry.queries()[name](spark, {sf!r}).count() > 0, name
from lexispark.operators import gibbs, latent, skipgram
from lexispark.plans import fixture as fx
from lexispark.plans.catalog_learning import _count_vectors
train, test, words = _count_vectors(spark, {sf!r}, sparse=0.9)
assert gibbs.gibbs_fit(train, len(words), k=3, burn_in=1, iterations=1).transform(test).count() > 0
assert latent.lanczos_fit(train, words).transform(test).count() > 0
assert skipgram.skipgram_fit(fx.docs(spark, {sf!r}), dim=4, epochs=1, shards=2).count() > 0
"""
    path = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
