"""The pipeline: every stage on its own input, and the registered queries' recall."""

import brute
import numpy as np
import pytest

import corpus_pipeline
from lexispark.llm import simhash, suffixes
from lexispark.llm.catalog import LLM_QUERIES, table
from lexispark.session import stage


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = table(spark, sf, "documents")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], sf), name))
    return out


def test_stages_keep_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_toxic_documents_go_and_clean_ones_stay(spark, sf, steps):
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in steps[1].select("doc_id").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    assert np.mean([i in kept for i in clean]) > 0.95
    assert kept <= {r.doc_id for r in steps[0].select("doc_id").collect()}


def test_one_of_each_near_copy_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].select("doc_id", "text").collect()]
    want = {i for i, _, c in brute.simhash_rows(rows) if i == c}
    assert [r.doc_id for r in steps[3].select("doc_id").orderBy("doc_id").collect()] == sorted(want)


def test_repeated_bytes_go(steps):
    rows = [(r.doc_id, r.text) for r in steps[3].select("doc_id", "text").collect()]
    want = {}
    units = [(i, (t or "").encode()) for i, t in rows]
    for (i, u), gone in zip(units, brute.repeated(units, 50, units)):
        want[i] = bytes(x for x, y in zip(u, gone) if not y).decode("utf-8", "ignore")
    got = {r.doc_id: r.text for r in steps[4].collect()}
    assert got == want
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())


def test_all_documents_are_packed(steps):
    packed = steps[5].select("doc_id").distinct().count()
    assert packed == steps[4].count()


def test_stages_take_awkward_documents(spark, sf):
    docs = brute.documents(spark)
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf), name)
    assert docs.count() > 0


def test_stages_take_an_empty_table(spark, sf):
    docs = brute.documents(spark, [])
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, sf), name)
    assert docs.count() == 0


def test_queries_match_plain_versions(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = LLM_QUERIES["op8_substring_dedup"](spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert brute.sorted_rows(got) == brute.sorted_rows(brute.substring_rows(rows))
    got = LLM_QUERIES["op6_suffix_array_dedup"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert brute.sorted_rows(got) == brute.sorted_rows(brute.suffix_rows(rows))
    got = LLM_QUERIES["op10_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()
    assert brute.sorted_rows(got) == brute.sorted_rows(brute.simhash_rows(rows))
    assert suffixes and simhash


def test_recall_of_the_multi_index_query(spark):
    sf = "/root/testdata/sf0.1"
    d = table(spark, sf, "embeddings").toPandas()
    x, ids = np.stack(d.embedding.values).astype(float), d.vec_id.values
    found = LLM_QUERIES["op5_inverted_multi_index"](spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for q in np.flatnonzero(ids % 100 == 0):
        dist = ((x - x[q]) ** 2).sum(1)
        dist[q] = np.inf
        hits.append(len(found[ids[q]] & set(ids[np.argsort(dist, kind="stable")[:10]])) / 10)
    assert np.mean(hits) >= 0.9
