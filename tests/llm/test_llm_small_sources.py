"""The line stage of the pipeline on sources of a few documents."""

import brute

import corpus_pipeline


def test_lines_of_small_sources_go(spark):
    line = "Copyright notice of this site"
    # sources by position: every seventh row has none, the others go by turns
    rows = [(i, f"{line}\nbody of document {i}") for i in range(21)]
    docs = brute.documents(spark, rows)
    sizes = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    assert max(sizes.values()) < 10 and min(sizes.values()) == 3
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {i: f"body of document {i}" for i in range(21)}


def test_lines_of_one_or_two_documents_stay(spark):
    docs = brute.documents(spark, [(i, "the same line") for i in range(6)])
    assert {r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {"the same line"}
