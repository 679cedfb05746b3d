"""Python steps and vocabularies keep to columns and to few terms; results are those of plain Python."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors
from pyspark.util import PythonEvalType

from lexispark.functions import stem
from lexispark.operators import embeddings, joins, terms
from lexispark.session import stage


def test_sparse_cells_are_columns(spark):
    rows = [("a", Vectors.sparse(9, [1, 4], [2.0, 3.0])), ("b", Vectors.sparse(9, [], [])), ("c", Vectors.sparse(9, [8], [1.0]))]
    got = spark.createDataFrame(rows, ["id", "v"]).coalesce(1).select("id", terms.sparse_cells("v").alias("cells")).collect()
    assert {r["id"]: [tuple(c) for c in r["cells"]] for r in got} == {"a": [(1, 2.0), (4, 3.0)], "b": [], "c": [(8, 1.0)]}
    assert terms.sparse_cells.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF  # no object for each entry


def test_stems_of_arrays_with_nulls(spark):
    table = pa.table({"tokens": pa.array([["skies", "running", "skies"], [], None, ["nationals"]], pa.list_(pa.string()))})
    got = [r[0] for r in spark.createDataFrame(table).select(stem.stem_tokens("tokens")).collect()]
    assert got == [["sky", "run", "sky"], [], None, [stem.porter2("nationals")]]


def corpus(spark):
    rng = np.random.default_rng(2)
    texts = [[f"w{int(k)}" for k in rng.zipf(1.5, 30) if k < 400] for _ in range(300)]
    return texts, stage(spark.createDataFrame(pa.table({"review_id": [str(i) for i in range(300)], "tokens": texts})).repartition(4), "batches")


def test_vocabulary_counts_few_ngrams(spark, monkeypatch):
    texts, docs = corpus(spark)
    want, counts = Counter(), Counter()
    for t in texts:
        grams = [" ".join(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)]
        counts.update(grams)
        want.update(set(grams))
    seen, plain = [], terms.term_statistics
    monkeypatch.setattr(terms, "term_statistics", lambda rows: (seen.append(rows.select("term").distinct().count()), plain(rows))[1])
    got = {r["term"]: (r["term_count"], r["doc_count"]) for r in terms.dtm_vocabulary(docs, 3, 10, 0.9).collect()}
    assert got == {g: (counts[g], n) for g, n in want.items() if n >= 10 and n > 300 * (1 - 0.9) and len(g) >= 3}
    assert any(" " in g for g in got) and sum(seen) < len(want) / 3


def test_means_need_no_sort(spark):
    texts, docs = corpus(spark)
    rng = np.random.default_rng(4)
    vectors = {f"w{i}": rng.standard_normal(6) for i in range(1, 300)}
    table = stage(spark.createDataFrame(pa.table({"word": list(vectors), "vector": [v.tolist() for v in vectors.values()]})), "vectors")
    means = embeddings.vector_average(docs, table, 6, ["w1"])
    got = {int(r["review_id"]): r["vector"] for r in means.collect()}
    for i, t in enumerate(texts):
        known = [vectors[w] for w in t if w in vectors and w != "w1"]
        assert np.allclose(got[i], np.mean(known, axis=0) if known else np.zeros(6))
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_frequent_words_are_named_by_their_document_counts(spark, monkeypatch):
    texts, docs = corpus(spark)
    want = {tuple(r) for r in terms.tfidf(docs, cut=None).collect()}

    def sketch(*_):
        raise AssertionError("a pass over all rows to find what the document counts say")

    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "heavy_keys", sketch)
    monkeypatch.setattr(joins, "HEAVY_KEYS", 5)
    assert {tuple(r) for r in terms.tfidf(docs, cut=None).collect()} == want and len(want) > 1000
