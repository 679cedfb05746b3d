"""The near-copy stage of the pipeline: its classes are those of the SimHash operator, its rows are judged by their own texts."""

import brute
import numpy as np

import corpus_pipeline


def stay(spark, rows):
    return corpus_pipeline.simhash_dedup(spark, brute.documents(spark, rows), "").select("doc_id", "text").collect()


def test_first_of_each_class_stays(spark):
    rng = np.random.default_rng(11)
    originals = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 400)) for _ in range(12)]
    rows = list(enumerate(originals))
    for k, text in enumerate(originals):
        for places in (0, 1, 2, 5, 30):
            words = text.split()
            for at in rng.choice(len(words), places, replace=False):
                words[at] = f"changed{rng.integers(10**6)}"
            rows.append((100 + 20 * k + places, " ".join(words)))
    want = {i for i, _, c in brute.simhash_rows(rows) if i == c}
    assert set(range(12)) <= want and 12 < len(want) < 60
    assert sorted(r.doc_id for r in stay(spark, rows)) == sorted(want)


def test_one_id_with_different_texts(spark):
    one, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(5, one), (5, other), (5, one), (3, other), (7, one), (None, one), (9, "c d e f g h"), (9, "i j k l m n")]
    got = [(r.doc_id, r.text) for r in stay(spark, rows)]
    # equal rows but for another column count as one as well
    assert set(got) == {(5, one), (3, other), (None, one), (9, "c d e f g h"), (9, "i j k l m n")} and len(got) == 5


def test_awkward_rows(spark):
    rows = [(i, t) for i, t in brute.awkward_documents() if i is not None]
    first = {}
    for i, f, c in brute.simhash_rows(rows):
        if i == c:
            first.setdefault((i, f), None)
    assert len(stay(spark, rows)) == len(first)
