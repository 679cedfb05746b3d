"""Rare toxic expressions have evidence of their own."""

import brute
import numpy as np
import pyarrow as pa

from lexispark.llm import toxicity


def test_rare_expressions_have_evidence(spark):
    rng = np.random.default_rng(21)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        own = list(rng.choice(plain, 40))
        if i % 5 == 0:
            own.insert(20, "vile")
            # after the same word each time: too few different predecessors for the former floor of 12
            own[5:5] = ["such", "zqrare"] if i % 20 == 0 else []
        elif i % 4 == 1:
            own[5:5] = ["such", "zqplain"]
        rows.append((i, " ".join(own)))
        labels.append((i, 0, int(i % 5 == 0)))
    model = toxicity.fit(brute.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text = "w1 w2 w3 such {} w4 w5 w6"
    rare, ordinary, unknown = model.features(pa.array([text.format(x) for x in ("zqrare", "zqplain", "zqunseen")]))[:, 0]
    assert rare > unknown > ordinary
    assert len(model.words) >= 304


def test_share_is_drawn_to_its_backoff():
    n1 = np.array([0.0, 1, 4, 100])
    share = toxicity.toxic_share(np.zeros(4), n1, np.full(4, 0.1), 2.0, 0.01)
    assert abs(share[0] - 0.1) < 1e-9 and (np.diff(share) > 0).all() and share[1] < 0.11 and share[3] > 0.9
