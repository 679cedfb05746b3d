"""Row and column totals of the document-term matrix out of one pass over the text."""

import pytest

from lexispark.operators import describe


@pytest.mark.parametrize("n_max", [1, 2])
def test_totals_come_from_one_pass_over_the_text(spark, monkeypatch, n_max):
    docs = spark.createDataFrame([("a", ["x", "y", "x"]), ("a", ["y"]), ("x", []), ("b", None), (None, ["z", "x"])], "review_id STRING, tokens ARRAY<STRING>")
    staged, plain = [], describe.stage
    monkeypatch.setattr(describe, "stage", lambda df, name: (staged.append(df), plain(df, name))[1])
    rows, cols = describe.row_and_column_totals(docs, n_max)
    assert [tuple(r) for r in rows.collect()] == [("a", 4 if n_max == 1 else 6), (None, 2 if n_max == 1 else 3)]
    bigrams = [("x y", 1), ("y x", 1), ("z x", 1)] if n_max == 2 else []
    assert [tuple(r) for r in cols.collect()] == [("x", 3), ("y", 2), *sorted([*bigrams, ("z", 1)])]
    assert len(staged) == 1 and staged[0]._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
