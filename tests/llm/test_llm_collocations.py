"""Collocations against plain counting; the burst trie on its own with small limits."""

import random
import re
from collections import Counter as Count
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from lexispark.llm import collocations as co


def plain_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_collocations(rows, least, longest, top, share=100):
    f, n = defaultdict(Count), Count()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", plain_lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in f:
        often = {p: a for p, a in f[lang].items() if a >= least}
        longer = Count()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        rows = []
        for p, a in often.items():
            if len(p) > 1 and not (p in longer and 100 * longer[p] >= share * a):
                score, _, left, right = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p), left, right))
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode()))
        out += [(lang, k + 1, p, -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(rows[:top])]
    return out


def frame(spark, rows):
    return spark.createDataFrame(pa.table({
        "lang": pa.array([r[0] for r in rows], pa.string()), "text": pa.array([r[1] for r in rows], pa.string()),
        "phrase": pa.array([1] * len(rows)), "n": pa.array(["x"] * len(rows)), "ids": pa.array([None] * len(rows), pa.int32()),
    }))


def check(spark, rows, **options):
    got = co.collocations(frame(spark, rows), **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    want = plain_collocations(rows, **options)
    assert sorted(map(tuple, got)) == sorted(want)
    return got


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["the", "The", "of", "naïve", "É", "日本", "x_y", "a-b", "don't", "\x00", "w" * 3000] + [f"w{k}" for k in range(40)]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: "".join(rng.choices(words, weights)[0] + rng.choices([" ", "  ", "\t", ", ", ".", "\n", "\x0b", "; "], [12, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(n))
    out = [(rng.choice(["en", "en", "en", "fr", None, "und", ""]), text(rng.choice([0, 1, 3, 60, 200]))) for _ in range(120)]
    out += [("en", "to be or not to be " * 40), ("en", "aha aha aha aha aha " * 30), ("fr", text(20000)), ("de", None), (None, None), ("es", "")]
    return out + [out[3]] * 5


def test_collocations_match_plain_counting(spark, rows):
    got = check(spark, rows, least=5, longest=5, top=2000)
    assert {r.lang for r in got} >= {"en", "fr", "und", ""} and max(len(r.phrase.split(" ")) for r in got) == 5
    check(spark, rows, least=3, longest=2, top=7)
    check(spark, rows, least=4, longest=3, top=50, share=60)


def test_awkward_and_empty_tables(spark):
    check(spark, [("en" if k % 2 else None, t) for k, (_, t) in enumerate(brute.awkward_documents())], least=2, longest=5, top=2000)
    assert co.collocations(frame(spark, [])).count() == 0


def test_trie_bursts_and_spills_whole_counts(monkeypatch):
    monkeypatch.setattr(co, "BURST", 6)
    rng = np.random.default_rng(2)
    for size in (2, 3, 4, 5):
        counter, want, got = co.Counter(parts=5), Count(), Count()
        seen, most = defaultdict(set), 0
        for step in range(30):
            block = rng.zipf(1.5, (200, size)).clip(0, 30).astype(np.uint64)
            want.update(map(tuple, block.tolist()))
            counter.add("en", [counter.local(c) for c in block.T])
            most = max(most, len(counter.tries["en", size].nodes))
            for batch in counter.runs(100 if step < 29 else 0):
                for r in batch.to_pylist():
                    keys = np.frombuffer(r["ids"], np.uint64).reshape(-1, r["size"])
                    assert [tuple(k) for k in keys.tolist()] == sorted(map(tuple, keys.tolist()))
                    for k, n in zip(keys.tolist(), np.frombuffer(r["counts"], np.int32).tolist()):
                        got[tuple(k)] += n
                        seen[tuple(k)].add(r["part"])
            assert sum(t.entries for t in counter.tries.values()) <= 100
        assert got == want and all(len(p) == 1 for p in seen.values()) and most > 20


def test_filter_holds_all_it_was_given(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(-(2**63), 2**63, (3000, 2))
    frequent = spark.createDataFrame(pa.table({"lang": pa.array(["en", "fr"] * 1500), "ids": pa.array(keys.tolist(), pa.list_(pa.int64()))}))
    bits = co.bloom_filter(spark, frequent).value
    assert co.held(bits, keys[::2].astype(np.uint64), "en").all() and co.held(bits, keys[1::2].astype(np.uint64), "fr").all()
    assert co.held(bits, rng.integers(0, 2**63, (10000, 2)).astype(np.uint64), "en").mean() < 0.01
