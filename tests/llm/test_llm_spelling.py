"""Spelling variants against all pairs of words; groups small enough to be halved several times."""

import random
import re
import zlib
from collections import Counter

import brute
import pytest

from lexispark.llm.spelling import spelling_variants


def plain_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_words(rows, least, rarest):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", plain_lower(text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= rarest}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def plain_variants(rows, least=7, rarest=2, times=10):
    n = plain_words(rows, least, rarest)
    near = {w: [] for w in n}
    words = sorted(n)
    for k, a in enumerate(words):
        for b in words[:k]:
            if one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda x: (-n[x], x.encode()), default=None)
        form[w] = top if top is not None and n[top] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def check(spark, rows, **options):
    got = spelling_variants(brute.documents(spark, rows), **options).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_variants(rows, **{k: v for k, v in options.items() if k in ("least", "rarest", "times")}), key=repr)
    return got


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    letters = "aabcdeéß÷"
    base = ["the" + "".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(200)]

    def change(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + w[k + 1 :]])

    words = [w for w in base for _ in range(rng.choice([2, 3, 40, 500]))] + [change(w) for w in base for _ in range(8)] * 2 + [change(change(w)) for w in base] * 2
    words += ["z" * 4000, "z" * 4001] * 3 + ["z" * 3999 + "y"] * 40 + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"] * 2 + ["Éaaaaaaa", "éaaaaaaa"] * 3
    rng.shuffle(words)
    texts = [rng.choice([" ", "1", ", ", "\n"]).join(words[k : k + 50]) for k in range(0, len(words), 50)]
    return list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (5, None), (6, ""), (7, "short")]


def test_variants_match_all_pairs(spark, rows):
    got = check(spark, rows)
    assert any(r.form is not None and r.root != r.form for r in got) and max(r.n_near for r in got) > 5


def test_crowded_halves_are_halved_again(spark, rows):
    check(spark, rows, group_words=4, bucket_words=50)
    check(spark, rows, least=4, rarest=1, times=2, group_words=2, bucket_words=10**6)


def test_awkward_and_empty_tables(spark):
    check(spark, [(r[0], r[1]) for r in brute.awkward_documents()])
    assert spelling_variants(brute.documents(spark, [])).count() == 0
