"""URL filters: hosts, paths and listed rules against plain Python, mined rules against all token combinations."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from lexispark.llm.catalog import LLM_ORACLES, LLM_QUERIES, URL_RULES
from lexispark.llm.urls import judge_urls


def plain_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return plain_lower(host), path


def plain_rule(host, path, rules):
    fits = []
    for action, rule in rules:
        domain, slash, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith(slash + start):
            fits.append((len(rule), rule, action))
    return max(fits)[1:] if fits else (None, None)


def plain_tokens(url):
    low = re.sub("[0-9]+", "\x01", plain_lower(url or ""))
    scheme, _, rest = low.partition("://") if "://" in low else ("", "", low)
    host, path, query, fragment = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?", rest, re.S).groups()
    cut = [("s:", scheme, "[^a-z]+"), ("h:", host, "[.:@-]+"), ("p:", path, "[/._-]+"), ("q:", query or "", "[&;]+"), ("f:", fragment or "", "[/&;._-]+")]
    return {m + w.replace("\x01", "#") for m, part, at in cut for w in re.split(at, part) if w}


def plain_verdicts(rows, labels, rules, support, least, confidence, longest=3):
    bad = defaultdict(bool)
    for i, quality, toxic in labels:
        if i is not None and (quality is not None or toxic is not None):
            bad[i] |= quality == 0 or toxic == 1
    taught = [(frozenset(plain_tokens(u)), bad[i]) for i, u in rows if i in bad]
    floor = max(least, -(-int(support * 100000) * len(taught) // 100000))
    on = defaultdict(list)
    for k, (t, _) in enumerate(taught):
        for x in t:
            on[x].append(k)
    standing = {}
    for x in sorted(on):
        standing.setdefault(tuple(on[x]), x)
    known = set(standing.values())
    n, n_bad = Counter(), Counter()
    for t, b in taught:
        for size in range(1, longest + 1):
            for s in itertools.combinations(sorted(t & known), size):
                n[s] += 1
                n_bad[s] += b
    sure = [frozenset(s) for s in n if n_bad[s] >= floor and 100 * n_bad[s] >= confidence * n[s]]
    out = []
    for i, u in rows:
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path, rules)
        out.append((i, host, path, rule, verdict or ("block" if any(s <= plain_tokens(u) for s in sure) else "allow")))
    return out


def by_text(rows):
    return sorted(map(tuple, rows), key=repr)


URLS = [
    None, "", "no scheme at all", "http://", "https://Example.COM/en/1", "https://www.example.com/en/2?q=1", "http://notexample.com/en/3", "http://a.net/es/x", "http://net/fr/y#z",
    "http://a.net/ES/x", "http://com", "http://com/", "http://x.com?en/", "http://x.com#a/b", "ftp://u@h.example.com:80/en/", "http://ÄRGER.example.com/en/Ä", "a://b://c.com/d",
    "http://a.com/x\ny/z", "http://" + "a." * 3000 + "com/en/" + "seg/" * 3000, "http://example.com/en", "x" * 100000,
]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    rows, labels = [(k, u) for k, u in enumerate(URLS)], []
    for i in range(100, 700):
        word, kind, lang = rng.choice(["casino", "news", "shop", "blog"]), rng.choice(["win", "daily", "free"]), rng.choice(["en", "de", "pt"])
        rows.append((i, f"https://www.{word}-{kind}.example.org/{lang}/{rng.randrange(10**6)}" + rng.choice(["", "?utm=1", "#top"])))
        spam = (word == "casino" and kind == "win") or (kind == "free" and lang == "pt" and rng.random() < 0.9)
        labels.append((i, rng.choice([1, 1, None]), int(spam)))
        if i % 3 == 0:
            rows.append(rows[-1])
    labels += [(None, 0, 1), (100, None, None), (101, 0, 0), (5000, 0, 1)]
    return rows, labels


def tables(spark, rows, labels):
    pages = pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string()),
                      "row": pa.array(["x"] * len(rows)), "rule": pa.array([None] * len(rows), pa.int32()), "doc_id": pa.array([7] * len(rows))})
    marks = pa.table({"doc_id": pa.array([r[0] for r in labels], pa.int64()), "quality": pa.array([r[1] for r in labels], pa.int32()),
                      "toxic": pa.array([r[2] for r in labels], pa.int32()), "page_id": pa.array([1] * len(labels))})
    return spark.createDataFrame(pages), spark.createDataFrame(marks)


def test_verdicts_match_all_combinations(spark, planted):
    rows, labels = planted
    got = judge_urls(*tables(spark, rows, labels), URL_RULES, support=0.005, least_pages=5, confidence=80)
    want = plain_verdicts(rows, labels, URL_RULES, 0.005, 5, 80)
    assert by_text(got.select("page_id", "host", "path", "rule", "verdict").collect()) == by_text(want)
    patterns = {p for r in got.select("pattern").distinct().collect() if r.pattern for p in r.pattern.split(" | ")}
    assert "h:casino & h:win" in patterns
    assert not any("h:casino" in p and "h:win" in p and p.count("&") > 1 for p in patterns)  # longer forms of it are spare


def test_no_labels_and_no_pages(spark, planted):
    rows, _ = planted
    pages, marks = tables(spark, rows, [])
    got = judge_urls(pages, marks, URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert by_text(got) == by_text(plain_verdicts(rows, [], URL_RULES, 0.005, 5, 80))
    assert judge_urls(*tables(spark, [], [(1, 0, 1)]), URL_RULES).count() == 0


def test_query_matches_sql(spark, sf):
    import compare

    name = "op11_url_filters"
    ok, info = compare.compare(spark, compare.duck(sf), name, LLM_QUERIES[name], LLM_ORACLES[name], sf)
    assert ok, info
