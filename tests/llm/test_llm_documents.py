"""Document operators against plain versions, on documents with awkward cases."""

import hashlib
import struct
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.llm import exchange, lines, packing, pieces, simhash, substrings, suffixes, token_counts, toxicity
from lexispark.llm.catalog import tokenizer
from lexispark.llm.components import components
from lexispark.llm.textarrays import U64

ROWS = brute.awkward_documents()


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark).repartition(5, "bucket")


@pytest.fixture(scope="module")
def empty(spark):
    return brute.documents(spark, [])


def same(df, columns, want):
    assert brute.sorted_rows(df.select(*columns).collect()) == brute.sorted_rows(want)


# --- tokens ---
def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = []
    for i, t in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False))
        want.append((i, len((t or "").encode()), n, n > 300))
    same(token_counts.token_counts(docs, path, limit=300), ["doc_id", "n_bytes", "n_tokens", "over_limit"], want)
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_counts_of_random_strings():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    alphabet = list("ab the'sS.,!?12 \n\t ́éÉΣßİ日<|endoftext|>")
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(600)]
    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    assert token_counts.Counter(path).lengths(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_piece_encoding(docs, empty):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "")
        text = library.decode(ids)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    out = pieces.encode_texts(docs, path)
    same(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], want)
    assert pieces.decode_ids(out, path, into="again").filter("again != decoded").count() == 0
    assert pieces.encode_texts(empty, path).count() == 0


def test_piece_encoding_of_random_strings():
    rng = np.random.default_rng(3)
    model = pieces.PieceModel(tokenizer("piece_bpe_32k.model"))
    alphabet = list("abehint  th()[]{}=_-..\t\n▁1290é中")
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(1500)]
    assert [ids for ids, _ in model.encode(texts)] == model.library.encode(texts)


# --- packing ---
def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        start, size = 0, len(ids) % 256 or 256
        for piece in range(-(-len(ids) // 256)):
            own = ids[start : start + size]
            want.append((i, piece, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
            start, size = start + size, 256
    packed = packing.pack_documents(docs, path, capacity=256, shard_pieces=64).cache()
    same(packed, ["doc_id", "piece", "start", "length", "ids_crc32"], want)
    bins = {}
    for r in packed.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    total = sum(w[3] for w in want)
    assert len(bins) <= 1.05 * -(-total // 256) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_genetic_packing_is_never_worse_than_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(200, 900, 400)
    plain = np.full(400, -1, np.int64)
    packing.best_fit(lengths, plain, np.argsort(-lengths, kind="stable"), 2048)
    better = packing.evolve(lengths, [plain], 2048, seed=3, size=4, rounds=30)
    assert packing.fitness(lengths, better, 2048) >= packing.fitness(lengths, plain, 2048)
    assert np.bincount(better, lengths).max() <= 2048 and (better >= 0).all()
    child = packing.crossover(lengths, plain, better, 2048, rng)
    assert np.bincount(child, lengths).max() <= 2048


def test_encoder_of_random_strings():
    rng = np.random.default_rng(4)
    encoder = packing.Encoder(tokenizer("byte_bpe_50k.json"))
    alphabet = list("abthe'sS.,!1  \n\t \x1c\x85éɐ日") + ["<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(1500)]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.ids(texts)] == want


# --- repeats ---
def test_substring_dedup(docs, empty):
    out = substrings.remove_repeats(docs)
    same(out, ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.substring_rows(ROWS))
    assert set(docs.columns) < set(out.columns)
    for r in out.select("text", "n_words", "n_removed", "spans", "kept_sha256").collect():
        assert sum(s.words for s in r.spans) == r.n_removed
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
        assert len(brute.words(r.text)) == r.n_words - r.n_removed
    assert substrings.remove_repeats(empty, digest_only=True).count() == 0


def test_suffix_array_dedup(docs, empty):
    out = suffixes.remove_repeats(docs)
    same(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.suffix_rows(ROWS))
    assert set(docs.columns) < set(out.columns)
    assert suffixes.remove_repeats(empty, digest_only=True).count() == 0


def test_runs_of_windows_cover_each_window_once(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 10, 49, 50, 51, 700, 90, 2000)]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = suffixes.Runs(raw, at, 50)
    monkeypatch.setattr(suffixes, "SLICE_BYTES", 128)
    cut = suffixes.Runs(raw, at, 50)
    for runs in (whole, cut):
        starts = np.concatenate([np.arange(s, s + w) for s, w in zip(runs.start, runs.windows)])
        want = np.concatenate([np.arange(a, max(a, b - 49)) for a, b in zip(at[:-1], at[1:])])
        assert (starts == want).all() and runs.windows.max() <= 50
        assert runs.counts.sum() == len(runs.start)
    # a text that is cut differently has the same anchors
    assert set(whole.keys) == set(cut.keys)


def test_radix_groups(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    data[1000:1400] = data[100:500]
    starts, ids = np.arange(2900), rng.integers(0, 9, 2900)
    for size in (9, 16, 50):
        low = {}
        for s, i in zip(starts.tolist(), ids.tolist()):
            key = data[s : s + size].tobytes()
            low[key] = min(low.get(key, i), i)
        want = [low[data[s : s + size].tobytes()] for s in starts.tolist()]
        assert suffixes.radix_groups(data, starts, ids, size).tolist() == want
        monkeypatch.setattr(suffixes, "DEAL_ROWS", 300)
        assert suffixes.smallest_ids(data, starts, ids, size).tolist() == want
        monkeypatch.undo()


def test_a_key_of_all_documents_is_sent_once_per_block():
    block = exchange.Block(1, earlier=True)
    n = 1000
    block.add(np.arange(n)[::-1].copy(), np.arange(n), np.ones(n, np.int64), np.full(n, 7, U64))
    sent = block.emit()
    assert len(sent.column("keys")[0].as_py()) == 8 and block.emit() is None


# --- near duplicates ---
def test_simhash(docs, empty):
    want = brute.simhash_rows(ROWS)
    same(simhash.near_duplicates(docs), ["doc_id", "fingerprint", "component_id"], want)
    same(simhash.near_duplicates(docs, bucket_rows=2), ["doc_id", "fingerprint", "component_id"], want)
    assert simhash.near_duplicates(empty).count() == 0


def test_trie_pairs():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    bit = lambda: U64(1) << rng.integers(0, 64, 150).astype(U64)
    prints = np.unique(np.concatenate([base, base ^ bit(), base ^ bit() ^ bit(), base ^ bit() ^ bit() ^ bit()]))
    distance = np.bitwise_count(prints[:, None] ^ prints[None])
    for budget in (0, 1, 2, 4):
        a, b = simhash.trie_pairs(prints, budget)
        want = {(i, j) for i, j in zip(*np.nonzero(distance <= budget)) if i < j}
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 300)]
    links = spark.createDataFrame(chain + [(5, x) for x in range(1000, 1200)] + [(7, 7), (5, 1000)], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, **{x: 5 for x in [5, *range(1000, 1200)]}}


# --- lines ---
def test_line_dedup(docs, empty):
    ratio, least = 0.15, 5
    rows = docs.select("doc_id", "text", "source").collect()
    by_host, seen = {}, {}
    for r in rows:
        by_host[r.source] = by_host.get(r.source, 0) + 1
        for x in {x.strip(" \t\r\f\x0b") for x in (r.text or "").split("\n")} - {""}:
            seen[r.source, x] = seen.get((r.source, x), 0) + 1
    bad = {k for k, n in seen.items() if by_host[k[0]] >= least and n > ratio * by_host[k[0]]}
    assert bad
    want = []
    for r in rows:
        own = [] if r.text is None else r.text.split("\n")
        kept = [x for x in own if (r.source, x.strip(" \t\r\f\x0b")) not in bad]
        want.append((r.doc_id, None if r.text is None else "\n".join(kept), len(own), len(own) - len(kept)))
    out = lines.drop_boilerplate(docs, "doc_id", "text", "source", ratio=ratio, min_pages=least)
    same(out, ["doc_id", "text", "__n_lines", "__n_dropped"], want)
    assert lines.drop_boilerplate(empty, "doc_id", "text", "source").count() == 0


# --- toxicity ---
def _labelled(spark):
    rng = np.random.default_rng(8)
    plain = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        own = list(rng.choice(plain, rng.integers(20, 60)))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                own.insert(rng.integers(0, len(own)), rng.choice(["vile", "awful", "nasty"]))
        rows.append((i, " ".join(own)))
        labels.append((i, 0, int(toxic)))
    rows += [(1000, ""), (1001, None), (1002, "?!"), (None, "awful nasty vile"), (5, rows[5][1])]
    labels += [(2000, 0, 1), (None, 0, 1), (7, None, None)]
    return brute.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = _labelled(spark)
    out = toxicity.score(docs, labels).collect()
    assert len(out) == docs.count()
    truth = {i: i % 6 == 0 for i in range(900)}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == brute.is_held_out(r.doc_id) for r in out) and len(held) > 100
    assert np.mean([r.predicted == int(truth[r.doc_id]) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    odd = {r.doc_id: r.score for r in out if r.doc_id in (1000, 1001, 1002)}
    assert len(set(odd.values())) == 1 and odd[1000] < 0.3
    assert next(r for r in out if r.doc_id is None).predicted == 1


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs, labels = _labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, labels).collect()}
    b = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, flipped).collect()}
    assert a == b


def test_toxicity_without_labels(spark, docs, empty):
    _, labels = _labelled(spark)
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).select("score").distinct().collect()} and toxicity.score(empty, labels).count() == 0


def test_fingerprints_use_all_bits():
    column = pa.array(["a b c d e f g", None, "", "One TWO  three\tfour"])
    got = simhash._fingerprints_of(column, 3)
    assert [int(x) & (2**64 - 1) for x in got] == [brute.fingerprint(t.as_py()) for t in column]


@pytest.mark.parametrize("size", [127, 128, 200, 300])
def test_suffix_sizes_beyond_a_byte(spark, size):
    passage = "".join(chr(97 + (k * k) % 23) for k in range(700))
    rows = [(i, f"text {i} " * 5 + passage[i % 3 * 40 :] + f" end {i}") for i in range(12)] + [(20, passage[:size]), (21, passage[: size - 1]), (None, passage), (22, None)]
    got = suffixes.remove_repeats(brute.documents(spark, rows), size=size, digest_only=True)
    assert brute.sorted_rows(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute.sorted_rows(brute.suffix_rows(rows, size))
