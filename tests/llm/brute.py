"""Plain single-process versions of the operators, and documents with awkward cases."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def awkward_documents():
    """(doc_id, text, lang, source, n_chars, extra): copies, shared passages, empty, null, short, long and odd texts."""
    rng = random.Random(5)
    lexicon = ["".join(rng.choice("abcdefghinorstu") for _ in range(rng.randint(2, 9))) for _ in range(300)] + ["ärger", "çà", "日本語", "naïve,", "The", "end."]
    text = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    passage, line = text(60), "Copyright notice of this site, all rights reserved by the owner."
    texts = [text(rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[3]] * 6 + [texts[4] + " more", "x " + texts[4]]
    texts += [f"{text(20)} {passage} {text(15)}" for _ in range(5)] + [passage]
    texts += [f"{line}\n{text(30)}\n  {line}  \n{text(5)}" for _ in range(6)]
    texts += ["", "", None, None, " ", "\n\t \r\n", "a", "word", "two words", "  lead  and   trail  ", "tab\tand\x0bvertical\x0cfeed", "x" * 200, "ab" * 100, "<|endoftext|> it's <s> don't", "▁a ▁▁b", "\x00nul\x1c", "日本語" * 40, "é" * 60, "É" * 60]
    texts += ["same words " * 400, text(6000)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(i, t) for i, t in zip(ids, texts)]
    rows += [rows[0], rows[43], (None, texts[3]), (None, None), (rows[5][0], "another text of an id that is there already, long enough to hold a window of thirteen words or more in it")]
    return rows


def documents(spark, rows=None):
    rows = awkward_documents() if rows is None else rows
    n = len(rows)
    table = pa.table({
        "doc_id": pa.array([r[0] for r in rows], pa.int64()),
        "text": pa.array([r[1] for r in rows], pa.string()),
        "lang": pa.array(["en"] * n, pa.string()),
        "source": pa.array([None if i % 7 == 6 else f"src{i % 3}" for i in range(n)], pa.string()),
        "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()),
        # names that operators use for their own columns
        "bucket": pa.array(range(n), pa.int64()), "id": pa.array(["x"] * n), "score": pa.array([1.0] * n), "v": pa.array([None] * n, pa.int32()),
    })
    return spark.createDataFrame(table)


def words(text):
    return WORDS.findall(text or "")


def repeated(units, size, rows):
    """For each (id, units) the marks of units covered by a window that also starts in a smaller id."""
    first = {}
    for i, u in rows:
        if i is not None:
            for k in range(len(u) - size + 1):
                key = u[k : k + size]
                first[key] = min(first.get(key, i), i)
    out = []
    for i, u in rows:
        gone = bytearray(len(u))
        if i is not None:
            for k in range(len(u) - size + 1):
                if first[u[k : k + size]] < i:
                    gone[k : k + size] = b"\1" * size
        out.append(gone)
    return out


def substring_rows(rows, size=13):
    units = [(i, tuple(words(t))) for i, t in rows]
    out = []
    for (i, u), gone in zip(units, repeated(units, size, units)):
        kept = " ".join(x for x, y in zip(u, gone) if not y)
        out.append((i, len(u), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix_rows(rows, size=50):
    units = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, u), gone in zip(units, repeated(units, size, units)):
        kept = bytes(x for x, y in zip(u, gone) if not y)
        out.append((i, len(u), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text, size=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
    shingles = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_rows(rows, budget=2):
    prints = [(i, fingerprint(t)) for i, t in rows]
    ids = sorted({i for i, _ in prints if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(i, f) for i, f in prints if i is not None]
    for a, (i, f) in enumerate(known):
        for j, g in known[a + 1 :]:
            if (f ^ g).bit_count() <= budget:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, f"{f:016x}", None if i is None else find(i)) for i, f in prints]


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
