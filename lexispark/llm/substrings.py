"""Substring dedup over word windows: Rabin-Karp hashes of every window, counted in Spark.

Every ``size`` consecutive words of every text give one 64-bit rolling hash of their word hashes. The hashes are
grouped by value (``exchange``); a window that also starts in a document with a smaller id is marked, and overlapping
marked windows merge into maximal intervals of words, which go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.exchange import BUCKET_KEYS, ID, PART, ROW, addressed, addresses, ask, bucket_of, flags_of, replies_of
from lexispark.llm.textarrays import mix, release, row_groups, text_buffers, window_hashes, word_bounds, word_hashes

SLICE_BYTES = 1 << 20


def _windows(column: pa.Array, size: int) -> Iterator[tuple]:
    """(first row, last row, windows per row, window hashes, bytes, word starts, word ends, words per row)."""
    raw, at = text_buffers(column)
    for first, last in row_groups(np.diff(at), SLICE_BYTES):
        starts, ends, words = word_bounds(raw, at[first : last + 1])
        rolling = mix(window_hashes(word_hashes(raw, starts, ends), size))
        ends_of = np.cumsum(words)
        # windows that don't run into the next text
        own = np.maximum(words - size + 1, 0)
        lead = np.cumsum(own) - own
        inside = np.arange(int(own.sum())) + np.repeat(ends_of - words - lead, own)
        yield first, last, own, rolling[inside], raw, starts, ends, words


def covered(flags: np.ndarray, size: int, length: int) -> np.ndarray:
    """Which of ``length`` places lie in a marked window of ``size``."""
    change = np.zeros(length + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, digest_only: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept_sha256`` and, unless ``digest_only``, the kept words as ``text_col`` and the removed ``spans``.

    Spans are (first word, words) of maximal runs; kept words are joined by one space. Null and empty texts have no
    words and lose none. Of texts with the same id none is smaller; a row without id is left whole and counts
    nowhere. Repeated rows give equal results. Columns of the names above are replaced.
    """
    base, total, parts = addressed(docs, id_col, text_col)
    buckets = max(1, -(-total // (6 * BUCKET_KEYS)))  # about six bytes to a word

    def keys_of(column: pa.Array):
        for first, last, own, keys, *_ in _windows(column, size):
            yield first, last, own, keys

    answers = ask(base, keys_of, buckets, parts, earlier=True)
    added = ["n_words", "n_removed", "kept_sha256", "spans"]
    names = [c for c in docs.columns if c not in added and (not digest_only or c == id_col) and c != text_col]
    picked = base.select(*[F.col(f"`{c}`") for c in names], "__llm_text", ID, ROW, PART)

    def cut(key: tuple, own_docs: pa.Table, replies: pa.Table) -> pa.Table:
        known = replies_of(replies)
        lists = [known.get(a, []) for a in addresses(own_docs)]
        own_docs = own_docs.combine_chunks()
        column = own_docs.column("__llm_text")
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
        n_words, n_removed, digests, texts, spans = [], [], [], [], []
        for first, last, own, keys, raw, starts, ends, words in _windows(column, size):
            marks = flags_of(lists[first:last], own, bucket_of(keys, buckets))
            w = m = 0
            for n, windows in zip(words.tolist(), own.tolist()):
                gone = covered(marks[m : m + windows], size, n)
                keep = np.flatnonzero(~gone) + w
                kept = _joined(raw, starts[keep], ends[keep])
                n_words.append(n)
                n_removed.append(n - len(keep))
                digests.append(hashlib.sha256(kept).hexdigest())
                if not digest_only:
                    texts.append(kept.decode())
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans.append([{"first": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
                w, m = w + n, m + windows
        release()
        out = own_docs.select(names) if names else pa.table({})
        for name, values, kind in (("n_words", n_words, pa.int64()), ("n_removed", n_removed, pa.int64()), ("kept_sha256", digests, pa.string())):
            out = out.append_column(name, pa.array(values, kind))
        if not digest_only:
            out = out.append_column(text_col, pa.array(texts, pa.string()))
            out = out.append_column("spans", pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))))
        return out

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[: len(names)])
    extra = ["n_words long", "n_removed long", "kept_sha256 string"]
    if not digest_only:
        extra += [f"`{text_col}` string", "spans array<struct<first:long,words:long>>"]
    return picked.groupBy(PART).cogroup(answers.groupBy(PART)).applyInArrow(cut, ", ".join([ddl, *extra] if ddl else extra))


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by one space: built by copying all bytes of the words, each with a space after it."""
    if not len(starts):
        return b""
    lengths = ends - starts + 1
    lead = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(lead - starts, lengths)
    place[-1] = 0
    out = raw[np.minimum(place, len(raw) - 1)]
    out[np.cumsum(lengths) - 1] = 32
    return out[:-1].tobytes()
