"""Suffix-array dedup: suffixes ordered only through their first ``size`` bytes, by most-significant-digit radix passes.

The repeated windows of ``size`` bytes are the groups of suffixes that stay equal through the last pass. Two steps keep what
is sorted and sent small without losing a window:

1. Every window has an anchor: the ``GRAM``-byte string in it with the smallest hash (the leftmost of equals). Equal windows
   have equal anchors, at the same place in the window, and a text has one anchor for some 14 bytes. Anchors that
   stand in a single document (``exchange``) rule out all windows that have them.
2. The other anchors go, with the bytes their windows cover, to buckets by the anchor's hash. A bucket holds all
   suffixes that may be equal. It orders them by eight bytes a pass; after each pass only groups of several suffixes
   from several documents go on. Equal stretches are sent once per block of documents and sorted once per bucket.

Each stretch gets back one bit per window: whether the window also starts in a document with a smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.exchange import (
    ANSWER, BUCKET_KEYS, ID, PART, ROW, Replies, addressed, addresses, ask, bucket_of, bucket_order, first_documents, flags_of, replies_of,
)
from lexispark.llm.substrings import covered
from lexispark.llm.textarrays import U64, group_of, group_starts, mix, release, row_groups, text_buffers, window_hashes, window_min
from lexispark.session import stage

GRAM = 24
SLICE_BYTES = 1 << 19  # bytes looked at together; longer texts are cut at multiples of it
BUCKET_BYTES = 6 << 20  # text for each bucket of stretches
DEAL_ROWS = 400_000  # suffixes sorted at once
CHUNK_BYTES = 1 << 19  # bytes that have an index or a hash term at once
STRETCHES = "bucket int, ids binary, rows binary, counts binary, windows binary, sent binary, local binary, lengths binary, bytes binary"


class Runs:
    """The windows of some texts by anchor: ``start`` and ``windows`` of each run of windows with one anchor, and its hash.

    ``counts`` are runs per row. A run never crosses a multiple of ``SLICE_BYTES`` of its text, so it depends on the text alone.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, size: int):
        lengths = np.diff(at)
        n_parts = np.maximum(1, -(-np.maximum(lengths - size + 1, 1) // SLICE_BYTES))
        row = np.repeat(np.arange(len(lengths)), n_parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        low = at[:-1][row] + part * SLICE_BYTES
        # windows that start in the part
        windows = np.minimum(np.maximum(at[1:][row] - size + 1 - low, 0), SLICE_BYTES)
        starts, counts, keys, rows = [], [], [], []
        for a, b in row_groups(windows, SLICE_BYTES):
            if not windows[a:b].sum():
                continue
            lo, hi = int(low[a]), int(low[b - 1] + windows[b - 1] + size - 1)
            hi = min(hi, int(at[-1]))
            grams = mix(window_hashes(raw[lo:hi].astype(U64) + U64(1), GRAM))
            place = np.arange(len(grams), dtype=U64)
            least = window_min((grams & U64(0xFFFFFFFF00000000)) | place, size - GRAM + 1)
            anchor = (least & U64(0xFFFFFFFF)).astype(np.int64)
            own = np.repeat(np.arange(a, b), windows[a:b])
            lead = np.cumsum(windows[a:b]) - windows[a:b]
            where = np.arange(len(own)) - np.repeat(lead, windows[a:b]) + low[own] - lo
            anchor = anchor[where]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])])
            heads = np.flatnonzero(new)
            starts.append(where[heads] + lo)
            counts.append(np.diff(np.concatenate([heads, [len(own)]])))
            # anchors have the smallest hashes: spread anew, as keys are dealt into buckets by value
            keys.append(mix(grams[anchor[heads]] + U64(1)))
            rows.append(row[own[heads]])
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.start, self.windows, self.keys = join(starts, np.int64), join(counts, np.int64), join(keys, U64)
        self.counts = np.bincount(join(rows, np.int64), minlength=len(lengths))


def _runs(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Runs]]:
    raw, at = text_buffers(column)
    for first, last in row_groups(np.diff(at), SLICE_BYTES):
        yield first, last, raw, at[first : last + 1], Runs(raw, at[first : last + 1], size)


def _bytes_at(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The given stretches of ``raw`` one after another."""
    out = np.empty(int(lengths.sum()), np.uint8)
    done = 0
    for first, last in row_groups(lengths, CHUNK_BYTES):
        own = lengths[first:last]
        lead = np.cumsum(own) - own
        piece = raw[np.arange(int(own.sum())) + np.repeat(starts[first:last] - lead, own)]
        out[done : done + len(piece)] = piece
        done += len(piece)
    return out


def _stretch_hashes(data: np.ndarray, lengths: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each of consecutive byte strings."""
    out = np.empty(len(lengths), U64)
    weights = mix(np.arange(1, int(lengths.max(initial=0)) + 1, dtype=U64) + U64(salt)) | U64(1)
    done = 0
    for first, last in row_groups(lengths, CHUNK_BYTES):
        own = lengths[first:last]
        lead = np.cumsum(own) - own
        n = int(own.sum())
        place = np.arange(n) - np.repeat(lead, own)
        out[first:last] = np.add.reduceat((data[done : done + n].astype(U64) + U64(1)) * weights[place], lead)
        done += n
    return mix(out + lengths.astype(U64))


def radix_groups(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """The smallest id among the suffixes at ``starts`` of ``data`` that agree through ``size`` bytes, for each of them.

    Passes over eight bytes from the most significant on. Suffixes whose group has one document need no further pass:
    their smallest id is their own.
    """
    low = ids.copy()
    active, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for depth in range(0, size, 8):
        if not len(active):
            break
        width = min(8, size - depth)
        digit = np.zeros(len(active), U64)
        at = starts[active] + depth
        for k in range(width):
            digit = (digit << U64(8)) | padded[at + k].astype(U64)
        order = np.argsort(digit)
        if depth:
            order = order[np.argsort(group[order], kind="stable")]
        d, g = digit[order], group[order]
        heads = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])]))
        active = active[order]
        group = group_of(heads, len(active))
        owner = ids[active]
        least, most = np.minimum.reduceat(owner, heads), np.maximum.reduceat(owner, heads)
        if depth + width >= size:
            low[active] = least[group]
            break
        several = (least != most)[group]
        active, group = active[several], group[several]
    return low


def smallest_ids(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """``radix_groups`` in bounded memory: suffixes are dealt by their first eight bytes, then sorted deal by deal."""
    deals = max(1, -(-len(starts) // DEAL_ROWS))
    if deals == 1:
        return radix_groups(data, starts, ids, size)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    deal = np.empty(len(starts), np.int32)
    for a in range(0, len(starts), DEAL_ROWS):
        at = starts[a : a + DEAL_ROWS]
        digit = np.zeros(len(at), U64)
        for k in range(8):
            digit = (digit << U64(8)) | padded[at + k].astype(U64)
        deal[a : a + DEAL_ROWS] = (mix(digit) % U64(deals)).astype(np.int32)
    low = np.empty_like(ids)
    for k in range(deals):
        own = np.flatnonzero(deal == k)
        low[own] = radix_groups(data, starts[own], ids[own], size)
    return low


def _text_column(t: pa.Table) -> pa.Array:
    column = t.combine_chunks().column("__llm_text")
    return column.chunk(0) if column.num_chunks else pa.array([], pa.string())


def _ask_stretches(docs: DataFrame, found: DataFrame, size: int, anchor_buckets: int, buckets: int, parts: int) -> DataFrame:
    """Packed answers with a bit by window, for the anchors of ``docs`` that are shared as ``found`` says."""
    names = [x.split()[0] for x in STRETCHES.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * 8]
    nothing = pa.table([pa.array([], t) for t in kinds], names=names)
    # a run has at most size - GRAM + 1 windows, so a stretch has less than twice the size
    width = np.uint8 if 2 * size < 256 else np.int32

    def request(key: tuple, own_docs: pa.Table, replies: pa.Table) -> pa.Table:
        # a row without id has no answers, as it never asked
        known = replies_of(replies)
        held: list[tuple] = []

        def emit() -> pa.Table:
            ids, rows, counts, windows, keys, data = (np.concatenate(x) for x in zip(*held))
            lengths = windows + size - 1
            doc = np.repeat(np.arange(len(ids)), counts)
            same = _stretch_hashes(data, lengths, 7) ^ (keys * U64(3))
            low, _ = first_documents(same, ids[doc])
            local, sent = ids[doc] > low, ids[doc] == low
            bucket = bucket_of(keys, buckets)
            order = bucket_order(bucket)
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            begin = np.cumsum(lengths) - lengths
            out = []
            for b in np.flatnonzero(np.diff(edges)):
                own = order[edges[b] : edges[b + 1]]
                heads = group_starts(doc[own])
                docs_of = doc[own][heads]
                n = np.diff(np.concatenate([heads, [len(own)]])).astype(np.int32)
                go = own[sent[own]]
                out.append((
                    int(b), ids[docs_of].tobytes(), rows[docs_of].tobytes(), n.tobytes(), windows[own].astype(width).tobytes(),
                    np.packbits(sent[own]).tobytes(), np.packbits(local[own]).tobytes(), lengths[go].astype(width).tobytes(),
                    _bytes_at(data, begin[go], lengths[go]).tobytes(),
                ))
            return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)

        # texts without a shared anchor have no stretches
        asked = [a in known for a in addresses(own_docs)]
        own_docs = own_docs.filter(pa.array(asked, pa.bool_()))
        lists = [known[a] for a in addresses(own_docs)]
        ids = own_docs.column(ID).fill_null(0).to_numpy()
        rows = own_docs.column(ROW).to_numpy()
        for first, last, raw, _, runs in _runs(_text_column(own_docs), size):
            shared = flags_of(lists[first:last], runs.counts, bucket_of(runs.keys, anchor_buckets))
            if not shared.any():
                continue
            counts = np.add.reduceat(np.append(shared, False).astype(np.int64), np.cumsum(runs.counts) - runs.counts) * (runs.counts > 0)
            some = np.flatnonzero(counts)
            windows, start = runs.windows[shared], runs.start[shared]
            data = _bytes_at(raw, start, windows + size - 1)
            held.append((ids[first:last][some], rows[first:last][some], counts[some], windows, runs.keys[shared], data))
        out = emit() if held else nothing
        release()
        return out

    def settle(t: pa.Table) -> pa.Table:
        asked = []
        for x in t.to_pylist():
            ids, rows = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["rows"], np.int64)
            counts = np.frombuffer(x["counts"], np.int32).astype(np.int64)
            n = int(counts.sum())
            sent = np.unpackbits(np.frombuffer(x["sent"], np.uint8), count=n).astype(bool)
            local = np.unpackbits(np.frombuffer(x["local"], np.uint8), count=n).astype(bool)
            windows = np.frombuffer(x["windows"], width).astype(np.int64)
            asked.append((ids, rows, counts, windows, sent, local, np.frombuffer(x["lengths"], width).astype(np.int64), np.frombuffer(x["bytes"], np.uint8), np.repeat(ids, counts)[sent]))
        lengths, data, owner = (np.concatenate([p[i] for p in asked]) for i in (6, 7, 8))
        # equal stretches are sorted once, for their smallest document
        same = _stretch_hashes(data, lengths, 11)
        order = np.lexsort((owner, same))
        heads = group_starts(same[order])
        first = order[heads]
        which = np.empty(len(same), np.int64)
        which[order] = group_of(heads, len(same))
        begin = np.cumsum(lengths) - lengths
        n_windows = lengths[first] - size + 1
        lead = np.cumsum(n_windows) - n_windows
        inner = np.arange(int(n_windows.sum())) - np.repeat(lead, n_windows)
        low = smallest_ids(data, np.repeat(begin[first], n_windows) + inner, np.repeat(owner[first], n_windows), size)
        answers, at = Replies(t.column("bucket")[0].as_py(), parts), 0
        for ids, rows, counts, windows, sent, local, own_lengths, _, own_owner in asked:
            flags = np.repeat(local, windows)
            k = len(own_lengths)
            own = which[at : at + k]
            at += k
            n = own_lengths - size + 1
            if k:
                place = np.arange(int(n.sum())) + np.repeat(lead[own] - (np.cumsum(n) - n), n)
                flags[np.repeat(sent, windows)] = low[place] < np.repeat(own_owner, n)
            per_doc = np.add.reduceat(windows, np.cumsum(counts) - counts)
            answers.add(ids, rows, per_doc, flags)
        out = answers.table()
        del asked, data, owner, same, which, inner, low, answers
        release()
        return out

    stretches = docs.groupBy(PART).cogroup(found.groupBy(PART)).applyInArrow(request, STRETCHES)
    return stretches.groupBy("bucket").applyInArrow(settle, ANSWER)


def _window_flags(runs: Runs, shared: np.ndarray, answers: list[list[tuple[int, bytes]]], buckets: int) -> np.ndarray:
    """One flag per window of all runs, in their order."""
    flags = np.zeros(int(runs.windows.sum()), bool)
    if not shared.any():
        return flags
    begin = np.cumsum(runs.windows) - runs.windows
    bucket = bucket_of(runs.keys, buckets)
    r = 0
    for answer, n in zip(answers, runs.counts.tolist()):
        if answer and n:
            own = np.flatnonzero(shared[r : r + n]) + r
            order = own[bucket_order(bucket[own])]
            ordered = bucket[order]
            for b, packed in answer:
                lo, hi = np.searchsorted(ordered, [b, b + 1])
                hit = order[lo:hi]
                w = runs.windows[hit]
                bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(w.sum())).astype(bool)
                place = np.arange(int(w.sum())) + np.repeat(begin[hit] - (np.cumsum(w) - w), w)
                flags[place] |= bits
        r += n
    return flags


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, digest_only: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, unless ``digest_only``, the kept text in ``text_col``.

    Each byte goes that is covered by a ``size``-byte string which also starts in a document with a smaller id; what was
    there before any removal decides. In the kept text, bytes of a character that was cut into are left out; the digest is
    over all kept bytes. Null texts count as empty (and come back empty). Texts shorter than ``size`` stay whole. Of texts
    with the same id none is smaller; a row without id is left whole and counts nowhere. Repeated rows give equal
    results. Columns of the names above are replaced.
    """
    if size <= GRAM:
        raise ValueError(f"size has to be over {GRAM}")
    base, total, parts = addressed(docs, id_col, text_col)
    anchor_buckets = max(1, -(-total // (13 * BUCKET_KEYS)))
    buckets = max(1, -(-total // BUCKET_BYTES))
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    names = [c for c in docs.columns if c not in added and (not digest_only or c == id_col) and c != text_col]

    def anchors(column: pa.Array):
        for first, last, _, _, runs in _runs(column, size):
            yield first, last, runs.counts, runs.keys

    found = stage(ask(base, anchors, anchor_buckets, parts, earlier=False, kind=np.uint32), "anchors")
    # one shuffle of the texts serves both uses
    dealt = base.select(*[F.col(f"`{c}`") for c in names], "__llm_text", ID, ROW, PART)
    answers = _ask_stretches(dealt, found, size, anchor_buckets, buckets, parts)
    kind = lambda df, k: df.withColumn("kind", F.lit(k))
    both = kind(found, 0).unionByName(kind(answers, 1))

    def cut(key: tuple, own_docs: pa.Table, replies: pa.Table) -> pa.Table:
        which = replies.column("kind").to_numpy()
        by_anchor, by_window = (replies_of(replies.filter(pa.array(which == k))) for k in (0, 1))
        own = addresses(own_docs)
        column = _text_column(own_docs)
        raw, at = text_buffers(column)
        n_removed, n_spans, digests, texts = [0] * len(own), [0] * len(own), [""] * len(own), [""] * len(own)

        def keep(row: int, text: np.ndarray) -> None:
            kept = text.tobytes()
            digests[row] = hashlib.sha256(kept).hexdigest()
            if not digest_only:
                texts[row] = kept.decode("utf-8", "ignore")

        for row, a in enumerate(own):
            if a not in by_window:  # no window of it is marked
                keep(row, raw[at[row] : at[row + 1]])
        marked = [row for row, a in enumerate(own) if a in by_window]
        shared_lists, window_lists = [by_anchor.get(own[r], []) for r in marked], [by_window[own[r]] for r in marked]
        for first, last, part, edges, runs in _runs(column.take(pa.array(marked, pa.int64())), size):
            shared = flags_of(shared_lists[first:last], runs.counts, bucket_of(runs.keys, anchor_buckets))
            flags = _window_flags(runs, shared, window_lists[first:last], buckets)
            # windows are in text order: one for each byte but the last size - 1 of a text
            windows = np.maximum(np.diff(edges) - size + 1, 0)
            w = 0
            for row, lo, hi, n in zip(marked[first:last], edges[:-1].tolist(), edges[1:].tolist(), windows.tolist()):
                gone = covered(flags[w : w + n], size, hi - lo) if n > 0 else np.zeros(hi - lo, bool)
                w += n
                n_removed[row] = int(gone.sum())
                n_spans[row] = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                keep(row, part[lo:hi][~gone])
        n_bytes = np.diff(at).tolist()
        del by_anchor, by_window, shared_lists, window_lists
        release()
        out = own_docs.select(names)
        for name, values, t in (("n_bytes", n_bytes, pa.int64()), ("n_removed", n_removed, pa.int64()), ("n_spans", n_spans, pa.int64()), ("kept_sha256", digests, pa.string())):
            out = out.append_column(name, pa.array(values, t))
        return out if digest_only else out.append_column(text_col, pa.array(texts, pa.string()))

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema[: len(names)]]
    ddl += ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] + ([] if digest_only else [f"`{text_col}` string"])
    return dealt.groupBy(PART).cogroup(both.groupBy(PART)).applyInArrow(cut, ", ".join(ddl))
