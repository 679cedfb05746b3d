"""Which keys of a document stand in another document: packed requests to buckets of keys and packed answers back.

Windows of texts are far too many for a row each. A task gathers the keys of a block of documents, settles what the
block itself shows (of equal keys only the smallest document's are sent on) and emits one row per bucket of
key values. A bucket sorts its keys and answers with bits, one per key, in one row for each part of the documents; a part
holds the documents of one value of a hash. So a key in a third of all documents reaches its bucket once per
block, never once per document, and neither way has a row per document or key.

The bits of a document and bucket follow the order of its keys; whoever has the text computes the same keys again
(``bucket_order``) and reads its answers (``flags_of``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shipping import ship
from lexispark.llm.textarrays import U64, group_of, group_starts, release

BLOCK_KEYS = 1_000_000  # keys a task gathers before it sends
BUCKET_KEYS = 1_000_000  # keys of a bucket, about
PART_BYTES = 4 << 20  # text of a part, about
ID, ROW, PART = "__llm_id", "__llm_row", "__llm_part"
REQUEST = "bucket int, ids binary, rows binary, counts binary, sent binary, local binary, keys binary"
ANSWER = f"{PART} long, bucket int, ids binary, rows binary, sizes binary, bits binary"


def addressed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """``docs`` with the address of each row, the bytes of all texts and the number of parts.

    The address is the id with a hash of id and text (rows that share both share all answers), and the part they fall into.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.withColumns({ID: F.col(id_col).cast("long"), ROW: F.xxhash64(F.col(id_col).cast("long"), text), "__llm_text": text})
    total = int(base.select(F.sum(F.octet_length("__llm_text"))).first()[0] or 0)
    parts = max(1, -(-total // PART_BYTES))
    return base.withColumn(PART, F.pmod(ROW, F.lit(parts)).cast("long")), total, parts


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def bucket_order(buckets: np.ndarray) -> np.ndarray:
    """Positions of keys by bucket, in their own order within each."""
    small = buckets.astype(np.uint16) if not len(buckets) or buckets.max() < 1 << 16 else buckets
    return np.argsort(small, kind="stable")


def first_documents(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the smallest and the largest id among equal keys."""
    order = np.argsort(keys)
    heads = group_starts(keys[order])
    group = group_of(heads, len(keys))
    low, high = np.empty_like(ids), np.empty_like(ids)
    low[order] = np.minimum.reduceat(ids[order], heads)[group] if len(keys) else ids
    high[order] = np.maximum.reduceat(ids[order], heads)[group] if len(keys) else ids
    return low, high


class Block:
    """Keys gathered for one block: for each document its address and keys in order."""

    def __init__(self, buckets: int, earlier: bool, kind: type = U64):
        self.buckets, self.earlier, self.kind = buckets, earlier, kind
        self.clear()

    def clear(self) -> None:
        self.ids, self.rows, self.counts, self.keys, self.size = [], [], [], [], 0

    def add(self, ids: np.ndarray, rows: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> None:
        for store, value in ((self.ids, ids), (self.rows, rows), (self.counts, counts), (self.keys, keys)):
            store.append(value)
        self.size += len(keys)

    def emit(self) -> pa.RecordBatch | None:
        if not self.size:
            self.clear()
            return None
        ids, rows, counts, keys = (np.concatenate(x) for x in (self.ids, self.rows, self.counts, self.keys))
        self.clear()
        doc = np.repeat(np.arange(len(ids)), counts)
        low, high = first_documents(keys, ids[doc])
        local = ids[doc] > low if self.earlier else low != high
        sent = ids[doc] == low
        bucket = bucket_of(keys, self.buckets)
        order = bucket_order(bucket)
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(edges)):
            own = order[edges[b] : edges[b + 1]]
            heads = group_starts(doc[own])
            docs = doc[own][heads]
            n = np.diff(np.concatenate([heads, [len(own)]])).astype(np.int32)
            out.append((int(b), ids[docs].tobytes(), rows[docs].tobytes(), n.tobytes(), np.packbits(sent[own]).tobytes(), np.packbits(local[own]).tobytes(), keys[own][sent[own]].astype(self.kind).tobytes()))
        columns = list(zip(*out))
        kinds = [pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["bucket", "ids", "rows", "counts", "sent", "local", "keys"])


class Replies:
    """Answers of one bucket, packed by the parts of the documents."""

    def __init__(self, bucket: int, parts: int):
        self.bucket, self.parts = bucket, parts
        self.ids, self.rows, self.bits = [], [], []

    def add(self, ids: np.ndarray, rows: np.ndarray, counts: np.ndarray, flags: np.ndarray) -> None:
        """``flags`` of some documents, ``counts`` each in order; documents without a flag need no answer."""
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(flags)])
        some = np.flatnonzero(total[ends] > total[ends - counts])
        self.ids.append(ids[some])
        self.rows.append(rows[some])
        self.bits += [np.packbits(flags[a:b]).tobytes() for a, b in zip((ends - counts)[some].tolist(), ends[some].tolist())]

    def table(self) -> pa.Table:
        ids, rows = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (self.ids, self.rows))
        part = np.mod(rows, self.parts)
        order = np.argsort(part, kind="stable")
        heads = group_starts(part[order])
        out = []
        for a, b in zip(heads, [*heads[1:], len(order)]):
            own = order[a:b]
            bits = [self.bits[i] for i in own]
            sizes = np.array([len(x) for x in bits], np.int32)
            out.append((int(part[own[0]]), self.bucket, ids[own].tobytes(), rows[own].tobytes(), sizes.tobytes(), b"".join(bits)))
        columns = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=[PART, "bucket", "ids", "rows", "sizes", "bits"])


def replies_of(t: pa.Table) -> dict[tuple[int, int], list[tuple[int, bytes]]]:
    """(bucket, bits) pairs by document address of the packed answers of a part."""
    out: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
    for bucket, ids, rows, sizes, bits in zip(*(t.column(c).to_pylist() for c in ("bucket", "ids", "rows", "sizes", "bits"))):
        at = 0
        for i, r, n in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(rows, np.int64).tolist(), np.frombuffer(sizes, np.int32).tolist()):
            out.setdefault((i, r), []).append((bucket, bits[at : at + n]))
            at += n
    return out


def addresses(t: pa.Table) -> list[tuple[int | None, int]]:
    return list(zip(t.column(ID).to_pylist(), t.column(ROW).to_pylist()))


def ask(docs: DataFrame, keys_of: Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray, np.ndarray]]], buckets: int, parts: int, earlier: bool, kind: type = U64) -> DataFrame:
    """Packed answers for the keys of addressed ``docs``.

    ``keys_of`` yields (first row, last row, keys per row, keys) for a column of texts. A bit is set if the key stands in a
    document with a smaller id (``earlier``) or in one with another id. Rows without id neither ask nor answer. With ``kind``
    uint32 only the lower half of each key is sent: enough to rule keys out, as the bucket holds the upper bits.
    """

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(buckets, earlier, kind)
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, last, counts, keys in keys_of(batch.column(2)):
                block.add(ids[first:last], rows[first:last], counts, keys)
                if block.size >= BLOCK_KEYS:
                    yield block.emit()
        rest = block.emit()
        if rest is not None:
            yield rest
        release()

    def settle(t: pa.Table) -> pa.Table:
        asked = []
        for x in t.to_pylist():
            ids, rows = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["rows"], np.int64)
            counts = np.frombuffer(x["counts"], np.int32).astype(np.int64)
            n = int(counts.sum())
            sent = np.unpackbits(np.frombuffer(x["sent"], np.uint8), count=n).astype(bool)
            local = np.unpackbits(np.frombuffer(x["local"], np.uint8), count=n).astype(bool)
            asked.append((ids, rows, counts, sent, local, np.frombuffer(x["keys"], kind), np.repeat(ids, counts)[sent]))
        low, high = first_documents(np.concatenate([p[5] for p in asked]), np.concatenate([p[6] for p in asked]))
        owner = np.concatenate([p[6] for p in asked])
        hit = owner > low if earlier else low != high
        replies, at = Replies(t.column("bucket")[0].as_py(), parts), 0
        for ids, rows, counts, sent, local, keys, _ in asked:
            flags = local.copy()
            flags[sent] |= hit[at : at + len(keys)]
            at += len(keys)
            replies.add(ids, rows, counts, flags)
        out = replies.table()
        del asked, low, high, owner, hit, replies
        release()
        return out

    plain = docs.select(ID, ROW, "__llm_text").filter(F.col(ID).isNotNull())
    return plain.mapInArrow(request, REQUEST).groupBy("bucket").applyInArrow(settle, ANSWER)


def flags_of(answers: list[list[tuple[int, bytes]]], counts: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The bits of ``answers`` (a list for each row) for keys of rows (``counts`` each) that fall into ``buckets``, in key order."""
    flags = np.zeros(len(buckets), bool)
    at = 0
    for answer, n in zip(answers, counts.tolist()):
        if answer and n:
            own = buckets[at : at + n]
            order = bucket_order(own)
            ordered = own[order]
            for bucket, bits in answer:
                lo, hi = np.searchsorted(ordered, [bucket, bucket + 1])
                flags[at + order[lo:hi]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        at += n
    return flags
