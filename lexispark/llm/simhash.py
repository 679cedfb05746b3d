"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a self-join of binary tries.

Two fingerprints that differ in at most k bits agree in one of k + 1 blocks of bits. Each distinct fingerprint goes to
k + 1 tries, each with another block as its first levels, where the error budget is 0: the roots below these
levels can be dealt out to tasks by the value of the block. A task walks its tries level by level with pairs
of nodes, adds the bits in which the pair differs and prunes pairs over the budget. A block value with very many
fingerprints is cut further by its next bits: a fingerprint then visits the nodes within the budget.

Equal fingerprints are one row from the start, whatever the number of their documents, and a task passes on only
the links of a spanning forest of what it found, so groups of copies never become all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.components import components
from lexispark.llm.shipping import ship
from lexispark.llm.textarrays import U64, group_of, group_starts, row_groups, text_buffers, word_bounds
from lexispark.session import stage

SEED = 42
BUCKET_ROWS = 20_000  # rows a task joins at once, about
_UPPER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z to a-z, other bytes as they are


def shingle_hashes(words: bytes, starts: list[int], ends: list[int], size: int) -> np.ndarray:
    """XXH64 of each ``size`` consecutive words of single-spaced ``words``; of all of them if there are fewer."""
    if not starts:
        return np.empty(0, U64)
    if len(starts) <= size:
        return np.array([xxhash.xxh64_intdigest(words, SEED)], U64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(words[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])), U64, len(starts) - size + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of ``hashes``; 0 for none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for first in range(0, n, 1 << 16):
        part = hashes[first : first + (1 << 16)]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def hashes_by_row(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle hashes) of each text that has words."""
    raw, at = text_buffers(column)
    for first, last in row_groups(np.diff(at), 1 << 21):
        starts, ends, counts = word_bounds(raw, at[first : last + 1])
        total = np.concatenate([[0], np.cumsum(counts)])
        for row in range(first, last):
            a, b = int(total[row - first]), int(total[row - first + 1])
            if a == b:
                continue
            # words joined by one space; where the text has single spaces already that is a slice of it
            lo, hi = int(starts[a]), int(ends[b - 1])
            text = raw[lo:hi].tobytes().translate(_UPPER)
            own_starts, own_ends = starts[a:b] - lo, ends[a:b] - lo
            if b - a > 1 and (not (own_starts[1:] - own_ends[:-1] == 1).all() or not (raw[ends[a : b - 1]] == 32).all()):
                text = b" ".join([text[x:y] for x, y in zip(own_starts.tolist(), own_ends.tolist())])
                lengths = own_ends - own_starts
                own_ends = np.cumsum(lengths + 1) - 1
                own_starts = own_ends - lengths
            yield row, shingle_hashes(text, own_starts.tolist(), own_ends.tolist(), size)


def _fingerprints_of(column: pa.Array, size: int) -> np.ndarray:
    """Fingerprints as signed 64-bit numbers."""
    out = np.zeros(len(column), np.int64)
    for row, hashes in hashes_by_row(column, size):
        value = majority_bits(hashes)
        out[row] = value - (1 << 64) if value >> 63 else value
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (the id if not given) and ``fingerprint`` long of each row; texts without words, empty and null ones have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            prints = pa.array(_fingerprints_of(batch.column(n), size))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], prints], names=[*batch.schema.names[:n], "fingerprint"])

    ship(docs.sparkSession)
    plain = docs.select(*(keep or [id_col]), F.col(text_col).cast("string").alias("__text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[:-1])
    return plain.mapInArrow(run, f"{ddl}, fingerprint long")


def trie_pairs(prints: np.ndarray, budget: int, free: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) of sorted distinct 64-bit ``prints`` that differ in at most ``budget`` bits.

    Pairs of trie nodes, each a range of ``prints``, go down together bit by bit. In the first ``free`` levels a
    difference is not allowed. Once both nodes are single fingerprints the rest of their bits is compared at once.
    """
    n = len(prints)
    none = np.empty(0, np.int64)
    if n < 2:
        return none, none
    lo1, hi1, lo2, hi2, errors = (np.array([x]) for x in (0, n, 0, n, 0))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(65):
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if single.any():
            a, b = lo1[single], lo2[single]
            differ = np.bitwise_count(prints[a] ^ prints[b])
            good = (a != b) & (differ <= budget)
            if level < free:
                good &= (prints[a] >> U64(64 - free)) == (prints[b] >> U64(64 - free))
            found.append((np.minimum(a, b)[good], np.maximum(a, b)[good]))
            lo1, hi1, lo2, hi2, errors = (x[~single] for x in (lo1, hi1, lo2, hi2, errors))
        # below the last level nodes are single fingerprints, as these are distinct
        if not len(lo1) or level == 64:
            break
        shift = U64(63 - level)
        ones = np.concatenate([[0], np.cumsum((prints >> shift) & U64(1)).astype(np.int64)])
        # inside a node the bit is 0 first, then 1
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        same = (lo1 == lo2) & (hi1 == hi2)
        children = [
            (lo1, mid1, lo2, mid2, errors, True),
            (mid1, hi1, mid2, hi2, errors, True),
            (lo1, mid1, mid2, hi2, errors + 1, level >= free),
            (mid1, hi1, lo2, mid2, errors + 1, (level >= free) & ~same),
        ]
        parts = []
        for a, b, c, d, e, allowed in children:
            use = (b > a) & (d > c) & (e <= budget) & allowed
            # a node paired with itself and one fingerprint has no pair
            use &= ~((a == c) & (b == d) & (b - a == 1))
            parts.append(tuple(x[use] for x in (a, b, c, d, e)))
        lo1, hi1, lo2, hi2, errors = (np.concatenate(x) for x in zip(*parts))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (none, none)
    return a, b


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each linked node to the smallest index of its tree."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        ra, rb = ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    own = np.flatnonzero(root != np.arange(n))
    return own, root[own]


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return x if by == 0 else (x << U64(by)) | (x >> U64(64 - by))


def similar_links(classes: DataFrame, budget: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) of a spanning set of all pairs of ``classes`` (node long, fingerprint long, distinct) within ``budget`` bits.

    Two classes are connected through links if and only if they are connected through pairs within the budget.
    """
    ship(classes.sparkSession)
    blocks = budget + 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    total = max(1, classes.count())
    cut = 8  # further bits by which a crowded block value is cut

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            prints = batch.column(1).to_numpy().view(U64)
            for i in range(blocks):
                turned = _rotate(prints, edges[i])
                block = (turned >> U64(64 - (edges[i + 1] - edges[i]))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(node), i, np.int32)), pa.array(block), pa.array(node), pa.array(turned.view(np.int64))],
                    names=["turn", "block", "node", "turned"],
                )

    tries = stage(classes.select("node", "fingerprint").mapInArrow(spread, "turn int, block long, node long, turned long"), "tries")
    sizes = tries.groupBy("turn", "block").agg(F.count("*").alias("n")).filter("n > 1")
    shared = tries.join(sizes, ["turn", "block"])
    near = F.array(*[F.lit(x) for x in range(1 << cut) if bin(x).count("1") <= budget])
    width = F.element_at(F.array(*[F.lit(edges[i + 1] - edges[i]) for i in range(blocks)]), F.col("turn") + 1)
    next_bits = F.expr(f"shiftrightunsigned(turned, cast(64 - {cut} - width as int))").bitwiseAND(F.lit((1 << cut) - 1))
    placed = shared.withColumn("width", width).withColumn("own", next_bits.cast("int"))
    crowded = F.col("n") > bucket_rows
    visits = F.when(crowded, F.filter(F.transform(near, lambda x: F.col("own").bitwiseXOR(x)), lambda y: y >= F.col("own"))).otherwise(F.array(F.lit(-1)))
    spots = placed.select("turn", "block", "node", "turned", F.explode(visits).alias("spot"))
    buckets = max(1, -(-total * blocks // bucket_rows))
    dealt = spots.withColumn("bucket", F.pmod(F.xxhash64("turn", "block", "spot"), F.lit(buckets)))

    def join(t: pa.Table) -> pa.Table:
        turn, block, spot = (t.column(c).to_numpy().astype(np.int64) for c in ("turn", "block", "spot"))
        node, turned = t.column("node").to_numpy(), t.column("turned").to_numpy().view(U64)
        us, vs = [], []
        for i in range(blocks):
            for whole in (True, False):
                use = np.flatnonzero((turn == i) & ((spot < 0) == whole))
                if len(use) < 2:
                    continue
                if whole:
                    # all block values of this turn are one trie whose first levels allow no difference
                    use = use[np.argsort(turned[use])]
                    a, b = trie_pairs(turned[use], budget, edges[i + 1] - edges[i])
                    a, b = forest(a, b, len(use))
                    us.append(node[use][a])
                    vs.append(node[use][b])
                    continue
                use = use[np.lexsort((turned[use], spot[use], block[use]))]
                heads = group_starts(block[use] * (1 << cut) + spot[use])
                for x, y in zip(heads, [*heads[1:], len(use)]):
                    own = use[x:y]
                    a, b = trie_pairs(turned[own], budget, edges[i + 1] - edges[i])
                    a, b = forest(a, b, len(own))
                    us.append(node[own][a])
                    vs.append(node[own][b])
        none = np.empty(0, np.int64)
        return pa.table({"u": pa.array(np.concatenate(us) if us else none), "v": pa.array(np.concatenate(vs) if vs else none)})

    return dealt.groupBy("bucket").applyInArrow(join, "u long, v long")


def _grouped(docs: DataFrame, keep: list[str], text_col: str, size: int, budget: int, bucket_rows: int) -> DataFrame:
    """``keep`` (with ``id`` long), ``fingerprint`` long and ``component_id`` of each row."""
    prints = stage(fingerprints(docs, text_col=text_col, size=size, keep=keep), "fingerprints")
    classes = stage(prints.filter("id is not null").groupBy("fingerprint").agg(F.min("id").alias("node")), "classes")
    links = similar_links(classes, budget, bucket_rows)
    roots = components(links)
    named = classes.join(roots, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    # one fingerprint may have very many documents: salted, as there is one row of classes for each
    salts = 16
    one = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    many = prints.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return many.join(one, ["fingerprint", "salt"], "left").drop("salt")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows ``(id, fingerprint, component_id)``: the class of every document under links of at most ``budget`` differing bits.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest id reachable, the own included. Texts without a
    word (empty, null) have fingerprint zero and link like any other. Repeated rows give one row each; a row without
    id gets a fingerprint and no component and links nothing. Other columns are ignored. An empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__doc_text"))
    return _grouped(plain, ["id"], "__doc_text", size, budget, bucket_rows).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def first_of_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class of near duplicates, one for each class, and all rows without id.

    Classes are those of ``near_duplicates``. Rows that share an id are judged by their own texts; of several rows with the smallest id
    and one fingerprint the one with the smallest hash stays, of equal rows one.
    """
    keyed = docs.filter(F.col(id_col).isNotNull()).withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    plain = keyed.select(F.col(id_col).cast("long").alias("id"), "__row", F.col(text_col).alias("__doc_text"))
    first = _grouped(plain, ["id", "__row"], "__doc_text", size, budget, bucket_rows).filter("id = component_id")
    heads = first.groupBy("id", "fingerprint").agg(F.min("__row").alias("__row")).select(F.col("id").alias("__id"), F.col("__row").alias("__head")).distinct()
    kept = keyed.join(heads, (F.col("__row") == F.col("__head")) & (F.col(id_col).cast("long") == F.col("__id")), "left_semi")
    return kept.dropDuplicates([id_col, "__row"]).select(docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
