"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

``token_pieces`` turns texts into pieces of at most ``capacity`` tokens. ``pack`` deals the pieces into
shards of bounded size by a hash, so a hot source or a group of copies spreads evenly. A shard is one row
of lengths; each of its islands evolves an own population of packings:

* a packing is a bin number per piece; its fitness is the mean squared fill (many full bins are better
  than many half-full ones), fewer bins always win;
* crossover injects whole well-filled bins of one parent into the other, removes the bins that now hold
  duplicates and best-fits the displaced pieces, longest first;
* after an epoch every island gets the elite of its neighbour and goes on from both.

The bins that stay below ``dissolve`` full in their shards form new shards with their bins as the first
packing and evolve once more, so that the last bins of different shards meet. Only lengths and bin
numbers move between islands; pieces are joined to their bins at the end.
"""

from __future__ import annotations

import random
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shipping import ship
from lexispark.llm.token_counts import balanced
from lexispark.session import stage

KNOWN_PIECES = 400_000  # encoded parts in each of the two generations a worker keeps
CALL_BYTES = 1 << 18
SHARD_PIECES = 4096

# a space with white space (or the end) on both sides can't be a cut: the pre-tokenizer joins such runs
_UNSAFE = re.compile(r"\s (?:\s|\Z)")


class Encoder:
    """Token ids of texts as little-endian 32-bit integers, under a byte-level tokenizer file.

    A word with its leading space is one unit for the pre-tokenizer, so texts are cut before
    spaces and each distinct part is encoded once. Texts with runs of white space around a space are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.ends = dict(zip(".,", self._encode([".", ","])))
        # the vocabulary spells bytes as characters, most as themselves; the rest by the next ones from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.spelling = [chr(b if b in plain else 256 + other.index(b)) for b in range(256)]

    def _word(self, word: str) -> bytes:
        """Ids of a space and ``word``, which the pre-tokenizer doesn't cut."""
        space = self.spelling[32]
        spelled = space + (word if word.isascii() else "".join([self.spelling[b] for b in word.encode()]))
        ids = [token.id for token in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for call in balanced(texts, CALL_BYTES):
            out += [struct.pack(f"<{len(x)}I", *x.ids) for x in self.tokenizer.encode_batch_fast(call, add_special_tokens=False)]
        return out

    def _learn(self, parts: set[str]) -> None:
        """``parts`` come without their leading space; letters and one comma or full stop after them are two units.

        Letters of the Latin blocks are a unit for sure, so their merges are asked for directly."""
        known, before, rest = self.known, self.before, []
        for part in parts:
            code = before.get(part)
            if code is None:
                end = part[-1:]
                word = part[:-1] if end in self.ends else part
                if word.isalpha() and max(word) < "\u0250":
                    code = known.get(word) or before.get(word) or self._word(word)
                    if word is not part:
                        known[word] = code
                        code += self.ends[end]
                else:
                    rest.append(part)
                    continue
            known[part] = code
        known.update(zip(rest, self._encode([" " + part for part in rest])))

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [None if _UNSAFE.search(text) else text.split(" ") for text in texts]
        if len(self.known) > KNOWN_PIECES:
            self.known, self.before = {}, self.known
        known = self.known
        fresh = {part for parts in cut if parts for part in parts[1:] if part not in known}
        self._learn(fresh)
        first = self._encode([text if parts is None else parts[0] for text, parts in zip(texts, cut)])
        return [
            head if parts is None else head + b"".join(map(known.__getitem__, parts[1:]))
            for head, parts in zip(first, cut)
        ]


_encoders: dict[str, Encoder] = {}


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, piece, start, length, ids_crc32)``: the token ids of each text and id 0, in pieces of at most ``capacity``.

    Only the first piece of a longer document may be shorter than ``capacity``. Null texts count as empty (one
    piece of one token). Repeated rows give their pieces again; null ids stay null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            todo: list[str] = []
            size = first = 0

            def flush(at: int) -> None:
                for k, code in zip(ids[at:], _encoders[path].ids(todo)):
                    code += b"\0\0\0\0"
                    n = len(code) // 4
                    head = n % capacity or capacity
                    start = 0
                    for piece, end in enumerate(range(head, n + 1, capacity)):
                        rows.append((k, piece, start, end - start, zlib.crc32(code[4 * start : 4 * end])))
                        start = end

            for text in batch.column(1):
                value = text.as_py() or ""
                todo.append(value)
                size += len(value)
                if size >= 1 << 22:
                    flush(first)
                    first, size, todo = first + len(todo), 0, []
            flush(first)
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["id", "piece", "start", "length", "ids_crc32"]
            )

    ship(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


# --- one population ---
class Bins:
    """Open bins by free space: finds the tightest bin a piece fits into."""

    def __init__(self, capacity: int):
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def add(self, number: int, free: int) -> None:
        self.by_free[free].append(number)
        self.mask |= 1 << free

    def take(self, size: int) -> tuple[int, int] | None:
        """(bin, its free space) with the least space of at least ``size``; the bin is taken out."""
        rest = self.mask >> size
        if not rest:
            return None
        free = size + (rest & -rest).bit_length() - 1
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        return number, free


def best_fit(lengths: np.ndarray, bins: np.ndarray, items: np.ndarray, capacity: int) -> None:
    """Put ``items`` (in this order) into the tightest bins of the packing ``bins``; -1 marks items without a bin."""
    placed = bins >= 0
    n = int(bins.max()) + 1 if placed.any() else 0
    fill = np.bincount(bins[placed], lengths[placed], minlength=n).astype(np.int64)
    store = Bins(capacity)
    for number in np.flatnonzero((fill > 0) & (fill < capacity)).tolist():
        store.add(number, capacity - int(fill[number]))
    chosen = []
    for size in lengths[items].tolist():
        found = store.take(size)
        if found is None:
            found, n = (n, capacity), n + 1
        number, free = found
        if free > size:
            store.add(number, free - size)
        chosen.append(number)
    bins[items] = chosen


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """(minus the number of bins, mean squared fill): larger is better."""
    fill = np.bincount(bins, lengths)
    fill = fill[fill > 0] / capacity
    return -len(fill), float((fill * fill).mean()) if len(fill) else 0.0


def crossover(lengths: np.ndarray, into: np.ndarray, donor: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of two packings: whole well-filled bins of ``donor``, what is left of ``into``, the rest best-fitted."""
    fill = np.bincount(donor, lengths)
    full = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    given = np.zeros(len(fill), bool)
    given[rng.choice(full, max(1, len(full) // 3), replace=False)] = True
    injected = given[donor]
    broken = np.zeros(int(into.max()) + 1, bool)
    broken[into[injected]] = True
    # a few badly filled bins are opened as well
    own = np.bincount(into, lengths)
    worst = np.flatnonzero((own > 0) & ~broken)
    broken[worst[np.argsort(own[worst])[: max(1, len(worst) // 20)]]] = True
    child = np.where(broken[into], -1, into)
    child[injected] = donor[injected] + int(into.max()) + 1
    loose = np.flatnonzero(child < 0)
    loose = loose[np.lexsort((rng.random(len(loose)), -lengths[loose]))]
    best_fit(lengths, child, loose, capacity)
    return np.unique(child, return_inverse=True)[1].astype(np.int64)


def evolve(lengths: np.ndarray, parents: list[np.ndarray], capacity: int, seed: int, size: int, rounds: int) -> np.ndarray:
    """The elite packing after ``rounds`` steady-state generations of ``size`` packings, ``parents`` among them."""
    rng = np.random.default_rng(seed)
    random.seed(seed)
    population = [p.copy() for p in parents]
    while len(population) < size:
        noise = 1 + 0.02 * len(population) * rng.random(len(lengths)) if population else np.ones(len(lengths))
        fresh = np.full(len(lengths), -1, np.int64)
        best_fit(lengths, fresh, np.argsort(-lengths * noise, kind="stable"), capacity)
        population.append(fresh)
    scores = [fitness(lengths, p, capacity) for p in population]
    least = -int(-(-int(lengths.sum()) // capacity))
    for _ in range(rounds):
        if max(scores)[0] >= least or len(lengths) < 3:
            break
        best = max(range(len(population)), key=scores.__getitem__)
        other = random.choice([i for i in range(len(population)) if i != best])
        into, donor = (best, other) if rng.random() < 0.5 else (other, best)
        child = crossover(lengths, population[into], population[donor], capacity, rng)
        score = fitness(lengths, child, capacity)
        worst = min(range(len(population)), key=scores.__getitem__)
        if score > scores[worst]:
            population[worst], scores[worst] = child, score
    return population[max(range(len(population)), key=scores.__getitem__)]


# --- shards on Spark ---
_ORDER = [("id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending"), ("prior", "ascending")]
_EMPTY = np.empty(0, np.int64)


def _evolved(shards: DataFrame, capacity: int, islands: int, epochs: int, size: int, rounds: int) -> DataFrame:
    """(shard, bins): the best packing of each row ``(shard, lengths, prior)`` over its islands."""
    schema = "shard long, island int, lengths binary, bins binary, n int, fill double"

    def step(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
                    parents = [np.frombuffer(x, np.int32).astype(np.int64) for x in (row["own"], row["migrant"]) if x]
                    seed = (row["shard"] * 31 + row["island"]) * 31 + epoch
                    bins = evolve(lengths, parents, capacity, seed & 0x7FFFFFFF, size, rounds) if len(lengths) else _EMPTY
                    n, fill = fitness(lengths, bins, capacity)
                    rows.append((row["shard"], row["island"], row["lengths"], bins.astype(np.int32).tobytes(), -n, fill))
                columns = list(zip(*rows)) or [()] * 6
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["shard", "island", "lengths", "bins", "n", "fill"])

        return run

    spread = max(1, shards.sparkSession.sparkContext.defaultParallelism)
    rows = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.col("prior").alias("own"), F.lit(None).cast("binary").alias("migrant"))
    elites = None
    for epoch in range(epochs):
        if elites is not None:
            # each island sends its elite to the next one of its shard
            sent = elites.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("migrant"))
            rows = elites.select("shard", "island", "lengths", F.col("bins").alias("own")).join(sent, ["shard", "island"])
        dealt = rows.select("shard", "island", "lengths", "own", "migrant").repartition(4 * spread, "shard", "island")
        elites = stage(dealt.mapInArrow(step(epoch), schema), f"packing-elites-{epoch}")
    best = elites.groupBy("shard").agg(F.min_by(F.struct("bins"), F.struct("n", -F.col("fill"), "island")).alias("best"))
    return best.select("shard", "best.bins")


def _packed(pieces: DataFrame, capacity: int, **how) -> DataFrame:
    """``pieces`` (id, piece, start, length, ids_crc32, prior, shard) with ``bin`` (in its shard), ``offset`` and ``fill`` of the bin."""

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by(_ORDER)
        prior = t.column("prior").to_numpy()
        known = np.unique(prior, return_inverse=True)[1].astype(np.int32).tobytes() if len(prior) and prior.min() >= 0 else None
        lengths = t.column("length").to_numpy().astype(np.int32).tobytes()
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "lengths": pa.array([lengths], pa.binary()), "prior": pa.array([known], pa.binary())})

    def place(key: tuple, t: pa.Table, solution: pa.Table) -> pa.Table:
        t = t.sort_by(_ORDER)
        bins = np.frombuffer(solution.column("bins")[0].as_py(), np.int32).astype(np.int64)
        lengths = t.column("length").to_numpy()
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        begins = ends - lengths[order]
        heads = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offsets = np.empty(len(bins), np.int64)
        offsets[order] = begins - np.maximum.accumulate(np.where(heads, begins, 0))
        fill = np.bincount(bins, lengths)[bins].astype(np.int64)
        return t.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets)).append_column("fill", pa.array(fill))

    shards = pieces.groupBy("shard").applyInArrow(gather, "shard long, lengths binary, prior binary")
    best = _evolved(shards, capacity, **how)
    columns = "id long, piece int, start long, length long, ids_crc32 long, prior long, shard long"
    return pieces.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(place, columns + ", bin long, offset long, fill long")


def pack(
    pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id", shard_pieces: int = SHARD_PIECES,
    islands: int = 2, epochs: int = 2, population: int = 4, rounds: int = 6, dissolve: float = 0.995,
) -> DataFrame:
    """``pieces`` (as of ``token_pieces``) with ``sequence_id`` and ``offset``: sequences of at most ``capacity``, gapless from 0.

    Every row is packed exactly once; equal rows are separate pieces. Pieces longer than ``capacity`` are not allowed.
    """
    how = {"islands": islands, "epochs": epochs, "size": population, "rounds": rounds}
    ship(pieces.sparkSession)
    names = ["piece", "start", "length", "ids_crc32"]
    # rows without an id, or many of one id, are dealt by their place in the stored table
    base = stage(pieces.select(F.col(id_col).alias("id"), *names, F.monotonically_increasing_id().alias("row")), "packing-pieces")
    n_shards = max(1, -(-base.count() // shard_pieces))
    key = F.pmod(F.xxhash64("row"), F.lit(n_shards))
    first = stage(_packed(base.select("id", *names, F.lit(-1).cast("long").alias("prior"), key.alias("shard")), capacity, **how), "packing-first")
    done = first.filter(F.col("fill") >= dissolve * capacity)
    # bins below that share go on together, as whole bins, so the new shards start from a valid packing
    rest = first.filter(F.col("fill") < dissolve * capacity)
    left = rest.count()
    width = 1 << 24  # bins of a shard
    number = F.col("shard") * width + F.col("bin")
    n_rest = max(1, -(-left // shard_pieces))
    again = rest.select("id", *names, number.alias("prior"), F.pmod(F.xxhash64("shard", "bin"), F.lit(n_rest)).alias("shard"))
    second = _packed(again, capacity, **how)
    level = lambda df, k: df.select(F.col("id").alias(id_col), *names, (F.lit(k * (1 << 55)) + number).alias("sequence_id"), "offset")
    return level(done, 0).unionByName(level(second, 1))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Token pieces of ``docs`` packed into sequences; see ``token_pieces`` and ``pack``. An empty table gives no rows."""
    return pack(token_pieces(docs, path, capacity, id_col, text_col), capacity, id_col, **how)
