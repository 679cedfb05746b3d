"""Phrase collocations: n-gram counts in burst tries, by levels, and the weakest cut of each phrase.

A phrase is as frequent as its parts at most, so three passes are enough: words, then pairs of frequent words, then the longer phrases all
of whose pairs are frequent. What is frequent travels as a Bloom filter of fixed size: a false entry costs some counting and
changes nothing, as all counts are exact.

A task counts in a shallow trie over word ids with containers of phrases below it. As in a HAT-trie's hybrid containers, one serves a range
of first words at the start; one that grows too large bursts in two, down to a single first word and a range of second words. The
containers are sorted columns, not hash tables: whole blocks of text enter them at once. When the trie is full its largest subtrees
go out whole as sorted runs, and the runs of a prefix partition are merged in one place. A first word with very many followers is
dealt over several partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm.shipping import ship
from lexispark.llm.textarrays import U64, group_starts, mix, release, row_groups, text_buffers, word_bounds, word_hashes
from lexispark.operators.joins import frequency_join
from lexispark.session import stage

BREAKS = np.zeros(256, bool)  # [.,;:!?\x0A-\x0D]: bytes that never occur inside a longer UTF-8 sequence
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = BREAKS.copy()
GAPS[[0x20, 0x09]] = True
SLICE_BYTES = 1 << 20  # text handled at once
WORD_ENTRIES = 400_000  # words a task holds before it sends them on
TRIE_ENTRIES = 2_000_000  # phrases a task holds before it sends subtrees on
BURST = 1 << 16  # phrases of a container before it bursts
PREFIX_SPLIT = 64  # partitions over which the phrases of one first word are dealt
PART_BYTES = 4 << 20  # text behind a prefix partition
BLOOM_BITS = 1 << 26
RUN = "part int, lang string, size int, ids binary, counts binary"


class Container:
    """Phrases whose packed prefix lies in one range of the trie: added as sorted blocks, merged when they have doubled."""

    def __init__(self) -> None:
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        self.merged = self.pending = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.blocks.append((keys, counts))
        self.pending += len(counts)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.blocks) != 1:
            self.blocks = [counted(np.concatenate([k for k, _ in self.blocks]), np.concatenate([n for _, n in self.blocks]))]
        self.merged, self.pending = len(self.blocks[0][1]), 0
        return self.blocks[0]

    def __len__(self) -> int:
        return self.merged + self.pending


class Burst:
    """Counts of phrases of one length: a shallow trie over the first two word ids with containers below it.

    A node covers a range of first words, later one first word or a range of its second words; the container of a node that grows
    over ``BURST`` phrases bursts in two at its middle prefix.
    """

    def __init__(self) -> None:
        self.starts = np.zeros(1, U64)  # the first packed prefix of each node
        self.nodes = [Container()]

    @property
    def entries(self) -> int:
        return sum(map(len, self.nodes))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Sorted distinct ``keys`` (packed ids, one row for each phrase) with their counts."""
        edges = np.append(np.searchsorted(keys[:, 0], self.starts), len(keys))
        for k in np.flatnonzero(np.diff(edges))[::-1].tolist():
            node = self.nodes[k]
            node.add(keys[edges[k] : edges[k + 1]], counts[edges[k] : edges[k + 1]])
            if node.pending > max(BURST // 2, node.merged):
                node.merge()
                if len(node) > BURST:
                    self._burst(k)

    def _burst(self, k: int) -> None:
        keys, counts = self.nodes[k].merge()
        middle = keys[len(keys) // 2, 0]
        if middle == keys[0, 0]:  # a prefix of two words is never taken apart
            later = keys[:, 0] > middle
            if not later.any():
                return
            middle = keys[np.argmax(later), 0]
        cut = int(np.searchsorted(keys[:, 0], middle))
        halves = [Container(), Container()]
        for half, part in zip(halves, (slice(None, cut), slice(cut, None))):
            half.add(keys[part], counts[part])
            half.merge()
        self.nodes[k : k + 1] = halves
        self.starts = np.insert(self.starts, k + 1, middle)

    def spill(self, left: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The sorted runs of the largest containers, until at most ``left`` phrases stay; the nodes stay for what is to come."""
        now = self.entries
        for k in sorted(range(len(self.nodes)), key=lambda k: -len(self.nodes[k])):
            if now <= left:
                return
            now -= len(self.nodes[k])
            if len(self.nodes[k]):
                yield self.nodes[k].merge()
                self.nodes[k] = Container()


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``keys`` in order, with their counts."""
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    keys = keys[order]
    heads = group_starts_of_rows(keys)
    n = np.diff(np.append(heads, len(keys))) if counts is None else np.add.reduceat(counts[order], heads)
    return keys[heads], n.astype(np.int64)


def packed(ids: list[np.ndarray]) -> np.ndarray:
    """Columns of word ids, two to a column of 64 bits."""
    pairs = [(ids[k].astype(U64) << U64(32)) | (ids[k + 1].astype(U64) if k + 1 < len(ids) else U64(0)) for k in range(0, len(ids), 2)]
    return np.stack(pairs, axis=1)


def unpacked(keys: np.ndarray, size: int) -> np.ndarray:
    return np.stack([(keys[:, k // 2] >> U64(32)) if k % 2 == 0 else (keys[:, k // 2] & U64(0xFFFFFFFF)) for k in range(size)], axis=1).astype(np.int64)


class Counter:
    """Phrases of one task by language and length; word ids are local, runs carry the 64-bit hashes of the words."""

    def __init__(self, parts: int):
        self.parts = parts
        self.ids: dict[int, int] = {}
        self.words: list[int] = []
        self.tries: dict[tuple[str, int], Burst] = {}

    def local(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words in this task."""
        same, inverse = np.unique(hashes, return_inverse=True)
        known, words = self.ids, self.words
        out = np.empty(len(same), np.int64)
        for k, h in enumerate(same.tolist()):
            i = known.get(h)
            if i is None:
                i = known[h] = len(words)
                words.append(h)
            out[k] = i
        return out[inverse]

    def add(self, lang: str, ids: list[np.ndarray]) -> None:
        """Count phrases given as columns of word ids."""
        self.tries.setdefault((lang, len(ids)), Burst()).add(*counted(packed(ids)))

    def full(self) -> bool:
        return sum(t.entries for t in self.tries.values()) > TRIE_ENTRIES

    def runs(self, left: int) -> Iterator[pa.RecordBatch]:
        """The subtrees that leave, by prefix partition."""
        words = np.array(self.words, U64)
        share = left // max(1, len(self.tries))
        for (lang, size), trie in self.tries.items():
            leaving = list(trie.spill(share))
            if not leaving:
                continue
            keys = words[unpacked(np.concatenate([k for k, _ in leaving]), size)]
            counts = np.concatenate([n for _, n in leaving])
            part = prefix_part(keys, lang, self.parts)
            order = np.lexsort((*keys.T[::-1], part))
            keys, counts, part = keys[order], counts[order].astype(np.int32), part[order]
            edges = np.append(group_starts(part), len(part))
            rows = [(int(part[a]), lang, size, keys[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["part", "lang", "size", "ids", "counts"])


def group_starts_of_rows(rows: np.ndarray) -> np.ndarray:
    if not len(rows):
        return np.empty(0, np.int64)
    return np.concatenate([[0], np.flatnonzero((rows[1:] != rows[:-1]).any(axis=1)) + 1])


def language_code(lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 7)


def prefix_part(keys: np.ndarray, lang: str, parts: int) -> np.ndarray:
    """Partition of each phrase: by its first word, one of ``PREFIX_SPLIT`` by the others."""
    rest = np.zeros(len(keys), U64)
    for column in keys.T[1:]:
        rest = mix(rest * U64(0x9E3779B97F4A7C15) + column)
    return (mix(mix(keys[:, 0] ^ U64(language_code(lang))) + rest % U64(PREFIX_SPLIT)) % U64(parts)).astype(np.int64)


def bloom_places(keys: np.ndarray, lang: str) -> np.ndarray:
    """One row for each key (word hashes of a phrase): its two bits in the filter."""
    own = np.full(len(keys), language_code(lang), U64)
    for column in keys.T:
        own = mix(own * U64(0x9E3779B97F4A7C15) + column)
    return np.stack([own % U64(BLOOM_BITS), (own >> U64(32)) % U64(BLOOM_BITS)], axis=1).astype(np.int64)


def words_of(column: pa.Array, langs: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lang, bytes, starts, ends, hashes, whether a word continues its piece) for slices of texts of one language."""
    raw, at = text_buffers(column)
    names = langs.to_pylist()
    for first, last in row_groups(np.diff(at), SLICE_BYTES):
        starts, ends, counts = word_bounds(raw, at[first : last + 1], GAPS)
        hashes = word_hashes(raw, starts, ends, lower=True)
        broken = np.concatenate([[0], np.cumsum(BREAKS[raw[at[first] : at[last]]])])
        lo = int(at[first])
        joined = np.zeros(len(starts), bool)
        joined[1:] = broken[starts[1:] - lo] == broken[ends[:-1] - lo]
        row = np.repeat(np.arange(first, last), counts)
        if len(row):
            joined[1:] &= row[1:] == row[:-1]
        for lang in dict.fromkeys(names[first:last]):
            own = np.array([n == lang for n in names[first:last]])[row - first]
            if own.all():
                yield lang, raw, starts, ends, hashes, joined
            elif own.any():  # rows of a language are whole, so their words still follow each other
                yield lang, raw, starts[own], ends[own], hashes[own], joined[own]


def count_words(docs: DataFrame, parts: int) -> DataFrame:
    """(lang, word, id, n): every word of ``docs`` (lang, text) with its 64-bit id and occurrences."""
    upper = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict[int, list]] = {}
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            for lang, box in found.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(box)), pa.array([w for w, _ in box.values()], pa.binary()).cast(pa.string()),
                     pa.array(np.array(list(box), U64).view(np.int64)), pa.array([n for _, n in box.values()], pa.int64())],
                    names=["lang", "word", "id", "n"],
                )
            found.clear()

        for batch in batches:
            for lang, raw, starts, ends, hashes, _ in words_of(batch.column(1), batch.column(0)):
                same, where, n = np.unique(hashes, return_index=True, return_counts=True)
                box = found.setdefault(lang, {})
                size -= len(box)
                for h, a, b, k in zip(same.tolist(), starts[where].tolist(), ends[where].tolist(), n.tolist()):
                    own = box.get(h)
                    if own is None:
                        box[h] = [raw[a:b].tobytes().translate(upper), k]
                    else:
                        own[1] += k
                size += len(box)
                if size > WORD_ENTRIES:
                    yield from send()
                    size = 0
        yield from send()
        release()

    return docs.mapInArrow(run, "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def bloom_filter(spark: SparkSession, frequent: DataFrame):
    """A broadcast filter of ``frequent`` (lang, ids: the word hashes of a phrase), of ``BLOOM_BITS`` whatever their number."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, ids = np.array(batch.column(0).to_pylist(), object), batch.column(1)
            keys = ids.flatten().to_numpy().view(U64).reshape(len(langs), -1) if len(langs) else np.empty((0, 1), U64)
            out = [bloom_places(keys[langs == lang], lang).ravel() for lang in dict.fromkeys(langs)]
            # Spark counts bits from 1
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) + 1 if out else np.empty(0, np.int64))], names=["at"])

    bits = frequent.select("lang", "ids").mapInArrow(places, "at long")
    maps = bits.groupBy(F.expr("bitmap_bucket_number(at)").alias("slot")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in maps.toLocalIterator():  # at most BLOOM_BITS / 32768 rows of 4 KB
        out[(r.slot - 1) * 4096 : r.slot * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return spark.sparkContext.broadcast(out)


def held(bits: np.ndarray, keys: np.ndarray, lang: str) -> np.ndarray:
    at = bloom_places(keys, lang)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def count_phrases(docs: DataFrame, sizes: tuple[int, ...], known: int, bloom, parts: int, least: int) -> DataFrame:
    """(lang, ids, n) of the phrases of ``sizes`` words with ``n`` of at least ``least``, all of whose ``known``-word parts are in ``bloom``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, bits = Counter(parts), bloom.value
        for batch in batches:
            for lang, _, _, _, hashes, joined in words_of(batch.column(1), batch.column(0)):
                good, span = _phrases_in(hashes, joined, known, bits, lang), known
                ids = None
                for size in sorted(sizes):
                    while span < size:  # a phrase is open if both its parts of one word less are, and its words are of one piece
                        good, span = good[:-1] & good[1:] & joined[span : span + max(len(good) - 1, 0)], span + 1
                    at = np.flatnonzero(good)
                    if ids is None and len(at):  # the shortest phrases hold all words that are needed
                        used = np.zeros(len(hashes), bool)
                        for k in range(size):
                            used[at + k] = True
                        ids = np.zeros(len(hashes), np.int64)
                        ids[used] = counter.local(hashes[used])
                    if len(at):
                        counter.add(lang, [ids[at + k] for k in range(size)])
                if counter.full():
                    yield from counter.runs(TRIE_ENTRIES // 2)
        yield from counter.runs(0)
        release()

    def merge(t: pa.Table) -> pa.Table:
        out = [pa.table({"lang": pa.array([], pa.string()), "ids": pa.array([], pa.list_(pa.int64())), "n": pa.array([], pa.int64())})]
        by_kind: dict[tuple[str, int], list] = {}
        for lang, size, ids, counts in zip(*(t.column(c).to_pylist() for c in ("lang", "size", "ids", "counts"))):
            by_kind.setdefault((lang, size), []).append((ids, counts))
        for (lang, size), runs in by_kind.items():
            keys = np.concatenate([np.frombuffer(i, U64).reshape(-1, size) for i, _ in runs])
            counts = np.concatenate([np.frombuffer(c, np.int32) for _, c in runs]).astype(np.int64)
            keys, total = counted(keys, counts)
            often = total >= least
            found = keys[often].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, size, dtype=np.int32)), pa.array(found.ravel()))
            out.append(pa.table({"lang": pa.array([lang] * len(found), pa.string()), "ids": lists, "n": pa.array(total[often])}))
        release()
        return pa.concat_tables(out)

    return docs.mapInArrow(run, RUN).groupBy("part").applyInArrow(merge, "lang string, ids array<long>, n long")


def _phrases_in(hashes: np.ndarray, joined: np.ndarray, known: int, bits: np.ndarray, lang: str) -> np.ndarray:
    """For each place whether the phrase of ``known`` words there is in the filter."""
    if len(hashes) < known:
        return np.zeros(0, bool)
    n = len(hashes) - known + 1
    whole = np.ones(n, bool)
    for k in range(1, known):
        whole &= joined[k : k + n]
    out = np.zeros(n, bool)
    at = np.flatnonzero(whole)
    out[at] = held(bits, np.stack([hashes[at + k] for k in range(known)], axis=1), lang)
    return out


def _key(phrase: Column | str) -> Column:
    return F.concat(F.col(phrase) if isinstance(phrase, str) else phrase, F.lit("\n"), F.col("lang"))


def _spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, a) of ``phrases`` (lang, ids, n) with the words of staged ``words`` (lang, id, word)."""
    look = F.concat(F.col("id"), F.lit("\n"), F.col("lang")).alias("look")
    table = stage(words.select(look, "word"), "phrase-words")
    single = phrases.select("lang", "ids", "n", F.posexplode("ids").alias("at", "id")).select("lang", "ids", "n", "at", look)
    named = frequency_join(single, table, "look").groupBy("lang", "ids").agg(F.max("n").alias("a"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("own"))
    return named.select("lang", F.array_join(F.transform("own", lambda x: x["word"]), " ").alias("phrase"), F.size("own").alias("n_words"), "a")


def phrase_counts(docs: DataFrame, least: int, longest: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Staged (lang, phrase, n_words, a) for all phrases of 1 to ``longest`` words with ``a`` of at least ``least``, and (lang, n) words."""
    spark = docs.sparkSession
    words = stage(count_words(docs, parts), "word-counts")
    totals = stage(words.groupBy("lang").agg(F.sum("n").alias("n")), "language-words")
    often = stage(words.where(F.col("n") >= least).select("lang", "word", "id", "n", F.array("id").alias("ids")), "frequent-words")
    if not often.groupBy("lang", "id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        raise RuntimeError("two frequent words share a 64-bit hash")
    pairs = stage(count_phrases(docs, (2,), 1, bloom_filter(spark, often), parts, least), "frequent-pairs")
    found = often.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("n_words"), F.col("n").alias("a"))
    if longest > 1:
        longer = pairs
        if longest > 2:
            longer = pairs.unionByName(count_phrases(docs, tuple(range(3, longest + 1)), 2, bloom_filter(spark, pairs), parts, least))
        found = found.unionByName(_spelled(stage(longer, "frequent-phrases"), often))
    return stage(found, "phrases"), totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, share: int = 100) -> DataFrame:
    """The ``top`` collocations of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts (A-Z lower-cased) fall into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words at spaces and tabs; a phrase of 2 to ``longest``
    words lies within a piece and has ``a`` occurrences, at least ``least``. Of its cuts into two the lowest of
    floor(1000 a n / (l r)) is its score, with ``n`` the words of the language. A phrase inside a longer one goes if the
    longer one has ``share`` percent of its occurrences. Null texts are empty, a null language is ``und``; repeated rows count each, ids
    and other columns are not read, ties end with the smaller phrase; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    size = plain.select(F.sum(F.octet_length("text"))).first()[0] or 0
    known, totals = phrase_counts(plain, least, longest, max(1, -(-size // PART_BYTES)))
    counts = stage(known.select(_key("phrase").alias("key"), F.col("a").alias("f")), "phrase-counts")
    chosen = known.where("n_words > 1")
    cut = chosen.withColumn("k", F.explode(F.expr("sequence(1, n_words - 1)")))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - n_words)"))
    cut = frequency_join(cut.withColumn("key", _key("first")), counts, "key").withColumnRenamed("f", "l").drop("key")
    cut = frequency_join(cut.withColumn("key", _key("rest")), counts, "key").withColumnRenamed("f", "r").drop("key")
    cut = frequency_join(cut, totals, "lang")
    big = "cast({} as decimal(20, 0))".format
    score = F.expr(f"(1000 * {big('a')} * {big('n')}) div ({big('l')} * {big('r')})")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the most frequent longer phrase around each phrase
    words = F.split("phrase", " ")
    spans = [(i, m) for m in range(2, longest) for i in range(longest - m + 1)]
    if spans:
        inner = [F.when((F.lit(m) < F.col("n_words")) & (F.lit(i + m) <= F.col("n_words")), F.array_join(F.slice(words, i + 1, m), " ")) for i, m in spans]
        within = chosen.where("n_words > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(F.array_compact(F.array(*inner)))).alias("phrase"))
        around = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * share, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
