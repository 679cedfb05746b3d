"""Spelling variants: words one edit apart, found by search schemes over an FM-index of the vocabulary in both directions.

A word and its variant agree in one of two halves, so a search matches one half exactly and extends across the other with one error.
Both searches begin at a word's end: the index holds the words between delimiters, one index as they are and one mirrored, and a
search is a chain of backward steps over intervals of suffix ranks.

The vocabulary is dealt to tasks by the half that has to agree. A half with very many words is halved again by the same argument:
a pair that agrees in the first p and the last s letters has its error in between, so it agrees in half of that as well. Each
pair belongs to one group at every level, decided by the length of its common prefix, so none is found twice or lost.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shipping import ship
from lexispark.llm.textarrays import release
from lexispark.session import stage

LETTERS = "[A-Za-zÀ-ÿ]"
GROUP_WORDS = 20_000  # words of a group that is not halved again
BUCKET_WORDS = 40_000  # words a task indexes at once, about
END = 0  # code of the delimiter


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, rarest: int = 2, every: int = 31) -> DataFrame:
    """``word`` and its occurrences ``n``: runs of letters of all texts, A-Z lower-cased, of ``least`` letters and ``rarest`` occurrences on.

    A run whose crc32 h of ``<id>:<run>`` is divisible by ``every`` loses its letter h % length: misspellings with a known origin.
    Null texts have no runs; a row without id counts under an empty id.
    """
    text = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("of"), F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS}{{{least},}})"))).alias("run"))
    h = F.crc32(F.concat(F.col("of"), F.lit(":"), F.col("run")))
    size = F.length("run")
    at = (F.col("h") % size).cast("int")
    changed = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(changed.alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


class Index:
    """FM-index of distinct words, each between delimiters: backward steps as look-ups in the places of each letter."""

    def __init__(self, letters: np.ndarray, starts: np.ndarray):
        """``letters``: codes of all words, each followed by END; ``starts``: where they begin. One END stands in front."""
        text = np.concatenate([[END], letters]).astype(np.int64)
        n = len(text)
        # suffixes in order, by ranks of doubled length; no search runs past a delimiter
        rank = text
        span, longest = 1, int(np.diff(np.append(starts, len(letters))).max()) + 1
        order = np.argsort(rank, kind="stable")
        while True:
            ordered = rank[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if span > longest or fresh[-1] == n - 1:
                break
            later = np.zeros(n, np.int64)
            later[:-span] = rank[span:] + 1
            rank = rank * (n + 1) + later
            order = np.argsort(rank, kind="stable")
            span *= 2
        before = text[order - 1]  # the letter in front of each suffix, in rank order
        self.n, self.text = n, text
        self.places = np.sort(before * n + np.arange(n))
        first = np.searchsorted(text[order], np.arange(int(text.max()) + 2))
        self.first = first
        self.before = before
        word = np.zeros(n, np.int64)
        word[starts] = np.arange(len(starts))  # the delimiter in front of a word names it
        self.word_at = word[order]
        # of runs of equal letters in ``before``: how many different letters an interval holds is small, so they are listed by hops
        self.next_same = self._hops(before)

    @staticmethod
    def _hops(before: np.ndarray) -> np.ndarray:
        """End of the run of equal letters around each rank."""
        edges = np.flatnonzero(before[1:] != before[:-1]) + 1
        ends = np.append(edges, len(before))
        return ends[np.searchsorted(edges, np.arange(len(before)), side="right")]

    def step(self, letter: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that have ``letter`` in front of those in [lo, hi)."""
        key = letter * self.n
        return np.searchsorted(self.places, key + lo), np.searchsorted(self.places, key + hi)

    def letters_in(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, letter) for the distinct letters in front of the suffixes of each interval."""
        pair = lo * (self.n + 1) + hi
        same, inverse = np.unique(pair, return_inverse=True)  # many searches stand at one node: it is opened once
        low, high = same // (self.n + 1), same % (self.n + 1)
        rows, found, at, own = [], [], low, np.arange(len(same))
        while len(own):
            letter = self.before[at]
            rows.append(own)
            found.append(letter)
            at = self.next_same[at]
            left = at < high[own]
            own, at = own[left], at[left]
        row, letter = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, found))
        key = np.unique(row * (int(self.before.max()) + 1) + letter)
        row, letter = key // (int(self.before.max()) + 1), key % (int(self.before.max()) + 1)
        # back to the searches: those of one node follow each other
        by_node = np.argsort(inverse, kind="stable")
        n_at = np.bincount(inverse, minlength=len(same))
        lead = np.cumsum(n_at) - n_at
        times = n_at[row]
        offset = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        return by_node[np.repeat(lead[row], times) + offset], np.repeat(letter, times)


def one_error(index: Index, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, fixed: np.ndarray, mirrored: bool) -> Iterator[tuple]:
    """(query, word, place, inserted) for words one replaced or one more letter away from each query.

    A query has ``sizes`` codes in ``letters`` from ``starts`` on; its last ``fixed`` letters have to agree (in the mirrored index the
    words and queries are mirrored, so these are the first ones). ``place`` is the length of the common prefix of the two words.
    """
    query = np.arange(len(sizes))
    left = sizes.copy()  # letters of the query that are not matched yet
    # every suffix that begins with a delimiter: the ends of the words
    lo, hi = np.full(len(query), index.first[END]), np.full(len(query), index.first[END + 1])
    while len(query):
        free = sizes[query] - left >= fixed[query]
        if free.any():
            own = np.flatnonzero(free)
            row, letter = index.letters_in(lo[own], hi[own])
            row = own[row]
            q, rest = query[row], left[row]
            following = np.where(rest > 0, letters[starts[q] + rest - 1], END)
            behind = np.where(rest < sizes[q], letters[starts[q] + np.minimum(rest, sizes[q] - 1)], -1)
            real = letter != END
            # replaced: the letter differs from the query's at this place
            swap = np.flatnonzero(real & (rest > 0) & (letter != following))
            yield from _finish(index, letters, starts, sizes, q[swap], rest[swap] - 1, letter[swap], lo[row][swap], hi[row][swap], mirrored, False)
            # one more letter: of equal letters in a row it counts as the last one of the word (in the mirror: the other end of the row)
            more = np.flatnonzero(real & (letter != (following if mirrored else behind)))
            yield from _finish(index, letters, starts, sizes, q[more], rest[more], letter[more], lo[row][more], hi[row][more], mirrored, True)
        # exactly on
        going = np.flatnonzero(left > 0)
        query, left = query[going], left[going] - 1
        lo, hi = index.step(letters[starts[query] + left], lo[going], hi[going])
        alive = lo < hi
        query, left, lo, hi = query[alive], left[alive], lo[alive], hi[alive]


def _finish(index: Index, letters, starts, sizes, query, left, letter, lo, hi, mirrored: bool, inserted: bool) -> Iterator[tuple]:
    """Take the wrong ``letter``, then the rest of the query exactly up to the delimiter in front of a word."""
    place = sizes[query] - left - (0 if inserted else 1) if mirrored else left
    lo, hi = index.step(letter, lo, hi)
    done = lo < hi
    query, left, lo, hi, place = query[done], left[done], lo[done], hi[done], place[done]
    while len(query):
        ended = left == 0
        if ended.any():
            a, b = index.step(np.full(int(ended.sum()), END), lo[ended], hi[ended])
            hit = np.flatnonzero(a < b)  # words are distinct, so an interval is one rank
            own = np.flatnonzero(ended)[hit]
            yield query[own], index.word_at[a[hit]], place[own], np.full(len(own), inserted)
        going = np.flatnonzero(~ended)
        query, place, left = query[going], place[going], left[going] - 1
        lo, hi = index.step(letters[starts[query] + left], lo[going], hi[going])
        alive = lo < hi
        query, left, lo, hi, place = query[alive], left[alive], lo[alive], hi[alive], place[alive]


def _coded(words: list[str], mirrored: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all words, each with END behind it; starts; lengths)."""
    points = np.frombuffer("".join(w[::-1] if mirrored else w for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    known = np.unique(points)
    out = np.zeros(len(points) + len(words), np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    at = np.arange(len(points)) + np.repeat(np.arange(len(words)), sizes)
    out[at] = np.searchsorted(known, points) + 1
    return out, starts, sizes


def near_words(words: list[str], asks: list[tuple[int, int, int, int, int]], mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, near) places in ``words`` (distinct): ``asks`` are (word, first letters fixed, last letters fixed, least place, stop place)."""
    letters, starts, sizes = _coded(words, mirrored)
    index = Index(letters, starts)
    who, p, s, low, stop = (np.array(x, np.int64) for x in zip(*asks))
    a, b = [], []
    for query, word, place, inserted in one_error(index, letters, starts[who], sizes[who], p if mirrored else s, mirrored):
        # the error lies between the parts that agree, and the pair belongs to this group only
        inside = (place >= low[query]) & (place < stop[query]) & (place + ~inserted + s[query] <= sizes[who[query]])
        query, word, inserted = who[query[inside]], word[inside], inserted[inside]
        a += [query, word[inserted]]
        b += [word, query[inserted]]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _groups(words: DataFrame, least: int, group_words: int, rounds: int = 40) -> DataFrame:
    """(word, n, size, p, s, stop): each word under the parts that a near word of shorter length ``size`` or more has to share.

    ``size`` is the length of the shorter word of a pair. Groups over ``group_words`` are halved until a single letter is free.
    """
    own = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")).where(F.col("size") >= least)
    whole = own.withColumns({"p": F.lit(0), "s": F.lit(0), "stop": F.col("size") + 1})
    now, done = _halved(whole), None
    for _ in range(rounds):
        now = stage(now, "halves")
        crowd = now.groupBy(*_shared()).agg(F.count("*").alias("n_words"), F.max(F.col("size") - F.col("p") - F.col("s")).alias("free"))
        crowd = stage(crowd.where((F.col("n_words") > group_words) & (F.col("free") > 1)).drop("free"), "crowded")
        if crowd.isEmpty():
            return now if done is None else done.unionByName(now)
        # a crowded group has many words, so there are few of them: at most their number over group_words
        marked = now.join(crowd.withColumnsRenamed({c: f"__{c}" for c in ("size", "p", "s", "stop")}), [F.col(c) == F.col(f"__{c}") for c in ("size", "p", "s", "stop")] + [_first() == F.col("first"), _last() == F.col("last")], "left")
        rest = marked.where("n_words is null").select(*now.columns)
        done = rest if done is None else done.unionByName(rest)
        now = _halved(marked.where("n_words is not null").select(*now.columns))
    raise RuntimeError("groups did not settle")


def _first() -> Column:
    return F.expr("substr(word, 1, p)")


def _last() -> Column:
    return F.expr("right(word, s)")


def _shared() -> list:
    return ["size", "p", "s", "stop", _first().alias("first"), _last().alias("last")]


def _halved(rows: DataFrame) -> DataFrame:
    free = F.col("size") - F.col("p") - F.col("s")
    half = F.floor(free / 2).cast("int")
    first = F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s"), F.col("stop").alias("stop"))
    last = F.struct(F.col("p").alias("p"), (F.col("s") + free - half).alias("s"), F.least(F.col("stop"), F.col("p") + half).alias("stop"))
    return rows.withColumn("__half", F.explode(F.array(first, last))).select("word", "n", "size", "__half.p", "__half.s", "__half.stop")


def near_pairs(words: DataFrame, least: int, group_words: int = GROUP_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(word, near, n_near) for all ordered pairs of ``words`` (word, n; distinct, of ``least`` letters on) that are one edit apart."""
    ship(words.sparkSession)
    rows = _groups(words, least, group_words)
    total = words.count()
    buckets = max(1, -(-total * 4 // bucket_words))
    # groups of one direction and similar parts share a task, words that are in several of its groups are indexed once
    mirrored = F.col("p") >= F.col("s")
    part = F.when(mirrored, F.xxhash64(F.lit(1), F.expr("substr(word, 1, p)"), "s", F.expr("right(word, s)"))).otherwise(F.xxhash64(F.lit(0), F.expr("right(word, s)"), "p", F.expr("substr(word, 1, p)")))
    dealt = rows.withColumns({"mirrored": mirrored, "bucket": F.pmod(part, F.lit(buckets)).cast("int")})

    def search(t: pa.Table) -> pa.Table:
        out = [pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string()), "n_near": pa.array([], pa.int64())})]
        word_column = t.column("word").to_pylist()
        n, size, p, s, stop = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "size", "p", "s", "stop"))
        side = t.column("mirrored").to_numpy(zero_copy_only=False).astype(bool)
        for way in (True, False):
            own = np.flatnonzero(side == way)
            place: dict[str, int] = {}
            counts, asks = [], []
            for i in own.tolist():
                w = word_column[i]
                k = place.setdefault(w, len(place))
                if k == len(counts):
                    counts.append(n[i])
                if size[i] == len(w):  # the shorter word of a pair asks
                    asks.append((k, p[i], s[i], p[i], stop[i]))
            if not asks:
                continue
            words_here, counts = list(place), np.array(counts, np.int64)
            a, b = near_words(words_here, asks, way)
            text = pa.array(words_here, pa.string())
            out.append(pa.table({"word": text.take(pa.array(a)), "near": text.take(pa.array(b)), "n_near": pa.array(counts[b])}))
        release()
        return pa.concat_tables(out)

    return dealt.groupBy("bucket").applyInArrow(search, "word string, near string, n_near long")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, rarest: int = 2, times: int = 10, group_words: int = GROUP_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """One row for each word of the ``vocabulary``: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word with most occurrences (ties: the smallest) if it has at least ``times`` those of the word, ``root`` the end of
    the chain of forms, the word itself without one. Null and empty texts and rows without letters add nothing; repeated rows
    count each; other columns are ignored; an empty table gives no rows.
    """
    words = stage(vocabulary(docs, id_col, text_col, least, rarest), "vocabulary")
    pairs = near_pairs(words, least, group_words, bucket_words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_near")).alias("less"), F.col("near").alias("form"))).alias("best"))
    own = words.join(best, "word", "left")
    form_n = -F.col("best.less")
    often = form_n >= F.col("n") * times
    rows = own.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("best.form")).alias("form"), F.when(often, form_n).alias("form_n"))
    rows = stage(rows, "forms")
    # chains by doubled steps: each form has at least ``times`` the occurrences, so the longest chain is known
    top = rows.agg(F.max("n")).first()[0] or 1
    steps, limit = 1, 1
    while limit < top:
        steps, limit = steps + 1, limit * max(times, 2)
    jump = rows.where("form is not null").select("word", F.col("form").alias("root"))
    doubled = 1
    while doubled < steps:
        jump = stage(jump, "roots")
        further = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jump = jump.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        doubled *= 2
    return rows.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
