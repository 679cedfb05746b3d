"""Toxicity by two class-conditional Kneser-Ney bigram models over shared backoff counts.

For a class c and words v, w (D: discount; K: ``strength``; t: classes in which an expression stands)

    P_c(w | v) = P(w | v) P(c | v w) / P(c | v)
    P_c(w)     = max(n(w) - D, 0) / n  P(c | w) / P(c)  +  lambda P_0(w)
    P(c | x)   = g(x) (max(n_c(x) - D, 0) + (K + t D) q_c(x)) / (n(x) + K)  +  (1 - g(x)) q_c(x)

with q_c the backoff of an expression x: P(c) for a word, and for a bigram v w what P(c | v) and P_c(w) give together. g is
the probability that the classes share x in another way than its backoff, from the likelihoods of its counts either way.

All n are continuation counts: an expression counts once for each different word before it, so copies of a
text add nothing. n(w) is that of both classes together and P_0 comes from the counts of w in all
documents; both are shared. Every word and bigram of the labelled sample takes part, however rare: it is drawn to its backoff as far as its
counts allow, a bigram to its word and a word to no evidence, and what neither class has seen says nothing, whatever the sizes of the
classes. lambda gives away just what the discount leaves; P(c | v) comes from the counts of v and K.

A text's evidence is ln P_toxic - ln P_ordinary by word: the mean over the text and the largest mean over ``window``
consecutive words. A logistic curve, fitted on labelled rows the counts have not seen, turns these two into the score.

Only the labelled rows for the two models are bounded (``per_class`` rows of each class at most, smallest hashes
first); so are the tables that are sent to the tasks: the words and bigrams of these rows. The counts behind P_0 go over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shipping import ship
from lexispark.llm.textarrays import U64, group_starts, mix, release, row_groups, text_buffers, word_bounds, word_hashes
from lexispark.session import stage

D = 0.75
SHORT = 8  # words without evidence that every text has besides its own
SLICE_BYTES = 1 << 20
# words: runs of ASCII letters and digits and of bytes beyond ASCII
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FIRST = U64(0x5851F42D4C957F2D)  # stands before the first word


def held_out(id_col: str, folds: int = 4, out: int = 2):
    """Whether a row's labels must not be learned from: crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == out, F.lit(False))


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, words per row) of a column of texts."""
    raw, at = text_buffers(column)
    for first, last in row_groups(np.diff(at), SLICE_BYTES):
        starts, ends, counts = word_bounds(raw, at[first : last + 1], _GAP)
        yield first, last, word_hashes(raw, starts, ends, lower=True), counts


def _before(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The word before each word; a fixed value before the first of a text."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]])[counts > 0]
    out[heads] = _FIRST
    return out


def _bigram_counts(texts: DataFrame) -> DataFrame:
    """(v, w, n0, n1) of ``texts`` (toxic int, text string): the different words before ``v w``, by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, words, counts in _slices(batch.column(1)):
                if not len(words):
                    continue
                before = _before(words, counts)
                side = np.repeat(toxic[first:last], counts).astype(np.int32)
                columns = [_before(before, counts), before, words, side]
                # each expression once for a batch
                key = mix(columns[0] * U64(0x9E3779B97F4A7C15) + mix(before + mix(words + side.astype(U64))))
                order = np.argsort(key)
                heads = order[group_starts(key[order])]
                u, v, w = (pa.array(x[heads].view(np.int64)) for x in columns[:3])
                yield pa.RecordBatch.from_arrays([u, v, w, pa.array(side[heads])], names=["u", "v", "w", "toxic"])

    rows = texts.mapInArrow(run, "u long, v long, w long, toxic int").distinct()
    sums = [F.sum(F.when(F.col("toxic") == c, 1).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    return rows.groupBy("v", "w").agg(*sums)


@dataclass
class Evidence:
    """Logarithms of P_toxic / P_ordinary: by word and by bigram; and the curve to a score."""

    words: np.ndarray  # sorted hashes
    word_ratio: np.ndarray  # of the word after a context it was not seen with; the last entry is for any other word
    bigrams: np.ndarray  # sorted keys context(v) * (size + 1) + place(w)
    bigram_ratio: np.ndarray
    curve: np.ndarray
    window: int

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, hashes)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == hashes, at, len(self.words)) if len(self.words) else np.zeros(len(hashes), np.int64)

    def contexts(self, hashes: np.ndarray) -> np.ndarray:
        """As ``places``, and a place of its own for what stands before the first word."""
        return np.where(hashes == _FIRST, len(self.words) + 1, self.places(hashes))

    def by_word(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        here, size = self.places(words), len(self.words) + 1
        before = np.empty_like(here)
        before[1:] = here[:-1]
        heads = np.concatenate([[0], np.cumsum(counts)[:-1]])[counts > 0]
        before[heads] = size
        ratio = self.word_ratio[here].astype(float)
        if len(self.bigrams):
            key = before * (size + 1) + here
            both = np.flatnonzero((before != size - 1) & (here < size - 1))
            at = np.searchsorted(self.bigrams, key[both])
            at[at == len(self.bigrams)] = 0
            hit = self.bigrams[at] == key[both]
            ratio[both[hit]] = self.bigram_ratio[at[hit]]
        return ratio

    def features(self, column: pa.Array) -> np.ndarray:
        """(mean, largest window mean) of the evidence of each text; zeros without words."""
        out = np.zeros((len(column), 2))
        for first, last, words, counts in _slices(column):
            if not len(words):
                continue
            ratio = self.by_word(words, counts)
            total = np.concatenate([[0], np.cumsum(ratio)])
            ends = np.cumsum(counts)
            heads = ends - counts
            full = counts > 0
            out[first:last, 0][full] = ((total[ends] - total[heads]) / (counts + SHORT))[full]
            # windows are cut at the text's end; a short text is one window
            w = self.window
            stop = np.minimum(np.arange(len(words)) + w, np.repeat(ends, counts))
            start = np.maximum(stop - w, np.repeat(heads, counts))
            means = (total[stop] - total[start]) / w
            out[first:last, 1][full] = np.maximum.reduceat(means, heads[full])
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_design(self.features(column)) @ self.curve, -40, 40)))


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3.0, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton steps; columns are scaled inside.

    ``ridge`` draws the slopes to zero, which matters for a few labelled rows only; the first column, the constant, is left free, so that
    the scores agree with the share of toxic rows on average.
    """
    scale = np.maximum(np.abs(x).mean(0), 1e-9)
    z, beta = x / scale, np.zeros(x.shape[1])
    pull = np.append(1e-6, np.full(x.shape[1] - 1, ridge))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        grad = z.T @ (weight * (y - p)) - pull * beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull)
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 4.0 / max(1e-9, np.abs(move).max()))
        beta += move
        if np.abs(move).max() < 1e-8:
            break
    return beta / scale


def _likelihood(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> float:
    z = x @ beta
    return float((weight * (y * z - np.logaddexp(0, z))).sum())


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers: Stirling's series eight steps further up."""
    steps = np.log(x)
    for i in range(1, 8):
        steps = steps + np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - steps


def toxic_share(n0: np.ndarray, n1: np.ndarray, backoff: np.ndarray, strength: float, prior_own: float) -> np.ndarray:
    """P(toxic | expression) from its counts in both classes and the share that its ``backoff`` expects."""
    q1 = np.clip(backoff, 1e-9, 1 - 1e-9)
    q0, total = 1 - q1, n0 + n1
    back = strength + D * ((n0 > 0).astype(float) + (n1 > 0))
    own = (np.maximum(n1 - D, 0) + back * q1) / (np.maximum(n0 - D, 0) + np.maximum(n1 - D, 0) + back)
    rise = lambda a, n: _log_gamma(a + n) - _log_gamma(a)
    better = rise(strength * q1, n1) + rise(strength * q0, n0) - rise(np.full(len(q1), strength), total) - n1 * np.log(q1) - n0 * np.log(q0)
    weight = 1 / (1 + np.exp(-np.clip(better + np.log(prior_own / (1 - prior_own)), -40, 40)))
    return weight * own + (1 - weight) * q1


def _numpy(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 6_000, strength: float = 2.0, prior_own: float = 0.01, window: int = 24) -> Evidence:
    """The evidence tables and the curve, learned from labelled rows that are not held out.

    Labels other than 0 and 1, null ids and null texts teach nothing. Without a row of both classes all scores are the
    share of toxic labels (or 0).
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    own = own.filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    shares = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = shares.get(0, 0), shares.get(1, 0)
    prior = n1 / max(1, n0 + n1)
    nothing = Evidence(np.empty(0, U64), np.zeros(1), np.empty(0, np.int64), np.empty(0), np.array([np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)), 0.0, 0.0]), window)
    if min(n0, n1) < 2:
        return nothing
    # bounded: 2 * per_class ids
    taken = [own.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    sample = stage(base.join(F.broadcast(taken[0].union(taken[1])), "id").select("id", "toxic", "text"), "toxicity-sample")
    # a third of the rows is kept for the curve
    fold = F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(3))
    pairs = stage(_bigram_counts(sample.filter(fold != 0).select("toxic", "text")), "toxicity-bigrams")
    # a word's own counts: the different words before it
    sides = [F.sum(F.when(F.col(f"n{c}") > 0, 1).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    by_word = pairs.groupBy("w").agg(*sides, F.count("*").alias("before"))
    word_rows = _numpy(by_word)
    total = by_word.agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "before")]).first()
    if not total.n0 or not total.n1:
        return nothing
    context_rows = _numpy(pairs.groupBy("v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))

    order = np.argsort(word_rows["w"].view(U64))
    words = word_rows["w"].view(U64)[order]
    n = [word_rows[f"n{c}"][order].astype(float) for c in (0, 1)]
    before = word_rows["before"][order].astype(float)
    corpus, everything = corpus_counts(base, words)
    # the last entry of each array is for the words outside the sample together
    zero = np.append(corpus, everything - corpus.sum()) + 1.0
    zero /= zero.sum()
    share = [float(total[f"n{c}"]) / (total.n0 + total.n1) for c in (0, 1)]

    held = np.maximum(before - D, 0) / float(total.before)
    toxic = toxic_share(n[0], n[1], np.full(len(words), share[1]), strength, prior_own)
    found = [1 - toxic, toxic]
    alone = [np.append(held * found[c] / share[c], 0.0) + (1 - held.sum()) * zero for c in (0, 1)]
    size = len(words) + 1
    model = Evidence(words, np.log(alone[1] / alone[0]), np.empty(0, np.int64), np.empty(0), nothing.curve, window)
    # contexts are the words of the sample and what stands before the first word
    odds = np.full(size + 1, np.log(share[1] / share[0]))
    odds[model.contexts(context_rows["v"].view(U64))] = np.log((context_rows["n1"] + strength * share[1]) / (context_rows["n0"] + strength * share[0]))
    del word_rows, context_rows, order, before, n, corpus, zero, held, toxic, found, alone

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w, n0, n1 = (batch.column(i).to_numpy() for i in range(4))
            bv, bw = model.contexts(v.view(U64)), model.places(w.view(U64))
            backoff = 1 / (1 + np.exp(-(odds[bv] + model.word_ratio[bw])))
            share = toxic_share(n0.astype(float), n1.astype(float), backoff, strength, prior_own)
            ratio = (np.log(share / (1 - share)) - odds[bv]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(bv * (size + 1) + bw), pa.array(ratio)], names=["key", "ratio"])

    # worked out in the tasks: the driver gets twelve bytes of each
    bigram_rows = _numpy(pairs.select("v", "w", "n0", "n1").mapInArrow(bigrams, "key long, ratio float"))
    order = np.argsort(bigram_rows["key"])
    model.bigrams, model.bigram_ratio = bigram_rows["key"][order], bigram_rows["ratio"][order]
    del bigram_rows, order
    release()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["toxic", "mean", "top"])

    rest = _numpy(sample.filter(fold == 0).select("toxic", "text").mapInArrow(features, "toxic int, mean double, top double"))
    y = rest["toxic"].astype(float)
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        # a few extreme texts shall not set the curve
        design = _design(np.clip(np.column_stack([rest["mean"], rest["top"]]), [-0.3, -0.6], [0.6, 1.2]))
        # more evidence never lowers a score: a part with a negative weight is left out
        fits = [(use, logistic(design[:, use], y, weight)) for use in ([0, 1, 2], [0, 1], [0, 2], [0])]
        fits = [(use, beta) for use, beta in fits if (beta[1:] >= 0).all()]
        use, beta = max(fits, key=lambda x: _likelihood(design[:, x[0]], y, weight, x[1]))
        model.curve = np.zeros(3)
        model.curve[use] = beta
    return model


def corpus_counts(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each of ``words`` (sorted hashes), and any word, occurs in all ``docs`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words) + 1, np.int64)
        look = Evidence(words, np.zeros(1), np.empty(0, np.int64), np.empty(0), np.zeros(3), 1)
        for batch in batches:
            for _, _, hashes, _ in _slices(batch.column(0)):
                total += np.bincount(look.places(hashes), minlength=len(words) + 1)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["place", "n"])

    got = _numpy(docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")))
    out = np.zeros(len(words) + 1)
    out[got["place"]] = got["n"]
    return out[:-1], int(out.sum())


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, **how) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 if the score reaches ``threshold``).

    Labels, language, source and id are no inputs of a score: equal texts score equally. Null and empty texts get the
    score of a text without evidence. Repeated rows and null ids stay; columns of these three names are replaced.
    """
    model = fit(docs, labels, id_col, text_col, label_col, **how)
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    plain = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(model.scores(batch.column(n)))], names=[*names, "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema[:-1])
    scored = plain.mapInArrow(run, ddl + ", score double")
    return scored.select(*[F.col(f"`{c}`") for c in names], held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
