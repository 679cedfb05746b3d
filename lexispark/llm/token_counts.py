"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at ASCII white space, which no token of the vocabulary spans and no normalisation
step (composition, lower case, collapsing of white space) looks across, so pieces encode
independently. Pieces of a batch are encoded together, once each, in calls balanced by bytes; a
bounded table keeps the lengths of pieces met before. A text adds up the lengths of its pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shipping import ship

KNOWN_PIECES = 1_000_000  # lengths kept by a worker
CALL_BYTES = 1 << 18  # text given to the tokenizer at once
SLICE_BYTES = 1 << 22  # text cut into pieces at once


class Counter:
    """Lengths of texts under a tokenizer file whose pre-tokenizer drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Lengths of new pieces; letters followed by one full stop or comma are two pieces for the pre-tokenizer."""
        stems = {piece: piece[:-1] for piece in pieces if piece[-1:] in (".", ",") and _letters(piece[:-1])}
        whole = {stems.get(piece, piece) for piece in pieces} | {".", ","}
        for call in balanced([piece for piece in whole if piece not in self.known], CALL_BYTES):
            for piece, code in zip(call, self.tokenizer.encode_batch_fast(call, add_special_tokens=False)):
                self.known[piece] = len(code)
        for piece, stem in stems.items():
            self.known[piece] = self.known[stem] + self.known[piece[-1]]

    def lengths(self, texts: list[str | None]) -> list[int]:
        cut = [_pieces(text) for text in texts]
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        known = self.known
        fresh = {piece for pieces in cut for piece in pieces if piece not in known}
        self._learn(list(fresh))
        return [sum(map(known.__getitem__, pieces)) for pieces in cut]


def _letters(stem: str) -> bool:
    """Whether ``stem`` is letters also after composition and lower case; some letters of other blocks fall into letter and mark."""
    return stem.isalpha() and stem[-1] < "\u0250" and stem.lower().isalpha()


def _pieces(text: str | None) -> list[str]:
    """The parts of a text between ASCII spaces, tabs and line ends; empty parts go."""
    if not text:
        return []
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def balanced(pieces: list[str], limit: int) -> Iterator[list[str]]:
    """Lists of about ``limit`` characters in the given order."""
    call, size = [], 0
    for piece in pieces:
        call.append(piece)
        size += len(piece) + 8
        if size >= limit:
            yield call
            call, size = [], 0
    if call:
        yield call


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One tokenizer for each worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row ``(id, n_bytes, n_tokens, over_limit)`` for each input row.

    Null texts count as empty: 0 bytes, 0 tokens. Special strings inside texts are handled as the library does by
    default. Repeated rows and null ids stay; other columns are ignored, whatever their names. An empty table gives
    no rows. ``path`` is a file every executor can open.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            ids, texts, sizes = batch.column(0), batch.column(1), batch.column(2)
            lengths: list[int] = []
            todo, size = [], 0
            for text in texts:
                value = text.as_py()
                todo.append(value)
                size += len(value or "")
                if size >= SLICE_BYTES:
                    lengths += tool.lengths(todo)
                    todo, size = [], 0
            lengths += tool.lengths(todo)
            tokens = pa.array(lengths, pa.int64())
            over = pa.array([n > limit for n in lengths], pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, sizes, tokens, over], names=["id", "n_bytes", "n_tokens", "over_limit"])

    ship(docs.sparkSession)
    plain = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = plain.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_col)
