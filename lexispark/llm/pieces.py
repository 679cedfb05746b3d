"""SentencePiece encoding by a merge-type prefix table.

In a merge-type (BPE) vocabulary the encoding of a text is the only sequence of tokens in which each
adjacent pair is compatible, that is, encodes to just these two tokens when joined. So every prefix of a text has one
last token: of the tokens that end there (found by an Aho-Corasick automaton), the one that is
compatible with the last token of the prefix before it. The table of last tokens is filled from left to right and
read backwards. Pair tests merge the few characters of two tokens by score and are remembered.

Texts are cut before each run of the space mark, which is safe as no token of the vocabulary has that mark after
another character (checked when the file is loaded; otherwise texts stay whole). Distinct parts are encoded once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.shipping import ship

SPACE = "▁"
KNOWN_PARTS = 500_000  # encoded parts kept by a worker
KNOWN_PAIRS = 2_000_000
_PART = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PieceModel:
    """A merge-type SentencePiece file: exact encoding with own prefix tables, decoding by the library."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        usable = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.id_of = {lib.id_to_piece(i): i for i in usable}
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in usable}
        self.byte_id = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.cuts = all(SPACE not in piece.lstrip(SPACE) for piece in self.id_of)
        # characters that no token joins: a text falls apart between them
        self.joined = {(a, b) for piece in self.id_of for a, b in zip(piece, piece[1:])}
        if any(c not in self.id_of for piece in self.id_of for c in piece):
            raise ValueError("a character of the vocabulary is no token of its own")
        self.pieces = {i: piece for piece, i in self.id_of.items()}
        self.pairs: dict[int, bool] = {}
        # only tokens that merging can reach may end a prefix
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}
        self.names: dict[str, str] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, the left one of equals. For the few characters of a pair test."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) > KNOWN_PAIRS:
            self.pairs.clear()
        pair = [self.pieces[left], self.pieces[right]]
        fits = self.pairs[left << 20 | right] = self.merged("".join(pair)) == pair
        return fits

    def encode_part(self, text: str) -> tuple[int, ...]:
        """Ids of a text whose spaces are marks already.

        ``last[i]`` is the last token of the prefix of i characters; it stays None before the text and after a
        character outside the vocabulary, which no token can join.
        """
        n = len(text)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        pairs = self.pairs
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                left = last[end - token[1]]
                if left is not None:
                    fits = pairs.get(left[0] << 20 | token[0])
                    if fits is None:
                        fits = self.compatible(left[0], token[0])
                    if not fits:
                        continue
                last[end] = token
        ids: list[int] = []
        while n:
            token = last[n]
            if token is None:
                ids.extend(self.byte_id[b] for b in reversed(text[n - 1].encode()))
                n -= 1
            else:
                ids.append(token[0])
                n -= token[1]
        ids.reverse()
        return tuple(ids)

    def _learn(self, part: str) -> None:
        """Encode a part that one space mark leads. A last character that no token joins to the one before is a part too."""
        text = SPACE + part
        stem, end = part[:-1], part[-1:]
        if stem and end in (",", ".") and (stem[-1], end) not in self.joined:
            if stem not in self.known:
                self._learn(stem)
            ids = self.known[stem] + self.encode_part(end)
        else:
            ids = self.encode_part(text)
        self.known[part] = ids
        self.names[part] = ",".join(map(str, ids))

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """(ids, their decimal text joined by commas) of each text."""
        if len(self.known) > KNOWN_PARTS:
            self.known.clear()
            self.names.clear()
        known, names = self.known, self.names
        out = []
        for text in texts:
            if not text:
                out.append(([], ""))
            elif self.cuts and "  " not in text and SPACE not in text and text[0] != " ":
                parts = text.split(" ")
                for part in parts:
                    if part not in known:
                        self._learn(part)
                out.append((list(chain.from_iterable(map(known.__getitem__, parts))), ",".join(map(names.__getitem__, parts))))
            else:
                whole = SPACE + text.replace(" ", SPACE)
                ids = [i for part in (_PART.findall(whole) if self.cuts else [whole]) for i in self.encode_part(part)]
                out.append((ids, ",".join(map(str, ids))))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """Rows ``(id, n_tokens, ids, decoded, ids_sha256, decoded_sha256)``, one for each input row.

    Ids are those of the library without begin and end marks; ``decoded`` is its text of these ids. Null
    texts count as empty. ``full=False`` leaves ``ids`` and ``decoded`` out of the rows. Repeated rows and null
    ids stay; other columns are ignored. An empty table gives no rows.
    """
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            n, digests, texts, ids_out, decoded_out = [], [], [], [], []
            for value in batch.column(1):
                ids, names = model.encode([value.as_py() or ""])[0]
                decoded = model.decode(ids)
                n.append(len(ids))
                digests.append(hashlib.sha256(names.encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                if full:
                    ids_out.append(ids)
                    decoded_out.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(decoded_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ship(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of their token ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def text_of(ids):
        model = piece_model(path)
        return ids.map(lambda x: model.decode([int(i) for i in x]) if x is not None else "")

    ship(rows.sparkSession)
    return rows.withColumn(into, text_of(F.col(ids_col)))
