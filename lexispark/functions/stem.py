"""English (Porter2) stemming of token arrays.

The rules follow M. Porter's published description of the English Snowball stemmer. Spark has no
stemmer, so this is the one place where tokens pass through Python: in Arrow batches, with a cache
of the words the task has already seen.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values of the published algorithm ---
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
STOP_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble",
    "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ism", "ate", "iti", "ous", "ive", "ize", "ion",
)
# --- end of fixed values ---

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_VOWEL = re.compile(r"[aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE_END = re.compile(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_PREFIXES = re.compile(r"^(?:gener|commun|arsen)")
_CONSONANT_Y = re.compile(r"(^|[aeiouy])y")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    head = _PREFIXES.match(word) or _REGION.search(word)
    r1 = head.end() if head else len(word)
    tail = _REGION.search(word, r1)
    return r1, tail.end() if tail else len(word)


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")) or not w.endswith("s"):
        return w
    return w[:-1] if _VOWEL.search(w[:-2]) else w


def _past(w: str, r1: int) -> str:
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end is None:
        return w
    base = w[: -len(end)]
    if end in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else w
    if not _VOWEL.search(base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _DOUBLE_END.search(base):
        return base[:-1]
    return base + "e" if r1 >= len(base) and _SHORT_END.search(base) else base


def _derivation(w: str, r1: int, r2: int) -> str:
    end = _longest(w, STEP2)
    if end and len(w) - len(end) >= r1:
        base = w[: -len(end)]
        allowed = {"ogi": base.endswith("l"), "li": base[-1:] in set("cdeghkmnrt")}.get(end, True)
        w = base + STEP2[end] if allowed else w
    end = _longest(w, STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP3[end]
    end = _longest(w, STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    return w


def porter2(word: str) -> str:
    """Stem of one lower-case word."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = _CONSONANT_Y.sub(r"\1Y", word.replace("’", "'").removeprefix("'"))
    r1, r2 = _regions(w)
    w = w[: len(w) - len(_longest(w, ("'", "'s", "'s'")) or "")]
    w = _plural(w)
    if w in STOP_AFTER_PLURAL:
        return w
    w = _past(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    w = _derivation(w, r1, r2)
    if w.endswith("e"):
        short = _SHORT_END.search(w[:-1])
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


class StemCache(dict):
    """Stems of the words a task has seen; started afresh when it gets large."""

    def __missing__(self, word: str) -> str:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = stem = porter2(word)
        return stem


# workers need no copy of this package: the stemmer travels with the UDF
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The words of a batch stay one Arrow column; only its different words become objects."""
    stems = StemCache()
    for tokens in batches:
        words = tokens.flatten().dictionary_encode()
        fresh = pa.array([w if w is None else stems[w] for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), fresh, mask=tokens.is_null())


@F.pandas_udf(T.StringType())
def _stem_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    stems = StemCache()
    for words in batches:
        yield words.map(lambda w: stems[w])


def stem_tokens(tokens) -> Column:
    """Stems of a token array, in place and order."""
    return _stem_arrays(tokens)


def stem_word(word) -> Column:
    """Stem of a single-word column."""
    return _stem_column(word)
