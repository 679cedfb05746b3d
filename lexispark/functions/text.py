"""Column functions for text. Everything here is a row-local built-in expression: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word: letters, digits and underscores, with apostrophes only inside it.
WORD = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*"

# The punctuation removed by `strip_punct_lower` (ASCII punctuation without the backslash).
PUNCTUATION = "]?!\"'#$%&(){}+*/:;,._`|~[<=>@^-"

# The pronoun stop list used with the pruned n-gram vocabulary.
PRONOUNS = ("i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def space_after_period(c) -> Column:
    """`.` becomes `. `."""
    return F.replace(_col(c), F.lit("."), F.lit(". "))


def hyphen_to_space(c) -> Column:
    return F.replace(_col(c), F.lit("-"), F.lit(" "))


def tokenize_words(c, lower: bool = True) -> Column:
    """Words of a text as ARRAY<STRING>; NULL text gives an empty array."""
    text = F.lower(_col(c)) if lower else _col(c)
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def normalize_alnum(c) -> Column:
    """Lower case, everything but letters and digits to a space, runs of spaces to one."""
    spaced = F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]", " ")
    return F.regexp_replace(spaced, r"\s+", " ")


def strip_punct_lower(c) -> Column:
    return F.translate(F.lower(_col(c)), PUNCTUATION, "")


def split_trim(c) -> Column:
    """Split on single spaces, trim every piece."""
    return F.transform(F.split(_col(c), " "), lambda w: F.trim(w))


def squeeze_breaks(c) -> Column:
    """Tabs and line breaks to one space, for line-based sinks."""
    return F.regexp_replace(_col(c), r"[\t\r\n]+", " ")


def drop_words(tokens, words: Iterable[str]) -> Column:
    """Tokens that are not in a literal word list (a hash-set test per token, no join)."""
    words = sorted(set(words))
    if not words:
        return _col(tokens)
    return F.filter(_col(tokens), lambda w: ~w.isin(words))


def ngrams(tokens, n_min: int = 1, n_max: int = 2, sep: str = " ") -> Column:
    """All n-grams for n in n_min..n_max, shorter ones first; none where the text is too short."""
    t = _col(tokens)

    def shifted(start: int, n: int) -> Column:
        """The tokens that stand at place `start` of some n-gram."""
        return F.slice(t, F.lit(start + 1), F.greatest(F.size(t) - F.lit(n - 1), F.lit(0)))

    # zipped slices, not a lambda that looks into `t`: Spark may inline the expression behind `t`
    # when it pushes a filter down, and inside a lambda that would run once per token
    def grams(n: int) -> Column:
        joined = shifted(0, n)
        for place in range(1, n):
            joined = F.zip_with(joined, shifted(place, n), lambda a, b: F.concat_ws(sep, a, b))
        return joined

    parts = [t if n == 1 else grams(n) for n in range(n_min, n_max + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def label_from_name(c, prefix: str = "pred_") -> Column:
    """Drop the first occurrence of the prefix from a prediction column's name."""
    return F.regexp_replace(_col(c), f"^(.*?){prefix}", "$1")


def joined_name(*parts, sep: str = "_") -> Column:
    """Feature-set name out of its parts (technique, approach, dataset, type, size)."""
    return F.concat_ws(sep, *[_col(p).cast("string") for p in parts])


def name_part(c, index: int, sep: str = "_") -> Column:
    return F.get(F.split(_col(c), sep), F.lit(index))


def round_prediction(c) -> Column:
    """Hard 0/1 label, halves to even."""
    return F.bround(_col(c).cast("double"), 0).cast("int")


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on an expensive computed column.

    A plain filter would be pushed below the projection (and any shuffle under it), so that the column is
    computed twice. A generator that yields one row or none stays where it is.
    """
    return df.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("_kept")).drop("_kept")


def sorted_runs(df: DataFrame, items, keep: Iterable[str]) -> DataFrame:
    """`keep` columns, the array `items` in order (`_sorted`) and where its runs of equal values start (`_starts`).

    A document is one row, so counting its terms needs no shuffle. Use the two columns inside a generator
    (`count_rows`), not as a column of their own that is filtered later: Spark would push such a filter
    below the sort and evaluate it per element.
    """
    s = F.col("_sorted")
    starts = F.when(
        F.size(s) > 0,
        F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))),
    ).otherwise(F.array().cast("array<int>"))
    return df.select(*keep, F.sort_array(_col(items)).alias("_sorted")).withColumn("_starts", starts)


def run_length(at: Column, k: Column) -> Column:
    """Length of the k-th run, which starts at `at`."""
    return (F.coalesce(F.get("_starts", k + 1), F.size("_sorted")) - at).cast("long")


def count_rows(df: DataFrame, items, keep: Iterable[str], term: str = "term", outer: bool = False) -> DataFrame:
    """One row per distinct element of the array with its count: `keep, <term>, n`.

    With `outer`, an empty array gives one row with NULLs.
    """
    keep = list(keep)
    runs = F.transform("_starts", lambda at, k: F.struct(F.get("_sorted", at), run_length(at, k)))
    generate = F.inline_outer if outer else F.inline
    return sorted_runs(df, items, keep).select(*keep, generate(runs).alias(term, "n"))
