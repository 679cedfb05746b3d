"""Line dedup by site-relative frequency: lines that stand on a large share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.joins import frequency_join
from lexispark.session import stage


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and a leading ``www.``; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


# HTML elements whose text is not shown, and those that end a line
HIDDEN = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:\s[^>]*)?/?>"
TAG = r"<[^>]*>"


SPACE = " \t\n\r\f\x0b"


def html_lines(html: Column) -> Column:
    """The shown text of a page, one line for each block, blank lines and space around line feeds left out; null stays null."""
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BREAKS, "\n"), TAG, "")
    # marks keep the space before the first and after the last line, which is no space around a line feed
    lines = F.transform(F.split(F.concat(F.lit("|"), shown, F.lit("|")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)))
    text = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return F.regexp_replace(F.substring(text, F.lit(2), F.length(text) - 2), r"^\n|\n\z", "")


def _key(line: Column) -> Column:
    """What makes two lines equal: their text without the white space around it, as 128 bits; null for blank lines."""
    text = F.btrim(line, F.lit(SPACE.replace("\n", "")))
    return F.when(text != "", F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))


def _host(host_col: str) -> Column:
    """The host as a key that joins, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))


def boilerplate(pages: DataFrame, text_col: str, host_col: str, ratio: float = 0.2, min_pages: int = 1, line_pages: int = 1) -> DataFrame:
    """(__host, __key, __n_pages, __n_host): lines on more than ``ratio`` of the pages, and at least ``line_pages``, of a host that has at least ``min_pages``.

    Every page counts a line once; pages with null or empty text count for their host. Counts are summed in each task before
    they are shuffled, so neither a hot host nor a line on every page lands in one task.
    """
    lines = F.array_distinct(F.transform(F.split(F.col(text_col), "\n", -1), _key))
    by_line = pages.select(_host(host_col).alias("__host"), F.explode(lines).alias("__key")).filter("__key is not null").groupBy("__host", "__key").agg(F.count("*").alias("__n_pages"))
    totals = pages.groupBy(_host(host_col).alias("__host")).agg(F.count("*").alias("__n_host")).filter(F.col("__n_host") >= min_pages)
    # a line has to reach the least count any host asks for before it meets the totals
    least = max(line_pages, int(ratio * min_pages) + 1)
    often = by_line.filter(F.col("__n_pages") >= least).join(totals, "__host")
    return often.filter(F.col("__n_pages") > ratio * F.col("__n_host"))


def drop_boilerplate(
    pages: DataFrame, id_col: str = "page_id", text_col: str = "html", host_col: str = "host",
    ratio: float = 0.2, min_pages: int = 1, line_pages: int = 1,
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text_col``, and ``__n_lines`` and ``__n_dropped``.

    A line is what stands between line feeds; lines are equal if they are without the white space around them. Blank lines
    never are boilerplate. Null texts stay null (0 lines); an empty text is one blank line. Rows with the same or no id are
    pages of their own. A null host is a host like any other. All columns stay; an empty table gives no rows.

    A host has at most 1 / ``ratio`` times as many bad lines as its pages have lines on average, so they travel as one row for
    each host, to every task if all of them are small, else by the join that takes hot hosts apart.
    """
    bad = boilerplate(pages, text_col, host_col, ratio, min_pages, line_pages)
    by_host = stage(bad.groupBy("__host").agg(F.collect_list("__key").alias("__bad")), "boilerplate")
    joined = frequency_join(pages.withColumn("__host", _host(host_col)), by_host, "__host", "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda x: F.coalesce(~F.array_contains(F.col("__bad"), _key(x)), F.lit(True)))
    out = joined.withColumn("__kept", F.when(F.col("__bad").isNull(), lines).otherwise(kept))
    return out.select(
        *[F.col(f"`{c}`") if c != text_col else F.array_join("__kept", "\n").alias(c) for c in pages.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("__n_lines"),
        (F.coalesce(F.size(lines), F.lit(0)) - F.coalesce(F.size("__kept"), F.lit(0))).cast("long").alias("__n_dropped"),
    )
