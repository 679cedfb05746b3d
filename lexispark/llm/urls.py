"""URL filters: a list of host and path rules first, association rules over URL tokens for what the list leaves open.

FP-growth mines the token combinations of the pages labelled bad. A combination is kept as a rule if it occurs on enough bad pages
(support) and if enough of all labelled pages that hold it are bad (confidence); a rule that a part of it already covers goes.
Rules are looked up by an inverted index: each stands under its rarest token, so a page meets only rules of its own tokens.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.operators.joins import frequency_join
from lexispark.session import stage

NUMBER, TOKEN_END, RULE_END = "\u0001", "\u0002", "\u0003"
Rule = tuple[str, str]  # (verdict, host and path, like "example.com/en/")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` and for null."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is ``host`` or a parent domain and whose path begins ``path``; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct marked tokens of a URL, sorted: scheme, host words, path words, query fields, fragment; digits count as ``#``."""
    low = F.translate(F.coalesce(url, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    low = F.regexp_replace(low, "[0-9]+", NUMBER)  # not "#" yet, which would begin a fragment

    def marked(mark: str, part: Column, at: str) -> Column:
        words = F.filter(F.split(part, at), lambda x: x != "")
        return F.transform(words, lambda x: F.concat(F.lit(mark), F.translate(x, NUMBER, "#")))

    rest = F.when(F.instr(low, "://") > 0, F.regexp_replace(low, r"(?s)^.*?://", "")).otherwise(low)
    scheme = F.when(F.instr(low, "://") > 0, F.substring_index(low, "://", 1)).otherwise("")
    parts = [
        marked("s:", scheme, r"[^a-z]+"),
        marked("h:", F.regexp_extract(rest, r"^([^/?#]*)", 1), r"[.:@-]+"),
        marked("p:", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), r"[/._-]+"),
        marked("q:", F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), r"[&;]+"),
        marked("f:", F.regexp_extract(rest, r"^[^#]*#([\s\S]*)", 1), r"[/&;._-]+"),
    ]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def matches(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(row, rule) for each row of ``rows`` (row, tokens) that holds all tokens of a rule of the staged ``index``."""
    spread = rows.select("row", "tokens", F.explode("tokens").alias("anchor"))
    met = frequency_join(spread, index, "anchor").select("row", "tokens", F.explode(F.split("rules", RULE_END)).alias("rule"))
    met = met.withColumn("rule", F.split("rule", TOKEN_END))
    return met.where(F.size(F.array_except("rule", "tokens")) == 0).select("row", "rule")


def _index(rules: DataFrame, rarity: DataFrame) -> DataFrame:
    """(anchor, rules): each rule under its rarest token, the rules of a token in one string, whose size is then known."""
    one = rules.select("rule", F.explode("rule").alias("token")).join(rarity.select("token", "n"), "token")
    least = one.groupBy("rule").agg(F.min(F.struct("n", "token")).alias("least")).select(F.col("least.token").alias("anchor"), F.concat_ws(TOKEN_END, "rule").alias("rule"))
    return stage(least.groupBy("anchor").agg(F.concat_ws(RULE_END, F.collect_list("rule")).alias("rules")), "rule-index")


def mine_rules(labelled: DataFrame, support: float = 0.005, least_pages: int = 5, confidence: int = 80, longest: int = 3) -> DataFrame:
    """``rule`` (array of tokens), ``n_bad`` and ``n`` for the association rules of staged ``labelled`` (row, tokens, bad).

    A rule has at most ``longest`` tokens, ``n_bad`` of at least ``support`` of the labelled pages and ``least_pages``, and 100 n_bad
    of at least ``confidence`` n. Tokens that stand on exactly the same labelled pages are interchangeable there; the smallest of them
    stands for all, so host parts that always go together don't multiply the combinations.
    """
    bad = labelled.where("bad")
    totals = labelled.agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")).first()
    floor = max(least_pages, math.ceil(support * totals.n))
    none = labelled.select(F.col("tokens").alias("rule"), F.lit(0).cast("long").alias("n_bad"), F.lit(0).cast("long").alias("n")).limit(0)
    if totals.n_bad < floor:
        return none
    pages_of = F.sum(F.xxhash64("row").cast("decimal(38,0)"))
    spread = labelled.select("row", "bad", F.explode("tokens").alias("token"))
    rarity = spread.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), pages_of.alias("pages")).where(F.col("n_bad") >= floor)
    rarity = stage(rarity.groupBy("n", "n_bad", "pages").agg(F.min("token").alias("token")).drop("pages"), "url-tokens")
    if rarity.isEmpty():
        return none
    kept = frequency_join(bad.select("row", F.explode("tokens").alias("token")), rarity.select("token"), "token", "left_semi")
    baskets = stage(kept.groupBy("row").agg(F.collect_set("token").alias("items")), "url-baskets")
    n_baskets = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (floor - 0.5) / n_baskets), minConfidence=1.0).fit(baskets)
    sets = model.freqItemsets.where(F.size("items") <= longest).select(F.array_sort("items").alias("rule"), F.col("freq").alias("n_bad"))
    sets = stage(sets, "url-itemsets")
    counted = matches(labelled, _index(sets, rarity)).groupBy("rule").agg(F.count("*").alias("n"))
    sure = stage(sets.join(counted, "rule").where(F.col("n_bad") * 100 >= F.col("n") * confidence), "url-rules")
    # a rule is spare if a part of it is a rule as well
    masks = range(1, (1 << longest) - 1)
    part_of = lambda m: F.array_compact(F.array(*[F.get("rule", F.lit(i)) for i in range(longest) if m >> i & 1]))
    parts = F.filter(F.array(*[part_of(m) for m in masks]), lambda p: (F.size(p) > 0) & (F.size(p) < F.size("rule")))
    spare = sure.select("rule", F.explode(parts).alias("part")).join(sure.select(F.col("rule").alias("part")), "part", "left_semi").select("rule").distinct()
    return sure.join(spare, "rule", "left_anti")


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", support: float = 0.005, least_pages: int = 5, confidence: int = 80
) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``pattern`` (the tokens of the mined rules that block it) for every row.

    The list decides where one of its rules fits; elsewhere a page is blocked if a mined rule holds, else allowed. ``labels`` has
    ``doc_id``, ``quality`` and ``toxic`` under the ids of the pages: bad are pages of quality 0 and toxic ones; rows without either
    label teach nothing, and of several rows for a page one bad label is enough. Null and broken URLs have an empty host
    and path; repeated rows are judged each; other columns are ignored; an empty table gives no rows.
    """
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    plain = pages.select(F.col(id_col), F.monotonically_increasing_id().alias("row"), host.alias("host"), path.alias("path"), tokens(url).alias("tokens"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    # written once: the row numbers are fixed from here on
    seen = stage(plain.withColumns({"rule": rule, "verdict": verdict}), "urls")
    is_bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("__of")).agg(F.bool_or(is_bad).alias("bad"))
    labelled = stage(seen.join(marks, seen[id_col] == marks["__of"]).select("row", "tokens", "bad"), "labelled-urls")
    mined = mine_rules(labelled, support, least_pages, confidence)
    mined = stage(mined, "mined-urls")
    open_rows = seen.where("rule is null").select("row", "tokens")
    rarity = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    hits = matches(open_rows, _index(mined, rarity)).groupBy("row").agg(F.array_sort(F.collect_set(F.concat_ws(" & ", "rule"))).alias("hits"))
    return seen.join(hits, "row", "left").select(
        id_col, "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("hits").isNotNull(), F.lit("block")).otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), F.concat_ws(" | ", "hits")).alias("pattern"),
    )
