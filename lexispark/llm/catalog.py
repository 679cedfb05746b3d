"""The registered queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.llm.token_counts import token_counts

    return token_counts(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"), limit=2048)


@query
def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.llm.packing import pack_documents

    return pack_documents(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), capacity=2048)


@query
def op2_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.llm.pieces import encode_texts

    return encode_texts(table(spark, sf, "documents"), tokenizer("piece_bpe_32k.model"), full=False)


@query
def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf, "documents"), size=3, budget=2)


@query
def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.llm.toxicity import score

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf, "labels"), threshold=0.3).select("doc_id", "held_out", "score", "predicted")


@query
def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The shown lines of the raw pages; a host's pages share navigation, notices and footers."""
    from pyspark.sql import functions as F

    from lexispark.llm.lines import drop_boilerplate, host_of, html_lines
    from lexispark.session import stage

    # written once, as taking the lines out of the markup costs more than all that follows
    pages = stage(table(spark, sf, "pages").select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")), "page-lines")
    cleaned = drop_boilerplate(pages, "page_id", "text", "host", ratio=0.2, line_pages=3)
    return cleaned.select(
        "page_id", "host", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


LLM_ORACLES["op7_line_dedup"] = r"""
WITH pg AS MATERIALIZED (SELECT page_id, row_number() OVER () AS rn,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:\s[^>]*)?/?>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), '\s*\n\s*', chr(10), 'g'), '^\n|\n$', '', 'g') AS text,
    regexp_replace(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), ''), '^www\.', '') AS host
  FROM pages),
line AS MATERIALIZED (SELECT rn, host, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pg),
tidy AS MATERIALIZED (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS txt FROM line),
totals AS (SELECT host, count(*) AS n_host FROM pg GROUP BY host),
often AS (SELECT host, txt, count(DISTINCT rn) AS n_pages FROM tidy WHERE txt <> '' GROUP BY host, txt),
bad AS MATERIALIZED (SELECT o.host, o.txt FROM often o JOIN totals t ON o.host IS NOT DISTINCT FROM t.host
  WHERE o.n_pages >= 3 AND o.n_pages > 0.2 * t.n_host),
marked AS (SELECT t.rn, t.raw, t.pos, b.txt IS NOT NULL AS gone FROM tidy t LEFT JOIN bad b ON t.host IS NOT DISTINCT FROM b.host AND t.txt = b.txt),
kept AS (SELECT rn, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY rn)
SELECT pg.page_id, pg.host, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, sha256(k.text) AS kept_sha256
FROM pg LEFT JOIN kept k USING (rn)
"""



@query
def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf, "documents"), size=13, digest_only=True)


@query
def op6_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.llm.suffixes import remove_repeats

    return remove_repeats(table(spark, sf, "documents"), size=50, digest_only=True)


@query
def op1_kd_top_k(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.llm.kdtree import top_k

    return top_k(table(spark, sf, "embeddings"), k=10, scale=1024, every=100)


LLM_ORACLES["op1_kd_top_k"] = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rn, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.rn <> c.rn AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op5_inverted_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.llm.multiindex import nearest

    return nearest(table(spark, sf, "embeddings"), k=10, every=100)


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query
def op11_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Pages are labelled by the row of ``labels`` with their id."""
    from lexispark.llm.urls import judge_urls

    judged = judge_urls(table(spark, sf, "pages"), table(spark, sf, "labels"), URL_RULES, support=0.005, least_pages=5, confidence=80)
    return judged.select("page_id", "host", "path", "rule", "verdict")


LLM_ORACLES["op11_url_filters"] = r"""
WITH low AS (SELECT *, regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', chr(1), 'g') AS lo,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS rn FROM pages),
part AS (SELECT *, CASE WHEN contains(lo, '://') THEN substr(lo, instr(lo, '://') + 3) ELSE lo END AS lr,
    CASE WHEN contains(lo, '://') THEN substr(lo, 1, instr(lo, '://') - 1) ELSE '' END AS ls,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM low),
raw AS (SELECT rn, unnest(list_concat(
    list_transform(list_filter(regexp_split_to_array(ls, '[^a-z]+'), lambda x: x <> ''), lambda x: 's:' || x),
    list_transform(list_filter(regexp_split_to_array(regexp_extract(lr, '^([^/?#]*)', 1), '[.:@-]+'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(regexp_split_to_array(regexp_extract(lr, '^[^/?#]*([^?#]*)', 1), '[/._-]+'), lambda x: x <> ''), lambda x: 'p:' || x),
    list_transform(list_filter(regexp_split_to_array(regexp_extract(lr, '^[^?#]*\?([^#]*)', 1), '[&;]+'), lambda x: x <> ''), lambda x: 'q:' || x),
    list_transform(list_filter(regexp_split_to_array(regexp_extract(lr, '^[^#]*#((?s:.*))', 1), '[/&;._-]+'), lambda x: x <> ''), lambda x: 'f:' || x))) AS t FROM part),
tok AS MATERIALIZED (SELECT DISTINCT rn, replace(t, chr(1), '#') AS token FROM raw),
lab AS MATERIALIZED (SELECT rn, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM part JOIN labels ON doc_id = page_id
  WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY rn),
least AS (SELECT greatest(5, CAST(ceil(0.005 * count(*)) AS BIGINT)) AS k FROM lab),
tk AS MATERIALIZED (SELECT rn, bad, token FROM tok JOIN lab USING (rn)),
cls AS (SELECT token, list(rn ORDER BY rn) AS on_pages FROM tk GROUP BY token HAVING count(*) FILTER (bad) >= (SELECT k FROM least)),
rep AS (SELECT min(token) AS token FROM cls GROUP BY on_pages),
own AS MATERIALIZED (SELECT * FROM tk JOIN rep USING (token)),
sets AS (SELECT [token] AS s, count(*) AS n, count(*) FILTER (bad) AS nb FROM own GROUP BY ALL
  UNION ALL SELECT [a.token, b.token], count(*), count(*) FILTER (a.bad) FROM own a JOIN own b ON a.rn = b.rn AND a.token < b.token GROUP BY ALL
  UNION ALL SELECT [a.token, b.token, c.token], count(*), count(*) FILTER (a.bad) FROM own a JOIN own b ON a.rn = b.rn AND a.token < b.token
    JOIN own c ON a.rn = c.rn AND b.token < c.token GROUP BY ALL),
sure AS MATERIALIZED (SELECT s, len(s) AS n_s, unnest(s) AS token FROM sets WHERE nb >= (SELECT k FROM least) AND nb * 100 >= n * 80),
hit AS (SELECT DISTINCT rn FROM (SELECT rn, s FROM tok JOIN sure USING (token) GROUP BY rn, s, n_s HAVING count(*) = n_s)),
rules(action, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
fit AS (SELECT rn, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS verdict FROM part JOIN rules
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY rn)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN hit.rn IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM part LEFT JOIN fit USING (rn) LEFT JOIN hit USING (rn)
"""


@query
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf, "documents"), least=7, rarest=2, times=10)


# crc32 bit by bit from its polynomial; near words by the variants with one letter left out
LLM_ORACLES["op12_spelling_variants"] = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([b], list_transform(range(8), lambda k: CAST(0 AS BIGINT))),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents) GROUP BY ALL),
codes AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(x), 2), lambda i: CAST(('0x' || substr(x, CAST(i AS BIGINT), 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM codes, crc),
changed AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
voc AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM voc)),
near AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN voc b ON a.short = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN voc b ON a.short = b.word),
best AS (SELECT word, count(*) AS n_near, min((-n, near)) AS b FROM near GROUP BY word),
form AS MATERIALIZED (SELECT word, voc.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * voc.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * voc.n THEN -b[1] END AS form_n
  FROM voc LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS onward FROM form UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN form f ON c.onward = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM form f JOIN chain c USING (word) WHERE c.onward IS NULL
"""


@query
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    from lexispark.llm.collocations import collocations

    return collocations(table(spark, sf, "documents"), least=100, longest=5, top=2000, share=100)


LLM_ORACLES["op13_collocations"] = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, rn, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]'), 1) AS pn
  FROM (SELECT lang, row_number() OVER () AS rn, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
word AS MATERIALIZED (SELECT lang, rn, pn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT lang, rn, pn, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM piece)),
total AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
run AS (SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4, lead(w, 4) OVER p AS w5 FROM word WINDOW p AS (PARTITION BY rn, pn ORDER BY i)),
phrase AS MATERIALIZED (
  SELECT lang, [w1] AS ws, count(*) AS f FROM run GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2], count(*) FROM run WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM run WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM run WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM run WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
cand AS MATERIALIZED (SELECT lang, ws, f AS a FROM phrase WHERE len(ws) > 1),
cut AS (SELECT lang, ws, a, unnest(range(1, len(ws))) AS k FROM cand),
scored AS (SELECT c.lang, c.ws, a, n, min((CAST(1000 * CAST(a AS HUGEINT) * CAST(n AS HUGEINT) // (CAST(p.f AS HUGEINT) * CAST(q.f AS HUGEINT)) AS BIGINT), k, p.f, q.f)) AS best
  FROM cut c JOIN phrase p ON p.lang = c.lang AND p.ws = c.ws[1:k] JOIN phrase q ON q.lang = c.lang AND q.ws = c.ws[k + 1:] JOIN total t ON t.lang = c.lang GROUP BY ALL),
part AS (SELECT lang, a, ws, unnest(range(2, len(ws))) AS m FROM cand),
inside AS (SELECT lang, ws[i:i + m - 1] AS ws, max(a) AS longer FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM part) GROUP BY ALL),
kept AS (SELECT s.*, array_to_string(s.ws, ' ') AS phrase FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.ws = s.ws WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY best[1] DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, best[3] AS l, best[4] AS r, n, best[1] AS score FROM ranked WHERE rank <= 2000
"""
