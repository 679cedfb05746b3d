"""Lines of raw pages and their hosts against plain Python; small hosts."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from lexispark.llm import lines
from lexispark.llm.catalog import LLM_QUERIES

HTML = [
    None, "", "  plain text ", "<p>one</p><p>two</p>", "  lead <br> mid \t\n\n x <BR/> trail  ", "a<b>c</b>d<!-- <p>no</p>\n -->e", "<script>var t='</p>';\nx</script>kept<style>p{}</style>",
    "<div class=\"x\">A&amp;B</div>\n<nav><ul><li>x</li>\n<li> y\r\n</li></ul></nav>", "|bar|<hr>|", "\n\nonly\n\n", "<p>" * 3000 + "deep", "<articles>no block</articles>", "tail<br>  ", "   <br>head",
]
BLOCKS = "address article aside blockquote body br dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split()


def plain_lines(html):
    if html is None:
        return None
    html = re.sub("(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "", html)
    html = re.sub(r"</?(\w+)(?:\s[^>]*)?/?>", lambda m: "\n" if m[1].lower() in BLOCKS else m[0], html)
    html = re.sub(r"[ \t\n\r\f\x0b]*\n[ \t\n\r\f\x0b]*", "\n", re.sub("<[^>]*>", "", html))
    return re.sub(r"^\n|\n\Z", "", html)


def test_html_lines(spark):
    df = spark.createDataFrame(pa.table({"html": pa.array(HTML, pa.string())})).select("html", lines.html_lines(F.col("html")).alias("text"))
    assert {r.html: r.text for r in df.collect()} == {h: plain_lines(h) for h in HTML}


def test_hosts(spark):
    want = {
        "http://www.Example.com/x": "example.com", "https://user:pw@a.b.org:80?q": "a.b.org", "ftp://x": "x", "no url": None, "": None, None: None,
        "http://": None, "https://m.www.net#top": "m.www.net", "git+ssh://www.www.de": "www.de",
    }
    df = spark.createDataFrame(pa.table({"url": pa.array(list(want), pa.string())}))
    assert {r.url: r.host for r in df.select("url", lines.host_of(F.col("url")).alias("host")).collect()} == want


def test_small_hosts_are_judged_too(spark, tmp_path):
    menu = "<nav><li>Home</li><li>About us</li></nav>"
    urls = ["http://one.com/a"] + [f"http://three.com/{k}" for k in range(3)] + [f"http://many.com/{k}" for k in range(40)]
    rows = [(k, u, f"{menu}<p>page {k}</p>" + ("<p>rare</p>" if k in (10, 11, 12) else "")) for k, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.host, r.n_lines, r.n_dropped) for r in LLM_QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert got[0] == ("one.com", 3, 0)  # what a single page holds is no boilerplate
    assert all(got[k] == ("three.com", 3, 2) for k in (1, 2, 3))
    assert all(got[k] == ("many.com", 4 if k in (10, 11, 12) else 3, 2) for k in range(4, 44))  # "rare" is on 3 of 40
