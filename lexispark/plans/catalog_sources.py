"""Queries: every sink and source, as round trips of the test tables through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.functions.text import squeeze_breaks
from lexispark.operators import cleaning, embeddings, runlog, terms
from lexispark.plans import fixture as fx
from lexispark.plans.catalog_features import word_table
from lexispark.plans.fixture import with_sql
from lexispark.plans.registry import query
from lexispark.session import new_folder
from lexispark.sources import readers, writers
from lexispark.streaming import paged

_RAW_SCHEMA = "reviewerID STRING, asin STRING, overall DOUBLE, reviewText STRING"
_RAW_MAPPING = {"reviewerID": "review_id", "overall": "rating", "reviewText": "review_text"}


def _raw_json(spark, sf):
    path = new_folder(spark, "ndjson")
    raw = fx.stars(spark, sf).select(
        F.col("review_id").alias("reviewerID"), F.lit("a1").alias("asin"), F.col("rating").alias("overall"), F.col("review_text").alias("reviewText")
    )
    raw.write.json(path)
    return path


_STARS = with_sql("SELECT review_id, rating, review_text FROM stars", "stars")


@query("read_reviews_ndjson", _STARS)
def _(spark, sf):
    return readers.read_reviews_ndjson(spark, _raw_json(spark, sf), _RAW_SCHEMA, _RAW_MAPPING)


@query("read_reviews_ndjson_paged", _STARS)
def _(spark, sf):
    out = new_folder(spark, "pages")
    pages = paged.review_pages(spark, _raw_json(spark, sf), _RAW_SCHEMA, _RAW_MAPPING, files_per_page=4)
    paged.write_pages(pages, out, new_folder(spark, "pages-checkpoint"))
    return spark.read.schema("review_id STRING, rating DOUBLE, review_text STRING").parquet(out)


_SQUEEZED = r"regexp_replace({0}, '[\t\r\n]+', ' ', 'g')"


@query("read_tsv_noheader", with_sql(f"SELECT CAST(rating AS INTEGER) AS rating, {_SQUEEZED.format('review_text')} AS review_text FROM stars", "stars"))
def _(spark, sf):
    path = new_folder(spark, "tsv")
    rows = fx.stars(spark, sf).select(F.concat_ws("\t", F.col("rating").cast("int"), squeeze_breaks("review_text")))
    rows.write.text(path)
    return readers.read_tsv_noheader(spark, path, "rating INT, review_text STRING")


@query("read_csv_header", _STARS)
def _(spark, sf):
    path = writers.write_csv(fx.stars(spark, sf), new_folder(spark, "csv"))
    return readers.read_csv_header(spark, path, "review_id STRING, rating DOUBLE, review_text STRING")


_CLUSTERS = with_sql("SELECT word_no, word, cluster FROM vectors", "vectors")


@query("write_csv", with_sql("SELECT word_no, cluster FROM vectors", "vectors"))
def _(spark, sf):
    path = writers.write_csv(word_table(spark, sf).select("word_no", "cluster"), new_folder(spark, "clusters"))
    return spark.read.schema("word_no BIGINT, cluster INT").csv(path, header=True)


@query("read_cluster_csv", _CLUSTERS)
def _(spark, sf):
    path = writers.write_csv(word_table(spark, sf).select("word_no", "cluster"), new_folder(spark, "clusters"))
    return readers.read_cluster_csv(spark, path, embeddings.frequent_words(fx.docs(spark, sf)))


@query(
    "cluster_centers",
    with_sql(
        f"""SELECT cluster, CAST(d - 1 AS INTEGER) AS dim, round(avg(embedding[d]::DOUBLE), 6) AS value
        FROM vectors, range(1, {fx.DIM + 1}) r(d) GROUP BY cluster, d""", "vectors",
    ),
)
def _(spark, sf):
    words = word_table(spark, sf)
    centers = embeddings.cluster_centers(words.select("word", "vector"), words.select("word", "cluster"), fx.DIM)
    path = writers.write_csv(centers, new_folder(spark, "centers"))
    stored = spark.read.schema(centers.schema).csv(path, header=True)
    values = F.array(*[F.col(f"c{i}") for i in range(fx.DIM)])
    return fx.round6(stored.select("cluster", F.posexplode(values).alias("dim", "value")), "value")


@query(
    "read_word_vectors_text",
    with_sql(
        """SELECT word, CAST(d AS INTEGER) AS dim, CASE WHEN word_no % 7 = 0 AND d = 3 THEN 0 ELSE round(embedding[d + 1]::DOUBLE, 6) END AS value
        FROM vectors, range(0, 64) r(d)""", "vectors",
    ),
)
def _(spark, sf):
    path = new_folder(spark, "word-vectors")
    words = word_table(spark, sf)
    # every seventh word has a missing number
    numbers = F.transform("vector", lambda x, i: F.when((F.col("word_no") % 7 == 0) & (i == 3), "NA").otherwise(x.cast("string")))
    lines = words.select(F.concat_ws(" ", "word", F.array_join(numbers, " ")).alias("value"))
    # each file gets the header
    lines.withColumnRenamed("value", f"{words.count()} {fx.DIM}").write.csv(path, header=True, sep="\u0001", quote="", escapeQuotes=False)
    vectors = readers.read_word_vectors_text(spark, path, fx.DIM)
    return fx.round6(vectors.select("word", F.posexplode_outer("vector").alias("dim", "value")), "value")


def _stored(spark, sf):
    root = new_folder(spark, "features")
    docs = cleaning.tokenized(fx.typed(spark, sf), fx.STOP)
    return writers.write_feature_set(terms.tfidf(docs, keep=["review_id", "type"]), root, "tfidf", "mix", "documents", 1000)


_STORED_SQL = """stored AS (SELECT review_id, word, round(n / total::DOUBLE * ln((SELECT count(DISTINCT review_id) FROM counts)::DOUBLE / df), 6) AS tf_idf,
    type FROM (SELECT *, sum(n) OVER (PARTITION BY review_id) AS total, count(*) OVER (PARTITION BY word) AS df FROM counts) JOIN typed USING (review_id)
    WHERE n / total::DOUBLE * ln((SELECT count(DISTINCT review_id) FROM counts)::DOUBLE / df) > 0.03)"""


@query(
    "write_feature_set",
    with_sql("SELECT *, 'tfidf' AS technique, 'mix' AS approach, 'documents' AS dataset, CAST(1000 AS INTEGER) AS size FROM stored", "counts", "typed", extra=(_STORED_SQL,)),
)
def _(spark, sf):
    df = spark.read.parquet(_stored(spark, sf))
    return fx.round6(df.select("review_id", "word", "tf_idf", *writers.FEATURE_SET), "tf_idf")


@query("read_table", with_sql("SELECT review_id, word, tf_idf FROM stored WHERE type = 'test'", "counts", "typed", extra=(_STORED_SQL,)))
def _(spark, sf):
    df = readers.read_table(spark, _stored(spark, sf), technique="tfidf", dataset="documents", type="test")
    return fx.round6(df.select("review_id", "word", "tf_idf"), "tf_idf")


@query(
    "write_fasttext",
    with_sql(f"SELECT '__label__' || CAST(CAST(rating AS INTEGER) AS VARCHAR) || ' ' || {_SQUEEZED.format('review_text')} AS line FROM stars", "stars"),
)
def _(spark, sf):
    df = fx.stars(spark, sf).withColumn("rating", F.col("rating").cast("int"))
    path = writers.write_fasttext(df, new_folder(spark, "fasttext"))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "write_corpus_text",
    with_sql(
        """SELECT coalesce(string_agg(word, ' ' ORDER BY pos), '') AS line FROM docs LEFT JOIN kept USING (review_id) GROUP BY review_id""", "docs", "kept",
    ),
)
def _(spark, sf):
    path = writers.write_corpus_text(fx.docs(spark, sf), new_folder(spark, "corpus"))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "nest_computation_time",
    """SELECT user_id, event_type AS stage, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6)::DOUBLE AS duration FROM events GROUP BY ALL""",
)
def _(spark, sf):
    spans = fx.table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end")
    )
    nested = runlog.nest_computation_time(spans, ["user_id"])
    rows = nested.select("user_id", F.explode("computation_time").alias("stage", "times"))
    return fx.round6(rows.select("user_id", "stage", F.col("times.duration").alias("duration")), "duration")
