"""Word vectors and word clusters as document features."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.functions.text import count_rows, drop_words
from lexispark.operators.centres import fit_centres
from lexispark.operators.cleaning import words_of
from lexispark.operators import joins
from lexispark.operators.joins import frequency_join, sliced_join, table_bytes
from lexispark.operators.ranking import assign_row_id
from lexispark.operators.sampling import sample_n
from lexispark.session import stage


def subsample_tokens(docs: DataFrame, sample: float = 1e-3, seed: int = 42) -> DataFrame:
    """Drops occurrences of frequent words, each kept with probability min(1, (sqrt(f/s) + 1) * s/f).

    `f` is the word's share of all tokens. The draw is a hash of review, position and seed, so a recomputed
    task takes the same decision. Only words above the threshold can be thinned: at most
    1 / sample words, which are looked up as a map.
    """
    counts = words_of(docs, ()).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.sum(F.size("tokens")).alias("t")).first()["t"] or 0
    ratio = F.lit(float(sample) * total) / F.col("n")
    keep = F.sqrt(ratio) + ratio
    thinned = counts.where(keep < 1).select("word", keep.alias("keep")).collect()  # bounded by 1 / sample
    if not thinned:
        return docs
    table = F.create_map(*[F.lit(x) for r in thinned for x in (r["word"], r["keep"])])
    draw = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("review_id"), i), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    return docs.withColumn(
        "tokens", F.filter("tokens", lambda w, i: F.coalesce(F.try_element_at(table, w), F.lit(1.0)) > draw(i))
    )


def word2vec_fit(
    docs: DataFrame,
    dim: int = 300,
    min_count: int = 40,
    window: int = 10,
    sample: float | None = 1e-3,
    seed: int = 42,
    iterations: int = 5,
    partitions: int | None = None,
) -> DataFrame:
    """`word, vector ARRAY<DOUBLE>` trained on `tokens`, by default in as many tasks as the cluster runs at once.

    Vocabulary x dim is held by the driver and every task, which is the trainer's own bound; `min_count` keeps it small.
    """
    partitions = partitions or docs.sparkSession.sparkContext.defaultParallelism
    corpus = docs if sample is None else subsample_tokens(docs, sample, seed)
    model = Word2Vec(
        vectorSize=dim, minCount=min_count, windowSize=window, maxIter=iterations, numPartitions=partitions,
        seed=seed, inputCol="tokens", outputCol="vector",
    ).fit(corpus.select("tokens"))
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def word_vector_join(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """Long-form tokens with their vector; unknown words drop out."""
    return frequency_join(tokens, vectors, "word")


def word_cluster_join(tokens: DataFrame, clusters: DataFrame) -> DataFrame:
    """Long-form tokens with their cluster; a word listed twice counts once, with its first cluster."""
    order = "word_no" if "word_no" in clusters.columns else "cluster"
    first = clusters.groupBy("word").agg(F.min_by("cluster", order).alias("cluster"))
    return frequency_join(tokens, first, "word")


def vector_average(docs: DataFrame, vectors: DataFrame, dim: int, stopwords=()) -> DataFrame:
    """`review_id, vector`: mean vector of a review's known, non-stop tokens, zeros where there is none.

    Repeated tokens count each time; unknown ones do not dilute the mean. A review's tokens are counted in its row
    before the join, and only known ones reach the mean. The sums are plain columns, which are added up in a hash table of one row for
    each review; an aggregate over vectors would sort all tokens with their vectors. With a table beyond the broadcast limit, they are added up
    for each slice of it before they are shuffled.
    """
    words = count_rows(docs, drop_words("tokens", stopwords), ["review_id"], "word")
    table = vectors.select("word", "vector")
    if table_bytes(table, "word") > joins.BROADCAST_BYTES:
        words = stage(words, "document-words")
    hits = sliced_join(words, table, "word")
    sums = [F.sum(F.col("vector")[i] * F.col("n")).alias(f"_s{i}") for i in range(dim)]
    totals = hits.groupBy(F.col("review_id").alias("_id")).agg(F.sum("n").alias("_n"), *sums)
    means = totals.select("_id", F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(dim)]).alias("_mean"))
    rows = docs.select("review_id").join(means, F.col("review_id") == F.col("_id"), "left")
    return rows.select("review_id", F.coalesce("_mean", F.array_repeat(F.lit(0.0), dim)).alias("vector"))


def word_clusters(vectors: DataFrame, k: int | None = None, max_iter: int = 150, seed: int = 42) -> DataFrame:
    """`word, cluster` by k-means on the word vectors, one tenth as many clusters as words by default.

    The rounds start from `k` words drawn by a hash of the word; the centres stay a table (see `centres`), so `k` may grow with the vocabulary.
    """
    points = stage(vectors.select("word", "vector").where("vector IS NOT NULL"), "cluster-points")
    k = k or max(points.count() // 10, 2)
    drawn = sample_n(points.dropDuplicates(["word"]), k, "word", seed)
    start = assign_row_id(drawn, ["word"], "cluster").select((F.col("cluster") - 1).alias("cluster"), F.col("vector").alias("centre"))
    return fit_centres(points, start, max_iter)[0].withColumn("cluster", F.col("cluster").cast("int"))


def cluster_centers(vectors: DataFrame, clusters: DataFrame, dim: int) -> DataFrame:
    """`cluster, c0..`: mean vector per cluster, flattened for a CSV sink."""
    rows = vectors.join(clusters, "word")
    return rows.groupBy("cluster").agg(*[F.avg(F.get("vector", F.lit(i))).alias(f"c{i}") for i in range(dim)])


def bag_of_centroids(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """`review_id, cluster, n`: tokens of a review per word cluster (raw counts).

    A review without a clustered word has one row with a NULL cluster and count 0.
    """
    words = count_rows(docs, "tokens", ["review_id"], "word")
    counts = word_cluster_join(words, clusters).groupBy(F.col("review_id").alias("_id"), "cluster").agg(F.sum("n").alias("n"))
    rows = docs.select("review_id").join(counts, F.col("review_id") == F.col("_id"), "left")
    return rows.select("review_id", "cluster", F.coalesce("n", F.lit(0)).alias("n"))


def frequent_words(docs: DataFrame, min_count: int = 1) -> DataFrame:
    """`word_no, word` by descending count (ties by word), for tables that refer to words by number."""
    counts = words_of(docs, ()).groupBy("word").agg((-F.count(F.lit(1))).alias("_n"))
    return assign_row_id(counts.where(F.col("_n") <= -min_count), ["_n", "word"], "word_no").drop("_n")
