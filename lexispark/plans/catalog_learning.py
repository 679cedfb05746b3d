"""Queries: fitted features and classifiers. They have no SQL form; tests check their invariants."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lexispark.operators import cleaning, embeddings, gibbs, latent, models, sampling, skipgram, terms
from lexispark.plans import fixture as fx
from lexispark.plans import protocols
from lexispark.plans.catalog_features import word_table
from lexispark.plans.fixture import with_sql
from lexispark.plans.registry import query
from lexispark.session import new_folder, small_table, stage
from lexispark.sources import readers, writers

KEEP = ("review_id", "type")


def _count_vectors(spark, sf, sparse=0.99):
    """Count vectors of all documents on the vocabulary of the training documents."""
    docs = cleaning.tokenized(fx.typed(spark, sf), fx.STOP)
    vocab = terms.dtm_vocabulary(docs.where("type = 'train'"), n_max=2, min_df=10, sparse=sparse)
    vectors, words = terms.count_vectors(docs, vocab, 2, keep=KEEP)
    # read by every iteration, by every core alike
    vectors = stage(vectors.repartition(spark.sparkContext.defaultParallelism), "count-vectors")
    return vectors.where("type = 'train'"), vectors.where("type = 'test'"), words


def _long(df, column):
    return df.select("review_id", F.posexplode_outer(column).alias("dim", "value"))


# --- latent semantic analysis ---
@query("lsa_fit")
def _(spark, sf):
    train, _test, words = _count_vectors(spark, sf)
    model = latent.lsa_fit(train, words)
    return small_table(spark, {"rank": list(range(1, model.k + 1)), "singular_value": model.singular_values[: model.k].tolist()})


@query("lsa_features")
def _(spark, sf):
    train, _test, words = _count_vectors(spark, sf)
    return _long(latent.lsa_fit(train, words).transform(train, "projected"), "lsa")


@query("lsa_foldin")
def _(spark, sf):
    """The unseen documents as pseudo documents of k numbers and as whole rows of the latent space, one entry for each term."""
    train, test, words = _count_vectors(spark, sf)
    return latent.lsa_fit(train, words).fold_in(test)


@query("lsa_doc_vectors")
def _(spark, sf):
    train, _test, words = _count_vectors(spark, sf)
    return _long(latent.lsa_fit(train, words).transform(train, "doc_vectors"), "lsa")


@query(
    "lsa_energy",
    with_sql(
        """SELECT count(DISTINCT term) AS n_terms, round(sum(n * n), 3)::DOUBLE AS energy FROM grams JOIN typed USING (review_id)
        WHERE type = 'train' AND term IN (SELECT term FROM vocab)""", "grams", "typed",
        extra=(
            """vocab AS (SELECT term FROM grams JOIN typed USING (review_id) WHERE type = 'train' AND length(term) >= 3 GROUP BY term
            HAVING count(*) >= 10 AND count(*) > (SELECT count(*) FROM typed WHERE type = 'train') * (1::DOUBLE - 0.99::DOUBLE))""",
        ),
    ),
)
def _(spark, sf):
    # the squared singular values sum up to the squared counts
    train, _test, words = _count_vectors(spark, sf)
    model = latent.lsa_fit(train, words)
    return small_table(spark, {"n_terms": [len(words)], "energy": [round(model.energy, 3)]})


# --- topics ---
def _topic_model(spark, sf):
    """500 sweeps of burn-in and 500 more, 50 between two exchanges of the counts."""
    train, test, words = _count_vectors(spark, sf)
    return gibbs.gibbs_fit(train, len(words), k=20, seed=123, burn_in=500, iterations=500, local_sweeps=50), train, test, words


@query("lda_fit")
def _(spark, sf):
    model, _train, _test, words = _topic_model(spark, sf)
    return gibbs.top_terms(spark, model, words, 20)


@query("topic_top_terms")
def _(spark, sf):
    model, _train, _test, words = _topic_model(spark, sf)
    return gibbs.top_terms(spark, model, words, 10)


@query("lda_features")
def _(spark, sf):
    model, train, _test, _words = _topic_model(spark, sf)
    return _long(model.transform(train), "topics")


@query("lda_foldin")
def _(spark, sf):
    model, train, test, _words = _topic_model(spark, sf)
    return gibbs.foldin(model, train, test).select("review_id", "type", F.posexplode_outer("topics").alias("dim", "value"))


@query("save_fitted_model")
def _(spark, sf):
    model, train, _test, _words = _topic_model(spark, sf)
    path = model.save(spark, new_folder(spark, "topic-model"))
    return _long(gibbs.GibbsModel.load(spark, path).transform(train), "topics")


# --- word vectors ---
@query("word2vec_fit")
def _(spark, sf):
    vectors = skipgram.skipgram_fit(fx.docs(spark, sf))
    return vectors.select("word", F.posexplode_outer("vector").alias("dim", "value"))


@query("word_clusters")
def _(spark, sf):
    return embeddings.word_clusters(word_table(spark, sf).select("word", "vector"))


# --- classifiers ---
def _labelled_vectors(spark, sf, stopwords=fx.STOP):
    """Vector averages of the labelled documents with a stratified split."""
    reviews = fx.reviews(spark, sf)
    means = embeddings.vector_average(cleaning.tokenized(reviews), word_table(spark, sf), fx.DIM, stopwords)
    labels = reviews.select("review_id", F.col("binary_rating").cast("double").alias("label"))
    rows = labels.join(means, "review_id").select("review_id", array_to_vector("vector").alias("features"), "label")
    split = stage(sampling.stratified_split(rows, "label", 0.2).hint("rebalance"), "labelled-vectors")
    return split.where("type = 'train'").drop("type"), split.where("type = 'test'").drop("type")


@query("lasso_logistic_cv")
def _(spark, sf):
    train, test = _labelled_vectors(spark, sf)
    return models.predict_models({"glmnet": models.lasso_logistic_cv(train)}, test)


@query("boosted_trees")
def _(spark, sf):
    train, test = _labelled_vectors(spark, sf)
    return models.predict_models({"xgboost": models.boosted_trees(train)}, test)


@query("logistic_plain")
def _(spark, sf):
    train, test = _labelled_vectors(spark, sf)
    return models.predict_models({"glm": models.logistic_plain(train)}, test)


@query("predict_models")
def _(spark, sf):
    train, test = _labelled_vectors(spark, sf)
    return models.predict_models(models.run_models(train), test)


@query("run_grid")
def _(spark, sf):
    """Two feature sets, with and without stop words, stored and read back by their keys; a short path of penalties and few trees."""
    root, techniques = new_folder(spark, "grid-features"), {"average": fx.STOP, "average_all": ()}
    size = fx.table(spark, sf, "documents").count()
    for technique, stopwords in techniques.items():
        train, test = _labelled_vectors(spark, sf, stopwords)
        rows = train.withColumn("type", F.lit("train")).unionByName(test.withColumn("type", F.lit("test")))
        rows = rows.withColumn("features", vector_to_array("features"))
        for approach in ("mix", "blind"):  # averages of given vectors are not fitted: both approaches have the same rows
            writers.write_feature_set(rows, root, technique, approach, "documents", size)

    def load(technique, dataset, size, approach):
        stored = readers.read_table(spark, root, technique=technique, dataset=dataset, size=size, approach=approach)
        return stored.select("review_id", array_to_vector("features").alias("features"), "label", "type")

    fit = lambda part: {"glmnet": models.lasso_logistic_cv(part, n_lambda=4), "xgboost": models.boosted_trees(part, rounds=8, depth=4)}
    grid = protocols.parameter_grid(["documents"], techniques, [size], spark=spark)
    return protocols.run_grid(grid, load, "blind_and_mix", fit)


# --- what fitted features have to fulfil, next to SQL ---
_DOC_COUNTS = with_sql(
    """SELECT type, count(DISTINCT review_id) AS n_docs, count(DISTINCT review_id) AS n_distributions
    FROM grams JOIN typed USING (review_id) WHERE term IN (SELECT term FROM vocab) GROUP BY type""", "grams", "typed",
    extra=(
        """vocab AS MATERIALIZED (SELECT term FROM grams JOIN typed USING (review_id) WHERE type = 'train' AND length(term) >= 3 GROUP BY term
        HAVING count(*) >= 10 AND count(*) > (SELECT count(*) FROM typed WHERE type = 'train') * (1::DOUBLE - 0.99::DOUBLE))""",
    ),
)


@query("lda_distributions", _DOC_COUNTS)
def _(spark, sf):
    """Documents with a term of the vocabulary, and those whose 20 topic shares add up to 1."""
    model, train, test, _words = _topic_model(spark, sf)
    rows = gibbs.foldin(model, train, test)
    total = F.aggregate("topics", F.lit(0.0), lambda a, x: a + x)
    good = (F.size("topics") == 20) & (F.abs(total - 1) < 1e-6) & F.forall("topics", lambda x: x >= 0)
    return rows.groupBy("type").agg(F.countDistinct("review_id").alias("n_docs"), F.count_if(good).alias("n_distributions"))


@query(
    "word2vec_words",
    with_sql("SELECT word, CAST(300 AS INTEGER) AS dim FROM kept GROUP BY word HAVING count(*) >= 40", "kept"),
)
def _(spark, sf):
    vectors = skipgram.skipgram_fit(fx.docs(spark, sf))
    return vectors.select("word", F.size("vector").alias("dim"))


@query("word_clusters_cover", with_sql("SELECT word, CAST(1 AS BIGINT) AS n FROM vectors", "vectors"))
def _(spark, sf):
    """Each word is in one cluster."""
    clusters = embeddings.word_clusters(word_table(spark, sf).select("word", "vector"))
    return clusters.groupBy("word").agg(F.count("*").alias("n"))


@query("lsa_reconstructed")
def _(spark, sf):
    """Whole rows of rank k for train and folded-in test documents, one entry for each term in the order of the vocabulary."""
    train, test, words = _count_vectors(spark, sf)
    model = latent.lsa_fit(train, words)
    return model.transform(train, "reconstructed").unionByName(model.transform(test, "reconstructed"))
