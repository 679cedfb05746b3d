import math

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lexispark.operators import cleaning, embeddings, joins, latent, terms, topics
from lexispark.plans import fixture as fx
from lexispark.plans import protocols
from lexispark.session import stage


@pytest.fixture(scope="module")
def small(spark):
    rows = [("1", "cat dog cat"), ("2", "dog bird"), ("3", ""), ("4", "cat bird bird fish")]
    return cleaning.tokenized(spark.createDataFrame(rows, "review_id STRING, review_text STRING"))


@pytest.fixture(scope="module")
def vectors(spark, sf):
    docs = cleaning.tokenized(fx.typed(spark, sf), fx.STOP)
    train = docs.where("type = 'train'")
    vocab = terms.dtm_vocabulary(train, 2, 5, 0.95)
    rows, words = terms.count_vectors(docs, vocab, 2, keep=["review_id", "type"])
    rows = rows.cache()
    return rows.where("type = 'train'"), rows.where("type = 'test'"), words


def test_tfidf_by_hand(small):
    rows = {(r["review_id"], r["word"]): r for r in terms.tfidf(small, cut=None).collect()}
    assert len(rows) == 7
    r = rows[("1", "cat")]  # the empty review does not count as a document
    assert (r["n"], r["rank"], r["total"]) == (2, 1, 3) and math.isclose(r["tf_idf"], 2 / 3 * math.log(3 / 2))
    assert rows[("4", "cat")]["rank"] == 2 and rows[("4", "fish")]["rank"] == 3  # ties by word
    assert {k for k, r in rows.items() if r["tf_idf"] > 0.15} == {
        (r["review_id"], r["word"]) for r in terms.tfidf(small, cut=0.15).collect()
    }


def test_dtm_bounds(small):
    got = {(r["review_id"], r["term"]): r["n"] for r in terms.dtm(small, 2, 2, 0.5).collect()}
    # 4 documents: more than 4 * 0.5 documents needed, nothing passes; with 0.6 the terms in two documents do
    assert got == {}
    got = {(r["review_id"], r["term"]): r["n"] for r in terms.dtm(small, 2, 2, 0.6).collect()}
    assert got == {("1", "cat"): 2, ("1", "dog"): 1, ("2", "dog"): 1, ("2", "bird"): 1, ("4", "cat"): 1, ("4", "bird"): 2}


def test_pruned_vocabulary_and_weights(small):
    vocab = terms.pruned_vocabulary(small, 2, 2, 0.001, 0.5)
    assert {(r["term"], r["term_count"], r["doc_count"]) for r in vocab.collect()} == {("cat", 3, 2), ("dog", 2, 2), ("bird", 3, 2)}
    weights = terms.vocab_vectorize(small, vocab).groupBy("review_id").agg(F.sum("weight").alias("w")).collect()
    assert {r["review_id"]: round(r["w"], 9) for r in weights} == {"1": 1, "2": 1, "3": 0, "4": 1}  # an empty review has a zero row


def test_counts_match_count_vectorizer(spark, sf):
    docs = fx.docs(spark, sf)
    model = CountVectorizer(inputCol="tokens", outputCol="v", minDF=20.0).fit(docs)
    want = model.transform(docs).select(F.sum(F.aggregate(vector_to_array("v"), F.lit(0.0), lambda a, x: a + x))).first()[0]
    counts = terms.doc_term_count(docs, word="term")
    vocab = stage(terms.document_frequency(counts).where("df >= 20"))
    assert terms.align_vocabulary(counts, vocab).agg(F.sum("n")).first()[0] == int(want)
    assert vocab.count() == len(model.vocabulary)


def test_sparse_vectors_agree(spark, sf):
    docs = fx.docs(spark, sf)
    vocab = terms.dtm_vocabulary(docs, 1, 5, 0.9)
    index = terms.vocabulary_index(vocab)
    joined = {r["review_id"]: r["features"] for r in terms.cast_sparse(terms.dtm_with_dictionary(docs, vocab, 1), index).collect()}
    direct, words = terms.count_vectors(docs, vocab, 1)
    assert [r["term"] for r in index.orderBy("idx").collect()] == words
    for r in direct.collect():
        if r["features"].numNonzeros():
            assert joined[r["review_id"]] == r["features"]
        else:
            assert r["review_id"] not in joined


def test_hashed_weights_sum_to_one(small):
    rows = terms.feature_hashing(small, 8).groupBy("review_id").agg(F.sum("weight").alias("w"), F.max("bucket").alias("b")).collect()
    assert {r["review_id"]: round(r["w"], 9) for r in rows} == {"1": 1, "2": 1, "3": 0, "4": 1}
    assert all(r["b"] is None if r["review_id"] == "3" else r["b"] < 8 for r in rows)


def test_empty_vocabulary_is_refused(small):
    with pytest.raises(ValueError, match="empty"):
        terms.count_vectors(small, terms.term_statistics(terms.doc_term_count(small, word="term")).limit(0))


def matrix(df, column):
    return {r["review_id"]: np.array(r[column].toArray() if hasattr(r[column], "toArray") else r[column]) for r in df.collect()}


def test_lsa_against_dense_svd(vectors):
    train, test, words = vectors
    model = latent.lsa_fit(train, words)
    x = matrix(train, "features")
    ids = sorted(x)
    dense = np.array([x[i] for i in ids])
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(model.singular_values[: len(s)], s, atol=1e-5 * s[0])
    assert model.k == int((np.cumsum(s) / s.sum() <= 0.5).sum()) + 1
    rank_k = (u[:, : model.k] * s[: model.k]) @ vt[: model.k]
    got = matrix(model.transform(train, "reconstructed"), "lsa")
    assert np.allclose(np.array([got[i] for i in ids]), rank_k, atol=1e-6 * s[0])
    left = matrix(model.transform(train, "doc_vectors"), "lsa")
    left = np.array([left[i] for i in ids])
    assert np.allclose(left.T @ left, np.eye(model.k), atol=1e-6)
    # a document is folded in as the product with the basis, whether it was in the fit or not
    y = matrix(test, "features")
    folded = matrix(model.transform(test, "projected"), "lsa")
    assert all(np.allclose(folded[i], y[i] @ model.basis) for i in y)


def test_topics(vectors):
    train, test, words = vectors
    model = topics.lda_fit(train, k=5, iterations=5, batch_share=0.5)
    rows = topics.lda_foldin(model, train, test).collect()
    # documents without a term of the vocabulary have no topics
    filled = sum(topics.with_terms(part).count() for part in (train, test))
    assert len(rows) == filled < train.count() + test.count()
    assert all(len(r["topics"]) == 5 and math.isclose(sum(r["topics"]), 1, rel_tol=1e-6) for r in rows)
    top = topics.topic_top_terms(model, words, 10).collect()
    assert len(top) == 50 and {r["term"] for r in top} <= set(words)
    strongest = {r["review_id"]: r["topic"] for r in topics.top_topic(topics.lda_features(model, test)).collect()}
    assert all(strongest[r["review_id"]] == int(np.argmax(r["topics"])) for r in rows if r["review_id"] in strongest)


def test_vector_average_ignores_unknown_and_stop_words(spark, small):
    vecs = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 3.0]), ("bird", [9.0, 9.0])], "word STRING, vector ARRAY<DOUBLE>")
    got = {r["review_id"]: r["vector"] for r in embeddings.vector_average(small, vecs, 2, ["bird"]).collect()}
    assert np.allclose(got["1"], [2 / 3, 1]) and got["2"] == [0.0, 3.0]
    assert got["3"] == [0.0, 0.0] and got["4"] == [1.0, 0.0]


def test_centroids_take_the_first_cluster(spark, small):
    clusters = spark.createDataFrame([(1, "cat", 7), (2, "cat", 8), (3, "dog", 7)], "word_no LONG, word STRING, cluster INT")
    got = {(r["review_id"], r["cluster"], r["n"]) for r in embeddings.bag_of_centroids(small, clusters).collect()}
    assert got == {("1", 7, 3), ("2", 7, 1), ("3", None, 0), ("4", 7, 1)}


def test_word2vec_and_clusters(spark, sf):
    docs = fx.docs(spark, sf)
    vecs = embeddings.word2vec_fit(docs, dim=8, min_count=40, iterations=1, sample=None).cache()
    counts = docs.select(F.explode("tokens").alias("w")).groupBy("w").count().where("count >= 40").count()
    assert vecs.count() == counts and all(len(r["vector"]) == 8 for r in vecs.collect())
    clusters = embeddings.word_clusters(vecs, max_iter=5).collect()
    assert len(clusters) == counts and len({r["cluster"] for r in clusters}) <= counts // 10


def test_subsampling_is_reproducible(spark, sf):
    docs = fx.docs(spark, sf, ())
    a = embeddings.subsample_tokens(docs, 1e-3)
    b = embeddings.subsample_tokens(docs.repartition(3), 1e-3)
    key = lambda df: {(r["review_id"], tuple(r["tokens"])) for r in df.select("review_id", "tokens").collect()}
    assert key(a) == key(b)
    size = lambda df: df.agg(F.sum(F.size("tokens"))).first()[0]
    assert 0.3 * size(docs) < size(a) < size(docs)


def test_blind_protocol_aligns_columns(spark):
    df = lambda rows: spark.createDataFrame(rows, "review_id STRING, review_text STRING")
    builder = lambda d: terms.doc_term_count(cleaning.tokenized(d), ["review_id", "type"])
    train, test = df([("1", "a b")]), df([("2", "b c")])
    rows = protocols.protocol_blind(train, test, builder, "word").collect()
    assert {(r["review_id"], r["type"], r["word"]) for r in rows} == {("1", "train", "a"), ("1", "train", "b"), ("2", "test", "b")}
    mixed = protocols.protocol_mix(train, test, builder).collect()
    assert {(r["type"], r["word"]) for r in mixed} == {("train", "a"), ("train", "b"), ("test", "b"), ("test", "c")}


def test_frequency_join_shuffles_only_rare_keys(spark, sf, monkeypatch):
    docs = fx.docs(spark, sf, ())
    counts = terms.doc_term_count(docs, word="term")
    # a key longer than any word, in every document
    counts = stage(counts.unionByName(docs.select("review_id", F.repeat(F.lit("x"), 200).alias("term"), F.lit(1).cast("long").alias("n"))))
    stats = stage(terms.term_statistics(counts))
    n = stats.count()
    # the frequent words are what this vocabulary rejects
    pruned = stage(stats.where((F.col("doc_count") < 60) & (F.length("term") > 2)))
    for how in ("inner", "left", "left_semi", "left_anti"):
        whole = joins.frequency_join(counts, pruned, "term", how)
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
        split = joins.frequency_join(counts, pruned, "term", how, heavy=50)
        assert split.exceptAll(whole).count() == 0 and whole.exceptAll(split).count() == 0, how
        monkeypatch.undo()
    keys = joins.heavy_keys(counts, "term", 1000)
    assert 0 < len(keys) <= 1000 < n
    rest = counts.where(~F.xxhash64("term").isin(keys)).groupBy("term").count().agg(F.max("count")).first()[0]
    assert rest <= counts.count() / 1000  # of no key that is shuffled
    reference = {(r["review_id"], r["word"], round(r["tf_idf"], 9)) for r in terms.tfidf(docs).collect()}
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert {(r["review_id"], r["word"], round(r["tf_idf"], 9)) for r in terms.tfidf(docs).collect()} == reference


def test_vectors_of_a_large_vocabulary_are_added_up_before_the_shuffle(spark, sf, monkeypatch):
    """Beyond the broadcast limit the means stay, and no vector meets its words in a join by shuffle but those of the rarest."""
    from lexispark.plans.catalog_features import word_table

    docs, table = fx.docs(spark, sf, ()), word_table(spark, sf)
    whole = {r["review_id"]: r["vector"] for r in embeddings.vector_average(docs, table, fx.DIM, fx.STOP).collect()}
    size, seen, sliced = joins.table_bytes(table.select("word", "vector"), "word"), [], joins.sliced_join

    def spy(*args):
        seen.append(sliced(*args))
        return seen[-1]

    monkeypatch.setattr(embeddings, "sliced_join", spy)
    for slices, shuffled in ((4, 0), (2, 1)):
        monkeypatch.setattr(joins, "BROADCAST_BYTES", size // 3)
        monkeypatch.setattr(joins, "SLICES", slices)
        got = {r["review_id"]: r["vector"] for r in embeddings.vector_average(docs, table, fx.DIM, fx.STOP).collect()}
        assert got.keys() == whole.keys() and all(np.allclose(got[i], whole[i]) for i in whole)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            physical = seen[-1].select("*")._jdf.queryExecution().sparkPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert physical.count("SortMergeJoin") + physical.count("ShuffledHashJoin") == shuffled
