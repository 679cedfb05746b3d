import pytest
from pyspark.sql import functions as F

from lexispark.functions import text as tx
from lexispark.functions.stem import porter2
from lexispark.operators import cleaning, describe, terms

TEXTS = [
    ("a", "Don't stop-here. End.Start it’s 3.14 ÉTÉ été"),
    ("b", "one"),
    ("c", ""),
    ("d", None),
    ("e", "the THE the"),
    ("f", "the cat the dog, the cat"),
]


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(TEXTS, "review_id STRING, review_text STRING")


def by_id(df, col):
    return {r["review_id"]: r[col] for r in df.collect()}


def test_tokens(reviews):
    tokens = by_id(cleaning.tokenized(reviews), "tokens")
    assert tokens["a"] == ["don't", "stop", "here", "end", "start", "it’s", "3", "14", "été", "été"]
    assert tokens["c"] == [] and tokens["d"] == []
    cased = by_id(cleaning.tokenized(reviews, lower=False), "tokens")
    assert cased["e"] == ["the", "THE", "the"]


def test_period_and_hyphen_replacement_do_not_change_tokens(reviews):
    replaced = reviews.withColumn("review_text", tx.hyphen_to_space(tx.space_after_period("review_text")))
    assert by_id(cleaning.tokenized(replaced), "tokens") == by_id(cleaning.tokenized(reviews), "tokens")


def test_positions_keep_gaps(spark, reviews):
    rows = cleaning.token_rows(cleaning.tokenized(reviews))
    stop = spark.createDataFrame([("the",), ("the",)], "word STRING")
    kept = cleaning.remove_stopwords(rows, stop).where("review_id = 'f'").orderBy("pos").collect()
    assert [(r["pos"], r["word"]) for r in kept] == [(2, "cat"), (4, "dog"), (6, "cat")]
    joined = by_id(cleaning.collapse_tokens(cleaning.remove_stopwords(rows, stop)), "review_text")
    assert joined["f"] == "cat dog cat" and "e" not in joined


def test_ngrams_short_and_long(reviews):
    docs = cleaning.tokenized(reviews)
    grams = by_id(docs.select("review_id", tx.ngrams("tokens", 1, 3).alias("g")), "g")
    assert grams["b"] == ["one"] and grams["c"] == []
    assert grams["e"] == ["the", "the", "the", "the the", "the the", "the the the"]
    bigrams = by_id(docs.select("review_id", tx.ngrams("tokens", 2, 2, "_").alias("g")), "g")
    assert bigrams["f"] == ["the_cat", "cat_the", "the_dog", "dog_the", "the_cat"]


def test_counts_per_document(reviews):
    rows = terms.doc_term_count(cleaning.tokenized(reviews)).collect()
    counts = {(r["review_id"], r["word"]): r["n"] for r in rows}
    assert counts[("f", "the")] == 3 and counts[("f", "cat")] == 2 and counts[("a", "été")] == 2
    assert not any(k[0] in "cd" for k in counts)
    outer = tx.count_rows(cleaning.tokenized(reviews), "tokens", ["review_id"], outer=True)
    assert {r["review_id"] for r in outer.where("term is null").collect()} == {"c", "d"}


def test_string_functions(spark):
    df = spark.createDataFrame([("Ab-c_D!  \t9 é",)], "t STRING")
    row = df.select(
        tx.normalize_alnum("t").alias("n"), tx.strip_punct_lower("t").alias("p"), tx.split_trim(F.lit("a  b ")).alias("s"),
        tx.label_from_name(F.lit("pred_glmnet")).alias("m"), tx.label_from_name(F.lit("x_pred_pred_y")).alias("m2"),
    ).first()
    assert row["n"] == "ab c d 9 é" and row["p"] == "abcd  \t9 é"
    assert row["s"] == ["a", "", "b", ""] and row["m"] == "glmnet" and row["m2"] == "x_pred_y"


def test_round_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (0.50001,), (0.49,), (1.0,)], "p DOUBLE")
    assert [r[0] for r in df.select(tx.round_prediction("p")).collect()] == [0, 1, 0, 1]


# published sample of the English stemmer's vocabulary
SAMPLE = """
consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist,
consistency consist, consistent consist, consistently consist, consisting consist, consists consist, consolation consol,
consolations consol, consolatory consolatori, console consol, consoled consol, consoles consol, consolidate consolid,
consolidated consolid, consolidating consolid, consoling consol, consolingly consol, consols consol, consonant conson,
consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu,
conspiracy conspiraci, conspirator conspir, conspirators conspir, conspire conspir, conspired conspir,
conspiring conspir, constable constabl, constables constabl, constance constanc, constancy constanc, constant constant,
knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead,
kneading knead, knee knee, kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell, knelt knelt,
knew knew, knick knick, knif knif, knife knife, knight knight, knightly knight, knights knight, knit knit, knits knit,
knitted knit, knitting knit, knives knive, knob knob, knobs knob, knock knock, knocked knock, knocker knocker,
knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot
"""


def test_stemmer_sample():
    for pair in SAMPLE.replace("\n", " ").split(","):
        word, stem = pair.split()
        assert porter2(word) == stem, word


@pytest.mark.parametrize(
    "word,stem",
    [("skies", "sky"), ("dying", "die"), ("news", "news"), ("generous", "generous"), ("communism", "communism"),
     ("arsenal", "arsenal"), ("inning", "inning"), ("exceed", "exceed"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"),
     ("hopping", "hop"), ("hoping", "hope"), ("luxuriated", "luxuri"), ("say", "say"), ("by", "by"), ("youth", "youth"),
     ("boy's", "boy"), ("boys'", "boy"), ("hop", "hop"), ("bed", "bed"), ("bead", "bead"), ("été", "été"), ("rational", "ration"),
     ("hopefulness", "hope"), ("controll", "control"), ("be", "be"), ("happy", "happi"), ("apologies", "apolog")],
)
def test_stemmer_rules(word, stem):
    assert porter2(word) == stem


def test_clean_reviews_paths_agree(spark, reviews):
    literal = cleaning.clean_reviews(reviews, ["the"], stems=False, keys=["review_id"])
    table = cleaning.clean_reviews(reviews, spark.createDataFrame([("the",)], "word STRING"), stems=False, keys=["review_id"])
    assert by_id(literal, "review_text") == by_id(table, "review_text")
    assert set(by_id(literal, "tokens")) == {"a", "b", "f"}
    stems = spark.createDataFrame([("cat", "kitten")], "word STRING, word_stem STRING")
    assert by_id(cleaning.clean_reviews(reviews, ["the"], stems, ["review_id"]), "review_text")["f"] == "kitten dog kitten"


def test_long_stop_list_is_joined(spark, reviews, monkeypatch):
    monkeypatch.setattr(cleaning, "MAX_LITERAL_WORDS", 1)
    stop = spark.createDataFrame([("the",), ("dog",)], "word STRING")
    assert cleaning.literal_words(stop) is None
    assert by_id(cleaning.clean_reviews(reviews, stop, False, ["review_id"]), "review_text")["f"] == "cat cat"


def test_stop_list_length_changes_no_answer(spark, monkeypatch):
    rows = [("1", "good cat"), ("1", "bad dog"), ("2", None), ("3", "the the"), ("4", "")]
    reviews = spark.createDataFrame(rows, "review_id STRING, review_text STRING")
    stop = spark.createDataFrame([("the",), ("of",)], "word STRING")
    stems = spark.createDataFrame([("cat", "kit")], "word STRING, word_stem STRING")
    texts = lambda **how: sorted((r["review_id"], r["review_text"]) for r in cleaning.clean_reviews(reviews, stop, keys=["review_id"], **how).collect())
    for how in ({"stems": False}, {}, {"stems": stems}):
        short = texts(**how)
        monkeypatch.setattr(cleaning, "MAX_LITERAL_WORDS", 1)
        assert texts(**how) == short and len(short) == 2  # rows with one id stay two reviews
        monkeypatch.undo()


def test_older_cleaning_chain_has_no_null_tokens(spark):
    reviews = spark.createDataFrame([("1", "the"), ("2", None), ("3", "cats")], "review_id STRING, review_text STRING")
    stems = spark.createDataFrame([("cats", "cat")], "word STRING, word_stem STRING")
    got = {r["review_id"]: (r["tokens"], r["review_text"]) for r in cleaning.clean_corpus_tm(reviews, ["the"], stems).collect()}
    assert got == {"1": ([], ""), "2": ([], ""), "3": (["cat"], "cat")}


def test_built_in_stemmer_in_the_pipeline(spark):
    df = spark.createDataFrame([("1", "Knitted the knives consistently")], "review_id STRING, review_text STRING")
    assert by_id(cleaning.clean_reviews(df, ["the"], keys=["review_id"]), "review_text")["1"] == "knit knive consist"
    rows = cleaning.stem_words(cleaning.token_rows(cleaning.tokenized(df)))
    assert {r["word"]: r["word_stem"] for r in rows.collect()}["knitted"] == "knit"


def test_stems_survive_another_tokenizing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("cast(doc_id as string) review_id", "text review_text")
    cleaned = cleaning.clean_reviews(docs, [], keys=["review_id"])
    again = cleaned.withColumn("again", tx.tokenize_words("review_text"))
    assert again.where("again <> tokens").count() == 0


def test_corpus_chain(reviews):
    out = by_id(cleaning.clean_corpus_tm(reviews, ["the"], stems=False), "review_text")
    assert out["a"] == "dont stop here endstart its 314 été été"  # deleted punctuation glues words together
    assert out["d"] == "" and out["e"] == ""


def test_description(reviews):
    docs = cleaning.tokenized(reviews)
    assert describe.word_count(docs).first().asDict() == {"word": "the", "n": 6}
    per_review = by_id(describe.distinct_words_per_review(docs, ["the"]), "n")
    assert per_review == {"a": 9, "b": 1, "f": 2}
    summary = describe.distinct_words_summary(docs, ["the"]).first()
    assert summary["mean_n"] == 4.0 and summary["median_n"] == 2.0
    assert describe.corpus_shape(docs).first().asDict() == {"n_rows": 20, "n_cols": 2}
