"""The test tables seen as review tables, on the DataFrame side and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.functions.text import PUNCTUATION, WORD
from lexispark.operators.cleaning import tokenized
from lexispark.operators.sampling import fraction_split
from lexispark.session import small_table, spread_scan

# Small own lexicons out of the words of the test texts.
STOP = (
    "the of and to in a is that it for was on with as be de la der en die que le des und et les un el den von du zu "
    "das une los mit se"
).split()
SCORES = {
    "er": 2, "by": -1, "this": 3, "re": -2, "at": 1, "th": -3, "from": 4, "ha": 2, "he": -4, "st": 1, "ed": -1,
    "ing": 5, "ti": -5, "or": 2, "tion": 3, "ly": 1, "ble": -2, "sh": -3, "wh": 1, "ther": 2, "than": -1, "del": 3,
    "auf": -2, "pour": 1, "est": -4, "qui": 2, "las": -1, "ist": 3, "nicht": -5, "no": -2, "con": 4,
}
EMOTION_WORDS = {
    "er": ["joy", "positive"], "by": ["anger"], "this": ["trust", "positive"], "re": ["fear", "negative"],
    "at": ["anticipation"], "th": ["disgust", "negative"], "from": ["surprise"], "he": ["sadness", "negative"],
    "st": ["trust"], "ing": ["joy", "anticipation", "positive"], "ti": ["anger", "fear", "negative"],
    "or": ["positive"], "tion": ["surprise", "positive"], "nicht": ["negative"], "con": ["joy"], "est": ["sadness"],
    "auf": ["anticipation"], "pour": ["positive"], "no": ["disgust", "negative"],
}
MODELS = ("glmnet", "xgboost")
APPROACHES = ("mix", "blind_seen", "blind_blind", "foldin")
DIM = 64  # length of the vectors in `embeddings`


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    scan = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("review_id"), F.col("text").alias("review_text")
    )
    return spread_scan(scan, "review_id")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents: quality as class, stars 1, 2, 4 or 5 out of quality and toxicity."""
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("review_id"),
        (1 + 3 * F.col("quality") + (1 - F.col("toxic"))).cast("double").alias("rating"),
        F.col("quality").cast("int").alias("binary_rating"),
    )
    return documents(spark, sf).join(labels, "review_id").select("review_id", "rating", "binary_rating", "review_text")


def typed(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with `type` train or test (about 80/20)."""
    return fraction_split(documents(spark, sf), 0.8)


def docs(spark: SparkSession, sf: str, stop=STOP) -> DataFrame:
    return tokenized(documents(spark, sf), stop)


def stars(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with 1..5 stars out of a hash of the id (the labels have no third star)."""
    star = 1 + F.conv(F.substring(F.md5("review_id"), 1, 4), 16, 10).cast("int") % 5
    return documents(spark, sf).select("review_id", star.cast("double").alias("rating"), "review_text")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of two pretended models for the labelled documents: thousandths out of a hash, so some lie on a cut."""
    base = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    bucket = lambda c, n: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int") % n
    approach = F.get(F.array(*[F.lit(a) for a in APPROACHES]), bucket(F.col("review_id"), 4))
    return (
        base.select(
            F.col("doc_id").cast("string").alias("review_id"),
            F.col("lang").alias("dataset"),
            F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"),
            F.col("quality").cast("int").alias("actual"),
        )
        .withColumn("prob", bucket(F.concat_ws("-", "model", "review_id"), 1000) / F.lit(1000.0))
        .withColumn("approach", approach)
        .select("review_id", "model", "prob", "actual", "approach", "dataset")
    )


def stop_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, {"word": STOP})


def score_lexicon(spark: SparkSession) -> DataFrame:
    return small_table(spark, {"word": list(SCORES), "afinn_score": list(SCORES.values())})


def emotion_lexicon(spark: SparkSession) -> DataFrame:
    pairs = [(w, s) for w, ss in EMOTION_WORDS.items() for s in ss]
    return small_table(spark, {"word": [w for w, _ in pairs], "sentiment": [s for _, s in pairs]})


def round6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


# --- the same in SQL ---
def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


_PATTERN = WORD.replace("'", "''")
PUNCTUATION_SQL = PUNCTUATION.replace("'", "''")
_STOP_IN = ", ".join(f"'{w}'" for w in STOP)
_BUCKET = "CAST('0x' || substr(md5({0}), 1, {1}) AS BIGINT)"


def bucket_sql(expr: str, digits: int = 4) -> str:
    return _BUCKET.format(expr, digits)


_CTES = {
    "docs": "docs AS (SELECT CAST(doc_id AS VARCHAR) AS review_id, text AS review_text FROM documents)",
    "reviews": """reviews AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS review_id,
        CAST(1 + 3 * quality + (1 - toxic) AS DOUBLE) AS rating, CAST(quality AS INTEGER) AS binary_rating,
        text AS review_text FROM documents JOIN labels USING (doc_id))""",
    "typed": f"""typed AS (SELECT *, CASE WHEN {bucket_sql("'42-' || review_id", 8)} / 4294967296::DOUBLE < 0.8::DOUBLE
        THEN 'train' ELSE 'test' END AS type FROM docs)""",
    "stars": f"""stars AS (SELECT review_id, CAST(1 + {bucket_sql("review_id")} % 5 AS DOUBLE) AS rating, review_text FROM docs)""",
    # all tokens with their position
    "tok": f"""tok AS (SELECT review_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
        FROM (SELECT review_id, regexp_extract_all(lower(review_text), '{_PATTERN}') AS words FROM docs))""",
    # without stop words, gaps in pos
    "kept": f"kept AS (SELECT * FROM tok WHERE word NOT IN ({_STOP_IN}))",
    "rtok": f"""rtok AS (SELECT review_id, rating, binary_rating, unnest(words) AS word, generate_subscripts(words, 1) AS pos
        FROM (SELECT *, regexp_extract_all(lower(review_text), '{_PATTERN}') AS words FROM reviews))""",
    "rkept": f"rkept AS (SELECT * FROM rtok WHERE word NOT IN ({_STOP_IN}))",
    "pairs": "pairs AS (SELECT review_id, word, pos, lead(word) OVER (PARTITION BY review_id ORDER BY pos) AS word2, "
    "lead(word, 2) OVER (PARTITION BY review_id ORDER BY pos) AS word3 FROM kept)",
    "counts": "counts AS (SELECT review_id, word, count(*) AS n FROM kept GROUP BY ALL)",
    "pred": f"""pred AS (SELECT CAST(doc_id AS VARCHAR) AS review_id, model, lang AS dataset, CAST(quality AS INTEGER) AS actual,
        ({bucket_sql("model || '-' || doc_id")} % 1000) / 1000::DOUBLE AS prob,
        [{", ".join(f"'{a}'" for a in APPROACHES)}][({bucket_sql("CAST(doc_id AS VARCHAR)")} % 4 + 1)::INTEGER] AS approach
        FROM labels JOIN documents USING (doc_id), (VALUES ('glmnet'), ('xgboost')) m(model))""",
    "stop": f"stop(word) AS (VALUES {_values((w,) for w in STOP)})",
    "scores": f"scores(word, afinn_score) AS (VALUES {_values(SCORES.items())})",
    "emotions": f"emotions(word, sentiment) AS (VALUES {_values((w, s) for w, ss in EMOTION_WORDS.items() for s in ss)})",
    "vocab_no": """vocab_no AS (SELECT row_number() OVER (ORDER BY n DESC, word) AS word_no, word
        FROM (SELECT word, count(*) AS n FROM kept GROUP BY word))""",
    "vectors": """vectors AS (SELECT word_no, word, embedding, label AS cluster FROM vocab_no
        JOIN embeddings ON vec_id = word_no - 1)""",
}
for _sep, _name in ((" ", "grams"), ("_", "ugrams")):
    _CTES[_name] = f"""{_name} AS (SELECT review_id, term, count(*) AS n FROM (
        SELECT review_id, word AS term FROM pairs UNION ALL
        SELECT review_id, word || '{_sep}' || word2 FROM pairs WHERE word2 IS NOT NULL) GROUP BY ALL)"""
_NEEDS = {
    "typed": ["docs"], "stars": ["docs"], "tok": ["docs"], "kept": ["tok"], "rtok": ["reviews"], "rkept": ["rtok"],
    "pairs": ["kept"], "counts": ["kept"], "grams": ["pairs"], "ugrams": ["pairs"], "vocab_no": ["kept"],
    "vectors": ["vocab_no"],
}


def with_sql(body: str, *names: str, extra: tuple[str, ...] = ()) -> str:
    """`body` with the named common table expressions (and what they need) in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join([_CTES[n] for n in ordered] + list(extra)) + "\n" + body.strip()
