"""Pieces of SQL that several queries share, and the tables they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momenta.functions import text as T
from momenta.operators import ngrams as N

#: Words of the corpus that keep a number of their own in the encoded corpus; all others share four classes' numbers.
TOP = 40

TOK = """tok AS (
    SELECT seq_id, i - 1 AS pos, w AS word
    FROM (SELECT doc_id AS seq_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
          FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n\\t\\r]+'), lambda x: x <> '') AS ws FROM documents)))"""

CLASS = """CASE WHEN regexp_matches(word, '^\\p{Lu}') THEN '@UPPER@' WHEN regexp_matches(word, '^\\p{Nd}') THEN '@DIGIT@'
                WHEN regexp_matches(word, '^\\p{Ll}') THEN '@LOWER@' ELSE '@MISC@' END"""

ENC = (
    TOK
    + f""",
cnt AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
top AS (SELECT word, n, (row_number() OVER (ORDER BY n DESC, word) - 1)::INTEGER AS tok FROM cnt ORDER BY n DESC, word LIMIT {TOP}),
enc AS (SELECT seq_id, pos, coalesce(top.tok, CASE {CLASS} WHEN '@UPPER@' THEN {TOP} WHEN '@DIGIT@' THEN {TOP + 1} WHEN '@LOWER@' THEN {TOP + 2} ELSE {TOP + 3} END) AS tok
        FROM tok LEFT JOIN top USING (word))"""
)

TRI = (
    ENC
    + """,
tri AS (SELECT w0, w1, w2, count(*) AS n FROM (
    SELECT tok AS w0, lead(tok, 1) OVER w AS w1, lead(tok, 2) OVER w AS w2 FROM enc WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) WHERE w2 IS NOT NULL GROUP BY ALL)"""
)

#: Users' events in order as labelled sequences: the token is the type's number in sorted order, the tag one of three levels of value.
EV = """ev AS (
    SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, t.tok,
           CASE WHEN value < 20 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END AS tag
    FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS tok FROM (SELECT DISTINCT event_type FROM events)) t USING (event_type))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tokens(table(spark, sf_dir, "documents"), "doc_id", "text")


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.top_words(N.word_counts(tokens(spark, sf_dir)), TOP)


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.encode_top(tokens(spark, sf_dir), top(spark, sf_dir), TOP)


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, x): the encoded corpus, built inside each row: the TOP words travel with the job, so nothing is shuffled but their counts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), "text")
    return N.encode_texts(docs, [r.word for r in N.top_words(N.text_word_counts(docs), TOP).orderBy("tok").collect()])


def trigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.counts(N.packed_windows(packed(spark, sf_dir), 3), "w0", "w1", "w2")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, pos, tok, tag) of users' events."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    kinds = N.sorted_ids(events, "event_type")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.withColumn("pos", (F.row_number().over(order) - 1).cast("int")).join(kinds, "event_type")
    tag = F.when(F.col("value") < 20, 0).when(F.col("value") < 60, 1).otherwise(2)
    return rows.select(F.col("user_id").alias("seq_id"), "pos", F.col("tok").cast("int").alias("tok"), tag.alias("tag"))


def r6(c):
    """Sums in another order differ in their last bits; both sides round."""
    return F.round(c, 6)
