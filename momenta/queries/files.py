"""Queries that write files from the tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from momenta.functions import text as T
from momenta.operators import ngrams as N
from momenta.operators import tab
from momenta.queries.registry import query
from momenta.queries.sql import EV, TOK, chains, table, tokens
from momenta.queries.tables import lines
from momenta.sources import text_files as S
from momenta.sources.scratch import folder, saved


@query(
    "src_tagged_text",
    """WITH l AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS seq_id, role, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n\\t\\r]+'), lambda x: x <> '' AND NOT contains(x, '_')) AS ws FROM conversations)
    SELECT seq_id, (i - 1)::INTEGER AS pos, word, role AS tag FROM (SELECT seq_id, role, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM l)""",
)
def src_tagged_text(spark, d):
    words = F.filter(T.tokenize(F.col("text")), lambda w: ~w.contains("_"))
    rows = table(spark, d, "conversations").withColumn("line", F.array_join(F.transform(words, lambda w: F.concat(w, F.lit("_"), F.col("role"))), " "))
    return S.read_tagged(spark, S.write_lines(rows, "line", "conv_id", "turn"))


def _index_lines(rows, value):
    packed = N.pack(rows, value, "x").withColumn("line", F.concat_ws(" ", F.transform("x", lambda v: v.cast("string"))))
    return S.write_lines(packed, "line", "seq_id")


@query("src_index_sequences", f"WITH {EV} SELECT dense_rank() OVER (ORDER BY seq_id) - 1 AS seq_id, pos::INTEGER AS pos, tok::INTEGER AS tok FROM ev")
def src_index_sequences(spark, d):
    return S.read_index_sequences(spark, _index_lines(chains(spark, d), "tok"))


@query("src_parsed_corpus", f"WITH {EV} SELECT dense_rank() OVER (ORDER BY seq_id) - 1 AS seq_id, pos::INTEGER AS pos, tok::INTEGER AS tok, tag FROM ev")
def src_parsed_corpus(spark, d):
    rows = chains(spark, d)
    return S.read_parsed(spark, _index_lines(rows, "tok"), _index_lines(rows, "tag"))


@query("src_dictionary", f"WITH {TOK} SELECT row_number() OVER (ORDER BY word) - 1 AS tok, word FROM (SELECT DISTINCT word FROM tok)")
def src_dictionary(spark, d):
    return S.read_dictionary(spark, S.write_lines(tokens(spark, d).select("word").distinct(), F.concat(F.lit(" "), "word"), "word"))


@query(
    "src_plain_text",
    f"""WITH {TOK}, f AS (SELECT word, min((seq_id, pos)) AS f FROM tok GROUP BY word), v AS (SELECT word, row_number() OVER (ORDER BY f) - 1 AS tok FROM f)
    SELECT tok, word, n FROM v JOIN (SELECT word, count(*) AS n FROM tok GROUP BY word) USING (word)""",
)
def src_plain_text(spark, d):
    docs = table(spark, d, "documents").withColumn("line", F.array_join(T.tokenize(F.col("text")), " "))
    rows, vocabulary = S.read_plain(spark, S.write_lines(docs, "line", "doc_id"))
    return rows.groupBy("tok").agg(F.count("*").alias("n")).join(vocabulary, "tok").select("tok", "word", "n")


@query("src_tab", "SELECT user_id::VARCHAR AS \"user\", event_type AS type, round(value * 100)::BIGINT::VARCHAR AS cents, CASE WHEN event_id % 3 = 0 THEN 'a=b' END AS note FROM events")
def src_tab(spark, d):
    rows = lines(spark, d)
    noted = rows.unionAll(rows.where("event_id % 10 = 0").withColumn("line", F.concat(F.lit("# "), "line")))
    m = S.read_tab(spark, S.write_lines(noted, "line", "event_id", "line"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return m.select(at("exp.user").alias("user"), at("exp.type").alias("type"), at("cents").alias("cents"), at("note").alias("note"))


@query("snk_tab", "SELECT 'cents=' || round(value * 100)::BIGINT || chr(9) || 'exp.type=' || event_type || chr(9) || 'exp.user=' || user_id || CASE WHEN event_id % 3 = 0 THEN chr(9) || 'note=a=b' ELSE '' END AS value FROM events")
def snk_tab(spark, d):
    rows = lines(spark, d).select("event_id", tab.unparse(tab.parse(F.col("line"))).alias("line"))
    return spark.read.text(S.write_lines(rows, "line", "event_id"))


def _runs(spark, d):
    """A run folder for each user: its options and its results, as lines of key, tab, value."""
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("n"), F.min("event_type").alias("kind"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    level = (F.col("run") % 3).cast("string")
    rows = [("options", "exp.level", level), ("options", "model\tname", F.col("kind")), ("output", "events", F.col("n").cast("string")), ("output", "clicks", F.when(F.col("clicks") > 12, F.col("clicks").cast("string")))]
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.concat(F.lit(key.split("\t")[0] + "\t"), v).alias("value")) for k, key, v in rows))
    return S.write_runs(users.select("run", F.explode(pairs).alias("p")).select("run", "p.kind", "p.value"))


RUNS = """r AS (SELECT user_id AS run, count(*) AS n, min(event_type) AS kind, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1)"""


@query(
    "src_run_dirs",
    f"WITH {RUNS} SELECT run::VARCHAR AS run, key, value FROM (SELECT run, unnest(['exp.level', 'model', 'events', 'clicks']) AS key, unnest([(run % 3)::VARCHAR, kind, n::VARCHAR, CASE WHEN clicks > 12 THEN clicks::VARCHAR END]) AS value FROM r WHERE run % 3 = 1) WHERE value IS NOT NULL",
)
def src_run_dirs(spark, d):
    return S.read_runs(spark, _runs(spark, d), {"level": "1"})


@query("snk_header_table", f"WITH {RUNS} SELECT run::VARCHAR AS run, kind AS model, n::VARCHAR AS events, CASE WHEN clicks > 12 THEN clicks::VARCHAR ELSE '' END AS clicks FROM r")
def snk_header_table(spark, d):
    wide = S.header_table(S.read_runs(spark, _runs(spark, d), {}), ["model", "events", "clicks"])
    path = folder(spark, "header")
    wide.write.csv(path, sep="\t", header=True, emptyValue="")
    return spark.read.csv(path, sep="\t", header=True, schema=wide.schema, emptyValue="").fillna("")


@query(
    "snk_indexed_corpus",
    f"WITH {EV} SELECT string_agg(tok::VARCHAR, ' ' ORDER BY pos) AS words, string_agg(tag::VARCHAR, ' ' ORDER BY pos) AS tags FROM ev GROUP BY seq_id",
)
def snk_indexed_corpus(spark, d):
    rows = chains(spark, d)
    words, tags = (S.numbered_lines(spark, _index_lines(rows, c)).withColumnRenamed("value", n) for c, n in (("tok", "words"), ("tag", "tags")))
    return words.join(tags, "line_no").select("words", "tags")


@query("snk_corpus_parquet", f"WITH {EV} SELECT seq_id, pos::INTEGER AS pos, tok::INTEGER AS tok, tag FROM ev")
def snk_corpus_parquet(spark, d):
    return saved(chains(spark, d), "corpus")


MATRIX = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, list_sum(list_transform(embedding, lambda x: round(x::DOUBLE * 1000)))::BIGINT AS total, len(embedding) AS d FROM embeddings"


@query("src_numeric_matrix", MATRIX)
def src_numeric_matrix(spark, d):
    line = F.concat_ws(" ", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")))
    m = S.read_matrix(spark, S.write_lines(table(spark, d, "embeddings"), line, "vec_id"))
    return m.select("i", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).cast("long").alias("total"), F.size("x").cast("long").alias("d"))


@query("snk_numeric_matrix", "SELECT array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1000)::BIGINT::VARCHAR), ' ') AS value FROM embeddings")
def snk_numeric_matrix(spark, d):
    line = F.concat_ws(" ", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")))
    return spark.read.text(S.write_lines(table(spark, d, "embeddings"), line, "vec_id"))


PARAMS = "SELECT 'unary' AS kind, event_type AS name, count(*)::DOUBLE AS w FROM events GROUP BY 2 UNION ALL SELECT 'level', (user_id % 5)::VARCHAR, count(*)::DOUBLE FROM events GROUP BY 2"


def _params(spark, d):
    events = table(spark, d, "events")
    count = lambda kind, c: events.groupBy(c.alias("name")).agg(F.count("*").cast("double").alias("w")).select(F.lit(kind).alias("kind"), "name", "w")
    return count("unary", F.col("event_type")), count("level", (F.col("user_id") % 5).cast("string"))


@query("snk_params", PARAMS)
def snk_params(spark, d):
    path = folder(spark, "params")
    for part in _params(spark, d):
        part.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("src_params", f"SELECT kind, count(*) AS n, sum(w) AS w FROM ({PARAMS}) GROUP BY kind")
def src_params(spark, d):
    return snk_params(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


@query("snk_cluster_lists", "SELECT string_agg(c_name, ', ' ORDER BY c_name) AS value FROM customer GROUP BY c_nationkey")
def snk_cluster_lists(spark, d):
    lists = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list("c_name")), ", ").alias("line"))
    return spark.read.text(S.write_lines(lists, "line", "c_nationkey"))
