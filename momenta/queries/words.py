"""Queries on words, vocabularies and n-grams of the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from momenta.functions import text as T
from momenta.operators import ngrams as N
from momenta.queries.registry import query
from momenta.queries.sql import CLASS, ENC, EV, TOK, TOP, TRI, chains, encoded, packed, r6, table, tokens, top, trigram_counts

VOCAB = TOK + ", cnt AS (SELECT word, count(*) AS n FROM tok GROUP BY word)"


@query("fn_tokenize", f"WITH {TOK} SELECT seq_id, pos::INTEGER AS pos, word FROM tok")
def fn_tokenize(spark, d):
    return tokens(spark, d)


@query(
    "fn_split_tag",
    """WITH t AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n\\t\\r]+'), lambda x: x <> '')) || '_' || role AS token FROM conversations)
    SELECT conv_id, turn, string_split(token, '_')[1] AS word, string_split(token, '_')[2] AS tag FROM t WHERE len(string_split(token, '_')) = 2""",
)
def fn_split_tag(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.transform(T.tokenize(F.col("text")), lambda w: F.concat(w, F.lit("_"), F.col("role")))).alias("token"))
    return rows.select("conv_id", "turn", T.split_tag(F.col("token")).alias("p")).where("p IS NOT NULL").select("conv_id", "turn", "p.word", "p.tag")


@query("fn_rare_class", f"WITH {VOCAB} SELECT CASE WHEN n < 5 THEN {CLASS} ELSE word END AS word, sum(n)::BIGINT AS n, count(*) AS words FROM cnt GROUP BY 1")
def fn_rare_class(spark, d):
    counts = N.word_counts(tokens(spark, d))
    return counts.groupBy(T.rare_class(F.col("word"), F.col("n"), 5).alias("word")).agg(F.sum("n").alias("n"), F.count("*").alias("words"))


@query("fn_contains_digit", f"WITH {VOCAB} SELECT word, n FROM cnt WHERE regexp_matches(word, '[0-9]')")
def fn_contains_digit(spark, d):
    return N.word_counts(tokens(spark, d)).where(T.contains_digit(F.col("word")))


@query("fn_contains_hyphen", f"WITH {VOCAB} SELECT word, n FROM cnt WHERE contains(word, '-')")
def fn_contains_hyphen(spark, d):
    return N.word_counts(tokens(spark, d)).where(T.contains_hyphen(F.col("word")))


@query("fn_initial_cap", f"WITH {VOCAB} SELECT word, n FROM cnt WHERE regexp_matches(word, '^[A-Z]')")
def fn_initial_cap(spark, d):
    return N.word_counts(tokens(spark, d)).where(T.initial_cap(F.col("word")))


@query(
    "fn_char_trigrams",
    f"""WITH {VOCAB}, g AS (SELECT word, list_transform(range(1, greatest(length(word) - 1, 1)), lambda i: substr(word, i, 3)) AS g,
        list_transform(range(1, greatest(length(word) - 2, 1)), lambda i: substr(word, i, 3)) AS s FROM cnt)
    SELECT word, array_to_string(g, '|') AS grams, len(s) AS n_short FROM g""",
)
def fn_char_trigrams(spark, d):
    w = F.col("word")
    return N.word_counts(tokens(spark, d)).select("word", F.array_join(T.char_trigrams(w), "|").alias("grams"), F.size(T.char_trigrams(w, drop_last=True)).cast("long").alias("n_short"))


@query(
    "fn_word_features",
    f"""WITH {VOCAB}, f AS (
        SELECT word, 'digit' AS feature FROM cnt WHERE regexp_matches(word, '[0-9]') UNION ALL SELECT word, 'hyphen' FROM cnt WHERE contains(word, '-')
        UNION ALL SELECT word, 'cap' FROM cnt WHERE regexp_matches(word, '^[A-Z]')
        UNION ALL SELECT DISTINCT word, 'tri=' || unnest(list_transform(range(1, greatest(length(word) - 1, 1)), lambda i: substr(word, i, 3))) FROM cnt),
    ids AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS id FROM (SELECT DISTINCT feature FROM f))
    SELECT word, string_agg(id::VARCHAR, ',' ORDER BY id) AS features FROM f JOIN ids USING (feature) GROUP BY word""",
)
def fn_word_features(spark, d):
    rows = N.word_counts(tokens(spark, d)).select("word", F.explode(T.word_features(F.col("word"))).alias("feature"))
    ids = N.sorted_ids(rows, "feature")
    return rows.join(ids, "feature").groupBy("word").agg(F.array_join(F.transform(F.array_sort(F.collect_list("tok")), lambda x: x.cast("string")), ",").alias("features"))


@query("fn_decode_words", f"WITH {ENC} SELECT seq_id, string_agg(coalesce(top.word, '@' || enc.tok), ' ' ORDER BY pos) AS line FROM enc LEFT JOIN top USING (tok) GROUP BY seq_id")
def fn_decode_words(spark, d):
    enc = encoded(spark, d).join(F.broadcast(top(spark, d).select("word", "tok")), "tok", "left").withColumn("word", F.coalesce("word", F.concat(F.lit("@"), F.col("tok"))))
    return N.pack(enc, "word", "ws").select("seq_id", F.array_join("ws", " ").alias("line"))


@query("fn_decode_tags", f"WITH {EV} SELECT seq_id, string_agg(CASE tag WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END, ' ' ORDER BY pos) AS line FROM ev GROUP BY seq_id")
def fn_decode_tags(spark, d):
    names = F.create_map(*map(F.lit, (0, "low", 1, "mid", 2, "high")))
    return N.pack(chains(spark, d).withColumn("name", names[F.col("tag")]), "name", "ws").select("seq_id", F.array_join("ws", " ").alias("line"))


@query("fn_tagged_lines", f"WITH {EV} SELECT seq_id, string_agg(tok || '_' || tag, ' ' ORDER BY pos) AS line FROM ev GROUP BY seq_id")
def fn_tagged_lines(spark, d):
    rows = chains(spark, d).withColumn("token", F.concat_ws("_", F.col("tok").cast("string"), F.col("tag").cast("string")))
    return N.pack(rows, "token", "ws").select("seq_id", F.array_join("ws", " ").alias("line"))


@query(
    "fn_one_hot_views",
    f"WITH {ENC}, w AS (SELECT seq_id, pos, tok AS a, lead(tok, 1) OVER w AS b, lead(tok, 2) OVER w AS c FROM enc WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) "
    "SELECT view::INTEGER AS view, idx::INTEGER AS idx, count(*) AS n FROM (SELECT unnest([1, 2, 3]) AS view, unnest([a, b, c]) AS idx FROM w WHERE c IS NOT NULL) GROUP BY ALL",
)
def fn_one_hot_views(spark, d):
    w = N.packed_windows(packed(spark, d), 3)
    views = w.select(F.posexplode(F.array("w0", "w1", "w2")).alias("view", "idx"))
    return views.groupBy((F.col("view") + 1).alias("view"), "idx").agg(F.count("*").alias("n"))


@query("join_encode", f"WITH {ENC} SELECT seq_id, pos::INTEGER AS pos, top.tok FROM tok JOIN top USING (word)")
def join_encode(spark, d):
    return tokens(spark, d).join(F.broadcast(top(spark, d).select("word", "tok")), "word").select("seq_id", "pos", "tok")


@query("join_decode", f"WITH {ENC} SELECT seq_id, pos::INTEGER AS pos, top.word FROM enc JOIN top USING (tok)")
def join_decode(spark, d):
    return encoded(spark, d).join(F.broadcast(top(spark, d).select("word", "tok")), "tok").select("seq_id", "pos", "word")


@query("join_counts", f"WITH {TOK}, cnt AS (SELECT word, count(*) AS n FROM tok JOIN documents ON doc_id = seq_id WHERE lang = 'en' GROUP BY word) SELECT word, coalesce(cnt.n, 0) AS n_en, count(*) AS n FROM tok LEFT JOIN cnt USING (word) GROUP BY ALL")
def join_counts(spark, d):
    docs = table(spark, d, "documents")
    known = N.word_counts(T.tokens(docs.where("lang = 'en'"), "doc_id", "text")).withColumnRenamed("n", "n_en")
    # counted first, so a frequent word is one row of the join
    return N.word_counts(T.tokens(docs, "doc_id", "text")).join(known, "word", "left").fillna(0, ["n_en"])


@query("join_word_tag", f"WITH {EV} SELECT a.tok::INTEGER AS tok, b.tag, count(*) AS n FROM ev a JOIN ev b USING (seq_id, pos) GROUP BY ALL")
def join_word_tag(spark, d):
    rows = chains(spark, d)
    return rows.select("seq_id", "pos", "tok").join(rows.select("seq_id", "pos", "tag"), ["seq_id", "pos"]).groupBy("tok", "tag").agg(F.count("*").alias("n"))


@query(
    "join_cluster_map",
    f"WITH {ENC}, bi AS (SELECT tok AS a, lead(tok) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM enc), cl AS (SELECT DISTINCT tok, tok % 4 AS c FROM enc) "
    "SELECT x.c AS c1, y.c AS c2, count(*) AS n FROM bi JOIN cl x ON a = x.tok JOIN cl y ON b = y.tok GROUP BY ALL",
)
def join_cluster_map(spark, d):
    bi = N.counts(N.packed_windows(packed(spark, d), 2), "w0", "w1")
    cluster = bi.select(F.explode(F.array("w0", "w1")).alias("tok")).distinct().withColumn("c", F.col("tok") % 4)
    left, right = (cluster.select(F.col("tok").alias(w), F.col("c").alias(c)) for w, c in (("w0", "c1"), ("w1", "c2")))
    return bi.join(left, "w0").join(right, "w1").groupBy("c1", "c2").agg(F.sum("n").alias("n"))


@query("join_known_trigram", f"WITH {TRI} SELECT w0, w1, w2, n FROM tri WHERE (w0, w1) IN (SELECT w0, w1 FROM tri GROUP BY ALL HAVING sum(n) >= 50)")
def join_known_trigram(spark, d):
    tri = trigram_counts(spark, d)
    known = tri.groupBy("w0", "w1").agg(F.sum("n").alias("m")).where("m >= 50")
    return tri.join(known, ["w0", "w1"], "left_semi").select("w0", "w1", "w2", "n")


@query("win_trigram", f"WITH {ENC}, w AS (SELECT seq_id, pos::INTEGER AS pos, tok AS w0, lead(tok, 1) OVER w AS w1, lead(tok, 2) OVER w AS w2 FROM enc WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) SELECT * FROM w WHERE w2 IS NOT NULL")
def win_trigram(spark, d):
    return N.packed_windows(packed(spark, d), 3)


@query("win_offset_pair", f"WITH {ENC}, w AS (SELECT tok AS w0, lead(tok, 1) OVER w AS w1, lead(tok, 2) OVER w AS w2 FROM enc WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) SELECT w0, w1, count(*) AS n FROM w WHERE w2 IS NOT NULL GROUP BY ALL")
def win_offset_pair(spark, d):
    return N.counts(N.packed_windows(packed(spark, d), 3), "w0", "w1")


@query("win_bigram", f"WITH {EV}, w AS (SELECT seq_id, pos::INTEGER AS pos, tok::INTEGER AS w0, lead(tok) OVER (PARTITION BY seq_id ORDER BY pos)::INTEGER AS w1 FROM ev) SELECT * FROM w WHERE w1 IS NOT NULL")
def win_bigram(spark, d):
    return N.windows(chains(spark, d), 2)


@query("win_tag_transition", f"WITH {EV}, w AS (SELECT lag(tag) OVER (PARTITION BY seq_id ORDER BY pos) AS prev, tag AS cur FROM ev) SELECT prev, cur, count(*) AS n FROM w WHERE prev IS NOT NULL GROUP BY ALL")
def win_tag_transition(spark, d):
    return N.transitions(chains(spark, d)).groupBy("prev", "cur").agg(F.count("*").alias("n"))


@query("win_first_token", f"WITH {TOK} SELECT seq_id, word FROM tok WHERE pos = 0")
def win_first_token(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.get(T.tokenize(F.col("text")), 0).alias("word")).where("word IS NOT NULL")


@query("win_sorted_ids", f"WITH {VOCAB} SELECT word, row_number() OVER (ORDER BY word) - 1 AS tok FROM cnt")
def win_sorted_ids(spark, d):
    return N.sorted_ids(tokens(spark, d))


@query("win_first_seen_ids", f"WITH {TOK}, f AS (SELECT word, min((seq_id, pos)) AS f FROM tok GROUP BY word) SELECT word, row_number() OVER (ORDER BY f) + 3 AS tok FROM f UNION ALL SELECT unnest(['@UPPER@', '@DIGIT@', '@LOWER@', '@MISC@']), unnest([0, 1, 2, 3])")
def win_first_seen_ids(spark, d):
    return N.first_seen_ids(tokens(spark, d), [T.UPPER, T.DIGIT, T.LOWER, T.MISC])


@query("win_top_words", f"WITH {TOK}, c AS (SELECT source, word, count(*) AS n FROM tok JOIN documents ON doc_id = seq_id GROUP BY ALL) SELECT source, word, n, r::INTEGER AS r FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS r FROM c) WHERE r <= 20")
def win_top_words(spark, d):
    words = table(spark, d, "documents").select("source", F.explode(T.tokenize(F.col("text"))).alias("word"))
    counts = words.groupBy("source", "word").agg(F.count("*").alias("n"))
    return counts.withColumn("r", N.rank_in(["source"], F.col("n").desc(), F.col("word"))).where("r <= 20")


@query("win_share", "SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS p FROM documents GROUP BY lang, source")
def win_share(spark, d):
    return N.share(table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")), "n", "lang").withColumn("p", r6("p"))


RUN = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _running(name, f):
    @query(name, f"SELECT event_id, round({f}(value) {RUN}, 9) AS v FROM events")
    def run(spark, d):
        from pyspark.sql import Window

        w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
        # a mean of two-decimal values over up to some hundred rows has no edge at nine digits
        return table(spark, d, "events").select("event_id", F.round(getattr(F, f)("value").over(w), 9).alias("v"))


for _name, _f in (("win_running_mean", "avg"), ("win_running_max", "max"), ("win_running_min", "min")):
    _running(_name, _f)


@query("topk_words", f"WITH {VOCAB} SELECT word, n FROM cnt ORDER BY n DESC, word LIMIT 40")
def topk_words(spark, d):
    return top(spark, d).drop("tok")


@query("set_vocab_union", f"WITH {TOK} SELECT DISTINCT word FROM (SELECT word FROM tok UNION SELECT unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\n\\t\\r]+'), lambda x: x <> '')) FROM conversations)")
def set_vocab_union(spark, d):
    talk = table(spark, d, "conversations").select(F.explode(T.tokenize(F.col("text"))).alias("word"))
    return tokens(spark, d).select("word").union(talk).distinct()


@query("set_remainder", f"WITH {VOCAB} SELECT word FROM (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS place FROM cnt) WHERE place > {TOP}")
def set_remainder(spark, d):
    return N.word_counts(tokens(spark, d)).select("word").join(top(spark, d), "word", "left_anti")


@query("agg_distinct_sequences", f"WITH {EV}, w AS (SELECT tok AS a, lead(tok, 1) OVER w AS b, lead(tok, 2) OVER w AS c FROM ev WINDOW w AS (PARTITION BY seq_id ORDER BY pos)) SELECT a || ' ' || b || ' ' || c AS x, count(*) AS n FROM w WHERE c IS NOT NULL GROUP BY ALL")
def agg_distinct_sequences(spark, d):
    w = N.windows(chains(spark, d), 3).select(F.array("w0", "w1", "w2").alias("x"))
    return w.groupBy("x").agg(F.count("*").alias("n")).select(F.concat_ws(" ", F.transform("x", lambda v: v.cast("string"))).alias("x"), "n")


@query("agg_corpus_summary", f"WITH {TOK} SELECT count(DISTINCT seq_id) AS sequences, count(DISTINCT word) AS words, count(*) AS tokens, (SELECT count(DISTINCT lang) FROM documents) AS tags FROM tok")
def agg_corpus_summary(spark, d):
    docs = table(spark, d, "documents")
    counts = N.word_counts(tokens(spark, d)).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"))
    sizes = docs.select(F.size(T.tokenize(F.col("text"))).alias("n"), "lang").agg(F.count_if(F.col("n") > 0).alias("sequences"), F.countDistinct("lang").alias("tags"))
    return sizes.crossJoin(counts).select("sequences", "words", "tokens", "tags")


@query("agg_avg_length", f"WITH {TOK} SELECT round((SELECT count(*) FROM tok) / (SELECT count(*) FROM documents), 6) AS mean")
def agg_avg_length(spark, d):
    return table(spark, d, "documents").agg(r6(F.avg(F.size(T.tokenize(F.col("text"))))).alias("mean"))


@query("agg_length_histogram", f"WITH {TOK}, l AS (SELECT doc_id, count(tok.seq_id) AS len FROM documents LEFT JOIN tok ON doc_id = seq_id GROUP BY doc_id) SELECT len, count(*) AS n FROM l GROUP BY len")
def agg_length_histogram(spark, d):
    return table(spark, d, "documents").groupBy(F.size(T.tokenize(F.col("text"))).cast("long").alias("len")).agg(F.count("*").alias("n"))


@query("agg_unigram", f"WITH {VOCAB} SELECT word, n, round(n / sum(n) OVER (), 9) AS p FROM cnt")
def agg_unigram(spark, d):
    return N.share(N.word_counts(tokens(spark, d)), "n").withColumn("p", F.round("p", 9))


@query("agg_cluster_bigram", f"WITH {ENC}, bi AS (SELECT tok % 6 AS c1, lead(tok) OVER (PARTITION BY seq_id ORDER BY pos) % 6 AS c2 FROM enc) SELECT c1, c2, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM bi WHERE c2 IS NOT NULL GROUP BY ALL")
def agg_cluster_bigram(spark, d):
    bi = N.counts(N.packed_windows(packed(spark, d), 2), "w0", "w1")
    sums = bi.groupBy((F.col("w0") % 6).alias("c1"), (F.col("w1") % 6).alias("c2")).agg(F.sum("n").alias("n"))
    return N.share(sums, "n").withColumn("p", F.round("p", 9))


@query("agg_bag_of_words", f"WITH {TOK} SELECT seq_id, word, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY seq_id), 6) AS p FROM tok GROUP BY seq_id, word")
def agg_bag_of_words(spark, d):
    return N.share(tokens(spark, d).groupBy("seq_id", "word").agg(F.count("*").alias("n")), "n", "seq_id").withColumn("p", r6("p"))


@query("agg_word_pairs", f"WITH {TRI} SELECT w0, w2, sum(n)::BIGINT AS n FROM tri GROUP BY ALL")
def agg_word_pairs(spark, d):
    return N.counts(N.packed_windows(packed(spark, d), 3), "w0", "w2")


@query("agg_word_triples", f"WITH {TRI} SELECT w0 AS x1, w2 AS x2, w1 AS x3, n FROM tri")
def agg_word_triples(spark, d):
    return trigram_counts(spark, d).select(F.col("w0").alias("x1"), F.col("w2").alias("x2"), F.col("w1").alias("x3"), "n")


VIEWS = """, v AS (SELECT {a} AS x1, {b} AS x2, {c} AS x3, n FROM tri),
g AS (SELECT CASE grouping(x1, x2, x3) WHEN 2 THEN '13' WHEN 1 THEN '12' WHEN 4 THEN '32' ELSE '123' END AS view, x1, x2, x3, sum(n)::BIGINT AS n
      FROM v GROUP BY GROUPING SETS ((x1, x3), (x1, x2), (x2, x3), (x1, x2, x3)))
SELECT view, x1, x2, x3, n, round(n / sum(n) OVER (PARTITION BY view), 9) AS p FROM g"""


@query("agg_views_hmm", f"WITH {TRI}" + VIEWS.format(a="w0", b="w2", c="w1"))
def agg_views_hmm(spark, d):
    return N.views(trigram_counts(spark, d)).withColumn("p", F.round("p", 9))


@query(
    "agg_views_mixture",
    f"WITH {ENC}, h AS (SELECT seq_id, tok, pos FROM enc WHERE pos < 3), tri AS (SELECT w0, w1, w2, count(*) AS n FROM (SELECT max(tok) FILTER (pos = 0) AS w0, max(tok) FILTER (pos = 1) AS w1, max(tok) FILTER (pos = 2) AS w2 FROM h GROUP BY seq_id) WHERE w2 IS NOT NULL GROUP BY ALL)"
    + VIEWS.format(a="w0", b="w1", c="w2"),
)
def agg_views_mixture(spark, d):
    x = F.col("x")
    bags = packed(spark, d).where(F.size(x) >= 3).select(*(x[k].alias(f"w{k}") for k in range(3)))
    return N.views(N.counts(bags, "w0", "w1", "w2"), (0, 1, 2)).withColumn("p", F.round("p", 9))


GRID = """grid AS (SELECT seq_id, pos // 4 AS r, pos // 2 % 2 AS c, pos % 2 AS d, tok FROM ev),
rows_ AS (SELECT seq_id, max(r) + 1 AS rows FROM grid GROUP BY seq_id)"""


def _grid(spark, d):
    """Events as grids of two columns with two observations a cell."""
    p = F.col("pos")
    return chains(spark, d).select("seq_id", F.floor(p / 4).cast("int").alias("r"), (F.floor(p / 2) % 2).cast("int").alias("c"), (p % 2).alias("d"), "tok")


@query(
    "join_grid_neighbours",
    f"WITH {EV}, {GRID} SELECT a.tok::INTEGER AS upper, b.tok::INTEGER AS lower, count(*) AS n FROM grid a JOIN rows_ USING (seq_id) JOIN grid b ON a.seq_id = b.seq_id AND b.r = (a.r + 1) % rows AND a.c = b.c AND a.d = b.d GROUP BY ALL",
)
def join_grid_neighbours(spark, d):
    grid = _grid(spark, d)
    rows = grid.groupBy("seq_id").agg((F.max("r") + 1).alias("rows"))
    upper = grid.join(rows, "seq_id").select("seq_id", ((F.col("r") + 1) % F.col("rows")).alias("r"), "c", "d", F.col("tok").alias("upper"))
    return upper.join(grid.withColumnRenamed("tok", "lower"), ["seq_id", "r", "c", "d"]).groupBy("upper", "lower").agg(F.count("*").alias("n"))


@query(
    "agg_views_grid",
    f"WITH {EV}, {GRID}, tri AS (SELECT a.tok AS w0, b.tok AS w1, e.tok AS w2, count(*) AS n FROM grid a JOIN grid b ON a.seq_id = b.seq_id AND a.r = b.r AND a.c = b.c AND a.d = 0 AND b.d = 1 JOIN grid e ON e.seq_id = a.seq_id AND e.r = a.r + 1 AND e.c = a.c AND e.d = 0 GROUP BY ALL)"
    + VIEWS.format(a="w0::INTEGER", b="w1::INTEGER", c="w2::INTEGER"),
)
def agg_views_grid(spark, d):
    grid = _grid(spark, d)
    cell = grid.groupBy("seq_id", "r", "c").agg(F.max(F.when(F.col("d") == 0, F.col("tok"))).alias("w0"), F.max(F.when(F.col("d") == 1, F.col("tok"))).alias("w1"))
    below = cell.select("seq_id", (F.col("r") - 1).alias("r"), "c", F.col("w0").alias("w2"))
    rows = cell.join(below, ["seq_id", "r", "c"]).where("w1 IS NOT NULL AND w2 IS NOT NULL")
    return N.views(N.counts(rows, "w0", "w1", "w2"), (0, 1, 2)).withColumn("p", F.round("p", 9))


@query("agg_trigram_tensor", f"WITH {TRI} SELECT w0 AS i, w1 AS j, w2 AS k, round(n / sum(n) OVER (), 9) AS v FROM tri")
def agg_trigram_tensor(spark, d):
    return N.share(trigram_counts(spark, d), "n", name="v").select(F.col("w0").alias("i"), F.col("w1").alias("j"), F.col("w2").alias("k"), F.round("v", 9).alias("v"))


@query("limit_sequences", f"WITH {TOK} SELECT seq_id, count(*) AS n FROM tok WHERE seq_id < 100 GROUP BY seq_id")
def limit_sequences(spark, d):
    docs = table(spark, d, "documents").where("doc_id < 100")
    return docs.select(F.col("doc_id").alias("seq_id"), F.size(T.tokenize(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query("limit_subsample", "SELECT vec_id, label FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 200")
def limit_subsample(spark, d):
    """The first 200 vectors in a fixed random order."""
    rows = table(spark, d, "embeddings").withColumn("r", F.md5(F.concat(F.lit("7:"), F.col("vec_id").cast("string"))))
    return rows.orderBy("r", "vec_id").limit(200).select("vec_id", "label")
