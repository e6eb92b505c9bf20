"""The opN queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momenta.llm import conversations, decontaminate, html_text, line_dedup, mixing, pii, quality, simhash, spelling, token_counts, token_files, toxicity, warc
from momenta.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).drop("spans")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).drop("file", "place")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents")).drop("distance")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
each AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM lines),
full_ AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j FROM each WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
runs AS (SELECT doc_id, j, i AS s, lead(i, 2) OVER w AS e, x AS x1, lead(x, 1) OVER w AS x2, lead(x, 2) OVER w AS x3 FROM full_ WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
marks AS (SELECT doc_id, j, s, e FROM (SELECT *, row_number() OVER (PARTITION BY x1, x2, x3 ORDER BY doc_id, j) AS r FROM runs WHERE e IS NOT NULL) WHERE r > 1),
fresh AS (SELECT *, CASE WHEN j > lag(j) OVER (PARTITION BY doc_id ORDER BY j) + 3 THEN 1 ELSE 0 END AS new FROM marks),
spans AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY j) AS g FROM fresh) GROUP BY doc_id, g),
gone AS (SELECT doc_id, unnest(range(s, e + 1)) AS i FROM spans),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS text, count(*) FILTER (regexp_matches(x, '[^\x20\x09-\x0D]')) AS n
         FROM each LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_lines FROM full_ GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text, coalesce(c.n_lines, 0) AS n_lines,
       CASE WHEN s.doc_id IS NULL THEN 0 ELSE coalesce(c.n_lines, 0) - coalesce(k.n, 0) END AS n_removed
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM spans) s USING (doc_id) LEFT JOIN kept k USING (doc_id) LEFT JOIN counted c USING (doc_id)"""

OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""

OP4_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
    FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sources),
running AS (
    SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest_weight,
           3 * coalesce(sum(source_size) OVER w, 0) AS capped
    FROM weighted WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
    SELECT *, max(CASE WHEN (total - capped) / rest_weight * weight <= 3 * source_size THEN (total - capped) / rest_weight END) OVER () AS level
    FROM running),
targets AS (SELECT source, source_size, least(coalesce(level * weight, 3 * source_size), 3 * source_size)::DOUBLE AS target FROM leveled),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM targets),
grouped AS (SELECT source, h, sum(size)::BIGINT AS size FROM sized GROUP BY source, h),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM grouped),
passing AS (
    SELECT p.source, p.target - p.whole * p.source_size AS budget, min(CASE WHEN s.upto > p.target - p.whole * p.source_size THEN s.h END) AS open
    FROM plan p JOIN summed s ON p.source IS NOT DISTINCT FROM s.source GROUP BY ALL),
cuts AS (
    SELECT p.source, CASE WHEN p.open IS NULL THEN 1152921504606846976 WHEN s.upto - p.budget < p.budget - (s.upto - s.size) THEN p.open + 1 ELSE p.open END AS cut
    FROM passing p LEFT JOIN summed s ON p.source IS NOT DISTINCT FROM s.source AND p.open = s.h),
copied AS (
    SELECT d.doc_id, d.size, p.source_size, p.target,
           (CASE WHEN p.source_size = 0 THEN 0 ELSE p.whole + CASE WHEN p.whole < 3 AND d.h < c.cut THEN 1 ELSE 0 END END)::BIGINT AS copies
    FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM copied"""

OP8_SQL = r"""
WITH doc AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
    SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
needed AS (SELECT item_id, w, least(len(w), 13) AS n FROM item WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM needed)),
lengths AS (SELECT DISTINCT n FROM grams),
spots AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)),
found AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM spots s JOIN grams g ON s.n = g.n AND s.g = g.g),
hits AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN hits h USING (doc_id) LEFT JOIN items i USING (doc_id)"""

#: crc32 of a string by bits: each byte is followed by seven zeros, and every element moves the register by one bit.
CRC_SQL = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, 2 * strlen({0}), 2),
    lambda i: [('0x' || substr(hex({0}), i, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"""

OP11_SQL = rf"""
WITH runs AS (
    SELECT doc_id, run, count(*) AS times FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT *, {CRC_SQL.format("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs),
words AS (
    SELECT word, sum(times)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING n >= 2),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT c.word, w.word AS near FROM cut c JOIN words w ON c.rest = w.word UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
    UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
best AS (SELECT p.word, count(*) AS n_near, max(w.n) AS best_n, min(p.near) FILTER (w.n = m.n) AS best
         FROM near p JOIN words w ON p.near = w.word JOIN (SELECT word, max(n) AS n FROM near q JOIN (SELECT word AS near, n FROM words) USING (near) GROUP BY word) m ON p.word = m.word GROUP BY p.word),
forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
    FROM words w LEFT JOIN best b USING (word)),
chains AS (
    WITH RECURSIVE steps AS (SELECT word, form AS at FROM forms WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.at = f.word WHERE f.form IS NOT NULL)
    SELECT s.word, s.at AS root FROM steps s JOIN forms f ON s.at = f.word WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN chains USING (word)"""

OP13_SQL = rf"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {CRC_SQL.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM raw WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM damaged),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM placed),
rows_ AS (
    SELECT conv_id, turn, i, role, text, substr(role, 1, 1) AS ini,
           CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN seen THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][ 	-]*\z') THEN 'truncated' ELSE '' END AS fault FROM again),
neighbours AS (SELECT conv_id, ini, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows_),
facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated
    FROM rows_ GROUP BY conv_id),
wrong AS (SELECT conv_id, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM neighbours GROUP BY conv_id),
next_ AS (SELECT * FROM (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')) v(p, q)),
put AS (SELECT * FROM (VALUES ('', '', ''), ('', 'u', 'I'), ('', 'a', 'II'), ('s', 's', ''), ('s', 'u', 'I'), ('s', 'a', 'II'), ('u', 'u', ''), ('u', 'a', 'I'), ('a', 'a', ''), ('a', 'u', 'I')) v(p, q, w)),
act AS (SELECT p, p AS q, 'D' AS w FROM (SELECT DISTINCT p FROM put) UNION ALL SELECT p, q, 'K' FROM next_ UNION ALL SELECT p, q, 'R' FROM next_ WHERE q <> 's'),
step AS (
    SELECT conv_id, 0::BIGINT AS i, '' AS last, {{'c': 0::BIGINT, 'a': ''}} AS best FROM facts
    UNION ALL
    SELECT s.conv_id, s.i + 1, act.q, min({{'c': s.best.c + 3 * length(put.w) + CASE act.w WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN act.w <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END, 'a': s.best.a || put.w || act.w}})
    FROM step s JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i JOIN put ON put.p = s.last JOIN act ON act.p = put.q
    WHERE act.w = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (act.w = 'R' OR act.q = r.ini)) GROUP BY s.conv_id, s.i, act.q),
ends AS (
    SELECT s.conv_id, min({{'c': s.best.c + 3 * length(put.w), 'a': s.best.a || put.w}}) AS best
    FROM step s JOIN facts f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.i JOIN put ON put.p = s.last WHERE put.q IN ('', 'a') GROUP BY s.conv_id),
letters AS (SELECT conv_id, unnest(string_split(best.a, '')) AS w, generate_subscripts(string_split(best.a, ''), 1) AS j FROM ends WHERE best.a <> ''),
aligned AS (SELECT *, sum(CASE WHEN w = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) - 1 AS i, sum(CASE WHEN w = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) - 1 AS place FROM letters),
kept AS (
    SELECT a.conv_id, a.j, a.w, a.place, r.role, CASE WHEN a.w = 'I' THEN '' ELSE r.text END AS text, max(CASE WHEN a.place = 0 AND a.w = 'K' AND r.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.conv_id) AS led
    FROM aligned a LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.i = a.i WHERE a.w <> 'D'),
digests AS (SELECT conv_id, sha256(string_agg(CASE WHEN w = 'K' THEN role WHEN (place - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS h FROM kept GROUP BY conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(w.illegal, 0) AS illegal,
       coalesce(e.best.c, 0) AS cost, coalesce(e.best.a, '') AS audit, coalesce(h.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN wrong w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN digests h ON h.conv_id IS NOT DISTINCT FROM c.conv_id"""

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_warc, op3_pii, op4_mixing, op5_token_counts, op6_html_text, op7_token_files, op8_decontamination, op9_quality_rules, op10_simhash, op11_spelling, op12_toxicity, op13_conversations)}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op2_warc": OP2_SQL, "op4_mixing": OP4_SQL, "op8_decontamination": OP8_SQL, "op11_spelling": OP11_SQL, "op13_conversations": OP13_SQL}
