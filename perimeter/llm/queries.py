"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perimeter.llm import alignment, fingerprints, language, lm, mixing, packing, simhash, spelling, vectors, warc
from perimeter.llm.common import remainder, table, word_count
from perimeter.llm.line_dedup import line_dedup
from perimeter.llm.quality import LEAST_DOCUMENTS, REACH, judge
from perimeter.llm.url_filter import Rule, filter_urls, split_url
from perimeter.storage import checkpoint_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if check:
            CHECKS[fn.__name__] = check
        return fn
    return register


_LINE_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS i FROM l),
w AS (SELECT doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS k FROM p),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM l),
kept AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS text FROM lines
         ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)"""


@query(_LINE_SQL)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"))


def _quality_sql() -> str:
    bucket = "((x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0))"
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
           FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM t),
win AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS k FROM p),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM t LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             1000 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(n_words, 1) AS symbols,
             1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats
      FROM f),
long AS (SELECT lang, source, measure, x FROM m UNPIVOT (x FOR measure IN (word_length, symbols, dup_lines, repeats)) WHERE NOT base_failed),
s AS (SELECT grouping(lang, source) AS level, lang, source, measure, {bucket} AS edge, count(*) AS n FROM long
      GROUP BY GROUPING SETS ((lang, source, measure, edge), (lang, measure, edge), (measure, edge))),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY edge) AS upto,
             sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM s),
q AS (SELECT level, lang, source, measure, max(total) AS total, min(edge) FILTER (4 * upto >= total) AS q1,
             min(edge) FILTER (4 * upto >= 3 * total) AS q3 FROM r GROUP BY ALL),
b AS (SELECT *, q3 + {REACH} * greatest(q3 - q1, CASE measure WHEN 'word_length' THEN 300 WHEN 'symbols' THEN 60 ELSE 150 END) AS high,
             CASE WHEN measure = 'word_length' THEN q1 - {REACH} * greatest(q3 - q1, 300) ELSE -1 END AS low FROM q),
j AS (SELECT m.doc_id, x.measure, coalesce(a.low, l.low, g.low) AS low, coalesce(a.high, l.high, g.high) AS high,
             CASE x.measure WHEN 'word_length' THEN word_length WHEN 'symbols' THEN symbols WHEN 'dup_lines' THEN dup_lines ELSE repeats END AS v
      FROM m CROSS JOIN (SELECT unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS measure) x
      LEFT JOIN b a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source
           AND a.measure = x.measure AND a.total >= {LEAST_DOCUMENTS}
      LEFT JOIN b l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM m.lang AND l.measure = x.measure AND l.total >= {LEAST_DOCUMENTS}
      LEFT JOIN b g ON g.level = 3 AND g.measure = x.measure),
k AS (SELECT doc_id, bool_and(coalesce(v BETWEEN low AND high, true)) AS good FROM j GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept
FROM m JOIN k USING (doc_id)"""


@query(_quality_sql())
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))


@query()
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder("doc_id", 3) == 1)
    model = language.fit(docs.filter("NOT held_out"))
    return (docs.select("doc_id", "held_out", language.predictor(docs, model, F.col("text")).alias("p"))
            .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")))


_WARC_SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first, unhex(sha1(html))::BIT::VARCHAR AS bits FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j:
           CASE WHEN substr(bits, 5 * i + j + 1, 1) = '1' THEN 16 >> j ELSE 0 END))::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b"""


@query(_WARC_SQL)
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{checkpoint_root(spark)}/warc/{uuid.uuid4().hex}"
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path, with_payload=False).select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to").alias("refers_to"))


@query()
def op5_simhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


@query()
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return packing.pack(docs, word_count(F.col("text")), packing.text_cluster(F.col("text")))


@query()
def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(rows.filter("vec_id % 20 = 0"), rows)


@query()
def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"), remainder("doc_id", 10) == 0)


@query()
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mixed(table(spark, folder, "documents"), word_count(F.col("text")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


#: The rules of the contract, and words that mark a host of the corpus as listed (fixed values).
RULES = [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
         Rule("net", "/es/", "block"), Rule("net", "/fr/", "block")]
LISTED_WORDS = "casino|adult|poker|porn"

_URL_SQL = f"""
WITH r AS (SELECT unnest([{", ".join(f"{{'host': '{r.host}', 'path': '{r.path}', 'verdict': '{r.verdict}'}}" for r in RULES)}]) AS r),
c AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM c),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
b AS (SELECT DISTINCT host FROM u WHERE regexp_matches(host, '{LISTED_WORDS}')),
m AS (SELECT page_id, arg_max(struct_pack(k := r.host || r.path, v := r.verdict), length(r.host || r.path)) AS best
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY page_id),
n AS (SELECT DISTINCT page_id FROM u JOIN b ON u.host = b.host OR ends_with(u.host, '.' || b.host))
SELECT u.page_id, host, path, best.k AS rule,
       CASE WHEN best IS NOT NULL THEN best.v WHEN n.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN m USING (page_id) LEFT JOIN n USING (page_id)"""


@query(_URL_SQL)
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    host, _ = split_url(F.col("url"))
    blocked = pages.select(host.alias("key")).filter(F.col("key").rlike(LISTED_WORDS))
    return filter_urls(pages, RULES, blocked, keep=["page_id"])


@query()
def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_and_count(table(spark, folder, "documents"))


@query()
def op12_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = fingerprints.with_next(table(spark, folder, "documents"), {"print": fingerprints.fingerprint(F.col("text"))})
    edited = docs.withColumn("edited", fingerprints.half_replaced(F.col("text"), F.col("next.text")))
    both = edited.withColumn("edited_print", fingerprints.fingerprint(F.col("edited")))
    return both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprints.hexed(F.col("print")).alias("fingerprint"), fingerprints.hexed(F.col("edited_print")).alias("edited_fingerprint"),
                       fingerprints.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                       fingerprints.likeness(F.col("print"), F.col("next.print")).alias("near_next"))


_SPELLING_SQL = f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS raw FROM documents),
c AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM r GROUP BY ALL),
k AS (SELECT run, times, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, hex(encode(s)) AS x FROM c),
h AS (SELECT run, times, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, length(x) // 2),
             lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]))) AS h FROM k, tab),
w AS (SELECT CASE WHEN h % {spelling.NOISE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM w WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {spelling.LEAST_COUNT}),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word),
g AS (SELECT word, CAST(count(*) AS BIGINT) AS n_near, max(near_n) AS most FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN most >= {spelling.LEAD} * v.n THEN
             (SELECT min(near) FROM p WHERE p.word = v.word AND near_n = most) END AS form,
             CASE WHEN most >= {spelling.LEAD} * v.n THEN most END AS form_n FROM v LEFT JOIN g USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain USING (word) JOIN f AS top ON top.word = chain.at WHERE top.form IS NULL"""


@query(_SPELLING_SQL)
def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))
