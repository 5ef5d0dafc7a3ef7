"""Registered queries of the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import (decontamination, html_extract, langid, mixing, near_dedup, periodic_runs, quality_rules, sharding, substring_dedup,
               token_files, toxicity, urlfilter, whitening)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return keep


_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_OP1_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), " + _FOLD
              + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
OP1_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_OP1_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
d AS (SELECT doc_id, {_OP1_WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM d, (SELECT DISTINCT m FROM wins) WHERE len(w) >= m)),
occ AS (SELECT doc_id, dw.m, i, item FROM dw JOIN wins USING (win, m)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM occ))
         GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
         FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN held USING (doc_id)
"""


@query("op1_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digest(read_table(spark, sf_dir, "documents"),
                                                read_table(spark, sf_dir, "benchmark"))


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(read_table(spark, sf_dir, "documents"))


_OP3_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), " + _FOLD + r"), '[^\x20\x09-\x0D]+')")
OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_OP3_WORDS} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b USING (s)
         WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
"""


@query("op3_near_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_digest(read_table(spark, sf_dir, "documents"))


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read_table(spark, sf_dir, "documents"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_digest(read_table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
j AS (
  SELECT page_id, host, path,
    (SELECT max(struct_pack(n := length(rhost || rpath), b := r.verdict = 'block', name := rhost || rpath))
     FROM rules r WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)) AS hit
  FROM u)
SELECT page_id, host, path, hit.name AS rule,
  CASE WHEN hit IS NOT NULL THEN CASE WHEN hit.b THEN 'block' ELSE 'allow' END
    WHEN regexp_matches(host || path, '(^|[.\-])(cheap-pills|(online-)?casino|poker|payday-loans?|viagra|porn)([.\-]|/|$)|/wp-login\.php$')
    THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""


@query("op7_url_filter", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read_table(spark, sf_dir, "pages"))


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(read_table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(read_table(spark, sf_dir, "documents"))


@query("op11_html_extraction")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_digest(read_table(spark, sf_dir, "pages"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(read_table(spark, sf_dir, "embeddings"))


# CRC-32 of the id's decimal digits, bit by bit: a byte is taken in, then eight shifts.
_CRC = ("xor(list_reduce(flatten(list_transform(CAST(doc_id AS VARCHAR).split(''), "
        "lambda c: [CAST(ascii(c) AS BIGINT)] || list_transform(range(8), lambda i: -1))), "
        "lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, "
        "4294967295), 4294967295)")
OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS v, CRC AS h FROM documents),
a AS (SELECT *, len(v) AS n, h // 10 AS g, CASE WHEN len(v) > 0 THEN (h // 10) % len(v) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN v[1:a] || list_transform(range(n - a), lambda i: v[a + 1 + i % p]) ELSE v END AS w FROM p),
c AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 16], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(n - 15)) AS i FROM t WHERE n >= 24)),
lag AS (SELECT y.doc_id, y.i, y.i - x.i AS q FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM lag),
diagonal AS (SELECT doc_id, q, min(i) - q AS start, max(i) + 16 - min(i) + q AS length
             FROM island GROUP BY doc_id, q, k HAVING max(i) + 16 - min(i) + q >= greatest(24, 3 * q)),
run AS (SELECT doc_id, start, length, min(q) AS period FROM diagonal GROUP BY doc_id, start, length),
best AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS ls,
           list(struct_pack(start := start, length := length, period := period)
                ORDER BY CAST(length AS DOUBLE) / period DESC, start, period)[1] AS b FROM run GROUP BY doc_id),
gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM run) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS s
         FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM t JOIN gone USING (doc_id)) x
         ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM gone) y USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period,
  1000 * b.length // b.period AS exponent_milli, sha256(coalesce(ls, '')) AS runs_sha256,
  sha256(CASE WHEN n_runs > 0 THEN kept.s ELSE array_to_string(w, ' ') END) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
""".replace("CRC", _CRC)


@query("op13_periodic_runs", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(read_table(spark, sf_dir, "documents"))
