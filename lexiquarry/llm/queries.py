"""Queries of the training-data operators with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat_format,
    decontaminate,
    fingerprints,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    periodic_runs,
    quality,
    ranked_search,
    secret_scan,
    suffix_dedup,
    url_filter,
)

#: Rules of op1: (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(_table(spark, sf_dir, "documents"), n=4, percent=85).drop("class_id", "class_key")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest_runs(_table(spark, sf_dir, "documents"), exponent=4, least=6, edit=periodic_runs.loop_some)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), documents=3, chars=20)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_url_filters,
        op2_chat_formatting,
        op3_language_id,
        op4_suffix_dedup,
        op5_fingerprints,
        op6_mix_sources,
        op7_quality,
        op8_decontaminate,
        op9_ngram_join,
        op10_secret_scans,
        op11_periodic_runs,
        op12_line_dedup,
        op13_ranked_search,
    )
    return {f.__name__: f for f in listed}


OP1_SQL = r"""
WITH parsed AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path,
  (SELECT max_by(rhost || rpath, length(rhost || rpath)) FROM rules
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT max_by(verdict, length(rhost || rpath)) FROM rules
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM parsed"""

OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY pos) AS l FROM turns GROUP BY conv_id),
prefixes AS (SELECT DISTINCT k, l[1:k] AS p FROM whole, unnest(range(1, n)) AS u(k)),
ends AS (SELECT n, l, min(conv_id) AS conv_id FROM whole GROUP BY n, l),
kept AS (SELECT conv_id FROM ends WHERE NOT EXISTS (SELECT 1 FROM prefixes WHERE k = n AND p = l))
SELECT conv_id, CAST(floor((pos - 1) / 64) AS BIGINT) AS part, count(*) AS n_turns,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY pos) AS chat
FROM turns WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY ALL"""

OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS place
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(place - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap,
    (SELECT sum(source_size) FROM ranked)::DOUBLE * 1.5::DOUBLE AS whole FROM ranked),
levels AS (
  SELECT *, whole - coalesce(sum(cap) OVER before, 0) AS l, sum(weight) OVER after AS heavy FROM weighted
  WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT cap / weight AS ratio, place, l, heavy FROM levels WHERE NOT l * weight >= cap * heavy ORDER BY ratio, place LIMIT 1),
targets AS (
  SELECT t.source, t.source_size,
    CASE WHEN v.place IS NULL OR (t.cap / t.weight < v.ratio OR (t.cap / t.weight = v.ratio AND t.place < v.place)) THEN t.cap
      ELSE v.l * t.weight / v.heavy END AS target
  FROM levels t LEFT JOIN level v ON true),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
keyed AS (
  SELECT d.doc_id, d.size, p.source, p.source_size, p.target, p.whole, floor(p.target + 0.5)::BIGINT - p.whole * p.source_size AS extra,
    substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS draw
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source),
points AS (SELECT source, draw, sum(size)::BIGINT AS own FROM keyed GROUP BY source, draw),
walked AS (SELECT *, (sum(own) OVER (PARTITION BY source ORDER BY draw) - own)::BIGINT AS before FROM points)
SELECT doc_id, size, source_size, target,
  least(whole * size + CASE WHEN own = 0 THEN 0 ELSE size * greatest(0, least(own, extra - before)) // own END, size * 2)::BIGINT AS taken
FROM keyed k JOIN walked w ON k.source IS NOT DISTINCT FROM w.source AND k.draw = w.draw"""

OP8_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT DISTINCT coalesce(item_id::VARCHAR, 'null') AS item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM bw, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS u(i)),
occ AS (SELECT rid, i, n, item FROM grams JOIN wins USING (n, g)),
hit AS (SELECT rid, count(DISTINCT k) AS n_hit FROM occ, unnest(range(i, i + n)) AS u(k) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM occ GROUP BY rid)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM w),
t AS (SELECT rid, doc_id, len(g) AS n, unnest(g) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS an, any_value(b.n) AS bn
  FROM t a JOIN t b ON a.g = b.g AND a.rid < b.rid AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.rid, b.rid, a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 85 * (an + bn - k) UNION SELECT b, a FROM pairs WHERE 100 * k >= 85 * (an + bn - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c.component_id
FROM s LEFT JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a"""

# Runs: a run of period p holds four words p apart at multiples of p, so only lags with such
# words are compared in full.
OP11_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS o,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: list_concat([ascii(c)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
      lambda h, x: CASE WHEN x < 0 THEN xor(h >> 1, 3988292384 * (h & 1)) ELSE xor(h, x) END) AS raw FROM documents),
crc AS (SELECT rid, doc_id, o, len(o)::BIGINT AS n, xor(raw, 4294967295) AS h FROM base),
looped AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM crc),
d AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE o END AS w FROM looped),
lags AS (SELECT rid, n, w, p FROM d, unnest(range(1, n // 4 + 1)) AS u(p)),
hits AS (SELECT rid, n, w, p, list_filter(range(0, n - 3 * p, p), lambda k: w[k + 1] = w[k + p + 1] AND w[k + 1] = w[k + 2 * p + 1] AND w[k + 1] = w[k + 3 * p + 1]) AS places FROM lags),
odd AS (SELECT rid, n, p, list_concat([-1::BIGINT], list_filter(range(0, n - p), lambda i: w[i + 1] <> w[i + p + 1]), [n - p]) AS x FROM hits WHERE len(places) > 0),
stretch AS (SELECT rid, p, x[i] + 1 AS s, x[i + 1] - x[i] - 1 + p AS l FROM odd, unnest(range(1, len(x))) AS u(i)),
enough AS (SELECT * FROM stretch WHERE l >= greatest(6, 4 * p)),
runs AS (SELECT * FROM enough e WHERE NOT EXISTS (SELECT 1 FROM enough q WHERE q.rid = e.rid AND q.p < e.p AND e.p % q.p = 0 AND q.s <= e.s AND q.s + q.l >= e.s + e.l)),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS t, list({'s': s, 'l': l, 'p': p}) AS r FROM runs GROUP BY rid),
best AS (SELECT rid, s, l, p FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY l / p DESC, s, p) AS k FROM runs) WHERE k = 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, p::BIGINT AS period, (1000 * l // p)::BIGINT AS exponent_milli,
  sha256(coalesce(t, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN r IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: len(list_filter(r, lambda y: i >= y.s + y.p AND i < y.s + y.l)) = 0),
    lambda i: w[i + 1]) END, ' '), '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid)"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT rid, id, i, l[i] AS line, regexp_replace(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM d, unnest(range(1, len(l) + 1)) AS u(i)),
shared AS (SELECT k, max(id) AS top FROM x WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT id) >= 3)
SELECT d.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (x.id < top)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (top IS NULL OR x.id = top), '')) AS kept_sha256
FROM d JOIN x USING (rid) LEFT JOIN shared USING (k) GROUP BY rid, d.doc_id"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
docs AS (SELECT rid, doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM docs),
q AS (SELECT row_number() OVER () AS qid, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT qid, unnest(t) AS term FROM q),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term),
scored AS (SELECT qid, rid, any_value(doc_id) AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l))))::BIGINT AS score
  FROM asked JOIN p USING (term) JOIN f USING (term) JOIN (SELECT rid, doc_id, n FROM docs) USING (rid), c GROUP BY qid, rid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN (SELECT qid, item_id FROM q) USING (qid) WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": OP1_SQL,
        "op2_chat_formatting": OP2_SQL,
        "op6_mix_sources": OP6_SQL,
        "op8_decontaminate": OP8_SQL,
        "op9_ngram_join": OP9_SQL,
        "op11_periodic_runs": OP11_SQL,
        "op12_line_dedup": OP12_SQL,
        "op13_ranked_search": OP13_SQL,
    }
