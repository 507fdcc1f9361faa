"""Registered queries opN_<name>: each operator over the whole of its table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import bpe, hosts, jaccard, langid, neighbours, packing, quality, secret_scan, shards, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@_query
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


@_query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(_table(spark, sf_dir, "documents"))


@_query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents"))


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.evaluate(_table(spark, sf_dir, "documents"))


@_query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


@_query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


@_query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(_table(spark, sf_dir, "documents"))


WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\n\r\f\x0b]+'), lambda x: x <> '')"

ORACLES["op10_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("lower(text)")} AS w FROM documents WHERE doc_id IS NOT NULL),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM d),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS s FROM grams GROUP BY doc_id),
reps AS (SELECT *, min(doc_id) OVER (PARTITION BY s) AS rep FROM sets),
own AS (SELECT grams.doc_id, n, g FROM grams JOIN reps ON grams.doc_id = reps.doc_id WHERE reps.doc_id = rep),
near AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM own a JOIN own b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
  HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5),
copies AS (SELECT rep, count(*) AS c FROM reps GROUP BY rep),
partners AS (SELECT a, sum(c) AS c FROM near JOIN copies ON rep = b GROUP BY a),
reach AS (SELECT rep AS a, rep AS b FROM copies UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
class AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(copies.c - 1 + coalesce(partners.c, 0), 0) AS BIGINT) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN reps USING (doc_id)
LEFT JOIN copies USING (rep) LEFT JOIN partners ON partners.a = rep LEFT JOIN class ON class.a = rep"""

ORACLES["op1_substring_dedup"] = f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
starts AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS h FROM starts),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM windows),
islands AS (SELECT doc_id, i, c, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM counted WHERE c > 1)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + 50 AS INTEGER) AS end_word, max(c) AS copies
FROM islands GROUP BY doc_id, island"""

ORACLES["op3_nearest_neighbours"] = """
WITH pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id,
    round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, neighbour_id) AS INTEGER) AS rank
FROM pairs QUALIFY rank <= 10"""

_DETECT = r"""
WITH words AS (SELECT doc_id, lang, ' ' || unnest(regexp_extract_all(lower(text), '\p{L}+')) || ' ' AS w FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, lang, w, unnest(range(1, length(w) + 1)) AS i FROM words),
grams AS (
  SELECT doc_id, lang, w[i] AS g FROM places WHERE i > 1 AND i < length(w)
  UNION ALL SELECT doc_id, lang, w[i:i + 1] FROM places WHERE i < length(w)
  UNION ALL SELECT doc_id, lang, w[i:i + 2] FROM places WHERE i + 1 < length(w)),
counts AS (SELECT doc_id, any_value(lang) AS lang, g, count(*) AS n FROM grams GROUP BY doc_id, g),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS r FROM counts QUALIFY r < 300),
chosen AS (
  SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 400),
profiles AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS r
  FROM counts SEMI JOIN chosen USING (doc_id) GROUP BY lang, g QUALIFY r < 300),
far AS (
  SELECT o.doc_id, l.lang, sum(CASE WHEN p.r IS NULL THEN 300 ELSE abs(p.r - o.r) END) AS d, count(*) AS n
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.g = o.g
  GROUP BY 1, 2),
best AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) = 1)"""
ORACLES["op2_language_id"] = _DETECT + """
SELECT documents.doc_id, best.lang AS detected, best.d / (300 * best.n) AS distance, coalesce(best.d / (300 * best.n) <= 0.7, false) AS accepted
FROM documents LEFT JOIN best ON documents.doc_id = best.doc_id"""

_STOPS = "'a', 'al', 'als', 'an', 'and', 'are', 'as', 'at', 'au', 'auch', 'auf', 'avec', 'be', 'by', 'ce', 'como', 'con', 'dans', 'das', 'de', 'del', 'dem', 'den', 'der', 'des', 'die', 'du', 'ein', 'eine', 'el', 'en', 'es', 'est', 'et', 'for', 'from', 'für', 'has', 'have', 'he', 'i', 'im', 'in', 'is', 'ist', 'it', 'la', 'las', 'le', 'les', 'lo', 'los', 'mit', 'más', 'nicht', 'not', 'o', 'of', 'on', 'or', 'par', 'para', 'pas', 'por', 'pour', 'que', 'qui', 'se', 'sich', 'su', 'sur', 'that', 'the', 'this', 'to', 'un', 'una', 'und', 'une', 'von', 'was', 'with', 'y', 'zu'"
ORACLES["op7_quality_rules"] = rf"""
WITH m AS (
  SELECT doc_id, coalesce(text, '') AS t, len(regexp_extract_all(t, '[^ \t\n\r\f\x0b]+')) AS words,
    length(regexp_replace(t, '[ \t\n\r\f\x0b]', '', 'g')) AS dense,
    length(regexp_replace(t, '[ \t\n\r\f\x0b0-9.,;:!?''"()\[\]{{}}<>#$%&*+\-/=@\\^_`|~]', '', 'g')) AS letters,
    length(t) - length(regexp_replace(t, '[#$%&*{{}}<>|^~=_@]', '', 'g')) AS symbols,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals,
    len(list_filter(regexp_split_to_array(lower(t), '[ \t\n\r\f\x0b]+'), lambda w: w IN ({_STOPS}))) AS stops,
    len(list_distinct(list_filter(regexp_split_to_array(lower(t), '[ \t\n\r\f\x0b]+'), lambda w: w <> ''))) AS distinct_words,
    len(string_split(t, chr(10))) AS lines, len(list_distinct(string_split(t, chr(10)))) AS distinct_lines,
    len(regexp_extract_all(t, '(?m)^[ \t]*[-*•]')) AS bullets,
    len(regexp_extract_all(t, '(?m)(\.\.\.|…)[ \t]*$')) AS ellipses
  FROM documents),
v AS (
  SELECT doc_id, words, CAST(words AS DOUBLE) AS word_count, dense / nullif(words, 0) AS mean_word_length, letters / nullif(dense, 0) AS letter_ratio,
    symbols / nullif(words, 0) AS symbol_ratio, capitals / nullif(dense, 0) AS capital_ratio, stops / nullif(words, 0) AS stop_word_ratio, distinct_words / nullif(words, 0) AS distinct_word_ratio,
    1 - distinct_lines / lines AS repeated_line_ratio, bullets / lines AS bullet_line_ratio, ellipses / lines AS ellipsis_line_ratio
  FROM m),
f AS (
  SELECT *, concat_ws(',', CASE WHEN word_count < 1 OR word_count > 100000 THEN 'word_count' END,
    CASE WHEN words >= 10 AND (mean_word_length < 2 OR mean_word_length > 12) THEN 'mean_word_length' END,
    CASE WHEN words >= 30 AND letter_ratio < 0.7 THEN 'letter_ratio' END, CASE WHEN words >= 30 AND symbol_ratio > 0.3 THEN 'symbol_ratio' END,
    CASE WHEN words >= 10 AND capital_ratio > 0.5 THEN 'capital_ratio' END, CASE WHEN words >= 60 AND stop_word_ratio < 0.05 THEN 'stop_word_ratio' END,
    CASE WHEN words >= 30 AND distinct_word_ratio < 0.1 THEN 'distinct_word_ratio' END,
    CASE WHEN words >= 10 AND repeated_line_ratio > 0.5 THEN 'repeated_line_ratio' END, CASE WHEN words >= 10 AND bullet_line_ratio > 0.9 THEN 'bullet_line_ratio' END,
    CASE WHEN words >= 10 AND ellipsis_line_ratio > 0.3 THEN 'ellipsis_line_ratio' END) AS failed
  FROM v)
SELECT * EXCLUDE (words), failed = '' AS keep FROM f"""

ORACLES["op9_url_filter"] = r"""
WITH marks AS (
  SELECT doc_id, max(CASE WHEN toxic IS NULL AND quality IS NULL THEN NULL WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
raw AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host,
    TRY_CAST(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:/[^/?#]*?)*?/([0-9]{1,18})(?:[./?#]|$)', 1), '') AS BIGINT) AS doc_id
  FROM pages),
parts AS (
  SELECT *, regexp_extract(host, '[^.]*$') AS last, regexp_extract(host, '([^.]*\.)?[^.]*$') AS two, regexp_extract(host, '([^.]*\.)?([^.]*\.)?[^.]*$') AS three,
    two IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.nz', 'co.jp', 'or.jp', 'com.br', 'com.cn', 'com.mx', 'co.in', 'co.za', 'com.tr', 'com.ar', 'github.io', 'blogspot.com') AS listed,
    CASE WHEN listed THEN two ELSE last END AS suffix, CASE WHEN listed THEN three ELSE two END AS domain
  FROM raw),
h AS (
  SELECT host, domain, suffix, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad
  FROM parts LEFT JOIN marks ON parts.doc_id = marks.doc_id WHERE host IS NOT NULL GROUP BY 1, 2, 3),
total AS (SELECT sum(bad) / nullif(sum(n), 0) AS mean FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS mean FROM h, total GROUP BY suffix),
ws AS (SELECT {weight} AS weight FROM s0),
s1 AS (SELECT suffix, (bad + weight * mean) / (n + weight) AS mean FROM s0, ws),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS mean FROM h JOIN s1 USING (suffix) GROUP BY domain, suffix),
wd AS (SELECT {weight} AS weight FROM d0),
d1 AS (SELECT domain, (bad + weight * mean) / (n + weight) AS mean FROM d0, wd),
h0 AS (SELECT h.*, mean FROM h JOIN d1 USING (domain)),
wh AS (SELECT {weight} AS weight FROM h0),
h1 AS (SELECT host, n, bad, (bad + weight * mean) / (n + weight) AS mean, weight FROM h0, wh),
h2 AS (SELECT *, CASE WHEN mean IS NOT NULL THEN greatest(0, mean - 1.645 * sqrt(mean * (1 - mean) / (n + weight + 1))) END AS low FROM h1)
SELECT page_id, host, domain, suffix, n AS labelled, CAST(bad AS BIGINT) AS bad, round(mean, 9) AS rate, round(low, 9) AS lower, coalesce(low <= 0.3, true) AS keep
FROM parts LEFT JOIN h2 USING (host)""".replace(
    "{weight}",
    """least(greatest(coalesce(CASE WHEN (sum((bad - n * mean) ** 2) - sum(n * mean * (1 - mean))) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0) > 0
  THEN 1 / ((sum((bad - n * mean) ** 2) - sum(n * mean * (1 - mean))) / nullif(sum(n * (n - 1) * mean * (1 - mean)), 0)) - 1 ELSE 1000 END, 1000), 1), 1000)""",
)
