"""Registered queries over the driver's tables, with equivalent SQL where SQL can say it.

Documents stand for files; code, lint output and comment lines, which the tables lack, are
derived from part, orders and events by expressions that the SQL repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import findings as O
from codeloom.operators import parsing, summary
from codeloom.plans import report
from codeloom.sources import codetree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").withColumn("file", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))


_FILE = "source || '/' || doc_id || '.txt'"
_LEXEME = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
_COUNT = f"len(regexp_extract_all(text, '{_LEXEME}'))"
_GRADE = "CASE WHEN {0} >= 3 THEN 'Critical \U0001f534' WHEN {0} >= 2 THEN 'High \U0001f7e0' WHEN {0} >= 1.5 THEN 'Medium \U0001f7e1' WHEN {0} >= 1 THEN 'Low \U0001f7e2' ELSE 'None' END"


@_query(f"""
SELECT {_FILE} AS file, {_COUNT} AS token_count, {_GRADE.format(f"({_COUNT} / 500)")} AS severity
FROM documents WHERE {_COUNT} >= 500 ORDER BY token_count DESC, file LIMIT 10""")
def large_files_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _documents(spark, sf_dir).select("file", C.lexical_count(F.col("text")).alias("token_count"))
    return O.large_files(counts, 500, 10).withColumn("token_count", F.col("token_count").cast("long"))


@_query(f"SELECT 'document' AS kind, doc_id AS id, {_COUNT} AS token_count FROM documents UNION ALL SELECT 'page', page_id, {_COUNT.replace('text', 'html')} FROM pages")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: C.lexical_count(F.col(c)).cast("long").alias("token_count")
    docs = _table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), count("text"))
    return docs.unionByName(_table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), count("html")))


@_query(f"""
WITH c AS (SELECT doc_id, {_COUNT} AS lexical, list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda l: length(l) >= 80), lambda l: len(regexp_extract_all(l, '{_LEXEME}')))) AS b FROM documents)
SELECT doc_id, CAST(CASE WHEN coalesce(b, 0) >= 10 AND coalesce(b, 0) * 10 >= lexical THEN coalesce(b, 0) ELSE lexical END AS BIGINT) AS token_count FROM c""")
def size_bucket_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The C# rule of token counts, lines of 80 characters and more standing for blocks."""
    in_lines = F.aggregate(F.filter(F.split("text", "\n", -1), lambda l: F.length(l) >= 80), F.lit(0), lambda s, l: s + C.lexical_count(l))
    return _table(spark, sf_dir, "documents").select("doc_id", O.block_or_lexical(in_lines, C.lexical_count(F.col("text"))).cast("long").alias("token_count"))


def _document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    last = F.size(F.split("text", "\n", -1))
    return docs.select(F.struct(F.col("source").alias("file"), F.col("doc_id").cast("int").alias("start_line"), last.alias("end_line")).alias("location"), C.lexemes(F.col("text")).alias("tokens"))


_BLOCKS = f"WITH b AS (SELECT source AS file, CAST(doc_id AS INTEGER) AS start_line, len(string_split(text, chr(10))) AS end_line, regexp_extract_all(text, '{_LEXEME}') AS tokens FROM documents)"


@_query(_BLOCKS + """
SELECT len(tokens) AS size, count(*) AS num_duplicates, string_agg(file || ':' || start_line || '-' || end_line, ' ' ORDER BY file, start_line, end_line) AS locations,
  min(file) <> max(file) AS cross_file, array_to_string(list_slice(tokens, 1, 10), ' ') || CASE WHEN len(tokens) > 10 THEN ' ...' ELSE '' END AS snippet, CAST(1.0 AS DOUBLE) AS similarity
FROM b WHERE len(tokens) >= 50 GROUP BY tokens HAVING count(*) >= 2""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = O.duplicates(_document_blocks(spark, sf_dir), 50)
    place = F.transform("locations", lambda p: F.concat_ws("", p["file"], F.lit(":"), p["start_line"], F.lit("-"), p["end_line"]))
    return g.select(F.col("size").cast("long").alias("size"), F.col("num_duplicates").cast("long").alias("num_duplicates"), F.array_join(place, " ").alias("locations"), "cross_file", C.snippet(F.col("tokens")).alias("snippet"), "similarity")


@_query(r"""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) AS line FROM documents)
SELECT line, count(*) AS n, count(DISTINCT doc_id) AS documents FROM l WHERE length(line) >= 40 GROUP BY line HAVING count(*) >= 2""")
def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.explode(C.lines(F.col("text"))).alias("line")).where(F.length("line") >= 40)
    by_doc = lines.groupBy("line", "doc_id").agg(F.count(F.lit(1)).alias("n"))  # two plain aggregates instead of a distinct one
    return by_doc.groupBy("line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents")).where("n >= 2")


_EVENT_LINE = "CASE event_id % 8 WHEN 0 THEN 'x = 1  # TODO: ' WHEN 1 THEN '# fix-me ' WHEN 2 THEN 'plain ' WHEN 3 THEN '# debug ' WHEN 4 THEN '# to do: ' WHEN 5 THEN '# notebook ' WHEN 6 THEN 's = ''#'' # Hack ' ELSE '## XXX, then TBD: ' END || event_type"


@_query(rf"""
WITH l AS (SELECT event_id, {_EVENT_LINE} AS line FROM events),
m AS (SELECT event_id, regexp_extract(line, '#.*?({C.MARKERS})(:|\b)(.*)', 1, 'i') AS kind, regexp_extract(line, '#.*?({C.MARKERS})(:|\b)(.*)', 3, 'i') AS text FROM l)
SELECT event_id, upper(trim(kind)) AS type, trim(text) AS text FROM m WHERE kind <> ''""")
def marker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, text = C.hash_marker(F.col("line"))
    lines = _table(spark, sf_dir, "events").select("event_id", F.expr(_EVENT_LINE.replace("''#''", "\\'#\\'")).alias("line"))
    return lines.where(F.contains("line", F.lit("#"))).select("event_id", kind.alias("type"), text.alias("text")).where("type <> ''")


@_query(rf"""
WITH c AS (SELECT page_id, unnest(regexp_extract_all(replace(replace(html, '<!-- ad ', '<!-- ' || CASE page_id % 3 WHEN 0 THEN 'TODO: ' WHEN 1 THEN 'mastodon ' ELSE 'see #note ' END), '-->', ' -->'), '(?s)<!--.*?-->')) AS comment FROM pages),
m AS (SELECT page_id, regexp_extract(comment, '{C.COMMENT_MARKER}', 1, 'i') AS kind, regexp_extract(comment, '{C.COMMENT_MARKER}', 2, 'i') AS text FROM c)
SELECT page_id, upper(kind) AS type, trim(text) AS text FROM m WHERE kind <> ''""")
def comment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.expr("CASE page_id % 3 WHEN 0 THEN 'TODO: ' WHEN 1 THEN 'mastodon ' ELSE 'see #note ' END")
    html = F.replace(F.replace("html", F.lit("<!-- ad "), F.concat(F.lit("<!-- "), word)), F.lit("-->"), F.lit(" -->"))
    comments = _table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(html, F.lit("(?s)<!--.*?-->"), F.lit(0))).alias("comment"))
    kind, text = C.comment_marker(F.col("comment"))
    return comments.select("page_id", kind.alias("type"), text.alias("text")).where("type <> ''")


@_query("""
SELECT page_id, url FROM pages WHERE NOT list_has_any(string_split(url, '/'), ['.venv', 'venv', 'env', 'ENV', 'en', 'de'])
  AND NOT (url = 'https://blog.tionsh.example.net' OR starts_with(url, 'https://blog.tionsh.example.net/'))""")
def path_ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").where(~C.in_ignored(url, C.ignored_names(["en", "de"])) & ~C.under_any(url, ["https://blog.tionsh.example.net"])).select("page_id", "url")


_LINT_LINE = "CASE o_orderkey % 4 WHEN 0 THEN 'src/a' || o_custkey || '.py:' || (o_orderkey % 900 + 1) || ':1: F401 ''os'' imported but unused' WHEN 1 THEN 'b.py:' || o_orderkey || ':12:  S307 ' || o_orderpriority WHEN 2 THEN 'summary: ' || o_orderstatus ELSE 'c:d.py:7:3: B006 mutable ' END"


@_query(rf"""
WITH l AS (SELECT o_orderkey, {_LINT_LINE} AS line FROM orders),
m AS (SELECT o_orderkey, regexp_extract(line, '^(.*?):([0-9]+):[0-9]+:\s+([A-Z]+[0-9]+)\s+(.*)$', ['file', 'line', 'code', 'message']) AS m FROM l)
SELECT m.file AS file, CAST(m.line AS INTEGER) AS line, m.code AS code, trim(m.message) AS message FROM m WHERE m.code <> ''""")
def lint_line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.external_findings(_table(spark, sf_dir, "orders").select(F.expr(_LINT_LINE.replace("''os''", "\\'os\\'")).alias("line")))


@_query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", C.content_hash(F.encode("text", "UTF-8")).alias("hash"))


@_query(f"""
SELECT l_orderkey, l_linenumber, {_GRADE.format("(l_quantity / nullif(CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber * 4 END, 0))")} AS severity FROM lineitem""")
def severity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    threshold = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_linenumber") * 4)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.severity(F.col("l_quantity"), threshold).alias("severity"))


def _sections(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three sections over the tables: documents as files, orders as functions, marker lines."""
    counts = _documents(spark, sf_dir).select("file", C.lexical_count(F.col("text")).alias("token_count"))
    value = (F.col("o_orderkey") % 41).cast("int")
    functions = _table(spark, sf_dir, "orders").where(value >= 10).select(F.col("o_orderpriority").alias("name"), value.alias("complexity"), F.col("o_custkey").cast("int").alias("lineno"), F.lit(None).cast("int").alias("endline"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".cs")).alias("file"), F.lit(10).alias("threshold"), C.severity(value, 10).alias("severity"))
    markers = marker_scan(spark, sf_dir).select(F.lit("events.py").alias("file"), F.col("event_id").cast("int").alias("line"), "type", "text")
    return {"complexity_results": functions, "large_files": O.large_files(counts, 500, None), "todo_fixme": markers}


_FINDINGS = rf"""
WITH f AS (
  SELECT 'complexity_results' AS section, 1 AS section_ord, {_GRADE.format("((o_orderkey % 41) / 10)")} AS severity, 'o' || o_orderkey || '.cs' AS file, CAST(o_custkey AS INTEGER) AS line, o_orderkey % 41 AS metric, o_orderpriority AS detail FROM orders WHERE o_orderkey % 41 >= 10
  UNION ALL SELECT 'large_files', 2, {_GRADE.format(f"({_COUNT} / 500)")}, {_FILE}, NULL, {_COUNT}, NULL FROM documents WHERE {_COUNT} >= 500
  UNION ALL SELECT 'todo_fixme', 5, NULL, 'events.py', CAST(event_id AS INTEGER), NULL, text FROM ({ORACLES["marker_scan"]}))"""


@_query(_FINDINGS + """,
s(section_ord, section, noun) AS (VALUES (1, 'complexity_results', 'high cyclomatic complexity functions'), (2, 'large_files', 'large files'), (3, 'large_classes', 'large classes'), (4, 'unused', 'unused imports/variables'),
  (5, 'todo_fixme', 'TODO/FIXME comments'), (6, 'duplicates', 'duplicate code blocks'), (7, 'bns_results', 'Bugs and Safety Issues')),
g AS (SELECT section, severity, count(*) AS n FROM f GROUP BY section, severity),
t AS (SELECT section, sum(n) AS n, string_agg(CASE WHEN severity IS NOT NULL THEN n || ' ' || severity END, ', ' ORDER BY CASE substr(severity, 1, 1) WHEN 'C' THEN 1 WHEN 'H' THEN 2 WHEN 'M' THEN 3 ELSE 4 END) AS grades FROM g GROUP BY section)
SELECT s.section_ord, s.section, CASE WHEN t.n > 0 THEN '- ' || CAST(t.n AS BIGINT) || ' ' || noun || coalesce(' (' || grades || ')', '') ELSE '- 0 ' || noun || ' ✅' END AS line
FROM s LEFT JOIN t ON s.section = t.section""")
def section_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.summary(summary.union(_sections(spark, sf_dir)))


@_query(_FINDINGS + """
SELECT *, CAST(row_number() OVER (PARTITION BY section ORDER BY metric DESC NULLS LAST, file, line, detail) AS INTEGER) AS position FROM f QUALIFY position <= 5""")
def per_section_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_of_each_section(summary.union(_sections(spark, sf_dir)), 5)


@_query(_FINDINGS + " SELECT * FROM f")
def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.union(_sections(spark, sf_dir))


@_query(f"""
WITH s AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(text, '{_LEXEME}')) AS t FROM documents),
e AS (SELECT id, len(t) AS n, unnest(t) AS token FROM s WHERE len(t) >= 10),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, any_value(a.n) AS an, any_value(b.n) AS bn FROM e a JOIN e b ON a.token = b.token AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, CAST(shared / (an + bn - shared) AS DOUBLE) AS similarity FROM p WHERE shared / (an + bn - shared) >= 0.8""")
def similar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.similar(_table(spark, sf_dir, "documents").select("doc_id", C.lexemes(F.col("text")).alias("tokens")), "doc_id", "tokens", 0.8, 10)


@_query(_BLOCKS + """,
g AS (
  SELECT len(tokens) AS size, count(*) AS n, min(file) <> max(file) AS cross_file, array_to_string(list_slice(tokens, 1, 10), ' ') || CASE WHEN len(tokens) > 10 THEN ' ...' ELSE '' END AS snippet,
    string_agg('    - [' || file || ':' || start_line || '](' || file || '#L' || start_line || ') - ' || file || ':' || start_line || '-' || end_line, chr(10) ORDER BY file, start_line, end_line) AS places, list(struct_pack(file := file, start_line := start_line, end_line := end_line) ORDER BY file, start_line, end_line) AS locations
  FROM b WHERE len(tokens) >= 50 GROUP BY tokens HAVING count(*) >= 2),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, size DESC, locations) AS INTEGER) AS position FROM g)
SELECT position, '- Clone #' || position || ': size=' || size || ' tokens, count=' || n || CASE WHEN cross_file THEN ' (cross-file)' ELSE '' END || chr(10) || places || chr(10) || '    Tokens: ' || snippet || chr(10) AS line FROM r""")
def clone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.clone_lines(O.duplicates(_document_blocks(spark, sf_dir), 50), markdown=True)


_PYTHON = r"concat('import os\nimport sys\n\nclass C', p_partkey, ':\n    size = ', p_size, '\n\n    def run(self, a, b=[]):\n        x = 1\n', repeat('        if a > 1:\n            a = b\n', p_size % 5), '        return eval(a)\n\n\ndef f', p_partkey, '(a):\n    # TODO: ', p_brand, '\n    # y = 2\n    return [v for v in a if v]\n')"
_ECMA = r"concat('// FIXME later ', p_partkey, '\nclass K', p_partkey, ' {\n  run(a) {\n', repeat('    if (a > 1 && a < 9) { a = a ? 1 : 2; }\n', p_size % 5), '    return a;\n  }\n}\nfunction g', p_partkey, '() { return `x`; }\n')"
_SHARP = r"concat('/* BUG: ', p_partkey, ' */\npublic class X', p_partkey, ' {\n    public int Foo(int? a) {\n', repeat('        foreach (var b in c) { if (b == 1 || b == 2) return 1; }\n', p_size % 5), '        switch (a) { case 1: return 2; case 2: return 3; default: return a ?? 0; }\n    }\n    public int Bar() => 3;\n}\n')"


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files table of code made from part: a Python, a JavaScript and a C# file for each row."""
    part = codetree.spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"))
    texts = F.array(*[F.struct(F.concat(F.lit(f"{folder}/p"), F.col("p_partkey").cast("string"), F.lit(ext)).alias("path"), F.expr(e).alias("content")) for folder, ext, e in (("py", ".py", _PYTHON), ("js", ".js", _ECMA), ("cs", ".cs", _SHARP))])
    rows = part.select(F.explode(texts).alias("t")).select("t.*")
    return codetree.from_table(rows, F.col("path"), F.col("content"))


def parsed_code(spark: SparkSession, sf_dir: str, *outputs: str, languages: tuple[str, ...] = ()) -> DataFrame:
    return parsing.parse(code(spark, sf_dir), outputs, languages)


@_query()
def py_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.blocks(parsed_code(spark, sf_dir, "blocks")).select("location.*", "type", "name", "language", F.array_join("tokens", " ").alias("tokens"))


@_query(f"""
WITH c AS (
  SELECT 'py/p' || p_partkey || '.py' AS file, 'C' || p_partkey AS name, 3 + p_size % 5 AS complexity, 4 AS lineno, 9 + 2 * (p_size % 5) AS endline FROM part
  UNION ALL SELECT 'py/p' || p_partkey || '.py', 'run', 1 + p_size % 5, 7, 9 + 2 * (p_size % 5) FROM part
  UNION ALL SELECT 'py/p' || p_partkey || '.py', 'f' || p_partkey, 3, 12 + 2 * (p_size % 5), 15 + 2 * (p_size % 5) FROM part
  UNION ALL SELECT 'js/p' || p_partkey || '.js', 'run', 1 + 3 * (p_size % 5), 3, 5 + p_size % 5 FROM part
  UNION ALL SELECT 'js/p' || p_partkey || '.js', 'g' || p_partkey, 1, 7 + p_size % 5, 7 + p_size % 5 FROM part
  UNION ALL SELECT 'cs/p' || p_partkey || '.cs', 'Foo', 3 + 3 * (p_size % 5), 3, 5 + p_size % 5 FROM part
  UNION ALL SELECT 'cs/p' || p_partkey || '.cs', 'Bar', 1, 6 + p_size % 5, 6 + p_size % 5 FROM part)
SELECT name, CAST(complexity AS INTEGER) AS complexity, CAST(lineno AS INTEGER) AS lineno, CAST(endline AS INTEGER) AS endline, file, 2 AS threshold, {_GRADE.format("(complexity / 2)")} AS severity FROM c WHERE complexity >= 2""")
def code_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.complexity(parsed_code(spark, sf_dir, "complexity"), 2)


@_query("""
SELECT 'py/p' || p_partkey || '.py' AS file, CAST(line AS INTEGER) AS line, type, text FROM part, LATERAL (SELECT 13 + 2 * (p_size % 5) AS line, 'TODO' AS type, p_brand AS text)
UNION ALL SELECT 'js/p' || p_partkey || '.js', 1, 'FIXME', 'later ' || p_partkey FROM part
UNION ALL SELECT 'cs/p' || p_partkey || '.cs', 1, 'BUG', p_partkey || ' */' FROM part""")
def code_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code(spark, sf_dir)
    return O.markers(files, parsing.parse(files, ("comments",), ("javascript", "typescript", "tsx", "csharp")))


@_query("""
SELECT 'py/p' || p_partkey || '.py' AS file, 1 AS line, 'F401' AS code, '''os'' imported but unused' AS message FROM part
UNION ALL SELECT 'py/p' || p_partkey || '.py', 2, 'F401', '''sys'' imported but unused' FROM part
UNION ALL SELECT 'py/p' || p_partkey || '.py', 8, 'F841', 'local variable ''x'' is assigned to but never used' FROM part""")
def py_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.unused(parsed_code(spark, sf_dir, "unused", languages=("python",)))


@_query("""
SELECT 'py/p' || p_partkey || '.py' AS file, 7 AS line, 'B006' AS code, 'Do not use mutable data structures for argument defaults' AS message FROM part
UNION ALL SELECT 'py/p' || p_partkey || '.py', CAST(9 + 2 * (p_size % 5) AS INTEGER), 'S307', 'Use of a possibly insecure function: eval' FROM part
UNION ALL SELECT 'py/p' || p_partkey || '.py', CAST(14 + 2 * (p_size % 5) AS INTEGER), 'E800', 'Found commented out code' FROM part""")
def py_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.lint(parsed_code(spark, sf_dir, "lint", languages=("python",)))


@_query(f"""
WITH c AS (
  SELECT 'C' || p_partkey AS name, 'py/p' || p_partkey || '.py' AS file, 4 AS start_line, 9 + 2 * (p_size % 5) AS end_line, 6 + 4 * (p_size % 5) AS n FROM part
  UNION ALL SELECT 'K' || p_partkey, 'js/p' || p_partkey || '.js', 2, 6 + p_size % 5, 4 + 8 * (p_size % 5) FROM part
  UNION ALL SELECT 'X' || p_partkey, 'cs/p' || p_partkey || '.cs', 2, 7 + p_size % 5, 6 + 5 * (p_size % 5) FROM part)
SELECT name, file, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(n AS INTEGER) AS token_count, {_GRADE.format("(n / 10)")} AS severity
FROM c WHERE n >= 10 ORDER BY n DESC, file, start_line, name LIMIT 20""")
def code_large_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.large_classes(parsing.blocks(parsed_code(spark, sf_dir, "blocks")), 10, 20)


@_query(f"""
SELECT 'py/p' || p_partkey || '.py' AS file, 'python' AS language, CAST(70 + 12 * (p_size % 5) AS INTEGER) AS token_count FROM part
UNION ALL SELECT 'js/p' || p_partkey || '.js', 'javascript', CAST(len(regexp_extract_all({_ECMA.replace(chr(92) + "n", "' || chr(10) || '")}, '{_LEXEME}')) AS INTEGER) FROM part
UNION ALL SELECT 'cs/p' || p_partkey || '.cs', 'csharp', CAST(11 + 10 * (p_size % 5) AS INTEGER) FROM part""")
def code_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.token_counts(parsed_code(spark, sf_dir, "py_tokens", "in_blocks"))


@_query("""
SELECT 'm' || (o_orderkey % 3) AS name, CAST(o_orderkey % 30 AS INTEGER) AS complexity, CAST(o_custkey AS INTEGER) AS lineno, CAST(NULL AS INTEGER) AS endline, 'o' || o_orderkey || '.js' AS file, 10 AS threshold,
  CASE WHEN o_orderkey % 30 >= 20 THEN 'High \U0001f7e0' WHEN o_orderkey % 30 >= 15 THEN 'Medium \U0001f7e1' ELSE 'Low \U0001f7e2' END AS severity
FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 30 >= 10""")
def external_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("not json")).otherwise(F.format_string('[{"name": "m%d", "complexity": %d, "lineno": %d}]', F.col("o_orderkey") % 3, F.col("o_orderkey") % 30, F.col("o_custkey")))
    return O.external_complexity(_table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".js")).alias("file"), text.alias("json")))
