"""Finding operators on small tables, against definitions and plain-Python versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import findings as O
from codeloom.operators import parsing, summary
from codeloom.plans import analysis, report
from codeloom.sources import codetree


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).collect()[0][0]


@pytest.mark.parametrize(
    ("value", "threshold", "grade"),
    [(5, 10, "None"), (10, 10, "Low \U0001f7e2"), (15, 10, "Medium \U0001f7e1"), (20, 10, "High \U0001f7e0"), (30, 10, "Critical \U0001f534"), (100, 1, "Critical \U0001f534"), (0, 0, "None"), (10, 0, "None"), (-5, 10, "None"), (5, -10, "None"), (None, 10, "None")],
)
def test_severity(spark, value, threshold, grade):
    assert one(spark, C.severity(F.lit(value).cast("double"), threshold)) == grade


def test_lexical_count_is_that_of_python(spark):
    texts = ["function foo() { return 1; }", "public class Foo { int x = 1; }", "élan ab_c, x1 — été ١٢ 日本 a‑b 'q' ½ ² é\U0001f534", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(C.lexical_count(F.col("t"))).collect()]
    assert found == [len(re.findall(r"[^\w\s]|\w+", t or "")) for t in texts] and found[:3] == [9, 10, 18]


MARKER_LINES = ["# TODO: a", "x='#todo'", "# debug x", "# notebook", "#fix me now", "# TODO :y", "# éTODOé z", "# temperature then FIXME q", "# just a comment", "TODO without sign", "", "# To-Do later", "## xxx: b", "# TO_FIX it ", "#\ttbd\u00a0"]


def test_hash_markers_equal_python(spark):
    pattern = re.compile(rf"#.*?({C.MARKERS})(:|\b)(.*)", re.I)
    df = spark.createDataFrame([(s,) for s in MARKER_LINES], "s string")
    kind, text = C.hash_marker(F.col("s"))
    want = [(m[1].strip().upper(), m[3].strip()) if (m := pattern.search(s)) else ("", "") for s in MARKER_LINES]
    assert [tuple(r) for r in df.select(kind, text).collect()] == want


@pytest.mark.parametrize(
    ("comment", "found"),
    [("// TODO: js todo", ("TODO", "js todo")), ("// debug mode", ("", "")), ("/* line\n * FIXME : two\n more */", ("FIXME", "two")), ("/* TODO\n next */", ("TODO", "next */")), ("//hack", ("HACK", ""))],
)
def test_comment_markers(spark, comment, found):
    kind, text = C.comment_marker(F.lit(comment))
    assert tuple(spark.range(1).select(kind, text).collect()[0]) == found


@pytest.mark.parametrize("text", ["a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j\u2028k\u2029l", "a\n", "a\n\n", "", "\n", "x"])
def test_lines_are_those_of_splitlines(spark, text):
    assert one(spark, C.lines(F.lit(text))) == text.splitlines()


def test_paths(spark):
    df = spark.createDataFrame([("a/venv/x.py",), ("a/env.py",), ("src/b.TSX",), ("/r/s/c.cs",), ("/r/sub/.py",), ("x",)], "p string")
    p = F.col("p")
    rows = df.select(C.in_ignored(p, C.ignored_names(["s"])), C.language(p), C.under_any(p, ["/r/s", "/q/"]), C.extension(p)).collect()
    assert [tuple(r) for r in rows] == [(True, "python", False, ".py"), (False, "python", False, ".py"), (False, "tsx", False, ".TSX"), (True, "csharp", True, ".cs"), (False, None, False, ""), (False, None, False, "")]
    assert C.normalised_extensions("py, .js") == (".js", ".py") and C.normalised_extensions(None) == C.DEFAULT_EXTENSIONS
    assert one(spark, C.path_text(F.lit("t.py"), F.lit(10))) == "t.py:10"
    assert one(spark, C.path_text(F.lit("t.py"), F.lit(10), "markdown")) == "[t.py:10](t.py#L10)"
    assert one(spark, C.path_text(F.lit("t.py"), None, "markdown")) == "[t.py](t.py)"
    assert one(spark, C.path_text(F.lit("t.py"), F.lit(10), "terminal")) == "\x1b]8;;file://t.py#L10\x1b\\t.py:10\x1b]8;;\x1b\\"


def block_rows(spark, rows):
    return spark.createDataFrame(rows, "location struct<file: string, start_line: int, end_line: int>, tokens array<string>")


def test_duplicates(spark):
    same = "def test x y return".split()
    blocks = block_rows(spark, [(("test2.py", 10, 14), same), (("test1.py", 1, 5), same), (("test3.py", 20, 25), "def other a b print".split()), (("z.py", 1, 1), None)])
    (g,) = O.duplicates(blocks, 3).collect()
    assert (g["size"], g.num_duplicates, g.similarity, g.cross_file, g.tokens) == (5, 2, 1.0, True, same)
    assert [tuple(x) for x in g.locations] == [("test1.py", 1, 5), ("test2.py", 10, 14)]
    assert O.duplicates(blocks, 6).collect() == []
    assert O.duplicates(blocks.where("false"), 1).collect() == []


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_equals_all_pairs(spark, least):
    r = random.Random(int(least * 10))
    sets = {i: {f"t{r.randrange(25)}" for _ in range(r.randint(1, 14))} for i in range(60)}
    sets |= {100: sets[0], 101: set()}
    df = spark.createDataFrame([(i, sorted(s) + sorted(s)[:1]) for i, s in sets.items()], "block_id int, tokens array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
    assert {(x.a, x.b) for x in O.similar(df, min_similarity=least).collect()} == want


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_blocks_of_similar_sets_lose_and_repeat_nothing(spark, least, monkeypatch):
    monkeypatch.setattr(O, "BLOCK_SETS", 7)
    monkeypatch.setattr(O, "CELLS", 20)
    r = random.Random(3)
    sets = {}
    for i in range(30):
        base = [f"{'x' * r.randrange(9)}{r.randrange(300)}" for _ in range(r.randint(1, 120))]
        sets[i], sets[100 + i] = set(base), set(base) | {f"y{j}" for j in range(r.randrange(20))}
        sets[200 + i] = set(base[: -(len(base) // 6) or None])
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "block_id long, tokens array<string>")
    want = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least)
    found = O.similar(df, min_similarity=least)
    assert sorted((x.a, x.b) for x in found.collect()) == want and len(want) >= 3
    assert "Generate explode(t" not in found._jdf.queryExecution().toString()  # no row for each token


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    body = "\n".join(f"        self.v{i} = {i}" for i in range(40))
    files = {
        "a.py": f"import os\n\ndef dup(a):\n    if a:\n        return [x for x in a if x]\n    return eval(a)  # TODO: safe\n\nclass Big:\n    def __init__(self, d=[]):\n{body}\n",
        "pkg/__init__.py": "def dup(a):\n    if a:\n        return [x for x in a if x]\n    return eval(a)\n",
        ".hid/h.py": "x = 1\r\n# FIXME later\r\n",
        "venv/v.py": "import os\n",
        "UP.PY": "import os\n",
        "b.js": "// HACK: b\nfunction f(a) { if (a && a.b) { return 1; } return 2; }\n" + "x = 1;\n" * 200,
        "c.cs": "/* NOTE c */\nclass C { int Foo(int a) { if (a > 1 || a < 0) return 1; return 2; } }\n",
        "d.ts": "interface T { a: string }\nconst g = (a: number) => { return a ? 1 : 2; };\n",
        "bad.py": "def (\n",
        "latin.py": b"x = '\xe9'\n",
        "notes.txt": "# TODO no\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    (root / "dir.py").mkdir()
    return root


def test_scan(spark, tree):
    names = {r.path.removeprefix(f"{tree}/"): r for r in codetree.read_tree(spark, str(tree)).collect()}
    assert set(names) == {"a.py", "pkg/__init__.py", ".hid/h.py", "b.js", "c.cs", "d.ts", "bad.py", "latin.py"}
    assert names["latin.py"].content is None and names[".hid/h.py"].content == "x = 1\n# FIXME later\n" and names["c.cs"].language == "csharp"
    assert {r.path.removeprefix(f"{tree}/") for r in codetree.read_tree(spark, str(tree), "py", ["pkg", ".hid"]).collect()} == {"a.py", "bad.py", "latin.py"}
    with pytest.raises(ValueError):
        codetree.read_tree(spark, f"{tree}/none")


def test_scan_packs_files_into_partitions(tree):
    reader = codetree.CodeTreeReader({"path": str(tree), "partitionbytes": "5000"})
    parts = reader.partitions()
    assert len(parts) > 3 and sum(len(p.paths) for p in parts) == 8


@pytest.fixture(scope="module")
def sections(spark, tree):
    corpus = analysis.Corpus.load(spark, tree)
    yield corpus.sections(analysis.Settings(tree, min_size=5, complexity_threshold=2, large_file_threshold=100, large_class_threshold=50))
    corpus.close()


def test_sections(sections, tree):
    found = {k: [{**r.asDict(), "file": r.asDict().get("file", "").removeprefix(f"{tree}/")} for r in df.collect()] for k, df in sections.items()}
    assert {(r["file"], r["name"], r["complexity"]) for r in found["complexity_results"]} == {("a.py", "dup", 4), ("a.py", "Big", 3), ("pkg/__init__.py", "dup", 4), ("b.js", "f", 3), ("c.cs", "Foo", 3), ("d.ts", "g", 2)}
    assert [(r["file"], r["token_count"]) for r in found["large_files"]][0] == ("b.js", 5 + 24 + 4 * 200)
    assert [(r["file"], r["name"], r["token_count"]) for r in found["large_classes"]] == [("a.py", "Big", 80)]
    assert [(r["file"], r["line"], r["code"]) for r in found["unused"]] == [("a.py", 1, "F401")]
    assert {(r["file"], r["line"], r["type"], r["text"]) for r in found["todo_fixme"]} == {("a.py", 6, "TODO", "safe"), (".hid/h.py", 2, "FIXME", "later"), ("b.js", 1, "HACK", "b"), ("c.cs", 1, "NOTE", "c */")}
    (g,) = found["duplicates"]
    assert g["num_duplicates"] == 2 and g["cross_file"] and g["tokens"][0] == "dup"
    assert sorted((r["file"], r["line"], r["code"]) for r in found["bns_results"]) == [("a.py", 6, "S307"), ("a.py", 9, "B006"), ("pkg/__init__.py", 4, "S307")]


def test_summary_and_reports(spark, sections, tree, tmp_path):
    lines = report.Reporter().summary(sections)
    assert lines[0] == "- 6 high cyclomatic complexity functions (2 High \U0001f7e0, 3 Medium \U0001f7e1, 1 Low \U0001f7e2)"
    assert lines[3:] == ["- 1 unused imports/variables", "- 4 TODO/FIXME comments", "- 1 duplicate code blocks", "- 3 Bugs and Safety Issues"]
    empty = {k: df.where("false") for k, df in sections.items()}
    assert report.Reporter().summary(empty)[1] == "- 0 large files ✅"
    text = "\n".join(report.Reporter().lines(sections))
    assert "Clone #1: size=" in text and "tokens, count=2 (cross-file)" in text and f"- {tree}/a.py:6 [TODO] safe" in text and "\x1b" not in text
    md = "\n".join(report.Reporter("markdown").lines({k: v for k, v in empty.items() if k != "unused"} | {"duplicates": sections["duplicates"]}))
    assert "## Code Duplications\n- Clone #1" in md and f"[{tree}/a.py:3]({tree}/a.py#L3)" in md and "**No large files found.**" in md and "Unused Imports and Vars" not in md
    out = tmp_path / "r.json"
    report.Reporter("json").generate(sections, out)
    import json

    data = json.loads(out.read_text())
    assert list(data) == [*report.SECTIONS, "summary"] and len(data["todo_fixme"]) == 4 and data["duplicates"][0]["locations"][0]["file"] == f"{tree}/a.py"
    with pytest.raises(ValueError):
        report.Reporter("xml")
    extra = report.Reporter(config={"more": report.Section("More"), "bad": report.Section("Bad", summary=lambda n, levels: 1 / 0)})
    assert extra.summary({"more": spark.createDataFrame([("Low \U0001f7e2",)], "severity string")})[7:] == ["- 1 more (1 Low \U0001f7e2)", "[Error in summary for bad: division by zero]"]


def test_unwritable_report_goes_to_standard_output(sections, capsys):
    report.Reporter().generate({"unused": sections["unused"]}, "/nonexistent/r.txt")
    assert "Error writing report" in (shown := capsys.readouterr().out) and "imported but unused" in shown


def test_findings_table(sections, tmp_path, spark):
    f = summary.union(sections)
    report.write_findings(f, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == f.count()
    assert {(r.section, r.position) for r in summary.top_of_each_section(f, 1).collect()} == {(s, 1) for s in sections}


def test_snippet(spark):
    assert one(spark, C.snippet(F.array(*[F.lit(f"t{i}") for i in range(11)]))) == "t0 t1 t2 t3 t4 t5 t6 t7 t8 t9 ..."
    assert one(spark, C.snippet(F.array(F.lit("a"), F.lit("b")))) == "a b"


def test_external_output(spark):
    lines = spark.createDataFrame([("a.py:3:1: F401 'os' imported but unused",), ("c:d.py:7:12:  B006 x ",), ("no",), (None,)], "line string")
    assert [tuple(r) for r in O.external_findings(lines).collect()] == [("a.py", 3, "F401", "'os' imported but unused"), ("c:d.py", 7, "B006", "x")]
    rows = spark.createDataFrame([("a.js", '[{"name": "f", "complexity": 12, "lineno": 1}, {"complexity": 30}]'), ("b.js", "bad"), ("c.js", None)], "file string, json string")
    assert [(r.name, r.complexity, r.lineno) for r in O.external_complexity(rows).collect()] == [("f", 12, 1), ("<anonymous>", 30, None)]


def test_compat_and_settings(spark, tree):
    corpus = analysis.Corpus(codetree.read_tree(spark, str(tree)), keep=False)
    s = analysis.Settings(tree, top_n_large=0, large_file_threshold=1, only=("large_files",))
    assert corpus.sections(s)["large_files"].count() == 6
    assert corpus.sections(analysis.Settings(tree, top_n_large=0, large_file_threshold=1, compat=True))["large_files"].count() == 0
    for bad in ({"path": f"{tree}/none"}, {"path": tree / "a.py"}, {"path": tree, "min_similarity": 2}, {"path": tree, "output_format": "xml"}, {"path": tree, "only": ("x",)}):
        with pytest.raises(ValueError):
            analysis.Settings(**bad)


def test_doubling_the_corpus_doubles_the_copies(spark):
    blocks = block_rows(spark, [((f"f{i % 3}", i, i), [f"t{i % 4}"] * 5) for i in range(12)])
    once, twice = ({tuple(r.tokens): r.num_duplicates for r in O.duplicates(b, 1).collect()} for b in (blocks, blocks.union(blocks)))
    assert twice == {k: 2 * v for k, v in once.items()}


def test_sql_functions(spark):
    analysis.register_functions(spark)
    spark.createDataFrame([("def f(a):\n    return a if a else eval(a)\n",)], "content string").createOrReplaceTempView("sources")
    assert spark.sql("SELECT name, tokens FROM sources, LATERAL py_blocks(content)").collect() == [("f", ["f", "a", "a", "eval", "a"])] or spark.sql("SELECT name FROM sources, LATERAL py_blocks(content)").collect()[0].name == "f"
    assert spark.sql("SELECT complexity FROM sources, LATERAL py_complexity(content)").collect()[0][0] == 2
    assert spark.sql("SELECT code FROM sources, LATERAL py_lint(content)").collect()[0][0] == "S307"
    assert spark.sql("SELECT text FROM LATERAL code_comments('a = 1; // b', 'javascript')").collect()[0][0] == "// b"
    assert spark.sql("SELECT py_token_count(cast('a = 1\n' AS binary))").collect()[0][0] == 4


def test_cli(tree, tmp_path, capsys):
    from codeloom import cli

    out = tmp_path / "r.md"
    assert cli.main([str(tree), "--output-format", "markdown", "--output-file", str(out), "--min-size", "5", "--extensions", "py,.js", "--findings", f"{tmp_path}/f"]) == 0
    assert out.read_text().startswith("# Code Quality Report") and (tmp_path / "f").exists()
    assert cli.main([f"{tree}/none"]) == 1
    assert cli.main([str(tree), "--only", "unused", "--ignore-dirs"]) == 0
    assert "imported but unused" in capsys.readouterr().out


def test_parse_is_one_pass(spark, tree):
    p = parsing.parse(codetree.read_tree(spark, str(tree)))
    plan = p._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") == plan.split("== Physical Plan ==")[0].count("MapInArrow") + 1
    assert {r.file.split("/")[-1]: r.error for r in p.collect()}["bad.py"] == "not parsed"
