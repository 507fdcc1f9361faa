"""Front ends against texts whose results are known by definition."""

import pytest

from codeloom.functions import braces, python_source
from codeloom.functions.frontend import analyse


def py_tokens(source):
    return [b["tokens"] for b in python_source.blocks(python_source.parse(source))]


def test_python_blocks_are_breadth_first():
    tree = python_source.parse("def first():\n    return x + y\n\nclass T:\n    def __init__(self):\n        self.value = 0\n")
    found = [(b["start_line"], b["end_line"], b["tokens"]) for b in python_source.blocks(tree)]
    assert found == [(1, 2, ["first", "x", "y"]), (4, 6, ["T", "0", "self"]), (5, 6, ["__init__", "0", "self"])]


def test_python_block_tokens_include_decorators_and_annotations():
    assert py_tokens("@dec(1)\ndef h(a: int = 2) -> str:\n    'doc'\n    return f'{a!r} z'") == [["h", "str", "2", "doc", "dec", "1", "int", " z", "a"]]


@pytest.mark.parametrize("source", ["async def g(): pass", "﻿x = 1", "def (", "", "# only\n", None])
def test_no_python_blocks(source):
    assert py_tokens(source) == []


@pytest.mark.parametrize(("source", "count"), [(b"a = 1\nb = 2\n", 8), (b"a = 1\n" * 100, 400), (b"def f():\n    y = 1\n" * 300, 3600), (b"", 0), ("﻿x=1".encode(), 4), (b"(", 0), (None, 0)])
def test_python_token_count(source, count):
    assert python_source.token_count(source) == count


@pytest.mark.parametrize(
    ("body", "value"),
    [("pass", 1), ("if a: pass\nelif b: pass\nelse: pass", 3), ("for i in a: pass\nelse: pass", 3), ("while a and b or c: pass", 4), ("try: pass\nexcept A: pass\nexcept B: pass", 3), ("x = [i for i in a if i if j]", 4), ("assert a", 2), ("x = 1 if a else 2", 2), ("match a:\n  case 1: pass\n  case _: pass", 2), ("def inner():\n  if a: pass", 1)],
)
def test_python_complexity(body, value):
    source = "def f():\n" + "\n".join("  " + line for line in body.split("\n"))
    assert python_source.complexity(python_source.parse(source))[0]["complexity"] == value


def test_python_classes_and_methods_are_listed():
    found = python_source.complexity(python_source.parse("class A:\n  def m(self):\n    if a: pass\n  def n(self): pass\n"))
    assert [(c["name"], c["complexity"]) for c in found] == [("A", 3), ("m", 2), ("n", 1)]


@pytest.mark.parametrize(
    ("source", "found"),
    [
        ("import os\nx = 1\n", [(1, "F401", "'os' imported but unused")]),
        ("from a import b as c\n", [(1, "F401", "'a.b as c' imported but unused")]),
        ("import sys\nprint(sys.version)\n", []),
        ("from __future__ import annotations\n", []),
        ("import a\n__all__ = ['a']\n", []),
        ("def g(z):\n    x = 1\n    return z\n", [(2, "F841", "local variable 'x' is assigned to but never used")]),
        ("def foo():\n    x, y = 1, 2\n", []),
        ("def foo():\n    x = 1\n    def bar(): return x\n", []),
        ("def foo():\n    global x\n    x = 1\n", []),
        ("def f():\n    import os\ndef g(os):\n    return os\n", [(2, "F401", "'os' imported but unused")]),
        ("import os\ndef g(a=os):\n    return a\n", []),
        ("import os\nclass C:\n    def f(self):\n        return [lambda: os.sep for x in ()]\n", []),
        ("class C:\n    import os\n", []),
        ("import os\ndef f():\n    global os\n    return os\n", []),
        ("def f():\n    import os\n    def g():\n        nonlocal os\n        return os\n    return g\n", []),
        ("import a.b\nimport a.c\nx: 'a' = 1\n", []),
        ("try:\n    import fast\nexcept ImportError:\n    fast = None\n", [(2, "F401", "'fast' imported but unused")]),
        ("def (", []),
    ],
)
def test_unused(source, found):
    assert [(f["line"], f["code"], f["message"]) for f in python_source.unused(python_source.parse(source))] == found


@pytest.mark.parametrize(
    ("source", "codes"),
    [
        ("def g(y=[]):\n    return y\n", ["B006"]), ("def foo(x={}):\n    pass\n", ["B006"]), ("def f():\n    return eval('2+2')\n", ["S307"]), ("import os\nos.system('ls')\n", ["S605"]),
        ("# print('dead code')\n", ["E800"]), ("# x = 1\n", ["E800"]), ("# just a comment\n", []), ("x = 1  # TODO: later\n", []), ("try:\n    a()\nexcept:\n    pass\n", ["B001", "S110"]),
        ("assert False\n", ["B011", "S101"]), ("password = 'abc'\n", ["S105"]), ("import subprocess\nsubprocess.run(x, shell=True)\n", ["S404", "S602"]), ("for i in range(3):\n    print(1)\n", ["B007"]),
        ("q = f'select a from t where x = {y}'\n", ["S608"]), ("x == 1\n", ["B015"]), ("def (", []),
    ],
)
def test_lint(source, codes):
    assert [f["code"] for f in python_source.lint(python_source.parse(source), source.encode())] == codes


def blocks(source, language):
    return [(b["type"], b["name"], b["start_line"], b["end_line"]) for b in braces.Source(source, language).blocks()]


def complexities(source, language):
    return [(c["name"], c["complexity"]) for c in braces.Source(source, language).complexity()]


def test_javascript():
    source = "class K {\n  run(a) {\n    if (a && b) { return /[}/]'/.test(a) ? 1 : 2; }\n    for (const x of a) {}\n    do { a--; } while (a);\n  }\n}\nconst f = function () {};\nfunction g() { return `{${h({})}`; } // }\n"
    assert blocks(source, "javascript") == [("class", "K", 1, 7), ("function", "run", 2, 6), ("function", "g", 9, 9)]
    assert complexities(source, "javascript") == [("run", 5), ("f", 1), ("g", 1)]
    assert braces.Source("function foo() { return 'a b' + 1; }", "javascript").blocks()[0]["tokens"] == ["foo", "'a b'", "1"]


def test_typescript():
    source = "interface A { x: number }\ntype T = { a: string } | null;\nenum E { R }\nconst f = async (x: number): Promise<void> => { if (x) return; };\nclass C<T> extends D {\n  get v(): number { return this.a || 2; }\n}\n"
    assert blocks(source, "typescript") == [("interface", "A", 1, 1), ("type", "T", 2, 2), ("enum", "E", 3, 3), ("declaration", "f", 4, 4), ("class", "C", 5, 7), ("function", "v", 6, 6)]
    assert complexities(source, "typescript") == [("f", 2), ("v", 2)]


def test_tsx_elements():
    assert [b[:2] for b in blocks('const App = () => { return (<div className="x"><B a={1}>it\'s text</B></div>); }', "tsx")] == [("declaration", "App"), ("jsx", "div"), ("jsx", "B")]


def test_csharp():
    source = "public class X {\n  public int Foo(int? a) {\n    foreach (var b in c) { if (b == 1 || b == 2) return 1; }\n    switch (a) { case 1: return 2; case int n when n > 3: return 3; default: return a ?? 0; }\n  }\n  int Bar() => 3;\n  public X(int q) { y = q > 1 ? q : 0; }\n  enum E { A }\n}\n"
    assert blocks(source, "csharp") == [("class", "X", 1, 9), ("function", "Foo", 2, 5), ("function", "Bar", 6, 6), ("function", "X", 7, 7), ("enum", "E", 8, 8)]
    assert complexities(source, "csharp") == [("Foo", 5), ("Bar", 1)]
    assert complexities("class Y { int Goo() { if (true) return 1; else return 2; } }", "csharp") == [("Goo", 2)]


def test_comments_are_not_found_in_strings():
    assert braces.Source('a = "// no"; /* yes\n two */ b = 1 // end', "javascript").comments == [(1, "/* yes\n two */"), (2, "// end")]


def test_failures_are_a_column():
    assert analyse("python", "def (", b"def (")["error"] == "not parsed"
    assert analyse("csharp", None, b"\xff")["blocks"] == []
    assert analyse("javascript", "}}) ]( `", b"")["error"] is None


@pytest.mark.parametrize(("comment", "left"), [("", ["F401"]), ("  # noqa", []), ("  # NOQA: F401", []), ("  # noqa:E501,F4", []), ("  # noqa: B006", ["F401"])])
def test_noqa(comment, left):
    source = f"import os{comment}\n"
    assert [f["code"] for f in analyse("python", source, source.encode())["unused"]] == left


def test_only_what_is_asked_for():
    assert analyse("python", "x = 1\n", b"x = 1\n", ("py_tokens",)) == {"py_tokens": 4, "error": None}
    assert analyse("csharp", "class A { int F() { return 1; } }", None, ("in_blocks",)) == {"in_blocks": 3, "error": None}
    assert analyse("javascript", None, None, ("comments",)) == {"comments": [], "error": None}


def test_many_functions_in_one_file_take_linear_time():
    import time

    source = braces.Source("function f(a) { if (a) { return b.map(x => { return x ? 1 : 2; }); } }\n" * 10_000, "javascript")
    began = time.time()
    found = source.complexity()
    assert len(found) == 20_000 and {c["complexity"] for c in found} == {2} and time.time() - began < 10
