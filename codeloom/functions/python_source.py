"""Python front end: token counts, blocks, complexity, unused names and lint rules of one source text.

Plain functions on standard-library parsers; a text that doesn't parse yields nothing.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

_FAILURES = (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError, UnicodeError)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


_fields: dict[type, tuple[str, ...]] = {}


def _children(node: ast.AST) -> list[ast.AST]:
    """Child nodes in order, without operators and contexts, which no rule looks at."""
    kind = type(node)
    names = _fields.get(kind)
    if names is None:
        names = _fields[kind] = tuple(f for f in kind._fields if f not in ("ctx", "op", "ops"))
    out = []
    for name in names:
        value = getattr(node, name, None)
        if isinstance(value, list):
            out += [v for v in value if isinstance(v, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


def _walk(node: ast.AST) -> list[ast.AST]:
    """The node and all below, breadth first."""
    out = [node]
    for inner in out:
        out += _children(inner)
    return out


def parse(content: str | None) -> ast.Module | None:
    try:
        return None if content is None else ast.parse(content)
    except _FAILURES:
        return None


def token_count(raw: bytes | None) -> int:
    """Lexical tokens, layout and comments included; 0 if the text can't be tokenised."""
    try:
        return sum(t.type not in (tokenize.ENCODING, tokenize.ENDMARKER) for t in tokenize.tokenize(io.BytesIO(raw or b"").readline))
    except _FAILURES:
        return 0


def blocks(tree: ast.Module | None) -> list[dict]:
    """Functions (not async ones) and classes at any depth, breadth first; tokens are the name and all names and constants inside."""
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "function"}
    found = [d for d in _walk(tree) if type(d) in kinds] if tree else []
    return [{"type": kinds[type(d)], "name": d.name, "start_line": d.lineno, "end_line": d.end_lineno, "tokens": [d.name, *_words(d)]} for d in found]


def _words(definition: ast.stmt) -> Iterator[str]:
    for inner in _walk(definition):
        match inner:
            case ast.Name(id=name):
                yield name
            case ast.Constant(value=value):
                yield str(value)


class _Branches(ast.NodeVisitor):
    """Branches of a statement, without those of functions and classes inside it, which are gathered."""

    def __init__(self) -> None:
        self.count, self.functions, self.classes = 0, [], []

    def visit(self, node: ast.AST) -> None:
        if isinstance(node, _FUNCTIONS):
            self.functions.append(node)
            return
        if isinstance(node, ast.ClassDef):
            self.classes.append(node)
            return
        match node:
            case ast.If() | ast.IfExp():
                self.count += 1
            case ast.For() | ast.AsyncFor() | ast.While():
                self.count += 1 + bool(node.orelse)
            case ast.Try() | ast.TryStar():
                self.count += len(node.handlers) + bool(node.orelse)
            case ast.BoolOp():
                self.count += len(node.values) - 1
            case ast.comprehension():
                self.count += 1 + len(node.ifs)
            case ast.Match():
                self.count += sum(not (isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None) for c in node.cases)
            case ast.Assert():
                self.count += 1
                return
        self.generic_visit(node)


def _branches(body: list[ast.stmt]) -> _Branches:
    b = _Branches()
    for statement in body:
        b.visit(statement)
    return b


def complexity(tree: ast.Module | None) -> list[dict]:
    """Functions, classes and methods with cyclomatic complexity. A function is 1 plus its branches, nested
    functions apart; a class with methods averages 1, its own branches and, for each method, 1 plus its complexity."""
    out: list[dict] = []

    def entry(node: ast.stmt, value: int) -> dict:
        return {"name": node.name, "complexity": value, "lineno": node.lineno, "endline": node.end_lineno}

    def of_class(node: ast.ClassDef) -> None:
        own = _branches(node.body)
        methods = [entry(f, 1 + _branches(f.body).count) for f in own.functions]
        total = 1 + own.count + sum(1 + m["complexity"] for m in methods)
        out.append(entry(node, total // len(methods) if methods else total))
        out.extend(methods)

    if tree:
        top = _branches(tree.body)
        out += [entry(f, 1 + _branches(f.body).count) for f in top.functions]
        for c in top.classes:
            of_class(c)
    return out


def _finding(line: int, code: str, message: str) -> dict:
    return {"line": line, "code": code, "message": message}


_NOQA = re.compile(r"(?i)#\s*noqa(?::[\s]?(?P<codes>[A-Z][0-9]+(?:[,\s]+[A-Z][0-9]+)*))?")


def without_noqa(findings: list[dict], content: str | None) -> list[dict]:
    """Findings, but for those on a line with a `noqa` comment that names no code or the beginning of theirs."""
    if not findings or not content or "noqa" not in content.lower():
        return findings
    lines = re.split("\r\n|[\n\r]", content)

    def stays(f: dict) -> bool:
        m = _NOQA.search(lines[f["line"] - 1]) if 0 < f["line"] <= len(lines) else None
        return not m or (m["codes"] is not None and not f["code"].startswith(tuple(re.split(r"[,\s]+", m["codes"].upper()))))

    return [f for f in findings if stays(f)]


def _own_nodes(function: ast.AST) -> Iterator[ast.AST]:
    """Nodes of a function's own scope."""
    todo = _children(function)[::-1]
    while todo:
        node = todo.pop()
        yield node
        if not isinstance(node, (*_FUNCTIONS, ast.ClassDef, ast.Lambda)):
            todo += _children(node)[::-1]


class _Scope:
    """Names that a module, class or function binds, reads and imports."""

    def __init__(self, parent: _Scope | None, is_class: bool = False):
        self.parent, self.is_class = parent, is_class
        self.bound: set[str] = set()
        self.reads: set[str] = set()
        self.outside: dict[str, bool] = {}  # names declared global (True) or nonlocal
        self.imports: list[tuple[str, int, str]] = []
        self.used: set[str] = set()

    def resolve(self, name: str, own: bool = True) -> None:
        """Marks the name as used in the scope that binds it."""
        scope: _Scope | None = self
        if name in self.outside:
            own = False
            while self.outside[name] and scope.parent:
                scope = scope.parent
                own = True
        while scope:
            if name in scope.bound and (own or scope is not self) and (scope is self or not scope.is_class):
                scope.used.add(name)
                return
            scope = scope.parent


def _scopes(tree: ast.Module) -> list[_Scope]:
    top = _Scope(None)
    found, todo = [top], [(node, top) for node in tree.body]
    while todo:
        node, scope = todo.pop()
        inner = scope
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.Lambda():
                inner = _Scope(scope)
                found.append(inner)
                args = node.args
                given = [*args.posonlyargs, *args.args, *args.kwonlyargs, *(a for a in (args.vararg, args.kwarg) if a)]
                inner.bound |= {a.arg for a in given}
                outer = [*args.defaults, *(d for d in args.kw_defaults if d), *(a.annotation for a in given if a.annotation)]
                if isinstance(node, ast.Lambda):
                    todo.append((node.body, inner))
                else:
                    scope.bound.add(node.name)
                    outer += [*node.decorator_list, *([node.returns] if node.returns else [])]
                    todo += [(n, inner) for n in node.body]
                todo += [(n, scope) for n in outer]
                continue
            case ast.ClassDef():
                scope.bound.add(node.name)
                inner = _Scope(scope, True)
                found.append(inner)
                todo += [(n, scope) for n in (*node.decorator_list, *node.bases, *(k.value for k in node.keywords))] + [(n, inner) for n in node.body]
                continue
            case ast.Import() | ast.ImportFrom():
                module = "." * (getattr(node, "level", 0) or 0) + (getattr(node, "module", None) or "")
                for alias in node.names if module != "__future__" else ():
                    bound = alias.asname or (alias.name.split(".")[0] if isinstance(node, ast.Import) else alias.name)
                    full = f"{module}{'' if module.endswith('.') or not module else '.'}{alias.name}"
                    scope.bound.add(bound)
                    if alias.name != "*":
                        scope.imports.append((bound, node.lineno, f"{full} as {alias.asname}" if alias.asname and alias.asname != alias.name else full))
            case ast.Global() | ast.Nonlocal():
                scope.outside |= dict.fromkeys(node.names, isinstance(node, ast.Global))
            case ast.Name():
                (scope.bound if isinstance(node.ctx, ast.Store) else scope.reads).add(node.id)
            case ast.ExceptHandler(name=str() as name):
                scope.bound.add(name)
        todo += [(n, inner) for n in _children(node)]
    for scope in found:
        scope.bound -= scope.outside.keys()
    for scope in found:
        for name in scope.reads:
            scope.resolve(name)
    return found


def unused(tree: ast.Module | None) -> list[dict]:
    """Imports never used in their scope or one inside it (F401; those of a class body are attributes) and plain local names assigned but never read in their function (F841)."""
    if not tree:
        return []
    named: set[str] = set()
    for node in _walk(tree):  # names listed for export, and in annotations written as strings
        if isinstance(node, (ast.Assign, ast.AugAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets):
                named |= {c.value for c in _walk(node.value) if isinstance(c, ast.Constant) and isinstance(c.value, str)}
        notes = [a for a in (getattr(node, "annotation", None), getattr(node, "returns", None)) if a is not None]
        for c in (c for a in notes for c in _walk(a) if isinstance(c, ast.Constant) and isinstance(c.value, str)):
            named |= set(re.findall(r"[^\W\d]\w*", c.value))
    out = [_finding(line, "F401", f"'{label}' imported but unused") for s in _scopes(tree) if not s.is_class for bound, line, label in s.imports if bound not in s.used | named]
    for node in _walk(tree):
        if isinstance(node, _FUNCTIONS):
            out += _unused_locals(node)
    return sorted(out, key=lambda f: (f["line"], f["code"], f["message"]))


def _unused_locals(function: ast.AST) -> list[dict]:
    inside = _walk(function)
    read = {n.id for n in inside if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Store)}
    if "locals" in read:
        return []
    outer = {name for n in inside if isinstance(n, (ast.Global, ast.Nonlocal)) for name in n.names}
    bound: dict[str, int] = {}
    for node in _own_nodes(function):
        names: list[tuple[str, int]] = []
        if isinstance(node, ast.Assign):
            names = [(t.id, t.lineno) for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, (ast.AnnAssign, ast.NamedExpr)) and node.value is not None and isinstance(node.target, ast.Name):
            names = [(node.target.id, node.target.lineno)]
        elif isinstance(node, ast.withitem) and isinstance(node.optional_vars, ast.Name):
            names = [(node.optional_vars.id, node.optional_vars.lineno)]
        elif isinstance(node, ast.ExceptHandler) and node.name:
            names = [(node.name, node.lineno)]
        bound |= dict(names)
    return [_finding(line, "F841", f"local variable '{name}' is assigned to but never used") for name, line in bound.items() if name not in read | outer]


_MUTABLE_CALLS = {"list", "dict", "set", "defaultdict", "OrderedDict", "Counter", "deque", "bytearray"}
_UNSAFE_CALLS = {
    "eval": ("S307", "Use of a possibly insecure function: eval"),
    "exec": ("S102", "Use of exec"),
    "os.system": ("S605", "Starting a process with a shell"),
    "os.popen": ("S605", "Starting a process with a shell"),
    "pickle.load": ("S301", "Unpickling untrusted data can run code"),
    "pickle.loads": ("S301", "Unpickling untrusted data can run code"),
    "marshal.loads": ("S302", "Unmarshalling untrusted data"),
    "tempfile.mktemp": ("S306", "Use of an insecure temporary file name"),
    "hashlib.md5": ("S324", "Use of a weak hash function: md5"),
    "hashlib.sha1": ("S324", "Use of a weak hash function: sha1"),
    "ssl._create_unverified_context": ("S323", "Certificates aren't verified"),
} | {f"random.{f}": ("S311", "Pseudo-random generators aren't fit for secrets") for f in ("random", "randint", "randrange", "choice", "choices", "uniform")}
_PROCESS_CALLS = {f"subprocess.{f}" for f in ("run", "call", "check_call", "check_output", "Popen")}
_RISKY_IMPORTS = {"telnetlib": "S401", "ftplib": "S402", "pickle": "S403", "subprocess": "S404", "xml.etree": "S405", "xml.sax": "S406"}
#: Nodes that a rule is about.
_RULED = (*_FUNCTIONS, ast.Lambda, ast.Call, ast.Assert, ast.ExceptHandler, ast.Try, ast.For, ast.Expr, ast.Assign, ast.AnnAssign, ast.Import, ast.ImportFrom, ast.Constant, ast.JoinedStr, ast.BinOp)
_PASSWORD = re.compile(r"(?i)(^|_)(pass(wd|word|phrase)?|pwd|secret|token)(_|$)")
_SQL = re.compile(r"(?is)^\s*(select\s.*\sfrom\s|insert\s+into\s|delete\s+from\s|update\s.*\sset\s)")
_NOT_CODE = re.compile(r"(?i)^(!|noqa|type:|pylint|pragma|fmt:|isort|mypy|coding|-\*-|todo|fixme|note|https?:)")


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else ""


def lint(tree: ast.Module | None, raw: bytes | None) -> list[dict]:
    """Findings of the rule catalogue: likely bugs (B), security (S), commented-out code (E800)."""
    if not tree:
        return []
    out: list[dict] = []
    for node in _walk(tree):
        if isinstance(node, _RULED):
            out += _rules(node)
    out += _dead_comments(raw)
    return sorted(out, key=lambda f: (f["line"], f["code"], f["message"]))


def _rules(node: ast.AST) -> Iterator[dict]:
    line = getattr(node, "lineno", 0)
    if isinstance(node, (*_FUNCTIONS, ast.Lambda)):
        for default in [*node.args.defaults, *(d for d in node.args.kw_defaults if d is not None)]:
            called = _dotted(default.func).split(".")[-1] if isinstance(default, ast.Call) else ""
            if isinstance(default, (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp)) or called in _MUTABLE_CALLS:
                yield _finding(default.lineno, "B006", "Do not use mutable data structures for argument defaults")
            elif isinstance(default, ast.Call) and called not in {"tuple", "frozenset", "int", "str", "float", "bool", "bytes"}:
                yield _finding(default.lineno, "B008", "Do not perform function calls in argument defaults")
    match node:
        case ast.Call():
            name = _dotted(node.func)
            given = {k.arg: k.value for k in node.keywords}
            if name in _UNSAFE_CALLS:
                yield _finding(line, *_UNSAFE_CALLS[name])
            if name in _PROCESS_CALLS:
                shell = given.get("shell")
                yield _finding(line, "S602", "A subprocess runs in a shell") if isinstance(shell, ast.Constant) and shell.value else _finding(line, "S603", "Check the input of a subprocess")
            if name == "yaml.load" and not any("Safe" in _dotted(a) for a in [*node.args[1:], *given.values()]):
                yield _finding(line, "S506", "Use a safe loader for YAML")
            if name.startswith(("requests.", "httpx.")) and isinstance(given.get("verify"), ast.Constant) and given["verify"].value is False:
                yield _finding(line, "S501", "Certificates aren't verified")
            if name in {"getattr", "setattr"} and len(node.args) == (2 if name == "getattr" else 3) and isinstance(node.args[1], ast.Constant) and str(node.args[1].value).isidentifier():
                yield _finding(line, "B009" if name == "getattr" else "B010", f"Do not call {name} with a constant attribute name")
            for key, value in given.items():
                if key and _PASSWORD.search(key) and isinstance(value, ast.Constant) and isinstance(value.value, str) and value.value:
                    yield _finding(line, "S106", f"Possible hardcoded password: {key}")
        case ast.Assert():
            yield _finding(line, "S101", "Use of assert")
            if isinstance(node.test, ast.Constant) and node.test.value is False:
                yield _finding(line, "B011", "Do not assert False; raise AssertionError")
        case ast.ExceptHandler():
            if node.type is None:
                yield _finding(line, "B001", "Do not use a bare except")
            if len(node.body) == 1 and isinstance(node.body[0], ast.Pass):
                yield _finding(line, "S110", "An exception is swallowed by pass")
            if len(node.body) == 1 and isinstance(node.body[0], ast.Continue):
                yield _finding(line, "S112", "An exception is swallowed by continue")
            for inner in _own_nodes(node):
                if isinstance(inner, ast.Raise) and inner.exc is not None and inner.cause is None and not isinstance(inner.exc, ast.Name):
                    yield _finding(inner.lineno, "B904", "Within an except clause, raise with from")
        case ast.Try() if any(isinstance(n, (ast.Return, ast.Break, ast.Continue)) for s in node.finalbody for n in [s, *_own_nodes(s)]):
            yield _finding(line, "B012", "return, break or continue inside finally silences exceptions")
        case ast.For() if isinstance(node.target, ast.Name) and not node.target.id.startswith("_") and not any(isinstance(n, ast.Name) and n.id == node.target.id for s in node.body for n in _walk(s)):
            yield _finding(line, "B007", f"Loop control variable '{node.target.id}' not used within the loop body")
        case ast.Expr():
            if isinstance(node.value, ast.Compare):
                yield _finding(line, "B015", "Pointless comparison")
            elif isinstance(node.value, (ast.List, ast.Set, ast.Dict, ast.Tuple)) or (isinstance(node.value, ast.Constant) and not isinstance(node.value.value, (str, type(...)))):
                yield _finding(line, "B018", "Useless expression")
        case ast.Assign() | ast.AnnAssign():
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            value = node.value
            if isinstance(value, ast.Constant) and isinstance(value.value, str) and value.value:
                for t in targets:
                    name = _dotted(t).split(".")[-1]
                    if name and _PASSWORD.search(name):
                        yield _finding(line, "S105", f"Possible hardcoded password: {name}")
        case ast.Import():
            for a in node.names:
                for module, code in _RISKY_IMPORTS.items():
                    if a.name == module or a.name.startswith(module + "."):
                        yield _finding(line, code, f"Consider security when using {module}")
        case ast.ImportFrom() if node.module:
            for module, code in _RISKY_IMPORTS.items():
                if node.module == module or node.module.startswith(module + "."):
                    yield _finding(line, code, f"Consider security when using {module}")
        case ast.Constant() if node.value == "0.0.0.0":
            yield _finding(line, "S104", "Possible binding to all interfaces")
        case ast.JoinedStr() if any(isinstance(v, ast.FormattedValue) for v in node.values) and _SQL.match("".join(str(v.value) if isinstance(v, ast.Constant) else " x " for v in node.values)):
            yield _finding(line, "S608", "Possible SQL injection through string building")
        case ast.BinOp(op=ast.Add() | ast.Mod(), left=ast.Constant(value=str() as text)) if _SQL.match(text + " "):
            yield _finding(line, "S608", "Possible SQL injection through string building")


def _dead_comments(raw: bytes | None) -> Iterator[dict]:
    try:
        comments = [t for t in tokenize.tokenize(io.BytesIO(raw or b"").readline) if t.type == tokenize.COMMENT]
    except _FAILURES:
        return
    for t in comments:
        text = t.string.lstrip("#").strip()
        if not text or _NOT_CODE.match(text):
            continue
        try:
            body = ast.parse(text if not text.endswith(":") else text + " pass").body
        except _FAILURES:
            continue
        plain = (ast.Name, ast.Constant, ast.Tuple, ast.Attribute, ast.BinOp, ast.UnaryOp, ast.Compare, ast.BoolOp, ast.Subscript, ast.List)
        if body and not all((isinstance(s, ast.Expr) and isinstance(s.value, plain)) or (isinstance(s, ast.AnnAssign) and s.value is None) for s in body):
            yield _finding(t.start[0], "E800", "Found commented out code")
