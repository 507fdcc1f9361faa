"""Front end for JavaScript, TypeScript, TSX and C#: one lexer, then blocks, complexity and comments from tokens.

Braces are matched on the token stream, so no grammar is needed; lines and columns are of
characters. What a lexer can't tell for sure (a regular expression from a division, a
conditional from a nullable type) is settled by the token before.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_ECMA_KEYWORDS = set(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if implements import in instanceof interface let new null package private protected public return static super switch this throw true try typeof undefined var void while with yield async of get set abstract as declare from is keyof module namespace never readonly require type".split()
)
#: Words that are keywords in some places only, and ordinary names elsewhere.
_SOFT = {"async", "of", "get", "set", "abstract", "as", "declare", "from", "is", "keyof", "module", "namespace", "readonly", "require", "type"}
_TS_TYPES = {"string", "number", "boolean", "any", "void", "unknown", "never", "object", "symbol", "bigint"}
_CS_KEYWORDS = set(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)
_CONTROL = {"if", "for", "while", "switch", "catch", "function", "with", "foreach", "lock", "using", "fixed", "return", "await", "typeof", "new", "when", "sizeof", "nameof", "super", "import", "do", "else"}
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_OPERATORS = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|->|.", re.S)
_WORD = re.compile(r"[^\W\d][\w$]*|[$@#]+[\w$]+")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[a-zA-Z]*")
_ECMA_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BLANK = re.compile(r"\s+")
_RAW_STRING = re.compile(r'(\$*)"""+')
_VERBATIM = re.compile(r'(?:\$?@|@\$)"')
LANGUAGES = ("javascript", "typescript", "tsx", "csharp")


@dataclass(slots=True)
class Token:
    kind: str  # word, number, string, template, regex, operator
    text: str
    line: int


def lex(text: str, language: str) -> tuple[list[Token], list[tuple[int, str]]]:
    """Tokens, and comments with the lines they start on."""
    tokens: list[Token] = []
    comments: list[tuple[int, str]] = []
    sharp = language == "csharp"
    i, line, n = 0, 1, len(text)

    def string_end(at: int, quote: str, many_lines: bool) -> int:
        while at < n:
            if text[at] == "\\":
                at += 2
            elif text[at] == quote:
                return at + 1
            elif text[at] == "\n" and not many_lines:
                return -1
            else:
                at += 1
        return n if many_lines else -1

    def template_end(at: int) -> int:
        while at < n:
            if text[at] == "\\":
                at += 2
            elif text[at] == "`":
                return at + 1
            elif text.startswith("${", at):
                depth, at = 1, at + 2
                while at < n and depth:
                    c = text[at]
                    if c == "`":
                        at = template_end(at + 1)
                        continue
                    if c in "\"'":
                        end = string_end(at + 1, c, False)
                        at = end if end > 0 else at + 1
                        continue
                    depth += (c == "{") - (c == "}")
                    at += 1
            else:
                at += 1
        return n

    while i < n:
        c = text[i]
        if c.isalpha() or c == "_":  # most tokens are words
            end = _WORD.match(text, i).end()
            tokens.append(Token("word", text[i:end], line))
            i = end
            continue
        if c.isspace():
            end = _BLANK.match(text, i).end()
            line += text.count("\n", i, end)
            i = end
            continue
        end, kind = -1, ""
        if c == "/" and text.startswith("//", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            comments.append((line, text[i:end]))
            i = end
            continue
        if c == "/" and text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            comments.append((line, text[i:end]))
            line += text.count("\n", i, end)
            i = end
            continue
        if sharp and c == "#" and not text[text.rfind("\n", 0, i) + 1 : i].strip():
            end = text.find("\n", i)
            i = n if end < 0 else end
            continue
        quoted = sharp and c in "\"$@"
        if quoted and (m := _RAW_STRING.match(text, i)):
            close = '"' * (len(m[0]) - len(m[1]))
            end = text.find(close, m.end())
            end, kind = (n if end < 0 else end + len(close)), "string"
        elif quoted and (m := _VERBATIM.match(text, i)):
            end, kind = m.end(), "string"
            while end < n and not (text[end] == '"' and not text.startswith('""', end)):
                end += 2 if text.startswith('""', end) else 1
            end = min(n, end + 1)
        elif quoted and text.startswith('$"', i):
            end, kind = string_end(i + 2, '"', False), "string"
        elif c in "\"'":
            end, kind = string_end(i + 1, c, False), "string"
        elif c == "`" and not sharp:
            end, kind = template_end(i + 1), "template"
        elif c == "/" and not sharp and _starts_regex(tokens) and (m := _ECMA_REGEX.match(text, i)):
            end, kind = m.end(), "regex"
        elif m := _WORD.match(text, i):
            end, kind = m.end(), "word"
        elif (c.isdigit() or (c == "." and text[i + 1 : i + 2].isdigit())) and (m := _NUMBER.match(text, i)):
            end, kind = m.end(), "number"
        if end < 0:
            m = _OPERATORS.match(text, i)
            end, kind = m.end(), "operator"
        tokens.append(Token(kind, text[i:end], line))
        if kind in ("string", "template"):
            line += text.count("\n", i, end)
        i = end
    return tokens, comments


def _starts_regex(tokens: list[Token]) -> bool:
    if not tokens:
        return True
    t = tokens[-1]
    return t.text in _BEFORE_REGEX if t.kind == "word" else t.kind == "operator" and t.text not in {")", "]", "}", "<"}


def _pairs(tokens: list[Token]) -> dict[int, int]:
    """The closing position of each opening bracket, and the other way round; unmatched ones have none."""
    out: dict[int, int] = {}
    stack: list[int] = []
    closes = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(tokens):
        if t.kind != "operator":
            continue
        if t.text in "([{":
            stack.append(i)
        elif t.text in closes:
            while stack and tokens[stack[-1]].text != closes[t.text]:
                stack.pop()
            if stack:
                j = stack.pop()
                out[i], out[j] = j, i
    return out


class Source:
    """One text: its tokens, matched brackets and comments."""

    def __init__(self, text: str, language: str):
        self.language = language
        self._functions: list[dict] | None = None
        self.sharp = language == "csharp"
        self.tokens, self.comments = lex(text, language)
        self.pairs = _pairs(self.tokens)
        self.keywords = _CS_KEYWORDS if self.sharp else _ECMA_KEYWORDS - _SOFT
        self.within: list[int] = []  # of each token the innermost open brace, or -1
        open_ = [-1]
        for i, t in enumerate(self.tokens):
            if t.text == "}" and self.pairs.get(i) == open_[-1]:
                open_.pop()
            self.within.append(open_[-1])
            if t.text == "{" and t.kind == "operator" and i in self.pairs:
                open_.append(i)

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word" and self.text(i) not in self.keywords

    def leaves(self, begin: int, end: int) -> list[str]:
        """Identifiers, and outside C# strings and numbers, of tokens begin .. end."""
        out = []
        for i in range(begin, end + 1):
            t = self.tokens[i]
            if t.kind == "word" and t.text not in self.keywords:
                if not self.sharp and t.text in _SOFT and (self.tokens[i + 1 : i + 2] and self.tokens[i + 1].kind in ("word", "string") or (t.text == "async" and self.text(i + 1) == "(")):
                    continue  # a keyword here
                if self.language in ("typescript", "tsx") and t.text in _TS_TYPES and self.text(i - 1) in {":", "<", "|", "&", "as", "=", "=>"}:
                    continue
                out.append(t.text)
            elif not self.sharp and t.kind in ("string", "number"):
                out.append(t.text)
        return [t for t in out if t.strip()]

    def body_after(self, i: int) -> tuple[int, int] | None:
        """The braces of a body that follows a parameter list closed at i, past a return type, constraints or initialisers."""
        j = i + 1
        while j < len(self.tokens):
            t = self.text(j)
            if t == "{":
                if self.text(j - 1) in {":", "|", "&"} and not self.sharp and j in self.pairs:  # a type in braces
                    j = self.pairs[j] + 1
                    continue
                return (j, self.pairs[j]) if j in self.pairs else None
            if t in {";", "}", "=>", "=", ")"} or (j == i + 1 and t not in {":", "where"}):
                return None
            j = self.pairs[j] + 1 if t in {"(", "["} and j in self.pairs else j + 1
        return None

    def functions(self) -> list[dict]:
        """All functions with a body: name, first and last token, body, and whether a declaration, method, expression, arrow or constructor."""
        if self._functions is None:
            self._functions = self._find_functions()
        return self._functions

    def _find_functions(self) -> list[dict]:
        out = []
        for i in range(len(self.tokens)):
            t = self.tokens[i]
            if t.text == "function" and t.kind == "word" and not self.sharp:
                j = i + 1 + (self.text(i + 1) == "*")
                name = self.text(j) if self.is_name(j) else ""
                j += bool(name)
                j = self._past_generics(j)
                if self.text(j) == "(" and j in self.pairs and (body := self.body_after(self.pairs[j])):
                    begin = i - (self.text(i - 1) == "async")
                    before = self.text(begin - 1)
                    stands = before in {"", ";", "{", "}", "export", "default", ")"} or (begin > 0 and self.tokens[begin - 1].line < t.line and before not in {"=", "(", ",", ":", "=>", "return", "?", "&&", "||", "[", "!", "+"})
                    out.append({"name": name or self._assigned(begin), "begin": begin, "end": body[1], "body": body, "kind": "declaration" if name and stands else "expression"})
            elif t.text == "=>" and not self.sharp and self.text(i + 1) == "{" and i + 1 in self.pairs:
                k = i - 1
                while k > 0 and self.text(k) != ")" and self.text(k) != ":" and (self.tokens[k].kind in ("word", "string") or self.text(k) in {".", "<", ">", "[", "]", "|", "&", ",", "?"}):
                    k -= 1  # back over a return type
                k = k - 1 if self.text(k) == ":" and self.text(k - 1) == ")" else i - 1
                begin = self.pairs.get(k, k) if self.text(k) == ")" else k
                begin -= self.text(begin - 1) == "async"
                out.append({"name": self._assigned(begin), "begin": begin, "end": self.pairs[i + 1], "body": (i + 1, self.pairs[i + 1]), "kind": "arrow"})
            elif (self.is_name(i) or (t.kind == "word" and self.text(i) in _SOFT) or (t.kind == "string" and not self.sharp)) and t.text not in _CONTROL:
                j = self._past_generics(i + 1)
                if self.text(j) != "(" or j not in self.pairs or self.text(i - 1) in {"function", "new", ".", "?."}:
                    continue
                close = self.pairs[j]
                if self.sharp:
                    found = self._sharp_method(i, close)
                else:
                    found = self._ecma_method(i, close)
                if found:
                    out.append(found)
        return out

    def _ecma_method(self, i: int, close: int) -> dict | None:
        body = self.body_after(close)
        if not body:
            return None
        begin = i
        while self.text(begin - 1) in {"static", "async", "get", "set", "*", "public", "private", "protected", "readonly", "override", "abstract"}:
            begin -= 1
        if self.text(begin - 1) not in {"{", "}", ",", ";", ")"} and not (begin and self.tokens[begin - 1].line < self.tokens[begin].line):
            return None
        if self.text(begin - 1) == ")" and self.tokens[begin - 1].line == self.tokens[begin].line:
            return None
        return {"name": self.text(i).strip("\"'"), "begin": begin, "end": body[1], "body": body, "kind": "method"}

    def _sharp_method(self, i: int, close: int) -> dict | None:
        if self.text(i - 1) in {".", "(", ",", "=", "=>", "return", "?", ":", "&&", "||", "!", "+", "await", "{", "}", ";", "~", "["} and not (self.text(i - 1) in {"{", "}", ";", "]"} and self._in_class(i)):
            return None
        kind = "constructor" if self._in_class(i) == self.text(i) else "method"
        body = self.body_after(close)
        after = close + 1
        while after < len(self.tokens) and self.text(after) not in {"{", "=>", ";", "}", ")"}:
            after += 1
        if not body and self.text(after) not in ({"=>", ";"} if self._in_class(i) else ()):
            return None
        if kind == "method" and not (self.tokens[i - 1].kind == "word" or self.text(i - 1) in {">", "]", "?"}):
            return None
        begin = i
        while begin and self.text(begin - 1) not in {";", "{", "}"}:
            begin -= 1
        end = body[1] if body else after
        if not body and self.text(after) == "=>":
            while end < len(self.tokens) and self.text(end) != ";":
                end = self.pairs.get(end, end) + 1 if self.text(end) in {"(", "{", "["} else end + 1
            end = min(end, len(self.tokens) - 1)
        return {"name": self.text(i), "begin": begin, "end": end, "body": body, "kind": kind}

    def _in_class(self, i: int) -> str:
        """The name of the class, struct, record or interface whose body directly holds token i."""
        self._classes()
        return self._bodies.get(self.within[i], "")

    def _classes(self) -> list[tuple[str, int, tuple[int, int]]]:
        if not hasattr(self, "_class_list"):
            words = {"class", "struct", "interface", "record"} if self.sharp else {"class"}
            found = []
            for i, t in enumerate(self.tokens):
                if t.kind == "word" and t.text in words and self.text(i - 1) != "." and (self.is_name(i + 1) or self.text(i + 1) in {"{", "extends"}):
                    j = i + 1
                    while j < len(self.tokens) and self.text(j) not in {"{", ";"}:
                        j = self.pairs.get(j, j) + 1 if self.text(j) == "(" else j + 1
                    if j < len(self.tokens) and self.text(j) == "{" and j in self.pairs:
                        found.append((self.text(i + 1) if self.is_name(i + 1) else "", i, (j, self.pairs[j])))
            self._class_list, self._bodies = found, {body[0]: name for name, _, body in reversed(found)}
        return self._class_list

    def _past_generics(self, j: int) -> int:
        if self.text(j) != "<":
            return j
        depth, k = 0, j
        while k < len(self.tokens):
            depth += {"<": 1, ">": -1, ">>": -2}.get(self.text(k), 0)
            if self.text(k) in {";", "{", "}", "(", ")"}:
                return j
            k += 1
            if depth <= 0:
                return k
        return j

    def _assigned(self, begin: int) -> str:
        """The name that an anonymous function is assigned to."""
        if self.text(begin - 1) in {"=", ":"}:
            i = begin - 2
            if self.is_name(i) or (i >= 0 and self.tokens[i].kind == "string"):
                return self.text(i).strip("\"'")
        return "<anonymous>"

    def _statement_end(self, i: int) -> int:
        """The last token of an initialiser or type that starts at i: up to a comma, semicolon or, at the end of a line, where it can't go on."""
        j = i
        while j < len(self.tokens):
            t = self.text(j)
            if t in {"(", "[", "{"} and j in self.pairs:
                j = self.pairs[j] + 1
            elif t in {";", ",", ")", "]", "}"}:
                break
            else:
                j += 1
            if j < len(self.tokens) and self.tokens[j].line > self.tokens[j - 1].line and self.tokens[j].kind == "word" and self.tokens[j - 1].text not in {"=", "=>", "?", ":", "+", "-", "*", "&&", "||", "??", "|", "&", ",", "."}:
                break
        return max(i, j - 1)

    def _block(self, kind: str, begin: int, end: int) -> dict | None:
        leaves = self.leaves(begin, end)
        last = self.tokens[end]
        return {"start_line": self.tokens[begin].line, "end_line": last.line + last.text.count("\n"), "type": kind, "name": leaves[0], "tokens": leaves} if leaves else None

    def blocks(self) -> list[dict]:
        found: list[tuple[int, int, str]] = []
        for name, i, body in self._classes():
            if self.sharp and self.text(i) == "class":
                begin = i
                while begin and self.text(begin - 1) not in {";", "{", "}"}:
                    begin -= 1
                found.append((begin, body[1], "class"))
            elif not self.sharp and name and self.text(i - 1) not in {"=", "(", ",", ":", "return", "=>", "?"}:
                found.append((i - (self.text(i - 1) == "abstract"), body[1], "class"))
        kinds = {"method", "constructor"} if self.sharp else {"declaration", "method"}
        found += [(f["begin"], f["end"], "function") for f in self.functions() if f["kind"] in kinds]
        for i, t in enumerate(self.tokens):
            if t.kind != "word" or self.text(i - 1) == ".":
                continue
            if t.text == "enum" and (self.sharp or self.language != "javascript") and self.is_name(i + 1):
                j = next((j for j in range(i + 2, min(i + 8, len(self.tokens))) if self.text(j) == "{"), 0)
                if j in self.pairs:
                    begin = i
                    while begin and self.text(begin - 1) in {"const", "public", "internal", "private", "protected", "declare"}:
                        begin -= 1
                    found.append((begin, self.pairs[j], "enum"))
            if self.language not in ("typescript", "tsx"):
                continue
            if t.text == "interface" and self.is_name(i + 1):
                j = next((j for j in range(i + 2, len(self.tokens)) if self.text(j) in {"{", ";"}), 0)
                if j in self.pairs:
                    found.append((i, self.pairs[j], "interface"))
            elif t.text == "type" and self.is_name(i + 1) and self.text(self._past_generics(i + 2)) == "=":
                found.append((i, self._statement_end(self._past_generics(i + 2) + 1), "type"))
            elif t.text in {"const", "let", "var"} and self.text(i + 1) != "enum":
                j = i + 1
                while j < len(self.tokens):
                    end = self._statement_end(j)
                    found.append((j, end, "declaration"))
                    if self.text(end + 1) != ",":
                        break
                    j = end + 2
        if self.language == "tsx":
            found += self._jsx()
        found.sort(key=lambda b: (b[0], -b[1]))
        return [b for b in (self._block(kind, begin, min(end, len(self.tokens) - 1)) for begin, end, kind in found) if b]

    def _jsx(self) -> list[tuple[int, int, str]]:
        """Elements with a closing tag."""
        found, stack = [], []
        i = 0
        while i < len(self.tokens):
            if self.text(i) == "<" and self.text(i + 1) == "/" and (self.is_name(i + 2) or self.text(i + 2) == ">"):
                name = self.text(i + 2) if self.is_name(i + 2) else ""
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][1] == name:
                        j = next((j for j in range(i + 2, len(self.tokens)) if self.text(j) == ">"), i + 2)
                        if name:
                            found.append((stack[k][0], j, "jsx"))
                        del stack[k:]
                        break
            elif self.text(i) == "<" and self.tokens[i + 1 : i + 2] and self.tokens[i + 1].kind == "word" and self.text(i - 1) in {"(", "return", "=", "?", ":", "&&", "||", "=>", ",", "{", "}", ">", "[", ""}:
                stack.append((i, self.text(i + 1)))
            i += 1
        return found

    def complexity(self) -> list[dict]:
        """Functions with a body (in C#: methods) and their cyclomatic complexity, nested functions apart outside C#."""
        functions = self.functions()
        values = dict.fromkeys(range(len(functions)), 1)
        if self.sharp:
            before = [0]  # branches in front of each token
            for i in range(len(self.tokens)):
                before.append(before[-1] + self._branch(i))
            for k, f in enumerate(functions):
                if f["body"]:
                    values[k] += before[f["body"][1]] - before[f["body"][0]]
        else:
            order = sorted(range(len(functions)), key=lambda k: (functions[k]["begin"], -functions[k]["end"]))
            open_: list[int] = []  # functions around the token, the innermost last
            at = 0
            for i in range(len(self.tokens)):
                while open_ and functions[open_[-1]]["end"] < i:
                    open_.pop()
                while at < len(order) and functions[order[at]]["begin"] == i:
                    open_.append(order[at])
                    at += 1
                if open_ and functions[open_[-1]]["body"][0] <= i:
                    values[open_[-1]] += self._branch(i)
        kept = [(k, f) for k, f in enumerate(functions) if not self.sharp or f["kind"] == "method"]
        return [{"name": f["name"], "complexity": values[k], "lineno": self.tokens[f["begin"]].line, "endline": self.tokens[f["end"]].line} for k, f in kept]

    def _branch(self, i: int) -> int:
        t = self.tokens[i]
        if t.kind == "word" and self.text(i - 1) not in {".", "?."}:
            if t.text == "while":  # that of do ... while is counted at do
                return int(not (self.text(i - 1) == "}" and self.text(self.pairs.get(i - 1, 0) - 1) == "do"))
            if t.text == "for" and not self.sharp:
                head = range(i + 1, self.pairs.get(i + 1, i + 1))
                return int(not any(self.text(j) in {"in", "of"} for j in head))
            if t.text == "case":
                if not self.sharp:
                    return 1
                j = i + 1
                while j < len(self.tokens) and self.text(j) not in {":", ";"}:
                    if self.text(j) == "when" or (j > i + 1 and self.tokens[j].kind == "word" and self.tokens[j - 1].kind == "word"):
                        return 0  # a pattern
                    j = self.pairs.get(j, j) + 1 if self.text(j) == "(" else j + 1
                return 1
            return int(t.text in {"if", "for", "foreach", "do"} if self.sharp else t.text in {"if", "do"})
        if t.kind == "operator":
            if t.text in {"&&", "||"}:
                return 1
            if t.text == "?":
                return int(self._conditional(i))
        return 0

    def _conditional(self, i: int) -> bool:
        """Whether ? at i has a : of its own before the statement ends."""
        if self.text(i + 1) in {")", ">", ",", ";", "=", "[", "]", "{", ":", "."}:
            return self.text(i + 1) == "["  # an array as the first branch
        j, nested = i + 1, 0
        while j < len(self.tokens):
            t = self.text(j)
            if t in {";", ")", "]", "}", ","}:
                return False
            if t == "?" and self.text(j + 1) not in {")", ">", ",", ";", "="}:
                nested += 1
            elif t == ":":
                if not nested:
                    return True
                nested -= 1
            j = self.pairs.get(j, j) + 1 if t in {"(", "[", "{"} else j + 1
        return False
