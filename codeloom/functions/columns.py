"""Column functions on built-ins only: paths, lexical counts, severities, formats, markers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {f".{e}": name for name, es in (("csharp", "cs"), ("javascript", "js jsx"), ("python", "py"), ("tsx", "tsx"), ("typescript", "ts")) for e in es.split()}
DEFAULT_EXTENSIONS = tuple(sorted(LANGUAGES))
ALWAYS_IGNORED = tuple("ENV env venv .venv".split())
DEFAULT_IGNORED = tuple(".git .idea .next .pytest_cache .venv .vs .vscode ENV __pycache__ bower_components build coverage dist env node_modules vendor venv".split())
#: One lexical token: a run of letters, digits and _, or any other single sign. Java's \w is ASCII, hence the classes.
LEXEME = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
SEVERITIES = (("Critical \U0001f534", 4), ("High \U0001f7e0", 3), ("Medium \U0001f7e1", 2), ("Low \U0001f7e2", 1), ("None", 0))
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
MARKERS = "|".join(w.replace("-", r"[\s_-]?") for w in "BUG FIX-ME HACK NOTE OPTIMIZE REVIEW TBD TEMP TO-DO TO-FIX WARNING XXX".split())

#: A marker in a comment, and the text after it.
COMMENT_MARKER = rf"(?:[#*/\s]|^)\b({MARKERS})\b\s*:?\s*(.*)"


def normalised_extensions(given: str | Iterable[str] | None) -> tuple[str, ...]:
    """Extensions with their dots; a string is split at commas, None means all known ones."""
    if given is None:
        return DEFAULT_EXTENSIONS
    parts = given.split(",") if isinstance(given, str) else list(given)
    return tuple(sorted({p if p.startswith(".") else f".{p}" for p in (p.strip() for p in parts) if p}))


def ignored_names(extra: Iterable[str] | None = None) -> tuple[str, ...]:
    return tuple(sorted({*ALWAYS_IGNORED, *(extra or ())}))


def extension(path: Column) -> Column:
    """The last suffix of the file name with its dot, or an empty string."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1)


def language(path: Column) -> Column:
    ext = F.lower(extension(path))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for e, name in LANGUAGES.items():
        out = out.when(ext == e, F.lit(name))
    return out


def in_ignored(path: Column, names: Iterable[str]) -> Column:
    """Whether any component of the path, the file name included, is one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def under_any(path: Column, folders: Iterable[str]) -> Column:
    """Whether the absolute path is one of the folders or lies below one."""
    out = F.lit(False)
    for f in folders:
        f = f.rstrip("/") or "/"
        out = out | (path == f) | F.startswith(path, F.lit(f if f == "/" else f + "/"))
    return out


def lexical_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(LEXEME)), F.lit(0))


def lexemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LEXEME), F.lit(0))


def content_hash(raw: Column) -> Column:
    """SHA-256 in hexadecimal; null for null, as for a file that can't be read."""
    return F.sha2(raw, 256)


def severity(value: Column, threshold: Column | float) -> Column:
    """Grade of value / threshold: 3, 2, 1.5 and 1 are the steps; null, negative or a threshold of 0 give "None"."""
    t = (threshold if isinstance(threshold, Column) else F.lit(threshold)).cast("double")
    ratio = F.when((t > 0) & (value >= 0), value.cast("double") / F.when(t > 0, t))
    (critical, _), (high, _), (medium, _), (low, _), (none, _) = SEVERITIES
    return F.when(ratio >= 3, critical).when(ratio >= 2, high).when(ratio >= 1.5, medium).when(ratio >= 1, low).otherwise(none)


def severity_rank(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for s, rank in SEVERITIES:
        out = out.when(name == s, F.lit(rank))
    return out.otherwise(F.lit(0))


def path_text(file: Column, line: Column | None = None, mode: str = "plain") -> Column:
    """file:line plain, as a Markdown link, or as a terminal hyperlink; without line, or where it is null, only the file."""
    if mode not in ("plain", "markdown", "terminal"):
        raise ValueError("mode is plain, markdown or terminal")
    bare = file if line is None else F.when(line.isNull(), file).otherwise(F.concat(file, F.lit(":"), line.cast("string")))
    anchor = file if line is None else F.when(line.isNull(), file).otherwise(F.concat(file, F.lit("#L"), line.cast("string")))
    if mode == "markdown":
        return F.concat(F.lit("["), bare, F.lit("]("), anchor, F.lit(")"))
    if mode == "terminal":
        return F.concat(F.lit("\x1b]8;;file://"), anchor, F.lit("\x1b\\"), bare, F.lit("\x1b]8;;\x1b\\"))
    return bare


def snippet(tokens: Column, most: int = 10) -> Column:
    return F.concat(F.array_join(F.slice(tokens, 1, most), " "), F.when(F.size(tokens) > most, F.lit(" ...")).otherwise(F.lit("")))


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(content: Column) -> Column:
    """Array of lines, split at every Unicode line boundary, without an empty last one."""
    parts = F.split(content, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def hash_marker(line: Column) -> tuple[Column, Column]:
    """Kind and text of the first marker after a # in the line; an empty kind if there is none."""
    pattern = rf"(?iU)#.*?({MARKERS})(:|\b)(.*)"
    return F.upper(stripped(F.regexp_extract(line, pattern, 1))), stripped(F.regexp_extract(line, pattern, 3))


def comment_marker(comment: Column) -> tuple[Column, Column]:
    """Kind and text of the first marker in a comment that stands as a word of its own."""
    pattern = f"(?iU){COMMENT_MARKER}"
    return F.upper(stripped(F.regexp_extract(comment, pattern, 1))), stripped(F.regexp_extract(comment, pattern, 2))


def finding_fields(line: Column, codes: str = r"[A-Z]+\d+") -> dict[str, Column]:
    """file, line, code and message of a line such as `a.py:3:1: F401 'os' imported but unused`; all null if it isn't one."""
    pattern = rf"^(.*?):([0-9]+):[0-9]+:\s+({codes})\s+(.*)$"
    found = F.regexp_extract(line, pattern, 3) != ""
    part = lambda i: F.when(found, F.regexp_extract(line, pattern, i))
    return {"file": part(1), "line": part(2).cast("int"), "code": part(3), "message": stripped(part(4))}
