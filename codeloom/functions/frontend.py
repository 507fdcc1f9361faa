"""What parsing one file yields: all of it or some, in one pass over the file."""

from __future__ import annotations

from collections.abc import Collection

from codeloom.functions import braces, python_source

#: What can be asked for: Python's lexical count, the number of tokens in blocks of other languages, blocks, complexity, comments, unused names, lint findings.
OUTPUTS = ("py_tokens", "in_blocks", "blocks", "complexity", "comments", "unused", "lint")
_COUNTS = {"py_tokens", "in_blocks"}


def analyse(language: str | None, content: str | None, raw: bytes | None, outputs: Collection[str] = OUTPUTS) -> dict:
    """The outputs asked for; a failure leaves them empty and is named in error. Findings on a line marked `noqa` are left out."""
    empty = {name: None if name in _COUNTS else [] for name in outputs}
    out = dict(empty, error=None)
    try:
        if language == "python":
            if "py_tokens" in outputs:
                out["py_tokens"] = python_source.token_count(raw)
            if set(outputs) <= _COUNTS:
                return out
            tree = python_source.parse(content)
            if tree is None:
                out["error"] = "not parsed"
            made = {
                "blocks": lambda: python_source.blocks(tree),
                "complexity": lambda: python_source.complexity(tree),
                "unused": lambda: python_source.without_noqa(python_source.unused(tree), content),
                "lint": lambda: python_source.without_noqa(python_source.lint(tree, raw), content),
            }
        elif language in braces.LANGUAGES and content is not None:
            source = braces.Source(content, language)
            made = {
                "blocks": source.blocks,
                "in_blocks": lambda: sum(len(b["tokens"]) for b in source.blocks()),
                "complexity": source.complexity,
                "comments": lambda: [{"line": line, "text": text} for line, text in source.comments],
            }
        else:
            made = {}
        out |= {name: make() for name, make in made.items() if name in outputs}
    except Exception as e:  # one bad file must not fail the job; the error is a column
        out |= empty | {"error": f"{type(e).__name__}: {e}"[:200]}
    return out
