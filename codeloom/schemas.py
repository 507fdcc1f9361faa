"""Schemas of the tables of an analysis."""

FILES = "path string, ext string, language string, content string, bytes binary"
BLOCKS = "array<struct<start_line: int, end_line: int, type: string, name: string, tokens: array<string>>>"
COMPLEXITY = "array<struct<name: string, complexity: int, lineno: int, endline: int>>"
COMMENTS = "array<struct<line: int, text: string>>"
FINDINGS = "array<struct<line: int, code: string, message: string>>"
OUTPUTS = {"py_tokens": "int", "in_blocks": "int", "blocks": BLOCKS, "complexity": COMPLEXITY, "comments": COMMENTS, "unused": FINDINGS, "lint": FINDINGS}


def parsed(outputs=tuple(OUTPUTS)) -> str:
    """The schema of parsed files with these outputs; lexical counts tokens of the text of JavaScript and C# without parsing."""
    return ", ".join(["file string", "language string", "lexical int", *[f"{name} {OUTPUTS[name]}" for name in OUTPUTS if name in outputs], "error string"])


PARSED = parsed()

#: Sections of a report in their order, with the key of their summary line.
SECTIONS = ("complexity_results", "large_files", "large_classes", "unused", "todo_fixme", "duplicates", "bns_results")
