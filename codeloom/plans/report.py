"""Reports: text, JSON and Markdown, and findings as a Parquet table.

Lines are made by Spark from each section in a total order; the driver only streams them into
the output, a partition at a time.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.functions import columns as C
from codeloom.operators import summary

FORMATS = ("text", "json", "markdown")
_CYAN, _YELLOW, _MAGENTA, _RESET = "\x1b[36m", "\x1b[33m", "\x1b[35m", "\x1b[0m"


@dataclass
class Section:
    """title and empty message of a section; line makes the text of a finding, summary that of its line from (number, counts by severity)."""

    title: str
    empty: str = "No results found."
    line: Callable[[], Column] | None = None
    order: tuple = ()
    summary: Callable[[int, dict[str, int]], str] | None = None


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


SECTIONS = {
    "complexity_results": Section("High Cyclomatic Complexity Functions", "No high cyclomatic complexity functions found.", lambda: _text("- ", F.col("file"), ":", F.col("lineno"), " ", F.col("name"), " (complexity: ", F.col("complexity"), ") [", F.col("severity"), "]"), ("-complexity", "file", "lineno", "name")),
    "large_files": Section("Large Files", "No large files found.", lambda: _text("- ", F.col("file"), " (tokens: ", F.col("token_count"), ") [", F.col("severity"), "]"), ("-token_count", "file")),
    "large_classes": Section("Large Classes", "No large classes found.", lambda: _text("- ", F.col("file"), ":", F.col("start_line"), " ", F.col("name"), " (tokens: ", F.col("token_count"), ") [", F.col("severity"), "]"), ("-token_count", "file", "start_line", "name")),
    "unused": Section("Unused Imports and Vars", "No unused imports or variables found.", lambda: _text("- ", F.col("file"), ":", F.col("line"), " [", F.col("code"), "] ", F.col("message")), ("file", "line", "code", "message")),
    "todo_fixme": Section("TODO/FIXME Comments", "No TODO/FIXME comments found.", lambda: _text("- ", F.col("file"), ":", F.col("line"), " [", F.col("type"), "] ", F.col("text")), ("file", "line", "type", "text")),
    "duplicates": Section("Code Duplications", "No code duplications found!", None, ("-num_duplicates", "-size", "locations")),
    "bns_results": Section("Bugs and Safety Issues", "No Bugs and Safety Issues found.", lambda: _text("- ", F.coalesce("file", F.lit("Unknown")), ":", F.coalesce(F.col("line").cast("string"), F.lit("?")), " ", F.coalesce("message", F.lit(""))), ("file", "line", "code", "message")),
}


def _order(section: Section) -> list[Column]:
    return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in section.order]


def clone_lines(groups: DataFrame, markdown: bool = False) -> DataFrame:
    """(position, line): the lines of each duplicate group, numbered over all groups."""
    numbered = groups.withColumn("position", F.row_number().over(Window.orderBy(*_order(SECTIONS["duplicates"]))))
    head = _text("- Clone #" if markdown else "Clone #", F.col("position"), ": size=", F.col("size"), " tokens, count=", F.col("num_duplicates"), F.when(F.col("cross_file"), " (cross-file)").otherwise(""))
    place = lambda p: _text(p["file"], ":", p["start_line"], "-", p["end_line"])
    listed = F.transform("locations", lambda p: _text("    - ", C.path_text(p["file"], p["start_line"], "markdown"), " - ", place(p)) if markdown else _text("    - ", place(p)))
    lines = F.concat(F.array(head), listed, F.array(_text("    Tokens: ", C.snippet(F.col("tokens"))), F.lit("")))
    return numbered.select("position", F.array_join(lines, "\n").alias("line"))


class Reporter:
    """Renders sections; config adds sections to the seven, or replaces some."""

    def __init__(self, output_format: str = "text", config: dict[str, Section] | None = None, colour: bool | None = None):
        if output_format not in FORMATS:
            raise ValueError(f"output format is one of {FORMATS}")
        self.format = output_format
        self.config = SECTIONS | (config or {})
        self.colour = colour

    def summary(self, sections: dict[str, DataFrame]) -> list[str]:
        """A line for each configured section; a section not given counts as empty, and a failing summary is named in its line."""
        known = {k: v for k, v in sections.items() if k in schemas.SECTIONS}
        lines = {r.section: r.line for r in summary.summary(summary.union(known)).collect()} if known else {}
        out = []
        for name, section in self.config.items():
            if section.summary is None and name in summary.NOUNS:
                out.append(lines.get(name, f"- 0 {summary.NOUNS[name]} ✅"))
                continue
            df = sections.get(name)
            graded = df is not None and "severity" in df.columns
            rows = [] if df is None else (df.groupBy("severity").count().collect() if graded else [(None, df.count())])
            n, levels = sum(r[1] for r in rows), {s: c for s, _ in C.SEVERITIES for r, c in rows if r == s}
            try:
                if section.summary is not None:
                    out.append(section.summary(n, levels))
                else:
                    by = f" ({', '.join(f'{c} {s}' for s, c in levels.items())})" if levels else ""
                    out.append(f"- {n} {section.title.lower()}{by}" if n else f"- 0 {section.title.lower()} ✅")
            except Exception as e:  # a caller's function; the report goes on
                out.append(f"[Error in summary for {name}: {e}]")
        return out

    def lines(self, sections: dict[str, DataFrame]) -> Iterator[str]:
        """The lines of a text or Markdown report. A section that is absent wasn't computed and is left out; an empty one says so."""
        markdown = self.format == "markdown"
        paint = (lambda c, s: f"{c}{s}{_RESET}") if self.colour and not markdown else (lambda c, s: s)
        yield "# Code Quality Report\n" if markdown else paint(_CYAN, "\nCode Quality Report\n")
        yield "## Summary" if markdown else paint(_YELLOW, "Summary:")
        yield from self.summary(sections)
        yield ""
        for name, section in self.config.items():
            if name not in sections:
                continue
            df = sections[name]
            if section.line is None and name == "duplicates":
                rendered = clone_lines(df, markdown).orderBy("position").select("line")
            else:
                line = section.line() if section.line else F.to_json(F.struct("*"))
                rendered = (df.orderBy(*_order(section)) if section.order else df).select(line.alias("line"))
            some = False
            for row in rendered.toLocalIterator():
                if not some:
                    yield f"## {section.title}" if markdown else (paint(_MAGENTA, f"{section.title}:"))
                    some = True
                yield row.line
            if not some:
                yield f"**{section.empty}**" if markdown else paint(_MAGENTA, section.empty)
            yield ""

    def json(self, sections: dict[str, DataFrame]) -> Iterator[str]:
        """The pieces of one JSON object: an array for each section, and the summary."""
        yield "{"
        for name, section in self.config.items():
            yield f"\n  {json.dumps(name)}: ["
            if name in sections:
                df = sections[name]
                some = False
                for row in (df.orderBy(*_order(section)) if section.order else df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
                    body = json.dumps(json.loads(row.j), indent=2).replace("\n", "\n    ")
                    yield f"{',' if some else ''}\n    {body}"
                    some = True
                if some:
                    yield "\n  "
            yield "],"
        body = json.dumps(self.summary(sections), indent=2).replace("\n", "\n  ")
        yield f'\n  "summary": {body}\n}}'

    def generate(self, sections: dict[str, DataFrame], output_file: str | Path | None = None) -> None:
        """Writes the report to the file, or to standard output, also if the file can't be written."""
        if self.colour is None:
            self.colour = output_file is None and sys.stdout.isatty()
        pieces = self.json(sections) if self.format == "json" else (f"{line}\n" for line in self.lines(sections))
        if output_file is None:
            sys.stdout.writelines(pieces)
            print()
            return
        try:
            with open(output_file, "w", encoding="utf-8") as f:
                f.writelines(pieces)
            print(f"\nWrote the report to {output_file}")
        except OSError as e:
            print(f"Error writing report: {e}")
            sys.stdout.writelines(self.json(sections) if self.format == "json" else (f"{line}\n" for line in self.lines(sections)))


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as Parquet, a folder for each section."""
    findings.write.mode("overwrite").partitionBy("section").parquet(path)
