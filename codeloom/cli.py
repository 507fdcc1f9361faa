"""Command line: python -m codeloom PATH [options]."""

from __future__ import annotations

import argparse
import sys

from codeloom import schemas
from codeloom.functions import columns as C

#: Options with a number: names, default, meaning.
_NUMBERS = (
    ("min-similarity min-sim", 0.8, "least similarity of near duplicates, 0 to 1"),
    ("min-size", 50, "least tokens of a duplicate block"),
    ("complexity-threshold", 10, "least complexity to report"),
    ("large-file-threshold", 500, "least tokens of a large file"),
    ("large-class-threshold", 300, "least tokens of a large class"),
    ("top-n-large", 10, "largest files and classes to show; 0 for all"),
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description="Code-quality findings of a source tree, by Spark.")
    p.add_argument("path", help="directory to analyse")
    for names, default, meaning in _NUMBERS:
        p.add_argument(*(f"--{n}" for n in names.split()), type=type(default), default=default, help=meaning)
    p.add_argument("--output-format", choices=("text", "json", "markdown"), default="text")
    p.add_argument("--output-file", help="file to write to, instead of standard output")
    p.add_argument("--ignore-dirs", nargs="*", default=list(C.DEFAULT_IGNORED), help="names of folders to leave out")
    p.add_argument("--extensions", nargs="*", help="extensions to include, also as one list separated by commas")
    p.add_argument("--only", nargs="*", choices=schemas.SECTIONS, default=list(schemas.SECTIONS), help="sections to compute")
    p.add_argument("--lint-ignore", nargs="*", default=[], help="codes to leave out of bugs and safety")
    p.add_argument("--compat", action="store_true", help="repeat the reference's quirks")
    p.add_argument("--findings", help="folder to write all findings to, as Parquet")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from codeloom.plans import analysis, report
    from codeloom.session import local_session

    try:
        extensions = None if a.extensions is None else [e for x in a.extensions for e in x.split(",")]
        settings = analysis.Settings(a.path, a.min_similarity, a.min_size, a.output_format, a.output_file, a.ignore_dirs, a.complexity_threshold, a.large_file_threshold, a.large_class_threshold, a.top_n_large, extensions, tuple(a.lint_ignore), tuple(a.only), a.compat)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or local_session()
    corpus = analysis.Corpus.load(spark, settings.path, settings.extensions, settings.ignore_dirs)
    try:
        sections = corpus.sections(settings)
        report.Reporter(settings.output_format).generate(sections, settings.output_file)
        if a.findings:
            report.write_findings(analysis.findings(sections), a.findings)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        corpus.close()
    return 0
