"""The whole analysis: a tree or table of files in, one DataFrame for each section out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

from codeloom import schemas
from codeloom.functions import columns as C
from codeloom.operators import findings as O
from codeloom.operators import parsing, summary
from codeloom.sources import codetree


@dataclass
class Settings:
    """What an analysis looks for. compat repeats the reference's quirks: a top_n of 0 gives no row, and C# methods and enums count as classes."""

    path: str | Path = "."
    min_similarity: float = 0.8
    min_size: int = 50
    output_format: str = "text"
    output_file: str | Path | None = None
    ignore_dirs: Iterable[str] = C.DEFAULT_IGNORED
    complexity_threshold: int = 10
    large_file_threshold: int = 500
    large_class_threshold: int = 300
    top_n_large: int | None = 10
    extensions: Iterable[str] | str | None = None
    lint_ignore: tuple[str, ...] = ()
    only: tuple[str, ...] = field(default=schemas.SECTIONS)
    compat: bool = False

    def __post_init__(self) -> None:
        root = self.path = Path(self.path)
        if not root.is_dir():
            raise ValueError(f"{root} is not a directory" if root.exists() else f"{root} does not exist")
        if self.min_similarity < 0 or self.min_similarity > 1:
            raise ValueError("min_similarity is in [0, 1]")
        if self.output_format not in ("text", "json", "markdown"):
            raise ValueError("output_format is text, json or markdown")
        if unknown := set(self.only) - set(schemas.SECTIONS):
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        if self.output_file is not None:
            self.output_file = Path(self.output_file)


class Corpus:
    """Files and what parsing them yields; both are lazy, and parsing happens once for all sections."""

    def __init__(self, files: DataFrame, keep: bool = True):
        self.files = files
        self.parsed = parsing.parse(files)
        if keep:
            self.parsed = self.parsed.persist(StorageLevel.MEMORY_AND_DISK)
        self.blocks = parsing.blocks(self.parsed)

    @classmethod
    def load(cls, spark: SparkSession, path: str | Path, extensions=None, ignore_dirs=C.DEFAULT_IGNORED) -> Corpus:
        return cls(codetree.read_tree(spark, str(path), extensions, ignore_dirs))

    def sections(self, s: Settings) -> dict[str, DataFrame]:
        n = s.top_n_large
        counts = O.token_counts(self.parsed)
        made = {
            "complexity_results": lambda: O.complexity(self.parsed, s.complexity_threshold),
            "large_files": lambda: O.large_files(counts, s.large_file_threshold, n),
            "large_classes": lambda: O.large_classes(self.blocks, s.large_class_threshold, n, strict=s.compat),
            "unused": lambda: O.unused(self.parsed),
            "todo_fixme": lambda: O.markers(self.files, self.parsed),
            "duplicates": lambda: O.duplicates(self.blocks, s.min_size),
            "bns_results": lambda: O.lint(self.parsed, s.lint_ignore),
        }
        out = {name: made[name]() for name in schemas.SECTIONS if name in s.only}
        if s.compat and n == 0:
            out |= {name: out[name].where("false") for name in ("large_files", "large_classes") if name in out}
        return out

    def register(self, prefix: str = "") -> None:
        """Temporary views files, parsed, blocks, for SQL."""
        for name in ("files", "parsed", "blocks"):
            getattr(self, name).createOrReplaceTempView(prefix + name)

    def close(self) -> None:
        self.parsed.unpersist()


def register_functions(spark: SparkSession) -> None:
    """The front ends as SQL functions: py_blocks, py_complexity, py_lint and code_comments as table functions, py_token_count as a scalar one."""
    from pyspark.sql.functions import arrow_udf, udtf

    from codeloom.functions import frontend, python_source

    def table(name: str, ddl: str, language_given: bool, key: str, fields: tuple[str, ...]):
        class Rows:
            def eval(self, content: str, language: str = "python"):
                raw = None if content is None else content.encode()
                for row in frontend.analyse(language if language_given else "python", content, raw, (key,))[key]:
                    yield tuple(row[f] for f in fields)

        spark.udtf.register(name, udtf(Rows, returnType=ddl))

    table("py_blocks", "start_line int, end_line int, type string, name string, tokens array<string>", False, "blocks", ("start_line", "end_line", "type", "name", "tokens"))
    table("py_complexity", "name string, complexity int, lineno int, endline int", False, "complexity", ("name", "complexity", "lineno", "endline"))
    table("py_lint", "line int, code string, message string", False, "lint", ("line", "code", "message"))
    table("py_unused", "line int, code string, message string", False, "unused", ("line", "code", "message"))
    table("code_blocks", "start_line int, end_line int, type string, name string, tokens array<string>", True, "blocks", ("start_line", "end_line", "type", "name", "tokens"))
    table("code_comments", "line int, text string", True, "comments", ("line", "text"))

    def count(raws):
        import pyarrow as pa

        return pa.array([python_source.token_count(r) for r in raws.to_pylist()], pa.int32())

    spark.udf.register("py_token_count", arrow_udf(count, "int"))


def findings(sections: dict[str, DataFrame]) -> DataFrame:
    return summary.union(sections)
