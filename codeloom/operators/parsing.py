"""files -> parsed: what files yield, from one pass of the front ends over Arrow batches."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeloom import schemas
from codeloom.functions import columns as C

#: Rows that are parsed before their results are handed on.
ROWS = 64


def parse(files: DataFrame, outputs: Collection[str] = tuple(schemas.OUTPUTS), languages: Collection[str] = ()) -> DataFrame:
    """One row for each file of a known language, or of one of `languages`, with the outputs asked for: see schemas.parsed. Only
    these files reach Python, and only what the outputs need is read of them. Files without text have empty arrays."""
    from codeloom.functions.frontend import analyse

    if unknown := set(outputs) - set(schemas.OUTPUTS):
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    wanted = tuple(name for name in schemas.OUTPUTS if name in outputs)
    ddl = schemas.parsed(wanted)
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS).to_pylist()
                found = [{"file": r["path"], "language": r["language"], "lexical": r["lexical"], **analyse(r["language"], r["content"], r["bytes"], wanted)} for r in rows]
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    chosen = files.where(F.col("language").isin(*languages) if languages else F.col("language").isNotNull())
    counted = "in_blocks" in wanted or "py_tokens" in wanted
    lexical = F.when(F.col("language").isin("javascript", "csharp"), C.lexical_count(F.col("content"))) if counted else F.lit(None)
    raw = F.when(F.col("language") == "python", F.col("bytes")) if "py_tokens" in wanted or "lint" in wanted else F.lit(None).cast("binary")
    text = F.when(F.col("language") != "javascript", F.col("content")) if set(wanted) <= {"py_tokens", "in_blocks"} else F.col("content")  # counted without parsing
    return chosen.select("path", "language", lexical.cast("int").alias("lexical"), text.alias("content"), raw.alias("bytes")).mapInArrow(run, ddl)


def blocks(parsed: DataFrame) -> DataFrame:
    """(location, tokens, type, name, language), a row for each block."""
    b = parsed.select("file", "language", F.explode("blocks").alias("b"))
    return b.select(F.struct("file", "b.start_line", "b.end_line").alias("location"), "b.tokens", "b.type", "b.name", "language")
