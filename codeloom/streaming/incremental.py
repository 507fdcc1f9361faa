"""Incremental analysis: files arrive as a stream, findings are appended, duplicates kept as a table of hashes.

Row-wise findings need no state. Duplicate blocks do: every batch adds its block hashes to a
Parquet table, and groups are read from the whole table when asked for, so state is
files in shared storage instead of memory that grows with the stream. A batch that is run again after a
failure overwrites its own folder, so each batch counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators import findings as O
from codeloom.operators import parsing, summary


def watch(files: DataFrame, out: str, checkpoint: str, min_size: int = 50, complexity_threshold: int = 10, large_file_threshold: int = 500, once: bool = False) -> StreamingQuery:
    """Runs the analysis on each batch of a streaming files table; results go to out/findings and out/blocks."""

    def batch(df: DataFrame, number: int) -> None:
        parsed = parsing.parse(df).persist()
        blocks = parsing.blocks(parsed)
        sections = {
            "complexity_results": O.complexity(parsed, complexity_threshold),
            "large_files": O.large_files(O.token_counts(parsed), large_file_threshold, None),
            "unused": O.unused(parsed),
            "todo_fixme": O.markers(df, parsed),
            "bns_results": O.lint(parsed),
        }
        summary.union(sections).write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        hashed = blocks.where(F.size("tokens") >= min_size).select("location.*", F.size("tokens").alias("size"), F.sha2(F.array_join("tokens", "\x1f"), 256).alias("hash"))
        hashed.write.mode("overwrite").parquet(f"{out}/blocks/batch={number}")
        parsed.unpersist()

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def duplicates(spark: SparkSession, out: str) -> DataFrame:
    """(hash, size, num_duplicates, locations, cross_file) over all batches so far."""
    b = spark.read.parquet(f"{out}/blocks")
    groups = b.groupBy("hash", "size").agg(F.count(F.lit(1)).alias("num_duplicates"), F.sort_array(F.collect_list(F.struct("file", "start_line", "end_line"))).alias("locations"), (F.min("file") != F.max("file")).alias("cross_file"))
    return groups.where("num_duplicates >= 2")
