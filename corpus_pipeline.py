"""A corpus pipeline over `documents`: language, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. run() writes each
result as Parquet, in the folder that the cluster names in spark.checkpoint.dir, and reads it again.

In all stages columns beyond those of documents pass through, whatever their names, but for the last, whose columns
are fixed; an empty table gives an empty result, texts are processed whole whatever their length, and a row with a null doc_id
is kept by every stage that keeps its text, up to packing, which leaves it out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import jaccard, langid, packing, secret_scan, substrings, tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in none of the languages of the corpus go.

    Null, empty and letterless texts are in no language and go; repeated rows stay or go together; of equally near languages the first by name counts."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Texts without words, null ones and rows with a null doc_id are in no group and stay; repeated rows are one document, and all of them stay or go."""
    return jaccard.without_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they come first and are cut out elsewhere; a document of which nothing is left goes.

    First is the smallest (doc_id, hash of the row, place). Rows equal in doc_id and text are one document, so they aren't copies of
    each other. Null and empty texts and rows with a null doc_id stay as they are. n_chars is set anew where text is cut."""
    return substrings.without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no row goes. Null and empty texts stay as they are, repeated rows are changed alike, n_chars is set anew."""
    return secret_scan.redact(docs, secret_scan.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in sequences of 2048 words: (pool, bin, bin_offset, doc_id, piece, length).

    Texts without words and rows with a null doc_id have no place; repeated rows have one each; equal sizes go by doc_id."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("passages", passages), ("secrets", secrets), ("packed", packed)]

#: SQL can say neither the trained field nor best-fit packing; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. The tables between them are in the shared folder until `tables.release`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{tables.own_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
