"""The long table of all findings, its counts and summary lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.functions import columns as C

#: What a section's summary line counts.
NOUNS = {
    "complexity_results": "high cyclomatic complexity functions",
    "large_files": "large files",
    "large_classes": "large classes",
    "unused": "unused imports/variables",
    "todo_fixme": "TODO/FIXME comments",
    "duplicates": "duplicate code blocks",
    "bns_results": "Bugs and Safety Issues",
}
GRADED = ("complexity_results", "large_files", "large_classes")


def union(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, section_ord, severity, file, line, metric, detail): one row for each finding of the sections given."""
    parts = {
        "complexity_results": ("severity", "file", "lineno", "complexity", "name"),
        "large_files": ("severity", "file", None, "token_count", None),
        "large_classes": ("severity", "file", "start_line", "token_count", "name"),
        "unused": (None, "file", "line", None, "message"),
        "todo_fixme": (None, "file", "line", None, "text"),
        "duplicates": (None, "locations[0].file", "locations[0].start_line", "num_duplicates", "array_join(slice(tokens, 1, 10), ' ')"),
        "bns_results": (None, "file", "line", None, "message"),
    }
    kinds = ("string", "string", "int", "long", "string")
    out = []
    for order, name in enumerate(schemas.SECTIONS, 1):
        if name in sections:
            columns = [F.expr(f"cast({e or 'null'} as {t})").alias(c) for e, t, c in zip(parts[name], kinds, ("severity", "file", "line", "metric", "detail"), strict=True)]
            out.append(sections[name].select(F.lit(name).alias("section"), F.lit(order).alias("section_ord"), *columns))
    return reduce(DataFrame.unionByName, out)


def section_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, s, NOUNS[s], s in GRADED) for i, s in enumerate(schemas.SECTIONS, 1)], "section_ord int, section string, noun string, graded boolean")


def counts(findings: DataFrame) -> DataFrame:
    """(section, severity, n) for each severity of a section, and with a null severity for the section as a whole: both levels from one pass."""
    rolled = findings.rollup("section", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return rolled.where("level < 3 and (level = 1 or severity is not null)").select("section", "severity", "n", "level")


def summary(findings: DataFrame) -> DataFrame:
    """(section_ord, section, line): one line for each section, those without findings included."""
    c = counts(findings)
    grade = F.struct((-C.severity_rank(F.col("severity"))).alias("o"), F.concat(F.col("n").cast("string"), F.lit(" "), F.col("severity")).alias("s"))
    levels = c.groupBy("section").agg(F.max(F.when(F.col("level") == 1, F.col("n"))).alias("n"), F.sort_array(F.collect_list(F.when(F.col("level") == 0, grade))).alias("grades"))
    joined = F.broadcast(section_dimension(findings.sparkSession)).join(levels, "section", "left")  # seven rows
    by_grade = F.when(F.col("graded") & (F.size("grades") > 0), F.concat(F.lit(" ("), F.array_join(F.transform("grades", lambda g: g["s"]), ", "), F.lit(")"))).otherwise("")
    line = F.when(F.col("n") > 0, F.concat(F.lit("- "), F.col("n").cast("string"), F.lit(" "), F.col("noun"), by_grade)).otherwise(F.concat(F.lit("- 0 "), F.col("noun"), F.lit(" ✅")))
    return joined.select("section_ord", "section", line.alias("line")).orderBy("section_ord")


def top_of_each_section(findings: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("section").orderBy(F.desc_nulls_last("metric"), "file", "line", "detail")
    return findings.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
