"""Quality rules: a table of measures and thresholds compiled into one projection.

Every measure is an expression of built-in functions, so a scan evaluates all rules in one
pass on the JVM, with no user function, join or exchange.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUOTIENT = re.compile(r"(\w+) / (\w+)")
STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in is was that for it with as be by on at this from are or an not have has a he i "
            "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
            "le la les et des en un du une que est pour qui dans par sur au pas avec ce de "
            "el los las y del se por con para una su al lo como más o".split()
        )
    )
)
_PUNCTUATION = "0123456789.,;:!?'\"()[]{}<>#$%&*+-/=@\\\\^_`|~"
_SYMBOLS = "#$%&*{}<>|^~=_@"


def _sql(text: str) -> str:
    return text.replace("'", "\\'")


_WHITE = r" \t\n\r\u000c\u000b"
_MEASURES = {
    "words": r"regexp_count(text, '[^ \\t\\n\\r\\f\\x0b]+')",
    "dense": rf"length(translate(text, '{_WHITE}', ''))",
    "letters": f"length(translate(text, '{_WHITE}{_sql(_PUNCTUATION)}', ''))",
    "symbols": f"length(text) - length(translate(text, '{_SYMBOLS}', ''))",
    "capitals": "length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))",
    "stops": rf"size(filter(split(lower(text), '[ \\t\\n\\r\\f\\x0b]+'), w -> w IN ({', '.join(repr(w) for w in STOP_WORDS)})))",
    "distinct_words": r"size(array_distinct(filter(split(lower(text), '[ \\t\\n\\r\\f\\x0b]+'), w -> w <> '')))",
    "lines": r"size(split(text, '\\n', -1))",
    "distinct_lines": r"size(array_distinct(split(text, '\\n', -1)))",
    "bullets": r"regexp_count(text, '(?m)^[ \\t]*[-*\u2022]')",
    "ellipses": r"regexp_count(text, '(?m)(\\.\\.\\.|\u2026)[ \\t]*$')",
}


@dataclass(frozen=True)
class Rule:
    """Fails if the value, an expression over the measures, lies outside [low, high]; applies from `words` words on."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None
    words: int = 1


#: Short texts have few words to judge by; ratios of words and lines apply from a size on.
RULES = (
    Rule("word_count", "words", 1, 100_000, 0),
    Rule("mean_word_length", "dense / words", 2.0, 12.0, 10),
    Rule("letter_ratio", "letters / dense", 0.7, None, 30),
    Rule("symbol_ratio", "symbols / words", None, 0.3, 30),
    Rule("capital_ratio", "capitals / dense", None, 0.5, 10),
    Rule("stop_word_ratio", "stops / words", 0.05, None, 60),
    Rule("distinct_word_ratio", "distinct_words / words", 0.1, None, 30),
    Rule("repeated_line_ratio", "1 - distinct_lines / lines", None, 0.5, 10),
    Rule("bullet_line_ratio", "bullets / lines", None, 0.9, 10),
    Rule("ellipsis_line_ratio", "ellipses / lines", None, 0.3, 10),
)


def evaluate(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, <value of each rule>, failed, keep) for each row of docs; failed joins the names of the rules that fail.

    A null text counts as an empty one: it has no words, fails word_count, and its ratios are
    null; a null value fails no rule. Null ids and repeated rows are kept; other columns are ignored."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    measured = text.select("doc_id", *[F.expr(e).cast("long").alias(n) for n, e in _MEASURES.items()])
    values = measured.select("doc_id", "words", *[F.expr(f"cast({_QUOTIENT.sub(r'try_divide(\1, \2)', r.value)} as double)").alias(r.name) for r in rules])
    broken = [F.when((F.col("words") >= r.words) & ((F.col(r.name) < r.low if r.low is not None else F.lit(False)) | (F.col(r.name) > r.high if r.high is not None else F.lit(False))), F.lit(r.name)) for r in rules]
    failed = F.concat_ws(",", *broken)
    return values.withColumn("failed", failed).select("doc_id", *[r.name for r in rules], "failed", (F.col("failed") == "").alias("keep"))
