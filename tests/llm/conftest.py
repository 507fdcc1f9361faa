import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
EXTRA = ("key", "leader", "leaders", "bucket", "payload", "size", "n", "pool", "cell", "shard", "bytes", "tokens", "rows", "start", "windows", "f", "detected", "distance", "total", "need", "a", "b")


def words(r, n, size=400):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def table(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns if asked for."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(7) for c in EXTRA}) if extra else df

    return make


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages, nulls, empty, blank, short and very long texts, repeated rows and one id with two texts."""
    r = random.Random(5)
    base = [words(r, r.choice((3, 20, 60, 150, 300))) for _ in range(40)]
    passage = words(r, 70, 100_000)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(8)] + [(110 + i, base[0]) for i in range(4)]
    for i in range(12):
        w = base[10 + i].split(" ")
        for _ in range(max(1, len(w) // 25)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, f"{words(r, 10 * i, 50_000)} {passage}\n\n{words(r, 15, 50_000)}".strip()) for i in range(5)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "ONE"), (405, "one two"), (None, base[3]), (None, None)]
    rows += [(500, words(r, 30_000, 10**9)), (501, "ab " * 400), (502, "é" * 5000)]
    rows += [(3, base[3]), (4, base[5]), (600, base[20] + " end"), (600, base[21])]
    return rows
