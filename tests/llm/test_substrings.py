import random
from collections import defaultdict

import numpy as np
import pytest

from codeloom.llm import substrings as S


def windows(rows, k):
    at = defaultdict(set)
    for i, text in {(i, t) for i, t in rows if i is not None and t is not None}:
        w = text.split()
        for s in range(len(w) - k + 1):
            at[tuple(w[s : s + k])].add((i, text, s))
    return {w: p for w, p in at.items() if len(p) > 1}


def brute_passages(rows, k):
    found = defaultdict(dict)
    for places in windows(rows, k).values():
        for i, text, s in places:
            found[i, text][s] = len(places)
    out = []
    for (i, _), starts in found.items():
        for s in sorted(starts):
            if s - 1 in starts:
                out[-1][2], out[-1][3] = s + k, max(out[-1][3], starts[s])
            else:
                out.append([i, s, s + k, starts[s]])
    return sorted(map(tuple, out))


@pytest.mark.parametrize(("k", "m"), [(50, 4), (5, 2), (2, 1), (30, 30)])
def test_passages_equal_brute_force(table, corpus, k, m):
    rows = [*corpus, (700, "p q r s t u v w " * 12), (701, "z " * 60), (702, "a\tb\n c  d " * 15)]
    found = S.repeated_passages(table(rows), k, m).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.copies) for r in found) == brute_passages(rows, k)


@pytest.mark.parametrize("hot_bytes", [0, 300, 3000])
def test_hot_minimisers_and_small_buckets_change_nothing(table, corpus, hot_bytes):
    rows = [*corpus, (701, "z " * 60), (702, "a\tb\n c  d " * 15)]
    found = S.repeated_passages(table(rows), 50, 4, 500, hot_bytes).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.copies) for r in found) == brute_passages(rows, 50)
    plain, split = (sorted(map(tuple, S.without_repeats(table(rows), 50, 4, 1 << 24, hot).collect()), key=repr) for hot in (1 << 24, hot_bytes))
    assert plain == split


def test_one_word_repeated_for_megabytes(table):
    n = 2_000_000
    found = S.repeated_passages(table([(1, "word " * n), (2, "other")])).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.copies) for r in found] == [(1, 0, n, n - 49)]


def test_only_later_occurrences_are_cut(spark, table):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a b\n{p} c"), (2, f"d {p}\ne f"), (3, p), (4, "g h"), (5, None), (None, p), (6, ""), (7, "g h")]
    out = S.without_repeats(table(rows))
    found = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    assert found == {(1, rows[0][1], len(rows[0][1])), (2, "d e f", 5), (4, "g h", 3), (5, None, None), (None, p, len(p)), (6, "", 0), (7, "g h", 3)}
    assert out.columns == table([]).columns


def test_cutting_leaves_no_repeats(table, corpus):
    rows = {(i, t) for i, t in corpus if i is not None}
    out = S.without_repeats(table(sorted(rows, key=repr)))
    left = [(r.doc_id, r.text) for r in out.collect()]
    firsts = {min(p) for p in windows(rows, 50).values()}
    assert firsts and not {i for i, t in rows if t is not None and t.strip()} - {i for i, _ in left} - {i for i, _, _ in (x for p in windows(rows, 50).values() for x in p)}
    assert {(i, t) for i, t in rows if not any((i, t) == (a, b) for p in windows(rows, 50).values() for a, b, _ in p)} <= set(left)


def test_empty_table(table):
    assert S.repeated_passages(table([])).collect() == []
    assert S.without_repeats(table([])).count() == 0


def test_super_kmers_cover_all_windows_once():
    data = np.frombuffer(b"a b c d e f g h i j k l m n o p", np.uint8)
    doc, start, minimiser, _, begin, end = S.super_kmers(data, np.array([0, 20, len(data)]), 4, 2)
    covered = [(d, s + i) for d, s, b, e in zip(doc, start, begin, end, strict=True) for i in range(len(data[b:e].tobytes().split()) - 3)]
    assert sorted(covered) == [(0, i) for i in range(7)] + [(1, i) for i in range(3)]


def test_a_bucket_unpacks_only_the_texts_that_may_repeat(monkeypatch):
    import pyarrow as pa

    r = random.Random(3)
    alone = lambda: " ".join(f"{r.randrange(10**9)}" for _ in range(80))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for ids, texts in (((0, 1, 2), (alone(), alone(), passage)), ((3, 4), (alone(), alone())), ((5,), (passage,))):
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts)], ["key", "doc_id", "text"])
        rows += [row for out in S._scatter(50, 4, 1, None, 0)(iter([batch])) for row in out.column("payload").to_pylist()]
    unpacked = []
    plain = S._text
    monkeypatch.setattr(S, "_text", lambda p: unpacked.append(p) or plain(p))
    found = S._count(50)(pa.table({"bucket": [0] * len(rows), "payload": pa.array(rows, pa.binary())}))
    assert len(rows) == 3 and len(unpacked) == 2
    assert sum(x["windows"] for x in found.to_pylist()) == 2 * 11
    assert set(found.column("doc_id").to_pylist()) == {2, 5} and set(found.column("copies").to_pylist()) == {2}
