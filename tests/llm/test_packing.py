import random
from collections import defaultdict

import pytest

from codeloom.llm import packing as P


def brute(sizes, capacity):
    """Best fit by scanning all bins; of equally tight ones that filled last."""
    rooms, stamp, out = [], [], []
    for t, size in enumerate(sizes):
        fits = [b for b, room in enumerate(rooms) if room >= size]
        if fits:
            b = min(fits, key=lambda b: (rooms[b], -stamp[b]))
        else:
            b = len(rooms)
            rooms.append(capacity)
            stamp.append(0)
        out.append((b, capacity - rooms[b]))
        rooms[b] -= size
        stamp[b] = t
    return out


@pytest.mark.parametrize("capacity", [1, 2, 7, 10, 64, 100])
def test_best_fit_equals_brute_force(capacity):
    r = random.Random(capacity)
    for n in (0, 1, 5, 300):
        sizes = sorted((r.randint(1, capacity) for _ in range(n)), reverse=True)
        assert list(zip(*P.best_fit_decreasing(sizes, capacity), strict=True)) == brute(sizes, capacity)


@pytest.mark.parametrize(("capacity", "in_slice"), [(50, 20_000), (50, 10), (7, 3)])
def test_every_word_is_packed_once(table, corpus, capacity, in_slice):
    found = P.pack(table(corpus), capacity, in_slice).collect()
    wanted, got, bins = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, t in corpus:
        if i is not None and t and t.split():
            n = len(t.split())
            wanted[i] += [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0)
    for r in found:
        got[r.doc_id].append(r.length)
        bins[r.pool, r.bin].append((r.bin_offset, r.length))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in wanted.items()}
    for spans in bins.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end = at + n
        assert end <= capacity
    words = sum(map(sum, wanted.values()))
    assert len(bins) <= 1.25 * words / capacity + 1
    assert sorted(found) == sorted(P.pack(table(corpus), capacity).collect())


def test_result_does_not_depend_on_partitions(table, corpus):
    one, many = (sorted(P.pack(table(corpus).repartition(n), 50, 20).collect()) for n in (1, 7))
    assert one == many


def test_empty_table(table):
    assert P.pack(table([])).collect() == []
    assert P.pack(table([(1, None), (2, " ")])).collect() == []


@pytest.mark.parametrize("capacity", [1, 2, 7, 10, 64, 100, 2048])
def test_runs_equal_best_fit_of_each_item(capacity):
    r = random.Random(capacity)
    for n in (0, 1, 5, 300, 5000):
        sizes = sorted((min(r.randint(1, capacity), r.randint(1, capacity)) for _ in range(n)), reverse=True)
        runs, used = P.best_fit_runs({s: sizes.count(s) for s in set(sizes)}, capacity)
        got = {}
        for size, start, first, step, each, offset in runs.tolist():
            end = min([s for z, s, *_ in runs.tolist() if z == size and s > start], default=sizes.count(size))
            for at in range(end - start):
                got[size, start + at] = (first + at // each * step, offset + at % each * size)
        bins, offsets = P.best_fit_decreasing(sizes, capacity)
        assert [got[s, i - sizes.index(s)] for i, s in enumerate(sizes)] == list(zip(bins, offsets, strict=True))
        assert used == max(bins, default=-1) + 1


def test_many_documents_are_packed_as_one(table):
    r = random.Random(9)
    rows = [(i, "w " * r.randint(1, 130)) for i in range(400)]
    found = P.pack(table(rows), 50, 20).collect()
    sizes = sorted(((len(t.split()), i) for i, t in rows), key=lambda x: (-(x[0] % 50), x[1]))
    rest = [(n % 50, i) for n, i in sizes if n % 50]
    want = {(i, *at) for (_, i), at in zip(rest, brute([n for n, _ in rest], 50), strict=True)}
    assert {(q.doc_id, q.bin, q.bin_offset) for q in found if q.length < 50} == want
    assert {q.pool for q in found} == {0} and len({q.bin for q in found}) == max(q.bin for q in found) + 1
