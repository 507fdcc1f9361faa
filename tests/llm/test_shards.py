import numpy as np
import pytest

from codeloom.llm import shards as S


def brute_place(sizes, shards):
    total = sizes.sum(axis=0)
    unit = [t / shards if t else 1 for t in total]
    free, out = [[1.0] * 3 for _ in range(shards)], []
    for v in sizes:
        v = [x / u for x, u in zip(v, unit, strict=True)]
        fits = [s for s in range(shards) if all(f >= x - 1e-12 for f, x in zip(free[s], v, strict=True))] or list(range(shards))
        best = max(fits, key=lambda s: (round(sum(f * x for f, x in zip(free[s], v, strict=True)), 12), -s))
        out.append(best)
        free[best] = [f - x for f, x in zip(free[best], v, strict=True)]
    return out


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_placing_equals_brute_force(shards):
    r = np.random.default_rng(shards)
    sizes = r.integers(0, 1000, (60, 3)).astype(float)
    assert S.place(sizes, shards).tolist() == brute_place(sizes, shards)


def test_balance_on_a_hot_source(table, corpus):
    rows = [(i, f"{t} {i}", "en", "hot" if i % 3 else f"s{i % 11}") for i in range(1500) for t in ("word " * (1 + i % 40),)]
    found = S.shard(table(rows), shard_bytes=sum(len(t) for _, t, *_ in rows) // 8 + 1, groups_per_shard=24).collect()
    assert len(found) == len(rows)
    shard = {r.doc_id: r.shard for r in found}
    loads = np.zeros((8, 3))
    for i, t, *_ in rows:
        loads[shard[i]] += (len(t), len(t.split()), 1)
    assert loads.max(axis=0).max() > 0 and (loads.max(axis=0) / loads.mean(axis=0)).max() < 1.15


def test_odd_rows(table, corpus):
    rows = [(i, t, "en", s) for (i, t), s in zip(corpus, (None, "a", "b", "a") * 100, strict=False)]
    found = S.shard(table(rows), shard_bytes=4000).collect()
    assert sorted(((r.doc_id, r.source) for r in found), key=repr) == sorted(((i, s) for i, _, _, s in rows), key=repr)
    repeated = {r.shard for r in S.shard(table([(1, "a"), (1, "a"), (2, "b")]), 1, 1, 8).where("doc_id = 1").collect()}
    assert len(repeated) == 1


def test_empty_table(table):
    assert S.shard(table([])).collect() == []
    assert [r.shard for r in S.shard(table([(1, None), (2, "")])).collect()] == [0, 0]


def test_a_source_is_cut_into_as_many_groups_as_its_shards_need(table):
    rows = [(i, "word " * (1 + i % 40), "en", "hot") for i in range(6000)]
    found = S.shard(table(rows), shard_bytes=sum(len(t) for _, t, *_ in rows) // 8 + 1, cells=12).collect()
    loads = np.zeros(8)
    for r in found:
        loads[r.shard] += len(rows[r.doc_id][1])
    assert len(found) == len(rows) and loads.max() / loads.mean() < 1.15 and loads.min() / loads.mean() > 0.85


def test_a_source_fills_more_shards_than_there_are_least_cells(table):
    found = S.shard(table([(i, "ab", "en", "hot") for i in range(12_000)]), shard_bytes=4, groups_per_shard=1)
    assert found.count() == 12_000 and found.select("shard").distinct().count() > S.CELLS


def test_many_shards_are_placed_in_ranges(table):
    rows = [(i, "word " * (1 + i % 40), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(6000)]
    found = S.shard(table(rows), shard_bytes=sum(len(t) for _, t, *_ in rows) // 30 + 1, groups_per_shard=12, most=7).collect()
    loads = np.zeros(30)
    for r in found:
        loads[r.shard] += len(rows[r.doc_id][1])
    assert len(found) == len(rows) and loads.max() / loads.mean() < 1.3 and loads.min() / loads.mean() > 0.7


def test_placing_time_of_many_shards(table):
    """10,000 shards of one source, none fuller than its share by more than a group."""
    rows = [(i, "ab" * 5, "en", "hot") for i in range(60_000)]
    found = S.shard(table(rows, extra=False), shard_bytes=60, groups_per_shard=6).groupBy("shard").count().collect()
    assert len(found) == 10_000 and max(r["count"] for r in found) <= 24 and sum(r["count"] for r in found) == 60_000
