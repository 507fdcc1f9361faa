import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from codeloom.llm import neighbours as N


def units(x):
    x = np.asarray(x, float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(x, k=10, every=50):
    """(vec_id, neighbour_id, cosine, rank), ids being the row numbers."""
    s = np.round(units(x) @ units(x).T, 6)
    return {(i, j, s[i, j], rank) for i in range(0, len(x), every) for rank, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:k], 1)}


def table(spark, x, kind="float"):
    rows = [(i, v.tolist(), 1, 2, 3.0, "x") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, rank int, cell int, cosine double, payload string")


def found(df):
    rows = [tuple(r) for r in df.select("vec_id", "neighbour_id", "cosine", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def clusters(r, n, each, d, near, offset=0.0):
    """n groups of vectors spread to the least cosine from a centre, with a common direction and unequal variances."""
    scale = np.exp(-3 * np.arange(d) / d)
    centre = units(r.normal(size=(n, d)) * scale / np.linalg.norm(scale) + offset * units(r.normal(size=(1, d))))
    out = []
    for c in centre:
        other = r.normal(size=(each, d)) * scale
        other = units(other - (other @ c)[:, None] * c)
        angle = r.uniform(0, math.acos(near), each)[:, None]
        out.append(c * np.cos(angle) + other * np.sin(angle))
    x = np.concatenate(out)
    return x[r.permutation(len(x))].astype(np.float32)


@pytest.mark.parametrize(("n", "values", "cell"), [(700, 1 << 20, 65_536), (700, 1, 3), (6, 1, 65_536)])
def test_far_vectors_equal_brute_force(spark, monkeypatch, n, values, cell):
    monkeypatch.setattr(N, "BLOCK_VALUES", values)
    monkeypatch.setattr(N, "CELL_CODES", cell)
    x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    x[5] = x[3] = x[1] = x[0]
    assert found(N.nearest(table(spark, x))) == brute(x)


@pytest.mark.parametrize(("d", "near", "offset"), [(64, 0.9, 0.0), (96, 0.9, 1.0), (20, 0.95, 0.5)])
def test_the_index_alone_answers_near_ones_with_recall(spark, monkeypatch, d, near, offset):
    monkeypatch.setattr(N, "CELL_CODES", 100)
    monkeypatch.setattr(N, "_scan", lambda queries, *_: queries.sparkSession.createDataFrame([], N._FOUND))
    x = clusters(np.random.default_rng(d), 60, 20, d, near, offset)
    got = found(N.nearest(table(spark, x), every=5))
    answered = {r[0] for r in got}
    want = {r[:2] for r in brute(x, every=5) if r[0] in answered}
    assert len(answered) >= 120 and len({r[:2] for r in got} & want) >= 0.95 * len(want)


def test_recall_over_all_queries(spark):
    x = np.concatenate([clusters(np.random.default_rng(4), 30, 20, 64, 0.85), np.random.default_rng(5).normal(size=(300, 64)).astype(np.float32)])
    want = {r[:2] for r in brute(x, every=3)}
    assert len({r[:2] for r in found(N.nearest(table(spark, x), every=3))} & want) >= 0.97 * len(want)


@pytest.mark.parametrize(("bits", "parts", "radius", "cell"), [(16, 2, 5, 65_536), (16, 3, 7, 20), (64, 4, 23, 65_536)])
def test_probing_retrieves_every_code_within_the_radius(monkeypatch, bits, parts, radius, cell):
    monkeypatch.setattr(N, "CELL_CODES", cell)
    r = np.random.default_rng(2)
    x = units(r.normal(size=(400, bits)))
    ids, layout, eye = np.arange(400), N.Layout(bits, parts, 400), np.eye(bits)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), bits)], ["vec_id", "embedding"])
    dealt = [b for reach in (None, radius // parts) for b in N._deal(layout, np.zeros(bits), eye, "f8", reach)(iter([batch]))]
    rows = pa.Table.from_batches(dealt).sort_by([("cell", "ascending"), ("kind", "ascending")])
    rows = rows.append_column("sub", pa.array(np.zeros(rows.num_rows, np.int64)))
    got = {(a, b) for out in N._probe(layout, radius, bits, "f8", 400)(iter(rows.combine_chunks().to_batches())) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    codes = N.codes_of(x, np.zeros(bits), eye)
    far = np.bitwise_count(codes[:, None] ^ codes[None, :])
    assert got == {(i, j) for i in range(400) for j in range(400) if i != j and far[i, j] <= radius} and len(got) > 400


def test_least_cosine_of_a_radius():
    r = np.random.default_rng(0)
    for radius in N.RADII:
        p = math.acos(N.least_cosine(64, radius)) / math.pi
        assert abs((r.binomial(64, p, 200_000) <= radius).mean() - N.CERTAIN) < 0.005
    assert all(a > b for a, b in pairwise(N.least_cosine(64, q) for q in (3, 9, 15, 23)))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.1, 0.0]), (2, [9.0, 9.0, 9.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0]), (7, [1.0, None, 0.0]), (8, [nan, 1.0, 0.0]), (9, [inf, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [0.0, 0.0, 1.0]), (1, [1.0, 0.0, 0.0]), (11, [5.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, a int, cell int")
    c = round(2 / math.sqrt(4.01), 6)
    assert found(N.nearest(df, every=1)) == {(1, 11, 1.0, 1), (1, 2, c, 2), (1, 10, 0.0, 3), (11, 1, 1.0, 1), (11, 2, c, 2), (11, 10, 0.0, 3), (2, 1, c, 1), (2, 11, c, 2), (2, 10, 0.0, 3), (10, 1, 0.0, 1), (10, 2, 0.0, 2), (10, 11, 0.0, 3)}
    assert found(N.nearest(df, k=1, every=2)) == {(2, 1, c, 1), (10, 1, 0.0, 1)}
    assert N.nearest(df.where("false")).collect() == [] and N.nearest(df, every=13).collect() == []
    with pytest.raises(ValueError):
        N.nearest(df, k=0)
