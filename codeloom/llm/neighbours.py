"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation fitted by iterative quantisation turns each vector into a code of one bit a
dimension. Codes are split into substrings, each indexed on its own. Two codes within a
Hamming radius r agree in at least one of m substrings up to floor(r / m) bits, so probing every
substring's index that far finds every code within the radius. What is found is reranked, where it is
found, by the cosine of the float vectors, and of each cell only the k best of a query travel on.

The index of a substring is dealt by its leading bits to cells; a query visits only the
cells that can hold something within reach, and cells with many codes are cut into parts.

The radius grows in rounds. A query is done when its k-th cosine is so high that a vector as near would lie beyond the
radius with a probability of at most 1 - CERTAIN. Queries whose neighbours are farther than the last radius, where
substrings would prune nothing, are compared with all vectors, in blocks, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import acos, ceil, comb, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import kernels as K
from codeloom.llm.tables import checkpoint

#: Rows whose vec_id is divisible by this are the queries; neighbours of each.
EVERY, NEAREST = 50, 10
#: Hamming radii of the rounds; substrings of a code; vectors that the rotation is fitted on: those of the smallest md5 of their ids.
RADII, PARTS, SAMPLE_ROWS = (15, 23), 4, 4096
#: With what probability a neighbour as far as the k-th is in reach when a query is done.
CERTAIN = 0.95
#: Codes that a part of a cell holds, about; float values in a block of vectors.
CELL_CODES, BLOCK_VALUES = 65_536, 1 << 20
_PAIRS = 1 << 20
_STRIP = 512


def fit_rotation(vectors: np.ndarray, bits: int, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal axes, rotated so that signs lose as little as possible. Vectors aren't centred, so mean
    is 0: codes have to tell angles at the origin, and about any other point the same pair has a wider one."""
    _, _, axes = np.linalg.svd(vectors, full_matrices=False)
    if len(axes) < bits:
        axes = np.linalg.qr(np.c_[axes.T, np.random.default_rng(seed).normal(size=(vectors.shape[1], bits))])[0].T
    axes = axes[:bits].T
    flat = vectors @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(flat @ rotation >= 0, 1.0, -1.0).T @ flat)
        rotation = (u @ v).T
    return np.zeros(vectors.shape[1]), axes @ rotation


def codes_of(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = (vectors - mean) @ projection >= 0
    weight = np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64)
    return (bits * weight).sum(axis=1, dtype=np.uint64)


@cache
def masks(width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All values of `width` bits with at most `most` bits set, and how many are."""
    every = [np.array([sum(1 << b for b in c) for c in combinations(range(width), n)], np.int64) for n in range(min(width, most) + 1)]
    return np.concatenate(every), np.repeat(np.arange(len(every)), [len(x) for x in every])


def least_cosine(bits: int, radius: int, certain: float = CERTAIN) -> float:
    """The least cosine from which on a code lies within the radius with that probability: each bit differs with probability angle / pi."""
    low, high = -1.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        p = acos(middle) / pi
        within = sum(comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(min(radius, bits) + 1))
        low, high = (low, middle) if within >= certain else (middle, high)
    return high


class Layout:
    """How codes of `bits` bits are cut: substring i has widths[i] bits from shifts[i]; its leading cell_bits name the cell."""

    def __init__(self, bits: int, parts: int, count: int):
        edges = np.linspace(0, bits, parts + 1).astype(int)
        self.shifts, self.widths = edges[:-1].tolist(), np.diff(edges).tolist()
        wanted = ceil(log2(max(1, count / CELL_CODES)))
        self.cell_bits = [min(w, max(4 if w >= 8 else w // 2, wanted)) for w in self.widths]

    def substring(self, codes: np.ndarray, i: int) -> np.ndarray:
        return ((codes >> np.uint64(self.shifts[i])) & np.uint64((1 << self.widths[i]) - 1)).astype(np.int64)


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("vec_id").to_numpy()
    return ids, batch.column("embedding").flatten().to_numpy().reshape(len(ids), -1)


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _pack(ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray) -> bytes:
    return ids.tobytes() + codes.tobytes() + vectors.tobytes()


def _unpack(payload: bytes, d: int, dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(payload) // (16 + d * np.dtype(dtype).itemsize)
    return np.frombuffer(payload, np.int64, n), np.frombuffer(payload, np.uint64, n, 8 * n), np.frombuffer(payload, dtype, n * d, 16 * n).reshape(n, d)


def _deal(layout: Layout, mean: np.ndarray, projection: np.ndarray, dtype: str, reach: int | None):
    """(cell, kind, n, payload): without a reach the index, each vector in the cell of each substring, as kind 0; with one the
    queries, in each cell within reach, as kind 1 + the number of leading bits that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = _vectors(batch)
            vectors = vectors.astype(dtype)
            codes = codes_of(_units(vectors), mean, projection)
            for i, width in enumerate(layout.widths):
                cell = layout.substring(codes, i) >> (width - layout.cell_bits[i])
                order = np.argsort(cell, kind="stable")
                cuts = np.r_[0, np.flatnonzero(np.diff(cell[order])) + 1, len(order)]
                near, differ = masks(layout.cell_bits[i], reach) if reach is not None else (np.zeros(1, np.int64), np.full(1, -1))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    o = order[a:b]
                    cells = i << 32 | (cell[o[0]] ^ near)
                    payload = _pack(ids[o], codes[o], vectors[o])
                    step = max(1, (8 << 20) // len(payload))
                    for at in range(0, len(cells), step):
                        n = len(cells[at : at + step])
                        yield pa.RecordBatch.from_arrays([pa.array(cells[at : at + step]), pa.array((differ[at : at + step] + 1).astype(np.int32)), pa.array(np.full(n, len(o), np.int32)), pa.array([payload] * n, pa.binary())], ["cell", "kind", "n", "payload"])

    return run


def first_k(of: np.ndarray, ids: np.ndarray, near: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """(of, *more or ids, near) of the k nearest for each value of `of`; equal ones go by id."""
    order = np.lexsort((ids, -near, of))
    of, near = of[order], near[order]
    first = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[first], *[x[order][first] for x in more or (ids,)], near[first]


def _found(ids: np.ndarray, others: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others), pa.array(near)], ["vec_id", "neighbour_id", "cosine"])


def _probe(layout: Layout, radius: int, d: int, dtype: str, k: int):
    """Rows come by cell and part, and of each the indexed codes (kind 0) before the queries. Gives each query's k nearest among the codes within the radius."""
    reach = radius // len(layout.widths)

    def search(built: tuple[np.ndarray, ...], part: int, differ: int, payload: bytes) -> Iterator[pa.RecordBatch]:
        ids, codes, vectors, starts = built
        low = layout.widths[part] - layout.cell_bits[part]
        mine, asked, floats = _unpack(payload, d, dtype)
        floats = _units(floats)
        probes, _ = masks(low, reach - differ)
        step = max(1, _PAIRS // max(len(probes), len(probes) * len(ids) >> low))
        for at in range(0, len(mine), step):
            c = asked[at : at + step]
            value = ((layout.substring(c, part) & ((1 << low) - 1))[:, None] ^ probes[None, :]).ravel()
            many = starts[value + 1] - starts[value]
            of = np.repeat(np.repeat(np.arange(len(c)), len(probes)), many)
            other = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[value], many)
            good = (np.bitwise_count(c[of] ^ codes[other]) <= radius) & (mine[at + of] != ids[other])
            of, other = of[good] + at, other[good]
            near = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", floats[of[i : i + 65536]], _units(vectors[other[i : i + 65536]])) for i in range(0, len(of), 65536)]])
            of, found, near = first_k(of, ids[other], np.round(near, 6), k)
            if len(of):
                yield _found(mine[of], found, near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, built = None, [], ()
        for batch in batches:
            for cell, sub, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("cell", "sub", "kind", "payload")), strict=True):
                if (cell, sub) != here:
                    here, held, built = (cell, sub), [], ()
                if kind == 0:
                    held.append(_unpack(payload, d, dtype))
                elif held:
                    part = cell >> 32
                    if not built:
                        ids, codes, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                        low = layout.widths[part] - layout.cell_bits[part]
                        key = layout.substring(codes, part) & ((1 << low) - 1)
                        order = np.argsort(key, kind="stable")
                        built = ids[order], codes[order], vectors[order], np.searchsorted(key[order], np.arange((1 << low) + 1))
                    yield from search(built, part, kind - 1, payload)

    return run


def nearest_in(ids: np.ndarray, units: np.ndarray, other_ids: np.ndarray, others: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, others' ids, cosines): for each of units the k nearest of others, without itself.
    Cosines are rounded to 6 digits and equal ones go by id."""
    wide = max(1, len(others) // 128)
    whole = len(others) // wide * wide
    for at in range(0, len(units), _STRIP):
        cosine = units[at : at + _STRIP] @ others.T
        mine = ids[at : at + _STRIP]
        cosine[mine[:, None] == other_ids[None, :]] = -np.inf
        least = np.full(len(mine), -2.0)
        if whole // wide >= k:  # k groups have a value so high
            most = cosine[:, :whole].reshape(len(mine), -1, wide).max(axis=2)
            least = np.partition(most, most.shape[1] - k, axis=1)[:, -k]
        row, column = np.nonzero(cosine >= (least - 2e-6)[:, None])
        near = np.round(cosine[row, column], 6)
        row, column, near = (x[np.isfinite(near)] for x in (row, column, near))
        row, column, near = first_k(row, other_ids[column], near, k, column)
        yield mine[row], other_ids[column], near


def _spread(mine: int, others: int, dtype: str, query: bool):
    """Deals vectors by hash of their ids to blocks, and each block to its meetings with all blocks of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = _vectors(batch)
            block = (K.mix(ids.view(np.uint64)) % np.uint64(mine)).astype(np.int64)
            for b in np.unique(block).tolist():
                o = np.flatnonzero(block == b)
                payload = _pack(ids[o], np.zeros(len(o), np.uint64), vectors[o].astype(dtype))
                for j in range(others):
                    yield pa.RecordBatch.from_arrays([pa.array([b * others + j if query else j * mine + b], pa.int64()), pa.array([query]), pa.array([payload], pa.binary())], ["meeting", "query", "payload"])

    return run


def _meet(d: int, dtype: str, k: int):
    def side(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, _, vectors = zip(*[_unpack(p, d, dtype) for p in rows.column("payload").to_pylist()], strict=True)
        return np.concatenate(ids), _units(np.concatenate(vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in K.grouped(batches, "meeting"):
            asked, held = (rows.filter(x) for x in (rows.column("query"), pc.invert(rows.column("query"))))
            if asked.num_rows and held.num_rows:
                for a, b, cosine in nearest_in(*side(asked), *side(held), k):
                    if len(a):
                        yield _found(a, b, cosine)

    return run


_FOUND = "vec_id long, neighbour_id long, cosine double"


def _scan(queries: DataFrame, vectors: DataFrame, d: int, asked: int, count: int, dtype: str, k: int) -> DataFrame:
    """At least the k nearest of each query, by comparing it with all vectors: every block of queries meets every block of vectors."""
    rows = max(256, BLOCK_VALUES // d)
    q, v = max(1, ceil(asked / rows)), max(1, ceil(count / rows))
    schema = "meeting long, query boolean, payload binary"
    both = queries.mapInArrow(_spread(q, v, dtype, True), schema).unionByName(vectors.mapInArrow(_spread(v, q, dtype, False), schema))
    return both.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(_meet(d, dtype, k), _FOUND)


def _clean(vectors: DataFrame) -> tuple[DataFrame, int, int, str] | None:
    """The vectors that count, one for each vec_id, their dimension, about how many they are, and the type that holds their values."""
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    rows = rows.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(norm > 0)
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None
    d, count = sizes[0]["d"], sizes[0]["count"]
    once = rows.where(F.size("embedding") == d).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return checkpoint(vectors.sparkSession, once), d, count, "f4" if kind == "float" else "f8"


def _ranked(near: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, numbered."""
    w = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour_id")
    return near.groupBy("vec_id", "neighbour_id").agg(F.max("cosine").alias("cosine")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, radii: tuple[int, ...] = RADII, parts: int = PARTS, sample_rows: int = SAMPLE_ROWS, certain: float = CERTAIN) -> DataFrame:
    """(vec_id, neighbour_id, cosine, rank): for every vector whose vec_id is divisible by `every`, the k nearest of all
    other vectors by cosine, rounded to 6 digits; equal ones go by neighbour_id. With fewer than k others, all of them.

    Every vector is indexed; only the rotation is fitted on a sample. A neighbour is missed with a probability of
    about 1 - certain at the most, and none of a query that is compared with all vectors.

    Vectors that are null, empty, zero, of another length than most, or have a null or non-finite
    value have no neighbours and are none; so are rows with a null vec_id. Of several rows of one vec_id the smallest
    vector counts. Ids are whole numbers or can be cast to such. Other columns are ignored."""
    if k < 1 or every < 1:
        raise ValueError("k and every are at least 1")
    spark = vectors.sparkSession
    K.bound_batches(spark)
    found = _clean(vectors)
    if not found:
        return spark.createDataFrame([], f"{_FOUND}, rank int")
    clean, d, count, dtype = found
    queries = clean.where(F.col("vec_id") % every == 0)
    sample = np.array([r.embedding for r in clean.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(sample_rows).collect()], np.float64)
    bits = min(64, d)
    mean, projection = fit_rotation(_units(sample), bits)
    layout = Layout(bits, min(parts, bits), count)
    schema = "cell long, kind int, n int, payload binary"
    index = checkpoint(spark, clean.mapInArrow(_deal(layout, mean, projection, dtype, None), schema))
    sizes = checkpoint(spark, index.groupBy("cell").agg(F.ceil(F.sum("n") / CELL_CODES).alias("subs")))
    placed = index.join(sizes, "cell").select("cell", F.expr("pmod(xxhash64(payload), subs)").alias("sub"), "kind", "payload")
    answers = []
    for radius in radii:
        reach = min(radius, bits) // len(layout.widths)
        asked = queries.mapInArrow(_deal(layout, mean, projection, dtype, reach), schema).join(sizes, "cell").select("cell", F.explode(F.expr("sequence(0L, subs - 1)")).alias("sub"), "kind", "payload")
        met = placed.unionByName(asked).repartition("cell", "sub").sortWithinPartitions("cell", "sub", "kind")
        best = checkpoint(spark, _ranked(met.mapInArrow(_probe(layout, min(radius, bits), d, dtype, k), _FOUND), k))
        done = best.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).where((F.col("n") == k) & (F.col("least") >= least_cosine(bits, radius, certain))).select("vec_id")
        answers.append(best.join(done, "vec_id", "left_semi"))
        queries = checkpoint(spark, queries.join(done, "vec_id", "left_anti"))
    left = queries.count()
    if left:
        answers.append(_ranked(_scan(queries, clean, d, left, count, dtype, k), k))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out
