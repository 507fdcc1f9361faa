"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Documents of a source stay in as few groups as balance allows: a source is cut by hash into
groups that are small against a shard. Groups, largest first, go to the shard for which the
dot product of the group with the shard's residual capacity is highest.

Placing looks at every shard for each group, so it goes in two levels where there are many shards: coarse groups are
placed in ranges of shards first, then the groups of each range in its shards, ranges side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tables import checkpoint

#: Bytes of text in a shard; groups that fill a shard, at least; hash cells of which groups are made, at least in all and for a group; shards in a range, at most.
SHARD_BYTES, GROUPS_PER_SHARD, CELLS, CELLS_PER_GROUP, RANGE = 16 << 20, 24, 4096, 8, 512
_MEASURES = ("bytes", "tokens", "rows")


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each group: rows of sizes are (bytes, tokens, rows), in the order of placing.
    All is scaled so that each resource of each shard has capacity 1; only shards where the group fits
    are candidates, or all if it fits nowhere, and of equal products the first shard is taken."""
    total = sizes.sum(axis=0)
    load = sizes / np.where(total > 0, total / shards, 1)
    residual, out = np.ones((shards, sizes.shape[1])), np.zeros(len(sizes), np.int64)
    for i, v in enumerate(load):
        product = residual @ v
        fits = (residual >= v - 1e-12).all(axis=1)
        best = int(np.argmax(np.where(fits, product, -np.inf) if fits.any() else product))
        out[i] = best
        residual[best] -= v
    return out


def _cut(cells: DataFrame, unit: list[str], groups: float, count: int, at: Column) -> DataFrame:
    """cells (.., part, cell, bytes, tokens, rows) with the piece of its unit that each belongs to: a unit, rows equal in
    `unit`, is cut by `at`, 0 .. count - 1, into as many pieces as its share of its part makes of so many groups."""
    sums = cells.groupBy("part", *[c for c in unit if c != "part"]).agg(*[F.sum(c).alias(f"of_{c}") for c in _MEASURES])
    wholes = sums.groupBy("part").agg(*[F.sum(f"of_{c}").alias(f"all_{c}") for c in _MEASURES])
    need = F.greatest(F.lit(1), *[F.ceil(F.col(f"of_{c}") * groups / F.greatest(F.lit(1), F.col(f"all_{c}"))) for c in _MEASURES])
    pieces = sums.join(wholes, "part").select(*[F.col(c).alias(f"u_{c}") for c in unit], F.least(need, F.lit(count)).alias("pieces"))
    same = [F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in unit]
    cut = cells.join(pieces, same).withColumn("piece", F.floor(at * F.col("pieces") / count))
    return cut.drop("pieces", *[f"u_{c}" for c in unit])


def _placed_cells(cells: DataFrame, into: Callable[[int], tuple[int, int]]) -> DataFrame:
    """cells with the place of their group, the cells equal in all but cell: of each part one task places the groups, by their sums, in
    `into(part)`, the first place and how many there are."""

    def assign(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in group]).combine_chunks()
        first, places = into(t.column("part")[0].as_py())
        sizes = np.stack([t.column(c).to_numpy() for c in _MEASURES], axis=1).astype(np.float64)
        share = (sizes / np.where(sizes.sum(axis=0) > 0, sizes.sum(axis=0), 1)).max(axis=1)
        order = np.argsort(-share, kind="stable")
        to = np.empty(len(order), np.int64)
        to[order] = first + place(sizes[order], places)
        return t.select(group).append_column("place", pa.array(to))

    group = [c for c in ("source", "unit", "part", "piece") if c in cells.columns]
    types = {"source": "string"}
    sums = cells.groupBy(*group).agg(*[F.sum(c).alias(c) for c in _MEASURES])
    placed = sums.groupBy("part").applyInArrow(assign, ", ".join(f"{c} {types.get(c, 'long')}" for c in [*group, "place"]))
    same = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in group]
    return cells.join(placed.select(*[F.col(c).alias(f"g_{c}") for c in group], "place"), same).drop(*[f"g_{c}" for c in group])


def shard(docs: DataFrame, shard_bytes: int = SHARD_BYTES, groups_per_shard: int = GROUPS_PER_SHARD, cells: int = CELLS, most: int = RANGE) -> DataFrame:
    """(doc_id, source, shard) for each row of docs; shards are numbered from 0 and there are as many
    as shard_bytes makes of all text. There are at least `cells` hash cells, and more where all shards' groups, which may be
    of one source, need more. More than `most` shards are filled in ranges of about equal numbers of shards.

    Tokens are words at ASCII white space. Null and empty texts weigh only as rows. A null
    source is a source of its own, a null doc_id hashes like a value. Repeated rows are
    counted and kept, in one shard. Groups of equal size go by source and number. Other columns are ignored."""
    if min(shard_bytes, groups_per_shard, cells, most) < 1:
        raise ValueError("shard_bytes, groups_per_shard, cells and most are at least 1")
    all_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    shards = max(1, -(-all_bytes // shard_bytes))
    cells = max(cells, CELLS_PER_GROUP * groups_per_shard * shards)
    cell = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(cells))
    source = F.col("source").cast("string")
    measured = docs.select(source.alias("source"), cell.alias("cell"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), F.expr(r"coalesce(regexp_count(text, '[^ \\t\\n\\r\\f\\x0b]+'), 0)").alias("tokens"))
    spark = docs.sparkSession
    cells_ = checkpoint(spark, measured.groupBy("source", "cell").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    ranges = -(-shards // most)
    edges = [shards * i // ranges for i in range(ranges + 1)]
    coarse = _cut(cells_.withColumn("part", F.lit(0).cast("long")), ["source"], ranges * groups_per_shard, cells, F.col("cell"))
    placed = _placed_cells(coarse, lambda _: (0, ranges)).select("source", "cell", *_MEASURES, F.col("piece").alias("unit"), F.col("place").alias("part"))
    fine = _cut(checkpoint(spark, placed), ["source", "unit", "part"], shards * groups_per_shard / ranges, cells, F.pmod(F.xxhash64("cell"), F.lit(cells)))
    placed = _placed_cells(fine, lambda i: (edges[i], edges[i + 1] - edges[i])).select("source", "cell", F.col("place").alias("shard"))
    rows = docs.select("doc_id", source.alias("source"), cell.alias("cell"))
    same = rows["source"].eqNullSafe(placed["source"]) & (rows["cell"] == placed["cell"])
    return rows.join(placed, same).select("doc_id", rows["source"], "shard")
