"""Best-fit packing of documents into sequences of a fixed length.

Documents longer than a sequence fill whole sequences; what is left of them, and all shorter
ones, go by best-fit decreasing: longest first, each into the fullest open bin that still has
room. A segment tree over remaining capacities finds that bin in logarithmic time.
Best-fit decreasing needs only to know how many documents are of each size: it is run once, over
all, on runs of bins with equal room. Documents then take the places of their size by rank, so the
work is spread and the result doesn't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tables import checkpoint, discard

#: Words in a sequence; documents in a range of doc_id, about, in which those of one size are ranked by one task.
CAPACITY, SLICE_DOCS = 2048, 1 << 17


class Capacities:
    """A segment tree over remaining capacities 1 .. capacity: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        i = room + self.base
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, b: int) -> None:
        if room:
            self.bins[room].append(b)
            self._change(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The remaining capacity and number of the tightest bin with room for size, which is taken out; of equals the last put in."""
        i = size + self.base
        if not self.count[i]:
            while i & 1 or not self.count[i + 1]:  # up, until something lies to the right
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.base:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.base
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset in it of each item, which come longest first; sizes are 1 .. capacity."""
    tree, bins, offsets, n = Capacities(capacity), [], [], 0
    for size in sizes:
        found = tree.take(size)
        if found:
            room, b = found
        else:
            room, b, n = capacity, n, n + 1
        bins.append(b)
        offsets.append(capacity - room)
        tree.put(room - size, b)
    return bins, offsets


def best_fit_runs(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """What best_fit_decreasing does with so many items of each size, as runs, and how many bins there are. A run (size, from, bin, step, each,
    offset) has the items of that size from number `from` on: `each` of them go to bin `bin`, from `offset`, as many to bin + step, and so on."""
    tree = Capacities(capacity)
    stacks: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # runs of bins of equal room: (first, number, step), in the order of filling
    runs, n = [], 0

    def put(room: int, run: tuple[int, int, int]) -> None:
        if room and run[1]:
            stacks[room].append(run)
            tree.put(room, 0)

    for size in sorted((s for s, c in counts.items() if c), reverse=True):
        done, count = 0, counts[size]
        while done < count:
            found = tree.take(size)
            if found:
                room = found[0]
                first, many, step = stacks[room].pop()
                each = room // size  # a bin that stays wide enough is the tightest, so it takes the next item too
                wanted = min(many, -(-(count - done) // each))
                put(room, (first, many - wanted, step))
                first, step = first + (many - 1) * step, -step  # last put in, first taken out
            else:
                room, each, first, step = capacity, capacity // size, n, 1
                wanted = -(-(count - done) // each)
                n += wanted
            runs.append((size, done, first, step, each, capacity - room))
            items = min(count - done, wanted * each)
            full = items // each
            put(room - each * size, (first, full, step))
            if items % each:
                put(room - items % each * size, (first + full * step, 1, 1))
            done += items
    return np.array(runs, np.int64).reshape(-1, 6), n


def _place(capacity: int, runs: np.ndarray, used: int, wholes: dict[int, int]):
    """wholes: for each rest, the number of the first full bin of documents with that rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] << 44 | runs[:, 1]
        by = np.argsort(keys)
        for batch in batches:
            ids, whole, rest, number, before = (batch.column(c).to_numpy() for c in ("doc_id", "whole", "rest", "number", "before"))
            some = np.flatnonzero(rest)
            _, start, first, step, each, offset = runs[by[np.searchsorted(keys[by], rest[some] << 44 | number[some], "right") - 1]].T
            at = number[some] - start
            full = np.repeat(np.arange(len(ids)), whole)
            piece = np.arange(len(full)) - (np.cumsum(whole) - whole)[full]
            base = used + np.array([wholes[r] for r in rest.tolist()], np.int64) + before
            columns = {
                "doc_id": np.r_[ids[full], ids[some]],
                "piece": np.r_[piece, whole[some]],
                "bin": np.r_[base[full] + piece, first + at // each * step],
                "bin_offset": np.r_[np.zeros(len(full), np.int64), offset + at % each * rest[some]],
                "length": np.r_[np.full(len(full), capacity), rest[some]],
            }
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(columns["doc_id"]), np.int64)), *[pa.array(c.astype(np.int64)) for c in columns.values()]], ["pool", *columns])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, slice_docs: int = SLICE_DOCS) -> DataFrame:
    """(pool, bin, bin_offset, doc_id, piece, length): piece number `piece` of the document, its words
    piece * capacity and on, stands in bin `bin` from word bin_offset. Sizes are words
    at ASCII white space; each is placed exactly once and no bin holds more than capacity. pool is 0.

    Null, empty and blank texts have no words and no piece. Rows with a null doc_id are left
    out. Repeated rows are packed each; equal sizes go by doc_id. Documents of one size, however many, are ranked in ranges of doc_id
    of about slice_docs documents. Ids are whole numbers or can be cast to such. Other columns are ignored."""
    if capacity < 1 or slice_docs < 1:
        raise ValueError("capacity and slice_docs are at least 1")
    spark = docs.sparkSession
    sized = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(r"cast(regexp_count(text, '[^ \\t\\n\\r\\f\\x0b]+') as bigint)").alias("size")).where("size > 0")
    measured = checkpoint(spark, sized.select("doc_id", F.expr(f"size div {capacity}").alias("whole"), F.expr(f"size % {capacity}").alias("rest")))
    of_rest = {r.rest: r for r in measured.groupBy("rest").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole")).collect()}  # at most `capacity` rows
    runs, used = best_fit_runs({rest: r.n for rest, r in of_rest.items() if rest}, capacity)
    wholes, full = {}, 0
    for rest in sorted(of_rest, reverse=True):
        wholes[rest] = full
        full += of_rest[rest].whole
    slices = max(1, -(-sum(r.n for r in of_rest.values()) // slice_docs))
    sliced = checkpoint(spark, measured.repartitionByRange(slices, "doc_id").withColumn("slice", F.spark_partition_id()))
    discard(measured)
    each = Window.partitionBy("rest").orderBy("slice")
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sliced.groupBy("rest", "slice").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("w")).select("rest", "slice", earlier("n", each).alias("from_n"), earlier("w", each).alias("from_w"))
    w = Window.partitionBy("rest", "slice").orderBy("doc_id", "whole")
    ranked = sliced.join(starts, ["rest", "slice"]).withColumns({"number": F.row_number().over(w).cast("long") - 1 + F.col("from_n"), "before": earlier("whole", w) + F.col("from_w")})
    return ranked.select("doc_id", "whole", "rest", "number", "before").mapInArrow(_place(capacity, runs, used, wholes), "pool long, doc_id long, piece long, bin long, bin_offset long, length long")
