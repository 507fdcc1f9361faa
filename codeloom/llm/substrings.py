"""Substring dedup: windows of k words that occur more than once, counted exactly.

Each window of k consecutive words has a minimiser, the smallest hash among its runs of m
words. Consecutive windows with one minimiser (about (k - m) / 2 of them) travel as one
string, a super-k-mer, to the bucket of that minimiser; equal windows have equal minimisers,
so they meet there. Super-k-mers of one bucket and batch are packed and compressed together.
In its bucket a minimiser that came once, from one place, is dropped unread; for the others
the windows themselves are sorted and counted, as bytes, so the counts are exact. There are as many buckets as
the texts' bytes need, so that what a task holds doesn't grow with the input.

A minimiser may be hot: a passage that a third of all documents have, or one word repeated for megabytes. The bytes of
minimisers are added up first, by hash in cells that are small against a bucket. Windows of hot ones don't meet in a bucket; Spark counts them by a hash of 128 bits, in
part before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import kernels as K
from codeloom.llm.tables import bitmap, checkpoint, discard, in_bitmap, split_by

WORDS, MINIMISER = 50, 4
#: Bytes of text for each bucket; bytes of super-k-mers from which a cell of minimisers is hot; cells for each bucket, at least.
BUCKET_BYTES, HOT_BYTES, CELLS = 16 << 20, 4 << 20, 64
_CODEC = "zstd"
_FLUSH = 16 << 20
_C = np.uint64(0x9E3779B97F4A7C15)


def one_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with each run of white space as one space, and none in front of a text."""
    if not len(data):
        return data, offsets
    white = K.WHITE[data]
    before = np.empty_like(white)
    before[0], before[1:] = True, white[:-1]
    heads = offsets[:-1]
    before[heads[heads < len(data)]] = True
    keep = ~(white & before)
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return np.where(white, np.uint8(32), data)[keep], kept[offsets]


def super_kmers(data: np.ndarray, offsets: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """document, number of its first window, minimiser, whether it has that minimiser at several
    places, first byte and end byte of each super-k-mer."""
    starts, ends, first = K.words(data, offsets)
    windows = len(starts) - k + 1
    if windows < 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none, none
    h = K.span_hashes(data, starts, ends)
    grams = h[: len(h) - m + 1].copy()
    for i in range(1, m):
        grams = K.mix(grams * _C + h[i : len(h) - m + 1 + i])
    least = K.sliding_min(grams, k - m + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[:windows]
    valid = np.arange(windows) + k <= first[1:][doc]
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, at.astype(np.uint64), at, at, at
    new = np.r_[True, (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])]
    head = at[new]
    many = np.diff(np.r_[np.flatnonzero(new), len(at)])
    grams_in = many + k - m
    ahead = np.cumsum(grams_in) - grams_in
    same = grams[np.repeat(head - ahead, grams_in) + np.arange(grams_in.sum())] == np.repeat(least[head], grams_in)
    several = np.add.reduceat(same, ahead, dtype=np.int32) > 1
    return doc[head], head - first[doc[head]], least[head], several, starts[head], ends[head + many + k - 2]


def _cell(minimiser: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(minimiser ^ _C) >> np.uint64(64 - bits)).astype(np.int64)


def _weights(k: int, m: int, bits: int):
    """(cell, bytes) of the super-k-mers of each piece of text, added up there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "text"):
            data, offsets = one_space(*K.flat(piece.column("text")))
            _, _, minimiser, _, begin, end = super_kmers(data, offsets, k, m)
            values, at = np.unique(_cell(minimiser, bits), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.bincount(at, end - begin, len(values)).astype(np.int64))], ["cell", "bytes"])

    return run


def _hot_windows(k: int, m: int, hot: np.ndarray, bits: int):
    """(key, doc_id, start, h1, h2): each window of a hot minimiser, with its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "text"):
            data, offsets = one_space(*K.flat(piece.column("text")))
            doc, start, minimiser, _, begin, end = super_kmers(data, offsets, k, m)
            some = np.flatnonzero(in_bitmap(hot, _cell(minimiser, bits))) if len(doc) else []
            if not len(some):
                continue
            starts, ends, first = K.words(data, offsets)
            h = K.span_hashes(data, starts, ends)
            h1, h2 = K.rolling(h, k), K.rolling(K.mix(h ^ _C), k)
            head = first[doc[some]] + start[some]
            many = np.searchsorted(starts, end[some]) - head - k + 1
            for a in range(0, len(some), 1 << 14):  # a window is many bytes of text
                n = many[a : a + (1 << 14)]
                at = np.repeat(head[a : a + (1 << 14)] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                of = np.repeat(doc[some[a : a + (1 << 14)]], n)
                columns = (piece.column("key").to_numpy()[of], piece.column("doc_id").to_numpy()[of], (at - first[of]).astype(np.int32), h1[at].view(np.int64), h2[at].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc_id", "start", "h1", "h2"])

    return run


def _scatter(k: int, m: int, buckets: int, hot: np.ndarray | None, bits: int):
    def flush(held: dict[int, list[tuple[bytes, ...]]]) -> pa.RecordBatch:
        rows = []
        for parts in held.values():
            columns = [b"".join(c) for c in zip(*parts, strict=True)]
            head, codec = b"".join(columns[:-1]), pa.Codec(_CODEC, 3)
            small = codec.compress(head, asbytes=True)
            rows.append(np.array([len(head), len(columns[-1]), len(small)], np.int64).tobytes() + small + codec.compress(columns[-1], asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(rows, pa.binary())], ["bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, ...]]] = {}
        size = 0
        for piece in K.pieces(batches, "text"):
            data, offsets = one_space(*K.flat(piece.column("text")))
            doc, start, minimiser, several, begin, end = super_kmers(data, offsets, k, m)
            if not len(doc):
                continue
            keys, ids = piece.column("key").to_numpy()[doc], piece.column("doc_id").to_numpy()[doc]
            bucket = (K.mix(minimiser) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            if hot is not None:
                order = order[~in_bitmap(hot, _cell(minimiser[order], bits))]
                if not len(order):
                    continue
            raw = data.tobytes()
            cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                o = order[a:b]
                text = b"".join([raw[x:y] for x, y in zip(begin[o].tolist(), end[o].tolist(), strict=True)])
                part = (minimiser[o].tobytes(), keys[o].tobytes(), ids[o].tobytes(), start[o].astype(np.int32).tobytes(), several[o].astype(np.int32).tobytes(), (end[o] - begin[o]).astype(np.int32).tobytes(), text)
                held.setdefault(int(bucket[order[a]]), []).append(part)
                size += len(text)
            if size >= _FLUSH:
                yield flush(held)
                held, size = {}, 0
        if held:
            yield flush(held)

    return run


def _heads(payload: pa.Scalar) -> tuple[np.ndarray, ...]:
    """minimiser, key, doc_id, first window, whether it has the minimiser at several places and bytes of each super-k-mer."""
    raw = payload.as_buffer()
    size, _, small = np.frombuffer(raw, np.int64, 3).tolist()
    data, n = pa.Codec(_CODEC).decompress(raw.slice(24, small), size), size // 36
    wide = [np.frombuffer(data, t, n, 8 * n * i) for i, t in enumerate((np.uint64, np.int64, np.int64))]
    return *wide, *(np.frombuffer(data, np.int32, n, 24 * n + 4 * n * i) for i in range(3))


def _text(payload: pa.Scalar) -> bytes:
    raw = payload.as_buffer()
    _, size, small = np.frombuffer(raw, np.int64, 3).tolist()
    return pa.Codec(_CODEC).decompress(raw.slice(24 + small), size, asbytes=True)


def count_windows(strings: dict[bytes, list[tuple[int, int, int]]], k: int) -> list[tuple[int, int, int, int, int, bool]]:
    """strings: super-k-mers of one minimiser, each with the (doc_id, key, first window) where it stands.
    Gives runs (doc_id, key, first window, windows, copies, is_first) of windows that occur at least twice;
    copies is the most among the run's windows, is_first whether they are the first occurrences."""
    windows, counts, firsts, at = [], [], [], []
    for sid, (s, places) in enumerate(strings.items()):
        ends = np.flatnonzero(np.frombuffer(s, np.uint8) == 32).tolist() + [len(s)]
        begins = [0] + [e + 1 for e in ends[:-1]]
        n = len(ends) - k + 1
        windows += [(s[begins[i] : ends[i + k - 1]], sid, i) for i in range(n)]
        counts.append([0] * n)
        firsts.append([False] * n)
        at.append(sorted(set(places)))
    windows.sort()
    for _, run in groupby(windows, key=lambda w: w[0]):
        same = [(sid, i) for _, sid, i in run]
        n = sum(len(at[sid]) for sid, _ in same)
        if n > 1:
            lead = min(same, key=lambda x: (*at[x[0]][0][:2], at[x[0]][0][2] + x[1]))
            for sid, i in same:
                counts[sid][i] = n
            firsts[lead[0]][lead[1]] = True
    out = []
    for n, f, places in zip(counts, firsts, at, strict=True):
        later = _runs(n, [False] * len(n))  # only a string's first place can hold first occurrences
        for p, (doc, key, start) in enumerate(places):
            out += [(doc, key, start + i, many, most, flag) for i, many, most, flag in (later if p else _runs(n, f))]
    return out


def _runs(counts: list[int], flags: list[bool]) -> list[tuple[int, int, int, bool]]:
    out, i = [], 0
    while i < len(counts):
        j = i + 1
        if counts[i] > 1:
            while j < len(counts) and counts[j] > 1 and flags[j] == flags[i]:
                j += 1
            out.append((i, j - i, max(counts[i:j]), flags[i]))
        i = j
    return out


_RUNS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("copies", pa.int64()), ("is_first", pa.bool_())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * len(_RUNS), _RUNS, strict=True)], schema=_RUNS)


def _count(k: int):
    """Of the payloads of a bucket the texts are unpacked one after the other, and only where some minimiser came often."""

    def run(table: pa.Table) -> pa.Table:
        payloads = list(table.column("payload"))
        parts = [_heads(p) for p in payloads]
        _, at, times = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
        often = (times[at] > 1) | (np.concatenate([p[4] for p in parts]) > 0)
        groups: dict[int, dict[bytes, list[tuple[int, int, int]]]] = {}
        done = 0
        for payload, (_, keys, ids, starts, _, sizes) in zip(payloads, parts, strict=True):
            some = np.flatnonzero(often[done : done + len(keys)])
            if len(some):
                ends, raw, mine = np.cumsum(sizes.astype(np.int64)), _text(payload), at[done : done + len(keys)]
                for i in some.tolist():
                    s = raw[ends[i] - sizes[i] : ends[i]]
                    groups.setdefault(int(mine[i]), {}).setdefault(s, []).append((int(ids[i]), int(keys[i]), int(starts[i])))
            done += len(keys)
        del parts, payloads, at, often
        found, rows = [], []
        for g in list(groups):
            rows += count_windows(groups.pop(g), k)
            if len(rows) >= 1 << 14:
                found.append(_table(rows))
                rows = []
        found.append(_table(rows))
        del rows, groups
        K.release()
        return pa.concat_tables(found)

    return run


def repeated_windows(docs: DataFrame, k: int = WORDS, m: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Runs (doc_id, key, start, windows, copies, is_first) of consecutive windows of k words that
    occur at least twice in the corpus, in one document or in several. key is xxhash64(doc_id, text).
    Of equal windows the one of the smallest (doc_id, key, start) is the first.

    Words are split at ASCII white space and compared byte by byte (windows of hot minimisers by 128 bits of hash). Texts of fewer than k words,
    null and empty ones have no windows. Rows with a null doc_id are left out; rows equal in
    doc_id and text are one document. Ids are whole numbers or can be cast to such. Other columns are ignored."""
    if not 0 < m <= k:
        raise ValueError("m is in 1 .. k")
    spark = docs.sparkSession
    K.bound_batches(spark)
    base = docs.where("doc_id is not null and text is not null").select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    buckets = max(1, -(-total // bucket_bytes))
    bits = (CELLS * buckets).bit_length()
    weights = base.select("text").mapInArrow(_weights(k, m, bits), "cell long, bytes long").groupBy("cell").agg(F.sum("bytes").alias("bytes"))
    heavy = checkpoint(spark, weights.where(F.col("bytes") > hot_bytes).select("cell"))
    hot = bitmap(heavy) if not heavy.isEmpty() else None
    discard(heavy)
    schema = "doc_id long, key long, start int, windows int, copies long, is_first boolean"
    counted = base.mapInArrow(_scatter(k, m, buckets, hot, bits), "bucket int, payload binary").groupBy("bucket").applyInArrow(_count(k), schema)
    if hot is None:
        return counted
    windows = base.mapInArrow(_hot_windows(k, m, hot, bits), "key long, doc_id long, start int, h1 long, h2 long").distinct()  # repeated rows are one document
    often = checkpoint(spark, windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "key", "start")).alias("lead")).where("copies > 1"))
    is_first = (F.col("doc_id") == F.col("lead.doc_id")) & (F.col("key") == F.col("lead.key")) & (F.col("start") == F.col("lead.start"))
    return counted.unionByName(windows.join(often, ["h1", "h2"]).select("doc_id", "key", "start", F.lit(1).alias("windows"), "copies", is_first.alias("is_first")))


def repeated_passages(docs: DataFrame, k: int = WORDS, m: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, start_word, end_word, copies): maximal runs of repeated windows, as words
    start_word .. end_word - 1 of the document; copies is the most often any of the windows occurs.
    First occurrences are listed like the others. For nulls and empty texts see `repeated_windows`."""
    runs = repeated_windows(docs, k, m, bucket_bytes, hot_bytes)
    w = Window.partitionBy("doc_id", "key").orderBy("start")
    new = F.coalesce((F.col("start") != F.lag(F.col("start") + F.col("windows")).over(w)).cast("int"), F.lit(1))
    islands = runs.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return islands.groupBy("doc_id", "key", "island").agg(F.min("start").alias("start_word"), (F.max(F.col("start") + F.col("windows")) + (k - 1)).alias("end_word"), F.max("copies").alias("copies")).drop("key", "island")


def _cut(k: int):
    @F.arrow_udf("string")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, mine in zip(texts, runs, strict=True):
            if not text.is_valid:
                out.append(None)
                continue
            raw = np.frombuffer(text.as_buffer(), np.uint8)
            starts, _, _ = K.words(raw, np.array([0, len(raw)]))
            edges = np.r_[starts, len(raw)]
            gone = np.zeros(len(raw) + 1, np.int64)
            for r in mine.as_py():
                gone[edges[r["start"]]] += 1
                gone[edges[min(r["start"] + r["windows"] + k - 1, len(starts))]] -= 1
            out.append(raw[np.cumsum(gone)[:-1] == 0].tobytes().decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return cut


def without_repeats(docs: DataFrame, k: int = WORDS, m: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """docs with the words of repeated windows taken out, but for the first occurrence of each window;
    n_chars, where there is such a column, is set anew. A document of which no word is left goes.
    Rows with null doc_id or null text, and all other columns, stay as they are. Only texts that may have something to cut are shuffled."""
    key, runs, new = "__codeloom_key", "__codeloom_runs", "__codeloom_text"
    later = repeated_windows(docs, k, m, bucket_bytes, hot_bytes).where("not is_first")
    mine = checkpoint(docs.sparkSession, later.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("start", "windows")).alias(runs)))
    keyed = docs.withColumn(key, F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), "text")))
    maybe, never = split_by(keyed, key, mine.select(key))
    text = F.when(F.col(runs).isNotNull(), F.col("text"))
    joined = maybe.join(mine, key, "left").withColumn(new, _cut(k)(text, F.col(runs)))
    out = joined.where(F.col(new).isNull() | F.col(new).rlike(r"[^ \t\n\r\f\x0b]")).withColumn("text", F.coalesce(new, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns).unionByName(never.select(*columns))
