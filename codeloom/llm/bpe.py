"""BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of all new words at once, walking a trie of the
vocabulary in lockstep. A sequence is what exact merging gives if and only if every adjacent
pair is compatible, that is, merging its two tokens' bytes alone gives these two tokens back; all
distinct pairs are tested side by side by undoing merges along the boundary. Only words with an
incompatible pair are merged exactly. The vocabulary file, one base64 token and rank a line, is a parameter.
"""

from __future__ import annotations

import base64
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import kernels as K

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The letters that with an apostrophe are a contraction.
SHORT = np.frombuffer(b"sdmt", np.uint8)
#: Bytes of text that are worked on at a time.
PIECE = 1 << 20
#: Words of up to so many bytes are merged side by side, each length with those up to the next; longer ones one by one, with a heap.
LOCKSTEP = (4, 6, 8, 10, 12, 16, 24, 40)
#: Words of which a worker keeps the tokens.
KEPT_WORDS = 500_000


_NONE = 1 << 60


def merge(word: bytes, ranks: dict[bytes, int], below: int = _NONE) -> list[int]:
    """Exact merging: the adjacent pair of lowest rank, leftmost first, until none is left of rank under `below`."""
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) < below:
        at = pairs.index(low)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], _NONE)
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], _NONE)
    return [ranks[p] for p in parts]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge(), with a heap, for words where rescanning all pairs would be slow."""
    import heapq

    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or not alive[end[i]]:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


@cache
def kinds() -> np.ndarray:
    """For each code point its class: 0 a letter, 1 a number, 2 white space, 3 anything else, as PATTERN has them."""
    import regex

    out = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, range(0xD800)))
    more = "".join(map(chr, range(0xE000, 0x110000)))
    for text, base in ((every, 0), (more, 0xE000)):
        for kind, pattern in enumerate((r"\p{L}+", r"\p{N}+", r"\s+")):
            for m in regex.finditer(pattern, text):
                out[base + m.start() : base + m.end()] = kind
    return out


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each match of PATTERN in texts of UTF-8; matches cover the texts.

    A match is a run of one class, but: white space in front of other text leaves its last character, which joins what
    follows if it is a space and stands alone if it isn't; and of an apostrophe alone and letters, contractions are cut off."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none
    lead = None
    points, heads = data, offsets[:-1]
    if int(data.max()) > 127:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        heads = np.searchsorted(lead, heads)
    m = len(points)
    kind = kinds()[points]
    head = np.zeros(m + 3, bool)
    head[heads] = True
    head[m:] = True
    start = head[: m + 1].copy()
    start[1:m] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:m] & (kind[1:] != 2) & (kind[:-1] == 2) & ~head[1:m]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    mark = np.flatnonzero((points == 39) & start[:m])
    mark = mark[~head[mark + 1]]
    mark = mark[kind[mark + 1] == 0]
    one = points[mark + 1]
    two = np.where(head[mark + 2], 0, points[np.minimum(mark + 2, m - 1)])
    short = np.isin(one, SHORT)
    long = ((one == 108) & (two == 108)) | (((one == 118) | (one == 114)) & (two == 101))
    start[mark[short | long] + 1] = False
    start[mark[short] + 2] = True
    start[mark[long] + 3] = True
    at = np.flatnonzero(start[:m])
    starts = at if lead is None else lead[at]
    return starts, np.r_[starts[1:], n]


def _well_formed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts, with U+FFFD for what isn't UTF-8."""
    try:
        data.tobytes().decode()
        return data, offsets
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
        return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]


class Encoder:
    def __init__(self, path: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        if any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        size = max(self.ranks.values()) + 1
        self.left = np.arange(size)
        self.right = np.arange(size)
        pairs = []
        for token, rank in self.ranks.items():
            if len(token) > 1:
                halves = merge(token, self.ranks, rank)
                if len(halves) != 2:
                    raise ValueError(f"no merge makes token {rank}")
                self.left[rank], self.right[rank] = halves
                pairs.append((halves[0] * size + halves[1], rank))
        pairs.sort()
        self.size = size
        self.pair, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        joins = sorted((a * size + b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None)
        self.joins, self.joined = (np.array(x, np.int64) for x in zip(*joins, strict=True))
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)])
        self._grow_trie()
        blob = [b""] * size
        for token, rank in self.ranks.items():
            blob[rank] = token
        self.lengths = np.array([len(b) for b in blob])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.word_tokens, self.word_begin, self.word_count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _grow_trie(self) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        edges, accepts = [], [-1]
        for token in sorted(self.ranks):
            for i in range(1, len(token) + 1):
                if token[:i] not in nodes:
                    nodes[token[:i]] = len(nodes)
                    accepts.append(-1)
                    edges.append((nodes[token[: i - 1]] * 256 + token[i - 1], nodes[token[:i]]))
            accepts[nodes[token]] = self.ranks[token]
        edges.sort()
        self.edge, self.to = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.accept = np.array(accepts)

    def longest_match(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, and for each the number of its word, in order."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        word = np.arange(len(words))
        start = ends - np.array([len(w) for w in words])
        live = start < ends
        word, start = word[live], start[live]
        at, node = start.copy(), np.zeros(len(word), np.int64)
        token, after = np.full(len(word), -1), start.copy()
        out_word, out_token = [], []
        while len(word):
            inside = at < ends[word]
            key = node * 256 + data[np.minimum(at, len(data) - 1)]
            e = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            go = inside & (self.edge[e] == key)
            node = np.where(go, self.to[e], 0)
            at = at + go
            hit = go & (self.accept[node] >= 0)
            token, after = np.where(hit, self.accept[node], token), np.where(hit, at, after)
            stop = ~go
            if stop.any():
                out_word.append(word[stop])
                out_token.append(token[stop])
                at = np.where(stop, after, at)
                keep = ~stop | (at < ends[word])
                word, at, node, token, after = word[keep], at[keep], node[keep], token[keep], after[keep]
        if not out_word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        w, t = np.concatenate(out_word), np.concatenate(out_token)
        order = np.argsort(w, kind="stable")
        return t[order], w[order]

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether no merge joins bytes across their boundary. Merges are undone, the
        latest first, on the side that was merged later; a pair that would have merged before that is incompatible."""
        a, b = first.copy(), second.copy()
        limit = np.full(len(a), 1 << 60)
        good, alive = np.ones(len(a), bool), np.arange(len(a))
        while len(alive):
            x, y, top = a[alive], b[alive], limit[alive]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            bad = (self.pair[at] == key) & (self.merged[at] < top)
            good[alive[bad]] = False
            alive, x, y = alive[~bad], x[~bad], y[~bad]
            left_base, right_base = self.right[x] == x, self.left[y] == y
            undo_left = np.where(x > y, ~left_base, right_base)
            done = left_base & right_base
            limit[alive] = np.where(undo_left, x, y + 1)
            a[alive] = np.where(undo_left, self.right[x], x)
            b[alive] = np.where(undo_left, y, self.left[y])
            alive = alive[~done]
        return good

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, and how many each word has."""
        tokens, word = self.longest_match(words)
        inner = np.flatnonzero(word[:-1] == word[1:])
        pairs, at = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)
        failing = np.unique(word[inner[~fine[at]]])
        if len(failing):
            kept = ~np.isin(word, failing)
            found, of = self.merged_words([words[i] for i in failing.tolist()])
            tokens, word = np.r_[tokens[kept], found], np.r_[word[kept], failing[of]]
            order = np.argsort(word, kind="stable")
            tokens, word = tokens[order], word[order]
        return tokens.astype(np.int32), np.bincount(word, minlength=len(words))

    def merged_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens by exact merging of all words, and for each the number of its word; words of about one length are merged in lockstep."""
        sizes = np.array([len(w) for w in words])
        tokens, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low = 0
        for high in LOCKSTEP:
            mine = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            if not len(mine):
                continue
            parts = np.full((len(mine), high + 1), -1)
            parts[np.arange(high + 1) < sizes[mine][:, None]] = self.single[np.frombuffer(b"".join([words[i] for i in mine.tolist()]), np.uint8)]
            ranks = self._join_rank(parts[:, :-1], parts[:, 1:])
            while len(mine):
                row, j = np.arange(len(mine)), ranks.argmin(axis=1)
                done = ranks[row, j] == _NONE
                if done.any():
                    held = parts[done] >= 0
                    tokens.append(parts[done][held])
                    of.append(np.repeat(mine[done], held.sum(axis=1)))
                    mine, parts, ranks, j = mine[~done], parts[~done], ranks[~done], j[~done]
                    row = np.arange(len(mine))
                    if not len(mine):
                        break
                n = parts.shape[1] - 1
                parts[row, j] = ranks[row, j]
                gone = np.ones(parts.shape, bool)
                gone[row, j + 1] = False
                parts = parts[gone].reshape(len(mine), n)
                gone = np.ones(ranks.shape, bool)
                gone[row, j] = False
                ranks = ranks[gone].reshape(len(mine), n - 1)
                left, right = np.flatnonzero(j > 0), np.flatnonzero(j < n - 1)
                ranks[left, j[left] - 1] = self._join_rank(parts[left, j[left] - 1], parts[left, j[left]])
                ranks[right, j[right]] = self._join_rank(parts[right, j[right]], parts[right, j[right] + 1])
        for i in np.flatnonzero(sizes > low).tolist():
            tokens.append(np.array(merge_long(words[i], self.ranks)))
            of.append(np.full(len(tokens[-1]), i))
        return np.concatenate(tokens), np.concatenate(of)

    def _join_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
        return np.where(self.joins[at] == key, self.joined[at], _NONE)

    def _numbers(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number under which the tokens of each of these words are kept; new words are encoded."""
        if len(self.known) > KEPT_WORDS:
            self._forget()
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            tokens, counts = self.encode_words(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.word_begin = np.r_[self.word_begin, len(self.word_tokens) + np.cumsum(counts) - counts]
            self.word_tokens, self.word_count = np.r_[self.word_tokens, tokens], np.r_[self.word_count, counts]
        return np.array([self.known[w] for w in words], np.int64)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, and n + 1 offsets."""
        starts, ends = split(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        raw = data.tobytes()
        _, first, word = np.unique(K.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        sizes = ends - starts
        if not (sizes == sizes[first][word]).all() or not (data[np.repeat((starts[first] - starts[0])[word] - starts, sizes) + np.arange(len(data))] == data).all():
            first, word = np.arange(len(starts)), np.arange(len(starts))  # two words with one hash
        number = self._numbers(raw, starts[first], ends[first])[word]
        counts = self.word_count[number]
        done = np.r_[0, np.cumsum(counts)]
        tokens = self.word_tokens[np.repeat(self.word_begin[number] - done[:-1], counts) + np.arange(done[-1])]
        return tokens, done[np.searchsorted(starts, offsets)]

    def encode(self, texts: pa.Array) -> pa.Array:
        values, offsets = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for piece in K.pieces(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), "t", PIECE):
            tokens, ends = self._encode(*_well_formed(*K.flat(piece.column("t"))))
            values.append(tokens)
            offsets.append(offsets[-1][-1] + ends[1:])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(np.concatenate(values)), mask=texts.is_null() if texts.null_count else None)

    def bytes_of(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all lists of tokens, and n + 1 offsets."""
        n = self.lengths[tokens]
        ends = np.r_[0, np.cumsum(n)]
        return self.blob[np.repeat(self.begins[tokens] - ends[:-1], n) + np.arange(ends[-1])], ends[offsets]

    def decode(self, lists: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.r_[0, np.cumsum(counts)]
        values = lists.flatten()
        known = pc.fill_null(pc.and_(pc.greater_equal(values, 0), pc.less(values, self.size)), False).to_numpy(zero_copy_only=False)
        ids = np.where(known, pc.fill_null(values, 0).to_numpy(zero_copy_only=False), 0)
        bad = np.add.reduceat(np.r_[~known, False].astype(np.int64), offsets[:-1]) * (counts > 0) > 0 if len(counts) else counts > 0
        data, ends = self.bytes_of(ids, offsets)
        mask = bad | lists.is_null().to_numpy(zero_copy_only=False)
        heads = ends[:-1][counts > 0]
        try:
            data.tobytes().decode()
            whole = not ((data[heads] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole and ends[-1] < 1 << 31:
            return pa.StringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data), pa.array(~mask).buffers()[1])
        return pa.array([None if m else data[a:b].tobytes().decode("utf-8", "replace") for m, a, b in zip(mask.tolist(), ends.tolist(), ends[1:].tolist(), strict=False)], pa.string())

    def tokenize(self, texts: pa.Array) -> pa.StructArray:
        """tokens, n_tokens and round_trip of each text."""
        tokens, same = [], []
        for piece in K.pieces(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), "t", PIECE):
            lists = self.encode(piece.column("t"))
            data, offsets = K.flat(piece.column("t"))
            again, ends = self.bytes_of(lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            equal = np.diff(ends) == np.diff(offsets)
            if equal.all():
                wrong = np.flatnonzero(again != data)
                equal[np.searchsorted(offsets, wrong, "right") - 1] = False
            else:
                equal = np.array([e and again[a:b].tobytes() == data[c:d].tobytes() for e, a, b, c, d in zip(equal.tolist(), ends, ends[1:], offsets, offsets[1:], strict=False)])
            tokens.append(lists)
            same.append(equal)
        lists = pa.concat_arrays(tokens) if tokens else pa.array([], pa.list_(pa.int32()))
        counts = pc.list_value_length(lists)
        null = counts.is_null()
        return pa.StructArray.from_arrays([lists, counts, pa.array(np.concatenate([np.zeros(0, bool), *same]), mask=null.to_numpy(zero_copy_only=False))], ["tokens", "n_tokens", "round_trip"])


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(text: Column | str, path: str = VOCABULARY) -> Column:
    """Token ids of a text; null for null, none for an empty text. Special tokens' strings are ordinary text."""

    def run(texts: pa.Array) -> pa.Array:
        return encoder(path).encode(texts)

    return F.arrow_udf(run, "array<int>")(text)


def decoded(tokens: Column | str, path: str = VOCABULARY) -> Column:
    """The text of token ids; null for null, and for lists with a null or an id outside the vocabulary. Bytes that
    aren't UTF-8, as a cut list may end in, become U+FFFD."""

    def run(lists: pa.Array) -> pa.Array:
        return encoder(path).decode(lists)

    return F.arrow_udf(run, "string")(tokens)


def tokenize(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) for each row of docs; round_trip: decoding gives the text again.

    A null text has null tokens and round_trip, and n_tokens null; an empty one no token. Bytes that aren't UTF-8 are
    encoded as U+FFFD, without round trip. Null ids and repeated rows are kept; other columns are ignored."""
    K.bound_batches(docs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        return encoder(path).tokenize(texts)

    found = docs.select("doc_id", F.arrow_udf(run, "struct<tokens: array<int>, n_tokens: int, round_trip: boolean>")("text").alias("found"))
    return found.select("doc_id", "found.tokens", "found.n_tokens", "found.round_trip")
