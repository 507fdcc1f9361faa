"""Secret scan: a linear-chain conditional random field over tokens, decoded by Viterbi.

Tokens are runs of letters, digits and _ + / . ~ -; each is tagged as beginning a secret (B),
inside one (I) or outside (O) from categorical features: its shape, the shapes of its
neighbours, key words before it, the separators around it, and features of the whole file.

The field is trained here, by gradient ascent on the exact conditional likelihood, on carriers
(windows of a bounded sample of the documents) into which generated secrets and look-alikes
are set, so that labels are known. Decoding is exact: chunks of a text are reduced to
max-plus matrices side by side, joined along the text and traced back.
"""

from __future__ import annotations

import random
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import kernels as K

#: Rows whose windows carry the training examples; examples; rounds of training.
SAMPLE_ROWS, EXAMPLES, ROUNDS, SEED = 300, 2000, 80, 7
MARK = "[SECRET]"
O, B, I = 0, 1, 2  # noqa: E741
_LOW = -1e9


def _set(chars: bytes) -> np.ndarray:
    a = np.zeros(256, bool)
    a[list(chars)] = True
    return a


_DIGIT, _UPPER, _LOWER = (_set(x.encode()) for x in (string.digits, string.ascii_uppercase, string.ascii_lowercase))
_SYMBOL, _HEX, _QUOTE = _set(b"_+/.~-"), _set(b"0123456789abcdefABCDEF"), _set(b"\"'`")
_WIDE = np.arange(256) >= 128
_TOKEN = _DIGIT | _UPPER | _LOWER | _SYMBOL | _WIDE
_KIND = np.select([_DIGIT, _UPPER, _LOWER, _SYMBOL], [1, 2, 3, 4], 5).astype(np.int8)
_CODE = _set(b"{};=<>()")
_KEYWORDS = {w: 1 for w in "token secret password passwd pwd passphrase api_key apikey api-key key access_key secret_key client_secret auth_token access_token bearer credential credentials auth aws_secret_access_key private_key db_password".split()}
_KEYWORDS |= {w: 2 for w in "-----begin private rsa ec openssh key-----".split()}
_KEYWORDS |= {w: 3 for w in "commit sha sha1 sha256 md5 id isbn version color hash rev build checksum digest uuid".split()}
_STARTS = {s: i + 1 for i, s in enumerate(("AKI", "ASI", "ghp", "gho", "xox", "sk-", "sk_", "eyJ", "AIz", "---", "SG.", "glp", "htt", "www"))}
_LENGTHS = np.array([2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32, 33, 36, 40, 41, 48, 64, 65, 100])
_N_LENGTHS = len(_LENGTHS) + 1


def _hash_table(words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    data = "".join(words).encode()
    ends = np.cumsum([len(w) for w in words])
    h = K.span_hashes(np.frombuffer(data, np.uint8), np.r_[0, ends[:-1]], ends)
    order = np.argsort(h)
    return h[order], np.array(list(words.values()))[order]


def _lookup(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
    return np.where(table[0][at] == h, table[1][at], 0)


def _shift(a: np.ndarray, by: int, doc: np.ndarray, outside: int) -> np.ndarray:
    """a[i + by] within the same document, else `outside`."""
    out = np.full(len(a), outside, a.dtype)
    if abs(by) < len(a):
        to, of = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
        out[to] = np.where(doc[to] == doc[of], a[of], outside)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of all tokens."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TOKEN[data]
    inner = offsets[1:-1]
    cut = inner[(inner > 0) & (inner < len(data))]
    begins, stops = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    both = cut[inside[cut] & inside[cut + 1]]  # tokens of two texts that touch
    begins[both] = True
    stops[both] = True
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops), np.searchsorted(offsets, starts, "right") - 1


def features(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(values, number of values) of each categorical feature of every token."""
    size = ends - starts

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask[data], out=sums[1:])
        return sums[ends] - sums[starts]

    digits, uppers, lowers, symbols, wides, hexes = (count(m) for m in (_DIGIT, _UPPER, _LOWER, _SYMBOL, _WIDE, _HEX))
    kinds = _KIND[data]
    turns = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kinds[1:] != kinds[:-1], out=turns[1:-1])
    changes = turns[ends - 1] - turns[starts]
    length = np.searchsorted(_LENGTHS, size, "right")
    mixture = (digits > 0) + 2 * (uppers > 0) + 4 * (lowers > 0) + 8 * (symbols > 0) + 16 * (wides > 0)
    random_like = np.minimum(7, 8 * changes // np.maximum(size, 1)) + 8 * (size >= 16)
    hexed = np.where(hexes == size, length, _N_LENGTHS)
    share = np.minimum(4, 5 * digits // size) + 5 * np.minimum(4, 5 * uppers // size)
    lower = np.where(_UPPER[data], data + 32, data).astype(np.uint8)
    word = _lookup(_table(), K.span_hashes(lower, starts, ends))
    padded = np.r_[data, np.zeros(3, np.uint8)].astype(np.int64)
    three = padded[starts] | padded[starts + 1] << 8 | padded[starts + 2] << 16
    known = np.zeros(len(starts), np.int64)
    for s, i in _STARTS.items():
        known[three == int.from_bytes(s.encode(), "little")] = i
    left = padded[starts - 1] * (starts > offsets[doc])
    right = padded[ends] * (ends < offsets[doc + 1])
    side = lambda b: np.select([_QUOTE[b], b == 61, b == 58, b == 10, b == 32, b == 0], [1, 2, 3, 4, 5, 6], 0)
    before = np.r_[0, ends[:-1]]  # the separator since the token before
    before = np.where(_shift(doc, -1, doc, -1) >= 0, before, offsets[doc])
    equals = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data == 61) | (data == 58), out=equals[1:])
    assigned = (equals[starts] - equals[before] > 0).astype(np.int64)
    shape = np.where(size < 12, 0, np.where(hexes == size, 1, np.where((digits > 0) & (lowers + uppers > 0), 2, np.where(symbols > 0, 3, np.where(digits == size, 4, 5)))))
    n = np.diff(offsets)
    code = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CODE[data] | _DIGIT[data], out=code[1:])
    file = np.minimum(3, 40 * (code[offsets[1:]] - code[offsets[:-1]]) // np.maximum(n, 1)) + 4 * np.searchsorted([100, 1000, 10000], n)
    previous, further = _shift(word, -1, doc, 0), _shift(word, -2, doc, 0)
    return [
        (np.zeros(len(starts), np.int64), 1),
        (length, _N_LENGTHS),
        (mixture, 32),
        (random_like, 16),
        (hexed, _N_LENGTHS + 1),
        (share, 25),
        (word, 4),
        (known, len(_STARTS) + 1),
        (side(left), 7),
        (side(right), 7),
        (assigned * 4 + previous, 8),
        (further, 4),
        (shape * 8 + assigned * 4 + previous, 48),
        (_shift(shape, -1, doc, 6) * 6 + shape, 42),
        (_shift(shape, 1, doc, 6) * 6 + shape, 42),
        (file[doc], 16),
    ]


_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _table() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables.append(_hash_table(_KEYWORDS))
    return _tables[0]


@dataclass
class Field:
    """weights[value of a feature, label], transitions[from, to] and start[label] of the field."""

    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, feats: list[tuple[np.ndarray, int]]) -> np.ndarray:
        out, base = np.zeros((len(feats[0][0]), 3), np.float32), 0
        for values, n in feats:
            out += self.weights[base + values]
            base += n
        return out

    def decode(self, e: np.ndarray, sizes: np.ndarray, chunk: int = 64) -> np.ndarray:
        """The best labels; sizes are the tokens of each document, in the order of e."""
        sizes = sizes[sizes > 0]
        if not len(sizes):
            return np.zeros(0, np.int8)
        chunks = -(-sizes // chunk)
        first = np.cumsum(chunks) - chunks
        ends = np.cumsum(sizes)
        place = np.repeat(first * chunk - (ends - sizes), sizes) + np.arange(len(e))
        total = int(chunks.sum())
        padded = np.full((total * chunk, 3), np.nan, np.float32)
        padded[place] = e
        grid = padded.reshape(total, chunk, 3)
        heads = np.zeros(total, bool)
        heads[first] = True
        same = np.where(np.eye(3, dtype=bool), 0, _LOW).astype(np.float32)
        table = self.transitions.astype(np.float32)
        best = np.broadcast_to(same, (total, 3, 3))
        back = np.zeros((chunk, total, 3, 3), np.int8)
        for t in range(chunk):
            step = table[None] + grid[:, t, None, :]
            if t == 0:
                step = np.where(heads[:, None, None], self.start.astype(np.float32)[None, None, :] + grid[:, 0, None, :], step)
            step = np.where(np.isnan(grid[:, t, :1, None]), same, step)
            paths = best[:, :, :, None] + step[:, None, :, :]
            back[t] = paths.argmax(axis=2)
            best = paths.max(axis=2)
        # along each document, over its chunks
        order = np.argsort(-chunks, kind="stable")
        score = np.zeros((len(sizes), 3), np.float32)
        enter = np.zeros((total, 3), np.int8)
        live = len(order)
        counts = chunks[order]
        for j in range(int(counts[0])):
            live = int(np.searchsorted(-counts, -j, "left"))
            d = order[:live]
            paths = score[d][:, :, None] + best[first[d] + j]
            enter[first[d] + j] = paths.argmax(axis=1)
            score[d] = paths.max(axis=1)
        state = score.argmax(axis=1)
        come, leave = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for j in range(int(counts[0]) - 1, -1, -1):
            live = int(np.searchsorted(-counts, -j, "left"))
            d = order[:live]
            leave[first[d] + j] = state[d]
            state[d] = enter[first[d] + j, state[d]]
            come[first[d] + j] = state[d]
        labels = np.zeros((total, chunk), np.int8)
        all_ = np.arange(total)
        for t in range(chunk - 1, -1, -1):
            labels[:, t] = leave
            leave = back[t, all_, come, leave].astype(np.int64)
        return labels.reshape(-1)[place]


def _examples(carriers: list[str], count: int, seed: int) -> tuple[list[str], list[tuple[int, int]]]:
    """Texts, and the characters from .. to of the secret in each; equal if it has none."""
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    b64, alnum, hexa = string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, "0123456789abcdef"
    keywords = [w for w, k in _KEYWORDS.items() if k == 1]
    lines = lambda n: "\n".join(some(b64, 64) for _ in range(n))
    strong = [lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + some(alnum, 36), lambda: "xoxb-" + some(string.digits, 11) + "-" + some(alnum, 24), lambda: "sk_live_" + some(alnum, 24), lambda: "sk-" + some(alnum, 40), lambda: f"eyJ{some(alnum, 20)}.eyJ{some(alnum, 40)}.{some(alnum, 43)}", lambda: "AIza" + some(alnum + "_-", 35)]
    pem = [lambda: (k := r.choice(("RSA ", "EC ", "", "OPENSSH ")), f"-----BEGIN {k}PRIVATE KEY-----\n{lines(r.randint(2, 5))}\n-----END {k}PRIVATE KEY-----")[1]]
    named = [lambda: some(hexa, r.choice((24, 32, 40, 40, 48, 64))), lambda: some(alnum, r.randint(16, 48)), lambda: some(b64, r.randint(20, 60)), lambda: some(alnum, r.randint(8, 15)) + r.choice(string.digits)]
    assign = ['{k} = "{s}"', "{k}: {s}", "{k}={s}", '"{k}": "{s}"', "{k} = '{s}'", "export {k}={s}", "{k} {s}"]
    harmless = [
        lambda: f"commit {some(hexa, 40)}", lambda: f"sha256: {some(hexa, 64)}", lambda: f"md5 {some(hexa, 32)}", lambda: f"https://www.{some(string.ascii_lowercase, 8)}.example.com/{some(string.ascii_lowercase, 6)}/{some(string.digits, 4)}?page={r.randint(1, 99)}",
        lambda: f"{some(string.ascii_lowercase, 5)}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", lambda: f"+1 ({some(string.digits, 3)}) 555-{some(string.digits, 4)}", lambda: some(string.digits, 16), lambda: " ".join(some(string.digits, 4) for _ in range(4)),
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T10:0{r.randint(0, 9)}:00", lambda: f"version {r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"id = {some(string.digits, r.randint(3, 12))}", lambda: f"{r.choice(keywords)} = ", lambda: f"the {r.choice(keywords)} of",
        lambda: f'{r.choice(keywords)}: "{some(string.ascii_lowercase, r.randint(3, 9))}"', lambda: f"src/{some(string.ascii_lowercase, 6)}/{some(string.ascii_lowercase, 9)}_{some(string.ascii_lowercase, 5)}.py", lambda: f"get{some(string.ascii_lowercase, 5).title()}{some(string.ascii_lowercase, 6).title()}(x) {{ return y; }}", lambda: some(string.ascii_lowercase, r.randint(20, 45)), lambda: some(string.ascii_uppercase, r.randint(5, 25)) + "!!", lambda: f"uuid {some(hexa, 8)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 12)}",
        lambda: "".join(r.choice(("$$$", "###", "%%%", "***", "&&&")) + some(string.ascii_lowercase, 7) + " " for _ in range(4)),
    ]
    texts, spans = [], []
    for _ in range(count):
        carrier = r.choice(carriers).split(" ") if carriers else []
        at = r.randrange(len(carrier) + 1)
        head, tail = " ".join(carrier[:at]), " ".join(carrier[at:])
        roll = r.random()
        if roll < 0.5:
            kind = r.random()
            if kind < 0.2:
                secret = r.choice(strong)()
                form = r.choice(["{s}", *assign])
            elif kind < 0.3:
                secret, form = pem[0](), r.choice(("{s}", '{k} = "{s}"'))
            else:
                secret, form = r.choice(named)(), r.choice(assign)
            k = r.choice(keywords)
            put = form.replace("{k}", k.upper() if r.random() < 0.3 else k)
            a = len(head) + 1 + put.index("{s}")
            put = put.replace("{s}", secret)
            texts.append(f"{head} {put}{r.choice((' ', ' ', chr(10), '. ', '### '))}{tail}")
            spans.append((a, a + len(secret)))
        else:
            put = r.choice(harmless)() if roll < 0.85 else ""
            texts.append(f"{head} {put} {tail}")
            spans.append((0, 0))
    return texts, spans


def _labels(texts: list[str], spans: list[tuple[int, int]]) -> tuple[list[tuple[np.ndarray, int]], np.ndarray, np.ndarray]:
    """Features, tokens of each text, labels."""
    data, offsets = K.flat(pa.array(texts, pa.string()))
    starts, ends, doc = tokens(data, offsets)
    at = np.array([[len(t[:a].encode()), len(t[:b].encode())] for t, (a, b) in zip(texts, spans, strict=True)])
    begin, end = at[:, 0] + offsets[:-1], at[:, 1] + offsets[:-1]
    hit = (starts < end[doc]) & (ends > begin[doc])
    return features(data, offsets, starts, ends, doc), np.bincount(doc, minlength=len(texts)), np.where(hit, np.where(starts <= begin[doc], B, I), O)


def train(carriers: list[str], examples: int = EXAMPLES, rounds: int = ROUNDS, seed: int = SEED) -> Field:
    """Maximum likelihood with a small ridge, by Adam on all examples at once; forward and backward over all of them side by side."""
    feats, sizes, gold = _labels(*_examples(carriers, examples, seed))
    base, columns = 0, []
    for values, n in feats:
        columns.append(base + values)
        base += n
    index = np.stack(columns, axis=1)
    n, most = len(sizes), int(sizes.max())
    first = np.cumsum(sizes) - sizes
    place = (np.arange(len(gold)) - np.repeat(first, sizes)) * n + np.repeat(np.arange(n), sizes)
    mask = np.zeros((most * n, 1), bool)
    mask[place] = True
    mask = mask.reshape(most, n, 1)
    onehot = np.eye(3)[gold]
    linked = np.ones(len(gold), bool)
    linked[first[sizes > 0]] = False
    pairs = np.zeros((3, 3))
    np.add.at(pairs, (gold[:-1][linked[1:]], gold[1:][linked[1:]]), 1)
    starts = onehot[~linked].sum(axis=0)
    w, trans, start = np.zeros((base, 3)), np.zeros((3, 3)), np.zeros(3)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, trans, start)]

    for t in range(1, rounds + 1):
        e = np.zeros((most, n, 3))
        flat = w[index].sum(axis=1)
        e.reshape(-1, 3)[place] = flat - flat.max(axis=1, keepdims=True)
        q, links = np.exp(e), np.exp(trans)
        alpha, beta, scale = np.zeros_like(q), np.ones_like(q), np.ones((most, n, 1))
        alpha[0] = np.exp(start) * q[0]
        for i in range(most):  # scaled to sum to one at each step; past a text's end all stays as it is
            if i:
                alpha[i] = np.where(mask[i], (alpha[i - 1] @ links) * q[i], alpha[i - 1])
            scale[i] = alpha[i].sum(axis=1, keepdims=True)
            alpha[i] /= scale[i]
        expected = np.zeros((3, 3))
        for i in range(most - 2, -1, -1):
            onward = q[i + 1] * beta[i + 1] / scale[i + 1]
            beta[i] = np.where(mask[i + 1], onward @ links.T, beta[i + 1])
            expected += (alpha[i] * mask[i + 1]).T @ onward * links
        p = alpha * beta
        miss = onehot - p.reshape(-1, 3)[place]
        gw = np.stack([np.bincount(index.ravel(), np.repeat(miss[:, k], index.shape[1]), base) for k in range(3)], axis=1) - 0.05 * w
        grads = (gw, pairs - expected - 0.05 * trans, starts - (p[0] * mask[0]).sum(axis=0) - 0.05 * start)
        for x, g, (m, v) in zip((w, trans, start), grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    trans[O, I], start[I] = _LOW, _LOW  # nothing is inside without a beginning
    return Field(w.astype(np.float32), trans, start)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, examples: int = EXAMPLES, rounds: int = ROUNDS, seed: int = SEED) -> Field:
    """A field trained on carriers from at most sample_rows rows, those with the smallest md5(doc_id).
    Windows with a long token that has digits might hold a real secret, unlabelled, and carry nothing."""
    K.bound_batches(docs.sparkSession)
    chosen = docs.where("doc_id is not null and text is not null").select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample_rows)
    rows = docs.where("text is not null").select("doc_id", "text").join(chosen.distinct(), "doc_id", "left_semi")
    windows = rows.select("doc_id", F.split("text", " ").alias("w")).select("doc_id", F.expr("slice(w, 1 + abs(xxhash64(doc_id) % greatest(1, size(w) - 24)), 24)").alias("w"))
    plain = windows.select("doc_id", F.array_join("w", " ").alias("t")).where(~F.col("t").rlike(r"(?=[A-Za-z0-9_+/.~-]*[0-9])[A-Za-z0-9_+/.~-]{12,}")).orderBy("doc_id", "t").limit(sample_rows)
    return train([r.t for r in plain.collect()], examples, rounds, seed)


def find(field: Field, texts: pa.Array) -> list[list[tuple[int, int]]]:
    """Bytes from .. to of the secrets of each text."""
    out: list[list[tuple[int, int]]] = []
    for piece in K.pieces(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), "t", 1 << 18):
        data, offsets = K.flat(piece.column("t"))
        starts, ends, doc = tokens(data, offsets)
        mine: list[list[tuple[int, int]]] = [[] for _ in range(piece.num_rows)]
        if len(starts):
            e = field.emissions(features(data, offsets, starts, ends, doc))
            labels = field.decode(e, np.bincount(doc, minlength=piece.num_rows))
            for i in np.flatnonzero(labels == B).tolist():
                j = i + 1
                while j < len(labels) and labels[j] == I and doc[j] == doc[i]:
                    j += 1
                a, b = int(starts[i]), int(ends[j - 1])
                while b > a + 1 and data[b - 1] == 46:
                    b -= 1
                while b < offsets[doc[i] + 1] and data[b] == 61:
                    b += 1
                mine[doc[i]].append((a - int(offsets[doc[i]]), b - int(offsets[doc[i]])))
        out += mine
    return out


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, start_char, end_char, head): a row for each secret; head is its first four characters.

    Null, empty and blank texts have none. Null ids and repeated rows are scanned like others;
    other columns are ignored. Order within a document is that of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch.column("doc_id"), batch.column("text"), find(field, batch.column("text")), strict=True):
                if spans:
                    raw = text.as_py().encode()
                    rows += [(doc.as_py(), len(raw[:a].decode("utf-8", "replace")), len(raw[:b].decode("utf-8", "replace")), raw[a:b].decode("utf-8", "replace")[:4]) for a, b in spans]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "start_char", "end_char", "head"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start_char int, end_char int, head string")


def redact(docs: DataFrame, field: Field, mark: str = MARK) -> DataFrame:
    """docs with every secret in text replaced by mark; n_chars, where there is such a column, follows
    the text where it changed. No row goes; all other columns, and texts without secrets, stay as they are."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts, find(field, texts), strict=True):
            if not spans:
                out.append(None)
                continue
            raw, parts, at = text.as_py().encode(), [], 0
            for a, b in spans:
                parts += [raw[at:a], mark.encode()]
                at = b
            out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    new = "__codeloom_text"
    out = docs.withColumn(new, F.arrow_udf(run, "string")("text"))
    columns = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    return out.withColumns(columns).select(*[F.col(f"`{c}`") for c in docs.columns])
