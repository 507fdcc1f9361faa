import random
from pathlib import Path

import pyarrow as pa
import pytest

from codeloom.llm import bpe as B

pytestmark = pytest.mark.skipif(not Path(B.VOCABULARY).exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def texts(corpus):
    r = random.Random(0)
    odd = ["", "a", " " * 300, "x" * 500 + "=" * 900, "日本語テキスト 🎉🎉 naïve ÀÉ", "\n\n\t  foo\r\n  bar ", "<|endoftext|>", "I'll don't 've 123456 12.5", "\x00ÿ", None]
    odd.append("".join(r.choice("abcdefghij 0123-_=/ABC") for _ in range(20_000)))
    odd.append("".join(chr(r.randrange(32, 0x2FFF)) for _ in range(3000)))
    return odd + [t for _, t in corpus]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_equals_exact_merging(texts, name):
    import tiktoken

    e = B.Encoder(str(Path(B.VOCABULARY).with_name(name)))
    plain = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    out = e.encode(pa.array(texts, pa.string()))
    assert out.to_pylist() == [None if t is None else plain.encode_ordinary(t) for t in texts]
    assert e.decode(out).to_pylist() == texts


def test_splitting_equals_the_pattern(texts):
    import numpy as np
    import regex

    r = random.Random(8)
    made = ["".join(r.choice(["a", "l", "s", "ve", "'", "'", " ", "  ", "\n", "\t", "1", "²", "!", ".", "é", "日", "\u3000", "\x1c", "\xa0", "🎉", "ſ"]) for _ in range(r.randrange(12))) for _ in range(3000)]
    made += [t for t in texts if t is not None]
    raw = [t.encode() for t in made]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in raw])]
    starts, ends = B.split(data, offsets)
    want = [w.encode() for t in made for w in regex.findall(B.PATTERN, t)]
    assert [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] == want
    assert B.split(data[:0], offsets[:1])[0].tolist() == []


def test_words_of_one_hash_are_told_apart(texts, monkeypatch):
    import numpy as np

    want = B.encoder().encode(pa.array(texts, pa.string()))
    monkeypatch.setattr(B.K, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(5))
    assert B.Encoder(B.VOCABULARY).encode(pa.array(texts, pa.string())).equals(want)


def test_lockstep_merging_equals_plain_merging():
    e, r = B.encoder(), random.Random(4)
    words = [bytes(r.choice(b"abetino rs=\xc3\xa9") for _ in range(r.randrange(1, 70))) for _ in range(2000)]
    tokens, of = e.merged_words(words)
    assert [tokens[of == i].tolist() for i in range(len(words))] == [B.merge(w, e.ranks) for w in words]


def test_text_that_is_not_utf8(spark):
    df = spark.sql("select doc_id, cast(t as string) as text from values (1, X'61FF62'), (2, X'6162'), (3, X'C3') as v(doc_id, t)")
    plain = B.encoder().encode(pa.array(["a\ufffdb", "ab", "\ufffd"])).to_pylist()
    found = {q.doc_id: (q.tokens, q.round_trip) for q in B.tokenize(df).collect()}
    assert found == {1: (plain[0], False), 2: (plain[1], True), 3: (plain[2], False)}


def test_compatibility_is_that_of_merging():
    e = B.encoder()
    r = random.Random(1)
    import numpy as np

    tokens = list(e.ranks)
    pairs = [(r.choice(tokens), r.choice(tokens)) for _ in range(1500)]
    pairs += [(t[:i], t[i:]) for t in r.sample(tokens, 500) if len(t) > 1 for i in (len(t) // 2,) if t[:i] in e.ranks and t[i:] in e.ranks]
    a, b = (np.array([e.ranks[p[i]] for p in pairs]) for i in (0, 1))
    want = [B.merge(x + y, e.ranks) == [e.ranks[x], e.ranks[y]] for x, y in pairs]
    assert e.compatible(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_heap_merging_equals_plain_merging():
    e, r = B.encoder(), random.Random(3)
    for _ in range(200):
        w = bytes(r.choice(b"abetino rs=") for _ in range(r.randrange(1, 60)))
        assert B.merge_long(w, e.ranks) == B.merge(w, e.ranks)


def test_tokenize(spark, table, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "abc"), (1, "a")]
    found = {(r.doc_id, r.n_tokens, r.round_trip) for r in B.tokenize(table(rows)).collect()}
    out = B.encoder().encode(pa.array([t for _, t in rows], pa.string())).to_pylist()
    assert found == {(i, None if t is None else len(x), None if t is None else True) for (i, t), x in zip(rows, out, strict=True)}
    assert B.tokenize(table([])).collect() == []


def test_decoding_bad_lists(spark):
    df = spark.createDataFrame([(1, [0, 1]), (2, [99_999]), (3, [1, None]), (4, []), (5, None), (6, [-1])], "i int, t array<int>")
    assert {r.i: r.d for r in df.select("i", B.decoded("t").alias("d")).collect()} == {1: '!"', 2: None, 3: None, 4: "", 5: None, 6: None}
