import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from codeloom.llm import langid as L

TEXTS = {"en": "the cat and the dog of this house were in that garden with another thing", "de": "der hund und die katze sind nicht in dem garten mit einer anderen sache", "fr": "le chien et les chats sont dans le jardin avec une autre chose pour nous"}


def plain_grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        p = f" {w} "
        for n in (1, 2, 3):
            out.update(g for i in range(len(p) - n + 1) if (g := p[i : i + n]) != " ")
    return out


def ranked(counts, top):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]]


def decoded(codes):
    return ["".join(chr(c) for s in (42, 21, 0) if (c := (int(x) >> s) & 0x1FFFFF)) for x in codes]


@pytest.mark.parametrize("texts", [["Hello, wörld!", "", "a", "  ", "É-é x1y2", "日本 語"], ["x"], ["", ""], [None, "ab"]])
def test_grams_equal_plain_ones(texts):
    for text, codes in zip(texts, L.gram_codes(pa.array(texts, pa.string())), strict=True):
        assert Counter(decoded(codes)) == plain_grams(text or "")
        assert decoded(L.ranking(codes, 5)) == ranked(plain_grams(text or ""), 5)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = []
    for i in range(90):
        lang = sorted(TEXTS)[i % 3]
        w = TEXTS[lang].split()
        out.append((i, " ".join(r.choice(w) for _ in range(60)), lang))
    return out


def test_identify_equals_brute_force(table, rows):
    odd = [(100, None, None), (101, "", "en"), (102, "123 !!", None), (103, "жзи клм", None), (None, "the dog and the cat", None), (104, "der hund " * 20_000, None), (0, rows[0][1], "en")]
    docs = table([*rows, *odd])
    profiles = L.fit(docs, top=40, sample_rows=1000)
    counts = {lang: sum((plain_grams(t) for i, t, x in [*rows, (101, "", "en"), (0, rows[0][1], "en")] if x == lang), Counter()) for lang in TEXTS}
    plain = {lang: ranked(c, 40) for lang, c in counts.items()}
    for r in L.identify(docs.drop("lang").withColumnRenamed("source", "lang"), profiles).join(docs.select("doc_id", "text"), "doc_id").collect():
        own = ranked(plain_grams(r.text or ""), 40)
        if not own:
            assert (r.detected, r.distance, r.accepted) == (None, None, False)
            continue
        d = {lang: sum(abs(p.index(g) - i) if g in p else 40 for i, g in enumerate(own)) for lang, p in plain.items()}
        best = min(sorted(d), key=d.get)
        assert r.detected == best and r.distance == d[best] / (40 * len(own))
    found = {r.doc_id: r for r in L.identify(docs, profiles).collect()}
    assert not found[103].accepted and found[104].detected == "de" and found[None].accepted
    kept = L.accepted(docs, profiles)
    assert kept.columns == docs.columns and kept.count() == 90 + 3


def test_no_labels_and_no_rows(table):
    empty = table([])
    assert L.identify(empty, L.fit(empty)).collect() == []
    unlabelled = table([(1, "abc", None)])
    assert L.identify(unlabelled, L.fit(unlabelled)).collect()[0].accepted is False


def test_held_out_accuracy(table, rows):
    profiles = L.fit(table(rows[:45]))
    held = [(i, " ".join(t.split()[:12]), lang) for i, t, lang in rows[45:]]
    found = {r.doc_id: r.detected for r in L.identify(table(held), profiles).collect()}
    assert sum(found[i] == lang for i, _, lang in held) >= 0.95 * len(held)
