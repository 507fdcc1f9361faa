"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent letter n-grams (one to three
characters of words padded with a space). A document's own ranking is compared with each
profile by out-of-place distance: for each of the document's grams, how far its rank is from
the rank in the profile, or the profile's length if it isn't there.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm import kernels as K

#: Grams in a ranking; labelled rows of each language that a profile is fitted on; the normalised
#: distance, 0 to 1, beyond which no language is accepted.
TOP, SAMPLE_ROWS, MAX_DISTANCE = 300, 400, 0.7
_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x32400)), bool, 0x32400))
    return _letters[0][np.minimum(points, 0x323FF)]


def gram_codes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its grams, as often as they occur: three code points of 21 bits, in the order of the strings."""
    data, offsets = K.flat(pc.utf8_lower(texts))
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    heads = at[offsets]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(heads) + 1)
    spaced = np.insert(points, heads[:-1], 32)  # each text begins with a space
    letter = _is_letter(spaced)
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~letter[1:]
    keep[:1] = True
    s, doc, letter = np.where(letter, spaced, 32)[keep].astype(np.int64), doc[keep], letter[keep]
    s, doc, letter = np.append(s, 32), np.append(doc, len(offsets) - 1), np.append(letter, False)
    two = (s[:-1] << 42) | (s[1:] << 21)
    pair = letter[:-1] | letter[1:]  # the last space of all may follow another
    two_doc = np.where(letter[:-1], doc[:-1], doc[1:])
    middle = letter[1:-1]
    parts = [(s[letter] << 42, doc[letter]), (two[pair], two_doc[pair]), ((two[:-1] | s[2:])[middle], doc[1:-1][middle])]
    cuts = [np.searchsorted(d, np.arange(len(offsets))) for _, d in parts]
    for i in range(len(offsets) - 1):
        yield np.concatenate([c[a[i] : a[i + 1]] for (c, _), a in zip(parts, cuts, strict=True)])


def ranking(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent grams, then in the order of the strings."""
    grams, counts = np.unique(codes, return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:top]]


@dataclass
class Profiles:
    """languages in alphabetical order; grams sorted; ranks[g, l] of gram g in language l, `top` where it has none."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    top: int

    @classmethod
    def of(cls, rankings: dict[str, np.ndarray], top: int) -> Profiles:
        languages = sorted(rankings)
        grams = np.unique(np.concatenate([np.zeros(0, np.int64), *rankings.values()]))
        ranks = np.full((len(grams) + 1, len(languages)), top, np.int64)
        for i, name in enumerate(languages):
            ranks[np.searchsorted(grams, rankings[name]), i] = np.arange(len(rankings[name]))
        return cls(languages, grams, ranks, top)

    def distances(self, mine: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, mine)
        at[at == len(self.grams)] = 0
        r = self.ranks[np.where(self.grams[at] == mine, at, len(self.grams))]
        return np.where(r < self.top, np.abs(r - np.arange(len(mine))[:, None]), self.top).sum(axis=0)


def fit(docs: DataFrame, top: int = TOP, sample_rows: int = SAMPLE_ROWS) -> Profiles:
    """Profiles from at most sample_rows labelled rows of each language, those with the smallest md5(doc_id)."""
    K.bound_batches(docs.sparkSession)
    w = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    labelled = docs.where("lang is not null and doc_id is not null and text is not null")
    chosen = labelled.select("doc_id", "lang").withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample_rows).drop("n")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in K.pieces(batches, "text"):
            for lang, codes in zip(piece.column("lang").to_pylist(), gram_codes(piece.column("text")), strict=True):
                grams, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    # at most sample_rows ids a language, so the text needn't be shuffled
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= top).orderBy("lang", "rank").collect():  # languages x top rows
        found.setdefault(r.lang, []).append(r.gram)
    return Profiles.of({k: np.array(v, np.int64) for k, v in found.items()}, top)


def _identify(profiles: Profiles):
    def run(texts: pa.Array) -> pa.Array:
        names, far = [], []
        for codes in (c for piece in K.pieces(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), "t") for c in gram_codes(piece.column("t"))):
            mine = ranking(codes, profiles.top)
            if not len(mine) or not profiles.languages:
                names.append(None)
                far.append(None)
                continue
            d = profiles.distances(mine)
            best = int(np.argmin(d))
            names.append(profiles.languages[best])
            far.append(int(d[best]) / (profiles.top * len(mine)))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(far, pa.float64())], ["lang", "distance"])

    return F.arrow_udf(run, "lang string, distance double")


def identify(docs: DataFrame, profiles: Profiles, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """One row for each row of docs: (doc_id, detected, distance, accepted).

    distance is the out-of-place distance divided by its maximum for that document; of equally
    near languages the first by name is taken. A null, empty or letterless text has detected
    and distance null and isn't accepted; nor is a text farther than max_distance from all
    profiles. Null ids and repeated rows are kept; other columns are ignored."""
    found = docs.select("doc_id", _identify(profiles)("text").alias("f"))
    return found.select("doc_id", F.col("f.lang").alias("detected"), F.col("f.distance").alias("distance"), F.coalesce(F.col("f.distance") <= max_distance, F.lit(False)).alias("accepted"))


def accepted(docs: DataFrame, profiles: Profiles, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """docs without the rows that `identify` doesn't accept; all columns stay as they are."""
    return docs.where(F.coalesce(_identify(profiles)("text").getField("distance") <= max_distance, F.lit(False)))
