"""Language identification by rank-order n-gram profiles.

A profile is a text's most frequent character n-grams (one to three characters of a word, a blank at its ends), best
first. A document gets the language whose profile is nearest by out-of-place distance: for each of the document's
n-grams the difference of its ranks, PROFILE if the language lacks it.

Languages are learned from about PER_LANGUAGE documents of each (all, where there are fewer), chosen by a hash of
their ids; the counts of their whole texts are summed per language. Prediction goes through every whole text without
a shuffle, in blocks of arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .blocks import Block, blocks
from .common import arrow_batches, broadcast_if_small, unused

PROFILE = 300
PER_LANGUAGE = 1500
UNKNOWN = "und"
BLANK = 32

_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
_FOLD = np.array([ord(low) if len(low := chr(i).lower()) == 1 else i for i in range(0x10000)], dtype=np.uint32)


def characters(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block in lower case with every non-letter as a blank, and where each row's begin (one more at the end)."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    heads = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    rows = heads[block.rows]
    small = points < 0x10000
    low = np.where(small, points, 0)
    out = np.where(_LETTER[low], _FOLD[low], BLANK).astype(np.uint32)
    for p in np.unique(points[~small]):
        out[points == p] = ord(chr(p).lower()[:1]) if chr(p).isalpha() else BLANK
    return out, rows


def grams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count) of a block, by row; an n-gram is its up to three code points of 21 bits each in one number."""
    points, rows = characters(block)
    n = len(rows) - 1
    none = np.zeros(0, np.int64)
    if not len(points):
        return none, none, none
    # a blank before and after each row, so that words at its ends have theirs
    text = np.full(len(points) + 2 * n, BLANK, np.uint32)
    owner = np.repeat(np.arange(n), np.diff(rows))
    text[np.arange(len(points)) + 2 * owner + 1] = points
    owner = np.repeat(np.arange(n), np.diff(rows) + 2)
    alphabet = np.unique(text)
    size = np.int64(len(alphabet) + 1)
    place = np.zeros(int(alphabet[-1]) + 1, np.int64)
    place[alphabet] = np.arange(1, len(alphabet) + 1)
    x = place[text]
    letter = text != BLANK
    same = owner[:-1] == owner[1:]
    keys = [((owner * size) * size * size + x)[letter]]
    two = same & (letter[:-1] | letter[1:])
    keys.append((owner[:-1] * size * size * size + x[:-1] * size + x[1:])[two])
    if len(x) > 2:
        three = same[:-1] & same[1:] & letter[1:-1] & (letter[:-2] | letter[2:])
        keys.append((owner[:-2] * size * size * size + (x[:-2] * size + x[1:-1]) * size + x[2:])[three])
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return none, none, none
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([first, [len(key)]]))
    key = key[first]
    row, code = key // size**3, key % size**3
    points_of = np.concatenate([[0], alphabet]).astype(np.int64)
    made = (points_of[code // size**2] << 42) | (points_of[code // size % size] << 21) | points_of[code % size]
    return row, made, count


def ranked(row: np.ndarray, gram: np.ndarray, count: np.ndarray, rows: int, most: int = PROFILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, rank from 0) of the ``most`` most frequent n-grams of each row; ties by n-gram."""
    order = np.lexsort((gram, -count, row))
    row, gram = row[order], gram[order]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row]
    keep = rank < most
    return row[keep], gram[keep], rank[keep]


class Profiles:
    """The learned languages: all their n-grams in order, and a rank of each per language (PROFILE: not in it)."""

    def __init__(self, learned: dict[str, list[int]]):
        self.languages = sorted(learned)
        self.grams = np.unique(np.array([g for x in learned.values() for g in x], np.int64))
        self.ranks = np.full((len(self.languages), len(self.grams) + 1), PROFILE, np.int64)
        for i, name in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.grams, np.array(learned[name], np.int64))] = np.arange(len(learned[name]))

    def predict(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Per row the number of the nearest language (-1: no letter) and a score."""
        rows = block.last - block.first
        row, gram, rank = ranked(*grams(block), rows)
        best, score = np.full(rows, -1), np.zeros(rows)
        if not len(row) or not self.languages:
            return best, score
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        held = np.bincount(row, minlength=rows)
        distance = np.empty((len(self.languages), rows))
        for i, ranks in enumerate(self.ranks):
            r = ranks[at]
            distance[i] = np.bincount(row, np.where(r < PROFILE, np.abs(r - rank), PROFILE), minlength=rows)
        some = held > 0
        best[some] = distance.argmin(axis=0)[some]
        score[some] = 1 - distance.min(axis=0)[some] / (held[some] * PROFILE)
        return best, score


#: Languages whose sizes are broadcast; more are joined by a shuffle.
MOST_LANGUAGES = 100_000


def learn(labelled: DataFrame, text: str, lang: str, chosen_by: Column, per_language: int = PER_LANGUAGE) -> Profiles:
    """Profiles of the languages of ``labelled``; ``chosen_by`` is a hash by which the documents to learn from are chosen."""
    usable = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.pmod(chosen_by, F.lit(1 << 30)).alias("by")).dropna()
    sizes = broadcast_if_small(usable.groupBy("lang").agg(F.count("*").alias("of")), MOST_LANGUAGES)
    sample = usable.join(sizes, "lang").filter(F.col("by") * F.col("of") < F.lit(per_language * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for b in blocks(batch.column(1)):
                row, gram, n = grams(b)
                for name in sorted(set(names[b.first : b.last])):
                    own = np.flatnonzero(names[b.first : b.last] == name)
                    mask = np.isin(row, own)
                    made, inverse = np.unique(gram[mask], return_inverse=True)
                    total = np.bincount(inverse, n[mask], minlength=len(made)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(made), pa.string()), pa.array(made), pa.array(total)], names=["lang", "gram", "n"])

    arrow_batches(labelled.sparkSession)
    counts = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= PROFILE).collect()
    learned: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        learned.setdefault(r["lang"], []).append(r.gram)
    return Profiles(learned)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with lang_pred and score (0 to 1: nearer is higher), one row per input row.

    A text that is null or has no letter gets ``und`` and score 0, as does every text if no language was learned.
    Equal distances go to the language first in the alphabet. Kept columns with the names of the results give way.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        names = pa.array([*p.languages, UNKNOWN], pa.string())
        for batch in batches:
            parts = [p.predict(b) for b in blocks(batch.column(len(keep)))]
            if not parts:
                continue
            best = np.concatenate([x for x, _ in parts])
            score = np.concatenate([x for _, x in parts])
            made = [names.take(pa.array(np.where(best < 0, len(p.languages), best))), pa.array(score)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=[*keep, "lang_pred", "score"])

    arrow_batches(docs.sparkSession)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*keep, F.col(text).cast("string").alias(unused(keep))).mapInArrow(run, schema)
