"""Phrase collocation mining over position bitmaps of words.

The texts of a language are cut into shards of about SHARD_BYTES. In a shard every word has a place, and borders of
pieces take places of their own, so no phrase steps over one. A word's bitmap says at which places it stands: only
chunks of BITS places that hold one are kept, as (chunk, mask). A phrase's bitmap says where it ends; shifted by one
place and ANDed with the words' masks of the same chunks it gives the bitmaps of all phrases one word longer, and
popcounts are their frequencies. Extension goes depth-first: a frontier is worked in parts of about FRONTIER chunks, and
a part's children are extended before the next part, so memory doesn't grow with the number of phrases.

Popcounts are summed over the shards of a language. A phrase can only be frequent if all its pairs of neighbouring words
are. So each shard first tells its pairs by 64-bit hashes; those that are frequent over all shards go back to the
shards that hold them, and only such pairs are extended and spelled out. Two pairs may share a hash: then too many
pairs go back, but the counts that decide are those of the words themselves.

What shards tell is cut into ranges of the hash, about RANGE_WORDS words of the corpus for each, and a shard's part of a
range is one row with packed arrays: a fraction of the bytes of a row for each phrase. A range is merged by one
task; a phrase has at most one entry for each shard in it, so a hot one doesn't swell its range. Texts are read once; the
rounds read the shards' codes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import LOWER, mix64
from .common import arrow_batches, materialize

SHARD_BYTES = 4 << 20
#: Bytes of text that a task holds over all languages before it closes its shards.
HELD_BYTES = 32 << 20
BITS, MASK = 8, np.uint8
FRONTIER = 1 << 17
LONGEST = 5
#: Words of the corpus to a range of hashes.
RANGE_WORDS = 1 << 20
#: Phrases to a bucket of the ranking, as a multiple of the rows asked for.
BUCKETED = 10

_BORDER = np.array([chr(b) in ".,;:!?" or 10 <= b <= 13 for b in range(256)])
_BLANK = np.array([b in (9, 32) for b in range(256)])


@dataclass
class Bitmaps:
    """Rows ``first[i]:first[i+1]`` of ``chunk`` and ``mask`` are the bitmap of the i-th phrase."""

    first: np.ndarray
    chunk: np.ndarray
    mask: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(self.mask).astype(np.int64), self.first[:-1]) if len(self) else np.zeros(0, np.int64)

    def part(self, a: int, b: int) -> Bitmaps:
        i, j = self.first[a], self.first[b]
        return Bitmaps(self.first[a : b + 1] - i, self.chunk[i:j], self.mask[i:j])

    def shifted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bitmaps one place on, as (phrase, chunk, mask) rows in order; a bit that leaves its chunk enters the next one."""
        moved = self.mask.astype(np.uint32) << np.uint32(1)
        mask = np.column_stack([moved & np.uint32((1 << BITS) - 1), moved >> np.uint32(BITS)]).ravel().astype(self.mask.dtype)
        some = np.flatnonzero(mask)
        owner = np.repeat(np.arange(len(self)), np.diff(self.first))
        return owner[some >> 1], self.chunk[some >> 1] + (some & 1), mask[some]


def grouped(key: np.ndarray, chunk: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, Bitmaps]:
    """Bitmaps of the distinct keys, in their order; rows of a key come by rising chunk, and masks of the same chunk are joined."""
    if not len(key):
        return key, Bitmaps(np.zeros(1, np.int64), chunk, mask)
    order = np.argsort(key, kind="stable")
    key, chunk, mask = key[order], chunk[order], mask[order]
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    new = start.copy()
    new[1:] |= chunk[1:] != chunk[:-1]
    at = np.flatnonzero(new)
    first = np.flatnonzero(start[at])
    return key[at][first], Bitmaps(np.append(first, len(at)), chunk[at], np.bitwise_or.reduceat(mask, at))


class Shard:
    """Bitmaps of a shard's words; ``codes`` has a word's number at each place, or -1 at a border."""

    def __init__(self, codes: np.ndarray):
        place = np.flatnonzero(codes >= 0)
        self.word, self.bitmaps = grouped(codes[place].astype(np.int64), (place // BITS).astype(np.int32), (1 << (place % BITS)).astype(MASK))
        # the same masks by chunk: the words of chunk c are rows of[c]:of[c+1]
        owner = np.repeat(self.word, np.diff(self.bitmaps.first))
        order = np.argsort(self.bitmaps.chunk, kind="stable")
        self.owner, self.mask = owner[order], self.bitmaps.mask[order]
        self.of = np.searchsorted(self.bitmaps.chunk[order], np.arange(len(codes) // BITS + 3)).astype(np.int32)

    def extended(self, phrases: Bitmaps) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
        """Phrases one word longer that occur: which phrase each begins with, its last word, and their bitmaps."""
        owner, chunk, mask = phrases.shifted()
        n = self.of[chunk + 1] - self.of[chunk]
        row = np.repeat(np.arange(len(owner)), n)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.of[chunk], n)
        both = mask[row] & self.mask[entry]
        some = np.flatnonzero(both)
        row, entry = row[some], entry[some]
        # of a phrase and a word; a shard has less than 2**31 of either
        key, found = grouped(owner[row] << 32 | self.owner[entry], chunk[row], both[some])
        return key >> 32, key & 0xFFFFFFFF, found

    def phrases(self, longest: int, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, counts) of all phrases of 2 to ``longest`` words, depth-first.

        ``allowed`` tells which pairs (arrays of first and second words) may stand in a phrase.
        """
        yield from self._below(self.word[:, None], self.bitmaps, longest, allowed)

    def _below(self, words: np.ndarray, bitmaps: Bitmaps, longest: int, allowed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = 0
        while at < len(bitmaps):
            end = max(at + 1, int(np.searchsorted(bitmaps.first, bitmaps.first[at] + FRONTIER, "right")) - 1)
            begun, last, found = self.extended(bitmaps.part(at, end))
            made = np.column_stack([words[at:end][begun], last])
            at = end
            if allowed is not None and len(made):
                keep = np.flatnonzero(allowed(made[:, -2], made[:, -1]))
                made, found = made[keep], _chosen(found, keep)
            if not len(made):
                continue
            yield made, found.counts()
            if made.shape[1] < longest:
                yield from self._below(made, found, longest, allowed)


def _chosen(bitmaps: Bitmaps, rows: np.ndarray) -> Bitmaps:
    n = np.diff(bitmaps.first)[rows]
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(bitmaps.first[rows], n)
    return Bitmaps(first, bitmaps.chunk[at], bitmaps.mask[at])


def coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Word numbers by place, with -1 at borders of pieces and texts, and the distinct words by number."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, offsets, raw = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = LOWER[np.frombuffer(raw, np.uint8)[at[0] : at[-1]]] if raw is not None else np.zeros(0, np.uint8)
    border = _BORDER[data]
    inside = ~(border | _BLANK[data])
    text_starts = np.unique(at[:-1] - at[0])
    text_starts = text_starts[text_starts < len(data)]
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    new[text_starts] = inside[text_starts]
    starts = np.flatnonzero(new)
    if not len(starts):
        return np.zeros(0, np.int32), pa.array([], pa.string())
    # only arrays over words have numbers; those over bytes of text are as narrow as the text
    last = inside.copy()
    last[:-1] &= ~inside[1:] | new[1:]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
    border[text_starts] = True
    passed = np.searchsorted(np.flatnonzero(border), starts, "right")
    apart = np.ones(len(starts), np.int64)
    apart[1:] += passed[1:] != passed[:-1]
    place = np.cumsum(apart) - 1
    codes = np.full(place[-1] + 2, -1, np.int32)
    codes[place] = words.indices.to_numpy()
    return codes, words.dictionary.cast(pa.string())


def _release() -> None:
    """Give freed memory back to the system: a worker that is reused would keep it, beside what the next task's workers take."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def _releasing(merge: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        merged = merge(table)
        _release()
        return merged

    return run


_SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_SHARD_COLUMNS = "shard long, lang string, codes binary, words array<string>, counts array<long>"


def shards(docs: DataFrame, lang: Column, text: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, lang, codes, words, counts): texts of a language as word numbers, its words and how often each occurs.

    A shard ends with the text that reaches ``shard_bytes``. Null texts, and texts without a word, leave nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def closed(key: str) -> pa.RecordBatch:
            codes, words = coded(pa.concat_arrays(held.pop(key)))
            n = np.bincount(codes[codes >= 0], minlength=len(words))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(n, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([key]), pa.array([codes.astype("<i4").tobytes()], pa.binary()), *lists], schema=_SHARDS)

        def close(key: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            made = closed(key)
            del size[key]
            _release()
            if len(made["words"][0]):
                yield made
                number += 1

        for batch in batches:
            key = batch.column(0).dictionary_encode()
            index = key.indices.to_numpy()
            order = np.argsort(index, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(index[order])) + 1):
                if len(rows):
                    name = key.dictionary[int(index[rows[0]])].as_py()
                    own = batch.column(1).take(pa.array(rows)).cast(pa.large_string())
                    held.setdefault(name, []).append(own)
                    size[name] = size.get(name, 0) + own.nbytes
                    if size[name] >= shard_bytes:
                        yield from close(name)
            while sum(size.values()) > HELD_BYTES:
                yield from close(max(size, key=size.get))
        for name in sorted(size):
            yield from close(name)

    arrow_batches(docs.sparkSession)
    texts = docs.select(lang.cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.filter("text != ''").mapInArrow(run, _SHARD_COLUMNS)


def _word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    """64-bit hashes of a language's words."""
    h = pd.util.hash_array(np.array([*words.to_pylist(), lang], dtype=object), categorize=False)
    return mix64(h[:-1] ^ mix64(h[-1:]))


def _hashes(word: np.ndarray, made: np.ndarray) -> np.ndarray:
    """64-bit hashes of phrases; ``word``: hashes of the words."""
    h = word[made[:, 0]]
    for j in range(1, made.shape[1]):
        h = mix64(h + word[made[:, j]])
    return h


def _ranged(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by hash, the ranges that occur, and where each begins in that order (one more at the end)."""
    order = np.argsort(hashes)
    of = ((hashes[order] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)
    return order, of[first].astype(np.int64), np.append(first, len(of))


def _frequent_pairs(whole: DataFrame, least: int, ranges: int) -> DataFrame:
    """(shard, hashes) of a shard's pairs whose hashes count ``least`` or more over all shards, a row for each range."""

    def told_by(shard: pa.Scalar, lang: str, codes: pa.Buffer, words: pa.Array) -> pa.RecordBatch | None:
        word = _word_hashes(lang, words)
        found = [(_hashes(word, made), n) for made, n in Shard(np.frombuffer(codes, "<i4")).phrases(2)]
        if not found:
            return None
        hashes, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order, of, first = _ranged(hashes, ranges)
        hashes, n = hashes[order].astype("<u8"), n[order].astype("<u4")
        packed = [pa.array([x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()) for x in (hashes, n)]
        return pa.RecordBatch.from_arrays([pa.array(of), pa.repeat(shard, len(of)), *packed], names=["range", "shard", "hashes", "n"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, codes, words in zip(*batch.columns, strict=True):
                made = told_by(shard, lang.as_py(), codes.as_buffer(), words.values)
                _release()
                if made is not None:
                    yield made

    def merge(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("hashes")]
        n = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table.column("n")])
        _, of = np.unique(np.concatenate(parts), return_inverse=True)
        often = (np.bincount(of, weights=n) >= least)[of]
        ends = np.cumsum([len(x) for x in parts])
        kept = [x[often[e - len(x) : e]].tobytes() for x, e in zip(parts, ends, strict=True)]
        return pa.table({"shard": table.column("shard"), "hashes": pa.array(kept, pa.binary())}).filter(pa.array([len(x) > 0 for x in kept], pa.bool_()))

    told = whole.select("shard", "lang", "codes", "words").mapInArrow(tell, "range long, shard long, hashes binary, n binary")
    return told.groupBy("range").applyInArrow(_releasing(merge), "shard long, hashes binary")


def _frequent_phrases(rows: DataFrame, least: int, longest: int, ranges: int) -> DataFrame:
    """(lang, phrase, n), n >= ``least``, of phrases of 2 to ``longest`` words whose pairs are all among their shards' ``hashes``."""
    schema = pa.schema([("range", pa.int64()), ("lang", pa.string()), ("phrases", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])

    def told_by(lang: pa.Scalar, codes: pa.Buffer, words: pa.Array, hashes: pa.Array) -> pa.RecordBatch | None:
        word = _word_hashes(lang.as_py(), words)
        kept = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in hashes]))

        def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            h = _hashes(word, np.column_stack([a, b]))
            return kept[np.minimum(np.searchsorted(kept, h), len(kept) - 1)] == h

        texts, found, counts = [], [], []
        for made, n in Shard(np.frombuffer(codes, "<i4")).phrases(longest, allowed):
            texts.append(pc.binary_join_element_wise(*[words.take(pa.array(made[:, j])) for j in range(made.shape[1])], " "))
            found.append(_hashes(word, made))
            counts.append(n)
        if not texts:
            return None
        order, of, first = _ranged(np.concatenate(found), ranges)
        at = pa.array(first.astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, x.take(pa.array(order))) for x in (pa.concat_arrays(texts), pa.array(np.concatenate(counts)))]
        return pa.RecordBatch.from_arrays([pa.array(of), pa.repeat(lang, len(of)), *lists], schema=schema)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, codes, words, hashes in zip(*batch.columns, strict=True):
                made = told_by(lang, codes.as_buffer(), words.values, hashes.values)
                _release()
                if made is not None:
                    yield made

    def merge(table: pa.Table) -> pa.Table:
        lists = table.column("phrases").combine_chunks()
        flat = {"lang": table.column("lang").take(pc.list_parent_indices(lists)), "phrase": pc.list_flatten(lists), "n": pc.list_flatten(table.column("n"))}
        summed = pa.table(flat).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        return summed.filter(pc.greater_equal(summed.column("n"), least)).select(["lang", "phrase", "n"])

    told = rows.select("lang", "codes", "words", "hashes").mapInArrow(tell, "range long, lang string, phrases array<string>, n array<long>")
    return told.groupBy("range").applyInArrow(_releasing(merge), "lang string, phrase string, n long")


def phrase_counts(docs: DataFrame, lang: Column, text: str, least: int, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES, range_words: int = RANGE_WORDS) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases, (lang, phrase, words, n) with n >= ``least`` of 1 to ``longest`` words, and (lang, n) with all words of each language."""
    whole = materialize(shards(docs, lang, text, shard_bytes))
    totals = whole.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    ranges = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // range_words))
    words = whole.select("lang", F.inline(F.arrays_zip(F.col("words").alias("phrase"), F.col("counts").alias("n"))))
    words = words.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    kept = _frequent_pairs(whole, least, ranges).groupBy("shard").agg(F.collect_list("hashes").alias("hashes"))  # a shard's own pairs
    frequent = words.unionByName(_frequent_phrases(whole.join(kept, "shard"), least, longest, ranges))
    return materialize(frequent.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n")), totals


def cut_score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (left * right)) of whole-number columns, exact while a is below 10**15 and the score fits into 64 bits."""
    return F.expr(f"CAST(CAST(1000 AS DECIMAL(4,0)) * CAST({a} AS DECIMAL(15,0)) * CAST({n} AS DECIMAL(19,0)) AS DECIMAL(38,0)) DIV CAST(CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0)) AS DECIMAL(38,0))")


def collocations(docs: DataFrame, lang: Column, text: str, least: int, most: int, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES, range_words: int = RANGE_WORDS) -> DataFrame:
    """The ``most`` first phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n all words of the language; score is
    floor(1000 * a * n / (l * r)) in decimals of 38 digits, so exact. Phrases that stand inside a longer one as often as
    that goes (a <= its a) are left out. Ties go by a, then by bytes of the phrase. Null texts have no words; repeated
    rows count each; a language without frequent phrases has no rows, as has an empty table.
    """
    counts, totals = phrase_counts(docs, lang, text, least, longest, shard_bytes, range_words)
    parts = F.split("phrase", " ")
    of = lambda begin, size: F.array_join(F.slice(F.col("parts"), begin, size), " ")
    candidates = counts.filter("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), parts.alias("parts"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: of(i, size))))
    held = candidates.filter("words >= 3").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    left = candidates.join(held, ["lang", "phrase"], "left").filter("inside IS NULL OR inside < a")
    cut = left.select("lang", "phrase", "a", "words", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", of(F.lit(1), F.col("k")).alias("head"), of(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    one = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(value))
    cut = cut.join(one("head", "l"), ["lang", "head"]).join(one("tail", "r"), ["lang", "tail"])
    best = cut.join(totals, "lang")  # as many rows as languages
    best = best.withColumn("score", cut_score("a", "n", "l", "r"))
    lowest = F.min(F.struct("score", "k", "l", "r", "n")).alias("cut")
    best = best.groupBy("lang", "phrase", "a").agg(lowest)
    ranked = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")
    # the first of each bucket, then of these the first of each language: a task sees few rows of a hot one
    buckets = -(-counts.count() // (BUCKETED * most)) or 1
    order = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    ranked = ranked.withColumn("rank", F.row_number().over(order("lang", "bucket"))).filter(F.col("rank") <= most)
    ranked = ranked.withColumn("rank", F.row_number().over(order("lang"))).filter(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
