"""Benchmark decontamination by suffix arrays over the training texts.

Shards are blocks of documents. A shard's suffix array holds the word suffixes that begin like some benchmark window
(with its first words, up to three; no other suffix can match), sorted by their first words as far as the longest
window. Every benchmark suffix is searched in it by bisection, one word deeper at a time, which gives the range of all
suffixes that share a whole window. Matches that continue each other in item and document are joined, so each match
is as long as can be and has its place in both.

The benchmark goes to the executors in parts of at most about PART_WORDS words, one after the other, with one pass over
the documents for each part; an ordinary benchmark is one part. A pass has no shuffle, so neither hot sources nor
copies matter; memory is bounded by a batch, a shard and a part, also in the driver. Parts after the first write the
matches of the rows that they hit and nothing of any other row; these join the first part's rows once. A worker
process prepares a part once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import ALNUM, Block, blocks, words
from .common import arrow_batches, materialize, unused

WINDOW = 10
PART_WORDS = 2_000_000
SHARD_BYTES = 1 << 20

MATCH = T.StructType(
    [T.StructField("item", T.StringType()), T.StructField("item_start", T.LongType()), T.StructField("doc_start", T.LongType()), T.StructField("length", T.LongType())]
)


def _bisect(column: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, goes_on) -> np.ndarray:
    """For each wanted value the first place in its sorted range of ``column`` where ``goes_on(value there, wanted)`` ends."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) >> 1
        right = goes_on(column[mid], wanted[open_])
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


class Windows:
    """The windows of some benchmark items: word numbers, and which items hold them where."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        column = pa.array([t for _, t in items], pa.large_string())
        codes = [np.zeros(0, np.uint64)]
        texts = []
        for b in blocks(column):
            w = words(b, ALNUM)
            codes.append(w.codes)
            texts += [w.codes[w.rows[i] : w.rows[i + 1]] for i in range(b.last - b.first)]
        self.vocabulary = np.unique(np.concatenate(codes))
        rows = []
        self.names = [i for i, _ in items]
        for t in texts:
            ids = np.searchsorted(self.vocabulary, t) + 1
            size = min(window, len(ids))
            if size:
                own = np.zeros((len(ids) - size + 1, window), np.int64)
                own[:, :size] = np.lib.stride_tricks.sliding_window_view(ids, size)
                rows.append(own)
            else:
                rows.append(np.zeros((0, window), np.int64))
        n = np.array([len(x) for x in rows], np.int64)
        self.words = np.concatenate([np.zeros((0, window), np.int64), *rows])
        self.item = np.repeat(np.arange(len(texts)), n)
        self.start = np.arange(len(self.words)) - np.repeat(np.cumsum(n) - n, n)
        self.sizes = np.repeat(np.array([min(window, len(t)) for t in texts], np.int64), n)
        self.least = int(self.sizes.min()) if len(self.sizes) else 0
        self.lead = min(3, self.least)
        base = np.int64(len(self.vocabulary) + 2)
        self.leads, key = [], np.zeros(len(self.words), np.int64)
        for d in range(self.lead):
            key = key * base + self.words[:, d] if d < 1 else np.searchsorted(self.leads[-1], key) * base + self.words[:, d]
            self.leads.append(np.unique(key))
        self.base = base

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """Places of ``text`` whose first words begin some window."""
        at = np.flatnonzero(text > 0)
        key = text[at]
        for d in range(self.lead):
            if d:
                keep = at + d < len(text)
                at, key = at[keep], key[keep]
                follows = text[at + d]
                keep = follows > 0
                at, key = at[keep], np.searchsorted(self.leads[d - 1], key[keep]) * self.base + follows[keep]
            place = np.minimum(np.searchsorted(self.leads[d], key), len(self.leads[d]) - 1)
            keep = self.leads[d][place] == key
            at, key = at[keep], key[keep]
        return at

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window number, place in text) of every whole window in a text of word numbers (0: foreign word or border)."""
        none = np.zeros(0, np.int64)
        if not self.least:
            return none, none
        at = self.candidates(text)
        if not len(at):
            return none, none
        width = self.words.shape[1]
        padded = np.concatenate([text, np.zeros(width, np.int64)])
        columns = [padded[at + d] for d in range(width)]
        order = np.lexsort(columns[::-1])
        suffixes, columns = at[order], [c[order] for c in columns]
        low, high = np.zeros(len(self.sizes), np.int64), np.full(len(self.sizes), len(at), np.int64)
        for d in range(width):
            live = np.flatnonzero((low < high) & (self.sizes > d))
            if not len(live):
                break
            wanted = self.words[live, d]
            first = _bisect(columns[d], wanted, low[live], high[live], np.less)
            low[live], high[live] = first, _bisect(columns[d], wanted, first, high[live], np.less_equal)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return which, suffixes[place]


def _matches(w: Windows, block: Block) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Words per row; the longest matches (row, item, item start, document start, length); their count per row."""
    got = words(block, ALNUM)
    n = len(block.rows) - 1
    counts = np.diff(got.rows)
    place = np.minimum(np.searchsorted(w.vocabulary, got.codes), max(0, len(w.vocabulary) - 1))
    number = np.where(w.vocabulary[place] == got.codes, place + 1, 0) if len(w.vocabulary) else np.zeros(len(got.codes), np.int64)
    text = np.zeros(len(number) + n, np.int64)  # a 0 after each row
    rows = np.repeat(np.arange(n), counts)
    text[np.arange(len(number)) + rows] = number
    begins = got.rows[:-1] + np.arange(n)
    which, at = w.search(text)
    row = np.searchsorted(begins, at, "right") - 1
    item, item_start, doc_start, size = w.item[which], w.start[which], at - begins[row], w.sizes[which]
    order = np.lexsort((doc_start, doc_start - item_start, item, row))
    row, item, item_start, doc_start, size = (x[order] for x in (row, item, item_start, doc_start, size))
    if len(row):
        go_on = (np.diff(row) == 0) & (np.diff(item) == 0) & (np.diff(doc_start) == 1) & (np.diff(item_start) == 1)
        heads = np.flatnonzero(np.concatenate([[True], ~go_on]))
        tails = np.concatenate([heads[1:], [len(row)]]) - 1
        size = doc_start[tails] - doc_start[heads] + size[tails]
        row, item, item_start, doc_start = (x[heads] for x in (row, item, item_start, doc_start))
    return counts, [item, item_start, doc_start, size], np.bincount(row, minlength=n)


_PREPARED: dict[str, Windows] = {}


def prepared(name: str, items, window: int) -> Windows:
    """The windows of a part by its name, made once in each worker process, which keeps the last part."""
    if name not in _PREPARED:
        _PREPARED.clear()
        _PREPARED[name] = Windows(items(), window)
    return _PREPARED[name]


def _pass(docs: DataFrame, keep: list[str], items: list[tuple[str, str]], window: int) -> DataFrame:
    """``keep`` columns with n_words and matches against the given items; the last column of ``docs`` is the text."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = prepared(name, lambda: shared.value, window)
        names = pa.array(w.names, pa.string())
        for batch in batches:
            counts, columns, sizes = [], [[] for _ in range(4)], []
            for b in blocks(batch.column(len(keep)), SHARD_BYTES):
                n, found, per_row = _matches(w, b)
                counts.append(n)
                sizes.append(per_row)
                for c, x in zip(columns, found, strict=True):
                    c.append(x)
            if not counts:
                continue
            item, *places = [np.concatenate(c) for c in columns]
            fields = [names.take(pa.array(item)), *[pa.array(x, pa.int64()) for x in places]]
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, MATCH.names))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(np.concatenate(counts), pa.int64()), found], names=[*keep, "n_words", "matches"])

    arrow_batches(docs.sparkSession)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))])
    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, part_words: int = PART_WORDS) -> DataFrame:
    """``keep`` columns (default: all but n_words and matches) with n_words and matches, one row per input row.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, ASCII letters in lower case. A match is a
    longest run of words that lie in common windows of ``window`` words at the same distance in item and document;
    an item of fewer words is one window. Null texts have no words; an item without words matches nothing; a null
    item id counts as an empty name; repeated rows each get their matches. An empty benchmark matches nothing. Kept
    columns named n_words or matches give way to the results.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "matches")]
    chosen = docs.select(*keep, F.col(text).cast("string").alias(unused(keep)))
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = 1 + total // (part_words * 4)  # a word has rarely under four characters with its space; of parts, the size matters little
    if parts == 1:
        return _pass(chosen, keep, [tuple(r) for r in items.collect()], window)
    row = unused([*keep, "n_words", "matches", *chosen.columns], "row")
    chosen = materialize(chosen.select(F.monotonically_increasing_id().alias(row), *chosen.columns))

    def part(p: int) -> list[tuple[str, str]]:
        return [tuple(r) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).collect()]

    first = _pass(chosen, [row, *keep], part(0), window)
    others = unused([*first.columns], "others")
    hits = None
    for p in range(1, parts):
        found = _pass(chosen.select(row, chosen.columns[-1]), [row], part(p), window)
        found = materialize(found.filter(F.size("matches") > 0).select(row, F.col("matches").alias(others)))
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy(row).agg(F.flatten(F.collect_list(others)).alias(others))
    both = F.concat("matches", F.coalesce(F.col(others), F.array().cast(T.ArrayType(MATCH))))
    return first.join(hits, row, "left").select(*keep, "n_words", both.alias("matches"))


def hit_words(matches) -> F.Column:
    """Words of the document inside any match."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m.doc_start.alias("a"), (m.doc_start + m.length).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda s, m: F.struct(F.greatest(s.to, m.b).alias("to"), (s.n + F.greatest(m.b - F.greatest(s.to, m.a), F.lit(0).cast("long"))).alias("n")), lambda s: s.n)


def items(matches) -> F.Column:
    """Names of the matching items, sorted."""
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item"])))


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any match, with their own columns."""
    found = find(docs.select(F.struct("*").alias("__own"), F.col(text).alias("__own_text")), benchmark, text="__own_text", keep=["__own"])
    return found.filter(F.size("matches") == 0).select("__own.*")
