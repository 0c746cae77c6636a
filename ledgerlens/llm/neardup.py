"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, components.

A document's set holds the hashes of its distinct word shingles. One permutation of the 32-bit integers scatters the
set; a second one, applied after a circular shift by k, gives signature coordinate k as its minimum, for all k. The
coordinates are banded: ROWS a band, BANDS bands. At the threshold a pair shares no band with a probability of
(1 - 0.85 ** 5) ** 28 = 8e-8, above it still less.

Documents with equal sets are one class, and only its smallest id goes on. Classes that share a band bucket are
candidates, but pairs within a bucket are not spelled out: first each member meets a few centres of the bucket, the
verified links give components, and this repeats while it finds links. What is left are members whose buckets hold
several components. All pairs of these across components that can meet the threshold by an exact prefix, length and
position filter over their shingles, rarest first, meet in the last step; so no pair that could join two components is
left out, a bucket of n near copies costs about n pairs, and outliers of a large family don't meet it one by one.
Members with too many shingles that no other member has drop out at the start. Sets are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .blocks import VISIBLE, Block, blocks, mix64, words
from .common import arrow_batches, broadcast_if_small, materialize
from .components import components

SHINGLE = 5
ROWS = 5
BANDS = 28
SHINGLE_BLOCK = 512 << 10
BROADCAST_NODES = 300_000
#: Most rounds of meeting centres before the rest meets in full; more rounds only save work.
CENTRE_ROUNDS = 4
#: Centres a bucket has in each round.
CENTRES = 3


def shingles(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's rows, sorted within each row, and where each row's begin (one more at the end).

    A row with fewer words has its whole sequence as one shingle; without words it has none.
    """
    w = words(block, VISIBLE)
    n = np.diff(w.rows)
    rows = len(n)
    factors = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    total = len(w.codes)
    row_of = np.repeat(np.arange(rows), n)
    made = [np.zeros(0, np.uint64)]
    owner = [np.zeros(0, np.int64)]
    if total >= size:
        whole = np.zeros(total - size + 1, np.uint64)
        for j in range(size):
            whole += w.codes[j : j + total - size + 1] * factors[j]
        inside = row_of[: total - size + 1] == row_of[size - 1 :]
        made.append(mix64(whole[inside]))
        owner.append(row_of[: total - size + 1][inside])
    for r in np.flatnonzero((n > 0) & (n < size)):
        codes = w.codes[w.rows[r] : w.rows[r + 1]]
        made.append(mix64(np.array([(codes * factors[: len(codes)]).sum() + np.uint64(len(codes))], np.uint64)))
        owner.append(np.array([r]))
    codes, owner = np.concatenate(made), np.concatenate(owner)
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    if len(codes):
        first = np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])
        codes, owner = codes[first], owner[first]
    return codes, np.searchsorted(owner, np.arange(rows + 1))


def scatter(x: np.ndarray) -> np.ndarray:
    """First permutation of the 32-bit integers."""
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


def permute(x: np.ndarray) -> np.ndarray:
    """Second permutation of the 32-bit integers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(codes: np.ndarray, starts: np.ndarray, coordinates: int = ROWS * BANDS) -> np.ndarray:
    """uint32 (rows, coordinates) of non-empty rows; a row without shingles gets the largest value."""
    rows = len(starts) - 1
    out = np.full((rows, coordinates), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(starts))
    if not len(filled):
        return out
    step = 1 << 16
    bounds = [0]
    for i in range(1, len(filled)):
        if starts[filled[i]] - starts[filled[bounds[-1]]] >= step:
            bounds.append(i)
    for a, b in zip(bounds, [*bounds[1:], len(filled)], strict=True):
        some = filled[a:b]
        low, high = starts[some[0]], starts[some[-1] + 1]
        x = scatter((codes[low:high] >> np.uint64(32)).astype(np.uint32))
        at = starts[some] - low
        for k in range(coordinates):
            out[some, k] = np.minimum.reduceat(permute(x + np.uint32(k)), at)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """int64 (rows, bands): a hash of each band's coordinates and number."""
    rows = signature.shape[0]
    parts = signature.reshape(rows, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (rows, BANDS)).copy()
    for j in range(ROWS):
        out = mix64(out ^ parts[:, :, j]) + np.uint64(j)
    return out.view(np.int64)


SKETCH = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_shingles", T.LongType()), ("set_a", T.LongType()), ("set_b", T.LongType()), ("bands", T.ArrayType(T.LongType())))])


def _set_hashes(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set."""
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(codes ^ np.uint64(salt)), dtype=np.uint64)])
        sums.append((run[starts[1:]] - run[starts[:-1]]).view(np.int64))
    return sums[0], sums[1]


def sketch(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) of every row, without any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, second, made = [], [], [], []
            for b in blocks(batch.column(1), SHINGLE_BLOCK):
                codes, starts = shingles(b)
                n.append(np.diff(starts))
                a, c = _set_hashes(codes, starts)
                first.append(a)
                second.append(c)
                made.append(bands(signatures(codes, starts)))
            if not n:
                continue
            flat = np.concatenate(made).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(flat))
            columns = [batch.column(0), *[pa.array(np.concatenate(x).astype(np.int64)) for x in (n, first, second)], lists]
            yield pa.RecordBatch.from_arrays(columns, names=SKETCH.names)

    arrow_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, SKETCH)


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold; ``docs`` has node, text."""
    needed = broadcast_if_small(materialize(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()), BROADCAST_NODES)
    texts = materialize(docs.join(needed, "node"))
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column(0).to_numpy()
            keep = np.zeros(len(a), bool)
            new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            firsts = _sets(batch.column(2).take(pa.array(new))) if len(new) else []
            group = np.searchsorted(new, np.arange(len(a)), "right") - 1
            for i, second in enumerate(_sets(batch.column(3))):
                first = firsts[group[i]]
                if 100 * min(len(first), len(second)) < percent * max(len(first), len(second)):
                    continue
                common = len(np.intersect1d(first, second, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(first) + len(second) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, schema)


def _codes(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, code) of every shingle of the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.view(np.int64) for x in _sets(batch.column(1))]
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes), flat)], names=["node", "codes"])

    texts = docs.join(broadcast_if_small(nodes, BROADCAST_NODES), "node")
    return texts.select("node", "text").mapInArrow(run, "node long, codes array<long>").select("node", F.explode("codes").alias("code"))


def _own_shingles(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, own): how many of a node's shingles no other of ``nodes`` has."""
    alone = _codes(nodes, docs).groupBy("code").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other")
    return alone.groupBy("node").agg(F.count("*").alias("own"))


def _held(members: DataFrame, docs: DataFrame) -> DataFrame:
    """``members`` with held: how many of their shingles some other of them has too."""
    own = _own_shingles(materialize(members.select("node").distinct()), docs)
    return members.join(own, "node", "left").withColumn("held", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")


def _prefix_pairs(open_: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``open_`` (node, n, component) across components that can meet the threshold: by prefix, length and place.

    Shingles are ordered from the rarest; two sets that meet the threshold have a first common one so early in both
    that what follows can still hold the rest of the intersection.
    """
    codes = materialize(_codes(open_.select("node"), docs))
    often = codes.groupBy("code").agg(F.count("*").alias("often")).filter("often > 1")
    # a shingle that one node has alone comes first in its order and meets nothing
    order = Window.partitionBy("node").orderBy("often", "code")
    placed = codes.join(often, "code").withColumn("late", F.row_number().over(order)).join(open_, "node")
    placed = placed.withColumn("place", F.col("n") - F.col("held") + F.col("late") - 1).filter((F.col("place") * 100 <= F.col("n") * (100 - percent)))
    one, two = (placed.select("code", *[F.col(c).alias(c + s) for c in ("node", "n", "component", "place")]) for s in ("", "_2"))
    most = F.least(F.col("n") - F.col("place"), F.col("n_2") - F.col("place_2"))
    near = most * 100 >= (F.col("n") + F.col("n_2") - most) * percent
    return one.join(two, "code").filter((F.col("component") < F.col("component_2")) & near)


def _sets(column: pa.Array) -> list[np.ndarray]:
    out = []
    for b in blocks(column, SHINGLE_BLOCK):
        codes, starts = shingles(b)
        out += [codes[starts[i] : starts[i + 1]] for i in range(len(starts) - 1)]
    return out


def _possible(percent: int):
    """Whether two members can meet the threshold: none of the shingles that one has alone is common."""
    most = F.least("held", "held_2")
    return most * 100 >= (F.col("n") + F.col("n_2") - most) * percent


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents are linked if the intersection of their shingle sets has at least ``percent`` hundredths of the union;
    component_id is the smallest id that links reach, kept tells whether it is the row's own. Null or empty texts have
    no shingles and no links. Rows without an id are linked with nothing: component_id null, kept true. Rows that
    repeat an id each stay and get one component; of different texts under one id the smallest stands for all.
    """
    sketches = materialize(sketch(docs, text, doc_id))
    if not sketches.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        one = docs.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.min(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
        found = near_duplicates(materialize(one), percent).select("doc_id", "component_id")
        out = sketches.select("doc_id", "n_shingles").join(found, "doc_id", "left")
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    usable = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.count("*").alias("size"))
    classes = materialize(classes)
    lead = usable.join(classes.withColumnRenamed("node", "doc_id"), ["set_a", "set_b", "doc_id"], "left_semi")
    exploded = lead.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")).distinct()
    shared = exploded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket")
    members = materialize(exploded.join(shared, "bucket", "left_semi"))
    nodes = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
    # their texts are looked up often, so they are taken out of the corpus once
    wanted = broadcast_if_small(materialize(members.select("node").distinct()), BROADCAST_NODES)
    nodes = materialize(nodes.join(wanted, "node"))
    able = _held(materialize(members.select("node", "n").distinct()), nodes).filter(F.col("held") * 100 >= F.col("n") * percent)
    members = materialize(members.join(able.select("node", "held"), "node"))

    links = tried = found = None
    progress = True
    for round_ in range(CENTRE_ROUNDS + 1):
        if found is None:
            now = members.withColumn("component", F.col("node"))
        else:
            now = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low < high")
        open_ = materialize(now.join(mixed.select("bucket", "size"), "bucket"))
        if not open_.count():
            break
        in_full = not progress or round_ == CENTRE_ROUNDS
        if in_full:
            met = _prefix_pairs(materialize(_held(open_.select("node", "n", "component").distinct(), nodes)), nodes, percent)
        else:
            # by the node alone, so that buckets with the same members choose the same centres; the first has the
            # fewest shingles of its own, as such a member is nearest to the others
            keys = [F.col("n") - F.col("held"), *[F.xxhash64(F.lit(round_ * CENTRES + k), "node") for k in range(1, CENTRES)]]
            chosen = open_.groupBy("bucket").agg(F.array_distinct(F.array(*[F.min(F.struct(k.cast("long").alias("key"), F.col("node"))).getField("node") for k in keys])).alias("centres"))
            other = open_.select("bucket", *[F.col(c).alias(f"{c}_2") for c in ("node", "n", "held", "component")])
            met = open_.join(chosen.select("bucket", F.explode("centres").alias("node_2")), "bucket").join(other, ["bucket", "node_2"])
            met = met.filter((F.col("component") != F.col("component_2")) & _possible(percent))
        pairs = met.select(F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs)
        new = materialize(_verified(pairs, nodes, percent))
        progress = not new.isEmpty()
        tried = pairs if tried is None else tried.union(pairs)
        links = new if links is None else links.union(new)
        found = materialize(components(links))
        if in_full:
            break

    by_class = classes.select("set_a", "set_b", "node")
    if found is None:
        by_class = by_class.withColumnRenamed("node", "component")
    else:
        by_class = by_class.join(found, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"))
    # Classes of one document hold its id already; only the others' rows need the join.
    out = sketches.select("doc_id", "n_shingles", "set_a", "set_b").join(by_class, ["set_a", "set_b"], "left")
    own = F.col("n_shingles") == 0
    component = F.when(own | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
