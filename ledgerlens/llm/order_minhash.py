"""Document fingerprints by order MinHash, and each document's neighbour in id order.

Every KMER code points in a row of the whole text, white space included, are a k-mer, numbered by how often it has
occurred before, so repetitions stay apart; a shorter text is one k-mer. A hash scatters the numbered k-mers over a
ring. Each of the SKETCHES coordinates is one circular shift of that order: it picks the PICKED numbered k-mers that
come first from its own point of the ring on, among all of the text, puts them in text order and hashes the tuple. So
equal coordinates mean common content in a common order, as edit distance asks for, at any length of text.

All of it is array expressions on a row, sorting packed numbers (hash above, place below), with no shuffle: a step costs
time and memory in proportion to the text. A hash has HASH_BITS bits, a place PLACE_BITS: more than the numbers that an
array in a row can hold (2 GB). For neighbours, texts are shuffled once, to buckets of consecutive ids, in which a
window sees the next one; only the first document of each bucket goes to another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from .common import materialize

KMER = 8
SKETCHES = 20
PICKED = 2
PLACE_BITS = 28
HASH_BITS = 63 - PLACE_BITS
#: Places whose k-mers are strings at the same time.
CHUNK = 1 << 15
#: Documents in a bucket of neighbouring ids, and the most buckets; beyond these, buckets grow (and sort with spill).
BUCKET_ROWS = 2000
MOST_BUCKETS = 50_000

#: Where each coordinate's order begins on the ring.
_POINTS = [(i << HASH_BITS) // SKETCHES << PLACE_BITS for i in range(SKETCHES)]


def _none() -> Column:
    """No numbers, as an array that can't hold nulls: only such arrays are sorted as plain longs, without a box for each."""
    return F.slice(F.array(F.lit(0).cast("long")), 1, 0)


def _points() -> Column:
    return F.array(*[F.lit(p).cast("long") for p in _POINTS])


def _hash(x: Column) -> Column:
    """The hash that a packed number holds."""
    return F.shiftright(x, PLACE_BITS)


def _pack(hash64: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hash64, 64 - HASH_BITS), PLACE_BITS).bitwiseOR(place.cast("long"))


def _kmers(text: Column, first: Column) -> Column:
    """The packed k-mers of ``text`` in its order, with places that count from ``first``; none of a text under KMER."""
    every = F.lit(f"(?s)(?=(.{{{KMER}}})).")

    def chunk(at: Column) -> Column:
        found = F.regexp_extract_all(F.substring(text, at + 1, F.lit(CHUNK + KMER - 1)), every, F.lit(1))
        return let(first + at, lambda begin: F.transform(found, lambda x, i: _pack(F.xxhash64(x), begin + i)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(text), F.lit(CHUNK)), chunk))


def _whole(text: Column, kmers: Column) -> Column:
    """``kmers``, or the whole of a text that is too short for one."""
    return F.when(F.length(text) >= KMER, kmers).when(F.length(text) > 0, F.array(_pack(F.xxhash64(text), F.lit(0)))).otherwise(_none())


def packed(text: str) -> Column:
    """The packed k-mers of a text column."""
    return _whole(F.col(text), _kmers(F.col(text), F.lit(0)))


def _before(a: Column) -> Column:
    """The number before each one of an array; null at first. As a value of its own, a loop finds it at the same place."""
    return F.concat(F.array(F.lit(None).cast("long")), a)


def _alike(x: Column, y: Column) -> Column:
    """Whether two packed numbers hold the same hash: they differ in their places alone. Null where one is."""
    return x.bitwiseXOR(y) < (1 << PLACE_BITS)


def _again(s: str) -> Column:
    """Of sorted packed k-mers, all but the first occurrence of each."""
    return let(_before(F.col(s)), lambda before: F.filter(s, lambda x, i: _alike(x, F.get(before, i))))


def _heads(e: str) -> Column:
    """Where each k-mer's further occurrences begin among them."""
    a = F.col(e)
    new = lambda i: (i == 0) | (_hash(F.get(a, i)) != _hash(F.get(a, i - 1)))
    return F.when(F.size(a) > 0, F.filter(F.sequence(F.lit(0), F.size(a) - 1), new)).otherwise(F.array().cast("array<int>"))


def _numbered(e: str, heads: str) -> Column:
    """Further occurrences with a hash of k-mer and number."""
    a, h = F.col(e), F.col(heads)
    place = F.lit((1 << PLACE_BITS) - 1)
    run = lambda begin, k: F.slice(a, begin + 1, F.coalesce(F.get(h, k + 1), F.size(a)) - begin)
    return F.flatten(F.transform(h, lambda begin, k: F.transform(run(begin, k), lambda x, j: _pack(F.xxhash64(_hash(x), j + 1), x.bitwiseAND(place)))))


def _sketch(b: str, places: str, e: str) -> Column:
    """The coordinates from the sorted numbered k-mers ``b``, which still hold the unnumbered ``e``."""
    every, again = F.col(b), F.col(e)
    place = F.lit((1 << PLACE_BITS) - 1)

    def second(x: Column, i: Column) -> Column:
        after = F.get(F.col(places), i) + 1
        copies = F.when(_hash(F.get(every, after)) == _hash(x), F.size(F.filter(again, lambda o: _hash(o) == _hash(x)))).otherwise(0)
        return F.coalesce(F.get(every, after + copies), F.get(every, F.lit(0)))

    def tuple_hash(x: Column, y: Column) -> Column:
        in_order = x.bitwiseAND(place) <= y.bitwiseAND(place)
        return F.when(_hash(x) == _hash(y), F.xxhash64(_hash(x))).when(in_order, F.xxhash64(_hash(x), _hash(y))).otherwise(F.xxhash64(_hash(y), _hash(x)))

    first = F.transform(F.col(places), lambda at: F.get(every, at))
    return F.zip_with(first, F.transform(first, second), tuple_hash)


def _begins(b: str) -> Column:
    """Where in the sorted ``b`` each coordinate's order begins: at the first number that isn't below its point, found by halving."""
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(PLACE_BITS))])
    further = lambda held, point: lambda at, step: F.when(F.get(held, at + step - 1) < point, at + step).otherwise(at)
    place = lambda held, steps: lambda point: F.aggregate(steps, F.lit(0), further(held, point))
    found = let(F.col(b), lambda held: let(F.filter(powers, lambda k: k <= F.size(held)), lambda steps: F.transform(_points(), place(held, steps))))
    return F.when(F.size(b) > 0, F.transform(found, lambda p: F.when(p >= F.size(b), 0).otherwise(p))).otherwise(F.array().cast("array<int>"))


def fingerprints(df: DataFrame, kmers: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep`` columns and, for each column of ``kmers`` (packed k-mers of a text), its fingerprint (array of SKETCHES longs) by the given name.

    Empty texts have an empty fingerprint; equal texts have equal ones.
    """
    left, made = list(kmers), []
    for c in kmers:
        left.remove(c)
        rest = [*keep, *left, *made]
        # Each step is read more than once by the next, so that the optimizer keeps it a step of its own.
        df = df.select(*rest, F.sort_array(c).alias("__s"))
        df = df.withColumn("__e", _again("__s"))
        df = df.withColumn("__h", _heads("__e"))
        df = df.select(*rest, "__e", F.sort_array(F.concat("__s", _numbered("__e", "__h"))).alias("__b"))
        df = df.select(*rest, "__e", "__b", _begins("__b").alias("__p"))
        df = df.select(*rest, _sketch("__b", "__p", "__e").alias(kmers[c]))
        made.append(kmers[c])
    return df


def likeness(a: Column, b: Column) -> Column:
    """Share of equal coordinates; 1 if both are empty, 0 if only one is."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: F.coalesce(x, F.lit(False)))) / SKETCHES
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(same)


def shown(a: Column) -> Column:
    """A fingerprint as a string: 16 hexadecimal digits for each coordinate."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


#: Parts of a bucket are numbered below this.
_PARTS = 1 << 24


def _bucket(doc_id: str, key: str, shares: list[int], nulls: int) -> Column:
    """Number of a row's bucket, rising by id and then key.

    ``shares``: rising ids that begin equal shares of the rows. An id that begins several has as many buckets, by
    ranges of the key, before the one of the ids after it. Null ids come first, in ``nulls`` buckets.
    """
    unsigned = F.shiftrightunsigned(F.col(key), 40)  # 24 bits, whose order is that of the key's ranges
    part = lambda times: F.floor(unsigned * times / (1 << 24))
    no_id = part(F.lit(nulls)).cast("long")
    bounds = sorted(set(shares))
    if not bounds:
        return F.when(F.col(doc_id).isNull(), no_id).otherwise(F.lit(_PARTS))
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    nested = lambda values: F.array(*[longs(values[i : i + step]) for i in range(0, len(values), step)])
    reached = lambda values: F.size(F.filter(values, lambda b: F.col(doc_id) >= b))
    coarse = reached(longs([x[0] for x in parts]))
    fine = reached(F.coalesce(F.get(F.array(*map(longs, parts)), coarse - 1), longs([])))
    number = F.when(coarse > 0, (coarse - 1) * step + fine).otherwise(0).cast("long")
    hot = [b if shares.count(b) > 1 else None for b in bounds] if len(set(shares)) < len(shares) else []
    within = F.lit(0).cast("long")
    if hot:
        often = {b: shares.count(b) for b in set(hot) if b is not None}
        at = lambda values: F.get(F.get(nested(values), coarse - 1), fine - 1)
        times = at([often.get(b, 1) for b in bounds])
        within = F.when(times > 1, F.when(F.col(doc_id) == at(bounds), part(times)).otherwise(times)).otherwise(0)
    return F.when(F.col(doc_id).isNull(), no_id).otherwise((number + 1) * _PARTS + F.coalesce(within.cast("long"), F.lit(0)))


def edited_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text replaces the last quarter (rounded down) of a text's code points by as many first ones of the next
    document by ascending id, or all it has; the first follows the last. Null texts count as empty; null ids come
    first; rows with equal ids go by a hash of their texts; equal rows follow each other. Other columns don't matter.
    """
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    size, some = docs.agg(F.count("*"), F.count(doc_id)).first()
    buckets = max(1, min(MOST_BUCKETS, some // bucket_rows))
    shares = [i / buckets for i in range(1, buckets)]
    bounds = docs.agg(F.percentile_approx(doc_id, shares, 20 * buckets)).first()[0] if shares else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), own.alias("text")).withColumn("key", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    nulls = max(1, min(MOST_BUCKETS, (size - some) // bucket_rows))
    rows = rows.withColumn("bucket", _bucket("doc_id", "key", sorted(bounds or []), nulls))

    # the first document of each bucket follows the last one of the bucket before; there are at most MOST_BUCKETS twice
    first = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "key")).alias("f")).select("bucket", F.col("f.doc_id").alias("id"), F.col("f.key").alias("k"))
    around = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(around), F.last("bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    first = F.broadcast(first.withColumn("before", before).drop("bucket"))
    heads = rows.drop("bucket").join(first, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id"))).dropDuplicates(["before"])
    heads = heads.select("before", F.col("text").alias("head"), packed("text").alias("kmers"))
    heads = materialize(fingerprints(heads, {"kmers": "head_fp"}, ["before", "head"]))

    in_order = Window.partitionBy("bucket").orderBy("doc_id", "key")
    both = rows.withColumn("next", F.lead("text").over(in_order)).join(heads, F.col("bucket") == F.col("before"))
    both = both.withColumn("n", F.length("text")).withColumn("cut", F.floor(F.col("n") / 4).cast("int"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, n - cut)"), F.expr("left(coalesce(next, head), cut)")))
    # k-mers that lie in the part that both texts share are read once
    both = both.withColumn("common", F.greatest(F.lit(0), F.col("n") - F.col("cut") - (KMER - 1)))
    kept = ["bucket", "doc_id", "key", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "head_fp", "common"]
    both = both.select(*kept, packed("text").alias("kmers"), F.expr("substring(edited, common + 1)").alias("tail"))
    tail = _kmers(F.col("tail"), F.col("common"))
    edited = F.when(F.col("common") > 0, F.concat(F.slice("kmers", 1, F.col("common")), tail)).otherwise(_whole(F.col("tail"), tail))
    kept = ["bucket", "doc_id", "key", "n_chars", "edited_sha256", "head_fp"]
    made = fingerprints(both.select(*kept, "kmers", edited.alias("edited_kmers")), {"kmers": "fp", "edited_kmers": "edited_fp"}, kept)
    made = made.withColumn("next_fp", F.coalesce(F.lead("fp").over(in_order), "head_fp"))
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
