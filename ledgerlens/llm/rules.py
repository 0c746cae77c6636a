"""Quality rules: base statistics of a text, and robust multivariate outliers among the texts of a language and source.

Texts that pass the base rules have a vector of transformed statistics (STATISTICS), in whole steps of 1 / STEPS. For
each group of a language and a source a minimum-covariance-determinant estimate is made: from a start at the medians
and quartile ranges, ROUNDS concentration steps take the half of the group nearest by Mahalanobis distance, and its mean
and covariance for the next distances. The estimate is scaled to the normal distribution, reweighted once with the rows
that are INSIDE with that chance, and texts so far out that normal ones are with a chance of BEYOND are rejected. A variance has FLOOR added, so
that a statistic that most of a group share exactly has a scale, too.

A step is one aggregation: rows are counted and summed by group and distance bin (BINS to a factor of e), before and after the
shuffle, and running sums over a group's bins find the half, which ends with a whole bin. So a group of any size is some
hundreds of rows, sums are of whole numbers and exact in any order, and equal rows are judged alike. Texts of a group
of under LEAST are judged by the estimate of their whole language, those of a language of under LEAST by that of all
texts; where all texts are fewer, they pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, materialize, unused

#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS, MARKS, BLANKS, CAPITALS = "#*$%&|<>", ".,;:!?", r"\x20\x09-\x0D", r"\p{Lu}"

STATISTICS = ("word_length", "symbols", "capitals", "marks")
P = len(STATISTICS)
STEPS = 1024
FLOOR = 0.1**2
#: Chances of normal rows: inside the half that concentrates, inside the reweighting, beyond the cutoff.
HALF, INSIDE, BEYOND = 0.5, 0.975, 1e-9
LEAST = 60
#: Concentration steps; few groups change after the sixth.
ROUNDS = 8
BINS = 32
BROADCAST_GROUPS = 100_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _only(text: str, kind: str) -> Column:
    """How many signs of a class of regular expressions a text has."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def _repeat_words(words: str, again: str) -> Column:
    """Words inside windows of three whose place is in ``again`` (sorted)."""
    a = F.col(again)
    return F.aggregate(F.transform(a, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(a, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda n, x: n + x)


def base(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with BASE and STATISTICS of a text; null counts as empty. Kept columns of these names give way.

    Windows of three words are found by sorting numbers of 32 hash bits and a place; those that share their hash bits
    are then compared by their words, so the count is exact.
    """
    keep = [c for c in keep if c.lower() not in (*BASE, *STATISTICS)]
    t, w, lines, c, h, m, d, r = (unused(keep, k) for k in ("t_", "w_", "l_", "c_", "h_", "m_", "d_", "r_"))
    df = df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(t))
    df = df.withColumn(w, F.regexp_extract_all(t, F.lit(f"[^{BLANKS}]+"), F.lit(0)))
    df = df.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{BLANKS}]")))
    places = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.slice(F.array(F.lit(0)), 1, 0))
    df = df.withColumn(c, F.transform(w, lambda x: F.xxhash64(x)))
    hashed = lambda i: F.shiftleft(F.xxhash64(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)), 32).bitwiseOR(i.cast("long"))
    df = df.withColumn(h, F.sort_array(F.transform(places, hashed)))
    high = lambda x: F.shiftright(x, 32)
    alike = lambda x, i: (high(x) == high(F.get(h, i + 1))) | (high(x) == high(F.get(h, F.when(i > 0, i - 1))))
    df = df.withColumn(m, F.filter(h, lambda x, i: F.coalesce(alike(x, i), F.lit(False))))
    place = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    df = df.withColumn(d, F.sort_array(F.transform(m, lambda x: F.struct(window(place(x)).alias("w"), place(x).alias("i")))))
    same = lambda x, i: F.coalesce((x["w"] == F.get(d, i + 1)["w"]) | (x["w"] == F.get(d, F.when(i > 0, i - 1))["w"]), F.lit(False))
    df = df.withColumn(r, F.sort_array(F.transform(F.filter(d, same), lambda x: x["i"])))
    df = df.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        (F.length(t).cast("long") - _only(t, BLANKS)).alias("word_chars"),
        _only(t, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(w, r).alias("n_repeat_words"),
        _only(t, CAPITALS).alias("n_capitals_"),
        _only(t, MARKS).alias("n_marks_"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    whole = lambda x: F.round(x * STEPS).cast("long")
    share = lambda a, b: whole(F.log(1 + 100 * F.col(a) / F.greatest(F.col(b), F.lit(1))))
    return df.select(
        *keep,
        *BASE[:-1],
        failed.alias("base_failed"),
        whole(F.log(F.greatest(F.col("word_chars") / F.greatest("n_words", F.lit(1)), F.lit(1.0)))).alias("word_length"),
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_capitals_", "word_chars").alias("capitals"),
        share("n_marks_", "word_chars").alias("marks"),
    )


def _chance(x: float, p: int) -> float:
    """That a chi-squared value of an even number ``p`` of degrees of freedom is at most ``x``."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(p // 2))


def _quantile(beyond: float, p: int) -> float:
    """The value that a chi-squared one passes with the chance ``beyond``."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        at = (low + high) / 2
        low, high = (at, high) if math.exp(-at / 2) * sum((at / 2) ** i / math.factorial(i) for i in range(p // 2)) > beyond else (low, at)
    return high


def _consistent(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows is to be multiplied with."""
    return share / _chance(_quantile(1 - share, P), P + 2)


def _groups(rows: DataFrame) -> DataFrame:
    """(own, key, feeds): the group that texts of a language and source (own) are judged in, and all groups whose estimates they take part in."""
    sizes = rows.groupBy("own", "lang_").agg(F.count("*").alias("n"))
    languages = sizes.groupBy("lang_").agg(F.sum("n").alias("m"), (F.min("n") < LEAST).alias("some_small"))
    all_, least = languages.agg(F.sum("m"), F.min("m")).first()
    whole = F.lit("[]") if (all_ or 0) >= LEAST else F.lit(None).cast("string")
    key = F.when(F.col("n") >= LEAST, F.col("own")).when(F.col("m") >= LEAST, F.col("lang_")).otherwise(whole)
    feeds = [F.when(F.col("n") >= LEAST, F.col("own")), F.when(F.col("some_small") & (F.col("m") >= LEAST), F.col("lang_"))]
    feeds += [whole] if (least or 0) < LEAST else []
    return sizes.join(languages, "lang_").select("own", key.alias("key"), F.array_compact(F.array(*feeds)).alias("feeds"))


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _start(rows: DataFrame) -> DataFrame:
    """(key, size, center, shift, inverse): medians, no shift, and the inverse of a diagonal scale from quartiles."""
    values = rows.select("key", F.posexplode("x").alias("i", "v")).groupBy("key", "i", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("key", "i").orderBy("v")
    whole = Window.partitionBy("key", "i")
    values = values.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
    at = lambda quarter: F.min(F.when(4 * F.col("upto") >= quarter * F.col("all"), F.col("v")))
    found = values.groupBy("key", "i").agg(F.max("all").alias("size"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))
    spread = ((F.col("q3") - F.col("q1")) / (1.349 * STEPS)).alias("spread")
    one = found.groupBy("key").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("i", "q2", spread))).alias("s"))  # P entries
    inverse = F.array(*[1 / F.sqrt(F.pow(F.col("s")[i]["spread"], 2) + FLOOR) if i == j else F.lit(0.0) for i, j in _PAIRS])
    return one.select("key", "size", F.transform("s", lambda e: e["q2"]).alias("center"), F.array(*[F.lit(0.0)] * P).alias("shift"), inverse.alias("inverse"))


def _distance(df: DataFrame, name: str) -> DataFrame:
    """The squared Mahalanobis distance of ``x`` by center, shift and inverse (rows of a triangular matrix)."""
    u, y = unused(df.columns, "u_"), unused(df.columns, "y_")
    df = df.withColumn(u, F.array(*[(F.col("x")[i] - F.col("center")[i]) / STEPS - F.col("shift")[i] for i in range(P)]))
    rows = [sum((F.col("inverse")[k] * F.col(u)[j] for k, (i, j) in enumerate(_PAIRS) if i == row), F.lit(0.0)) for row in range(P)]
    df = df.withColumn(y, F.array(*rows))
    return df.withColumn(name, sum((F.col(y)[i] * F.col(y)[i] for i in range(P)), F.lit(0.0))).drop(u, y)


def _inverted(df: DataFrame) -> DataFrame:
    """Adds ``inverse``: that of the lower Cholesky factor of the columns s0, s1, ... (_PAIRS of a covariance)."""
    at = {p: k for k, p in enumerate(_PAIRS)}
    low = lambda i, j: F.col(f"l{at[i, j]}")
    inv = lambda i, j: F.col(f"v{at[i, j]}")
    for j in range(P):
        rest = lambda i, j=j: F.col(f"s{at[i, j]}") - sum((low(i, k) * low(j, k) for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{at[j, j]}", F.sqrt(F.greatest(rest(j), F.lit(FLOOR / 1e6))))
        df = df.withColumns({f"l{at[i, j]}": rest(i) / low(j, j) for i in range(j + 1, P)}) if j + 1 < P else df
    for i in range(P):
        df = df.withColumns({f"v{at[i, j]}": (F.lit(1.0) if i == j else -sum((low(i, k) * inv(k, j) for k in range(j, i)), F.lit(0.0))) / low(i, i) for j in range(i + 1)})
    return df.withColumn("inverse", F.array(*[F.col(f"v{k}") for k in range(len(_PAIRS))]))


_SUMS = [f"a{i}" for i in range(P)] + [f"b{k}" for k in range(len(_PAIRS))]


def _sums() -> list[Column]:
    """Sums of x - center and of their products, as whole numbers; a bin's fit into 64 bits up to ten thousand million texts."""
    u = [F.col("x")[i] - F.col("center")[i] for i in range(P)]
    return [F.count("*").alias("n"), *[F.sum(u[i]).alias(f"a{i}") for i in range(P)], *[F.sum(u[i] * u[j]).alias(f"b{k}") for k, (i, j) in enumerate(_PAIRS)]]


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """(key, size, center, shift, inverse) from n, a* and b*, with the covariance times ``factor`` and FLOOR more on the diagonal."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    n = F.col("n").cast("double")
    product = lambda a, b: (wide(a).cast("decimal(25,0)") * wide(b).cast("decimal(13,0)")).cast("double")
    cov = {}
    for k, (i, j) in enumerate(_PAIRS):
        exact = product(f"b{k}", "n") - (wide(f"a{i}").cast("decimal(19,0)") * wide(f"a{j}").cast("decimal(19,0)")).cast("double")
        cov[f"s{k}"] = exact / n / n / STEPS**2 * factor + (FLOOR if i == j else 0.0)
    shift = F.array(*[F.col(f"a{i}") / n / STEPS for i in range(P)]).alias("shift")
    return _inverted(sums.select("key", "size", "center", shift, *[c.alias(k) for k, c in cov.items()])).select("key", "size", "center", "shift", "inverse")


def _concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The estimate from the nearest half of each group by the given one; a half ends with a whole bin."""
    d = _distance(rows.join(estimate, "key"), "d2")
    bins = d.withColumn("bin", F.floor(BINS * F.log(F.greatest("d2", F.lit(1e-9)))).cast("int")).groupBy("key", "bin").agg(F.first("size").alias("size"), F.first("center").alias("center"), *_sums())
    upto = Window.partitionBy("key").orderBy("bin")
    running = bins.select("key", "size", "center", F.col("n").alias("own"), *[F.sum(F.col(c).cast("decimal(28,0)")).over(upto).alias(c) for c in ("n", *_SUMS)])
    half = F.ceil(F.col("size") * HALF)
    chosen = running.filter((F.col("n") >= half) & (F.col("n") - F.col("own") < half))
    return _estimate(chosen, _consistent(HALF))


def _reweighted(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    inside = _distance(rows.join(estimate, "key"), "d2").filter(F.col("d2") <= _quantile(1 - INSIDE, P))
    return _estimate(inside.groupBy("key").agg(F.first("size").alias("size"), F.first("center").alias("center"), *_sums()), _consistent(INSIDE))


def judge(docs: DataFrame, text: str, lang: Column, source: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns with BASE, distance2 (squared Mahalanobis distance; null where none is taken) and kept, one row per row of ``docs``.

    A text is kept if it doesn't fail the base rules and isn't an outlier. Null texts count as empty and fail; null
    languages and sources are groups of their own; equal rows are judged alike. Kept columns named like results give way.
    """
    keep = [c for c in keep if c.lower() not in (*BASE, *STATISTICS, "distance2", "kept", "own", "lang_", "key", "x", "of_")]
    carried = docs.select(F.struct(*keep).alias("of_"), lang.cast("string").alias("lang_"), source.cast("string").alias("own"), F.col(text).alias("text_"))
    stats = base(carried, "text_", ["of_", "lang_", "own"]).select(
        "of_",
        *BASE,
        F.to_json(F.array("lang_")).alias("lang_"),
        F.to_json(F.array("lang_", "own")).alias("own"),
        F.array(*STATISTICS).alias("x"),
    )
    stats = materialize(stats)
    passed = stats.filter(~F.col("base_failed"))
    groups = materialize(_groups(passed))
    groups_ = broadcast_if_small(groups, BROADCAST_GROUPS)
    few = groups_ is not groups
    rows = materialize(passed.select("own", "x").join(groups_, "own").select(F.explode("feeds").alias("key"), "x"))
    hint = F.broadcast if few else lambda df: df  # there are at most as many estimates as groups
    estimate = materialize(_start(rows))
    for _ in range(ROUNDS):
        estimate = materialize(_concentrated(rows, hint(estimate)))
    estimate = materialize(_reweighted(rows, hint(estimate)))
    keyed = stats.join(groups_.drop("feeds"), "own", "left").join(hint(estimate), "key", "left")
    judged = _distance(keyed, "d2").withColumn("distance2", F.when(~F.col("base_failed"), F.col("d2")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= _quantile(BEYOND, P), F.lit(True))
    return judged.select("of_.*", *BASE, "distance2", kept.alias("kept"))
