"""Boolean trigram queries of regular expressions, and secret scans by a trigram inverted index.

``clauses(pattern)`` gives an OR of ANDs of trigrams that every text with a match satisfies, in lower case; None if
the pattern has no mandatory trigram. The index holds postings (trigram, row key) for the trigrams that some rule
asks for; others are never looked up. Intersecting the postings of a clause is counting, per row and clause, the
clause's trigrams among the postings. Rows with a full clause are candidates of its rule; only they run the rule's
expression. Rules without mandatory trigrams run on every row.

All of it is DataFrame operations. Postings shuffle small rows (a key and a clause number), pre-aggregated per task;
texts are shuffled only if there are more candidates than may be broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, constants, materialize

_PARSER, _CODES = re._parser, re._constants
MOST_STRINGS = 64
BROADCAST_CANDIDATES = 500_000


def clauses(pattern: str) -> list[frozenset[str]] | None:
    found = _query(_PARSER.parse(pattern))
    if found is None:
        return None
    least = [c for c in found if not any(o < c for o in found)]
    return sorted(set(least), key=sorted)


def _and(a, b):
    """AND of two ORs of ANDs; None is true."""
    if a is None or b is None:
        return b if a is None else a
    both = {x | y for x, y in product(a, b)}
    return both if len(both) <= MOST_STRINGS else a


def _grams(strings: set[str]):
    made = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in made else made


def _exact(op, arg) -> set[str] | None:
    """All strings that a node matches, in lower case, if they are few."""
    if op is _CODES.LITERAL:
        return {chr(arg).lower()}
    if op is _CODES.IN and all(k is _CODES.LITERAL for k, _ in arg) and len(arg) <= 8:
        return {chr(v).lower() for _, v in arg}
    if op is _CODES.SUBPATTERN:
        return _exact_all(arg[3])
    if op is _CODES.BRANCH:
        parts = [_exact_all(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is _CODES.MAX_REPEAT and arg[1] <= 2:
        inner, out = _exact_all(arg[2]), set()
        if inner is None:
            return None
        for n in range(arg[0], arg[1] + 1):
            out |= {"".join(x) for x in product(inner, repeat=n)}
        return out
    if op is _CODES.AT:
        return {""}
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        one = _exact(op, arg)
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def _query(nodes):
    found, run = None, {""}
    for op, arg in nodes:
        one = _exact(op, arg)
        if one is not None and len(run) * len(one) <= MOST_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        found, run = _and(found, _grams(run)), {""}
        if one is not None:
            run = one
        elif op is _CODES.SUBPATTERN:
            found = _and(found, _query(arg[3]))
        elif op is _CODES.BRANCH:
            parts = [_query(x) if (e := _exact_all(x)) is None else _grams(e) for x in arg[1]]
            if None not in parts:
                found = _and(found, set().union(*parts))
        elif op in (_CODES.MAX_REPEAT, _CODES.MIN_REPEAT) and arg[0] >= 1:
            found = _and(found, _query(arg[2]))
    return _and(found, _grams(run))


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are leftmost and don't overlap; those whose ``group`` has fewer than ``least`` characters drop."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_order, end, kind>> of a rule's matches, in code points.

    The pieces between matches and the matches give all places by running sums, so Spark needs no position function.
    """
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    held = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else whole
    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("before"), whole.alias("size"), held.alias("held"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc.at + m.before
        made = F.struct(begin.alias("start"), F.lit(order).alias("kind_order"), (begin + m["size"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((begin + m["size"]).alias("at"), F.when(m.held >= rule.least, F.concat(acc.out, F.array(made))).otherwise(acc.out).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc.out)


def scan(docs: DataFrame, rules: list[Rule], text: str = "text", out: str = "found") -> DataFrame:
    """Add ``out``: array<struct<start, kind_order, end, kind>> of all rules' matches in the whole text, by start, then rule order.

    Null texts count as empty; an empty table gives an empty one; repeated rows each get their spans, and rows need
    no id. A column named ``out`` is replaced.
    """
    spark = docs.sparkSession
    asked = [(i, n, c) for i, r in enumerate(rules) for n, c in enumerate(clauses(r.pattern) or [])]
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c != out]
    key = F.md5(plain.cast("binary"))  # what is found depends on the text alone
    rows = docs.select(F.struct(*kept).alias("own"), plain.alias("whole"))
    if asked:
        grams = sorted(set().union(*[c for _, _, c in asked]))
        lowered = docs.select(key.alias("key"), F.lower(plain).alias("low"))
        # one test inside a loop over the trigrams: written out for each, the compiled method and the compiler's memory grow with the rules
        postings = lowered.select("key", F.explode(F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains("low", g))).alias("gram"))
        terms = constants(spark, ["rule", "clause", "gram", "needs"], [(i, n, g, len(c)) for i, n, c in asked for g in sorted(c)])
        full = (
            postings.join(F.broadcast(terms), "gram")
            .groupBy("key", "rule", "clause", "needs")
            .agg(F.count_distinct("gram").alias("has"))
            .filter("has = needs")
            .groupBy("key")
            .agg(F.collect_set("rule").alias("may"))
        )
        candidates = broadcast_if_small(materialize(full), BROADCAST_CANDIDATES)
        rows = rows.withColumn("key", F.md5(F.col("whole").cast("binary"))).join(candidates, "key", "left")
    none = F.array().cast("array<struct<start:int,kind_order:int,end:int,kind:string>>")
    every = []
    for i, r in enumerate(rules):
        indexed = any(i == j for j, _, _ in asked)
        may = F.coalesce(F.array_contains("may", i), F.lit(False)) if indexed else F.lit(True)
        every.append(F.when(may & F.col("whole").rlike(r.pattern), spans(F.col("whole"), r, i)).otherwise(none))
    return rows.select(*[F.col("own").getField(c).alias(c) for c in kept], F.array_sort(F.concat(*every) if every else none).alias(out))


def redacted(text: Column, found: Column) -> Column:
    """``text`` with every run of overlapping spans of ``found`` (sorted, as ``scan`` gives them) replaced by its first kind in brackets."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        gap = F.substring(text, acc.at + 1, m.start - acc.at)
        out = F.when(m.start >= acc.at, F.concat(acc.out, gap, F.lit("["), m.kind, F.lit("]"))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, m["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(found, begin, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)
