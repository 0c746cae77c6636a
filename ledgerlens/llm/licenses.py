"""License scans: phrases and an exact set-similarity join of text blocks with license templates.

A document's words are cut into overlapping blocks of twice the block length, one every block length, so a passage of
up to that many words lies whole in some block. Tokens are pairs of consecutive words, so that scattered words meet
nothing. A block meets a template if it holds at least the share CONTAINED of the template's distinct tokens. Tokens
are ordered globally by their frequency in all documents, rarest first. A pair that meets shares one of the template's
first tokens in that order (its prefix), the block has enough template tokens at all (length), and at the first shared
token both have enough left (position); only such pairs are verified. Of templates with other labels that have half
of their tokens in common, a block keeps those with the largest share, as variants of a notice hold much of each other.

All of it is DataFrame operations. Tokens outside all templates can be in no intersection and are left out before
blocks become rows, and only documents with some prefix token are cut at all. The templates are a fixed table, so
their prefix index and vocabulary, the only things broadcast or collected, don't grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, constants

#: Words between the starts of blocks; more if a template is longer.
BLOCK = 32
CONTAINED = 0.85
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice of at least two words, in lower case and single-spaced."""

    label: str
    text: str

    @property
    def tokens(self) -> frozenset[str]:
        words = self.text.split()
        return frozenset(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def block_words(templates: list[Template]) -> int:
    return max([BLOCK, *(len(t.text.split()) for t in templates)])


def rivals(templates: list[Template]) -> list[tuple[int, int]]:
    """Numbers of templates with other labels of which the smaller has half of its tokens in the other."""
    return [
        (i, j)
        for i, a in enumerate(templates)
        for j, b in enumerate(templates)
        if a.label != b.label and 2 * len(a.tokens & b.tokens) >= min(len(a.tokens), len(b.tokens))
    ]


def _any(strings: Iterable[str]) -> str:
    """An expression for any of the strings (of words and blanks) that tests their common beginnings once."""
    tails: dict[str, list[str]] = {}
    for s in strings:
        tails.setdefault(s[:1], []).append(s[1:])
    if list(tails) == [""]:
        return ""
    return "(?:" + "|".join(c + (_any(rest) if c else "") for c, rest in sorted(tails.items(), reverse=True)) + ")"


def spaced(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one blank before and after each; one blank if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(" ")), _OTHER, " ")


def _count(c: Column, part: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)


def _needed(t: Template, share: float) -> int:
    n = len(t.tokens)
    return max(1, -int(-share * n // 1))


def places(words: Column, phrases: dict[str, str]) -> list[Column]:
    """n_words, n_base, first_word, last_word, base (array of labels) from ``spaced`` words."""
    hits, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        mark = f" {phrase} "
        has = F.contains(words, F.lit(mark))
        hits.append(F.when(has, F.size(F.split(words, f" {phrase}(?= )", -1)) - 1).otherwise(0))
        before = F.substring(words, F.lit(1), F.instr(words, mark))
        firsts.append(F.when(has, _count(before, " ") - 1))
        upto = F.substring(words, F.lit(1), F.length(words) - F.instr(F.reverse(words), mark[::-1]) + 2 - len(mark))
        lasts.append(F.when(has, _count(upto, " ") - 1))
        labels.append(F.when(has, F.lit(label)))
    n = _count(words, " ") - 1
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return [
        n.cast("long").alias("n_words"),
        total.cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    ]


def contained(docs: DataFrame, templates: list[Template], share: float = CONTAINED) -> DataFrame:
    """(key, found, best) of the rows of ``docs`` (key, words: ``spaced``) with a block that meets a template.

    found: the templates' labels; best: the largest share of a template in a block.
    """
    spark, length = docs.sparkSession, block_words(templates)
    vocabulary = sorted(set().union(*[t.tokens for t in templates]))
    held = F.regexp_extract_all("words", F.lit(f" (?=({_any(vocabulary)}) )"), F.lit(1))
    often = {r.t: r.n for r in docs.select(F.explode(held).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary of the templates
    order = sorted(vocabulary, key=lambda t: (often.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    index = []
    for i, t in enumerate(templates):
        ranked, needs = sorted(t.tokens, key=rank.get), _needed(t, share)
        index += [(w, i, place, len(ranked), needs) for place, w in enumerate(ranked[: len(ranked) - needs + 1])]
    prefix = sorted({w for w, *_ in index})
    index_rows = F.broadcast(constants(spark, ["token", "template", "place", "size", "needs"], index))
    sets = F.broadcast(constants(spark, ["template", "label", "held"], [(i, t.label, sorted(t.tokens)) for i, t in enumerate(templates)]))

    some = docs.filter(F.col("words").rlike(f" {_any(prefix)} "))
    cut = some.select("key", F.split(F.trim("words"), " ").alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("words") - 1) / length).cast("int")))
    blocks = cut.withColumn("block", F.explode(starts)).select("key", "block", F.slice("words", F.col("block") * length + 1, 2 * length).alias("words"))
    pairs = F.transform("words", lambda w, i: F.concat(w, F.lit(" "), F.coalesce(F.get("words", i + 1), F.lit(""))))
    # array_intersect keeps the order of its first array: the global one
    ranked = blocks.select("key", "block", F.array_intersect(F.array(*map(F.lit, order)), pairs).alias("own"))
    first = ranked.filter(F.arrays_overlap("own", F.array(*map(F.lit, prefix))))
    met = first.select("key", "block", "own", F.posexplode("own").alias("at", "token")).join(index_rows, "token")
    n = F.size("own")
    met = met.filter((n >= F.col("needs")) & (F.col("at") <= n - F.col("needs")) & (1 + F.least(F.col("size") - F.col("place") - 1, n - F.col("at") - 1) >= F.col("needs")))
    common = F.size(F.array_intersect("own", "held"))
    verified = met.select("key", "block", "own", "template", "size", "needs").join(sets, "template").withColumn("common", common).filter("common >= needs")
    entry = F.struct((F.col("common") / F.col("size")).alias("share"), "common", "template", "label")
    by_block = verified.groupBy("key", "block").agg(F.collect_set(entry).alias("met"))  # at most the templates
    against: dict[int, list[int]] = {}
    for i, j in rivals(templates):
        against.setdefault(i, []).append(j)

    def beaten(x: Column) -> Column:
        def by(y: Column) -> Column:
            rival = F.lit(False)
            for i, others in against.items():
                rival = rival | ((x["template"] == i) & y["template"].isin(others))
            return rival & ((y["share"] > x["share"]) | ((y["share"] == x["share"]) & (y["common"] > x["common"])))

        return F.exists("met", by)

    left = by_block.select("key", F.explode(F.filter("met", lambda x: ~beaten(x))).alias("m"))
    return left.groupBy("key").agg(F.collect_set("m.label").alias("found"), F.max("m.share").alias("best"))


OUTPUTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, templates: list[Template], phrases: dict[str, str], keep: list[str], text: str = "text", share: float = CONTAINED) -> DataFrame:
    """``keep`` columns with n_words, n_base, first_word, last_word, base_labels, labels and score, one row per input row.

    A phrase's place is where its words stand consecutively. labels has those of phrases and templates; score is the
    largest share of a template in a block, 1 with a phrase, else 0. Null and empty texts have no words; repeated
    rows each get their result; rows need no id. Columns of ``keep`` with the name of a result give way to it.
    """
    if any(not t.tokens for t in templates):
        raise ValueError("a template needs two words")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = F.struct(*[F.col(c) for c in keep if c not in OUTPUTS], F.lit(0).alias("__none")).alias("own")
    rows = docs.select(own, F.md5(whole.cast("binary")).alias("key"), spaced(whole).alias("words"))
    base = rows.select("own", "key", *places(F.col("words"), phrases))
    if templates:
        found = contained(rows.select("key", "words"), templates, share)
        base = base.join(found, "key", "left")
    else:
        base = base.withColumns({"found": F.array().cast("array<string>"), "best": F.lit(0.0)})
    return base.select(
        *[F.col("own").getField(c).alias(c) for c in keep if c not in OUTPUTS],
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
