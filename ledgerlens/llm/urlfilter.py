"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with the literal tokens that each matching URL must hold. A rule is filed under
the one of them that is rarest among all URLs. A URL's tokens fetch the rules filed under them, and only those run
their expressions. Natively: one explode of URL tokens, one join with the index, one aggregation back to rows.

The index has one row per rule. It is broadcast only if there are at most BROADCAST_RULES rules, else joined by
shuffling tokens; URLs that hold no filed token send one row on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, constants

BROADCAST_RULES = 100_000
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host + path; ``tokens`` are delimited literals of every match; higher ``rank`` wins."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int
    named: bool


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains whose paths start with ``path``; a longer rule ranks higher."""
    text = f"{host}{path}".lower()
    found = [m for m in re.finditer(TOKEN, text)]
    whole = tuple(m[0] for m in found if m.end() < len(text) or not path)
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, pattern, whole, verdict, 1_000_000 + len(host + path), True)


def word_rule(verdict: str, phrase: str, rank: int) -> Rule:
    """A rule for hosts and paths that hold ``phrase`` between non-alphanumerics, in either case."""
    pattern = rf"(?i)(?:^|[^a-z0-9]){re.escape(phrase)}(?:$|[^a-z0-9])"
    return Rule(f"*{phrase}*", pattern, tuple(re.findall(TOKEN, phrase.lower())), verdict, rank, False)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; both empty if it is null or has no ``://``."""
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(u, split, 1)), F.regexp_extract(u, split, 2)


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with host, path, rule and verdict, one row per input row.

    The rule of the highest rank that matches gives the verdict, else ``default``; rule is its name if it is a named
    one, else null. Null or odd URLs have an empty host and path and match nothing. Repeated rows stay repeated, and
    columns that clash with the added ones are replaced. With no rules every row gets ``default``.
    """
    made = ["host", "path", "rule", "verdict"]
    keep = [c for c in (pages.columns if keep is None else keep) if c not in made]
    host, path = parts(F.col(url))
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    names = [f"k{i}" for i in range(len(keep))]
    if rules:
        index = _index(pages.sparkSession, rows, rules)
        tokens = F.array_distinct(F.regexp_extract_all(ascii_lower(F.concat("host", "path")), F.lit(TOKEN), F.lit(0)))
        fetched = rows.withColumn("token", F.explode_outer(tokens))
        index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
        fits = F.when(F.expr("concat(host, path) rlike pattern"), F.struct("rank", "name", "decision", "named"))
        rows = fetched.join(index, "token", "left").groupBy("row").agg(*[F.first(c).alias(c) for c in [*names, "host", "path"]], F.max(fits).alias("best"))
    else:
        rows = rows.withColumn("best", F.lit(None).cast("struct<rank:int,name:string,decision:string,named:boolean>"))
    return rows.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "host",
        "path",
        F.when(F.col("best.named"), F.col("best.name")).alias("rule"),
        F.coalesce("best.decision", F.lit(default)).alias("verdict"),
    )


def _index(spark, rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, pattern, rank, name, decision, named): each rule under its rarest token among the rows, ties by token."""
    columns = ["id", "pattern", "rank", "name", "decision", "named"]
    table = constants(spark, columns, [(i, r.pattern, r.rank, r.name, r.verdict, r.named) for i, r in enumerate(rules)])
    literal = constants(spark, ["id", "token"], [(i, t) for i, r in enumerate(rules) for t in set(r.tokens)])
    vocabulary = sorted({t for r in rules for t in r.tokens})
    seen = (
        rows.select(F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.concat("host", "path")), F.lit(TOKEN), F.lit(0)))).alias("token"))
        .filter(F.col("token").isin(vocabulary))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )
    rarest = literal.join(seen, "token", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).getField("token").alias("token"))
    return table.join(rarest, "id").drop("id")
