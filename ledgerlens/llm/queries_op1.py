"""Secret scans over every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .trigrams import Rule, scan

NAME = "op1_secret_scan"

# The base kinds of the task. Runs that can't reach the least length can't hide a longer match of access
# or hex, so their lengths stand in the pattern.
BASE = [
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE = [
    Rule("pem", r"-----BEGIN (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
]
RULES = BASE + MORE


def joined(found):
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), RULES)
    n = lambda i: F.size(F.filter("found", lambda x: x.kind_order == i)).cast("long")
    base = F.filter("found", lambda x: x.kind_order < len(BASE))
    return found.select("doc_id", *[n(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _spans_sql(i: int, r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda k: {{
        's': (list_sum(list_transform(string_split_regex(t, '{p}')[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:k-1], lambda x: length(x))), 0))::BIGINT,
        'o': {i},
        'e': (list_sum(list_transform(string_split_regex(t, '{p}')[1:k], lambda x: length(x))) + list_sum(list_transform(regexp_extract_all(t, '{p}')[1:k], lambda x: length(x))))::BIGINT,
        'n': length(regexp_extract_all(t, '{p}', {r.group})[k]), 'k': '{r.kind}'}}), lambda m: m.n >= {r.least})"""


_ALL = ", ".join(_spans_sql(i, r) for i, r in enumerate(RULES))
_JOIN = "coalesce(array_to_string(list_transform({}, lambda m: m.k || ':' || m.s || ':' || m.e), ','), '')"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(flatten([{_ALL}])) AS found FROM d)
SELECT doc_id, {", ".join(f"len(list_filter(found, lambda m: m.o = {i}))::BIGINT AS n_{r.kind}" for i, r in enumerate(BASE))},
       sha256({_JOIN.format(f"list_filter(found, lambda m: m.o < {len(BASE)})")}) AS base_sha256, {_JOIN.format("found")} AS spans
FROM f
"""
