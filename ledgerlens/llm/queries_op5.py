"""URL filters over every page."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .urlfilter import host_rule, judge, word_rule

NAME = "op5_url_filter"

# The rules of the task.
BASE = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BLOCKED_WORDS = ["spam-farm", "cheap-pills", "casino", "poker", "viagra", "payday-loans", "warez", "torrent", "xxx", "porn", "click-bait", "adserver", "free-money"]
RULES = [host_rule(*r) for r in BASE] + [word_rule("block", w, i) for i, w in enumerate(BLOCKED_WORDS)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES, keep=["page_id"])


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in BASE)
_WORDS = "|".join(BLOCKED_WORDS)
ORACLE = f"""
WITH u AS (
  SELECT row_number() OVER () AS n, page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS sep FROM pages
), h AS (
  SELECT n, page_id, CASE WHEN sep > 0 THEN regexp_extract(substr(url, sep + 3), '^[^/?#]*') ELSE '' END AS raw_host,
         CASE WHEN sep > 0 THEN substr(url, sep + 3) ELSE '' END AS rest FROM u
), p AS (
  SELECT n, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h
), r AS (
  SELECT * FROM (VALUES {_RULES}) AS t(verdict, rule_host, rule_path)
), best AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])({_WORDS})($|[^a-z0-9])') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (n)
"""
