"""Main text of every page."""

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .html_text import extract

NAME = "op2_html_text"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


# The pages of these tables have one article each with paragraphs and headings; this takes it by patterns.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(h, '</?(p|h1|div)>'),
  lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))),
  lambda x: x <> '') AS t FROM a)
SELECT page_id, url, coalesce(array_to_string(t, chr(10) || chr(10)), '') AS text, length(coalesce(array_to_string(t, chr(10) || chr(10)), ''))::BIGINT AS n_chars FROM b
"""
