"""Collocations of each language of documents, and the same counts over all windows of words in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import ASCII_LOWER, ASCII_UPPER, table

NAME = "op11_collocations"
LEAST, MOST = 100, 2000


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return collocations(docs, F.coalesce("lang", F.lit("und")), "text", LEAST, MOST)


ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spans AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
inner_spans AS (SELECT lang, f, k, p, size, unnest(range(1, k - size + 2)) AS i FROM f CROSS JOIN (SELECT unnest(range(2, 5)) AS size) WHERE k > size),
inside AS (SELECT lang, p[i:i + size - 1] AS p, max(f) AS most FROM inner_spans GROUP BY ALL),
cuts AS (SELECT f.lang, f.p, f.f AS a, unnest(range(1, f.k)) AS c FROM f LEFT JOIN inside USING (lang, p) WHERE f.k >= 2 AND (most IS NULL OR most < f.f)),
scored AS (SELECT cuts.lang, cuts.p, a, c, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.p = cuts.p[1:c] JOIN f AS y ON y.lang = cuts.lang AND y.p = cuts.p[c + 1:] JOIN totals ON totals.lang = cuts.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, c) AS place FROM scored),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM lowest WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {MOST}
"""
