"""Sixteen clusters of all embeddings after three rounds, and the same rounds in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .lloyd import cluster

NAME = "op12_centroids"
WIDTH, CLUSTERS, ROUNDS = 64, 16, 3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of embeddings with their clusters; of equal hashes the smaller vector starts first, null ids come last."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    return cluster(vectors, "embedding", [order], ["vec_id"], WIDTH, CLUSTERS, ROUNDS)


def _round(i: int) -> str:
    """Distances to the centroids c{i} and the nearest ones as n{i}."""
    return f"""
d{i} AS MATERIALIZED (SELECT row_no, k, sum((x - y) * (x - y)) AS d FROM v JOIN c{i} USING (j) GROUP BY row_no, k),
n{i} AS MATERIALIZED (SELECT row_no, k, d FROM (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY d, k) AS place FROM d{i}) WHERE place = 1)"""


def _moved(i: int) -> str:
    return f"""
m{i} AS (SELECT k, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM v JOIN n{i} USING (row_no) GROUP BY k, j),
c{i + 1} AS MATERIALIZED (SELECT c.k, c.j, CASE WHEN m.n IS NULL THEN c.y ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS y FROM c{i} AS c LEFT JOIN m{i} AS m USING (k, j))"""


ORACLE = f"""
WITH kept AS (SELECT row_number() OVER () AS row_no, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
v AS MATERIALIZED (SELECT row_no, unnest(range({WIDTH})) AS j, unnest(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT)) AS x FROM kept),
first AS (SELECT row_no, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM kept ORDER BY k LIMIT {CLUSTERS}),
c0 AS MATERIALIZED (SELECT k, j, x AS y FROM first JOIN v USING (row_no)),
{",".join(_round(i) + "," + _moved(i) for i in range(ROUNDS))},
{_round(ROUNDS)},
digests AS (SELECT k, sha256(string_agg(y::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM n{ROUNDS} JOIN kept USING (row_no) JOIN digests USING (k)
"""
