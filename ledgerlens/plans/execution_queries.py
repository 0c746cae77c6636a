"""Executed answer expressions over customers: each nation's block of customers is one evidence table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import execution
from .lexical_queries import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def evidence(spark, d):
    """(qid, variable, csv): customers of a nation and a block of 1000 keys by key: key, segment, whole balance."""
    c = table(spark, d, "customer").withColumn("qid", F.concat_ws("-", "c_nationkey", F.expr("c_custkey div 1000")))
    line = F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), "c_mktsegment", F.lit('"')), F.floor("c_acctbal"))
    by = c.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))).alias("s"))
    text = F.concat(F.lit("key,segment,balance\n"), F.array_join(F.transform("s", lambda x: x.line), "\n"))
    return by.select("qid", F.lit("df0").alias("variable"), text.alias("csv"))


def values(spark, d, text: str):
    e = evidence(spark, d)
    return execution.execute(e.select("qid", F.lit(f"result = {text}").alias("query")), e, "qid").select("qid", F.round("value", 6).alias("value"), "error")


CUSTOMERS = "c AS (SELECT c_nationkey || '-' || c_custkey // 1000 AS qid, c_custkey AS key, c_mktsegment AS segment, floor(c_acctbal) AS balance FROM customer)"


@query(f"WITH {CUSTOMERS} SELECT qid, round((arg_min(balance, key) / 1000 + count(*))::DOUBLE, 6) AS value, NULL::VARCHAR AS error FROM c GROUP BY 1")
def expr_iloc_cells(spark, d):
    return values(spark, d, "float(df0.iloc[0, 2]) / 1000 + len(df0)")


@query(f"WITH {CUSTOMERS}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY balance DESC, key) AS hi, row_number() OVER (PARTITION BY qid ORDER BY balance, key) AS lo FROM c) SELECT qid, (max(key) FILTER (hi = 1) - max(key) FILTER (lo = 1) + sum(balance) FILTER (hi <= 3))::DOUBLE AS value, NULL::VARCHAR AS error FROM k GROUP BY 1")
def expr_arg_extremes(spark, d):
    return values(spark, d, "df0.loc[df0['balance'].idxmax(), 'key'] - df0.loc[df0['balance'].idxmin(), 'key'] + df0.nlargest(3, 'balance')['balance'].sum()")


@query(f"WITH {CUSTOMERS}, m AS (SELECT qid, abs(balance - avg(balance) OVER (PARTITION BY qid, segment)) AS off FROM c) SELECT qid, round(max(off), 6) AS value, NULL::VARCHAR AS error FROM m GROUP BY 1")
def expr_groupby_transform(spark, d):
    return values(spark, d, "abs(df0['balance'] - df0.groupby('segment')['balance'].transform('mean')).max()")


@query(f"WITH {CUSTOMERS}, s AS (SELECT qid, sum(balance) AS v, min(key) AS k FROM c WHERE balance >= 0 GROUP BY 1) SELECT qid, round((v * (1 + (k % 2) / 100.0::DOUBLE)), 2) AS expected, CASE WHEN k % 5 = 0 THEN NULL ELSE v::DOUBLE END AS actual, k % 5 <> 0 AND abs(round((v * (1 + (k % 2) / 100.0::DOUBLE)), 2) - v) <= 0.00025 * greatest(1.0, abs(round((v * (1 + (k % 2) / 100.0::DOUBLE)), 2))) AS ok FROM s")
def verify_execution(spark, d):
    e = evidence(spark, d)
    c = table(spark, d, "customer").select(F.concat_ws("-", "c_nationkey", F.expr("c_custkey div 1000")).alias("qid"), F.col("c_custkey").alias("k"), F.floor("c_acctbal").alias("b")).filter("b >= 0")
    sums = c.groupBy("qid").agg(F.sum("b").alias("v"), F.min("k").alias("k"))
    good = F.lit("result = float(df0[df0['balance'] >= 0]['balance'].sum())")
    answers = sums.select("qid", F.round(F.col("v") * (1 + F.expr("k % 2") / 100.0), 2).alias("answer"), F.when(F.expr("k % 5 = 0"), F.lit("result = open('x')")).otherwise(good).alias("query"))
    return execution.verify_execution(answers, e, "qid").select("qid", "expected", "actual", "ok")
