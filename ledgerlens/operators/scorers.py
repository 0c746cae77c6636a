"""Pluggable models: anything that scores (query, text) pairs or embeds texts. The default needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlap_score(queries: list[str], texts: list[str]) -> list[float]:
    """Share of the query's words in the text; a stand-in for a cross-encoder, without its accuracy."""
    return [len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.lower().split()))) for q, t in zip(queries, texts, strict=True)]


def score_pairs(pairs: DataFrame, query: str, text: str, load: Callable[[], Callable] = lambda: overlap_score, name: str = "score") -> DataFrame:
    """Add a score per pair; ``load`` runs once per task and gives a function of two lists."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            yield pd.Series(model(q.fillna("").tolist(), t.fillna("").tolist()), dtype="float64")

    return pairs.withColumn(name, run(query, text))


def best_over_queries(scored: DataFrame, by: list[str], item: str, score: str) -> DataFrame:
    """The best score of each item over a question's queries, at six decimals."""
    return scored.groupBy(*by, item).agg(F.round(F.max(score), 6).alias(score))


def embed(rows: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], name: str = "vector") -> DataFrame:
    """Add a vector per text; ``load`` runs once per task and gives a function of a list of texts."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for t in batches:
            yield pd.Series(model(t.fillna("").tolist()))

    return rows.withColumn(name, run(text))
