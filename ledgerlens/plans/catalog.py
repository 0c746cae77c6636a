"""All queries of the engine with their SQL twins."""

from __future__ import annotations

from . import (
    emission_queries,
    execution_queries,
    expansion_queries,
    fusion_queries,
    gate_queries,
    lexical_queries,
    mechanism_queries,
    number_queries,
    planning_queries,
    retrieval_queries,
    structure_queries,
)

_MODULES = [lexical_queries, fusion_queries, number_queries, planning_queries, gate_queries, structure_queries, retrieval_queries, execution_queries, expansion_queries, emission_queries, mechanism_queries]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
