"""Queries of the corpus operators with their SQL twins."""

from __future__ import annotations

from . import (
    queries_op1,
    queries_op2,
    queries_op3,
    queries_op4,
    queries_op5,
    queries_op6,
    queries_op7,
    queries_op8,
    queries_op9,
    queries_op10,
    queries_op11,
    queries_op12,
    queries_op13,
)

_MODULES = [queries_op1, queries_op2, queries_op3, queries_op4, queries_op5, queries_op6, queries_op7, queries_op8, queries_op9, queries_op10, queries_op11, queries_op12, queries_op13]
QUERIES = {m.NAME: m.query for m in _MODULES}
ORACLES = {m.NAME: m.ORACLE for m in _MODULES if m.ORACLE}
