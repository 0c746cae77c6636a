"""Answer expressions over evidence tables: checked, then read by a small interpreter on frames; Python never executes them.

An expression is one assignment to ``result``. Its names, attributes and syntax come from fixed lists, and every step
(attribute, index, call, operator) is taken by this module on pandas objects, so no other code can be reached. Spark
has no text form of such expressions, and each answer brings its own text, so they run in Arrow batches, one answer a
row; the tables of an answer, some dozens at most, come to it by a join. ``functions.expressions`` has the Column form
for one expression over many rows.
"""

from __future__ import annotations

import ast
import io
import math
import operator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import LONGEST, ExpressionError
from . import checks

# What an expression may name and read.
NAMES = {"pd": pd, "float": float, "int": int, "str": str, "len": len, "abs": abs, "min": min, "max": max, "sum": sum, "round": round}
ATTRIBUTES = frozenset([
    "agg", "all", "any", "astype", "between", "contains", "count", "dropna",
    "eq", "fillna", "ge", "groupby", "gt", "idxmax", "idxmin", "iloc", "index",
    "isin", "item", "le", "loc", "lower", "lt", "map", "mask", "max", "mean",
    "min", "nlargest", "nsmallest", "nunique", "replace", "reset_index", "round",
    "shape", "sort_values", "str", "strip", "sum", "to_numeric", "tolist",
    "transform", "unique", "values", "where",
])

_OPERATORS = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: operator.pow,
    ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Not: operator.not_,
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b,
}
#: Largest power and repetition, so that a short text can't ask for endless work.
LARGEST_POWER = 64


@lru_cache(maxsize=4096)
def parsed(query: str) -> ast.expr:
    """The expression that a query assigns to ``result``; ExpressionError if it is anything else."""
    if len(query) > LONGEST or "__" in query:
        raise ExpressionError("too long or holds a double underscore")
    try:
        body = ast.parse(query.strip()).body
    except (SyntaxError, ValueError, RecursionError) as e:
        raise ExpressionError("not valid Python") from e
    if len(body) != 1 or not isinstance(body[0], ast.Assign) or [getattr(t, "id", None) for t in body[0].targets] != ["result"]:
        raise ExpressionError("one assignment to result is allowed")
    return body[0].value


REDUCTIONS = frozenset(["all", "any", "count", "idxmax", "idxmin", "max", "mean", "min", "nunique", "sum"])


def _reduces(x) -> bool:
    """Whether ``x`` names reductions, singly, in a list or by column; pandas would call any method that is named so."""
    if isinstance(x, (list, tuple)):
        return all(map(_reduces, x))
    if isinstance(x, dict):
        return all(map(_reduces, x.values()))
    return x in (min, max, sum) or (isinstance(x, str) and x in REDUCTIONS)


class Reader:
    """Value of a checked expression; ``used`` tells which frames it read."""

    def __init__(self, frames: dict[str, pd.DataFrame]):
        self.frames = frames
        self.used: set[str] = set()

    def read(self, node):
        step = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if step is None:
            raise ExpressionError(f"{type(node).__name__} is not allowed")
        return step(node)

    def apply(self, op, *values):
        if type(op) not in _OPERATORS:
            raise ExpressionError(f"{type(op).__name__} is not allowed")
        if isinstance(op, ast.Pow) and isinstance(values[1], (int, float)) and abs(values[1]) > LARGEST_POWER:
            raise ExpressionError("too large a power")
        if isinstance(op, ast.Mult) and any(isinstance(v, (str, list, tuple)) for v in values):
            raise ExpressionError("only numbers can be multiplied")
        if isinstance(op, ast.Mod) and isinstance(values[0], str):
            raise ExpressionError("text can't be formatted")
        return _OPERATORS[type(op)](*values)

    def on_name(self, node):
        if node.id in self.frames:
            self.used.add(node.id)
            return self.frames[node.id]
        if node.id not in NAMES:
            raise ExpressionError(f"unknown name {node.id}")
        return NAMES[node.id]

    def on_constant(self, node):
        return node.value

    def on_attribute(self, node):
        on = self.read(node.value)
        if node.attr not in ATTRIBUTES or (on is pd and node.attr != "to_numeric"):
            raise ExpressionError(f"{node.attr} is not allowed")
        return getattr(on, node.attr)

    def on_subscript(self, node):
        return self.read(node.value)[self.read(node.slice)]

    def on_slice(self, node):
        return slice(*[None if x is None else self.read(x) for x in (node.lower, node.upper, node.step)])

    def on_list(self, node):
        return [self.read(x) for x in node.elts]

    def on_tuple(self, node):
        return tuple(self.on_list(node))

    def on_dict(self, node):
        return {self.read(k): self.read(v) for k, v in zip(node.keys, node.values, strict=True) if k is not None}

    def on_binop(self, node):
        return self.apply(node.op, self.read(node.left), self.read(node.right))

    def on_unaryop(self, node):
        return self.apply(node.op, self.read(node.operand))

    def on_compare(self, node):
        left, out = self.read(node.left), None
        for op, right in zip(node.ops, map(self.read, node.comparators), strict=True):
            one = self.apply(op, left, right)
            out, left = one if out is None else (out and one), right
        return out

    def on_boolop(self, node):
        out = None
        for x in node.values:
            out = self.read(x)
            if bool(out) != isinstance(node.op, ast.And):
                break
        return out

    def on_ifexp(self, node):
        return self.read(node.body if self.read(node.test) else node.orelse)

    def on_call(self, node):
        if any(k.arg in (None, "inplace") for k in node.keywords):
            raise ExpressionError("this named argument is not allowed")
        f = self.read(node.func)
        args = [self.read(a) for a in node.args]
        if not callable(f) or any(isinstance(a, ast.Starred) for a in node.args):
            raise ExpressionError("call not allowed")
        if getattr(node.func, "attr", "") in ("agg", "transform") and (node.keywords or not all(map(_reduces, args))):
            raise ExpressionError("only named reductions are allowed")
        return f(*args, **{k.arg: self.read(k.value) for k in node.keywords})


def evaluate(query: str, frames: dict[str, pd.DataFrame]) -> float:
    """The finite number that a query gives over its frames, of which it must read one; else ExpressionError."""
    reader = Reader(frames)
    try:
        value = float(reader.read(parsed(query)))
    except ExpressionError:
        raise
    except Exception as e:  # whatever pandas makes of odd cells
        raise ExpressionError(f"{type(e).__name__}: {e}") from e
    if not reader.used:
        raise ExpressionError("the query reads no evidence")
    if not math.isfinite(value):
        raise ExpressionError("the result is not finite")
    return value


RESULT = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("error", T.StringType())])


def execute(answers: DataFrame, evidence: DataFrame, qid: str, query: str = "query", variable: str = "variable", csv: str = "csv") -> DataFrame:
    """The rows of ``answers`` with value and error of their query over the tables of ``evidence`` (qid, variable, csv text with a header).

    One of both is null. Null queries, failing ones and results that are no finite number have an error; so have
    queries that read no table. Of tables under one name the smallest text counts. Columns named value or error give way.
    """

    @F.pandas_udf(RESULT)
    def run(queries: pd.Series, tables: pd.Series) -> pd.DataFrame:
        out = []
        for q, held in zip(queries, tables, strict=True):
            try:
                frames = {t["variable"]: pd.read_csv(io.StringIO(t["csv"] or "")) for t in reversed([] if held is None else list(held)) if t["variable"]}
                out.append((evaluate(q or "", frames), None))
            except Exception as e:
                out.append((None, str(e)[:200]))
        return pd.DataFrame(out, columns=RESULT.names)

    held = evidence.groupBy(qid).agg(F.array_sort(F.collect_set(F.struct(F.col(variable).alias("variable"), F.col(csv).alias("csv")))).alias("__tables"))
    kept = [c for c in answers.columns if c not in RESULT.names]
    ran = answers.select(*kept).join(held, qid, "left").withColumn("__ran", run(F.col(query), F.col("__tables")))
    return ran.select(*kept, "__ran.value", "__ran.error")


def verify_execution(answers: DataFrame, evidence: DataFrame, qid: str, answer: str = "answer", tolerance: float = 0.00025) -> DataFrame:
    """(qid, expected, actual, ok) of every answer: whether its query over its evidence gives its value."""
    ran = execute(answers, evidence, qid)
    return checks.replay(answers.select(qid, F.col(answer).alias("value")), ran.select(qid, "value"), qid, tolerance)
