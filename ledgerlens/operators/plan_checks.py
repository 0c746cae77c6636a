"""Checks of many calculation plans at once: facts, steps and their inputs as tables, and one table of what is wrong.

facts: plan, id, place, entity, period, query. steps: plan, id, place, op. inputs: plan, step, ref. gates: plan, tickers,
years (what the plan may speak of; empty: anything). All rows of a plan meet in one shuffle and are judged where they are:
where one step rests on another, in as many turns as a plan has such steps, over arrays as long as the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .partitions import spread
from .questions import PLAN_OPERATIONS


def _gathered(facts: DataFrame, steps: DataFrame, inputs: DataFrame, gates: DataFrame) -> DataFrame:
    """(plan, facts, steps, inputs, gates): a plan's rows of each table as an array. Rows without a plan are one plan, whose inputs don't count."""
    gate = F.struct(F.transform("tickers", lambda t: F.lower(t)).alias("approved"), "years")
    each = [
        facts.select("plan", F.struct("id", "entity", "period").alias("facts")),
        steps.select("plan", F.struct("place", "id", "op").alias("steps")),
        inputs.filter("plan IS NOT NULL").select("plan", F.struct("step", "ref").alias("inputs")),
        gates.select("plan", gate.alias("gates")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    # counted are facts and steps, whose files tell it; inputs, a few for each step, would have to be spelled out
    most = 2 * (facts.count() + steps.count())
    return spread(rows, "plan", rows=most).groupBy("plan").agg(*[F.collect_list(c).alias(c) for c in ("facts", "steps", "inputs", "gates")])


def _ids(rows: Column) -> Column:
    return F.transform(rows, lambda x: x["id"])


def _linked(plans: DataFrame) -> DataFrame:
    """``plans`` with facts (those of no plan don't count), ids of facts and steps, all ids in order, edges (inputs that the plan has
    somewhere), those among steps, and the steps where these begin. Each is a column of its own, so that it is computed once."""
    own = F.when(F.col("plan").isNotNull(), F.col("facts")).otherwise(F.slice("facts", 1, 0))
    out = plans.select("plan", "steps", "inputs", "gates", own.alias("facts"), F.sort_array(F.concat(_ids(F.col("facts")), _ids(F.col("steps")))).alias("ids"))
    facts = F.array_distinct(F.filter(_ids(F.col("facts")), lambda i: i.isNotNull()))
    out = out.select("*", facts.alias("fact_ids"), F.array_distinct(_ids(F.col("steps"))).alias("step_ids"))
    inside = lambda e: F.array_contains("step_ids", e["step"]) & (F.array_contains("fact_ids", e["ref"]) | F.array_contains("step_ids", e["ref"]))
    out = out.select("*", F.filter("inputs", inside).alias("edges"))
    among = lambda e: ~F.array_contains("fact_ids", e["step"]) & ~F.array_contains("fact_ids", e["ref"])
    out = out.select("*", F.filter("edges", among).alias("among"))
    begin = lambda c: F.array_distinct(F.transform(c, lambda e: e["step"]))
    return out.select("*", begin("edges").alias("begin"), begin("among").alias("begin_among"))


def _unresolved() -> Column:
    """Ids of the steps of a linked plan that can never be computed, as they rest on a cycle. Inputs that the plan lacks don't count."""
    still = lambda held: F.filter("among", lambda e: F.array_contains(held, e["step"]) & F.array_contains(held, e["ref"]))
    return F.aggregate("begin_among", F.col("begin_among"), lambda held, _: F.array_distinct(F.transform(still(held), lambda e: e["step"])))


def _unused() -> Column:
    """Ids of the facts and steps of a linked plan that its last step doesn't rest on. A plan without steps uses all its facts."""
    last = F.array_max(F.transform("steps", lambda x: F.struct(x["place"], x["id"])))["id"]
    reached = lambda held: F.transform(F.filter("edges", lambda e: F.array_contains(held, e["step"])), lambda e: e["ref"])
    used = F.aggregate("begin", F.array(last), lambda held, _: F.array_union(held, reached(held)))
    return F.when(F.size("steps") > 0, F.array_except(F.concat("fact_ids", "step_ids"), used))


def _early(e: Column) -> Column:
    """Whether an input is one that the plan lacks, or one that comes no sooner than its step."""
    fact = F.when(F.array_contains("fact_ids", e["ref"]), F.lit(-1).cast("long"))
    place = F.array_min(F.transform(F.filter("steps", lambda s: s["id"] == e["ref"]), lambda s: s["place"].cast("long")))
    return let(F.least(fact, place), lambda known: F.exists("steps", lambda s: (s["id"] == e["step"]) & (known.isNull() | (known >= s["place"]))))


def violations(facts: DataFrame, steps: DataFrame, inputs: DataFrame, gates: DataFrame) -> DataFrame:
    """(plan, id, problem), each once; id is null where the plan as a whole is at fault. A plan without rows here is sound."""
    said = lambda ids, text: F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(text).alias("problem")))
    each = lambda ids, text: said(let(ids, lambda x: F.when(F.size(x) > 1, F.array_distinct(x)).otherwise(x)), text)
    gated = lambda rule: F.filter("facts", lambda f: F.exists("gates", lambda g: rule(f, g)))
    entity = lambda f, g: (F.size(g["approved"]) > 0) & ~F.array_contains(g["approved"], F.lower(F.coalesce(f["entity"], F.lit(""))))
    period = lambda f, g: f["period"].isNotNull() & (F.size(g["years"]) > 0) & ~F.array_contains(g["years"], f["period"])
    known = lambda s: F.coalesce(s["op"].isin(*sorted(PLAN_OPERATIONS)), F.lit(False))
    asked = F.filter(F.transform("inputs", lambda e: e["step"]), lambda i: i.isNotNull())
    found = [
        said(F.when((F.size("gates") > 0) & (F.size("facts") == 0), F.array(F.lit(None).cast("string"))), "no facts"),
        each(_ids(gated(entity)), "unapproved entity"),
        each(_ids(gated(period)), "unapproved period"),
        each(_ids(F.filter("steps", lambda s: ~known(s))), "unknown operation"),
        each(F.filter("ids", lambda x, i: (i > 0) & x.eqNullSafe(F.get("ids", i - 1))), "repeated id"),
        said(F.array_except("step_ids", asked), "no inputs"),
        each(F.transform(F.filter("inputs", _early), lambda e: e["step"]), "unknown or future input"),
        said(_unresolved(), "rests on a cycle"),
        said(_unused(), "not used"),
    ]
    empty = F.array().cast("array<struct<id: string, problem: string>>")
    judged = _linked(_gathered(facts, steps, inputs, gates)).select("plan", F.explode(F.concat(*[F.coalesce(x, empty) for x in found])).alias("x"))
    return judged.select("plan", "x.id", "x.problem")


def salvaged(facts: DataFrame, gates: DataFrame) -> DataFrame:
    """(plan, id, entity, period, query): the usable facts of broken plans, numbered anew in their order.

    A fact without a query goes. An entity beyond the gate's gives way to its first, a period beyond its years to none.
    """
    kept = facts.filter(F.trim(F.coalesce("query", F.lit(""))) != "")
    # a plan's facts are gathered before they meet its gate, so that the gate's arrays aren't sorted with every fact
    order = F.struct("place", "id", "entity", "period", "query")
    each = spread(kept, "plan").groupBy("plan").agg(F.sort_array(F.collect_list(order)).alias("__f")).join(gates, "plan")
    each = each.select("plan", "tickers", "years", F.posexplode("__f").alias("__n", "__x")).select("plan", "tickers", "years", "__n", "__x.entity", "__x.period", "__x.query")
    entity = F.when((F.size("tickers") > 0) & ~F.coalesce(F.array_contains("tickers", F.col("entity")), F.lit(False)), F.get("tickers", F.lit(0))).otherwise(F.col("entity"))
    period = F.when((F.size("years") == 0) | F.array_contains("years", F.col("period")), F.col("period"))
    return each.select("plan", F.concat(F.lit("f"), (F.col("__n") + 1).cast("string")).alias("id"), entity.alias("entity"), period.alias("period"), F.trim("query").alias("query"))
