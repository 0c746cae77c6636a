"""Emitted expressions: the value, the text and the citations of a plan, all from the cells that it reads.

A plan is an operator, the cells it reads in the order of its text, the divisor of the unit asked for (1 for relative figures), and a factor. A
cell is named by the variable of its table and its row and column in the grid; scale is what its own number is
multiplied by. Plans of all questions are rows, and every result here is one expression over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = "struct<variable:string,row:bigint,column:bigint,scale:double,year:int,value:double>"
CELLS = f"array<{CELL}>"
PLAN = f"struct<operator:string,cells:{CELLS},divisor:double,factor:int>"

# How the emitted text reads a cell (signs out, percents with a decimal comma), and what it is without evidence.
READ = ".replace('(', '-').replace(')', '').replace('--', '-').replace('%%', '').replace('.', '').replace(',', '.' if '%%' in %1$s else '')"
UNBOUND = "result = 0 * df0.shape[0]"

#: Rows of a cited table that go with its citation.
VIEW_ROWS = 200


def _number(x: Column) -> Column:
    """A whole or decimal number as Python reads it."""
    whole = x == F.floor(x)
    return F.when(whole, F.format_string("%.1f", x)).otherwise(x.cast("string"))


def read_row(row: Column) -> Column:
    """A grid's row where a CSV reader takes the first row as names."""
    return F.greatest(row - 1, F.lit(0))


def cell_text(cell: Column) -> Column:
    """What reads one cell as a number, times its scale."""
    place = F.format_string("str(%s.iloc[%d, %d])", cell["variable"], read_row(cell["row"]), cell["column"])
    number = F.concat(F.lit("float("), place, F.format_string(READ, place), F.lit(")"))
    return F.when(cell["scale"] == 1.0, number).otherwise(F.concat(F.lit("("), number, F.lit(" * "), _number(cell["scale"]), F.lit(")")))


def evaluated(plan: Column) -> Column:
    """The value of a plan at two decimals; null where a denominator is 0 or missing, and for no plan."""
    cells = plan["cells"]
    v = F.transform(cells, lambda c: c["value"])
    first, last, second = F.get(v, F.lit(0)), F.element_at(v, -1), F.get(v, F.lit(1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dated = F.transform(cells, lambda c: F.struct(c["value"].alias("value"), c["year"].alias("year")))
    value = (
        F.when(plan["operator"] == "cell", first)
        .when(plan["operator"] == "growth", F.try_divide(last - first, first) * 100)
        .when(plan["operator"] == "average", total(v) / F.size(v))
        .when(plan["operator"] == "sum", total(v))
        .when(plan["operator"] == "difference", first - total(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))))
        .when(plan["operator"] == "ratio", F.try_divide(first, second) * plan["factor"])
        .when(plan["operator"] == "max", F.array_max(v))
        .when(plan["operator"] == "min", F.array_min(v))
        .when(plan["operator"] == "year of max", F.array_max(dated)["year"].cast("double"))
        .when(plan["operator"] == "year of min", F.array_min(dated)["year"].cast("double"))
    )
    return F.when(F.size(cells) > 0, F.round(value / plan["divisor"], 2))


def text(plan: Column) -> Column:
    """The expression of a plan, rounded like its value; null where that is null."""
    cells = plan["cells"]
    t = F.transform(cells, cell_text)
    first, last = F.get(t, F.lit(0)), F.element_at(t, -1)
    rest = F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    joined = lambda a, sign: F.concat(F.lit("("), F.array_join(a, sign), F.lit(")"))
    divided = lambda c: F.concat(F.lit("("), c, F.lit(" / "), _number(plan["divisor"]), F.lit(")"))
    pairs = F.array_join(F.transform(cells, lambda c: F.concat(F.lit("("), cell_text(c), F.lit(", "), c["year"].cast("string"), F.lit(")"))), ", ")
    minus = F.when(F.size(t) > 1, F.concat(F.lit("("), first, F.lit(" - "), joined(rest, " + "), F.lit(")"))).otherwise(first)
    body = (
        F.when(plan["operator"] == "cell", divided(first))
        .when(plan["operator"] == "growth", F.concat(F.lit("(("), last, F.lit(" - "), first, F.lit(") / "), first, F.lit(" * 100)")))
        .when(plan["operator"] == "average", divided(F.concat(F.lit("("), joined(t, " + "), F.lit(" / "), F.size(t).cast("string"), F.lit(")"))))
        .when(plan["operator"] == "sum", divided(joined(t, " + ")))
        .when(plan["operator"] == "difference", divided(minus))
        .when(plan["operator"] == "ratio", F.concat(F.lit("("), first, F.lit(" / "), F.get(t, F.lit(1)), F.lit(" * "), plan["factor"].cast("string"), F.lit(")")))
        .when(plan["operator"].isin("max", "min"), divided(F.concat(plan["operator"], F.lit("(["), F.array_join(t, ", "), F.lit("])"))))
        .when(plan["operator"].startswith("year of"), F.concat(F.substring(plan["operator"], -3, 3), F.lit("(["), pairs, F.lit("])[1]")))
    )
    return F.when(evaluated(plan).isNotNull(), F.concat(F.lit("round("), body, F.lit(", 2)")))


def emitted(questions: DataFrame, values: DataFrame, score: str = "score") -> DataFrame:
    """(qid, branch, plan, answer, query) of every question.

    Where no branch applies, or it has no value, the bound cell with the highest ``score`` (ties: the lower column, then the
    first place) is planned alone; a question without bound cells only reads a shape, and has no answer.
    questions and values as for planning.plans, with a score for each value.
    """
    from .planning import plans

    # both attempts are planned at once, as questions of their own
    order = F.struct(F.col(score), -F.col("column"), -F.col("place"))
    others = [c for c in values.columns if c != "qid"]
    alone = values.groupBy("qid").agg(F.max_by(F.struct(*others), order).alias("b")).select("qid", "b.*")
    attempt = lambda df, n: df.withColumn("qid", F.struct("qid", F.lit(n).alias("attempt")))
    every = attempt(values, 0).unionByName(attempt(alone, 1))
    asked = questions.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("qid", F.struct("qid", "attempt")).drop("attempt")
    made = plans(asked, every).select("qid.*", "branch", "plan").withColumn("answer", evaluated(F.col("plan")))
    whole = F.struct("attempt", "branch", "plan", "answer")
    best = made.groupBy("qid").agg(F.min_by(whole, F.when(F.col("answer").isNotNull(), F.col("attempt"))).alias("p"))
    branch = F.when(F.col("p.attempt") == 1, F.concat(F.lit("lookup: "), F.col("p.branch"))).otherwise(F.coalesce("p.branch", F.lit("unbound")))
    return best.select("qid", branch.alias("branch"), "p.plan", "p.answer", F.coalesce(F.concat(F.lit("result = "), text(F.col("p.plan"))), F.lit(UNBOUND)).alias("query"))


def cells_read(plans: DataFrame) -> DataFrame:
    """(qid, place, variable, row, column, scale, year, value): the cells that a plan's text reads, once each, by first place from 1."""
    cells = plans.filter("answer IS NOT NULL").select("qid", F.posexplode("plan.cells").alias("place", "cell"))
    once = cells.groupBy("qid", "cell.variable", "cell.row", "cell.column").agg(F.min_by(F.struct("place", "cell"), "place").alias("c"))
    each = once.groupBy("qid").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return each.select("qid", F.posexplode("c").alias("place", "c")).select("qid", (F.col("place") + 1).cast("long").alias("place"), "c.cell.*")


def citations(plans: DataFrame, tables: DataFrame) -> DataFrame:
    """(qid, id, place, variable, report_id, table_id, line, page, row, column, raw_value, row_label, column_label, unit, label, fault) of every cell read.

    tables: qid, variable, report_id, table_id, line, page, unit, grid. row counts as the emitted text does, below the
    names. fault says what is wrong: the table or the cell doesn't exist. A cell in the first grid row is read from the row below.
    """
    j = cells_read(plans).join(tables, ["qid", "variable"], "left")
    at = read_row(F.col("row"))
    line = F.get(F.col("grid"), (at + 1).cast("int"))
    column = F.col("column").cast("int")
    wide, high = F.size(F.get("grid", F.lit(0))), F.size("grid") - 1
    inside = (at < high) & (F.col("column") >= 0) & (F.col("column") < wide)
    fault = F.when(F.col("grid").isNull(), F.concat(F.lit("no table "), "variable"))
    fault = fault.when(~inside, F.format_string("%s.iloc[%d, %d] does not exist; rows 0-%d, columns 0-%d", "variable", at, "column", high - 1, wide - 1))
    return j.select(
        "qid",
        F.concat(F.lit("c"), F.col("place").cast("string")).alias("id"),
        "place",
        "variable",
        "report_id",
        "table_id",
        "line",
        "page",
        at.alias("row"),
        F.col("column"),
        F.get(line, column).alias("raw_value"),
        F.get(line, F.lit(0)).alias("row_label"),
        F.get(F.get("grid", F.lit(0)), column).alias("column_label"),
        "unit",
        F.format_string("%s · row %d · column %d", "report_id", at, "column").alias("label"),
        fault.alias("fault"),
    )


def refused(plans: DataFrame, cited: DataFrame) -> DataFrame:
    """(qid, reason) of answers that can't stand: no cell is read, or one that doesn't exist."""
    none = plans.filter("answer IS NULL").select("qid", F.lit("no cell is read").alias("reason"))
    return none.unionByName(cited.filter("fault IS NOT NULL").groupBy("qid").agg(F.min_by("fault", "place").alias("reason")))


def evidence_views(cited: DataFrame, tables: DataFrame, most: int = VIEW_ROWS) -> DataFrame:
    """Citations with headers, the first ``most`` rows of their table, and whether it has more."""
    shown = tables.select("qid", "variable", F.get("grid", F.lit(0)).alias("headers"), F.slice("grid", 2, most).alias("rows"), (F.size("grid") - 1 > most).alias("truncated"))
    return cited.filter("fault IS NULL").join(shown, ["qid", "variable"])
