"""Arithmetic over bound evidence: which operation a question asks for, and its value.

All questions are planned in one pass: values are grouped by question once into the year spans of table rows and once
into single figures, and one CASE decides. The branches are tried in a fixed order; one whose own conditions fail
falls through to the next. A branch gives a plan: an operator with the cells that it reads. The answer is the plan's
value; its text and citations come from the same cells (``emission``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import asks_for_year, asks_percentage, requested_scale, years
from ..functions.text import folded, says
from .emission import CELLS, PLAN, evaluated

# The operator wording of questions (folded Vietnamese), and report wording that looks like it.
GROWTH = ["tang truong", "toc do tang"]
AVERAGE = ["trung binh", "binh quan"]
SUM = ["tong", "cong", "tong cong"]
DIFFERENCE = ["chenh lech", "hieu", "tru", "cao hon", "thap hon", "lon hon"]
RATIO = ["ty le", "ty trong", "gap", "bien loi nhuan", "tren"]
LARGEST = ["lon nhat", "cao nhat", "nhieu nhat"]
SMALLEST = ["nho nhat", "thap nhat", "it nhat"]
YEAR_SELECTOR = ["nam ma", "tai nam ma", "vao nam ma"]
BOILERPLATE = [
    "cua cong ty me", "cua tong cong ty", "cua ngan hang", "cua cong ty", "cong ty me", "cong ty con", "cong ty co phan", "cong ty tnhh",
    "tong cong ty", "cong ty", "ngan hang thuong mai", "ngan hang tmcp", "ngan hang", "ctcp", "tnhh", "tmcp", "bao cao tai chinh",
    "bao cao rieng", "bao cao hop nhat", "nam tai chinh", "ke toi", "ke tu ngay", "den ngay", "ky ke toan",
]
# Operation families in the order in which they are tried.
HINTS = [
    ("growth", ["tang truong", "toc do tang", "tang giam"]), ("difference", ["chenh lech", "khac biet", "hieu so"]),
    ("ratio", ["ty le", "ty trong", "bien loi nhuan", "bao nhieu lan"]), ("average", AVERAGE), ("sum", ["tong", "cong"]), ("max", LARGEST), ("min", SMALLEST),
]


def operation_hint(question: Column) -> Column:
    """The first operation family whose wording a question holds, else lookup."""
    text = F.concat(F.lit(" "), folded(question), F.lit(" "))
    out = None
    for name, phrases in HINTS:
        found = text.rlike(" (" + "|".join(phrases) + ") ")
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("lookup")


def without_boilerplate(text: Column) -> Column:
    for phrase in sorted(BOILERPLATE, key=lambda p: (-len(p), p)):
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    return text


def operator_text(question: Column, labels: Column) -> Column:
    """The folded question without line-item names (``labels``: folded, longest first) and report wording.

    A question that names several years keeps its line items, whose first word may be the instruction.
    """
    padded = F.concat(F.lit(" "), folded(question), F.lit(" "))
    bare = F.aggregate(labels, padded, lambda t, label: F.replace(t, label, F.lit(" ")))
    return without_boilerplate(F.when(F.size(years(question)) > 1, padded).otherwise(bare))


def metric_match(label: Column, phrase: Column) -> Column:
    """Whether every word of a phrase is a word of the label."""
    wanted = F.filter(F.split(phrase, " "), lambda w: w != "")
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, F.split(label, " "))) == 0)


def _year_groups(values: DataFrame) -> DataFrame:
    """(qid, best, best_complete, best_equal): the largest year span of a table row: of all, of those with every named year, of those with just these."""
    member = F.struct("year", "column", "value", "cell")
    g = values.filter("year IS NOT NULL").groupBy("qid", "variable", "row").agg(F.sort_array(F.collect_list(member)).alias("m"), F.min("place").alias("first"), F.first("named").alias("named"))
    held = F.array_distinct(F.transform("m", lambda x: x.year))
    g = g.withColumn("held", held).filter(F.size("held") > 1)
    complete = (F.size("named") <= 1) | (F.size(F.array_except("named", "held")) == 0)
    equal = (F.size(F.array_except("named", "held")) == 0) & (F.size("held") == F.size("named"))
    size = F.struct(F.size("m"), -F.col("first"))
    pick = lambda c: F.max_by(F.when(c, F.col("m")), F.when(c, size))
    return g.groupBy("qid").agg(pick(F.lit(True)).alias("best"), pick(complete).alias("best_complete"), pick(equal).alias("best_equal"))


def plans(questions: DataFrame, values: DataFrame) -> DataFrame:
    """(qid, branch, plan) for every question; both are null where no branch applies.

    questions: qid, question, labels (folded line items, longest first), metrics (those it mentions, in its order).
    values: qid, place, variable, row, column, value, year (or null), label (folded), and scale if there is one: what
    the cell's own number was multiplied by.
    """
    scale_of = F.col("scale").cast("double") if "scale" in values.columns else F.lit(1.0)
    cell = F.struct("variable", F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), scale_of.alias("scale"), F.col("year").cast("int").alias("year"), F.col("value").cast("double").alias("value"))
    values = values.withColumn("cell", cell)
    text = operator_text(F.col("question"), F.col("labels"))
    plain = folded(F.col("question"))
    q = questions.select("qid", "metrics", text.alias("text"), plain.alias("plain"), years(F.col("question")).alias("named"))
    values = values.join(q.select("qid", "named", "metrics"), "qid")
    single = values.groupBy("qid", "variable", "row").agg(F.min_by(F.struct("place", "row", "value", "year", "label", "cell"), "place").alias("s"), F.first("metrics").alias("metrics"))
    # figures named by a metric come first, in the question's order; each metric takes its first figure
    order = F.array_position(F.transform("metrics", lambda m: metric_match(F.col("s.label"), m)), True)
    single = single.select("qid", "s.*", F.when((order > 0) & (F.size("metrics") > 1), order).otherwise(1_000_000).alias("by"))
    singles = single.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("by", "place", "row", "value", "year", "label", "cell"))).alias("v"))
    singles = singles.withColumn("v", F.sort_array(F.transform("v", lambda x, i: F.struct(F.when((i > 0) & (x.by < 1_000_000) & (F.get(F.col("v"), i - 1)["by"] == x.by), 1_000_000).otherwise(x.by).alias("by"), x.place.alias("place"), x["row"].alias("row"), x.value.alias("value"), x.year.alias("year"), x.label.alias("label"), x.cell.alias("cell")))))
    p = q.join(singles, "qid", "left").join(_year_groups(values), "qid", "left")

    said = lambda words: says(F.col("text"), *words)
    cells = lambda g: F.transform(g, lambda x: x.cell)
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast(CELLS))
    superlative = said(LARGEST) | said(SMALLEST)
    dated = F.filter("v", lambda x: x.year.isNotNull())
    in_named = lambda i: F.filter("v", lambda x: F.array_contains(F.col("named"), x.year) & metric_match(x.label, F.get("metrics", F.lit(i))))
    # of several figures of a year: an exact label, then no segment row, then the earliest row
    score = lambda x, i: F.struct((x.label == F.get("metrics", F.lit(i))).cast("int"), (~x.label.rlike("giua cac bo phan|noi bo")).cast("int"), -x["row"])
    best = lambda a, i: F.array_max(F.transform(a, lambda x: F.struct(score(x, i).alias("s"), x.value.alias("value"), x.year.alias("year"), x.cell.alias("cell"))))
    primary, target = in_named(0), in_named(1)
    per_year = F.transform(F.array_distinct(F.transform(primary, lambda x: x.year)), lambda y: best(F.filter(primary, lambda x: x.year == y), 0))
    contest = F.transform(per_year, lambda b: F.struct(b.value, b.year))
    winner = F.when(said(LARGEST), F.array_max(contest)["year"]).otherwise(F.array_min(contest)["year"])
    chosen = best(F.filter(target, lambda x: x.year == winner), 1)["cell"]
    one_metric = F.transform(primary, lambda x: F.struct(x.value, x.year, x.cell))
    extreme = F.when(said(LARGEST), F.array_max(one_metric)["cell"]).otherwise(F.array_min(one_metric)["cell"])
    many = F.size("named") > 1
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    newest_first = lambda g: F.concat(F.slice(cells(g), F.size(g), 1), F.slice(cells(g), 1, F.size(g) - 1))
    every, span = cells("v"), F.coalesce("best_complete", "best")

    branches = [
        ("growth in a row", said(GROWTH) & has("best_complete"), "growth", cells("best_complete"), True),
        ("average of a row", said(AVERAGE) & has("best"), "average", cells(span), False),
        ("sum of a row", said(SUM) & has("best_equal"), "sum", cells("best_equal"), False),
        ("difference in a row", said(DIFFERENCE) & has("best_complete"), "difference", newest_first("best_complete"), False),
        ("value in the best year", said(YEAR_SELECTOR) & superlative & many & (F.size("metrics") >= 2) & (F.size(per_year) >= 2) & chosen.isNotNull(), "cell", one(chosen), False),
        ("extreme over years", superlative & many & (F.size("metrics") == 1) & ~asks_for_year(F.col("plain")) & (F.size(per_year) >= 2), "cell", one(extreme), False),
        ("which year", asks_for_year(F.col("plain")) & has(dated) & superlative, F.when(said(LARGEST), "year of max").otherwise("year of min"), cells(dated), True),
        ("single", F.size("v") == 1, "cell", every, False),
        ("growth", said(GROWTH) & has("v"), "growth", every, True),
        ("average", said(AVERAGE) & has("v"), "average", every, False),
        ("sum", said(SUM) & has("v"), "sum", every, False),
        ("difference", said(DIFFERENCE) & has("v"), "difference", every, False),
        ("ratio", said(RATIO) & has("v"), "ratio", F.slice(every, 1, 2), True),
        ("max", said(LARGEST) & has("v"), "max", every, False),
        ("min", said(SMALLEST) & has("v"), "min", every, False),
    ]
    name = plan = None
    factor = F.when(asks_percentage(F.col("plain")), 100).otherwise(1)
    for label, condition, operator, read, relative in branches:
        condition = F.coalesce(condition, F.lit(False))
        divisor = F.lit(1.0) if relative else requested_scale(F.col("plain"))
        operator = F.lit(operator) if isinstance(operator, str) else operator
        made = F.struct(operator.alias("operator"), read.alias("cells"), divisor.alias("divisor"), factor.alias("factor")).cast(PLAN)
        name = F.when(condition, label) if name is None else name.when(condition, label)
        plan = F.when(condition, made) if plan is None else plan.when(condition, made)
    return p.select("qid", name.alias("branch"), plan.alias("plan"))


def answer(questions: DataFrame, values: DataFrame) -> DataFrame:
    """(qid, branch, answer) for every question; answer is null where no branch applies or a denominator is 0."""
    return plans(questions, values).select("qid", "branch", evaluated(F.col("plan")).alias("answer"))
