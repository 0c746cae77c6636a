"""JSON inside other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a scan looks at: an escaped backslash, or a quote or brace with the backslash before it.
MARKS = r'\\\\|\\?["{}]'


def first_json_object(text: Column) -> Column:
    """The first balanced {...} of a text that is valid JSON, as a string; null without one.

    A scan begins at each opening brace in turn, outside of strings; braces inside strings don't count, and inside them a
    backslash escapes the next sign. The text is cut at its quotes, braces and escaped backslashes, and the scan folds
    over these marks only; once an object is found, no further scan runs. An object with a key twice isn't valid.
    """
    marks, pieces = F.regexp_extract_all(text, F.lit(MARKS), F.lit(0)), F.split(text, MARKS, -1)
    held = F.struct(marks.alias("m"), pieces.alias("p"))
    state = lambda depth, inside, end: F.struct(depth.alias("depth"), inside.alias("inside"), end.alias("end"))
    none = F.lit(-1)

    def scan(m: Column, p: Column, start: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            mark = F.get(m, i)
            sign, escaped = F.right(mark, F.lit(1)), F.length(mark) == 2
            # outside of strings a backslash means nothing, two of them neither
            quote = (sign == '"') & ~(s["inside"] & escaped)
            depth = s["depth"] + F.when(s["inside"], 0).when(sign == "{", 1).when(sign == "}", -1).otherwise(0)
            return F.when(s["end"] >= 0, s).otherwise(state(depth, F.when(quote, ~s["inside"]).otherwise(s["inside"]), F.when((depth == 0) & ~s["inside"], i).otherwise(none)))

        at = F.aggregate(F.sequence(start, F.size(m) - 1), state(F.lit(0), F.lit(False), none), step)["end"]
        between = F.transform(F.sequence(start + 1, at), lambda i: F.concat(F.get(p, i), F.get(m, i)))
        return F.when(at > start, F.concat(F.lit("{"), F.array_join(between, "")))

    def first(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x["m"]) - 1), lambda i: F.right(F.get(x["m"], i), F.lit(1)) == "{")

        def attempt(found: Column, start: Column) -> Column:
            return F.when(found.isNotNull(), found).otherwise(F.get(F.filter(F.array(scan(x["m"], x["p"], start)), lambda o: F.try_parse_json(o).isNotNull()), F.lit(0)))

        return F.when(F.size(x["m"]) > 0, F.aggregate(starts, F.lit(None).cast("string"), attempt))

    return F.get(F.transform(F.array(held), first), F.lit(0))
