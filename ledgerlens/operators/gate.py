"""The document gate: which reports a question may read, by issuer, year and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold_words, let
from .partitions import spread

# Cue phrases of questions (folded Vietnamese).
SEPARATE_CUES = ["cong ty me", "ngan hang me", "bao cao rieng", "bao cao tai chinh rieng", "bctc rieng", "co so rieng"]
CONSOLIDATED_CUES = ["hop nhat", "bao cao hop nhat"]
PRIOR_YEAR_CUES = [
    "so voi nam truoc", "so voi nam lien truoc", "so voi nam truoc do", "so voi ky so sanh", "tai san binh quan", "von chu so huu binh quan",
    "hang ton kho binh quan", "trung binh hang ton kho", "trung binh tong tai san", "trung binh tai san co dinh", "binh quan tai san co dinh",
    "dau nam den cuoi nam", "dau ky va cuoi ky", "so ngay ton kho", "vong quay tong tai san", "vong quay tai san co dinh", " roe ", " roa ",
    "ty suat sinh loi tren von chu so huu",
]
NEXT_YEAR_CUES = ["vao nam sau nam", "cuoi nam ke tiep", "nam ngay sau nam dau tien", "nam lien sau nam dau tien"]
GROWTH_CUES = ["tang truong", "toc do tang", "sut giam nam"]
AVERAGE_CUES = ["tai san binh quan", "von chu so huu binh quan", "hang ton kho binh quan", "trung binh hang ton kho", "trung binh tong tai san", "trung binh tai san co dinh", "binh quan tai san co dinh"]
COMPARED_CUES = ["so voi nam truoc", "so voi nam lien truoc", "so voi nam truoc do"]
RANGE = r"(?:giai doan(?: tu)?|trong cac nam(?: tai chinh)? tu|qua cac nam tu|tu nam)\s+((?:19|20)\d{2})\s*(?:den|toi)\s*(?:nam\s+)?((?:19|20)\d{2})"
DASH = r"\b((?:19|20)\d{2})\s*[-–—]\s*((?:19|20)\d{2})\b"
LONGEST_RANGE = 15


def _any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def _spans(text: Column, pattern: str) -> Column:
    """All years of ranges that a pattern finds, if not too long."""
    found = lambda t: F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("b"))
    ends = let(text, found)
    low, high = (lambda x: F.least(x.a.cast("int"), x.b.cast("int"))), (lambda x: F.greatest(x.a.cast("int"), x.b.cast("int")))
    return F.flatten(F.transform(F.filter(ends, lambda x: high(x) - low(x) <= LONGEST_RANGE), lambda x: F.sequence(low(x), high(x))))


def question_years(question: Column, folded: Column) -> Column:
    """All years that a question names, singly or by ranges, rising."""
    single = F.transform(F.regexp_extract_all(question, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.concat(single, _spans(folded, RANGE), _spans(question, DASH))))


def with_years(questions: DataFrame, question: str) -> DataFrame:
    """``questions`` with folded and years, which are computed once for all that reads them."""
    read = questions.withColumn("folded", fold_words(F.col(question)))
    return read.withColumn("years", question_years(F.col(question), F.col("folded")))


def scope(folded: Column) -> Column:
    """separate, consolidated (also without cue) or mixed."""

    def kind(text: Column) -> Column:
        separate, consolidated = _any(text, SEPARATE_CUES), _any(text, CONSOLIDATED_CUES)
        return F.when(separate & consolidated, "mixed").when(separate, "separate").otherwise("consolidated")

    return let(folded, kind)


def _places(text: Column, phrases: list[str], kind: str) -> Column:
    """array<struct<at, kind>> of all places where one of the phrases begins."""

    def of(phrase: str) -> Column:
        # the lengths of the text before each occurrence, from the pieces between them
        begin = lambda pieces, i: F.struct(F.length(F.array_join(F.slice(pieces, F.lit(1), i), phrase)).alias("at"), F.lit(kind).alias("kind"))
        begins = lambda pieces: F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: begin(pieces, i))
        none = F.array().cast("array<struct<at:int,kind:string>>")
        return F.when(F.contains(text, F.lit(phrase)), let(F.split(text, phrase, -1), begins)).otherwise(none)

    return F.concat(*map(of, phrases))


def scope_of_years(folded: Column, years: Column) -> Column:
    """map<year, scope>; in mixed questions the nearest cue before a year's first place decides, or else the first cue."""

    def one(text: Column, cues: Column, y: Column) -> Column:
        place = F.instr(text, y.cast("string"))
        place = F.when(place > 0, place - 1).otherwise(F.length(text))
        nearest = let(F.filter(cues, lambda c: c["at"] <= place), lambda before: F.get(before, F.size(before) - 1)["kind"])
        return F.coalesce(nearest, F.get(cues, F.lit(0))["kind"])

    def by_year(text: Column, of: Column) -> Column:
        cues = F.array_sort(F.concat(_places(text, SEPARATE_CUES, "separate"), _places(text, CONSOLIDATED_CUES, "consolidated")))
        mixed = let(cues, lambda held: F.transform(of, lambda y: one(text, held, y)))
        plain = lambda kind: F.when(kind == "mixed", mixed).otherwise(F.transform(of, lambda _: kind))
        return F.map_from_arrays(of, let(scope(text), plain))

    return let(folded, lambda text: let(years, lambda of: by_year(text, of)))


def required_years(folded: Column, years: Column) -> Column:
    """The years of the reports that a question needs: its own, then the year before or after where its wording asks for it."""
    padded = F.concat(F.lit(" "), folded, F.lit(" "))
    return let(padded, lambda text: let(years, lambda named: _required_years(text, named)))


def _required_years(text: Column, years: Column) -> Column:
    prior = _any(text, PRIOR_YEAR_CUES) | ((F.size(years) == 1) & _any(text, GROWTH_CUES))
    # the 130 characters from each mention of an average on
    after = F.regexp_extract_all(text, F.lit(r"(?=(binh quan.{0,121}|trung binh.{0,120}))"), F.lit(1))
    two_years_near = F.exists(after, lambda x: F.size(F.regexp_extract_all(x, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))) >= 2)
    prior = prior & ~(_any(text, AVERAGE_CUES) & two_years_near)
    prior = prior & (~F.contains(text, F.lit("dau nam den cuoi nam")) | (F.size(years) == 1))
    first, second = F.get(years, F.lit(0)), F.get(years, F.lit(1))
    adjacent = (F.size(years) == 2) & (second - first == 1)
    span = F.regexp_like(text, F.concat(F.lit("tu nam "), first, F.lit(" den (?:nam )?"), second))
    prior = prior & ~F.coalesce(adjacent & span & _any(text, COMPARED_CUES), F.lit(False))
    targets = F.transform(F.regexp_extract_all(text, F.lit(r"(?:ty so )?roe (?:tai )?nam ((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    held = (F.size(targets) > 0) & F.forall(targets, lambda y: F.array_contains(years, y - 1))
    prior = prior & ~(_any(text, [" roe ", "ty suat sinh loi tren von chu so huu"]) & held)
    none = F.array().cast("array<int>")
    more = F.concat(years, F.when(prior, F.array(F.array_min(years) - 1)).otherwise(none), F.when(_any(text, NEXT_YEAR_CUES), F.array(F.array_max(years) + 1)).otherwise(none))
    return F.when(F.size(years) == 0, none).otherwise(F.array_distinct(more))


def covering_years(years: Column) -> Column:
    """The fewest report years, newest first, where a report covers its own and the previous year; rising."""
    start = F.array().cast("array<int>")
    newest_first = F.sort_array(F.array_distinct(years), asc=False)
    add = lambda acc, y: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) - 1 <= y), acc).otherwise(F.array_append(acc, y))
    return F.array_sort(F.aggregate(newest_first, start, lambda acc, y: F.when(F.size(acc) == 0, F.array(y)).otherwise(add(acc, y))))


def canonical_scope(c: Column) -> Column:
    """aggregated counts as consolidated."""
    return F.when(c == "aggregated", "consolidated").otherwise(c)


def choose_report(requests: DataFrame, reports: DataFrame, keys: list[str], request_scope: str) -> DataFrame:
    """One report for each request (a row with ``keys`` and its scope), or none.

    The exact scope, else one of unknown scope, never another; then one that isn't aggregated; then the most tables;
    then the smallest id. reports: keys, doc_id, scope, table_count.
    """
    pool = spread(requests, *keys).join(reports, keys)
    exact = F.col("scope") == F.col(request_scope)
    pool = pool.filter(exact | (F.col("scope") == "unknown"))
    w = Window.partitionBy(*requests.columns).orderBy(F.desc(exact.cast("int")), F.contains("doc_id", F.lit("_aggregated")), F.desc(F.coalesce("table_count", F.lit(0))), "doc_id")
    return pool.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def retrieve_docs(questions: DataFrame, reports: DataFrame, qid: str, comparative: bool = False) -> DataFrame:
    """(qid, place, ticker, requested_year, year_source, scope, selected_doc, selected_scope): the decision for each ticker and year.

    questions: qid, tickers, years (named), required (years needed; none: all that reports have), scope, scope_by_year
    (a map). reports: ticker, year, doc_id, scope, table_count. ``comparative``: only the fewest years whose reports
    cover all. A year's own scope goes before the question's, of which mixed counts as consolidated. Places follow
    tickers, then years; a decision without a fitting report has no document. Null arrays count as empty.
    """
    known = sorted(r[0] for r in reports.select("year").distinct().dropna().collect())  # calendar years, so few at any size
    none = F.array().cast("array<int>")
    need = F.coalesce(F.col("required").cast("array<int>"), none)
    need = F.when(F.size(need) > 0, need).otherwise(F.array(*map(F.lit, known)).cast("array<int>"))
    need = covering_years(need) if comparative else need
    asked = questions.withColumn("__need", need).select("*", F.posexplode("tickers").alias("__t", "ticker"))
    asked = asked.select("*", F.posexplode("__need").alias("__y", "year"))
    general = F.when(F.col("scope") == "mixed", "consolidated").otherwise(F.col("scope"))
    source = F.when(F.array_contains(F.coalesce(F.col("years").cast("array<int>"), none), F.col("year")), "explicit").otherwise("derived_dependency")
    place = F.col("__t").cast("long") * F.size("__need") + F.col("__y")
    asked = asked.select(F.col(qid).alias("qid"), place.alias("place"), "ticker", "year", source.alias("year_source"), F.coalesce(F.try_element_at("scope_by_year", F.col("year")), general).alias("want"))
    found = choose_report(asked.select("qid", "place", "ticker", "year", "want"), reports.select("ticker", "year", "doc_id", "scope", "table_count"), ["ticker", "year"], "want")
    found = found.select("qid", "place", F.col("doc_id").alias("selected_doc"), F.col("scope").alias("selected_scope"))
    out = asked.join(found, ["qid", "place"], "left")
    return out.select(F.col("qid").alias(qid), "place", "ticker", F.col("year").alias("requested_year"), "year_source", F.col("want").alias("scope"), "selected_doc", "selected_scope")


def selected_docs(decisions: DataFrame, qid: str) -> DataFrame:
    """(qid, doc_id, place): each decided document once, at its first place."""
    return decisions.dropna(subset=["selected_doc"]).groupBy(qid, F.col("selected_doc").alias("doc_id")).agg(F.min("place").alias("place"))


def fallback(questions: DataFrame, reports: DataFrame, qid: str) -> DataFrame:
    """(qid, report_id, stage, year): the reports of the first rung that has any: ticker + year + scope, ticker + year, ticker, year, all.

    questions: qid, tickers, years (arrays), scope; reports: report_id, ticker, year, scope. The first three rungs are
    decided on the distinct keys of reports, and reports join once, by the keys decided on. On the last two, no report_id
    stands for all reports: of the row's year on the rung of years (a row for each year asked for that has reports), of
    any year on the last; they aren't spelled out for each question.
    """
    q = questions.select(qid, F.array_distinct("tickers").alias("tickers"), F.array_distinct("years").alias("years"), "scope")
    keys = reports.select("ticker", F.col("year").alias("__y"), F.col("scope").alias("__s")).distinct()
    in_year = F.coalesce(F.array_contains("years", F.col("__y")), F.lit(False))
    rung = F.when(in_year & F.coalesce(F.col("__s") == F.col("scope"), F.lit(False)), 1).when(in_year, 2).otherwise(3)
    met = q.withColumn("ticker", F.explode("tickers")).join(keys, "ticker").select(qid, "ticker", "__y", "__s", rung.alias("__n"))
    best = met.groupBy(qid).agg(F.min("__n").alias("__n"))
    decided = met.join(best, [qid, "__n"])
    named = reports.select("report_id", F.col("ticker").alias("__t"), "year", "scope")
    same = (F.col("ticker") == F.col("__t")) & F.col("__y").eqNullSafe(F.col("year")) & F.col("__s").eqNullSafe(F.col("scope"))
    stage = F.element_at(F.array(*map(F.lit, ["ticker_year_scope", "ticker_year", "ticker"])), F.col("__n"))
    none = F.lit(None).cast(reports.schema["report_id"].dataType).alias("report_id")
    no_year = F.lit(None).cast(reports.schema["year"].dataType).alias("year")
    found = decided.join(named, same).select(qid, "report_id", stage.alias("stage"), no_year)
    rest = q.join(best, qid, "left_anti")
    dated = rest.select(qid, F.explode("years").alias("year")).join(reports.select("year").distinct(), "year").select(qid, none, F.lit("year").alias("stage"), "year")
    last = rest.join(dated.select(qid).distinct(), qid, "left_anti").select(qid, none, F.lit("all").alias("stage"), no_year)
    return found.unionByName(dated).unionByName(last)


def fallback_members(found: DataFrame, reports: DataFrame, qid: str) -> DataFrame:
    """(qid, report_id, stage, year) without a qid: each report that a row of ``fallback`` without a report_id stands for, once.

    With both, every report of every question is told: a question's row on the rung of years meets the members of its year, one
    on the last rung all of that rung.
    """
    stood = found.filter("report_id IS NULL")
    none = F.lit(None).cast(found.schema[qid].dataType).alias(qid)
    years = stood.filter("stage = 'year'").select("year").distinct()
    dated = reports.join(years, "year", "left_semi").select(none, "report_id", F.lit("year").alias("stage"), "year")
    last = stood.filter("stage = 'all'").select("stage").distinct()
    whole = reports.select("report_id").crossJoin(F.broadcast(last))
    return dated.unionByName(whole.select(none, "report_id", "stage", F.lit(None).cast(reports.schema["year"].dataType).alias("year")))


def explicit_reports(asked: DataFrame, reports: DataFrame, qid: str, ids: str) -> DataFrame:
    """(qid, report_id, place): the named reports that exist, in the order given."""
    named = asked.select(qid, F.posexplode(ids).alias("place", "report_id"))
    return named.join(reports.select("report_id").distinct(), "report_id").select(qid, "report_id", F.col("place").cast("long").alias("place"))


