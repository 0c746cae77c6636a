"""Entities of questions: tickers, company names, aliases, line items.

Companies come as a registry (ticker, name); up to MOST_COMPANIES rows it is broadcast, beyond that its joins shuffle.
Fuzzy scores need a sequence ratio that Spark lacks; it runs in an Arrow UDF over (question, company) pairs that share
a word, after an equi-join on words.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import content_words, fold_words, says

#: Companies or aliases that are broadcast; more are joined by shuffles.
MOST_COMPANIES = 50_000
#: From this score on a company counts as named; so many of the others are shown.
EXACT, SHORTLIST = 0.98, 8
# Wording that lists tickers, words of periods and of entities, wording of counterparties.
GROUP_CUES = ["ma co phieu", "gom cac cong ty", "nhom"]
PERIOD_WORDS = ["nam", "quy", "thang", "ngay", "ky", "tai", "cuoi", "dau"]
ENTITY_PHRASES = ["cong ty", "ngan hang", "tap doan", "ctcp", "chi nhanh", "quy dau tu"]
COUNTERPARTY = r"(?:phai thu tu|phai tra cho|dau tu vao|ban (?:hang )?(?:cho|voi)|giao dich voi)\s+((?:[a-z0-9]+\s+){0,7})$"


def explicit_tickers(question: Column, folded: Column, known: Column) -> Column:
    """Known tickers that a question spells out."""
    return F.array_distinct(F.filter(spelled_words(question, folded), lambda w: F.array_contains(known, w)))


def spelled_words(question: Column, folded: Column) -> Column:
    """Words of a question that may be tickers: in parentheses, in capitals, or in any case where it lists tickers."""
    bracketed = F.transform(F.regexp_extract_all(question, F.lit(r"\(([A-Za-z0-9]{2,6})\)"), F.lit(1)), F.upper)
    capitals = F.regexp_extract_all(question, F.lit(r"(?<![A-Za-z0-9])([A-Z][A-Z0-9]{1,5})(?![A-Za-z0-9])"), F.lit(1))
    loose = F.transform(F.regexp_extract_all(question, F.lit(r"(?<![A-Za-z0-9])([A-Za-z][A-Za-z0-9]{1,5})(?![A-Za-z0-9])"), F.lit(1)), F.upper)
    listed = folded.rlike("|".join(GROUP_CUES))
    return F.concat(bracketed, capitals, F.when(listed, loose).otherwise(F.array().cast("array<string>")))


def alias_matches(questions: DataFrame, aliases: DataFrame, qid: str, folded: str) -> DataFrame:
    """(qid, ticker): tickers whose alias a question holds as whole words, but not only inside a longer matched alias.

    aliases: alias (folded), ticker. Pairs meet on the alias's first word.
    """
    words = questions.select(qid, folded, F.explode(F.array_distinct(F.split(folded, " "))).alias("w"))
    a = aliases.withColumn("w", F.element_at(F.split("alias", " "), 1))
    held = words.join(F.broadcast(a) if is_small(aliases) else a, "w").filter(F.contains(F.concat(F.lit(" "), folded, F.lit(" ")), F.concat(F.lit(" "), "alias", F.lit(" "))))
    apart = lambda c: F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit("  ")), F.lit(" "))  # noqa: E731  (each word has its own blanks)
    every = held.groupBy(qid, folded).agg(F.collect_set(F.struct("alias", "ticker")).alias("m"))
    one = every.select(qid, folded, "m", F.explode("m").alias("x"))
    longer = F.array_sort(F.filter(F.transform("m", lambda y: y["alias"]), lambda y: F.contains(y, F.col("x.alias")) & (y != F.col("x.alias"))))
    # blank out longer matches, longest first, and look again
    by_length = F.reverse(F.array_sort(F.transform(longer, lambda y: F.struct(F.length(y).alias("n"), y.alias("y")))))
    rest = F.aggregate(by_length, apart(F.col(folded)), lambda t, y: F.replace(t, apart(y["y"]), F.lit(" | ")))
    return one.filter(F.contains(rest, apart(F.col("x.alias")))).select(qid, F.col("x.ticker").alias("ticker")).distinct()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def is_small(companies: DataFrame) -> bool:
    """Whether a registry may be broadcast; beyond that the same joins shuffle."""
    return companies.limit(MOST_COMPANIES + 1).count() <= MOST_COMPANIES


def entity_scores(questions: DataFrame, companies: DataFrame, qid: str, question: str, best: int | None = None) -> DataFrame:
    """(qid, ticker, score, rank): full name 1, own name 0.98, else 0.82 of the shared words and 0.18 of the sequence ratio.

    Ranked by score, then ticker, both falling. Companies that share no word with a question get no row. With ``best``
    only the first so many and those of EXACT or more are kept, which is all that a decision reads: of the companies of
    one name no more than the last ``best`` tickers can be among the first ones, so a name that many share isn't
    spelled out for each question.
    """
    # equal texts and equal names are scored once
    q = questions.select(F.col(question).alias("__t")).distinct().select("__t", fold_words(F.col("__t")).alias("f"), F.array_distinct(content_words(F.col("__t"))).alias("qw"))
    c = companies.select("name").distinct().select("name", fold_words(F.col("name")).alias("full"), content_words(F.col("name")).alias("words")).withColumn("own", F.array_join("words", " "))
    small = is_small(companies)
    hint = F.broadcast if small else lambda x: x
    pairs = q.withColumn("w", F.explode("qw")).join(hint(c.withColumn("w", F.explode(F.array_distinct("words")))), "w").groupBy("__t", "name").agg(*[F.first(x).alias(x) for x in ("f", "qw", "full", "words", "own")])
    shared = F.size(F.array_intersect("qw", "words")) / F.size(F.array_distinct("words"))
    exact = F.when(F.contains("f", F.col("full")), 1.0).when((F.col("own") != "") & F.contains("f", F.col("own")), 0.98)
    scored = pairs.withColumn("exact", exact).withColumn("ratio", sequence_ratio("own", "f")).select("__t", "name", F.coalesce("exact", 0.82 * shared + 0.18 * F.col("ratio")).alias("score"))
    named = companies.select("ticker", "name")
    w = Window.partitionBy("__t").orderBy(F.desc("score"), F.desc("ticker"))
    if best is None:
        held = scored.join(named, "name")
    else:
        last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ticker")))
        few = named.distinct().withColumn("__last", last).filter(F.col("__last") <= best).drop("__last")
        exact = scored.filter(F.col("score") >= EXACT)
        held = scored.join(few, "name").unionByName(exact.join(named, "name"))
    each = held.groupBy("__t", "ticker").agg(F.max("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(w).cast("long"))
    if best is not None:
        ranked = ranked.filter((F.col("rank") <= best) | (F.col("score") >= EXACT))
    return questions.select(qid, F.col(question).alias("__t")).join(ranked, "__t").select(qid, "ticker", "score", "rank")


def decide_entities(scores: DataFrame, qid: str) -> DataFrame:
    """(qid, tickers, confidence, method, shortlist) from ranked scores: exact names, else one clear fuzzy winner, else none."""
    exact = F.array_compact(F.transform("s", lambda x: F.when(x.score >= EXACT, x.ticker)))
    short = F.transform(F.filter(F.slice("s", 1, SHORTLIST), lambda x: x.score >= 0.32), lambda x: x.ticker)
    # all that is read below: the exact names and the first eight
    place = F.row_number().over(Window.partitionBy(qid).orderBy("rank"))
    scores = scores.withColumn("__n", place).filter((F.col("score") >= EXACT) | (F.col("__n") <= SHORTLIST))
    by = scores.groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("rank", "ticker", "score"))).alias("s"))
    best, second = F.element_at("s", 1)["score"], F.coalesce(F.get("s", F.lit(1))["score"], F.lit(0.0))
    clear = (best >= 0.73) & (best - second >= 0.08)
    tickers = F.when(F.size(exact) > 0, exact).when(clear, F.slice(F.transform("s", lambda x: x.ticker), 1, 1)).otherwise(F.array().cast("array<string>"))
    method = F.when(F.size(exact) == 1, "single_official_name").when(F.size(exact) > 1, "union_all_entity_detectors").when(clear, "fuzzy_high_confidence").otherwise("ambiguous")
    return by.select(qid, tickers.alias("tickers"), F.when(F.size(exact) > 0, 0.98).otherwise(best).alias("confidence"), method.alias("method"), short.alias("shortlist"))


def named_items(questions: DataFrame, labels: DataFrame, qid: str, text: str, limit: int = 3) -> DataFrame:
    """(qid, items): the longest lexicon labels that a question holds as whole words, up to ``limit``.

    Labels of period words and numbers only or with an entity's name don't count, nor do those inside a kept one. Questions and
    labels (token texts) meet on a label's first word.
    """
    own = F.filter(F.split("label", " "), lambda w: ~w.isin(PERIOD_WORDS) & ~w.rlike("^[0-9]+$"))
    usable = labels.filter((F.size(own) > 0) & ~F.col("label").rlike("|".join(ENTITY_PHRASES))).withColumn("w", F.element_at(F.split("label", " "), 1))
    words = questions.select(qid, text, F.explode(F.array_distinct(F.split(text, " "))).alias("w"))
    held = words.join(usable, "w").filter(F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), "label", F.lit(" "))))
    found = held.groupBy(qid).agg(F.array_sort(F.collect_set(F.struct((-F.length("label")).alias("n"), "label"))).alias("s"))
    keep = F.aggregate("s", F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) < limit) & ~F.exists(a, lambda k: F.contains(k, x.label)), F.array_append(a, x.label)).otherwise(a))
    return found.select(qid, keep.alias("items"))


def typed_slots(questions: DataFrame, qid: str) -> DataFrame:
    """(qid, ticker, metric, year, role) needed by a question (tickers, metrics, years, operation): ``*`` or null where it names none.

    Growth over one year needs that and the one before; a ratio of two metrics a numerator and a denominator.
    """
    or_star = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit("*")))
    q = questions.withColumn("ticker", F.explode(or_star("tickers"))).select("*", F.posexplode(or_star("metrics")).alias("at", "metric"))
    one = (F.col("operation") == "growth") & (F.size("years") == 1)
    years = F.when(one, F.array(F.get("years", F.lit(0)) - 1, F.get("years", F.lit(0)))).when(F.size("years") > 0, F.col("years")).otherwise(F.array(F.lit(None).cast("int")))
    q = q.select("*", F.posexplode(years).alias("nth", "year"))
    role = F.when(one, F.when(F.col("nth") == 0, "prior").otherwise("current")).when((F.col("operation") == "ratio") & (F.size("metrics") >= 2), F.when(F.col("at") == 0, "numerator").otherwise("denominator")).otherwise("value")
    return q.select(qid, "ticker", "metric", "year", role.alias("role"))


def only_counterparty(content: Column, name: Column) -> Column:
    """Whether each mention of a company's own name (words of ``content``) follows wording that makes it a counterparty."""
    padded, mark = F.concat(F.lit(" "), content, F.lit(" ")), F.concat(F.lit(" "), name, F.lit(" "))
    pieces = F.split(F.replace(padded, mark, F.lit(" \u0001 ")), "\u0001")
    before = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    related = lambda p: p.rlike(COUNTERPARTY) & ~F.contains(F.regexp_extract(p, COUNTERPARTY, 1), F.lit("cua me"))
    return (F.size(before) > 0) & F.forall(before, related)


def fuzzy_winner(scores: DataFrame, qid: str) -> DataFrame:
    """(qid, tickers, confidence, method, shortlist) from ranked scores alone: one clear winner, or none; the best eight of note."""
    some = scores.filter(F.col("rank") <= SHORTLIST).groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("rank", "ticker", "score"))).alias("s"))
    best, second = F.element_at("s", 1), F.coalesce(F.get("s", F.lit(1))["score"], F.lit(0.0))
    clear = (best["score"] >= 0.73) & (best["score"] - second >= 0.08)
    short = F.transform(F.filter("s", lambda x: x.score >= 0.32), lambda x: x.ticker)
    tickers = F.when(clear, F.array(best["ticker"])).otherwise(F.array().cast("array<string>"))
    return some.select(qid, tickers.alias("tickers"), best["score"].alias("confidence"), F.when(clear, "fuzzy_high_confidence").otherwise("ambiguous").alias("method"), short.alias("shortlist"))


def named_companies(q: DataFrame, companies: DataFrame, qid: str) -> DataFrame:
    """(qid, ticker, own): companies whose full folded name (in ``__f``) or own name of three words or more (in ``__c``) stands in a question as whole words.

    An own name inside the own name of another company named so doesn't count, nor does one that is but a counterparty.
    Questions and names meet on a name's first word.
    """
    names = companies.select("ticker", F.array_join(content_words(F.col("name")), " ").alias("own"), fold_words(F.col("name")).alias("full"))
    hint = F.broadcast if is_small(companies) else lambda x: x
    holds = lambda text, name: F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), name, F.lit(" ")))
    met = []
    for text, name in (("__f", "full"), ("__c", "own")):
        words = q.select(qid, "__f", "__c", F.explode(F.array_distinct(F.split(text, " "))).alias("w"))
        usable = names.filter((F.col(name) != "") & (F.lit(name == "full") | (F.size(F.split("own", " ")) >= 3)))
        pairs = words.join(hint(usable.withColumn("w", F.element_at(F.split(name, " "), 1))), "w").filter(holds(F.col(text), F.col(name)) & ~only_counterparty(F.col("__c"), F.col("own")))
        met.append(pairs.select(qid, "ticker", "own"))
    full, own = met
    every = own.groupBy(qid).agg(F.collect_set("own").alias("owns"))
    inside = F.exists("owns", lambda o: (o != F.col("own")) & F.contains(o, F.col("own")))
    return full.unionByName(own.join(every, qid).filter(~inside).select(qid, "ticker", "own")).distinct()


def infer_entities(questions: DataFrame, companies: DataFrame, aliases: DataFrame, qid: str, question: str) -> DataFrame:
    """(qid, tickers, confidence, method, shortlist): spelled-out tickers, official names and aliases, else a clear fuzzy winner, else none.

    Counterparties drop, and so do tickers that are but a word of a company named in full. Tickers come spelled-out ones
    first, in the question's order, then the others by alphabet.
    """
    text = F.col(question)
    q = questions.select(qid, text.alias("__q"), fold_words(text).alias("__f"), F.array_join(content_words(text), " ").alias("__c"))
    tickers = companies.select("ticker").distinct()
    hint = F.broadcast if is_small(companies) else lambda x: x
    # all words that may be tickers meet the known ones by a join
    may = q.select(qid, F.posexplode(spelled_words(F.col("__q"), F.col("__f"))).alias("at", "ticker")).join(hint(tickers), "ticker", "left_semi").groupBy(qid, "ticker").agg(F.min("at").alias("at"))
    names = companies.select("ticker", F.array_join(content_words(F.col("name")), " ").alias("own"))
    named = named_companies(q, companies, qid)
    called = alias_matches(q, aliases, qid, "__f").join(hint(names), "ticker").join(q, qid).filter(~only_counterparty(F.col("__c"), F.col("own"))).select(qid, "ticker", "own")
    exact = named.unionByName(called).distinct()
    words = exact.select(qid, F.col("ticker").alias("owner"), F.explode(F.split("own", " ")).alias("w"))
    word = F.coalesce(F.bool_or((F.lower("ticker") == F.col("w")) & (F.col("ticker") != F.col("owner"))), F.lit(False))
    spelled = may.join(words, [qid], "left").groupBy(qid, "ticker", "at").agg(word.alias("word")).filter(~F.col("word")).select(qid, "ticker", "at")
    found = spelled.unionByName(exact.select(qid, "ticker", F.lit(None).cast("int").alias("at"))).groupBy(qid, "ticker").agg(F.min("at").alias("at"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("at", F.lit(1 << 30)).alias("at"), "ticker")))
    sure = found.groupBy(qid).agg(F.transform(order, lambda x: x.ticker).alias("tickers"), F.count("at").alias("n"), F.count("*").alias("of"))
    method = F.when((F.col("n") > 0) & (F.col("n") == F.col("of")), "explicit_ticker").when(F.col("of") == 1, "single_official_name").otherwise("union_all_entity_detectors")
    sure = sure.select(qid, "tickers", F.when(F.col("n") > 0, 1.0).otherwise(0.98).alias("confidence"), method.alias("method"))
    fuzzy = fuzzy_winner(entity_scores(questions, companies, qid, question, SHORTLIST), qid)
    both = questions.select(qid).join(sure, qid, "left").join(fuzzy.select(qid, *[F.col(c).alias(f"__{c}") for c in ("tickers", "confidence", "method", "shortlist")]), qid, "left")
    none = F.array().cast("array<string>")
    return both.select(
        qid,
        F.coalesce("tickers", "__tickers", none).alias("tickers"),
        F.coalesce("confidence", "__confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("method", "__method", F.lit("ambiguous")).alias("method"),
        F.array_distinct(F.concat(F.coalesce("tickers", none), F.coalesce("__shortlist", none))).alias("shortlist"),
    )


# Wording that makes a question more than a lookup.
SUM_WORDING = ["tong cua", "tong cong cua", "cong voi", "cong lai"]
NOT_LOOKUP = [
    "tang truong", "toc do tang", "tang giam", "chenh lech", "khac biet",
    "hieu", "tru", "cao hon", "thap hon", "lon hon", "trung binh",
    "binh quan", "ty trong", "chiem bao nhieu", "gap", "bao nhieu lan",
    "bien loi nhuan", "lon nhat", "cao nhat", "nhieu nhat", "nho nhat",
    "thap nhat", "it nhat", "nam nao", "cong ty nao", "doanh nghiep nao",
    "trong so", "neu", "vuot", "tren muc", "duoi muc",
]


def is_direct_lookup(operator_text: Column, years: Column) -> Column:
    """Whether a question asks for one figure: at most one year, and no operator wording (line items and report wording removed)."""
    return (F.size(years) <= 1) & ~says(operator_text, *SUM_WORDING, *NOT_LOOKUP)


def is_high_arity(documents: Column, items: Column, years: Column) -> Column:
    """Whether a question needs several cells: two documents, line items or different years."""
    return (F.size(documents) >= 2) | (F.size(items) >= 2) | (F.size(F.array_distinct(years)) >= 2)


def metric_mentions(text: Column, labels: Column) -> Column:
    """The labels that a folded question holds, in its order, the longer first at one place, none inside an earlier one."""
    at = lambda x: F.struct(F.instr(text, x).alias("at"), (-F.length(x)).alias("n"), x.alias("label"))
    usable = F.filter(labels, lambda x: (x != "") & F.contains(text, x) & ~x.isin("tong cong", "tong cong tai san"))
    found = F.array_sort(F.transform(F.array_distinct(usable), at))
    inside = lambda k, x: (k["at"] <= x["at"]) & (x["at"] - x["n"] <= k["at"] - k["n"])
    kept = F.aggregate(found, F.array().cast("array<struct<at:int,n:int,label:string>>"), lambda a, x: F.when(F.exists(a, lambda k: inside(k, x)), a).otherwise(F.array_append(a, x)))
    return F.transform(kept, lambda x: x["label"])


#: Operations of plans.
PLAN_OPERATIONS = frozenset("add argmax argmin change compare divide lookup mean multiply select subtract sum".split())


def plan_problems(facts: list[dict], steps: list[dict], tickers: list[str], years: list[int]) -> list[str]:
    """What is wrong with a plan: facts outside the gate, unknown operations, steps that refer to nothing before them."""
    known, out = set(), []
    for f in facts:
        if f.get("entity") not in tickers or (f.get("period") is not None and f["period"] not in years):
            out.append(f"fact {f.get('id')} is outside the gate")
        known.add(f.get("id"))
    for s in steps:
        if s.get("op") not in PLAN_OPERATIONS:
            out.append(f"step {s.get('id')} has an unknown operation")
        if not s.get("inputs") or any(i not in known for i in s["inputs"]):
            out.append(f"step {s.get('id')} refers to what isn't before it")
        known.add(s.get("id"))
    return out


def salvaged_facts(facts: list[dict], tickers: list[str], years: list[int]) -> list[dict]:
    """The usable facts of a broken plan, renumbered: foreign entities become the gate's first, foreign periods none."""
    kept = [f for f in facts if isinstance(f.get("query"), str) and f["query"].strip()]
    return [{"id": f"f{i}", "query": f["query"].strip(), "entity": f.get("entity") if f.get("entity") in tickers else tickers[0], "period": f.get("period") if f.get("period") in years else None} for i, f in enumerate(kept, 1)]
