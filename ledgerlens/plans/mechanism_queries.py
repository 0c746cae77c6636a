"""Packed batches, JSON in noisy text, checks of plans, and prompts within a budget, over documents and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.json_text import first_json_object
from ..operators import manifests, packing, plan_checks, prompting
from ..operators.partitions import spread
from .lexical_queries import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, least(1024, length(text) // 4 + 1) AS width, row_number() OVER (ORDER BY least(1024, length(text) // 4 + 1), doc_id % 8, doc_id) AS i FROM documents),
w AS (SELECT 0::BIGINT AS i, -1::BIGINT AS doc_id, 0::BIGINT AS width, 0::BIGINT AS n, 0::BIGINT AS batch
UNION ALL SELECT d.i, d.doc_id, d.width, CASE WHEN w.n > 0 AND (d.width * (w.n + 1) > 8192 OR w.n >= 16) THEN 1 ELSE w.n + 1 END, CASE WHEN w.n > 0 AND (d.width * (w.n + 1) > 8192 OR w.n >= 16) THEN w.batch + 1 ELSE w.batch END FROM w JOIN d ON d.i = w.i + 1)
SELECT doc_id, width, batch FROM w WHERE i > 0""")
def length_packed_batches(spark, d):
    """Batches of all documents by a width of about their tokens; the twin walks from row to row."""
    docs = table(spark, d, "documents").select("doc_id", F.least(F.lit(1024), F.floor(F.length("text") / 4) + 1).cast("long").alias("width"))
    return packing.packed(docs, "width", "doc_id", F.col("doc_id") % 8)


@query("SELECT doc_id, md5(text) AS digest, length(text)::BIGINT AS n FROM documents")
def json_in_noise(spark, d):
    """Every document's text as a nested JSON string inside an unclosed brace and its own first signs, found and parsed again."""
    own = F.to_json(F.struct("doc_id", F.struct("text").alias("inner")))
    noisy = F.concat(F.lit('Plan {"a": {'), F.left("text", F.lit(40)), F.lit(' \\" '), own, F.lit("} } {}"))
    found = table(spark, d, "documents").select(first_json_object(noisy).alias("o"))
    back = found.select(F.from_json("o", "doc_id BIGINT, inner STRUCT<text: STRING>").alias("o"))
    return back.select("o.doc_id", F.md5("o.inner.text").alias("digest"), F.length("o.inner.text").cast("long").alias("n"))


OPERATIONS = ["sum", "add", "mean", "select", "divide", "lookup", "change", "argmax", "multiply", "power", "Sum"]


def plans(spark, d):
    """A plan for each order: a fact and a step for each line item; steps take their own fact and another step, if there is one."""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").cast("long").alias("place"), "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")
    ident = lambda kind, n: F.concat(F.lit(kind), n.cast("string"))
    number = F.col("place")
    facts = line.select("plan", ident("f", number).alias("id"), "place", ident("S", F.col("l_suppkey") % 5).alias("entity"), F.year("l_shipdate").alias("period"), F.when(F.col("l_returnflag") != "R", F.lit(" doanh thu ")).alias("query"))
    op = F.element_at(F.array(*map(F.lit, OPERATIONS)), (F.col("l_partkey") % len(OPERATIONS) + 1).cast("int"))
    steps = line.select("plan", ident("s", number).alias("id"), "place", op.alias("op"))
    other = F.col("l_partkey") % 8
    refs = F.array_compact(F.array(F.when(F.col("l_suppkey") % 7 != 0, ident("f", number)), F.when(other > 0, ident("s", other))))
    inputs = line.select("plan", ident("s", number).alias("step"), F.explode(refs).alias("ref"))
    o = table(spark, d, "orders")
    year = F.year("o_orderdate")
    gates = o.select(F.col("o_orderkey").alias("plan"), F.array(F.lit("s1"), F.lit("S2"), F.lit("S3")).alias("tickers"), F.array(year, year + 1).alias("years"))
    return facts, steps, inputs, gates


_PLANS = f"""l AS MATERIALIZED (SELECT l_orderkey AS plan, l_linenumber::BIGINT AS place, 'f' || l_linenumber AS f, 's' || l_linenumber AS s, l_partkey % 8 AS other, l_suppkey, year(l_shipdate) AS period, ({OPERATIONS})[l_partkey % {len(OPERATIONS)} + 1] AS op, l_returnflag FROM lineitem),
g AS (SELECT o_orderkey AS plan, year(o_orderdate) AS y FROM orders),
ids AS (SELECT plan, f AS id, -1::BIGINT AS place FROM l UNION ALL SELECT plan, s, place FROM l),
inputs AS MATERIALIZED (SELECT plan, s AS step, f AS ref, place FROM l WHERE l_suppkey % 7 <> 0 UNION ALL SELECT plan, s, 's' || other, place FROM l WHERE other > 0),
known AS MATERIALIZED (SELECT DISTINCT i.plan, i.step, i.ref FROM inputs AS i JOIN ids ON ids.plan = i.plan AND ids.id = i.ref),
reach AS (SELECT plan, step AS a, ref AS b FROM known UNION SELECT r.plan, r.a, k.ref FROM reach AS r JOIN known AS k ON k.plan = r.plan AND k.step = r.b),
looped AS (SELECT DISTINCT plan, a FROM reach WHERE a = b),
last AS (SELECT plan, arg_max(s, place) AS s FROM l GROUP BY plan),
used AS (SELECT plan, s AS id FROM last UNION SELECT r.plan, r.b FROM reach AS r JOIN last ON last.plan = r.plan AND last.s = r.a)"""


@query(f"""WITH RECURSIVE {_PLANS}, v AS (SELECT plan, NULL AS id, 'no facts' AS problem FROM g WHERE plan NOT IN (SELECT plan FROM l)
UNION ALL SELECT plan, f, 'unapproved entity' FROM l WHERE l_suppkey % 5 NOT IN (1, 2, 3)
UNION ALL SELECT plan, f, 'unapproved period' FROM l JOIN g USING (plan) WHERE period NOT IN (y, y + 1)
UNION ALL SELECT plan, s, 'unknown operation' FROM l WHERE op IN ('power', 'Sum')
UNION ALL SELECT plan, id, 'repeated id' FROM ids GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT plan, s, 'no inputs' FROM l WHERE NOT EXISTS (FROM inputs AS i WHERE i.plan = l.plan AND i.step = l.s)
UNION ALL SELECT i.plan, i.step, 'unknown or future input' FROM inputs AS i LEFT JOIN (SELECT plan, id, min(place) AS p FROM ids GROUP BY ALL) AS k ON k.plan = i.plan AND k.id = i.ref WHERE p IS NULL OR p >= i.place
UNION ALL SELECT plan, a, 'rests on a cycle' FROM looped
UNION ALL SELECT r.plan, r.a, 'rests on a cycle' FROM reach AS r JOIN looped AS c ON c.plan = r.plan AND c.a = r.b
UNION ALL SELECT plan, id, 'not used' FROM ids ANTI JOIN used USING (plan, id))
SELECT DISTINCT plan, id, problem FROM v""")
def plan_violations(spark, d):
    """What is wrong with the plans of all orders."""
    return plan_checks.violations(*plans(spark, d))


@query("""WITH l AS (SELECT l_orderkey AS plan, l_linenumber, l_suppkey % 5 AS k, year(l_shipdate) AS period, l_returnflag FROM lineitem), g AS (SELECT o_orderkey AS plan, year(o_orderdate) AS y FROM orders)
SELECT plan, 'f' || row_number() OVER (PARTITION BY plan ORDER BY l_linenumber, k, period NULLS FIRST) AS id, CASE WHEN k IN (2, 3) THEN 'S' || k ELSE 's1' END AS entity, CASE WHEN period IN (y, y + 1) THEN period END::INTEGER AS period, 'doanh thu' AS query FROM l JOIN g USING (plan) WHERE l_returnflag <> 'R'""")
def salvaged_facts(spark, d):
    """The facts that can still be used."""
    facts, _, _, gates = plans(spark, d)
    return plan_checks.salvaged(facts, gates)


_ROW = "sha256(concat_ws(',', {}))"


def _digest_sql(columns: list[str], by: str, rows: str) -> str:
    """A twin of manifests.digest."""
    row = _ROW.format(", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns))
    sums = ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT::HUGEINT) AS s{i}" for i in range(4))
    return f"SELECT {by}, n AS rows, sha256(concat_ws(':', n::VARCHAR, s0::VARCHAR, s1::VARCHAR, s2::VARCHAR, s3::VARCHAR)) AS digest FROM (SELECT {by}, count(*) AS n, {sums} FROM (SELECT {by}, {row} AS h FROM {rows}) GROUP BY {by})"


@query(_digest_sql(["doc_id", "text", "lang", "n_chars"], "source", "documents"))
def table_digests(spark, d):
    """Digests of the documents of each source."""
    return manifests.digest(table(spark, d, "documents"), ["doc_id", "text", "lang", "n_chars"], ["source"])


@query("""WITH l AS (SELECT l_linenumber AS shard, count(*) FILTER (l_orderkey % 500 = 3) AS odd FROM lineitem GROUP BY 1)
SELECT shard, unnest(list_filter([CASE WHEN shard = 2 THEN 'other pairs' END, CASE WHEN shard > 1 AND odd > 0 THEN 'other scores' END, CASE WHEN shard % 3 = 0 THEN 'other scorer' END], lambda x: x IS NOT NULL)) AS problem FROM l
UNION ALL SELECT 99, 'no scores'""")
def manifest_problems(spark, d):
    """Scores of line items in a shard for each line number, some of which changed after their manifests were made."""
    line = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("shard"), F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("score"))
    pairs = line.select("qid", "item")
    made = manifests.digest(line, by=["shard"]).select("shard", F.col("digest").alias("scores_digest"))
    made = made.join(F.broadcast(manifests.digest(pairs).select(F.col("digest").alias("__p"))))
    made = made.select("shard", F.when(F.col("shard") == 2, "?").otherwise(F.col("__p")).alias("pairs_digest"), "scores_digest", F.when(F.col("shard") % 3 == 0, "b").otherwise("a").alias("scorer"))
    lost = made.filter("shard = 1").withColumn("shard", F.lit(99).cast("long"))
    changed = line.withColumn("score", F.expr("if(shard > 1 and qid % 500 = 3, score + 1, score)"))
    return manifests.problems(pairs, changed, made.unionByName(lost))


PROMPT_CHARS = 6000
_LIMITS = prompting.limits()
_SIZE = "sum(length(header) + coalesce(list_sum(list_transform(lines[1:{k}], lambda x: length(x) + 1)), 0)) + 2 * (count(*) - 1)"
_MASK = "CASE WHEN regexp_full_match(trim({c}), '(19|20)[0-9]{{2}}') THEN {c} ELSE regexp_replace({c}, '[0-9][0-9.,]*', '<NUM>', 'g') END"


def _question(qid):
    return F.concat(F.lit("Returned parts of supplier "), qid.cast("string"), F.repeat(F.lit("?"), (qid * 397 % 5900).cast("int")))


def _evidence(spark, d):
    """A request for each supplier, whose tables are the line items of a year."""
    line = table(spark, d, "lineitem")
    year = F.year("l_shipdate")
    whole = lambda c: F.col(c).cast("long").cast("string")
    state = F.when(F.col("l_returnflag") == "R", "Returned").when(F.col("l_returnflag") == "A", "Accepted").otherwise("None")
    cells = F.array(F.concat_ws(" ", F.lit("Part"), whole("l_partkey"), state), whole("l_quantity"), whole("l_extendedprice"), year.cast("string"))
    row = F.struct("l_orderkey", "l_linenumber", cells.alias("cells"))
    # rows meet their grid as they are read, in tasks of bounded size; cells are written there
    line = spread(line.select(F.col("l_suppkey").alias("qid"), year.cast("long").alias("place"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"), "qid", "place")
    grids = line.groupBy("qid", "place").agg(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["cells"]).alias("grid"))
    asked = F.array(F.lit("returned"), (F.col("qid") % 40 + 10).cast("string"))
    columns = F.array(F.lit("Line"), F.lit("Quantity"), F.lit("Price"), F.lit("Year"))
    return grids.select("qid", "place", F.concat(F.lit("df"), F.col("place").cast("string")).alias("variable"), F.concat(F.lit("Shipped in "), F.col("place").cast("string")).alias("title"), columns.alias("columns"), "grid", asked.alias("asked"))


@query(f"""WITH r AS (SELECT l_suppkey AS qid, year(l_shipdate)::BIGINT AS place, row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate) ORDER BY l_orderkey, l_linenumber, l_partkey::VARCHAR, CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' ELSE 'None' END, trunc(l_quantity)::BIGINT::VARCHAR, trunc(l_extendedprice)::BIGINT::VARCHAR) - 1 AS i,
['Part ' || l_partkey || ' ' || CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' ELSE 'None' END, trunc(l_quantity)::BIGINT::VARCHAR, trunc(l_extendedprice)::BIGINT::VARCHAR, year(l_shipdate)::VARCHAR] AS cells FROM lineitem),
h AS (SELECT *, len(list_intersect(['returned', (qid % 40 + 10)::VARCHAR], regexp_extract_all(lower(array_to_string(cells, ' ')), '[a-z0-9%]{{2,}}'))) AS hits, max(i) OVER (PARTITION BY qid, place) AS top FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, place ORDER BY hits DESC, i DESC) AS n FROM h),
seeds AS (SELECT qid, place, top, i, n AS spot FROM k WHERE n <= 10 UNION ALL SELECT qid, place, top, i, 11 + i FROM k WHERE i < 3),
near AS (SELECT qid, place, i + o AS i, min(spot * 3 + o) AS spot FROM seeds, (SELECT unnest([-1, 0, 1]) AS o) WHERE i + o BETWEEN 0 AND top GROUP BY ALL),
shown AS (SELECT qid, place, i FROM near QUALIFY row_number() OVER (PARTITION BY qid, place ORDER BY spot) <= 14),
t AS (SELECT qid, place, 'TABLE df' || place || ' | Shipped in ' || place || chr(10) || 'COLUMNS 0:Line | 1:Quantity | 2:Price | 3:Year' AS header,
list('ROW ' || i || ' | ' || array_to_string(list_transform(cells, lambda c, j: (j - 1) || ':' || {_MASK.format(c="c")}), ' | ') ORDER BY i) AS lines, list(i ORDER BY i) AS rows FROM shown JOIN r USING (qid, place, i) GROUP BY qid, place),
q AS (SELECT *, 'Returned parts of supplier ' || qid || repeat('?', (qid * 397 % 5900)::INT) AS question FROM t),
g AS (SELECT qid, any_value({PROMPT_CHARS} - length(question)) AS budget, {", ".join(_SIZE.format(k=k) + f" AS s{k}" for k in _LIMITS)} FROM q GROUP BY qid),
c AS (SELECT qid, budget, CASE {" ".join(f"WHEN s{k} <= budget THEN {k}" for k in _LIMITS)} ELSE {_LIMITS[-1]} END AS row_limit FROM g),
x AS (SELECT qid, any_value(question) AS question, any_value(budget) AS budget, any_value(row_limit) AS row_limit, sum(len(rows[1:row_limit])) AS n_rows, string_agg(array_to_string([header] || lines[1:row_limit], chr(10)), chr(10) || chr(10) ORDER BY place) AS context FROM q JOIN c USING (qid) GROUP BY qid)
SELECT qid, row_limit, n_rows::BIGINT AS n_rows, length(context)::BIGINT AS n_chars, length(context) <= budget AS fits, md5(context) AS digest, CASE WHEN length(context) <= budget THEN sha256(question || context) END AS prompt_sha256 FROM x""")
def budgeted_prompts(spark, d):
    """Prompts of all suppliers over their line items; questions of different lengths leave different room."""
    question = _question(F.col("qid"))
    made = prompting.contexts(_evidence(spark, d), "qid", prompting.room(PROMPT_CHARS, question))
    rows = F.aggregate("visible", F.lit(0).cast("long"), lambda s, v: s + F.size(v["rows"]))
    out = prompting.with_prompt(made, question, F.lit(""))
    return out.select("qid", "row_limit", rows.alias("n_rows"), F.col("n_chars").cast("long").alias("n_chars"), "fits", F.md5("context").alias("digest"), "prompt_sha256")
