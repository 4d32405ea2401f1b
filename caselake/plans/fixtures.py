"""Queries of folds, calendars, records and register answers; inputs are written from columns of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import masking as K
from ..functions import text as X
from ..operators import analytics as A
from ..operators import cleaning as L
from ..operators import compare as C
from ..operators import gazetteer as P
from ..operators import matching as M
from ..operators import records as R
from ..operators import register as G
from ..session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _sql(rows: list[tuple]) -> str:
    def cell(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


#: Documents of which some letters are written as Arabic ones that fold, with marks, signs of length and digits of either system.
_SPELLED = "translate(text, 'abcdghnot', 'أإآٱةؤئ١ـ') || ' مُؤَسَّسَةٌ ۖ ١٢٣٬٤٥٦٫٧٨ ' || CAST(doc_id AS VARCHAR(20))"


@query(f"""SELECT doc_id AS id, replace(replace(lower(trim(regexp_replace(translate(regexp_replace({_SPELLED}, '[\u064B-\u065F\u0670\u06D6-\u06ED\u0640]', '', 'g'),
 'أإآٱةؤئ٠١٢٣٤٥٦٧٨٩٫٬', 'ااااهوي0123456789.,'), '[\\s\u00a0\u0085\u2000-\u200a\u3000]+', ' ', 'g'), ' ')), 'ς', 'σ'), 'ß', 'ss') AS folded FROM documents""")
def arabic_fold(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.fold(F.expr(_SPELLED)).alias("folded"))


_JDN = "datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588"


@query(f"""WITH j AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, {_JDN} AS jdn FROM orders),
 y AS (SELECT *, CAST(floor((30 * (jdn - 1948440) + 10646) / 10631) AS BIGINT) AS y FROM j), s AS (SELECT *, jdn - (354 * (y - 1) + (3 + 11 * y) // 30 + 1948439) AS n FROM y),
 m AS (SELECT *, (SELECT max(k) FROM range(1, 13) t(k) WHERE n > 30 * (k // 2) + 29 * ((k - 1) // 2)) AS m FROM s)
 SELECT id, CAST(y AS INT) AS y, CAST(m AS INT) AS m, CAST(n - 30 * (m // 2) - 29 * ((m - 1) // 2) AS INT) AS d, day FROM m""")
def hijri_round_trip(spark, sf):
    """Dates of the orders in the tabular calendar (months of 30 and 29 days in turn), and back."""
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), D.date_to_hijri(F.to_date("o_orderdate")).alias("h"))
    return t.select("id", "h.*", D.hijri_to_date(F.col("h.y"), F.col("h.m"), F.col("h.d")).alias("day"))


#: A date of each order with its numbers in several orders, and numbers that are no date.
_DATED = """CASE o_orderkey % 8 WHEN 0 THEN year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) WHEN 1 THEN day(o_orderdate) || '-' || month(o_orderdate) || '-' || year(o_orderdate)
 WHEN 2 THEN day(o_orderdate) || '/' || month(o_orderdate) || '/' || (o_orderkey % 100) WHEN 3 THEN (1400 + o_custkey % 200) || '/' || (1 + o_custkey % 14) || '/' || (1 + o_orderkey % 32) WHEN 4 THEN (1 + o_orderkey % 32) || '.' || (1 + o_custkey % 13) || '.' || (1300 + o_custkey % 300)
 WHEN 5 THEN '2024/' || (1 + o_custkey % 14) || '/' || (1 + o_orderkey % 32) WHEN 6 THEN (1600 + o_custkey % 700) || '-1-1' ELSE (1 + o_orderkey % 32) || '.2.' || (1896 + o_custkey % 300) END"""


@query(f"""WITH t AS (SELECT o_orderkey AS id, {_DATED} AS s FROM orders), p AS (SELECT id, list_transform(regexp_split_to_array(s, '[-/.]'), lambda x: CAST(x AS INT)) AS p, length(regexp_extract(s, '^[0-9]+')) >= 3 AS first, length(regexp_extract(s, '[0-9]+$')) >= 3 AS last FROM t),
 q AS (SELECT id, CASE WHEN first THEN p[1] WHEN last THEN p[3] END AS y, p[2] AS m, CASE WHEN first THEN p[3] ELSE p[1] END AS d FROM p),
 v AS (SELECT *, CASE WHEN y BETWEEN 1200 AND 1499 THEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 30
 WHEN y BETWEEN 1900 AND 2199 THEN try_cast(y || '-' || m || '-' || d AS DATE) IS NOT NULL ELSE false END AS ok FROM q)
 SELECT id, CASE WHEN ok THEN y END AS y, CASE WHEN ok THEN m END AS m, CASE WHEN ok THEN d END AS d FROM v""")
def numeric_dates(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), D.parse_numeric_date(F.expr(_DATED)).alias("p")).select("id", "p.y", "p.m", "p.d")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS doc, l_returnflag AS label, l_partkey % 300 AS a, l_partkey % 300 + 10 AS b FROM lineitem WHERE l_linenumber % 2 = 1), d AS (SELECT l_orderkey AS doc, l_suppkey * 7 % 400 AS s, strftime(l_shipdate, '%Y/%m/%d') AS date_text FROM lineitem WHERE l_linenumber % 2 = 0)
 SELECT doc, label, a AS start, date_text FROM (SELECT l.doc, label, a, date_text, row_number() OVER (PARTITION BY l.doc, label, a ORDER BY s, date_text) AS rn FROM l JOIN d ON l.doc = d.doc AND d.s BETWEEN b AND b + 90) WHERE rn = 1""")
def nearest_label_date(spark, sf):
    """Labels at odd lines of an order, each with the first date that follows it within reach at an even one."""
    t, at = table(spark, sf, "lineitem"), F.col("l_partkey") % 300
    labels = t.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("label"), at.alias("start"), (at + 10).alias("end"), F.lit(1).alias("rank"))
    dates = t.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") * 7 % 400).alias("start"), F.date_format("l_shipdate", "yyyy/MM/dd").alias("date_text"))
    return M.label_dates(labels, dates, "doc").select("doc", "label", "start", "date_text")


@query("""WITH c AS (SELECT l_orderkey AS doc, l_partkey % 500 AS s, l_returnflag || l_linenumber AS value FROM lineitem), a AS (SELECT o_orderkey AS doc, o_custkey % 500 AS p FROM orders), k AS (SELECT c.doc, s, value, abs(s - p) + CASE WHEN s < p THEN 1000000 ELSE 0 END AS cost FROM c JOIN a USING (doc))
 SELECT doc, value, cost FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY cost, s, value) AS rn FROM k) WHERE rn = 1""")
def nearest_anchor(spark, sf):
    """Of an order's lines as spans, the one nearest to the order's anchor."""
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 500).alias("start"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("value"))
    anchors = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 500).alias("pos"))
    return M.nearest_anchor(c, anchors, "doc").select("doc", "value", "cost")


PLACES = [P.Place("الرياض", "riyadh"), P.Place("الخرج", "riyadh", city=False), P.Place("جدة", "makkah"), P.Place("مكة المكرمة", "makkah"), P.Place("العليا", "riyadh", city=False), P.Place("Jeddah", "makkah"), P.Place("Wadi Al-Dawasir", "riyadh", city=False)]
#: How each is written in a text, with a particle or another article, its size without them, and its city flag.
_WRITTEN = (("بالرياض", 6, True), ("للخرج", 5, False), ("وجدة", 3, True), ("مكة المكرمة", 11, True), ("العليا", 6, False), ("jeddah", 6, True), ("wadi dawasir", 12, False))
_PLANTED = "left(text, CAST(doc_id * 31 % 2000 AS INT)) || ' حفرة في ' || {0} || ' ثم ' || substr(text, CAST(doc_id * 31 % 2000 + 1 AS INT)) || ' in ' || {1} || '.'"


@query("WITH w(i, said, size, city, place, region) AS (VALUES " + ", ".join(f"({i}, '{w}', {n}, {str(c).lower()}, '{PLACES[i].name}', '{PLACES[i].area}')" for i, (w, n, c) in enumerate(_WRITTEN))
 + """), d AS (SELECT doc_id AS id, doc_id % 7 AS i, doc_id // 7 % 7 AS j FROM documents), k AS (SELECT id, i AS at, 0 AS late FROM d UNION ALL SELECT id, j, 1 FROM d), r AS (SELECT id, place, region, row_number() OVER (PARTITION BY id ORDER BY city DESC, size DESC, late) AS rn FROM k JOIN w ON w.i = k.at)
 SELECT id, place, region FROM r WHERE rn = 1""")
def place_lookup(spark, sf):
    """Two places written into each document, one at a place that varies and one at its end: the city wins, then the longer name, then the earlier."""
    said = F.array(*(F.lit(w) for w, *_ in _WRITTEN))
    d = table(spark, sf, "documents").withColumns({"first": F.get(said, (F.col("doc_id") % 7).cast("int")), "second": F.get(said, (F.floor(F.col("doc_id") / 7) % 7).cast("int"))})
    found = d.select(F.col("doc_id").alias("id"), P.place_of(F.expr(_PLANTED.format("first", "second")), PLACES).alias("p"))
    return found.select("id", F.col("p.name").alias("place"), F.col("p.area").alias("region"))


#: Parts as entries of a dictionary: the last word of a name is its canonical key.
_ENTRIES = "SELECT p_name || p_size % 3 AS exact, p_name AS canonical, CAST(p_partkey % 800 AS INT) AS page, upper(p_name) || p_size % 4 AS raw, CASE p_size % 9 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'odd' END AS gender, p_type AS meaning, p_retailprice AS confidence FROM part"


@query(f"""WITH e AS ({_ENTRIES}), v AS (SELECT canonical, max(n) > 1 AS veto FROM (SELECT canonical, page, count(DISTINCT exact) AS n FROM e GROUP BY 1, 2) GROUP BY 1), k AS (SELECT *, CASE WHEN veto THEN exact ELSE canonical END AS key FROM e JOIN v USING (canonical))
 SELECT key, arg_max(raw, (confidence, raw)) AS name, string_agg(DISTINCT raw, '|' ORDER BY raw) AS variants, string_agg(DISTINCT meaning, '|' ORDER BY meaning) AS meanings,
 CASE count(DISTINCT gender) FILTER (gender <> 'odd') WHEN 0 THEN 'unknown' WHEN 1 THEN min(gender) FILTER (gender <> 'odd') ELSE 'unisex' END AS gender, count(*) AS n FROM k GROUP BY 1""")
def dictionary_merge(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return R.merge_names(spark.sql(_ENTRIES))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS way FROM orders), v AS (SELECT CASE WHEN way = 5 THEN 'missing' WHEN way = 4 THEN 'mismatch' ELSE 'match' END AS verdict FROM o)
 SELECT d.verdict, count(v.verdict) AS n FROM (VALUES ('match'), ('mismatch'), ('missing'), ('unclear')) d(verdict) LEFT JOIN v USING (verdict) GROUP BY 1""")
def register_compare_counts(spark, sf):
    """Register and document values that differ in case, masks, zeros and the order of a date; one that differs, one that is missing."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 6).alias("way"), F.date_format("o_orderdate", "yyyy/MM/dd").alias("ymd"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("dmy"))
    n = F.lpad((F.col("case_id") + 1000000).cast("string"), 10, "1")
    kept = F.element_at(F.array(F.lit("Ali"), F.concat(F.lit("******"), F.right(n, F.lit(4))), F.concat(n, F.lit(".50")), F.col("ymd"), F.lit("Riyadh"), F.lit("x")), (F.col("way") + 1).cast("int"))
    said = F.element_at(F.array(F.lit("ali "), n, F.concat(n, F.lit(".5")), F.col("dmy"), F.lit("Jeddah"), F.lit(None)), (F.col("way") + 1).cast("int"))
    v = C.verdicts(o.select("case_id", kept.alias("value")), o.select("case_id", said.alias("value")), ["case_id"])
    dim = spark.createDataFrame([("match", 0), ("mismatch", 1), ("missing", 2), ("unclear", 3)], "id string, rank int")
    return A.zero_filled(v, "verdict", dim, "rank").select(F.col("id").alias("verdict"), "n")


@query("""WITH c AS (SELECT o_orderkey AS id, 0 AS s, -1 AS r, 0 AS i, 'City' AS label, o_clerk AS value FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS o_clerk FROM orders)
 UNION ALL SELECT l_orderkey, 0, l_linenumber - 1, 0, 'Owner ' || l_linenumber || ' - Name', l_returnflag FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_returnflag) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_returnflag FROM lineitem))
 SELECT id, row_number() OVER (PARTITION BY id ORDER BY s, r, i) AS line, label, value FROM c WHERE value <> ''""")
def flatten_pairs(spark, sf):
    """Orders as a section with a field and a record for each line; empty values are no lines."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    field = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    numbered = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "flag"))).alias("l"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("city"))
    wide = F.transform(F.sequence(F.lit(1), F.greatest(F.array_max(F.transform("l", lambda x: x["l_linenumber"])), F.lit(1))), lambda n: F.array(field("Name", F.try_element_at(F.filter("l", lambda x: x["l_linenumber"] == n), F.lit(1))["flag"])))
    d = orders.join(numbered, "id", "left").select("id", F.array(F.struct(F.array(field("City", F.col("city"))).alias("fields"), F.lit("Owner").alias("record_label"), wide.alias("records"))).alias("s"))
    return R.flatten_sections(d, "id", "s").select("id", F.col("line").cast("long").alias("line"), "label", "value")


@query("SELECT 'k' AS key, count(json_extract_string(props, '$.k')) AS n, count(*) AS \"of\", 'number' AS types FROM events")
def schema_profile(spark, sf):
    return R.presence(table(spark, sf, "events"), "props")


@query("""WITH c AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS clause, string_split(text, chr(10))[-1] AS wanted FROM documents), r AS (SELECT id, clause, len(list_intersect(string_split(clause, ' '), string_split(wanted, ' '))) / len(list_distinct(string_split(wanted, ' '))) AS ratio FROM c)
 SELECT id, CAST(round(ratio * 100) AS BIGINT) AS percent, clause FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ratio DESC, length(clause), clause DESC) AS rn FROM r WHERE ratio >= 0.15) WHERE rn = 1""")
def best_clause(spark, sf):
    """The line of each document that holds most of its last line's words."""
    lines = F.split("text", "\n")
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(lines).alias("clause"), F.element_at(lines, -1).alias("wanted"))
    return M.best_clause(c.select("id", "clause", F.split("clause", " ").alias("words"), F.split("wanted", " ").alias("wanted")), "id", 0.15).select("id", F.round(F.col("ratio") * 100).cast("long").alias("percent"), "clause")


@query("""WITH t AS (SELECT doc_id AS doc, generate_subscripts(string_split(text, chr(10)), 1) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT doc, ln, CASE WHEN length(line) % 4 = 1 THEN left(line, 9) END AS block FROM t)
 SELECT doc, ln, coalesce(last_value(block IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ln), first_value(block IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ln ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS block FROM b""")
def fill_blocks(spark, sf):
    """Lines of documents without a block take that of the line before, or else the next."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    d = d.select("doc", (F.col("i") + 1).cast("long").alias("ln"), F.when(F.length("line") % 4 == 1, F.left("line", F.lit(9))).alias("block"))
    return M.fill_both_ways(d, "doc", "ln", "block")


@query("""WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents), s AS (SELECT *, sum(CASE WHEN length(line) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS entry FROM t)
 SELECT doc_id, CAST(entry AS BIGINT) AS entry, string_agg(line, ' ' ORDER BY ln) AS text, min(1.0 / ln) AS confidence FROM s WHERE entry > 0 GROUP BY 1, 2""")
def carry_lines(spark, sf):
    """Lines whose length is divisible by three open an entry; the others continue the one before."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).withColumn("ln", F.col("i") + 1)
    return M.carry_forward(d.withColumn("confidence", 1 / F.col("ln")), "doc_id", "ln", F.length("text") % 3 == 0)


_CELL = "CASE doc_id % 8 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) WHEN 5 THEN ' =' ELSE '' END || text"


@query(f"SELECT doc_id AS id, CASE WHEN regexp_matches(c, '^[=+@\\t\\r-]') THEN chr(39) || c ELSE c END AS cell FROM (SELECT doc_id, {_CELL} AS c FROM documents)")
def csv_cells(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), X.csv_cell(F.expr(_CELL)).alias("cell"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'a_b ' || c_custkey || '.pdf' WHEN 2 THEN 'تقرير' || c_custkey || '.pdf' ELSE left(c_custkey || repeat('x', 200), 120) END AS name FROM customer""")
def safe_names(spark, sf):
    """Names of dots only, with folders and forbidden signs, in Arabic, and too long."""
    n = F.col("c_custkey").cast("string")
    ways = [F.lit(" ... "), F.concat(F.lit("../up\\x/a?b "), n, F.lit(".pdf")), F.concat(F.lit("C:\\تقرير"), n, F.lit(".pdf")), F.concat(n, F.repeat(F.lit("x"), 200))]
    name = F.element_at(F.array(*ways), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), X.safe_name(name).alias("name"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Deed' || c_custkey || ' number' WHEN 1 THEN 'Owner id ' || c_custkey ELSE 'Plain' || repeat('k', 1200) END AS label FROM customer""")
def key_labels(spark, sf):
    n = F.col("c_custkey").cast("string")
    key = F.element_at(F.array(F.concat(F.lit("deed"), n, F.lit("Number")), F.concat(F.lit("owner__id_"), n), F.concat(F.lit("plain"), F.repeat(F.lit("k"), 1200))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), X.label_of(key).alias("label"))


_REGION = "CASE c_nationkey % 5 WHEN 0 THEN 'riyadh' WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN 'unknown' WHEN 3 THEN '' END"


@query(f"WITH t AS (SELECT c_custkey AS id, {_REGION} AS region, c_acctbal < 3000 AS said FROM customer) SELECT id, CASE WHEN coalesce(region, '') NOT IN ('', 'unknown') THEN region <> 'riyadh' ELSE said END AS outside FROM t")
def outside_jurisdiction(spark, sf):
    reasons = F.when(F.col("c_acctbal") < 3000, F.array(F.lit("low_confidence"), F.lit("outside_jurisdiction"))).otherwise(F.array(F.lit("low_confidence")))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), G.outside(F.expr(_REGION), "riyadh", reasons).alias("outside"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, CAST(floor(1000 * CASE WHEN l_returnflag = 'R' THEN least(1, 0.6::DOUBLE * (l_discount * 10) + 0.4::DOUBLE * (l_tax * 10) + 0.2::DOUBLE) ELSE l_discount * 10 * 0.8::DOUBLE END + 0.5) AS BIGINT) AS thousandths FROM lineitem""")
def confidence_blend(spark, sf):
    blend = D.confidence(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_returnflag") == "R")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.floor(1000 * blend + 0.5).alias("thousandths"))


@query("""SELECT o_orderkey AS id, 'status' AS field, o_orderstatus AS old, 'F' AS new FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'note', NULL, 'new' FROM orders WHERE o_orderkey % 2 = 0""")
def real_changes(spark, sf):
    """Old and new maps of every order; empty and absent values are the same."""
    o = table(spark, sf, "orders")
    old = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("gone"), F.lit(""))
    new = F.create_map(F.lit("status"), F.lit("F"), F.lit("note"), F.when(F.col("o_orderkey") % 2 == 0, "new").otherwise(""))
    d = o.select(F.col("o_orderkey").alias("id"), F.explode(R.changes_of(old, new)).alias("field", "c"))
    return d.select("id", "field", F.col("c.from").alias("old"), F.col("c.to").alias("new"))


_LABEL = "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || p_name || ' ' || p_size || '  ' ELSE p_type END"


@query(f"WITH a AS (SELECT p_name || CASE WHEN p_size > 25 THEN ' ' || p_size ELSE '' END AS alias, p_brand AS key FROM part), o AS (SELECT alias, CASE WHEN count(DISTINCT key) = 1 THEN min(key) END AS key FROM a GROUP BY 1) SELECT id, key FROM (SELECT p_partkey AS id, {_LABEL} AS label FROM part) LEFT JOIN o ON lower(trim(label)) = alias")
def label_alignment(spark, sf):
    """Labels of parts against aliases of their names; aliases of several keys stand for none."""
    p = table(spark, sf, "part")
    aliases = p.select(F.expr("p_name || CASE WHEN p_size > 25 THEN ' ' || p_size ELSE '' END").alias("alias"), F.col("p_brand").alias("key"))
    return R.align_labels(p.select(F.col("p_partkey").alias("id"), F.expr(_LABEL).alias("label")), aliases).select("id", "key")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS id, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INT) AS b FROM lineitem), k(id, n, b, kept) AS (SELECT DISTINCT id, 0, -1, '' FROM s UNION ALL
 SELECT k.id, n + 1, x.b, kept || CASE WHEN n > 0 THEN ' ' ELSE '' END || x.a || '-' || x.b FROM k JOIN LATERAL (SELECT a, b FROM s WHERE s.id = k.id AND a >= k.b ORDER BY a, b LIMIT 1) x ON true WHERE n < 3)
 SELECT id, arg_max(kept, n) AS kept FROM k GROUP BY 1""")
def greedy_quotes(spark, sf):
    """Spans of the lines of an order, from the left, without overlaps, three at most."""
    start = F.col("l_linenumber") * 10
    t = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"))).alias("s"))
    kept = F.transform(M.greedy_spans(F.col("s")), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return t.select("id", F.array_join(kept, " ").alias("kept"))


_PARENTS = ("owner", "identity", "Principals[]", "deed", "Person", "a.company", "list[].personalId")
_KEYS = ("id", "nationalId", "phone", "number", "birthDateHijri", "emails", "Email", "id_number", "mobileNo", "ID", "idNo")
_SPELT = "CASE WHEN c_nationkey % 2 = 0 THEN 'x' || c_nationkey || '.' ELSE '' END || CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_PARENTS)) + " END || '.' || CASE c_custkey % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_KEYS)) + " END"


@query(f"""WITH k AS (SELECT c_custkey AS id, string_split(lower(replace({_SPELT}, '[]', '')), '.') AS s FROM customer)
 SELECT id, s[-1] IN ('nationalid', 'phone', 'birthdatehijri', 'email', 'mobileno', 'idno') OR (s[-1] = 'id' AND s[-2] IN ('identity', 'person', 'personalid')) OR array_to_string(s, '.') = 'principals.id' AS personal FROM k""")
def personal_fields(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), K.personal_path(F.expr(_SPELT), ["principals.id"]).alias("personal"))


@query("SELECT doc_id AS id, doc_id % 3 <> 0 OR length(text) = 0 AS same FROM documents")
def multiset_equal(spark, sf):
    """The characters of a text against themselves in reverse, and against the text with its first one doubled."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.split("text", "").alias("c"), "text")
    other = F.when(F.col("id") % 3 == 0, F.split(F.concat(F.left("text", F.lit(1)), "text"), "")).otherwise(F.reverse("c"))
    return d.select("id", X.same_multiset(F.col("c"), other).alias("same"))


PRICES = [("A", 5), ("N", 8), ("R", 0)]


@query(f"WITH p(endpoint, price) AS ({_sql(PRICES)}) SELECT l_orderkey AS id, CAST(sum(price + CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END) AS BIGINT) AS cost FROM lineitem JOIN p ON l_returnflag = endpoint GROUP BY 1")
def call_costs(spark, sf):
    """What the calls chosen for each order cost, those by an old number more."""
    calls = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("endpoint"), (F.col("l_linestatus") == "O").alias("old"))
    return L.call_costs(calls, spark.createDataFrame(PRICES, "endpoint string, price int"), "id", 2)


# Status, both quotes, an explanation, and whether the finding holds; a quote of more than five characters was not found.
FINDINGS = [("same", "10 SAR", "10 sar", "x", True), ("same", "a 10", "a 11", "x", False), ("changed", "a", "b", "x", True), ("only_a", "", "b", "x", False), ("only_b", None, "b", "x", True), ("odd", "a", "b", "x", False),
            ("only_a", "a", "", "x", True), ("same", "a", "b", " ", False), ("changed", "a", "invented", "x", False), ("only_a", "a", "invented", "x", False)]


@query("WITH f(way, ok) AS (VALUES " + ", ".join(f"({i}, {str(f[-1]).lower()})" for i, f in enumerate(FINDINGS)) + ") SELECT o_orderkey AS id, ok FROM orders JOIN f ON o_orderkey % 10 = way")
def finding_rules(spark, sf):
    pick = lambda k: F.element_at(F.array(*[F.lit(f[k]).cast("string") for f in FINDINGS]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    found = lambda q: F.coalesce((q != "") & (F.length(q) <= 6), F.lit(False))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), C.finding_ok(pick(0), pick(1), pick(2), pick(3), found(pick(1)), found(pick(2))).alias("ok"))
