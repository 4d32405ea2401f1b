"""Queries of citation, value checks, closed vocabularies, budgets and names; inputs are built from the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import citation as Q
from ..operators import cleaning as C
from ..session import table

QUERIES, ORACLES = {}, {}


def query_into(queries: dict, oracles: dict):
    """A decorator that registers a query, with its SQL if there is one."""

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return query


query = query_into(QUERIES, ORACLES)


def _pick(key: str, values: list):
    """One of some strings by a key."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _rows(rows) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, (i, *r))) + ")" for i, r in enumerate(rows)) + ")"


@query("""WITH RECURSIVE s AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\\n+', chr(1), 'g'), '([.!?؟؛])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
 t AS (SELECT doc_id, row_number() OVER () AS n, trim(s, chr(32)) AS s FROM s), c(doc_id, part, rest) AS (SELECT doc_id, '', s FROM t WHERE s <> '' UNION ALL
 SELECT doc_id, trim(left(rest, stop)), trim(substr(rest, stop + 1)) FROM (SELECT *, CASE WHEN length(rest) <= 450 THEN 450 WHEN length(regexp_extract(left(rest, 450), '(?s)^(.*) [^ ]*$', 1)) >= 200
 THEN length(regexp_extract(left(rest, 450), '(?s)^(.*) [^ ]*$', 1)) ELSE 450 END AS stop FROM c) WHERE rest <> '')
 SELECT doc_id, count(DISTINCT part) AS n, CAST(sum(DISTINCT length(part)) AS BIGINT) AS sizes, max(part) AS last_part FROM c WHERE part <> '' GROUP BY 1""")
def sentence_spans(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(Q.sentences(F.col("text"))).alias("part"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum_distinct(F.length("part")).alias("sizes"), F.max("part").alias("last_part"))


@query("""WITH q AS (SELECT doc_id, text, q FROM (SELECT doc_id, text, regexp_replace(substr(text, 50, 60), '^\\s+|\\s+$', '', 'g') AS q FROM documents) WHERE q <> ''), p AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN q ELSE
 regexp_extract(text, replace(regexp_escape(regexp_replace(q, '\\s+', ' ', 'g')), '\\ ', '\\s+')) END AS hit FROM q), s AS (SELECT doc_id, text, hit, position(hit IN text) - 1 AS a FROM p)
 SELECT doc_id, a AS start, a + length(hit) AS "end", length(left(text, a)) - length(replace(left(text, a), chr(10), '')) + 1 AS line, hit AS quote FROM s""")
def quote_citations(spark, sf):
    """A part of each text as it is, or with every run of blanks replaced by others."""
    d = table(spark, sf, "documents").select("doc_id", "text", F.regexp_replace(F.substring("text", 50, 60), r"^\s+|\s+$", "").alias("q")).where("q != ''")
    quote = F.when(F.col("doc_id") % 2 == 0, F.col("q")).otherwise(F.regexp_replace("q", r"\s+", " \n\t "))
    return d.select("doc_id", Q.cite(F.col("text"), quote).alias("c")).select("doc_id", *[F.col(f"c.{c}").cast("long").alias(c) for c in ("start", "end", "line")], "c.quote")


_PRINTED = "translate(CAST(1000000 + o_orderkey AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩')"


@query(f"""SELECT o_orderkey AS id, 'رقم ' || CASE WHEN o_orderkey % 3 = 0 THEN CAST(2000000 + o_orderkey AS VARCHAR) ELSE {_PRINTED} END AS value, o_orderkey % 3 = 1 AS verified FROM orders""")
def restored_values(spark, sf):
    """Values in other digits than the source's; a third has a number that the source lacks, a third other words."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    number = (F.col("id") + 1000000).cast("string")
    source = F.concat(F.lit("الصك "), F.when(F.col("id") % 3 == 2, "عدد ").otherwise("رقم "), F.translate(number, X.DIGITS_TO[:10], X.DIGITS_FROM[:10]), F.lit(" وتاريخه"))
    value = F.concat(F.lit("رقم "), F.when(F.col("id") % 3 == 0, (F.col("id") + 2000000).cast("string")).otherwise(number))
    return o.select("id", Q.fidelity(value, source).alias("f")).select("id", "f.value", "f.verified")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 3 THEN NULL WHEN c_custkey % 4 = 2 THEN printf('%05d', c_custkey) ELSE translate(left(printf('%05d', c_custkey), 2), '0123456789', '٠١٢٣٤٥٦٧٨٩')
 || CASE c_custkey % 4 WHEN 0 THEN ' ' ELSE '' END || substr(printf('%05d', c_custkey), 3) END AS printed FROM customer""")
def numbers_in_other_writing(spark, sf):
    """A number typed plainly, found as the text prints it: in mixed digits, with a blank, as it is; inside a longer number it does not count."""
    n = F.format_string("%05d", F.col("c_custkey"))
    mixed = F.translate(F.left(n, F.lit(2)), X.DIGITS_TO[:10], X.DIGITS_FROM[:10])
    ways = [F.concat(F.lit("call "), mixed, F.lit(" "), F.substr(n, F.lit(3)), F.lit(".")), F.concat(F.lit("call "), mixed, F.substr(n, F.lit(3))), F.concat(F.lit("no. "), n), F.concat(F.lit("no. 7"), n)]
    text = F.element_at(F.array(*ways), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), Q.find_number(text, n).alias("printed"))


TYPES = {"id10": ("^[12][0-9]{9}$", ()), "iban": ("^SA[0-9]{22}$", ()), "share": ("^[0-9]+/[0-9]+$", ("percent",)), "percent": ("^[0-9]+ ?%$", ()), "area": (r"^[0-9]+(\.[0-9]+)?$", ("note",)), "note": (None, ())}
VALUES = (
    ("id10", "١٠٢٣٤٥٦٧٨٩", "ok"), ("id10", "3023456789", "mismatch"), ("iban", "SA03 8000 0000 6080 1016 7519", "ok"), ("iban", "SA12", "mismatch"), ("share", "1/2", "ok"), ("share", "50 %", "ok"), ("share", "half", "mismatch"),
    ("area", "wide", "ok"), ("free", "anything", "ok"), ("id10", " ", "empty"), ("enum", "الزوجة", "ok"), ("enum", "ابنة", "mismatch"), ("enum", "الأخ الشقيق", "ok"), ("id10", None, "empty"),
)


@query(f"SELECT o_orderkey AS id, CASE WHEN status = 'ok' AND o_orderkey % 5 = 0 THEN 'unverified' ELSE status END AS status FROM orders JOIN {_rows(VALUES)} t(way, type, value, status) ON o_orderkey % {len(VALUES)} = way")
def valuetype_validate(spark, sf):
    """Patterns with fallbacks, an unconstrained fallback, an unknown type, spaced codes, other digits and enums with articles."""
    choices = F.transform(F.array(*map(F.lit, ("ابن", "زوجة", "أخ شقيق"))), lambda c: X.normalize(c))
    status = Q.value_status(_pick("o_orderkey", [v for _, v, _ in VALUES]), _pick("o_orderkey", [t for t, _, _ in VALUES]), TYPES, choices)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), Q.field_status(status, F.col("o_orderkey") % 5 != 0).alias("status"))


VOCABULARY = {"category": ["roads", "water", "other"], "ministry": ["city", "other"], "priority": ["critical", "high", "medium", "low"], "factor": list("abcdef"), "scope": ["one", "many"], "tone": ["calm"], "confidence": list(C.CONFIDENCES)}
ANSWERS = (
    ('{"category":"roads","subcategory":"pothole","ministry":"city","priority":"high","priority_factors":["a","x","a","b","c","d","e"],"tone":"calm","confidence":"high"}', "roads", "pothole", "a,b,c,d", "calm", "high"),
    ('{"category":"roads","subcategory":"leak","ministry":"city","priority":"high","tone":"wild","confidence":"sure"}', "roads", None, "", None, "low"),
    ('{"category":"air","ministry":"city","priority":"high"}', None, None, None, None, None), ('{"category":"water","ministry":"city"}', None, None, None, None, None), ("not json", None, None, None, None, None),
)


@query(f"SELECT o_orderkey AS id, category, sub AS subcategory, factors, tone, confidence FROM orders JOIN {_rows([(a[1], a[2], a[3], a[4], a[5]) for a in ANSWERS])} t(way, category, sub, factors, tone, confidence) ON o_orderkey % {len(ANSWERS)} = way")
def closed_classification(spark, sf):
    c = C.classification(_pick("o_orderkey", [a[0] for a in ANSWERS]), VOCABULARY, {"pothole": "roads", "leak": "water"})
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), c.alias("c"))
    return o.select("id", "c.category", "c.subcategory", F.array_join("c.factors", ",").alias("factors"), "c.tone", "c.confidence")


@query("""SELECT conv_id, turn, text, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1 OR used <= 800""")
def prefix_budget(spark, sf):
    return C.prefix_budget(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", F.length("text"), 800)


@query("""WITH s AS (SELECT o_orderkey AS ref, o_orderdate AS made FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30), c AS (SELECT o_orderkey AS ref, 'priority' AS changes FROM orders WHERE o_orderkey % 97 = 0),
 a AS (SELECT s.ref, made, changes, false AS outside FROM s LEFT JOIN c USING (ref) UNION ALL SELECT ref, NULL, changes, true FROM c WHERE ref NOT IN (SELECT ref FROM s))
 SELECT ref, changes, outside, row_number() OVER (ORDER BY outside DESC, made NULLS FIRST, ref) AS place FROM a""")
def samples_with_corrected(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_orderdate").alias("made"))
    newest = o.orderBy(F.desc("made"), F.desc("ref")).limit(30)
    changed = o.where("ref % 97 = 0").select("ref", F.lit("priority").alias("changes"))
    return C.samples_with_corrected(newest, changed, "ref", "made").select("ref", "changes", "outside", F.col("place").cast("long").alias("place"))


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, l_returnflag AS f FROM lineitem), g AS (SELECT id, list(f ORDER BY n, f) AS got FROM l GROUP BY 1)
 SELECT id, array_to_string(list_slice(list_filter(list_distinct_in_order, lambda x: x IN ('R', 'A')), 1, 5), ',') AS cited, (SELECT coalesce(string_agg(f || k, ',' ORDER BY f), '') FROM
 (SELECT f, count(*) - count(*) FILTER (WHERE n % 2 = 0) * 2 AS k FROM l WHERE l.id = h.id GROUP BY f) WHERE k > 0) AS odd_more FROM
 (SELECT id, list_transform(list_sort(list_distinct(list_transform(list_distinct(got), lambda x: (list_position(got, x), x)))), lambda t: t[2]) AS list_distinct_in_order FROM g) h""")
def reference_lists(spark, sf):
    """Supplied references once each in order; and by multiset difference, what odd lines hold more often than even ones."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("l"))
    flags = F.transform("l", lambda x: x["l_returnflag"])
    some = lambda rest: F.transform(F.filter("l", lambda x: x["l_linenumber"] % 2 == rest), lambda x: x["l_returnflag"])
    more = C.multiset_difference(some(1), some(0))
    return lines.select(
        "id", F.array_join(C.cited(flags, F.array(F.lit("R"), F.lit("A"))), ",").alias("cited"), F.array_join(F.transform(more, lambda m: F.concat(m["item"], m["n"].cast("string"))), ",").alias("odd_more")
    )


_RULES = [("deed", "number", True, "^[0-9]+$", None, None), ("deed", "date", False, None, "number", None), ("firm", "cr", False, "^7[0-9]+$", None, "who"), ("firm", "name", False, None, None, "who")]
_INPUTS = "endpoint string, name string, required boolean, pattern string, required_if string, `group` string"


@query("""WITH c AS (SELECT c_custkey AS call, c_custkey % 2 = 0 AS deed, c_custkey % 3 = 0 AS a, c_custkey % 5 = 0 AS b, c_custkey % 7 = 0 AS lost FROM customer), k AS (SELECT call, lost, CASE WHEN deed THEN a OR (NOT a AND NOT b) ELSE a = b OR (a AND call % 11 = 0) END AS bad FROM c)
 SELECT call, CASE WHEN lost THEN 'unavailable' WHEN bad THEN 'invalid' END AS skip FROM k""")
def planned_calls(spark, sf):
    """Inputs against a catalogue: required, malformed, required beside another, and one of a group."""
    n = F.col("c_custkey")
    endpoint = F.when(n % 2 == 0, "deed").otherwise("firm")
    a, b = n % 3 == 0, n % 5 == 0
    given = F.when(n % 2 == 0, F.array(F.struct(F.lit("number").alias("name"), F.when(a, "12x").otherwise("123").alias("value")), F.struct(F.lit("date").alias("name"), F.when(b, "2024").otherwise("").alias("value")))).otherwise(
        F.array(F.struct(F.lit("cr").alias("name"), F.when(a, F.when(n % 11 == 0, "8").otherwise("71")).otherwise("").alias("value")), F.struct(F.lit("name").alias("name"), F.when(b, "x").otherwise("").alias("value")))
    )
    calls = table(spark, sf, "customer").select(n.alias("call"), endpoint.alias("endpoint"), given.alias("g"), F.when(n % 7 == 0, "gone").otherwise(endpoint).alias("to"))
    rules = spark.createDataFrame(_RULES, _INPUTS)
    conflicts = C.checked_inputs(calls.select("call", "endpoint", F.explode("g").alias("x")).select("call", "endpoint", "x.*"), rules)
    return C.planned(calls.select("call", F.col("to").alias("endpoint")), conflicts, ["deed", "firm"]).select("call", "skip")


# A name, its key, whether it is plausible; a meaning and the gender that it states.
NAMES = (
    ("أَحْمَد", "احمد", True, "اسم علم مذكر", "male"), ("عبد الله", "عبدالله", True, "اسم مؤنث", "female"), ("هو", "هو", False, "للذكور والإناث", "unisex"), ("نور في الدار", "نورفيالدار", False, "ضوء", None),
    ("زيد وعمرو وبكر", "زيدوعمرووبكر", True, "اسم للذكور", "male"), ("واحد اثنان ثلاثة", "واحداثنانثلاثة", False, "x", None), ("م", "م", False, "اسم مشترك", "unisex"), ("abc", "", False, "اسم للإناث", "female"),
)


@query(f"""SELECT o_orderkey AS id, key, ok, coalesce(gender, CASE WHEN o_orderkey % 3 = 0 THEN 'female' WHEN o_orderkey % 3 = 1 THEN 'male' END, CASE WHEN o_orderkey % 5 = 0 THEN 'male' END, 'unknown') AS gender
 FROM orders JOIN {_rows([(n[1], n[2], n[4]) for n in NAMES])} t(way, key, ok, gender) ON o_orderkey % {len(NAMES)} = way""")
def dictionary_names(spark, sf):
    """Keys, plausibility and gender: by the wording, else above or below the page's split, else by the section."""
    k = F.col("o_orderkey")
    name = _pick("o_orderkey", [n[0] for n in NAMES])
    split = F.when(k % 3 < 2, F.lit(50))
    g = C.gender_of(_pick("o_orderkey", [n[3] for n in NAMES]), (k % 3) * 40 + 40, split, F.lit("female"), F.lit("male"), F.when(k % 5 == 0, "male"))
    return table(spark, sf, "orders").select(k.alias("id"), C.name_key(name).alias("key"), C.plausible_name(name).alias("ok"), g["gender"].alias("gender"))


@query("""SELECT doc_id, count(*) FILTER (WHERE length(l) > 300) AS noise, count(*) FILTER (WHERE length(regexp_replace(l, '[^ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي]', '', 'g')) >= 2) AS meaningful
 FROM (SELECT doc_id, unnest(string_split(text, chr(10)) || ['كلمة', 'ك 1']) AS l FROM documents) GROUP BY 1""")
def line_guards(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.concat(F.split("text", "\n"), F.array(F.lit("كلمة"), F.lit("ك 1")))).alias("l"))
    return d.groupBy("doc_id").agg(F.count_if(C.noise_line(F.col("l"))).alias("noise"), F.count_if(C.meaningful(F.col("l"))).alias("meaningful"))


@query("""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_linenumber // 3 AS VARCHAR) AS h, l_returnflag AS b FROM lineitem), m AS (SELECT *, CASE WHEN lag(h) OVER (PARTITION BY id ORDER BY n) = h THEN 0 ELSE 1 END AS o FROM l),
 s AS (SELECT *, sum(o) OVER (PARTITION BY id ORDER BY n) AS section FROM m) SELECT id, CAST(section AS BIGINT) AS section, min(h) AS heading, string_agg(b, chr(10) ORDER BY n, b) AS body FROM s GROUP BY id, section""")
def joined_sections(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.floor(F.col("l_linenumber") / 3).cast("string").alias("heading"), F.col("l_returnflag").alias("body"))
    return C.joined_chunks(l, "id", "n", "heading", "body")


@query("SELECT l_orderkey AS id, l_returnflag AS status, count(DISTINCT (l_linestatus, l_tax)) AS n FROM lineitem GROUP BY 1, 2")
def finding_counts(spark, sf):
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("status"), "l_linestatus", "l_tax")
    return C.finding_counts(f, "id", ["status", "l_linestatus", "l_tax"])


@query("SELECT round(avg(x), 6) AS mean FROM (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS x FROM orders UNION ALL SELECT avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END) FROM orders UNION ALL SELECT NULL)")
def mean_agreement(spark, sf):
    a = table(spark, sf, "orders").agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("a"), F.avg((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("b")).withColumn("c", F.lit(None).cast("double"))
    return C.mean_agreement(a, ["a", "b", "c"]).select(F.round("mean", 6).alias("mean"))


@query("""SELECT doc_id, CASE WHEN length(line) <= 200 THEN trim(line) ELSE CASE WHEN p > 0 THEN '…' ELSE '' END || trim(substr(line, p + 1, least(length(line), pos + 76) - p)) || CASE WHEN pos + 76 < length(line) THEN '…' ELSE '' END END AS quote
 FROM (SELECT doc_id, string_split(text, chr(10))[1] AS line, 20 AS pos, 0 AS p FROM documents) WHERE length(line) >= 30""")
def quote_windows(spark, sf):
    """The line around characters 20 to 30, whole or cut on either side."""
    d = table(spark, sf, "documents").where(F.length(F.substring_index("text", "\n", 1)) >= 30)
    return d.select("doc_id", Q.window(F.col("text"), F.lit(20), F.lit(30)).alias("quote"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'a b' END AS value, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'x,y' END AS facts FROM orders")
def cleaned_answers(spark, sf):
    """Placeholders become empty; lists lose them and their repeats."""
    value = F.when(F.col("o_orderkey") % 8 == 0, "غير مذكور").when(F.col("o_orderkey") % 4 == 0, " N/A ").otherwise(" a \n b ")
    facts = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("-"))).when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("x"), F.lit(" x"))).otherwise(F.array(F.lit("x"), F.lit("none"), F.lit("y"), F.lit("z")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), C.scalar(value).alias("value"), F.array_join(C.strings(facts, 2), ",").alias("facts"))

