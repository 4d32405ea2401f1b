"""Queries of line shapes, recovered entries, sizes, cells, windows and declared registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import layout as L
from ..operators import registry as R
from ..operators import segment as S
from ..session import table
from .checks import query_into

QUERIES, ORACLES = {}, {}
query = query_into(QUERIES, ORACLES)

#: Labels whose rows are looked for in the documents.
LABELS = ("contact", "email", "phone", "license", "copyright", "the")


@query()
def line_shapes(spark, sf):
    """Rows, headings and body of every line of every document."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "t"))
    shaped = L.line_shapes(lines, "doc_id", "n", "t", list(LABELS))
    return shaped.select("doc_id", "n", "shape", F.array_join("cells", " | ").alias("cells"))


def entry_sql(key: str, name: str, source: str, first: int) -> str:
    """Entries of a table in SQL of either engine; names and meanings vary a little from row to row."""
    return f"""SELECT {first} + {key} AS id, {key} % 40 AS page, {key} AS at, 'k' || ({key} * 7) % 97 AS key, CASE WHEN {key} % 3 = 0 THEN 'nom' ELSE 'name' END || {key} % 5 || 'ra' AS name, 'meaning of ' || {name} AS meaning, ({key} * 13) % 400 AS y FROM {source}"""


@query()
def recovered_entries(spark, sf):
    """Entries of customers by page, corrected and extended by a second reading, the suppliers'."""
    for t in ("customer", "supplier"):
        table(spark, sf, t).createOrReplaceTempView(f"entries_of_{t}")
    old = spark.sql(entry_sql("c_custkey", "lower(c_mktsegment)", "entries_of_customer", 0))
    new = spark.sql(entry_sql("s_suppkey", "CASE s_nationkey % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' ELSE 'householt' END", "entries_of_supplier", 1_000_000_000))
    quality = lambda d: d.withColumn("quality", C.text_quality(F.col("meaning")))
    return S.recovered(quality(old), quality(new), "page").select("id", "page", "key", "name", "meaning", "how")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS id, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS n FROM lineitem),
 g(id, n, x, start) AS (SELECT id, n, x, x FROM s WHERE n = 1 UNION ALL SELECT s.id, s.n, s.x, CASE WHEN s.x > g.start * 1.08 THEN s.x ELSE g.start END FROM g JOIN s ON s.id = g.id AND s.n = g.n + 1)
 SELECT id, sum(v)::DOUBLE AS total, count(DISTINCT start) AS groups FROM (SELECT *, round_even(median(x) OVER (PARTITION BY id, start) * 2, 0) / 2 AS v FROM g) GROUP BY id""")
def size_clusters(spark, sf):
    """Quantities of an order in groups within eight per cent of their least."""
    q = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("x")).select(F.col("l_orderkey").alias("id"), S.size_groups(F.col("x")).alias("v"))
    return q.select("id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(F.array_distinct("v")).cast("long").alias("groups"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name || ' ' || p_size || ' ' || p_brand || ' ' || p_name AS line, [p_name, p_size::VARCHAR, p_name, p_brand, ''] AS c FROM part),
 a AS (SELECT *, strpos(line, c[1]) - 1 AS f1 FROM t), b AS (SELECT *, f1 + length(c[1]) AS e1 FROM a), d AS (SELECT *, CASE WHEN strpos(line[e1 + 1:], c[2]) > 0 THEN e1 + strpos(line[e1 + 1:], c[2]) - 1 END AS f2 FROM b),
 e AS (SELECT *, coalesce(f2 + length(c[2]), e1) AS e2 FROM d), f AS (SELECT *, CASE WHEN strpos(line[e2 + 1:], c[3]) > 0 THEN e2 + strpos(line[e2 + 1:], c[3]) - 1 END AS f3 FROM e), g AS (SELECT *, coalesce(f3 + length(c[3]), e2) AS e3 FROM f)
 SELECT id, f1::INT AS first, f2::INT AS second, f3::INT AS third, (CASE WHEN strpos(line[e3 + 1:], c[4]) > 0 THEN e3 + strpos(line[e3 + 1:], c[4]) - 1 END)::INT AS fourth, NULL::INT AS fifth FROM g""")
def cell_places(spark, sf):
    """Cells of a line, each searched behind the one before; one that stands before it is not found."""
    n = F.col("p_size").cast("string")
    found = S.ordered_cells(F.concat_ws(" ", "p_name", n, "p_brand", "p_name"), F.array("p_name", n, "p_name", "p_brand", F.lit("")))
    places = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), found.alias("f"))
    return places.select("id", *(F.col("f")[i].alias(n) for i, n in enumerate(("first", "second", "third", "fourth", "fifth"))))


@query("""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents), w(doc_id, i, a, b, n) AS (SELECT doc_id, 0, 0::BIGINT, b, n FROM (SELECT *, 0::BIGINT AS a FROM d), LATERAL (SELECT CASE WHEN a + 900 >= n THEN n
 ELSE coalesce((SELECT max(k) FROM (SELECT unnest(range(a + 450, a + 900)) AS k) WHERE text[k + 1] = chr(10)), a + 900) END AS b) UNION ALL
 SELECT doc_id, i + 1, a2, CASE WHEN a2 + 900 >= n THEN n WHEN strpos(reverse(body), chr(10)) BETWEEN 1 AND 450 THEN a2 + 900 - strpos(reverse(body), chr(10)) ELSE a2 + 900 END, n
 FROM (SELECT w.*, greatest(a + 1, b - 400) AS a2, substr(d.text, (greatest(a + 1, b - 400) + 1)::BIGINT, 900) AS body FROM w JOIN d USING (doc_id) WHERE b < w.n AND i < 3))
 SELECT doc_id, i::INT AS i, a::INT AS start, b::INT AS "end" FROM w""".replace("""LATERAL (SELECT CASE WHEN a + 900 >= n THEN n
 ELSE coalesce((SELECT max(k) FROM (SELECT unnest(range(a + 450, a + 900)) AS k) WHERE text[k + 1] = chr(10)), a + 900) END AS b)""", """LATERAL (SELECT CASE WHEN n <= 900 THEN n
 WHEN strpos(reverse(text[1:900]), chr(10)) BETWEEN 1 AND 450 THEN 900 - strpos(reverse(text[1:900]), chr(10)) ELSE 900 END AS b)"""))
def overlapping_windows(spark, sf):
    """Up to four windows of 900 characters over each document, 400 shared, cut at line ends where one lies past a window's half."""
    w = S.overlapping(F.col("text"), 900)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(w).alias("i", "w")).select("doc_id", "i", "w.start", "w.end")


#: A registry read from the tables: groups are brands, their fields the types of its parts, templates the suppliers; every third use has a role.
_RELATIONS = {
    "groups": "SELECT p_brand AS grp, 'Section ' || substr(p_brand, 7, 1) AS section, false AS repeatable, true AS instantiable FROM part GROUP BY p_brand",
    "group_fields": "SELECT p_brand AS grp, CAST(min(p_size) AS INT) AS at, lower(substr(p_type, 1, 6)) AS key, 'The ' || lower(p_type) AS label, CASE WHEN p_type LIKE 'S%' THEN 'text' ELSE 'number' END AS type FROM part GROUP BY p_brand, p_type",
    "uses": "SELECT s_name AS template, CAST(n AS INT) AS at, 'Brand#' || ((s_suppkey + n) % 5 + 1) AS grp, CASE WHEN n = 1 THEN 'Own' END AS section, CASE WHEN n = 2 THEN CASE WHEN s_suppkey % 10 = 9 THEN '' ELSE 'r' || s_suppkey % 4 END END AS prefix, CASE WHEN n = 2 THEN 'heir' END AS role, CASE WHEN n = 2 THEN 'Heir' END AS role_label, n = 2 AS instance, CASE WHEN s_suppkey % 7 = 0 THEN 'standa' ELSE 'none' END AS need FROM supplier, (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) k",
}


def _relations(spark, sf):
    for t in ("part", "supplier"):
        table(spark, sf, t).createOrReplaceTempView(t)
    none = F.array().cast("array<string>")
    r = {k: spark.sql(sql) for k, sql in _RELATIONS.items()}
    r["group_fields"] = r["group_fields"].withColumns({"aliases": F.array(F.upper("key")), "choices": none})
    r["uses"] = r["uses"].withColumn("required", F.when(F.col("need") == "none", none).otherwise(F.array("need"))).drop("need")
    for k in ("fields", "anchors"):
        r[k] = spark.createDataFrame([], R.SCHEMAS[k])
    r["sections"] = table(spark, sf, "supplier").select(F.col("s_name").alias("template"), F.explode(F.array(F.lit("own"), F.lit("section 1"), F.lit("section 2"))).alias("section"))
    r["types"] = spark.createDataFrame([("text", ["number"]), ("number", ["text"])], R.SCHEMAS["types"])
    return r


_COMPILED = f"""g AS ({_RELATIONS["groups"]}), f AS ({_RELATIONS["group_fields"]}), u AS ({_RELATIONS["uses"]}),
 c AS (SELECT template, CASE WHEN coalesce(prefix, '') <> '' OR prefix = '' THEN prefix || '_' ELSE '' END || key AS key, CASE WHEN role IS NULL THEN label ELSE label || ' لHeir' END AS label, type, coalesce(u.section, g.section) AS section, need = key AS required,
 role, grp AS source, CASE WHEN role IS NULL THEN upper(key) ELSE label || ' لHeir' END AS aliases, CASE WHEN role IS NULL THEN '' ELSE label || ',' || upper(key) END AS shared FROM u JOIN g USING (grp) JOIN f USING (grp))"""


@query(f"WITH {_COMPILED} SELECT * FROM c")
def registry_fields(spark, sf):
    """The declared fields of every template, with prefixes, composed labels, sections and shared aliases."""
    f = R.compiled(_relations(spark, sf))
    return f.select("template", "key", "label", "type", "section", "required", "role", "source", F.array_join("aliases", ",").alias("aliases"), F.array_join("shared_aliases", ",").alias("shared"))


@query(f"""WITH {_COMPILED} SELECT 'error' AS level, template, 'unknown group' AS rule, grp AS detail FROM u WHERE grp NOT IN (SELECT grp FROM g) UNION ALL SELECT 'error', template, 'role without a prefix', role FROM u WHERE instance AND prefix = ''
 UNION ALL SELECT 'error', template, 'unknown required field', grp || '.' || need FROM u WHERE need <> 'none' AND grp IN (SELECT grp FROM g) AND NOT EXISTS (SELECT 1 FROM f WHERE f.grp = u.grp AND f.key = u.need)
 UNION ALL SELECT 'error', template, 'key twice', key FROM c GROUP BY template, key HAVING count(*) > 1
 UNION ALL SELECT 'warning', template, 'field in an unknown section', key || ': ' || section FROM c WHERE lower(section) NOT IN ('own', 'section 1', 'section 2')""")
def registry_findings(spark, sf):
    """What is wrong with the declared templates, and what is doubtful."""
    return R.findings(_relations(spark, sf))
