"""Queries of the register's smaller rules; every input is written from columns of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import answers as A
from ..operators import citation as Q
from ..operators import cleaning as C
from ..operators import compare as V
from ..operators import gazetteer as P
from ..operators import layout as L
from ..operators import matching as M
from ..operators import register as G
from ..operators import segment as S
from ..operators import signals as N
from ..session import spread, table
from ..sources import intake as I
from ..streaming import cases as K
from .checks import query_into

QUERIES, ORACLES = {}, {}
query = query_into(QUERIES, ORACLES)

_BYTES = "replace(text, chr(10), CASE doc_id % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(13) ELSE chr(10) END) || CASE WHEN doc_id % 11 = 0 THEN chr(0) ELSE '' END"


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN NULL ELSE replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS decoded FROM documents")
def decoded_texts(spark, sf):
    """Documents as bytes with a byte order mark or none, line ends of three kinds, NULs, and bytes that are no UTF-8."""
    mark, broken = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit(""))), F.when(F.col("doc_id") % 13 == 0, F.unhex(F.lit("C328FF"))).otherwise(F.unhex(F.lit("")))
    return table(spark, sf, "documents").select("doc_id", I.decode_text(F.concat(mark, F.encode(F.expr(_BYTES), "UTF-8"), broken)).alias("decoded"))


@query("""WITH b AS (SELECT l_orderkey AS doc, l_linenumber % 3 AS page, l_partkey AS o, l_suppkey, 'n ' || l_partkey || chr(10) || 'q ' || CAST(l_quantity AS INT) AS lines FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus <> 'O')
 SELECT doc, page, string_agg(lines, chr(10) ORDER BY o, lines) AS text FROM b GROUP BY 1, 2""")
def page_texts(spark, sf):
    """Recognised blocks as one text a page, in reading order, without those that failed or were skipped."""
    html = F.concat(F.lit("<p>n "), F.col("l_partkey").cast("string"), F.lit("</p><div>q&nbsp;").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.lit("</div>"))
    b = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 3).alias("page"), F.col("l_partkey").alias("order"), F.replace(html, F.lit("&nbsp;"), F.lit(" ")).alias("html"), (F.col("l_returnflag") == "R").alias("error"), F.when(F.col("l_linestatus") == "O", True).alias("skipped")
    )
    return I.pages_of(b, "doc", "page")


@query("""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_custkey % 11 = 0 THEN 'empty_text' END, CASE WHEN o_custkey % 2 = 0 THEN 'low_confidence' END, CASE WHEN o_totalprice > 200000 THEN 'critical_unsupported' END, CASE WHEN o_orderstatus = 'P' THEN 'repeat_complainant' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders""")
def review_reason_order(spark, sf):
    """Reasons for a review in their fixed order, whatever order the flags come in."""
    flags = {"repeat_complainant": F.col("o_orderstatus") == "P", "critical_unsupported": F.col("o_totalprice") > 200000, "low_confidence": F.col("o_custkey") % 2 == 0, "empty_text": F.col("o_custkey") % 11 == 0}
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(N.review_reasons(flags), ",").alias("reasons"))


@query("""WITH t AS (SELECT l_orderkey AS id, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM t)
 SELECT id, string_agg(left('line ' || n, 5) || '=' || left(p::VARCHAR, 5), ',' ORDER BY n) AS context FROM r WHERE k <= 2 GROUP BY id""")
def context_caps(spark, sf):
    """Sections, fields and characters of a nested context held to their limits."""
    field = lambda label, v: F.struct(label.alias("label"), v.cast("string").alias("value"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), "l_linenumber").agg(F.min("l_partkey").alias("p"))
    section = F.struct(F.col("l_linenumber").alias("n"), F.array(field(F.concat(F.lit("line "), F.col("l_linenumber").cast("string")), F.col("p")), field(F.lit("more"), F.col("p"))).alias("fields"))
    s = lines.groupBy("id").agg(F.array_sort(F.collect_list(section)).alias("s"))
    kept = F.flatten(F.transform(C.capped_context(F.col("s"), 2, 1, 5), lambda x: x["fields"]))
    return s.select("id", F.array_join(F.transform(kept, lambda f: F.concat_ws("=", f["label"], f["value"])), ",").alias("context"))


_PAGE = """'{"blocks": [{"label": "' || repeat('x', CAST(1 + p_size % 45 AS INT)) || '", "bbox": [' || CASE WHEN p_partkey % 5 = 0 THEN '0.9' ELSE '-0.5' END || ', 0.25, ' || CASE p_partkey % 7 WHEN 0 THEN '0.9' WHEN 1 THEN 'null' ELSE '1.5' END || ', 0.75], "lines": ["' || p_name || '", ' || CASE WHEN p_partkey % 9 = 0 THEN 'null' ELSE '"b"' END || ']}]' || CASE WHEN p_partkey % 13 = 0 THEN '' ELSE '}' END"""


@query("""SELECT p_partkey AS id, p_size % 45 < 40 AND p_partkey % 9 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 7 <> 1 AND NOT (p_partkey % 5 = 0 AND p_partkey % 7 = 0) AS kept,
 CASE WHEN p_size % 45 < 40 AND p_partkey % 9 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 7 <> 1 AND NOT (p_partkey % 5 = 0 AND p_partkey % 7 = 0) THEN CASE WHEN p_partkey % 5 = 0 THEN 0.9 ELSE 0.0 END::DOUBLE END AS x0 FROM part""")
def clean_layouts(spark, sf):
    """Page layouts with labels that are too long, boxes without width or sides, missing lines and damaged JSON."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), L.clean_page(F.expr(_PAGE)).alias("p"))
    return p.select("id", F.col("p").isNotNull().alias("kept"), F.col("p.blocks")[0]["bbox"][0].alias("x0"))


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders WHERE o_orderstatus = 'F' QUALIFY place <= 30")
def newest_finished(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("stage"))
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))).cast("long")
    return G.newest_done(df).select("id", place.alias("place"))


@query("(SELECT 'oldest queued' AS what, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1) UNION ALL (SELECT 'latest in progress', o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)")
def queue_ends(spark, sf):
    """The case that is next, and the one that was begun last."""
    stage = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "ocr").otherwise("done")
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), stage.alias("stage"))
    return G.oldest_queued(df).select(F.lit("oldest queued").alias("what"), "id").union(G.latest_in_progress(df).select(F.lit("latest in progress"), "id"))


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS place FROM customer")
def whole_export(spark, sf):
    """Every row in order, numbered in the order in which the file has them."""
    order = [F.col("c_mktsegment").asc(), F.col("c_acctbal").desc(), F.col("c_custkey").asc()]
    rows = G.export(table(spark, sf, "customer"), order)
    return G.numbered(rows, order, "place").select(F.col("c_custkey").alias("id"), "place")


@query("SELECT c_custkey AS id, CASE WHEN v IN ('1', 'true', 'yes') THEN true WHEN v IN ('0', 'false', 'no') THEN false END AS flag FROM (SELECT c_custkey, lower(trim(CASE c_custkey % 8 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN '1' WHEN 3 THEN 'No' WHEN 4 THEN '0' WHEN 5 THEN 'maybe' WHEN 6 THEN '' ELSE c_mktsegment END)) AS v FROM customer)")
def flag_words(spark, sf):
    said = F.expr("CASE c_custkey % 8 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN '1' WHEN 3 THEN 'No' WHEN 4 THEN '0' WHEN 5 THEN 'maybe' WHEN 6 THEN '' ELSE c_mktsegment END")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), G.flag_of(said).alias("flag"))


@query("""WITH a AS (SELECT l_orderkey AS doc, l_linenumber AS id FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), b AS (SELECT l_orderkey AS doc, l_linenumber AS id FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2), n AS (SELECT doc, (SELECT count(*) FROM a WHERE a.doc = d.doc) * (SELECT count(*) FROM b WHERE b.doc = d.doc) AS n FROM (SELECT DISTINCT doc FROM a INTERSECT SELECT DISTINCT doc FROM b) d)
 SELECT doc, a.id AS a, b.id AS b FROM a JOIN b USING (doc) JOIN n USING (doc) WHERE n.n <= 9 UNION ALL SELECT doc, min(a.id), max(b.id) FROM a JOIN b USING (doc) JOIN n USING (doc) WHERE n.n > 9 GROUP BY doc""")
def few_pairs(spark, sf):
    """All pairs of two sides of an order where they are few, else the given best one."""
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"), "l_returnflag").distinct()
    a, b = t.where("l_returnflag = 'A'"), t.where("l_returnflag = 'N'")
    of = lambda flag: F.when(F.col("l_returnflag") == flag, F.col("id"))
    ends = t.groupBy("doc").agg(F.min(of("A")).alias("a"), F.max(of("N")).alias("b")).where("a is not null and b is not null")
    return V.all_or_best(a, b, "doc", ends)


@query("""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^ ]+')[1] AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(0, length(text))) AS i, text FROM t WHERE length(w) > 0)
 SELECT doc_id, bool_or(NOT contains(text[greatest(i - 19, 1):i], 'e') AND contains(text[greatest(i - 29, 1):i + length(w) + 30], 'a')) AS fires FROM p WHERE text[i + 1:i + length(w)] = w GROUP BY doc_id""")
def anchor_gates(spark, sf):
    """Whether a document's first word stands anywhere with no e in the twenty characters before it and an a within thirty."""
    d = table(spark, sf, "documents").withColumn("w", F.regexp_extract("text", "[^ ]+", 0)).where(F.length("w") > 0)
    fires = M.anchor_fires(F.col("text"), F.col("w"), F.array(F.lit("e")), 20, F.array(F.lit("a")), 30)
    return d.select("doc_id", fires.alias("fires"))


@query("SELECT p_partkey AS id, p_size % 2 = 0 OR contains(lower(p_type), lower(split_part(p_name, ' ', 1))) OR contains(lower(p_type), lower(left(p_brand, 2))) AS kept FROM part WHERE kept")
def printed_columns(spark, sf):
    """Columns that are required, or one of whose names the text prints."""
    p = table(spark, sf, "part").withColumns({"required": F.col("p_size") % 2 == 0, "names": F.array(X.fold(F.split("p_name", " ")[0]), X.fold(F.left("p_brand", F.lit(2))), F.lit(""))})
    return A.printed_columns(p, X.fold(F.col("p_type")), "required", "names").select(F.col("p_partkey").alias("id"), F.lit(True).alias("kept"))


@query("SELECT o_orderkey AS id, array_to_string(list_filter(['empty_text', 'not_a_complaint', 'input_truncated'], lambda r: list_contains(n, r) AND NOT list_contains(o, r)), ',') AS unseen FROM (SELECT o_orderkey, [CASE WHEN o_custkey % 2 = 0 THEN 'empty_text' ELSE 'other' END, CASE WHEN o_custkey % 3 = 0 THEN 'not_a_complaint' ELSE 'low' END] AS n, [CASE WHEN o_orderkey % 3 = 0 THEN 'empty_text' ELSE 'x' END] AS o FROM orders)")
def unseen_reasons(spark, sf):
    new = F.expr("array(CASE WHEN o_custkey % 2 = 0 THEN 'empty_text' ELSE 'other' END, CASE WHEN o_custkey % 3 = 0 THEN 'not_a_complaint' ELSE 'low' END)")
    old = F.expr("array(CASE WHEN o_orderkey % 3 = 0 THEN 'empty_text' ELSE 'x' END)")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(C.unseen_reasons(new, old, ["empty_text", "not_a_complaint", "input_truncated"]), ",").alias("unseen"))


@query("""SELECT c_custkey AS id, array_to_string(list_filter(['segment', 'name', 'nation', 'never'], lambda k: k = 'never' OR (k = 'segment' AND c_custkey % 4 = 0) OR (k = 'nation' AND c_nationkey % 3 = 0)), ',') AS missing, CASE WHEN c_custkey % 4 = 0 THEN 'name' ELSE 'segment,name' END || CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE ',nation' END AS present FROM customer""")
def required_fields(spark, sf):
    """Required keys that are absent or empty, and those that are there, in the order of the requirement."""
    field = lambda key, v: F.struct(F.lit(key).alias("key"), v.alias("value"))
    fields = F.array(field("nation", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey").cast("string"))), field("name", F.col("c_name")), field("segment", F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment"))))
    keys = ["segment", "name", "nation", "never"]
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array_join(Q.missing_required(fields, keys), ",").alias("missing"), F.array_join(Q.present_required(fields, keys), ",").alias("present"))


@query("SELECT doc_id, trim(text, ' ') AS scrubbed FROM documents")
def scrubbed_texts(spark, sf):
    """Fences and format characters put around and into documents go."""
    fenced = F.concat(F.lit("```json "), F.left("text", F.lit(7)), F.lit("‏​"), F.substr("text", F.lit(8)), F.lit("```"))
    return table(spark, sf, "documents").select("doc_id", X.scrub(fenced).alias("scrubbed"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'وصف ' || p_size END AS ar, array_to_string(list_filter([p_name, CASE WHEN p_size % 2 = 0 THEN p_type END], lambda x: x IS NOT NULL), ' - ') AS en FROM part")
def bilingual_descriptions(spark, sf):
    """Descriptions in two languages on one line or several."""
    arabic = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("وصف "), F.col("p_size").cast("string")))
    said = F.concat("p_name", F.lit(" – "), arabic, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("\n"), "p_type", F.lit("."))).otherwise(""))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), A.split_description(said).alias("d")).select("id", "d.ar", "d.en")


@query("SELECT c_custkey AS id, greatest(600, 2 * (4096 - 900 - 1200)::BIGINT - 2 * greatest(0, c_custkey % 3000 - 1200))::INT AS room FROM customer")
def document_rooms(spark, sf):
    """Characters of a document that fit beside prompts of every length."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), A.document_room(4096, 900, F.col("c_custkey") % 3000).alias("room"))


_QUEUE = "SELECT o_orderkey AS id, CASE o_custkey % 5 WHEN 0 THEN 'ocr' WHEN 1 THEN 'done' WHEN 2 THEN 'structuring' ELSE 'queued' END AS stage, CAST(o_custkey % 4 AS INT) AS attempts, o_orderdate AS created_at FROM orders"


@query(f"SELECT id, 'ocr' AS stage, attempts + 1 AS attempts FROM ({_QUEUE}) WHERE stage = 'queued' AND attempts < 3 ORDER BY created_at, id LIMIT 40")
def claimed_cases(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return K.claim(spark.sql(_QUEUE), 40).select("id", "stage", "attempts")


@query(f"SELECT id, CASE WHEN stage IN ('ocr', 'structuring') THEN CASE WHEN attempts >= 3 THEN 'error' ELSE 'queued' END ELSE stage END AS stage FROM ({_QUEUE})")
def recovered_cases(spark, sf):
    """What becomes of each case after a stop."""
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return K.recover(spark.sql(_QUEUE)).select("id", "stage")


@query("SELECT 'customer' AS source, count(*) AS n FROM customer WHERE c_nationkey % 3 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 3 = 0)")
def cascade_delete(spark, sf):
    """Customers of some nations go, and their orders with them."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    left = K.without_cases({"customer": (c, "c_custkey"), "orders": (o, "o_custkey")}, c.where("c_nationkey % 3 = 0").select(F.col("c_custkey").alias("id")))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n") for name, df in left.items()]
    return counts[0].union(counts[1])


@query("SELECT doc_id, replace(lower(trim(regexp_replace(text, '[\\s]+', ' ', 'g'), ' ')), 'ß', 'ss') AS folded FROM documents")
def folded_in_sql(spark, sf):
    """The search form as a SQL function of the session."""
    A.register_functions(spark)
    return table(spark, sf, "documents").selectExpr("doc_id", "cms_fold(text) AS folded")


@query("""WITH RECURSIVE t AS (SELECT l_orderkey AS doc, ['name', 'share', 'id', 'date'][CAST(l_quantity AS INT) % 4 + 1] AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS o FROM lineitem),
 r(doc, o, record, seen) AS (SELECT doc, o, 0, [key] FROM t WHERE o = 1 UNION ALL SELECT t.doc, t.o, CASE WHEN list_contains(seen, key) THEN record + 1 ELSE record END, CASE WHEN list_contains(seen, key) THEN [key] ELSE list_append(seen, key) END FROM r JOIN t ON t.doc = r.doc AND t.o = r.o + 1)
 SELECT doc, o::INT AS o, record::INT AS record FROM r""")
def broken_records(spark, sf):
    """Cells of an order as records: a key that comes round again opens the next one."""
    key = F.element_at(F.array(*map(F.lit, ("name", "share", "id", "date"))), F.col("l_quantity").cast("int") % 4 + 1)
    o = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), key.alias("key"), o.alias("o"))
    return S.break_records(t, "doc", "o", "key").select("doc", "o", "record")


@query("""WITH r AS (SELECT p_partkey AS id, ['Firm ' || p_partkey, '70' || (10000000 + p_partkey), '1' || (100000000 + p_partkey), CASE WHEN p_size % 2 = 0 THEN '10-12' ELSE '١٢٣٤٥' END] AS v, p_size FROM part)
 SELECT id, unnest(['number', 'owner', 'deed']) AS field, unnest([v[2], v[3], CASE WHEN p_size % 2 = 1 THEN '12345' ELSE '98765' END]) AS value, unnest([NULL, 'National_ID', NULL]) AS kind FROM r""")
def prefilled_inputs(spark, sf):
    """Inputs of a service from labelled lines: the first rule that fits decides, and the shape of a value counts."""
    pair = lambda label, v: F.struct(F.lit(label).alias("label"), v.alias("value"))
    n = F.col("p_partkey")
    pairs = F.array(
        pair("Company number", F.concat(F.lit("Firm "), n.cast("string"))), pair("Unified NUMBER", F.concat(F.lit("70"), (n + 10000000).cast("string"))), pair("owner identity", F.concat(F.lit("1"), (n + 100000000).cast("string"))),
        pair("deed number", F.when(F.col("p_size") % 2 == 0, "10-12").otherwise("١٢٣٤٥")), pair("old deed", F.lit("98765")),
    )
    rows = table(spark, sf, "part").select(n.alias("id"), F.posexplode(pairs).alias("at", "p")).select("id", "at", "p.label", "p.value")
    rules = [("number", "unified|company", "70[0-9]{8}$"), ("owner", "owner", "[12][0-9]{9}$"), ("deed", "^deed", "[0-9]{5}$"), ("deed", "old", "[0-9]{5}$"), ("none", "absent", ".")]
    found = M.prefill(rows, "id", "at", rules)
    return found.withColumn("kind", F.when(F.col("field") == "owner", M.identity_kind(F.col("value"))))


@query("SELECT doc_id, true AS jeddah, false AS riyadh FROM documents")
def supporting_texts(spark, sf):
    """What may back a place: the letter without its addressee and the entity's own names."""
    letter = F.concat(F.lit("سعادة أمير منطقة الرياض\n"), "text", F.lit("\nحفرة في جدة بإمارة منطقة الرياض"))
    support = P.support_text(letter, F.lit("سعادة أمير منطقة الرياض"), ["إمارة منطقة الرياض"])
    return table(spark, sf, "documents").select("doc_id", F.contains(support, F.lit("جده")).alias("jeddah"), F.contains(support, F.lit("رياض")).alias("riyadh"))


_CLAUSE_EDGES = Q._EDGES.replace("'", "''")


@query(f"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\\n+|\\s*\\|\\s*', chr(1), 'g'), '([.!?؟؛;،,:])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS part FROM documents), w AS (SELECT doc_id, list_filter(string_split_regex(trim(part, '{_CLAUSE_EDGES}'), '\\s+'), lambda x: x <> '') AS w FROM p),
 i AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 10, 1), 10)) AS i FROM w), c AS (SELECT DISTINCT doc_id, trim(array_to_string(w[i + 1:i + 20], ' '), '{_CLAUSE_EDGES}') AS clause FROM i)
 SELECT doc_id, count(*) AS n, max(clause) AS last_clause FROM c WHERE len(string_split(clause, ' ')) >= 3 GROUP BY doc_id""")
def clause_lists(spark, sf):
    """Distinct clauses of every document; long ones as windows of twenty words."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    # counted inside the row, so that no clause is moved or sorted; worked out once under a generator
    c = d.select("doc_id", F.explode(F.array(Q.clauses(F.col("text")))).alias("c")).where(F.size("c") > 0)
    return c.groupBy("doc_id").agg(F.sum(F.size("c")).alias("n"), F.max(F.array_max("c")).alias("last_clause"))


@query("""SELECT o_orderkey AS id, 'المكرم/ة ' || CASE WHEN o_custkey % 4 = 0 THEN 'مقدم الشكوى' ELSE 'Customer ' || o_custkey END || chr(10) || 'السلام عليكم ورحمة الله وبركاته، وبعد:' || chr(10) || chr(10) || 'تلقّت الإمارة ' || CASE WHEN r THEN 'خطابكم' ELSE 'شكواكم' END || ' رقم ' || o_orderkey
 || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' بتاريخ ' || strftime(o_orderdate, '%Y-%m-%d') END || ' بشأن «' || left(repeat('s' || o_orderkey, 60), 120) || '»' || CASE WHEN r THEN '، وسيُطّلع عليه.' ELSE '، وقد أحالتها إلى ' || CASE WHEN o_custkey % 5 = 0 THEN 'الجهة المختصة' ELSE 'Desk ' || o_custkey % 9 END
 || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ' بأولوية ' || o_orderpriority || '، ونتوقع الرد خلال ' || o_custkey % 7 || ' days' END || '.' END || chr(10) || CASE WHEN r THEN 'ونأمل ذكر رقمه في أي تواصل لاحق.' ELSE 'وسنوافيكم بما يستجد بشأنها، ونأمل ذكر رقم الشكوى في أي تواصل لاحق.' END || chr(10) || chr(10)
 || CASE WHEN r THEN 'شاكرين لكم تواصلكم، وتقبلوا خالص التحية والتقدير.' ELSE 'شاكرين لكم تواصلكم وحرصكم، وتقبلوا خالص التحية والتقدير.' END || chr(10) || 'مكتب الشكاوى — الإمارة' AS letter FROM (SELECT *, o_totalprice < 50000 AS r FROM orders)""")
def reply_letters(spark, sf):
    """Replies to every case: receipts, letters on to a desk, with and without a name, a date, a priority and a term."""
    text = lambda c: c.cast("string")
    letter = A.letter(
        F.when(F.col("o_custkey") % 4 == 0, " ").otherwise(F.concat(F.lit("Customer "), text(F.col("o_custkey")))), text(F.col("o_orderkey")), F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.repeat(F.concat(F.lit("s"), text(F.col("o_orderkey"))), F.lit(60)), "الإمارة", "مكتب الشكاوى", F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("Desk "), text(F.col("o_custkey") % 9))),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")), F.concat(text(F.col("o_custkey") % 7), F.lit(" days")), F.col("o_totalprice") < 50000,
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), letter.alias("letter"))


_LABELLED = "SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS place, CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'name of heir' WHEN 1 THEN 'name of deceased' WHEN 2 THEN 'id' WHEN 3 THEN 'id' ELSE 'other' END AS label, CASE WHEN l_orderkey % 9 = 0 THEN 'estate' ELSE '' END AS section FROM lineitem"


@query(f"""WITH l AS ({_LABELLED}), e AS (SELECT doc, section, place, CASE label WHEN 'name of heir' THEN 'heir' ELSE 'dead' END AS role FROM l WHERE label LIKE 'name%'),
 n AS (SELECT l.doc, l.place, e.role, row_number() OVER (PARTITION BY l.doc, l.place ORDER BY abs(e.place - l.place), e.place > l.place) AS rn FROM l JOIN e ON e.doc = l.doc AND e.section = l.section WHERE l.label = 'id')
 SELECT l.doc, l.place::INT AS place, CASE WHEN label = 'name of heir' THEN 'heir_name' WHEN label = 'name of deceased' THEN 'dead_name' WHEN label = 'id' AND section = 'estate' THEN 'dead_id' WHEN label = 'id' THEN n.role || '_id' END AS key FROM l LEFT JOIN n ON n.doc = l.doc AND n.place = l.place AND n.rn = 1""")
def role_votes(spark, sf):
    """Labels that several roles share, settled by the heading or by the nearest label of one role; the one before wins a tie."""
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    aliases = [("name of heir", "heir_name", "heirs", "heir", False), ("name of deceased", "dead_name", "estate", "dead", False), ("id", "heir_id", "heirs", "heir", True), ("id", "dead_id", "estate", "dead", True)]
    a = spark.createDataFrame(aliases, "alias string, key string, section string, role string, shared boolean")
    return A.vote_roles(spark.sql(_LABELLED), a, "doc", "place").select("doc", F.col("place").cast("int").alias("place"), "key")


_COSINE = "round(list_inner_product(CAST(p.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) / sqrt(list_inner_product(CAST(p.v AS DOUBLE[]), CAST(p.v AS DOUBLE[]))) / sqrt(list_inner_product(CAST(c.v AS DOUBLE[]), CAST(c.v AS DOUBLE[]))), 6)"


@query(f"""WITH e AS (SELECT vec_id AS id, embedding AS v, 'w' || vec_id % 5 AS a, 'w' || vec_id % 3 AS b FROM embeddings), p AS (SELECT * FROM e WHERE id % 4 = 0), c AS (SELECT * FROM e WHERE id % 4 <> 0),
 s AS (SELECT p.id AS passage, p.id % 10 AS doc, c.id AS clause, {_COSINE} AS cosine, 0.12 * len(list_intersect([c.a, c.b], [p.a, p.b])) / len(list_distinct([c.a, c.b])) AS lexical, p.a = c.a AND p.b = c.b AS exact FROM p, c),
 k AS (SELECT *, row_number() OVER (PARTITION BY passage ORDER BY cosine DESC, clause) AS rn FROM s), g AS (SELECT *, cosine + least(lexical, 0.12) AS score FROM k WHERE rn <= 50), h AS (SELECT * FROM g WHERE exact OR (cosine >= 0.5 AND score >= 0.6))
 SELECT doc, clause, CAST(floor(max(score) * 10000 + 0.5) AS BIGINT) AS score, count(*) AS n FROM h GROUP BY 1, 2""")
def retrieved_clauses(spark, sf):
    """Clauses that passages call up by cosine and shared words, and how many passages of a document do."""
    words = F.array(F.concat(F.lit("w"), (F.col("vec_id") % 5).cast("string")), F.concat(F.lit("w"), (F.col("vec_id") % 3).cast("string")))
    e = V.unit_vectors(table(spark, sf, "embeddings"), "embedding").select("vec_id", F.col("embedding").alias("v"), words.alias("words"))
    passages = e.where("vec_id % 4 = 0").select((F.col("vec_id") % 10).alias("doc"), F.col("vec_id").alias("passage"), "words", "v")
    found = A.retrieved(passages, e.where("vec_id % 4 != 0").select(F.col("vec_id").alias("clause"), "words", "v"))
    return found.select("doc", "clause", F.floor(F.col("score") * 10000 + 0.5).alias("score"), "n")
