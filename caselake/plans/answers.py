"""Queries of register answers, derivations, intake and geometry; cases and numbers come from the tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..operators import answers as A
from ..operators import gazetteer as P
from ..operators import matching as M
from ..operators import register as G
from ..operators import segment as S
from ..session import table
from ..sources import intake as I
from ..streaming import cases as Q
from .checks import _pick, _rows

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _by_case(cases: list[tuple], columns: str, key: str = "o_orderkey", source: str = "orders") -> str:
    """SQL that gives each row of a table the stated answer of its case."""
    return f"SELECT {key} AS id, {columns} FROM {source} JOIN {_rows(cases)} t(way, {columns}) ON {key} % {len(cases)} = way"


NUMBERS = (("٧٠٠ ١٢٣ ٤٥٦٧", "7001234567", "unified"), ("1010-123.456", "1010123456", "cr"), ("12345", None, None), ("70012345ab", None, None), ("9010123456", None, None))


@query(_by_case([n[1:] for n in NUMBERS], "digits, kind"))
def number_kinds(spark, sf):
    k = A.number_kind(_pick("o_orderkey", [n[0] for n in NUMBERS]))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), k["digits"].alias("digits"), k["kind"].alias("kind"))


LABELS = (("الاسم", "الوارث", "اسم الوارث"), ("رقم الهوية", "الوارث", "رقم هوية الوارث"), ("الرقم الموحد", "الوارث", "الرقم الموحد للوارث"), ("رقم السجل التجاري", "ولي الزوجة", "رقم السجل التجاري لولي الزوجة"), ("", "الزوج", "الزوج"))


@query(_by_case([(x[2],) for x in LABELS], "label"))
def role_labels(spark, sf):
    label = A.role_label(_pick("o_orderkey", [x[0] for x in LABELS]), _pick("o_orderkey", [x[1] for x in LABELS]))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), label.alias("label"))


# A correction's region and town, the old ones, and what becomes of it: refused, region, town.
CORRECTIONS = (
    (None, "kharj", "makkah", "unknown", False, "riyadh", "kharj"), ("makkah", None, "riyadh", "kharj", False, "makkah", "unknown"), ("makkah", "kharj", "makkah", "unknown", True, "makkah", None),
    ("unknown", "kharj", "riyadh", "kharj", True, "unknown", None), ("unknown", None, "riyadh", "kharj", False, "unknown", "unknown"), ("riyadh", "kharj", "makkah", "unknown", False, "riyadh", "kharj"), (None, None, "riyadh", "kharj", False, None, None),
)


@query(_by_case([c[4:] for c in CORRECTIONS], "refused, region, town"))
def coupled_corrections(spark, sf):
    c = P.couple(*[_pick("o_orderkey", [x[k] for x in CORRECTIONS]) for k in range(4)], "riyadh")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), c.alias("c")).select("id", "c.*")


# Hexadecimal content, name, stated type, kind and extension, and what recognition takes it for.
UPLOADS = (
    ("255044462d312e37", "x", "", "pdf", "pdf", "pdf"), ("125504446 2d1".replace(" ", "0"), "x", "", None, None, None), ("5249464600000000574542505650", "x", "", "image", "webp", "image"), ("0a0a255044462d", "a.PDF", "", "pdf", "pdf", "pdf"),
    ("0a0a255044462d", "a.bin", "", None, None, None), ("6869", "x", "text/plain; charset=x", "txt", "txt", None), ("89504e470d0a1a0a", "", "", "image", "png", "image"), ("ffd8ffe0", "", "", "image", "jpg", "image"), ("424d", "x", "", None, None, "image"), ("00", "b.txt", "", "txt", "txt", None),
)


@query(_by_case([u[3:] for u in UPLOADS], "kind, extension, readable"))
def upload_kinds(spark, sf):
    content, name, said = (_pick("o_orderkey", [u[k] for u in UPLOADS]) for k in range(3))
    k = I.kind_of(F.unhex(content), name, said)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), k["kind"].alias("kind"), k["extension"].alias("extension"), I.readable_kind(F.unhex(content), name).alias("readable"))


# Outcome, tries, reloaded, attempts of a run; the next stage, tries, reloaded, and whether it waits.
RUNS = (("ok", 0, False, 1, "done", 0, False, None), ("busy", 1, False, 1, "queued", 2, False, True), ("busy", 3, False, 3, "queued", 3, True, False), ("busy", 3, True, 3, "error", 3, True, None), ("failed", 0, False, 2, "queued", 0, False, False), ("failed", 0, False, 3, "error", 0, False, None))


@query(_by_case([r[4:] for r in RUNS], "stage, tries, was_reloaded, waits"))
def runs_settled(spark, sf):
    outcome, tries, reloaded, attempts = (_pick("o_orderkey", [r[k] if isinstance(r[k], str) else str(r[k]).lower() for r in RUNS]) for k in range(4))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), outcome.alias("outcome"), tries.cast("int").alias("busy_tries"), reloaded.cast("boolean").alias("reloaded"), attempts.cast("int").alias("attempts"))
    now = F.lit("2026-01-01").cast("timestamp")
    return Q.after_run(runs, now).select("id", "stage", "tries", "was_reloaded", (F.col("not_before") > now).alias("waits"))


@query("""SELECT o_orderkey AS id, o_orderkey % 2 = 1 AS reviewed, (o_orderkey % 3)::INT AS pending_fields, CASE WHEN o_orderkey % 3 = 0 THEN 'low_confidence' ELSE 'low_confidence,fields_unverified' END AS reasons,
 CASE o_orderkey % 4 WHEN 0 THEN false WHEN 1 THEN true ELSE false END AS outside_jurisdiction, CASE WHEN o_orderstatus <> 'F' THEN '' WHEN o_orderkey % 2 = 1 AND o_orderpriority <> '2-HIGH' THEN 'تعديل المراجع'
 WHEN o_orderkey % 5 = 0 THEN 'رفعتها القواعد' ELSE 'تقدير النموذج' END AS set_by FROM orders""")
def register_summary(spark, sf):
    """The list's derivations: flags, the answered reason, the place of a case, and what set its priority."""
    k = F.col("o_orderkey")
    region = F.element_at(F.array(F.lit("riyadh"), F.lit("makkah"), F.lit("unknown"), F.lit(None)), (k % 4 + 1).cast("int"))
    o = table(spark, sf, "orders").select(
        k.alias("id"), region.alias("region"), (k % 3).alias("pending_fields"), F.array(F.lit("low_confidence"), F.lit("fields_unverified")).alias("review_reasons"), F.lit(1).alias("needs_review"), (k % 2).alias("reviewed"),
        F.when(F.col("o_orderstatus") == "F", "done").otherwise("ocr").alias("stage"), F.col("o_orderpriority").alias("priority"), F.lit("2-HIGH").alias("model_priority"), F.when(k % 5 == 0, "rule_floor").otherwise("llm").alias("source"),
    )
    set_by = G.priority_source(F.col("stage"), F.col("reviewed"), F.col("priority"), F.col("model_priority"), F.col("source"))
    return G.summary(o, "riyadh").select("id", "reviewed", "pending_fields", F.array_join("review_reasons", ",").alias("reasons"), "outside_jurisdiction", set_by.alias("set_by"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'typed' ELSE o_clerk END AS a, o_orderkey % 2 = 1 AND o_clerk <> '' AS a_open, o_orderstatus AS b, o_orderkey % 3 = 0 AS b_open FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS o_clerk FROM orders)""")
def merged_fields(spark, sf):
    """Two fields of each order, the first reviewed for even keys; open are unverified ones with a value and no review."""
    k = F.col("o_orderkey")
    field = lambda key, value, ok: F.struct(F.lit(key).alias("key"), value.alias("value"), ok.alias("verified"))
    first = F.when(k % 5 == 0, "").otherwise(F.col("o_orderpriority"))
    fields = F.array(field("a", first, F.lit(False)), field("b", F.col("o_orderstatus"), F.when(k % 3 == 0, False)))
    reviews = F.when(k % 2 == 0, F.create_map(F.lit("a"), F.struct(F.lit("typed").alias("value"), F.lit("edit").alias("action")))).otherwise(F.expr("cast(map() as map<string,struct<value:string,action:string>>)"))
    m = table(spark, sf, "orders").select(k.alias("id"), G.merged_fields(fields, reviews).alias("m"))
    return m.select("id", F.col("m")[0]["value"].alias("a"), F.col("m")[0]["pending"].alias("a_open"), F.col("m")[1]["value"].alias("b"), F.col("m")[1]["pending"].alias("b_open"))


@query("""WITH p AS (SELECT l_orderkey AS doc, l_suppkey % 3 AS clause, l_linenumber AS passage, 0.45 + l_discount AS cosine, l_tax AS lexical, l_quantity > 48 AS exact FROM lineitem),
 g AS (SELECT *, cosine + least(lexical, 0.12) AS score FROM p), q AS (SELECT * FROM g WHERE exact OR (cosine >= 0.5 AND score >= 0.6))
 SELECT doc, CAST(clause AS BIGINT) AS clause, CAST(round(max(score) * 1000) AS BIGINT) AS score, count(*) AS n FROM q GROUP BY 1, 2""")
def qualifying_clauses(spark, sf):
    p = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 3).cast("long").alias("clause"), F.col("l_linenumber").alias("passage"), (0.45 + F.col("l_discount")).alias("cosine"), F.col("l_tax").alias("lexical"), (F.col("l_quantity") > 48).alias("exact")
    )
    return A.qualifying_clauses(p, "doc").select("doc", "clause", F.round(F.col("score") * 1000).cast("long").alias("score"), "n")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'cityName,name,paid' ELSE 'cityName,id,name,paid' END AS keys FROM customer""")
def codes_beside_names(spark, sf):
    """A code goes beside its name, a short id beside a plain name; a long id and a word that ends like a code stay."""
    k = F.col("c_custkey")
    row = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    cells = F.array(row("cityId", F.lit("3")), row("cityName", F.lit("Riyadh")), row("id", F.when(k % 2 == 0, "12").otherwise("1023456789")), row("name", F.lit("x")), row("paid", F.lit("1")))
    rows = table(spark, sf, "customer").select(k.alias("id"), F.explode(cells).alias("c")).select("id", "c.*")
    return A.without_codes(rows, "id").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"))


@query("""SELECT l_orderkey AS page, l_linenumber % 2 AS line, string_agg(l_returnflag, ' ' ORDER BY l_partkey, l_suppkey, l_returnflag) AS text, min(l_partkey) AS x0, max(l_partkey + 10) AS x1, round_even(avg(CASE WHEN l_quantity >= 10 THEN l_quantity END), 2) AS conf
 FROM lineitem GROUP BY 1, 2""")
def recognised_lines(spark, sf):
    """Words of a page to lines, with hull and mean confidence; negative confidence does not count."""
    l = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.lit(1).alias("block"), F.lit(1).alias("par"), (F.col("l_linenumber") % 2).alias("line"), F.struct("l_partkey", "l_suppkey").alias("word"), F.col("l_partkey").alias("left"), F.lit(0).alias("top"),
        F.lit(10).alias("width"), F.lit(5).alias("height"), F.when(F.col("l_quantity") >= 10, F.col("l_quantity")).otherwise(-1.0).alias("conf"), F.col("l_returnflag").alias("text"),
    )
    return I.ocr_lines(l).select("page", "line", "text", "x0", "x1", "conf")


@query("""WITH b AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey % 120 - 10 AS x0, l_suppkey % 90 AS y0, l_partkey % 120 - 10 + l_quantity - 5 AS x1, l_suppkey % 90 + l_quantity AS y1 FROM lineitem)
 SELECT id, n, CASE WHEN x1 > x0 THEN CAST(round(greatest(0, least(1, x0 / 100.0)) * 100) AS BIGINT) END AS x0, CASE WHEN x1 > x0 THEN CAST(round(greatest(0, least(1, y1 / 100.0)) * 100) AS BIGINT) END AS y1 FROM b""")
def boxes_in_pages(spark, sf):
    l = table(spark, sf, "lineitem")
    x0, y0 = F.col("l_partkey") % 120 - 10, F.col("l_suppkey") % 90
    box = I.page_fractions(x0, y0, x0 + F.col("l_quantity") - 5, y0 + F.col("l_quantity"), F.lit(100), F.lit(100))
    d = l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), box.alias("b"))
    return d.select("id", "n", F.round(F.col("b")[0] * 100).cast("long").alias("x0"), F.round(F.col("b")[3] * 100).cast("long").alias("y1"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'يوم واحد' WHEN 1 THEN 'يومان' WHEN 2 THEN CAST(o_orderkey % 8 + 3 AS VARCHAR) || ' أيام' ELSE CAST(o_orderkey % 50 + 11 AS VARCHAR) || ' يوما' END AS term,
 CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE least(1.0, (o_orderkey % 300) / 200.0) END AS share FROM orders""")
def counted_terms(spark, sf):
    """Arabic agreement of a number with its noun; shares from text, held within 0 and 1."""
    k = F.col("o_orderkey")
    n = F.when(k % 4 == 0, 1).when(k % 4 == 1, 2).when(k % 4 == 2, k % 8 + 3).otherwise(k % 50 + 11)
    term = X.counted_noun(n, "يوم واحد", "يومان", "أيام", "يوما")
    return table(spark, sf, "orders").select(k.alias("id"), term.alias("term"), D.clamp01(F.when(k % 3 == 0, "none").otherwise(((k % 300) / 200).cast("string"))).alias("share"))


@query("SELECT c_custkey AS id, levenshtein(c_name, reverse(c_name) || c_mktsegment) AS edits FROM customer")
def name_distances(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), S.edit_distance(F.col("c_name"), F.concat(F.reverse("c_name"), F.col("c_mktsegment"))).cast("long").alias("edits"))


@query("""WITH t AS (SELECT doc_id, text || 'erere' AS text FROM documents), c AS (SELECT doc_id, generate_subscripts(string_split(text, ''), 1) - 1 AS i, unnest(string_split(text, '')) AS ch FROM t),
 w AS (SELECT doc_id, i, ch || lead(ch, 1) OVER (PARTITION BY doc_id ORDER BY i) || lead(ch, 2) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM c)
 SELECT doc_id, count(*) AS n, min(i)::INT AS first FROM w WHERE s = 'ere' GROUP BY doc_id""")
def literal_places(spark, sf):
    """Overlapping occurrences of a literal in whole texts."""
    d = table(spark, sf, "documents").select("doc_id", M.find_all(F.concat("text", F.lit("erere")), F.lit("ere")).alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("n"), F.coalesce(F.try_element_at("p", F.lit(1)), F.lit(-1)).alias("first"))


@query("SELECT doc_id, length(t) + len(list_filter(string_split(t, ''), lambda c: unicode(c) > 65535)) AS units FROM (SELECT doc_id, text || '😀x' AS t FROM documents)")
def utf16_places(spark, sf):
    t = F.concat("text", F.lit("😀x"))
    return table(spark, sf, "documents").select("doc_id", X.utf16_offset(t, F.length(t)).alias("units"))
