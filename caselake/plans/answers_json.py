"""Queries of answers as VARIANT; the JSON texts are written from columns of whole tables, and the oracles answer from the columns or with another engine's JSON walk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import variants as V
from ..session import spread, table
from .checks import query_into

QUERIES, ORACLES = {}, {}
query = query_into(QUERIES, ORACLES)

#: A contract answer of each order, in SQL of either engine: one party or a list with a stray text, numbers as numbers or texts, placeholders, damaged answers.
_PARTY = """'{"name": " Owner ' || k || '-' || %d || ' ", "typeName": "string", "identity": {"id": "10' || (10000000 + k * 7 + %d) || '", "typeName": "ID"}, "nationality": {"name": "N' || k %% 7 || '"},
 "partnership": [{"name": "role"}, {"name": ""}, 5], "partnerShare": {"cashContributionCount": ' || k %% 50 || '}' || CASE WHEN k %% 6 = 0 THEN ', "guardian": {"name": "G' || k || '", "isFatherGuardian": true}' ELSE '' END || '}'"""
ANSWER = f"""CASE WHEN k % 50 = 0 THEN '{{"entity": {{"name": "x"' WHEN k % 50 = 1 THEN '{{"articles": []}}' ELSE
'{{"contractCopyNumber": ' || k || ', "contractDate": "2024-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR(2)), 2, '0') || '", "entity": {{"crNationalNumber": "70' || (10000000 + k) || '", "crNumber": ' ||
CASE WHEN k % 2 = 0 THEN '1010' || (100000 + k % 900000) ELSE '" 1010' || (100000 + k % 900000) || ' "' END || ', "name": "Firm ' || k || repeat(' long', CAST(k % 90 AS INT)) || '", "companyDuration": ' ||
CASE k % 4 WHEN 0 THEN '"ten"' WHEN 1 THEN '99' WHEN 2 THEN '12.50' ELSE 'true' END || ', "isLicenseBased": ' || CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"yes"' ELSE 'false' END ||
CASE WHEN k % 5 = 0 THEN ', "capital": {{"currencyName": "SAR", "contributionCapital": {{"cashCapital": ' || c || ', "typeName": "string"}}, "stockCapital": {{}}}}' ELSE ', "capital": []' END ||
CASE WHEN k % 3 = 0 THEN ', "fiscalYear": {{"endYear": 2024, "endMonth": "' || (k % 12 + 1) || '", "endDay": 3, "isFirst": false}}' ELSE '' END ||
', "parties": ' || CASE k % 4 WHEN 0 THEN {_PARTY % (0, 0)} WHEN 1 THEN '[]' WHEN 2 THEN 'null' ELSE '["stray", ' || {_PARTY % (1, 1)} || ', ' || {_PARTY % (2, 2)} || ']' END ||
', "activities": [{{"id": ' || k % 100 || ', "name": "act"}}, {{"id": 1}}]}}, "articles": [{{"partName": "P", "text": "call 05' || (10000000 + k) || ' now"}}, {{"text": " "}}], "setAsideDetails": {{"isSetAsideEnabled": ' ||
CASE WHEN k % 7 = 0 THEN 'true' ELSE 'false' END || ', "profitAllocation": {{"percentage": 10}}}}}}' END"""


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


@query("""WITH t AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), p AS (SELECT k, c, k % 50 > 1 AS ok, CASE k % 4 WHEN 0 THEN [0] WHEN 3 THEN [1, 2] ELSE [] END AS who FROM t)
 SELECT k AS id, ok AS shaped, CASE WHEN ok THEN k::VARCHAR END AS copy_number, CASE WHEN ok THEN '2024-01-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') END AS date, CASE WHEN ok THEN '70' || (10000000 + k) END AS national_number,
 CASE WHEN ok THEN '1010' || (100000 + k % 900000) END AS cr_number, CASE WHEN ok THEN CASE WHEN length(n) > 300 THEN n[1:300] || '…' ELSE n END END AS name, CASE WHEN ok THEN CASE k % 4 WHEN 1 THEN '99' WHEN 2 THEN '12.5' ELSE '' END END AS duration,
 CASE WHEN ok AND k % 3 <> 1 THEN k % 3 = 0 END AS license_based, CASE WHEN ok AND k % 5 = 0 THEN c::VARCHAR END AS cash, ok AND k % 5 = 0 AS contributed, CASE WHEN ok AND k % 3 = 0 THEN '2024/' || lpad((k % 12 + 1)::VARCHAR, 2, '0') || '/03' END AS year_end,
 CASE WHEN ok THEN array_to_string(list_transform(who, lambda i: 'Owner ' || k || '-' || i || ' ••••••' || right((10000000 + k * 7 + i)::VARCHAR, 4) || ' N' || k % 7 || ' role ' || k % 50 || CASE WHEN k % 6 = 0 THEN ' G' || k ELSE '' END), '; ') END AS parties,
 CASE WHEN ok THEN k % 100 || ' act' END AS activities, CASE WHEN ok THEN 'call ' || repeat('•', 2 + length((10000000 + k)::VARCHAR) - 4) || right((10000000 + k)::VARCHAR, 4) || ' now' END AS articles, CASE WHEN ok AND k % 7 = 0 THEN '10' END AS set_aside
 FROM (SELECT *, 'Firm ' || k || repeat(' long', k % 90) AS n FROM p)""")
def contract_shapes(spark, sf):
    """Contract answers held to their shape: coerced lists, masks, cuts and typed readers."""
    s = V.contracts(spread(_orders(spark, sf)).select("k", F.expr(ANSWER).alias("answer")), "answer", "s")
    party = lambda p: F.concat_ws(" ", p["name"], p["id_masked"], p["nationality"], F.array_join(p["roles"], ","), p["cash_shares"], p["guardian"]["name"])
    return s.select(
        F.col("k").alias("id"), F.col("s").isNotNull().alias("shaped"), "s.contract.copy_number", "s.contract.date", "s.entity.national_number", "s.entity.cr_number", "s.entity.name", "s.entity.duration", "s.entity.license_based",
        F.col("s.capital.contribution.cash").alias("cash"), F.coalesce(F.col("s.capital.contribution").isNotNull(), F.lit(False)).alias("contributed"), F.col("s.fiscal_year.end").alias("year_end"),
        F.when(F.col("s").isNotNull(), F.array_join(F.transform("s.parties", party), "; ")).alias("parties"), F.array_join(F.transform("s.activities", lambda a: F.concat_ws(" ", a["code"], a["name"])), "; ").alias("activities"),
        F.array_join(F.transform("s.articles", lambda a: a["text"]), "; ").alias("articles"), F.col("s.profit_set_aside.pct").alias("set_aside"),
    )


#: A view tree of each order.
VIEW = """'[{"type": "group", "label": "Order", "children": [{"type": "field", "label": "Number", "value": ' || k || '}, {"type": "group", "label": "Client", "children": [{"type": "field", "label": " the  key ", "value": " c ' || c || ' "},
 {"type": "field", "label": "Empty", "value": null}]}]}, {"type": "list", "label": "Acts", "items": ["a' || k % 3 || '", 7, true]}, {"type": "table", "label": "Owners", "columns": ["Name", "Share"], "rows": [["Ali", 0.' || (k % 9 + 1) || '], ["Sara"], "odd"]},
 {"type": "cards", "items": [' || CASE WHEN k % 2 = 0 THEN '{"type": "group", "label": "Card (1)", "children": [{"type": "field", "label": "X", "value": "' || c % 10 || '"}]}' ELSE '[{"type": "field", "label": "Y", "value": "y"}]' END || ']}, "stray"' || CASE WHEN k % 40 = 0 THEN '' ELSE ']' END"""


@query("""WITH t AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey % 40 <> 0)
 SELECT k AS id, unnest(range(1, 8)) AS line, unnest(['Order - Number', 'Order - Client - the key', 'Acts', 'Owners 1 - Name', 'Owners 1 - Share', 'Owners 2 - Name', CASE WHEN k % 2 = 0 THEN 'Card (1) - X' ELSE 'Y' END]) AS label,
 unnest([k::VARCHAR, 'c ' || c, 'a' || k % 3 || '، 7، True', 'Ali', '0.' || (k % 9 + 1), 'Sara', CASE WHEN k % 2 = 0 THEN (c % 10)::VARCHAR ELSE 'y' END]) AS value FROM t""")
def view_tree_lines(spark, sf):
    """View trees as the lines that a page shows."""
    return V.view_lines(_orders(spark, sf).select("k", F.expr(VIEW).alias("v")), "k", "v").select(F.col("k").alias("id"), F.col("line").cast("long").alias("line"), "label", "value")


#: A nested value of each event, of changing shape.
NESTED = """'{"id": ' || event_id || ', "props": ' || props || ', "user": {"id": ' || CASE WHEN user_id % 3 = 0 THEN '"u' || user_id || '"' ELSE CAST(user_id AS VARCHAR(20)) END || CASE WHEN user_id % 4 = 0 THEN ', "vip": true' ELSE '' END ||
 '}, "tags": [' || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '"a", 1' WHEN 2 THEN '{"n": "x", "m": [1, [2]]}, {"n": null}' ELSE '[]' END || ']' || CASE WHEN event_id % 5 = 0 THEN ', "extra": null' ELSE '' END || '}'"""
_WALK = f"(SELECT event_id AS id, regexp_replace(regexp_replace(fullkey, '^\\$\\.?', ''), '\\[[0-9]+\\]', '[]', 'g') AS path, type, atom, fullkey FROM (SELECT event_id, {NESTED.replace('%', '%')} AS j FROM events), json_tree(j))"
_KIND = "CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"


def _events(spark, sf):
    e = spread(table(spark, sf, "events").select("event_id", "user_id", "props"))
    return e.select(F.col("event_id").alias("id"), F.try_parse_json(F.expr(NESTED)).alias("v"))


@query(f"""SELECT id, path, {_KIND} AS kind, CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL', 'BOOLEAN') THEN '' ELSE trim(atom::VARCHAR, '"') END AS value FROM {_WALK}""")
def answer_paths(spark, sf):
    """Every value of a nested answer with its path and kind."""
    return V.nodes(_events(spark, sf), "id", "v").select("id", "path", "kind", V.scalar(F.col("value")).alias("value"))


@query(f"""WITH w AS (SELECT *, regexp_replace(path, '(\\[\\]|\\.[^.\\[]*|^[^.\\[]*)$', '') AS parent, regexp_extract(fullkey, '\\[([0-9]+)\\]$', 1) AS i FROM {_WALK}),
 b AS (SELECT path, any_value(parent) AS parent, count(*) AS times, count(*) FILTER (i = '0') AS firsts, count(*) FILTER (type = 'OBJECT') AS objects, count(*) FILTER (type = 'ARRAY') AS lists, string_agg(DISTINCT {_KIND}, ',' ORDER BY {_KIND}) AS kinds FROM w GROUP BY path)
 SELECT b.path, CASE WHEN b.path LIKE '%[]' THEN firsts ELSE times END AS n, CASE WHEN b.path = '' THEN times WHEN b.path LIKE '%[]' THEN o.lists ELSE o.objects END AS of, b.kinds
 FROM b LEFT JOIN (SELECT path AS parent, objects, lists FROM b) o USING (parent)""")
def nested_profile(spark, sf):
    """How often each path of a nested answer is there, of how many, and the kinds of its values."""
    return V.profile(_events(spark, sf), "v")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 < 2 THEN 'old' || o_orderkey || ',again' END AS reasons FROM orders""")
def review_reason_arrays(spark, sf):
    """Reasons of an analysis where they are a list; damaged texts and other kinds give none."""
    text = F.expr("""CASE k % 5 WHEN 0 THEN '{"a": 1, "review_reasons": ["old' || k || '", "again"]}' WHEN 1 THEN '{"review_reasons": ["old' || k || '", "again"], "z": {}}' WHEN 2 THEN '{"review_reasons": "old"}' WHEN 3 THEN '{"review_reasons": ["cut"' ELSE '[]' END""")
    return _orders(spark, sf).select(F.col("k").alias("id"), F.array_join(V.array_or_null(text, "review_reasons"), ",").alias("reasons"))


@query("""WITH t AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders) SELECT k AS id, unnest(['cityId', 'cityName', 'id', 'mail', 'note', 'n', 'n', 'flag']) AS key, unnest(['City id', 'المدينة', 'Id', 'Mail', 'Note', 'N', 'N', 'Flag']) AS label,
 unnest([(c % 9)::VARCHAR, 'Town ' || c, repeat('•', length((1000000000 + k)::VARCHAR) - 4) || right((1000000000 + k)::VARCHAR, 4), 'a•••@x' || c || '.org', 'please call ' || repeat('•', 1 + length((10000 + c)::VARCHAR)) || right((10000 + c)::VARCHAR, 4) || ' now', '1', '2', CASE WHEN k % 2 = 0 THEN 'نعم' ELSE 'لا' END]) AS value, unnest(['', '', '', '', '', '/items.1', '/items.2', '']) AS record FROM t""")
def answer_display(spark, sf):
    """Register answers as rows that may be shown: labels, masks, and flags in words."""
    text = F.expr("""'{"identity": {"id": "' || (1000000000 + k) || '"}, "mail": "ab' || k || '@x' || c || '.org", "cityId": ' || c % 9 || ', "cityName": "Town ' || c || '", "note": "please call 05599' || (10000 + c) || ' now", "items": [{"n": 1}, {"n": "2"}], "flag": ' ||
 CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ', "none": null, "kind": "string", "deep": {}}'""")
    rows = L.answer_rows(_orders(spark, sf).select("k", text.alias("j")), "k", "j")
    labels = spark.createDataFrame([("cityName", "المدينة")], "path string, label string")
    return L.display_rows(rows, labels).select(F.col("k").alias("id"), "key", "label", "value", "record")
