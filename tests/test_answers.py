"""Register answers, roles, labels, letters and retrieval against stated cases."""

import json
import random

from pyspark.sql import functions as F

from caselake.functions import text
from caselake.operators import answers as A
from caselake.operators import citation, cleaning, gazetteer, layout, segment, variants


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_number_kinds(spark):
    rows = [("٧٠٠ ١٢٣ ٤٥٦٧", "7001234567", "unified"), ("７００1234567", "7001234567", "unified"), ("1010-123.456", "1010123456", "cr"), ("12345", None, None), ("70012345ab", None, None), (None, None, None), ("9010123456", None, None)]
    df = spark.createDataFrame(rows, "raw string, digits string, kind string").withColumn("got", A.number_kind(F.col("raw")))
    assert df.where(~F.col("got.digits").eqNullSafe(F.col("digits")) | ~F.col("got.kind").eqNullSafe(F.col("kind"))).count() == 0


def test_register_trees(spark):
    tree = [
        {"type": "group", "label": "City", "children": [{"type": "field", "label": "Name", "value": "Riyadh"}, {"type": "field", "label": "Empty", "value": ""}]}, {"type": "list", "label": "Acts", "items": ["a", "b"]},
        {"type": "table", "label": "Owners", "columns": ["Name", "Share"], "rows": [["Ali", 0.5], ["Sara", None]]}, {"type": "cards", "items": [{"type": "group", "label": "Card (1)", "children": [{"type": "field", "label": "X", "value": 1}]}]},
    ]
    got = variants.view_lines(spark.createDataFrame([(1, json.dumps(tree)), (2, "broken"), (3, None)], "doc int, v string"), "doc", "v").orderBy("doc", "line").collect()
    want = [("City - Name", "Riyadh"), ("Acts", "a، b"), ("Owners 1 - Name", "Ali"), ("Owners 1 - Share", "0.5"), ("Owners 2 - Name", "Sara"), ("Card (1) - X", "1")]
    assert [tuple(r) for r in got] == [(1, i, *x) for i, x in enumerate(want, 1)]
    many = [{"type": "cards", "items": [{"type": "group", "label": f"c{i}", "children": [{"type": "field", "label": "deep", "value": variants.DEEPER}, *({"type": "field", "label": str(j), "value": f" a  b{j}"} for j in range(9))]} for i in range(12)]}]
    got = variants.view_lines(spark.createDataFrame([(1, json.dumps(many))], "doc int, v string"), "doc", "v").orderBy("line").collect()
    assert [(r["label"], r["value"]) for r in got] == [(f"c{i} - {j}", f"a b{j}") for i in range(10) for j in range(9)][: variants.MOST_LINES]


def test_codes_beside_names(spark):
    rows = [(1, "cityId", "3"), (1, "cityName", "Riyadh"), (1, "id", "12"), (1, "name", "x"), (2, "id", "1023456789"), (2, "name", "Ali"), (3, "id", "4"), (3, "cityId", "9"), (4, "partnersNationalityId", "7"), (4, "PartnersNationalityName", "SA"), (5, "paid", "1"), (5, "name", "y")]
    got = {tuple(r)[:2] for r in A.without_codes(spark.createDataFrame(rows, "rec int, key string, value string"), "rec").collect()}
    assert got == {(1, "cityName"), (1, "name"), (2, "id"), (2, "name"), (3, "id"), (3, "cityId"), (4, "PartnersNationalityName"), (5, "paid"), (5, "name")}


def test_roles_by_heading_and_vote(spark):
    aliases = [("name of heir", "heir_name", "heirs", "heir", False), ("name of deceased", "dead_name", "estate", "dead", False), ("both", "a", "x", None, False), ("both", "b", "x", None, False),
               ("id", "heir_id", "heirs", "heir", True), ("id", "dead_id", "estate", "dead", True)]
    labels = [(1, "estate", 1, "id"), (2, "", 1, "name of deceased"), (2, "", 2, "id"), (2, "", 3, "name of heir"), (3, "odd", 1, "id"), (4, "", 1, "both"), (5, "", 1, "id"), (5, "", 3, "name of heir")]
    a = spark.createDataFrame(aliases, "alias string, key string, section string, role string, shared boolean")
    got = {(r["doc"], r["at"]): r["key"] for r in A.vote_roles(spark.createDataFrame(labels, "doc int, section string, at int, label string"), a, "doc", "at").collect()}
    assert got == {(1, 1): "dead_id", (2, 1): "dead_name", (2, 2): "dead_id", (2, 3): "heir_name", (3, 1): None, (4, 1): None, (5, 1): "heir_id", (5, 3): "heir_name"}


def test_labels_and_descriptions(spark):
    for base, role, want in (("الاسم", "الوارث", "اسم الوارث"), ("رقم الهوية", "الوارث", "رقم هوية الوارث"), ("الرقم الموحد", "الوارث", "الرقم الموحد للوارث"), ("رقم السجل التجاري", "ولي الزوجة", "رقم السجل التجاري لولي الزوجة"), ("", "x", "x"), ("y", None, "y")):
        assert one(spark, A.role_label(F.lit(base), F.lit(role).cast("string"))) == want
    assert tuple(one(spark, A.split_description(F.lit("Commercial  Number - رقم السجل\nnote:")))) == ("رقم السجل", "Commercial Number - note")


def test_letters(spark):
    make = lambda **k: one(spark, A.letter(*(F.lit(k.get(c)).cast("string") for c in ("name", "ref", "day", "subject")), "الإمارة", "المكتب", *(F.lit(k.get(c)).cast("string") for c in ("target", "priority", "term")), F.lit(bool(k.get("plain")))))
    full = make(name="علي", ref="CMP-1", day="٢٠٢٦/٠١/٠٢", subject="حفرة", target="البلدية", priority="عالية", term="٣ أيام").split("\n")
    assert full[0] == "المكرم/ة علي" and full[3] == "تلقّت الإمارة شكواكم رقم CMP-1 بتاريخ ٢٠٢٦/٠١/٠٢ بشأن «حفرة»، وقد أحالتها إلى البلدية بأولوية عالية، ونتوقع الرد خلال ٣ أيام." and full[-1] == "المكتب — الإمارة"
    plain = make(plain=True).split("\n")
    assert plain[0] == "المكرم/ة مقدم الشكوى" and plain[3] == "تلقّت الإمارة خطابكم، وسيُطّلع عليه."


def test_qualifying_clauses(spark):
    rows = [(1, p, "c", 0.55, 0.5, False) for p in range(5)] + [(1, 9, "d", 0.49, 0.5, False), (1, 9, "e", 0.1, 0.0, True), (1, 9, "f", 0.52, 0.01, False)]
    got = {r["clause"]: (round(r["score"], 2), r["passages"], r["n"]) for r in A.qualifying_clauses(spark.createDataFrame(rows, "doc int, passage int, clause string, cosine double, lexical double, exact boolean"), "doc").collect()}
    assert got == {"c": (0.67, [0, 1, 2], 5), "e": (0.1, [9], 1)}


def test_fold_as_a_sql_function(spark):
    A.register_functions(spark)
    rng = random.Random(3)
    rows = [("".join(rng.choice("أإؤةـَ ٣ßςAé\t") for _ in range(12)),) for _ in range(50)]
    df = spark.createDataFrame(rows, "s string")
    assert df.where(F.expr("cms_fold(s)") != text.fold(F.col("s"))).count() == 0


def test_injected_embeddings(spark):
    got = A.embedded(spark.createDataFrame([("a",), ("bb",), ("",)], "t string"), "t", lambda xs: [[float(len(x)), 0.0] for x in xs], 2).orderBy("t").collect()
    assert [r["embedding"] for r in got] == [None, [1.0, 0.0], [2.0, 0.0]]


def test_facts_and_room(spark):
    trend = spark.createDataFrame([(f"2026-01-{d:02d}", d) for d in range(1, 21)], "day string, n int")
    counts = spark.createDataFrame([("roads", 5), ("water", 9)], "id string, n int")
    outside = lambda stated: spark.createDataFrame([("a", 1, stated), ("b", 2, stated)], "region string, n int, stated int")
    got = {r["fact"]: r["value"] for r in A.facts(trend, counts, outside(3), 14).collect()}
    assert got == {"recent7": str(sum(range(14, 21))), "prior7": str(sum(range(7, 14))), "category water": "9 of 14", "category roads": "5 of 14", "outside a": "1", "outside b": "2"}
    assert not any(r["fact"].startswith("outside") for r in A.facts(trend, counts, outside(4), 14).collect())
    assert one(spark, A.document_room(4096, 600, F.lit(1000))) == 4592 and one(spark, A.document_room(4096, 600, F.lit(9000))) == 600


def test_clauses_against_a_loop(spark):
    rng = random.Random(6)
    for _ in range(30):
        t = "".join(rng.choice(["word ", "x. ", "y, ", "| ", "\n", "«z» ", "end! "]) for _ in range(rng.randrange(60)))
        want = {}
        import re

        for part in re.split(r"\n+|\s*\|\s*|(?<=[.!?؟؛;،,:])\s+", t):
            words = part.strip(citation._EDGES).split()
            for i in range(0, max(1, len(words) - 10), 10):
                clause = " ".join(words[i : i + 20]).strip(citation._EDGES)
                if len(clause.split()) >= 3:
                    want[clause] = None
        assert one(spark, citation.clauses(F.lit(t))) == list(want)


def test_places_coupled_and_supported(spark):
    def couple(region, town, old_region="makkah", old_town="unknown"):
        s = lambda v: F.lit(v).cast("string")
        return tuple(one(spark, gazetteer.couple(s(region), s(town), s(old_region), s(old_town), "riyadh")))

    assert couple(None, "kharj") == (False, "riyadh", "kharj") and couple("makkah", None, "riyadh", "kharj") == (False, "makkah", "unknown")
    assert couple("makkah", "kharj")[0] and couple("unknown", "kharj")[0] and couple("unknown", None, "riyadh", "kharj") == (False, "unknown", "unknown")
    assert couple("riyadh", "kharj") == (False, "riyadh", "kharj") and couple(None, None, "riyadh", "kharj") == (False, None, None)
    support = one(spark, gazetteer.support_text(F.lit("سعادة أمير منطقة الرياض\nحفرة في جدة بإمارة منطقة الرياض"), F.lit("سعادة أمير منطقة الرياض"), ["إمارة منطقة الرياض"]))
    assert "الرياض" not in support and "جده" in support
    assert one(spark, gazetteer.addressed_to(F.lit("إلى إمارة منطقة الرياض"), ["إمارة منطقة الرياض"])) and not one(spark, gazetteer.addressed_to(F.lit("إلى البلدية"), ["إمارة منطقة الرياض"]))


def test_small_rules(spark):
    assert one(spark, cleaning.unseen_reasons(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("b")), ["a", "b"])) == ["a"]
    assert one(spark, citation.missing_required(F.expr("array(named_struct('key','a','value','1'), named_struct('key','b','value',' '))"), ["c", "b", "a"])) == ["c", "b"]
    assert one(spark, text.token_changes(F.lit("id 12345 and 777"), F.lit("id 12345 and 778"))) == ["777", "778"]
    assert segment.salvaged('{"a": 1}') == '{"a": 1}'
    context = F.expr("array(named_struct('title','t','fields',array(named_struct('label','abc','value','xyz'), named_struct('label','b','value','c'))), named_struct('title','u','fields',array(named_struct('label','b','value','c'))))")
    cut = one(spark, cleaning.capped_context(context, 1, 1, 2))
    assert [(s["title"], [tuple(f) for f in s["fields"]]) for s in cut] == [("t", [("ab", "xy")])]
    cols = spark.createDataFrame([("a", True, ["x"]), ("b", False, ["اسم"]), ("c", False, ["قط"])], "key string, required boolean, names array<string>")
    assert [r["key"] for r in A.printed_columns(cols, F.lit("الاسم هنا"), "required", "names").orderBy("key").collect()] == ["a", "b"]


def test_layouts_are_kept_or_dropped_whole(spark):
    block = {"label": "Text", "bbox": [-0.1, 0.2, 0.5, 2], "lines": ["a", "b"]}
    bad = [{**block, "bbox": [0.5, 0, 0.5, 1]}, {**block, "bbox": [0, 0, 1]}, {**block, "label": "x" * 41}, {**block, "lines": None}, {**block, "lines": ["a"] * 4001}, {**block, "label": None}]
    rows = [json.dumps({"blocks": [block]}), json.dumps({"blocks": []}), *(json.dumps({"blocks": [block, b]}) for b in bad), "{}", "none", None, json.dumps({"blocks": [block] * 801})]
    got = [r["p"] for r in spark.createDataFrame([(r,) for r in rows], "r string").select(layout.clean_page(F.col("r")).alias("p")).collect()]
    assert got[0]["blocks"][0]["bbox"] == [0.0, 0.2, 0.5, 1.0] and got[1]["blocks"] == [] and all(g is None for g in got[2:])


def test_lines_find_their_blocks(spark):
    pages = [([["title", "one"], ["two", "three"]], ["title", "on", "new", "three"]), ([], ["x"]), ([["a"]], ["zz", "q"]), ([["a", "b"], ["c", "d", "e"]], ["d", "a", "b", "c", "e"]), ([["x", "x"], ["y", "x"]], ["x", "new", " x ", "y", "x"]), ([["p", "q", "r", "s"]], ["p", "z", "s"])]
    blocks = spark.createDataFrame([(d, b, i, t) for d, (page, _) in enumerate(pages) for b, x in enumerate(page) for i, t in enumerate(x)], "doc int, block int, line int, text string")
    lines = spark.createDataFrame([(d, i, t) for d, (_, new) in enumerate(pages) for i, t in enumerate(new)], "doc int, at int, text string")
    got = {}
    for r in layout.places_of_lines(blocks, lines, "doc").orderBy("doc", "at").collect():
        got.setdefault(r["doc"], []).append(None if r["block"] is None else (r["block"], r["line"]))
    assert got == {0: [(0, 0), (0, 1), (1, 0), (1, 1)], 1: [None], 2: [(0, 0), (0, 0)], 3: [(0, 0), (0, 0), (0, 1), (1, 0), (1, 2)], 4: [(0, 0), (0, 0), (0, 1), (1, 0), (1, 1)], 5: [(0, 0), (0, 1), (0, 3)]}


def test_label_and_value_lines(spark):
    lines = [(1, 1, "City"), (1, 2, "Riyadh"), (1, 3, "Date: 2024"), (1, 4, "Name"), (1, 5, "Number"), (1, 6, "12"), (1, 7, "prose"), (1, 8, "City"), (1, 9, "a | b")]
    got = layout.label_values(spark.createDataFrame(lines, "doc int, ln int, t string"), "doc", "ln", "t", spark.createDataFrame([("City",), ("Name",), ("Number",)], "label string")).orderBy("ln").collect()
    assert [(r["ln"], r["label"], r["value"]) for r in got] == [(1, "City", "Riyadh"), (3, "Date", "2024"), (4, None, None), (5, "Number", "12"), (7, None, None), (8, None, None), (9, None, None)]


def test_answers_as_display_rows(spark):
    tree = {"crName": "Firm", "owners": [{"name": "Ali", "nationalId": "1023456789"}, {"name": "Sara", "nationalId": "1098765432"}], "acts": ["a", "b"], "boards": [{"title": "x", "members": [{"n": 1}, {"n": 2}]}], "note": "call 055 123 4567 now", "empty": ""}
    rows = layout.answer_rows(spark.createDataFrame([(1, json.dumps(tree)), (2, "broken")], "doc int, j string"), "doc", "j")
    got = {(r["path"], r["record"]): (r["label"], r["value"]) for r in layout.display_rows(rows, spark.createDataFrame([("crName", "الاسم")], "path string, label string")).collect()}
    assert got["crName", ""] == ("الاسم", "Firm") and got["owners[].nationalId", "/owners.1"] == ("National id", "••••••6789") and got["note", ""][1] == "call ••• ••• 4567 now" and ("empty", "") not in got
    shapes = {r["list"]: r["shape"] for r in layout.list_shapes(rows, "doc").collect()}
    assert shapes == {"/owners": "table", "/acts": "list", "/boards": "cards", "/boards.1/members": "table"}
