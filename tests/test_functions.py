"""Functions and operators against direct Python definitions and stated cases."""

import datetime as dt
import gzip
import json
import random
import unicodedata
import zlib

import pytest
from pyspark.sql import functions as F

from caselake.functions import dates, masking, text
from caselake.operators import compare as C
from caselake.operators import layout, matching, register, segment
from caselake.sources import intake
from caselake.streaming import cases
from tests.shapes import shapes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_against_a_loop(spark):
    rng = random.Random(7)
    pool = "أإآٱةؤئى٣۷ـabZ \tَّ‏‪محدé😀"
    rows = [("".join(rng.choice(pool) for _ in range(rng.randrange(30))),) for _ in range(300)]
    table = dict(zip(text.FOLD_FROM, text.FOLD_TO, strict=False))

    def expected(s):
        out = "".join(table.get(c, c) for c in s if c not in "َّ‏‪ـ")
        return " ".join(out.split()).lower()

    got = spark.createDataFrame(rows, "s string").select("s", text.fold(F.col("s")).alias("x")).collect()
    assert all(r["x"] == expected(r["s"]) for r in got)


def test_nfc(spark):
    assert one(spark, text.compose(F.lit("é"))) == unicodedata.normalize("NFC", "é")
    assert one(spark, text.compose(F.lit("plain"))) == "plain"


def test_utf16_offset(spark):
    assert one(spark, text.utf16_offset(F.lit("a😀b"), F.lit(2))) == 3


def test_html_lines(spark):
    html = "<table><tr><td> A </td><td>B&amp;C</td></tr></table><p>one<br/>two</p><script>x()</script>"
    assert one(spark, text.html_lines(F.lit(html))) == ["A | B&C", "one", "two", "x()"]


@pytest.mark.parametrize(("y", "m", "d", "iso"), [(1445, 1, 1, "2023-07-19"), (1450, 1, 1, "2028-05-25"), (1447, 1, 1, "2025-06-27"), (1447, 3, 29, "2025-09-22")])
def test_hijri(spark, y, m, d, iso):
    assert one(spark, dates.hijri_to_date(F.lit(y), F.lit(m), F.lit(d))) == dt.date.fromisoformat(iso)


def test_hijri_round_trip(spark):
    days = spark.range(0, 30000, 17).select(F.date_add(F.lit("1960-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    h = days.select("d", dates.date_to_hijri(F.col("d")).alias("h"))
    assert h.where(dates.hijri_to_date(F.col("h.y"), F.col("h.m"), F.col("h.d")) != F.col("d")).count() == 0


@pytest.mark.parametrize(("days", "status"), [(-1, "expired"), (0, "expiring_soon"), (90, "expiring_soon"), (91, "valid")])
def test_expiry_edges(spark, days, status):
    base = F.lit("2026-01-01").cast("date")
    assert one(spark, dates.expiry_status(F.date_add(base, days), base)) == status


def test_masks(spark):
    assert one(spark, masking.long_numbers(F.lit("id 1023456789 and 12345"))) == "id ••••••6789 and 12345"
    for given, want in (
        ("123456", "123456"), ("12345678", "12345678"), ("order 20240305", "order 20240305"), ("055 123 4567", "••• ••• 4567"), ("٠٥٥١٢٣٤٥٦٧", "••••••٤٥٦٧"), ("۱۲۳۴۵۶۷۸۹", "•••••۶۷۸۹"),
        ("1445/03/12 500000", "1445/03/12 500000"), ("1234  56789", "1234  56789"), ("a123456789b", "a•••••6789b"),
    ):
        assert one(spark, masking.long_numbers(F.lit(given))) == want
    assert [one(spark, masking.tail4(F.lit(x))) for x in ("123", "12345", "1234567")] == ["•••", "•••45", "•••4567"]
    assert one(spark, masking.personal_value(F.lit("ali@x.sa"), F.lit("email"))) == "a•••@x.sa"
    assert one(spark, masking.personal_value(F.lit("1990-05-06"), F.lit("birthDate"))) == "1990-••-••"
    assert one(spark, masking.masked_tail_matches(F.lit("**6789"), F.lit("1023456789")))
    assert not one(spark, masking.masked_tail_matches(F.lit("6789"), F.lit("1023456789")))


def test_unknown_priority_is_an_error(spark):
    with pytest.raises(Exception, match="unknown priority"):
        spark.range(1).select(register.due_at(F.current_timestamp(), F.lit("odd")).alias("x")).collect()


def test_unknown_filter_is_an_error(spark):
    with pytest.raises(ValueError, match="no such filter"):
        register.equal_filters(spark.range(1), {"nope": "x"})


def test_chunks_are_lossless():
    rng = random.Random(3)
    for _ in range(50):
        t = "".join(rng.choice("ab. \n") for _ in range(rng.randrange(5000)))
        cuts = segment.cut_points(t)
        at = 0
        for a, b, page in cuts:
            assert t[at:a].strip() == "" and 0 < b - a <= segment.CHUNK and page is None
            at = b
        assert t[at:].strip() == ""


def test_chunks_keep_pages_apart_and_prefer_late_ends():
    t = "--- Page 1 ---\n" + "a" * 700 + "\n" + "b" * 300 + ". " + "c" * 400 + "\n--- Page 2 ---\nend"
    cuts = segment.cut_points(t)
    assert [p for _, _, p in cuts] == [1, 1, 2] and t[cuts[0][0] : cuts[0][1]].endswith("b.") and t[cuts[2][0] :] == "end"


def test_overlapping_windows(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc\n") for _ in range(rng.randrange(1, 900))) for _ in range(100)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", segment.overlapping(F.col("t"), 200, overlap=50, most=4).alias("w")).collect()
    for t, got in ((r["t"], [tuple(x) for x in r["w"]]) for r in found):
        assert got[0][0] == 0 and 1 <= len(got) <= 4 and (got[-1][1] == len(t) or len(got) == 4)
        for (a, b), (c, d) in zip(got, got[1:]):
            assert c == max(a + 1, b - 50) and d - c <= 200
        for a, b in got:
            breaks = [i for i in range(a + 100, min(a + 200, len(t))) if t[i] == "\n"]
            assert b == len(t) or b == (breaks[-1] if breaks else a + 200)
    assert one(spark, segment.overlapping(F.lit(None).cast("string"), 200)) is None and [tuple(x) for x in one(spark, segment.overlapping(F.lit(""), 200))] == [(0, 0)]


def test_closed_json(spark):
    rows = [('{"s": [{"a": 1}, {"b": "c', '{"s": [{"a": 1}]}'), ('{"a": [{"f": [{"x": 1}', '{"a": [{"f": [{"x": 1}]}]}'), ("[1, 2]", "[1, 2]"), ("nothing", None), ('{"a": 1,', None), ('{"a": "}]", "b": [{"c": "x\\\\"}, {"d', '{"a": "}]", "b": [{"c": "x\\\\"}]}'), ("[{}]]", "[{}]")]
    got = spark.createDataFrame(rows, "s string, e string").select(segment.closed_json(F.col("s")).alias("x"), "e").collect()
    assert all(r["x"] == r["e"] for r in got)


def test_edit_distance_sizes_and_cells(spark):
    rng = random.Random(11)
    words = [("".join(rng.choice("abc") for _ in range(rng.randrange(8))), "".join(rng.choice("abc") for _ in range(rng.randrange(8)))) for _ in range(200)]
    d = spark.createDataFrame(words, "a string, b string")
    for r in d.select("a", "b", segment.edit_distance(F.col("a"), F.col("b")).alias("n")).collect():
        row = list(range(len(r["b"]) + 1))
        for i, x in enumerate(r["a"], 1):
            row = [i] + [min(row[j + 1] + 1, row[j] + (x != y)) for j, y in enumerate(r["b"])]
            for j in range(1, len(row)):
                row[j] = min(row[j], row[j - 1] + 1)
        assert r["n"] == row[-1]
    sizes = lambda *x: one(spark, segment.size_groups(F.array(*map(F.lit, x)).cast("array<double>")))
    assert sizes(10.0, 10.4, 12.0, 10.8, 30.0) == [10.5, 10.5, 12.0, 10.5, 30.0] and sizes() == [] and sizes(7.3, 7.3) == [7.5, 7.5]
    cells = lambda line, *x: one(spark, segment.ordered_cells(F.lit(line), F.array(*map(F.lit, x))))
    assert cells("ali 10 ali 20", "ali", "ali", "10", "20") == [0, 7, None, 11] and cells("a", "", "a") == [None, 0]


def test_recovered_entries_against_a_loop(spark):
    """Second readings correct or extend a page, each entry once, in order."""
    rng = random.Random(6)
    names, meanings = ["karim", "karem", "salim", "salima", "nour", "noor"], ["generous and noble", "generous and nobel", "safe and sound", "light of day", "x"]
    rows = lambda first: [(first + i, rng.randrange(4), i, f"k{rng.randrange(9)}", rng.choice(names), rng.choice(meanings), rng.randrange(5) * 30, float(rng.randrange(9))) for i in range(40)]
    columns = "id int, page int, at int, key string, name string, meaning string, y int, quality double"
    old, new = rows(0), rows(100)
    a, b = spark.createDataFrame(old, columns), spark.createDataFrame(new, columns)
    same = {tuple(r) for r in segment.same_entries(a, b, "page").select("a", "b").collect()}
    want = {r[0]: (r[1], r[3], r[4], r[5], "read") for r in old}
    taken, known = set(), {(r[1], r[3]) for r in old}
    for r in new:
        if (r[1], r[3]) in known:
            continue
        known.add((r[1], r[3]))
        hit = next((o for o in old if o[1] == r[1] and o[0] not in taken and (o[0], r[0]) in same), None)
        if hit:
            taken.add(hit[0])
            want[hit[0]] = (hit[1], r[3], r[4], r[5] if r[7] > hit[7] else hit[5], "corrected")
        else:
            want[r[0]] = (r[1], r[3], r[4], r[5], "added")
    got = {r["id"]: (r["page"], r["key"], r["name"], r["meaning"], r["how"]) for r in segment.recovered(a, b, "page").collect()}
    assert got == want and {x[-1] for x in want.values()} == {"read", "corrected", "added"}


def test_line_shapes(spark):
    rng = random.Random(4)
    pool = ["Deed of sale", "City", "Riyadh", "Name: Ali", "Time: 10:30 today", "Number 1234", "Issued on", "1445/01/02", "a | b | c", "Total sum 99", "plain words that end here.", "Alone: x", "  ", "Owner Sara Ahmad", "Part one", "77", "Owner: me", "City : a b", "x |", "12: no", "seven words are too many for headings", "Last 5"]
    texts = [[rng.choice(pool) for _ in range(rng.randrange(1, 14))] for _ in range(300)]
    d = spark.createDataFrame([(k, i, t) for k, x in enumerate(texts) for i, t in enumerate(x)], "doc int, n int, t string")
    got = {}
    for r in layout.line_shapes(d, "doc", "n", "t", ["City", "Owner"], ["Part one"]).orderBy("doc", "n").collect():
        got.setdefault(r["doc"], []).append((r["n"], r["shape"], r["cells"]))
    for k, x in enumerate(texts):
        assert got.get(k, []) == shapes(list(enumerate(x)), {"city", "owner"}, {"part one"}), x


def test_same_entries_near_each_other(spark):
    left = spark.createDataFrame([(1, 1, "احمد", "اسم علم مذكر", 100.0), (2, 1, "نور", "ضوء", 500.0)], "id int, page int, name string, meaning string, y double")
    right = spark.createDataFrame([(7, 1, "حمد", "اسم علم مذكر", 140.0), (8, 1, "احمد", "اسم علم مذكر", 300.0), (9, 2, "نور", "ضوء", 500.0)], left.schema)
    assert [(r["a"], r["b"]) for r in segment.same_entries(left, right, "page").collect()] == [(1, 7)]


def test_offsets_point_to_the_raw_text(spark):
    raw = "مُحَمّد  ـأحمد"
    got = one(spark, segment.normalized_with_offsets(F.lit(raw)))
    assert "".join(c["norm"] for c in got) == one(spark, text.normalize(F.lit(raw)))
    assert [c["at"] for c in got] == sorted(c["at"] for c in got)


def test_word_edits_and_similarity(spark):
    df = spark.createDataFrame([("the red fox", "the blue fox", "abcd", "abxd")], "a string, b string, c string, d string")
    r = df.select(segment.word_edits(F.col("a"), F.col("b")).alias("e"), segment.similarity(F.col("c"), F.col("d")).alias("s")).first()
    assert [tuple(x) for x in r["e"]] == [("replace", "red", "blue")] and abs(r["s"] - 0.75) < 1e-9


def test_record_breaks(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(["name", "share", "name", "name", "share"])], "doc int, i int, k string")
    assert [r["record"] for r in segment.break_records(df, "doc", "i", "k").orderBy("i").collect()] == [0, 0, 1, 2, 2]


def test_repairs_feed_later_neighbours(spark):
    df = spark.createDataFrame([("p", i, n) for i, n in enumerate(["ab", "ac", "xd", "ae", "af", "ag"])], "page string, y int, name string")
    assert [r["name"] for r in segment.repair_initials(df, ["page"], "y", "name").orderBy("y").collect()] == ["ab", "ac", "ad", "ae", "af", "ag"]


def test_find_all_overlaps(spark):
    assert one(spark, matching.find_all(F.lit("aaaa"), F.lit("aa"))) == [0, 1, 2]
    assert one(spark, matching.find_all(F.lit("a"), F.lit("abc"))) == []


def test_anchor_needs_its_context(spark):
    assert one(spark, matching.anchor_fires(F.lit("the deed number"), F.lit("deed"), F.array(F.lit("no "))))
    assert not one(spark, matching.anchor_fires(F.lit("no deed here"), F.lit("deed"), F.array(F.lit("no "))))


def test_intake(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfone\r\ntwo")
    (tmp_path / "c.txt").write_bytes(b"bad\x00")
    (tmp_path / "d.jpg").write_bytes(b"not a picture")
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["text"]) for r in intake.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.bin": ("pdf", None), "b.txt": ("txt", "one\ntwo"), "c.txt": ("txt", None), "d.jpg": (None, None)}
    webp, junk = b"RIFF\x00\x00\x00\x00WEBPVP8 ", b"\n\n%PDF-1.4"
    rows = [(b"\x12\x55\x04\x44\x62\xd1", "x", "", None, None), (webp, "x", "", "image/webp", "image"), (junk, "a.pdf", "", "pdf/pdf", "pdf"), (junk, "a.bin", "", None, None), (b"hi", "x", "text/plain; charset=x", "txt/txt", None),
            (b"BM..", "x", "", None, "image"), (b"none", "scan.TIFF", "", None, "image"), (b"\x89PNG\r\n\x1a\n", "", "", "image/png", "image")]
    df = spark.createDataFrame(rows, "c binary, n string, t string, kind string, readable string")
    k = intake.kind_of(F.col("c"), F.col("n"), F.col("t"))
    assert df.where(~F.concat_ws("/", k["kind"], k["extension"]).eqNullSafe(F.coalesce("kind", F.lit(""))) | ~intake.readable_kind(F.col("c"), F.col("n")).eqNullSafe(F.col("readable"))).count() == 0


def test_answers_and_pages(spark):
    body = '{"اسم": 1}'.encode()
    rows = [(gzip.compress(zlib.compress(body)), None, '{"اسم": 1}'), (json.dumps('{"a": 1}').encode(), None, '{"a": 1}'), ('{"é": 1}'.encode("latin-1"), "latin-1", '{"é": 1}'), (gzip.compress(body)[:-4], None, None), (None, None, None), (b"no json", None, None)]
    df = spark.createDataFrame(rows, "b binary, c string, want string").withColumn("got", intake.answer_text("b", "c"))
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    blocks = spark.createDataFrame([(1, 1, 2, "<p>b</p>", False, False), (1, 1, 1, "<p>a</p>", None, None), (1, 1, 3, "<p>c</p>", True, False), (1, 2, 1, "<p>d</p>", False, True)], "doc int, page int, order int, html string, error boolean, skipped boolean")
    assert [tuple(r) for r in intake.pages_of(blocks, "doc", "page").collect()] == [(1, 1, "a\nb")]


def test_vocabulary(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"regions": [{"id": "a_1", "label_ar": "x"}, {"id": "b"}]}', encoding="utf-8")
    assert [tuple(r) for r in intake.vocabulary(spark, str(tmp_path / "v.json"), ("regions",)).orderBy("at").collect()] == [("regions", "a_1", "x", "", 0), ("regions", "b", "", "", 1)]
    (tmp_path / "w.json").write_text('{"regions": [{"id": "A"}]}', encoding="utf-8")
    with pytest.raises(ValueError, match="regions"):
        intake.vocabulary(spark, str(tmp_path / "w.json"), ("regions",))


def test_register_summary_fields_and_sources(spark):
    rows = [(1, "riyadh", 0, ["low_confidence", "fields_unverified"], 1, 0, None, "done", True, "high", "low", "llm"), (2, "makkah", 2, ["fields_unverified"], 0, 1, None, "done", False, "low", "low", "rule_cap"), (3, None, None, [], 0, 0, None, "ocr", False, "low", "low", "llm")]
    df = spark.createDataFrame(rows, "id int, region string, pending_fields int, review_reasons array<string>, needs_review int, reviewed int, text string, stage string, seen boolean, priority string, model_priority string, by string")
    got = {r["id"]: r for r in register.summary(df, "riyadh").collect()}
    assert got[1]["review_reasons"] == ["low_confidence"] and got[1]["needs_review"] is True and "text" not in got[1].asDict()
    assert [got[i]["outside_jurisdiction"] for i in (1, 2, 3)] == [False, True, False] and got[3]["pending_fields"] == 0
    said = df.select("id", register.priority_source(F.col("stage"), F.col("seen"), F.col("priority"), F.col("model_priority"), F.col("by")).alias("s")).collect()
    assert [r["s"] for r in said] == [register.REVIEWED_PRIORITY, register.SOURCES["rule_cap"], ""]
    fields = F.expr("array(named_struct('key','a','value','1','verified',false), named_struct('key','b','value','2','verified',false), named_struct('key','c','value','','verified',false))")
    merged = one(spark, register.merged_fields(fields, F.expr("map('a', named_struct('value', '9', 'action', 'edit'))")))
    assert [(f["key"], f["value"], f["action"], f["pending"]) for f in merged] == [("a", "9", "edit", False), ("b", "2", None, True), ("c", "", None, False)]
    assert register.checked_filters({"stage": "done", "needs_review": "TRUE", "q": " x ", "region": ""}, {"stage": ["done"]}) == {"stage": "done", "needs_review": True, "q": "x"}
    for bad in ({"stage": "x"}, {"needs_review": "maybe"}, {"q": "y" * 300}):
        with pytest.raises(ValueError):
            register.checked_filters(bad, {"stage": ["done"]})
    paged = register.page_with_total(df.withColumn("created_at", F.col("id")), [F.col("id").desc()], 2)
    assert [(r["id"], r["total"]) for r in paged.orderBy(F.desc("id")).collect()] == [(3, 3), (2, 3)]


def test_missing_due_times_fall_back(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    bucket = lambda due, p: one(spark, register.sla_bucket(due, at("2026-01-05"), at("2026-01-03"), F.lit(p)))
    none = F.lit(None).cast("timestamp")
    assert [bucket(none, "critical"), bucket(none, "high"), bucket(none, "low"), bucket(none, "odd"), bucket(at("2026-01-04"), "low")] == ["overdue", "due_soon", "on_track", None, "overdue"]


def test_csv_sink(spark, tmp_path):
    intake.write_csv(spark.createDataFrame([("=1+1", 2)], "a string, b int").coalesce(1), str(tmp_path / "out"), ["A", "b"])
    assert b"".join(p.read_bytes() for p in (tmp_path / "out").glob("*.csv")) == b"\xef\xbb\xbfA,b\r\n'=1+1,2\r\n"


def test_ocr_lines(spark):
    w = spark.createDataFrame([(1, 1, 1, 1, 2, 30, 5, 10, 8, 90.0, "b"), (1, 1, 1, 1, 1, 5, 4, 10, 8, 80.0, "a"), (1, 1, 1, 1, 3, 50, 5, 10, 8, -1.0, "c")], "page int, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string")
    r = intake.ocr_lines(w).first()
    assert (r["text"], r["x0"], r["y0"], r["x1"], r["y1"], r["conf"]) == ("a b c", 5, 4, 60, 13, 85.0)


def test_stage_rules(spark):
    q = spark.createDataFrame([(1, "queued", 0, 5), (2, "queued", 3, 1), (3, "ocr", 1, 2), (4, "ocr", 3, 2)], "id int, stage string, attempts int, created_at int")
    assert [(r["id"], r["stage"], r["attempts"]) for r in cases.claim(q, 5).collect()] == [(1, "ocr", 1)]
    assert {r["id"]: r["stage"] for r in cases.recover(q).collect()} == {1: "queued", 2: "queued", 3: "queued", 4: "error"}


def test_settle_keeps_reviewed_values(spark):
    cur = spark.createDataFrame([(1, True, "a", "t"), (2, False, "a", "t")], "id int, reviewed boolean, category string, text string")
    new = spark.createDataFrame([(1, "b", ""), (2, "b", "u")], "id int, category string, text string")
    assert sorted(tuple(r) for r in cases.settle(cur, new).collect()) == [(1, True, "a", "t"), (2, False, "b", "u")]


def test_stream_counts_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(src))
    stream = cases.windowed(cases.read_events(spark, str(src)), "1 day", "10 days")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = spark.read.parquet(str(src)).withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day")["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_intake_once(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(1).write.parquet(str(src))
    q = cases.intake_once(cases.read_events(spark, str(src)), "user_id", "60 days").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == spark.read.parquet(str(src)).select("user_id").distinct().count()


def test_vector_mutual_all_scores_every_row(spark):
    from caselake.plans import registry
    from tests.conftest import SMALL

    unit = {}
    for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect():
        norm = sum(x * x for x in r["embedding"]) ** 0.5
        unit[r["vec_id"]] = [x / norm for x in r["embedding"]]
    left, right = [sorted(i for i in unit if (i % 20 == 0) == side) for side in (True, False)]
    score = {(a, b): round(sum(x * y for x, y in zip(unit[a], unit[b], strict=True)), 6) for a in left for b in right}
    want = {(a, max(right, key=lambda b: (score[a, b], -b))) for a in left} | {(max(left, key=lambda a: (score[a, b], -a)), b) for b in right}
    assert len(left) + len(right) == len(unit) and {b for _, b in want} == set(right)
    assert sorted(map(tuple, registry.QUERIES["vector_mutual_all"](spark, SMALL).collect())) == sorted(want)


def test_best_pairs_ties_go_to_the_least_id_over_all_parts(spark):
    left = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0]), (None, [1.0, 0.0])], "i long, v array<double>")
    right = spark.createDataFrame([(9, [1.0, 0.0]), (8, [1.0, 0.0]), (7, [0.0, 1.0]), (6, [0.0, 1.0])], "i long, v array<double>")
    for parts in (1, 4):
        got = C.mutual_best(C.best_pairs(left, right.repartition(parts), "i", "v")).collect()
        assert sorted(map(tuple, got)) == [(1, 8), (1, 9), (2, 8), (3, 6), (3, 7)]
    assert C.mutual_best(C.best_pairs(left.where("i < 0"), right, "i", "v")).count() == 0


def test_find_all_against_a_loop(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choice("ab(") for _ in range(rng.randrange(20))), "".join(rng.choice("ab(") for _ in range(rng.randrange(1, 3)))) for _ in range(300)]
    got = spark.createDataFrame(rows, "t string, n string").select("t", "n", matching.find_all(F.col("t"), F.col("n")).alias("x")).collect()
    assert all(r["x"] == [i for i in range(len(r["t"])) if r["t"].startswith(r["n"], i)] for r in got)


def test_span_choice(spark):
    t = "id 12\nname x 12\nlast 12"
    spans = "array(named_struct('start', 3, 'end', 5), named_struct('start', 13, 'end', 15), named_struct('start', 21, 'end', 23))"
    n = "cast(null as int)"

    def pick(line=n, near=n, labels="cast(array() as array<int>)", after=n):
        return one(spark, matching.choose_span(F.lit(t), F.expr(spans), F.expr(line), F.expr(near), F.expr(labels), F.expr(after)))["start"]

    assert [pick(), pick(line="7"), pick(near="20"), pick(labels="array(6)"), pick(labels="array(22)"), pick(after="13"), pick(line="7", near="0"), pick(after="99")] == [3, 13, 21, 13, 21, 21, 13, 3]


def test_anchor_gates(spark):
    text_, sec = F.lit("no deed here. the deed is old"), F.expr("array(named_struct('start', 0, 'end', 14, 'name', 'a'), named_struct('start', 14, 'end', 99, 'name', 'b'))")
    lits = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    fires = lambda bad=(), back=5, near=(), allowed=(): one(spark, matching.anchor_fires(text_, F.lit("deed"), lits(*bad), back, lits(*near), 8, sec, lits(*allowed)))
    assert fires() and fires(["no "]) and not fires(["no ", "the "]) and fires(near=["old"]) and not fires(near=["absent"]) and fires(["no "], allowed=["b"]) and not fires(["no "], allowed=["a"])
    assert one(spark, matching.co_occur(text_, F.lit("deed"), F.lit("old"), 8)) and not one(spark, matching.co_occur(text_, F.lit("no"), F.lit("old"), 8))


def test_clip_at_lines(spark):
    t = "a" * 85 + "\n" + "b" * 100 + "\n" + "c" * 30
    assert one(spark, text.clip_lines(F.lit(t), 100)) == "a" * 85 and one(spark, text.clip_lines(F.lit("x" * 200), 100)) == "x" * 100 and one(spark, text.clip_lines(F.lit("short"), 100)) == "short"
    both = one(spark, text.clip_lines(F.lit(t), 120, 0.3))
    assert len(both) <= 120 and both.startswith("a" * 79) and both.endswith("c" * 30)


def test_steps_and_retries(spark):
    q = spark.createDataFrame([(1, "queued"), (2, "done"), (3, "ocr"), (4, "error")], "id int, stage string")
    new, log = cases.step(q, spark.createDataFrame([(1, "ocr"), (2, "ocr"), (3, "done")], "id int, to string"), F.lit("2026-01-01").cast("timestamp"))
    assert {r["id"]: r["stage"] for r in new.collect()} == {1: "ocr", 2: "done", 3: "ocr", 4: "error"} and [(r["id"], r["old"], r["new"]) for r in log.collect()] == [(1, "queued", "ocr")]
    runs = spark.createDataFrame([(1, "ok", 0, False, 1), (2, "busy", 1, False, 1), (3, "busy", 3, False, 3), (4, "busy", 3, True, 3), (5, "failed", 0, False, 2), (6, "failed", 0, False, 3)], "id int, outcome string, busy_tries int, reloaded boolean, attempts int")
    now = F.lit("2026-01-01").cast("timestamp")
    got = {r["id"]: (r["stage"], r["tries"], r["was_reloaded"], r["late"]) for r in cases.after_run(runs, now).withColumn("late", F.col("not_before") > now).collect()}
    assert got == {1: ("done", 0, False, None), 2: ("queued", 2, False, True), 3: ("queued", 3, True, False), 4: ("error", 3, True, None), 5: ("queued", 0, False, False), 6: ("error", 0, False, None)}


def test_stale_accepts_go(spark):
    reviews = spark.createDataFrame([(1, "a", "accept", "x"), (1, "b", "accept", "x"), (1, "c", "edit", "y"), (2, "a", "accept", "x")], "id int, key string, action string, value string")
    fields = spark.createDataFrame([(1, "a", "x"), (1, "b", "z"), (1, "c", "q")], "id int, key string, value string")
    assert {(r["id"], r["key"]) for r in cases.kept_reviews(reviews, fields).collect()} == {(1, "a"), (1, "c")}


def test_progress(spark):
    spark.sparkContext.setJobGroup("g1", "test")
    spark.range(10).count()
    assert cases.progress(spark, "g1")["done"] >= 1
    spark.sparkContext.setJobGroup("", "")


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", "male", [1, 2]), ("b", "female", [3])], "name string, gender string, pages array<int>")
    intake.write_exports(df, str(tmp_path), ["name"], "gender")
    assert spark.read.json(f"{tmp_path}/full").where("pages[0] = 3").count() == 1 and spark.read.json(f"{tmp_path}/simple").columns == ["name"]
    assert [r["name"] for r in spark.read.json(f"{tmp_path}/by_gender/gender=female").collect()] == ["b"]


def test_cascade_delete(spark):
    cases_ = spark.createDataFrame([(1,), (2,)], "id int")
    events = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "case_id int, e string")
    left = cases.without_cases({"cases": (cases_, "id"), "events": (events, "case_id")}, spark.createDataFrame([(2,)], "id int"))
    assert [r["id"] for r in left["cases"].collect()] == [1] and [r["e"] for r in left["events"].collect()] == ["x"]


def test_official_calendar(spark):
    """Known days, the table's ends, days that a month lacks, and the tabular rule outside."""
    months = dates.MonthStarts.of_runtime(spark)
    day = lambda *x: one(spark, dates.hijri_day(*map(F.lit, x), months))
    assert day(1447, 1, 1) == dt.date(2025, 6, 26) and day(1447, 3, 29) == dt.date(2025, 9, 21)
    assert day(1447, 2, 30) is None and day(1447, 1, 30) == dt.date(2025, 7, 25) and day(1447, 13, 1) is None and day(1447, 1, 0) is None
    assert day(1250, 1, 1) == one(spark, dates.hijri_to_date(F.lit(1250), F.lit(1), F.lit(1)))
    back = lambda c: tuple(one(spark, dates.hijri_of(F.lit(c).cast("date"), months)))
    assert back("2025-06-26") == (1447, 1, 1) and back("2025-06-25")[:2] == (1446, 12)
    assert back("1840-01-01") == tuple(one(spark, dates.date_to_hijri(F.lit("1840-01-01").cast("date"))))
    days = spark.range(0, 60000, 7).select(F.date_from_unix_date((F.col("id") - 25000).cast("int")).alias("g"))
    h = days.select("g", months.from_date(F.col("g")).alias("h")).where("h is not null")
    assert h.count() > 8000 and h.where(months.to_date(F.col("h.y"), F.col("h.m"), F.col("h.d")) != F.col("g")).count() == 0
    table = spark.createDataFrame([(1447, 1, dt.date(2025, 6, 26)), (1447, 2, dt.date(2025, 7, 26)), (1447, 3, dt.date(2025, 8, 24))], "year int, month int, start date")
    own = dates.MonthStarts.of_table(table)
    assert own.days == months.days[(1447 - months.year) * 12 :][:3] and one(spark, own.to_date(F.lit(1447), F.lit(2), F.lit(29))) == dt.date(2025, 8, 23)
    with pytest.raises(ValueError):
        dates.MonthStarts.of_table(table.where("month <> 2"))


def test_prefixes_lose_no_pair(spark):
    """Weighted Jaccard of all pairs, against multisets."""
    from collections import Counter

    rng = random.Random(12)
    texts = lambda n, first: [(first + i, [rng.choice("abcdefgh" if rng.random() < 0.6 else "xyz") for _ in range(rng.randrange(0, 9))]) for i in range(n)]
    left, right = texts(40, 0), texts(120, 1000)
    left += [(500 + i, t) for i, (_, t) in enumerate(right[:10])]
    for least in (0.3, 0.5, 0.8, 1.0):
        want = {}
        for i, x in left:
            for j, y in right:
                both = sum((Counter(x) & Counter(y)).values())
                if both and both / (len(x) + len(y) - both) >= least:
                    want[i, j] = both / (len(x) + len(y) - both)
        got = C.weighted_jaccard(spark.createDataFrame(left, "a int, tokens array<string>"), spark.createDataFrame(right, "b int, tokens array<string>"), "a", "b", least).collect()
        assert {(r["a"], r["b"]): r["jaccard"] for r in got} == pytest.approx(want) and len(want) > 5


def test_the_index_finds_nine_of_ten_in_few_cells(spark):
    """Rows in clusters, of which one holds a third: the index reaches the stated recall in a few cells, and all cells give the exact result."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12))
    which = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 30, 3000))
    v = centres[which] + 0.3 * rng.normal(size=(3000, 12))
    df = C.unit_vectors(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(9000, None), (9001, [1.0]), (9002, [0.0] * 12), (9003, [float("nan")] * 12)], "i long, v array<double>"), "v")
    assert df.count() == 3000
    index = C.VectorIndex(df, "i", "v", cells=40)
    queries = df.where("i % 20 = 0")
    probes, share = index.probes_for(queries, "i", "v", 5)
    assert share >= 0.9 and probes <= 10
    exact = {(r["q"], r["r"]) for r in C.nearest(queries, df, "i", "i", "v", 5).collect()}
    assert {(r["q"], r["r"]) for r in index.search(queries, "i", "v", 5, len(index.centroids)).collect()} == exact and len(exact) == 750
    none = df.where("i < 0")
    assert C.VectorIndex(none, "i", "v").rows.count() == 0 and C.nearest(none, df, "i", "i", "v", 5).count() == 0


def test_expiry_evidence_is_injected(spark):
    """The date as the document writes it, whether it carries it, and where; without the functions nothing is claimed."""
    from caselake.operators import citation, expiry

    raw = "تاريخ انتهاء الوكالة: ٢٠٢٦/٠١/٠٥ م"
    d = spark.createDataFrame([(raw,)], "raw string").withColumn("t", dates.dated_text(F.col("raw"))).withColumn("d", dates.dates_in(F.col("t")))
    fields = F.array().cast("array<struct<key:string,label:string,value:string>>")
    v = expiry.verdict(F.col("t"), F.col("d"), fields, F.lit("2026-01-01").cast("date"))
    full = expiry.with_evidence(F.col("v"), locate=lambda x: F.instr(F.col("raw"), x) - 1, verify=lambda x: F.contains(F.col("raw"), x), restore=lambda x: citation.restore(x, F.col("raw")))
    d = d.withColumn("v", v)
    got = d.select(full.alias("x")).first()["x"]
    assert (got["shown"], got["verified"], got["source"], got["status"]) == ("٢٠٢٦/٠١/٠٥", True, raw.index("٢٠٢٦"), "expiring_soon")
    bare = d.select(expiry.with_evidence(F.col("v")).alias("x")).first()["x"]
    assert (bare["shown"], bare["verified"], bare["source"]) == ("2026/01/05", False, None)
