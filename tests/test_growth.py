"""What made queries grow faster than their input: expressions that Spark worked out over and over, and blocks without a bound."""

from pyspark.sql import functions as F

from caselake.functions import dates, text
from caselake.plans import registry
from tests.conftest import SMALL


def plan(spark, name):
    return registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_a_date_is_read_once_in_the_plan(spark):
    for name in ("issue_dates", "expiry_verdicts", "dates_in_text", "official_hijri"):
        said = plan(spark, name)
        assert said.count("array_sort(") == (2 if name == "expiry_verdicts" else 1), name  # the fields' dates are others
        assert said.count("format_string(") == 0, name  # it was there wherever a date named its parts


def test_places_of_matches_in_a_text_that_holds_the_mark(spark):
    rows = ["a1b22", f"{text.MARK}a1{text.MARK}{text.MARK}22😀3", "", "x", None, "12"]
    found = spark.createDataFrame([(r,) for r in rows], "t string").select(text.find_spans(F.col("t"), "(?<![0-9])[0-9]+").alias("s")).collect()
    want = [[("1", 1, 2), ("22", 3, 5)], [("1", 2, 3), ("22", 5, 7), ("3", 8, 9)], [], [], None, [("12", 0, 2)]]
    assert [r["s"] and [tuple(x) for x in r["s"]] for r in found] == want


def test_names_of_months_one_by_one_and_no_others(spark):
    names = [(n.upper(), c, i) for c, months in (("hijri", dates.HIJRI_MONTHS), ("gregorian", dates.GREGORIAN_MONTHS)) for i, some in enumerate(months, 1) for n in some]
    d = spark.createDataFrame([(n, f"5 {n} {1445 if c == 'hijri' else 2024}", c, i) for n, c, i in names] + [("none", "5 marche 2024 or 5 رجبي 1445", None, None)], "n string, t string, c string, i int")
    for r in d.select("n", "c", "i", dates.dates_in(F.col("t")).alias("d")).collect():
        assert [(x["calendar"], x["m"], x["d"]) for x in r["d"]] == ([(r["c"], r["i"], 5)] if r["c"] else []), r


def test_a_block_holds_few_scores_at_a_time(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from caselake.operators import compare

    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(3000, 4)), 1)  # many ties
    block = pa.table({"id": pa.array(rng.permutation(3000)), "v": pa.array(list(v), pa.list_(pa.float64()))})
    monkeypatch.setattr(compare, "CELLS", 100_000)
    ids, x = compare._matrix(block)
    scores = np.round(x @ x.T, 6)
    np.fill_diagonal(scores, -np.inf)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :7]
    del scores
    tracemalloc.start()
    got = compare._best_of(7)(block, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6, peak  # all scores are 72 MB
    assert got.column("q").to_pylist() == list(np.repeat(ids, 7)) and got.column("r").to_pylist() == list(ids[order].reshape(-1))


def test_view_trees_are_walked_without_a_shuffle(spark):
    assert "Exchange hashpartitioning" not in plan(spark, "view_tree_lines") and "Window" not in plan(spark, "view_tree_lines")


def test_words_on_two_lines_are_not_side_by_side(spark):
    from caselake.operators import register

    d = spark.createDataFrame([(1, "the\nand"), (2, "The  AND"), (3, "x THE and y"), (4, None)], "id int, t string")
    found = lambda **how: [r["id"] for r in register.search(d, "The  AND", ["t"], **how).orderBy("id").collect()]
    assert found() == [1, 2, 3] and found(side_by_side=True) == [3]


def test_a_text_is_squeezed_once_for_all_sayings(spark):
    from caselake.operators import signals

    d = spark.createDataFrame([("",)], "t string").select(signals.suspected_instructions(F.col("t"), ["a_b"], ["high"]).alias("s"))
    said = d._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("\\p{Cf}") == 1


def test_an_object_of_an_answer_is_opened_once_for_all_names(spark):
    said = registry.QUERIES["contract_shapes"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("$['entity']") == 1  # whether there is one; each field looked its value up from the top


def test_a_tree_is_opened_inside_its_row(spark):
    assert plan(spark, "answer_paths").count("Generate") == 2  # all nodes of a row, then one by one: not a row for each node and level


def test_levels_items_and_empty_containers_of_a_tree(spark):
    from caselake.operators import variants

    d = spark.createDataFrame([(1, '{"b": {}, "a": [[1, [2]], [], null, 3], "c": null}'), (2, "7"), (3, None)], "id int, t string").select("id", F.try_parse_json("t").alias("v"))
    found = lambda **how: sorted((r["id"], r["at"], r["path"], r["kind"], r["record"]) for r in variants.nodes(d, "id", "v", **how).collect())
    ends = [(1, [0, 0], "a[]", "array", "/a.1"), (1, [0, 1], "a[]", "array", "/a.2"), (1, [0, 2], "a[]", "null", "/a.3"), (1, [1], "b", "object", ""), (1, [2], "c", "null", ""), (2, [], "", "number", "")]
    assert found(levels=2, most=3, above=False) == ends
    assert found(levels=2, most=3) == sorted([*ends, (1, [], "", "object", ""), (1, [0], "a", "array", "")])


def test_pairs_of_two_sides_need_no_join(spark):
    from caselake.operators import compare

    side = lambda rows: spark.createDataFrame(rows, "doc int, id int")
    left = side([(1, 1), (1, 1), (1, None), *((2, i) for i in range(5)), (3, 1), (None, 1)])
    right = side([(1, 7), (1, 8), (2, 1), (2, 2), (4, 1), (None, 1)])
    best = spark.createDataFrame([(1, 0, 0), (2, 4, 2), (3, 3, 3), (None, 9, 9), (5, 5, 5)], "doc int, a int, b int")
    found = compare.all_or_best(left, right, "doc", best)
    want = [(1, a, b) for a in (1, 1, None) for b in (7, 8)] + [(2, 4, 2), (3, 3, 3), (None, 9, 9), (5, 5, 5)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert "Join" not in plan(spark, "few_pairs")


def test_clauses_are_counted_inside_their_row(spark):
    said = plan(spark, "clause_lists")
    assert "array_max(" in said and said.count("Generate") == 1  # every clause of every document was moved and sorted


def test_a_long_line_is_read_for_a_number_only_if_it_ends_with_one(spark):
    from caselake.operators import layout
    from tests.shapes import shapes

    ends = ["99", "1445/01/02هـ", "1445/01/02 هـ", "5 م", "٥ ه", "۷۷", "5 mm", "5.", "5 هـم", "1 2", "هـ", "5 م", "5م ", "", "12 345"]
    texts = [[f"{head} {end}", "Name: Ali", "Place: x", f"{head} {end}", "plain words that end here."] for head in ("Issued on", "one two three four five six", "Sum 4 and", "a | b", "Label:", "") for end in ends]
    d = spark.createDataFrame([(k, i, t) for k, x in enumerate(texts) for i, t in enumerate(x)], "doc int, n int, t string")
    shaped = layout.line_shapes(d, "doc", "n", "t", ["Owner"], [])
    got = {}
    for r in shaped.orderBy("doc", "n").collect():
        got.setdefault(r["doc"], []).append((r["n"], r["shape"], r["cells"]))
    for k, x in enumerate(texts):
        assert got.get(k, []) == shapes(list(enumerate(x)), {"owner"}, set()), x
    assert layout._NUMBER_ENDS in plan(spark, "line_shapes")  # every line was read from its start for one


def test_numbers_of_a_date_come_with_the_pass_that_finds_it(spark):
    assert "regexp_extract(" not in plan(spark, "dates_in_text")  # each number and the era were looked for again in every date
    odd = [f"x{text.MARK} 1/2/2024 ه, ٣", "1/2/2024 هجري 5 may 2024 رجب 1445", "من 2024 may, 2024", "ربيع 1 1445 and ربيع 11445", "MAY\n\n 2024", "may 144", "", None]
    got = [r["d"] and [(x["text"], x["start"], x["calendar"], x["y"], x["m"], x["d"], x["complete"]) for x in r["d"]] for r in spark.createDataFrame([(t,) for t in odd], "t string").select(dates.dates_in(F.col("t")).alias("d")).collect()]
    assert got == [
        [], [("5 may 2024", 14, "gregorian", 2024, 5, 5, True), ("رجب 1445", 25, "hijri", 1445, 7, 1, False)], [], [("ربيع 1 1445", 0, "hijri", 1445, 3, 1, False), ("ربيع 11445", 16, "hijri", 1445, 3, 1, False)],
        [("MAY\n\n 2024", 0, "gregorian", 2024, 5, 1, False)], [], [], None,
    ]
    spans = spark.createDataFrame([("a1b", ), (f"{text.MARK}a1{text.MARK}2",), ("",), (None,)], "t string").select(text.find_spans(F.col("t"), "([a-z])?([0-9])", 2).alias("s")).collect()
    assert [r["s"] and [(x["text"], x["start"], x["end"], x["parts"]) for x in r["s"]] for r in spans] == [[("a1", 0, 2, ["a", "1"])], [("a1", 1, 3, ["a", "1"]), ("2", 4, 5, ["", "2"])], [], None]


def test_days_of_a_calendar_table_and_no_others(spark):
    months = dates.MonthStarts(1412, (7863, 7893, 7922, 7952, 7981, 8011, 8041, 8070, 8100, 8129, 8158, 8188, 8217))
    d = spark.range(7800, 8300).selectExpr("date_from_unix_date(cast(id as int)) AS c").select("c", months.from_date(F.col("c")).alias("h"))
    for r in d.select(F.unix_date("c").alias("day"), "h", months.to_date(F.col("h.y"), F.col("h.m"), F.col("h.d")).alias("back"), "c").collect():
        assert (r["h"] is not None) == (7863 <= r["day"] < 8217) and (r["h"] is None or r["back"] == r["c"] and r["h"]["d"] >= 1)
    assert "sequence(" not in d._jdf.queryExecution().executedPlan().toString()  # a list of months was made for every day


def test_rows_of_one_row_group_are_dealt_although_it_has_many_splits(spark, tmp_path):
    from caselake import session

    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "t"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in was:
            spark.conf.set(k, "4096")
        df = spark.read.parquet(str(tmp_path / "t"))
        held = lambda x: sum(n > 0 for n in x.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        assert df.rdd.getNumPartitions() >= 4 and held(df) == 1 and held(session.spread(df, cut=True)) == 4
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    for name in ("dates_in_text", "official_hijri"):
        assert "RoundRobinPartitioning" in plan(spark, name) or "REPARTITION_BY_NUM" in plan(spark, name)


def test_a_term_in_words_is_not_read_as_a_number(spark):
    said = plan(spark, "expiry_verdicts")
    assert "try_cast(" not in said.lower()  # every word in its place made an error, with its stack, that was thrown away
    d = spark.createDataFrame([("لمده 45 يوم", 45), ("مده الوكاله سنتان", 730), ("لمده ثلاث سنوات", 1095), ("لمده شهرين", 60), ("3 years", None)], "t string, n int")
    assert d.where(~dates.days_of_duration(F.col("t")).eqNullSafe(F.col("n"))).count() == 0
