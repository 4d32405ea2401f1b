"""Operators 11 and 12 against loops."""

import hashlib
import re
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselake.llm import fill_middle, rendezvous

from .common import empty_docs, odd_docs, odd_rows, write


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(odd_docs(spark), tmp_path_factory.mktemp("odd") / "t")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(empty_docs(spark), tmp_path_factory.mktemp("empty") / "t")


def gapless(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(shards))
    return all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_shards_of_odd_rows(spark, odd):
    rows = rendezvous.op11_rendezvous_shards(spark, odd).collect()
    want = sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows())
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in rows) == want
    assert gapless(rows, 16) and {r.law for r in rows} == {"key"}
    assert all(r.grown_shard in (r.shard, 16) for r in rows)
    assert len({(r.doc_id, r.shard) for r in rows}) == len({r.doc_id for r in rows})


def test_shards_of_no_rows(spark, empty):
    assert rendezvous.op11_rendezvous_shards(spark, empty).count() == 0


def test_weights_and_growth(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    weights = (1.0, 2.0, 5.0)
    got = rendezvous.place(rows, "doc_id", weights, added=2.0).collect()
    shares = [sum(r.shard == s for r in got) / len(got) for s in range(3)]
    assert all(abs(share - w / 8) < 0.015 for share, w in zip(shares, weights))
    moved = [r for r in got if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {3} and abs(len(moved) / len(got) - 0.2) < 0.015
    grown = {r.doc_id: r.shard for r in rendezvous.place(rows, "doc_id", (*weights, 2.0)).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    with pytest.raises(ValueError):
        rendezvous.place(rows, "doc_id", (1.0, 0.0))


def test_a_third_of_all_rows_alike(spark):
    """Equal rows and null ids in a third of the rows: slots stay gapless and the rows of a copy are dealt by chunk."""
    rows = spark.range(9_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(1).alias("size"))
    got = rendezvous.place(rows, "doc_id", (1.0,) * 4).collect()
    assert len(got) == 9_000 and gapless(got, 4)
    nulls = [r for r in got if r.doc_id is None]
    assert len(nulls) == 3_000 and len({r.shard for r in nulls}) == 1


def test_the_exchange_of_rows_is_used_twice(spark, odd):
    df = rendezvous.op11_rendezvous_shards(spark, odd)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "Python" not in plan


def cut_by_loop(text, doc_id, unit=r"[^\n]*\n|[^\n]+"):
    u = re.findall(unit, text)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(u), "plain", None, None, text
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


LINES = [(i, t) for i, t in enumerate(["a\nb\nc", "\n", "\n\n\n", "a\r\nb\n", "one <P> two\nthree", "x<\n<S\n>M>", "漢字\n😀😀\nтекст", "<", "no line end", "\n" * 5000, "w x\n" * 3000, "a b\x85c\n d\x0b"])]


def test_middles_of_odd_rows(spark, tmp_path):
    docs = odd_docs(spark).select("doc_id", "text", "pos", "label").union(spark.createDataFrame([(i * 31, t, 1, "l") for i, t in LINES], "doc_id long, text string, pos int, label string"))
    path = write(docs, tmp_path / "t")
    rows = docs.select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        n, form, p, m, out = cut_by_loop(text or "", doc_id)
        want.append((doc_id, n, form, p, m, sha(out), sha(text or "")))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in fill_middle.op12_lookaround_fill_middle(spark, path).collect())
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_middles_of_no_rows(spark, empty):
    assert fill_middle.op12_lookaround_fill_middle(spark, empty).count() == 0


def test_rate_and_forms(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd").alias("text"))
    by = dict(fill_middle.fill_in_middle(docs, rate=40, spm_rate=25).groupBy("form").count().collect())
    assert abs(by["plain"] - 2400) < 120 and abs(by["spm"] - 400) < 80
    again = fill_middle.fill_in_middle(docs, seed=8).where("form <> 'plain'").select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t"))
    assert again.where("t <> 'a\nb\nc\nd'").count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1. \n\t😀漢", max_size=30), min_size=1, max_size=20))
def test_boundaries_cut_where_units_end(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for unit, (one, _) in fill_middle.GRAMMARS.items():
        got = [r.u for r in df.select(fill_middle.units(F.col("t"), unit).alias("u")).collect()]
        assert got == [re.findall(one, t) for t in texts], unit
