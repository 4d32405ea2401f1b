import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselake.llm import bagminhash as B
from caselake.llm import common
from caselake.llm import substring_dedup as S
from caselake.llm.common import WORD, Rolling, WordHashes, hash_words, sliding_min
from tests.conftest import SMALL
from tests.llm.common import empty_docs, odd_docs, odd_rows, sentence, write


def brute_repeats(rows, window=S.WINDOW):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - window + 1 if i is not None else 0):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_odd_documents(spark, tmp_path):
    got = S.op2_substring_dedup(spark, write(odd_docs(spark), tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats([r[:2] for r in odd_rows()])


def test_substring_random_small_alphabet(spark, tmp_path):
    """Many overlapping repeats, branches and periodic texts."""
    rng = random.Random(5)
    parts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20, 130))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    got = S.op2_substring_dedup(spark, write(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows)


def test_substring_passage_in_a_unit_that_a_document_repeats(spark, tmp_path):
    """The edges across the passage's ends occur several times in the same first document, also in rows that share its id."""
    passage, before, after = sentence(120, "p"), sentence(70, "q"), sentence(70, "r")
    unit = f"{before} {passage} {after}"
    rows = [(3, passage), (5, " ".join([unit] * 3)), (5, f"{unit} {sentence(40, 's')} {unit}"), (7, f"{sentence(30, 't')} {unit} {unit}")]
    got = sorted(map(tuple, S.op2_substring_dedup(spark, write(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)).collect()), key=repr)
    assert got == brute_repeats(rows)
    assert [r[2] for r in got if r[0] == 5 and r[1] == 780] == [360]


def test_substring_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, S.op2_substring_dedup(spark, SMALL).collect()), key=repr) == brute_repeats(rows)


def test_remove_keeps_rows_columns_and_spacing(spark):
    docs = odd_docs(spark)
    got = S.remove_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in got.where("doc_id is not null").collect()}
    assert texts[2] == "" and texts[3] == "tail" and texts[7] == "" and texts[8] == "   \n\t " and texts[14].startswith("wq0")
    assert texts[5].split() == odd_rows()[4][1].split()[:30]


def test_empty_tables(spark, tmp_path):
    path = write(empty_docs(spark), tmp_path)
    assert S.op2_substring_dedup(spark, path).count() == 0
    assert B.op4_bagminhash_near_dedup(spark, path).count() == 0


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_rolling_hash_and_sliding_minimum(xs, width):
    x = np.array(xs, np.uint64)
    r = Rolling(x)
    spans = {}
    for i in range(len(x)):
        for j in range(i + 1, len(x) + 1):
            h = int(r.span(np.array([i]), np.array([j]))[0])
            assert spans.setdefault((h, j - i), tuple(xs[i:j])) == tuple(xs[i:j])
    assert sliding_min(x, width).tolist() == [min(xs[i : i + width]) for i in range(len(xs) - width + 1)]


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows, least=0.8):
    bags = [(i, bag(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for n, (_, b) in enumerate(bags):
        for s in b:
            by[s].add(n)
    for n, (i, b) in enumerate(bags):
        for m in {x for s in b for x in by[s] if x > n}:
            j, o = bags[m]
            both = sum(min(b[s], o[s]) for s in b)
            if both >= least * (sum(b.values()) + sum(o.values()) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("odd", [True, False])
def test_near_classes(spark, tmp_path, odd):
    path = write(odd_docs(spark), tmp_path) if odd else SMALL
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = B.op4_bagminhash_near_dedup(spark, path).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows)
    assert all(r["class_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None) for r in got)


def test_near_copies_that_a_center_does_not_reach(spark, tmp_path):
    """A chain of edits: ends are unlike, neighbours are alike; and a group of many copies of unlike strength."""
    rng = random.Random(1)
    words = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(300)] = f"n{rng.random()}"
    path = write(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    got = {r["doc_id"]: r["class_id"] for r in B.op4_bagminhash_near_dedup(spark, path).collect()}
    assert got == brute_classes(rows)


def test_weighted_signatures_are_unbiased():
    cache = WordHashes()
    docs = [["a", "b", "c", "d", "e"] * 9, ["a", "b", "c", "d", "e"] * 6 + ["q", "r", "s"]]
    doc, s, n = B.shingles(docs, cache)
    sig = B.signatures(doc, s, n, 2, 6000)
    x, y = ({h: c for d, h, c in zip(doc, s, n, strict=True) if d == i} for i in (0, 1))
    true = sum(min(x.get(h, 0), y.get(h, 0)) for h in x | y) / sum(max(x.get(h, 0), y.get(h, 0)) for h in x | y)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.025


def test_components(spark, tmp_path):
    from caselake.llm.common import Scratch

    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["id"]: r["label"] for r in B.components(Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def test_drop_keeps_one_of_each_class(spark):
    kept = sorted(r["doc_id"] for r in B.drop_near_copies(odd_docs(spark)).where(F.col("doc_id").isNotNull()).select("doc_id").collect())
    assert kept == [1, 4, 5, 6, 7, 8, 9, 9, 10, 12, 13, 14]


def test_hash_words_starts():
    h, starts = hash_words([["a"], [], ["b", "a"]], WordHashes(limit=1))
    assert starts.tolist() == [0, 1, 1, 3] and h[0] == h[2] != h[1]


def test_cells_bound_the_overlap_from_above():
    rng = random.Random(5)
    lists = [[f"w{rng.randrange(30 if i % 2 else 3000)}" for _ in range(rng.randrange(5, 400))] for i in range(20)]
    lists += [[w if rng.random() > 0.03 else "new" for w in x] for x in lists]
    doc, s, count = B.shingles(lists, WordHashes(), 2)
    rows = B.cell_counts(doc, s, count, len(lists))
    bags = [dict(zip(s[doc == i].tolist(), count[doc == i].tolist(), strict=True)) for i in range(len(lists))]
    for i in range(len(lists)):
        assert rows[i, -1] == sum(bags[i].values())
        for j in range(i):
            apart = sum(abs(bags[i].get(k, 0) - bags[j].get(k, 0)) for k in bags[i].keys() | bags[j].keys())
            assert np.bitwise_count(rows[i, :-1] ^ rows[j, :-1]).sum() <= apart


def test_joins_of_hot_keys_against_a_plain_join(spark, monkeypatch):
    """A key of half of all rows is dealt to several tasks and joins like any other; keys without a partner go."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = [(0 if i % 2 else i % 7, i) for i in range(400)]
    big = spark.createDataFrame(rows, "k long, i long")
    counts = Counter(k for k, _ in rows)
    small = spark.createDataFrame([(k, n, f"v{k}") for k, n in counts.items() if k != 3] + [(99, 0, "none")], "k long, n long, v string")
    got = common.join_counted(big, small, ["k"], 400, ["i"])
    assert sorted(tuple(r) for r in got.select("k", "i", "v").collect()) == sorted((k, i, f"v{k}") for k, i in rows if k != 3)
    assert got.columns == ["k", "i", "v"]


def test_equal_words_are_told_by_digests(spark):
    """Two texts over two words that collide in polynomial hashes modulo 2^64 are no copies of each other."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = (" ".join("xy"[bit ^ flip] for bit in bits) for flip in (0, 1))
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r["doc_id"]: r["copy_of"] for r in B.near_classes(docs).collect()} == {1: 1, 2: 2, 3: 1}
