"""Operator 13 against the definition of a run, word by word."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselake.llm import tandem_runs as runs

from .common import empty_docs, odd_docs, sentence, write


def runs_by_loop(s, least):
    found = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in found.items())


def squares_by_loop(s):
    """Every word that is twice a primitive word."""
    n, found = len(s), set()
    for k in range(1, n // 2 + 1):
        for i in range(n - 2 * k + 1):
            half = tuple(s[i : i + k])
            if half == tuple(s[i + k : i + 2 * k]) and not any(k % d == 0 and half == half[:d] * (k // d) for d in range(1, k)):
                found.add(half + half)
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 6), st.sampled_from([2, 4, 12]))
def test_runs_and_vocabulary(tail, times, least):
    s = np.array(tail[:15] * times + tail, np.int64)
    assert runs.runs_of(s, least) == runs_by_loop(s.tolist(), least)
    if len(s) > 1:
        tree = runs.SuffixTree(s)
        at, half = runs.covering_squares(tree, runs.block_starts(tree))
        keep = runs.primitive(tree, at, half)
        nodes = runs.vocabulary(s, tree, at[keep], half[keep]) if len(at) else []
        words = [tuple(s[tree.order[lo] :][: 2 * k].tolist()) for lo, _, k in nodes]
        assert len(words) == len(set(words)) and set(words) == squares_by_loop(s.tolist())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 5)), min_size=1, max_size=5))
def test_stretches_lose_no_run(parts):
    lists = [x * n for x, n in parts]
    assert runs.block_runs(lists) == [runs_by_loop(x, runs.LEAST) for x in lists]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs_by_loop(words, 12)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in found), default=None)
    start, length, period, milli = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), start, length, period, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


TEN = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
#: Runs that overlap, nest, touch, come again elsewhere and fall one word short.
TEXTS = [
    "a b c " * 4, "a b c d e f " * 2, "a b c d e f a b c d e", "x " * 12, "x " * 11, "x " * 12 + "y " * 12, "a b " * 6 + "a c " * 6, sentence(20) + " " + "p q r s t u v " * 3 + sentence(20), ("a b " * 6 + "c ") * 3,
    sentence(30, "m") + " " + sentence(5, "n") + " " + sentence(30, "m"), (sentence(40, "z") + " ") * 2, "漢 字 😀 " * 5, "a b a b " * 8, "tail",
]


def test_rows(spark, tmp_path):
    docs = odd_docs(spark).where("n_chars is null or n_chars < 20000").select("doc_id", "text", "spans", "k")
    rows = [(1000 + i, t, "s", "k") for i, t in enumerate(TEXTS)] + [(i, TEXTS[j % len(TEXTS)] + " " + sentence(15 + j), "s", "k") for j, i in enumerate(TEN)]
    docs = docs.union(spark.createDataFrame(rows, "doc_id long, text string, spans string, k string"))
    got = [tuple(r) for r in runs.op13_tandem_runs(spark, write(docs, tmp_path / "t")).collect()]
    want = [expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r[1] for r in want) > 20


def test_no_rows(spark, tmp_path):
    assert runs.op13_tandem_runs(spark, write(empty_docs(spark), tmp_path / "t")).count() == 0


@pytest.mark.parametrize("kind", ["one word", "no repetition", "long period", "two words"])
def test_long_texts_stay_near_linear(kind):
    n = 40_000
    s = {"one word": [0] * n, "no repetition": list(range(n)), "long period": [i % 9_000 for i in range(n)], "two words": np.random.default_rng(5).integers(0, 2, n).tolist()}[kind]
    got = runs.block_runs([[str(x) for x in s]])[0]
    if kind == "one word":
        assert got == [(0, n, 1)]
    elif kind == "long period":
        assert got == [(0, n, 9_000)]
    elif kind == "no repetition":
        assert got == []
    else:
        assert got and all(s[i : i + length - q] == s[i + q : i + length] for i, length, q in got)
