import random
import zlib
from collections import Counter

import numpy as np
import pytest

from caselake.llm import packing as P
from caselake.llm import token_attribution as A
from caselake.llm.tokens import ByteBpe, WordBpe, default_path
from tests.conftest import SMALL
from tests.llm.common import empty_docs, odd_docs, odd_rows, write

MEDIUM = "/root/testdata/sf0.01"

TEXTS = ["", "Hello, it's 3 o'clock", "ΑΣ ς é é ǅ <|endoftext|> a", "  tabs\t and\nlines ", "漢字 😀 text", "a" * 500, "don't WON'T İ"]


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_cached_ids_equal_the_library(spark):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    enc = WordBpe(default_path("word_bpe_49k.json"), cache=50)
    assert [np.frombuffer(enc.encode(t), "<u4").tolist() for t in texts] == plain_ids(texts)


def test_cached_lengths_equal_the_library(spark):
    import public_tokenizers

    enc = ByteBpe(default_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cache=50)
    for t in TEXTS + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]:
        want = [len(enc.encoding.decode_single_token_bytes(i)) for i in enc.encoding.encode_ordinary(t)]
        assert enc.lengths(t).tolist() == want and sum(want) == len(t.encode())


@pytest.mark.parametrize("rule", A.RULES)
def test_attribution_against_loops(rule):
    rng = random.Random(9)
    for _ in range(100):
        lengths = np.array([rng.randrange(1, 6) for _ in range(rng.randrange(20))], np.int64)
        total = int(lengths.sum())
        bounds = np.array(sorted({0, total, *(rng.randrange(total + 1) for _ in range(4))}), np.int64) if total else np.array([0, 0])
        want = [0] * (len(bounds) - 1)
        at = 0
        for n in lengths.tolist():
            share = [max(0, min(at + n, bounds[s + 1]) - max(at, bounds[s])) for s in range(len(want))]
            touched = [s for s, x in enumerate(share) if x]
            want[{"first": touched[0], "last": touched[-1], "most": int(np.argmax(share))}[rule]] += 1
            at += n
        got, crossing = A.attribute(lengths, bounds, rule)
        assert got.tolist() == want and crossing.sum() <= len(lengths)


def test_sections(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one\n\ntwo\n"), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    rows = A.op7_offset_mapped_tokens(spark, write(docs, tmp_path)).orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["section"], r["start"], r["length"]) for r in rows] == [(1, 0, 0, 4), (1, 1, 4, 1), (1, 2, 5, 4), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 1)]
    with pytest.raises(ValueError, match="rule"):
        A.section_tokens(docs, "x", "y", "odd")


def check_packing(rows, texts, size=P.SIZE):
    """Pieces are exact, and every sequence is gapless."""
    ids = {}
    for (i, _), t in zip(texts, plain_ids([t or "" for _, t in texts]), strict=True):
        ids.setdefault(i, []).append([*t, 0])
    want = Counter((i, k, k * size, len(x[k * size : (k + 1) * size]), zlib.crc32(np.array(x[k * size : (k + 1) * size], "<u4").tobytes())) for i, all_ in ids.items() for x in all_ for k in range(-(-len(x) // size)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(by)


def test_packing_whole_table(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = P.op8_best_fit_packing(spark, SMALL).collect()
    assert check_packing(rows, texts) <= -(-sum(r["length"] for r in rows) // P.SIZE) * 1.06 + 1


def test_packing_odd_and_empty(spark, tmp_path):
    rows = P.op8_best_fit_packing(spark, write(odd_docs(spark), tmp_path / "a")).collect()
    check_packing(rows, [r[:2] for r in odd_rows()])
    assert P.op8_best_fit_packing(spark, write(empty_docs(spark), tmp_path / "b")).count() == 0


def test_token_sections_odd_and_empty(spark, tmp_path):
    assert A.op7_offset_mapped_tokens(spark, write(odd_docs(spark), tmp_path / "a")).select("doc_id").distinct().count() == 16
    assert A.op7_offset_mapped_tokens(spark, write(empty_docs(spark), tmp_path / "b")).count() == 0


def test_plan_holds_the_histogram_and_is_tight():
    rng = np.random.default_rng(1)
    for scale in (5, 300):
        h = Counter(np.clip(rng.lognormal(4, 1, 40 * scale).astype(int), 1, 512).tolist())
        used, bound = P.plan(dict(h), size=512)
        have = Counter()
        for found, times in used:
            assert sum(k * n for k, n in found.items()) <= 512 and times > 0
            for k, n in found.items():
                have[k] += n * times
        assert have == h
        assert bound <= sum(t for _, t in used) <= np.ceil(sum(k * n for k, n in h.items()) / 512) * 1.02 + 1


def test_plan_beats_best_fit_where_that_is_poor():
    """Triples that fill a sequence exactly: the bound is their number, and best fit misses most of them."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(400, 900, 2000), rng.integers(400, 900, 2000)
    h = dict(Counter(np.concatenate([a, b, 2048 - a - b]).tolist()))
    used, bound = P.plan(h)
    fit = sum(t for _, t in P._fill(h, 2048))
    assert sum(k * n * t for found, t in used for k, n in found.items()) == 2000 * 2048
    assert bound == 2000 and sum(t for _, t in used) < 2000 + (fit - 2000) / 3


def test_plan_is_the_rounded_program_where_best_fit_needs_as_many(spark):
    """On the lengths of the table best fit is no better, and the configurations returned are those of the program."""
    pieces = P.pieces(spark.read.parquet(f"{MEDIUM}/documents.parquet"), default_path("word_bpe_49k.json"))
    h = {r["length"]: r["count"] for r in pieces.where(f"length < {P.SIZE}").groupBy("length").count().collect()}
    used, bound = P.plan(h)
    left, want = dict(h), []
    for most in P.ROUNDS:
        left = {k: v for k, v in left.items() if v}
        if left:
            want += P.rounded(left, P.solve(left, P.SIZE, most)[0])
    want += P._fill(left, P.SIZE)
    assert used == want and used != P._fill(h, P.SIZE)
    assert bound <= sum(t for _, t in used) <= sum(t for _, t in P._fill(h, P.SIZE))


def test_rows_without_id_or_text_are_dealt_over_the_buckets(spark):
    """A third of all rows is one and the same; slots stay gapless and no bucket holds them all."""
    docs = spark.createDataFrame([(None, None)] * 400 + [(i, f"word {i}") for i in range(800)], "doc_id long, text string")
    rows = P.pack(docs, default_path("word_bpe_49k.json")).collect()
    assert len(rows) == 1200
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= P.SIZE


def test_knapsack_against_brute_force():
    lengths, weights = np.array([3, 5, 7]), np.array([3.1, 5.6, 7.2])
    value, take = P._best_values(lengths, weights, 17)
    found = P._trace(take, 17)
    best = max(3.1 * a + 5.6 * b + 7.2 * c for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 17)
    assert abs(sum(weights[list(lengths).index(k)] * n for k, n in found.items()) - best) < 1e-9
    assert abs(value[17] - best) < 1e-9
