import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselake.llm import cotraining as C
from caselake.llm import langid as G
from caselake.llm import toxicity as X
from tests.conftest import SMALL
from tests.llm.common import empty_docs, odd_docs, odd_rows, write

MEDIUM = "/root/testdata/sf0.01"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = [int(x) for x in rng.integers(0, 6, 4)]
        score = rng.normal(size=(sum(counts), 3))
        doc = np.repeat(np.arange(4), counts)
        got = G.viterbi(score, doc, 4, 0.7)
        at = 0
        for n in counts:
            value = lambda p: sum(score[at + i, k] for i, k in enumerate(p)) - 0.7 * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
            if n:
                assert abs(value(got[at : at + n].tolist()) - max(map(value, itertools.product(range(3), repeat=n)))) < 1e-9
            at += n


def test_language_held_out_accuracy(spark):
    rows = G.op5_viterbi_language_id(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97


def test_language_spans_of_mixed_text(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = G.fit(docs)
    pick = {r["lang"]: r["text"][:400] for r in docs.where("length(text) > 500 and lang in ('en', 'de')").collect()}
    mixed = spark.createDataFrame([(1, pick["en"] + "\n" + pick["de"]), (2, "Привет мир это текст")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in G.identify(mixed, model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de"] and abs(got[1]["spans"][0]["end"] - 400) < 60
    assert got[2]["lang_pred"] in model.langs


def test_language_odd_and_empty(spark, tmp_path):
    odd, none = write(odd_docs(spark), tmp_path / "a"), write(empty_docs(spark), tmp_path / "b")
    rows = G.op5_viterbi_language_id(spark, odd).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (6, 7, 8)} == {"und"} and all(r["lang_pred"] == "en" for r in rows if r["doc_id"] in (1, 12))
    assert G.op5_viterbi_language_id(spark, none).count() == 0


def brute_kernel(a, b):
    """Three-character subsequences by their weights."""

    def features(s):
        out = {}
        for i, j in X.GAPS:
            for p in range(len(s) - j):
                g = s[p] + s[p + i] + s[p + j]
                out[g] = out.get(g, 0) + X.DECAY ** (j + 1)
        return out

    x, y = features(a), features(b)
    return sum(v * y.get(g, 0) for g, v in x.items())


def test_kernel_against_brute_force():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    marks = ["abcabc", "caéb", "bbca"]
    got = X.Kernel(marks).values(words)
    want = [[min(1.0, brute_kernel(w, z) / brute_kernel(z, z)) ** 2 for z in marks] for w in words]
    assert np.allclose(got, want)


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "toxic")
    rows = X.op10_subsequence_kernel_toxicity(spark, MEDIUM).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    rows = [r for r in rows if r["held_out"]]
    assert len(rows) > 40
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    assert sum(clean) / len(clean) < 0.05 and sum(toxic) / len(toxic) > 0.6


def test_one_very_long_document_does_not_stop_the_fit(spark):
    """The first toxic documents by hash are longer than the room of their class; the others, and some of their sentences, train the model."""
    insult, fine = "you worthless idiot number {0}. go away {0}.", "the garden number {0} was green. we sat there {0}."
    rows = [(i, (insult if i % 2 else fine).format(i), i % 2) for i in range(120)]
    order = [r.id for r in spark.range(120).where("id % 2 = 1").orderBy("id").selectExpr("id", "xxhash64(id) as h").orderBy("h").collect()]
    rows = [(i, t + " the river was calm." * 400 if i in order[:3] else t, y) for i, t, y in rows]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = X.fit(docs, labels, max_chars=12_000)
    assert model is not None
    scores = {r.doc_id: r.score for r in X.score(docs, model).collect()}
    short = [i for i, t, _ in rows if len(t) < 200]
    assert all((scores[i] >= 0.5) == (i % 2 == 1) for i in short)
    cut = docs.select(F.length(X.part_of(F.col("text"), 500)).alias("n")).collect()
    assert all(r.n <= 500 for r in cut)


def test_gapped_insults_are_near():
    k = X.Kernel(["idiot", "worthless"])
    v = k.values(["idiiot", "idxiot", "worthhless", "therein", "idiot"])
    assert v[0, 0] > 0.3 and v[1, 0] > X.ACTIVE and v[2, 1] > 0.3 and v[3].max() < 0.1 and v[4, 0] == 1.0
    doc, values, _ = X.Sentences(k).of(["you i-d-i-o-t.", "you fine thing", "w.o.r.t.h.l.e.s.s", "a W*o*r*t*hless one"])
    assert doc.tolist() == [0, 3] and min(values[0, 0], values[1, 1]) > 0.999


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, None, None), (None, 1, 1)], [(1, 1, 1), (1, 0, 0), (2, 0, 1), (99, 1, 0)]])
def test_models_odd_and_empty(spark, tmp_path, labels):
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    odd, none = write(odd_docs(spark), tmp_path / "a", labels=t), write(empty_docs(spark), tmp_path / "b", labels=t)
    for f in (X.op10_subsequence_kernel_toxicity, C.op9_cotraining_quality):
        rows = f(spark, odd).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
        assert f(spark, none).count() == 0


def test_quality_classifier_on_held_out_labels(spark):
    """Labels of ids divisible by four are kept from the fit; only they are counted."""
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = C.quality(docs, labels.where("doc_id % 4 != 0")).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.93
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) / len(good) > 0.95


def in_memory(xs):
    """The naming of a pool that is at hand."""
    rows = np.arange(len(xs[0]))

    def ask(weights, taken, take):
        return {key: [(int(i), xs[0][i], xs[1][i]) for i in best] for key, best, _ in C.surest(weights, taken, take, rows, xs)}

    return ask


def test_pseudo_labels_help_the_weak_view():
    rng = np.random.default_rng(0)
    y = (rng.random(900) < 0.5).astype(float)
    a, b = y[:, None] * 3 + rng.normal(size=(900, 1)), y[:, None] * 2 + rng.normal(size=(900, 2))
    model = C.co_train([a[:30], b[:30]], y[:30], in_memory([a[30:600], b[30:600]]), 0.5)
    assert ((model.scores([a[600:], b[600:]]) >= 0.5) == (y[600:] == 1)).mean() > 0.9


def test_surest_rows_of_all_tasks_against_brute_force(spark):
    """The lists named over many tasks are those of a plain sort of all rows, ties by row, without the rows already named."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(500, 3)).round(1), rng.normal(size=(500, 2)).round(1)
    weights = [[rng.normal(size=4) * 3, rng.normal(size=3) * 3] for _ in range(2)]
    pool = spark.createDataFrame([(i, a[i].astype("<f4").tobytes(), b[i].astype("<f4").tobytes()) for i in range(500)], "row long, text_x binary, meta_x binary").repartition(7)
    taken, take = {(0, 1, 1): {3, 5, 7}, (1, 0, 0): set(range(100))}, {1: 12, 0: 5}
    got = C.naming_over(pool)(weights, taken, take)
    for m in (0, 1):
        for k, x in enumerate((a, b)):
            z = np.float32(x).astype(float) @ weights[m][k][:-1] + weights[m][k][-1]
            for label, n in take.items():
                p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                sure = p if label else 1 - p
                want = sorted((-s, i) for i, s in enumerate(sure) if s >= C.SURE and i not in taken.get((m, k, label), ()))[:n]
                assert [r for r, *_ in got.get((m, k, label), [])] == [i for _, i in want]


def test_round_by_round_against_a_plain_loop():
    """Brute force: co-training written as one loop a model gives the same weights."""
    rng = np.random.default_rng(7)
    y = (rng.random(400) < 0.6).astype(float)
    a, b = y[:, None] * 2 + rng.normal(size=(400, 2)), y[:, None] * 3 + rng.normal(size=(400, 1))
    xs, pool, labels = [a[:60], b[:60]], [a[60:], b[60:]], y[:60]
    model = C.co_train(xs, labels, in_memory(pool), 0.6, rounds=3, take=10)
    balance = np.where(labels == 1, 0.6 / labels.mean(), 0.4 / (1 - labels.mean()))
    told = [{}, {}]  # documents that each view has been told, with their labels
    for step in range(4):
        fits = [C.fit_logistic(np.vstack([xs[k], *(pool[k][i][None] for i in told[k])]), np.append(labels, list(told[k].values())), np.append(balance, np.full(len(told[k]), 0.5))) for k in (0, 1)]
        if step == 3:
            break
        new = [{}, {}]
        for k in (0, 1):
            p = C.sigmoid(C.apply(fits[k], pool[k]))
            for label, n in ((1, 6), (0, 4)):
                sure = p if label else 1 - p
                best = sorted((i for i in range(340) if sure[i] >= C.SURE and i not in told[1 - k]), key=lambda i: (-sure[i], i))[:n]
                new[1 - k] |= dict.fromkeys(best, label)
        for k in (0, 1):
            told[k] |= new[k]
    for k in (0, 1):
        assert np.allclose(model.weights[k], fits[k], atol=1e-4)
