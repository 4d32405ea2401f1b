import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from caselake.llm import decontamination as D
from caselake.llm import license_scan as L
from caselake.llm import quality_rules as Q
from caselake.llm.common import WORD
from tests.conftest import SMALL
from tests.llm.common import empty_docs, odd_docs, odd_rows, write


def brute_tiles(item, text, least):
    """Longest unmarked common run, again and again."""
    fa, fb, out = [True] * len(item), [t != 0 for t in text], []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and fa[i + n] and fb[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        fa[i : i + n] = fb[j : j + n] = [False] * n
        out.append(n)


def test_tiles_against_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))]
        text = [rng.randrange(0, 5) for _ in range(rng.randrange(0, 50))]
        got = D.tiles(item, text, 3)
        assert all(item[i : i + n] == text[j : j + n] and 0 not in text[j : j + n] for i, j, n in got)
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for *_, n in got) == len({x for _, j, n in got for x in range(j, j + n)})
        assert max((n for *_, n in got), default=0) == max(brute_tiles(item, text, 3), default=0)


def _bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    w = item.split()
    rows = [
        (1, "intro " + item.upper() + " outro"), (2, " ".join(w[6:]) + " and then " + " ".join(w[:6])), (3, " ".join(w[:5]) + " x"), (4, " ".join(reversed(w))), (5, None), (6, ""), (None, item), (7, item), (7, item),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = _bench(spark, [(1, item), (2, None), (3, ""), (4, "too short"), (1, item), (None, "one two three four five six seven")])
    got = Counter((r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench).collect())
    assert got == Counter({(1, 1): 2, (2, 1): 2, (None, 1): 2, (7, 1): 4})
    assert D.leaks(docs, _bench(spark, [])).count() == 0
    assert sorted(r["doc_id"] or -1 for r in D.drop_leaks(docs, bench).collect()) == [-1, 3, 4, 5, 6]


def brute_tiles(item, text, least):
    """Greedy tiling by trying every pair of places, longest match first (then the earliest in the item and the text)."""
    free_a, free_b, found = [True] * len(item), [True] * len(text), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return found
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        found.append(n)


def test_leaks_against_brute_force(spark):
    """Whole tile sets of random texts that share pieces of items, in any order and more than once, and the rows that reach the share."""
    rng = random.Random(12)
    items = [" ".join(f"t{rng.randrange(40)}" for _ in range(rng.randrange(5, 20))) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            w = rng.choice(items).split()
            k = rng.randrange(len(w))
            parts += [f"x{rng.randrange(5)}"] * rng.randrange(3) + w[k : k + rng.randrange(3, 14)]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_covered"], r["n_tiles"], r["longest"]) for r in D.leaks(docs, _bench(spark, list(enumerate(items)))).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            tiles = brute_tiles(x.split(), t.split(), D.MIN_TILE)
            if tiles and sum(tiles) >= D.COVERAGE * len(x.split()):
                want[d, i] = (sum(tiles), len(tiles), max(tiles))
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == want[k] for k in want), [(k, got[k], want[k]) for k in want if got[k] != want[k]][:3]


def test_leaks_with_seeds_in_a_third_of_the_rows(spark):
    """Five common words that every item and a third of the documents hold bring few pairs together, and no leak is lost; an item of common words alone is found too."""
    hot = "this is a very common phrase"
    items = [f"{hot} " + " ".join(f"q{i}w{j}" for j in range(12)) for i in range(40)] + [hot]
    texts = [f"d{i} {hot} e{i}" if i % 3 == 0 else " ".join(f"p{i}x{j}" for j in range(10)) for i in range(600)]
    texts += [f"{items[i]} and more" for i in range(0, 40, 5)]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), _bench(spark, list(enumerate(items)))
    df = D.leaks(docs, bench)
    got = {(r["doc_id"], r["item_id"]) for r in df.collect()}
    assert got == {(600 + i // 5, i) for i in range(0, 40, 5)} | {(d, 40) for d, t in enumerate(texts) if hot in t}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "__part" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_probes_leave_out_frequent_seeds():
    """What is left out covers less than the share, and the rarest seeds are asked first."""
    counted = [{"n": 100 if i < 6 else 1, "seed": i, "at": i} for i in range(12)]
    batch = pa.RecordBatch.from_pylist([{"no": 7, "size": 12, "counted": counted}])
    (out,) = D._probes(5, 0.5)(iter([batch]))
    seeds = set(out.column(1).to_pylist())
    left = sorted(set(range(12)) - seeds)
    assert left and left == list(range(len(left))) and len({a + j for a in left for j in range(5)}) < 0.5 * 16
    assert set(range(6, 12)) <= seeds


def test_leaks_find_planted_items(spark):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = sorted(map(tuple, D.leaks(docs, bench).collect()))
    texts = {r["doc_id"]: " ".join(D.TOKEN.findall(r["text"].lower())) for r in docs.collect()}
    items = {r["item_id"]: " ".join(D.TOKEN.findall(r["text"].lower())) for r in bench.collect()}
    planted = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert planted and planted <= {r[:2] for r in whole}


def test_scans_odd_and_empty(spark, tmp_path):
    bench = _bench(spark, [(1, odd_rows()[0][1])])
    odd = write(odd_docs(spark), tmp_path / "odd", benchmark=bench)
    none = write(empty_docs(spark), tmp_path / "none", benchmark=_bench(spark, []))
    assert sorted(r["doc_id"] or -1 for r in D.op3_greedy_string_tiling(spark, odd).collect()) == [-1, 1, 2, 3]
    for f in (Q.op1_distribution_divergence, L.op6_fuzzy_license_notices):
        assert f(spark, odd).count() == len(odd_rows()) and f(spark, none).count() == 0
    assert D.op3_greedy_string_tiling(spark, none).count() == 0
    r = L.op6_fuzzy_license_notices(spark, odd).where("doc_id = 6").first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["base_labels"], r["labels"], r["score"]) == (0, 0, None, "", "", 0.0)
    r = Q.op1_distribution_divergence(spark, odd).where("doc_id = 6").first()
    assert (r["n_words"], r["base_failed"], r["kept"]) == (0, True, False)


def test_base_counts_against_loops():
    rng = random.Random(6)
    for _ in range(200):
        t = "".join(rng.choice(["a", "b", " ", "\n", "#", "é", " a b a b a ", "\x0b"]) for _ in range(rng.randrange(60)))
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        assert Q.base_counts(t) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again))


def test_divergence():
    p, q = np.array([1, 0]), np.array([0, 1])
    assert Q.distance(p, q) == 1.0 and Q.distance(p, p) == 0.0 and Q.distance(p * 0, q) == 0.0


def test_quality_verdicts(spark):
    rows = Q.op1_distribution_divergence(spark, SMALL).join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) / len(good) > 0.9


def brute_phrases(text):
    words = L.TOKEN.findall(text.translate(L.LOWER))
    places, labels = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return sorted(places), labels


def test_phrases_against_loops():
    rng = random.Random(8)
    for _ in range(200):
        t = rng.choice([" ", "", "-"]).join(rng.choice(["CC", "by", " ", "general", " public ", "license", "all rights", " reserved", "x"]) for _ in range(rng.randrange(30)))
        words = L.TOKEN.findall(t.translate(L.LOWER))
        joined = f" {' '.join(words)} " if words else ""
        places, labels = L.phrase_places(joined, [i + 1 for i, c in enumerate(joined[:-1]) if c == " "])
        assert (sorted(places), labels) == brute_phrases(t)


@pytest.mark.parametrize("edits", [0, 1, 3, 4])
def test_fuzzy_notices_within_the_bound(edits):
    notice, label, most = L.NOTICES[0]
    rng = random.Random(edits)
    for _ in range(30):
        t = list(notice)
        for _ in range(edits):
            t[rng.randrange(len(t))] = "z"
        found = L.fuzzy_matches(f" some words {''.join(t)} more words ")
        assert any(x[2] == label and x[3] <= most for x in found)
    assert L.fuzzy_matches(" nothing of the kind under the sun ") == []


def test_spans_are_word_positions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "A b. Licensed under the Apache Licence, Version 2.0. end")], "doc_id long, text string")
    r = L.op6_fuzzy_license_notices(spark, write(docs, tmp_path)).first()
    assert r["labels"] == "apache-2.0" and (r["spans"][0]["first_word"], r["spans"][0]["last_word"], r["spans"][0]["edits"]) == (2, 9, 1) and 0.9 < r["score"] < 1


def test_adjacent_notices_with_different_edits():
    """The most exact of several notices in a row hides none on either side of it."""
    forms = {"all rights reserved": 0, "all rights reservd": 1, "all rihts reservd": 2}
    for order in (["all rights reservd", "all rights reserved"], ["all rihts reservd", "all rights reservd", "all rights reserved", "all rights reservd"], ["all rights reserved", "all rihts reservd"]):
        text = f" {' '.join(order)} "
        got = [(text[a:b], k) for a, b, label, k in L.fuzzy_matches(text) if label == "reserved"]
        assert [k for _, k in got] == [forms[x] for x in order]
        assert [x.strip() for x, _ in got] == order


def test_inserted_deleted_and_neighbouring_notices():
    """Brute force over edits: any mix of up to four inserted, deleted and replaced characters is found, wherever notices stand side by side."""
    notice, label, most = L.NOTICES[0]
    rng = random.Random(4)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            t = list(notice)
            for _ in range(rng.randrange(most + 1)):
                k = rng.randrange(1, len(t) - 1)
                kind = rng.randrange(3)
                t[k : k + (kind > 0)] = ["q"] if kind < 2 else []
            parts.append("".join(t))
        text = f" a {' '.join(parts)} b "
        found = [m for m in L.fuzzy_matches(text) if m[2] == label]
        assert len(found) == len(parts) and all(k <= most for *_, k in found), (text, found)


def test_notices_stand_on_whole_words():
    assert [m for m in L.fuzzy_matches(" small rights reserveds ") if m[3] == 0] == []
    both = "licensed under the apoche license version 2 0", "licensed under the apache license version 2 0"
    for order in (both, both[::-1]):
        assert len(L.fuzzy_matches(f" {' '.join(order)} ")) == 2


def test_long_runs_of_notices_cost_their_length():
    took = []
    for n in (1500, 6000):
        began = time.process_time()
        assert len([m for m in L.fuzzy_matches(" " + "all rights reserved " * n) if m[2] == "reserved"]) == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_other_languages_get_references_of_their_own(spark):
    """Prose of a language without a word list is judged by its own counts; symbols under the same tag fail."""
    rng = random.Random(9)
    words = ["и", "в", "не", "на", "что", "он", "как", "это", *(f"слово{chr(1072 + i)}" for i in range(30))]
    prose = [(i, " ".join(rng.choices(words, weights=[9] * 8 + [1] * 30, k=120)) + ".", "ru") for i in range(40)]
    small = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()]
    docs = spark.createDataFrame([*prose, *((1000 + i, t, k) for i, t, k in small), (99, "## $$ %% && || << >> ** " * 40, "ru"), (98, prose[0][1] + " ещё", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in Q.quality_rules(docs).collect()}
    assert all(not got[i]["kept"] if got[i]["base_failed"] else got[i]["kept"] and got[i]["nearest_lang"] == "ru" for i in [*range(40), 98])
    assert sum(got[i]["kept"] for i in range(40)) > 30 and not got[99]["kept"]


def test_distances_and_verdicts_against_loops(spark):
    """Histograms, references, distances and verdicts of the small table by plain loops."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    vocabulary = {w for x in Q.COMMON.values() for w in x}
    classes = lambda t: Counter(Q._class_of(ord(c)) for c in t)
    common = lambda t: Counter(w if w in vocabulary else None for w in Q.LETTERS.findall(t.lower()))
    refs = {}
    for _, t, lang in rows:
        a, b = refs.setdefault(lang, (Counter(), Counter()))
        a.update(classes(t))
        b.update(common(t))

    def apart(p, q):
        if not p.total() or not q.total():
            return 0.0
        total = 0.0
        for k in p.keys() | q.keys():
            x, y = p[k] / p.total(), q[k] / q.total()
            total += sum(v / 2 * math.log2(v / ((x + y) / 2)) for v in (x, y) if v)
        return math.sqrt(max(0.0, total))

    got = {r["doc_id"]: r for r in Q.quality_rules(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    for i, t, _ in rows:
        a, b, lang = min(((apart(classes(t), c), apart(common(t), w), k) for k, (c, w) in refs.items()), key=lambda x: (x[0] + x[1], x[2]))
        r = got[i]
        assert r["nearest_lang"] == lang and abs(r["char_distance"] - a) < 1e-6 and abs(r["word_distance"] - b) < 1e-6
        passed = not (len(t) >= Q.MIN_CHARS and a > Q.MAX_CHAR_DISTANCE or r["n_words"] >= Q.MIN_WORDS and b > Q.MAX_WORD_DISTANCE)
        assert r["kept"] == (passed and not r["base_failed"])


def test_classes_of_signs_beyond_the_first_planes():
    """Emoji are no letters, ideographic blanks are blanks, ideographs are letters."""
    got = dict(zip(Q.CLASSES, Q.char_classes("😀。　　🎉漢字가").tolist(), strict=True))
    assert sum(got.values()) == 8 and got[Q.CLASSES[2]] == 3 and got[Q.CLASSES[4]] == 2 and got[Q.CLASSES[8]] == 3
