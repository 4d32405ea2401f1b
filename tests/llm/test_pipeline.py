import random

import corpus_pipeline
from caselake.llm import decontamination as D
from caselake.llm.common import WORD
from tests.conftest import SMALL
from tests.llm.common import empty_docs, odd_docs, odd_rows, write
from tests.llm.test_dedup import brute_classes
from tests.llm.test_tokens import check_packing


def brute_cut(rows, window=50):
    first = {}
    for i, t in rows:
        w = WORD.findall(t)
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        m = list(WORD.finditer(t))
        w = [x.group() for x in m]
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        ends = [x.start() for x in m[1:]] + [len(t)]
        out.append((i, "".join(t[x.start() : e] for x, e, g in zip(m, ends, gone, strict=True) if not g) if any(gone) else t))
    return out


def test_pipeline_against_brute_force(spark):
    """Every text of the small tables has a clear language, so the first stage keeps all of them."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    classes = brute_classes(rows)
    rows = brute_cut([r for r in rows if classes[r[0]] == r[0]])
    items = [" ".join(D.TOKEN.findall(r["text"].lower())) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(x in " ".join(D.TOKEN.findall(r[1].lower())) for x in items)]
    assert check_packing(corpus_pipeline.run(spark, SMALL).collect(), rows) > 0


def test_stages_keep_columns_on_odd_and_empty_documents(spark, tmp_path):
    bench = spark.createDataFrame([(1, odd_rows()[3][1])], "item_id long, text string")
    for name, docs in (("odd", odd_docs(spark)), ("none", empty_docs(spark))):
        path = write(docs, tmp_path / name, benchmark=bench)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.dtypes == docs.dtypes
                out.write.parquet(f"{tmp_path}/{name}-{k}")
                docs = spark.read.parquet(f"{tmp_path}/{name}-{k}")
            else:
                assert (out.count() > 0) == (name == "odd")


def test_language_judges_each_row_by_its_text(spark):
    """Null and repeated ids: clean texts stay, texts without a letter go."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    i, text = docs.orderBy("doc_id").select("doc_id", "text").first()
    odd = [(None, text), (None, text), (None, "12 34 -- 56"), (None, None), (i, "99 00"), (i, text + " again")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    got = corpus_pipeline.language(spark, docs, SMALL)
    assert got.dtypes == docs.dtypes
    assert sorted(r["text"] for r in got.where("doc_id is null").collect()) == [text, text]
    assert sorted(r["text"] for r in got.where(f"doc_id = {i}").collect()) == [text, text + " again"]


def test_language_rejects_noise_and_keeps_the_rest(spark):
    """Random letters and unlearned scripts go; every text of the small tables stays, and so do short odd ones."""
    rng = random.Random(2)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(500)) for _ in range(5)] + ["обычный текст о погоде и людях " * 20]
    odd = [(900_000 + i, t) for i, t in enumerate([*noise, "A. All rights reserved.", 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"'])]
    more = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, more, SMALL).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} | {900_006, 900_007}
