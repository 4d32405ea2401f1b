"""Operator 2, substring dedup by compaction of a token de Bruijn graph.

Every window of ``window`` consecutive words is a k-mer of the graph. Consecutive k-mers that share
their minimizer (the least hash of the ``seed`` -word spans inside) form one edge, a super-k-mer,
as in the published minimizer-based compaction of de Bruijn graphs; equal windows always share the
minimizer, so edges are compared only within a minimizer. Three kinds of repeats follow:

* an edge that occurs as a whole in several documents. Where an edge is always followed by the same
  edge, and that one always preceded by it, the path does not branch; pointer doubling by joins
  compacts such paths, and one row for the head of a path stands for a span of any length;
* edges of one minimizer that differ as a whole may still share windows at their ends. Every
  occurrence of such an edge in its first document is opened into its windows at its source
  coordinates and compared window by window; occurrences in later documents go as a whole;
* the rest is unique and never leaves the first step.

Nothing is sampled: each window lies in exactly one edge.

Defined results: null or wordless texts and texts of fewer than ``window`` words lose nothing; rows
with a null doc_id neither lose words nor count as a source; rows that repeat a doc_id are no
sources for each other, as only a smaller doc_id counts; extra columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, Rolling, Scratch, WordHashes, blocks, hash_words, join_counted, lean, read_documents, signed, sliding_min

WINDOW, SEED = 50, 20
BLOCK_WORDS = 400_000

EDGE = "doc_id long, th long, v long, k long, pos int, n int"


def _minimizers(h: np.ndarray, window: int, seed: int) -> tuple[Rolling, np.ndarray]:
    roll = Rolling(h)
    return roll, sliding_min(roll.all(seed), window - seed + 1)


def _edges(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in lean(batches):
            ids, ths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts, [len(t) // 6 for t in texts], BLOCK_WORDS):
                h, starts = hash_words([WORD.findall(t) for t in texts[a:b]], cache)
                _, v = _minimizers(h, window, seed)
                count = np.maximum(np.diff(starts) - (window - 1), 0)
                doc = np.repeat(np.arange(b - a), count)
                if not len(doc):
                    continue
                first = np.zeros(b - a, np.int64)
                np.cumsum(count[:-1], out=first[1:])
                p = np.arange(len(doc)) - first[doc] + starts[doc]
                value = v[p]
                new = np.ones(len(doc), bool)
                new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(doc)))
                content = Rolling(h, 1).span(p[at], p[at] + n + window - 1)
                d = doc[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[a:b][d], ths[a:b][d], signed(value[at]), signed(content), (p[at] - starts[d]).astype(np.int32), n.astype(np.int32))],
                    names=["doc_id", "th", "v", "k", "pos", "n"],
                )

    return run


def _windows(window: int, seed: int):
    """Open the edges listed with a text into their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in lean(batches):
            ids, ths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts, lists = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a, b in blocks(texts, [len(t) // 6 for t in texts], BLOCK_WORDS):
                h, starts = hash_words([WORD.findall(t) for t in texts[a:b]], cache)
                n = np.array([e["n"] for x in lists[a:b] for e in x], np.int64)
                v = np.array([e["v"] for x in lists[a:b] for e in x], np.int64)
                doc = np.repeat(np.arange(b - a), [len(x) for x in lists[a:b]])
                begin = starts[doc] + np.array([e["pos"] for x in lists[a:b] for e in x], np.int64)
                of = np.repeat(np.arange(len(n)), n)
                offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                p = begin[of] + offset
                w = Rolling(h, 1).span(p, p + window)
                d = doc[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[a:b][d], ths[a:b][d], v[of], signed(w), (p - starts[d]).astype(np.int32))], names=["doc_id", "th", "v", "w", "pos"]
                )

    return run


def _compact(scratch: Scratch, occ: DataFrame) -> DataFrame:
    """Heads of nonbranching paths: (v, k) of the head, the number of windows on the path (total) and its occurrences (n)."""
    spark = scratch.spark
    nodes = scratch.cut(
        occ.groupBy("v", "k").agg(
            F.max("n").alias("n"), F.count("*").alias("rows"), F.min("prev").alias("p0"), F.max("prev").alias("p1"), F.min("next").alias("x0"), F.max("next").alias("x1")
        )
    )
    a = nodes.where("x0 = x1 and x0 != 0").select(F.col("v").alias("av"), F.col("k").alias("ak"), F.col("x0").alias("bk"))
    b = nodes.where("p0 = p1 and p0 != 0").select(F.col("k").alias("bk"), F.col("v").alias("bv"), F.col("p0").alias("ak"))
    links = a.join(b, ["ak", "bk"])
    state = scratch.cut(
        nodes.join(links.select(F.col("av").alias("v"), F.col("ak").alias("k"), F.col("bv").alias("xv"), F.col("bk").alias("xk")), ["v", "k"], "left")
        .join(links.select(F.col("bv").alias("v"), F.col("bk").alias("k"), F.lit(True).alias("inner")), ["v", "k"], "left")
        .select("v", "k", "rows", F.col("n").cast("long").alias("n"), "xv", "xk", F.coalesce("inner", F.lit(False)).alias("inner"))
    )
    old = [nodes]
    while not state.where("not inner and xk is not null").isEmpty():
        ahead = state.select(F.col("v").alias("xv"), F.col("k").alias("xk"), F.col("n").alias("n2"), F.col("xv").alias("xv2"), F.col("xk").alias("xk2"))
        moved = scratch.cut(
            state.join(ahead, ["xv", "xk"], "left").select(
                "v", "k", "rows", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.col("xv2").alias("xv"), F.col("xk2").alias("xk"), "inner"
            )
        )
        old.append(state)
        state = moved
    heads = scratch.cut(state.where("not inner").select("v", "k", F.col("n").alias("total"), F.col("rows").alias("n")))
    scratch.drop(*old, state)
    return heads


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, th, pos, n): ``n`` windows from word ``pos`` on also start in a document with a smaller id.

    ``th`` is xxhash64 of the text, so that rows that repeat a doc_id stay apart.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    edges = scratch.cut(keyed.mapInArrow(_edges(window, seed), EDGE))
    shared = scratch.cut(edges.groupBy("v").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("rows")).where("a < b").select("v", F.col("rows").alias("n")))
    cand = scratch.cut(join_counted(edges.withColumnRenamed("n", "size"), shared, ["v"], edges.count(), ["doc_id", "pos"]).withColumnRenamed("size", "n"))
    scratch.drop(edges, shared)
    classes = scratch.cut(
        cand.groupBy("v", "k").agg(F.min(F.struct("doc_id", "th", "pos", "n")).alias("f"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    )
    total = cand.count()

    whole = classes.where("f.doc_id < last").select("v", "k", F.col("f.doc_id").alias("first"), "n")
    seq = Window.partitionBy("doc_id", "th").orderBy("pos")
    occ = scratch.cut(
        join_counted(cand.withColumnRenamed("n", "size"), whole, ["v", "k"], total, ["doc_id", "pos"])
        .withColumnRenamed("size", "n")
        .repartition("doc_id", "th")
        .dropDuplicates(["doc_id", "th", "pos"])
        .withColumn("prev", F.when(F.lag(F.col("pos") + F.col("n")).over(seq) == F.col("pos"), F.lag("k").over(seq)).otherwise(0))
        .withColumn("next", F.when(F.lead("pos").over(seq) == F.col("pos") + F.col("n"), F.lead("k").over(seq)).otherwise(0))
    )
    heads = _compact(scratch, occ)
    later = occ.where("doc_id > first").select("v", "k", "doc_id", "th", "pos")
    whole_spans = join_counted(later, heads, ["v", "k"], total, ["doc_id", "pos"]).select("doc_id", "th", "pos", F.col("total").cast("int").alias("n"))

    mixed = scratch.cut(classes.groupBy("v").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n")).where("a < b").select("v", "n"))
    sources = join_counted(classes.select("v", "k", F.col("f.doc_id").alias("doc_id")), mixed, ["v"], classes.count(), ["k"])
    opened = (
        cand.join(sources, ["v", "k", "doc_id"], "left_semi")
        .groupBy("doc_id", "th")
        .agg(F.collect_set(F.struct("v", "pos", "n")).alias("edges"))
    )
    texts = keyed.join(opened, ["doc_id", "th"]).select("doc_id", "th", "text", "edges")
    windows = scratch.cut(texts.mapInArrow(_windows(window, seed), "doc_id long, th long, v long, w long, pos int"))
    first = scratch.cut(
        windows.groupBy("v", "w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    )
    repeated = join_counted(windows, first, ["v", "w"], windows.count(), ["doc_id", "pos"])
    part_spans = repeated.where("doc_id > first").select("doc_id", "th", "pos", F.lit(1).alias("n"))
    spans = scratch.cut(
        whole_spans.unionByName(part_spans).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("spans"))
    )
    scratch.drop(cand, classes, occ, heads, mixed, windows, first)
    return spans


def covered(n_words: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Which words the spans cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for s in spans or ():
        edge[s["pos"]] += 1
        edge[s["pos"] + s["n"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def _with_spans(docs: DataFrame, window: int, seed: int) -> DataFrame:
    spans = repeated_spans(docs, window, seed).select(F.col("doc_id").alias("__cl_id"), F.col("th").alias("__cl_th"), F.col("spans").alias("__cl_spans"))
    return docs.join(spans, (docs["doc_id"].cast("long") == F.col("__cl_id")) & (F.xxhash64(docs["text"]) == F.col("__cl_th")), "left").drop("__cl_id", "__cl_th")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with repeated words cut out of ``text``; white space after a kept word stays. Same columns and rows."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            spans = batch.column(len(names)).to_pylist()
            texts = batch.column(at)
            if any(spans):
                fixed = texts.to_pylist()
                for i, s in enumerate(spans):
                    if s:
                        found = list(WORD.finditer(fixed[i]))
                        gone = covered(len(found), s, window)
                        ends = [m.start() for m in found[1:]] + [len(fixed[i])]
                        fixed[i] = "".join(fixed[i][m.start() : e] for m, e, g in zip(found, ends, gone, strict=True) if not g)
                texts = pa.array(fixed, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(len(names))], names=names)

    return _with_spans(docs, window, seed).mapInArrow(run, docs.schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    docs = read_documents(spark, sf_dir, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            total, removed, digest = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = WORD.findall(text or "")
                total.append(len(words))
                gone = 0
                if spans:
                    mask = covered(len(words), spans, WINDOW)
                    gone = int(mask.sum())
                    words = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
                removed.append(gone)
                digest.append(hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = T.StructType([docs.schema["doc_id"]]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return _with_spans(docs, WINDOW, SEED).select("doc_id", "text", "__cl_spans").mapInArrow(run, schema)
