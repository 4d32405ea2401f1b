"""Operator 3, benchmark decontamination by greedy string tiling.

Tokens are lower-case runs of letters, digits and underscores. Documents and benchmark items join on shared ``min_tile`` -token
seeds: one pass over the documents keeps the seeds that a bit filter of the benchmark's seeds lets through (a filter of
fixed size, so it may go to every task; what it lets through wrongly finds no partner in the join). An item joins by its rarer seeds
only: its most frequent ones are left out as long as they cover too little of it to leak alone, and rows of a seed that is frequent even so are dealt to
several tasks. Pairs that met, and whose seeds could cover enough of the item, are tiled: running Karp-Rabin finds the longest matches of unmarked tokens, marks them on both sides, and goes
on with shorter ones, so that passages in another order are still covered. An item leaks into a document if tiles
cover at least ``coverage`` of its tokens.

Defined results: null or empty texts and items match nothing; items of fewer than ``min_tile`` tokens cannot be tiled and match
nothing; repeated rows of documents and of items give a result each; null ids are carried; extra columns play no part.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, Rolling, Scratch, WordHashes, blocks, hash_words, join_counted, lean, read_documents, signed

TOKEN = re.compile(r"\w+")
MIN_TILE, COVERAGE = 5, 0.5
#: 64-bit words of the seed filter, and the bits of a seed that choose one.
FILTER_WORDS = 1 << 20
BLOCK_WORDS = 400_000
SCHEMA = "doc_id long, item_id long, n_tokens int, n_covered int, n_tiles int, longest int, coverage double"


def _free_windows(free: list[bool], size: int) -> Iterator[int]:
    run = 0
    for i, ok in enumerate(free):
        run = run + 1 if ok else 0
        if run >= size:
            yield i - size + 1


def _span_hashes(tokens: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each window of unmarked tokens, rolled by one token at a time."""
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    top = pow(base, size, 1 << 64)
    last = value = None
    for i in _free_windows(free, size):
        if last is not None and i == last + 1:
            value = (value * base + tokens[i + size - 1] - tokens[i - 1] * top) & mask
        else:
            value = 0
            for t in tokens[i : i + size]:
                value = (value * base + t) & mask
        last = i
        yield i, value


def tiles(item: list[int], text: list[int], least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in item, start in text, length), longest first. A 0 in ``text`` is a break and matches nothing."""
    free_a, free_b = [True] * len(item), [t != 0 for t in text]
    found: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), 32))
    while size >= least:
        table = defaultdict(list)
        for i, value in _span_hashes(item, free_a, size):
            table[value].append(i)
        matches = []
        for j, value in _span_hashes(text, free_b, size):
            for i in table.get(value, ()):
                n = 0
                while i + n < len(item) and j + n < len(text) and free_a[i + n] and free_b[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n >= size:
                    matches.append((n, i, j))
        if matches and (longest := max(matches)[0]) > 2 * size:
            size = longest
            continue
        again = False
        for n, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_a[i : i + n]) and all(free_b[j : j + n]):
                free_a[i : i + n] = free_b[j : j + n] = [False] * n
                found.append((i, j, n))
            else:
                again = True
        # what a marked neighbour has cut short may still hold a match of this size
        if not again:
            size = size // 2 if size > 2 * least else least if size > least else 0
    return found


def _token_rows(batch: pa.RecordBatch, least: int, cache: WordHashes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, token hashes, seed hashes) of the texts in the second column that have a seed."""
    texts = batch.column(1).to_pylist()
    for a, b in blocks(texts, [len(t) // 6 for t in texts], BLOCK_WORDS):
        h, at = hash_words([TOKEN.findall(t.lower()) for t in texts[a:b]], cache)
        grams = Rolling(h).all(least)
        for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if e - s >= least:
                yield a + i, h[s:e], grams[s : e - least + 1]


def _items(least: int):
    """(item_id, no, tokens, seeds) of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in lean(batches):
            found = list(_token_rows(batch, least, cache))
            rows = pa.array([i for i, _, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(2).take(rows), pa.array([h.tobytes() for _, h, _ in found], pa.binary()), pa.array([signed(g) for _, _, g in found], pa.list_(pa.int64()))],
                names=["item_id", "no", "tokens", "seeds"],
            )

    return run


def _candidates(held, least: int):
    """Of each document with seeds in the filter: their tokens, run by run, with a 0 after each run, and the seeds with their places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bits = WordHashes(), held.value
        for batch in lean(batches):
            texts = batch.column(1).to_pylist()
            out: list[tuple] = []
            for a, b in blocks(texts, [len(t) // 6 for t in texts], BLOCK_WORDS):
                h, at = hash_words([TOKEN.findall(t.lower()) for t in texts[a:b]], cache)
                grams = Rolling(h).all(least)
                hits = np.flatnonzero((bits[(grams >> U(44)).astype(np.int64)] >> (grams & U(63))) & U(1))
                doc = np.searchsorted(at, hits, side="right") - 1
                inside = hits + least <= at[doc + 1]
                hits, doc = hits[inside], doc[inside]
                cuts = np.flatnonzero(np.diff(doc)) + 1
                for p, d in zip(np.split(hits, cuts), doc[np.append(0, cuts)].tolist() if len(doc) else [], strict=False):
                    tokens, place = _runs(h, p, least)
                    out.append((a + d, tokens.tobytes(), signed(grams[p]), place))
            rows = pa.array([r[0] for r in out], pa.int64())
            columns = [pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), *columns], names=["doc_id", "row", "text", "seeds", "places"])

    return run


def _runs(h: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that windows from ``starts`` cover, a 0 after each unbroken run of them, and where each window starts in that."""
    new = np.append(True, starts[1:] > starts[:-1] + least)
    run = np.cumsum(new) - 1
    first = starts[new]
    last = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1]) + least
    offset = np.cumsum(last - first + 1) - (last - first + 1)
    tokens = np.zeros(int((last - first + 1).sum()), U)
    for f, e, o in zip(first.tolist(), last.tolist(), offset.tolist(), strict=True):
        tokens[o : o + e - f] = h[f:e]
    return tokens, (offset[run] + starts - first[run]).astype(np.int32)


def _probes(least: int, share: float):
    """Of each item, the seeds that join: the rest, its most frequent ones, cover too few of its tokens to reach the share alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nos, seeds = [], []
            for no, size, counted in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                n = size + least - 1
                places = defaultdict(list)
                for x in counted:
                    places[-x["n"], x["seed"]].append(x["at"])
                covered, left_out = np.zeros(n, bool), True
                for key in sorted(places):
                    for at in places[key]:
                        covered[at : at + least] = True
                    left_out = left_out and covered.sum() < share * n
                    if not left_out:
                        nos.append(no)
                        seeds.append(key[1])
            yield pa.RecordBatch.from_arrays([pa.array(nos, pa.int64()), pa.array(seeds, pa.int64())], names=["no", "seed"])

    return run


def _tiled(least: int, share: float):
    """Tile the pairs of a document (its tokens, seeds and their places) and an item (its tokens and seeds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            out: list[tuple] = []
            text, at, item = (batch.column(k) for k in (2, 4, 5))
            for i in range(batch.num_rows):
                h, n = np.frombuffer(item[i].as_py(), U), len(item[i].as_py()) // 8
                seeds, own = (np.asarray(batch.column(k)[i].values) for k in (3, 6))
                # each token that a tile covers lies in a shared seed, so fewer than this cannot reach the share
                marks = np.flatnonzero(np.isin(own, seeds))
                if not len(marks) or least + np.minimum(np.diff(marks), least).sum() < share * n:
                    continue
                places = np.unique(np.asarray(at[i].values)[np.isin(seeds, own)]).astype(np.int64)
                part, _ = _runs(np.frombuffer(text[i].as_py(), U), places, least)
                got = tiles(h.tolist(), part.tolist(), least)
                total = sum(t[2] for t in got)
                if got and total >= share * n:
                    out.append((i, n, total, len(got), max(t[2] for t in got), total / n))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            rows = pa.array(cols[0], pa.int64())
            kinds = (*[pa.int32()] * 4, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))],
                names=["doc_id", "item_id", "n_tokens", "n_covered", "n_tiles", "longest", "coverage"],
            )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, share: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_tokens, n_covered, n_tiles, longest, coverage) of each pair of a document and an item that leaks into it."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    numbered = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", F.monotonically_increasing_id().alias("no"))
    items = scratch.cut(numbered.mapInArrow(_items(least), "item_id long, no long, tokens binary, seeds array<long>"))
    seeds = items.select("no", F.size("seeds").alias("size"), F.posexplode("seeds").alias("at", "seed"))
    word = F.shiftrightunsigned("seed", 44)
    bits = np.zeros(FILTER_WORDS, U)
    for r in seeds.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("bits")).toLocalIterator():  # FILTER_WORDS rows at most
        bits[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    held = spark.sparkContext.broadcast(bits)

    source = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    found = scratch.cut(source.mapInArrow(_candidates(held, least), "doc_id long, row long, text binary, seeds array<long>, places array<int>"))
    hits = found.select("row", F.explode(F.array_distinct("seeds")).alias("seed"))
    counts = scratch.cut(hits.groupBy("seed").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    listed = seeds.join(counts, "seed").groupBy("no").agg(F.first("size").alias("size"), F.collect_list(F.struct("n", "seed", "at")).alias("counted"))
    probes = listed.mapInArrow(_probes(least, share), "no long, seed long")
    asked = scratch.cut(probes.groupBy("seed").agg(F.collect_list("no").alias("nos")).join(counts, "seed"))
    met = join_counted(hits, asked, ["seed"], total, ["row"]).select("row", F.explode("nos").alias("no")).distinct()
    pairs = met.join(items.select("no", "item_id", "tokens", F.col("seeds").alias("item_seeds")), "no").join(found, "row")
    return pairs.select("doc_id", "item_id", "text", "seeds", "places", "tokens", "item_seeds").mapInArrow(_tiled(least, share), SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that an item leaks into."""
    found = Scratch(docs.sparkSession, "leaks").cut(leaks(docs, benchmark).select(F.col("doc_id").alias("__cl_id")).distinct())
    return docs.join(found, docs["doc_id"].cast("long") == found["__cl_id"], "left_anti")


def op3_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that holds a benchmark item, with the item and its coverage."""
    return leaks(read_documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
