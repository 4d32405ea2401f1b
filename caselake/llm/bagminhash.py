"""Operator 4, MinHash near-dedup by BagMinHash.

A document is the multiset of its five-word shingles. As in BagMinHash, weights are discretised:
the weight axis is cut into (0,1], (1,2], (2,4], ... and a Poisson process over time and weight runs
in each cell of each shingle, seeded by both alone. A point is dealt to one of ``m`` components and
counts only if its place on the weight axis is at most the shingle's count, which thins the partly
filled last cell; a component keeps its earliest point. Two documents keep the same point with
the probability of their weighted Jaccard similarity, sum(min)/sum(max).

Exact copies (equal word sequences) collapse first. Bands of the signatures give buckets; each
member of a bucket is compared with the least id there. Components follow from verified links,
and in a bucket that still holds several components, all members outside the largest are compared
with the whole bucket in slices, so that no link between different texts that share a band is lost,
while a bucket of one component, however large, costs its size only. Of these pairs the likeliest of each
member and component is verified first; pairs that a verified link has joined by then need no look.
Every link is verified on the whole multisets.

Defined results: texts of one to four words are one shingle of all their words; null or wordless
texts are a class of their own each; rows with a null doc_id have a null class; rows that repeat
a doc_id are one node, so that their classes merge; a class id is the least doc_id of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASES, U, WORD, Rolling, Scratch, WordHashes, blocks, hash_words, join_counted, lean, mix, read_documents, signed, times, unit

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
#: Bits of a component that are compared in pairs.
PLANES = 4
#: Members of an open bucket that one task compares at a time.
SLICE = 2_000
#: Cells that bound the overlap of two documents from above, and the counts told apart in a cell.
CELLS, LEVELS = 512, 2
BLOCK_WORDS = 100_000


def shingles(lists: list[list[str]], cache: WordHashes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list index, shingle hash, count), by list and hash."""
    h, starts = hash_words(lists, cache)
    n = np.diff(starts)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(lists)), count)
    if not len(doc):
        return doc, np.zeros(0, U), np.zeros(0, np.int64)
    p = np.arange(len(doc)) - (np.cumsum(count) - count)[doc] + starts[doc]
    s = Rolling(h).span(p, np.minimum(p + size, starts[doc + 1]))
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], s[at], np.diff(np.append(at, len(s)))


def signatures(doc: np.ndarray, s: np.ndarray, count: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) ids of the earliest points; rows of documents without shingles stay 0."""
    best, sig = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, U)
    d, seed, low, rate, weight = [], [], [], [], []
    cell, lower = 0, 0
    left = np.arange(len(s))
    while len(left):
        width = 1 if cell == 0 else lower
        d.append(doc[left])
        seed.append(mix(s[left] + times(BASES[1], cell + 1)))
        low.append(np.full(len(left), float(lower)))
        rate.append(np.full(len(left), float(width)))
        weight.append(count[left].astype(float))
        lower, cell = lower + width, cell + 1
        left = left[count[left] > lower]
    if not d:
        return sig.reshape(n_docs, m)
    d, seed, low, rate, weight = map(np.concatenate, (d, seed, low, rate, weight))
    time, step = np.zeros(len(d)), 0
    while len(d):
        step += 1
        a = mix(seed + times(BASES[0], step))
        b = mix(a + BASES[1])
        time = time - np.log(unit(a)) / rate
        slot = d * m + (b % U(m)).astype(np.int64)
        ok = (time < best[slot]) & ((weight >= low + rate) | (low + rate * unit(mix(b + BASES[0])) <= weight))
        np.minimum.at(best, slot[ok], time[ok])
        won = ok & (time == best[slot])
        sig[slot[won]] = a[won]
        go = time < best.reshape(n_docs, m).max(axis=1)[d]
        d, seed, low, rate, weight, time = d[go], seed[go], low[go], rate[go], weight[go], time[go]
    return sig.reshape(n_docs, m)


def bit_planes(sig: np.ndarray) -> np.ndarray:
    """The low PLANES bits of all components of a row, each plane packed into 64-bit words: (rows, PLANES * words)."""
    n, m = sig.shape
    words = -(-m // 64)
    out = np.zeros((n, PLANES, words), U)
    for plane in range(PLANES):
        bit = (sig >> U(plane)) & U(1)
        for c in range(m):
            out[:, plane, c // 64] |= bit[:, c] << U(c % 64)
    return out.reshape(n, PLANES * words)


def cell_counts(doc: np.ndarray, s: np.ndarray, count: np.ndarray, n_docs: int) -> np.ndarray:
    """Shingle counts summed in CELLS cells, each cut off at LEVELS and written in unary, and the sum of all counts: (n_docs, LEVELS * CELLS / 64 + 1)."""
    cells = np.bincount(doc * CELLS + (s % U(CELLS)).astype(np.int64), weights=count, minlength=n_docs * CELLS).reshape(n_docs, CELLS)
    bits = [np.packbits(cells >= level, axis=1).view(U) for level in range(1, LEVELS + 1)]
    return np.hstack([*bits, cells.sum(axis=1).astype(U)[:, None]])


def _may_reach(least: float, first: int) -> Column:
    """Whether the cells of a.. and b.. from column ``first`` on allow the overlap ``least``. Cells never differ by more than the multisets do, so no true pair is lost."""
    last = first + LEVELS * CELLS // 64
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(first, last)), F.lit(0))
    return differ <= (F.col(f"a{last}") + F.col(f"b{last}")) * ((1 - least) / (1 + least)) + 1e-6


def _agreeing(m: int) -> Column:
    """Of the columns a0.. and b0.. (bit planes), the components that agree in every plane; one of 2^PLANES does by chance."""
    words = -(-m // 64)
    differ = F.lit(0)
    for w in range(words):
        mask = F.lit(0).cast("long")
        for plane in range(PLANES):
            i = plane * words + w
            mask = mask.bitwiseOR(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}")))
        differ = differ + F.bit_count(mask)
    return m - differ


def _sign(bands: int, rows: int, size: int):
    m = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in lean(batches):
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts, [len(t) // 6 for t in texts], BLOCK_WORDS):
                lists = [WORD.findall(t) for t in texts[a:b]]
                n = np.array([len(x) for x in lists])
                h, starts = hash_words(lists, cache)
                digest = b"".join(xxhash.xxh3_128_digest(h[s:e].tobytes()) for s, e in zip(starts[:-1], starts[1:], strict=True))
                x, y = np.frombuffer(digest, np.int64).reshape(-1, 2).T.copy()
                parts = shingles(lists, cache, size)
                sig = signatures(*parts, len(lists), m)
                band = np.zeros((len(lists), bands), U)
                for r in range(rows):
                    band = mix(band * BASES[0] + sig[:, r::rows])
                band = mix(band + np.arange(bands, dtype=U) * BASES[1])
                sketch = signed(np.hstack([bit_planes(sig), cell_counts(*parts, len(lists))]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(x), pa.array(y),
                        pa.array([list(r) if k else [] for r, k in zip(signed(band), n, strict=True)], pa.list_(pa.int64())),
                        pa.array([list(r) if k else None for r, k in zip(sketch, n, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "th", "x", "y", "bands", "sketch"],
                )

    return run


def _vectors(size: int):
    """Sorted shingle hashes and counts of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in lean(batches):
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts, [len(t) // 6 for t in texts], BLOCK_WORDS):
                doc, s, count = shingles([WORD.findall(t) for t in texts[a:b]], cache, size)
                cuts = np.searchsorted(doc, np.arange(b - a + 1))
                # Without repeats, the counts are left out.
                pairs = [(s[i:j].tobytes(), count[i:j].astype(np.uint32).tobytes() if (count[i:j] > 1).any() else b"") for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1))], names=["doc_id", "s", "c"])

    return run


def _jaccard(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            keep = []
            for sa, ca, sb, cb in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                sa, sb = np.frombuffer(sa, U), np.frombuffer(sb, U)
                ca, cb = (np.frombuffer(c, np.uint32).astype(np.int64) if c else np.ones(len(s), np.int64) for s, c in ((sa, ca), (sb, cb)))
                at = np.searchsorted(sb, sa)
                at[at == len(sb)] = 0
                hit = sb[at] == sa
                both = int(np.minimum(ca[hit], cb[at[hit]]).sum())
                keep.append(both >= least * (int(ca.sum()) + int(cb.sum()) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def verified(scratch: Scratch, pairs: DataFrame, vectors: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by ``least`` or more. A document of very many pairs meets them in several tasks."""
    pairs = scratch.cut(pairs)
    degrees = pairs.groupBy("a").agg(F.count("*").alias("n"))
    left = vectors.select(F.col("doc_id").alias("a"), F.col("s").alias("sa"), F.col("c").alias("ca")).join(degrees, "a")
    right = vectors.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"), F.col("c").alias("cb"))
    met = join_counted(pairs, left, ["a"], pairs.count(), ["b"]).join(right, "b")
    return met.select("a", "b", "sa", "ca", "sb", "cb").mapInArrow(_jaccard(least), "a long, b long")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(id, label): label is the least id of the connected component; by alternating large-star and small-star steps."""
    edges = scratch.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = scratch.cut(small.where("u > v").distinct())
        same = new.count() == edges.count() and new.exceptAll(edges).isEmpty()
        scratch.drop(edges, large)
        edges = new
        if same:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def near_classes(docs: DataFrame, least: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, agree: float | None = None) -> DataFrame:
    """(doc_id, th, class_id, copy_of) per distinct doc_id and text; ``th`` is xxhash64 of the text, ``copy_of`` the least id with the same words.

    Within open buckets every pair is verified unless its counts by cell rule it out, which they do for no true pair. With ``agree``,
    pairs of which a smaller share of signature components agrees are left out too; that is faster, and may lose a true pair.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed_rows = scratch.cut(keyed.mapInArrow(_sign(bands, rows, size), "doc_id long, th long, x long, y long, bands array<long>, sketch array<long>").where("sketch is not null"))
    exact = scratch.cut(signed_rows.groupBy("x", "y").agg(F.min(F.struct("doc_id", "th")).alias("f"), F.count("*").alias("n")))
    reps = signed_rows.join(exact.select("f.doc_id", "f.th"), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "bands", "sketch")
    banded = scratch.cut(reps.select("doc_id", F.explode("bands").alias("band")))
    buckets = scratch.cut(banded.groupBy("band").agg(F.min("doc_id").alias("center"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("center < last").select("band", "center", "n"))
    members = scratch.cut(join_counted(banded, buckets, ["band"], banded.count(), ["doc_id"]))
    scratch.drop(banded, buckets)
    ids = members.select("doc_id").distinct()
    known = scratch.cut(reps.join(ids, "doc_id").select("doc_id", "th", "bands", "sketch"))
    vectors = scratch.cut(keyed.join(known.select("doc_id", "th"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("doc_id", "text").mapInArrow(_vectors(size), "doc_id long, s binary, c binary"))

    stars = members.where("doc_id > center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = scratch.cut(verified(scratch, stars, vectors, least))
    labels = components(scratch, links)

    labelled = (
        members.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("band", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    )
    sizes = labelled.groupBy("band", "label").agg(F.count("*").alias("n"))
    open_buckets = scratch.cut(
        sizes.groupBy("band")
        .agg(F.sum("n").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.max_by("label", F.struct("n", "label")).alias("main"))
        .where("l0 < l1")
        .select("band", "main", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"), "n")
    )
    rest = scratch.cut(join_counted(labelled, open_buckets, ["band"], members.count(), ["doc_id"]).join(known.select("doc_id", "bands", "sketch"), "doc_id"))
    m = bands * rows
    planes = PLANES * -(-m // 64)
    words = planes + LEVELS * CELLS // 64 + 1
    # Pairs within the bucket's largest component are settled: only the others meet all members, slice by slice.
    a = rest.where("label != main").select(
        "band", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("doc_id").alias("a"), F.col("label").alias("la"), F.col("bands").alias("ha"),
        *(F.col("sketch")[i].alias(f"a{i}") for i in range(words)),
    )
    b = rest.select(
        "band", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int").alias("slice"), F.col("doc_id").alias("b"), F.col("label").alias("lb"), F.col("bands").alias("hb"),
        (F.col("label") == F.col("main")).alias("in_main"), *(F.col("sketch")[i].alias(f"b{i}") for i in range(words)),
    )
    alike = _agreeing(m) >= int(agree * m) if agree else F.lit(True)
    # A pair of different components is open in every band it shares; the least of them tells it.
    told = F.array_min(F.array_intersect("ha", "hb")) == F.col("band")
    met = a.join(b, ["band", "slice"]).where((F.col("la") != F.col("lb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & alike & _may_reach(least, planes) & told)
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    seen = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cross = scratch.cut(met.select("a", "b", "la", "lb", _agreeing(m).alias("agree")).distinct().join(seen, ["a", "b"], "left_anti"))
    likely = scratch.cut(cross.groupBy("a", "lb").agg(F.max_by("b", F.struct("agree", "b")).alias("b")).select(*pair).distinct())
    first = scratch.cut(verified(scratch, likely, vectors, least))
    by_label = cross.select(*pair, "la", "lb").join(first, ["a", "b"], "left_semi").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    merged = components(scratch, by_label)
    apart = (
        cross.join(merged.select(F.col("id").alias("la"), F.col("label").alias("ma")), "la", "left")
        .join(merged.select(F.col("id").alias("lb"), F.col("label").alias("mb")), "lb", "left")
        .where(F.coalesce("ma", "la") != F.coalesce("mb", "lb"))
        .select(*pair)
        .join(likely, ["a", "b"], "left_anti")
        .distinct()
    )
    more = scratch.cut(verified(scratch, apart, vectors, least))
    final = components(scratch, links.unionByName(first).unionByName(more))
    named = scratch.cut(
        exact.select("x", "y", "n", F.col("f.doc_id").alias("copy_of"))
        .join(final.withColumnRenamed("id", "copy_of"), "copy_of", "left")
        .select("x", "y", "n", "copy_of", F.coalesce("label", "copy_of").alias("class_id"))
    )
    keys = signed_rows.select("doc_id", "th", "x", "y")
    out = scratch.cut(join_counted(keys, named, ["x", "y"], signed_rows.count(), ["doc_id"]).select("doc_id", "th", "copy_of", "class_id").distinct())
    scratch.drop(signed_rows, exact, members, known, vectors, links, open_buckets, rest, cross, likely, first, more, named)
    return out


def _joined(docs: DataFrame, classes: DataFrame) -> DataFrame:
    c = classes.select(F.col("doc_id").alias("__cl_id"), F.col("th").alias("__cl_th"), F.col("class_id").alias("__cl_class"), F.col("copy_of").alias("__cl_copy"))
    return docs.join(c, (docs["doc_id"].cast("long") == F.col("__cl_id")) & (F.xxhash64(docs["text"]) == F.col("__cl_th")), "left").drop("__cl_id", "__cl_th")


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the one with the least id. Columns stay.

    A document is a doc_id: all rows that repeat the kept doc_id stay, exact copies of each other too.
    """
    names = docs.columns
    joined = _joined(docs, near_classes(docs, least))
    return joined.where(F.col("__cl_class").isNull() | (F.col("__cl_class") == F.col("doc_id"))).select(*names)


def op4_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least id of the near-duplicate class), copy_of (least id with the same words) for every document."""
    docs = read_documents(spark, sf_dir, "doc_id", "text")
    c = near_classes(docs)
    keys = docs.select("doc_id", F.xxhash64("text").alias("th"))
    return keys.join(c, ["doc_id", "th"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"))
