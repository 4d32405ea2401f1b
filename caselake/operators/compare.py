"""Comparison of documents and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import SMALL, spread

#: Pairs of two documents' chunks up to which all of them are compared.
ALL_PAIRS = 9
#: Rows of either side of a block of pairs, and of a block for a core of a small table.
BLOCK_ROWS, LEAST_ROWS = 16_384, 1_024
#: Scores that a task holds at a time.
CELLS = 2_000_000
#: Vectors that centroids are fitted on, for each of them; rounds of fitting; queries on which recall is measured.
SAMPLE_PER_CELL, ROUNDS, MEASURED = 64, 8, 200


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(df: DataFrame, vector: str, size: int | None = None) -> DataFrame:
    """Vectors as unit length; rows with a non-finite part, no length, or another dimension than ``size`` (the commonest one by default) are dropped."""
    if size is None:
        common = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = common["n"] if common else 0

    def unit(v: Column) -> Column:
        finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        # the length is worked out once, not for each part
        return X.let(F.sqrt(dot(v, v)), lambda norm: F.when(finite & (norm > 0), F.transform(v, lambda x: x / norm)))

    units = F.explode(F.array(X.let(F.transform(vector, lambda x: x.cast("double")), unit)))
    return spread(df).where(F.size(vector) == size).withColumn(vector, units).where(F.col(vector).isNotNull())


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, by id."""
    ids = t.column("id").to_numpy()
    v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    order = np.argsort(ids, kind="stable")
    return ids[order], v[order]


def _side(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))


def _blocks(rows: int, cores: int) -> int:
    """Blocks of a side: of BLOCK_ROWS rows at most, more for a small table, so that no core idles."""
    return max(1, -(-rows // BLOCK_ROWS), min(cores, rows // LEAST_ROWS))


def _scored(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on every pair of a block of ``left`` and a block of ``right`` (id, v); a task holds one block of either."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    n_left, n_right = _blocks(left.count(), 1), _blocks(right.count(), cores)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.select("id", "v", block(n_left).alias("x"), every(n_right).alias("y"))
    b = right.select("id", "v", every(n_left).alias("x"), block(n_right).alias("y"))
    return a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInArrow(run, schema)


def _slices(x: np.ndarray, y: np.ndarray, more: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Scores of every row of ``x`` with all rows of ``y`` in slices of at most CELLS numbers (but a row), with the first row of each; ``more`` numbers come with a row."""
    step = max(1, CELLS // max(1, len(y) + more))
    for at in range(0, len(x), step):
        yield at, x[at : at + step] @ y.T


def _first_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` greatest numbers of each row, greatest first, ties to the first column; without sorting the rest."""
    n = scores.shape[1]
    if k >= n:
        return np.argsort(-scores, axis=1, kind="stable")
    least = np.partition(scores, n - k, axis=1)[:, n - k, None]
    above, level = scores > least, scores == least
    level &= level.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)
    columns = np.nonzero(above | level)[1].reshape(-1, k)
    order = np.argsort(-np.take_along_axis(scores, columns, 1), axis=1, kind="stable")
    return np.take_along_axis(columns, order, 1)


def _best_of(k: int):
    """The best ``k`` rows of a block for each query of another, ties to the least id; a query is no partner of itself."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        (q, a), (r, b) = _matrix(queries), _matrix(rows)
        if not len(q) or not len(r):
            return pa.table({"q": pa.array([], pa.int64()), "r": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        asked, found, kept = [], [], []
        for at, scores in _slices(a, b):
            scores = np.round(scores, 6)
            mine = q[at : at + len(scores)]
            scores[mine[:, None] == r[None, :]] = -np.inf
            top = _first_best(scores, k)  # rows are in the order of their ids
            best = np.take_along_axis(scores, top, 1)
            seen = best > -np.inf
            asked.append(np.broadcast_to(mine[:, None], best.shape)[seen])
            found.append(r[top][seen])
            kept.append(best[seen])
        return pa.table({"q": np.concatenate(asked), "r": np.concatenate(found), "score": np.concatenate(kept)})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "r")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, q: str, r: str, vector: str, k: int) -> DataFrame:
    """The exact top ``k`` rows by cosine for each query, ties to the least id; a query is no partner of itself.

    Blocks of queries meet blocks of rows in tasks of bounded size, which keep the best ``k`` of each query: nothing passes through the driver. The work
    grows with the product of both sides; ``VectorIndex`` is for large ones.
    """
    return _top(_scored(_side(queries, q, vector), _side(rows, r, vector), _best_of(k), "q long, r long, score double"), k)


class VectorIndex:
    """An inverted file of unit vectors: every row belongs to the cell of its nearest centroid, and a query looks into the cells nearest to it.

    Centroids are fitted on a bounded sample, SAMPLE_PER_CELL rows of the least hashes for each; they are all that goes to every task. All cells together give the
    exact result. Rows and queries of a large cell are dealt to several tasks.
    """

    def __init__(self, rows: DataFrame, key: str, vector: str, cells: int | None = None):
        self.rows = _side(rows, key, vector)
        n = self.rows.count()
        cells = max(1, min(cells or int(n**0.5), n))
        sample = self.rows.orderBy(F.xxhash64("id"), "id").limit(cells * SAMPLE_PER_CELL).select("v").toArrow().column("v").combine_chunks()
        self.centroids = self._fit(sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1), cells) if len(sample) else np.zeros((0, 1))

    @staticmethod
    def _fit(v: np.ndarray, cells: int) -> np.ndarray:
        """Spherical k-means; an empty cell takes the vector that is farthest from its own."""
        centres = v[np.linspace(0, len(v) - 1, cells).astype(int)]
        for _ in range(ROUNDS):
            near, best = np.empty(len(v), int), np.empty(len(v))
            for at, scores in _slices(v, centres):
                near[at : at + len(scores)], best[at : at + len(scores)] = scores.argmax(axis=1), scores.max(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, v)
            size = np.linalg.norm(sums, axis=1)
            far = np.argsort(best, kind="stable")
            empty = np.flatnonzero(size == 0)
            sums[empty], size[empty] = v[far[: len(empty)]], 1.0
            centres = sums / size[:, None]
        return centres

    def _placed(self, df: DataFrame, probes: int) -> DataFrame:
        """(id, v, cell) for each of the ``probes`` nearest cells of a vector."""
        held = df.sparkSession.sparkContext.broadcast(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = held.value
            for batch in batches:
                if batch.num_rows:
                    v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    for at, scores in _slices(v, centres, probes * v.shape[1]):  # a vector comes once for each probe
                        near = _first_best(scores, probes)
                        who = pa.array(np.repeat(np.arange(at, at + len(near)), near.shape[1]))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(near.reshape(-1).astype(np.int32))], names=["id", "v", "cell"])

        return df.mapInArrow(run, "id long, v array<double>, cell int")

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probes: int) -> DataFrame:
        """(q, r, score, rank): the best ``k`` rows of the ``probes`` nearest cells of each query."""
        rows, asked = self._placed(self.rows, 1), self._placed(_side(queries, key, vector), probes)
        parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(name))
        sizes = F.broadcast(parts(rows, "n_rows").join(parts(asked, "n_asked"), "cell"))  # a row a centroid
        block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        a = asked.join(sizes, "cell").select("id", "v", "cell", block("n_asked").alias("x"), every("n_rows").alias("y"))
        b = rows.join(sizes, "cell").select("id", "v", "cell", every("n_asked").alias("x"), block("n_rows").alias("y"))
        met = a.groupBy("cell", "x", "y").cogroup(b.groupBy("cell", "x", "y")).applyInArrow(_best_of(k), "q long, r long, score double")
        return _top(met, k)

    def probes_for(self, queries: DataFrame, key: str, vector: str, k: int, recall: float = 0.9) -> tuple[int, float]:
        """The fewest cells, by doubling, at which a sample of MEASURED queries finds the stated share of its exact best ``k``, and the share found."""
        some = _side(queries, key, vector).orderBy(F.xxhash64("id"), "id").limit(MEASURED)
        exact = nearest(some, self.rows, "id", "id", "v", k).select("q", "r")
        # a partner is found as soon as its cell is looked into, so the place of that cell among the query's own says at how many probes
        pairs = self.rows.select(F.col("id").alias("r"), F.col("v").alias("b")).join(F.broadcast(exact), "r").join(F.broadcast(some.select(F.col("id").alias("q"), F.col("v").alias("a"))), "q")
        places: dict[tuple[int, int], int] = {}
        for x in pairs.collect():  # k * MEASURED rows at most
            cell = int((self.centroids @ np.array(x["b"])).argmax())
            place = int(np.flatnonzero(np.argsort(-(self.centroids @ np.array(x["a"])), kind="stable") == cell)[0])
            places[x["q"], x["r"]] = min(place, places.get((x["q"], x["r"]), place))
        probes = 1
        while True:
            share = sum(p < probes for p in places.values()) / max(1, len(places))
            if share >= recall or probes >= len(self.centroids):
                return probes, share
            probes = min(2 * probes, len(self.centroids))


def best_pairs(left: DataFrame, right: DataFrame, key: str, vector: str) -> DataFrame:
    """Pairs (a, b, score) of unit vectors that hold the best b of each a and the best a of each b, ties to the least.

    Every row of ``left`` is scored against every row of ``right``, block by block; a block emits the best of each of its rows, so no pair is shuffled.
    """

    def run(a_side: pa.Table, b_side: pa.Table) -> pa.Table:
        (a, x), (b, y) = _matrix(a_side), _matrix(b_side)
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        forth, best = np.empty(len(a), int), np.empty(len(a))
        back, most = np.zeros(len(b), int), np.full(len(b), -np.inf)
        for at, scores in _slices(x, y):
            scores = np.round(scores, 6)
            forth[at : at + len(scores)], best[at : at + len(scores)] = scores.argmax(axis=1), scores.max(axis=1)
            high = scores.max(axis=0)
            more = high > most  # the first of equal ones stays
            back[more], most[more] = at + scores.argmax(axis=0)[more], high[more]
        return pa.table({"a": np.concatenate([a, a[back]]), "b": np.concatenate([b[forth], b]), "score": np.concatenate([best, most])})

    return _scored(_side(left, key, vector), _side(right, key, vector), run, "a long, b long, score double")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """From scored pairs (a, b, score): the best b of each a and the best a of each b, ties to the least; sorted and distinct."""
    forth = pairs.groupBy("a").agg(F.max_by("b", F.struct("score", (-F.col("b")).alias("m"))).alias("b"))
    back = pairs.groupBy("b").agg(F.max_by("a", F.struct("score", (-F.col("a")).alias("m"))).alias("a"))
    return forth.select("a", "b").union(back.select("a", "b")).distinct()


def all_or_best(left: DataFrame, right: DataFrame, doc: str, best: DataFrame) -> DataFrame:
    """Pairs (doc, a, b) of two documents' chunks: all of them where they are ALL_PAIRS at most, else the given best pairs."""
    # both sides and the best meet in one shuffle by document; only lists of ALL_PAIRS ids at most are built
    w, side, none = Window.partitionBy(doc), F.col("__side"), F.lit(None)
    ids = left.select(doc, F.lit(0).alias("__side"), F.col("id").alias("a"), none.alias("b")).unionByName(right.select(doc, F.lit(1).alias("__side"), none.alias("a"), F.col("id").alias("b")))
    rows = ids.unionByName(best.select(doc, F.lit(2).alias("__side"), "a", "b"))
    times = lambda k: F.count(F.when(side == k, 1)).over(w)
    rows = rows.withColumn("__few", F.col(doc).isNotNull() & (times(0) * times(1)).between(1, ALL_PAIRS))
    rows = rows.withColumn("__right", F.collect_list(F.when(F.col("__few") & (side == 1), F.struct("b"))).over(w))
    every = F.transform("__right", lambda r: F.struct(F.col("a").alias("a"), r["b"].alias("b")))
    pairs = F.when(F.col("__few") & (side == 0), every).when(~F.col("__few") & (side == 2), F.array(F.struct("a", "b")))
    return rows.select(doc, F.explode(pairs).alias("p")).select(doc, "p.a", "p.b")


def weighted_jaccard(left: DataFrame, right: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Pairs (a, b, jaccard) whose sum of least over sum of greatest counts is at least ``least``; both sides are (id, tokens), ``left`` the smaller.

    Three exact filters come before the join. Sizes: such pairs are within that factor of each other. Words: tokens that ``left`` lacks are dropped before they move, and a
    text whose other tokens are too few goes. Prefixes: with each side's tokens from rare to frequent, such a pair shares one of the first
    ``size - least * size + 1``; pairs meet by those only, so that frequent words join nothing. What meets is counted in full.
    """
    # filters on a generated column stay above its generator, so that tokens are cut out of a text once only
    once = lambda df, key: df.select(key, F.explode(F.array("tokens")).alias("tokens"))
    sized = lambda df, key: once(df, key).select(key, "tokens", F.size("tokens").alias(f"size_{key}")).where(F.size("tokens") > 0)
    x, y = sized(left, a), sized(right, b)
    span = x.agg(F.min(f"size_{a}").alias("low"), F.max(f"size_{a}").alias("high")).first()
    sa, sb = F.col(f"size_{a}"), F.col(f"size_{b}")
    y = y.where(sb.between((span["low"] or 0) * least, (span["high"] or 0) / least))
    mine = x.select(a, sa, F.explode("tokens").alias("token")).groupBy(a, sa, "token").agg(F.count("*").alias("n_a"))
    # any order of words will do if it is the same on both sides: rare ones of ``left`` first
    words = mine.groupBy("token").agg(F.sum("n_a").alias("often"))
    known = F.broadcast(words) if words.limit(SMALL + 1).count() <= SMALL else words
    mine = mine.join(known, "token")
    theirs = y.select(b, sb, F.explode("tokens").alias("token")).join(known, "token").groupBy(b, sb, "token", "often").agg(F.count("*").alias("n_b"))

    def prefix(df: DataFrame, key: str, size: Column, n: str) -> DataFrame:
        """Tokens of the first ``size - least * size + 1`` places of a text, its own words before those that the other side has."""
        w = Window.partitionBy(key)
        before = F.sum(n).over(w.orderBy("often", "token").rowsBetween(Window.unboundedPreceding, -1))
        shared = F.sum(n).over(w)
        placed = df.withColumns({"before": F.coalesce(before, F.lit(0)) + size - shared, "shared": shared})
        return placed.where((F.col("shared") >= size * least) & (F.col("before") <= size - F.ceil(size * F.lit(least) - 1e-9))).select(key, size, "token")

    met = prefix(mine, a, sa, "n_a").join(prefix(theirs, b, sb, "n_b"), "token").where((sb >= sa * least) & (sb * least <= sa)).select(a, b).distinct()
    shared = met.join(mine, a).join(theirs, [b, "token"]).groupBy(a, b, sa, sb).agg(F.sum(F.least("n_a", "n_b")).alias("both"))
    return shared.select(a, b, (F.col("both") / (sa + sb - F.col("both"))).alias("jaccard")).where(F.col("jaccard") >= least)


def same_but_numbers(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines (id, line, skeleton, numbers) equal but for their numbers: an equi-join on the skeleton instead of all pairs."""
    a = left.select(F.col("id").alias("a"), F.col("line").alias("line_a"), "skeleton", F.col("numbers").alias("na")).where(F.size("na") > 0)
    b = right.select(F.col("id").alias("b"), F.col("line").alias("line_b"), "skeleton", F.col("numbers").alias("nb")).where(F.size("nb") > 0)
    return a.join(b, "skeleton").where("na != nb and a < b").select("a", "b", "line_a", "line_b")


# What a finding may say of two documents.
STATUSES = ("same", "changed", "only_a", "only_b")


def finding_ok(status: Column, quote_a: Column, quote_b: Column, explanation: Column, found_a: Column, found_b: Column) -> Column:
    """Valid findings: a known status and an explanation of at most 2,500 characters; a quote found on each side that it needs, and no quote
    that was not found; no "same" for wordings that are equal but for their numbers."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(X.ascii_digits(c), "[0-9]+", "#"), r"\s+", " "))
    contradicts = (status == "same") & (bare(quote_a) == bare(quote_b)) & (X.numbers(quote_a) != X.numbers(quote_b))
    needed = ((status == "only_b") | found_a) & ((status == "only_a") | found_b)
    invented = (has(quote_a) & ~found_a) | (has(quote_b) & ~found_b)
    said = has(explanation) & (F.length(explanation) <= 2500)
    return F.coalesce(status.isin(*STATUSES) & said & needed & ~invented & ~F.coalesce(contradicts, F.lit(False)), F.lit(False))


def verdicts(register: DataFrame, document: DataFrame, key: list[str]) -> DataFrame:
    """Register values against document values by label: match, mismatch or missing; numbers and dates compare by value, masked numbers by their tail."""
    from ..functions import dates, masking

    d = document.select(*key, F.col("value").alias("doc_value"))
    j = register.join(d, key, "left")
    a, b = F.col("value"), F.col("doc_value")
    same = (F.lower(F.trim(a)) == F.lower(F.trim(b))) | dates.same_number(a, b) | masking.masked_tail_matches(a, b) | (dates.parse_numeric_date(a).cast("string") == dates.parse_numeric_date(b).cast("string"))
    return j.withColumn("verdict", F.when(b.isNull() | (b == ""), "missing").when(F.coalesce(same, F.lit(False)), "match").otherwise("mismatch"))
