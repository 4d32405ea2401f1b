"""Operator 13, periodic runs of words by the tandem-repeat method of Gusfield and Stoye.

A document is first cut down to the stretches that can hold a run. A run of ``length >= max(least, 2 * period)`` equals itself
``period`` words on over at least half of its length, so each of its words lies in a window of ``least // 2`` words that comes again within the run;
what no such window covers is left out, again and again until nothing changes. This loses no run.

On each stretch the method proper works: a suffix tree (suffix array with the intervals of its longest common prefixes), the
Lempel-Ziv blocks, for each block the squares whose centre lies in it (a set that covers the leftmost occurrence of every square),
their places in the tree, and suffix-link walks from there to all rotations that occur, which completes the vocabulary of squares.
Squares whose half is itself a power are left out, as their root is a square too. All occurrences of the vocabulary
are read off the leaves below its places, and occurrences of one half length at consecutive words merge into runs.

Words are compared by numbers given to them within a block of documents, never by hashes (a hash only chooses windows, where a
collision keeps a stretch too many). Memory of a task: a block of BLOCK characters, or one document, times the logarithm
of its longest stretch.

Defined results: null and empty texts have no words and no runs, and collapse to the empty text; a null id has no number, so its words stay as
they are; repeated rows give a row each. Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, blocks, lean, mix, read_documents
from .rendezvous import crc32_sql

#: Least length of a run; characters of the documents that are worked on together.
LEAST, BLOCK = 12, 1_000_000


class Numbers(dict):
    """Numbers of words in order of appearance."""

    def __missing__(self, word: str) -> int:
        got = self[word] = len(self)
        return got


class SuffixTree:
    """Suffixes of a sequence in order, with the ranks of all its substrings of 2^j words, for longest common extensions.

    A node of the tree is an interval of ``order`` whose suffixes share a prefix.
    """

    def __init__(self, s: np.ndarray):
        n = self.n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        self.levels, width = [], 1
        while True:
            # where the sequence ends before 2^j words, the rest counts as 0, below every word
            self.levels.append(np.append(rank, -1).astype(np.int32))
            if int(rank.max()) == n - 1:
                break
            second = np.zeros(n, np.int64)
            second[: max(n - width, 0)] = rank[width:] + 1
            rank = np.unique(rank * (n + 1) + second, return_inverse=True)[1]
            width *= 2
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        lcp = np.zeros(n + 1, np.int64)
        lcp[1:n] = self.forward(self.order[:-1], self.order[1:])
        #: least[j][r]: the least of 2^j common prefixes from r on (a prefix is shared with the suffix before)
        self.least, width = [lcp], 1
        while 2 * width <= n + 1:
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and from j on; i and j differ."""
        got = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            level = self.levels[k]
            got += (level[i + got] == level[j + got]).astype(np.int64) << k
        return got

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words that end at i and at j; i and j differ, -1 is before the first word."""
        got = np.zeros(len(i), np.int64)
        low = np.minimum(i, j)
        for k in range(len(self.levels) - 2, -1, -1):
            level, step = self.levels[k], 1 << k
            back = got + (step - 1)
            inside = low >= back
            got += (inside & (level[np.where(inside, i - back, 0)] == level[np.where(inside, j - back, 1)])).astype(np.int64) << k
        return got

    def node(self, r: int, length: int) -> tuple[int, int]:
        """The first and the last suffix that share ``length`` words with the suffix of rank r."""
        lo, hi = r, r + 1
        for k in range(len(self.least) - 1, -1, -1):
            step = 1 << k
            if lo - step >= 0 and self.least[k][lo - step + 1] >= length:
                lo -= step
            if hi + step <= self.n and self.least[k][hi] >= length:
                hi += step
        return lo, hi - 1


def previous_factors(tree: SuffixTree) -> np.ndarray:
    """Of each place, the longest prefix of its suffix that also starts earlier.

    Its partner is the nearest suffix in order, above or below, that starts earlier: places leave a linked list from the last to the first.
    """
    n, rank = tree.n, tree.rank.tolist()
    above, below = list(range(-1, n - 1)), list(range(1, n + 1))
    up, down = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        p, q = up[i], down[i] = above[r], below[r]
        if p >= 0:
            below[p] = q
        if q < n:
            above[q] = p
    at, got = np.arange(n), np.zeros(n, np.int64)
    for near in (np.array(up), np.array(down)):
        real = (near >= 0) & (near < n)
        got[real] = np.maximum(got[real], tree.forward(at[real], tree.order[near[real]]))
    return got


def block_starts(tree: SuffixTree) -> np.ndarray:
    """Where the Lempel-Ziv blocks start, and the end: each block is the longest that also starts earlier, or one new word."""
    longest, starts, h = previous_factors(tree).tolist(), [], 0
    while h < tree.n:
        starts.append(h)
        h += max(1, longest[h])
    return np.array([*starts, tree.n])


def counts_up(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, the numbers 1 to sizes[i]: i repeated, and the numbers."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(1, len(which) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def covering_squares(tree: SuffixTree, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of squares, of which one lies at or before every leftmost occurrence with only squares of that length between."""
    h, end, size = starts[:-1], starts[1:], np.diff(starts)
    found = []
    # the centre is in the block and the square reaches beyond its end
    t, k = counts_up(size)
    e = end[t]
    t, k, e = t[e < tree.n], k[e < tree.n], e[e < tree.n]
    q = e - k
    ahead, behind = tree.forward(e, q), tree.backward(e - 1, q - 1)
    ok = (ahead + behind >= k) & (ahead > 0)
    found.append((np.maximum(q - behind, q - k + 1)[ok], k[ok]))
    # the square starts before the block and its centre is in it
    t, k = counts_up(size + np.append(size[1:], 0))
    b, e = h[t], end[t]
    inside = (b > 0) & (b + k < tree.n)
    b, e, k = b[inside], e[inside], k[inside]
    ahead, behind = tree.forward(b, b + k), tree.backward(b - 1, b + k - 1)
    at = np.maximum(b - behind, b - k + 1)
    ok = (ahead + behind >= k) & (ahead > 0) & (behind > 0) & (at + k <= e)
    found.append((at[ok], k[ok]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def primes_of(k: int) -> list[int]:
    found, d = [], 2
    while d * d <= k:
        if k % d == 0:
            found.append(d)
            while k % d == 0:
                k //= d
        d += 1
    return [*found, k] if k > 1 else found


def primitive(tree: SuffixTree, at: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Which squares have a half that is no power of a shorter word."""
    keep = np.ones(len(at), bool)
    for k in np.unique(half).tolist():
        of = np.flatnonzero(half == k)
        for prime in primes_of(k):
            root = k // prime
            keep[of] &= tree.forward(at[of], at[of] + root) < 2 * k - root
    return keep


def vocabulary(s: np.ndarray, tree: SuffixTree, at: np.ndarray, half: np.ndarray) -> list[tuple[int, int, int]]:
    """All squares with primitive halves as nodes of the tree: (first suffix, last suffix, half length).

    A walk goes from a square to the next rotation: the suffix link drops its first word, and the edge on which that word
    follows is taken. While the text itself goes on so, that is the next word of the text; where it does not, another occurrence
    below the node may. A walk ends at a square that is marked, after a full turn, or where no such edge leaves.
    """
    marked: set[tuple[int, int]] = set()
    out = []
    rank, order, n = tree.rank, tree.order, tree.n
    walks = list(zip(at.tolist(), half.tolist(), strict=True))
    while walks:
        i, k = walks.pop()
        for _ in range(k):
            lo, hi = tree.node(int(rank[i]), 2 * k)
            if (lo, k) in marked:
                break
            marked.add((lo, k))
            out.append((lo, hi, k))
            first = s[i]
            if i + 2 * k < n and s[i + 2 * k] == first:
                i += 1
                continue
            if i + 1 >= n:
                break
            a, b = tree.node(int(rank[i + 1]), 2 * k - 1)
            b += 1
            stop = b
            while a < b:  # suffixes below the node are in order of the word that follows; the end of the text comes first
                m = (a + b) // 2
                after = int(order[m]) + 2 * k - 1
                if after >= n or s[after] < first:
                    a = m + 1
                else:
                    b = m
            if a == stop or (after := int(order[a]) + 2 * k - 1) >= n or s[after] != first:
                break
            i = int(order[a])
    return out


def runs_of(s: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs (start, length, smallest period) of a sequence of numbers, of ``length >= max(least, 2 * period)``."""
    if len(s) < 2:
        return []
    tree = SuffixTree(s)
    at, half = covering_squares(tree, block_starts(tree))
    if not len(at):
        return []
    keep = primitive(tree, at, half)
    # dense numbers keep the order of the words, which the order of suffixes follows
    nodes = vocabulary(s, tree, at[keep], half[keep])
    places = np.concatenate([tree.order[lo : hi + 1] for lo, hi, _ in nodes])
    halves = np.repeat([k for *_, k in nodes], [hi + 1 - lo for lo, hi, _ in nodes])
    by = np.lexsort((places, halves))
    places, halves = places[by], halves[by]
    begins = np.flatnonzero(np.append(True, (np.diff(places) != 1) | (np.diff(halves) != 0)))
    start, period = places[begins], halves[begins]
    length = np.append(begins[1:], len(places)) - begins + 2 * period - 1
    ok = length >= np.maximum(least, 2 * period)
    return sorted(zip(start[ok].tolist(), length[ok].tolist(), period[ok].tolist(), strict=True))


def stretches(numbers: np.ndarray, document: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of the sequence, each within a document, that hold all runs: every word lies in a window that the range holds twice."""
    width = max(1, least // 2)
    place, part, size = np.arange(len(numbers)), document.astype(np.int64), -1
    while len(place) >= least and len(place) != size:
        size = len(place)
        words = numbers[place].astype(np.uint64)
        code = np.zeros(size - width + 1, np.uint64)
        for j in range(width):
            code = mix(code + words[j : j + len(code)] + np.uint64(1))
        code ^= mix(part[: len(code)].astype(np.uint64) + np.uint64(1 << 40))
        whole = np.flatnonzero(part[: len(code)] == part[width - 1 :])
        code = code[whole]
        by = np.argsort(code)
        same = code[by][1:] == code[by][:-1]
        twice = np.zeros(len(code) + 1, bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        depth = np.zeros(size + 1, np.int64)
        at = whole[twice[:-1]]
        np.add.at(depth, at, 1)
        np.add.at(depth, at + width, -1)
        covered = np.cumsum(depth[:-1]) > 0
        # a part ends where words are left out or where the part before did
        fresh = np.append(True, (np.diff(place) != 1) | (np.diff(part) != 0))
        number = np.cumsum(fresh | ~covered | np.append(True, ~covered[:-1]))
        counted = np.bincount(number[covered], minlength=int(number[-1]) + 1)
        keep = covered & (counted[number] >= least)
        place, part = place[keep], number[keep]
    if not len(place) or len(place) < least:
        return []
    begins = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(part) != 0)))
    ends = np.append(begins[1:], len(place)) - 1
    return list(zip(place[begins].tolist(), (place[ends] + 1).tolist(), strict=True))


def block_runs(lists: list[list[str]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words."""
    number = Numbers().__getitem__
    sizes = [len(x) for x in lists]
    numbers = np.fromiter((number(w) for x in lists for w in x), np.int64, sum(sizes))
    first = np.cumsum([0, *sizes])
    out: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    for a, b in stretches(numbers, np.repeat(np.arange(len(lists)), sizes), least):
        d = int(np.searchsorted(first, a, side="right")) - 1
        out[d] += [(a - int(first[d]) + i, length, q) for i, length, q in runs_of(numbers[a:b], least)]
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """Words joined by a space, without those that a run holds after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    return " ".join(words)


def periodic(doc_id: object, words: list[str]) -> list[str]:
    """The words of the registered query: one document in ten, by the CRC-32 of its id, ends in a repetition."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))


def find_runs(docs: DataFrame, least: int = LEAST, change: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """Each document's doc_id, runs (by start, then period) and collapsed text; ``change`` gives other words to an id before."""
    schema = T.StructType([docs.schema["doc_id"]]).add("runs", RUNS).add("collapsed", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in lean(batches):
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            found, short = [], []
            for a, b in blocks(texts, [len(t) for t in texts], BLOCK):
                lists = [WORD.findall(t) for t in texts[a:b]]
                if change:
                    lists = [change(i, x) for i, x in zip(ids[a:b], lists, strict=True)]
                for words, runs in zip(lists, block_runs(lists, least), strict=True):
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    short.append(collapsed(words, runs))
            if texts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(short, pa.string())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def digest(runs: Column) -> Column:
    """SHA-256 of a line for each run."""
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256)


def op13_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one document in ten ending in a repetition."""
    found = find_runs(read_documents(spark, sf_dir, "doc_id", "text"), change=periodic)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("best", best)
    length, period = -F.col("best.l"), F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        digest(F.col("runs")).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: All pairs of equal words of a document, as islands by distance: quadratic, and fit for small tables only.
ORACLE = rf"""
WITH base AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce({crc32_sql("hex(encode(doc_id::VARCHAR))")}, 1) AS h FROM documents),
places AS (SELECT *, len(w) AS n, h // 10 % greatest(len(w), 1) AS a FROM base),
periods AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM places),
words AS (SELECT d, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM periods)),
pairs AS (SELECT x.d, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.d = y.d AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
islands AS (SELECT d, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS g FROM pairs) GROUP BY d, q, g HAVING count(*) + q >= greatest(12, 2 * q)),
runs AS (SELECT d, s, l, min(q) AS q FROM islands GROUP BY d, s, l),
told AS (SELECT d, count(*) AS n_runs, first([s, l, q] ORDER BY l DESC, s, q) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY d),
gone AS (SELECT DISTINCT d, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT d, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (d, i) GROUP BY d)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, best[2] * 1000 // best[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM base LEFT JOIN told USING (d) LEFT JOIN kept USING (d)
"""
