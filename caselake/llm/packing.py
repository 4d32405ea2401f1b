"""Operator 8, best-fit packing by a configuration linear program over the histogram of lengths.

Documents become token ids with a closing 0; only documents of more than ``size`` ids are cut. The
number of pieces of each length (at most ``size`` different ones, so the histogram is bounded) is
all that the driver sees. The configuration program, one variable for each way to fill a sequence,
is solved by multiplicative weights in small steps, priced by a knapsack dynamic program over the
sequence, which gives a dual bound as well. Amounts are rounded, the program is solved again for
what is left, and the last pieces are packed by best fit over the histogram. The
plan says for the r-th piece of a length which sequence and place it takes; ranks come from counts by
(length, bucket), so neither a length nor a sequence is ever gathered.

Defined results: null text is the one id 0; empty tables give no rows; repeated rows and null ids are
packed like any others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, blocks, lean, read_documents
from .tokens import default_path, word_bpe

SIZE = 2048
#: Rounds of the multiplicative weights at most, of all pieces and then of those that rounding leaves; the share of its demand that a length may gain in one, the rate at which covered
#: lengths lose weight, and how far below the best value a configuration may lie.
ROUNDS, STEP, RATE, NEAR = (200, 100, 50, 50), 0.05, 0.5, 0.05
#: Rows of one length in one bucket, on average at most.
BUCKET_ROWS = 200_000
#: Characters whose new words are encoded together.
BLOCK_CHARS = 2_000_000


def _best_values(lengths: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """By capacity: the greatest weight of a configuration, and the length to take there (0: leave a place empty)."""
    best = np.zeros(size + 1)
    take = np.zeros(size + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for room in range(int(lengths[0]), size + 1):
        n = fits[room]
        value = best[room - lengths[:n]] + weights[:n]
        k = int(value.argmax())
        if value[k] > best[room - 1]:
            best[room], take[room] = value[k], lengths[k]
        else:
            best[room] = best[room - 1]
    return best, take


def _trace(take: np.ndarray, room: int) -> dict[int, int]:
    """The configuration that reaches the best value of this capacity."""
    found: dict[int, int] = {}
    while room > 0:
        if k := int(take[room]):
            found[k] = found.get(k, 0) + 1
            room -= k
        else:
            room -= 1
    return found


def solve(histogram: dict[int, int], size: int, rounds: int = ROUNDS[0], step: float = STEP, rate: float = RATE, near_by: float = NEAR) -> tuple[dict[tuple, float], float]:
    """Fractional amounts of configurations that cover the histogram, and a lower bound on the sequences needed.

    Covering by multiplicative weights: a length weighs its size times exp(-rate * covered share), so that what lags
    behind gains. Each round prices all configurations by one dynamic program; for every open length, the best
    configuration with it is used if its value is within ``step`` of the best one, by a small amount: no length gains
    more than ``step`` of its demand in a round. Any weights give a bound by duality: the demand's weight over the best value.
    """
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[k] for k in lengths.tolist()], float)
    place = {k: i for i, k in enumerate(lengths.tolist())}
    share = np.zeros(len(lengths))
    program: dict[tuple, float] = {}
    bound = (lengths * demand).sum() / size
    for _ in range(rounds):
        open_ = share < 1 - 1e-9
        if not open_.any():
            break
        weights = np.where(open_, lengths * np.exp(rate * (share[open_].min() - share)), 0.0)
        best, take = _best_values(lengths, weights, size)
        bound = max(bound, float(weights @ demand / best[size]))
        near = open_ & (weights + best[size - lengths] >= (1 - near_by) * best[size])
        chosen: dict[tuple, None] = {}
        for k in lengths[near].tolist():
            found = _trace(take, size - k)
            found[k] = found.get(k, 0) + 1
            chosen[tuple(sorted(found.items(), reverse=True))] = None
        room = np.minimum(step, 1 - share) * demand  # pieces of each length that this round may still cover
        for c in chosen:
            x = min(room[place[k]] / n for k, n in c)
            if x > 0:
                program[c] = program.get(c, 0.0) + x
                for k, n in c:
                    room[place[k]] -= n * x
                    share[place[k]] += n * x / demand[place[k]]
    return program, bound


def _fill(left: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Best fit over a histogram: the longest piece first, then always the longest that still fits."""
    left, used = dict(left), []
    keys = sorted((k for k in left if left[k]), reverse=True)
    while keys:
        found, room = {}, size
        for k in keys:
            if k <= room and (n := min(left[k], room // k)):
                found[k], room = n, room - n * k
        times = min(left[k] // n for k, n in found.items())
        used.append((found, times))
        for k, n in found.items():
            left[k] -= n * times
        keys = [k for k in keys if left[k]]
    return used


def rounded(left: dict[int, int], program: dict[tuple, float]) -> list[tuple[dict[int, int], int]]:
    """Configurations of the program in whole numbers, along the running sum of their amounts; what they hold is taken from ``left``."""
    used, running, done = [], 0.0, 0
    for c, x in sorted(program.items(), key=lambda p: (-p[1], p[0])):
        running += x
        times = min(int(running) - done, *(left[k] // m for k, m in c))
        done = int(running)
        if times > 0:
            used.append((dict(c), times))
            for k, m in c:
                left[k] -= m * times
    return used


def plan(histogram: dict[int, int], size: int = SIZE, rounds: tuple[int, ...] = ROUNDS, step: float = STEP) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Configurations and how often each is used, which together hold exactly the pieces of the histogram, and the lower bound.

    The program is solved and rounded, then solved again for the pieces that rounding left, with fewer rounds each time; what is left
    at last, some pieces of each length, is packed by best fit. Only where best fit of everything needs fewer sequences is that taken.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    full = [({size: 1}, n)] if (n := left.pop(size, 0)) else []
    if not left:
        return full, float(n)
    plain, used, bound = _fill(left, size), [], 0.0
    for most in rounds:
        left = {k: v for k, v in left.items() if v > 0}
        if left:
            program, below = solve(left, size, most, step)
            bound = bound or below
            used += rounded(left, program)
    used += _fill(left, size)
    return full + min(used, plain, key=lambda u: sum(t for _, t in u)), n + bound


def _slots(used: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length in a sequence, place of the first), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for found, times in used:
        at = 0
        for k in sorted(found, reverse=True):
            rows.append((k, rank.get(k, 0), sequence, found[k], at))
            rank[k] = rank.get(k, 0) + found[k] * times
            at += k * found[k]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(tokenizer)
        for batch in lean(batches):
            row, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, ids in ((a + k, x) for a, b in blocks(texts, [len(t) for t in texts], BLOCK_CHARS) for k, x in enumerate(encoder.encode_all(texts[a:b]))):
                data = ids + b"\0\0\0\0"
                n = len(data) // 4
                for k, s in enumerate(range(0, n, size)):
                    part = data[4 * s : 4 * (s + size)]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = T.StructType([docs.schema["doc_id"]]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.cut(pieces(docs, tokenizer, size).withColumn("row", F.monotonically_increasing_id()))  # written, so a row keeps its number
    n_buckets = max(64, cut.count() // BUCKET_ROWS)
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(n_buckets)))
    counts = scratch.cut(keyed.groupBy("length", "bucket").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``size`` rows
    slots = _slots(plan(histogram, size)[0])
    key = slots[:, 0] * (1 << 44) + slots[:, 1] if len(slots) else np.zeros(0, np.int64)
    before = counts.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    order = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = keyed.withColumn("r", F.row_number().over(order) - 1).join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("before")).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            length, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            s = slots[np.searchsorted(key, length * (1 << 44) + r, side="right") - 1]
            j = r - s[:, 1]
            sequence, offset = s[:, 2] + j // s[:, 3], s[:, 4] + (j % s[:, 3]) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([cut.schema[c] for c in names]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack(read_documents(spark, sf_dir, "doc_id", "text"), tokenizer or default_path("word_bpe_49k.json"))
