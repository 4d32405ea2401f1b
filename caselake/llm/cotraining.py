"""Operator 9, quality classifier by co-training of two views.

One view sees the text only: its hashed words, and character, word, line and repetition statistics. The other sees the page
metadata only: hashed source and language. Each is a logistic classifier fitted on the labelled sample; over rounds, each names
the unlabelled documents it is surest of, out of all of them, and the other learns those too. Both are calibrated on the labelled
sample by cross-fitting, the combination of the calibrated views is fitted there as well, and all documents are scored.

Both views of every document are written once, as numbers. A round reads them in one pass: each task keeps the surest documents
of each list, and a top-k over the tasks' lists is all that reaches the driver. Only the labelled sample is bounded
(``per_class`` documents of each class).

Defined results: null text and null metadata are values of their own; missing metadata columns
count as null; without both classes in training every score is the share of good labels (1 without
labels); several labels of a document count as good only if all are; repeated rows are scored each, and each may be learned from.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import U, WORD, Scratch, WordHashes, blocks, hash_words, lean, read_documents
from .linear import apply, fit_logistic, sigmoid

PER_CLASS = 2000
ROUNDS, TAKE, FOLDS = 5, 60, 3
#: How sure a view must be of a document that it names.
SURE = 0.9
METADATA = ("source", "lang")
HASHED, WORD_BUCKETS, STATISTICS = 48, 64, 16
BLOCK_CHARS = 1_000_000
VIEWS = ("text_x", "meta_x")


def statistics(text: str, words: list[str]) -> list[float]:
    """Statistics of a text; all in comparable ranges."""
    if not text:
        return [1.0] + [0.0] * (STATISTICS - 1)
    n, n_words = len(text), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    count = lambda chars: sum(map(text.count, chars))
    grams = max(0, len(words) - 4)
    distinct = len(set(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)))
    top = Counter(lines).most_common(1)[0][1] / n_lines if lines else 0.0
    blank = count(" \n\t")
    return [
        0.0, np.log1p(n) / 10, np.log1p(len(words)) / 8, sum(map(str.isalpha, words)) / n_words, sum(map(str.isupper, words)) / n_words, 10 * count("#*$%&|<>") / n,
        10 * text.count("|") / n, 10 * text.count("!") / n, count("0123456789") / n, (n - blank) / n_words / 10,
        1 - distinct / grams if grams else 0.0, 1 - len(set(lines)) / n_lines, top, np.log1p(len(words) / n_lines) / 4,
        len(set(words)) / n_words, 5 * count(".,;:") / n,
    ]


def text_view(texts: list[str | None], cache: WordHashes) -> np.ndarray:
    """Statistics, and the square roots of the shares of hashed words, one row for each text."""
    texts = [t or "" for t in texts]
    lists = [WORD.findall(t) for t in texts]
    h, starts = hash_words([[w.lower() for w in x] for x in lists], cache)
    at = np.repeat(np.arange(len(texts)), np.diff(starts)) * WORD_BUCKETS + (h % U(WORD_BUCKETS)).astype(np.int64)
    words = np.bincount(at, minlength=len(texts) * WORD_BUCKETS).reshape(len(texts), WORD_BUCKETS)
    words = np.sqrt(words / np.maximum(1, words.sum(axis=1, keepdims=True)))
    return np.hstack([np.array([statistics(t, x) for t, x in zip(texts, lists, strict=True)]).reshape(-1, STATISTICS), words])


def meta_view(source: str | None, lang: str | None) -> list[float]:
    out = [0.0] * HASHED
    for name, value in zip(METADATA, (source, lang), strict=True):
        out[zlib.crc32(f"{name}={value}".encode("utf-8", "surrogatepass")) % HASHED] = 1.0
    return out


def views(docs: DataFrame) -> DataFrame:
    """doc_id, row (any distinct numbers) and both views, as packed 32-bit numbers."""
    have = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(f"__{c}") for c in METADATA]
    source = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", *have)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in lean(batches):
            texts, *meta = (batch.column(i).to_pylist() for i in (2, 3, 4))
            text_x: list[bytes] = []
            for a, b in blocks(texts, [len(t or "") for t in texts], BLOCK_CHARS):
                text_x += [x.tobytes() for x in text_view(texts[a:b], cache).astype("<f4")]
            meta_x = [np.array(meta_view(*m), "<f4").tobytes() for m in zip(*meta, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text_x, pa.binary()), pa.array(meta_x, pa.binary())], names=["doc_id", "row", *VIEWS])

    return source.mapInArrow(run, T.StructType([docs.schema["doc_id"]]).add("row", "long").add("text_x", "binary").add("meta_x", "binary"))


def unpacked(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<f4").reshape(len(cells), -1).astype(float)


@dataclass
class CoTrained:
    """Weights of both views, their calibrations, and the combination."""

    weights: list[np.ndarray]
    calibrated: list[np.ndarray]
    final: np.ndarray

    def logits(self, xs: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([apply(c, apply(w, x)[:, None]) for w, c, x in zip(self.weights, self.calibrated, xs, strict=True)])

    def scores(self, xs: list[np.ndarray]) -> np.ndarray:
        return sigmoid(apply(self.final, self.logits(xs)))


#: A list of the surest documents: model, view that names them, label.
Key = tuple[int, int, int]
#: Asked with the weights of each model's views and the rows that each list may not name again, for so many rows of each list:
#: (row, text view, metadata view), the surest first.
Naming = Callable[[list[list[np.ndarray]], dict[Key, set[int]], dict[int, int]], dict[Key, list[tuple[int, np.ndarray, np.ndarray]]]]


def surest(weights: list[list[np.ndarray]], taken: dict[Key, set[int]], take: dict[int, int], rows: np.ndarray, xs: list[np.ndarray]) -> Iterator[tuple[Key, np.ndarray, np.ndarray]]:
    """(list, places, how sure) of the rows that each model's views are surest of, ties to the least row."""
    for m, pair in enumerate(weights):
        for k, w in enumerate(pair):
            p = sigmoid(apply(w, xs[k]))
            for label, n in take.items():
                sure = p if label else 1 - p
                at = np.flatnonzero((sure >= SURE) & ~np.isin(rows, list(taken.get((m, k, label), ()))))
                best = at[np.lexsort((rows[at], -sure[at]))][:n]
                yield (m, k, label), best, sure[best]


def co_train(xs: list[np.ndarray], y: np.ndarray, naming: Naming, share: float, rounds: int = ROUNDS, take: int = TAKE) -> CoTrained:
    """``xs``: both views of the labelled sample; ``share`` of good documents in the corpus. The folds' models and the whole one advance together."""
    balance = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean()))
    fold = np.arange(len(y)) % FOLDS
    known = [*(np.flatnonzero(fold != f) for f in range(FOLDS)), np.arange(len(y))]
    given: list[list[list[tuple[np.ndarray, int]]]] = [[[], []] for _ in known]
    taken: dict[Key, set[int]] = {}
    good = int(round(take * share))

    def fitted(m: int, k: int) -> np.ndarray:
        extra, rows = given[m][k], known[m]
        x = np.vstack([xs[k][rows], *(v[None] for v, _ in extra)])
        return fit_logistic(x, np.append(y[rows], [label for _, label in extra]), np.append(balance[rows], np.full(len(extra), 0.5)))

    for step in range(rounds + 1):
        weights = [[fitted(m, k) for k in (0, 1)] for m in range(len(known))]
        if step == rounds:
            break
        for (m, k, label), named in naming(weights, taken, {1: good, 0: take - good}).items():
            given[m][1 - k] += [(named_xs[1 - k], label) for _, *named_xs in named]
            for other in (0, 1):  # the other view is given a document once only
                taken.setdefault((m, k, other), set()).update(r for r, *_ in named)
    raw = np.zeros((len(y), 2))
    for f in range(FOLDS):
        for k in (0, 1):
            raw[fold == f, k] = apply(weights[f][k], xs[k][fold == f])
    calibrated = [fit_logistic(raw[:, [k]], y, balance, ridge=0.1) for k in (0, 1)]
    logits = np.column_stack([apply(c, raw[:, [k]]) for k, c in enumerate(calibrated)])
    return CoTrained(weights[-1], calibrated, fit_logistic(logits, y, balance, ridge=0.1))


def naming_over(pool: DataFrame) -> Naming:
    """The surest rows of a table of views: a few of each task, then a top-k over the tasks."""

    def ask(weights: list[list[np.ndarray]], taken: dict[Key, set[int]], take: dict[int, int]) -> dict[Key, list[tuple[int, np.ndarray, np.ndarray]]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[Key, list[tuple[float, int, bytes, bytes]]] = {}
            for batch in lean(batches):
                if not batch.num_rows:
                    continue
                rows, cells = batch.column(0).to_numpy(), [batch.column(i).to_pylist() for i in (1, 2)]
                for key, best, sure in surest(weights, taken, take, rows, [unpacked(c) for c in cells]):
                    found = kept.get(key, []) + [(-s, int(rows[i]), cells[0][i], cells[1][i]) for s, i in zip(sure.tolist(), best.tolist(), strict=True)]
                    kept[key] = sorted(found)[: take[key[2]]]
            out = [(*key, -s, r, a, b) for key, found in kept.items() for s, r, a, b in found]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (*[pa.int32()] * 3, pa.float64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["m", "k", "label", "sure", "row", *VIEWS])

        named = pool.select("row", *VIEWS).mapInArrow(run, "m int, k int, label int, sure double, row long, text_x binary, meta_x binary")
        order = F.row_number().over(Window.partitionBy("m", "k", "label").orderBy(F.desc("sure"), "row"))
        # the plain bound comes first, as Spark cuts the lists in each task by it
        top = named.withColumn("n", order).where(F.col("n") <= max(take.values())).where(F.when(F.col("label") == 1, F.col("n") <= take[1]).otherwise(F.col("n") <= take[0]))
        found: dict[Key, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for r in sorted(top.collect(), key=lambda r: r["n"]):  # 2 * (FOLDS + 1) * TAKE rows at most
            found.setdefault((r["m"], r["k"], r["label"]), []).append((r["row"], *(unpacked([bytes(r[v])])[0] for v in VIEWS)))
        return dict(sorted(found.items()))

    return ask


def fit(table: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, scratch: Scratch | None = None) -> CoTrained | float:
    """The model from a table of views, or the one score that all documents get."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    total = counts.get(0, 0) + counts.get(1, 0)
    share = counts.get(1, 0) / total if total else 1.0
    if not counts.get(0) or not counts.get(1):
        return share
    scratch = scratch or Scratch(table.sparkSession, "cotraining")
    known = scratch.cut(table.join(marked, "doc_id"))
    chosen = []
    for value in (0, 1):
        chosen += known.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id", "text_x").limit(per_class).collect()  # packed numbers of a bounded sample
    y = np.array([r["y"] for r in chosen], float)
    if not ((y == 0).any() and (y == 1).any()):
        return share
    pool = scratch.cut(table.join(marked, "doc_id", "left_anti").select("row", *VIEWS))
    xs = [unpacked([bytes(r[v]) for r in chosen]) for v in VIEWS]
    order = np.random.default_rng(0).permutation(len(y))  # classes in every fold
    model = co_train([x[order] for x in xs], y[order], naming_over(pool), share)
    scratch.drop(known, pool)
    return model


def score(table: DataFrame, model: CoTrained | float) -> DataFrame:
    """doc_id, text_score and meta_score (calibrated views) and score, from a table of views."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            n = batch.num_rows
            if isinstance(model, float) or not n:
                out = [np.full(n, model if isinstance(model, float) else 0.0)] * 3
            else:
                xs = [unpacked(batch.column(i).to_pylist()) for i in (1, 2)]
                out = [*sigmoid(model.logits(xs)).T, model.scores(xs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in out)], names=schema.names)

    schema = T.StructType([table.schema["doc_id"]]).add("text_score", "double").add("meta_score", "double").add("score", "double")
    return table.select("doc_id", *VIEWS).mapInArrow(run, schema)


def op9_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, both views' scores, the combined score, predicted and kept for every document."""
    return quality(read_documents(spark, sf_dir, "doc_id", "text", *METADATA), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Learn from ``labels`` and score ``docs``."""
    scratch = Scratch(docs.sparkSession, "cotraining")
    table = scratch.cut(views(docs))
    model = fit(table, labels, per_class, scratch)
    good = F.col("score") >= 0.5
    return score(table, model).select("doc_id", "text_score", "meta_score", "score", good.cast("int").alias("predicted"), good.alias("kept"))
