"""Operator 10, toxicity by a subsequence string kernel with Nyström landmarks.

Two strings are similar by the three-character subsequences they share, each weighted by decay to the
power of the length it spans; spans are at most five characters, so one inserted character between any two
still counts; other signs than letters and digits are left out of a word first (``i-d-i-o-t``). Landmarks are strings that tell toxic training documents from others. A
word's kernel values to the landmarks come from one table of their subsequences; a sentence takes the
largest value of its words for each landmark, is mapped by the inverse root of the landmarks' own kernel
matrix (Nyström), and scored by a support vector machine trained on sentences. Labels are by
document: each toxic document contributes its most toxic sentences, re-chosen over some rounds. The margins
of a document's sentences and its length are calibrated to a probability.

Fitted on a bounded sample (``per_class`` labelled documents of each class in the order of a hash of their ids, those that fit into
``max_chars`` characters in all, very long ones by some of their sentences); every text is scored whole.

Defined results: null and empty texts get the score of a text without sentences; without both classes
in training every score is 0; a document with several labels counts as toxic if any label says so;
unlabelled or null labels train nothing; a null id is not held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, blocks, crc_of_id, lean, mix, read_documents
from .linear import apply, fit_logistic, fit_svm, sigmoid

#: Offsets of the second and third character; the decay of a spanned character.
GAPS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
DECAY = 0.8
PER_CLASS, MAX_CHARS, LANDMARKS = 1500, 8_000_000, 64
#: A document fills at most this part of the characters of its class.
LONGEST = 20
#: Buckets that count strings before the frequent ones are told apart.
STRING_BUCKETS = 1 << 22
#: A word takes part from this squared share of a landmark's own kernel value on.
ACTIVE = 0.15
BITS = 20
BLOCK_CHARS = 1_000_000
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What may be put between the letters of a word to hide it.
INNER = re.compile(r"[\W_]+")


def _triples(code: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(place, hashed subsequence, weight) for each gap pattern; an owner's characters are consecutive."""
    c = code.astype(U)
    for i, j in GAPS:
        if len(c) <= j:
            continue
        n = len(c) - j
        at = np.flatnonzero(owner[:n] == owner[j:])
        yield at, (mix((c[at] << U(42)) ^ (c[at + i] << U(21)) ^ c[at + j]) >> U(64 - BITS)).astype(np.int64), DECAY ** (j + 1)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, np.repeat(np.arange(len(words)), [len(w) for w in words])


class Kernel:
    """Squared values of words to the landmarks, as shares of each landmark's own value (at most 1)."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        code, owner = _codes(landmarks)
        features: dict[tuple[int, int], float] = {}
        for at, gram, weight in _triples(code, owner):
            for z, g in zip(owner[at].tolist(), gram.tolist(), strict=True):
                features[g, z] = features.get((g, z), 0.0) + weight
        own = np.zeros(len(landmarks))
        by: dict[int, list[tuple[int, float]]] = {}
        for (g, z), v in features.items():
            own[z] += v * v
            by.setdefault(g, []).append((z, v))
        self.slot = np.zeros(1 << BITS, np.int32)
        self.first, self.z, self.v = [0, 0], [], []
        for k, (g, entries) in enumerate(sorted(by.items()), 1):
            self.slot[g] = k
            self.z += [z for z, _ in entries]
            self.v += [v / own[z] for z, v in entries]
            self.first.append(len(self.z))
        self.first, self.z, self.v = np.array(self.first), np.array(self.z, np.int64), np.array(self.v)
        k = self.values(landmarks)
        root = np.outer(own, 1 / own)
        gram = (k * root + (k * root).T) / 2
        value, vector = np.linalg.eigh(gram)
        self.map = vector / np.sqrt(np.maximum(value, 0.05)) @ vector.T

    def values(self, words: list[str]) -> np.ndarray:
        """(words, landmarks)."""
        m = len(self.landmarks)
        code, owner = _codes(words)
        total = np.zeros(len(words) * m)
        for at, gram, weight in _triples(code, owner):
            slot = self.slot[gram]
            hit = np.flatnonzero(slot)
            k = slot[hit]
            n = self.first[k + 1] - self.first[k]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[k], n)
            key = np.repeat(owner[at[hit]], n) * m + self.z[entry]
            total += np.bincount(key, weights=self.v[entry] * weight, minlength=len(total))
        return np.minimum(total.reshape(-1, m), 1.0) ** 2


class Sentences:
    """Sentences of texts with a word near a landmark: document, landmark values; all others score like an empty one."""

    def __init__(self, kernel: Kernel, limit: int = 300_000):
        self.kernel, self.limit = kernel, limit
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1, len(kernel.landmarks)))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known, self.rows = {}, self.rows[:1]
            new = list(words)
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            k = self.kernel.values([INNER.sub("", w) for w in part])
            on = np.flatnonzero(k.max(axis=1) >= ACTIVE)
            index = np.zeros(len(part), np.int64)
            index[on] = len(self.rows) + np.arange(len(on))
            self.rows = np.vstack([self.rows, k[on]])
            self.known.update(zip(part, index.tolist(), strict=True))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document of each sentence, values, words of each document)."""
        sentences, doc = [], []
        n_words = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            for s in SENTENCE.split(t.lower()):
                if words := WORD.findall(s):
                    sentences.append(words)
                    doc.append(i)
                    n_words[i] += len(words)
        self._learn({w for s in sentences for w in s})
        look = self.known.__getitem__
        index = np.fromiter((look(w) for s in sentences for w in s), np.int64, sum(map(len, sentences)))
        owner = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
        on = np.flatnonzero(index)
        owner, index = owner[on], index[on]
        head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
        values = np.maximum.reduceat(self.rows[index], head) if len(owner) else np.zeros((0, self.rows.shape[1]))
        return np.array(doc, np.int64)[owner[head]], values, n_words


def choose_landmarks(toxic: list[str], clean: list[str], most: int = LANDMARKS) -> list[str]:
    """Strings of four to nine letters, greedily: each explains toxic documents that the ones before leave open."""
    letters = re.compile(r"[^\W\d_]+")

    def strings(text: str) -> set[str]:
        words = set(letters.findall(text.lower()))
        return {w[i : i + n] for w in words for n in range(4, 10) for i in range(len(w) - n + 1)}

    # Counts by bucket first: only strings of a bucket that is full enough are held, so rare ones cost no memory.
    need_docs = max(3, len(toxic) // 200)
    bucket = np.zeros(STRING_BUCKETS, np.int32)
    for t in toxic:
        bucket[np.unique(np.fromiter((hash(x) % STRING_BUCKETS for x in strings(t)), np.int64))] += 1
    full = (bucket >= need_docs).tobytes()
    frequent = lambda t: {x for x in strings(t) if full[hash(x) % STRING_BUCKETS]}
    seen = Counter(x for t in toxic for x in frequent(t))
    kept = {x for x, n in seen.items() if n >= need_docs}
    against = Counter(x for t in clean for x in strings(t) & kept)
    sets = [strings(t) & kept for t in toxic]
    ratio = len(toxic) / max(1, len(clean))
    value = {s: max(0.0, 1 - (against[s] + 0.5) * ratio / seen[s]) for s in kept}
    need = np.full(len(sets), 3.0)
    where: dict[str, list[int]] = {}
    for i, x in enumerate(sets):
        for s in x:
            if value[s] > 0.2:
                where.setdefault(s, []).append(i)
    chosen: list[str] = []
    while len(chosen) < most and where:
        gain, _, s = max((value[s] * need[i].sum(), len(s), s) for s, i in where.items())
        if gain < max(3.0, 0.002 * len(toxic)):
            break
        chosen.append(s)
        need[where[s]] = np.maximum(0.0, need[where[s]] - 1)
        where = {k: v for k, v in where.items() if k not in s and s not in k}
    return chosen


@dataclass
class Model:
    kernel: Kernel
    svm: np.ndarray
    final: np.ndarray

    def features(self, doc: np.ndarray, values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Largest margin, how many sentences are positive, their density, and the length, by document."""
        n = len(n_words)
        base = float(self.svm[-1])
        margin = apply(self.svm, values @ self.kernel.map) if len(values) else np.zeros(0)
        top = np.full(n, base)
        np.maximum.at(top, doc, margin)
        soft = np.bincount(doc, weights=np.clip(margin - base, 0, 2), minlength=n)
        size = np.log1p(n_words)
        return np.column_stack([top, np.log1p(soft), 100 * soft / (n_words + 50.0), size])

    def scores(self, doc: np.ndarray, values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return sigmoid(apply(self.final, self.features(doc, values, n_words)))


def part_of(text: Column, most: int) -> Column:
    """The text, or of a longer one every k-th sentence by hash, so that at most ``most`` characters are left."""
    k = F.ceil(F.length(text) / most)
    some = F.filter(F.split(text, SENTENCE.pattern), lambda s: F.pmod(F.xxhash64(s), k) == 0)
    return F.when(k > 1, F.substring(F.array_join(some, ". "), 1, most)).otherwise(text)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model | None:
    """From at most ``per_class`` labelled documents of each class and ``max_chars`` characters, half for either class, taken by a hash of the id.

    A document that does not fit into the room left is passed over, and one of over a LONGEST-th of the room takes part with some of its sentences.
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    longest = max(1, max_chars // 2 // LONGEST)
    known = docs.where("text is not null").select("doc_id", "text")
    sized = marked.join(known.select("doc_id", F.least(F.length("text"), F.lit(longest)).alias("size")), "doc_id")
    texts, y = [], []
    for value in (0, 1):
        rows = sized.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id", "size").limit(per_class).collect()
        together: dict[int, int] = {}
        for r in rows:
            together[r["doc_id"]] = together.get(r["doc_id"], 0) + r["size"]
        room, chosen = max_chars // 2, []
        for doc_id, size in together.items():
            if size <= room:
                room -= size
                chosen.append(doc_id)
        if not chosen:
            return None
        ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(chosen)], "doc_id long")
        picked = known.join(F.broadcast(ids), "doc_id").select(part_of(F.col("text"), longest).alias("text"))
        found = sorted(r["text"] for r in picked.toLocalIterator())  # max_chars / 2 characters at most, as their sizes have been added up
        texts += found
        y += [value] * len(found)
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    return fit_texts(texts, np.array(y), counts.get(1, 0) / max(1, counts.get(0, 0)))


def fit_texts(texts: list[str], y: np.ndarray, odds: float) -> Model | None:
    """``odds``: toxic documents to others in the corpus; the sample may hold them in other shares."""
    if len(set(y.tolist())) < 2:
        return None
    landmarks = choose_landmarks([t for t, k in zip(texts, y, strict=True) if k], [t for t, k in zip(texts, y, strict=True) if not k])
    if not landmarks:
        return None
    kernel = Kernel(landmarks)
    doc, values, n_words = Sentences(kernel).of(texts)
    x = values @ kernel.map
    toxic = y[doc] == 1
    witness = toxic.copy()
    svm = np.zeros(x.shape[1] + 1)
    for _ in range(4):
        use = witness | ~toxic
        label = np.where(toxic[use], 1.0, -1.0)
        weight = np.where(toxic[use], 0.5 / max(1, witness.sum()), 0.5 / max(1, (~toxic).sum())) * len(x)
        # a sentence without any word near a landmark is clean
        svm = fit_svm(np.vstack([x[use], np.zeros((1, x.shape[1]))]), np.append(label, -1.0), np.append(weight, 0.2 * len(x)))
        margin = apply(svm, x)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, doc, margin)
        witness = toxic & (margin >= np.minimum(best[doc], 0.0))
    model = Model(kernel, svm, np.zeros(5))
    features = model.features(doc, values, n_words)
    model.final = fit_logistic(features, y.astype(float), ridge=0.1)
    model.final[-1] += np.log(odds) - np.log(y.mean() / (1 - y.mean()))
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentences = Sentences(model.kernel) if model else None
        for batch in lean(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = np.zeros(len(texts))
            for a, b in blocks(texts, [len(t) for t in texts], BLOCK_CHARS) if model else ():
                out[a:b] = model.scores(*sentences.of(texts[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"]]).add("score", "double"))


def op10_subsequence_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = read_documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = fit(docs, labels.where(crc_of_id(F.col("doc_id"), 5) != 0))
    held = F.coalesce(crc_of_id(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
