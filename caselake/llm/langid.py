"""Operator 5, language identification of mixed text.

Each word gets a score per language, the sum of its letters' log-probabilities under hashed character
trigrams (word ends included). Script ranges narrow the candidates first: a language that was never
learned with a word's script is out, unless that holds for all. Viterbi decoding over the words, with a
penalty for each switch, labels spans of mixed text; the language with most letters is the document's.

The model is fitted on a bounded sample (``per_lang`` documents of each language); every document is scored as a whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; with nothing to learn
from, every text is ``und``; rows without language train nothing but are scored; repeated rows and null
ids are scored each (a null id is not held out and trains nothing).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, blocks, crc_of_id, lean, mix, read_documents

BITS = 16
PER_LANG, SWITCH = 4000, 12.0
BLOCK_CHARS = 400_000
#: A text of at least so many letters fits no language if they are, on average, so much less likely than those of its training texts (nats a letter).
MIN_LETTERS, MAX_LOSS = 100, 3.0
# First code points of the ranges told apart as scripts, and their numbers.
SCRIPTS = (
    (0, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 7), (0x900, 8), (0x980, 9), (0xE00, 10), (0xE80, 11),
    (0x10A0, 12), (0x1100, 13), (0x1200, 14), (0x1E00, 1), (0x1F00, 2), (0x2C00, 15), (0x3040, 16), (0x30A0, 16), (0x3130, 13), (0x3400, 17), (0xA000, 18), (0xAC00, 13), (0xD7B0, 18), (0xF900, 17), (0xFB50, 6), (0xFE00, 18), (0x20000, 17), (0x32000, 18),
)
N_SCRIPTS = 19
_LETTER = _SCRIPT = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _LETTER, _SCRIPT
    if _LETTER is None:
        _LETTER = np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])
        starts = np.array([s for s, _ in SCRIPTS])
        _SCRIPT = np.array([n for _, n in SCRIPTS], np.uint8)[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]
    return _LETTER, _SCRIPT


@dataclass
class Letters:
    """The letters of some texts, one after the other, and the words they form."""

    at: np.ndarray  # place in the joined text
    gram: np.ndarray  # hashed trigram
    script: np.ndarray
    word: np.ndarray  # first letter of each word
    doc: np.ndarray  # document of each word
    start: np.ndarray  # where each text starts in the joined one


def letters(texts: list[str]) -> Letters:
    letter, script = _tables()
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in low], np.int64)
    start = np.cumsum(sizes) - sizes
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[code]
    at = np.flatnonzero(is_letter)
    c = np.where(is_letter, code, 0).astype(U)
    before = np.concatenate(([U(0)], c[:-1]))[at]
    after = np.concatenate((c[1:], [U(0)]))[at]
    gram = (mix((before << U(42)) ^ (c[at] << U(21)) ^ after) >> U(64 - BITS)).astype(np.int64)
    new = before == 0
    word = np.flatnonzero(new)
    doc = np.searchsorted(start, at[word], side="right") - 1
    return Letters(at, gram, script[code[at]], word, doc, start)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (2^BITS, languages)
    out: np.ndarray  # (scripts, languages): penalty per letter of a script that the language lacks
    usual: np.ndarray  # mean log-probability of a letter of each language's own sample

    def word_scores(self, x: Letters) -> np.ndarray:
        if not len(x.word):
            return np.zeros((0, len(self.langs)))
        return np.stack([np.add.reduceat(self.logp[x.gram, k] + self.out[x.script, k], x.word) for k in range(len(self.langs))], axis=1)


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Counts of hashed trigrams and scripts by language over a bounded sample of the rows with text, language and id."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return None
    langs = sorted(r["lang"] for r in sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_lang / r["count"]))])
    u = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000.0
    sample = rows.where(F.col("lang").isin(langs)).where(u < F.element_at(share, F.col("lang"))).select("lang", "text").repartition(8)
    place = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), 1 << BITS), np.int64)
        scripts = np.zeros((len(langs), N_SCRIPTS), np.int64)
        for batch in lean(batches):
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts, [len(t) for t in texts], BLOCK_CHARS):
                x = letters(texts[a:b])
                lang = np.repeat(np.array([place[k] for k in names[a:b]], np.int64)[x.doc], np.diff(np.append(x.word, len(x.at))))
                np.add.at(grams, (lang, x.gram), 1)
                np.add.at(scripts, (lang, x.script), 1)
        for i in range(len(langs)):
            if grams[i].any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([grams[i].astype("<u4").tobytes()]), pa.array([scripts[i].astype("<u4").tobytes()])], names=["i", "grams", "scripts"])

    grams = np.zeros((len(langs), 1 << BITS))
    scripts = np.zeros((len(langs), N_SCRIPTS))
    for r in sample.mapInArrow(run, "i long, grams binary, scripts binary").toLocalIterator():  # 8 partitions by languages
        grams[r["i"]] += np.frombuffer(r["grams"], "<u4")
        scripts[r["i"]] += np.frombuffer(r["scripts"], "<u4")
    if not grams.any():
        return None
    logp = np.log((grams + 0.5) / (grams.sum(axis=1, keepdims=True) + 0.5 * (1 << BITS))).T
    usual = (grams * logp.T).sum(axis=1) / np.maximum(1, grams.sum(axis=1))
    known = (scripts > 0.01 * np.maximum(1, scripts.sum(axis=1, keepdims=True))).T
    out = np.where(known | ~known.any(axis=1, keepdims=True), 0.0, -30.0)
    return Model(langs, np.ascontiguousarray(logp, np.float32), out.astype(np.float32), usual)


def viterbi(score: np.ndarray, doc: np.ndarray, n_docs: int, switch: float) -> np.ndarray:
    """Best language of each word; ``score`` is (words, languages), words are grouped by document. All documents advance together."""
    n = len(score)
    count = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-count, kind="stable")
    first = (np.cumsum(count) - count)[order]
    active = np.searchsorted(-count[order], -np.arange(count.max() if n else 0), side="left")
    stay = np.zeros(score.shape, bool)
    jump = np.zeros(n, np.int16)
    state = np.zeros((n_docs, score.shape[1]))
    for t, k in enumerate(active.tolist()):
        at = first[:k] + t
        if t:
            best = state[:k].max(axis=1)
            jump[at] = state[:k].argmax(axis=1)
            keep = state[:k] >= (best - switch)[:, None]
            stay[at] = keep
            state[:k] = np.where(keep, state[:k], (best - switch)[:, None])
        state[:k] += score[at]
    path = np.zeros(n, np.int64)
    now = state.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        path[at] = now[:k]
        if t:
            now[:k] = np.where(stay[at, now[:k]], now[:k], jump[at])
    return path


def verdicts(texts: list[str | None], model: Model | None, switch: float = SWITCH) -> tuple[list[str], list[float], list[list[dict]], list[float]]:
    """Language, its share of the letters, the spans of each text, and how much less likely its letters are than usual (0 for short texts)."""
    texts = [t or "" for t in texts]
    pred, score, spans, loss = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts], [0.0] * len(texts)
    for a, b in blocks(texts, [len(t) for t in texts], BLOCK_CHARS) if model else ():
        x = letters(texts[a:b])
        if not len(x.word):
            continue
        scores = model.word_scores(x)
        path = viterbi(scores, x.doc, b - a, switch)
        size = np.diff(np.append(x.word, len(x.at)))
        behind = np.bincount(x.doc, weights=model.usual[path] * size - scores[np.arange(len(path)), path], minlength=b - a)
        votes = np.zeros((b - a, len(model.langs)), np.int64)
        np.add.at(votes, (x.doc, path), size)
        for i in np.flatnonzero(votes.any(axis=1)):
            k = int(votes[i].argmax())
            pred[a + i], score[a + i] = model.langs[k], float(votes[i, k] / votes[i].sum())
            if votes[i].sum() >= MIN_LETTERS:
                loss[a + i] = float(behind[i] / votes[i].sum())
        new = np.ones(len(path), bool)
        new[1:] = (path[1:] != path[:-1]) | (x.doc[1:] != x.doc[:-1])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(path)) - 1
        begin = x.at[x.word[head]] - x.start[x.doc[head]]
        end = x.at[np.append(x.word[1:], len(x.at))[last] - 1] + 1 - x.start[x.doc[head]]
        for i, s, e, k in zip(x.doc[head].tolist(), begin.tolist(), end.tolist(), path[head].tolist(), strict=True):
            spans[a + i].append({"start": s, "end": e, "lang": model.langs[k]})
    return pred, score, spans, loss


def identify(docs: DataFrame, model: Model | None, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in spans of lang_pred) and spans (start, end, lang) in code points of the lower-cased text."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            pred, score, spans, _ = verdicts(batch.column(1).to_pylist(), model, switch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, span)], names=schema.names)

    parts = T.StructType().add("start", "long").add("end", "long").add("lang", "string")
    schema = T.StructType([docs.schema["doc_id"]]).add("lang_pred", "string").add("score", "double").add("spans", T.ArrayType(parts))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_clear(docs: DataFrame, model: Model | None, least: float, most_loss: float = MAX_LOSS) -> DataFrame:
    """Rows of ``docs`` whose text has a language with at least ``least`` of its letters, and letters that fit their languages.

    Each row is judged by its own text, whatever its id. Texts of languages that were never learned, and noise, fit none: their
    letters are less likely than usual by more than ``most_loss``.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            pred, score, _, loss = verdicts(batch.column(at).to_pylist(), model)
            yield batch.filter(pa.array([k != "und" and s >= least and x <= most_loss for k, s, x in zip(pred, score, loss, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(crc_of_id(F.col("doc_id"), 4) != 2)


def op5_viterbi_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every document."""
    docs = read_documents(spark, sf_dir, "doc_id", "text", "lang")
    model = fit(training_rows(docs))
    return identify(docs, model).select("doc_id", F.coalesce(crc_of_id(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")
