"""Operator 1, quality rules by distribution divergence.

Two histograms of a document, of character classes and of its common words, are compared with
those of each language by Jensen-Shannon distance. The language references are the summed histograms of
all documents of the language; common words are listed for four languages and counted over all documents for any other. A document is judged by the language nearest to it (the sum of both
distances), so that a wrong language tag does not count against it, and only where it is long enough:
shorter ones pass. Base rules (length, repeated words) come first.

Defined results: null text has no words and fails the base rules; without any reference (an empty
table or no language given) the method passes everything; repeated rows and null ids are judged each.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, lean, read_documents

# Common words by language.
COMMON = {
    "en": "the of and to in a is that it for was on are with as be by this at from or an have not which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero".split(),
}
#: Common words that another language gets.
COMMON_SIZE = 25
SYMBOLS = frozenset("#*$%&|<>")
LETTERS = re.compile(r"[^\W\d_]+")
CLASSES = ("lower", "upper", "other letter", "digit", "blank", "line end", "stop", "symbol", "other")

#: Guards and limits: distances count from so many characters or words on.
MIN_CHARS, MIN_WORDS = 100, 30
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.33, 0.6


def _class_of(code: int) -> int:
    c = chr(code)
    if "a" <= c <= "z":
        return 0
    if "A" <= c <= "Z":
        return 1
    if c.isalpha():
        return 2
    if c.isdigit():
        return 3
    if c == "\n":
        return 5
    if c.isspace():
        return 4
    if c in ".,;:!?'\"()-":
        return 6
    return 7 if c in SYMBOLS else 8


_TABLE = None


def char_classes(text: str) -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([_class_of(i) for i in range(sys.maxunicode + 1)], np.uint8)  # once a worker
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_TABLE[codes], minlength=len(CLASSES))


def slots_of(words: dict[str, list[str]]) -> dict[str, int]:
    """The bins of all languages' common words."""
    return {w: i for i, w in enumerate(sorted({w for x in words.values() for w in x}))}


def common_words(text: str, slots: dict[str, int]) -> np.ndarray:
    """Counts of the common words, and of all other words at the end."""
    counts = np.zeros(len(slots) + 1, np.int64)
    found = Counter(LETTERS.findall(text.lower()))
    counts[-1] = sum(found.values())
    for w in found.keys() & slots.keys():
        counts[slots[w]] = found[w]
        counts[-1] -= found[w]
    return counts


def counted_common(docs: DataFrame) -> dict[str, list[str]]:
    """The most frequent words of each language that COMMON lacks, over all its documents; ties to the lesser word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            sums: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            rows = [(lang, w, n) for lang, c in sums.items() for w, n in c.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    others = docs.where(F.col("lang").isNotNull() & ~F.col("lang").isin(*COMMON) & F.col("text").isNotNull()).select("text", "lang")
    counts = others.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    out: dict[str, list[str]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= COMMON_SIZE).select("lang", "word").collect():  # COMMON_SIZE rows a language
        out.setdefault(r["lang"], []).append(r["word"])
    return out


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    entropy = lambda x: -(x[x > 0] * np.log2(x[x > 0])).sum()
    return float(np.sqrt(max(0.0, entropy(m) - (entropy(p) + entropy(q)) / 2)))


def references(docs: DataFrame) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], dict[str, int]]:
    """Summed histograms of all documents of each language, and the bins of common words; the driver gets a few hundred sums a language."""
    named = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    langs = {r["lang"] for r in named.select("lang").distinct().collect()}
    slots = slots_of(COMMON | (counted_common(docs) if langs - COMMON.keys() else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in lean(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = sums.setdefault(lang, (np.zeros(len(CLASSES), np.int64), np.zeros(len(slots) + 1, np.int64)))
                a += char_classes(text)
                b += common_words(text, slots)
        rows = [(lang, kind, i, int(n)) for lang, both in sums.items() for kind, x in enumerate(both) for i, n in enumerate(x) if n]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["lang", "kind", "bin", "n"])

    sums = named.mapInArrow(run, "lang string, kind int, bin int, n long")
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for r in sums.groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["lang"], (np.zeros(len(CLASSES)), np.zeros(len(slots) + 1)))[r["kind"]][r["bin"]] = r["n"]
    return out, slots


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeated = 0
    if len(words) > 5:
        grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        counts = Counter(grams)
        if len(counts) < len(grams):
            until = 0  # words before this one are counted
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    repeated += i + 5 - max(i, until)
                    until = i + 5
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated


def judge(text: str, n_words: int, refs: dict, slots: dict[str, int]) -> tuple[str | None, float, float, bool]:
    """Nearest language, both distances to it, and whether the document passes."""
    chars, words = char_classes(text), common_words(text, slots)
    best = min(((distance(chars, c), distance(words, w), lang) for lang, (c, w) in refs.items()), key=lambda x: (x[0] + x[1], x[2]), default=None)
    if best is None:
        return None, 0.0, 0.0, True
    a, b, lang = best
    return lang, a, b, not (chars.sum() >= MIN_CHARS and a > MAX_CHAR_DISTANCE or n_words >= MIN_WORDS and b > MAX_WORD_DISTANCE)


def quality_rules(docs: DataFrame) -> DataFrame:
    refs, slots = references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                counts = base_counts(text)
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                lang, a, b, passed = judge(text, counts[0], refs, slots)
                rows.append((*counts, failed, not failed and passed, lang, a, b))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    schema = T.StructType([docs.schema["doc_id"]])
    for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("nearest_lang", "string").add("char_distance", "double").add("word_distance", "double")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base_failed, kept and both distances for every document."""
    return quality_rules(read_documents(spark, sf_dir, "doc_id", "text", "lang"))
