"""Operator 6, fuzzy search for short license notices.

A notice with at most ``edits`` errors, cut into ``edits`` + 1 pieces, keeps one piece unchanged (the
pigeonhole principle). An automaton finds all pieces of all notices in one pass; around each hit the
regex library's bounded-error matching looks for the whole notice and gives its span and edits.
Base phrases are searched for exactly on word boundaries.

Defined results: null text is empty and has no labels (empty strings, score 0, null positions);
repeated rows and null ids give a result each.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import lean, read_documents

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
# Base phrases and labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Notices, labels and the errors allowed.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("subject to the terms of the mozilla public license", "mpl", 4),
    ("licensed under a creative commons attribution", "cc-by", 4),
    ("released into the public domain", "public-domain", 3),
    ("all rights reserved", "reserved", 2),
    ("spdx license identifier", "spdx", 2),
)


def split_pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 consecutive pieces of about equal length, with their offsets."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def _machine(notices: tuple[tuple[str, str, int], ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    at: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, _, edits) in enumerate(notices):
        for offset, piece in split_pieces(notice, edits):
            at.setdefault(piece, []).append((i, offset))
    for piece, where in at.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n)}){{e<={k}}}(?![^ ])") for n, _, k in notices]


def fuzzy_matches(text: str, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> list[tuple[int, int, str, int]]:
    """(start, end, label, edits) of the notices in normalised text; matches stand on whole words, and those of one notice do not overlap.

    A search gives the best match of its region, so the parts on both sides of it are searched too.
    """
    automaton, patterns = _machine(notices)
    near: dict[int, list[list[int]]] = {}
    for end, (size, where) in automaton.iter(text):
        for i, offset in where:
            notice, _, edits = notices[i]
            begin = end + 1 - size - offset
            a, b = _whole_words(text, max(0, begin - edits), min(len(text), begin + len(notice) + edits))
            spans = near.setdefault(i, [])
            if spans and a <= spans[-1][1]:
                spans[-1] = [min(a, spans[-1][0]), max(b, spans[-1][1])]
            else:
                spans.append([a, b])
    found = []
    for i, spans in near.items():
        most = len(notices[i][0]) + notices[i][2] + 2
        parts = [p for a, b in spans for p in _windows(text, a, b, most)]
        least = len(notices[i][0]) - notices[i][2]
        taken: set[tuple[int, int, int]] = set()
        while parts:
            a, b = parts.pop()
            if b - a >= least and (m := patterns[i].search(text, a, b)):
                start, end = m.start() + (text[m.start()] == " "), m.end() - (text[m.end() - 1] == " ")
                taken.add((start, end, sum(m.fuzzy_counts)))
                parts += [(a, start), (end, b)]
        found += [(a, b, notices[i][1], k) for a, b, k in _best_apart(taken)]
    return sorted(found)


def _windows(text: str, a: int, b: int, most: int) -> list[tuple[int, int]]:
    """A region in overlapping windows of bounded size, so that long runs of notices cost their length only.

    Every match of at most ``most`` characters lies whole in a window of four times that.
    """
    if b - a <= 4 * most:
        return [(a, b)]
    return [_whole_words(text, k, min(b, k + 4 * most)) for k in range(a, b - most, 3 * most)]


def _whole_words(text: str, a: int, b: int) -> tuple[int, int]:
    """A region widened to the blanks around it."""
    end = text.find(" ", b)
    return max(0, text.rfind(" ", 0, a + 1)), end if end >= 0 else len(text)


def _best_apart(matches: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Matches without overlaps: of a cluster, the one with fewest edits first, then the earliest."""
    kept: list[tuple[int, int, int]] = []
    cluster: list[tuple[int, int, int]] = []
    for m in [*sorted(matches), (1 << 60, 1 << 60, 0)]:
        if cluster and m[0] >= max(c[1] for c in cluster):
            best: list[tuple[int, int, int]] = []
            for c in sorted(cluster, key=lambda c: (c[2], c[0])):
                if all(c[0] >= o[1] or o[0] >= c[1] for o in best):
                    best.append(c)
            kept += best
            cluster = []
        cluster.append(m)
    return kept


def phrase_places(joined: str, starts: list[int]) -> tuple[list[int], set[str]]:
    """Word positions where a base phrase starts, and the labels; ``joined`` has single spaces and one at either end, ``starts`` its words' places."""
    places, labels = [], set()
    for phrase, label in BASE:
        at = joined.find(f" {phrase} ")
        while at >= 0:
            places.append(bisect_left(starts, at + 1))
            labels.add(label)
            at = joined.find(f" {phrase} ", at + 1)
    return places, labels


SPAN = T.ArrayType(T.StructType().add("label", "string").add("first_word", "long").add("last_word", "long").add("edits", "integer"))
_ARROW_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))


def license_scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                words = TOKEN.findall((text or "").translate(LOWER))
                joined = f" {' '.join(words)} " if words else ""
                starts = list(accumulate((len(w) + 1 for w in words[:-1]), initial=1)) if words else []
                places, base = phrase_places(joined, starts)
                fuzzy = fuzzy_matches(joined)
                labels = base | {m[2] for m in fuzzy}
                spans = [{"label": label, "first_word": bisect_right(starts, a) - 1, "last_word": bisect_right(starts, b - 1) - 1, "edits": k} for a, b, label, k in fuzzy]
                score = 1.0 if base else max((1 - k / (b - a) for a, b, _, k in fuzzy), default=0.0)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _ARROW_SPAN]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    schema = T.StructType([docs.schema["doc_id"]])
    for c in ("n_words", "n_base", "first_word", "last_word"):
        schema = schema.add(c, "long")
    schema = schema.add("base_labels", "string").add("labels", "string").add("score", "double").add("spans", SPAN)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_fuzzy_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels, fuzzy labels, score and spans for every document."""
    return license_scan(read_documents(spark, sf_dir, "doc_id", "text"))
