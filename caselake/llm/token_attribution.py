"""Operator 7, token counts by offset-mapped attribution.

A document is encoded once as a whole; the spans of its tokens are joined as intervals with its
sections (lines, each with its line end). A token that crosses a boundary goes to one section
by an explicit rule: ``first`` (where it begins), ``last`` (where it ends) or ``most`` (where most of
its bytes lie, the earlier on ties). Counts of a document add up to its tokens under every rule.

Defined results: null and empty texts have one empty section without tokens; repeated rows and null
ids give their sections each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import lean, read_documents
from .tokens import ByteBpe, default_path

RULES = ("first", "last", "most")


def attribute(lengths: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and of these the ones that cross a boundary. ``bounds``: where sections start, and the end."""
    end = np.cumsum(lengths.astype(np.int64))
    start = end - lengths
    n = len(bounds) - 1
    a = np.minimum(np.searchsorted(bounds, start, side="right") - 1, n - 1)
    b = np.minimum(np.searchsorted(bounds, end - 1, side="right") - 1, n - 1)
    to = {"first": a, "last": b, "most": a.copy()}[rule]
    crossing = a != b
    if rule == "most":
        for t in np.flatnonzero(crossing):
            parts = [min(end[t], bounds[s + 1]) - max(start[t], bounds[s]) for s in range(a[t], b[t] + 1)]
            to[t] = a[t] + int(np.argmax(parts))
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def line_bounds(data: bytes) -> np.ndarray:
    """Byte offsets where lines start, and the end; a line end belongs to its line."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    inner = ends[:-1] if len(ends) and ends[-1] == len(data) else ends
    return np.concatenate(([0], inner, [len(data)])).astype(np.int64)


def characters(data: bytes) -> np.ndarray:
    """By byte offset, how many characters begin before it."""
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(begins)))


def section_tokens(docs: DataFrame, ranks: str, pattern: str, rule: str = "first") -> DataFrame:
    """doc_id, section, start and length (in characters), n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe(ranks, pattern)
        for batch in lean(batches):
            rows, parts = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                data = text.encode("utf-8", "surrogatepass")
                bounds = line_bounds(data)
                counts, crossing = attribute(encoder.lengths(text), bounds, rule)
                chars = characters(data)[bounds]
                rows.append(len(counts))
                parts.append((np.arange(len(counts)), chars[:-1], np.diff(chars), counts, crossing))
            if not rows:
                continue
            columns = [np.concatenate([p[i] for p in parts]) for i in range(5)]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), rows)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names)

    schema = T.StructType([docs.schema["doc_id"]]).add("section", "integer")
    for c in ("start", "length", "n_tokens", "n_crossing"):
        schema = schema.add(c, "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_offset_mapped_tokens(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Tokens of every line of every document."""
    import public_tokenizers

    return section_tokens(read_documents(spark, sf_dir, "doc_id", "text"), ranks or default_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
