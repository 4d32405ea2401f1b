"""Sources and sinks."""

from __future__ import annotations

import json
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_cell, html_lines
from ..functions.vectorised import vectorised


# First bytes of image files.
IMAGES = (("png", b"\x89PNG\r\n\x1a\n"), ("jpg", b"\xff\xd8\xff"), ("tif", b"II*\x00"), ("tif", b"MM\x00*"), ("bmp", b"BM"))
IMAGE_NAMES = (".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp")


def _begins(content: Column, magic: bytes, at: int = 1) -> Column:
    return F.substring(content, at, len(magic)) == F.lit(bytearray(magic))


def _webp(content: Column) -> Column:
    return _begins(content, b"RIFF") & _begins(content, b"WEBP", 9)


def kind_of(content: Column, name: Column, content_type: Column | None = None) -> Column:
    """struct(kind, extension) of an upload by its first bytes, or null.

    A name decides only for text, and for a PDF whose header comes within the first kilobyte; a stated type of plain text comes last.
    """
    name, said = F.lower(F.coalesce(name, F.lit(""))), F.lit("") if content_type is None else F.coalesce(content_type, F.lit(""))
    of = lambda kind, ext: F.struct(F.lit(kind).alias("kind"), F.lit(ext).alias("extension"))
    out = F.when(name.endswith(".txt"), of("txt", "txt")).when(_begins(content, b"%PDF-"), of("pdf", "pdf"))
    for ext, magic in IMAGES[:2]:
        out = out.when(_begins(content, magic), of("image", ext))
    late = name.endswith(".pdf") & F.contains(F.substring(content, 1, 1024), F.lit(bytearray(b"%PDF-")))
    plain = F.trim(F.lower(F.substring_index(said, ";", 1))) == "text/plain"
    return out.when(_webp(content), of("image", "webp")).when(late, of("pdf", "pdf")).when(plain, of("txt", "txt"))


def readable_kind(content: Column, name: Column) -> Column:
    """pdf or image for recognition, by the first bytes or the name's ending; null for anything else."""
    name = F.lower(F.coalesce(name, F.lit("")))
    image = _webp(content)
    for _, magic in IMAGES:
        image = image | _begins(content, magic)
    for ending in IMAGE_NAMES:
        image = image | name.endswith(ending)
    return F.when(_begins(content, b"%PDF-") | name.endswith(".pdf"), "pdf").when(image, "image")


def decode_text(content: Column) -> Column:
    """UTF-8 with or without a byte order mark, line ends as \\n; null if invalid or if it holds a NUL."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
    text = F.regexp_replace(F.regexp_replace(text, "^\\uFEFF", ""), "\\r\\n?", "\n")
    return F.when(~F.contains(text, F.lit("\0")), text)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, sha256, size, text): every file below a path; the text of text files only."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = kind_of(F.col("content"), F.col("path"))["kind"]
    return df.select("path", kind.alias("kind"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.when(kind == "txt", decode_text(F.col("content"))).alias("text"))


def pages_of(blocks: DataFrame, doc: str, page: str) -> DataFrame:
    """Recognised blocks (order, html, error, skipped) as one text a page, in reading order, without blocks that failed or were skipped."""
    good = blocks.where(~F.coalesce("error", F.lit(False)) & ~F.coalesce("skipped", F.lit(False)))
    lines = good.withColumn("lines", F.array_join(html_lines(F.col("html")), "\n")).where("lines != ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("order", "lines"))), lambda x: x["lines"])
    return lines.groupBy(doc, page).agg(F.array_join(ordered, "\n").alias("text"))


def vocabulary(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, id, label_ar, label_en, at) of a YAML or JSON vocabulary; ids must be plain and unique within a kind, or it is rejected."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    data = json.loads(text) if path.endswith(".json") else _yaml(text)
    rows = []
    for kind in kinds:
        ids = [x["id"] for x in data.get(kind, [])]
        if bad := [i for i in ids if not re.fullmatch("[a-z][a-z0-9_]{0,63}", str(i))] or [i for i in set(ids) if ids.count(i) > 1]:
            raise ValueError(f"{kind}: ids that are no ids, or stand twice: {bad}")
        rows += [(kind, x["id"], x.get("label_ar", ""), x.get("label_en", ""), n) for n, x in enumerate(data.get(kind, []))]
    return spark.createDataFrame(rows, "kind string, id string, label_ar string, label_en string, at int")


def _yaml(text: str) -> dict:
    import yaml

    return yaml.safe_load(text)


#: Layers of compression that an answer may have, and bytes that it may unfold to.
MOST_LAYERS, MOST_BYTES = 2, 16 << 20


def unfolded(body: bytes) -> bytes | None:
    """A register's answer without its layers of gzip or deflate; null if it is damaged or unfolds to too much."""
    for _ in range(MOST_LAYERS):
        kind = 31 if body[:2] == b"\x1f\x8b" else 15 if body[:1] == b"\x78" and len(body) > 1 and not int.from_bytes(body[:2], "big") % 31 else 0
        if not kind:
            break
        inflate = zlib.decompressobj(kind)
        try:
            body = inflate.decompress(body, MOST_BYTES + 1)
        except zlib.error:
            return None
        if len(body) > MOST_BYTES or not inflate.eof:
            return None
    return body


@vectorised("string")
def answer_text(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    """JSON text of register answers: unfolded, as Unicode if it is that, else in the stated character set; an answer that is a JSON string of JSON is opened."""

    def one(body: bytes | None, charset: str | None) -> str | None:
        data = None if body is None else unfolded(bytes(body))
        if data is None:
            return None
        for name in ("utf-8-sig", charset or "utf-8"):
            try:
                text = data.decode(name)
                value = json.loads(text)
                return json.dumps(json.loads(value), ensure_ascii=False) if isinstance(value, str) else text
            except (UnicodeDecodeError, LookupError, ValueError):
                continue
        return None

    return pd.Series([one(b, c) for b, c in zip(bodies, charsets, strict=True)])


def ocr_lines(words: DataFrame) -> DataFrame:
    """Recognised words (page, block, par, line, word, left, top, width, height, conf, text) to lines with hull and mean confidence."""
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    return words.where("trim(text) != ''").groupBy("page", "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(right).alias("x1"), F.max(bottom).alias("y1"), F.bround(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), 2).alias("conf"),
    )


def page_fractions(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box as fractions of its page, held within 0 and 1, four decimals; null if it is empty."""
    part = lambda v, size: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size)), 4)
    return F.when((x1 > x0) & (y1 > y0) & (width > 0) & (height > 0), F.array(part(x0, width), part(y0, height), part(x1, width), part(y1, height)))


def write_csv(df: DataFrame, path: str, headers: list[str] | None = None) -> None:
    """CSV files with a byte order mark, the stated headers, quoted formulas and CRLF line ends."""
    names = headers or df.columns
    cells = [(csv_cell(F.col(c.name)) if c.dataType.simpleString() == "string" else F.col(c.name)).alias(n) for c, n in zip(df.schema, ["\ufeff" + names[0], *names[1:]], strict=True)]
    df.select(*cells).write.option("header", True).option("lineSep", "\r\n").option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """Newline-delimited JSON, split by a column if one is named."""
    (df.write.partitionBy(by) if by else df.write).json(path)


def write_exports(df: DataFrame, path: str, simple: list[str], by: str) -> None:
    """Three exports of records: full (nested), simple (some columns), and simple ones split by a column, such as gender."""
    df.write.json(f"{path}/full")
    df.select(*simple).write.json(f"{path}/simple")
    write_json(df.select(*dict.fromkeys([*simple, by])), f"{path}/by_{by}", by)
