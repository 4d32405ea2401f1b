"""Page layouts and display rows: layouts held to their shape, lines placed in blocks, label and value lines, and register answers as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import masking as K
from ..functions import text as X
from ..session import small
from . import variants as V
from .wordings import folded

MOST_BLOCKS, MOST_LINES, MOST_CHARS, MOST_LABEL = 800, 4000, 20_000, 40
PAGE = "struct<blocks:array<struct<label:string,bbox:array<double>,lines:array<string>>>>"


def clean_page(raw: Column) -> Column:
    """A page's layout (JSON) with boxes held within 0 and 1 and lines cut; null if any part of it is malformed or too large.

    A page is kept or dropped whole, as a layout that lacks a block no longer accounts for every line.
    """
    blocks = F.from_json(raw, PAGE)["blocks"]
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    def good(b: Column) -> Column:
        box = F.transform(b["bbox"], clamp)
        fine = (F.size(b["bbox"]) == 4) & F.forall(b["bbox"], lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & (box[2] > box[0]) & (box[3] > box[1])
        return F.coalesce(b["label"].isNotNull() & (F.length(b["label"]) <= MOST_LABEL) & fine & b["lines"].isNotNull() & F.forall(b["lines"], lambda x: x.isNotNull()), F.lit(False))

    lines = F.aggregate(blocks, F.lit(0), lambda n, b: n + F.coalesce(F.size(b["lines"]), F.lit(0)))
    sound = F.coalesce((F.size(blocks) <= MOST_BLOCKS) & F.forall(blocks, good) & (lines <= MOST_LINES), F.lit(False))
    cleaned = F.transform(
        blocks, lambda b: F.struct(b["label"].alias("label"), F.transform(b["bbox"], clamp).alias("bbox"), F.transform(b["lines"], lambda x: F.left(x, F.lit(MOST_CHARS))).alias("lines"))
    )
    return F.when(sound, F.struct(cleaned.alias("blocks")))


def places_of_lines(blocks: DataFrame, lines: DataFrame, doc: str) -> DataFrame:
    """(doc, at, block, line) of a layout that each line of a corrected text comes from; ``blocks`` (doc, block, line, text), ``lines`` (doc, at, text).

    A text that stands as often in both, white space aside, ties its occurrences together in order. Of these ties those stay that
    cross none: one that leaps over both ties after it goes, then each that falls behind an earlier one. A line between two ties takes
    the place at the same share of the way between them, or the earlier tie's where nothing lies between; before the first tie the layout's start stands for one, after the last
    its end. A document without a layout has null places.
    """
    folded = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    by_doc, by_text = Window.partitionBy(doc), Window.partitionBy(doc, "t")
    old = blocks.select(doc, "block", "line", folded("text").alias("t")).withColumn("o", F.row_number().over(by_doc.orderBy("block", "line")) - 1)
    new = lines.select(doc, "at", folded("text").alias("t")).withColumn("n", F.row_number().over(by_doc.orderBy("at")) - 1)
    numbered = lambda df, place: df.withColumns({"k": F.row_number().over(by_text.orderBy(place)), "times": F.count("*").over(by_text)})
    ties = numbered(new, "n").join(numbered(old, "o").select(doc, "t", "k", "times", "o"), [doc, "t", "k", "times"]).select(doc, "n", "o")
    in_order = by_doc.orderBy("n")
    leaps = F.coalesce(F.col("o") > F.greatest(F.lead("o", 1).over(in_order), F.lead("o", 2).over(in_order)), F.lit(False)) & F.lead("o", 2).over(in_order).isNotNull()
    kept = ties.withColumn("leaps", leaps).where("not leaps").withColumn("best", F.max("o").over(in_order.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce(F.col("o") > F.col("best"), F.lit(True)))
    sizes = old.groupBy(doc).agg(F.count("*").alias("size"))
    placed = new.join(kept.select(doc, "n", "o"), [doc, "n"], "left").join(sizes, doc, "left").withColumn("last", F.max("n").over(by_doc) + 1)
    known = lambda c: F.when(F.col("o").isNotNull(), F.col(c))
    back, ahead = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(0, Window.unboundedFollowing)
    ends = {
        "n0": F.coalesce(F.last(known("n"), True).over(back), F.lit(-1)),
        "o0": F.coalesce(F.last(known("o"), True).over(back), F.lit(-1)),
        "n1": F.coalesce(F.first(known("n"), True).over(ahead), F.col("last")),
        "o1": F.coalesce(F.first(known("o"), True).over(ahead), F.col("size")),
    }
    gap, way = F.col("o1") - F.col("o0") - 1, F.col("n") - F.col("n0") - 1
    inside = F.col("o0") + 1 + F.floor(way * gap / (F.col("n1") - F.col("n0") - 1)).cast("int")
    found = placed.withColumns(ends).withColumn("to", F.when(F.col("o").isNotNull(), F.col("o")).when(gap > 0, inside).when(F.col("o0") >= 0, F.col("o0")).otherwise(F.col("o1")))
    return found.select(doc, "at", F.col("to").alias("o")).join(old.select(doc, "o", "block", "line"), [doc, "o"], "left").select(doc, "at", "block", "line")


def label_values(lines: DataFrame, doc: str, order: str, text: str, labels: DataFrame) -> DataFrame:
    """Lines as (label, value): a line ``label: value``, or a line that is exactly a known label with the line under it.

    A label takes the next line only if that is no label and holds neither a bar nor a colon; the taken line is no line of its own.
    """
    known = lines.join(small(labels.select(F.col("label").alias(text), F.lit(True).alias("is_label")).distinct()), text, "left").withColumn("is_label", F.coalesce("is_label", F.lit(False)))
    w = Window.partitionBy(doc).orderBy(order)
    plain = ~F.col(text).rlike("[|:]")
    nxt = known.withColumn("__next", F.lead(F.when(plain & ~F.col("is_label"), F.col(text))).over(w)).withColumn("__takes", F.col("is_label") & plain & F.col("__next").isNotNull())
    taken = F.coalesce(F.lag("__takes").over(w), F.lit(False))
    split = F.split(F.col(text), r"\s*:\s*", 2)
    pair = F.when(F.col("__takes"), F.struct(F.col(text).alias("label"), F.col("__next").alias("value"))).when(
        F.col(text).rlike("^[^:|]{1,60}:"), F.struct(split[0].alias("label"), F.trim(split[1]).alias("value"))
    )
    return nxt.withColumn("__taken", taken).where("not __taken").select(doc, order, text, pair.alias("pair")).select(doc, order, text, "pair.label", "pair.value")


#: Words of a label, characters of a label and value line, words and characters of a heading at most.
LABEL_WORDS, LABEL_LINE, HEADING_WORDS, HEADING_CHARS = 5, 60, 6, 48
_DIGIT = "[0-9٠-٩۰-۹]"
#: A label of up to 32 signs, a colon and a value; a label and the date or number that ends the line; a date or number alone; what no heading ends with.
_FIELD = r"^([^:：]{1,32}?)\s*([:：])\s*(.*\S)$"
_NUMBER = rf"{_DIGIT}(?:[0-9٠-٩۰-۹/\-.\s]*{_DIGIT})?\s*(?:هـ|ه|م)?"
_TAIL = rf"^([^0-9٠-٩۰-۹|:：]*[^0-9٠-٩۰-۹|:：\s])\s+({_NUMBER})$"
#: The last signs of every line that ends with a number, and how many they are at most.
_NUMBER_ENDS, _END = rf"{_DIGIT}\s*(?:هـ|ه|م)?$", 4
_HEADING_ENDS = r"[.،:؛]$"


def line_shapes(lines: DataFrame, doc: str, order: str, text: str, labels: list[str], sections: list[str] = (), letter: str = r"\p{L}") -> DataFrame:
    """(doc, order, text, shape, cells) of the lines of documents: rows with their cells, headings and body; blank lines are left out.

    A row is a line cut by bars, a field with a declared label, a line that opens with one, or a declared label with the line under it. In company
    of others, so are a field with any label next to another field, a label with a date or number next to a row (and the next one next to that, as far as they
    go), and a label with a date or number on the line under it, next to a row. Everything looks at neighbours through windows of a document; ``letter``
    is what a label must hold.
    """
    declared, held = [sorted({folded(x).lower() for x in names}) for names in (labels, sections)]
    w = Window.partitionBy(doc).orderBy(order)
    s = F.col("__s")
    among = lambda c, names: X.fold(c).isin(names) if names else F.lit(False)
    is_label = lambda c: among(c, declared) & ~among(c, held)
    words = lambda c: F.size(F.split(c, " "))  # noqa: E731  # blanks are single by then

    def field(c: Column) -> Column:
        part = lambda k: F.regexp_extract(c, _FIELD, k)
        fine = (part(2) != "") & part(1).rlike(letter) & ~part(1).rlike(_DIGIT + "$") & ~part(3).rlike(_FIELD)
        return F.when(fine, F.struct(part(1).alias("k"), part(2).alias("c"), part(3).alias("v")))

    # a declared label takes the line under it
    base = lines.select(doc, order, F.trim(F.regexp_replace(text, r"(?U)\s+", " ")).alias("__s")).where("__s != ''")
    base = base.withColumns({"__label": is_label(s), "__field": field(s), "__bar": F.contains(s, F.lit("|"))})
    plain = ~F.col("__bar") & F.col("__field").isNull()
    takes = F.coalesce(F.col("__label") & plain & F.lead(plain & ~F.col("__label")).over(w), F.lit(False))
    base = base.withColumns({"__takes": takes, "__under": F.lead("__s").over(w)})
    base = base.withColumn("__taken", F.coalesce(F.lag("__takes").over(w), F.lit(False))).where("not __taken")
    # what is a row by itself
    bars = F.filter(F.transform(F.split(s, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    parts = F.split(s, " ")
    heads = F.filter(F.sequence(F.lit(1), F.least(F.lit(LABEL_WORDS), words(s) - 1)), lambda n: is_label(F.array_join(F.slice(parts, 1, n), " ")))
    opens = F.when((F.length(s) <= LABEL_LINE) & (words(s) > 1) & ~among(s, held), F.array_max(heads))
    f = F.col("__field")
    of_field = F.array(F.concat(f["k"], f["c"]), f["v"])
    cells = (
        F.when(F.col("__takes"), F.array("__s", "__under"))
        .when(F.col("__bar"), F.when(F.size(bars) >= 2, bars))
        .when(f.isNotNull() & is_label(f["k"]), of_field)
        .when(opens.isNotNull(), F.array(F.array_join(F.slice(parts, 1, opens), " "), F.array_join(F.slice(parts, opens + 1, F.size(parts)), " ")))
    )
    near = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False)) | F.coalesce(F.lead(c).over(w), F.lit(False))
    company = near(f.isNotNull() & ~F.col("__takes"))
    rows = base.withColumn("cells", cells).withColumn("cells", F.coalesce("cells", F.when(f.isNotNull() & company, of_field)))
    # labels with a number after them, from row to row: an unbroken stretch of such lines and rows that holds a row
    # the pattern reads a line from its start, sign by sign, so it is asked only where the end fits
    name = F.when(F.col("cells").isNull() & F.right(s, F.lit(_END)).rlike(_NUMBER_ENDS), F.regexp_extract(s, _TAIL, 1)).otherwise("")
    tail = F.col("cells").isNull() & name.rlike(letter) & (words(name) <= LABEL_WORDS) & ~among(name, held)
    rows = rows.withColumns({"__tail": tail, "__row": F.col("cells").isNotNull()})
    rows = rows.withColumn("__stretch", F.sum((~(F.col("__tail") | F.col("__row"))).cast("int")).over(w))
    holds = F.max(F.col("__row")).over(Window.partitionBy(doc, "__stretch"))
    rows = rows.withColumn("cells", F.when(F.col("__tail") & holds, F.array(name, F.regexp_extract(s, _TAIL, 2))).otherwise(F.col("cells")))
    # a label over a number, next to a row
    alone = F.col("cells").isNull()
    caption = alone & s.rlike(letter) & ~s.rlike(_DIGIT) & (words(s) <= LABEL_WORDS) & ~among(s, held) & ~F.col("__bar")
    number = alone & s.rlike(f"^{_NUMBER}$")
    rows = rows.withColumns({"__caption": caption, "__number": number, "__row": ~alone})
    beside = F.coalesce(F.lag("__row").over(w), F.lit(False)) | F.coalesce(F.lead("__row", 2).over(w), F.lit(False))
    rows = rows.withColumns({"__over": F.coalesce(F.col("__caption") & F.lead("__number").over(w) & beside, F.lit(False)), "__under": F.lead("__s").over(w)})
    rows = rows.withColumn("__taken", F.coalesce(F.lag("__over").over(w), F.lit(False))).where("not __taken").withColumn("cells", F.when(F.col("__over"), F.array("__s", "__under")).otherwise(F.col("cells")))
    letters, digits = F.regexp_count(s, F.lit(r"\p{L}")), F.regexp_count(s, F.lit(_DIGIT))
    heading = (words(s) <= HEADING_WORDS) & (F.length(s) <= HEADING_CHARS) & s.rlike(letter) & ~((digits >= letters) & (digits > 0)) & ~F.coalesce(F.col("__tail"), F.lit(False)) & ~s.rlike(_HEADING_ENDS)
    shape = F.when(F.col("cells").isNotNull(), "row").when(heading, "heading").otherwise("body")
    return rows.select(doc, order, F.col("__s").alias(text), shape.alias("shape"), "cells")


MOST_COLUMNS = 12
#: How true and false read (fixed values).
YES, NO = "نعم", "لا"


def answer_rows(answers: DataFrame, doc: str, answer: str) -> DataFrame:
    """Register answers (JSON) as rows (doc, at, record, path, key, parent, value); ``record`` names the list item that a value belongs to, ``at`` orders them.

    Empty values are left out, damaged JSON has none. Members of an object come in the order of their names.
    """
    found = V.nodes(answers.select(doc, F.try_parse_json(answer).alias("__v")), doc, "__v", above=False)
    text = F.when(F.col("kind") == "boolean", F.when(F.try_variant_get("value", "$", "boolean"), YES).otherwise(NO)).otherwise(V.limited(V.scalar(F.col("value"))))
    return found.select(doc, "at", "record", "path", "key", "parent", text.alias("value")).where("value != ''")


def display_rows(rows: DataFrame, labels: DataFrame, personal: list[str] = (), redact: list[str] = ()) -> DataFrame:
    """Rows of ``answer_rows`` as they may be shown: with the label of their path, personal values masked, and long numbers in prose hidden.

    ``labels`` (path, label); a path without one shows its key in words.
    """
    from ..functions.text import label_of

    norm = F.lower(F.replace("path", F.lit("[]"), F.lit("")))
    hide = norm.isin([p.replace("[]", "").lower() for p in redact]) | F.col("value").rlike(r"\s\S+\s")
    shown = F.when(K.personal_path(F.col("path"), list(personal)), K.personal_value(F.col("value"), F.col("key"))).when(hide, K.long_numbers(F.col("value"))).otherwise(F.col("value"))
    named = rows.join(small(labels), "path", "left").withColumn("label", F.coalesce("label", label_of(F.col("key"))))
    return named.withColumn("value", shown)


def list_shapes(rows: DataFrame, doc: str) -> DataFrame:
    """(doc, list, shape) of the lists in ``answer_rows``: a table if its several items hold plain values under few keys, else cards; plain values are a list."""
    inside = rows.where("record != ''").withColumn("list", F.regexp_replace("record", r"\.[0-9]+$", ""))
    plain = F.col("path").endswith("[]")
    depth = F.size(F.split(F.element_at(F.split("path", r"\[\]"), -1), r"\.")) - 1
    per = inside.groupBy(doc, "list").agg(F.count_distinct("record").alias("items"), F.count_distinct("key").alias("keys"), F.max(depth).alias("deep"), F.bool_and(plain).alias("plain"))
    outer = inside.select(doc, F.regexp_extract("record", r"^(.*)/[^/]*$", 1).alias("outer")).where("outer != ''")
    nested = outer.select(doc, F.regexp_replace("outer", r"\.[0-9]+$", "").alias("list"), F.lit(True).alias("nested")).distinct()
    j = per.join(nested, [doc, "list"], "left")
    table = (F.col("items") > 1) & (F.col("keys") <= MOST_COLUMNS) & (F.col("deep") <= 1) & F.col("nested").isNull()
    return j.select(doc, "list", F.when(F.col("plain"), "list").when(table, "table").otherwise("cards").alias("shape"))
