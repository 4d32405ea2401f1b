"""Operator 12, fill-in-the-middle transformation by lookaround splitting.

A unit grammar is stated twice: as the regex of one unit, and as pairs of neighbouring classes between which a unit
ends. The pairs become a zero-width boundary, ``(?<=before)(?=after)``, on which Spark's ``split`` cuts without losing a
character; an empty text, which ``split`` would give one empty piece, has no units. A document's prefix, middle
and suffix are whole units, chosen by its id, and are written in one of three forms.

Defined results: a null text counts as empty; an empty text, and one that holds a mark, stays ``plain``; a null id is read
as the empty string; repeated rows give a row each. Nothing is shuffled, so a row's length is the only memory
that a task needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents

ANY, BLANK, INK = r"[\s\S]", r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"

#: Grammar: one unit as a regex, and the neighbours (before, after) between which a unit ends.
GRAMMARS = {
    "line": (r"[^\n]*\n|[^\n]+", [(r"\n", ANY)]),
    "paragraph": (r"(?:[^\n]|\n(?!\n))*\n\n+|(?:[^\n]|\n(?!\n))+", [(r"\n\n", r"[^\n]")]),
    "word": (rf"{INK}*{BLANK}+|{INK}+", [(BLANK, INK)]),
    "field": (rf"{INK}+|{BLANK}+", [(BLANK, INK), (INK, BLANK)]),
    "identifier": (r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", [("[A-Za-z]", "[^A-Za-z]"), ("[0-9]", "[^0-9]"), ("[^A-Za-z0-9]", "[A-Za-z0-9]")]),
}

#: Marks of prefix, suffix and middle. None begins as another ends, so none arises where pieces meet.
MARKS = ("<P>", "<S>", "<M>")


def boundary(unit: str) -> str:
    """The zero-width regex between two units."""
    return "|".join(f"(?<={before})(?={after})" for before, after in GRAMMARS[unit][1])


def units(text: Column, unit: str = "line") -> Column:
    """The units of a text in order; joined, they are the text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(unit), -1))


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """Each document's doc_id, source_text, n, form, prefix, middle, suffix and output.

    ``rate`` per cent of the documents are transformed, ``spm_rate`` per cent of these with the suffix first. Cuts and form follow from
    the seed and the id alone.
    """
    p, s, m = map(F.lit, MARKS)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.col("source_text").contains(mark)
    plain = (F.col("source_text") == "") | marked | (h[2] % 100 >= rate)
    first, second = F.least("cut_1", "cut_2"), F.greatest("cut_1", "cut_2")
    piece = lambda start, length: F.array_join(F.slice("pieces", start, length), "")
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("source_text"))
        .withColumns({"pieces": units(F.col("source_text"), unit), "digest": digest})
        .withColumns({"n": F.size("pieces").cast("long"), "form": F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")})
        .withColumns({"cut_1": (h[0] % (F.col("n") + 1)).cast("int"), "cut_2": (h[1] % (F.col("n") + 1)).cast("int")})
        .withColumns({"prefix": piece(F.lit(1), first), "middle": piece(first + 1, second - first), "suffix": piece(second + 1, F.size("pieces"))})
        .withColumn(
            "output",
            F.when(F.col("form") == "plain", F.col("source_text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle")),
        )
        .select("doc_id", "source_text", "n", "form", *(F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix", "middle", "suffix")), "output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text from what was written and its form."""
    part = F.split(output, "|".join(MARKS), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def op12_lookaround_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into lines, with digests of what is written and of the text rebuilt from it."""
    done = fill_in_middle(read_documents(spark, sf_dir, "doc_id", "text"))
    return done.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: Lines are taken one by one here, by the regex of a unit; the restored text is the text itself.
ORACLE = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
hashed AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM base),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM hashed),
parts AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
