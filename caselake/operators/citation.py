"""Quotes and numbers found again in their source, values checked against it, and the splits that quotes come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X

QUOTE, CLAUSE_WORDS, WINDOW = 450, 20, 200
_EDGES = " \t\n\"'«»“”„‘’()[]{}.,،؛;:!؟?…-–—"
_ANY_DIGIT = "[0-9٠-٩۰-۹]"


def sentences(c: Column) -> Column:
    """Distinct spans of at most QUOTE characters: sentences and lines, longer ones cut at the last blank past 200 characters, or hard."""
    cut = rf"(?s)\S.{{0,{QUOTE - 1}}}$|\S.{{199,{QUOTE - 2}}}(?= )|\S.{{{QUOTE - 1}}}"
    parts = F.flatten(F.transform(F.split(c, r"\n+|(?<=[.!?؟؛])\s+"), lambda s: F.regexp_extract_all(F.trim(s), F.lit(cut), 0)))
    return F.array_distinct(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != ""))


def clauses(c: Column, least_words: int = 3) -> Column:
    """Distinct clauses, in order: split at line ends, bars and punctuation; long ones as windows of twenty words, each ten words on."""
    bare = lambda s: F.btrim(s, F.lit(_EDGES))
    step = CLAUSE_WORDS // 2

    def windows(part: Column) -> Column:
        words = F.filter(F.split(bare(part), r"(?U)\s+"), lambda w: w != "")
        last = F.greatest(F.lit(0), F.size(words) - step - 1)
        return F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: bare(F.array_join(F.slice(words, i + 1, CLAUSE_WORDS), " ")))

    found = F.flatten(F.transform(F.split(c, r"\n+|\s*\|\s*|(?<=[.!?؟؛;،,:])\s+"), windows))
    return F.array_distinct(F.filter(found, lambda s: (s != "") & (F.size(F.split(s, " ")) >= least_words)))


def _literal(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def quote_pattern(quote: Column) -> Column:
    """Java pattern of a quote in which only white space may differ."""
    words = F.filter(F.split(quote, r"(?U)\s+"), lambda w: w != "")
    return F.concat(F.lit("(?U)"), F.array_join(F.transform(words, _literal), r"\s+"))


def cite(text: Column, quote: Column) -> Column:
    """struct(start, end, line, start_utf16, end_utf16, quote) of a quote in a text: as it is, else with other white space; null if absent."""
    bare = F.trim(F.regexp_replace(quote, r"(?U)^\s+|\s+$", ""))
    exact = F.position(bare, text)
    loose = F.when(exact > 0, bare).otherwise(F.regexp_substr(text, quote_pattern(bare)))
    start = F.when(exact > 0, exact - 1).otherwise(F.position(loose, text) - 1)
    end = start + F.length(loose)
    found = F.struct(
        start.alias("start"), end.alias("end"), (F.regexp_count(F.left(text, start), F.lit("\n")) + 1).alias("line"),
        X.utf16_offset(text, start).alias("start_utf16"), X.utf16_offset(text, end).alias("end_utf16"), loose.alias("quote"),
    )
    return F.when((bare != "") & loose.isNotNull() & (start >= 0), found)


def number_pattern(value: Column) -> Column:
    """Java pattern of a number of five digits or more in any digit system and spacing, never inside a longer one; null for other values."""
    digits = F.regexp_replace(X.ascii_digits(value), "[^0-9]", "")
    classes = F.create_map(*[F.lit(x) for d in range(10) for x in (str(d), f"[{d}{chr(0x660 + d)}{chr(0x6F0 + d)}]")])
    body = F.array_join(F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d: F.element_at(classes, d)), "[ \\-–]?")
    return F.when((F.length(digits) >= 5) & value.rlike(r"^\+?(?:" + _ANY_DIGIT + r"|[\s\-–()])+$"), F.concat(F.lit(f"(?<!{_ANY_DIGIT})"), body, F.lit(f"(?!{_ANY_DIGIT})")))


def find_number(text: Column, value: Column) -> Column:
    """The number as the text prints it, or null."""
    return F.regexp_substr(text, number_pattern(value))


def window(text: Column, start: Column, end: Column) -> Column:
    """The line around a span; of a line longer than WINDOW characters, a third of that on either side, with marks where it is cut."""
    before, after = F.left(text, start), F.substr(text, end + 1)
    line_start = F.length(before) - F.length(F.substring_index(before, "\n", -1))
    line_end = end + F.length(F.substring_index(after, "\n", 1))
    whole = F.trim(F.substr(text, line_start + 1, line_end - line_start))
    a, b = F.greatest(line_start, start - WINDOW // 3), F.least(line_end, end + WINDOW // 3)
    part = F.concat(F.when(a > line_start, "…").otherwise(""), F.trim(F.substr(text, a + 1, b - a)), F.when(b < line_end, "…").otherwise(""))
    return F.when(line_end - line_start <= WINDOW, whole).otherwise(part)


def _tokens_by_digits(source: Column) -> Column:
    """Protected tokens of a source as array<struct<digits, token>>, in order."""
    return F.transform(X.protected_tokens(source), lambda t: F.struct(X.ascii_digits(t).alias("digits"), t.alias("token")))


def _known(tokens: Column, token: Column) -> Column:
    return F.try_element_at(F.filter(tokens, lambda t: t["digits"] == X.ascii_digits(token)), F.lit(1))["token"]


def restore(value: Column, source: Column) -> Column:
    """A value whose protected tokens take the source's own digits; tokens that it lacks stay."""
    pattern = F.lit("|".join(X.PROTECTED))
    known, hits, parts = _tokens_by_digits(source), X.protected_tokens(value), F.split(value, pattern, -1)
    pairs = F.arrays_zip(parts.alias("part"), hits.alias("hit"))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["part"], F.coalesce(_known(known, p["hit"]), p["hit"], F.lit("")))), "")


def fidelity(value: Column, source: Column) -> Column:
    """struct(value, verified): digits restored; verified if the source prints every protected token and, folded, the value itself."""
    known = _tokens_by_digits(source)
    missing = F.exists(X.protected_tokens(value), lambda t: _known(known, t).isNull())
    out = restore(value, source)
    empty = F.coalesce(F.trim(value), F.lit("")) == ""
    return F.struct(F.when(empty, value).otherwise(out).alias("value"), (empty | (~missing & F.contains(X.normalize(source), X.normalize(out)))).alias("verified"))


def bare_words(c: Column) -> Column:
    """Each word of more than three letters without its definite article."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.when(w.startswith("ال") & (F.length(w) > 3), F.substr(w, F.lit(3))).otherwise(w)), " ")


def value_status(value: Column, kind: Column, types: dict[str, tuple[str | None, tuple[str, ...]]], choices: Column | None = None) -> Column:
    """ok, empty or mismatch of a value by its type.

    ``types``: pattern and fallback types of each; a type without a pattern accepts anything, and so does an unknown one. ``enum``
    values compare folded, with or without articles; an enum without ``choices`` accepts anything.
    """
    norm = X.normalize(value)
    ok = F.lit(True)
    for name, (_, fallback) in types.items():
        patterns = [(n, types[n][0] if n in types else None) for n in (name, *fallback)]
        open_end = next((i for i, (_, p) in enumerate(patterns) if p is None), None)
        fits = F.lit(open_end is not None)
        for n, p in patterns[:open_end]:
            fits = fits | (F.replace(norm, F.lit(" "), F.lit("")) if n == "iban" else norm).rlike(p) | F.trim(value).rlike(p)
        ok = F.when(kind == name, fits).otherwise(ok)
    if choices is not None:
        among = F.array_contains(choices, norm) | F.array_contains(F.transform(choices, bare_words), bare_words(norm))
        ok = F.when(kind == "enum", (F.size(choices) == 0) | among).otherwise(ok)
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", "empty").when(ok, "ok").otherwise("mismatch")


def field_status(status: Column, verified: Column) -> Column:
    return F.when((status == "ok") & ~verified, "unverified").otherwise(status)


def missing_required(fields: Column, required: list[str]) -> Column:
    """Keys that are required but absent or empty, in order, from array<struct<key, value>>."""
    filled = F.transform(F.filter(fields, lambda f: F.trim(F.coalesce(f["value"], F.lit(""))) != ""), lambda f: f["key"])
    return F.array_except(F.array(*map(F.lit, required)), filled)


def present_required(fields: Column, required: list[str]) -> Column:
    """Keys that are required and hold a value, in the order of ``required``."""
    keys = F.array(*map(F.lit, required))
    return F.array_except(keys, missing_required(fields, required))
