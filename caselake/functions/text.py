"""Text functions as column expressions. Patterns are Unicode-aware ((?U)), as the data mixes scripts."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectorised import vectorised

# Character folds of the Arabic search form, each character beside its target.
FOLD_FROM = "أإآٱةؤئ٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬"
FOLD_TO = "ااااهوي01234567890123456789.,"
# Vowel marks, tatweel, and invisible controls, which the search form drops.
MARKS = "".join(map(chr, (*range(0x64B, 0x660), 0x670, *range(0x6D6, 0x6EE))))
TATWEEL = "ـ"
BIDI = "".join(map(chr, (*range(0x200B, 0x2010), 0x61C, *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0xFEFF)))
#: White space of Unicode other than the blank.
SPACES = "".join(map(chr, (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"


@vectorised("string")
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), 0)


def compose(c: Column) -> Column:
    """NFC; only texts that hold a combining mark leave the JVM."""
    return F.when(c.rlike("[\\u0300-\\u036F\\u0653-\\u0655]"), _nfc(c)).otherwise(c)


def normalize(c: Column, nfc: bool = False) -> Column:
    """Search form: invisible controls, vowel marks and tatweel go, letter variants and digits fold, white space collapses.

    Arabic letters written with a combining hamza or madda come out as composed ones do, since both fold to the bare
    letter; ``nfc`` composes other scripts too, outside the JVM.
    """
    c = compose(c) if nfc else c
    # white space becomes blanks with the letters, so that only runs of blanks are left to the pattern
    return F.trim(F.regexp_replace(F.translate(c, FOLD_FROM + SPACES + TATWEEL + MARKS + BIDI, FOLD_TO + " " * len(SPACES)), " {2,}", " "))


def fold(c: Column) -> Column:
    """Search form without case (the sharp s and the final sigma fold as well)."""
    return F.replace(F.translate(F.lower(normalize(c)), "ς", "σ"), F.lit("ß"), F.lit("ss"))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, DIGITS_FROM, DIGITS_TO)


#: Digits that compatibility forms add: full width, superscript and subscript.
COMPATIBLE_FROM, COMPATIBLE_TO = "０１２３４５６７８９⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉", "0123456789" * 3


def bare_number(c: Column) -> Column:
    """A typed number in ASCII digits, whatever system or form it was typed in, without blanks, dashes, dots and invisible characters."""
    digits = F.translate(c, DIGITS_FROM + COMPATIBLE_FROM + BIDI, DIGITS_TO + COMPATIBLE_TO)
    return F.regexp_replace(digits, r"(?U)[\s.\-‐-―]+", "")


def national_id(c: Column) -> Column:
    """An identifier without spaces, dashes and invisible characters, in ASCII digits."""
    return F.regexp_replace(F.translate(c, DIGITS_FROM + BIDI, DIGITS_TO), "(?U)[\\s-]+", "")


def tokens(c: Column) -> Column:
    """Lower-case word tokens for comparison, without marks and with one form of alef."""
    return F.regexp_extract_all(F.translate(F.lower(c), "أإآ" + TATWEEL + MARKS, "ااا"), F.lit("[\\p{L}\\p{N}_]+"), 0)


#: A noncharacter, which no text should hold.
MARK = "\uffff"


def find_spans(c: Column, pattern: str | Column, groups: int = 0) -> Column:
    """Every match of a pattern as array<struct<text, start, end>>, places from 0 in code points; with ``groups`` also what its first groups took ("" for none), as ``parts``.

    One pass puts marks around each match and each of its groups, so the text falls into parts, matches and groups in turn, and running lengths give
    the places without a Python step. A text that holds the mark itself is cut by the pattern, which Spark compiles again for every text.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.expr("cast(array() as array<struct<text:string,start:int,end:int" + (",parts:array<string>" if groups else "") + ">>)")
    each = groups + 2

    def cut(t: Column) -> Column:
        both = F.arrays_zip(F.split(t, pattern, -1).alias("part"), *(F.regexp_extract_all(t, pattern, k).alias(f"hit{k}") for k in range(groups + 1)))
        slow = F.flatten(F.transform(both, lambda x: F.array(x["part"], *(x[f"hit{k}"] for k in range(groups + 1)))))
        marked = F.lit("".join(f"{MARK}${k}" for k in range(groups + 1)) + MARK)
        return F.when(F.contains(t, F.lit(MARK)), slow).otherwise(F.split(F.regexp_replace(t, pattern, marked), MARK, -1))

    def spans(pieces: Column) -> Column:
        def step(acc: Column, k: Column) -> Column:
            def span(x: Column) -> Column:
                parts = [F.slice(pieces, k + 3, groups).alias("parts")] if groups else []
                return F.struct(x["text"].alias("text"), x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"), *parts)

            met = let(F.struct(F.get(pieces, k + 1).alias("text"), (acc["at"] + F.length(F.get(pieces, k))).alias("start")), span)
            return let(met, lambda x: F.struct(x["end"].alias("at"), F.array_append(acc["out"], x).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), F.size(pieces) - each - 1, F.lit(each)), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    return let(let(c, cut), lambda pieces: F.when(F.size(pieces) <= each, none).otherwise(spans(pieces)))


# Protected tokens, in order of precedence: e-mail, IBAN, date, run of three or more digits.
PROTECTED = (
    "[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}",
    "[A-Z]{2}[0-9]{2}[A-Za-z0-9]{10,}",
    "[0-9٠-٩]{1,4}[/\\-.][0-9٠-٩]{1,2}[/\\-.][0-9٠-٩]{1,4}",
    "[0-9٠-٩]{3,}",
)


def protected_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("|".join(PROTECTED)), 0)


def token_changes(before: Column, after: Column) -> Column:
    """Sorted protected tokens whose number of occurrences differs between two texts."""
    a, b = protected_tokens(before), protected_tokens(after)
    times = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))
    return F.array_sort(F.filter(F.array_union(a, b), lambda t: times(a, t) != times(b, t)))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def skeleton(c: Column) -> Column:
    """A line with each run of digits replaced by one mark."""
    return F.regexp_replace(ascii_digits(c), "[0-9]+", "#")


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(ascii_digits(c), F.lit("[0-9]+"), 0)


def head_tail(c: Column, head: int, tail: int) -> Column:
    """The head and the tail of a long text, with a mark between."""
    return F.when(F.length(c) <= head + tail, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit("\n...\n"), F.right(c, F.lit(tail))))


def clip_lines(c: Column, limit: int, tail: float = 0.0) -> Column:
    """At most ``limit`` characters: a head cut at its last line end past four fifths, and for ``tail`` a share of the text's end from a line on."""
    rest = int(limit * tail)
    room = limit - rest - (len("\n...\n") if rest else 0)
    first = F.left(c, F.lit(room))
    whole = F.regexp_extract(first, r"(?s)^(.*)\n", 1)
    start = F.when(F.length(whole) >= int(room * 0.8), whole).otherwise(first)
    if not rest:
        return F.when(F.length(c) <= limit, c).otherwise(start)
    last = F.right(c, F.lit(rest))
    line = F.substr(last, F.length(F.substring_index(last, "\n", 1)) + 2)
    end = F.when(F.contains(F.left(last, F.lit(max(1, rest // 5))), F.lit("\n")), line).otherwise(last)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(start, F.lit("\n...\n"), end))


def token_estimate(c: Column) -> Column:
    """Arabic letters at 2.2 characters a token, digits one each, all else at four, and 16 more for the frame."""
    digits = F.regexp_count(c, F.lit("\\p{Nd}"))
    arabic = F.regexp_count(c, F.lit("[\\u0600-\\u06FF&&[^\\u0660-\\u0669\\u06F0-\\u06F9]]"))
    return (F.floor(arabic / 2.2 + digits + (F.length(c) - arabic - digits) / 4.0) + 16).cast("long")


def utf16_offset(c: Column, at: Column) -> Column:
    """A code point offset as an offset in UTF-16 units."""
    return (F.octet_length(F.encode(F.left(c, at), "UTF-16LE")) / 2).cast("long")


def words_windows(words: Column, size: int = 20, step: int = 10) -> Column:
    """Overlapping windows of words, as texts."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(step)), lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def safe_name(c: Column) -> Column:
    """A file name without folders and characters that file systems reject."""
    base = F.substring_index(F.substring_index(c, "/", -1), "\\", -1)
    cleaned = F.left(F.trim(F.regexp_replace(base, "[\\x00-\\x1F<>:\"|?*]", "_")), F.lit(120))
    return F.when(F.regexp_replace(cleaned, "[. ]", "") == "", "file").otherwise(cleaned)


def csv_cell(c: Column) -> Column:
    """Quoted against formula injection."""
    return F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def scrub(c: Column) -> Column:
    """Without code fences and format characters."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "```[A-Za-z]*", ""), "[\\p{Cf}]", ""))


def label_of(key: Column) -> Column:
    """A camelCase or snake_case key as words."""
    spaced = F.lower(F.regexp_replace(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1 $2"), "_+", " "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))


@vectorised("string")
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def html_lines(c: Column) -> Column:
    """Lines of block HTML: cells are joined by bars, breaks and block ends make lines, tags go, entities are resolved, bars at the ends go.

    Only the entities, which are too many for a chain of rewrites, are resolved outside the JVM.
    """
    table = c.rlike("(?i)<td|<table")
    cells = F.regexp_replace(F.regexp_replace(c, r"(?i)</t[dh]>\s*", " | "), r"(?i)</tr>\s*", "\n")
    c = F.regexp_replace(F.regexp_replace(F.when(table, cells).otherwise(c), r"(?i)<br\s*/?>", "\n"), "(?i)</(p|div|h[1-6]|li)>", "\n")
    lines = F.split(_unescaped(F.regexp_replace(c, "<[^>]+>", "")), "\n")
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    tidy = lambda x: strip(F.regexp_replace(strip(F.regexp_replace(strip(x), r"(?U)\s*\|\s*", " | ")), r"(?U)^\|\s*|\s*\|$", ""))
    return F.filter(F.transform(lines, tidy), lambda x: x != "")


# Forms of counted nouns: 0 and 3-10 plural, 1 singular, 2 dual, else singular.
def counted_noun(n: Column, one: str, two: str, few: str, many: str) -> Column:
    """Arabic agreement of a counted noun with its number."""
    last = n % 100
    return F.when(n == 1, one).when(n == 2, two).when(last.between(3, 10), F.concat_ws(" ", n, F.lit(few))).otherwise(F.concat_ws(" ", n, F.lit(many)))
