"""Model output held to closed vocabularies, reference lists, budgets, and sets of review reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import small

# Answers that mean nothing was found.
PLACEHOLDERS = ("-", "—", "–", "لا يوجد", "لايوجد", "غير مذكور", "غير محدد", "غير متوفر", "غير معروف", "لا ينطبق", "n/a", "na", "none", "null", "unknown", "not mentioned", "not specified")
CONFIDENCES = ("high", "medium", "low")
MOST_FACTORS, MOST_REFS, MOST_VALUE = 4, 5, 300
CLASSIFICATION = (
    "category string, subcategory string, ministry string, priority string, priority_factors array<string>, affected_scope string, tone string, confidence string, evidence array<string>"
)


def scalar(c: Column) -> Column:
    """A short value with single blanks; placeholders and null are empty."""
    text = F.left(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")), F.lit(MOST_VALUE))
    return F.when(X.fold(text).isin(*PLACEHOLDERS), "").otherwise(text)


def strings(c: Column, most: int) -> Column:
    """Distinct values of a list without placeholders, the first ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), scalar), lambda v: v != "")), 1, most)


def classification(raw: Column, vocabulary: dict[str, list[str]], category_of: dict[str, str]) -> Column:
    """A JSON answer as a struct of closed ids; null if it is no object or one of its three decisions is no id.

    A subcategory of another category is dropped, factors are distinct and few, other ids are null if unknown, confidence is low.
    """
    d = F.from_json(raw, CLASSIFICATION)
    valid = d["category"].isin(vocabulary["category"]) & d["ministry"].isin(vocabulary["ministry"]) & d["priority"].isin(vocabulary["priority"])
    owner = F.try_element_at(F.create_map(*[F.lit(x) for pair in category_of.items() for x in pair]), d["subcategory"])
    none = F.expr("cast(array() as array<string>)")
    known = lambda c, kind: F.when(c.isin(vocabulary[kind]), c)
    clean = F.struct(
        d["category"].alias("category"), F.when(owner == d["category"], d["subcategory"]).alias("subcategory"), d["ministry"].alias("ministry"), d["priority"].alias("priority"),
        F.slice(F.array_distinct(F.filter(F.coalesce(d["priority_factors"], none), lambda f: f.isin(vocabulary["factor"]))), 1, MOST_FACTORS).alias("factors"),
        known(d["affected_scope"], "scope").alias("scope"), known(d["tone"], "tone").alias("tone"), F.coalesce(known(d["confidence"], "confidence"), F.lit("low")).alias("confidence"),
        F.slice(F.filter(F.coalesce(d["evidence"], none), lambda e: e.isNotNull()), 1, 3).alias("evidence"),
    )
    return F.when(F.coalesce(valid, F.lit(False)), clean)


def cited(refs: Column, supplied: Column) -> Column:
    """References that were supplied, once each, the first five."""
    return F.slice(F.array_intersect(refs, supplied), 1, MOST_REFS)


def samples_with_corrected(samples: DataFrame, corrected: DataFrame, ref: str, order: str) -> DataFrame:
    """Sampled rows and corrected ones outside the sample, the corrected outsiders first; ``changes`` marks every corrected row."""
    inside = samples.join(corrected.select(ref, "changes"), ref, "left").withColumn("outside", F.lit(False))
    extra = corrected.join(samples.select(ref), ref, "left_anti").withColumn("outside", F.lit(True))
    rank = F.row_number().over(Window.orderBy(F.desc("outside"), order, ref))
    return inside.unionByName(extra, allowMissingColumns=True).withColumn("place", rank)


def prefix_budget(df: DataFrame, key: list[str], order: str, cost: Column, budget: int) -> DataFrame:
    """Rows of each key in order until the first that would exceed the budget; the first row always stays."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("used", F.sum(cost).over(w)).withColumn("__rn", F.row_number().over(w)).where((F.col("__rn") == 1) | (F.col("used") <= budget)).drop("__rn")


def capped_context(sections: Column, most_sections: int, most_fields: int, most_chars: int) -> Column:
    """Nested sections cut to so many sections, fields each, and characters of label and value."""
    short = lambda f: F.struct(F.left(f["label"], F.lit(most_chars)).alias("label"), F.left(f["value"], F.lit(most_chars)).alias("value"))
    return F.transform(F.slice(sections, 1, most_sections), lambda s: s.withField("fields", F.transform(F.slice(s["fields"], 1, most_fields), short)))


def multiset_difference(a: Column, b: Column) -> Column:
    """What ``a`` holds more often than ``b``, as array<struct<item, n>>, sorted."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    more = F.transform(F.array_distinct(a), lambda x: F.struct(x.alias("item"), (times(a, x) - times(b, x)).alias("n")))
    return F.array_sort(F.filter(more, lambda m: m["n"] > 0))


def unseen_reasons(new: Column, old: Column, again: list[str]) -> Column:
    """Reasons of a new analysis that call for another review and were not there before."""
    return F.array_except(F.array_intersect(new, F.array(*map(F.lit, again))), old)


def joined_chunks(chunks: DataFrame, doc: str, order: str, heading: str, body: str) -> DataFrame:
    """Chunk outputs as sections: a chunk whose heading equals that of the chunk before it continues that section."""
    w = Window.partitionBy(doc).orderBy(order)
    opens = ~F.col(heading).eqNullSafe(F.lag(heading).over(w)) | (F.row_number().over(w) == 1)
    numbered = chunks.withColumn("section", F.sum(opens.cast("int")).over(w))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, body))), lambda x: x[body])
    return numbered.groupBy(doc, "section").agg(F.first(heading).alias(heading), F.array_join(ordered, "\n").alias(body))


def finding_counts(findings: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """Findings by status after removing those that repeat a document's ``keys``."""
    return findings.dropDuplicates([doc, *keys]).groupBy(doc, "status").agg(F.count("*").alias("n"))


def mean_agreement(df: DataFrame, columns: list[str]) -> DataFrame:
    """The mean of several agreement ratios, those that are null left out."""
    return df.select(F.explode(F.array(*columns)).alias("x")).agg(F.avg("x").alias("mean"))


# Words that are no names, alone or as a part of one.
REJECTED = ("المعنى", "معناه", "ملاحظة", "مثال", "مثلا", "قال", "وقال", "أي", "هو", "هي", "اسم", "الأسماء", "الفصل", "الباب", "المصدر", "المرجع")
REJECTED_PARTS = (
    "في من إلى على عن مع عند بين ثم الذي التي هو هي هذا هذه كل غير بعد قبل أخوته اخوته اشتهرت منها أطرافها تابعي الرماح فنسبت وقيل المختلفة الروائح العطرة ذكر الحبارى "
    "وشعراء وصحابيين وأمراء وعليه عليه قول الشاعر وكاتب مؤرخ وفقيه ولقب ومحكم الأمر الشيء ومنه الأعشى ونبات الرائحة"
).split()
LETTER = r"[ء-غف-يٮ-ۓۺ-ۿ]"


def name_form(c: Column, search: bool = False) -> Column:
    """A name without marks, controls and anything but Arabic letters and single blanks; the search form has one alef."""
    plain = F.regexp_replace(F.translate(c, X.TATWEEL + X.MARKS + X.BIDI, ""), r"(?U)\s+", " ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^ء-يٮ-ۓۺ-ۿ ]", ""), " +", " "))
    return F.translate(plain, "أإآٱ", "اااا") if search else plain


def name_key(c: Column) -> Column:
    """Key of spelling variants: no blanks, one form of a leading alef."""
    return F.regexp_replace(F.replace(name_form(c), F.lit(" "), F.lit("")), "^[أإآٱ]", "ا")


def plausible_name(c: Column) -> Column:
    """2 to 28 letters in one to four words, none of them rejected; three words or more need a connective."""
    name = name_form(c)
    words = F.filter(F.split(name, " "), lambda w: w != "")
    letters = F.regexp_count(name, F.lit(LETTER))
    rejected = F.arrays_overlap(words, F.array(*map(F.lit, (*REJECTED, *REJECTED_PARTS))))
    later = F.exists(F.slice(words, 2, 4), lambda w: w.startswith("و"))
    return letters.between(2, 28) & F.size(words).between(1, 4) & ~rejected & ((F.size(words) < 3) | later | F.array_contains(words, "أو"))


def noise_line(c: Column) -> Column:
    """A line too long, or with two or more marks of a damaged row."""
    return (F.length(c) > 300) | (F.regexp_count(c, F.lit(r"\b5\s+1\s+\d")) >= 2)


def meaningful(c: Column) -> Column:
    return F.regexp_count(c, F.lit(LETTER)) >= 2


def text_quality(c: Column) -> Column:
    """Letters count, digits count against three, other characters a little."""
    letters, digits = F.regexp_count(c, F.lit(LETTER)), F.regexp_count(c, F.lit("[0-9٠-٩۰-۹]"))
    return letters - digits * 3 - F.abs(F.length(c) - letters) * 0.05


# Wordings that state the gender of a name.
_GENDERS = (
    ("unisex", r"اسم(?:\s+علم)?\s+مشترك|للذكور\s+وال[إا]ناث|للمذكر\s+والمؤنث|للذكر\s+وال[أا]نثى"),
    ("female", r"اسم(?:\s+علم)?\s+مؤنث|اسم(?:\s+علم)?\s+لل[إا]ناث"), ("male", r"اسم(?:\s+علم)?\s+مذكر|اسم(?:\s+علم)?\s+للذكور"),
)


def gender_of(meaning: Column, y: Column, split_y: Column, before: Column, after: Column, section: Column) -> Column:
    """struct(gender, source): by the wording, else by the page's split, else by the section of the book."""
    text = F.translate(meaning, X.TATWEEL + X.MARKS, "")
    said = F.coalesce(*(F.when(text.rlike(p), g) for g, p in _GENDERS))
    placed = F.coalesce(F.when(split_y.isNotNull() & y.isNotNull(), F.when(y < split_y, before).otherwise(after)), section)
    source = F.when(said.isNotNull(), "explicit_description").when(placed.isNotNull(), "document_section").otherwise("unclassified")
    return F.struct(F.coalesce(said, placed, F.lit("unknown")).alias("gender"), source.alias("source"))


def checked_inputs(inputs: DataFrame, rules: DataFrame) -> DataFrame:
    """Conflicts (call, name, problem) of call inputs (call, endpoint, name, value) with a catalogue's rules.

    ``rules`` (endpoint, name, required, pattern, required_if, group): a pattern must fit, a required input or one whose
    ``required_if`` input is given must be there, and of a ``group`` exactly one is given. The catalogue is broadcast, if Spark finds it small.
    """
    calls = inputs.select("call", "endpoint").distinct()
    want = calls.join(rules, "endpoint").join(inputs.select("call", "name", "value"), ["call", "name"], "left")
    given = F.coalesce(F.trim("value"), F.lit("")) != ""
    names = F.collect_set(F.when(given, F.col("name"))).over(Window.partitionBy("call"))
    in_group = F.count_if(given).over(Window.partitionBy("call", "group"))
    j = want.withColumn("given", given).withColumn("all", names).withColumn("in_group", in_group)
    problem = (
        F.when(~F.col("given") & (F.col("required") | F.coalesce(F.array_contains("all", F.col("required_if")), F.lit(False))), "missing")
        .when(F.col("given") & F.col("pattern").isNotNull() & ~F.expr("regexp_like(value, pattern)"), "malformed")
        .when(F.col("group").isNotNull() & (F.col("in_group") != 1), "one_of")
    )
    return j.select("call", "name", problem.alias("problem")).where("problem is not null")


def planned(calls: DataFrame, conflicts: DataFrame, available: list[str]) -> DataFrame:
    """Calls with ``skip``: unavailable, invalid, or null where the call can go out."""
    bad = conflicts.select("call").distinct().withColumn("bad", F.lit(True))
    return calls.join(bad, "call", "left").withColumn("skip", F.when(~F.col("endpoint").isin(available), "unavailable").when(F.col("bad"), "invalid")).drop("bad")



def call_costs(calls: DataFrame, prices: DataFrame, key: str, surcharge: int) -> DataFrame:
    """(key, cost) of the chosen register calls (key, endpoint, old): each endpoint's price, and a surcharge for a call by an old number."""
    each = F.col("price") + F.when(F.col("old"), surcharge).otherwise(0)
    return calls.join(small(prices), "endpoint").groupBy(key).agg(F.sum(each).cast("long").alias("cost"))
