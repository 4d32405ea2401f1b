"""Matching by place in a text: spans, nearest labels, anchors, places, signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X



def section_spans(marks: DataFrame, doc: str, pos: str, length: str) -> DataFrame:
    """Each mark's section reaches to the next mark, or to the end."""
    w = Window.partitionBy(doc).orderBy(pos)
    return marks.withColumn("section_end", F.lead(pos).over(w)).withColumn("section_end", F.coalesce("section_end", F.col(length)))


def page_lines(lines: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Page and line numbers: a marker line opens its page as line 0, the text before any marker is page 1."""
    marker = F.regexp_extract(F.col(text), "^--- Page ([0-9]+) ---$", 1)
    w = Window.partitionBy(doc).orderBy(order)
    paged = lines.withColumn("page", F.coalesce(F.last(F.when(marker != "", marker.try_cast("int")), ignorenulls=True).over(w), F.lit(1))).withColumn("is_marker", marker != "")
    first = Window.partitionBy(doc, "page").orderBy(order)
    seen = F.max(F.col("is_marker").cast("int")).over(first)
    return paged.withColumn("line", F.row_number().over(first) - seen).drop("is_marker")


def find_all(text: Column, needle: Column) -> Column:
    """Starts (from 0) of a literal, overlapping ones included, in one pass: the text is split before each occurrence."""
    parts = F.split(text, F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)")), -1)
    none = F.expr("cast(array() as array<int>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    ends = F.aggregate(parts, start, lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out")), lambda acc: acc["out"])
    inner = F.slice(ends, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(needle == "", none).when(F.startswith(text, needle), F.concat(F.array(F.lit(0)), inner)).otherwise(inner)


FAR = 1_000_000


def choose_span(text: Column, spans: Column, same_line_as: Column, near: Column, label_starts: Column, after: Column) -> Column:
    """The span (start, end) of some candidates that fits the hints best; hints that are null, or lists that are empty, say nothing.

    On the line of another span; else nearest to a place; else just after the nearest label (before one is far); else the first after a place; else the first.
    """
    line_of = lambda at: F.regexp_count(F.left(text, at), F.lit("\n"))
    on_line = F.when(same_line_as.isNotNull(), F.filter(spans, lambda s: line_of(s["start"]) == line_of(same_line_as)))
    found = F.coalesce(F.size(on_line), F.lit(0)) > 0
    among = F.when(found, on_line).otherwise(spans)
    place = F.coalesce(near, F.when(~found, same_line_as))
    best = lambda cost: F.array_min(F.transform(among, lambda s: F.struct(cost(s).alias("cost"), s["start"].alias("start"), s["end"].alias("end"))))
    by_label = best(lambda s: F.array_min(F.transform(label_starts, lambda a: F.when(s["start"] >= a, s["start"] - a).otherwise(a - s["start"] + FAR))))
    later = F.filter(among, lambda s: s["start"] > after)
    chosen = (
        F.when(place.isNotNull(), best(lambda s: F.abs(s["start"] - place))).when(F.coalesce(F.size(label_starts), F.lit(0)) > 0, by_label)
        .when(F.coalesce(F.size(later), F.lit(0)) > 0, F.array_min(F.transform(later, lambda s: F.struct(F.lit(0).alias("cost"), s["start"].alias("start"), s["end"].alias("end")))))
        .otherwise(best(lambda s: F.lit(0)))
    )
    return F.when(F.size(spans) > 0, F.struct(chosen["start"].alias("start"), chosen["end"].alias("end")))


def label_dates(labels: DataFrame, dates: DataFrame, doc: str, reach: int = 90) -> DataFrame:
    """As-of join: for each label (start, end, rank), the first date that starts within ``reach`` characters after it.

    The range condition rides on an equi-join by document, so that the plan stays a hash or merge join.
    """
    d = dates.select(doc, F.col("start").alias("date_start"), "date_text")
    near = labels.join(d, doc).where(F.col("date_start").between(F.col("end"), F.col("end") + reach))
    hit = near.groupBy(doc, "label", "start", "rank").agg(F.min(F.struct("date_start", "date_text")).alias("hit"))
    return hit.select(doc, "label", "start", "rank", F.col("hit.date_start").alias("date_start"), F.col("hit.date_text").alias("date_text"))


def nearest_anchor(candidates: DataFrame, anchors: DataFrame, doc: str, penalty: int = 1_000_000) -> DataFrame:
    """By document, the candidate span nearest to an anchor; one before the anchor costs ``penalty`` more. Ties take the earlier."""
    a = anchors.select(doc, F.col("pos").alias("anchor"))
    cost = F.abs(F.col("start") - F.col("anchor")) + F.when(F.col("start") < F.col("anchor"), penalty).otherwise(0)
    best = candidates.join(a, doc).groupBy(doc).agg(F.min(F.struct(cost.alias("cost"), "start", "value")).alias("b"))
    return best.select(doc, F.col("b.start").alias("start"), F.col("b.value").alias("value"), F.col("b.cost").alias("cost"))


def anchor_fires(text: Column, anchor: Column, not_before: Column, look_back: int = 40, co_occurs: Column | None = None, within: int = 200, sections: Column | None = None, allowed: Column | None = None) -> Column:
    """Some occurrence of an anchor passes every gate: none of ``not_before`` in the ``look_back`` characters before it, one of ``co_occurs``
    within reach, and a section (start, end, name) of ``allowed`` around it. Empty lists are no gates."""

    def passes(at: Column) -> Column:
        before = F.substr(text, F.greatest(at - look_back + 1, F.lit(1)), F.least(at, F.lit(look_back)))
        ok = ~F.exists(not_before, lambda n: F.contains(before, n))
        if co_occurs is not None:
            low = F.greatest(at - within, F.lit(0))
            around = F.substr(text, low + 1, at + F.length(anchor) + within - low)
            ok = ok & ((F.size(co_occurs) == 0) | F.exists(co_occurs, lambda c: (c != "") & F.contains(around, c)))
        if sections is not None:
            ok = ok & ((F.size(allowed) == 0) | F.exists(sections, lambda s: (s["start"] <= at) & (at < s["end"]) & F.array_contains(allowed, s["name"])))
        return ok

    return F.exists(find_all(text, anchor), passes)


def co_occur(text: Column, a: Column, b: Column, within: int) -> Column:
    """Two strings stand at most ``within`` characters apart somewhere."""
    return F.exists(find_all(text, a), lambda x: F.exists(find_all(text, b), lambda y: F.abs(x - y) <= within))


def budget_newest(df: DataFrame, key: str, order: str, cost: Column, budget: int) -> DataFrame:
    """Rows from the newest back while the running cost fits; the newest always stays; stops at the first overflow."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return df.withColumn("running", F.sum(cost).over(w)).withColumn("rn", newest).where((F.col("rn") == 1) | (F.col("running") <= budget)).drop("rn")


def fill_both_ways(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Nulls take the value before, or else the one after."""
    back = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(column, F.coalesce(F.last(column, ignorenulls=True).over(back), F.first(column, ignorenulls=True).over(ahead)))


def carry_forward(df: DataFrame, key: str, order: str, is_start: Column) -> DataFrame:
    """Continuation lines join the entry opened last: entry number, text, least confidence. Lines before any entry are dropped."""
    w = Window.partitionBy(key).orderBy(order)
    e = df.withColumn("entry", F.sum(is_start.cast("int")).over(w)).where("entry > 0")
    return e.groupBy(key, "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ").alias("text"), F.min("confidence").alias("confidence"))


def greedy_spans(spans: Column, most: int = 3) -> Column:
    """Non-overlapping spans (start, end) from the left, ``most`` at most."""
    empty = F.filter(spans, lambda x: F.lit(False))

    def step(kept: Column, span: Column) -> Column:
        behind = F.element_at(kept, F.greatest(F.size(kept), F.lit(1)))["end"] <= span["start"]
        return F.when((F.size(kept) < most) & ((F.size(kept) == 0) | behind), F.concat(kept, F.array(span))).otherwise(kept)

    return F.aggregate(F.array_sort(spans), empty, step)


def best_clause(clauses: DataFrame, doc: str, least: float) -> DataFrame:
    """The clause with most of the wanted words (share at least ``least``); ties take the shortest, then the greatest text."""
    ratio = F.size(F.array_intersect("words", "wanted")) / F.size(F.array_distinct("wanted"))
    rated = clauses.withColumn("ratio", ratio).where(F.col("ratio") >= least)
    best = rated.groupBy(doc).agg(F.max(F.struct("ratio", (-F.length("clause")).alias("short"), "clause")).alias("b"))
    return best.select(doc, F.col("b.ratio").alias("ratio"), F.col("b.clause").alias("clause"))


def pattern_hits(text: Column, vocabulary: list[tuple[str, str]]) -> Column:
    """Names of a short stated vocabulary (name, pattern) whose pattern occurs in a text, in order; a name with several patterns comes once.

    One expression over the text: nothing is joined, and each pattern is compiled once. Longer vocabularies belong to ``signals.detect``.
    """
    names = dict.fromkeys(n for n, _ in vocabulary)
    any_of = {n: [text.rlike(p) for m, p in vocabulary if m == n] for n in names}
    return F.array_compact(F.array(*(F.when(reduce(Column.__or__, tests), F.lit(n)) for n, tests in any_of.items())))


def anchor_weights(text: Column, anchors: list[tuple[str, str, str, int]]) -> Column:
    """array<struct<template, group, weight, ceiling>> of the anchors (template, group, literal, weight) that a text holds.

    A template's ceiling is the sum of the greatest weight of each of its groups; groups with a negative weight count evidence against it, and have none.
    """
    best: dict[str, dict[str, int]] = {}
    for template, group, _, weight in anchors:
        groups = best.setdefault(template, {})
        groups[group] = max(weight, groups.get(group, weight))
    ceiling = {t: sum(w for w in groups.values() if w > 0) for t, groups in best.items()}
    hit = lambda t, g, a, w: F.when(F.contains(text, F.lit(a)), F.struct(F.lit(t).alias("template"), F.lit(g).alias("group"), F.lit(w).alias("weight"), F.lit(ceiling[t]).alias("ceiling")))
    return F.array_compact(F.array(*(hit(*x) for x in anchors)))


def prefill(rows: DataFrame, doc: str, order: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(doc, field, value): of rows (doc, order, label, value), what fills a service's inputs; ``rules`` are (field, label pattern, shape of the folded value).

    The first rule of a field that any row fits decides, and of the rows that fit it the first.
    """
    value = X.fold(F.col("value"))
    fits = F.array_compact(
        F.array(*(F.when(F.col("label").rlike(f"(?i){label}") & value.rlike(f"^(?:{shape})"), F.struct(F.lit(field).alias("field"), F.lit(i).alias("rank"))) for i, (field, label, shape) in enumerate(rules)))
    )
    hit = rows.select(doc, order, value.alias("value"), F.explode(fits).alias("f"))
    return hit.groupBy(doc, "f.field").agg(F.min(F.struct("f.rank", order, "value")).alias("m")).select(doc, "field", F.col("m.value").alias("value"))


def identity_kind(number: Column) -> Column:
    """What an identity number says of its owner (fixed values): a citizen's begins with 1, a resident's with 2."""
    return F.when(number.startswith("1"), "National_ID").when(number.startswith("2"), "Resident_ID")
