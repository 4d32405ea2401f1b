"""Aggregations of the register's dashboard. Each is one shuffle on its own keys; small results are ordered by total keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked_counts(df: DataFrame, column: str) -> DataFrame:
    """(id, n) without empty ids, the most frequent first."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id")


def zero_filled(df: DataFrame, column: str, dim: DataFrame, rank: str) -> DataFrame:
    """Counts for every member of a small dimension (id, ``rank``), zeros included."""
    counts = df.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n"))
    return dim.join(counts, "id", "left").select("id", rank, F.coalesce("n", F.lit(0)).alias("n"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``row`` by the stated values of ``column``, with the row's total; one pass, no discovery of values."""
    sums = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return df.where(F.col(row).isNotNull() & (F.col(row) != "")).groupBy(row).agg(*sums, F.count("*").alias("total"))


def daily_trend(df: DataFrame, day: Column, last: str, days: int) -> DataFrame:
    """(day, n) for each of ``days`` days up to ``last``, gaps filled with 0; rows outside are pruned before counting."""
    days = max(1, min(days, 366))
    end = F.lit(last).cast("date")
    span = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    counts = df.select(day.alias("day")).where(F.col("day").between(F.date_sub(end, days - 1), end)).groupBy("day").agg(F.count("*").alias("n"))
    return span.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def mean_timings(df: DataFrame, keys: list[str]) -> DataFrame:
    """Means of the valid timings (finite, not negative) and of their sum by row; 0 where none is valid."""
    valid = {k: F.when((F.col(k) >= 0) & ~F.isnan(F.col(k)) & (F.col(k) != float("inf")), F.col(k)) for k in keys}
    total = sum((F.coalesce(v, F.lit(0.0)) for v in valid.values()), F.lit(0.0))
    any_ = F.coalesce(*valid.values()).isNotNull()
    return df.agg(*(F.coalesce(F.bround(F.avg(v), 2), F.lit(0.0)).alias(k) for k, v in valid.items()), F.coalesce(F.bround(F.avg(F.when(any_, total)), 2), F.lit(0.0)).alias("total"))


def agreement(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Share of rows whose first rating equals the second, over rows that have the second; null without any."""
    return df.agg(*(F.bround(F.avg(F.when(F.col(b).isNotNull(), F.col(a).eqNullSafe(F.col(b)).cast("double"))), 4).alias(a) for a, b in pairs))


def net_corrections(df: DataFrame, fields: dict[str, tuple[str, str]], ref: str, last: str, top: int = 10, refs: int = 5) -> DataFrame:
    """Most frequent (field, from, to) changes with the newest references; equal values (empty is null) are no change."""
    rows = F.array(*(F.struct(F.lit(k).alias("field"), F.nullif(F.col(a), F.lit("")).alias("from"), F.nullif(F.col(b), F.lit("")).alias("to")) for k, (a, b) in fields.items()))
    long = df.select(F.col(ref).alias("ref"), F.col(last).alias("last"), F.explode(rows).alias("c")).select("ref", "last", "c.*").where(~F.col("from").eqNullSafe(F.col("to")))
    counts = long.groupBy("field", "from", "to").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field", F.coalesce("from", F.lit("")), F.coalesce("to", F.lit(""))).limit(top)
    w = Window.partitionBy("field", "from", "to").orderBy(F.desc("last"), "ref")
    # ranks are cut in each task before the shuffle, so only the newest references of a change travel
    newest = long.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= refs)
    lists = newest.groupBy("field", "from", "to").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col("ref").cast("string").alias("r")))), lambda x: x["r"]), ",").alias("refs"))
    return counts.alias("c").join(lists.alias("l"), [F.col(f"c.{k}").eqNullSafe(F.col(f"l.{k}")) for k in ("field", "from", "to")]).select("c.field", "c.from", "c.to", "c.n", "l.refs")


def json_counts(df: DataFrame, column: str, path: str) -> DataFrame:
    """Counts of a JSON attribute; damaged JSON counts as absent."""
    return ranked_counts(df.select(F.get_json_object(column, path).alias("value")), "value")


def repeats(df: DataFrame, key: str) -> DataFrame:
    """How many other rows share the key; 0 for empty keys. Counted by key first, so that a hot key costs one row per task."""
    counts = df.where(~(F.col(key).isNull() | (F.col(key).cast("string") == ""))).groupBy(key).agg((F.count("*") - 1).alias("others"))
    return df.join(counts, key, "left").withColumn("others", F.coalesce("others", F.lit(0)))


def trailing_run(df: DataFrame, key: str, order: list[str], matches: Column) -> DataFrame:
    """By key, how many events match since the last one that does not."""
    at = F.struct(*order)
    last = df.groupBy(key).agg(F.max(F.when(~matches, at)).alias("stop"))
    return df.join(last, key).groupBy(key).agg(F.count_if(matches & (F.col("stop").isNull() | (at > F.col("stop")))).alias("run"))


def percent(n: Column, total: Column) -> Column:
    """Whole percent, halves up."""
    return F.when(total > 0, F.floor(n * 100 / total + 0.5)).cast("long")


def resolve_floor(signals: DataFrame, key: str, rank: str, top: int = 4) -> DataFrame:
    """Highest floor by key with the signals at that floor; floors at the top level are ignored."""
    usable = signals.where(F.col(rank) < top)
    best = usable.groupBy(key).agg(F.max(rank).alias("floor"))
    return usable.join(best, key).where(F.col(rank) == F.col("floor")).groupBy(key, "floor").agg(F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))


def gaps_islands(df: DataFrame, keys: list[str], value: str, gap: int) -> DataFrame:
    """Runs of values at most ``gap`` apart: first, last, size; by keys."""
    w = Window.partitionBy(*keys).orderBy(value)
    d = df.select(*keys, value).distinct().withColumn("new", (F.col(value) - F.lag(value).over(w) > gap).cast("int"))
    d = d.withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(w))
    return d.groupBy(*keys, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("size"))


def category_scores(hits: DataFrame, doc: str) -> DataFrame:
    """Evidence by template of hits (doc, template, group, weight, ceiling): the best weight of each group, summed, over the template's ceiling.

    Groups of negative weight take off 0.3 each, 0.6 at most. One aggregate by group, then one by template, both combined before they move.
    """
    best = hits.groupBy(doc, "template", "ceiling", "group").agg(F.max("weight").alias("w"))
    s = best.groupBy(doc, "template", "ceiling").agg(F.sum(F.greatest(F.col("w"), F.lit(0))).alias("w"), F.count_if(F.col("w") < 0).alias("against"))
    raw = F.col("w") / F.col("ceiling") - F.least(0.3 * F.col("against"), F.lit(0.6))
    return s.select(doc, "template", F.greatest(F.lit(0.0), raw).alias("score"))


def ranked_templates(scores: DataFrame, doc: str, tie: str) -> DataFrame:
    """All templates of a document, the best first."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("score"), tie)))


def best_with_margin(scores: DataFrame, doc: str, tie: str) -> DataFrame:
    """The best template by document and its lead over the runner-up."""
    w = Window.partitionBy(doc).orderBy(F.desc("score"), tie)
    return scores.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("rn = 1").withColumn("margin", F.col("score") - F.coalesce("next", F.lit(0.0))).drop("rn", "next")
