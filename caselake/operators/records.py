"""Extracted records: merging, deduplication, flattening, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_names(entries: DataFrame) -> DataFrame:
    """Entries (exact, canonical, page, raw, gender, meaning, confidence) to records.

    Exact keys merge by canonical key, unless any two of them occur on one page: then all stay apart.
    """
    veto = entries.groupBy("canonical", "page").agg(F.count_distinct("exact").alias("n")).groupBy("canonical").agg((F.max("n") > 1).alias("veto"))
    keyed = entries.join(veto, "canonical").withColumn("key", F.when(F.col("veto"), F.col("exact")).otherwise(F.col("canonical")))
    genders = F.array_sort(F.collect_set(F.when(F.col("gender").isin("male", "female", "unisex"), F.col("gender"))))
    return keyed.groupBy("key").agg(
        F.max_by("raw", F.struct("confidence", "raw")).alias("name"), F.array_join(F.array_sort(F.collect_set("raw")), "|").alias("variants"),
        F.array_join(F.array_sort(F.collect_set("meaning")), "|").alias("meanings"), gender_of(genders).alias("gender"), F.count("*").alias("n"),
    )


def gender_of(found: Column) -> Column:
    """none: unknown; one: itself; several: unisex."""
    return F.when(F.size(found) == 0, "unknown").when(F.size(found) == 1, F.element_at(found, 1)).otherwise("unisex")


def keep_best(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """One row by keys: the best score, the first on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def dense_group(df: DataFrame, key: str, page: str, weight: str, gap: int = 4) -> DataFrame:
    """By key, the run of pages at most ``gap`` apart with the greatest total; ties take the earlier run."""
    w = Window.partitionBy(key).orderBy(page)
    runs = df.withColumn("__new", F.coalesce(F.col(page) - F.lag(page).over(w) > gap, F.lit(False)).cast("int")).withColumn("__run", F.sum("__new").over(w))
    totals = runs.groupBy(key, "__run").agg(F.sum(weight).alias("total"), F.min(page).alias("first_page"), F.max(page).alias("last_page"))
    best = totals.groupBy(key).agg(F.max(F.struct("total", (-F.col("first_page")).alias("m"), "first_page", "last_page")).alias("b"))
    return best.select(key, F.col("b.first_page").alias("first_page"), F.col("b.last_page").alias("last_page"), F.col("b.total").alias("total"))


def exact_copies(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, keeper, is_copy): the least key of equal contents. The hash is aggregated, not the text."""
    h = df.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("sha"))
    first = h.groupBy("sha").agg(F.min(key).alias("keeper"))
    return h.join(first, "sha").select(key, "keeper", (F.col(key) != F.col("keeper")).alias("is_copy"))


def flatten_sections(df: DataFrame, doc: str, sections: str, most: int = 120) -> DataFrame:
    """Fields and records of nested sections as numbered (label, value) lines; a record's lines carry its number."""
    s = df.select(doc, F.posexplode(sections).alias("s", "sec"))
    f = s.select(doc, "s", F.lit(-1).alias("r"), F.posexplode("sec.fields").alias("i", "f")).select(doc, "s", "r", "i", F.col("f.label").alias("label"), F.col("f.value").alias("value"))
    rec = s.select(doc, "s", F.col("sec.record_label").alias("role"), F.posexplode("sec.records").alias("r", "rec"))
    numbered = F.concat_ws(" ", "role", (F.col("r") + 1).cast("string"), F.lit("-"), F.col("f.label")).alias("label")
    g = rec.select(doc, "s", "r", "role", F.posexplode("rec").alias("i", "f")).select(doc, "s", "r", "i", numbered, F.col("f.value").alias("value"))
    w = Window.partitionBy(doc).orderBy("s", "r", "i")
    return f.unionByName(g).where("value is not null and value != ''").withColumn("line", F.row_number().over(w)).where(F.col("line") <= most).select(doc, "line", "label", "value")


def presence(df: DataFrame, json: str) -> DataFrame:
    """By top-level key of a JSON object: in how many rows, of how many, and which types of value."""
    total = df.agg(F.count("*").alias("of"))
    obj = df.select(F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").rlike("^-?[0-9]+(\\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").when(F.col("value").isin("true", "false"), "boolean").otherwise("string")
    return obj.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("types")).crossJoin(F.broadcast(total)).select("key", "n", "of", "types")


def changes_of(old: Column, new: Column) -> Column:
    """Map of real changes between two maps: {key: struct(from, to)}; empty is null."""
    keys = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    pair = lambda k: F.struct(F.nullif(F.element_at(old, k), F.lit("")).alias("from"), F.nullif(F.element_at(new, k), F.lit("")).alias("to"))
    return F.map_filter(F.map_from_arrays(keys, F.transform(keys, pair)), lambda k, v: ~v["from"].eqNullSafe(v["to"]))


def align_labels(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows (id, label) with the key of their label; an alias that several keys share gives null."""
    one = aliases.groupBy("alias").agg(F.when(F.count_distinct("key") == 1, F.min("key")).alias("key"))
    return rows.join(one, F.lower(F.trim("label")) == F.col("alias"), "left").drop("alias")


def last_values(log: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Current state of an append-only log: the value of the latest entry by key."""
    return log.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))
