"""Register answers and labels: numbers and their kinds, code and name tidying, roles by vote, labels and letters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .compare import nearest

ARTICLE = "ال"


def number_kind(c: Column) -> Column:
    """struct(digits, kind) of a typed register number: unified (begins with 70) or cr, ten digits both; null for anything else."""
    digits = X.bare_number(c)
    kind = F.when(digits.rlike("^70[0-9]{8}$"), "unified").when(digits.rlike("^[1-57][0-9]{9}$"), "cr")
    return F.when(kind.isNotNull(), F.struct(digits.alias("digits"), kind.alias("kind")))


def without_codes(rows: DataFrame, record: str, key: str = "key", value: str = "value") -> DataFrame:
    """Flat rows without the codes that stand beside their name: ``cityId`` beside ``cityName``, a short ``id`` beside a plain name.

    A code goes if a name of its record has the same base, or one that the code's base begins with; names are grouped by record once.
    """
    k, v = F.col(key), F.col(value)
    base = F.lower(F.regexp_extract(k, "(?i)^(.*?)(?:NameAr|NameEn|Name|Description|Desc)$", 1))
    named = k.rlike("(?i)^.*(?:Name|Desc|Description|NameAr|NameEn)$") & (F.coalesce(v, F.lit("")) != "")
    plain = F.lower(k).isin("name", "namear", "nameen", "arabicname", "englishname", "description", "desc") & (F.coalesce(v, F.lit("")) != "")
    w = Window.partitionBy(record)
    marked = rows.withColumn("__bases", F.collect_set(F.when(named & (base != ""), base)).over(w)).withColumn("__plain", F.max(plain).over(w))
    code = F.lower(F.regexp_extract(k, "^(.*?[a-z])(?:Id|ID|Code)$", 1))
    beside = (code != "") & F.exists("__bases", lambda b: code.startswith(b))
    lookup = F.lower(k).isin("id", "code") & F.col("__plain") & (F.length(v) <= 5)
    return marked.where(~F.coalesce(beside | lookup, F.lit(False))).drop("__bases", "__plain")


def printed_columns(columns: DataFrame, text: Column, required: str, names: str) -> DataFrame:
    """Candidate columns that are required, or one of whose names (folded) the text prints."""
    return columns.where(F.col(required) | F.exists(names, lambda n: (n != "") & F.contains(text, n)))


def vote_roles(labels: DataFrame, aliases: DataFrame, doc: str, order: str) -> DataFrame:
    """Keys of labels (doc, section, ``order``, label, folded): by an exact alias, else by the heading, else by the nearest exact label.

    ``aliases`` (alias, key, section, role, shared): an exact alias of one key gives it; of several, null. Of a shared alias, the key
    whose section the heading matches is taken if it is the only one; otherwise the nearest label that stands for an exact key
    votes for the one candidate of its section and role, the label before on a tie. Votes never cross a (doc, section).
    """
    exact = aliases.where("not shared").groupBy("alias").agg(F.when(F.count_distinct("key") == 1, F.struct(F.min("key").alias("key"), F.min("section").alias("s"), F.min("role").alias("r"))).alias("exact"))
    pool = aliases.where("shared").groupBy("alias").agg(F.collect_set(F.struct("key", F.col("section").alias("s"), F.col("role").alias("r"))).alias("pool"))
    here = labels.join(exact, F.col("label") == exact["alias"], "left").drop("alias").join(exact.select("alias", F.lit(True).alias("known")), F.col("label") == F.col("alias"), "left").drop("alias")
    here = here.join(pool, F.col("label") == pool["alias"], "left").drop("alias")
    hits = F.collect_list(F.when(F.col("exact").isNotNull(), F.struct(F.col(order).alias("at"), "exact"))).over(Window.partitionBy(doc, "section"))
    heading = F.col("section")
    fits = lambda c: (heading != "") & ((c["s"] == heading) | ((F.least(F.length(c["s"]), F.length(heading)) >= 4) & (F.contains(c["s"], heading) | F.contains(heading, c["s"]))))
    scoped = F.filter("pool", fits)
    among = F.when(F.size(scoped) > 0, scoped).otherwise(F.col("pool"))

    def vote(h: Column) -> Column:
        agree = F.filter(among, lambda c: (c["s"] == h["exact"]["s"]) & (h["exact"]["r"].isNull() | c["r"].isNull() | (c["r"] == h["exact"]["r"])))
        far = F.abs(h["at"] - F.col(order))
        return F.when(F.size(agree) == 1, F.struct(far.alias("far"), (h["at"] > F.col(order)).alias("after"), agree[0]["key"].alias("key")))

    nearest = F.array_min(F.transform("hits", vote))["key"]
    alone = F.when((F.size("pool") == 1) & (heading == ""), F.col("pool")[0]["key"])
    shared = F.when(F.size(scoped) == 1, scoped[0]["key"]).otherwise(F.coalesce(nearest, alone))
    key = F.when(F.col("exact").isNotNull(), F.col("exact.key")).when(F.col("known"), F.lit(None)).otherwise(shared)
    return here.withColumn("hits", hits).withColumn("key", key).drop("exact", "known", "pool", "hits")


def role_label(base: Column, role: Column) -> Column:
    """A field's label with its role in construct form: a lone noun or a two-word chain sheds its article, anything else takes the preposition."""
    base, role = F.trim(F.coalesce(base, F.lit(""))), F.trim(F.coalesce(role, F.lit("")))
    words = F.split(base, r"\s+")
    bare = lambda w: F.when(w.startswith(ARTICLE), F.substr(w, F.lit(3))).otherwise(w)
    chain = (F.size(words) == 2) & ~words[0].startswith(ARTICLE) & F.try_element_at(words, F.lit(2)).startswith(ARTICLE)
    to = F.when(role.startswith(ARTICLE), F.concat(F.lit("ل"), F.substr(role, F.lit(2)))).otherwise(F.concat(F.lit("ل"), role))
    joined = F.when(F.size(words) == 1, F.concat_ws(" ", bare(words[0]), role)).when(chain, F.concat_ws(" ", words[0], bare(F.try_element_at(words, F.lit(2))), role))
    return F.when(base == "", role).when(role == "", base).otherwise(F.coalesce(joined, F.concat_ws(" ", base, to)))


def split_description(c: Column) -> Column:
    """struct(ar, en) of a bilingual description, split at spaced dashes and line ends; 120 characters each."""
    parts = F.filter(F.transform(F.split(c, r"(?U)\s+[-–—]\s+|\n"), lambda p: F.btrim(F.regexp_replace(p, r"(?U)\s+", " "), F.lit(" -–—:،.'\""))), lambda p: p != "")
    arabic = lambda p: p.rlike(r"\p{IsArabic}")
    half = lambda keep: F.left(F.array_join(F.filter(parts, keep), " - "), F.lit(120))
    return F.struct(half(arabic).alias("ar"), half(lambda p: ~arabic(p)).alias("en"))


def letter(name: Column, ref: Column, day: Column, subject: Column, entity: str, desk: str, target: Column, priority: Column, term: Column, receipt_only: Column) -> Column:
    """The reply to a complainant; the same row always gives the same letter. ``target`` is who gets the case, or null if it only is received."""
    some = lambda before, c, after="": F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    who = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "مقدم الشكوى").otherwise(F.left(name, F.lit(100)))
    received = F.concat(F.lit(f"تلقّت {entity} "), F.when(receipt_only, "خطابكم").otherwise("شكواكم"), some(" رقم ", ref), some(" بتاريخ ", day), some(" بشأن «", F.left(subject, F.lit(120)), "»"))
    routed = F.concat(F.lit("، وقد أحالتها إلى "), F.coalesce(target, F.lit("الجهة المختصة")), some(" بأولوية ", priority), F.when(F.trim(F.coalesce(priority, F.lit(""))) != "", some("، ونتوقع الرد خلال ", term)).otherwise(""))
    body = F.when(receipt_only, F.concat(received, F.lit("، وسيُطّلع عليه."))).otherwise(F.concat(received, routed, F.lit(".")))
    ask = F.when(receipt_only, "ونأمل ذكر رقمه في أي تواصل لاحق.").otherwise("وسنوافيكم بما يستجد بشأنها، ونأمل ذكر رقم الشكوى في أي تواصل لاحق.")
    thanks = F.when(receipt_only, "شاكرين لكم تواصلكم، وتقبلوا خالص التحية والتقدير.").otherwise("شاكرين لكم تواصلكم وحرصكم، وتقبلوا خالص التحية والتقدير.")
    return F.concat_ws("\n", F.concat(F.lit("المكرم/ة "), who), F.lit("السلام عليكم ورحمة الله وبركاته، وبعد:"), F.lit(""), body, ask, F.lit(""), thanks, F.lit(f"{desk} — {entity}"))


def document_room(window: int, answer: int, fixed_tokens: Column, overhead: int = 1200, per_token: float = 2.0, least: int = 600) -> Column:
    """Characters of a document that fit beside an answer and the fixed part of a prompt in a model's window."""
    budget = max(1500, min(12000, int((window - answer - overhead) * per_token)))
    return F.greatest(F.lit(least), F.lit(budget) - F.floor(F.greatest(F.lit(0), fixed_tokens - overhead) * per_token)).cast("int")


#: Limits of retrieval: cosine, cosine with the lexical part, that part at most, and the best passages that a clause keeps.
MIN_COSINE, MIN_SCORE, MOST_LEXICAL, BEST = 0.50, 0.60, 0.12, 3


def qualifying_clauses(pairs: DataFrame, doc: str) -> DataFrame:
    """Of scored pairs (doc, passage, clause, cosine, lexical, exact), each qualifying clause once: best score, its best passages, their number.

    An exact excerpt qualifies, or a cosine and a score high enough; nothing is cut by rank but the passages shown.
    """
    score = F.col("cosine") + F.least(F.col("lexical"), F.lit(MOST_LEXICAL))
    good = pairs.withColumn("score", score).where(F.col("exact") | ((F.col("cosine") >= MIN_COSINE) & (F.col("score") >= MIN_SCORE)))
    rank = F.row_number().over(Window.partitionBy(doc, "clause").orderBy(F.desc("score"), "passage"))
    placed = good.withColumn("rank", rank)
    best = F.array_sort(F.collect_list(F.when(F.col("rank") <= BEST, F.struct("rank", "passage"))))
    return placed.groupBy(doc, "clause").agg(F.max("score").alias("score"), F.transform(best, lambda x: x["passage"]).alias("passages"), F.count("*").alias("n"))


def retrieved(passages: DataFrame, clauses: DataFrame, k: int = 50) -> DataFrame:
    """(doc, clause, score, passages, n): regulations' clauses that a document's passages call up; ``passages`` (doc, passage, words, v), ``clauses`` (clause, words, v), unit vectors.

    Each passage meets its ``k`` nearest clauses; the share of a clause's words that a passage has counts up to MOST_LEXICAL on top of the cosine, and a passage that
    holds all of them in order is an exact excerpt. ``qualifying_clauses`` decides.
    """
    met = nearest(passages, clauses, "passage", "clause", "v", k).select(F.col("q").alias("passage"), F.col("r").alias("clause"), F.col("score").alias("cosine"))
    said = met.join(passages.select("doc", "passage", F.col("words").alias("__said")), "passage").join(clauses.select("clause", "words"), "clause")
    share = F.size(F.array_intersect("words", "__said")) / F.greatest(F.size(F.array_distinct("words")), F.lit(1))
    whole = (F.size("words") > 0) & F.contains(F.concat(F.lit(" "), F.array_join("__said", " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    return qualifying_clauses(said.select("doc", "passage", "clause", "cosine", (MOST_LEXICAL * share).alias("lexical"), whole.alias("exact")), "doc")


def register_functions(spark: SparkSession) -> None:
    """``cms_fold(text)`` in SQL: the search form, as a function of built-in expressions."""
    folds = X.FOLD_FROM + X.TATWEEL + X.MARKS + X.BIDI
    inner = f"trim(regexp_replace(translate(t, '{folds}', '{X.FOLD_TO}'), r'(?U)\\s+', ' '))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cms_fold(t STRING) RETURNS STRING DETERMINISTIC RETURN replace(translate(lower({inner}), 'ς', 'σ'), 'ß', 'ss')")


def embedded(df: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], size: int, batch: int = 64) -> DataFrame:
    """``df`` with an ``embedding`` from an injected model; vectors that are not finite, have no length or another dimension are null."""

    def embed(texts: pd.Series) -> pd.Series:
        out: list[list[float] | None] = []
        for i in range(0, len(texts), batch):
            part = texts.iloc[i : i + batch].tolist()
            got = model(part)
            if len(got) != len(part):
                raise ValueError("the model must give one vector a text")
            out += [v if len(v) == size and sum(x * x for x in v) > 0 and all(abs(x) < float("inf") for x in v) else None for v in got]
        return pd.Series(out)

    return df.withColumn("embedding", F.pandas_udf(embed, "array<double>")(F.col(text)))


def facts(trend: DataFrame, counts: DataFrame, outside: DataFrame, total: int, top: int = 5) -> DataFrame:
    """(fact, value) lines: sums of the last seven days and the seven before, the top categories with "k of n", and the outside breakdown if it adds up."""
    last = F.row_number().over(Window.orderBy(F.desc("day")))
    days = trend.withColumn("back", last).where(F.col("back") <= 14)
    sums = days.agg(F.sum(F.when(F.col("back") <= 7, F.col("n")).otherwise(0)).alias("recent7"), F.sum(F.when(F.col("back") > 7, F.col("n")).otherwise(0)).alias("prior7"))
    lines = sums.select(F.explode(F.create_map(F.lit("recent7"), F.col("recent7").cast("string"), F.lit("prior7"), F.col("prior7").cast("string"))).alias("fact", "value"))
    ranked = counts.orderBy(F.desc("n"), "id").limit(top).select(F.concat(F.lit("category "), "id").alias("fact"), F.concat_ws(" of ", F.col("n").cast("string"), F.lit(str(total))).alias("value"))
    whole = outside.agg(F.sum("n").alias("all"), F.max("stated").alias("stated")).where("all = stated")
    places = outside.join(F.broadcast(whole.select(F.lit(True).alias("ok")))).select(F.concat(F.lit("outside "), "region").alias("fact"), F.col("n").cast("string").alias("value"))
    return lines.unionByName(ranked).unionByName(places)
