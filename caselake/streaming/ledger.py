"""An event-sourced register: analyses, verdicts, field reviews and status changes folded into the current row of each case.

The fold is one expression over a case's events in order. ``Ledger`` keeps the rows as Parquet in buckets of cases, written by ``foreachBatch``: a batch rewrites
only the buckets that it touches, and each row carries the number of the last batch that changed it, so that a batch that comes again, whole or in part, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Reasons that send a reviewed case back, the one that field reviews answer, the one of a text without words, and what a reviewer may do.
REVIEW_AGAIN, FIELDS_UNVERIFIED, EMPTY_TEXT = ("empty_text", "not_a_complaint", "input_truncated"), "fields_unverified", "empty_text"
KINDS = ("created", "processed", "feedback", "field_review", "status")
#: Values that the model gives and a verdict may change; and those that an empty text never blanks.
DECIDED, TOLD = ("category", "ministry", "priority", "region"), ("subject", "summary")

EVENT = "struct<at:timestamp,seq:bigint,kind:string,values:map<string,string>,reasons:array<string>,fields:array<struct<key:string,value:string,verified:boolean>>>"
STATE = (
    "struct<status:string,reviewed:boolean," + ",".join(f"{c}:string" for c in (*DECIDED, *(f"model_{c}" for c in DECIDED), *TOLD)) + ",due_at:timestamp,reasons:array<string>,"
    "fields:array<struct<key:string,value:string,verified:boolean>>,reviews:map<string,struct<action:string,value:string>>,pending:int,needs_review:boolean,updated_at:timestamp,events:bigint>"
)


def blank_state() -> Column:
    """A case before its first event."""
    return F.from_json(F.lit('{"reviewed": false, "reasons": [], "fields": [], "reviews": {}, "pending": 0, "needs_review": false, "events": 0}'), STATE)


def _open(fields: Column, reviews: Column) -> Column:
    """Fields with a value that the text does not carry and nobody has reviewed."""
    return F.size(F.filter(fields, lambda f: ~F.map_contains_key(reviews, f["key"]) & f["verified"].eqNullSafe(F.lit(False)) & (F.trim(F.coalesce(f["value"], F.lit(""))) != "")))


def _field(fields: Column, key: Column) -> Column:
    return F.get(F.filter(fields, lambda f: f["key"] == key), 0)


def step(s: Column, e: Column) -> Column:
    """The state after an event; an event of no known kind only counts.

    An analysis moves what the model says, and the case's own values until a verdict is given; after that it only fills gaps and may send the case back by a reason not seen
    before. Accepted values outlive it only if it gives them again, changed ones always. An analysis of an empty text blanks nothing.
    A verdict sets values and marks the case reviewed; a review of a field that the case does not have changes nothing.
    """
    given = lambda k: F.try_element_at(e["values"], F.lit(k))
    analysed, judged, settled = e["kind"] == "processed", e["kind"] == "feedback", e["kind"] == "status"
    key = given("key")
    noted = (e["kind"] == "field_review") & F.coalesce(_field(s["fields"], key).isNotNull() & given("action").isin("accept", "change"), F.lit(False))
    fields = F.when(analysed, F.coalesce(e["fields"], s["fields"])).otherwise(s["fields"])
    reasons = F.when(analysed, F.coalesce(e["reasons"], F.array().cast("array<string>"))).otherwise(s["reasons"])
    shown = F.coalesce(F.try_element_at(s["reviews"], key)["value"], _field(s["fields"], key)["value"], F.lit(""))
    review = F.struct(given("action").alias("action"), F.when(given("action") == "accept", shown).otherwise(given("value")).alias("value"))
    others = F.map_filter(s["reviews"], lambda k, _: k != F.coalesce(key, F.lit("")))
    still = F.map_filter(s["reviews"], lambda k, r: (r["action"] == "change") | r["value"].eqNullSafe(_field(e["fields"], k)["value"]))
    reviews = F.when(analysed, still).when(noted, F.map_concat(others, F.create_map(key, review))).otherwise(s["reviews"])
    pending = F.when(analysed | noted, _open(fields, reviews)).otherwise(s["pending"])
    reviewed = s["reviewed"] | judged
    back = F.array(*map(F.lit, REVIEW_AGAIN))
    unseen = F.size(F.array_except(F.array_intersect(reasons, back), s["reasons"])) > 0
    waits = s["reviewed"] & s["needs_review"] & ((s["pending"] == 0) | F.arrays_overlap(reasons, back))
    unanswered = ~s["reviewed"] & F.exists(reasons, lambda r: r != FIELDS_UNVERIFIED)
    needs = (
        F.when(analysed, (pending > 0) | (s["reviewed"] & unseen) | unanswered).when(judged, pending > 0).when(noted, (pending > 0) | waits | unanswered).otherwise(s["needs_review"])
    )
    due = given("due_at").try_cast("timestamp")
    out = {"status": F.when(settled & (F.coalesce(given("status"), F.lit("")) != ""), given("status")).otherwise(F.coalesce(s["status"], F.when(e["kind"] == "created", "new"))), "reviewed": reviewed}
    for c in DECIDED:
        # a reviewed case keeps its value; a region that it never had is filled
        kept = F.coalesce(s[c], given(c)) if c == "region" else s[c]
        verdict = F.when(F.map_contains_key(e["values"], c), F.nullif(given(c), F.lit(""))).otherwise(s[c])
        out[c] = F.when(analysed, F.when(s["reviewed"], kept).otherwise(given(c))).when(judged, verdict).otherwise(s[c])
    for c in DECIDED:
        out[f"model_{c}"] = F.when(analysed, given(c)).otherwise(s[f"model_{c}"])
    for c in TOLD:
        new = F.coalesce(given(c), F.lit(""))
        out[c] = F.when(analysed, F.when(F.array_contains(reasons, EMPTY_TEXT) & (new == ""), s[c]).otherwise(new)).otherwise(s[c])
    out |= {
        "due_at": F.when(analysed, F.when(s["reviewed"], F.coalesce(s["due_at"], due)).otherwise(due)).when(judged, F.coalesce(due, s["due_at"])).otherwise(s["due_at"]),
        "reasons": reasons, "fields": fields, "reviews": reviews, "pending": pending, "needs_review": needs,
        "updated_at": F.greatest(s["updated_at"], e["at"]), "events": s["events"] + 1,
    }
    return F.struct(*(v.alias(k) for k, v in out.items())).cast(STATE)


def as_events(df: DataFrame) -> DataFrame:
    """Rows (id, at, seq, kind, values, reasons, fields) as (id, event)."""
    return df.select("id", F.struct("at", "seq", "kind", "values", "reasons", "fields").cast(EVENT).alias("event"))


def fold(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(id, state) after (id, event), by time and number; from ``state`` (id, state) on, or from nothing."""
    when = lambda x: F.struct(x["at"], x["seq"])
    in_time = lambda a, b: F.when(when(a) < when(b), -1).when(when(a) > when(b), 1).otherwise(0)
    by = events.groupBy("id").agg(F.array_sort(F.collect_list("event"), in_time).alias("todo"))
    if state is not None:
        by = by.join(state.select("id", "state"), "id", "full")
    else:
        by = by.withColumn("state", F.lit(None).cast(STATE))
    todo = F.coalesce("todo", F.array().cast(f"array<{EVENT}>"))
    return by.select("id", F.aggregate(todo, F.coalesce("state", blank_state()), step).alias("state"))


class Ledger:
    """The register's table under a path, in ``buckets`` parts by a hash of the id."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def read(self) -> DataFrame | None:
        """(id, state, batch, bucket); None before the first batch."""
        return self.spark.read.parquet(self.path) if self._exists() else None

    def apply(self, events: DataFrame, batch: int) -> None:
        """Fold a batch of events (id, event) in. Cases that already hold this batch or a later one are left as they are."""
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        events = events.withColumn("bucket", bucket)
        now = self.read()
        if now is None:
            done = fold(events).withColumn("batch", F.lit(batch).cast("long"))
        else:
            touched = now.join(F.broadcast(events.select("bucket").distinct()), "bucket", "left_semi")  # at most ``buckets`` rows
            fresh = events.join(touched.where(F.col("batch") >= batch).select("id"), "id", "left_anti")
            folded = fold(fresh, touched.select("id", "state"))
            changed = fresh.select("id").distinct().withColumn("__new", F.lit(True))
            done = folded.join(touched.select("id", "batch"), "id", "left").join(changed, "id", "left")
            done = done.select("id", "state", F.when(F.col("__new"), batch).otherwise(F.col("batch")).cast("long").alias("batch"))
        # one task a bucket at least, and only the buckets written here are replaced
        done.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def follow(self, events: DataFrame, checkpoint: str):
        """A writer that folds each micro-batch of a stream of events (id, event) in; start it with a trigger of choice."""
        return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: self.apply(df, batch))
