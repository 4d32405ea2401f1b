"""Streams of case events. Times are cast to TIMESTAMP, as watermarks need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stages of a case and the steps allowed between them.
STAGES = ("queued", "ocr", "structuring", "classifying", "done", "error")
STEPS = {
    "queued": ("ocr", "structuring", "error"), "ocr": ("structuring", "queued", "error"), "structuring": ("classifying", "queued", "error"), "classifying": ("done", "queued", "error"),
    "done": ("queued",), "error": ("queued",),
}
MAX_ATTEMPTS = 3
#: How often a busy model is asked again, and how long after.
BUSY_TRIES, BUSY_SECONDS = 3, 5


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream; new files are new events."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts by event-time window and type; late events within ``delay`` still count."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def intake_once(events: DataFrame, key: str, delay: str) -> DataFrame:
    """First event of each key within the watermark; the state stays bounded."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def settle(current: DataFrame, new: DataFrame) -> DataFrame:
    """Re-analysis merged into the register: reviewed rows keep their values, an empty new text never blanks an old one."""
    n = new.select("id", *(F.col(c).alias(f"new_{c}") for c in ("category", "text")))
    j = current.join(n, "id", "left")
    return j.select(
        "id", "reviewed",
        F.when(F.col("reviewed"), F.col("category")).otherwise(F.coalesce("new_category", "category")).alias("category"),
        F.when(F.coalesce(F.trim("new_text"), F.lit("")) == "", F.col("text")).otherwise(F.col("new_text")).alias("text"),
    )


def claim(queue: DataFrame, most: int) -> DataFrame:
    """The oldest queued cases with attempts left, marked as claimed."""
    return queue.where((F.col("stage") == "queued") & (F.col("attempts") < MAX_ATTEMPTS)).orderBy("created_at", "id").limit(most).withColumn("stage", F.lit("ocr")).withColumn("attempts", F.col("attempts") + 1)


def recover(queue: DataFrame) -> DataFrame:
    """After a stop, unfinished cases queue again, or fail when their attempts are used up."""
    busy = F.col("stage").isin("ocr", "structuring", "classifying")
    return queue.withColumn("stage", F.when(busy & (F.col("attempts") >= MAX_ATTEMPTS), "error").when(busy, "queued").otherwise(F.col("stage")))


def without_cases(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Cascade delete: each table without the rows of the ids in ``gone``."""
    return {k: df.join(gone.select(F.col("id").alias("__gone")), F.col(c) == F.col("__gone"), "left_anti") for k, (df, c) in tables.items()}


def may_step(old: Column, new: Column) -> Column:
    """Whether a case may go from one stage to another."""
    table = F.create_map(*[x for k, v in STEPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(table, old), new), F.lit(False))


def step(queue: DataFrame, moves: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """The queue after moves (id, to), and the log (id, old, new, at) of those that were allowed; others change nothing."""
    j = queue.join(moves, "id", "left").withColumn("__ok", F.col("to").isNotNull() & may_step(F.col("stage"), F.col("to")))
    log = j.where("__ok").select("id", F.col("stage").alias("old"), F.col("to").alias("new"), at.alias("at"))
    return j.withColumn("stage", F.when(F.col("__ok"), F.col("to")).otherwise(F.col("stage"))).drop("to", "__ok"), log


def after_run(runs: DataFrame, now: Column) -> DataFrame:
    """Runs (id, outcome, busy_tries, reloaded, attempts) with what comes next: stage, and when the case may be tried again.

    A busy model is asked again a few times, then loaded once more; a failed run queues again until its attempts are used up.
    """
    again = (F.col("outcome") == "busy") & (F.col("busy_tries") < BUSY_TRIES)
    reload = (F.col("outcome") == "busy") & ~again & ~F.col("reloaded")
    over = F.col("attempts") >= MAX_ATTEMPTS
    stage = F.when(F.col("outcome") == "ok", "done").when(again | reload | ~over, "queued").otherwise("error")
    wait = F.when(again, now + F.make_dt_interval(secs=F.lit(BUSY_SECONDS).cast("decimal(18,6)"))).otherwise(now)
    return runs.select(
        "*", stage.alias("stage"), F.when(stage == "queued", wait).alias("not_before"), (F.col("busy_tries") + again.cast("int")).alias("tries"), (F.col("reloaded") | reload).alias("was_reloaded")
    )


def kept_reviews(reviews: DataFrame, fields: DataFrame) -> DataFrame:
    """Field reviews (id, key, action, value) that outlive a new analysis (id, key, value): typed values do, an accepted value only if it is the same again."""
    j = reviews.join(fields.select("id", "key", F.col("value").alias("__new")), ["id", "key"], "left")
    return j.where((F.col("action") != "accept") | F.col("value").eqNullSafe(F.col("__new"))).drop("__new")


def progress(spark: SparkSession, group: str) -> dict[str, int]:
    """Stages and tasks of the jobs of a group, for progress events; ``spark.sparkContext.cancelJobGroup(group)`` stops them."""
    tracker = spark.sparkContext.statusTracker()
    infos = [i for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds if (i := tracker.getStageInfo(s))]
    return {"stages": len(infos), "tasks": sum(i.numTasks for i in infos), "done": sum(i.numCompletedTasks for i in infos)}
