"""Streams against batch: the stage machine after a restart, and the event-sourced register after replays."""

import random

import pytest
from pyspark.sql import functions as F

from caselake.streaming import ledger, stages

from .conftest import SMALL

WORDS = "CASE event_type WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'advance' WHEN 'error' THEN 'busy' ELSE IF(event_id % 2 = 0, 'fail', 'stop') END"


def messages(df):
    return df.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.expr(WORDS).alias("message"))


@pytest.mark.parametrize("wait", [5, 40_000])
def test_stage_stream_equals_batch_after_a_restart(spark, tmp_path, wait):
    events = spark.read.parquet(f"{SMALL}/events.parquet").where("user_id < 40").orderBy("ts", "event_id").collect()
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        log = stages.stream_log(messages(stream), wait, "1 second")
        q = log.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None

    thirds = [events[i * len(events) // 3 : (i + 1) * len(events) // 3] for i in range(3)]
    for part in thirds:  # each run is a restart from the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        run()
    batch = stages.batch_log(messages(spark.read.parquet(src)), wait)
    entries = lambda df: sorted(map(repr, df.select("id", "at", "old", "new", "attempts", "why").collect()))
    got, want = entries(spark.read.parquet(out)), entries(batch)
    # timers that the watermark has not passed stay open in the stream
    assert set(got) <= set(want) and all("asked again" in x for x in set(want) - set(got)) and len(want) - len(got) <= 40
    whys = {r["why"] for r in batch.select("why").distinct().collect()}
    assert whys >= {"submitted", "claimed", "went well", "busy", "asked again", "failed", "interrupted"}
    assert stages.final_states(batch).where("stage not in ('queued', 'ocr', 'structuring', 'classifying', 'done', 'error')").count() == 0


def test_busy_cases_are_reloaded_once_then_settled():
    case = stages.Case()
    told = [(e[1], e[2], e[4]) for e in stages.fold(case, [(0, "submit"), (1, "claim"), *((10 * i, "busy") for i in range(1, 10))], 5)]
    assert told[:2] == [("", "queued", "submitted"), ("queued", "ocr", "claimed")]
    assert [w for *_, w in told[2:]] == ["busy", "asked again"] * 3 + ["reloaded"] + ["busy", "asked again"] * 3 + ["busy too long"] and case.stage == "queued"
    case.attempts = 3
    case.stage = "classifying"
    assert [e[2] for e in stages.fold(case, [(200, "fail")], 5)] == ["error"]


ROWS = "id long, at timestamp, seq long, kind string, values map<string,string>, reasons array<string>, fields array<struct<key:string,value:string,verified:boolean>>"


def random_events(n, seed):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        kind = rng.choice(["created", "processed", "processed", "feedback", "field_review", "field_review", "status", "odd"])
        values, reasons, fields = {}, None, None
        if kind == "processed":
            values = {c: rng.choice("abc") for c in ledger.DECIDED if rng.random() < 0.8} | {"subject": rng.choice(["", "s1", "s2"]), "due_at": f"2026-01-{rng.randint(1, 28):02} 00:00:00"}
            reasons = rng.sample([*ledger.REVIEW_AGAIN, ledger.FIELDS_UNVERIFIED, "low_confidence"], rng.randrange(4))
            fields = [(k, rng.choice(["1", "2", ""]), rng.choice([True, False, None])) for k in ("name", "phone")]
        elif kind == "feedback":
            values = {c: rng.choice(["x", "y", ""]) for c in ledger.DECIDED if rng.random() < 0.4}
        elif kind == "field_review":
            values = {"key": rng.choice(["name", "phone", "none"]), "action": rng.choice(["accept", "change", "bad"]), "value": rng.choice(["1", "9"])}
        elif kind == "status":
            values = {"status": rng.choice(["open", "closed", ""])}
        out.append((rng.randrange(6), f"2026-02-01 00:00:{seq % 60:02}", seq, kind, values, reasons, fields))
    return out


def fold_by_hand(events):
    state = {}
    for id_, at, seq, kind, v, reasons, fields in sorted(events, key=lambda e: (e[1], e[2])):
        s = state.setdefault(id_, {"reviewed": False, "reasons": [], "fields": [], "reviews": {}, "pending": 0, "needs": False, "events": 0, "status": None, "subject": None, **dict.fromkeys(ledger.DECIDED)})
        s["events"] += 1
        open_ = lambda: sum(f[0] not in s["reviews"] and f[2] is False and bool((f[1] or "").strip()) for f in s["fields"])
        if kind == "created":
            s["status"] = s["status"] or "new"
        elif kind == "status" and v["status"]:
            s["status"] = v["status"]
        elif kind == "processed":
            unseen = (set(reasons) & set(ledger.REVIEW_AGAIN)) - set(s["reasons"])
            given = {f[0]: f[1] for f in fields}
            s["reviews"] = {k: r for k, r in s["reviews"].items() if r[0] == "change" or given.get(k) == r[1]}
            s["fields"], s["reasons"] = fields, reasons
            s["pending"] = open_()
            if not (("empty_text" in reasons) and not v["subject"]):
                s["subject"] = v["subject"]
            if s["reviewed"]:
                s["region"] = s["region"] or v.get("region")
                s["needs"] = s["pending"] > 0 or bool(unseen)
            else:
                s.update({c: v.get(c) for c in ledger.DECIDED})
                s["needs"] = s["pending"] > 0 or any(r != "fields_unverified" for r in reasons)
        elif kind == "feedback":
            s.update({c: v[c] or None for c in ledger.DECIDED if c in v}, reviewed=True, needs=s["pending"] > 0)
        elif kind == "field_review" and v["action"] != "bad" and any(f[0] == v["key"] for f in s["fields"]):
            old = s["reviews"].get(v["key"], (None, next(f[1] for f in s["fields"] if f[0] == v["key"])))[1]
            again = s["reviewed"] and s["needs"] and (not s["pending"] or bool(set(s["reasons"]) & set(ledger.REVIEW_AGAIN)))
            s["reviews"] = {**s["reviews"], v["key"]: (v["action"], old if v["action"] == "accept" else v["value"])}
            s["pending"] = open_()
            s["needs"] = s["pending"] > 0 or again or (not s["reviewed"] and any(r != "fields_unverified" for r in s["reasons"]))
    return {i: (s["status"], s["reviewed"], *(s[c] for c in ledger.DECIDED), s["subject"], s["pending"], s["needs"], s["events"], dict(s["reviews"])) for i, s in state.items()}


def as_told(df):
    return {r.id: (r.state.status, r.state.reviewed, *(r.state[c] for c in ledger.DECIDED), r.state.subject, r.state.pending, r.state.needs_review, r.state.events, {k: tuple(x) for k, x in r.state.reviews.items()}) for r in df.collect()}


def test_fold_against_a_loop(spark):
    events = random_events(400, 3)
    got = as_told(ledger.fold(ledger.as_events(spark.createDataFrame(events, ROWS.replace("at timestamp", "at string")).withColumn("at", F.to_timestamp("at")))))
    assert got == fold_by_hand(events)


def test_ledger_replays_change_nothing(spark, tmp_path):
    events = [(i, f"2026-02-{1 + n // 60:02} 00:00:{n % 60:02}", n, k, v, r, f) for n, (i, _, _, k, v, r, f) in enumerate(random_events(90, 4))]
    frame = ledger.as_events(spark.createDataFrame(events, ROWS.replace("at timestamp", "at string")).withColumn("at", F.to_timestamp("at")))
    book = ledger.Ledger(spark, str(tmp_path / "book"), buckets=4)
    parts = [frame.where((F.col("event.seq") >= a) & (F.col("event.seq") < a + 30)) for a in (0, 30, 60)]
    for n, part in enumerate(parts):
        book.apply(part, n)
        told = as_told(book.read())
        book.apply(part, n)
        if n:
            book.apply(parts[0], 0)
        assert as_told(book.read()) == told
    assert told == fold_by_hand(events) == as_told(ledger.fold(frame))


def test_ledger_follows_a_stream(spark, tmp_path):
    events = [(i, f"2026-02-01 00:0{n // 60}:{n % 60:02}", n, k, v, r, f) for n, (i, _, _, k, v, r, f) in enumerate(random_events(60, 5))]
    schema = ROWS.replace("at timestamp", "at string")
    src, check = str(tmp_path / "in"), str(tmp_path / "check")
    book = ledger.Ledger(spark, str(tmp_path / "book"), buckets=2)
    for part in (events[:30], events[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src).withColumn("at", F.to_timestamp("at"))
        q = book.follow(ledger.as_events(stream), check).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    assert as_told(book.read()) == fold_by_hand(events)
