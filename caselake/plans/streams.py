"""Queries of the stage machine and of the event-sourced register over the events table, against recursive and closed-form SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..streaming import ledger as L
from ..streaming import stages as S
from .checks import query_into

QUERIES, ORACLES = {}, {}
query = query_into(QUERIES, ORACLES)

#: The message that an event stands for, and the seconds that a busy model is left alone.
MESSAGE, WAIT = "CASE event_type WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'advance' WHEN 'error' THEN 'busy' WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'fail' ELSE 'stop' END END", 40_000


@query(f"""WITH RECURSIVE e AS (SELECT max(epoch_us(ts)) AS t FROM events), a AS (SELECT user_id AS id, epoch_us(ts) AS t, event_id AS seq, {MESSAGE} AS message FROM events UNION ALL SELECT DISTINCT user_id, e.t, 9000000000000000000, '' FROM events, e),
 m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, seq) AS n FROM a),
 r(id, n, stage, attempts, busy, reloaded, due, steps) AS (SELECT DISTINCT id, 0::BIGINT, '', 0, 0, false, NULL::BIGINT, 0 FROM m UNION ALL
 SELECT id, n, CASE what WHEN 'submitted' THEN 'queued' WHEN 'claimed' THEN 'ocr' WHEN 'well' THEN CASE stage WHEN 'ocr' THEN 'structuring' WHEN 'structuring' THEN 'classifying' ELSE 'done' END WHEN 'settled' THEN CASE WHEN attempts >= 3 THEN 'error' ELSE 'queued' END ELSE stage END,
 CASE what WHEN 'submitted' THEN 0 WHEN 'claimed' THEN attempts + 1 ELSE attempts END, CASE what WHEN 'busy' THEN busy + 1 WHEN 'reloaded' THEN 0 WHEN 'settled' THEN 0 WHEN 'submitted' THEN 0 ELSE busy END,
 CASE what WHEN 'reloaded' THEN true WHEN 'settled' THEN false WHEN 'submitted' THEN false ELSE reloaded END, CASE what WHEN 'busy' THEN t + {WAIT}000000 WHEN 'settled' THEN NULL WHEN 'submitted' THEN NULL ELSE open END,
 steps + CASE WHEN what IS NULL THEN 0 ELSE 1 END + CASE WHEN fires THEN 1 ELSE 0 END FROM (SELECT *, CASE WHEN message = 'submit' AND stage IN ('', 'done', 'error') THEN 'submitted' WHEN message = 'claim' AND stage = 'queued' THEN 'claimed'
 WHEN stage NOT IN ('ocr', 'structuring', 'classifying') THEN NULL WHEN message IN ('fail', 'stop') THEN 'settled' WHEN open IS NOT NULL THEN NULL WHEN message = 'advance' THEN 'well'
 WHEN message = 'busy' THEN CASE WHEN busy < 3 THEN 'busy' WHEN NOT reloaded THEN 'reloaded' ELSE 'settled' END END AS what
 FROM (SELECT r.id, m.n, r.stage, r.attempts, r.busy, r.reloaded, r.steps, m.t, m.message, coalesce(r.due <= m.t, false) AS fires, CASE WHEN r.due <= m.t THEN NULL ELSE r.due END AS open FROM r JOIN m ON m.id = r.id AND m.n = r.n + 1)))
 SELECT id, stage, attempts, steps::BIGINT AS steps FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS last FROM r) WHERE last = 1 AND steps > 0""")
def stage_states(spark, sf):
    """Where the stage machine leaves each case, after how many attempts and steps; retries of a busy model fire in event time."""
    messages = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.expr(MESSAGE).alias("message"))
    return S.final_states(S.batch_log(messages, WAIT))


@query("""WITH e AS (SELECT user_id AS id, event_type AS k, event_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), v AS (SELECT id, min(n) AS n FROM e WHERE k = 'click' GROUP BY id),
 p AS (SELECT e.*, coalesce(e.n < v.n, true) AS before, lag(s) OVER (PARTITION BY e.id ORDER BY e.n) AS earlier FROM e LEFT JOIN v USING (id) WHERE k = 'view'),
 f AS (SELECT id, arg_max('f' || s % 7, n) FILTER (s % 2 = 0) AS category, max(n) AS n FROM e WHERE k = 'click' GROUP BY id),
 g AS (SELECT id, arg_max('c' || s % 5, n) FILTER (before) AS category, arg_max('c' || s % 5, n) AS model_category, arg_max(CASE WHEN s % 4 = 0 THEN '' ELSE 's' || s END, n) FILTER (s % 12 <> 0) AS subject,
  max(CASE WHEN before THEN n END) AS last_before, arg_min('r' || s % 2, n) FILTER (NOT before AND s % 3 <> 0) AS later_region, arg_max(s, n) FILTER (before) AS b, arg_min(s, n) FILTER (NOT before) AS a, max(n) AS n,
  arg_max(CASE WHEN before THEN s % 6 < 2 ELSE s % 6 = 0 AND coalesce(earlier % 6 <> 0, true) END, n) AS needs FROM p GROUP BY id),
 t AS (SELECT id, arg_max('open' || s % 3, n) FILTER (k = 'purchase') AS status, bool_or(k = 'signup') AS made, count(*) AS events FROM e GROUP BY id)
 SELECT t.id, coalesce(t.status, CASE WHEN made THEN 'new' END) AS status, f.n IS NOT NULL AS reviewed, coalesce(f.category, g.category) AS category, model_category, subject,
 coalesce(CASE WHEN b % 3 <> 0 THEN 'r' || b % 2 END, later_region) AS region, TIMESTAMP '2026-01-01 00:00:00' + to_days((coalesce(b, a) % 300)::INT) AS due_at, CASE WHEN g.n IS NULL OR f.n > g.n THEN false ELSE needs END AS needs_review, t.events
 FROM t LEFT JOIN f USING (id) LEFT JOIN g USING (id)""")
def register_ledger(spark, sf):
    """The register folded from its events: analyses move what is not reviewed, verdicts stay, an empty text blanks nothing, unseen reasons send a case back."""
    s, kind = F.col("event_id"), F.col("event_type")
    text = lambda prefix, n: F.concat(F.lit(prefix), (s % n).cast("string"))
    due = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (s % 300).cast("int")), "yyyy-MM-dd 00:00:00")
    some = lambda *pairs: F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(v for _, v in pairs))), lambda _, v: v.isNotNull())
    analysis = some(("category", text("c", 5)), ("region", F.when(s % 3 != 0, text("r", 2))), ("subject", F.when(s % 4 == 0, "").otherwise(F.concat(F.lit("s"), s.cast("string")))), ("due_at", due))
    values = F.when(kind == "view", analysis).when(kind == "click", some(("category", F.when(s % 2 == 0, text("f", 7))))).when(kind == "purchase", some(("status", text("open", 3)))).otherwise(some(("key", F.lit("x")), ("action", F.lit("accept"))))
    kinds = F.create_map(*(F.lit(x) for pair in {"signup": "created", "view": "processed", "click": "feedback", "purchase": "status", "error": "field_review"}.items() for x in pair))
    reasons = F.array_compact(F.array(F.when(s % 6 == 0, "empty_text").when(s % 6 == 1, "low_confidence").when(s % 6 == 2, "fields_unverified")))
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), s.alias("seq"), F.try_element_at(kinds, kind).alias("kind"), values.alias("values"), reasons.alias("reasons"),
        F.array().cast("array<struct<key:string,value:string,verified:boolean>>").alias("fields"),
    )
    done = L.fold(L.as_events(events))
    return done.select("id", *(f"state.{c}" for c in ("status", "reviewed", "category", "model_category", "subject", "region")), F.col("state.due_at").cast("timestamp_ntz").alias("due_at"), "state.needs_review", "state.events")
