"""The streaming shapes run over tables; tests hold streams against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import sessions
from .base import literal, query, table


REQUESTS = [(1, '{"id": "a", "text": "AP 장애"}'), (2, '{"id": "b"}'), (3, "{broken"), (4, '{"id": 4, "text": ""}'), (5, "")]


@query("x01_requests", "SELECT n, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.id') END AS id, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.text') END AS text, CASE WHEN NOT json_valid(raw) THEN 'INVALID_JSON' WHEN json_extract_string(raw, '$.text') IS NULL THEN 'MISSING_TEXT' ELSE 'OK' END AS status FROM " + literal(REQUESTS, "n", "raw"))
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request or an error for each line; none stops the loop."""
    lines = spark.createDataFrame(REQUESTS, "n int, value string")
    return sessions.records(lines, "n")


@query("ext_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: event-time windows."""
    out = sessions.windowed_counts(table(spark, sf_dir, "events"), "1 hour", "1 hour", F.col("event_type"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "key", "n", F.round("total", 4).alias("total"))


@query("ext_sessions", """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) x) y GROUP BY user_id, s""")
def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: session windows."""
    return sessions.sessions(table(spark, sf_dir, "events"), "30 minutes", "1 hour").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


TWICE = [("d", 0, 2), ("d", 0, 2), ("d", 5, 9), ("e", 0, 2)]


@query("x05_deduplicated", f'SELECT DISTINCT doc_id, start, "end" FROM {literal(TWICE, "doc_id", "start", chr(34) + "end" + chr(34))}')
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.deduplicated(spark.createDataFrame(TWICE, "doc_id string, start int, end int"), "1 hour")


@query("x02_gap_state", "SELECT user_id AS entity_id, event_type AS residual, count(*) AS occurrences, count(DISTINCT event_id % 10) AS documents FROM events GROUP BY ALL")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.gaps(table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("residual"), (F.col("event_id") % 10).alias("doc_id")))


ACTIVATIONS = [("t1", "s1", 10), ("t1", "s2", 20), ("t1", "s3", 30), ("t2", "s4", 15)]
JOBS = [("j1", "t1", 9), ("j2", "t1", 10), ("j3", "t1", 25), ("j4", "t2", 99), ("j5", "t3", 50)]


@query("x03_pinned_snapshots", f"SELECT job, arg_max(s, moment) AS snapshot FROM {literal(JOBS, 'job', 'tenant', 'begun')} LEFT JOIN {literal(ACTIVATIONS, 'tenant', 's', 'moment').replace('AS t(', 'AS a(')} ON t.tenant = a.tenant AND moment <= begun GROUP BY job")
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that was active when a job began stays the job's: null where there was none."""
    return sessions.pinned(spark.createDataFrame(JOBS, "job string, tenant string, begun int"), spark.createDataFrame(ACTIVATIONS, "tenant string, snapshot string, at int"))


@query("x03_pinned_by_user", "SELECT j.event_id AS job, a.event_id AS snapshot FROM (SELECT * FROM events WHERE event_type = 'purchase') j ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') a ON j.user_id = a.user_id AND j.ts >= a.ts")
def x03_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as activations of a user, purchases as jobs."""
    events = table(spark, sf_dir, "events")
    jobs = events.where("event_type = 'purchase'").select(F.col("event_id").alias("job"), F.col("user_id").alias("tenant"), F.col("ts").alias("begun"))
    return sessions.pinned(jobs, events.where("event_type = 'signup'").select(F.col("user_id").alias("tenant"), F.col("event_id").alias("snapshot"), F.col("ts").alias("at")))


@query("x07_active_by_user", "SELECT user_id AS tenant, arg_max(event_id, ts) AS snapshot, count(*) AS activations FROM events WHERE event_type = 'signup' GROUP BY 1")
def x07_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return rows.groupBy(F.col("user_id").alias("tenant")).agg(F.max_by("event_id", "ts").alias("snapshot"), F.count("*").alias("activations"))


@query("x07_active_snapshots", f"SELECT tenant, arg_max(s, moment) AS snapshot, count(*) AS activations FROM {literal(ACTIVATIONS, 'tenant', 's', 'moment')} GROUP BY tenant")
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One active snapshot a tenant: the last activation of an append-only log."""
    rows = spark.createDataFrame(ACTIVATIONS, "tenant string, snapshot string, at int")
    return rows.groupBy("tenant").agg(F.max_by("snapshot", "at").alias("snapshot"), F.count("*").alias("activations"))


PROVISIONAL = [("p1", 1), ("p2", 5), ("p3", 20), ("p4", 21), ("p5", None)]


@query("x06_expired", f"SELECT id, 25 - turn >= 20 AS expired FROM {literal(PROVISIONAL, 'id', 'turn')} WHERE turn IS NOT NULL")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional terms expire twenty turns after they were put in; terms without a turn are not provisional."""
    return sessions.expired(spark.createDataFrame(PROVISIONAL, "id string, turn int"), F.lit(25))


@query("x06_expired_terms", """
SELECT p.user_id AS tenant, p.event_id AS id, l.event_id AS expired_by
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) p
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) l ON l.user_id = p.user_id AND l.turn = p.turn + 20
WHERE p.event_type = 'signup'""")
def x06_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a turn of its user, each signup puts in a term: the event by which it expires, null if it lives."""
    return sessions.expired_by(turns_of(table(spark, sf_dir, "events")))


def turns_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("tenant"), "ts", F.col("event_id").alias("n"), F.when(F.col("event_type") == "signup", F.col("event_id")).alias("id"))


def steps_of(events: DataFrame) -> DataFrame:
    """A user's events of a day as those of a job: job, ts, n, event."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return events.select(F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("job"), "ts", F.col("event_id").alias("n"), F.try_element_at(kinds, F.col("event_type")).alias("event"))


KINDS = {"view": "start", "click": "start", "purchase": "finish", "error": "fail", "signup": "cancel"}


@query("x04_job_histories", """
WITH steps AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS job, event_id AS n, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'cancel' END AS event FROM events),
begun AS (SELECT job, count(*) AS n_events, min(n) FILTER (event = 'start') AS s, min(n) FILTER (event = 'cancel') AS c FROM steps GROUP BY job),
ended AS (SELECT b.job, arg_min(event, n) AS e FROM begun b JOIN steps t ON t.job = b.job AND n > s AND event IN ('finish', 'fail', 'cancel') WHERE c IS NULL OR s < c GROUP BY b.job)
SELECT b.job, CASE WHEN c IS NOT NULL AND (s IS NULL OR c < s) THEN 'CANCELLED' WHEN s IS NULL THEN 'QUEUED' WHEN e = 'finish' THEN 'SUCCEEDED' WHEN e = 'fail' THEN 'FAILED' WHEN e = 'cancel' THEN 'CANCELLED' ELSE 'RUNNING' END AS state,
  n_events - CASE WHEN c IS NOT NULL AND (s IS NULL OR c < s) THEN 1 WHEN s IS NULL THEN 0 WHEN e IS NULL THEN 1 ELSE 2 END AS refused
FROM begun b LEFT JOIN ended USING (job)""")
def x04_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user's day as those of a job, hours folded by themselves and chained."""
    steps = steps_of(table(spark, sf_dir, "events"))
    return sessions.job_states(steps, F.date_trunc("hour", "ts"))


STEPS = [("j1", 1, "start"), ("j1", 2, "finish"), ("j2", 1, "start"), ("j2", 2, "cancel"), ("j2", 3, "finish"), ("j3", 1, "finish"), ("j4", 1, "cancel"), ("j5", 1, "start"), ("j5", 2, "fail"), ("j5", 3, "start"), ("j6", 1, "start")]


@query("x04_job_states", "SELECT * FROM " + literal([("j1", "SUCCEEDED", 0), ("j2", "CANCELLED", 1), ("j3", "QUEUED", 1), ("j4", "CANCELLED", 0), ("j5", "FAILED", 1), ("j6", "RUNNING", 0)], "job", "state", "refused"))
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of jobs after their events in order; events that a state does not allow are refused and counted."""
    return sessions.job_states(spark.createDataFrame(STEPS, "job string, n int, event string"))


@query("x08_audit_log", f"SELECT job || ':' || n || ':' || event AS line FROM {literal(STEPS, 'job', 'n', 'event')}")
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each event, none of them changed later."""
    return spark.createDataFrame(STEPS, "job string, n int, event string").select(F.concat_ws(":", "job", "n", "event").alias("line"))
