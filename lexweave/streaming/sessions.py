"""Structured Streaming shapes of the stateful operators; each works on streams and on plain tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    """Event time must be a timestamp with a zone; others are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, length: str, late: str, key: Column, slide: str | None = None) -> DataFrame:
    """Counts and sums of event-time windows; rows later than ``late`` may be dropped on a stream."""
    held = _timed(events).withWatermark("ts", late)
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return held.groupBy(w.alias("w"), key.alias("key")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "key", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    held = _timed(events).withWatermark("ts", late)
    return held.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(mentions: DataFrame, late: str) -> DataFrame:
    """Mentions that overlapping chunks report twice, once."""
    if mentions.isStreaming:
        return mentions.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id", "start", "end"])
    return mentions.dropDuplicates(["doc_id", "start", "end"])


def gaps(mentions: DataFrame) -> DataFrame:
    """Occurrences and distinct documents of each (entity, residual); update mode on a stream.

    On a stream two aggregations in a row are not allowed in update mode, so the documents are a set in the state.
    """
    seen = F.size(F.collect_set("doc_id")).cast("bigint") if mentions.isStreaming else F.count_distinct("doc_id")
    return mentions.groupBy("entity_id", "residual").agg(F.count("*").alias("occurrences"), seen.alias("documents"))


def records(lines: DataFrame, *keep: str) -> DataFrame:
    """Requests from JSON lines (value): a record or an error for each."""
    v = F.try_parse_json("value")
    text = F.try_variant_get(v, "$.text", "string")
    return lines.select(*keep, F.try_variant_get(v, "$.id", "string").alias("id"), text.alias("text"), F.when(v.isNull(), "INVALID_JSON").when(text.isNull(), "MISSING_TEXT").otherwise("OK").alias("status"))


def pinned(jobs: DataFrame, activations: DataFrame) -> DataFrame:
    """job and the snapshot of its tenant (tenant, snapshot, at) that was active when it began; null without one.

    Jobs and activations of a tenant are sorted together once, and each job takes the last snapshot before it: no job
    meets all activations. Of activations at one time the one of the greatest snapshot holds, also for jobs that begin just
    then. Jobs without a tenant or a beginning have no snapshot; repeated jobs stay apart.
    """
    told = activations.where("at is not null and snapshot is not null").select("tenant", F.col("at").alias("__at"), F.lit(None).alias("__job"), "snapshot", F.lit(False).alias("__is_job"))
    asked = jobs.select("tenant", F.col("begun").alias("__at"), F.struct("job").alias("__job"), F.lit(None).alias("snapshot"), F.lit(True).alias("__is_job"))
    before = Window.partitionBy("tenant").orderBy("__at", "__is_job", "snapshot").rowsBetween(Window.unboundedPreceding, 0)
    held = told.unionByName(asked).withColumn("__last", F.last("snapshot", ignorenulls=True).over(before)).where("__is_job")
    return held.select("__job.job", F.when(F.col("tenant").isNotNull() & F.col("__at").isNotNull(), F.col("__last")).alias("snapshot"))


def expired(terms: DataFrame, now: Column, turns: int = 20) -> DataFrame:
    """Whether provisional terms (id, turn) have outlived their turns; others are left out."""
    return terms.where("turn is not null").select("id", (now - F.col("turn") >= turns).alias("expired"))


#: State and event: the state after it.
MOVES = {("QUEUED", "start"): "RUNNING", ("QUEUED", "cancel"): "CANCELLED", ("RUNNING", "finish"): "SUCCEEDED", ("RUNNING", "fail"): "FAILED", ("RUNNING", "cancel"): "CANCELLED"}


STATES = ("QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED")


def job_states(events: DataFrame, part: Column | None = None) -> DataFrame:
    """state and number of refused events of each job, from its events (job, n, event) in order of n. Native folds.

    part: a column that never falls as n grows, such as an hour. Each part of a job is folded by itself, from every state
    that it may begin in, and the parts are chained: no task then holds all events of a large job, only those of a part.
    A null event is refused, whatever the state; rows without a job are one job's.
    """
    moves = F.create_map(*[F.lit(x) for (a, e), b in MOVES.items() for x in (f"{a}:{e}", b)])

    def moved(s: Column, e: Column) -> Column:
        after = F.try_element_at(moves, F.concat(s["state"], F.lit(":"), e["event"]))
        return F.struct(F.coalesce(after, s["state"]).alias("state"), (s["refused"] + after.isNull().cast("bigint")).alias("refused"))

    begun = lambda state: F.struct(F.lit(state).alias("state"), F.lit(0).cast("bigint").alias("refused"))
    held = events.withColumn("__part", F.lit(0) if part is None else part).groupBy("job", "__part").agg(F.array_sort(F.collect_list(F.struct("n", "event"))).alias("es"))
    ends = held.select("job", "__part", F.create_map(*[x for s in STATES for x in (F.lit(s), F.aggregate("es", begun(s), moved))]).alias("ends"))
    parts = ends.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("__part", F.map_entries("ends").alias("ends")))).alias("ps"))

    def chained(s: Column, p: Column) -> Column:
        end = F.element_at(F.map_from_entries(p["ends"]), s["state"])
        return F.struct(end["state"].alias("state"), (s["refused"] + end["refused"]).alias("refused"))

    return parts.select("job", F.aggregate("ps", begun("QUEUED"), chained).alias("f")).select("job", "f.state", "f.refused")


def expired_by(events: DataFrame, turns: int = 20) -> DataFrame:
    """tenant, id and the n of the event that is ``turns`` turns later (null so far), for each term that events put in.

    events: tenant, ts, n, id (the term, null in turns that put in none); each is a turn of its tenant, in order of (ts, n).
    """
    later = F.lead("n", turns).over(Window.partitionBy("tenant").orderBy("ts", "n"))
    return events.withColumn("expired_by", later).where("id is not null").select("tenant", "id", "expired_by")
