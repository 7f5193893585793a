"""Ordered folds of a key's events on a stream: job states, one-time requests, terms that expire after turns.

Events wait in the state until the watermark has passed them and are then applied in the order of (ts, n), so that a
stream gives what the same fold over the whole table gives, however batches cut it and in whatever order events come
within the watermark. Later ones are dropped, as in Spark's own windows. A key's state holds the events that wait, which
the watermark bounds, and what the fold holds; it goes once nothing has come for ``keep``, so that what comes afterwards
starts anew. All of it is in the query's checkpoint: a query that is killed resumes without loss or repetition.

Null keys and null times: such events belong to no key and no moment, and are left out. A null n comes first among equal times. Other columns are
not read; empty streams give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .sessions import MOVES

#: Turns that a provisional term lives.
TURNS = 20
Step = Callable[[dict, dict], tuple[dict, list[tuple]]]


def ordered_fold(events: DataFrame, key: str, step: Step, columns: list[str], out: str, late: str, keep_seconds: int) -> DataFrame:
    """Rows that step(state, event) gives for each event of a stream with ts, n and columns, in order; state begins as {}.

    out: the schema of those rows, without the key, which comes first as a string.
    """
    names = [key, *[c.strip().split(" ")[0] for c in out.split(",")]]

    def kernel(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting, last = (json.loads(v) for v in state.get[0:3]) if state.exists else ({}, [], 0)
        for f in () if state.hasTimedOut else frames:
            waiting += [[int(at), None if pd.isna(n) else int(n), row] for at, n, row in zip(f["__at"], f["__n"], f["__row"])]
        mark = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda w: (w[0], w[1] is not None, w[1] or 0, w[2]))
        ready = [w for w in waiting if w[0] // 1000 < mark]
        waiting = waiting[len(ready) :]
        told: list[tuple] = []
        for at, _, row in ready:
            held, rows = step(held, json.loads(row))
            told += [(of[0], *r) for r in rows]
            last = max(last, at // 1000)
        if waiting or held and last + keep_seconds * 1000 >= mark:
            state.update((json.dumps(held), json.dumps(waiting), json.dumps(last)))
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 if waiting else last + keep_seconds * 1000, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(told, columns=names)

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    told = timed.select(
        F.col(key).cast("string").alias("__key"), "ts", F.unix_micros("ts").alias("__at"), F.col("n").cast("bigint").alias("__n"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("__row")
    )
    return told.groupBy("__key").applyInPandasWithState(kernel, f"{key} string, {out}", "held string, waiting string, last string", "append", GroupStateTimeout.EventTimeTimeout)


def live_job_states(events: DataFrame, late: str = "1 hour", keep_seconds: int = 86_400) -> DataFrame:
    """job, n, state and number of refused events up to it, for each event (job, ts, n, event): the last row is the job's."""

    def step(held: dict, row: dict) -> tuple[dict, list[tuple]]:
        state, refused = held.get("state", "QUEUED"), held.get("refused", 0)
        after = MOVES.get((state, row["event"]))
        held = {"state": after or state, "refused": refused + (after is None)}
        return held, [(row["n"], held["state"], held["refused"])]

    return ordered_fold(events, "job", step, ["n", "event"], "n bigint, state string, refused bigint", late, keep_seconds)


def live_expired(events: DataFrame, turns: int = TURNS, late: str = "1 hour", keep_seconds: int = 30 * 86_400) -> DataFrame:
    """tenant, id and the n of the event with which a provisional term expires.

    Each event (tenant, ts, n, id) is a turn of its tenant; one with an id puts that term in. A tenant holds no more terms than turns.
    """

    def step(held: dict, row: dict) -> tuple[dict, list[tuple]]:
        turn, live = held.get("turn", 0) + 1, held.get("live", [])
        gone = [(i, row["n"]) for i, put in live if turn - put >= turns]
        live = [[i, put] for i, put in live if turn - put < turns] + ([[row["id"], turn]] if row["id"] is not None else [])
        return {"turn": turn, "live": live}, gone

    return ordered_fold(events, "tenant", step, ["n", "id"], "id bigint, expired_by bigint", late, keep_seconds)


def live_consumed(events: DataFrame, late: str = "1 hour", keep_seconds: int = 7 * 86_400) -> DataFrame:
    """request, n and outcome of each attempt to use a request once within its time.

    events: request, ts, n, tenant, snapshot, document and expires (a timestamp in the rows that create a request, null in
    attempts). The first attempt uses the request up, whatever comes of it; attempts before a request is created, or once
    its state has gone, find none.
    """
    told = events.withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("__until", F.unix_micros(F.col("expires").cast("timestamp")))

    def step(held: dict, row: dict) -> tuple[dict, list[tuple]]:
        if row["__until"] is not None:
            return (held if "made" in held else {**held, "made": row}), []
        made, used = held.get("made"), held.get("used", False)
        if made is None:
            outcome = "unknown_request"
        elif used:
            outcome = "compact_request_consumed"
        elif row["__at"] >= made["__until"]:
            outcome = "compact_request_expired"
        elif row["tenant"] != made["tenant"]:
            outcome = "compact_request_context_mismatch"
        elif row["snapshot"] != made["snapshot"]:
            outcome = "compact_snapshot_mismatch"
        elif row["document"] != made["document"]:
            outcome = "compact_document_mismatch"
        else:
            outcome = "accepted"
        return ({**held, "used": True} if made else held), [(row["n"], outcome)]

    return ordered_fold(told, "request", step, ["n", "tenant", "snapshot", "document", "__at", "__until"], "n bigint, outcome string", late, keep_seconds)
