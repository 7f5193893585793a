"""A stream gives what the table gives."""

import datetime as dt
import os
import shutil

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexweave.operators import proposals
from lexweave.plans.stream_queries import steps_of, turns_of
from lexweave.streaming import keyed, sessions

SF = "/root/testdata/sf0.001"


def test_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = sessions.windowed_counts(stream, "1 hour", "60 days", F.col("event_type")).writeStream.format("memory").queryName("windows").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("windows").groupBy("start", "key").agg(F.max("n").alias("n"))
    want = sessions.windowed_counts(events, "1 hour", "60 days", F.col("event_type")).select("start", "key", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_records(spark):
    rows = spark.createDataFrame([('{"id": "1", "text": "a"}',), ("x",), ("{}",), (None,)], "value string")
    assert [r["status"] for r in sessions.records(rows).collect()] == ["OK", "INVALID_JSON", "MISSING_TEXT", "INVALID_JSON"]


# ---------------------------------------------------------------- keyed state: killed in the middle and resumed


def streamed(spark, tmp_path, rows, live):
    """All rows of live(stream of rows), every third row of which comes a file late; the query is killed once and resumed."""
    source, out, marker = tmp_path / "in", str(tmp_path / "out"), tmp_path / "resumed"
    source.mkdir()
    numbered = rows.withColumn("__i", F.row_number().over(Window.orderBy("ts", "n")) - 1).persist()
    size = -(-numbered.count() // 5)
    for i in range(5):  # every third row comes a file late
        here = F.least(F.floor(F.col("__i") / size) + (F.col("__i") % 3 == 0).cast("int"), F.lit(4))
        numbered.where(here == i).drop("__i").orderBy(F.rand(i)).coalesce(1).write.parquet(str(source / "tmp"))
        (part,) = (source / "tmp").glob("*.parquet")
        target = source / f"{i}.parquet"
        part.rename(target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
        shutil.rmtree(source / "tmp")
    end = rows.limit(1).withColumn("ts", F.lit("2100-01-01").cast("timestamp"))  # lets the watermark pass all others
    end = end.withColumn(rows.columns[0], F.lit("-1").cast(rows.schema[0].dataType))
    end.coalesce(1).write.parquet(str(source / "tmp"))
    (part,) = (source / "tmp").glob("*.parquet")
    part.rename(source / "9.parquet")
    shutil.rmtree(source / "tmp")
    path = str(marker)

    def started():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        told = live(stream)

        def put(batch, n):
            if n == 3 and not os.path.exists(path):
                raise RuntimeError("killed")
            batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

        return told.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()

    try:
        started().awaitTermination(240)
        raise AssertionError("the query was not killed")
    except StreamingQueryException:
        marker.touch()
    started().awaitTermination(240)
    return spark.read.parquet(out).drop("batch")


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_live_job_states(spark, tmp_path):
    steps = steps_of(spark.read.parquet(f"{SF}/events.parquet")).select("job", "ts", "n", "event")
    got = streamed(spark, tmp_path, steps, lambda s: keyed.live_job_states(s, "13 days", 40 * 86_400))
    assert got.count() == steps.count()
    last = got.groupBy("job").agg(F.max_by("state", "n").alias("state"), F.max("refused").alias("refused"))
    assert same(last, sessions.job_states(steps)) and same(last, sessions.job_states(steps, F.date_trunc("hour", "ts")))


def test_live_expired(spark, tmp_path):
    turns = turns_of(spark.read.parquet(f"{SF}/events.parquet"))
    got = streamed(spark, tmp_path, turns, lambda s: keyed.live_expired(s, 5, "13 days", 40 * 86_400))
    want = sessions.expired_by(turns, 5).where("expired_by is not null").select(F.col("tenant").cast("string").alias("tenant"), "id", "expired_by")
    assert want.count() > 50 and same(got, want)


def test_live_consumed(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    made, tried = [], []
    for r in range(60):
        if r % 10:
            made.append((str(r), day(r % 5), None, "t", "s", "d", day(r % 5 + 6)))
        for k in range(r % 4):
            tried.append((str(r), day(r % 5 + (k + 2 * (r % 9 == 2)) * (r % 3) * 2) + dt.timedelta(hours=1 + k), 100 * r + k, "u" if r % 7 == 3 else "t", None if r % 11 == 5 else "s", "e" if r % 13 == 6 else "d", None))
    rows = spark.createDataFrame(made + tried, "request string, ts timestamp, n bigint, tenant string, snapshot string, document string, expires timestamp")
    got = streamed(spark, tmp_path, rows, lambda s: keyed.live_consumed(s, "13 days", 40 * 86_400))
    requests = rows.where("expires is not null").withColumnRenamed("ts", "issued").drop("n")
    want = proposals.consumed(rows.where("expires is null").withColumnRenamed("ts", "at").drop("expires"), requests).select("request", "n", "outcome")
    kinds = {r["outcome"] for r in want.select("outcome").distinct().collect()}
    assert len(kinds) >= 6 and same(got, want)


def test_job_states_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "start"), ("a", 3, "leap"), (None, 1, "start"), ("b", None, "cancel"), ("b", 1, "start")], "job string, n bigint, event string")
    got = {r["job"]: (r["state"], r["refused"]) for r in sessions.job_states(rows).collect()}
    assert got == {"a": ("RUNNING", 2), None: ("RUNNING", 0), "b": ("CANCELLED", 1)}
    assert sessions.job_states(rows.limit(0)).count() == 0
