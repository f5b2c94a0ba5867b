"""Progress events and request batches over the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import fresh_path
from ..streaming import progress
from .common import Registry, table

R = Registry()
#: The events' pauses are hours; a tick of the queries is so many milliseconds of theirs.
SCALE = 60_000


def epoch_ms(events: DataFrame, name: str) -> Column:
    """The milliseconds of a time; one without a zone is read as UTC, whatever
    the session's zone."""
    if dict(events.dtypes)[name] != "timestamp_ntz":
        return F.unix_millis(F.col(name).cast("timestamp"))
    since = F.col(name) - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(since.cast("interval second").cast("decimal(18,6)") * 1000).cast("long")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as progress: the user is the job, the type the entry."""
    events = table(spark, sf_dir, "events")
    ms = F.floor(epoch_ms(events, "ts") / SCALE)
    return events.select("event_id", F.col("user_id").alias("job_id"), ms.alias("ms"), F.col("event_type").alias("entry"))


def rank() -> Column:
    """What orders a job's first and last events in the SQL: the order of
    time, up to ids of ten million."""
    return F.col("ms") * 10_000_000 + F.col("event_id")


SQL_TICKS = f"t AS (SELECT event_id, user_id AS job_id, epoch_ms(ts) // {SCALE} AS ms, event_type AS entry FROM events)"


@R.add(f"""
WITH {SQL_TICKS}, g AS (
  SELECT *, coalesce(CAST(ms - lag(ms) OVER w > 400 AS INTEGER), 0) AS new FROM t WINDOW w AS (PARTITION BY job_id ORDER BY ms, event_id)
), n AS (
  SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ms, event_id) AS batch FROM g
), f AS (
  SELECT job_id, batch, entry, min(ms) AS ms, arg_min(event_id, ms * 10000000 + event_id) AS first, count(*) AS n FROM n GROUP BY ALL
)
SELECT job_id, CAST(batch AS BIGINT) AS batch, min(ms) AS started, CAST(sum(n) AS BIGINT) AS n_requests, list(entry ORDER BY ms, first) AS paths FROM f GROUP BY job_id, batch""")
def q_session_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.batches(ticks(spark, sf_dir), key="job_id", path="entry", rank=rank())


SQL_SENT = f"""
WITH RECURSIVE {SQL_TICKS}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ms, event_id) AS k FROM t), s AS (
  SELECT job_id, k, event_id, ms AS sent, entry AS last, true AS forward FROM o WHERE k = 1
  UNION ALL
  SELECT o.job_id, o.k, o.event_id, CASE WHEN o.ms - s.sent >= 100 OR o.entry <> s.last THEN o.ms ELSE s.sent END, CASE WHEN o.ms - s.sent >= 100 OR o.entry <> s.last THEN o.entry ELSE s.last END,
         o.ms - s.sent >= 100 OR o.entry <> s.last
  FROM s JOIN o ON o.job_id = s.job_id AND o.k = s.k + 1
)
SELECT job_id, event_id FROM s WHERE forward"""


@R.add(SQL_SENT)
def q_progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.throttle(ticks(spark, sf_dir)).select("job_id", "event_id")


def run_stream(events: DataFrame, shape, out: str) -> DataFrame:
    """What `shape` makes of `events` as a stream, all of them one micro-batch."""
    spark = events.sparkSession
    coming = fresh_path(spark, "coming")
    events.write.parquet(coming)
    query = (
        shape(spark.readStream.schema(events.schema).parquet(coming)).writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


@R.add(SQL_SENT)
def q_throttle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, throttled with each job's last forwarded event
    as state."""
    return run_stream(ticks(spark, sf_dir), progress.throttle_stream, fresh_path(spark, "sent")).select("job_id", "event_id")


@R.add(f"""
WITH {SQL_TICKS}, g AS (
  SELECT *, coalesce(CAST(ms - lag(ms) OVER w >= 400 AS INTEGER), 0) AS new FROM t WINDOW w AS (PARTITION BY job_id ORDER BY ms, event_id)
), n AS (
  SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ms, event_id) AS batch FROM g
)
SELECT job_id, min(ms) AS started, count(*) AS n_requests, list_sort(list_distinct(list(entry))) AS paths FROM n GROUP BY job_id, batch""")
def q_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as a stream of session windows; an event long after the last
    one moves the watermark past all of them."""
    t = ticks(spark, sf_dir)
    end = t.agg(F.lit(None).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("job_id"), (F.max("ms") + 86_400_000).alias("ms"), F.lit("end").alias("entry"))
    events = t.unionByName(end).select(F.col("job_id").alias("key"), F.timestamp_millis("ms").alias("ts"), F.col("entry").alias("path"))
    closed = run_stream(events, progress.batch_stream, fresh_path(spark, "sessions")).where("key >= 0")
    return closed.select(F.col("key").alias("job_id"), F.unix_millis("session.start").alias("started"), "n_requests", "paths")


@R.add(f"WITH {SQL_TICKS} SELECT job_id, arg_max(event_id, ms * 10000000 + event_id) AS event_id, max(ms) AS ms FROM t GROUP BY job_id")
def q_progress_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.final_events(ticks(spark, sf_dir), rank=rank()).select("job_id", "event_id", "ms")


@R.add(f"""
WITH {SQL_TICKS}, p AS (
  SELECT t.event_id, value AS done, lag(value) OVER (PARTITION BY job_id ORDER BY ms, t.event_id) AS before FROM t JOIN events USING (event_id)
)
SELECT event_id, CASE WHEN done > 50 THEN 'over' ELSE 'back' END AS why FROM p WHERE done > 50 OR done < before""")
def q_progress_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's values as a job's bytes done, of 50."""
    done = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("bytes_done"), F.lit(50.0).alias("bytes_total"))
    return progress.violations(ticks(spark, sf_dir).join(done, "event_id")).select("event_id", "why")
