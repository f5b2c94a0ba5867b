"""Progress events and request batches, over tables and over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERVAL_MS = 100
DEBOUNCE_MS = 400
#: A key's time is taken in stretches of so many milliseconds.
SPAN_MS = 3_600_000


def numbered_runs(rows: DataFrame, key: str, ms: str, order: str, carried: list[str], starts: Callable[[Column], Column], span_ms: int = SPAN_MS, mark: str | None = None) -> DataFrame:
    """`rows` and `run_`: a number that goes up, within a key and in order of
    time, at each row for which `starts` holds of the row before it (a struct
    of ms, order and `carried`; null for a key's first row).

    A key's rows needn't fit one task: windows go over a key's stretch of
    `span_ms`, and a stretch's last row and number of starts are handed on
    between stretches. With `mark`, a column of that name says which rows
    start a run. Rows without a key or a time are left out.
    """
    taken = Window.partitionBy(key, "stretch_").orderBy(ms, order)
    along = Window.partitionBy(key).orderBy("stretch_")
    value = F.struct(F.col(ms).alias("ms"), F.col(order).alias("order"), *carried)
    r = rows.where(F.col(key).isNotNull() & F.col(ms).isNotNull()).withColumn("stretch_", F.floor(F.col(ms) / span_ms))
    lasts = r.groupBy(key, "stretch_").agg(F.max_by(value, F.struct(ms, order)).alias("last_"))
    before = lasts.select(key, "stretch_", F.lag("last_").over(along).alias("before_"))
    r = r.join(before, [key, "stretch_"]).withColumn("start_", starts(F.coalesce(F.lag(value).over(taken), F.col("before_"))).cast("int"))
    counts = r.groupBy(key, "stretch_").agg(F.sum("start_").alias("n_"))
    earlier = F.sum("n_").over(along.rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(key, "stretch_", F.coalesce(earlier, F.lit(0)).alias("offset_"))
    r = r.join(offsets, [key, "stretch_"]).withColumn("run_", F.col("offset_") + F.sum("start_").over(taken))
    if mark:
        r = r.withColumn(mark, F.col("start_") == 1)
    return r.drop("stretch_", "before_", "start_", "offset_")


def throttle(events: DataFrame, *, job: str = "job_id", ms: str = "ms", entry: str = "entry", order: str = "event_id", interval_ms: int = INTERVAL_MS) -> DataFrame:
    """The `events` that are forwarded: a job's first, one of another entry
    than the last forwarded one, or one `interval_ms` or more after it.

    An event that is kept back has the entry of the last forwarded one, so the
    events that change the entry, or follow a pause of the interval, are
    forwarded whatever came before. They start runs that don't depend on each
    other; tasks read them in order of time and hold what was last forwarded
    alone. Events without a job or a time are left out.
    """

    def starts(prev: Column) -> Column:
        return prev.isNull() | (F.col(ms) - prev["ms"] >= interval_ms) | ~F.col(entry).eqNullSafe(prev[entry])

    runs = numbered_runs(events.select(job, ms, entry, order), job, ms, order, [entry], starts)
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ticks = runs.select(F.xxhash64(job, "run_").alias("run"), F.col(job).alias("job"), "run_", F.col(ms).cast("long").alias("t"), order)
    ticks = ticks.repartition(n, "run").sortWithinPartitions("run", "job", "run_", "t", order)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last = None, None
        for batch in batches:
            keep = []
            for job_id, number, t in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                forward = (job_id, number) != run or t - last >= interval_ms
                keep.append(forward)
                if forward:
                    run, last = (job_id, number), t
            yield batch.select(["job", order]).filter(pa.array(keep, pa.bool_()))

    kept = ticks.mapInArrow(sent, T.StructType([ticks.schema["job"], ticks.schema[order]])).withColumnRenamed("job", job)
    return events.join(kept, [job, order], "left_semi")


def throttle_stream(events: DataFrame, *, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """As `throttle`, for a stream of (job_id, event_id, ms, entry): what each
    job last forwarded is kept as state. A micro-batch's events are taken in
    order of time; batches must come in order."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_ms, last_entry = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values(["ms", "event_id"])
        keep = []
        for t, name in zip(rows["ms"], rows["entry"]):
            forward = last_ms is None or t - last_ms >= interval_ms or name != last_entry
            keep.append(forward)
            if forward:
                last_ms, last_entry = int(t), name
        state.update((last_ms, last_entry))
        yield rows[keep]

    return events.select("job_id", "event_id", "ms", "entry").groupBy("job_id").applyInPandasWithState(
        step, "job_id long, event_id long, ms long, entry string", "last_ms long, last_entry string", "append", "NoTimeout"
    )


def final_events(events: DataFrame, *, job: str = "job_id", ms: str = "ms", order: str = "event_id", rank: Column | None = None) -> DataFrame:
    """Each job's last event, which is forwarded whatever the throttle says,
    at the job's last time. `rank`: what orders the events in place of (`ms`,
    `order`); those that have none aren't last."""
    columns = [c for c in events.columns if c != job]
    last = F.max_by(F.struct(*(c for c in columns if c != ms)), F.struct(ms, order) if rank is None else rank)
    found = events.groupBy(job).agg(last.alias("last"), F.max(ms).alias(ms))
    return found.select(job, *(c if c == ms else F.col("last")[c].alias(c) for c in columns))


def violations(events: DataFrame, *, job: str = "job_id", ms: str = "ms", order: str = "event_id") -> DataFrame:
    """`events` (with bytes_done and bytes_total) that can't be, with `why`:
    `over` if more bytes are done than there are, else `back` if fewer are
    done than at the job's event before. A job's events needn't fit one task:
    see `numbered_runs`."""
    fewer = lambda prev: F.coalesce(F.col("bytes_done") < prev["bytes_done"], F.lit(False))
    numbered = numbered_runs(events, job, ms, order, ["bytes_done"], fewer, mark="back_")
    why = F.when(F.col("bytes_done") > F.col("bytes_total"), F.lit("over")).when(F.col("back_"), F.lit("back"))
    return numbered.withColumn("why", why).drop("run_", "back_").where("why is not null")


def batches(requests: DataFrame, *, key: str = "key", ms: str = "ms", path: str = "path", order: str = "event_id", debounce_ms: int = DEBOUNCE_MS, rank: Column | None = None) -> DataFrame:
    """(`key`, batch, started, n_requests, paths): requests that follow each
    other within `debounce_ms` are one batch; its paths are distinct, in the
    order they first came. `rank`: what says which of a path's requests was
    the first (it settles paths of one time), in place of (`ms`, `order`)."""
    late = lambda prev: F.coalesce(F.col(ms) - prev["ms"] > debounce_ms, F.lit(False))
    numbered = numbered_runs(requests.select(key, ms, path, order), key, ms, order, [], late).withColumnRenamed("run_", "batch")
    first = F.min_by(order, F.struct(ms, order) if rank is None else rank)
    firsts = numbered.groupBy(key, "batch", path).agg(F.struct(F.min(ms).alias(ms), first.alias(order)).alias("at"), F.count("*").alias("n"))
    paths = F.transform(F.array_sort(F.collect_list(F.struct("at", path))), lambda x: x[path])
    return firsts.groupBy(key, "batch").agg(F.min(f"at.{ms}").alias("started"), F.sum("n").alias("n_requests"), paths.alias("paths"))


def batch_stream(requests: DataFrame, *, key: str = "key", ts: str = "ts", path: str = "path", debounce: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """As `batches` for a stream, by event time: a session window. A request
    just `debounce` after the one before starts a new one; Spark's windows
    take in what comes at their end, so they end a microsecond earlier."""
    gap = f"{debounce} -1 microseconds"
    return requests.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), key).agg(
        F.count("*").alias("n_requests"), F.array_sort(F.collect_set(path)).alias("paths")
    )
