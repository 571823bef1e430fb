"""Control of request streams (user_id, ts, event_id, event_type): the latest wins, debounce, in-flight de-duplication, lifetime of state.

Each operator has a batch form over a table and a form over a stream with a watermark; ties of ts go by event_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame) -> DataFrame:
    """The last request of each user: whatever came before is superseded."""
    best = F.max(F.struct("ts", "event_id", "event_type")).alias("b")
    return events.groupBy("user_id").agg(best).select("user_id", "b.ts", "b.event_id", "b.event_type")


def debounced(events: DataFrame, gap: str) -> DataFrame:
    """The last event of each session, a run of a user's events less than `gap` apart, and how many the session has."""
    session = F.session_window("ts", gap)
    return events.groupBy("user_id", session).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("events")).drop("session_window")


def first_requests(events: DataFrame, span: str) -> DataFrame:
    """The first of equal requests (user, type) in each span of time: later ones share its answer."""
    return events.groupBy("user_id", "event_type", F.window("ts", span)).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).drop("window")


def coalesced(events: DataFrame, seconds: float) -> DataFrame:
    """(user_id, event_id, started): a queue of one place for each user, whose requests take so many seconds. While one runs, the newest that came waits and all before it are answered with nothing
    (started null); the waiting one starts when the running one ends. Rows stream through a task in order, so that no user's requests are held."""
    took = np.timedelta64(int(seconds * 1e6), "us")

    def run(batches):
        user, free, waiting = None, None, None
        for batch in batches:
            rows, users = [], batch.column("user_id").to_pylist()
            for u, e, at in zip(users, batch.column("event_id").to_pylist(), batch.column("ts").to_numpy(zero_copy_only=False).astype("datetime64[us]"), strict=True):
                if u != user:
                    if waiting is not None:
                        rows.append((user, waiting, free))
                    user, free, waiting = u, None, None
                if waiting is not None and at >= free:  # it started when the one before ended
                    rows.append((user, waiting, free))
                    free, waiting = free + took, None
                if free is None or at >= free:
                    rows.append((user, e, at))
                    free = at + took
                else:
                    if waiting is not None:
                        rows.append((user, waiting, None))
                    waiting = e
            yield _queued(rows)
        if waiting is not None:
            yield _queued([(user, waiting, free)])

    own = events.select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts")).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return own.mapInArrow(run, "user_id long, event_id long, started timestamp_ntz")


def _queued(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"user_id": pa.int64(), "event_id": pa.int64(), "started": pa.timestamp("us")}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def unstale(replies: DataFrame) -> DataFrame:
    """Replies (user_id, seq, ...) that answer the newest request of their user."""
    return replies.withColumn("_m", F.max("seq").over(Window.partitionBy("user_id"))).filter("seq = _m").drop("_m")


def stream(spark, folder: str, schema: str, late: str = "10 minutes") -> DataFrame:
    """Events that arrive as Parquet files in a folder, with a watermark."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def stream_debounced(events: DataFrame, gap: str) -> DataFrame:
    """As debounced, over a stream: a session is given out when the watermark has passed its end."""
    return debounced(events, gap)


def stream_first(events: DataFrame, keys: list[str]) -> DataFrame:
    """First of equal requests within the watermark; state of older ones is dropped."""
    return events.dropDuplicatesWithinWatermark(keys)


def upsert_latest(events: DataFrame, folder: str):
    """A query that keeps each user's latest request: every micro-batch writes its own latest, which a reader combines with latest()."""
    return events.writeStream.outputMode("append").foreachBatch(lambda batch, n: latest(batch).write.mode("overwrite").parquet(f"{folder}/batch={n}"))
