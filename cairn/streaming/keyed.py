"""Keyed state of request streams: the queue of one place, and requests with a lifetime, by transformWithState with timers; and a table of which each key's row is replaced.

State lives in RocksDB (`use_state_store` sets it), so that it may be larger than memory, and in the stream's checkpoint, so that a query that starts again goes on where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.formats import place_of
from .requests import latest

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a replaced table; a micro-batch writes those that it touches.
BUCKETS = 64


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def micros(ts) -> int:
    return pd.Timestamp(ts).value // 1000


class QueueOfOne(StatefulProcessor):
    """One key's queue: requests wait until the watermark has passed them, so that they are taken in order of time; the running request's end and the newest waiting one are the state. Nothing is held of a key that is idle."""

    def __init__(self, seconds: float):
        self.took = int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", "at long, event_id long")
        self.now = handle.getValueState("now", "free long, waiting long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            at = [micros(t) for t in part["ts"]]
            self.early.appendList([(a, int(e)) for a, e in zip(at, part["event_id"], strict=True)])
            first = min([*at, *([first] if first is not None else [])])
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.early.get()) if self.early.exists() else []
        due, rest = [r for r in held if r[0] < passed], [r for r in held if r[0] >= passed]
        free, waiting = self.now.get() if self.now.exists() else (None, None)
        out = []
        for at, event in due:
            if waiting is not None and at >= free:  # it started when the one before ended
                out.append((waiting, free))
                free, waiting = free + self.took, None
            if free is None or at >= free:
                out.append((event, at))
                free = at + self.took
            else:
                if waiting is not None:
                    out.append((waiting, None))
                waiting = event
        if waiting is not None and free < passed:
            out.append((waiting, free))
            free, waiting = free + self.took, None
        if rest:
            self.early.put(rest)
        else:
            self.early.clear()
        if waiting is None and (free is None or free < passed):
            self.now.clear()
            if rest:
                self._wake(rest[0][0])
        else:
            self.now.update((free, waiting))
            self._wake(min(free, rest[0][0]) if rest else free)
        if out:
            yield pd.DataFrame({"user_id": key[0], "event_id": [e for e, _ in out], "started": pd.to_datetime([s for _, s in out], unit="us")})

    def _wake(self, at: int) -> None:
        """Timers fire when the watermark has passed their millisecond."""
        self.handle.registerTimer(at // 1000 + 1)

    def close(self) -> None:
        pass


def stream_coalesced(events: DataFrame, seconds: float) -> DataFrame:
    """`requests.coalesced` over a stream (user_id, ts, event_id, ...) with a watermark: a row is given out when no request can come any more that changes it. Requests behind the watermark are dropped."""
    own = events.filter("user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").select("user_id", "ts", "event_id")
    return own.groupBy("user_id").transformWithStateInPandas(QueueOfOne(seconds), StructType.fromDDL("user_id long, event_id long, started timestamp"), "append", "eventTime")


class Superseding(StatefulProcessor):
    """One key's newest request, forgotten when it has been the newest for its lifetime."""

    def __init__(self, lifetime_ms: int):
        self.lifetime = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at long, event_id long", ttlDurationMs=self.lifetime)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.newest.get()) if self.newest.exists() else None
        came = sorted((micros(t), int(e)) for part in rows for t, e in zip(part["ts"], part["event_id"], strict=True))
        order = sorted([*([old] if old else []), *came])
        newest = order[-1]
        if newest != old:
            self.newest.update(newest)
        past = [e for e in order[:-1] if e != old] + ([old] if old and newest != old else [])
        rows = [(e, newest[1]) for _, e in past] + ([(newest[1], None)] if newest != old else [])
        if rows:
            yield pd.DataFrame({"user_id": key[0], "event_id": [e for e, _ in rows], "superseded_by": pd.array([b for _, b in rows], "Int64")})

    def close(self) -> None:
        pass


def stream_superseded(events: DataFrame, lifetime_ms: int) -> DataFrame:
    """Latest wins, over a stream (user_id, ts, event_id, ...): (user_id, event_id, superseded_by): a request that is its user's newest (null), and every request that a newer one takes the place of. A user's newest request
    is forgotten after its lifetime in processing time; what comes then is the newest whatever its ts."""
    own = events.filter("user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").select("user_id", "ts", "event_id")
    return own.groupBy("user_id").transformWithStateInPandas(Superseding(lifetime_ms), StructType.fromDDL("user_id long, event_id long, superseded_by long"), "append", "processingTime")


class ReplacedTable:
    """A table of each user's latest request in a folder: users are in buckets, and a micro-batch writes a new version of the buckets that it touches. A version's list of files is written last and names the files of every
    bucket; versions that neither of the last two lists names are removed. The same micro-batch again writes the same version, from the version before it."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.where, self.place = place_of(self.folder)

    def versions(self) -> list[int]:
        from pyarrow import fs

        if self.where.get_file_info(self.place).type == fs.FileType.NotFound:
            return []
        return sorted(int(f.base_name[5:-5]) for f in self.where.get_file_info(fs.FileSelector(self.place)) if f.base_name.startswith("list-"))

    def list_of(self, version: int) -> dict[int, int]:
        """bucket to the version that its rows are of."""
        with self.where.open_input_stream(f"{self.place}/list-{version}.json") as f:
            return {int(k): v for k, v in json.loads(f.read()).items()}

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame | None:
        """The rows of some buckets, or all, as of the last version (before another); None if there are none."""
        past = [v for v in self.versions() if before is None or v < before]
        files = [f"{self.folder}/rows-{v}/bucket={b}" for b, v in (self.list_of(past[-1]) if past else {}).items() if buckets is None or b in buckets]
        return self.spark.read.parquet(*files) if files else None

    def write(self, batch: DataFrame, version: int) -> None:
        new = latest(batch).withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        old = self.read(touched, before=version)
        if old is not None:
            new = latest(new.drop("bucket").unionByName(old)).withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int"))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/rows-{version}")
        past = [v for v in self.versions() if v < version]
        files = (self.list_of(past[-1]) if past else {}) | {b: version for b in touched}
        with self.where.open_output_stream(f"{self.place}/.list-{version}") as f:
            f.write(json.dumps(files).encode())
        self.where.move(f"{self.place}/.list-{version}", f"{self.place}/list-{version}.json")
        named = set(files.values()) | (set(self.list_of(past[-1]).values()) if past else set())
        for v in past[:-1]:
            if v not in named:
                self.where.delete_dir(f"{self.place}/rows-{v}")
            self.where.delete_file(f"{self.place}/list-{v}.json")


def replace_latest(events: DataFrame, table: ReplacedTable):
    """A writer of a stream that keeps each user's latest request in a replaced table: give it a checkpoint and start it."""
    return events.writeStream.outputMode("update").foreachBatch(lambda batch, n: table.write(batch, n))
