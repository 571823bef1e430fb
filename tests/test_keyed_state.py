"""Streams with keyed state against the batch forms, over restarts, and that state goes when its time is over."""

import random
import time
from datetime import datetime, timedelta

import pytest

from cairn.streaming import keyed, requests

DDL = "user_id long, ts timestamp, event_id long, event_type string"
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    keyed.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def requests_of(rng, users, n):
    return [(rng.randrange(users), T0 + timedelta(seconds=rng.randrange(4000)), i, rng.choice("ab")) for i in range(n)]


def put(spark, rows, folder):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(folder))


def run(df, out, checkpoint, trigger=None):
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    return q.lastProgress


def test_queue_of_one_equals_the_batch_form(spark, tmp_path):
    """Requests out of order within the watermark, in several runs from one checkpoint; a last request of another user moves the watermark past all."""
    rng = random.Random(4)
    rows = requests_of(rng, 5, 240)
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rng.randrange(0, 500)))
    put(spark, rows[:80], tmp_path / "in")
    live = lambda: keyed.stream_coalesced(requests.stream(spark, str(tmp_path / "in"), DDL), 60.0)
    run(live(), tmp_path / "out", tmp_path / "cp")
    put(spark, rows[80:160], tmp_path / "in")
    run(live(), tmp_path / "out", tmp_path / "cp")
    put(spark, rows[160:], tmp_path / "in")
    run(live(), tmp_path / "out", tmp_path / "cp")
    put(spark, [(99, T0 + timedelta(days=2), 10_000, "a")], tmp_path / "in")
    run(live(), tmp_path / "out", tmp_path / "cp")
    put(spark, [(99, T0 + timedelta(days=4), 10_001, "a")], tmp_path / "in")
    progress = run(live(), tmp_path / "out", tmp_path / "cp")
    got = sorted(((r["user_id"], r["event_id"], r["started"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["user_id"] != 99), key=str)
    want = sorted(map(tuple, requests.coalesced(spark.createDataFrame(rows, DDL), 60.0).collect()), key=str)
    assert got == want and len(got) == 240 and any(r[2] is None for r in got)
    assert progress["stateOperators"][0]["numRowsTotal"] <= 6  # of user 99 alone: its state, its request and a timer


def test_superseded_and_forgotten(spark, tmp_path):
    once = {"once": True}  # with processing time a stream never runs out of batches
    at = lambda s: T0 + timedelta(seconds=s)
    live = lambda ms=3_600_000: keyed.stream_superseded(requests.stream(spark, str(tmp_path / "in"), DDL), ms)
    put(spark, [(1, at(5), 2, "a"), (1, at(3), 1, "a"), (2, at(9), 3, "b")], tmp_path / "in")
    run(live(), tmp_path / "out", tmp_path / "cp", once)
    put(spark, [(1, at(4), 4, "a"), (2, at(9), 5, "b")], tmp_path / "in")
    run(live(), tmp_path / "out", tmp_path / "cp", once)
    read = lambda: sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    first = [(1, 1, 2), (1, 2, None), (1, 4, 2), (2, 3, 5), (2, 3, None), (2, 5, None)]
    assert read() == sorted(first, key=str)
    run(live(100), tmp_path / "brief", tmp_path / "cp2", once)
    time.sleep(1)
    put(spark, [(1, at(0), 6, "a")], tmp_path / "in")
    run(live(100), tmp_path / "brief", tmp_path / "cp2", once)
    assert (1, 6, None) in set(map(tuple, spark.read.parquet(str(tmp_path / "brief")).collect()))  # older than 2, which is forgotten
    run(live(), tmp_path / "out", tmp_path / "cp", once)
    assert read() == sorted([*first, (1, 6, 2)], key=str)


def test_a_replaced_table_holds_one_row_a_key(spark, tmp_path):
    rng = random.Random(6)
    rows = requests_of(rng, 40, 300)
    table = keyed.ReplacedTable(spark, str(tmp_path / "table"), buckets=8)
    assert table.read() is None

    def go():
        q = keyed.replace_latest(spark.readStream.schema(DDL).parquet(str(tmp_path / "in")), table).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    for k in range(0, 300, 60):
        put(spark, rows[k : k + 60], tmp_path / "in")
        go()
        want = sorted(map(tuple, requests.latest(spark.createDataFrame(rows[: k + 60], DDL)).collect()))
        assert sorted(map(tuple, table.read().select("user_id", "ts", "event_id", "event_type").collect())) == want
    assert len(table.versions()) == 2 and len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("rows-")]) <= 3
    last = table.versions()[-1]
    table.write(spark.createDataFrame(rows[240:], DDL), last)  # the last micro-batch again
    assert sorted(map(tuple, table.read().select("user_id", "ts", "event_id", "event_type").collect())) == want
    put(spark, [(3, T0 + timedelta(days=1), 999, "z")], tmp_path / "in")
    go()
    assert table.list_of(table.versions()[-1]) != table.list_of(last) and table.read().filter("user_id = 3").first()["event_id"] == 999
    assert table.read().count() == 40
