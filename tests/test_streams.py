"""Streams in several batches, late and repeated rows, cool-down against brute force."""

from __future__ import annotations

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from freightlens.plans.messages import to_retry
from freightlens.session import new_path
from freightlens.streaming import cooldown, jobs
from freightlens.streaming import ordered as keyed

START = dt.datetime(2024, 1, 1)


def brute_force(rows, minutes):
    """Emitted ids of (key, ts, id) rows, walked one by one."""
    last, out = {}, set()
    for key, ts, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last or ts >= last[key] + dt.timedelta(minutes=minutes):
            last[key] = ts
            out.add(i)
    return out


def random_rows(n, keys, seed, hours=48):
    rnd = random.Random(seed)
    return [
        (rnd.choice(keys), START + dt.timedelta(seconds=rnd.randrange(hours * 3600)), i) for i in range(n)
    ]


@pytest.mark.parametrize("minutes, busy, chunk", [(30, 10**6, None), (30, 20, None), (30, 20, 45), (7, 20, 60), (200, 20, 60)])
def test_cooldown_equals_brute_force(spark, minutes, busy, chunk):
    # one key holds most rows
    rows = random_rows(600, ["hot"] * 6 + ["a", "b"], seed=minutes)
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint")
    out = cooldown.with_cooldown(df, ["k"], "ts", minutes, "id", busy_rows=busy, chunk_minutes=chunk)
    assert {r["id"] for r in out.collect()} == brute_force(rows, minutes)


@pytest.mark.parametrize("fan", [4, 64])
def test_a_key_of_many_chunks_and_mixed_waits(spark, monkeypatch, fan):
    monkeypatch.setattr(cooldown, "FAN", fan)
    rnd = random.Random(fan)
    # 10,000 chunks of an hour on either side of 1970, waits of 30 and 600 minutes chained apart
    start = dt.datetime(1970, 1, 1) - dt.timedelta(hours=5000)
    rows = [("hot", start + dt.timedelta(seconds=rnd.randrange(10_000 * 3600)), i, 30 if i % 3 else 600) for i in range(12_000)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id bigint, wait int")
    out = cooldown.with_cooldown(df, ["k"], "ts", "wait", "id", busy_rows=1, chunk_minutes=60)
    want = set()
    for wait in (30, 600):
        want |= brute_force([r[:3] for r in rows if r[3] == wait], wait)
    assert {r["id"] for r in out.collect()} == want


def files_of(spark, batches, schema):
    """One file per batch, read in name order."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for n, batch in enumerate(batches):
        pdf = spark.createDataFrame(batch, schema).toPandas()
        path = os.path.join(folder, f"{n:03d}.parquet")
        pdf.to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + n * 60, 1_700_000_000 + n * 60))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_cooldown_sorts_across_batches(spark):
    rows = random_rows(300, ["a", "b", "c"], seed=5, hours=24)
    ordered = sorted(rows, key=lambda r: r[1])
    batches = [ordered[i : i + 60] for i in range(0, 300, 60)]
    for a, b in zip(batches, batches[1:]):  # neighbours trade rows: late, but inside the watermark
        a[-1], b[0] = b[0], a[-1]
    end = ordered[-1][1] + dt.timedelta(hours=10)
    batches += [[("a", end, 999)]]
    stream = files_of(spark, batches, "k string, ts timestamp, id bigint").withWatermark("ts", "3 hours")
    out = jobs.run_available(spark, keyed.cooldown(stream, "k string", 30), "test")
    assert {r["id"] for r in out.collect()} - {999} == brute_force(rows, 30)


def test_late_and_repeated_rows_are_dropped(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    # late rows are judged by the watermark of the batch before, so one more batch passes first
    batches = [[(1, at(0)), (2, at(1))], [(3, at(10))], [(7, at(10))], [(2, at(1)), (4, at(1)), (5, at(11))], [(5, at(11)), (6, at(12))]]
    stream = files_of(spark, batches, "event_id bigint, ts timestamp")
    out = jobs.run_available(spark, jobs.without_repeats(stream), "test")
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 3, 5, 6, 7]


def test_windows_close_behind_the_watermark(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    row = lambda i, h, s: (i, "T", at(h), s, s == "Delayed", 0.9 if s == "Delayed" else 0.1)
    batches = [[row(1, 0, "Delayed"), row(2, 1, "In Transit")], [row(3, 30, "Delayed")], [row(6, 31, "Pending")], [row(4, 2, "Delayed"), row(5, 60, "Delayed")]]
    schema = "id bigint, asset_id string, ts timestamp, shipment_status string, logistics_delay boolean, delay_probability double"
    out = jobs.run_available(spark, jobs.live_kpis(files_of(spark, batches, schema), "1 day"), "test")
    got = {r["window_start"].day: (r["shipments"], r["delayed"]) for r in out.collect()}
    assert got == {1: (2, 1), 2: (2, 1)}  # row 4 came too late, day 3 is still open


def test_status_changes_in_order(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [[("A", at(0), 1, "In Transit"), ("A", at(20), 3, "Delayed")], [("A", at(10), 2, "Delivered")], [("A", at(600), 4, "Delayed")]]
    stream = files_of(spark, batches, "asset_id string, ts timestamp, id bigint, shipment_status string")
    changes = jobs.run_available(spark, keyed.status_changes(stream.withWatermark("ts", "1 hour")), "test")
    rows = [(r["id"], r["old_status"], r["new_status"]) for r in changes.orderBy("id").collect()]
    assert rows == [(2, "In Transit", "Delivered"), (3, "Delivered", "Delayed")]


def state_rows(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def test_idle_assets_leave_no_state(spark):
    at = lambda d: START + dt.timedelta(days=d)
    batches = [[("A", at(0), 1, "In Transit"), ("B", at(0), 2, "In Transit")], [("A", at(1), 3, "Delayed")], [("B", at(20), 4, "Delayed")], [("B", at(40), 5, "Delayed")], [("B", at(41), 6, "Delayed"), ("C", at(41), 7, None)]]
    stream = files_of(spark, batches, "asset_id string, ts timestamp, id bigint, shipment_status string").withWatermark("ts", "1 hour")
    checkpoint = new_path(spark, "idle")
    out = jobs.run_available(spark, keyed.status_changes(stream, forget_days=30), "test", checkpoint)
    assert sorted((r["id"], r["old_status"], r["new_status"]) for r in out.collect()) == [(3, "In Transit", "Delayed"), (4, "In Transit", "Delayed")]
    kept = {r["key"]["asset_id"]: r["value"].asDict() for r in state_rows(spark, checkpoint, "memory").collect()}
    assert set(kept) == {"B"} and kept["B"]["status"] == "Delayed"  # typed columns; A has been silent for 39 days


def test_cooldown_state_ends_with_the_wait(spark):
    batches = [[("a", START, 1)], [("b", START + dt.timedelta(hours=5), 2)], [("b", START + dt.timedelta(hours=9), 3)], [("c", START + dt.timedelta(hours=20), 4)]]
    stream = files_of(spark, batches, "k string, ts timestamp, id bigint").withWatermark("ts", "1 hour")
    checkpoint = new_path(spark, "wait")
    out = jobs.run_available(spark, keyed.cooldown(stream, "k string", 30), "test", checkpoint)
    assert {r["id"] for r in out.collect()} == {1, 2, 3}
    assert not state_rows(spark, checkpoint, "memory").where("key.k = 'a'").count()


def test_rows_are_released_when_due(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    batches = [
        [(1, at(0), None), (2, at(0), at(3)), (3, at(0), at(30)), (4, at(0), START + dt.timedelta(hours=3, minutes=40))],
        [(5, at(5), at(4))],
        [(6, at(6), at(6))],
        [(7, at(28), None)],
    ]
    stream = files_of(spark, batches, "id bigint, ts timestamp, due timestamp").withWatermark("ts", "1 hour")
    checkpoint = new_path(spark, "due")
    out = jobs.run_available(spark, keyed.release_when_due(stream, "due", "id"), "test", checkpoint)
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 4, 5, 6, 7]
    assert [r["list_element"]["id"] for r in state_rows(spark, checkpoint, "waiting").collect()] == [3]


def test_deferred_delivery(spark):
    schema = "id bigint, scheduled_for timestamp"
    batches = [[(1, None), (2, START)], [(3, START + dt.timedelta(days=2))]]
    out, waiting = new_path(spark, "out"), new_path(spark, "waiting")
    query = jobs.deliver_due(spark, files_of(spark, batches, schema), out, waiting, F.lit("2024-01-02").cast("timestamp"))
    query.awaitTermination()
    ids = lambda path: sorted(r["id"] for r in spark.read.schema(schema).parquet(path).collect())
    assert ids(out) == [1, 2] and ids(waiting) == [3]


def test_deferred_rows_are_delivered_by_a_later_run(spark):
    schema = "id bigint, scheduled_for timestamp"
    source, out, waiting, state = (new_path(spark, name) for name in ("source", "out", "waiting", "state"))

    def run(rows, as_of):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.deliver_due(spark, stream, out, waiting, F.lit(as_of).cast("timestamp"), state).awaitTermination()
        return sorted(r["id"] for r in spark.read.schema(schema).parquet(out).collect())

    assert run([(1, None), (2, START + dt.timedelta(days=2)), (3, START + dt.timedelta(days=9))], "2024-01-02") == [1]
    assert run([(4, None)], "2024-01-04") == [1, 2, 4]
    assert run([(5, None)], "2024-01-20") == [1, 2, 3, 4, 5]


def test_stream_cooldown_orders_equal_times_by_number(spark):
    batches = [[("a", START, 10), ("a", START, 9)], [("a", START + dt.timedelta(hours=9), 11)], [("b", START + dt.timedelta(hours=20), 12)]]
    stream = files_of(spark, batches, "k string, ts timestamp, id bigint").withWatermark("ts", "1 hour")
    out = jobs.run_available(spark, keyed.cooldown(stream, "k string", 30), "test")
    assert {r["id"] for r in out.collect()} - {12} == {9, 11}


def test_retries_stop_at_the_limit(spark):
    df = spark.createDataFrame([(1, "failed", 0), (2, "failed", 2), (3, "failed", 3), (4, "sent", 0)], "id bigint, status string, retry_count int")
    assert {(r["id"], r["retry_count"]) for r in to_retry(df).collect()} == {(1, 1), (2, 3)}


def test_health_severity(spark):
    df = spark.createDataFrame([(6.0, 9, False), (6.0, 0, True), (1.0, 5, None)], "api_response_time double, database_errors_per_hour int, ml_service_available boolean")
    assert [r["severity"] for r in jobs.health_alerts(df).collect()] == ["High", "Medium"]


def test_a_catch_up_batch_is_handed_over_by_the_hour():
    """The processor on plain dictionaries: no call gets more than one hour of a key, in order all the same."""
    import types

    import pandas as pd

    class Map(dict):
        exists = lambda self: bool(self)
        updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.pop

    class Value(list):
        exists = lambda self: bool(self)
        get = lambda self: self[0]
        update = lambda self, v: self.__setitem__(slice(None), [v])

    timers, calls = [], []
    handle = types.SimpleNamespace(getMapState=lambda *a: Map(), getValueState=lambda *a: Value(), registerTimer=timers.append)

    def step(memory, rows):
        calls.append([r[0] for r in rows])
        return (rows[-1][0],), [(r[0], r[1]) for r in rows]

    fold = keyed.Fold("at bigint", step, lambda memory: memory[0])
    p = keyed.InOrder(["k"], "ts", {"id": "bigint"}, ["k", "ts", "id"], fold)
    p.init(handle)
    minutes = [(i * 37) % 600 for i in range(600)]  # ten hours, shuffled, in six frames
    frames = [pd.DataFrame({"ts": pd.to_datetime([m * 60 for m in minutes[a : a + 100]], unit="s"), "id": minutes[a : a + 100]}) for a in range(0, 600, 100)]
    p.handleInputRows(("a",), iter(frames), None)
    assert timers == [0]
    at = lambda minute: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: minute * 60_000)
    first = [int(i) for f in p.handleExpiredTimer(("a",), at(449), None) for i in f["id"]]
    assert first == list(range(450)) and timers[-1] == 450 * 60_000
    rest = [int(i) for f in p.handleExpiredTimer(("a",), at(600), None) for i in f["id"]]
    assert rest == list(range(450, 600)) and not p.waiting
    assert max(len(c) for c in calls) == 60
    assert [*p.handleExpiredTimer(("a",), at(700), None)] == [] and not p.memory
