"""Prefix scans against plain windows, also where one key holds all rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from freightlens.operators import scan, windows

SCHEMA = "asset_id string, ts timestamp_ntz, id bigint, shipment_status string, _x int"


def frame(spark, n, keys, seed):
    rnd = random.Random(seed)
    at = "2024-01-01 00:00:00"
    rows = [(rnd.choice(keys), rnd.randrange(n // 3 + 1), i, rnd.choice(["A", "B", None]), i) for i in range(n)]
    df = spark.createDataFrame(rows, "asset_id string, s int, id bigint, shipment_status string, _x int")
    ts = F.expr(f"timestamp_ntz'{at}' + make_interval(0, 0, 0, 0, 0, 0, s)")
    return df.select("asset_id", ts.alias("ts"), "id", "shipment_status", "_x").repartition(5)


@pytest.mark.parametrize("n, keys", [(0, ["a"]), (1, ["a"]), (3000, ["a"]), (3000, ["a"] * 30 + list("bcdefgh") + [None]), (40, list("abcdefghijklmnop")), (500, [None])])
def test_scan_equals_plain_windows(spark, n, keys):
    df = frame(spark, n, keys, n)
    w = Window.partitionBy("asset_id").orderBy("ts", "id")
    want = {r["id"]: (r["p"], r["i"]) for r in df.select("id", F.lag("shipment_status").over(w).alias("p"), (F.row_number().over(w) - 1).alias("i")).collect()}
    lagged = scan.previous_value(df, "asset_id", ["ts", "id"], "shipment_status", "p")
    indexed = scan.row_index(df, "asset_id", ["ts", "id"])
    assert lagged.columns == [*df.columns, "p"] and indexed.columns == [*df.columns, "row_index"]
    assert {r["id"]: r["p"] for r in lagged.collect()} == {i: p for i, (p, _) in want.items()}
    assert {r["id"]: r["row_index"] for r in indexed.collect()} == {i: x for i, (_, x) in want.items()}


def test_one_key_is_dealt_evenly(spark):
    rows = scan.scanned(frame(spark, 20_000, ["hot"], 7), "asset_id", ["ts", "id"], "shipment_status")
    sizes = sorted(r["count"] for r in rows.groupBy(scan.PART).count().collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_status_changes_and_sequences_of_one_key(spark):
    df = frame(spark, 2000, ["hot"], 3)
    rows = df.orderBy("ts", "id").collect()
    changes = {b["id"] for a, b in zip(rows, rows[1:]) if None not in (a["shipment_status"], b["shipment_status"]) and a["shipment_status"] != b["shipment_status"]}
    assert {r["id"] for r in windows.status_changes(df).collect()} == changes
    out = windows.sequences(df, "asset_id", ["ts", "id"], ["id"], "id", length=4, block=50)
    got = {r["target"]: [s["id"] for s in r["sequence"]] for r in out.collect()}
    assert got == {rows[i]["id"]: [r["id"] for r in rows[i - 4 : i]] for i in range(4, len(rows))}
