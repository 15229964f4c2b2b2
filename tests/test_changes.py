"""Inserts, updates, deletes and message rules on small frames."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from freightlens.operators import changes, features, joins
from freightlens.plans import messages


def test_insert_reports_every_reason(spark):
    batch = spark.createDataFrame(
        [(1, 10, 5.0), (2, 99, -1.0), (3, 10, 1.0), (3, 10, 2.0), (4, None, 1.0)], "id bigint, customer_id bigint, weight double"
    )
    table = spark.createDataFrame([(1,)], "id bigint")
    parents = {"customer_id": (spark.createDataFrame([(10,)], "id bigint"), "id")}
    good, bad = changes.insert_checked(batch, table, "id", {"negative_weight": F.col("weight") < 0}, parents)
    assert [r["id"] for r in good.collect()] == [3]
    reasons = {(r["id"], tuple(r["violations"])) for r in bad.collect()}
    assert reasons == {
        (1, ("existing_id",)), (2, ("negative_weight", "unknown_customer_id")), (3, ("repeated_id",)), (4, ("unknown_customer_id",)),
    }


def test_update_can_set_null(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id bigint, name string, phone string")
    updates = spark.createDataFrame([(1, "z", None, ["phone"])], "id bigint, name string, phone string, set_fields array<string>")
    out = {r["id"]: (r["name"], r["phone"]) for r in changes.partial_update(table, updates, "id").collect()}
    assert out == {1: ("a", None), 2: ("b", "y")}


def test_soft_delete_names_missing_rows(spark):
    table = spark.createDataFrame([(1, True), (2, False)], "id bigint, is_active boolean")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    switched, missing = changes.soft_delete(table, keys, "id")
    assert {r["id"]: r["is_active"] for r in switched.collect()} == {1: False, 2: False}
    assert {r["id"] for r in missing.collect()} == {2, 3}


def test_messages_survive_seven_year_horizon(spark):
    log = spark.sql("select timestamp_ntz'2001-01-01' as sent_at")
    kept = lambda days: changes.retention_apply({"communications": log}, "2024-01-01 00:00:00", days)["communications"].count()
    assert kept(2555) == 1 and kept(2554) == 0


def test_unknown_context_gets_the_generic_text(spark):
    schema = "context string, channel string, shipment_id string, customer_name string, origin_port string, destination_port string, status string, predicted_delay_hours double, new_eta timestamp_ntz, scheduled_arrival timestamp_ntz, email string, phone string"
    rows = [("x", "email") + (None,) * 10, ("nothing", "email", "S1", "Ann", "A", "B", "pending", None, None, None, "a@b", None)]
    first, second = messages.customer_messages(spark.createDataFrame(rows, schema)).collect()
    assert first["message"] == messages.FALLBACK_TEXT and first["recipient"] == messages.FALLBACK_RECIPIENT
    assert second["subject"] == "Shipment S1 Update" and second["message"].startswith("Dear Ann, we have an update")


def test_critical_system_alert_is_high(spark):
    schema = "type string, severity string, component string, details string, shipment_id string, asset_id string, delay_probability double, risk_level string, old_status string, new_status string"
    nothing = (None,) * 6
    rows = [("system_alert", "Critical", "Db", "down", *nothing), ("system_alert", "High", "Db", "slow", *nothing)]
    out = messages.alert_rows(spark.createDataFrame(rows, schema)).collect()
    assert [r["priority"] for r in out] == ["HIGH", "MEDIUM"] and out[0]["title"] == "down - Db"


def test_split_is_exact_per_class(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("double").alias("label"))
    train, test = features.stratified_split(df, "label", "id")
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    assert counts == {1.0: 80, 0.0: 721}
    assert train.union(test).distinct().count() == 1003


def test_label_codes_follow_the_alphabet(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,), ("a",)], "v string")
    codes = {r["value"]: r["code"] for r in features.fit_labels(df, "v").collect()}
    assert codes == {"a": 0, "b": 1, "c": 2, "unknown": 3}
    unseen = spark.createDataFrame([("zz",)], "v string")
    assert features.encode_labels(unseen, "v", features.fit_labels(df, "v"), unseen=-1).first()["v_encoded"] == -1


def test_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.1,), (10.0,)], "x double")
    out = features.equal_width_bins(df, "x", 5, "b", "bin").orderBy("x").collect()
    assert [r["bin"] for r in out] == ["b1", "b1", "b2", "b5"]
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert {r["bin"] for r in features.equal_width_bins(same, "x", 5, "b", "bin").collect()} == {"b1"}


def test_repeated_rows_and_updates_stay_one_row(spark):
    from freightlens.operators import changes

    batch = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b"), (2, "c")], "id long, name string")
    good, bad = changes.insert_checked(batch, batch.limit(0), "id", {})
    assert sorted(r.id for r in good.collect()) == [1, 2]
    assert sorted((r.id, tuple(r.violations)) for r in bad.collect()) == [(1, ("repeated_id",)), (1, ("repeated_id",)), (2, ("repeated_id",))]

    table = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "id long, name string, phone string")
    updates = spark.createDataFrame(
        [(1, "first", None, ["name"], 1), (1, "second", None, ["name"], 2), (1, "no", None, ["phone"], 3)],
        "id long, name string, phone string, set_fields array<string>, at int",
    )
    assert sorted(map(tuple, changes.partial_update(table, updates, "id", order="at").collect())) == [(1, "second", None), (2, "y", "q")]

    predictions = spark.createDataFrame([(1, 5.0, None)], "shipment_id long, predicted_delay_hours double, actual_delay_hours double")
    outcomes = spark.createDataFrame([(1, 2.0, 1), (1, 1.0, 2)], "shipment_id long, delay_hours double, at int")
    assert [r.actual_delay_hours for r in changes.backfill_outcomes(predictions, outcomes, "at").collect()] == [1.0]


def test_newest_valid_observation_of_mixed_lifetimes(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    external = spark.createDataFrame(
        [
            (1, "weather", "k", 0.1, at(0), at(6)), (2, "weather", "k", 0.2, at(1), at(1, 30)), (3, "weather", "k", 0.3, at(1), at(1, 20)),
            (4, "port_status", "k", 0.4, at(2), at(2, 30)), (5, "weather", "k", 0.5, at(3), at(3)), (6, "weather", "k", None, at(5, 30), at(5, 40)),
        ],
        "id long, data_type string, data_key string, data_value double, created_at timestamp_ntz, expires_at timestamp_ntz",
    )
    asked = [("weather", at(0)), ("weather", at(1, 10)), ("weather", at(1, 25)), ("weather", at(2)), ("weather", at(5)), ("weather", at(6)), ("port_status", at(2, 10)), ("port_status", at(3)), ("weather", at(5, 35))]
    probes = spark.createDataFrame([(i, t, "k", k) for i, (k, t) in enumerate(asked)], "id long, ts timestamp_ntz, data_key string, data_type string")
    got = sorted((r.id, r.data_value, r.observed_at) for r in joins.as_of_external(probes, external, default=0.9).collect())
    assert [x[1] for x in got] == [0.1, 0.3, 0.2, 0.1, 0.1, 0.9, 0.4, 0.9, 0.9]
    assert [x[2] for x in got] == [at(0), at(1), at(1), at(0), at(0), None, at(2), None, at(5, 30)]


def test_lifetimes_of_any_length_and_resolution(spark):
    """Against a walk over all observations; a year takes a few dozen rows."""
    rnd = random.Random(8)
    start = dt.datetime(1969, 12, 1)
    rows = []
    for i in range(150):
        at = start + dt.timedelta(seconds=rnd.randrange(90 * 86400), microseconds=rnd.choice([0, 0, 7]))
        rows.append((i, "weather", rnd.choice("kkkq"), float(i), at, at + dt.timedelta(seconds=rnd.choice([0, 1, 61, 3600, 86400 * 30, 86400 * 365]))))
    external = spark.createDataFrame(rows, "id long, data_type string, data_key string, data_value double, created_at timestamp_ntz, expires_at timestamp_ntz")
    asked = [(i, start + dt.timedelta(seconds=rnd.randrange(100 * 86400)), "k") for i in range(300)] + [(1000 + r[0], r[rnd.choice([4, 5])], "k") for r in rows]
    probes = spark.createDataFrame([(*a, "weather") for a in asked], "id long, ts timestamp_ntz, data_key string, data_type string")
    got = {r.id: r.data_value for r in joins.as_of_external(probes, external, default=-1.0).collect()}
    want = {}
    for i, t, k in asked:
        alive = [(r[4], r[0], r[3]) for r in rows if r[2] == k and r[4] <= t < r[5]]
        want[i] = max(alive)[2] if alive else -1.0
    assert got == want
    year = spark.sql("SELECT 0L AS a, 365L * 24 * 3600 * 1000000 AS b")
    assert year.select(F.size(joins._nodes(F.col("a"), F.col("b")))).first()[0] < 100


def test_moments_of_long_delays_do_not_cancel(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, "A", "B", day, day + dt.timedelta(hours=1_000_000, seconds=i)) for i in range(3)]
    voyages = spark.createDataFrame(rows, "id long, origin_port string, destination_port string, scheduled_arrival timestamp_ntz, actual_arrival timestamp_ntz")
    assert joins.route_statistics(voyages).first().route_delay_std == pytest.approx(1 / 3600, rel=1e-3)
