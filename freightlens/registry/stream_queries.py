"""Streams replayed over the event table; the SQL twins describe the closed windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import ALERT_RULES
from ..operators import cleaning, windows
from ..plans import messages
from ..sources import shapes
from ..streaming import cooldown, jobs, ordered
from ..streaming.alerts import rule_table
from .change_queries import _FAN, recipients
from .core import register


def stream_updates(spark, root):
    return jobs.updates(shapes.event_stream(spark, root))


def ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_RISKY = "SELECT id, asset_id, delay_probability FROM scored WHERE delay_probability >= 0.8e0"


@register("stream_risky_updates", "E-01", _RISKY)
def stream_risky_updates(spark, root):
    out = jobs.risky_updates(stream_updates(spark, root)).select("id", "asset_id", "delay_probability")
    return jobs.run_available(spark, out, "risky")


@register(
    "stream_delay_risk_alerts",
    "E-02",
    "SELECT id, 'high_delay_risk' AS rule, 'HIGH' AS priority FROM scored WHERE delay_probability > 0.8e0",
)
def stream_delay_risk_alerts(spark, root):
    out = jobs.delay_risk_alerts(stream_updates(spark, root), rule_table(spark)).select("id", "rule", "priority")
    return jobs.run_available(spark, out, "risk")


@register(
    "custom_and_disabled_rules",
    "E-02 A-40",
    """SELECT 'medium_watch' AS rule, count(*) AS n FROM scored WHERE delay_probability >= 0.6e0 AND delay_probability <= 0.8e0 AND delay_probability > 0.5e0""",
)
def custom_and_disabled_rules(spark, root):
    extra = [("medium_watch", "high_delay_risk", "MEDIUM", 10, True, {"min_delay_probability": "0.6", "risk_level": "Medium"})]
    rules = rule_table(spark, extra, disabled=("high_delay_risk",))
    rows = jobs.updates(shapes.table(spark, root, "events"))
    return jobs.delay_risk_alerts(rows, rules).groupBy("rule").agg(F.count("*").alias("n"))


@register(
    "stream_prediction_alerts",
    "E-04",
    "SELECT id, delay_probability FROM scored WHERE delay_probability > 0.8e0",
)
def stream_prediction_alerts(spark, root):
    out = jobs.prediction_alerts(stream_updates(spark, root)).select("id", "delay_probability")
    return jobs.run_available(spark, out, "predicted")


def _late_errors(rows):
    return rows.filter(F.col("shipment_status") == "Delayed").select(
        F.lit("delay").alias("rule"), F.col("waiting_time").cast("bigint").alias("shipment_id"), "ts", "id"
    )


# the fold as a recursive walk: each alert points to the first row at least 30 minutes later
_COOLDOWN = """WITH RECURSIVE e AS MATERIALIZED (SELECT {key} AS k, ts, id FROM readings WHERE shipment_status = 'Delayed' {extra}),
  walk AS (SELECT k, min((ts, id)) AS pos FROM e GROUP BY k
    UNION ALL SELECT w.k, (SELECT min((e.ts, e.id)) FROM e WHERE e.k = w.k AND e.ts >= w.pos[1] + INTERVAL 30 MINUTE) FROM walk w WHERE w.pos IS NOT NULL)
  SELECT k AS {name}, pos[2] AS id FROM walk WHERE pos IS NOT NULL"""


def _cooldown_sql(key: str, name: str, extra: str = "") -> str:
    return _COOLDOWN.format(key=key, name=name, extra=extra)


@register("cooldown_per_shipment", "E-03 U-07", _cooldown_sql("CAST(waiting_time AS BIGINT)", "shipment_id"))
def cooldown_per_shipment(spark, root):
    alerts = _late_errors(shapes.readings(spark, root))
    return cooldown.with_cooldown(alerts, ["rule", "shipment_id"], "ts", 30, "id").select("shipment_id", "id")


@register("cooldown_per_asset_busy", "E-03 U-07", _cooldown_sql("asset_id", "asset_id"))
def cooldown_per_asset_busy(spark, root):
    """Every asset counts as busy here, so the time-split walk is the one compared."""
    alerts = shapes.readings(spark, root).filter(F.col("shipment_status") == "Delayed").select("asset_id", "ts", "id")
    return cooldown.with_cooldown(alerts, ["asset_id"], "ts", 30, "id", busy_rows=50, chunk_minutes=1440).select("asset_id", "id")


@register(
    "stream_cooldown",
    "E-03 U-07 E-16",
    _cooldown_sql("CAST(waiting_time AS BIGINT)", "shipment_id", "AND ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM readings WHERE shipment_status = 'Delayed')"),
)
def stream_cooldown(spark, root):
    late = _late_errors(stream_updates(spark, root)).withWatermark("ts", "1 hour")
    out = ordered.cooldown(late, "rule string, shipment_id bigint", 30)
    return jobs.run_available(spark, out, "cooldown").select("shipment_id", "id")


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM readings)"


@register(
    "stream_many_high_risks",
    "E-05",
    f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS total, count(*) FILTER (delay_probability >= 0.8e0) AS high_risk,
         100e0 * count(*) FILTER (delay_probability >= 0.8e0) / count(*) AS share FROM scored GROUP BY 1
       HAVING (count(*) FILTER (delay_probability >= 0.8e0) >= 3 OR 100e0 * count(*) FILTER (delay_probability >= 0.8e0) / count(*) >= 30)
         AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_CLOSED}""",
)
def stream_many_high_risks(spark, root):
    out = jobs.many_high_risks(stream_updates(spark, root))
    return ntz(jobs.run_available(spark, out, "many").drop("window_end"), "window_start")


@register(
    "many_high_risks",
    "E-05",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS total, count(*) FILTER (delay_probability >= 0.8e0) AS high_risk,
         100e0 * count(*) FILTER (delay_probability >= 0.8e0) / count(*) AS share FROM scored GROUP BY 1
       HAVING count(*) FILTER (delay_probability >= 0.8e0) >= 3 OR 100e0 * count(*) FILTER (delay_probability >= 0.8e0) / count(*) >= 30""",
)
def many_high_risks(spark, root):
    return ntz(jobs.many_high_risks(jobs.updates(shapes.table(spark, root, "events"))).drop("window_end"), "window_start")


_CHANGES = """SELECT id, asset_id, old_status, shipment_status AS new_status FROM
  (SELECT *, lag(shipment_status) OVER (PARTITION BY asset_id ORDER BY ts, id) AS old_status FROM readings {0})
  WHERE old_status <> shipment_status AND shipment_status IN ('Delayed', 'Cancelled')"""
_STATUS_RULE = next(r[5] for r in ALERT_RULES if r[0] == "status_change")


@register("status_alerts", "E-06 W-06", _CHANGES.format(""))
def status_alerts(spark, root):
    changes = windows.status_changes(shapes.readings(spark, root))
    return jobs.notify_statuses(changes, _STATUS_RULE).select("id", "asset_id", "old_status", "new_status")


@register("stream_status_alerts", "E-06", _CHANGES.format(f"WHERE ts <= {_CLOSED}"))
def stream_status_alerts(spark, root):
    rows = stream_updates(spark, root).select("asset_id", "ts", "id", "shipment_status").withWatermark("ts", "1 hour")
    changes = jobs.run_available(spark, ordered.status_changes(rows), "status")
    return jobs.notify_statuses(changes, _STATUS_RULE).select("id", "asset_id", "old_status", "new_status")


@register(
    "stream_deferred_release",
    "E-10",
    f"""SELECT id, scheduled_for FROM (SELECT id, CASE WHEN id % 4 = 0 THEN ts + to_hours(CAST(id % 7 AS INTEGER)) END AS scheduled_for FROM readings)
       WHERE scheduled_for IS NULL OR scheduled_for <= {_CLOSED}""",
)
def stream_deferred_release(spark, root):
    """Messages that wait for a time of their own; what is due after the last closed moment stays in the state."""
    later = F.when(F.col("id") % 4 == 0, F.expr("ts + make_interval(0, 0, 0, 0, cast(id % 7 as int))"))
    rows = stream_updates(spark, root).select("id", "ts", later.alias("scheduled_for")).withWatermark("ts", "1 hour")
    out = jobs.run_available(spark, ordered.release_when_due(rows, "scheduled_for", "id"), "released")
    return ntz(out.select("id", "scheduled_for"), "scheduled_for")


_DEGRADED = """SELECT time_bucket(INTERVAL 7 DAY, prediction_date, TIMESTAMP '1970-01-01') AS window_start, count(*) AS total,
    count(*) FILTER ((predicted_delay_hours > 2) <> (actual_delay_hours > 2)) AS errors,
    avg(CASE WHEN (predicted_delay_hours > 2) = (actual_delay_hours > 2) THEN 1e0 ELSE 0e0 END) AS accuracy
  FROM predictions WHERE actual_delay_hours IS NOT NULL GROUP BY 1
  HAVING (accuracy < 0.7e0 OR errors > 10) AND window_start + INTERVAL 7 DAY <= (SELECT max(prediction_date) - INTERVAL 1 DAY FROM predictions WHERE actual_delay_hours IS NOT NULL)"""


@register("stream_model_degradation", "E-07", _DEGRADED)
def stream_model_degradation(spark, root):
    schema = shapes.table(spark, root, "lineitem").schema
    rows = spark.readStream.schema(schema).parquet(f"{root}/lineitem.parquet*")
    late = F.when(F.col("l_linestatus") == "F", F.greatest((F.col("l_orderkey") * 31 % 97 - 24).cast("double"), F.lit(0.0)))
    predictions = rows.select(
        F.col("l_shipdate").cast("timestamp").alias("prediction_date"),
        F.col("l_quantity").alias("predicted_delay_hours"),
        late.alias("actual_delay_hours"),
    )
    out = jobs.run_available(spark, jobs.model_degradation(predictions), "degraded")
    return ntz(out.drop("window_end"), "window_start")


@register(
    "stream_errors_per_hour",
    "E-08",
    f"""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS window_start, count(*) AS errors
       FROM (SELECT ts, unnest([0, 1, 2, 3]) AS i FROM readings WHERE shipment_status = 'Delayed') GROUP BY 1
       HAVING count(*) > 5 AND window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM readings WHERE shipment_status = 'Delayed')""",
)
def stream_errors_per_hour(spark, root):
    out = jobs.run_available(spark, jobs.errors_per_hour(stream_updates(spark, root)), "errors")
    return ntz(out.drop("window_end"), "window_start")


@register(
    "health_alerts",
    "E-09",
    """SELECT id, concat_ws('; ', CASE WHEN t > 5 THEN 'High API response time: ' || printf('%.2f', t) || 's' END,
           CASE WHEN e > 5 THEN 'Database errors: ' || CAST(e AS VARCHAR) || '/hour' END, CASE WHEN NOT ok THEN 'ML service unavailable' END) AS details,
         CASE WHEN (CASE WHEN t > 5 THEN 1 ELSE 0 END + CASE WHEN e > 5 THEN 1 ELSE 0 END + CASE WHEN NOT ok THEN 1 ELSE 0 END) > 2 THEN 'High' ELSE 'Medium' END AS severity
       FROM (SELECT id, waiting_time / 8e0 AS t, id % 9 AS e, id % 7 <> 0 AS ok FROM readings) WHERE t > 5 OR e > 5 OR NOT ok""",
)
def health_alerts(spark, root):
    checks = shapes.readings(spark, root).select(
        "id",
        (F.col("waiting_time") / 8.0).alias("api_response_time"),
        (F.col("id") % 9).alias("database_errors_per_hour"),
        (F.col("id") % 7 != 0).alias("ml_service_available"),
    )
    return jobs.health_alerts(checks).select("id", "details", "severity")


@register("stream_fan_out", "E-12 E-13 J-14", _FAN)
def stream_fan_out(spark, root):
    rows = cleaning.scored(stream_updates(spark, root))
    kind = F.when(F.col("delay_probability") > 0.8, "delay_prediction").when(F.col("shipment_status") == "Delayed", "status_change")
    nothing = F.lit(None).cast("string")
    alerts = rows.withColumn("type", kind).filter(F.col("type").isNotNull()).select(
        "id", "type", F.col("id").cast("string").alias("shipment_id"), "asset_id", "delay_probability", "risk_level",
        nothing.alias("old_status"), F.col("shipment_status").alias("new_status"),
        nothing.alias("severity"), nothing.alias("component"), nothing.alias("details"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit("Company 1"), F.lit("Company 9"))).alias("recipients"),
    )
    out = messages.fan_out(messages.alert_rows(alerts), recipients(spark, root), ["email", "webhook"])
    return jobs.run_available(spark, out.select("id", "recipient_id", "channel"), "outbox")


@register(
    "stream_tracking_notifications",
    "E-14 F-14",
    """SELECT t.id, t.shipment_id, t.event_type, v.customer_id, c.name FROM tracking_events t JOIN voyages v ON v.id = t.shipment_id
       JOIN customers c ON c.id = v.customer_id WHERE t.event_type IN ('departed', 'arrived', 'delayed', 'customs_cleared')""",
)
def stream_tracking_notifications(spark, root):
    events = shapes.tracking_from_events(shapes.event_stream(spark, root))
    out = jobs.tracking_notifications(events, shapes.voyages(spark, root), shapes.customers(spark, root))
    return jobs.run_available(spark, out.select("id", "shipment_id", "event_type", "customer_id", "name"), "tracking")


def _live_sql(unit: str) -> str:
    return f"""SELECT date_trunc('{unit}', ts) AS window_start, count(*) AS shipments, count(*) FILTER (logistics_delay) AS delayed,
         100e0 * count(*) FILTER (logistics_delay) / count(*) AS delay_rate, avg(delay_probability) AS avg_probability FROM scored GROUP BY 1
       HAVING window_start + INTERVAL 1 {unit} <= {_CLOSED}"""


@register("stream_kpis_daily", "E-15", _live_sql("day"))
def stream_kpis_daily(spark, root):
    out = jobs.run_available(spark, jobs.live_kpis(stream_updates(spark, root), "1 day"), "kpis")
    return ntz(out.drop("window_end"), "window_start")


@register("stream_kpis_hourly", "E-15", _live_sql("hour"))
def stream_kpis_hourly(spark, root):
    out = jobs.run_available(spark, jobs.live_kpis(stream_updates(spark, root), "1 hour"), "kpis")
    return ntz(out.drop("window_end"), "window_start")


@register("stream_without_repeats", "E-16", "SELECT event_id, event_type FROM events")
def stream_without_repeats(spark, root):
    """Every event arrives twice and leaves once."""
    twice = shapes.event_stream(spark, root).unionByName(shapes.event_stream(spark, root))
    out = jobs.without_repeats(twice).select("event_id", "event_type")
    return jobs.run_available(spark, out, "unique")
