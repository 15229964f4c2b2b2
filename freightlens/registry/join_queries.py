"""Joins over voyages, predictions, events and external data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..sources import etl, shapes
from .core import register
from .source_queries import _ETL_SHIPMENTS

_BAND = "CASE WHEN predicted_delay_hours >= 24 THEN 'high' WHEN predicted_delay_hours >= 8 THEN 'medium' WHEN predicted_delay_hours IS NOT NULL THEN 'low' END"


@register(
    "recent_shipments",
    "J-01 C-21",
    f"""SELECT n.id, n.customer_id, coalesce(c.name, 'Unknown') AS customer_name, n.status, l.delay_probability,
         l.predicted_delay_hours, {_BAND} AS risk_level
       FROM (SELECT * FROM voyages ORDER BY created_at DESC, id LIMIT 20) n
       LEFT JOIN customers c ON c.id = n.customer_id LEFT JOIN latest l ON l.shipment_id = n.id""",
)
def recent_shipments(spark, root):
    out = joins.recent_shipments(shapes.voyages(spark, root), shapes.customers(spark, root), shapes.predictions(spark, root))
    return out.select("id", "customer_id", "customer_name", "status", "delay_probability", "predicted_delay_hours", "risk_level")


@register(
    "latest_prediction",
    "J-02 W-05",
    """SELECT v.id, l.predicted_delay_hours, l.delay_probability, l.prediction_date
       FROM voyages v LEFT JOIN latest l ON l.shipment_id = v.id""",
)
def latest_prediction(spark, root):
    out = joins.with_latest_prediction(shapes.voyages(spark, root), shapes.predictions(spark, root))
    return out.select("id", "predicted_delay_hours", "delay_probability", "prediction_date")


@register(
    "track_voyages",
    "J-03",
    """SELECT v.id, l.predicted_delay_hours, e.event_id, e.event_type, e.event_timestamp, e.event_rank
       FROM voyages v LEFT JOIN latest l ON l.shipment_id = v.id
       LEFT JOIN (SELECT shipment_id, id AS event_id, event_type, event_timestamp,
                    row_number() OVER (PARTITION BY shipment_id ORDER BY event_timestamp DESC, id DESC) AS event_rank
                  FROM tracking_events) e ON e.shipment_id = v.id""",
)
def track_voyages(spark, root):
    out = joins.track(shapes.voyages(spark, root), shapes.tracking_events(spark, root), shapes.predictions(spark, root))
    return out.select("id", "predicted_delay_hours", "event_id", "event_type", "event_timestamp", "event_rank")


@register(
    "high_risk_list",
    "J-04 T-06",
    """SELECT t.shipment_id AS id, v.customer_id, c.name AS customer_name, t.delay_probability, t.predicted_delay_hours,
         v.status, 'high' AS risk_level
       FROM (SELECT * FROM predictions WHERE delay_probability >= 0.7e0
             ORDER BY delay_probability DESC, shipment_id, l_linenumber, l_partkey, l_suppkey, predicted_delay_hours LIMIT 20) t
       JOIN voyages v ON v.id = t.shipment_id AND v.status IN ('pending', 'in_transit')
       LEFT JOIN customers c ON c.id = v.customer_id""",
)
def high_risk_list(spark, root):
    out = joins.high_risk_list(shapes.voyages(spark, root), shapes.customers(spark, root), shapes.predictions(spark, root))
    return out.select("id", "customer_id", "customer_name", "delay_probability", "predicted_delay_hours", "status", "risk_level")


@register(
    "predictions_of_voyages",
    "J-05",
    """SELECT v.status, count(*) AS n, avg(p.delay_probability) AS p FROM predictions p
       JOIN voyages v ON v.id = p.shipment_id GROUP BY 1""",
)
def predictions_of_voyages(spark, root):
    both = joins.predictions_of_voyages(shapes.predictions(spark, root), shapes.voyages(spark, root))
    return both.groupBy("status").agg(F.count("*").alias("n"), F.avg("delay_probability").alias("p"))


_HOURS = """greatest(0e0, waiting_time / 60e0 * CASE logistics_delay_reason WHEN 'Weather' THEN 2e0
  WHEN 'Mechanical Failure' THEN 3e0 WHEN 'Traffic' THEN 1.5e0 ELSE 1e0 END)"""
_TRAIN = f"""SELECT id, asset_id, CASE WHEN logistics_delay THEN {_HOURS} ELSE 0e0 END AS delay_hours,
  sqrt(latitude * latitude + longitude * longitude) * 100 AS distance_traveled,
  greatest(5e0, 20 - coalesce(waiting_time, 0) / 4e0) AS fuel_efficiency FROM readings"""


@register(
    "asset_statistics",
    "J-06 M-04 M-29",
    f"""WITH t AS ({_TRAIN}), s AS (SELECT asset_id, avg(delay_hours) AS asset_delay_hours_mean, stddev_samp(delay_hours) AS asset_delay_hours_std,
  count(delay_hours) AS asset_delay_hours_count, avg(fuel_efficiency) AS asset_fuel_efficiency_mean,
  avg(distance_traveled) AS asset_distance_traveled_mean FROM t GROUP BY 1)
SELECT t.id, s.* FROM t LEFT JOIN s USING (asset_id)""",
)
def asset_statistics(spark, root):
    from ..operators.features import derived_training_columns

    rows = derived_training_columns(shapes.readings(spark, root)).select(
        "id", "asset_id", "delay_hours", "distance_traveled", "fuel_efficiency"
    )
    return joins.with_asset_statistics(rows).drop("delay_hours", "distance_traveled", "fuel_efficiency")


_DELAY = "date_diff('second', scheduled_arrival, actual_arrival) / 3600e0"


@register(
    "route_statistics",
    "J-07 M-24",
    f"""SELECT v.id, s.m AS route_avg_delay, s.sd AS route_delay_std, s.md AS route_median_delay, s.n AS route_frequency
       FROM voyages v LEFT JOIN (SELECT origin_port, destination_port, avg({_DELAY}) AS m, stddev_samp({_DELAY}) AS sd,
         median({_DELAY}) AS md, count(*) AS n FROM voyages WHERE actual_arrival IS NOT NULL GROUP BY 1, 2) s
       USING (origin_port, destination_port)""",
)
def route_statistics(spark, root):
    return joins.with_route_statistics(shapes.voyages(spark, root)).select(
        "id", "route_avg_delay", "route_delay_std", "route_median_delay", "route_frequency"
    )


@register(
    "route_history",
    "J-08",
    f"""WITH r AS (SELECT origin_port, destination_port, {_DELAY} AS h FROM voyages WHERE actual_arrival IS NOT NULL),
       s AS (SELECT origin_port, destination_port, avg(h) AS m, median(h) AS md, stddev_pop(h) AS sd, max(h) AS mx, count(*) AS n
         FROM r GROUP BY 1, 2)
       SELECT v.id, coalesce(m, 0) AS route_avg_delay, coalesce(md, 0) AS route_median_delay, coalesce(sd, 0) AS route_delay_std,
         coalesce(mx, 0) AS route_max_delay, coalesce(n, 0) AS route_frequency
       FROM voyages v LEFT JOIN s USING (origin_port, destination_port)""",
)
def route_history(spark, root):
    v = shapes.voyages(spark, root)
    return joins.with_route_history(v, v).select(
        "id", "route_avg_delay", "route_median_delay", "route_delay_std", "route_max_delay", "route_frequency"
    )


@register(
    "port_congestion",
    "J-09",
    f"""WITH v AS ({_ETL_SHIPMENTS}), c(port, level) AS (VALUES ('shanghai', 0.7e0), ('los angeles', 0.8e0), ('singapore', 0.4e0),
         ('rotterdam', 0.3e0), ('hamburg', 0.3e0), ('antwerp', 0.4e0))
       SELECT v.id, coalesce(o.level, 0e0) AS origin_congestion, coalesce(d.level, 0e0) AS destination_congestion
       FROM v LEFT JOIN c o ON o.port = lower(origin_port) LEFT JOIN c d ON d.port = lower(destination_port)""",
)
def port_congestion(spark, root):
    rows = shapes.readings(spark, root)
    v = etl.shipments(rows, etl.customers(rows)).select("id", "origin_port", "destination_port")
    return joins.with_congestion(v, 0.0).drop("origin_port", "destination_port")


_PROBES = "SELECT id, ts, CAST(id % 25 AS VARCHAR) AS data_key, CASE WHEN id % 3 = 0 THEN 'weather' ELSE 'port_status' END AS data_type FROM readings"


def _external_probes(spark, root):
    kind = F.when(F.col("id") % 3 == 0, "weather").otherwise("port_status")
    return shapes.readings(spark, root).select("id", "ts", (F.col("id") % 25).cast("string").alias("data_key"), kind.alias("data_type"))


@register(
    "as_of_external",
    "J-12",
    f"""WITH r AS ({_PROBES})
       SELECT r.id, coalesce(x.data_value, 0.5e0) AS data_value, x.created_at AS observed_at FROM r
       LEFT JOIN (SELECT p.id, arg_max(e.data_value, (e.created_at, e.id)) AS data_value, max(e.created_at) AS created_at
         FROM r p JOIN external_data e ON e.data_key = p.data_key AND e.data_type = p.data_type AND e.created_at <= p.ts AND p.ts < e.expires_at
         GROUP BY 1) x USING (id)""",
)
def as_of_external(spark, root):
    found = joins.as_of_external(_external_probes(spark, root), shapes.external_data(spark, root), default=0.5)
    return found.select("id", "data_value", "observed_at")


@register(
    "as_of_external_lifetimes",
    "J-12",
    f"""WITH e AS (SELECT id, data_type, data_key, data_value, created_at, created_at + to_minutes(10 + id % 11 * 25) AS expires_at FROM external_data),
         r AS ({_PROBES})
       SELECT r.id, coalesce(x.data_value, 0.5e0) AS data_value, x.created_at AS observed_at FROM r
       LEFT JOIN (SELECT p.id, arg_max(e.data_value, (e.created_at, e.id)) AS data_value, max(e.created_at) AS created_at
         FROM r p JOIN e ON e.data_key = p.data_key AND e.data_type = p.data_type AND e.created_at <= p.ts AND p.ts < e.expires_at
         GROUP BY 1) x USING (id)""",
)
def as_of_external_lifetimes(spark, root):
    lives = F.expr("created_at + make_interval(0, 0, 0, 0, 0, 10 + cast(id % 11 as int) * 25)")
    external = shapes.external_data(spark, root).withColumn("expires_at", lives)
    return joins.as_of_external(_external_probes(spark, root), external, default=0.5).select("id", "data_value", "observed_at")


@register(
    "reference_check",
    "J-13",
    """SELECT (SELECT count(*) FROM voyages WHERE customer_id + id % 3 * 100000 IN (SELECT id FROM customers)) AS accepted,
         (SELECT count(*) FROM voyages WHERE customer_id + id % 3 * 100000 NOT IN (SELECT id FROM customers)) AS rejected""",
)
def reference_check(spark, root):
    rows = shapes.voyages(spark, root).select("id", (F.col("customer_id") + F.col("id") % 3 * 100000).alias("customer_id"))
    ok, bad = joins.check_references(rows, shapes.customers(spark, root), "customer_id")
    sides = ok.agg(F.count("*").alias("n"), F.lit("accepted").alias("side")).union(bad.agg(F.count("*"), F.lit("rejected")))
    return sides.groupBy().pivot("side", ["accepted", "rejected"]).agg(F.first("n"))


@register(
    "unique_new_rows",
    "J-13",
    """SELECT email, id FROM (SELECT 'c' || CAST(id % 1000 + 1000 AS VARCHAR) || '@example.com' AS email, min(id) AS id FROM readings GROUP BY 1)
       WHERE email NOT IN (SELECT email FROM customers)""",
)
def unique_new_rows(spark, root):
    batch = shapes.readings(spark, root).select(
        F.concat(F.lit("c"), (F.col("id") % 1000 + 1000).cast("string"), F.lit("@example.com")).alias("email"), "id"
    )
    return joins.new_and_unique(batch, shapes.customers(spark, root), "email", "id").select("email", "id")


@register(
    "asset_owner",
    "J-15",
    f"""WITH v AS ({_ETL_SHIPMENTS}) SELECT customer_id, count(*) AS n FROM v GROUP BY 1""",
)
def asset_owner(spark, root):
    rows = shapes.readings(spark, root)
    return etl.shipments(rows, etl.customers(rows)).groupBy("customer_id").agg(F.count("*").alias("n"))


@register(
    "message_context",
    "J-16 X-04",
    """SELECT m.id, v.shipment_id, c.name AS customer_name, v.status, l.predicted_delay_hours,
         v.scheduled_arrival + to_seconds(CAST(floor(l.predicted_delay_hours * 3600) AS BIGINT)) AS new_eta
       FROM communications m LEFT JOIN voyages v ON v.id = m.shipment_id LEFT JOIN customers c ON c.id = m.customer_id
       LEFT JOIN latest l ON l.shipment_id = m.shipment_id""",
)
def message_context(spark, root):
    requests = shapes.communications(spark, root).select("id", F.col("shipment_id").alias("shipment_key"), "customer_id")
    out = joins.message_context(
        requests, shapes.voyages(spark, root), shapes.customers(spark, root), shapes.predictions(spark, root)
    )
    return out.select("id", "shipment_id", "customer_name", "status", "predicted_delay_hours", "new_eta")
