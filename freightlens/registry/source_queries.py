"""Scans, loads, probes and appends over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning
from ..session import new_path
from ..sources import etl, files, shapes
from .core import register

AS_OF = "2024-01-31"


def raw_text_rows(rows):
    """Readings as the text file would hold them, with the usual dirt in it."""
    i = F.col("id")
    return rows.select(
        F.when(i % 211 == 0, "not a date")
        .when(i % 10 == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("Timestamp"),
        F.col("asset_id").alias("Asset_ID"),
        F.when(i % 97 == 0, "90.01").otherwise(F.col("latitude").cast("string")).alias("Latitude"),
        F.col("longitude").cast("string").alias("Longitude"),
        F.when(i % 101 == 0, "abc").otherwise(F.concat(F.col("inventory_level").cast("string"), F.lit(".0"))).alias("Inventory_Level"),
        F.col("shipment_status").alias("Shipment_Status"),
        F.col("temperature").cast("string").alias("Temperature"),
        F.col("humidity").cast("string").alias("Humidity"),
        F.when(i % 7 != 0, F.col("traffic_status")).alias("Traffic_Status"),
        F.when(i % 103 != 0, F.col("waiting_time").cast("string")).alias("Waiting_Time"),
        F.col("user_transaction_amount").cast("string").alias("User_Transaction_Amount"),
        F.col("user_purchase_frequency").cast("string").alias("User_Purchase_Frequency"),
        F.when(i % 13 == 0, "Strike").otherwise(F.col("logistics_delay_reason")).alias("Logistics_Delay_Reason"),
        F.col("asset_utilization").cast("string").alias("Asset_Utilization"),
        F.col("demand_forecast").cast("string").alias("Demand_Forecast"),
        F.when(F.col("logistics_delay"), F.when(i % 2 == 0, "1").otherwise("True"))
        .otherwise(F.when(i % 5 == 0, "true").otherwise("0"))
        .alias("Logistics_Delay"),
    )


_CLEAN_SQL = """
SELECT CASE WHEN id % 211 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE date_trunc('second', ts) END AS ts,
  asset_id, latitude, longitude, inventory_level,
  CASE WHEN shipment_status = 'Pending' THEN 'In Transit' ELSE shipment_status END AS shipment_status,
  temperature, humidity,
  CASE WHEN id % 7 = 0 THEN 'Clear' ELSE traffic_status END AS traffic_status, waiting_time,
  user_transaction_amount, user_purchase_frequency,
  CASE WHEN id % 13 = 0 THEN 'Other' ELSE logistics_delay_reason END AS logistics_delay_reason,
  asset_utilization, demand_forecast, logistics_delay
FROM readings WHERE id % 97 <> 0 AND id % 101 <> 0 AND id % 103 <> 0
"""


@register("csv_scan_clean", "S-01 C-01", _CLEAN_SQL)
def csv_scan_clean(spark, root):
    path = new_path(spark, "csv")
    raw_text_rows(shapes.readings(spark, root)).write.option("header", True).csv(path)
    return cleaning.clean_records(files.scan_csv(spark, path), F.lit(AS_OF))


@register(
    "csv_scan_defaults",
    "S-02",
    """SELECT asset_id, latitude, waiting_time, 'In Transit' AS status, 'Normal' AS traffic_conditions,
         'Clear' AS weather_conditions, 'None' AS delay_reason FROM readings""",
)
def csv_scan_defaults(spark, root):
    path = new_path(spark, "csv")
    part = shapes.readings(spark, root).select("asset_id", "latitude", "waiting_time")
    part.write.option("header", True).csv(path)
    return files.scan_training_csv(spark, path, part.schema)


@register("table_scan_active", "S-03", "SELECT id, asset_id, ts, waiting_time FROM readings WHERE is_active")
def table_scan_active(spark, root):
    return files.active_rows(shapes.readings(spark, root)).select("id", "asset_id", "ts", "waiting_time")


@register("dataset_probe", "S-04")
def dataset_probe(spark, root):
    return files.probe(shapes.table(spark, root, "events"))


@register(
    "dataset_probe_counts",
    "S-04",
    """SELECT 'events' AS "table", count(*) AS total_records, 'Dataset available' AS status FROM events
       UNION ALL SELECT 'orders', count(*), 'Dataset available' FROM orders
       UNION ALL SELECT 'nothing', 0, 'Dataset file not found'""",
)
def dataset_probe_counts(spark, root):
    """What a probe says that doesn't depend on how the files were written."""
    events, orders = shapes.table(spark, root, "events"), shapes.table(spark, root, "orders")
    probes = {"events": events, "orders": orders, "nothing": events.filter("event_id IS NULL")}
    found = [files.probe(df).select(F.lit(name).alias("table"), "total_records", "status") for name, df in probes.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("bulk_load_once", "S-05", "SELECT count(*) AS stored_rows FROM readings")
def bulk_load_once(spark, root):
    path = new_path(spark, "readings")
    rows = shapes.readings(spark, root)
    files.bulk_load(rows, path)
    return files.bulk_load(rows.filter("is_active"), path)  # populated: left alone


@register("bulk_load_replace", "S-05", "SELECT count(*) AS stored_rows FROM readings WHERE is_active")
def bulk_load_replace(spark, root):
    path = new_path(spark, "readings")
    rows = shapes.readings(spark, root)
    files.bulk_load(rows, path)
    return files.bulk_load(rows.filter("is_active"), path, replace=True)


_H = "CAST('0x' || substr(md5({0}), 1, {1}) AS BIGINT)"


def _bucket(n: int, *cols: str) -> str:
    text = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"({_H.format(text, 8)} % {n})"


def _pick(values, *cols: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"([{items}])[{_bucket(len(values), *cols)} + 1]"


_OWNERS = f"""SELECT {_H.format("asset_id", 12)} AS customer_id, asset_id, 'Fleet Owner ' || asset_id AS name,
  lower(asset_id) || '@' || replace(lower(company), ' ', '') || '.com' AS email,
  '+1-555-' || CAST({_bucket(9000, "asset_id", "'phone'")} + 1000 AS VARCHAR) AS phone, company,
  {_pick(etl.CONTACT_CHANNELS, "asset_id", "'channel'")} AS preferred_communication,
  'en' AS language_preference, 'UTC' AS timezone
FROM (SELECT asset_id, {_pick(etl.COMPANIES, "asset_id", "'company'")} AS company FROM (SELECT DISTINCT asset_id FROM readings))"""


@register("etl_customers", "S-06 X-14", _OWNERS)
def etl_customers(spark, root):
    return etl.customers(shapes.readings(spark, root))


def _by_distance(ports) -> str:
    """The ports as a list of (distance, name), nearest first."""
    items = ", ".join(f"{{'distance': sqrt((latitude - {a!r}e0) * (latitude - {a!r}e0) + (longitude - {b!r}e0) * (longitude - {b!r}e0)), 'name': '{n}'}}" for n, a, b in ports)
    return f"list_sort([{items}])"


_LARGE = [p for p in etl.PORTS if p[0] in etl.DESTINATION_PORTS]


def _class(value: str, ends, names) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {e} THEN '{n}'" for e, n in zip(ends, names)) + f" ELSE '{names[-1]}' END"


_ETL_SHIPMENTS = f"""WITH owners AS ({_OWNERS}),
placed AS (SELECT *, ({_by_distance(etl.PORTS)})[1].name AS origin_port, date_trunc('day', ts) AS scheduled_departure FROM readings),
aimed AS (SELECT *, (list_filter({_by_distance(_LARGE)}, lambda p: p.name <> origin_port))[1] AS goal FROM placed),
routed AS (SELECT *, goal.name AS destination_port, CAST(scheduled_departure AS TIMESTAMP) + to_days(CAST(floor(goal.distance / 15) AS INTEGER) + 7) AS scheduled_arrival FROM aimed)
SELECT id, 'SHP' || CAST(id + 1000 AS VARCHAR) AS shipment_id,
  coalesce(o.customer_id, (SELECT min(customer_id) FROM owners)) AS customer_id, origin_port, destination_port,
  origin_port || '-' || destination_port AS route, {_class("inventory_level * 10", etl.WEIGHT_ENDS, etl.CONTAINER_TYPES)} AS container_type,
  inventory_level * 10 AS cargo_weight, user_transaction_amount * inventory_level AS cargo_value,
  {_class("demand_forecast", etl.DEMAND_ENDS, etl.CARGO_TYPES)} AS cargo_type, CAST(scheduled_departure AS TIMESTAMP) AS scheduled_departure, scheduled_arrival,
  scheduled_arrival + to_hours(waiting_time) AS estimated_arrival,
  CASE WHEN shipment_status = 'Delivered' THEN scheduled_arrival
    + to_hours(CASE WHEN logistics_delay THEN waiting_time ELSE 0 END) END AS actual_arrival,
  CASE shipment_status WHEN 'Delivered' THEN 'delivered' WHEN 'Delayed' THEN 'delayed' WHEN 'Pending' THEN 'pending'
    ELSE 'in_transit' END AS status,
  user_purchase_frequency >= {etl.PRIORITY_FREQUENCY} AS is_priority, ts AS created_at
FROM routed LEFT JOIN owners o USING (asset_id)"""


@register("etl_shipments", "S-06 J-15", _ETL_SHIPMENTS)
def etl_shipments(spark, root):
    rows = shapes.readings(spark, root)
    return etl.shipments(rows, etl.customers(rows))


@register(
    "etl_predictions",
    "S-06 C-30 C-15 C-17",
    """SELECT id AS shipment_id, p AS predicted_delay_hours, delay_probability, greatest(delay_probability, 1 - delay_probability) AS confidence_score,
  '1.0' AS model_version, temperature / 30 AS weather_factor, asset_utilization / 100 AS port_congestion_factor,
  0.5e0 AS route_complexity_factor, ts AS prediction_date, a AS actual_delay_hours,
  CASE WHEN a > 0 THEN greatest(0e0, least(1e0, 1 - abs(p - a) / greatest(p, a, 1e0))) END AS prediction_accuracy
FROM (SELECT *, CASE WHEN logistics_delay THEN CAST(waiting_time AS DOUBLE) ELSE 0e0 END AS a, CASE WHEN delay_probability > 0.5e0 THEN
    greatest(0e0, waiting_time / 60e0 * CASE logistics_delay_reason WHEN 'Weather' THEN 2e0 WHEN 'Mechanical Failure' THEN 3e0 WHEN 'Traffic' THEN 1.5e0 ELSE 1e0 END)
    ELSE 0e0 END AS p FROM scored)""",
)
def etl_predictions(spark, root):
    return etl.predictions(shapes.readings(spark, root))


@register(
    "etl_communications",
    "S-06 X-13",
    f"""WITH owners AS ({_OWNERS}),
d AS (SELECT *, preferred_communication AS type, 'SHP' || CAST(id + 1000 AS VARCHAR) AS sid,
  lower(CASE WHEN coalesce(logistics_delay_reason, 'None') = 'None' THEN 'Operational delays' ELSE logistics_delay_reason END) AS reason
  FROM readings JOIN owners USING (asset_id) WHERE shipment_status = 'Delayed')
SELECT id AS shipment_key, customer_id, type, CASE WHEN type = 'email' THEN 'Shipment Update - ' || sid END AS subject,
  CASE WHEN type = 'email' THEN 'Dear ' || name || ', shipment ' || sid || ' may be late: ' || reason || '.'
    ELSE 'Alert: shipment ' || sid || ' delayed, ' || reason || '.' END AS message,
  CASE WHEN type = 'email' THEN email ELSE coalesce(phone, '+1-555-0000') END AS recipient,
  CAST(json_object('delay_reason', reason, 'waiting_time', waiting_time, 'traffic_status', traffic_status) AS VARCHAR) AS personalization_data,
  ts AS sent_at, 'delivered' AS delivery_status
FROM d""",
)
def etl_communications(spark, root):
    rows = shapes.readings(spark, root)
    owners = etl.customers(rows)
    return etl.communications(rows, etl.shipments(rows, owners), owners)


@register(
    "append_predictions",
    "S-07",
    """SELECT strftime(prediction_date, '%Y-%m') AS prediction_period, count(*) AS stored, sum(predicted_delay_hours) AS hours,
         sum(weather_factor) AS weather
       FROM predictions GROUP BY 1""",
)
def append_predictions(spark, root):
    path = new_path(spark, "predictions")
    rows = shapes.predictions(spark, root)
    files.append_predictions(rows, path, ["weather_factor", "model_version"], granularity="monthly")
    back = spark.read.schema("predicted_delay_hours double, features_used string, prediction_period string").parquet(path)
    return back.groupBy("prediction_period").agg(
        F.count("*").alias("stored"),
        F.sum("predicted_delay_hours").alias("hours"),
        F.sum(F.get_json_object("features_used", "$.weather_factor").cast("double")).alias("weather"),
    )


@register(
    "append_communications",
    "S-08",
    """SELECT id, type, delivery_status, sent_at, CASE WHEN delivery_status = 'delivered' THEN sent_at END AS delivered_at
       FROM communications""",
)
def append_communications(spark, root):
    path = new_path(spark, "communications")
    files.append_communications(shapes.communications(spark, root), path)
    return spark.read.parquet(path).select("id", "type", "delivery_status", "sent_at", "delivered_at")


@register(
    "text_date_range",
    "S-09 C-04",
    """SELECT strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day, count(*) AS parsed_rows
       FROM readings WHERE id % 211 <> 0""",
)
def text_date_range(spark, root):
    return files.date_range_of_text(raw_text_rows(shapes.readings(spark, root)), "Timestamp")


_COVERAGE = """SELECT min(ts) AS min_timestamp, max(ts) AS max_timestamp, count(*) AS total_records,
  count(*) FILTER (ts >= TIMESTAMP '{0}' AND ts < TIMESTAMP '{1}' + INTERVAL 1 DAY) AS records_in_range,
  '{2}' AS verdict FROM readings"""


@register("coverage_in_range", "S-10", _COVERAGE.format("2024-01-10", "2024-01-20", "ok"))
def coverage_in_range(spark, root):
    return files.coverage(shapes.readings(spark, root), "2024-01-10", "2024-01-20")


@register("coverage_outside", "S-10", _COVERAGE.format("2025-01-10", "2025-01-20", "outside"))
def coverage_outside(spark, root):
    return files.coverage(shapes.readings(spark, root), "2025-01-10", "2025-01-20")
