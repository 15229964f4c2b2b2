"""Voyage-generation tables derived from flat readings.

Every field of a voyage or a prediction follows from columns of its reading: ports from
the position, the time under way from the ports' distance, cargo from stock and demand,
predictions from the heuristics that score live rows.  A customer's number, company and
channel are assigned by a stable hash of the asset, as there is no other source, so a
re-run gives the same tables on any number of executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import CARGO_TYPES, COMPANIES, CONTACT_CHANNELS, CONTAINER_TYPES, DESTINATION_PORTS, PORT_COORDINATES, PORT_NAMES
from ..functions.risk import accuracy_of, delay_probability, estimated_delay_hours
from ..functions.scalars import plus_hours, stable_bucket, stable_hash, stable_pick


def customers(readings: DataFrame) -> DataFrame:
    """One customer per asset."""
    assets = readings.select("asset_id").distinct()
    company = stable_pick(COMPANIES, "asset_id", F.lit("company"))
    return assets.select(
        stable_hash("asset_id", digits=12).alias("customer_id"),
        "asset_id",
        F.concat(F.lit("Fleet Owner "), "asset_id").alias("name"),
        F.concat(
            F.lower("asset_id"), F.lit("@"), F.translate(F.lower(company), " ", ""), F.lit(".com")
        ).alias("email"),
        F.concat(F.lit("+1-555-"), (stable_bucket(9000, "asset_id", F.lit("phone")) + 1000).cast("string")).alias("phone"),
        company.alias("company"),
        stable_pick(CONTACT_CHANNELS, "asset_id", F.lit("channel")).alias("preferred_communication"),
        F.lit("en").alias("language_preference"),
        F.lit("UTC").alias("timezone"),
    )


#: (name, latitude, longitude) of the ports a voyage may begin at, and the upper ends of the cargo classes.
PORTS = [(name, lat, lon) for name in PORT_NAMES for key, lat, lon in PORT_COORDINATES if key == name.lower()]
WEIGHT_ENDS, DEMAND_ENDS = [2000, 3000, 4000], [150, 200, 250]
PRIORITY_FREQUENCY = 6


def by_distance(lat: Column, lon: Column, ports: list[tuple[str, float, float]]) -> Column:
    """The ports as (distance, name), nearest first; distances are in degrees."""
    gap = lambda a, b: F.sqrt((lat - a) * (lat - a) + (lon - b) * (lon - b))
    return F.array_sort(F.array(*[F.struct(gap(a, b).alias("distance"), F.lit(name).alias("name")) for name, a, b in ports]))


def _class(value: Column, ends: list[int], names: list[str]) -> Column:
    out = F.lit(names[-1])
    for end, name in reversed(list(zip(ends, names))):
        out = F.when(value < end, name).otherwise(out)
    return out


def shipments(readings: DataFrame, owners: DataFrame) -> DataFrame:
    """One voyage per reading; assets without an owner go to the first customer.

    It begins at the nearest port, on the day of the reading, and goes to the nearest
    other one of the large ports; it takes a week, and a day for every 15 degrees that
    port lies from the reading.
    """
    first = owners.agg(F.min("customer_id").alias("customer_id"))
    mapped = readings.join(owners.select("asset_id", "customer_id"), "asset_id", "left").withColumn(
        "customer_id", F.coalesce("customer_id", first.scalar())
    )
    lat, lon = F.col("latitude"), F.col("longitude")
    large = by_distance(lat, lon, [p for p in PORTS if p[0] in DESTINATION_PORTS])
    base = (
        mapped.withColumn("origin_port", F.get(by_distance(lat, lon, PORTS), F.lit(0))["name"])
        .withColumn("goal", F.get(F.filter(large, lambda p: p["name"] != F.col("origin_port")), F.lit(0)))
        .withColumn("destination_port", F.col("goal.name"))
        .withColumn("scheduled_departure", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    )
    base = base.withColumn("scheduled_arrival", plus_hours("scheduled_departure", 24 * (F.floor(F.col("goal.distance") / 15) + 7)))
    base = base.withColumn("cargo_weight", F.col("inventory_level") * 10)
    late = F.when(F.col("logistics_delay"), F.col("waiting_time")).otherwise(0)
    return base.select(
        "id",
        F.concat(F.lit("SHP"), (F.col("id") + 1000).cast("string")).alias("shipment_id"),
        "customer_id",
        "origin_port",
        "destination_port",
        F.concat_ws("-", "origin_port", "destination_port").alias("route"),
        _class(F.col("cargo_weight"), WEIGHT_ENDS, CONTAINER_TYPES).alias("container_type"),
        "cargo_weight",
        (F.col("user_transaction_amount") * F.col("inventory_level")).alias("cargo_value"),
        _class(F.col("demand_forecast"), DEMAND_ENDS, CARGO_TYPES).alias("cargo_type"),
        "scheduled_departure",
        "scheduled_arrival",
        plus_hours("scheduled_arrival", F.col("waiting_time")).alias("estimated_arrival"),
        F.when(F.col("shipment_status") == "Delivered", plus_hours("scheduled_arrival", late)).alias("actual_arrival"),
        F.when(F.col("shipment_status") == "Delivered", "delivered")
        .when(F.col("shipment_status") == "Delayed", "delayed")
        .when(F.col("shipment_status") == "Pending", "pending")
        .otherwise("in_transit")
        .alias("status"),
        (F.col("user_purchase_frequency") >= PRIORITY_FREQUENCY).alias("is_priority"),
        F.col("ts").alias("created_at"),
    )


def predictions(readings: DataFrame) -> DataFrame:
    """One prediction per reading by the heuristics for live rows: estimated hours where a delay is likelier than not."""
    actual = F.when(F.col("logistics_delay"), F.col("waiting_time")).otherwise(0).cast("double")
    p = delay_probability("traffic_status", "waiting_time", "logistics_delay_reason")
    hours = estimated_delay_hours("waiting_time", "logistics_delay_reason")
    return (
        readings.withColumn("actual_delay_hours", actual)
        .withColumn("delay_probability", p)
        .withColumn("predicted_delay_hours", F.when(F.col("delay_probability") > 0.5, hours).otherwise(0.0))
        .select(
            F.col("id").alias("shipment_id"),
            "predicted_delay_hours",
            "delay_probability",
            F.greatest(F.col("delay_probability"), 1 - F.col("delay_probability")).alias("confidence_score"),
            F.lit("1.0").alias("model_version"),
            (F.col("temperature") / 30).alias("weather_factor"),
            (F.col("asset_utilization") / 100).alias("port_congestion_factor"),
            F.lit(0.5).alias("route_complexity_factor"),
            F.col("ts").alias("prediction_date"),
            "actual_delay_hours",
            accuracy_of("predicted_delay_hours", "actual_delay_hours").alias("prediction_accuracy"),
        )
    )


def communications(readings: DataFrame, voyages: DataFrame, owners: DataFrame) -> DataFrame:
    """One message per delayed voyage."""
    delayed = voyages.filter(F.col("status") == "delayed").select("id", "shipment_id", "customer_id")
    reason = F.lower(
        F.when(F.coalesce("logistics_delay_reason", F.lit("None")) == "None", "Operational delays").otherwise(
            F.col("logistics_delay_reason")
        )
    )
    joined = (
        delayed.join(readings.select("id", "ts", "waiting_time", "traffic_status", "logistics_delay_reason"), "id")
        .join(owners.select("customer_id", "name", "email", "phone", "preferred_communication"), "customer_id")
        .withColumn("type", F.col("preferred_communication"))
        .withColumn("reason", reason)
    )
    is_mail = F.col("type") == "email"
    return joined.select(
        F.col("id").alias("shipment_key"),
        "customer_id",
        "type",
        F.when(is_mail, F.concat(F.lit("Shipment Update - "), "shipment_id")).alias("subject"),
        F.when(
            is_mail,
            F.concat(F.lit("Dear "), "name", F.lit(", shipment "), "shipment_id", F.lit(" may be late: "), "reason", F.lit(".")),
        )
        .otherwise(F.concat(F.lit("Alert: shipment "), "shipment_id", F.lit(" delayed, "), "reason", F.lit(".")))
        .alias("message"),
        F.when(is_mail, F.col("email")).otherwise(F.coalesce("phone", F.lit("+1-555-0000"))).alias("recipient"),
        F.to_json(F.struct(F.col("reason").alias("delay_reason"), "waiting_time", "traffic_status")).alias("personalization_data"),
        F.col("ts").alias("sent_at"),
        F.lit("delivered").alias("delivery_status"),
    )
