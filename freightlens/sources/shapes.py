"""Shipment tables derived from the generic star-schema tables.

The engine itself works on shipment readings, voyages, customers, predictions,
communications, tracking events and external data.  These views give the generic
tables those shapes with plain projections, so filters and column pruning still
reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def readings_from_events(events: DataFrame) -> DataFrame:
    """Current-generation shipment rows; works on a batch or a streaming frame."""
    e = events.withColumn("k", _k())
    delayed = (F.col("event_type") == "error") | ((F.col("k") % 3 == 1) & (F.col("k") % 61 > 30))
    eid = F.col("event_id")
    return e.select(
        eid.alias("id"),
        F.concat(F.lit("Truck_"), (F.col("user_id") % 10 + 1).cast("string")).alias("asset_id"),
        "ts",
        F.when(F.col("event_type") == "purchase", "Delivered")
        .when(F.col("event_type") == "error", "Delayed")
        .when(F.col("event_type") == "signup", "Pending")
        .otherwise("In Transit")
        .alias("shipment_status"),
        F.when(F.col("k") % 3 == 0, "Clear").when(F.col("k") % 3 == 1, "Heavy").otherwise("Detour").alias("traffic_status"),
        (F.col("k") % 61).alias("waiting_time"),
        delayed.alias("logistics_delay"),
        F.when(~delayed, "None")
        .when(F.col("k") % 4 == 0, "Weather")
        .when(F.col("k") % 4 == 1, "Traffic")
        .when(F.col("k") % 4 == 2, "Mechanical Failure")
        .otherwise("None")
        .alias("logistics_delay_reason"),
        ((eid * 7919 % 18001).cast("double") / 100 - 90).alias("latitude"),
        ((eid * 104729 % 36001).cast("double") / 100 - 180).alias("longitude"),
        (eid % 400 + 100).cast("int").alias("inventory_level"),
        F.when(eid % 17 != 0, (eid % 13 + 18).cast("double")).alias("temperature"),
        F.when(eid % 19 != 0, (eid % 31 + 50).cast("double")).alias("humidity"),
        F.col("value").alias("user_transaction_amount"),
        (eid % 10 + 1).cast("int").alias("user_purchase_frequency"),
        (eid % 41 + 60).cast("double").alias("asset_utilization"),
        (eid % 201 + 100).cast("double").alias("demand_forecast"),
        (eid % 50 != 0).alias("is_active"),
    )


def readings(spark: SparkSession, root: str) -> DataFrame:
    return readings_from_events(table(spark, root, "events"))


def voyages(spark: SparkSession, root: str) -> DataFrame:
    """Voyage-generation shipments: port pair, schedule, cargo and status."""
    nation, region = table(spark, root, "nation"), table(spark, root, "region")
    ports = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("port_key"),
        F.concat_ws("_", "r_name", F.col("n_nationkey").cast("string")).alias("port"),
    )
    orders = table(spark, root, "orders")
    customer = table(spark, root, "customer").select("c_custkey", "c_nationkey")
    key = F.col("o_orderkey")
    base = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("dest_key", ((F.col("c_nationkey") + 1 + key % 5) % 25).cast("int"))
        .withColumn("scheduled_arrival", F.expr("o_orderdate + make_dt_interval(cast(7 + o_orderkey % 15 as int))"))
    )
    origin = ports.select(F.col("port_key").alias("origin_key"), F.col("port").alias("origin_port"))
    dest = ports.select(F.col("port_key").alias("dest_port_key"), F.col("port").alias("destination_port"))
    joined = base.join(origin, F.col("c_nationkey") == F.col("origin_key")).join(
        dest, F.col("dest_key") == F.col("dest_port_key")
    )
    arrived = (F.col("o_orderstatus") == "F") | ((F.col("o_orderstatus") == "O") & (key % 3 == 0))
    return joined.select(
        key.alias("id"),
        F.concat(F.lit("SHP"), (key + 1000).cast("string")).alias("shipment_id"),
        F.col("o_custkey").alias("customer_id"),
        "origin_port",
        "destination_port",
        F.concat_ws("-", "origin_port", "destination_port").alias("route"),
        F.when(key % 4 == 0, "20GP").when(key % 4 == 1, "40GP").when(key % 4 == 2, "40HC").otherwise("45HC").alias("container_type"),
        (F.col("o_totalprice") / 10).alias("cargo_weight"),
        F.col("o_totalprice").alias("cargo_value"),
        F.when(key % 3 == 0, "electronics").when(key % 3 == 1, "textiles").otherwise("machinery").alias("cargo_type"),
        F.col("o_orderdate").alias("scheduled_departure"),
        "scheduled_arrival",
        F.when(arrived, F.expr("scheduled_arrival + make_dt_interval(0, cast((o_orderkey * 31 % 97) - 24 as int))")).alias("actual_arrival"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "delayed")
        .when(key % 2 == 0, "pending")
        .otherwise("in_transit")
        .alias("status"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_priority"),
        F.col("o_orderdate").alias("created_at"),
    )


def customers(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("c_custkey")
    segment = F.col("c_mktsegment")
    return table(spark, root, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com")).alias("email"),
        F.when(key % 7 != 0, F.concat(F.lit("+1-555-"), F.lpad((key % 10000).cast("string"), 4, "0"))).alias("phone"),
        F.concat(F.lit("Company "), (key % 10).cast("string")).alias("company"),
        F.when(segment == "MACHINERY", "sms").when(segment == "BUILDING", "phone").when(segment == "FURNITURE", "webhook").otherwise("email").alias("preferred_communication"),
        (key % 20 != 0).alias("is_active"),
    )


def predictions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("shipment_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_shipdate").alias("prediction_date"),
        F.col("l_quantity").alias("predicted_delay_hours"),
        F.least(F.col("l_quantity") / 48, F.lit(1.0)).alias("delay_probability"),
        (1 - F.col("l_discount")).alias("confidence_score"),
        F.when(F.col("l_returnflag") == "A", "forest").when(F.col("l_returnflag") == "N", "boosted").otherwise("ensemble").alias("model_name"),
        F.col("l_linestatus").alias("model_version"),
        F.col("l_tax").alias("weather_factor"),
        F.when(
            F.col("l_linestatus") == "F",
            F.greatest((F.col("l_orderkey") * 31 % 97 - 24).cast("double"), F.lit(0.0)),
        ).alias("actual_delay_hours"),
    )


def communications(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumn("k", _k())
    return e.select(
        F.col("event_id").alias("id"),
        F.expr("event_id div 4").alias("shipment_id"),
        F.col("user_id").alias("customer_id"),
        F.when(F.col("k") % 4 == 0, "email").when(F.col("k") % 4 == 1, "sms").when(F.col("k") % 4 == 2, "phone").otherwise("webhook").alias("type"),
        F.col("ts").alias("sent_at"),
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type").isin("purchase", "click"), "delivered")
        .otherwise("sent")
        .alias("delivery_status"),
        (F.col("k") % 10 != 0).alias("ai_generated"),
        (F.col("value") / 500).alias("engagement_score"),
    )


def tracking_from_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.expr("event_id div 4").alias("shipment_id"),
        F.when(kind == "purchase", "arrived")
        .when(kind == "click", "departed")
        .when(kind == "error", "delayed")
        .when(kind == "signup", "customs_cleared")
        .otherwise("in_transit")
        .alias("event_type"),
        F.col("ts").alias("event_timestamp"),
        F.col("props").alias("event_data"),
    )


def tracking_events(spark: SparkSession, root: str) -> DataFrame:
    return tracking_from_events(table(spark, root, "events"))


def external_data(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 2 == 0, "weather").otherwise("port_status").alias("data_type"),
        (F.col("user_id") % 25).cast("string").alias("data_key"),
        F.col("value").alias("data_value"),
        F.col("ts").alias("created_at"),
        F.expr("ts + interval '1' hour").alias("expires_at"),
    )


def event_stream(spark: SparkSession, root: str, files_per_batch: int = 200) -> DataFrame:
    """The event table as a file stream; the glob matches a file or a folder.

    The batch size bounds how much a catch-up run holds in state at once.
    """
    schema = table(spark, root, "events").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(f"{root}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))
