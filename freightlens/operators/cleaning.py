"""Cleaning, validation and projection of shipment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import LEAKAGE_COLUMNS
from ..functions.risk import delay_probability
from ..functions.scalars import drop_nulls, map_value, nan_to_null, parse_bool, parse_timestamp, safe_double, safe_int

_MEAN_FILLED = ["temperature", "humidity", "asset_utilization", "demand_forecast"]
_CONSTANT_FILLED = {
    "user_transaction_amount": 0.0,
    "user_purchase_frequency": 1,
    "logistics_delay_reason": "None",
    "traffic_status": "Clear",
}


def map_status(c: Column | str) -> Column:
    return map_value(c, ["In Transit", "Delivered", "Delayed"], "In Transit")


def map_traffic(c: Column | str) -> Column:
    return map_value(c, ["Clear", "Heavy", "Detour"], "Clear")


def map_reason(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | (c == ""), "None").otherwise(
        map_value(c, ["None", "Weather", "Traffic", "Mechanical Failure"], "Other")
    )


def clean_records(raw: DataFrame, as_of: Column) -> DataFrame:
    """Typed rows from all-text rows; rows without usable position, stock or wait are dropped."""
    typed = raw.select(
        parse_timestamp("Timestamp", as_of).alias("ts"),
        F.trim(F.coalesce("Asset_ID", F.lit(""))).alias("asset_id"),
        safe_double("Latitude").alias("latitude"),
        safe_double("Longitude").alias("longitude"),
        safe_int("Inventory_Level").alias("inventory_level"),
        map_status("Shipment_Status").alias("shipment_status"),
        safe_double("Temperature").alias("temperature"),
        safe_double("Humidity").alias("humidity"),
        map_traffic("Traffic_Status").alias("traffic_status"),
        safe_int("Waiting_Time").alias("waiting_time"),
        safe_double("User_Transaction_Amount").alias("user_transaction_amount"),
        safe_int("User_Purchase_Frequency").alias("user_purchase_frequency"),
        map_reason("Logistics_Delay_Reason").alias("logistics_delay_reason"),
        safe_double("Asset_Utilization").alias("asset_utilization"),
        safe_double("Demand_Forecast").alias("demand_forecast"),
        parse_bool("Logistics_Delay").alias("logistics_delay"),
    )
    return valid_ranges(typed)


def valid_ranges(df: DataFrame) -> DataFrame:
    """Null and out-of-range positions, stock and waits are dropped."""
    return df.filter(
        F.col("latitude").between(-90, 90)
        & F.col("longitude").between(-180, 180)
        & (F.col("inventory_level") >= 0)
        & (F.col("waiting_time") >= 0)
    )


def fill_means(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls become the column mean; the means come from one scan as scalar subqueries."""
    wanted = [c for c in (columns or _MEAN_FILLED) if c in df.columns]
    means = df.agg(*[F.avg(c).alias(c) for c in wanted])
    return df.withColumns({c: F.coalesce(F.col(c), means.select(c).scalar()) for c in wanted})


def fill_constants(df: DataFrame) -> DataFrame:
    return df.na.fill({c: v for c, v in _CONSTANT_FILLED.items() if c in df.columns})


def clean_dataset(df: DataFrame) -> DataFrame:
    """Imputation, exact duplicate removal and range checks, in this order."""
    return valid_ranges(fill_constants(fill_means(df)).dropDuplicates())


def training_columns(df: DataFrame) -> DataFrame:
    """Lower-case names, training names, and no column that gives the label away."""
    renames = {"traffic_status": "traffic_conditions", "ts": "timestamp"}
    lower = df.toDF(*[c.lower() for c in df.columns])
    labelled = lower.withColumn("delay_present", F.col("logistics_delay").cast("int"))
    return labelled.withColumnsRenamed({k: v for k, v in renames.items() if k in lower.columns}).drop(*LEAKAGE_COLUMNS)


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: the name of every rule a row breaks.  A rule is the failing condition."""
    return df.withColumn("violations", drop_nulls(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    checked = check_rules(df, rules)
    good = F.size("violations") == 0
    return checked.filter(good).drop("violations"), checked.filter(~good)


def prediction_rules() -> dict[str, Column]:
    p, h = F.col("delay_probability"), F.col("predicted_delay_hours")
    return {
        "probability_range": p.isNull() | (p < 0) | (p > 1),
        "negative_delay": h.isNull() | (h < 0),
        "confidence_range": (F.col("confidence_score") < 0) | (F.col("confidence_score") > 1),
    }


def voyage_rules() -> dict[str, Column]:
    return {
        "negative_weight": F.col("cargo_weight") < 0,
        "negative_value": F.col("cargo_value") < 0,
        "arrival_before_departure": F.col("scheduled_arrival") <= F.col("scheduled_departure"),
        "missing_port": F.coalesce(F.length("origin_port"), F.lit(0)) * F.coalesce(F.length("destination_port"), F.lit(0)) == 0,
    }


def scored(df: DataFrame) -> DataFrame:
    """Readings with the heuristic delay probability."""
    return df.withColumn("delay_probability", delay_probability("traffic_status", "waiting_time", "logistics_delay_reason"))


def analytics_rows(df: DataFrame) -> DataFrame:
    """The projection every analysis reads: 18 columns, delay flag never null, calendar parts added."""
    keep = [
        "id", "asset_id", "ts", "shipment_status", "traffic_status", "waiting_time", "logistics_delay",
        "logistics_delay_reason", "latitude", "longitude", "inventory_level", "temperature", "humidity",
        "user_transaction_amount", "user_purchase_frequency", "asset_utilization", "demand_forecast",
    ]
    present = [c for c in keep if c in df.columns]
    flagged = df.select(*present).withColumn("logistics_delay", F.coalesce("logistics_delay", F.lit(False)))
    return flagged if "delay_probability" in flagged.columns else scored(flagged)


def summary_rows(df: DataFrame) -> DataFrame:
    return scored(df).select(
        "id", "asset_id", "shipment_status", "latitude", "longitude", "logistics_delay", "delay_probability", "ts"
    )


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row: NaN as null, timestamps in ISO form, null fields kept."""
    doubles = {c: nan_to_null(c) for c, t in df.dtypes if t in ("double", "float")}
    return df.select(
        F.to_json(
            F.struct(*[doubles.get(c, F.col(c)).alias(c) for c in df.columns]),
            {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"},
        ).alias("json")
    )
