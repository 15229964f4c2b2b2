"""Model features as column expressions and joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.risk import estimated_delay_hours, seasonal_weather_severity
from ..functions.scalars import stable_hash, temporal_parts
from ..session import stored
from .joins import with_asset_statistics, with_congestion, with_route_statistics


def derived_training_columns(readings: DataFrame) -> DataFrame:
    """Columns a training run expects and the readings lack.

    Efficiency falls with the time spent waiting, from 20 to 5; the weather follows from
    temperature and humidity (usual values where they are missing); delay hours from the
    delay flag and the estimated delay.
    """
    warm, wet = F.coalesce("temperature", F.lit(20.0)), F.coalesce("humidity", F.lit(60.0))
    weather = F.when(warm < 0, "Snowy").when((wet > 75) & (warm > 28), "Stormy").when(wet > 75, "Rainy").when(wet > 65, "Cloudy").otherwise("Clear")
    return readings.withColumns(
        {
            "distance_traveled": F.sqrt(F.col("latitude") * F.col("latitude") + F.col("longitude") * F.col("longitude")) * 100,
            "fuel_efficiency": F.greatest(F.lit(5.0), 20 - F.coalesce("waiting_time", F.lit(0)) / 4),
            "weather_conditions": weather,
            "traffic_conditions": F.col("traffic_status"),
            "delay_hours": F.when(
                F.col("logistics_delay"), estimated_delay_hours("waiting_time", "logistics_delay_reason")
            ).otherwise(0.0),
        }
    )


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    parts = {"hour": F.hour(ts), "day_of_week": F.weekday(ts), "month": F.month(ts), "quarter": F.quarter(ts)}
    out = df.withColumns(parts)
    cycles = {"hour": ("hour", 24), "day": ("day_of_week", 7), "month": ("month", 12)}
    waves: dict[str, Column] = {}
    for name, (source, length) in cycles.items():
        angle = F.col(source) * (2 * math.pi) / length
        waves[f"{name}_sin"] = F.sin(angle)
        waves[f"{name}_cos"] = F.cos(angle)
    return out.withColumns(waves)


def equal_width_bins(df: DataFrame, column: str, bins: int, prefix: str, out: str) -> DataFrame:
    """Bins over the column's own range, closed on the right, the lowest value in the first bin."""
    edges = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    low = edges.select("low").scalar()
    width = edges.select((F.col("high") - F.col("low")) / bins).scalar()
    index = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col(column) - low) / F.nullif(width, F.lit(0.0)))))
    return df.withColumn(out, F.concat(F.lit(prefix), F.coalesce(index, F.lit(1)).cast("string")))


def location_features(df: DataFrame) -> DataFrame:
    distance = F.sqrt(F.col("latitude") * F.col("latitude") + F.col("longitude") * F.col("longitude"))
    out = df.withColumn("distance_from_origin", distance)
    out = equal_width_bins(out, "latitude", 5, "lat_", "lat_region")
    return equal_width_bins(out, "longitude", 5, "lon_", "lon_region")


def risk_score() -> Column:
    weather, fuel, far = F.col("weather_conditions"), F.coalesce("fuel_efficiency", F.lit(0.0)), F.coalesce("distance_traveled", F.lit(0.0))
    score = (
        F.when(F.col("traffic_conditions") == "Heavy", 3).when(F.col("traffic_conditions") == "Moderate", 1).otherwise(0)
        + F.when(weather == "Stormy", 3).when(weather.isin("Rainy", "Snowy"), 2).when(weather == "Cloudy", 1).otherwise(0)
        + F.when(fuel < 8, 2).when(fuel < 10, 1).otherwise(0)
        + F.when(far > 1000, 2).when(far > 500, 1).otherwise(0)
    )
    return F.least(score, F.lit(10))


def delay_features(df: DataFrame) -> DataFrame:
    """Risk score always; the target only where delay hours are known (they are not at scoring time)."""
    out = df.withColumn("risk_score", risk_score())
    return out.withColumn("is_delayed", (F.col("delay_hours") > 0).cast("int")) if "delay_hours" in df.columns else out


def asset_features(df: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    return with_asset_statistics(df, statistics)


# --- voyages ------------------------------------------------------------------------
def voyage_temporal_features(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumns(temporal_parts(c))
    return df


def route_features(df: DataFrame) -> DataFrame:
    dashes = F.length("route") - F.length(F.replace(F.col("route"), F.lit("-"), F.lit("")))
    abroad = F.substring("origin_port", 1, 2) != F.substring("destination_port", 1, 2)
    return df.withColumns({"route_complexity": dashes + 1, "is_international": abroad.cast("int")})


def weight_category(weight: Column) -> Column:
    """Right-closed bands; zero and below have no band."""
    return (
        F.when(weight <= 0, None)
        .when(weight <= 1000, "very_light")
        .when(weight <= 5000, "light")
        .when(weight <= 10000, "medium")
        .when(weight <= 50000, "heavy")
        .when(weight.isNotNull(), "very_heavy")
    )


def cargo_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"cargo_weight_category": weight_category(F.col("cargo_weight")), "cargo_weight_log": F.log1p("cargo_weight")}
    )


def historical_features(df: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    return with_route_statistics(df, statistics)


def external_features(df: DataFrame) -> DataFrame:
    seasoned = df.withColumn("weather_severity_score", seasonal_weather_severity("scheduled_departure"))
    return with_congestion(seasoned, 0.0)


def encode_labels(df: DataFrame, column: str, fitted: DataFrame | None = None, unseen: int | None = 0) -> DataFrame:
    """Alphabetical codes from 0.

    ``fitted`` holds (value, code) from :func:`fit_labels`; unseen values get
    ``unseen`` and, with ``unseen=None``, stay null so the caller can reject them.
    """
    codes = fit_labels(df, column) if fitted is None else fitted
    named = codes.select(F.col("value").alias("_value"), F.col("code").alias(f"{column}_encoded"))
    out = df.join(named, F.coalesce(F.col(column), F.lit("unknown")) == F.col("_value"), "left").drop("_value")
    if unseen is None:
        return out
    return out.withColumn(f"{column}_encoded", F.coalesce(f"{column}_encoded", F.lit(unseen)))


def fit_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): each column's distinct values with their alphabetical position.

    The distinct values of all columns are range-partitioned and stored once, so partition
    numbers stay fixed; the rank is then a position inside a partition plus the sizes of
    the column's partitions before it.  Only those sizes meet in one task, and no list of
    values is held by the driver.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])
    ranged = df.select(F.inline(pairs)).distinct().repartitionByRange("column", "value").withColumn("part", F.spark_partition_id())
    values = stored(ranged, "labels")
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = values.groupBy("column", "part").agg(F.count("*").alias("n"))
    offsets = sizes.select("column", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = values.withColumn("pos", F.row_number().over(Window.partitionBy("part", "column").orderBy("value")))
    return inside.join(offsets, ["column", "part"]).select("column", "value", (F.col("offset") + F.col("pos") - 1).cast("int").alias("code"))


def fit_labels(df: DataFrame, column: str) -> DataFrame:
    """(value, code) of one column's distinct values, alphabetically from 0."""
    return fit_codes(df, [column]).select("value", "code")


def fit_scaling(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, nulls as zero; one aggregate, a few numbers on the driver."""
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    row = df.agg(*[F.avg(v).alias(f"m_{c}") for c, v in value.items()], *[F.stddev_pop(v).alias(f"s_{c}") for c, v in value.items()]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def apply_scaling(df: DataFrame, scaling: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - m) / s for c, (m, s) in scaling.items()}
    )


def with_split(
    df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42, buckets: int = 65536
) -> DataFrame:
    """Exact per-class split by hash order as a flag ``in_train``; rows are neither sorted nor moved.

    Counting per (class, hash bucket) finds the bucket in which a class reaches
    its share.  Only rows of that bucket are ranked, to find the last training
    row.  The result is one cut point per class, compared with every row.
    """
    h = stable_hash(F.lit(seed), key)
    marked = df.withColumns({"_h": h, "_b": F.pmod(h, F.lit(buckets))})
    sizes = marked.groupBy(label, "_b").agg(F.count("*").alias("n"))
    run = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    take = Window.partitionBy(label)
    reached = sizes.select(
        label, "_b", "n", F.sum("n").over(run).alias("until"), F.floor(F.sum("n").over(take) * share).alias("take")
    )
    borders = reached.filter((F.col("until") > F.col("take")) & (F.col("until") - F.col("n") <= F.col("take"))).select(
        label, F.col("_b").alias("_border"), (F.col("take") - F.col("until") + F.col("n")).alias("_rest")
    )
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    last = (
        marked.select(label, "_h", "_b", key)
        .join(borders, label)
        .filter(F.col("_b") == F.col("_border"))
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_rest"))
        .select(label, F.struct("_h", key).alias("_last"))
    )
    cuts = stored(borders.select(label, "_border").join(last, label, "left"), "cuts")
    before = F.col("_b") < F.col("_border")
    at_border = (F.col("_b") == F.col("_border")) & F.coalesce(F.struct("_h", key) <= F.col("_last"), F.lit(False))
    flagged = marked.join(cuts, label, "left")
    return flagged.withColumn("in_train", F.coalesce(before | at_border, F.lit(True))).drop("_h", "_b", "_border", "_last")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    flagged = with_split(df, label, key, share, seed)
    return flagged.filter("in_train").drop("in_train"), flagged.filter(~F.col("in_train")).drop("in_train")
