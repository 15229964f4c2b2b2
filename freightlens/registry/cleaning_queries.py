"""Cleaning, projection and per-row scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import PORT_CONGESTION, PORT_COORDINATES
from ..functions import risk, scalars
from ..operators import cleaning
from ..sources import etl, shapes
from .core import register
from .source_queries import AS_OF, _ETL_SHIPMENTS, raw_text_rows


@register(
    "safe_casts",
    "C-02",
    """SELECT id, CASE WHEN id % 101 = 0 THEN NULL ELSE inventory_level END AS inventory_level,
         CASE WHEN id % 97 = 0 THEN 90.01e0 ELSE latitude END AS latitude,
         CASE WHEN id % 103 = 0 THEN NULL ELSE waiting_time END AS waiting_time FROM readings""",
)
def safe_casts(spark, root):
    rows = shapes.readings(spark, root)
    i = F.col("id")
    text = rows.select(
        "id",
        F.when(i % 101 == 0, "abc").otherwise(F.concat(F.col("inventory_level").cast("string"), F.lit(".7"))).alias("stock"),
        F.when(i % 97 == 0, "90.01").otherwise(F.col("latitude").cast("string")).alias("lat"),
        F.when(i % 103 == 0, "").otherwise(F.col("waiting_time").cast("string")).alias("wait"),
    )
    return text.select(
        "id",
        scalars.safe_int("stock").alias("inventory_level"),
        scalars.safe_double("lat").alias("latitude"),
        scalars.safe_int("wait").alias("waiting_time"),
    )


@register(
    "enum_mapping",
    "C-03",
    """SELECT CASE WHEN shipment_status = 'Pending' THEN 'In Transit' ELSE shipment_status END AS status,
         CASE WHEN id % 7 = 0 THEN 'Clear' ELSE traffic_status END AS traffic,
         CASE WHEN id % 13 = 0 THEN 'Other' ELSE logistics_delay_reason END AS reason, count(*) AS n
       FROM readings GROUP BY 1, 2, 3""",
)
def enum_mapping(spark, root):
    raw = raw_text_rows(shapes.readings(spark, root))
    return raw.groupBy(
        cleaning.map_status("Shipment_Status").alias("status"),
        cleaning.map_traffic("Traffic_Status").alias("traffic"),
        cleaning.map_reason("Logistics_Delay_Reason").alias("reason"),
    ).agg(F.count("*").alias("n"))


@register(
    "timestamp_fallback",
    "C-04",
    """SELECT CASE WHEN id % 211 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE date_trunc('second', ts) END AS ts,
         count(*) AS n FROM readings GROUP BY 1""",
)
def timestamp_fallback(spark, root):
    raw = raw_text_rows(shapes.readings(spark, root))
    return raw.groupBy(scalars.parse_timestamp("Timestamp", F.lit(AS_OF)).alias("ts")).agg(F.count("*").alias("n"))


@register("boolean_parse", "C-05", "SELECT logistics_delay AS flag, count(*) AS n FROM readings GROUP BY 1")
def boolean_parse(spark, root):
    raw = raw_text_rows(shapes.readings(spark, root))
    return raw.groupBy(scalars.parse_bool("Logistics_Delay").alias("flag")).agg(F.count("*").alias("n"))


@register(
    "mean_imputation",
    "C-06",
    """SELECT id, coalesce(temperature, (SELECT avg(temperature) FROM readings)) AS temperature,
         coalesce(humidity, (SELECT avg(humidity) FROM readings)) AS humidity FROM readings""",
)
def mean_imputation(spark, root):
    rows = shapes.readings(spark, root).select("id", "temperature", "humidity")
    return cleaning.fill_means(rows, ["temperature", "humidity"])


@register(
    "constant_imputation",
    "C-07 X-15",
    """SELECT id, CASE WHEN id % 11 = 0 THEN 0e0 ELSE user_transaction_amount END AS user_transaction_amount,
         CASE WHEN id % 12 = 0 THEN 1 ELSE user_purchase_frequency END AS user_purchase_frequency,
         CASE WHEN id % 13 = 0 THEN 'None' ELSE logistics_delay_reason END AS logistics_delay_reason,
         CASE WHEN id % 14 = 0 THEN 'Clear' ELSE traffic_status END AS traffic_status FROM readings""",
)
def constant_imputation(spark, root):
    i = F.col("id")
    holes = shapes.readings(spark, root).select(
        "id",
        F.when(i % 11 != 0, F.col("user_transaction_amount")).alias("user_transaction_amount"),
        F.when(i % 12 != 0, F.col("user_purchase_frequency")).alias("user_purchase_frequency"),
        F.when(i % 13 != 0, F.col("logistics_delay_reason")).alias("logistics_delay_reason"),
        F.when(i % 14 != 0, F.col("traffic_status")).alias("traffic_status"),
    )
    return cleaning.fill_constants(holes)


@register(
    "exact_duplicates_removed",
    "C-08",
    "SELECT DISTINCT asset_id, shipment_status, traffic_status, waiting_time, logistics_delay_reason FROM readings",
)
def exact_duplicates_removed(spark, root):
    cols = ["asset_id", "shipment_status", "traffic_status", "waiting_time", "logistics_delay_reason"]
    return shapes.readings(spark, root).select(*cols).dropDuplicates()


@register(
    "range_filters",
    "C-09",
    """SELECT id, latitude, longitude, inventory_level, waiting_time FROM
         (SELECT id, latitude * 1.1e0 AS latitude, longitude * 1.1e0 AS longitude, inventory_level - 120 AS inventory_level,
            waiting_time - 5 AS waiting_time FROM readings)
       WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND inventory_level >= 0 AND waiting_time >= 0""",
)
def range_filters(spark, root):
    shifted = shapes.readings(spark, root).select(
        "id",
        (F.col("latitude") * 1.1).alias("latitude"),
        (F.col("longitude") * 1.1).alias("longitude"),
        (F.col("inventory_level") - 120).alias("inventory_level"),
        (F.col("waiting_time") - 5).alias("waiting_time"),
    )
    return cleaning.valid_ranges(shifted)


@register(
    "clean_dataset",
    "C-06 C-07 C-08 C-09",
    """SELECT DISTINCT id, asset_id, latitude, longitude, inventory_level, waiting_time,
         coalesce(temperature, (SELECT avg(temperature) FROM readings)) AS temperature,
         coalesce(humidity, (SELECT avg(humidity) FROM readings)) AS humidity, asset_utilization, demand_forecast,
         user_transaction_amount, traffic_status FROM readings""",
)
def clean_dataset(spark, root):
    rows = shapes.readings(spark, root).select(
        "id", "asset_id", "latitude", "longitude", "inventory_level", "waiting_time", "temperature", "humidity",
        "asset_utilization", "demand_forecast", "user_transaction_amount", "traffic_status",
    )
    return cleaning.clean_dataset(rows)


@register(
    "training_columns",
    "C-10",
    """SELECT id, asset_id, ts AS timestamp, traffic_status AS traffic_conditions, waiting_time, latitude, longitude,
         CAST(logistics_delay AS INTEGER) AS delay_present FROM readings""",
)
def training_columns(spark, root):
    rows = shapes.readings(spark, root).select(
        "id", "asset_id", "ts", F.col("traffic_status").alias("Traffic_Status"), "waiting_time", "latitude", "longitude",
        "logistics_delay", "logistics_delay_reason", "shipment_status",
    )
    return cleaning.training_columns(rows)


_RULE_SQL = """SELECT array_to_string(list_filter([
    CASE WHEN predicted_delay_hours / 50 > 0.9e0 AND l_partkey % 9 = 0 THEN 'probability_range' END,
    CASE WHEN predicted_delay_hours - 5 < 0 THEN 'negative_delay' END], lambda x: x IS NOT NULL), ',') AS violations,
  count(*) AS n FROM predictions GROUP BY 1"""


def _doubtful(rows):
    p = F.when((F.col("predicted_delay_hours") / 50 > 0.9) & (F.col("l_partkey") % 9 == 0), 1.5)
    return rows.select(
        p.otherwise(F.col("delay_probability")).alias("delay_probability"),
        (F.col("predicted_delay_hours") - 5).alias("predicted_delay_hours"),
        "confidence_score",
    )


@register("constraint_check", "C-11", _RULE_SQL)
def constraint_check(spark, root):
    checked = cleaning.check_rules(_doubtful(shapes.predictions(spark, root)), cleaning.prediction_rules())
    return checked.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


@register(
    "constraint_split",
    "C-11",
    """SELECT 'valid' AS side, count(*) AS n FROM predictions WHERE predicted_delay_hours >= 5
         AND NOT (predicted_delay_hours / 50 > 0.9e0 AND l_partkey % 9 = 0)
       UNION ALL
       SELECT 'rejected', count(*) FROM predictions WHERE NOT (predicted_delay_hours >= 5
         AND NOT (predicted_delay_hours / 50 > 0.9e0 AND l_partkey % 9 = 0))""",
)
def constraint_split(spark, root):
    valid, rejected = cleaning.split_valid(_doubtful(shapes.predictions(spark, root)), cleaning.prediction_rules())
    return valid.agg(F.lit("valid").alias("side"), F.count("*").alias("n")).union(
        rejected.agg(F.lit("rejected"), F.count("*"))
    )


@register(
    "analytics_rows",
    "C-12 C-17",
    """SELECT id, asset_id, ts, shipment_status, traffic_status, waiting_time, logistics_delay, logistics_delay_reason,
         latitude, longitude, inventory_level, temperature, humidity, user_transaction_amount, user_purchase_frequency,
         asset_utilization, demand_forecast, delay_probability FROM scored""",
)
def analytics_rows(spark, root):
    return cleaning.analytics_rows(shapes.readings(spark, root))


@register(
    "summary_rows",
    "C-13",
    "SELECT id, asset_id, shipment_status, latitude, longitude, logistics_delay, delay_probability, ts FROM scored",
)
def summary_rows(spark, root):
    return cleaning.summary_rows(shapes.readings(spark, root))


@register(
    "json_rows",
    "C-14 X-13",
    """SELECT id, CASE WHEN id % 17 = 0 THEN NULL ELSE CAST(18 + id % 13 AS DOUBLE) END AS temperature,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM readings""",
)
def json_rows(spark, root):
    rows = shapes.readings(spark, root).select(
        "id", F.coalesce("temperature", F.lit(float("nan"))).alias("temperature"), "ts"
    )
    text = cleaning.json_rows(rows)
    parsed = F.from_json("json", "id bigint, temperature double, ts string")
    return text.select(parsed.alias("r")).select("r.id", "r.temperature", "r.ts")


@register(
    "estimated_delay_hours",
    "C-15",
    """SELECT id, greatest(0e0, waiting_time / 60e0 * CASE logistics_delay_reason WHEN 'Weather' THEN 2e0
         WHEN 'Mechanical Failure' THEN 3e0 WHEN 'Traffic' THEN 1.5e0 ELSE 1e0 END) AS hours FROM readings""",
)
def estimated_delay_hours(spark, root):
    return shapes.readings(spark, root).select("id", risk.estimated_delay_hours("waiting_time", "logistics_delay_reason").alias("hours"))


@register(
    "averaged_delay_probability",
    "C-16",
    """SELECT id, least(1e0, (CASE traffic_status WHEN 'Heavy' THEN 0.3e0 WHEN 'Detour' THEN 0.2e0 ELSE 0e0 END
         + CASE WHEN waiting_time > 30 THEN 0.4e0 ELSE 0e0 END
         + CASE WHEN logistics_delay_reason IS DISTINCT FROM 'None' THEN 0.5e0 ELSE 0e0 END) / 3) AS p FROM readings""",
)
def averaged_delay_probability(spark, root):
    p = risk.averaged_delay_probability("traffic_status", "waiting_time", "logistics_delay_reason")
    return shapes.readings(spark, root).select("id", p.alias("p"))


@register(
    "heuristic_prediction",
    "C-17",
    "SELECT id, delay_probability AS p, delay_probability > 0.5e0 AS will_delay FROM scored",
)
def heuristic_prediction(spark, root):
    p = risk.delay_probability("traffic_status", "waiting_time", "logistics_delay_reason")
    return shapes.readings(spark, root).select("id", p.alias("p"), (p > 0.5).alias("will_delay"))


@register(
    "risk_bands",
    "C-18 C-19 C-20 C-21 C-29",
    """SELECT CASE WHEN p >= 0.8e0 THEN 'HIGH' WHEN p >= 0.5e0 THEN 'MEDIUM' WHEN p >= 0.2e0 THEN 'LOW' ELSE 'MINIMAL' END AS inclusive_band,
         CASE WHEN p > 0.8e0 THEN 'High' WHEN p > 0.5e0 THEN 'Medium' WHEN p > 0.2e0 THEN 'Low' ELSE 'Very Low' END AS exclusive_band,
         CASE WHEN h >= 24 AND p >= 0.7e0 THEN 'high' WHEN h >= 8 AND p >= 0.5e0 THEN 'medium'
           WHEN h >= 2 AND p >= 0.3e0 THEN 'low' ELSE 'minimal' END AS joint_band,
         CASE WHEN h >= 24 THEN 'high' WHEN h >= 8 THEN 'medium' ELSE 'low' END AS hours_band,
         sum(least(h / 24, 1e0)) AS probability_from_hours, count(*) AS n
       FROM (SELECT delay_probability AS p, predicted_delay_hours AS h FROM predictions) GROUP BY 1, 2, 3, 4""",
)
def risk_bands(spark, root):
    p, h = "delay_probability", "predicted_delay_hours"
    return (
        shapes.predictions(spark, root)
        .groupBy(
            risk.band_inclusive(p).alias("inclusive_band"),
            risk.band_exclusive(p).alias("exclusive_band"),
            risk.band_hours_probability(h, p).alias("joint_band"),
            risk.band_hours(h).alias("hours_band"),
        )
        .agg(F.sum(risk.probability_from_hours(h)).alias("probability_from_hours"), F.count("*").alias("n"))
    )


@register(
    "prediction_summary",
    "C-22 X-06",
    """SELECT shipment_id, l_linenumber, l_partkey, l_suppkey, 100 * delay_probability AS probability_percent,
         predicted_delay_hours, 100 * confidence_score AS confidence_percent, model_name || ' v' || model_version AS model
       FROM predictions""",
)
def prediction_summary(spark, root):
    return shapes.predictions(spark, root).select(
        "shipment_id", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("delay_probability") * 100).alias("probability_percent"),
        "predicted_delay_hours",
        (F.col("confidence_score") * 100).alias("confidence_percent"),
        F.concat("model_name", F.lit(" v"), "model_version").alias("model"),
    )


_WEATHER_SQL = """0.5e0 + CASE WHEN month(scheduled_departure) IN (12, 1, 2) THEN 0.2e0
  WHEN month(scheduled_departure) IN (6, 7, 8) THEN 0.1e0 ELSE 0e0 END"""


@register(
    "rule_based_delay",
    "C-23 C-26",
    f"""SELECT id, h AS hours, least(1e0, h / 24) AS p, CASE WHEN h < 6 THEN 'low' WHEN h < 18 THEN 'medium' ELSE 'high' END AS band
       FROM (SELECT id, (2e0 * (length(route) - length(replace(route, '-', '')) + 1) + 12 * ({_WEATHER_SQL}) + 8 * (0.5e0 + 0.5e0))
         * CASE WHEN is_priority THEN 0.7e0 ELSE 1e0 END AS h FROM voyages)""",
)
def rule_based_delay(spark, root):
    hours = risk.rule_based_hours(
        F.length("route") - F.length(F.replace(F.col("route"), F.lit("-"), F.lit(""))) + 1,
        risk.seasonal_weather_severity("scheduled_departure"),
        risk.congestion_level("origin_port", None),
        risk.congestion_level("destination_port", None),
        "is_priority",
    )
    rows = shapes.voyages(spark, root).select("id", hours.alias("hours"))
    return rows.select("id", "hours", risk.probability_from_hours("hours").alias("p"), risk.band_rule_hours("hours").alias("band"))


@register(
    "averaged_predictions",
    "C-24",
    """SELECT shipment_id, avg(predicted_delay_hours) AS hours, avg(delay_probability) AS p, avg(confidence_score) AS confidence,
         CASE WHEN avg(predicted_delay_hours) < 6 THEN 'low' WHEN avg(predicted_delay_hours) < 18 THEN 'medium' ELSE 'high' END AS band
       FROM predictions GROUP BY 1""",
)
def averaged_predictions(spark, root):
    means = shapes.predictions(spark, root).groupBy("shipment_id").agg(
        F.avg("predicted_delay_hours").alias("hours"),
        F.avg("delay_probability").alias("p"),
        F.avg("confidence_score").alias("confidence"),
    )
    return means.withColumn("band", risk.band_rule_hours("hours"))


@register(
    "weather_severity",
    "C-25",
    """SELECT id, least(1e0, CASE WHEN t < 0 OR t > 40 THEN 0.3e0 ELSE 0e0 END + CASE WHEN w > 25 THEN 0.4e0 ELSE 0e0 END
         + CASE WHEN r > 5 THEN 0.3e0 ELSE 0e0 END) AS severity
       FROM (SELECT id, coalesce((temperature - 18) * 5 - 10, 20) AS t, waiting_time AS w, humidity - 60 AS r FROM readings)""",
)
def weather_severity(spark, root):
    t = (F.col("temperature") - 18) * 5 - 10
    return shapes.readings(spark, root).select(
        "id", risk.weather_severity(t, F.col("waiting_time"), F.col("humidity") - 60).alias("severity")
    )


@register(
    "factor_explanation",
    "C-27 C-28 X-12",
    f"""SELECT id, w * 0.3e0 AS weather, 0.5e0 * 0.4e0 AS port_congestion, least(d / 24, 0.5e0) AS route_history,
         CASE WHEN cargo_weight > 20000 THEN 0.2e0 ELSE 0e0 END AS cargo_complexity,
         CASE WHEN is_priority THEN -0.1e0 ELSE 0e0 END AS priority_handling,
         CASE WHEN d >= 24 THEN 2 WHEN d >= 8 THEN 2 ELSE 0 END + CASE WHEN w * 0.3e0 > 0.3e0 THEN 1 ELSE 0 END
           + CASE WHEN least(d / 24, 0.5e0) > 0.3e0 THEN 1 ELSE 0 END
           + CASE WHEN d < 8 AND w * 0.3e0 <= 0.3e0 AND least(d / 24, 0.5e0) <= 0.3e0 THEN 1 ELSE 0 END AS advice_lines
       FROM (SELECT *, {_WEATHER_SQL} AS w, CAST(id * 31 % 97 AS DOUBLE) AS d FROM voyages)""",
)
def factor_explanation(spark, root):
    rows = shapes.voyages(spark, root).select(
        "id", "cargo_weight", "is_priority",
        risk.seasonal_weather_severity("scheduled_departure").alias("w"),
        (F.col("id") * 31 % 97).cast("double").alias("d"),
    )
    factors = risk.factor_map(F.col("w"), F.lit(0.5), F.lit(0.5), F.col("d"), F.col("cargo_weight"), F.col("is_priority"))
    full = rows.withColumn("factors", factors).withColumn("advice", risk.prediction_advice("d", "factors"))
    names = ["weather", "port_congestion", "route_history", "cargo_complexity", "priority_handling"]
    return full.select("id", *[F.col("factors")[n].alias(n) for n in names], F.size("advice").alias("advice_lines"))


@register(
    "prediction_accuracy_rows",
    "C-30",
    "SELECT shipment_id, l_linenumber, l_partkey, l_suppkey, predicted_delay_hours, prediction_accuracy FROM validated",
)
def prediction_accuracy_rows(spark, root):
    return shapes.predictions(spark, root).select(
        "shipment_id", "l_linenumber", "l_partkey", "l_suppkey", "predicted_delay_hours",
        risk.accuracy_of("predicted_delay_hours", "actual_delay_hours").alias("prediction_accuracy"),
    )


@register(
    "request_defaults",
    "C-31",
    """SELECT id, CASE WHEN id % 5 = 0 THEN 0e0 ELSE cargo_weight END AS cargo_weight,
         CASE WHEN id % 7 = 0 THEN 'general' ELSE cargo_type END AS cargo_type,
         CASE WHEN id % 11 = 0 THEN 'standard' ELSE container_type END AS container_type,
         route, id % 13 <> 0 AND is_priority AS is_priority FROM voyages""",
)
def request_defaults(spark, root):
    from ..plans.voyage_prediction import with_request_defaults

    i = F.col("id")
    holes = shapes.voyages(spark, root).select(
        "id", "origin_port", "destination_port",
        F.when(i % 5 != 0, F.col("cargo_weight")).alias("cargo_weight"),
        F.when(i % 7 != 0, F.col("cargo_type")).alias("cargo_type"),
        F.when(i % 11 != 0, F.col("container_type")).alias("container_type"),
        F.when(i % 3 != 0, F.col("route")).alias("route"),
        F.when(i % 13 != 0, F.col("is_priority")).alias("is_priority"),
    )
    return with_request_defaults(holes).drop("origin_port", "destination_port")


_CONG = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in PORT_CONGESTION)


@register(
    "route_fields",
    "C-32 J-11",
    f"""WITH v AS ({_ETL_SHIPMENTS}),
r AS (SELECT id, CASE least(lower(origin_port), lower(destination_port)) || '|' || greatest(lower(origin_port), lower(destination_port))
    WHEN 'los angeles|shanghai' THEN 0.8e0 WHEN 'rotterdam|singapore' THEN 0.9e0 WHEN 'hamburg|new york' THEN 0.7e0
    WHEN 'dubai|singapore' THEN 0.6e0 ELSE 0.5e0 END AS c FROM v)
SELECT id, c AS complexity, CAST(greatest(1, floor(c * 15)) AS BIGINT) AS transit_days, CASE WHEN c > 0.5e0 THEN 'international' ELSE 'domestic' END AS route_type,
  CAST(greatest(0, floor(c * 5)) AS BIGINT) AS stops, CAST(greatest(1, floor(c * 3)) AS BIGINT) AS checkpoints FROM r""",
)
def route_fields(spark, root):
    from ..operators.joins import with_route_complexity

    rows = shapes.readings(spark, root)
    voyages = etl.shipments(rows, etl.customers(rows)).select("id", "origin_port", "destination_port")
    c = F.col("complexity")
    return with_route_complexity(voyages).select(
        "id", "complexity",
        F.greatest(F.lit(1), F.floor(c * 15)).alias("transit_days"),
        F.when(c > 0.5, "international").otherwise("domestic").alias("route_type"),
        F.greatest(F.lit(0), F.floor(c * 5)).alias("stops"),
        F.greatest(F.lit(1), F.floor(c * 3)).alias("checkpoints"),
    )


@register(
    "congestion_fields",
    "C-33 J-09",
    f"""WITH v AS ({_ETL_SHIPMENTS}),
c0 AS (SELECT id, created_at, CASE lower(origin_port) {_CONG} ELSE 0.5e0 END AS base FROM v),
c1 AS (SELECT id, CASE WHEN hour(created_at) BETWEEN 6 AND 18 THEN least(base + 0.1e0, 1e0) ELSE base END AS level FROM c0)
SELECT id, level, level * 12 AS wait_hours, CAST(greatest(1, floor(10 * (1 - level))) AS BIGINT) AS berths,
  CASE WHEN level >= 0.8e0 THEN 'severe' WHEN level >= 0.6e0 THEN 'high' WHEN level >= 0.4e0 THEN 'moderate'
    WHEN level >= 0.2e0 THEN 'low' ELSE 'minimal' END AS band FROM c1""",
)
def congestion_fields(spark, root):
    rows = shapes.readings(spark, root)
    voyages = etl.shipments(rows, etl.customers(rows)).select("id", "origin_port", "created_at")
    level = risk.busy_congestion(risk.congestion_level("origin_port", 0.5), "created_at")
    leveled = voyages.select("id", level.alias("level"))
    return leveled.select(
        "id", "level",
        (F.col("level") * 12).alias("wait_hours"),
        F.greatest(F.lit(1), F.floor((1 - F.col("level")) * 10)).alias("berths"),
        risk.congestion_band("level").alias("band"),
    )


_COORD = " ".join(f"WHEN contains(lower(origin_port), '{k}') THEN {la}" for k, la, _ in PORT_COORDINATES)
_COORD_LON = " ".join(f"WHEN contains(lower(origin_port), '{k}') THEN {lo}" for k, _, lo in PORT_COORDINATES)


@register(
    "port_coordinates",
    "J-10 X-08",
    f"""WITH v AS ({_ETL_SHIPMENTS})
SELECT origin_port, CAST(CASE {_COORD} END AS DOUBLE) AS lat, CAST(CASE {_COORD_LON} END AS DOUBLE) AS lon, count(*) AS n
FROM v GROUP BY 1, 2, 3""",
)
def port_coordinates(spark, root):
    rows = shapes.readings(spark, root)
    voyages = etl.shipments(rows, etl.customers(rows))
    placed = voyages.groupBy("origin_port").agg(F.count("*").alias("n"))
    return placed.withColumn("at", risk.port_coordinates("origin_port")).select("origin_port", "at.lat", "at.lon", "n")
