"""Batch delay prediction for planned voyages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import risk
from ..operators.joins import as_of_external, with_congestion, with_route_history

DEFAULT_WEATHER = {"temperature": 20.0, "wind_speed": 5.0, "precipitation": 0.0}


def with_weather(requests: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather at the origin port when the voyage departs, and its severity; usual weather where none is known.

    ``weather`` holds observations (id, data_type, data_key, data_value, created_at,
    expires_at) with the port as key and temperature, wind_speed and precipitation in
    data_value.
    """
    probes = requests.withColumns({"data_type": F.lit("weather"), "data_key": F.col("origin_port")})
    found = as_of_external(probes, weather, None, time="scheduled_departure")
    known = {c: F.coalesce(F.col("data_value")[c].cast("double"), F.lit(usual)) for c, usual in DEFAULT_WEATHER.items()}
    full = found.withColumns(known).drop("data_type", "data_key", "data_value", "observed_at")
    return full.withColumn("weather_severity", risk.weather_severity("temperature", "wind_speed", "precipitation"))


def with_request_defaults(requests: DataFrame) -> DataFrame:
    return requests.withColumns(
        {
            "cargo_weight": F.coalesce("cargo_weight", F.lit(0.0)),
            "cargo_type": F.coalesce("cargo_type", F.lit("general")),
            "container_type": F.coalesce("container_type", F.lit("standard")),
            "route": F.coalesce("route", F.concat_ws("-", "origin_port", "destination_port")),
            "is_priority": F.coalesce("is_priority", F.lit(False)),
        }
    )


def predict_voyages(requests: DataFrame, history: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """Hours, probability, band, factors and advice per request.

    With ``weather`` observations the severity is that at the origin when the voyage
    departs, else the season's; ports are busier in business hours, at the origin on
    departure and at the destination on arrival.  A request without ports or schedule
    gets the safe default row instead.
    """
    full = with_congestion(with_route_history(with_request_defaults(requests), history), 0.5)
    if weather is None:
        full = full.withColumn("weather_severity", risk.seasonal_weather_severity("scheduled_departure"))
    else:
        full = with_weather(full, weather)
        full = full.withColumns(
            {
                "origin_congestion": risk.busy_congestion("origin_congestion", "scheduled_departure"),
                "destination_congestion": risk.busy_congestion("destination_congestion", "scheduled_arrival"),
            }
        )
    hours = risk.rule_based_hours(
        F.lit(1.0), "weather_severity", "origin_congestion", "destination_congestion", "is_priority"
    )
    usable = F.col("origin_port").isNotNull() & F.col("destination_port").isNotNull() & F.col("scheduled_departure").isNotNull()
    scored = (
        full.withColumn("predicted_delay_hours", F.when(usable, hours).otherwise(0.0))
        .withColumn("delay_probability", F.when(usable, risk.probability_from_hours("predicted_delay_hours")).otherwise(0.1))
        .withColumn(
            "risk_level",
            F.when(usable, risk.band_hours_probability("predicted_delay_hours", "delay_probability")).otherwise("unknown"),
        )
        .withColumn("confidence_score", F.when(usable, 0.7).otherwise(0.1))
    )
    factors = risk.factor_map(
        "weather_severity", "origin_congestion", "destination_congestion", "route_avg_delay", "cargo_weight", "is_priority"
    )
    no_factors = F.create_map().cast("map<string,double>")
    failed = F.array(F.lit(risk.PREDICTION_ADVICE["failed"]))
    explained = scored.withColumn("factors", F.when(usable, factors).otherwise(no_factors))
    return explained.withColumn(
        "recommendations", F.when(usable, risk.prediction_advice("predicted_delay_hours", "factors")).otherwise(failed)
    )
