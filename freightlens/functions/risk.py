"""Delay heuristics, risk bands and severity scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..fixed_values import PORT_CONGESTION, PORT_COORDINATES, PREDICTION_ADVICE
from .scalars import col, drop_nulls, lookup


# --- heuristics on readings -----------------------------------------------------
def estimated_delay_hours(waiting: Column | str, reason: Column | str) -> Column:
    factor = (
        F.when(col(reason) == "Weather", 2.0)
        .when(col(reason) == "Mechanical Failure", 3.0)
        .when(col(reason) == "Traffic", 1.5)
        .otherwise(1.0)
    )
    return F.greatest(F.lit(0.0), col(waiting) / F.lit(60.0) * factor)


def averaged_delay_probability(traffic: Column | str, waiting: Column | str, reason: Column | str) -> Column:
    """Three factors averaged; a missing reason counts as a reason."""
    total = (
        F.when(col(traffic) == "Heavy", 0.3).when(col(traffic) == "Detour", 0.2).otherwise(0.0)
        + F.when(col(waiting) > 30, 0.4).otherwise(0.0)
        + F.when(col(reason).eqNullSafe("None"), 0.0).otherwise(0.5)
    )
    return F.least(total / F.lit(3.0), F.lit(1.0))


def delay_probability(traffic: Column | str, waiting: Column | str, reason: Column | str) -> Column:
    """Additive score used for live rows while no model is registered."""
    score = (
        F.lit(0.3)
        + F.when(col(traffic) == "Heavy", 0.3).otherwise(0.0)
        + F.when(col(waiting) > 30, 0.2).otherwise(0.0)
        + F.when(col(reason).eqNullSafe("None"), 0.0).otherwise(0.2)
    )
    return F.least(F.lit(1.0), score)


def accuracy_of(predicted: Column | str, actual: Column | str) -> Column:
    """Null unless the actual delay is positive, else one minus the relative error, kept in 0..1."""
    p, a = col(predicted), col(actual)
    score = 1 - F.abs(p - a) / F.greatest(p, a, F.lit(1.0))
    return F.when(a > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def probability_from_hours(hours: Column | str) -> Column:
    return F.least(col(hours) / 24, F.lit(1.0))


# --- bands -----------------------------------------------------------------------
def band_inclusive(p: Column | str) -> Column:
    return (
        F.when(col(p) >= 0.8, "HIGH").when(col(p) >= 0.5, "MEDIUM").when(col(p) >= 0.2, "LOW").otherwise("MINIMAL")
    )


def band_exclusive(p: Column | str) -> Column:
    return F.when(col(p) > 0.8, "High").when(col(p) > 0.5, "Medium").when(col(p) > 0.2, "Low").otherwise("Very Low")


def band_hours_probability(hours: Column | str, p: Column | str) -> Column:
    h, q = col(hours), col(p)
    return (
        F.when((h >= 24) & (q >= 0.7), "high")
        .when((h >= 8) & (q >= 0.5), "medium")
        .when((h >= 2) & (q >= 0.3), "low")
        .otherwise("minimal")
    )


def band_hours(hours: Column | str) -> Column:
    h = col(hours)
    return F.when(h >= 24, "high").when(h >= 8, "medium").when(h.isNotNull(), "low")


def band_rule_hours(hours: Column | str) -> Column:
    return F.when(col(hours) < 6, "low").when(col(hours) < 18, "medium").otherwise("high")


# --- rule-based voyage prediction ---------------------------------------------------
def rule_based_hours(
    complexity: Column | str, weather: Column | str, origin: Column | str, destination: Column | str, priority: Column | str
) -> Column:
    base = (
        F.coalesce(col(complexity).cast("double"), F.lit(1.0)) * 2
        + F.coalesce(col(weather), F.lit(0.5)) * 12
        + (F.coalesce(col(origin), F.lit(0.5)) + F.coalesce(col(destination), F.lit(0.5))) * 8
    )
    return F.greatest(F.lit(0.0), F.when(F.coalesce(col(priority), F.lit(False)), base * 0.7).otherwise(base))


def weather_severity(temperature: Column | str, wind: Column | str, precipitation: Column | str) -> Column:
    t = F.coalesce(col(temperature), F.lit(20.0))
    score = (
        F.when((t < 0) | (t > 40), 0.3).otherwise(0.0)
        + F.when(F.coalesce(col(wind), F.lit(0.0)) > 25, 0.4).otherwise(0.0)
        + F.when(F.coalesce(col(precipitation), F.lit(0.0)) > 5, 0.3).otherwise(0.0)
    )
    return F.least(score, F.lit(1.0))


def seasonal_weather_severity(ts: Column | str) -> Column:
    month = F.month(col(ts))
    extra = F.when(month.isin(12, 1, 2), 0.2).when(month.isin(6, 7, 8), 0.1).otherwise(0.0)
    return F.lit(0.5) + extra


def factor_map(
    weather: Column | str, origin: Column | str, destination: Column | str,
    route_delay: Column | str, weight: Column | str, priority: Column | str,
) -> Column:
    return F.create_map(
        F.lit("weather"), col(weather) * 0.3,
        F.lit("port_congestion"), (col(origin) + col(destination)) / 2 * 0.4,
        F.lit("route_history"), F.least(col(route_delay) / 24, F.lit(0.5)),
        F.lit("cargo_complexity"), F.when(col(weight) > 20000, 0.2).otherwise(0.0),
        F.lit("priority_handling"), F.when(col(priority), -0.1).otherwise(0.0),
    )


def prediction_advice(hours: Column | str, factors: Column | str) -> Column:
    h, f = col(hours), col(factors)
    text = PREDICTION_ADVICE
    high, moderate = h >= 24, (h >= 8) & (h < 24)
    items = drop_nulls(
        F.when(high, text["high"][0]),
        F.when(high, text["high"][1]),
        F.when(moderate, text["moderate"][0]),
        F.when(moderate, text["moderate"][1]),
        F.when(f["weather"] > 0.3, text["weather"]),
        F.when(f["port_congestion"] > 0.5, text["congestion"]),
        F.when(f["route_history"] > 0.3, text["history"]),
    )
    return F.when(F.size(items) == 0, F.array(F.lit(text["default"]))).otherwise(items)


# --- ports and routes ------------------------------------------------------------------
def congestion_level(port: Column | str, default: float | None) -> Column:
    return lookup(F.lower(col(port)), PORT_CONGESTION, None if default is None else F.lit(default))


def port_coordinates(port: Column | str) -> Column:
    """Coordinates of the first known fragment inside the port name, else null."""
    name = F.lower(col(port))
    return F.coalesce(
        *[
            F.when(F.contains(name, F.lit(key)), F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon")))
            for key, lat, lon in PORT_COORDINATES
        ]
    )


def busy_congestion(level: Column | str, ts: Column | str) -> Column:
    """Business hours add a tenth, at most one in total."""
    return F.when(F.hour(col(ts)).between(6, 18), F.least(col(level) + 0.1, F.lit(1.0))).otherwise(col(level))


def congestion_band(level: Column | str) -> Column:
    c = col(level)
    return (
        F.when(c >= 0.8, "severe").when(c >= 0.6, "high").when(c >= 0.4, "moderate").when(c >= 0.2, "low").otherwise("minimal")
    )
