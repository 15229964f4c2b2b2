"""Seasonal delay forecast per route: trend, weekday and yearly terms with cargo and priority.

The fit needs only sums per (route, day), so rows are added up first and a busy
route reaches the solver as one row per calendar day.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import hours_between

YEAR_TERMS = 3
EPOCH = "2000-01-01"
MINIMUM = 10

# task functions travel by value: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def calendar_terms(day) -> list:
    """The date part of the model: constant, trend, weekdays, yearly waves."""
    days = F.date_diff(F.to_date(day), F.lit(EPOCH).cast("date")).cast("double")
    years = days / 365.25
    weekday = F.weekday(day)
    waves = []
    for k in range(1, YEAR_TERMS + 1):
        angle = years * (2 * np.pi * k)
        waves += [F.sin(angle), F.cos(angle)]
    return [F.lit(1.0), years, *[F.when(weekday == d, 1.0).otherwise(0.0) for d in range(1, 7)], *waves]


def daily_sums(voyages: DataFrame) -> DataFrame:
    hours = hours_between("scheduled_arrival", "actual_arrival")
    rows = voyages.filter(F.col("actual_arrival").isNotNull()).select(
        "route",
        F.to_date("scheduled_departure").alias("day"),
        (F.coalesce("cargo_weight", F.lit(0.0)) / 1000).alias("w"),
        F.col("is_priority").cast("double").alias("p"),
        hours.alias("y"),
    )
    product = {"ww": ("w", "w"), "wp": ("w", "p"), "wy": ("w", "y"), "py": ("p", "y")}
    sums = rows.groupBy("route", "day").agg(
        F.count("*").cast("double").alias("n"),
        F.sum("w").alias("w"),
        F.sum("p").alias("p"),
        F.sum("y").alias("y"),
        *[F.sum(F.col(a) * F.col(b)).alias(name) for name, (a, b) in product.items()],
    )
    return sums.withColumn("terms", F.array(*calendar_terms("day")))


def _solve(days: pd.DataFrame) -> pd.DataFrame:
    """Least squares of one route from its daily sums."""
    d = np.vstack(days["terms"].to_numpy())
    col = {c: days[c].to_numpy() for c in ("n", "w", "p", "y", "ww", "wp", "wy", "py")}
    k = d.shape[1]
    xtx = np.zeros((k + 2, k + 2))
    xtx[:k, :k] = (d * col["n"][:, None]).T @ d
    xtx[:k, k] = xtx[k, :k] = d.T @ col["w"]
    xtx[:k, k + 1] = xtx[k + 1, :k] = d.T @ col["p"]
    xtx[k, k] = col["ww"].sum()
    xtx[k, k + 1] = xtx[k + 1, k] = col["wp"].sum()
    xtx[k + 1, k + 1] = col["p"].sum()  # the flag is 0 or 1, so its square is itself
    xty = np.concatenate([d.T @ col["y"], [col["wy"].sum(), col["py"].sum()]])
    beta = np.linalg.pinv(xtx, rcond=1e-10, hermitian=True) @ xty
    return pd.DataFrame({"route": [days["route"].iloc[0]], "rows": [int(col["n"].sum())], "beta": [beta.tolist()]})


def fit(voyages: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """Coefficients of every route with enough arrivals."""
    fitted = daily_sums(voyages).groupBy("route").applyInPandas(_solve, "route string, rows bigint, beta array<double>")
    return fitted.filter(F.col("rows") >= minimum)


def predict(voyages: DataFrame, fitted: DataFrame) -> DataFrame:
    """Hours per voyage, never negative; zero on routes without a fit."""
    terms = [*calendar_terms("scheduled_departure"), F.coalesce("cargo_weight", F.lit(0.0)) / 1000, F.col("is_priority").cast("double")]
    dot = sum((F.get("beta", F.lit(i)) * t for i, t in enumerate(terms)), F.lit(0.0))
    joined = voyages.join(fitted.select("route", "beta"), "route", "left")
    hours = F.coalesce(F.greatest(dot, F.lit(0.0)), F.lit(0.0))
    return joined.withColumn("predicted_delay_hours", F.when(F.col("beta").isNull(), 0.0).otherwise(hours)).drop("beta")
