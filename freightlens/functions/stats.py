"""Significance of a regression slope without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def slope_p_value(r: str, n: str) -> Column:
    """Two-sided p-value of a correlation column ``r`` over ``n`` points.

    Student's t with n-2 whole degrees of freedom has a finite series in
    cos(theta), theta = atan(t / sqrt(df)); here cos^2(theta) = 1 - r^2 and
    sin(theta) = |r|.  Even df: 1 + (1/2)c + (1*3/2*4)c^2 + ..., odd df:
    1 + (2/3)c + (2*4/3*5)c^2 + ...  The number of points is a number of periods,
    so the series is short.
    """
    rho, df = f"least(abs({r}), 1D)", f"(cast({n} as int) - 2)"
    steps = f"(({df} + {df} % 2) div 2 - 1 - {df} % 2)"
    series = f"""aggregate(
        if({steps} >= 1, sequence(1, cast({steps} as int)), array()),
        named_struct('total', 1D, 'term', 1D),
        (acc, j) -> named_struct(
            'total', acc.total + acc.term * (1 - {r} * {r}) * (2 * j - 1 + {df} % 2) / (2 * j + {df} % 2),
            'term', acc.term * (1 - {r} * {r}) * (2 * j - 1 + {df} % 2) / (2 * j + {df} % 2)),
        acc -> acc.total)"""
    return F.expr(
        f"""CASE WHEN {df} < 1 THEN if({rho} > 0, 0D, 1D)
             WHEN {df} % 2 = 0 THEN greatest(0D, 1 - {rho} * {series})
             WHEN {df} = 1 THEN greatest(0D, 1 - 2 / pi() * asin({rho}))
             ELSE greatest(0D, 1 - 2 / pi() * (asin({rho}) + {rho} * sqrt(1 - {rho} * {rho}) * {series})) END"""
    )


def trend_direction(slope: Column) -> Column:
    return F.when(F.abs(slope) < 0.01, "stable").when(slope > 0, "increasing").otherwise("decreasing")
