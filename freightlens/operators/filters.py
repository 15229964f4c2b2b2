"""Filters, lookups, pages and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import NOTIFYING_EVENTS, OPEN_STATUSES
from ..functions.scalars import col


def _moment(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def date_window(df: DataFrame, start: str | None = None, end: str | None = None, ts: str = "ts") -> DataFrame:
    """Inclusive on both ends; an end given as a bare date covers that whole day."""
    if start:
        df = df.filter(F.col(ts) >= _moment(start))
    if end and len(end) == 10:
        df = df.filter(F.col(ts) < F.expr(f"timestamp_ntz'{end}' + interval '1' day"))
    elif end:
        df = df.filter(F.col(ts) <= _moment(end))
    return df


def select_shipments(
    df: DataFrame,
    asset_id: str | None = None,
    status: str | None = None,
    delayed: bool | None = None,
    traffic: str | None = None,
    reason: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Active rows meeting every filter that was given."""
    equal = {
        "asset_id": asset_id,
        "shipment_status": status,
        "logistics_delay": delayed,
        "traffic_status": traffic,
        "logistics_delay_reason": reason,
    }
    df = df.filter("is_active")
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return date_window(df, start, end)


def page(df: DataFrame, order: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """One page, newest (or largest) first; the key breaks ties."""
    return df.orderBy(F.col(order).desc(), F.col(key)).offset(offset).limit(limit)


def page_per_key(df: DataFrame, by: str, order: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """The same page for every value of ``by`` at once.

    A rank filter directly above the window lets Spark keep only the first rows
    of each key before the shuffle, so a hot key does not travel whole.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc(), F.col(key)))
    ranked = df.withColumn("page_rank", rank).filter(F.col("page_rank") <= offset + limit)
    return ranked.filter(F.col("page_rank") > offset)


def by_id(df: DataFrame, key: int | Column, column: str = "id") -> DataFrame:
    return df.filter((F.col(column) == key) & F.col("is_active"))


def recent_delayed(df: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    since = F.expr(f"timestamp_ntz'{as_of}' - interval '{hours}' hour")
    return df.filter(F.col("is_active") & F.col("logistics_delay") & (F.col("ts") >= since)).orderBy(F.col("ts").desc(), "id")


def voyages_where(df: DataFrame, status: str | None = None, customer_id: int | None = None) -> DataFrame:
    if status is not None:
        df = df.filter(F.col("status") == status)
    if customer_id is not None:
        df = df.filter(F.col("customer_id") == customer_id)
    return df


def active_customers(df: DataFrame, active_only: bool = True) -> DataFrame:
    return df.filter("is_active") if active_only else df


def is_open(status: Column | str = "status") -> Column:
    return col(status).isin(*OPEN_STATUSES)


def overdue(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(is_open() & (F.col("scheduled_arrival") < _moment(as_of)))


def on_time(df: DataFrame) -> DataFrame:
    return df.filter((F.col("status") == "delivered") & (F.col("actual_arrival") <= F.col("scheduled_arrival")))


def high_risk(df: DataFrame, bound: float = 0.8, inclusive: bool = False) -> DataFrame:
    p = F.col("delay_probability")
    return df.filter(p >= bound if inclusive else p > bound)


def notifying_events(df: DataFrame) -> DataFrame:
    return df.filter(F.lower("event_type").isin(*NOTIFYING_EVENTS))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def last_rows(df: DataFrame, n: int, order: str, key: str) -> DataFrame:
    """The newest ``n`` rows of a history."""
    return df.orderBy(F.col(order).desc(), F.col(key).desc()).limit(n)
