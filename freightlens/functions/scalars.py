"""Casts, hashing, dates and other small column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- casts -------------------------------------------------------------------
def safe_double(c: Column | str) -> Column:
    return col(c).try_cast("double")


def safe_int(c: Column | str) -> Column:
    """Text to whole number, cutting decimals toward zero; null when not a number."""
    return col(c).try_cast("double").try_cast("int")


def parse_bool(c: Column | str) -> Column:
    return F.coalesce(col(c).isin("1", "True"), F.lit(False))


def parse_timestamp(c: Column | str, fallback: Column | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` first, then ISO 8601, then the fallback."""
    text = col(c)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), iso).cast("timestamp_ntz")
    return parsed if fallback is None else F.coalesce(parsed, fallback.cast("timestamp_ntz"))


def map_value(c: Column | str, known: list[str], default: str) -> Column:
    """Keep known values, replace everything else (null too) by the default."""
    return F.when(col(c).isin(*known), col(c)).otherwise(F.lit(default))


def lookup(c: Column | str, pairs: list[tuple[str, float]], default: Column | float | None = None) -> Column:
    """A small fixed table as a CASE expression, so no join is needed."""
    text = col(c)
    branches = reduce(
        lambda acc, kv: acc.when(text == kv[0], F.lit(kv[1])),
        pairs[1:],
        F.when(text == pairs[0][0], F.lit(pairs[0][1])),
    )
    return branches if default is None else branches.otherwise(default)


# --- stable draws --------------------------------------------------------------
def stable_hash(*cols: Column | str, digits: int = 8) -> Column:
    """Non-negative number from the MD5 of the joined values; the same on every engine."""
    text = F.concat_ws("|", *[col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def stable_bucket(n: int, *cols: Column | str) -> Column:
    return F.pmod(stable_hash(*cols), F.lit(n))


def stable_pick(values: list[str], *cols: Column | str) -> Column:
    """One entry of a fixed list, chosen by hash."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (stable_bucket(len(values), *cols) + 1).cast("int"))


# --- dates -----------------------------------------------------------------------
def day_label(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def hours_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("SECOND", col(start), col(end)) / F.lit(3600.0)


def plus_hours(c: Column | str, hours: Column | str) -> Column:
    """Add fractional hours to the second."""
    return F.timestamp_add("SECOND", F.floor(col(hours) * 3600).cast("int"), col(c))


def period_label(c: Column | str, granularity: str) -> Column:
    """Sortable label of the hour, day, ISO week, month or quarter."""
    ts = col(c)
    if granularity == "hourly":
        return F.date_format(ts, "yyyy-MM-dd HH:00")
    if granularity == "daily":
        return day_label(ts)
    if granularity == "weekly":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))
    if granularity == "monthly":
        return F.date_format(ts, "yyyy-MM")
    if granularity == "quarterly":
        return F.format_string("%04d-Q%d", F.year(ts), F.quarter(ts))
    raise ValueError(f"unknown granularity {granularity}")


def temporal_parts(c: str) -> dict[str, Column]:
    """Nine calendar columns prefixed with the source column name."""
    ts = F.col(c)
    weekday = F.weekday(ts)
    return {
        f"{c}_year": F.year(ts),
        f"{c}_month": F.month(ts),
        f"{c}_day": F.dayofmonth(ts),
        f"{c}_dayofweek": weekday,
        f"{c}_hour": F.hour(ts),
        f"{c}_quarter": F.quarter(ts),
        f"{c}_is_weekend": (weekday >= 5).cast("int"),
        f"{c}_is_month_end": (F.to_date(ts) == F.last_day(ts)).cast("int"),
        f"{c}_is_month_start": (F.dayofmonth(ts) == 1).cast("int"),
    }


# --- numbers and text ---------------------------------------------------------------
def rate(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """``part / whole * scale``; zero when there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") * scale / whole).otherwise(F.lit(0.0))


def number_text(c: Column | str, digits: int = 2) -> Column:
    return F.bround(col(c), digits).cast("string")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def nan_to_null(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def valid_phone(c: Column | str) -> Column:
    """Digits and plus signs, 10 to 15 of them once blanks, dashes and brackets are gone."""
    return F.coalesce(F.translate(col(c), " -()", "").rlike(r"^[0-9+]{10,15}$"), F.lit(False))


def sms_text(c: Column | str) -> Column:
    """Cut to one text message of 160 characters."""
    text = col(c)
    return F.when(F.length(text) > 160, F.concat(F.substring(text, 1, 157), F.lit("..."))).otherwise(text)


def title_case(c: Column | str) -> Column:
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def drop_nulls(*items: Column) -> Column:
    return F.array_compact(F.array(*items))
