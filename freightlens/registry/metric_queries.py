"""Metrics over readings: series, root causes, forecast, KPIs, overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, metrics
from ..sources import shapes
from .core import register

_RATE = "100e0 * count(*) FILTER (logistics_delay) / count(*)"
_PERIODS = {
    "hourly": "strftime(ts, '%Y-%m-%d %H:00')",
    "daily": "strftime(ts, '%Y-%m-%d')",
    "weekly": "printf('%04d-W%02d', isoyear(ts), week(ts))",
    "monthly": "strftime(ts, '%Y-%m')",
    "quarterly": "printf('%04d-Q%d', year(ts), quarter(ts))",
}


def rows(spark, root):
    return cleaning.analytics_rows(shapes.readings(spark, root))


def daily(spark, root):
    return metrics.daily_series(rows(spark, root))


def _trend_sql(granularity: str) -> str:
    return f"""SELECT {_PERIODS[granularity]} AS period, count(*) AS shipments, count(*) FILTER (logistics_delay) AS delayed,
      avg(delay_probability) AS avg_probability, stddev_samp(delay_probability) AS std_probability, avg(waiting_time) AS avg_wait,
      median(waiting_time) AS median_wait, max(waiting_time) AS max_wait, {_RATE} AS delay_rate
    FROM scored GROUP BY 1"""


def _register_trend(granularity: str) -> None:
    @register(f"trend_{granularity}", "A-01 X-02 U-02", _trend_sql(granularity))
    def trend(spark, root):
        return metrics.trend_series(rows(spark, root), granularity)


for _g in _PERIODS:
    _register_trend(_g)


def trend_columns(series: str, order: str, value: str, prefix: str) -> str:
    """One-row SELECT with the trend of ``value`` over an ordered CTE."""
    return f"""SELECT CASE WHEN abs(sl) < 0.01e0 THEN 'stable' WHEN sl > 0 THEN 'increasing' ELSE 'decreasing' END AS {prefix}direction,
      sl AS {prefix}slope, abs(r) AS {prefix}strength, r * r AS {prefix}r_squared, p AS {prefix}p_value, p < 0.05e0 AS {prefix}significant
    FROM (SELECT sl, r, CASE WHEN n % 2 = 0 THEN
        1 - abs(r) / sqrt(pi()) * list_sum([exp(lgamma(j + 0.5e0) - lgamma(j + 1)) * pow(1 - r * r, j) FOR j IN range(0, (n - 2) // 2)])
      ELSE 1 - 2 / pi() * (asin(abs(r)) + CASE WHEN n > 3 THEN abs(r) * sqrt(1 - r * r) * sqrt(pi()) / 2
        * list_sum([exp(lgamma(j + 1) - lgamma(j + 1.5e0)) * pow(1 - r * r, j) FOR j IN range(0, (n - 3) // 2)]) ELSE 0 END) END AS p
      FROM (SELECT count(*) AS n, regr_slope(y, x) AS sl, corr(y, x) AS r
            FROM (SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS DOUBLE) AS x, CAST({value} AS DOUBLE) AS y FROM {series})))"""


@register("delay_rate_trend", "A-03 W-04 U-01", trend_columns("daily", "d", "rate", ""))
def delay_rate_trend(spark, root):
    return metrics.linear_trend(daily(spark, root), "day", "delay_rate")


@register("volume_trend", "A-03 U-01", trend_columns("daily", "d", "n", ""))
def volume_trend(spark, root):
    return metrics.linear_trend(daily(spark, root), "day", "shipments")


SUMMARY_SQL = f"""WITH t AS (SELECT strftime(d, '%Y-%m-%d') AS period, d, n, rate FROM daily)
SELECT * FROM (SELECT count(*) AS total_periods, avg(n) AS avg_shipments_per_period, avg(rate) AS avg_delay_rate,
    var_samp(rate) AS delay_rate_variance,
    (SELECT period FROM t ORDER BY n DESC, period LIMIT 1) AS peak_volume_period,
    (SELECT period FROM t ORDER BY rate DESC, period LIMIT 1) AS highest_delay_period FROM t),
  ({trend_columns("t", "d", "rate", "delay_")}), ({trend_columns("t", "d", "n", "volume_")})"""


@register("trend_summary", "A-02 A-04 T-05", SUMMARY_SQL)
def trend_summary(spark, root):
    return metrics.trend_summary(metrics.trend_series(rows(spark, root), "daily"))


@register(
    "delay_rate_variance",
    "A-04",
    "SELECT count(*) AS periods, var_samp(rate) AS variance, count(*) >= 7 AND var_samp(rate) > 25 AS unstable FROM daily",
)
def delay_rate_variance(spark, root):
    v = F.var_samp("delay_rate")
    return daily(spark, root).agg(
        F.count("*").alias("periods"), v.alias("variance"), ((F.count("*") >= 7) & (v > 25)).alias("unstable")
    )


@register(
    "delay_reason_shares",
    "A-05",
    """SELECT logistics_delay_reason AS reason, count(*) AS n, 100e0 * count(*) / (SELECT count(*) FROM scored WHERE logistics_delay) AS share
       FROM scored WHERE logistics_delay AND logistics_delay_reason IS NOT NULL GROUP BY 1""",
)
def delay_reason_shares(spark, root):
    return metrics.reason_shares(rows(spark, root))


@register(
    "top_delay_reasons",
    "A-05 T-03",
    """SELECT logistics_delay_reason AS reason, count(*) AS n FROM scored WHERE logistics_delay GROUP BY 1 ORDER BY n DESC, reason LIMIT 5""",
)
def top_delay_reasons(spark, root):
    shares = metrics.reason_shares(rows(spark, root)).select("reason", "n")
    return metrics.top_k(shares, 5, F.col("n").desc(), F.col("reason"))


@register(
    "top_delay_assets",
    "A-06 T-02",
    f"""SELECT asset_id, count(*) FILTER (logistics_delay) AS total_delays, {_RATE} AS delay_rate FROM scored GROUP BY 1
       HAVING count(*) FILTER (logistics_delay) > 0 ORDER BY delay_rate DESC, total_delays DESC, asset_id LIMIT 10""",
)
def top_delay_assets(spark, root):
    return metrics.top_delay_assets(rows(spark, root))


@register("delays_by_hour", "A-07 X-01", "SELECT hour(ts) AS hour, count(*) AS n FROM scored WHERE logistics_delay GROUP BY 1")
def delays_by_hour(spark, root):
    return metrics.delays_by_hour(rows(spark, root))


@register("delays_by_weekday", "A-07 X-03", "SELECT dayname(ts) AS weekday, count(*) AS n FROM scored WHERE logistics_delay GROUP BY 1")
def delays_by_weekday(spark, root):
    return metrics.delays_by_weekday(rows(spark, root))


@register(
    "delay_peaks",
    "A-07 T-05",
    """SELECT (SELECT hour(ts) FROM scored WHERE logistics_delay GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_hour,
         (SELECT dayname(ts) FROM scored WHERE logistics_delay GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS worst_day""",
)
def delay_peaks(spark, root):
    r = rows(spark, root)
    return metrics.one_row(
        metrics.first_max(metrics.delays_by_hour(r), "hour", "n", "peak_hour"),
        metrics.first_max(metrics.delays_by_weekday(r), "weekday", "n", "worst_day"),
    )


@register("geographic_hotspots", "A-08")
def geographic_hotspots(spark, root):
    return metrics.geographic_hotspots(rows(spark, root))


@register(
    "delay_summary",
    "A-09",
    f"""SELECT count(*) FILTER (logistics_delay) AS total_delayed, {_RATE} AS delay_rate,
         avg(delay_probability) FILTER (logistics_delay) AS avg_delay_probability,
         avg(waiting_time) FILTER (logistics_delay) AS avg_waiting_time FROM scored""",
)
def delay_summary(spark, root):
    return metrics.delay_summary(rows(spark, root))


@register(
    "daily_series",
    "A-10",
    """SELECT strftime(d, '%Y-%m-%d') AS day, n AS shipments, delayed, prob AS avg_probability, wait AS avg_wait, rate AS delay_rate FROM daily""",
)
def daily_series(spark, root):
    return daily(spark, root)


_FORECAST = """WITH ma AS (SELECT d, avg(n) OVER w AS vm, avg(rate) OVER w AS rm, row_number() OVER (ORDER BY d DESC) - 1 AS back
    FROM daily WINDOW w AS (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
  ends AS (SELECT max(d) AS last, max(vm) FILTER (back = 0) AS v0, max(vm) FILTER (back = 2) AS v2,
    max(rm) FILTER (back = 0) AS r0, max(rm) FILTER (back = 2) AS r2 FROM ma WHERE back < 3),
  fc AS (SELECT i, strftime(last + CAST(i AS INTEGER), '%Y-%m-%d') AS day, greatest(0e0, v0 + (v0 - v2) / 3 * i) AS predicted_volume,
    greatest(0e0, least(100e0, r0 + (r0 - r2) / 3 * i)) AS predicted_delay_rate, greatest(0.3e0, 0.8e0 - 0.1e0 * i) AS confidence
    FROM ends, (SELECT unnest(range(1, {days} + 1)) AS i))"""


@register("forecast_week", "A-11 W-01 W-02", _FORECAST.format(days=7) + " SELECT * FROM fc")
def forecast_week(spark, root):
    return metrics.forecast(daily(spark, root), 7)


@register("forecast_fortnight", "A-11", _FORECAST.format(days=14) + " SELECT * FROM fc")
def forecast_fortnight(spark, root):
    return metrics.forecast(daily(spark, root), 14)


MEANS_SQL = _FORECAST.format(days=7) + """ SELECT (SELECT avg(n) FROM daily) AS avg_volume, (SELECT avg(rate) FROM daily) AS avg_delay_rate,
  avg(predicted_volume) AS expected_avg_volume, avg(predicted_delay_rate) AS expected_avg_delay_rate FROM fc"""


@register("forecast_means", "A-12", MEANS_SQL)
def forecast_means(spark, root):
    return metrics.forecast_means(daily(spark, root))


CAPACITY_SQL = f"""WITH week AS (SELECT * FROM daily ORDER BY d DESC LIMIT 7)
SELECT * FROM (SELECT max(n) AS max_daily_volume, avg(n) AS avg_daily_volume, 100e0 * avg(n) / max(n) AS utilization_rate,
    CASE WHEN 100e0 * avg(n) / max(n) > 85 THEN 'high' WHEN 100e0 * avg(n) / max(n) > 70 THEN 'medium' ELSE 'low' END AS capacity_status
    FROM daily HAVING count(*) >= 7), ({trend_columns("week", "d", "n", "volume_")})"""


@register("capacity", "A-13 W-03", CAPACITY_SQL)
def capacity(spark, root):
    return metrics.capacity(daily(spark, root))


SHARES_SQL = """SELECT (SELECT asset_id FROM scored GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_asset,
  (SELECT 100e0 * max(n) / sum(n) FROM (SELECT count(*) AS n FROM scored GROUP BY asset_id)) AS max_asset_share,
  (SELECT CAST(hour(ts) AS VARCHAR) FROM scored GROUP BY hour(ts) ORDER BY count(*) DESC, hour(ts) LIMIT 1) AS top_hour,
  (SELECT 100e0 * max(n) / sum(n) FROM (SELECT count(*) AS n FROM scored GROUP BY hour(ts))) AS max_hour_share,
  count(*) FILTER (delay_probability > 0.8e0) AS high_risk_count,
  100e0 * count(*) FILTER (delay_probability > 0.8e0) / count(*) AS high_risk_rate, count(*) AS total FROM scored"""


@register("concentration_shares", "A-14", SHARES_SQL)
def concentration_shares(spark, root):
    return metrics.risk_shares(rows(spark, root))


KPI_SQL = f"""SELECT kpi, v AS current_value, target, CASE WHEN s * v >= s * target THEN 'excellent' WHEN s * v >= s * warning THEN 'good'
    WHEN s * v >= s * critical THEN 'warning' ELSE 'critical' END AS status, v - target AS variance
  FROM (SELECT 'on_time_delivery_rate' AS kpi, 100 - {_RATE} AS v, 95e0 AS target, 90e0 AS warning, 85e0 AS critical, 1e0 AS s FROM scored
    UNION ALL SELECT 'delay_rate', {_RATE}, 5e0, 10e0, 15e0, -1e0 FROM scored)"""


@register("kpi_evaluation", "A-15", KPI_SQL)
def kpi_evaluation(spark, root):
    return metrics.evaluate_kpis(rows(spark, root))


@register(
    "descriptive_distributions",
    "A-16",
    """SELECT 'asset_id' AS field, asset_id AS value, count(*) AS n FROM scored GROUP BY 2
       UNION ALL SELECT 'shipment_status', shipment_status, count(*) FROM scored GROUP BY 2
       UNION ALL SELECT 'logistics_delay_reason', logistics_delay_reason, count(*) FROM scored GROUP BY 2""",
)
def descriptive_distributions(spark, root):
    r = rows(spark, root)
    parts = [
        metrics.distribution(r, c).select(F.lit(c).alias("field"), "value", "n")
        for c in ("asset_id", "shipment_status", "logistics_delay_reason")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


OVERVIEW_SQL = f"""SELECT count(*) AS total_shipments, count(*) FILTER (NOT logistics_delay) AS on_time_shipments,
  count(*) FILTER (logistics_delay) AS delayed_shipments, {_RATE} AS delay_rate, 100 - {_RATE} AS on_time_rate,
  avg(delay_probability) AS avg_delay_probability, count(*) FILTER (delay_probability > 0.8e0) AS high_risk_shipments,
  avg(waiting_time) AS avg_waiting_time FROM scored"""


@register("overview_metrics", "A-16 A-17", OVERVIEW_SQL)
def overview_metrics(spark, root):
    return metrics.overview(rows(spark, root))


REALTIME_SQL = """SELECT count(*) FILTER (shipment_status IS DISTINCT FROM 'Delivered') AS active_shipments, count(DISTINCT asset_id) AS total_assets,
  count(asset_id) * 1e0 / count(DISTINCT asset_id) AS avg_shipments_per_asset,
  100e0 * count(*) FILTER (shipment_status IS DISTINCT FROM 'Delivered') / count(DISTINCT asset_id) AS utilization_rate FROM scored"""


@register("realtime_metrics", "A-18", REALTIME_SQL)
def realtime_metrics(spark, root):
    return metrics.realtime_metrics(rows(spark, root))


_PERFORMANCE = f"""SELECT asset_id, count(*) AS total_shipments, count(*) FILTER (logistics_delay) AS delayed_shipments, {_RATE} AS delay_rate,
  avg(delay_probability) AS avg_delay_probability, (100 - {_RATE}) * (1 - avg(delay_probability)) AS performance_score FROM scored GROUP BY 1"""


@register("asset_performance", "A-19", _PERFORMANCE)
def asset_performance(spark, root):
    return metrics.asset_performance(rows(spark, root))


@register("top_performers", "A-19 T-03", f"SELECT * FROM ({_PERFORMANCE}) ORDER BY performance_score DESC, asset_id LIMIT 3")
def top_performers(spark, root):
    return metrics.top_performers(metrics.asset_performance(rows(spark, root)))


@register("underperformers", "A-19", f"SELECT * FROM ({_PERFORMANCE}) WHERE delay_rate > 15")
def underperformers(spark, root):
    return metrics.underperformers(metrics.asset_performance(rows(spark, root)))


@register(
    "asset_utilization",
    "A-20 W-09",
    f"""SELECT asset_id, utilization_rate, delay_rate, CASE WHEN utilization_rate < m * 0.7e0 THEN 'under'
         WHEN utilization_rate > m * 1.3e0 THEN 'over' ELSE 'balanced' END AS load
       FROM (SELECT *, avg(utilization_rate) OVER () AS m FROM (SELECT asset_id, 100e0 * count(*) / (SELECT count(*) FROM scored) AS utilization_rate,
         {_RATE} AS delay_rate FROM scored GROUP BY 1))""",
)
def asset_utilization(spark, root):
    return metrics.asset_utilization(rows(spark, root))


@register(
    "weekly_kpis",
    "A-21",
    f"""SELECT {_PERIODS["weekly"]} AS week, count(*) AS shipments, {_RATE} AS delay_rate, avg(delay_probability) AS avg_probability
       FROM scored GROUP BY 1""",
)
def weekly_kpis(spark, root):
    return metrics.weekly_kpis(rows(spark, root))


@register(
    "weekly_delay_trend",
    "A-21 A-03",
    f"WITH w AS (SELECT {_PERIODS['weekly']} AS week, {_RATE} AS rate FROM scored GROUP BY 1) " + trend_columns("w", "week", "rate", "delay_"),
)
def weekly_delay_trend(spark, root):
    return metrics.linear_trend(metrics.weekly_kpis(rows(spark, root)), "week", "delay_rate", "delay_")


SCENARIO_SQL = f"""SELECT s.scenario, greatest(0e0, least(100e0, dr * s.f)) AS delay_rate, s.v AS volume_change, s.g AS efficiency_gain
  FROM (SELECT {_RATE} AS dr FROM scored), (VALUES ('optimistic', 0.9e0, 15, 12), ('realistic', 1e0, 5, 3), ('pessimistic', 1.15e0, -5, -8)) s(scenario, f, v, g)"""


@register("scenarios", "A-22", SCENARIO_SQL)
def scenarios(spark, root):
    return metrics.scenarios(rows(spark, root)).select("scenario", "delay_rate", "volume_change", "efficiency_gain")


BENCHMARK_SQL = f"""SELECT kpi, current_value, CASE WHEN s * current_value >= s * b[1] THEN 'excellent' WHEN s * current_value >= s * b[2] THEN 'good'
    WHEN s * current_value >= s * b[3] THEN 'average' ELSE 'poor' END AS tier,
  CAST(floor(25e0 * len(list_filter(b, lambda x: s * current_value >= s * x))) AS INTEGER) AS percentile
  FROM (SELECT *, CASE kpi WHEN 'delay_rate' THEN -1e0 ELSE 1e0 END AS s,
    CASE kpi WHEN 'delay_rate' THEN [2e0, 5e0, 10e0, 15e0] ELSE [98e0, 95e0, 90e0, 85e0] END AS b FROM ({KPI_SQL}))"""


@register("benchmark_tiers", "A-23 X-11", BENCHMARK_SQL)
def benchmark_tiers(spark, root):
    return metrics.benchmark(metrics.evaluate_kpis(rows(spark, root)))


@register("delay_rate_chart", "A-24", "SELECT strftime(d, '%Y-%m-%d') AS day, rate AS delay_rate FROM daily")
def delay_rate_chart(spark, root):
    return metrics.delay_rate_chart(rows(spark, root))


@register(
    "status_distribution",
    "A-25",
    """SELECT 'status' AS source, shipment_status AS value, count(*) AS n FROM scored GROUP BY 2
       UNION ALL SELECT 'flag', CASE WHEN logistics_delay THEN 'Delayed' ELSE 'On Time' END, count(*) FROM scored GROUP BY 2
       UNION ALL SELECT 'none', 'Unknown', count(*) FROM scored""",
)
def status_distribution(spark, root):
    r = rows(spark, root)
    tag = lambda df, name: metrics.status_distribution(df).select(F.lit(name).alias("source"), "value", "n")
    return (
        tag(r, "status")
        .union(tag(r.drop("shipment_status"), "flag"))
        .union(tag(r.drop("shipment_status", "logistics_delay"), "none"))
    )


@register(
    "activity_heatmap",
    "A-26",
    "SELECT dayname(ts) AS weekday, "
    + ", ".join(f'count(*) FILTER (hour(ts) = {h}) AS "{h}"' for h in range(24))
    + " FROM scored GROUP BY 1",
)
def activity_heatmap(spark, root):
    return metrics.activity_heatmap(rows(spark, root))


@register(
    "shipment_statistics",
    "A-27",
    f"""SELECT count(*) AS total_shipments, count(*) FILTER (logistics_delay) AS delayed_shipments, {_RATE} AS delay_rate,
         avg(waiting_time) AS avg_waiting_time, count(*) FILTER (shipment_status = 'In Transit') AS in_transit,
         count(*) FILTER (logistics_delay AND logistics_delay_reason = 'Weather') AS weather_delays FROM readings WHERE is_active""",
)
def shipment_statistics(spark, root):
    out = metrics.shipment_statistics(shapes.readings(spark, root))
    return out.select(
        "total_shipments", "delayed_shipments", "delay_rate", "avg_waiting_time",
        F.try_element_at("status_counts", F.lit("In Transit")).alias("in_transit"),
        F.try_element_at("delay_reasons", F.lit("Weather")).alias("weather_delays"),
    )


@register(
    "dataset_summary",
    "A-38",
    f"""SELECT count(*) AS total_records, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (logistics_delay) AS total_delayed,
         {_RATE} AS delay_rate, min(waiting_time) AS min_wait, max(waiting_time) AS max_wait, avg(waiting_time) AS mean_wait,
         median(waiting_time) AS median_wait, min(latitude) AS min_latitude, max(latitude) AS max_latitude,
         min(longitude) AS min_longitude, max(longitude) AS max_longitude, count(DISTINCT asset_id) AS total_assets,
         string_agg(DISTINCT asset_id, ',' ORDER BY asset_id) AS asset_list FROM readings""",
)
def dataset_summary(spark, root):
    out = metrics.dataset_summary(shapes.readings(spark, root))
    return out.withColumn("asset_list", F.array_join("asset_list", ","))


@register("dataset_assets", "A-38", "SELECT asset_id, count(*) AS n FROM readings WHERE asset_id IS NOT NULL GROUP BY 1")
def dataset_assets(spark, root):
    return metrics.dataset_assets(shapes.readings(spark, root))


@register(
    "dataset_distributions",
    "A-38",
    """SELECT 'shipment_status' AS field, shipment_status AS value, count(*) AS n FROM readings GROUP BY 2
       UNION ALL SELECT 'traffic_status', traffic_status, count(*) FROM readings GROUP BY 2
       UNION ALL SELECT 'logistics_delay_reason', logistics_delay_reason, count(*) FROM readings GROUP BY 2""",
)
def dataset_distributions(spark, root):
    return metrics.dataset_distributions(shapes.readings(spark, root))


@register(
    "table_validation",
    "A-39",
    """SELECT count(*) FILTER (is_active) AS total_records, count(*) FILTER (is_active AND logistics_delay) AS delayed_records,
         100e0 * count(*) FILTER (is_active AND logistics_delay) / count(*) FILTER (is_active) AS delay_rate,
         min(ts) AS first_ts, max(ts) AS last_ts, 'VALID' AS data_integrity FROM readings""",
)
def table_validation(spark, root):
    return metrics.validation(shapes.readings(spark, root))


@register(
    "date_range",
    "A-43",
    """SELECT strftime(min(ts), '%Y-%m-%d') AS "start", strftime(max(ts), '%Y-%m-%d') AS "end" FROM readings""",
)
def date_range(spark, root):
    return metrics.date_range(shapes.readings(spark, root))


@register(
    "moving_means",
    "W-01",
    """SELECT strftime(d, '%Y-%m-%d') AS day, avg(n) OVER w AS volume_ma3, avg(rate) OVER w AS delay_rate_ma3 FROM daily
       WINDOW w AS (ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def moving_means(spark, root):
    return metrics.moving_means(daily(spark, root)).select("day", "volume_ma3", "delay_rate_ma3")


@register(
    "last_seven_days",
    "W-02 W-03",
    """SELECT strftime(d, '%Y-%m-%d') AS day, n AS shipments, row_number() OVER (ORDER BY d DESC) - 1 AS back FROM daily
       QUALIFY row_number() OVER (ORDER BY d DESC) <= 7""",
)
def last_seven_days(spark, root):
    return metrics.last_days(daily(spark, root), 7).select("day", "shipments", "back")
