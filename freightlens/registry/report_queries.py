"""Rule rows and report figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, rules, windows
from ..plans import reports
from ..session import new_path
from ..sources import files, shapes
from .core import register
from .metric_queries import BENCHMARK_SQL, CAPACITY_SQL, KPI_SQL, MEANS_SQL, OVERVIEW_SQL, REALTIME_SQL, SHARES_SQL, SUMMARY_SQL, rows


def figures(spark, root, **options):
    return reports.Figures(rows(spark, root), **options)


def joined(df, column):
    """Arrays as text, so rows compare on every engine."""
    return df.withColumn(column, F.array_join(column, "; "))


_S = "CAST(round_even({0}, 2) AS VARCHAR)"
TREND_INSIGHTS_SQL = f"""SELECT type, title FROM (SELECT s.*, unnest([
    CASE WHEN delay_direction = 'increasing' AND delay_significant THEN {{'type': 'warning', 'title': 'Increasing Delay Rate Trend'}} END,
    CASE WHEN delay_direction = 'decreasing' AND delay_significant THEN {{'type': 'positive', 'title': 'Improving Delay Performance'}} END,
    CASE WHEN volume_direction = 'increasing' AND volume_significant THEN {{'type': 'info', 'title': 'Growing Shipment Volume'}} END,
    CASE WHEN total_periods >= 7 AND delay_rate_variance > 25 THEN {{'type': 'info', 'title': 'High Delay Rate Variability'}} END
  ], recursive := true) FROM ({SUMMARY_SQL}) s) WHERE type IS NOT NULL"""


@register("trend_insights", "R-01", TREND_INSIGHTS_SQL)
def trend_insights(spark, root):
    trend = metrics.trend_summary(metrics.trend_series(rows(spark, root), "daily"))
    return rules.trend_insights(trend).select("type", "title")


@register(
    "trend_insights_hourly",
    "R-01",
    """SELECT 'info' AS type, 'High Delay Rate Variability' AS title, 'medium' AS impact,
         'Investigate cyclical patterns and stabilize operations' AS recommendations
       FROM (SELECT var_samp(r) AS v, count(*) AS n FROM (SELECT 100e0 * count(*) FILTER (logistics_delay) / count(*) AS r
         FROM scored GROUP BY date_trunc('hour', ts))) WHERE n >= 7 AND v > 25""",
)
def trend_insights_hourly(spark, root):
    trend = metrics.trend_summary(metrics.trend_series(rows(spark, root), "hourly"))
    found = rules.trend_insights(trend).filter(F.col("title") == "High Delay Rate Variability")
    return joined(found.select("type", "title", "impact", "recommendations"), "recommendations")


CAUSE_FACTS_SQL = """SELECT (SELECT count(*) FROM scored WHERE logistics_delay) AS total_delayed,
  (SELECT 100e0 * count(*) FILTER (logistics_delay) / count(*) FROM scored) AS dr,
  (SELECT count(*) FILTER (delay_probability > 0.8e0) FROM scored) AS hr,
  (SELECT logistics_delay_reason FROM scored WHERE logistics_delay GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS tr,
  (SELECT 100e0 * max(n) / sum(n) FROM (SELECT count(*) AS n FROM scored WHERE logistics_delay GROUP BY logistics_delay_reason)) AS trs,
  (SELECT count(*) FROM (SELECT asset_id FROM scored GROUP BY 1 HAVING 100e0 * count(*) FILTER (logistics_delay) / count(*) > 20)) AS ra,
  (SELECT count(*) FROM (SELECT 100e0 * count(*) FILTER (logistics_delay) / count(*) AS r FROM scored GROUP BY asset_id
     HAVING count(*) FILTER (logistics_delay) > 0 ORDER BY r DESC LIMIT 10) WHERE r > 20) AS rta,
  (SELECT hour(ts) FROM scored WHERE logistics_delay GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS ph,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM scored WHERE logistics_delay GROUP BY hour(ts))) AS phc,
  (SELECT 100e0 * max(n) / sum(n) FROM (SELECT count(*) AS n FROM scored WHERE logistics_delay GROUP BY hour(ts))) AS phs"""

CAUSE_INSIGHTS_SQL = f"""SELECT 0 AS position, 'critical' AS type, 'High Overall Delay Rate' AS title,
    'System-wide delay rate of ' || {_S.format('dr')} || '% exceeds acceptable thresholds' AS description FROM f WHERE dr > 15
  UNION ALL SELECT 1, 'warning', 'Elevated Delay Rate', 'Delay rate of ' || {_S.format('dr')} || '% requires attention' FROM f WHERE dr > 10 AND dr <= 15
  UNION ALL SELECT 2, 'actionable', 'Dominant Delay Cause: ' || tr, tr || ' accounts for ' || {_S.format('trs')} || '% of all delays' FROM f WHERE trs > 40
  UNION ALL SELECT 3, 'warning', 'High-Risk Assets Identified', CAST(ra AS VARCHAR) || ' assets have delay rates > 20%' FROM f WHERE ra > 0
  UNION ALL SELECT 4, 'info', 'Peak Delay Period: ' || CAST(ph AS VARCHAR) || ':00',
    'Hour ' || CAST(ph AS VARCHAR) || ' accounts for ' || CAST(phc AS VARCHAR) || ' delays' FROM f WHERE phs > 20"""


@register("root_cause_insights", "R-02", f"WITH f AS ({CAUSE_FACTS_SQL}) {CAUSE_INSIGHTS_SQL}")
def root_cause_insights(spark, root):
    return rules.root_cause_insights(figures(spark, root).cause_facts).select("position", "type", "title", "description")


@register("root_cause_insights_with_hotspots", "R-02 A-08")
def root_cause_insights_with_hotspots(spark, root):
    fig = figures(spark, root, hotspots=metrics.geographic_hotspots(rows(spark, root)))
    return rules.root_cause_insights(fig.cause_facts)


_LEVEL = "CASE WHEN high_risk_rate > 20 THEN 'high' WHEN max_asset_share > 50 THEN 'medium' ELSE 'low' END"


@register("overall_risk_level", "R-03", f"SELECT {_LEVEL} AS risk_level, max_asset_share, max_hour_share, high_risk_rate FROM ({SHARES_SQL})")
def overall_risk_level(spark, root):
    return figures(spark, root).risk_facts.select("risk_level", "max_asset_share", "max_hour_share", "high_risk_rate")


@register(
    "risk_factors_of_delayed",
    "R-03",
    """SELECT 'High Delay Probability Shipments' AS factor, 'high' AS level, printf('%.1f%%', 100e0 * hr / n) AS value,
         CAST(hr AS VARCHAR) || ' shipments have >80% delay probability' AS description
       FROM (SELECT count(*) AS n, count(*) FILTER (delay_probability > 0.8e0) AS hr FROM scored WHERE logistics_delay) WHERE 100e0 * hr / n > 20""",
)
def risk_factors_of_delayed(spark, root):
    late = rows(spark, root).filter("logistics_delay")
    return rules.risk_factors(metrics.risk_shares(late)).drop("position")


@register(
    "predictive_recommendations",
    "R-04",
    f"""WITH m AS ({MEANS_SQL}), c AS (SELECT max(n) AS peak FROM daily), l AS (SELECT {_LEVEL} AS level FROM ({SHARES_SQL}))
       SELECT 'high' AS priority, 'Capacity Expansion Required' AS title,
         'Predicted volume (' || CAST(round_even(expected_avg_volume, 1) AS VARCHAR) || ') approaching capacity limit' AS description FROM m, c WHERE expected_avg_volume > 0.9e0 * peak
       UNION ALL SELECT 'high', 'High Risk Level Detected', 'Multiple high-risk factors identified' FROM l WHERE level = 'high'
       UNION ALL SELECT 'medium', 'Delay Rate Optimization Needed',
         'Predicted delay rate of ' || {_S.format('expected_avg_delay_rate')} || '% exceeds targets' FROM m WHERE expected_avg_delay_rate > 10""",
)
def predictive_recommendations(spark, root):
    return rules.predictive_recommendations(figures(spark, root).outlook_facts).select("priority", "title", "description")


@register(
    "issues",
    "R-05 V-02",
    f"""WITH f AS ({CAUSE_FACTS_SQL}), i AS ({CAUSE_INSIGHTS_SQL})
       SELECT 'High Delay Rate' AS issue, 'critical' AS severity, 'Delay rate of ' || {_S.format('dr')} || '% exceeds acceptable thresholds' AS description FROM f WHERE dr > 15
       UNION ALL SELECT 'Elevated Delay Rate', 'warning', 'Delay rate of ' || {_S.format('dr')} || '% requires attention' FROM f WHERE dr > 10 AND dr <= 15
       UNION ALL SELECT 'High Number of High-Risk Shipments', 'warning', CAST(hr AS VARCHAR) || ' shipments have >80% delay probability' FROM f WHERE hr > 10
       UNION ALL SELECT title, type, description FROM i WHERE type IN ('critical', 'warning')""",
)
def issues(spark, root):
    facts = figures(spark, root).cause_facts
    return rules.issues(facts, rules.root_cause_insights(facts)).select("issue", "severity", "description")


@register(
    "opportunities",
    "R-06",
    f"""WITH f AS ({CAUSE_FACTS_SQL})
       SELECT 'Delay Reduction' AS category, 'Reduce delay rate from ' || {_S.format('dr')} || '% to <10%' AS potential_improvement, 'medium' AS implementation_effort FROM f WHERE dr > 10
       UNION ALL SELECT 'Risk Mitigation', 'Reduce high-risk shipments from ' || CAST(hr AS VARCHAR) || ' to <5', 'low' FROM f WHERE hr > 5
       UNION ALL SELECT 'Asset Performance Optimization', 'Improve performance of ' || CAST(rta AS VARCHAR) || ' underperforming assets', 'high' FROM f WHERE rta > 0""",
)
def opportunities(spark, root):
    return rules.opportunities(figures(spark, root).cause_facts).select("category", "potential_improvement", "implementation_effort")


_ASSET = "CASE WHEN logistics_delay THEN 'Truck_late' ELSE asset_id END"
_UTIL = f"""SELECT asset_id, n, CASE WHEN n < avg(n) OVER () * 0.7e0 THEN 'under' WHEN n > avg(n) OVER () * 1.3e0 THEN 'over' ELSE 'balanced' END AS load
  FROM (SELECT {_ASSET} AS asset_id, count(*) AS n FROM scored GROUP BY 1)"""
_RESOURCE = f"""WITH u AS ({_UTIL}), s AS (SELECT string_agg(asset_id, ', ' ORDER BY asset_id) FILTER (load = 'over') AS o,
    string_agg(asset_id, ', ' ORDER BY asset_id) FILTER (load = 'under') AS u FROM u)
  SELECT 'Redistribute workload from overutilized assets (' || o || ') to underutilized assets (' || u || ')' AS recommendation FROM s WHERE o IS NOT NULL AND u IS NOT NULL
  UNION ALL SELECT 'Review asset allocation strategy to balance utilization'
  UNION ALL SELECT 'Consider adding capacity if consistently overutilized'"""


@register("resource_recommendations", "R-07 X-08", _RESOURCE)
def resource_recommendations(spark, root):
    """Late rows count as one asset here, so the load is uneven and both lists fill."""
    uneven = rows(spark, root).withColumn("asset_id", F.when(F.col("logistics_delay"), "Truck_late").otherwise(F.col("asset_id")))
    return rules.resource_recommendations(metrics.asset_utilization(uneven)).select("recommendation")


_PLANS = f"""SELECT CASE kpi WHEN 'delay_rate' THEN 'Delay Rate' ELSE 'On Time Delivery Rate' END AS kpi, current_value AS current, target,
  CASE kpi WHEN 'delay_rate' THEN current_value - target ELSE target - current_value END AS gap, 4 AS actions
  FROM ({KPI_SQL}) WHERE status IN ('warning', 'critical')"""


@register("kpi_plans", "R-08 X-08", _PLANS)
def kpi_plans(spark, root):
    plans = rules.kpi_plans(metrics.evaluate_kpis(rows(spark, root)))
    return plans.withColumn("actions", F.size("actions"))


@register(
    "prescriptive_recommendations",
    "R-09 V-02",
    f"""WITH f AS ({CAUSE_FACTS_SQL}), p AS ({_PLANS}), a AS ({_RESOURCE.replace(_ASSET, 'asset_id')})
       SELECT 'Delay Reduction' AS category, 'medium' AS priority, 'Reduce delay rate from ' || {_S.format('dr')} || '% to <10%' AS description FROM f WHERE dr > 10
       UNION ALL SELECT 'Risk Mitigation', 'high', 'Reduce high-risk shipments from ' || CAST(hr AS VARCHAR) || ' to <5' FROM f WHERE hr > 5
       UNION ALL SELECT 'Asset Performance Optimization', 'medium', 'Improve performance of ' || CAST(rta AS VARCHAR) || ' underperforming assets' FROM f WHERE rta > 0
       UNION ALL SELECT 'Resource Optimization', 'medium', recommendation FROM a
       UNION ALL SELECT 'KPI Improvement: ' || kpi, 'high', 'Close gap of ' || {_S.format('gap')} || ' to reach target' FROM p""",
)
def prescriptive_recommendations(spark, root):
    fig = figures(spark, root)
    rows_ = rules.prescriptive_recommendations(
        rules.opportunities(fig.cause_facts), rules.resource_recommendations(fig.utilization), rules.kpi_plans(fig.kpis)
    )
    return rows_.select("category", "priority", "description")


@register(
    "descriptive_insights",
    "R-10",
    f"""SELECT 'descriptive' AS type, 'Shipment Overview' AS title, delay_rate AS first_figure FROM ({OVERVIEW_SQL})
       UNION ALL SELECT 'kpi_evaluation', 'KPI Performance', current_value FROM ({KPI_SQL}) WHERE kpi = 'delay_rate'""",
)
def descriptive_insights(spark, root):
    r = rows(spark, root)
    out = rules.descriptive_insights(metrics.overview(r), metrics.evaluate_kpis(r))
    return out.select("type", "title", F.try_element_at("metrics", F.lit("delay_rate")).alias("first_figure"))


@register(
    "report_descriptive",
    "R-11 A-16",
    f"""SELECT o.*, (SELECT count(DISTINCT asset_id) FROM scored) AS assets, (SELECT count(*) FROM scored WHERE shipment_status = 'Delayed') AS status_delayed,
         (SELECT count(*) FROM scored WHERE logistics_delay_reason = 'Traffic') AS reason_traffic, 2 AS kpis, 2 AS insights,
         (SELECT strftime(min(ts), '%Y-%m-%d') FROM scored) AS "start" FROM ({OVERVIEW_SQL}) o""",
)
def report_descriptive(spark, root):
    r = reports.descriptive(figures(spark, root), per_asset=True)
    return r.select(
        "performance_metrics.*", F.size("asset_distribution").alias("assets"),
        F.try_element_at("status_distribution", F.lit("Delayed")).alias("status_delayed"),
        F.try_element_at("delay_reasons", F.lit("Traffic")).alias("reason_traffic"),
        F.size("kpi_evaluation").alias("kpis"), F.size("insights").alias("insights"), "data_summary.start",
    )


_TITLES = "(SELECT string_agg(title, '; ' ORDER BY position) FROM i)"


@register(
    "report_diagnostic",
    "R-12",
    f"""WITH f AS ({CAUSE_FACTS_SQL}), i AS ({CAUSE_INSIGHTS_SQL})
       SELECT total_delayed, dr AS delay_rate, tr AS top_reason, trs AS top_share, ph AS peak_hour,
         (SELECT dayname(ts) FROM scored WHERE logistics_delay GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS worst_day,
         (SELECT count(*) FROM scored WHERE logistics_delay AND hour(ts) = 9) AS delays_at_nine, {_TITLES} AS insights FROM f""",
)
def report_diagnostic(spark, root):
    r = reports.diagnostic(figures(spark, root))
    first = F.get("delay_reasons", F.lit(0))
    return r.select(
        "summary.total_delayed", "summary.delay_rate", first["reason"].alias("top_reason"), first["share"].alias("top_share"),
        "peaks.peak_hour", "peaks.worst_day", F.try_element_at("hourly_distribution", F.lit("09")).alias("delays_at_nine"),
        F.array_join("insights.title", "; ").alias("insights"),
    )


@register(
    "report_predictive",
    "R-13",
    f"""SELECT m.*, c.max_daily_volume, c.capacity_status, c.volume_direction, (SELECT {_LEVEL} FROM ({SHARES_SQL})) AS overall_risk_level, 7 AS forecast_days
       FROM ({MEANS_SQL}) m, ({CAPACITY_SQL}) c""",
)
def report_predictive(spark, root):
    r = reports.predictive(figures(spark, root))
    return r.select(
        "forecast_summary.*", "capacity_analysis.max_daily_volume", "capacity_analysis.capacity_status",
        "capacity_analysis.volume_direction", "overall_risk_level", F.size("forecasts").alias("forecast_days"),
    )


@register(
    "report_prescriptive",
    "R-14",
    f"""WITH f AS ({CAUSE_FACTS_SQL}), p AS ({_PLANS}), a AS ({_RESOURCE.replace(_ASSET, 'asset_id')})
       SELECT (CASE WHEN dr > 10 THEN 1 ELSE 0 END) + (CASE WHEN hr > 10 THEN 1 ELSE 0 END) + (CASE WHEN dr > 10 THEN 1 ELSE 0 END)
           + (CASE WHEN ra > 0 THEN 1 ELSE 0 END) AS issues,
         (CASE WHEN dr > 10 THEN 1 ELSE 0 END) + (CASE WHEN hr > 5 THEN 1 ELSE 0 END) + (CASE WHEN rta > 0 THEN 1 ELSE 0 END) AS opportunities,
         (SELECT count(*) FROM p) AS plans, (SELECT count(DISTINCT asset_id) FROM scored) AS assets FROM f""",
)
def report_prescriptive(spark, root):
    r = reports.prescriptive(figures(spark, root), per_asset=True)
    n = lambda c: F.size(c).cast("bigint")
    return r.select(
        n("issues").alias("issues"), n("optimization_opportunities").alias("opportunities"),
        n("kpi_improvements").alias("plans"),
        n(F.filter("asset_utilization", lambda a: a["asset_id"].isNotNull())).alias("assets"),
    )


_ALL_TITLES = f"""SELECT string_agg(title, '; ' ORDER BY tier, position) FROM (
    SELECT 0 AS tier, 0 AS position, 'Shipment Overview' AS title UNION ALL SELECT 0, 1, 'KPI Performance'
    UNION ALL SELECT 1, position, title FROM i
    UNION ALL SELECT 2, 0, title FROM ({TREND_INSIGHTS_SQL}))"""


@register(
    "report_comprehensive",
    "R-15 V-01",
    f"""WITH f AS ({CAUSE_FACTS_SQL}), i AS ({CAUSE_INSIGHTS_SQL}) SELECT ({_ALL_TITLES}) AS insights, 'descriptive,diagnostic,predictive' AS tiers""",
)
def report_comprehensive(spark, root):
    r = reports.comprehensive(figures(spark, root))
    return r.select(F.array_join("insights.title", "; ").alias("insights"), F.array_join("analysis_types", ",").alias("tiers"))


@register(
    "report_executive",
    "R-16 T-04",
    f"""SELECT o.*, t.total_periods, t.peak_volume_period, t.delay_direction FROM ({OVERVIEW_SQL}) o, ({SUMMARY_SQL}) t""",
)
def report_executive(spark, root):
    r = reports.executive(figures(spark, root))
    return r.select("overview.*", "trends.total_periods", "trends.peak_volume_period", "trends.delay_direction")


@register(
    "report_operational",
    "R-17",
    f"""SELECT r.*, (SELECT count(*) FROM scored WHERE shipment_status = 'Pending') AS pending, c.utilization_rate AS capacity_use,
         (SELECT asset_id FROM scored GROUP BY 1 ORDER BY (100 - 100e0 * count(*) FILTER (logistics_delay) / count(*)) * (1 - avg(delay_probability)) DESC, 1 LIMIT 1) AS best_asset
       FROM ({REALTIME_SQL}) r, ({CAPACITY_SQL}) c""",
)
def report_operational(spark, root):
    r = reports.operational(figures(spark, root))
    return r.select(
        "real_time_metrics.*", F.try_element_at("status_distribution", F.lit("Pending")).alias("pending"),
        F.col("capacity_analysis.utilization_rate").alias("capacity_use"),
        F.get("top_performers", F.lit(0))["asset_id"].alias("best_asset"),
    )


@register(
    "report_forecast",
    "R-18 A-22",
    f"""SELECT t.avg_delay_rate, t.volume_direction, 14 AS forecast_days, 3 AS scenarios,
         100e0 * count(*) FILTER (logistics_delay) / count(*) * 0.9e0 AS optimistic_rate FROM scored, ({SUMMARY_SQL}) t GROUP BY 1, 2""",
)
def report_forecast(spark, root):
    r = reports.forecast_report(figures(spark, root, forecast_days=14))
    return r.select(
        "historical_trends.avg_delay_rate", "historical_trends.volume_direction", F.size("forecasts").alias("forecast_days"),
        F.size("scenarios").alias("scenarios"), F.get("scenarios", F.lit(0))["delay_rate"].alias("optimistic_rate"),
    )


@register(
    "report_scorecard",
    "R-19 A-21 A-23",
    f"""SELECT k.current_value AS on_time_rate, k.status, b.tier, b.percentile,
         (SELECT count(DISTINCT isoyear(ts) * 100 + week(ts)) FROM scored) AS weeks
       FROM ({KPI_SQL}) k JOIN ({BENCHMARK_SQL}) b USING (kpi) WHERE kpi = 'on_time_delivery_rate'""",
)
def report_scorecard(spark, root):
    r = reports.scorecard(figures(spark, root))
    kpi = F.get("kpi_evaluation", F.lit(0))
    bench = F.element_at(F.filter("benchmark_comparison", lambda b: b["kpi"] == "on_time_delivery_rate"), 1)
    return r.select(
        kpi["current_value"].alias("on_time_rate"), kpi["status"].alias("status"), bench["tier"].alias("tier"),
        bench["percentile"].alias("percentile"), F.size("weekly_data").alias("weeks"),
    )


@register(
    "report_export",
    "S-11 C-14",
    f"""WITH f AS ({CAUSE_FACTS_SQL}), i AS ({CAUSE_INSIGHTS_SQL})
       SELECT '2024-01-31T00:00:00' AS generated_at, (SELECT count(*) FROM i) AS total_insights, {_TITLES} AS titles""",
)
def report_export(spark, root):
    path = new_path(spark, "export")
    found = rules.root_cause_insights(figures(spark, root).cause_facts)
    files.export_json(reports.export_rows(found, "2024-01-31T00:00:00"), path)
    back = spark.read.schema("generated_at string, total_insights bigint, insights array<struct<title:string>>").json(path)
    return back.select("generated_at", "total_insights", F.array_join("insights.title", "; ").alias("titles"))


@register(
    "status_changes",
    "W-06",
    """SELECT id, asset_id, ts, old_status, shipment_status AS new_status FROM
         (SELECT *, lag(shipment_status) OVER (PARTITION BY asset_id ORDER BY ts, id) AS old_status FROM readings)
       WHERE old_status <> shipment_status""",
)
def status_changes(spark, root):
    return windows.status_changes(shapes.readings(spark, root)).select("id", "asset_id", "ts", "old_status", "new_status")


@register(
    "sequences",
    "W-07",
    """SELECT asset_id, row_index, CAST(s AS BIGINT) AS wait_sum, f AS first_wait, target FROM (SELECT asset_id, row_number() OVER k - 1 AS row_index,
         sum(waiting_time) OVER w AS s, first(waiting_time) OVER w AS f, count(*) OVER w AS n, temperature IS NULL AS target
         FROM readings WINDOW k AS (PARTITION BY asset_id ORDER BY ts, id),
           w AS (PARTITION BY asset_id ORDER BY ts, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE n = 10""",
)
def sequences(spark, root):
    flagged = shapes.readings(spark, root).withColumn("no_temperature", F.col("temperature").isNull())
    out = windows.sequences(flagged, "asset_id", ["ts", "id"], ["waiting_time"], "no_temperature", block=200)
    waits = F.transform("sequence", lambda s: s["waiting_time"])
    return out.select(
        "asset_id", "row_index",
        F.aggregate(waits, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("wait_sum"),
        F.get(waits, F.lit(0)).alias("first_wait"), "target",
    )


@register(
    "missing_features",
    "V-03",
    """SELECT CASE WHEN temperature IS NULL AND humidity IS NULL THEN 'temperature,humidity' WHEN temperature IS NULL THEN 'temperature'
         WHEN humidity IS NULL THEN 'humidity' ELSE '' END AS missing, count(*) AS n FROM readings GROUP BY 1""",
)
def missing_features(spark, root):
    expected = ["temperature", "humidity", "waiting_time"]
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in expected]))
    gone = F.array_except(F.array(*[F.lit(c) for c in expected]), present)
    return shapes.readings(spark, root).groupBy(F.array_join(gone, ",").alias("missing")).agg(F.count("*").alias("n"))


@register(
    "missing_keys",
    "V-03",
    "SELECT id FROM customers EXCEPT ALL SELECT DISTINCT customer_id FROM voyages",
)
def missing_keys(spark, root):
    used = shapes.voyages(spark, root).select("customer_id").distinct()
    return shapes.customers(spark, root).select("id").exceptAll(used)
