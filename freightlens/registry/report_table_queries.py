"""Whole reports, saved and loaded as tables; the twins compare every field of every section."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..fixed_values import KPI_ACTIONS
from ..operators import metrics, rules
from ..plans import report_tables
from ..session import new_path
from .core import register
from .metric_queries import CAPACITY_SQL, KPI_SQL, MEANS_SQL, OVERVIEW_SQL, REALTIME_SQL, SHARES_SQL, SUMMARY_SQL, rows
from .report_queries import _LEVEL, _S, CAUSE_FACTS_SQL, figures, joined

AS_OF = "2024-01-31T00:00:00"


def section(name: str, key: str, sql: str, numbers: str = "", texts: str = "") -> str:
    """One section as (section, key, field, number, text) rows; fields without a value have none."""
    fields = [f"{{'field': '{f}', 'number': CAST({f} AS DOUBLE), 'text': CAST(NULL AS VARCHAR)}}" for f in numbers.split()]
    fields += [f"{{'field': '{f}', 'number': CAST(NULL AS DOUBLE), 'text': CAST({chr(34)}{f}{chr(34)} AS VARCHAR)}}" for f in texts.split()]
    return f"""SELECT '{name}' AS section, CAST(k AS VARCHAR) AS key, x.field AS field, x.number AS number, x.text AS text
      FROM (SELECT {key} AS k, unnest([{', '.join(fields)}]) AS x FROM ({sql})) WHERE x.number IS NOT NULL OR x.text IS NOT NULL"""


def whole(*sections: str) -> str:
    return f"WITH f AS ({CAUSE_FACTS_SQL}), i AS ({INSIGHTS}) " + " UNION ALL ".join(sections)


OVERVIEW_FIELDS = "total_shipments on_time_shipments delayed_shipments delay_rate on_time_rate avg_delay_probability high_risk_shipments avg_waiting_time"
_SUMMARY = """SELECT count(*) AS total_records, strftime(min(ts), '%Y-%m-%d') AS "start", strftime(max(ts), '%Y-%m-%d') AS "end" FROM scored"""
DATA_SUMMARY = section("data_summary", "''", _SUMMARY, "total_records", "start end")
KPIS = section("kpi_evaluation", "kpi", KPI_SQL, "current_value target variance", "kpi status")


def counts(name: str, column: str) -> str:
    return section(name, "value", f"SELECT {column} AS value, count(*) AS n FROM scored WHERE {column} IS NOT NULL GROUP BY 1", "n", "value")


# position, type, title, description, impact and advice of the root-cause insights, from the facts f
INSIGHTS = f"""SELECT 0 AS position, 'critical' AS type, 'High Overall Delay Rate' AS title,
    'System-wide delay rate of ' || {_S.format('dr')} || '% exceeds acceptable thresholds' AS description,
    'Implement immediate corrective measures; Review operational procedures; Increase monitoring frequency' AS recommendations FROM f WHERE dr > 15
  UNION ALL SELECT 1, 'warning', 'Elevated Delay Rate', 'Delay rate of ' || {_S.format('dr')} || '% requires attention',
    'Investigate primary delay causes; Implement preventive measures' FROM f WHERE dr > 10 AND dr <= 15
  UNION ALL SELECT 2, 'actionable', 'Dominant Delay Cause: ' || tr, tr || ' accounts for ' || {_S.format('trs')} || '% of all delays',
    'Focus improvement efforts on ' || tr || '; Develop targeted mitigation strategies' FROM f WHERE trs > 40
  UNION ALL SELECT 3, 'warning', 'High-Risk Assets Identified', CAST(ra AS VARCHAR) || ' assets have delay rates > 20%',
    'Schedule maintenance for high-risk assets; Review asset utilization patterns' FROM f WHERE ra > 0
  UNION ALL SELECT 4, 'info', 'Peak Delay Period: ' || CAST(ph AS VARCHAR) || ':00',
    'Hour ' || CAST(ph AS VARCHAR) || ' accounts for ' || CAST(phc AS VARCHAR) || ' delays',
    'Investigate operational bottlenecks during peak hours; Consider resource reallocation' FROM f WHERE phs > 20"""

_KPI_FIGURES = f"""SELECT 'metrics.' || kpi AS field, current_value AS number FROM ({KPI_SQL})"""
_DESCRIPTIVE = f"""SELECT 'insights' AS section, 'descriptive' AS key, field, number, text FROM (
    SELECT unnest([{{'field': 'type', 'number': CAST(NULL AS DOUBLE), 'text': 'descriptive'}}, {{'field': 'title', 'number': NULL, 'text': 'Shipment Overview'}},
      {{'field': 'metrics.total_shipments', 'number': total_shipments, 'text': NULL}}, {{'field': 'metrics.delayed_shipments', 'number': delayed_shipments, 'text': NULL}},
      {{'field': 'metrics.delay_rate', 'number': delay_rate, 'text': NULL}}, {{'field': 'metrics.avg_delay_probability', 'number': avg_delay_probability, 'text': NULL}}],
      recursive := true) FROM ({OVERVIEW_SQL}))
  UNION ALL SELECT 'insights', 'kpi_evaluation', field, number, NULL FROM ({_KPI_FIGURES})
  UNION ALL SELECT 'insights', 'kpi_evaluation', 'type', NULL, 'kpi_evaluation' UNION ALL SELECT 'insights', 'kpi_evaluation', 'title', NULL, 'KPI Performance'"""


def saved(spark, root, name: str):
    """Save a report, then read it back by its manifest."""
    sections = report_tables.REPORTS[name](figures(spark, root))
    path = report_tables.save(sections, name, new_path(spark, "reports"), AS_OF)
    return report_tables.load(spark, path)[1]


@register(
    "report_descriptive_rows",
    "R-11 A-16 S-11",
    whole(
        DATA_SUMMARY, section("performance_metrics", "''", OVERVIEW_SQL, OVERVIEW_FIELDS), counts("asset_distribution", "asset_id"),
        counts("status_distribution", "shipment_status"), counts("delay_reasons", "logistics_delay_reason"), KPIS, _DESCRIPTIVE,
    ),
)
def report_descriptive_rows(spark, root):
    return saved(spark, root, "descriptive")


_ISSUES = f"""SELECT 0 AS position, 'High Delay Rate' AS issue, 'critical' AS severity, 'Delay rate of ' || {_S.format('dr')} || '% exceeds acceptable thresholds' AS description,
    'Operational efficiency and customer satisfaction are significantly impacted' AS impact FROM f WHERE dr > 15
  UNION ALL SELECT 1, 'Elevated Delay Rate', 'warning', 'Delay rate of ' || {_S.format('dr')} || '% requires attention',
    'Potential negative impact on customer satisfaction' FROM f WHERE dr > 10 AND dr <= 15
  UNION ALL SELECT 2, 'High Number of High-Risk Shipments', 'warning', CAST(hr AS VARCHAR) || ' shipments have >80% delay probability',
    'Increased operational risk and potential customer complaints' FROM f WHERE hr > 10
  UNION ALL SELECT position + 100, title, type, description, 'Unknown' FROM i WHERE type IN ('critical', 'warning')"""
_CHANCES = f"""SELECT 0 AS position, 'Delay Reduction' AS category, 'Reduce delay rate from ' || {_S.format('dr')} || '% to <10%' AS potential_improvement,
    'medium' AS implementation_effort, 'Improved customer satisfaction and reduced costs' AS expected_benefit,
    'Implement predictive delay alerts; Optimize routing based on traffic patterns; Improve asset maintenance schedules' AS recommendations FROM f WHERE dr > 10
  UNION ALL SELECT 1, 'Risk Mitigation', 'Reduce high-risk shipments from ' || CAST(hr AS VARCHAR) || ' to <5', 'low',
    'Proactive issue resolution and improved reliability',
    'Enhance monitoring of high-risk shipments; Implement early intervention protocols; Review asset allocation strategies' FROM f WHERE hr > 5
  UNION ALL SELECT 2, 'Asset Performance Optimization', 'Improve performance of ' || CAST(rta AS VARCHAR) || ' underperforming assets', 'high',
    'Better asset utilization and reduced delays',
    'Conduct maintenance reviews for underperforming assets; Provide additional training for asset operators; Consider asset replacement for consistently underperforming units'
    FROM f WHERE rta > 0"""
_LOAD = """SELECT asset_id, utilization_rate, delay_rate, CASE WHEN utilization_rate < m * 0.7e0 THEN 'under' WHEN utilization_rate > m * 1.3e0 THEN 'over' ELSE 'balanced' END AS load
  FROM (SELECT *, avg(utilization_rate) OVER () AS m FROM (SELECT asset_id, 100e0 * count(*) / (SELECT count(*) FROM scored) AS utilization_rate,
    100e0 * count(*) FILTER (logistics_delay) / count(*) AS delay_rate FROM scored GROUP BY 1))"""


def _ids(load: str) -> str:
    return f"""(SELECT string_agg(asset_id, ', ' ORDER BY asset_id) FILTER (r <= 20) || CASE WHEN count(*) > 20 THEN ' and ' || CAST(count(*) - 20 AS VARCHAR) || ' more' ELSE '' END
      FROM (SELECT asset_id, row_number() OVER (ORDER BY asset_id) AS r FROM ({_LOAD}) WHERE load = '{load}'))"""


_RESOURCES = f"""SELECT 0 AS position, 'Redistribute workload from overutilized assets (' || {_ids('over')} || ') to underutilized assets (' || {_ids('under')} || ')' AS recommendation
  WHERE {_ids('over')} IS NOT NULL AND {_ids('under')} IS NOT NULL
  UNION ALL SELECT 1, 'Review asset allocation strategy to balance utilization' UNION ALL SELECT 2, 'Consider adding capacity if consistently overutilized'"""
_ACTIONS = " ".join(f"WHEN '{name}' THEN '{'; '.join(actions)}'" for name, actions in KPI_ACTIONS.items())
_PLANS = f"""SELECT CASE kpi WHEN 'delay_rate' THEN 'Delay Rate' ELSE 'On Time Delivery Rate' END AS kpi, current_value AS current, target,
    CASE kpi WHEN 'delay_rate' THEN current_value - target ELSE target - current_value END AS gap, CASE kpi {_ACTIONS} END AS actions
  FROM ({KPI_SQL}) WHERE status IN ('warning', 'critical')"""
_ALL = f"""SELECT 0 AS source, position, category, CASE WHEN implementation_effort = 'low' THEN 'high' ELSE 'medium' END AS priority,
    potential_improvement AS description, recommendations AS actions FROM ({_CHANCES})
  UNION ALL SELECT 1, position, 'Resource Optimization', 'medium', recommendation, 'Implement resource redistribution plan; Monitor utilization metrics' FROM ({_RESOURCES})
  UNION ALL SELECT 2, CASE kpi WHEN 'Delay Rate' THEN 1 ELSE 0 END, 'KPI Improvement: ' || kpi, 'high', 'Close gap of ' || {_S.format('gap')} || ' to reach target', actions FROM ({_PLANS})"""


@register(
    "report_prescriptive_rows",
    "R-14 R-05 R-06 R-07 R-08 R-09",
    whole(
        section("issues", "position", _ISSUES, "position", "issue severity description impact"),
        section("optimization_opportunities", "category", _CHANCES, "position", "category potential_improvement implementation_effort expected_benefit recommendations"),
        section("asset_utilization", "asset_id", _LOAD, "utilization_rate delay_rate", "asset_id load"),
        section("resource_recommendations", "position", _RESOURCES, "position", "recommendation"),
        section("kpi_improvements", "kpi", _PLANS, "current target gap", "kpi actions"),
        section("recommendations", "CAST(source AS VARCHAR) || '.' || CAST(position AS VARCHAR)", _ALL, "source position", "category priority description actions"),
    ),
)
def report_prescriptive_rows(spark, root):
    return saved(spark, root, "prescriptive")


_STRENGTH = "printf('%.2f', {0})"
_TREND_INSIGHTS = f"""SELECT 0 AS position, 'warning' AS type, 'Increasing Delay Rate Trend' AS title,
    'Delay rates are trending upward with ' || {_STRENGTH.format('delay_strength')} || ' correlation' AS description, 'high' AS impact,
    'Investigate root causes and implement preventive measures' AS recommendations FROM t WHERE delay_direction = 'increasing' AND delay_significant
  UNION ALL SELECT 1, 'positive', 'Improving Delay Performance', 'Delay rates are trending downward with ' || {_STRENGTH.format('delay_strength')} || ' correlation', 'high',
    'Continue current optimization strategies' FROM t WHERE delay_direction = 'decreasing' AND delay_significant
  UNION ALL SELECT 2, 'info', 'Growing Shipment Volume', 'Shipment volume is increasing with ' || {_STRENGTH.format('volume_strength')} || ' correlation', 'medium',
    'Ensure capacity planning and resource allocation' FROM t WHERE volume_direction = 'increasing' AND volume_significant
  UNION ALL SELECT 3, 'info', 'High Delay Rate Variability', 'Delay rates show high variability (variance: ' || {_STRENGTH.format('delay_rate_variance')} || ')', 'medium',
    'Investigate cyclical patterns and stabilize operations' FROM t WHERE total_periods >= 7 AND delay_rate_variance > 25"""
_HOURLY = SUMMARY_SQL.replace(
    "WITH t AS (SELECT strftime(d, '%Y-%m-%d') AS period, d, n, rate FROM daily)",
    """WITH t AS (SELECT strftime(d, '%Y-%m-%d %H:00') AS period, d, n, rate FROM (SELECT date_trunc('hour', ts) AS d, count(*) AS n,
       100e0 * count(*) FILTER (logistics_delay) / count(*) AS rate FROM scored GROUP BY 1))""",
)


@register("trend_insights_hourly_full", "R-01", f"WITH t AS ({_HOURLY}) {_TREND_INSIGHTS}")
def trend_insights_hourly_full(spark, root):
    """Every trend insight of the hourly series, with all its texts."""
    found = rules.trend_insights(metrics.trend_summary(metrics.trend_series(rows(spark, root), "hourly")))
    return joined(found, "recommendations").select("position", "type", "title", "description", "impact", "recommendations")


_SCOPES = {
    "all": "true",
    "delayed": "logistics_delay",
    "one asset": "asset_id = 'Truck_3'",
    "morning": "hour(ts) IN (8, 9)",
}


def _factors_sql(scope: str, condition: str) -> str:
    facts = SHARES_SQL.replace("FROM scored", f"FROM (SELECT * FROM scored WHERE {condition})")
    one = "printf('%.1f%%', {0})"
    return f"""SELECT '{scope}' AS scope, factor, level, value, description FROM (SELECT unnest([
      CASE WHEN high_risk_rate > 20 THEN {{'factor': 'High Delay Probability Shipments', 'level': 'high', 'value': {one.format('high_risk_rate')},
        'description': CAST(high_risk_count AS VARCHAR) || ' shipments have >80% delay probability'}} END,
      CASE WHEN max_asset_share > 50 THEN {{'factor': 'Asset Concentration', 'level': 'medium', 'value': {one.format('max_asset_share')},
        'description': 'Single asset handles ' || {one.format('max_asset_share')} || ' of shipments'}} END,
      CASE WHEN max_hour_share > 30 THEN {{'factor': 'Temporal Concentration', 'level': 'low', 'value': {one.format('max_hour_share')},
        'description': 'Peak activity at hour ' || top_hour || ' (' || {one.format('max_hour_share')} || ' of shipments)'}} END],
      recursive := true) FROM ({facts})) WHERE factor IS NOT NULL"""


@register("risk_factors_by_scope", "R-03", " UNION ALL ".join(_factors_sql(s, c) for s, c in _SCOPES.items()))
def risk_factors_by_scope(spark, root):
    """The risk factors of all rows and of parts of them that set off each rule."""
    every = rows(spark, root)
    parts = {
        "all": every, "delayed": every.filter("logistics_delay"), "one asset": every.filter("asset_id = 'Truck_3'"),
        "morning": every.filter(F.hour("ts").isin(8, 9)),
    }
    found = [rules.risk_factors(metrics.risk_shares(df)).drop("position").withColumn("scope", F.lit(scope)) for scope, df in parts.items()]
    return reduce(DataFrame.unionByName, found)


_FIRST_INSIGHTS = f"""WITH t AS ({SUMMARY_SQL}) SELECT * FROM (SELECT *, row_number() OVER (ORDER BY tier, position) AS place FROM (
    SELECT 0 AS tier, 0 AS position, 'descriptive' AS type, 'Shipment Overview' AS title, NULL AS description, NULL AS impact, NULL AS recommendations
    UNION ALL SELECT 0, 1, 'kpi_evaluation', 'KPI Performance', NULL, NULL, NULL
    UNION ALL SELECT 1, position, type, title, description, NULL, recommendations FROM i
    UNION ALL SELECT 2, * FROM ({_TREND_INSIGHTS}))) WHERE place <= 5"""
_FIRST_ADVICE = f"""WITH m AS ({MEANS_SQL}), c AS (SELECT max(n) AS peak FROM daily), l AS (SELECT {_LEVEL} AS level FROM ({SHARES_SQL}))
  SELECT *, row_number() OVER (ORDER BY position) AS place FROM (
    SELECT 0 AS position, 'high' AS priority, 'capacity_planning' AS category, 'Capacity Expansion Required' AS title,
      'Predicted volume (' || CAST(round_even(expected_avg_volume, 1) AS VARCHAR) || ') approaching capacity limit' AS description,
      'Scale up resources; Optimize asset utilization; Consider additional capacity' AS actions FROM m, c WHERE expected_avg_volume > 0.9e0 * peak
    UNION ALL SELECT 1, 'high', 'risk_mitigation', 'High Risk Level Detected', 'Multiple high-risk factors identified',
      'Implement risk mitigation strategies; Increase monitoring frequency; Review operational procedures' FROM l WHERE level = 'high'
    UNION ALL SELECT 2, 'medium', 'operational_improvement', 'Delay Rate Optimization Needed',
      'Predicted delay rate of ' || {_S.format('expected_avg_delay_rate')} || '% exceeds targets',
      'Investigate root causes; Implement preventive measures; Enhance monitoring' FROM m WHERE expected_avg_delay_rate > 10)"""
_TREND_NUMBERS = "slope strength r_squared p_value"
_TREND_FIELDS = " ".join(f"{p}_{x}" for p in ("delay", "volume") for x in _TREND_NUMBERS.split())


@register(
    "report_executive_rows",
    "R-16 T-04 X-06",
    "SELECT section, key, field, round_even(number, 2) AS number, text FROM ("
    + whole(
        DATA_SUMMARY, section("overview", "''", OVERVIEW_SQL, OVERVIEW_FIELDS), KPIS,
        section(
            "trends", "''", SUMMARY_SQL, f"total_periods avg_shipments_per_period avg_delay_rate delay_rate_variance {_TREND_FIELDS}",
            "peak_volume_period highest_delay_period delay_direction delay_significant volume_direction volume_significant",
        ),
        section("insights", "place", _FIRST_INSIGHTS, "place", "type title description impact recommendations"),
        section("recommendations", "place", _FIRST_ADVICE, "place", "priority category title description actions"),
    )
    + ")",
)
def report_executive_rows(spark, root):
    """The whole executive summary, figures rounded as they are shown."""
    return report_tables.rounded_rows(saved(spark, root, "executive"))


_PERFORMANCE = """SELECT asset_id, count(*) AS shipments, count(*) FILTER (logistics_delay) AS delayed, 100e0 * count(*) FILTER (logistics_delay) / count(*) AS delay_rate,
    avg(delay_probability) AS avg_probability,
    (100 - 100e0 * count(*) FILTER (logistics_delay) / count(*)) * (1 - avg(delay_probability)) AS performance_score FROM scored GROUP BY 1"""
_PERFORMANCE_FIELDS = "shipments delayed delay_rate avg_probability performance_score"
_REASONS = """SELECT logistics_delay_reason AS reason, count(*) AS n, 100e0 * count(*) / (SELECT count(*) FROM scored WHERE logistics_delay) AS share
  FROM scored WHERE logistics_delay AND logistics_delay_reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5"""


@register(
    "report_operational_rows",
    "R-17",
    whole(
        DATA_SUMMARY, section("real_time_metrics", "''", REALTIME_SQL, "active_shipments total_assets avg_shipments_per_asset utilization_rate"),
        counts("status_distribution", "shipment_status"),
        section(
            "capacity_analysis", "''", CAPACITY_SQL,
            f"max_daily_volume avg_daily_volume utilization_rate {' '.join(f'volume_{x}' for x in _TREND_NUMBERS.split())}", "capacity_status volume_direction volume_significant",
        ),
        section(
            "delay_summary", "''",
            """SELECT total_delayed, dr AS delay_rate, (SELECT avg(delay_probability) FROM scored WHERE logistics_delay) AS avg_delay_probability,
               (SELECT avg(waiting_time) FROM scored WHERE logistics_delay) AS avg_waiting_time FROM f""",
            "total_delayed delay_rate avg_delay_probability avg_waiting_time",
        ),
        section("top_reasons", "reason", _REASONS, "n share", "reason"),
        section("asset_performance", "asset_id", _PERFORMANCE, _PERFORMANCE_FIELDS, "asset_id"),
        section("top_performers", "asset_id", f"SELECT * FROM ({_PERFORMANCE}) ORDER BY performance_score DESC, asset_id LIMIT 3", _PERFORMANCE_FIELDS, "asset_id"),
        section("underperformers", "asset_id", f"SELECT * FROM ({_PERFORMANCE}) WHERE delay_rate > 15", _PERFORMANCE_FIELDS, "asset_id"),
    ),
)
def report_operational_rows(spark, root):
    return saved(spark, root, "operational")
