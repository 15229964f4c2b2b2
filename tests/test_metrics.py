"""Edge cases of series, trends, forecasts, KPIs and rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from freightlens.operators import filters, metrics, rules
from freightlens.plans import reports


def series(spark, rates):
    rows = [(f"2024-01-{i + 1:02d}", 10 + i, float(r)) for i, r in enumerate(rates)]
    return spark.createDataFrame(rows, "day string, shipments bigint, delay_rate double")


def trend(spark, rates):
    return metrics.linear_trend(series(spark, rates), "day", "delay_rate").first()


def test_trend_of_one_period(spark):
    t = trend(spark, [5])
    assert (t["direction"], t["slope"], t["strength"], t["p_value"], t["significant"]) == ("insufficient_data", 0.0, 0.0, None, False)


def test_trend_of_two_periods(spark):
    t = trend(spark, [5, 7])
    assert t["direction"] == "increasing" and t["slope"] == pytest.approx(2) and t["p_value"] == pytest.approx(0, abs=1e-6)


def test_flat_trend(spark):
    t = trend(spark, [5, 5, 5, 5])
    assert (t["direction"], t["slope"], t["strength"], t["p_value"], t["significant"]) == ("stable", 0.0, 0.0, 1.0, False)


def test_forecast_needs_three_days(spark):
    assert metrics.forecast(series(spark, [1, 2])).count() == 0
    out = metrics.forecast(series(spark, [10, 10, 40]), 2).orderBy("i").collect()
    # moving means 10, 10, 20: slope (20 - 10) / 3
    assert [r["predicted_delay_rate"] for r in out] == pytest.approx([20 + 10 / 3, 20 + 20 / 3])
    assert [r["confidence"] for r in out] == pytest.approx([0.7, 0.6])
    assert out[0]["day"] == "2024-01-04"


def test_capacity_needs_seven_days(spark):
    assert metrics.capacity(series(spark, [1] * 6)).count() == 0
    row = metrics.capacity(series(spark, [1] * 7)).first()
    assert row["max_daily_volume"] == 16 and row["utilization_rate"] == pytest.approx(13 / 16 * 100) and row["capacity_status"] == "medium"


@pytest.mark.parametrize("late, statuses", [(5, "excellent"), (10, "good"), (15, "warning"), (16, "critical")])
def test_kpi_status_at_the_bounds(spark, late, statuses):
    row = spark.createDataFrame([(100, float(late))], "n bigint, dr double")
    assert {r["status"] for r in metrics.kpi_rows(row).collect()} == {statuses}


def test_kpis_of_nothing(readings):
    assert metrics.evaluate_kpis(readings([(0, 0, True, {})]).limit(0)).count() == 0


def test_ties_take_the_first_label(spark):
    df = spark.createDataFrame([("b", 3), ("a", 3), ("c", 1)], "k string, n bigint")
    assert metrics.first_max(df, "k", "n", "best").first()["best"] == "a"


def test_null_reason_stays_in_the_denominator(readings):
    df = readings([(0, 0, True, {"logistics_delay_reason": None}), (0, 1, True, {}), (0, 2, False, {})])
    assert [tuple(r) for r in metrics.reason_shares(df).select("reason", "n", "share").collect()] == [("Weather", 1, 50.0)]


def test_date_range_of_nothing(readings):
    empty = readings([(0, 0, True, {})]).limit(0)
    assert tuple(metrics.date_range(empty).first()) == ("N/A", "N/A")
    assert tuple(metrics.date_range(empty.drop("ts")).first()) == ("N/A", "N/A")


def test_bare_end_date_covers_the_day(readings):
    df = readings([(0, 0, False, {}), (1, 23, False, {}), (2, 0, False, {})])
    assert filters.date_window(df, "2024-01-01", "2024-01-02").count() == 2
    assert filters.date_window(df, "2024-01-01", "2024-01-02 00:00:00").count() == 1


def test_hotspots_need_more_than_ten_points(readings):
    spots = metrics.geographic_hotspots(readings([(0, i, True, {}) for i in range(10)]))
    assert spots.count() == 0
    far = readings([(0, i, True, {"latitude": float(10 * (i % 3)), "longitude": float(i % 3)}) for i in range(18)])
    found = metrics.geographic_hotspots(far).collect()
    assert sum(r["delay_count"] for r in found) == 18 and [r["delay_count"] for r in found] == sorted((r["delay_count"] for r in found), reverse=True)


def test_root_cause_rules_without_delays(readings):
    fig = reports.Figures(readings([(0, i, False, {}) for i in range(5)]))
    assert rules.root_cause_insights(fig.cause_facts).count() == 0
    report = reports.diagnostic(fig).first()
    assert report["summary"]["total_delayed"] == 0 and report["delay_reasons"] == []


def test_root_cause_rules_all_delayed(readings):
    fig = reports.Figures(readings([(0, i % 2, True, {}) for i in range(12)]))
    titles = [r["title"] for r in rules.root_cause_insights(fig.cause_facts).orderBy("position").collect()]
    assert titles == ["High Overall Delay Rate", "Dominant Delay Cause: Weather", "High-Risk Assets Identified", "Peak Delay Period: 0:00"]


@pytest.mark.parametrize("late, issue", [(10, None), (11, "Elevated Delay Rate"), (15, "Elevated Delay Rate"), (16, "High Delay Rate")])
def test_issue_bounds(spark, late, issue):
    facts = spark.createDataFrame([(float(late), 0)], "delay_rate double, high_risk_shipments bigint")
    none = spark.createDataFrame([], "position int, type string, title string, description string, impact string")
    assert [r["issue"] for r in rules.issues(facts, none).collect()] == ([issue] if issue else [])


def test_reports_match_direct_metrics(spark, root):
    from freightlens.registry.metric_queries import rows

    df = rows(spark, root)
    fig = reports.Figures(df)
    direct, cut = metrics.overview(df).first().asDict(), fig.overview.first().asDict()
    assert cut.keys() == direct.keys() and all(cut[k] == pytest.approx(direct[k]) for k in direct)
    assert fig.reasons.orderBy("reason").collect() == metrics.reason_shares(df).select("reason", "n", "share").orderBy("reason").collect()


def test_rounded_report_keeps_shape(spark, root):
    from freightlens.registry.metric_queries import rows

    report = reports.scorecard(reports.Figures(rows(spark, root)))
    out = reports.rounded(report)
    assert out.schema.names == report.schema.names
    value = out.first()["kpi_evaluation"][0]["current_value"]
    assert value == round(value, 2)


def test_largest_first_page(spark):
    df = spark.range(10).select("id", (F.col("id") % 3).alias("v"))
    assert [r["id"] for r in filters.page(df, "v", "id", 3, 1).collect()] == [5, 8, 1]
