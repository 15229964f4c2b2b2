"""Reports as tables: committed by their manifest, and nothing in one row grows with the assets."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from freightlens.operators import rules
from freightlens.plans import report_tables, reports
from freightlens.session import new_path


@pytest.fixture
def many(readings):
    """300 assets, half of them busy."""
    rows = []
    for a in range(300):
        for i in range(1 if a % 2 else 9):
            rows.append((i % 8, i, a % 4 == 0, {"asset_id": f"Truck_{a:03d}"}))
    return reports.Figures(readings(rows))


def test_a_saved_report_is_loaded_by_its_manifest(spark, many):
    path = report_tables.save(report_tables.operational(many), "operational", new_path(spark, "reports"), "2024-01-31T00:00:00")
    manifest, rows = report_tables.load(spark, path)
    assert manifest["report"] == "operational" and manifest["generated_at"] == "2024-01-31T00:00:00"
    counted = {r["section"]: r["count"] for r in rows.groupBy("section").count().collect()}
    assert {k: v for k, v in manifest["rows"].items() if v} == counted
    assert rows.where("section = 'asset_performance'").select("key").distinct().count() == 300


def test_an_unfinished_report_is_refused(spark, many):
    path = new_path(spark, "half")
    report_tables.report_rows(report_tables.descriptive(many)).write.partitionBy("section").parquet(f"{path}/rows")
    with pytest.raises(ValueError):
        report_tables.load(spark, path)


@pytest.mark.parametrize("name", ["descriptive", "prescriptive", "operational", "executive"])
def test_nested_reports_do_not_grow_with_assets(many, name):
    row = getattr(reports, name)(many).first().asDict(recursive=True)

    def longest(x):
        if isinstance(x, dict):
            return max([len(x), *map(longest, x.values())])
        if isinstance(x, list):
            return max([len(x), *map(longest, x)], default=0)
        return len(x) // 40 if isinstance(x, str) else 0

    assert longest(row) < 40


def test_resource_advice_names_the_first_assets(many):
    line = rules.resource_recommendations(many.utilization).first()["recommendation"]
    assert "Truck_000, Truck_002" in line and "and 130 more" in line and line.count("Truck_") == 40
    assert many.utilization.where(F.col("load") == "over").count() == 150


def test_export_is_ordered(spark):
    rows = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "position int, title string")
    assert [x["title"] for x in reports.export_rows(rows, "t").first()["insights"]] == ["a", "b", "c"]


def test_reports_list_every_asset_when_asked(many):
    told = reports.descriptive(many, per_asset=True).first()["asset_distribution"]
    assert len(told) == 300 and told["Truck_000"] == 9 and told["Truck_001"] == 1
    used = reports.prescriptive(many, per_asset=True).first()["asset_utilization"]
    assert [r["asset_id"] for r in used] == [f"Truck_{a:03d}" for a in range(300)]


def test_queries_name_and_count_all_assets(spark, root):
    from freightlens import catalog
    from freightlens.sources import shapes

    ids = sorted(r[0] for r in shapes.readings(spark, root).select("asset_id").distinct().collect())
    assert catalog.QUERIES["dataset_summary"](spark, root).first()["asset_list"] == ",".join(ids)
    for name in ("report_descriptive", "report_prescriptive"):
        assert catalog.QUERIES[name](spark, root).first()["assets"] == len(ids)
