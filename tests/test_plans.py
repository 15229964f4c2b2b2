"""Physical plans: no cross joins, native expressions stay in the JVM, filters reach the scan."""

from __future__ import annotations

import pytest

from freightlens import catalog
from freightlens.operators import filters
from freightlens.sources import shapes

QUICK = [q for q in sorted(catalog.ORACLES) if not q.startswith(("stream_", "csv_", "bulk_", "append_", "report_"))]
#: Queries with a Python step in their plan: the ordered walk of the cool-down.
PYTHON_STEP = {"cooldown_per_shipment", "cooldown_per_asset_busy"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUICK)
def test_no_cross_join_and_no_python(spark, root, name):
    text = plan(catalog.QUERIES[name](spark, root))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_STEP:
        assert not any(x in text for x in ("Python", "InPandas", "InArrow", "Pandas"))


def test_filters_and_columns_reach_the_scan(spark, root):
    text = plan(filters.voyages_where(shapes.voyages(spark, root), customer_id=7).select("id", "created_at"))
    assert "EqualTo(o_custkey,7)" in text
    assert "o_totalprice" not in text.split("ReadSchema")[1]


def test_pages_use_top_k(spark, root):
    page = filters.page(shapes.readings(spark, root), "ts", "id", 10)
    assert "TakeOrderedAndProject" in plan(page)


def test_rank_filters_run_before_the_shuffle(spark, root):
    rows = filters.page_per_key(shapes.communications(spark, root), "customer_id", "sent_at", "id", 5)
    assert "WindowGroupLimit" in plan(rows)
