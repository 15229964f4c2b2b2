"""Boundary values of casts, bands, scores and texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from freightlens.functions import risk, scalars, stats
from freightlens.operators import cleaning
from freightlens.operators.features import weight_category


def values(spark, schema, rows, *exprs):
    out = spark.createDataFrame(rows, schema).select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).collect()
    return [r[0] if len(exprs) == 1 else tuple(r) for r in out]


def test_safe_casts(spark):
    rows = [("123.0",), ("-1.9",), ("",), ("abc",), (None,), (" 7 ",)]
    assert values(spark, "x string", rows, scalars.safe_int("x")) == [123, -1, None, None, None, 7]


def test_flags(spark):
    rows = [("0",), ("1",), ("True",), ("true",), (None,)]
    assert values(spark, "x string", rows, scalars.parse_bool("x")) == [False, True, True, False, False]


def test_timestamps(spark):
    rows = [("2024-01-02 03:04:05",), ("2024-01-02T03:04:05Z",), ("nope",), (None,)]
    got = values(spark, "x string", rows, F.date_format(scalars.parse_timestamp("x", F.lit("2020-01-01")), "yyyy-MM-dd HH:mm"))
    assert got == ["2024-01-02 03:04", "2024-01-02 03:04", "2020-01-01 00:00", "2020-01-01 00:00"]


def test_enum_defaults(spark):
    rows = [("Delivered", "Heavy", "Weather"), ("Lost", "Fog", "Strike"), (None, None, None), ("", "", "")]
    got = values(spark, "s string, t string, r string", rows, cleaning.map_status("s"), cleaning.map_traffic("t"), cleaning.map_reason("r"))
    assert got == [("Delivered", "Heavy", "Weather"), ("In Transit", "Clear", "Other"), ("In Transit", "Clear", "None"), ("In Transit", "Clear", "None")]


@pytest.mark.parametrize(
    "band, cases",
    [
        (risk.band_inclusive, {0.8: "HIGH", 0.7999: "MEDIUM", 0.5: "MEDIUM", 0.2: "LOW", 0.19: "MINIMAL"}),
        (risk.band_exclusive, {0.81: "High", 0.8: "Medium", 0.5: "Low", 0.2: "Very Low"}),
        (risk.band_hours, {24.0: "high", 23.9: "medium", 8.0: "medium", 7.9: "low", None: None}),
        (risk.band_rule_hours, {5.9: "low", 6.0: "medium", 18.0: "high"}),
        (risk.congestion_band, {0.8: "severe", 0.6: "high", 0.4: "moderate", 0.2: "low", 0.1: "minimal"}),
    ],
)
def test_bands(spark, band, cases):
    assert values(spark, "x double", [(k,) for k in cases], band("x")) == list(cases.values())


def test_joint_band(spark):
    rows = [(24.0, 0.7), (24.0, 0.69), (8.0, 0.5), (2.0, 0.3), (1.9, 1.0)]
    assert values(spark, "h double, p double", rows, risk.band_hours_probability("h", "p")) == ["high", "medium", "medium", "low", "minimal"]


def test_heuristics_count_a_missing_reason(spark):
    rows = [("Heavy", 31, "None"), ("Clear", 30, None), ("Detour", 31, "Weather")]
    s = "t string, w int, r string"
    assert values(spark, s, rows, risk.delay_probability("t", "w", "r")) == pytest.approx([0.8, 0.5, 0.7])
    assert values(spark, s, rows, risk.averaged_delay_probability("t", "w", "r")) == pytest.approx([0.7 / 3, 0.5 / 3, 1.1 / 3])


def test_accuracy(spark):
    rows = [(5.0, 0.0), (5.0, None), (5.0, 10.0), (100.0, 1.0), (0.5, 0.5)]
    assert values(spark, "p double, a double", rows, risk.accuracy_of("p", "a")) == [None, None, 0.5, pytest.approx(0.01), 1.0]


def test_phones_and_texts(spark):
    rows = [("+1 (555) 000-1234", "x" * 161), ("555", "y" * 160), (None, None), ("12345a7890", "z")]
    got = values(spark, "p string, t string", rows, scalars.valid_phone("p"), scalars.sms_text("t"))
    assert [g[0] for g in got] == [True, False, False, False]
    assert got[0][1] == "x" * 157 + "..." and got[1][1] == "y" * 160


def test_weight_bands_are_closed_on_the_right(spark):
    rows = [(0.0,), (1000.0,), (1000.1,), (50000.0,), (50000.1,), (None,)]
    assert values(spark, "w double", rows, weight_category(F.col("w"))) == [None, "very_light", "light", "heavy", "very_heavy", None]


def test_ports(spark):
    got = values(spark, "p string", [("Port of Shanghai",), ("NEW YORK",), ("Oslo",)], risk.port_coordinates("p")["lat"])
    assert got == [31.2304, 40.7128, None]


def test_iso_week_labels(spark):
    rows = [("2024-12-30",), ("2023-01-01",)]
    assert values(spark, "d string", rows, scalars.period_label(F.col("d").cast("timestamp_ntz"), "weekly")) == ["2025-W01", "2022-W52"]


@pytest.mark.parametrize("df, t", [(1, 12.7062047), (10, 2.2281389), (28, 2.0484071), (2, 4.3026527), (3, 3.1824463)])
def test_p_value_at_textbook_quantiles(spark, df, t):
    r = t / (df + t * t) ** 0.5
    got = values(spark, "r double, n bigint", [(r, df + 2), (-r, df + 2)], stats.slope_p_value("r", "n"))
    assert got == pytest.approx([0.05, 0.05], abs=1e-7)


def test_p_value_of_two_points(spark):
    assert values(spark, "r double, n bigint", [(1.0, 2), (0.0, 2)], stats.slope_p_value("r", "n")) == [0.0, 1.0]


@pytest.mark.parametrize(
    "master, warehouse, shared",
    [("local[8]", "file:/w", True), ("local", "/w", True), ("yarn", "file:/w", False), ("spark://h:7077", "/w", False), ("local-cluster[3,2,1024]", "file:///w", False), ("yarn", "hdfs://n/w", True)],
)
def test_a_local_warehouse_is_no_shared_folder_on_a_cluster(master, warehouse, shared):
    from freightlens.session import shared_warehouse

    assert shared_warehouse(master, warehouse) == shared
