"""Alert rules as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..fixed_values import ALERT_RULES

RULE_SCHEMA = "rule string, trigger string, priority string, cooldown_minutes int, enabled boolean, conditions map<string,string>"


def rule_table(spark: SparkSession, extra: list[tuple] | None = None, disabled: tuple[str, ...] = ()) -> DataFrame:
    """The default rules plus custom ones; a custom rule of the same name replaces the default."""
    rules = {r[0]: r for r in ALERT_RULES}
    rules.update({r[0]: r for r in extra or []})
    rows = [(*r[:4], r[4] and r[0] not in disabled, r[5]) for r in rules.values()]
    return spark.createDataFrame(rows, RULE_SCHEMA)
