"""Reports as tables: one row per (section, key, field), and a manifest that commits them.

A nested one-row report can't hold a list that grows with the assets, so every section
here is a frame of rows under a key.  ``save`` writes all sections in one job and the
manifest last: a folder without a manifest is not a report, and ``load`` refuses it.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators import metrics, rules
from ..session import new_path
from ..sources.files import path_exists
from .profile import cut
from .reports import Figures, all_insights, all_recommendations, live_metrics

SCHEMA = "section string, key string, field string, number double, text string"
#: Section name to its frame and the expression of its key.
Sections = dict[str, tuple[DataFrame, Column]]


def _values(name: str, kind: T.DataType) -> Column:
    """A column's values as (field, number, text); a map gives one per entry, a list of texts one text."""
    entry = lambda field, number, text: F.struct(field.alias("field"), number.alias("number"), text.alias("text"))
    no_number, no_text, field = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(name)
    c = F.col(name)
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(c), lambda e: entry(F.concat(field, F.lit("."), e["key"]), e["value"].cast("double"), no_text))
    if isinstance(kind, T.ArrayType):
        return F.array(entry(field, no_number, F.array_join(c, "; ")))
    if isinstance(kind, T.NumericType):
        return F.array(entry(field, c.cast("double"), no_text))
    return F.array(entry(field, no_number, c.cast("string")))


def section_rows(name: str, df: DataFrame, key: Column) -> DataFrame:
    """A section in the common form; fields without a value have no row."""
    each = F.flatten(F.array(*[F.coalesce(_values(f.name, f.dataType), F.array().cast("array<struct<field:string,number:double,text:string>>")) for f in df.schema.fields]))
    rows = df.select(F.lit(name).alias("section"), key.cast("string").alias("key"), F.inline(each))
    return rows.where("number IS NOT NULL OR text IS NOT NULL")


def report_rows(sections: Sections) -> DataFrame:
    return reduce(DataFrame.unionByName, [section_rows(name, df, key) for name, (df, key) in sections.items()])


def rounded_rows(rows: DataFrame) -> DataFrame:
    """Figures to two decimals, half to even."""
    return rows.withColumn("number", F.bround("number", 2))


# --- the reports -----------------------------------------------------------------------
def _counts(fig: Figures, kind: str, measure: str = "shipments") -> tuple[DataFrame, Column]:
    per = cut(fig.base, kind, "key").where(F.col("key").isNotNull() & (F.col(measure) > 0))
    return per.select(F.col("key").alias("value"), F.col(measure).alias("n")), F.col("value")


def _once(df: DataFrame) -> tuple[DataFrame, Column]:
    return df, F.lit("")


def descriptive(fig: Figures) -> Sections:
    return {
        "data_summary": _once(fig.data_summary),
        "performance_metrics": _once(fig.overview),
        "asset_distribution": _counts(fig, "asset"),
        "status_distribution": _counts(fig, "status"),
        "delay_reasons": _counts(fig, "reason"),
        "kpi_evaluation": (fig.kpis, F.col("kpi")),
        "insights": (rules.descriptive_insights(fig.overview, fig.kpis), F.col("type")),
    }


def prescriptive(fig: Figures) -> Sections:
    facts = fig.cause_facts
    chances, resources, plans = rules.opportunities(facts), rules.resource_recommendations(fig.utilization), rules.kpi_plans(fig.kpis)
    return {
        "issues": (rules.issues(facts, rules.root_cause_insights(facts)), F.col("position")),
        "optimization_opportunities": (chances, F.col("category")),
        "asset_utilization": (fig.utilization, F.col("asset_id")),
        "resource_recommendations": (resources, F.col("position")),
        "kpi_improvements": (plans, F.col("kpi")),
        "recommendations": (
            rules.prescriptive_recommendations(chances, resources, plans),
            F.concat_ws(".", F.col("source").cast("string"), F.col("position").cast("string")),
        ),
    }


def _first(df: DataFrame, k: int, *order: str) -> tuple[DataFrame, Column]:
    """The first rows of a short list, their place as key."""
    place = F.row_number().over(Window.orderBy(*order))
    ranked = df.withColumn("place", place).where(F.col("place") <= k)
    return ranked.drop(*order), F.col("place")


def executive(fig: Figures) -> Sections:
    return {
        "data_summary": _once(fig.data_summary),
        "overview": _once(fig.overview),
        "kpi_evaluation": (fig.kpis, F.col("kpi")),
        "trends": _once(fig.trends),
        "insights": _first(all_insights(fig), 5, "tier", "position"),
        "recommendations": _first(all_recommendations(fig), 3, "position"),
    }


def operational(fig: Figures) -> Sections:
    assets = fig.assets
    by_score = [F.col("performance_score").desc(), F.col("asset_id")]
    return {
        "data_summary": _once(fig.data_summary),
        "real_time_metrics": _once(live_metrics(fig)),
        "status_distribution": _counts(fig, "status"),
        "capacity_analysis": _once(metrics.capacity(fig.daily)),
        "delay_summary": _once(fig.cause_facts.select("total_delayed", "delay_rate", "avg_delay_probability", "avg_waiting_time")),
        "top_reasons": (metrics.top_k(fig.reasons, 5, F.col("n").desc(), F.col("reason")), F.col("reason")),
        "asset_performance": (assets, F.col("asset_id")),
        "top_performers": (metrics.top_k(assets, 3, *by_score), F.col("asset_id")),
        "underperformers": (assets.where(F.col("delay_rate") > 15), F.col("asset_id")),
    }


REPORTS = {"descriptive": descriptive, "prescriptive": prescriptive, "executive": executive, "operational": operational}


# --- the sink --------------------------------------------------------------------------
def save(sections: Sections, report: str, root: str, as_of: str) -> str:
    """Write a report's rows, a folder per section, then its manifest; returns the report's path.

    Every run has a folder of its own, so a run that fails half-way leaves nothing that
    ``load`` takes for a report, and repeating it is safe.
    """
    spark = next(iter(sections.values()))[0].sparkSession
    path = new_path(spark, report) if not root else f"{root}/{new_path(spark, report).rsplit('/', 1)[1]}"
    report_rows(sections).write.partitionBy("section").parquet(f"{path}/rows")
    counts = {r["section"]: r["n"] for r in read_rows(spark, path).groupBy("section").agg(F.count("*").alias("n")).collect()}
    manifest = {"report": report, "generated_at": as_of, "rows": {name: counts.get(name, 0) for name in sections}}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return path


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/rows")


def load(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A saved report's manifest and rows; a folder that was not finished is refused."""
    if not path_exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError(f"no finished report in {path}")
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    return manifest, read_rows(spark, path)
