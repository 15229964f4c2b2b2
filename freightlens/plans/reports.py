"""Nested one-row reports, all derived from one profile of the readings.

They hold nothing that grows with the assets unless asked to (``per_asset``);
``report_tables`` has those sections as rows.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import day_label, rate
from ..operators import metrics, rules
from ..operators.metrics import one_row
from ..session import stored
from .profile import cut, profile

TIERS = ("descriptive", "diagnostic", "predictive")


class Figures:
    """Named cuts of a profile; every property is a small frame.

    The one-row fact frames are stored once, because several rule sets read them.

    ``hotspots`` comes from :func:`metrics.geographic_hotspots` and is optional:
    it needs its own model fit over the positions.
    """

    def __init__(self, df: DataFrame, hotspots: DataFrame | None = None, forecast_days: int = 7):
        self.base = stored(profile(df), "profile")
        self.hotspots = hotspots
        self.forecast_days = forecast_days

    @property
    def overview(self) -> DataFrame:
        whole = cut(self.base, "all", "scope")
        return whole.select(
            F.col("shipments").alias("total_shipments"),
            (F.col("shipments") - F.col("delayed")).alias("on_time_shipments"),
            F.col("delayed").alias("delayed_shipments"),
            "delay_rate",
            (100 - F.col("delay_rate")).alias("on_time_rate"),
            F.col("avg_probability").alias("avg_delay_probability"),
            F.col("high_risk").alias("high_risk_shipments"),
            F.col("avg_wait").alias("avg_waiting_time"),
        )

    @property
    def data_summary(self) -> DataFrame:
        whole = cut(self.base, "all", "scope")
        return whole.agg(
            F.coalesce(F.max("shipments"), F.lit(0)).alias("total_records"),
            F.coalesce(day_label(F.min("first_ts")), F.lit("N/A")).alias("start"),
            F.coalesce(day_label(F.max("last_ts")), F.lit("N/A")).alias("end"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        """One row per day in a single partition, so the series windows need no further shuffle."""
        days = cut(self.base, "day", "day").select("day", "shipments", "delayed", "avg_probability", "avg_wait", "delay_rate")
        return stored(days.coalesce(1), "daily")

    @property
    def kpis(self) -> DataFrame:
        """KPI rows straight from the overall counts."""
        whole = cut(self.base, "all", "scope")
        return metrics.kpi_rows(whole.select(F.col("shipments").alias("n"), F.col("delay_rate").alias("dr")))

    @cached_property
    def trends(self) -> DataFrame:
        return stored(metrics.trend_summary(self.daily.withColumnRenamed("day", "period")), "trends")

    @property
    def reasons(self) -> DataFrame:
        per = cut(self.base, "reason", "reason").filter(F.col("delayed") > 0)
        total = per.agg(F.sum("delayed")).scalar()
        return per.filter(F.col("reason").isNotNull()).select(
            "reason", F.col("delayed").alias("n"), (F.col("delayed") * 100.0 / total).alias("share")
        )

    @property
    def assets(self) -> DataFrame:
        per = cut(self.base, "asset", "asset_id")
        score = (100 - F.col("delay_rate")) * (1 - F.col("avg_probability"))
        return per.select(
            "asset_id", "shipments", "delayed", "delay_rate", "avg_probability", score.alias("performance_score")
        )

    @property
    def top_assets(self) -> DataFrame:
        late = self.assets.filter(F.col("asset_id").isNotNull() & (F.col("delayed") > 0))
        return metrics.top_k(late, 10, F.col("delay_rate").desc(), F.col("delayed").desc(), F.col("asset_id")).select(
            "asset_id", F.col("delayed").alias("total_delays"), "delay_rate"
        )

    @property
    def utilization(self) -> DataFrame:
        per = self.assets
        sums = per.agg(F.sum("shipments").alias("total"), F.count("*").alias("assets"))
        mean = sums.select(F.lit(100.0) / F.col("assets")).scalar()
        used = per.withColumn("utilization_rate", F.col("shipments") * 100.0 / sums.select("total").scalar())
        load = F.when(F.col("utilization_rate") < mean * 0.7, "under").when(F.col("utilization_rate") > mean * 1.3, "over")
        return used.select("asset_id", "utilization_rate", "delay_rate", load.otherwise("balanced").alias("load"))

    @cached_property
    def cause_facts(self) -> DataFrame:
        """What the root-cause rules read."""
        whole = cut(self.base, "all", "scope")
        hours = cut(self.base, "hour", "hour").filter(F.col("delayed") > 0)
        days = cut(self.base, "weekday", "weekday").filter(F.col("delayed") > 0)
        reasons, late = self.reasons, self.assets.filter(F.col("asset_id").isNotNull() & (F.col("delayed") > 0))
        peak = F.struct(-F.col("delayed"), F.col("hour"))
        parts = [
            whole.select(
                F.col("delayed").alias("total_delayed"), "delay_rate", F.col("high_risk").alias("high_risk_shipments"),
                F.col("avg_delayed_probability").alias("avg_delay_probability"), F.col("avg_delayed_wait").alias("avg_waiting_time"),
            ),
            reasons.agg(
                F.min_by("reason", F.struct(-F.col("n"), F.col("reason"))).alias("top_reason"), F.max("share").alias("top_reason_share")
            ),
            late.agg(F.count_if(F.col("delay_rate") > 20).alias("risky_assets")),
            self.top_assets.agg(F.count_if(F.col("delay_rate") > 20).alias("risky_top_assets")),
            hours.agg(
                F.min_by("hour", peak).cast("int").alias("peak_hour"),
                F.max("delayed").alias("peak_hour_count"),
                rate(F.max("delayed"), F.sum("delayed")).alias("peak_hour_share"),
            ),
            days.agg(F.min_by("weekday", F.struct(-F.col("delayed"), F.col("weekday"))).alias("worst_day")),
        ]
        if self.hotspots is not None:
            parts.append(self.hotspots.agg(F.max("delay_count").alias("hotspot_count")))
        else:
            parts[0] = parts[0].withColumn("hotspot_count", F.lit(None).cast("bigint"))
        return stored(one_row(*parts), "causes")

    @property
    def risk_facts(self) -> DataFrame:
        whole = cut(self.base, "all", "scope")
        total = whole.select("shipments").scalar()
        assets = self.assets.filter(F.col("asset_id").isNotNull())
        hours = cut(self.base, "hour", "hour")
        facts = one_row(
            whole.select(F.col("high_risk").alias("high_risk_count"), rate(F.col("high_risk"), F.col("shipments")).alias("high_risk_rate")),
            assets.agg(
                F.min_by("asset_id", F.struct(-F.col("shipments"), F.col("asset_id"))).alias("top_asset"),
                (F.max("shipments") * 100.0 / total).alias("max_asset_share"),
            ),
            hours.agg(
                F.min_by("hour", F.struct(-F.col("shipments"), F.col("hour"))).cast("int").cast("string").alias("top_hour"),
                (F.max("shipments") * 100.0 / total).alias("max_hour_share"),
            ),
        )
        return facts.withColumn("risk_level", rules.overall_risk(F.col("high_risk_rate"), F.col("max_asset_share")))

    @property
    def forecast(self) -> DataFrame:
        return metrics.forecast(self.daily, self.forecast_days)

    @cached_property
    def outlook_facts(self) -> DataFrame:
        """Forecast means, capacity and risk in one row."""
        means = metrics.forecast_means(self.daily, self.forecast_days)
        return stored(one_row(means, metrics.capacity(self.daily), self.risk_facts), "outlook")

    def counts(self, kind: str, out: str, measure: str = "shipments") -> DataFrame:
        per = cut(self.base, kind, "key").filter(F.col("key").isNotNull() & (F.col(measure) > 0))
        return metrics.as_map(per, "key", measure, out)


def _pack(df: DataFrame, out: str, *fields: str) -> DataFrame:
    return df.select(F.struct(*(fields or df.columns)).alias(out))


def _list(df: DataFrame, out: str, *order) -> DataFrame:
    """A short frame as one array ordered by the given columns."""
    keyed = df.select(F.struct(*order).alias("_o"), F.struct(*df.columns).alias("_v"))
    by_order = lambda a, b: F.when(a["_o"] < b["_o"], -1).when(a["_o"] > b["_o"], 1).otherwise(0)
    packed = F.array_sort(F.collect_list(F.struct("_o", "_v")), by_order)
    return keyed.agg(F.transform(packed, lambda x: x["_v"]).alias(out))


def kpi_list(fig: Figures) -> DataFrame:
    return _list(fig.kpis, "kpi_evaluation", F.col("kpi") == "delay_rate")


def descriptive(fig: Figures, per_asset: bool = False) -> DataFrame:
    """``per_asset`` adds the number of shipments of every asset."""
    return one_row(
        _pack(fig.data_summary, "data_summary"),
        _pack(fig.overview, "performance_metrics"),
        fig.counts("status", "status_distribution"),
        fig.counts("reason", "delay_reasons"),
        kpi_list(fig),
        _list(rules.descriptive_insights(fig.overview, fig.kpis), "insights", F.col("type")),
        *([fig.counts("asset", "asset_distribution")] if per_asset else []),
    )


def diagnostic(fig: Figures) -> DataFrame:
    """Summary, reasons, assets, time patterns, hotspots and insights; all null or empty without delays."""
    facts = fig.cause_facts
    parts = [
        _pack(facts, "summary", "total_delayed", "delay_rate", "avg_delay_probability", "avg_waiting_time"),
        _list(fig.reasons, "delay_reasons", F.col("n") * -1, F.col("reason")),
        _list(fig.top_assets, "asset_analysis", F.col("delay_rate") * -1, F.col("total_delays") * -1, F.col("asset_id")),
        _pack(facts, "peaks", "peak_hour", "worst_day"),
        fig.counts("hour", "hourly_distribution", "delayed"),
        fig.counts("weekday", "daily_distribution", "delayed"),
        rules.as_list(rules.root_cause_insights(facts), "insights"),
    ]
    if fig.hotspots is not None:
        parts.append(_list(fig.hotspots, "geographic_hotspots", F.col("delay_count") * -1, F.col("cluster_id")))
    return one_row(*parts)


def predictive(fig: Figures) -> DataFrame:
    facts = fig.outlook_facts
    return one_row(
        _list(fig.forecast, "forecasts", F.col("i")),
        _pack(facts, "forecast_summary", "avg_volume", "avg_delay_rate", "expected_avg_volume", "expected_avg_delay_rate"),
        rules.as_list(rules.risk_factors(facts), "risk_factors"),
        facts.select(F.col("risk_level").alias("overall_risk_level")),
        _pack(metrics.capacity(fig.daily), "capacity_analysis"),
        rules.as_list(rules.predictive_recommendations(facts), "recommendations"),
    )


def prescriptive(fig: Figures, per_asset: bool = False) -> DataFrame:
    """``per_asset`` adds share, delay rate and load of every asset."""
    facts = fig.cause_facts
    chances, resources, plans = rules.opportunities(facts), rules.resource_recommendations(fig.utilization), rules.kpi_plans(fig.kpis)
    everything = rules.prescriptive_recommendations(chances, resources, plans)
    return one_row(
        rules.as_list(rules.issues(facts, rules.root_cause_insights(facts)), "issues"),
        rules.as_list(chances, "optimization_opportunities"),
        _list(plans, "kpi_improvements", F.col("kpi") == "Delay Rate"),
        _list(everything, "recommendations", F.col("source"), F.col("position")),
        *([_list(fig.utilization, "asset_utilization", F.col("asset_id"))] if per_asset else []),
    )


def all_insights(fig: Figures, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """Insights of the chosen tiers, then the trend insights, in report order."""
    parts = []
    if "descriptive" in tiers:
        basic = rules.descriptive_insights(fig.overview, fig.kpis)
        position = F.when(F.col("type") == "descriptive", 0).otherwise(1).alias("position")
        parts.append(basic.select(F.lit(0).alias("tier"), position, "type", "title"))
    if "diagnostic" in tiers:
        parts.append(rules.root_cause_insights(fig.cause_facts).select(F.lit(1).alias("tier"), "*"))
    parts.append(rules.trend_insights(fig.trends).select(F.lit(2).alias("tier"), "*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def all_recommendations(fig: Figures, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    rows = rules.predictive_recommendations(fig.outlook_facts)
    return rows if "predictive" in tiers else rows.limit(0)


def comprehensive(fig: Figures, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    return one_row(
        _pack(fig.data_summary, "data_period"),
        _list(all_insights(fig, tiers), "insights", F.col("tier"), F.col("position")),
        _list(all_recommendations(fig, tiers), "recommendations", F.col("position")),
        fig.data_summary.select(F.array(*[F.lit(t) for t in tiers]).alias("analysis_types")),
    )


def executive(fig: Figures) -> DataFrame:
    full = comprehensive(fig)
    return one_row(
        _pack(fig.data_summary, "data_summary"),
        _pack(fig.overview, "overview"),
        kpi_list(fig),
        _pack(fig.trends, "trends"),
        full.select(F.slice("insights", 1, 5).alias("insights"), F.slice("recommendations", 1, 3).alias("recommendations")),
    )


def live_metrics(fig: Figures) -> DataFrame:
    """Open rows, assets, rows per asset and open rows per asset."""
    active = cut(fig.base, "all", "scope").select("active").scalar()
    return fig.assets.agg(
        F.count("asset_id").alias("total_assets"),
        F.avg(F.when(F.col("asset_id").isNotNull(), F.col("shipments"))).alias("avg_shipments_per_asset"),
    ).select(
        active.alias("active_shipments"), "total_assets", "avg_shipments_per_asset",
        rate(active, F.col("total_assets")).alias("utilization_rate"),
    )


def operational(fig: Figures) -> DataFrame:
    assets = fig.assets
    best = metrics.top_k(assets, 3, F.col("performance_score").desc(), F.col("asset_id"))
    return one_row(
        _pack(fig.data_summary, "data_summary"),
        _pack(live_metrics(fig), "real_time_metrics"),
        fig.counts("status", "status_distribution"),
        _pack(metrics.capacity(fig.daily), "capacity_analysis"),
        _pack(fig.cause_facts, "delay_summary", "total_delayed", "delay_rate", "avg_delay_probability", "avg_waiting_time"),
        _list(metrics.top_k(fig.reasons, 5, F.col("n").desc(), F.col("reason")), "top_reasons", F.col("n") * -1, F.col("reason")),
        _list(best, "top_performers", F.col("performance_score") * -1, F.col("asset_id")),
    )


def forecast_report(fig: Figures) -> DataFrame:
    whole = cut(fig.base, "all", "scope").select(F.col("delay_rate").alias("dr"))
    return one_row(
        _pack(fig.data_summary, "data_summary"),
        predictive(fig),
        _pack(fig.trends, "historical_trends"),
        _list(metrics.scenario_rows(whole), "scenarios", F.col("scenario")),
    )


def scorecard(fig: Figures) -> DataFrame:
    weekly = cut(fig.base, "week", "week").select("week", "shipments", "delay_rate", "avg_probability")
    return one_row(
        _pack(fig.data_summary, "data_summary"),
        kpi_list(fig),
        _list(weekly, "weekly_data", F.col("week")),
        _pack(metrics.linear_trend(weekly, "week", "delay_rate"), "delay_rate_trend"),
        _pack(metrics.linear_trend(weekly, "week", "shipments"), "volume_trend"),
        _list(metrics.benchmark(fig.kpis), "benchmark_comparison", F.col("kpi")),
    )


def rounded(report: DataFrame) -> DataFrame:
    """Report figures to two decimals, half to even, at any depth of structs and arrays."""
    from pyspark.sql import types as T

    def fix(c, t):
        if isinstance(t, T.DoubleType):
            return F.bround(c, 2)
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[fix(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: fix(x, t.elementType))
        return c

    return report.select(*[fix(F.col(f.name), f.dataType).alias(f.name) for f in report.schema.fields])


def export_rows(insights: DataFrame, as_of: str) -> DataFrame:
    """Insights as one exportable row: time, count and list."""
    body = insights.agg(F.array_sort(F.collect_list(F.struct("position", *[c for c in insights.columns if c != "position"]))).alias("insights"))
    return body.select(F.lit(as_of).alias("generated_at"), F.size("insights").alias("total_insights"), "insights")
