"""Rules: a one-row frame of facts becomes rows of insights, issues or recommendations.

Texts are fixed values; the conditions are plain column expressions, so every
rule set is one projection over one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import KPI_ACTIONS
from ..functions.scalars import number_text, title_case
from .metrics import one_row

SEVERITY_FROM_TYPE = ["critical", "warning"]


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def texts(*values: str | Column) -> Column:
    return F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]).cast("array<string>")


def fire(facts: DataFrame, rules: list[tuple[Column, dict[str, Column | str]]]) -> DataFrame:
    """One output row per rule whose condition holds, in rule order."""
    structs = []
    for n, (cond, fields) in enumerate(rules):
        cols = [(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]
        structs.append(F.when(cond, F.struct(F.lit(n).alias("position"), *cols)))
    return facts.select(F.inline(F.array_compact(F.array(*structs))))


def insight(kind: str, title: Column | str, description: Column | str, impact: str | None, *advice: Column | str) -> dict:
    return {
        "type": kind,
        "title": title,
        "description": description,
        "impact": F.lit(impact).cast("string"),
        "recommendations": texts(*advice),
    }


def trend_insights(facts: DataFrame) -> DataFrame:
    """Reads delay_* and volume_* trend columns, total_periods and delay_rate_variance."""
    rising = (F.col("delay_direction") == "increasing") & F.col("delay_significant")
    falling = (F.col("delay_direction") == "decreasing") & F.col("delay_significant")
    growing = (F.col("volume_direction") == "increasing") & F.col("volume_significant")
    unstable = (F.col("total_periods") >= 7) & (F.col("delay_rate_variance") > 25)
    strength = lambda c: F.format_string("%.2f", c)
    return fire(
        facts,
        [
            (rising, insight("warning", "Increasing Delay Rate Trend",
                             text("Delay rates are trending upward with ", strength("delay_strength"), " correlation"), "high",
                             "Investigate root causes and implement preventive measures")),
            (falling, insight("positive", "Improving Delay Performance",
                              text("Delay rates are trending downward with ", strength("delay_strength"), " correlation"), "high",
                              "Continue current optimization strategies")),
            (growing, insight("info", "Growing Shipment Volume",
                              text("Shipment volume is increasing with ", strength("volume_strength"), " correlation"), "medium",
                              "Ensure capacity planning and resource allocation")),
            (unstable, insight("info", "High Delay Rate Variability",
                               text("Delay rates show high variability (variance: ", strength("delay_rate_variance"), ")"), "medium",
                               "Investigate cyclical patterns and stabilize operations")),
        ],
    )


def root_cause_insights(facts: DataFrame) -> DataFrame:
    """Reads delay_rate, top_reason(_share), risky_assets, peak_hour(_share, _count), hotspot_count.

    The peak hour counts when it holds more than a fifth of the delays.
    """
    rate_text = number_text("delay_rate")
    delays = F.col("total_delayed") > 0
    return fire(
        facts,
        [
            (delays & (F.col("delay_rate") > 15), insight(
                "critical", "High Overall Delay Rate",
                text("System-wide delay rate of ", rate_text, "% exceeds acceptable thresholds"), None,
                "Implement immediate corrective measures", "Review operational procedures", "Increase monitoring frequency")),
            (delays & (F.col("delay_rate") > 10) & (F.col("delay_rate") <= 15), insight(
                "warning", "Elevated Delay Rate", text("Delay rate of ", rate_text, "% requires attention"), None,
                "Investigate primary delay causes", "Implement preventive measures")),
            (F.col("top_reason_share") > 40, insight(
                "actionable", text("Dominant Delay Cause: ", F.col("top_reason")),
                text(F.col("top_reason"), " accounts for ", number_text("top_reason_share"), "% of all delays"), None,
                text("Focus improvement efforts on ", F.col("top_reason")), "Develop targeted mitigation strategies")),
            (F.col("risky_assets") > 0, insight(
                "warning", "High-Risk Assets Identified",
                text(F.col("risky_assets").cast("string"), " assets have delay rates > 20%"), None,
                "Schedule maintenance for high-risk assets", "Review asset utilization patterns")),
            (F.col("peak_hour_share") > 20, insight(
                "info", text("Peak Delay Period: ", F.col("peak_hour").cast("string"), ":00"),
                text("Hour ", F.col("peak_hour").cast("string"), " accounts for ", F.col("peak_hour_count").cast("string"), " delays"), None,
                "Investigate operational bottlenecks during peak hours", "Consider resource reallocation")),
            (F.col("hotspot_count") > 5, insight(
                "info", "Geographic Delay Hotspot Detected",
                text("Location cluster has ", F.col("hotspot_count").cast("string"), " delays"), None,
                "Investigate regional factors affecting delays", "Consider route optimization")),
        ],
    )


def risk_factors(facts: DataFrame) -> DataFrame:
    one = lambda c: F.format_string("%.1f%%", c)
    return fire(
        facts,
        [
            (F.col("high_risk_rate") > 20, {
                "factor": "High Delay Probability Shipments", "level": "high", "value": one("high_risk_rate"),
                "description": text(F.col("high_risk_count").cast("string"), " shipments have >80% delay probability")}),
            (F.col("max_asset_share") > 50, {
                "factor": "Asset Concentration", "level": "medium", "value": one("max_asset_share"),
                "description": text("Single asset handles ", one("max_asset_share"), " of shipments")}),
            (F.col("max_hour_share") > 30, {
                "factor": "Temporal Concentration", "level": "low", "value": one("max_hour_share"),
                "description": text("Peak activity at hour ", F.col("top_hour"), " (", one("max_hour_share"), " of shipments)")}),
        ],
    )


def overall_risk(high_risk_rate: Column, max_asset_share: Column) -> Column:
    return F.when(high_risk_rate > 20, "high").when(max_asset_share > 50, "medium").otherwise("low")


def predictive_recommendations(facts: DataFrame) -> DataFrame:
    """Reads expected_avg_volume, expected_avg_delay_rate, max_daily_volume and risk_level."""
    limit = F.coalesce(F.col("max_daily_volume").cast("double"), F.lit(100.0)) * 0.9
    return fire(
        facts,
        [
            (F.col("expected_avg_volume") > limit, {
                "priority": "high", "category": "capacity_planning", "title": "Capacity Expansion Required",
                "description": text("Predicted volume (", number_text("expected_avg_volume", 1), ") approaching capacity limit"),
                "actions": texts("Scale up resources", "Optimize asset utilization", "Consider additional capacity")}),
            (F.col("risk_level") == "high", {
                "priority": "high", "category": "risk_mitigation", "title": "High Risk Level Detected",
                "description": "Multiple high-risk factors identified",
                "actions": texts("Implement risk mitigation strategies", "Increase monitoring frequency", "Review operational procedures")}),
            (F.col("expected_avg_delay_rate") > 10, {
                "priority": "medium", "category": "operational_improvement", "title": "Delay Rate Optimization Needed",
                "description": text("Predicted delay rate of ", number_text("expected_avg_delay_rate"), "% exceeds targets"),
                "actions": texts("Investigate root causes", "Implement preventive measures", "Enhance monitoring")}),
        ],
    )


def issues(facts: DataFrame, insights: DataFrame) -> DataFrame:
    """Issues from the rates, then every critical or warning insight as an issue."""
    own = fire(
        facts,
        [
            (F.col("delay_rate") > 15, {
                "issue": "High Delay Rate", "severity": "critical",
                "description": text("Delay rate of ", number_text("delay_rate"), "% exceeds acceptable thresholds"),
                "impact": "Operational efficiency and customer satisfaction are significantly impacted"}),
            ((F.col("delay_rate") > 10) & (F.col("delay_rate") <= 15), {
                "issue": "Elevated Delay Rate", "severity": "warning",
                "description": text("Delay rate of ", number_text("delay_rate"), "% requires attention"),
                "impact": "Potential negative impact on customer satisfaction"}),
            (F.col("high_risk_shipments") > 10, {
                "issue": "High Number of High-Risk Shipments", "severity": "warning",
                "description": text(F.col("high_risk_shipments").cast("string"), " shipments have >80% delay probability"),
                "impact": "Increased operational risk and potential customer complaints"}),
        ],
    )
    derived = insights.filter(F.col("type").isin(*SEVERITY_FROM_TYPE)).select(
        (F.col("position") + 100).alias("position"),
        F.col("title").alias("issue"),
        F.col("type").alias("severity"),
        "description",
        F.coalesce("impact", F.lit("Unknown")).alias("impact"),
    )
    return own.unionByName(derived)


def opportunities(facts: DataFrame) -> DataFrame:
    """Reads delay_rate, high_risk_shipments and risky_top_assets (rate above 20 among the top ten)."""
    return fire(
        facts,
        [
            (F.col("delay_rate") > 10, {
                "category": "Delay Reduction",
                "potential_improvement": text("Reduce delay rate from ", number_text("delay_rate"), "% to <10%"),
                "implementation_effort": "medium", "expected_benefit": "Improved customer satisfaction and reduced costs",
                "recommendations": texts("Implement predictive delay alerts", "Optimize routing based on traffic patterns",
                                         "Improve asset maintenance schedules")}),
            (F.col("high_risk_shipments") > 5, {
                "category": "Risk Mitigation",
                "potential_improvement": text("Reduce high-risk shipments from ", F.col("high_risk_shipments").cast("string"), " to <5"),
                "implementation_effort": "low", "expected_benefit": "Proactive issue resolution and improved reliability",
                "recommendations": texts("Enhance monitoring of high-risk shipments", "Implement early intervention protocols",
                                         "Review asset allocation strategies")}),
            (F.col("risky_top_assets") > 0, {
                "category": "Asset Performance Optimization",
                "potential_improvement": text("Improve performance of ", F.col("risky_top_assets").cast("string"), " underperforming assets"),
                "implementation_effort": "high", "expected_benefit": "Better asset utilization and reduced delays",
                "recommendations": texts("Conduct maintenance reviews for underperforming assets",
                                         "Provide additional training for asset operators",
                                         "Consider asset replacement for consistently underperforming units")}),
        ],
    )


NAMED_ASSETS = 20


def resource_recommendations(utilization: DataFrame) -> DataFrame:
    """Fixed advice, led by a redistribution line when both ends of the load exist.

    The line names the first ``NAMED_ASSETS`` assets of either end and the number of
    further ones; the rows of ``utilization`` have them all.
    """
    ends = utilization.where(F.col("load").isin("over", "under"))
    place = F.row_number().over(Window.partitionBy("load").orderBy("asset_id"))
    named = ends.withColumn("place", place).where(F.col("place") <= NAMED_ASSETS)
    counts = utilization.agg(F.count_if(F.col("load") == "over").alias("n_over"), F.count_if(F.col("load") == "under").alias("n_under"), F.count("*").alias("n"))
    ids = lambda load: F.array_join(F.array_sort(F.collect_list(F.when(F.col("load") == load, F.col("asset_id")))), ", ")
    sides = one_row(named.agg(ids("over").alias("first_over"), ids("under").alias("first_under")), counts)
    rest = lambda load: F.when(F.col(f"n_{load}") > NAMED_ASSETS, F.concat(F.lit(" and "), (F.col(f"n_{load}") - NAMED_ASSETS).cast("string"), F.lit(" more"))).otherwise("")
    sides = sides.withColumns({load: F.concat(f"first_{load}", rest(load)) for load in ("over", "under")})
    line = text("Redistribute workload from overutilized assets (", F.col("over"), ") to underutilized assets (", F.col("under"), ")")
    both = (F.col("over") != "") & (F.col("under") != "")
    return fire(
        sides,
        [
            (both, {"recommendation": line}),
            (F.col("n") > 0, {"recommendation": "Review asset allocation strategy to balance utilization"}),
            (F.col("n") > 0, {"recommendation": "Consider adding capacity if consistently overutilized"}),
        ],
    )


def kpi_plans(kpis: DataFrame) -> DataFrame:
    """A plan per KPI in warning or critical state; the gap is signed toward the target."""
    actions = F.create_map(*[x for name, a in KPI_ACTIONS.items() for x in (F.lit(name), texts(*a))])
    gap = F.when(F.col("kpi") == "delay_rate", F.col("current_value") - F.col("target")).otherwise(
        F.col("target") - F.col("current_value")
    )
    return kpis.filter(F.col("status").isin("warning", "critical")).select(
        title_case("kpi").alias("kpi"),
        F.col("current_value").alias("current"),
        "target",
        gap.alias("gap"),
        F.coalesce(F.try_element_at(actions, F.col("kpi")), texts()).alias("actions"),
    )


def prescriptive_recommendations(chances: DataFrame, resources: DataFrame, plans: DataFrame) -> DataFrame:
    """One list from three sources; low effort and KPI gaps come with high priority."""
    parts = [
        chances.select(
            F.lit(0).alias("source"), "position", "category",
            F.when(F.col("implementation_effort") == "low", "high").otherwise("medium").alias("priority"),
            F.col("potential_improvement").alias("description"),
            F.col("recommendations").alias("actions"),
        ),
        resources.select(
            F.lit(1).alias("source"), "position", F.lit("Resource Optimization").alias("category"), F.lit("medium").alias("priority"),
            F.col("recommendation").alias("description"),
            texts("Implement resource redistribution plan", "Monitor utilization metrics").alias("actions"),
        ),
        plans.select(
            F.lit(2).alias("source"), F.when(F.col("kpi") == "Delay Rate", 1).otherwise(0).alias("position"),
            text("KPI Improvement: ", F.col("kpi")).alias("category"), F.lit("high").alias("priority"),
            text("Close gap of ", number_text("gap"), " to reach target").alias("description"), "actions",
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def descriptive_insights(overview: DataFrame, kpis: DataFrame) -> DataFrame:
    """An overview row and a KPI row, their figures as a map."""
    metric = lambda *names: F.map_from_entries(
        F.array(*[F.struct(F.lit(n), F.col(n).cast("double")) for n in names])
    )
    first = overview.filter(F.col("total_shipments") > 0).select(
        F.lit("descriptive").alias("type"),
        F.lit("Shipment Overview").alias("title"),
        metric("total_shipments", "delayed_shipments", "delay_rate", "avg_delay_probability").alias("metrics"),
    )
    second = (
        kpis.agg(F.map_from_entries(F.collect_list(F.struct("kpi", "current_value"))).alias("metrics"))
        .filter(F.size("metrics") > 0)
        .select(F.lit("kpi_evaluation").alias("type"), F.lit("KPI Performance").alias("title"), "metrics")
    )
    return first.unionByName(second)


def as_list(df: DataFrame, out: str, order: str = "position") -> DataFrame:
    """Short rule output as one ordered array; the ordering column leads and is kept."""
    fields = [order, *[c for c in df.columns if c != order]]
    return df.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))
