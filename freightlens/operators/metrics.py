"""Aggregated metrics and the window steps on top of them.

Every unpartitioned window below runs on a series that an aggregation has already
reduced to one row per period, asset or reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import BENCHMARKS, KPI_THRESHOLDS, SCENARIOS
from ..functions.scalars import clamp, day_label, period_label, rate
from ..functions.stats import slope_p_value, trend_direction
from .filters import top_k

def delayed_count() -> Column:
    return F.count_if("logistics_delay")


def delay_rate() -> Column:
    return rate(delayed_count(), F.count("*"))


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames side by side: a union with gaps, folded to the filled value per column."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def literal_rows(df: DataFrame, rows: list[Column]) -> DataFrame:
    """Repeat each row of ``df`` for every struct of a small fixed table."""
    return df.select("*", F.inline(F.array(*rows)))


# --- series -----------------------------------------------------------------------------
def trend_series(df: DataFrame, granularity: str = "daily") -> DataFrame:
    """Counts, delays and waits per period.  The wait is whole minutes, so the exact median stays small."""
    return df.groupBy(period_label("ts", granularity).alias("period")).agg(
        F.count("*").alias("shipments"),
        delayed_count().alias("delayed"),
        F.avg("delay_probability").alias("avg_probability"),
        F.stddev_samp("delay_probability").alias("std_probability"),
        F.avg("waiting_time").alias("avg_wait"),
        F.expr("percentile(waiting_time, 0.5D)").alias("median_wait"),
        F.max("waiting_time").alias("max_wait"),
        delay_rate().alias("delay_rate"),
    )


def daily_series(df: DataFrame) -> DataFrame:
    return df.groupBy(day_label("ts").alias("day")).agg(
        F.count("*").alias("shipments"),
        delayed_count().alias("delayed"),
        F.avg("delay_probability").alias("avg_probability"),
        F.avg("waiting_time").alias("avg_wait"),
        delay_rate().alias("delay_rate"),
    )


def delay_rate_chart(df: DataFrame) -> DataFrame:
    return daily_series(df).select("day", F.coalesce("delay_rate", F.lit(0.0)).alias("delay_rate"))


def linear_trend(series: DataFrame, order: str, value: str, prefix: str = "", last: int | None = None) -> DataFrame:
    """Least-squares trend of an ordered series of periods, one row.

    A flat series has slope 0 and strength 0; fewer than two points give
    ``insufficient_data``.
    """
    if last is not None:
        newest = F.row_number().over(Window.orderBy(F.col(order).desc()))
        series = series.withColumn("_newest", newest).filter(F.col("_newest") <= last)
    indexed = series.select(
        (F.row_number().over(Window.orderBy(order)) - 1).cast("double").alias("x"), F.col(value).cast("double").alias("y")
    )
    fit = indexed.agg(
        F.count("y").alias("n"),
        F.regr_slope("y", "x").alias("fit_slope"),
        F.covar_samp("x", "y").alias("cov"),
        F.var_samp("x").alias("vx"),
        F.var_samp("y").alias("vy"),
    )
    flat = F.coalesce(F.col("vy"), F.lit(0.0)) <= 0
    enough = F.col("n") >= 2
    # an inner branch never divides by zero because the flat case is taken first
    r = F.when(flat, 0.0).otherwise(F.try_divide(F.col("cov"), F.sqrt(F.col("vx") * F.col("vy"))))
    out = fit.select("n", F.when(flat, 0.0).otherwise(F.col("fit_slope")).alias("slope"), r.alias("r"))
    out = out.withColumn("p", slope_p_value("r", "n"))
    named = {
        "direction": F.when(enough, trend_direction(F.col("slope"))).otherwise("insufficient_data"),
        "slope": F.when(enough, F.col("slope")).otherwise(0.0),
        "strength": F.when(enough, F.abs("r")).otherwise(0.0),
        "r_squared": F.when(enough, F.col("r") * F.col("r")),
        "p_value": F.when(enough, F.col("p")),
        "significant": F.when(enough, F.col("p") < 0.05).otherwise(False),
    }
    return out.select(*[c.alias(prefix + name) for name, c in named.items()])


def first_max(df: DataFrame, label: str, value: str, out: str) -> DataFrame:
    """The first label, in label order, that carries the largest value."""
    return df.agg(F.min_by(label, F.struct(-F.col(value), F.col(label))).alias(out))


def trend_summary(series: DataFrame) -> DataFrame:
    return one_row(
        series.agg(
            F.count("*").alias("total_periods"),
            F.avg("shipments").alias("avg_shipments_per_period"),
            F.avg("delay_rate").alias("avg_delay_rate"),
            F.var_samp("delay_rate").alias("delay_rate_variance"),
        ),
        first_max(series, "period", "shipments", "peak_volume_period"),
        first_max(series, "period", "delay_rate", "highest_delay_period"),
        linear_trend(series, "period", "delay_rate", "delay_"),
        linear_trend(series, "period", "shipments", "volume_"),
    )


def weekly_kpis(df: DataFrame) -> DataFrame:
    return df.groupBy(period_label("ts", "weekly").alias("week")).agg(
        F.count("*").alias("shipments"),
        delay_rate().alias("delay_rate"),
        F.avg("delay_probability").alias("avg_probability"),
    )


# --- root causes ---------------------------------------------------------------------------
def reason_shares(df: DataFrame) -> DataFrame:
    """Counts per reason among delayed rows; rows without a reason stay in the denominator."""
    counts = df.filter("logistics_delay").groupBy("logistics_delay_reason").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return (
        counts.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(whole))
        .filter(F.col("logistics_delay_reason").isNotNull())
        .withColumnRenamed("logistics_delay_reason", "reason")
    )


def asset_delay_ranking(df: DataFrame) -> DataFrame:
    """Delays over all rows of an asset; assets without delays are left out."""
    return (
        df.filter(F.col("asset_id").isNotNull())
        .groupBy("asset_id")
        .agg(delayed_count().alias("total_delays"), delay_rate().alias("delay_rate"))
        .filter(F.col("total_delays") > 0)
    )


def top_delay_assets(df: DataFrame, k: int = 10) -> DataFrame:
    ranked = asset_delay_ranking(df)
    return top_k(ranked, k, F.col("delay_rate").desc(), F.col("total_delays").desc(), F.col("asset_id"))


def delays_by_hour(df: DataFrame) -> DataFrame:
    return df.filter("logistics_delay").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def delays_by_weekday(df: DataFrame) -> DataFrame:
    return df.filter("logistics_delay").groupBy(F.date_format("ts", "EEEE").alias("weekday")).agg(F.count("*").alias("n"))


def delay_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        delayed_count().alias("total_delayed"),
        delay_rate().alias("delay_rate"),
        F.avg(F.when(F.col("logistics_delay"), F.col("delay_probability"))).alias("avg_delay_probability"),
        F.avg(F.when(F.col("logistics_delay"), F.col("waiting_time"))).alias("avg_waiting_time"),
    )


def geographic_hotspots(df: DataFrame, k: int = 5, top: int = 5, seed: int = 42) -> DataFrame:
    """Clusters of delayed positions, largest first.  Ten points or fewer give no rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = df.filter("logistics_delay").select("latitude", "longitude").na.drop()
    n = points.count()
    schema = "cluster_id int, center_latitude double, center_longitude double, delay_count bigint"
    if n <= 10:
        return df.sparkSession.createDataFrame([], schema)
    vectors = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="position").transform(points)
    model = KMeans(k=min(k, n // 3), seed=seed, featuresCol="position", predictionCol="cluster_id").fit(vectors)
    sized = (
        model.transform(vectors)
        .groupBy("cluster_id")
        .agg(
            F.avg("latitude").alias("center_latitude"),
            F.avg("longitude").alias("center_longitude"),
            F.count("*").alias("delay_count"),
        )
    )
    return top_k(sized, top, F.col("delay_count").desc(), F.col("cluster_id"))


# --- forecast and capacity --------------------------------------------------------------------
def moving_means(daily: DataFrame) -> DataFrame:
    w = Window.orderBy("day").rowsBetween(-2, 0)
    return daily.withColumns(
        {"volume_ma3": F.avg("shipments").over(w), "delay_rate_ma3": F.avg("delay_rate").over(w)}
    )


def last_days(daily: DataFrame, n: int) -> DataFrame:
    newest = Window.orderBy(F.col("day").desc())
    return daily.withColumn("back", F.row_number().over(newest) - 1).filter(F.col("back") < n)


def forecast(daily: DataFrame, days: int = 7) -> DataFrame:
    """Extrapolate the last three moving means; no rows under three days of history.

    The slope is the change over the three points divided by three.
    """
    recent = last_days(moving_means(daily), 3)
    at = lambda c, back: F.max(F.when(F.col("back") == back, F.col(c)))
    ends = recent.agg(
        F.count("*").alias("n"),
        F.max("day").alias("last_day"),
        at("volume_ma3", 0).alias("v0"),
        at("volume_ma3", 2).alias("v2"),
        at("delay_rate_ma3", 0).alias("r0"),
        at("delay_rate_ma3", 2).alias("r2"),
    ).filter(F.col("n") == 3)
    steps = ends.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(days))))
    i = F.col("i")
    return steps.select(
        "i",
        F.date_format(F.date_add(F.to_date("last_day"), i), "yyyy-MM-dd").alias("day"),
        F.greatest(F.lit(0.0), F.col("v0") + (F.col("v0") - F.col("v2")) / 3 * i).alias("predicted_volume"),
        clamp(F.col("r0") + (F.col("r0") - F.col("r2")) / 3 * i, 0.0, 100.0).alias("predicted_delay_rate"),
        F.greatest(F.lit(0.3), F.lit(0.8) - i * 0.1).alias("confidence"),
    )


def forecast_means(daily: DataFrame, days: int = 7) -> DataFrame:
    return one_row(
        daily.agg(F.avg("shipments").alias("avg_volume"), F.avg("delay_rate").alias("avg_delay_rate")),
        forecast(daily, days).agg(
            F.avg("predicted_volume").alias("expected_avg_volume"),
            F.avg("predicted_delay_rate").alias("expected_avg_delay_rate"),
        ),
    )


def capacity(daily: DataFrame) -> DataFrame:
    """Peak and mean daily volume, use of the peak and the last week's trend; needs seven days."""
    used = daily.agg(
        F.count("*").alias("days"), F.max("shipments").alias("max_daily_volume"), F.avg("shipments").alias("avg_daily_volume")
    ).withColumn("utilization_rate", rate(F.col("avg_daily_volume"), F.col("max_daily_volume")))
    status = F.when(F.col("utilization_rate") > 85, "high").when(F.col("utilization_rate") > 70, "medium").otherwise("low")
    both = one_row(used.withColumn("capacity_status", status), linear_trend(daily, "day", "shipments", "volume_", last=7))
    return both.filter(F.col("days") >= 7).drop("days")


def risk_shares(df: DataFrame) -> DataFrame:
    """Largest asset share, largest hour share and high-risk share of all rows."""

    def largest(by: Column, name: str) -> DataFrame:
        counts = df.groupBy(by.alias("k")).agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n").alias("total")).scalar()
        named = counts.filter(F.col("k").isNotNull())
        return named.agg(
            F.min_by("k", F.struct(-F.col("n"), F.col("k"))).cast("string").alias(f"top_{name}"),
            (F.max("n") * 100.0 / total).alias(f"max_{name}_share"),
        )

    high = F.count_if(F.col("delay_probability") > 0.8)
    return one_row(
        largest(F.col("asset_id"), "asset"),
        largest(F.hour("ts"), "hour"),
        df.agg(high.alias("high_risk_count"), rate(high, F.count("*")).alias("high_risk_rate"), F.count("*").alias("total")),
    )


# --- KPIs ------------------------------------------------------------------------------------
def kpi_status(value: Column, target: Column, warning: Column, critical: Column, lower_better: Column) -> Column:
    sign = F.when(lower_better, -1.0).otherwise(1.0)
    v = value * sign
    return (
        F.when(v >= target * sign, "excellent")
        .when(v >= warning * sign, "good")
        .when(v >= critical * sign, "warning")
        .otherwise("critical")
    )


def kpi_rows(measured: DataFrame) -> DataFrame:
    """On-time and delay rate of a one-row frame (n, dr) against target, warning and critical values."""
    rows = [
        F.struct(
            F.lit(name).alias("kpi"), F.lit(t).alias("target"), F.lit(w).alias("warning"), F.lit(c).alias("critical"),
            F.lit(low).alias("lower_better"),
        )
        for name, t, w, c, low in KPI_THRESHOLDS
        if name in ("on_time_delivery_rate", "delay_rate")
    ]
    value = F.when(F.col("lower_better"), F.col("dr")).otherwise(100 - F.col("dr"))
    return literal_rows(measured.filter(F.col("n") > 0), rows).select(
        "kpi",
        value.alias("current_value"),
        "target",
        kpi_status(value, F.col("target"), F.col("warning"), F.col("critical"), F.col("lower_better")).alias("status"),
        (value - F.col("target")).alias("variance"),
    )


def evaluate_kpis(df: DataFrame) -> DataFrame:
    return kpi_rows(df.agg(F.count("*").alias("n"), delay_rate().alias("dr")))


def benchmark(kpis: DataFrame) -> DataFrame:
    """Industry tier and percentile of every KPI that has a benchmark."""
    bounds = F.create_map(
        *[x for name, e, g, a, p, _ in BENCHMARKS for x in (F.lit(name), F.array(F.lit(e), F.lit(g), F.lit(a), F.lit(p)))]
    )
    lower = F.col("kpi").isin(*[name for name, *_, low in BENCHMARKS if low])
    sign = F.when(lower, -1.0).otherwise(1.0)
    known = kpis.withColumn("bounds", F.try_element_at(bounds, F.col("kpi"))).filter(F.col("bounds").isNotNull())
    v = F.col("current_value") * sign
    hits = F.size(F.filter("bounds", lambda b: v >= b * sign))
    tier = F.when(v >= F.col("bounds")[0] * sign, "excellent").when(v >= F.col("bounds")[1] * sign, "good").when(
        v >= F.col("bounds")[2] * sign, "average"
    )
    return known.select(
        "kpi", "current_value", tier.otherwise("poor").alias("tier"), (F.floor(hits * 100 / 4)).cast("int").alias("percentile")
    )


def scenario_rows(now: DataFrame) -> DataFrame:
    """Delay rate, volume and efficiency of a one-row frame (dr) under three fixed assumptions."""
    rows = [
        F.struct(
            F.lit(name).alias("scenario"), F.lit(float(factor)).alias("factor"), F.lit(volume).alias("volume_change"),
            F.lit(gain).alias("efficiency_gain"), F.lit(text).alias("description"),
            F.array(*[F.lit(a) for a in assumptions]).alias("assumptions"),
        )
        for name, factor, volume, gain, text, assumptions in SCENARIOS
    ]
    return literal_rows(now, rows).select(
        "scenario", clamp(F.col("dr") * F.col("factor"), 0.0, 100.0).alias("delay_rate"),
        "volume_change", "efficiency_gain", "description", "assumptions",
    )


def scenarios(df: DataFrame) -> DataFrame:
    return scenario_rows(df.agg(delay_rate().alias("dr")))


# --- overviews ---------------------------------------------------------------------------------
def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_shipments"),
        (F.count("*") - delayed_count()).alias("on_time_shipments"),
        delayed_count().alias("delayed_shipments"),
        delay_rate().alias("delay_rate"),
        (100 - delay_rate()).alias("on_time_rate"),
        F.avg("delay_probability").alias("avg_delay_probability"),
        F.count_if(F.col("delay_probability") > 0.8).alias("high_risk_shipments"),
        F.avg("waiting_time").alias("avg_waiting_time"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def as_map(counts: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """A counted table of few keys (a fixed list of statuses, reasons or hours) as one map."""
    return counts.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(out))


def status_distribution(df: DataFrame) -> DataFrame:
    """Counts per status; without a status column by delay flag, and without both one row."""
    if "shipment_status" in df.columns:
        return distribution(df, "shipment_status")
    label = F.when(F.col("logistics_delay"), "Delayed").otherwise("On Time") if "logistics_delay" in df.columns else F.lit("Unknown")
    return df.groupBy(label.alias("value")).agg(F.count("*").alias("n"))


def realtime_metrics(df: DataFrame) -> DataFrame:
    """Open rows, assets and rows per asset from one count per (asset, open)."""
    open_row = ~F.col("shipment_status").eqNullSafe("Delivered")
    per_asset = df.groupBy("asset_id").agg(F.count("*").alias("n"), F.count_if(open_row).alias("open"))
    totals = per_asset.agg(
        F.sum("open").alias("active_shipments"),
        F.count("asset_id").alias("total_assets"),
        F.avg(F.when(F.col("asset_id").isNotNull(), F.col("n"))).alias("avg_shipments_per_asset"),
    )
    return totals.withColumn("utilization_rate", rate(F.col("active_shipments"), F.col("total_assets")))


def asset_performance(df: DataFrame) -> DataFrame:
    per_asset = df.groupBy("asset_id").agg(
        F.count("*").alias("total_shipments"),
        delayed_count().alias("delayed_shipments"),
        delay_rate().alias("delay_rate"),
        F.avg("delay_probability").alias("avg_delay_probability"),
    )
    return per_asset.withColumn("performance_score", (100 - F.col("delay_rate")) * (1 - F.col("avg_delay_probability")))


def top_performers(performance: DataFrame, k: int = 3) -> DataFrame:
    return top_k(performance, k, F.col("performance_score").desc(), F.col("asset_id"))


def underperformers(performance: DataFrame, bound: float = 15.0) -> DataFrame:
    return performance.filter(F.col("delay_rate") > bound)


def asset_utilization(df: DataFrame) -> DataFrame:
    """Share of rows per asset against the mean share."""
    counts = df.groupBy("asset_id").agg(F.count("*").alias("n"), delay_rate().alias("delay_rate"))
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("assets"))
    total = sums.select("total").scalar()
    mean = sums.select(F.lit(100.0) / F.col("assets")).scalar()
    shared = counts.withColumn("utilization_rate", F.col("n") * 100.0 / total)
    load = F.when(F.col("utilization_rate") < mean * 0.7, "under").when(F.col("utilization_rate") > mean * 1.3, "over")
    return shared.select("asset_id", "utilization_rate", "delay_rate", load.otherwise("balanced").alias("load"))


def activity_heatmap(df: DataFrame) -> DataFrame:
    """Rows per weekday and hour, one column per hour."""
    timed = df.select(F.date_format("ts", "EEEE").alias("weekday"), F.hour("ts").alias("hour"))
    return timed.groupBy("weekday").pivot("hour", list(range(24))).count().na.fill(0)


def shipment_statistics(df: DataFrame) -> DataFrame:
    """Active rows only: totals, status counts, reasons of delayed rows, mean wait."""
    active = df.filter("is_active")
    return one_row(
        active.agg(
            F.count("*").alias("total_shipments"),
            delayed_count().alias("delayed_shipments"),
            delay_rate().alias("delay_rate"),
            F.avg("waiting_time").alias("avg_waiting_time"),
        ),
        as_map(distribution(active, "shipment_status"), "value", "n", "status_counts"),
        as_map(distribution(active.filter("logistics_delay"), "logistics_delay_reason"), "value", "n", "delay_reasons"),
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    assets = df.groupBy("asset_id").agg(F.count("*").alias("n"))
    return one_row(
        df.agg(
            F.count("*").alias("total_records"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            delayed_count().alias("total_delayed"),
            delay_rate().alias("delay_rate"),
            F.min("waiting_time").alias("min_wait"),
            F.max("waiting_time").alias("max_wait"),
            F.avg("waiting_time").alias("mean_wait"),
            F.expr("percentile(waiting_time, 0.5D)").alias("median_wait"),
            F.min("latitude").alias("min_latitude"),
            F.max("latitude").alias("max_latitude"),
            F.min("longitude").alias("min_longitude"),
            F.max("longitude").alias("max_longitude"),
        ),
        assets.agg(F.count("asset_id").alias("total_assets"), F.sort_array(F.collect_list("asset_id")).alias("asset_list")),
    )


def dataset_assets(df: DataFrame) -> DataFrame:
    """The assets of a dataset, a row each."""
    return df.where("asset_id IS NOT NULL").groupBy("asset_id").agg(F.count("*").alias("n"))


def dataset_distributions(df: DataFrame) -> DataFrame:
    parts = ["shipment_status", "traffic_status", "logistics_delay_reason"]
    counted = [distribution(df, c).select(F.lit(c).alias("field"), "value", "n") for c in parts]
    return reduce(DataFrame.unionByName, counted)


def validation(df: DataFrame) -> DataFrame:
    active = F.col("is_active")
    n, d = F.count_if(active), F.count_if(active & F.col("logistics_delay"))
    return df.agg(
        n.alias("total_records"),
        d.alias("delayed_records"),
        rate(d, n).alias("delay_rate"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    ).withColumn("data_integrity", F.when(F.col("total_records") > 0, "VALID").otherwise("NO_DATA"))


def date_range(df: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last day as text; N/A for an empty frame or a missing column."""
    if ts not in df.columns:
        return df.agg(F.lit("N/A").alias("start"), F.lit("N/A").alias("end"))
    return df.agg(
        F.coalesce(day_label(F.min(ts)), F.lit("N/A")).alias("start"),
        F.coalesce(day_label(F.max(ts)), F.lit("N/A")).alias("end"),
    )
