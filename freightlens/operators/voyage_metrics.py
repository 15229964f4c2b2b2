"""Dashboard and administration figures over voyages, predictions and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.risk import accuracy_of, band_exclusive
from ..functions.scalars import day_label, hours_between, rate
from .filters import is_open, top_k
from .joins import predictions_of_voyages
from .metrics import one_row

ARRIVAL_DELAY = lambda: hours_between("scheduled_arrival", "actual_arrival")


def _day(as_of: str) -> Column:
    return F.to_date(F.lit(as_of))


def _since(as_of: str, days: int) -> Column:
    return F.expr(f"timestamp_ntz'{as_of}' - interval '{days}' day")


def with_accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("prediction_accuracy", accuracy_of("predicted_delay_hours", "actual_delay_hours"))


def dashboard_statistics(
    voyages: DataFrame, customers: DataFrame, predictions: DataFrame, communications: DataFrame, as_of: str
) -> DataFrame:
    """Nine figures, one conditional aggregate per table."""
    late = F.col("actual_arrival") > F.col("scheduled_arrival")
    status = F.col("status")
    return one_row(
        voyages.agg(
            F.count("*").alias("total_shipments"),
            F.count_if(is_open()).alias("active_shipments"),
            F.count_if(status == "delayed").alias("delayed_shipments"),
            F.count_if((status == "delivered") & (F.col("actual_arrival") <= F.col("scheduled_arrival"))).alias("on_time_shipments"),
            F.coalesce(F.avg(F.when(late, ARRIVAL_DELAY())), F.lit(0.0)).alias("average_delay_hours"),
        ),
        customers.agg(F.count_if("is_active").alias("total_customers")),
        with_accuracy(predictions).agg(
            F.count_if(F.to_date("prediction_date") == _day(as_of)).alias("predictions_today"),
            F.coalesce(F.avg("prediction_accuracy"), F.lit(0.0)).alias("delay_prediction_accuracy"),
        ),
        communications.agg(F.count_if(F.to_date("sent_at") == _day(as_of)).alias("communications_sent_today")),
    )


def daily_voyage_delays(voyages: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    recent = voyages.filter(F.col("created_at") >= _since(as_of, days))
    delayed = F.count_if(F.col("status") == "delayed")
    return recent.groupBy(day_label("created_at").alias("day")).agg(
        F.count("*").alias("total_shipments"), delayed.alias("delayed_shipments"), rate(delayed, F.count("*")).alias("delay_rate")
    )


def route_performance(voyages: DataFrame, as_of: str, days: int = 30, minimum: int = 5, k: int = 10) -> DataFrame:
    arrived = voyages.filter((F.col("created_at") >= _since(as_of, days)) & F.col("actual_arrival").isNotNull())
    routes = (
        arrived.groupBy("origin_port", "destination_port")
        .agg(F.count("*").alias("total_shipments"), F.avg(ARRIVAL_DELAY()).alias("avg_delay_hours"))
        .filter(F.col("total_shipments") >= minimum)
    )
    return top_k(routes, k, F.col("avg_delay_hours").desc(), F.col("origin_port"), F.col("destination_port"))


def accuracy_by_day(predictions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    rows = with_accuracy(predictions.filter(F.col("prediction_date") >= _since(as_of, days)))
    return (
        rows.filter(F.col("prediction_accuracy").isNotNull())
        .groupBy(day_label("prediction_date").alias("day"))
        .agg(F.avg("prediction_accuracy").alias("accuracy"))
    )


def dashboard_alerts(voyages: DataFrame, predictions: DataFrame, communications: DataFrame, as_of: str) -> DataFrame:
    """High-risk, overdue and failed-message alerts; only those with something to report."""
    risky = (
        predictions_of_voyages(predictions.filter(F.col("delay_probability") >= 0.8), voyages)
        .filter(is_open())
        .agg(F.count("*").alias("n"))
        .select(F.lit("high_risk").alias("type"), F.lit("high").alias("severity"), F.lit("%d shipments have high delay risk (>80%%)").alias("text"), "n")
    )
    late = voyages.agg(
        F.count_if(is_open() & (F.col("scheduled_arrival") < F.lit(as_of).cast("timestamp_ntz"))).alias("n")
    ).select(F.lit("overdue"), F.lit("critical"), F.lit("%d shipments are overdue"), "n")
    failed = communications.agg(
        F.count_if((F.col("delivery_status") == "failed") & (F.to_date("sent_at") == _day(as_of))).alias("n")
    ).select(F.lit("failed_communications"), F.lit("medium"), F.lit("%d communications failed to deliver today"), "n")
    counts = risky.union(late).union(failed).filter(F.col("n") > 0)
    return counts.select("type", "severity", F.expr("format_string(text, n)").alias("message"), F.col("n").alias("count"))


def table_counts(as_of: str, tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows and rows of the last 24 hours per table; a table without a time column counts none as recent."""
    since = F.expr(f"timestamp_ntz'{as_of}' - interval '1' day")
    parts = [
        df.agg(
            F.lit(name).alias("table"),
            F.count("*").alias("rows"),
            (F.count_if(F.col(ts) >= since) if ts else F.lit(0).cast("bigint")).alias("last_day"),
        )
        for name, (df, ts) in tables.items()
    ]
    return reduce(DataFrame.union, parts)


def activity_on(df: DataFrame, ts: str, as_of: str) -> DataFrame:
    return df.agg(F.count_if(F.to_date(ts) == _day(as_of)).alias("activity"))


def performance_summary(
    voyages: DataFrame, predictions: DataFrame, communications: DataFrame, voyages_as_of: str, messages_as_of: str, days: int = 30
) -> DataFrame:
    delayed = F.count_if(F.col("status") == "delayed")
    ok = F.count_if(F.col("delivery_status") == "delivered")
    return one_row(
        with_accuracy(predictions.filter(F.col("prediction_date") >= _since(voyages_as_of, days))).agg(
            F.count("*").alias("total_predictions"),
            F.coalesce(F.avg("prediction_accuracy"), F.lit(0.0)).alias("average_accuracy"),
            F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("average_confidence"),
        ),
        communications.filter(F.col("sent_at") >= _since(messages_as_of, days)).agg(
            F.count("*").alias("total_communications"),
            ok.alias("successful_deliveries"),
            rate(ok, F.count("*")).alias("communication_success_rate"),
            F.coalesce(F.avg("engagement_score"), F.lit(0.0)).alias("average_engagement"),
        ),
        voyages.filter(F.col("created_at") >= _since(voyages_as_of, days)).agg(
            F.count("*").alias("total_shipments"),
            F.count_if(F.col("status") == "delivered").alias("delivered_shipments"),
            delayed.alias("delayed_shipments"),
            rate(F.count("*") - delayed, F.count("*")).alias("on_time_rate"),
        ),
    )


def communication_statistics(communications: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    recent = communications.filter(F.col("sent_at") >= _since(as_of, days))
    ok, written = F.count_if(F.col("delivery_status") == "delivered"), F.count_if("ai_generated")
    return recent.agg(
        F.count("*").alias("total_communications"),
        ok.alias("successful_deliveries"),
        rate(ok, F.count("*")).alias("delivery_success_rate"),
        rate(written, F.count("*")).alias("ai_generated_percentage"),
    )


def communications_by_type(communications: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return communications.filter(F.col("sent_at") >= _since(as_of, days)).groupBy("type").agg(F.count("*").alias("n"))


def prediction_errors(predictions: DataFrame, voyages: DataFrame, as_of: str, days: int = 30, late_hours: float = 2.0) -> DataFrame:
    """Errors of predictions whose voyage arrived: absolute, squared, and late-or-not."""
    known = predictions_of_voyages(
        predictions.filter((F.col("prediction_date") >= _since(as_of, days)) & F.col("actual_delay_hours").isNotNull()),
        voyages.filter(F.col("actual_arrival").isNotNull()),
    )
    gap = F.col("actual_delay_hours") - F.col("predicted_delay_hours")
    same = (F.col("actual_delay_hours") > late_hours) == (F.col("predicted_delay_hours") > late_hours)
    return known.agg(
        F.count("*").alias("predictions_evaluated"),
        F.avg(F.abs(gap)).alias("mae_hours"),
        F.sqrt(F.avg(gap * gap)).alias("rmse_hours"),
        F.avg(same.cast("double")).alias("classification_accuracy"),
    )


def scoring_summary(scored: DataFrame, label: str | None = None) -> DataFrame:
    """Totals over scored rows; accuracy too when the outcome is known."""
    hit = [F.avg((F.col("will_delay") == F.col(label)).cast("double")).alias("accuracy")] if label else []
    return scored.agg(
        F.count("*").alias("total_shipments"),
        F.count_if("will_delay").alias("predicted_delays"),
        rate(F.count_if("will_delay"), F.count("*"), 1.0).alias("delay_rate"),
        F.avg("delay_probability").alias("average_delay_probability"),
        F.count_if(band_exclusive("delay_probability") == "High").alias("high_risk_shipments"),
        *hit,
    )


def notification_statistics(notifications: DataFrame) -> DataFrame:
    sent, failed = F.count_if(F.col("status") == "sent"), F.count_if(F.col("status") == "failed")
    return notifications.agg(
        F.count("*").alias("total_notifications"),
        sent.alias("sent_notifications"),
        failed.alias("failed_notifications"),
        rate(sent, F.count("*")).alias("success_rate"),
    )


def rule_statistics(rules: DataFrame, alerts: DataFrame) -> DataFrame:
    return one_row(
        rules.agg(F.count("*").alias("total_rules"), F.count_if("enabled").alias("active_rules")),
        alerts.agg(F.count("*").alias("recent_alerts"), F.count_distinct("shipment_id").alias("tracked_shipments")),
    )


def model_performance(predictions: DataFrame, late_hours: float = 2.0) -> DataFrame:
    """Confusion counts and error figures per model and version, over validated predictions."""
    known = predictions.filter(F.col("actual_delay_hours").isNotNull())
    said, was = F.col("predicted_delay_hours") > late_hours, F.col("actual_delay_hours") > late_hours
    gap = F.col("predicted_delay_hours") - F.col("actual_delay_hours")
    counts = known.groupBy("model_name", "model_version").agg(
        F.count("*").alias("total_predictions"),
        F.count_if(said & was).alias("tp"),
        F.count_if(said & ~was).alias("fp"),
        F.count_if(~said & was).alias("fn"),
        F.count_if(~said & ~was).alias("tn"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.avg("confidence_score").alias("mean_confidence"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "model_name", "model_version", "total_predictions",
        rate(tp + tn, F.col("total_predictions"), 1.0).alias("accuracy"),
        rate(tp, tp + fp, 1.0).alias("precision"),
        rate(tp, tp + fn, 1.0).alias("recall"),
        rate(2 * tp, 2 * tp + fp + fn, 1.0).alias("f1"),
        "rmse", "mae", "mean_confidence",
    )
