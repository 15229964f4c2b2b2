"""Dashboard, administration and model figures over voyages, predictions and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import voyage_metrics as vm
from ..sources import shapes
from .core import register
from .filter_queries import EVENTS_AS_OF, VOYAGES_AS_OF
from .metric_queries import rows

_DELAY = "date_diff('second', scheduled_arrival, actual_arrival) / 3600e0"
_V = "TIMESTAMP '2001-08-02'"
_E = "TIMESTAMP '2024-01-31'"
BUSY_DAY = "2000-06-15 00:00:00"
BUSY_EVENT_DAY = "2024-01-15 00:00:00"


def four(spark, root):
    return (
        shapes.voyages(spark, root),
        shapes.customers(spark, root),
        shapes.predictions(spark, root),
        shapes.communications(spark, root),
    )


@register(
    "dashboard_statistics",
    "A-28 F-12",
    f"""SELECT * FROM (SELECT count(*) AS total_shipments, count(*) FILTER (status IN ('pending', 'in_transit')) AS active_shipments,
         count(*) FILTER (status = 'delayed') AS delayed_shipments,
         count(*) FILTER (status = 'delivered' AND actual_arrival <= scheduled_arrival) AS on_time_shipments,
         avg({_DELAY}) FILTER (actual_arrival > scheduled_arrival) AS average_delay_hours FROM voyages),
       (SELECT count(*) FILTER (is_active) AS total_customers FROM customers),
       (SELECT count(*) FILTER (CAST(prediction_date AS DATE) = DATE '2000-06-15') AS predictions_today,
         avg(prediction_accuracy) AS delay_prediction_accuracy FROM validated),
       (SELECT count(*) FILTER (CAST(sent_at AS DATE) = DATE '2000-06-15') AS communications_sent_today FROM communications)""",
)
def dashboard_statistics(spark, root):
    return vm.dashboard_statistics(*four(spark, root), BUSY_DAY)


@register(
    "daily_voyage_delays",
    "A-29",
    f"""SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS total_shipments, count(*) FILTER (status = 'delayed') AS delayed_shipments,
         100e0 * count(*) FILTER (status = 'delayed') / count(*) AS delay_rate
       FROM voyages WHERE created_at >= {_V} - INTERVAL 365 DAY GROUP BY 1""",
)
def daily_voyage_delays(spark, root):
    return vm.daily_voyage_delays(shapes.voyages(spark, root), VOYAGES_AS_OF, 365)


@register(
    "route_performance",
    "A-30",
    f"""SELECT origin_port, destination_port, count(*) AS total_shipments, avg({_DELAY}) AS avg_delay_hours FROM voyages
       WHERE created_at >= {_V} - INTERVAL 3650 DAY AND actual_arrival IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5
       ORDER BY avg_delay_hours DESC, origin_port, destination_port LIMIT 10""",
)
def route_performance(spark, root):
    return vm.route_performance(shapes.voyages(spark, root), VOYAGES_AS_OF, 3650)


@register(
    "accuracy_by_day",
    "A-31",
    f"""SELECT strftime(prediction_date, '%Y-%m-%d') AS day, avg(prediction_accuracy) AS accuracy FROM validated
       WHERE prediction_date >= {_V} - INTERVAL 3650 DAY AND prediction_accuracy IS NOT NULL GROUP BY 1""",
)
def accuracy_by_day(spark, root):
    return vm.accuracy_by_day(shapes.predictions(spark, root), VOYAGES_AS_OF, 3650)


@register(
    "dashboard_alerts",
    "A-32",
    f"""WITH c AS (SELECT 'high_risk' AS type, 'high' AS severity, ' shipments have high delay risk (>80%)' AS t, count(*) AS n
         FROM predictions p JOIN voyages v ON v.id = p.shipment_id WHERE delay_probability >= 0.8e0 AND status IN ('pending', 'in_transit')
       UNION ALL SELECT 'overdue', 'critical', ' shipments are overdue', count(*) FROM voyages
         WHERE status IN ('pending', 'in_transit') AND scheduled_arrival < TIMESTAMP '2024-01-15'
       UNION ALL SELECT 'failed_communications', 'medium', ' communications failed to deliver today', count(*) FROM communications
         WHERE delivery_status = 'failed' AND CAST(sent_at AS DATE) = DATE '2024-01-15')
       SELECT type, severity, CAST(n AS VARCHAR) || t AS message, n AS count FROM c WHERE n > 0""",
)
def dashboard_alerts(spark, root):
    v, _, p, c = four(spark, root)
    return vm.dashboard_alerts(v, p, c, BUSY_EVENT_DAY)


@register(
    "table_counts",
    "A-33",
    f"""SELECT 'shipments' AS "table", count(*) AS rows, count(*) FILTER (created_at >= {_E} - INTERVAL 1 DAY) AS last_day FROM voyages
       UNION ALL SELECT 'customers', count(*), 0 FROM customers
       UNION ALL SELECT 'predictions', count(*), count(*) FILTER (prediction_date >= {_E} - INTERVAL 1 DAY) FROM predictions
       UNION ALL SELECT 'communications', count(*), count(*) FILTER (sent_at >= {_E} - INTERVAL 1 DAY) FROM communications
       UNION ALL SELECT 'external_data', count(*), count(*) FILTER (created_at >= {_E} - INTERVAL 1 DAY) FROM external_data""",
)
def table_counts(spark, root):
    v, c, p, m = four(spark, root)
    return vm.table_counts(
        EVENTS_AS_OF,
        {
            "shipments": (v, "created_at"),
            "customers": (c, None),
            "predictions": (p, "prediction_date"),
            "communications": (m, "sent_at"),
            "external_data": (shapes.external_data(spark, root), "created_at"),
        },
    )


@register(
    "performance_summary",
    "A-34",
    f"""SELECT * FROM (SELECT count(*) AS total_predictions, avg(prediction_accuracy) AS average_accuracy, avg(confidence_score) AS average_confidence
         FROM validated WHERE prediction_date >= {_V} - INTERVAL 3650 DAY),
       (SELECT count(*) AS total_communications, count(*) FILTER (delivery_status = 'delivered') AS successful_deliveries,
         100e0 * count(*) FILTER (delivery_status = 'delivered') / count(*) AS communication_success_rate,
         avg(engagement_score) AS average_engagement FROM communications WHERE sent_at >= {_E} - INTERVAL 3650 DAY),
       (SELECT count(*) AS total_shipments, count(*) FILTER (status = 'delivered') AS delivered_shipments,
         count(*) FILTER (status = 'delayed') AS delayed_shipments, 100e0 * count(*) FILTER (status <> 'delayed') / count(*) AS on_time_rate
         FROM voyages WHERE created_at >= {_V} - INTERVAL 3650 DAY)""",
)
def performance_summary(spark, root):
    v, _, p, m = four(spark, root)
    return vm.performance_summary(v, p, m, VOYAGES_AS_OF, EVENTS_AS_OF, 3650)


@register(
    "communication_statistics",
    "A-35",
    f"""SELECT count(*) AS total_communications, count(*) FILTER (delivery_status = 'delivered') AS successful_deliveries,
         100e0 * count(*) FILTER (delivery_status = 'delivered') / count(*) AS delivery_success_rate,
         100e0 * count(*) FILTER (ai_generated) / count(*) AS ai_generated_percentage
       FROM communications WHERE sent_at >= {_E} - INTERVAL 30 DAY""",
)
def communication_statistics(spark, root):
    return vm.communication_statistics(shapes.communications(spark, root), EVENTS_AS_OF)


@register(
    "communications_by_type",
    "A-35",
    f"SELECT type, count(*) AS n FROM communications WHERE sent_at >= {_E} - INTERVAL 30 DAY GROUP BY 1",
)
def communications_by_type(spark, root):
    return vm.communications_by_type(shapes.communications(spark, root), EVENTS_AS_OF)


@register(
    "prediction_errors",
    "A-36",
    f"""SELECT count(*) AS predictions_evaluated, avg(abs(actual_delay_hours - predicted_delay_hours)) AS mae_hours,
         sqrt(avg(pow(actual_delay_hours - predicted_delay_hours, 2))) AS rmse_hours,
         avg(CASE WHEN (actual_delay_hours > 2) = (predicted_delay_hours > 2) THEN 1e0 ELSE 0e0 END) AS classification_accuracy
       FROM predictions p JOIN voyages v ON v.id = p.shipment_id
       WHERE v.actual_arrival IS NOT NULL AND actual_delay_hours IS NOT NULL AND prediction_date >= {_V} - INTERVAL 3650 DAY""",
)
def prediction_errors(spark, root):
    v, _, p, _ = four(spark, root)
    return vm.prediction_errors(p, v, VOYAGES_AS_OF, 3650)


@register(
    "scoring_summary",
    "A-37",
    """SELECT count(*) AS total_shipments, count(*) FILTER (delay_probability > 0.5e0) AS predicted_delays,
         count(*) FILTER (delay_probability > 0.5e0) * 1e0 / count(*) AS delay_rate, avg(delay_probability) AS average_delay_probability,
         count(*) FILTER (delay_probability > 0.8e0) AS high_risk_shipments,
         avg(CASE WHEN (delay_probability > 0.5e0) = logistics_delay THEN 1e0 ELSE 0e0 END) AS accuracy FROM scored""",
)
def scoring_summary(spark, root):
    scored = rows(spark, root).withColumn("will_delay", F.col("delay_probability") > 0.5)
    return vm.scoring_summary(scored, "logistics_delay")


@register(
    "notification_statistics",
    "A-40",
    """SELECT count(*) AS total_notifications, count(*) FILTER (delivery_status <> 'failed') AS sent_notifications,
         count(*) FILTER (delivery_status = 'failed') AS failed_notifications,
         100e0 * count(*) FILTER (delivery_status <> 'failed') / count(*) AS success_rate FROM communications""",
)
def notification_statistics(spark, root):
    log = shapes.communications(spark, root).select(
        F.when(F.col("delivery_status") == "failed", "failed").otherwise("sent").alias("status")
    )
    return vm.notification_statistics(log)


@register(
    "rule_statistics",
    "A-40",
    """SELECT 5 AS total_rules, 5 AS active_rules, count(*) AS recent_alerts, count(DISTINCT id // 4) AS tracked_shipments
       FROM scored WHERE delay_probability > 0.8e0""",
)
def rule_statistics(spark, root):
    from ..streaming.alerts import rule_table

    alerts = rows(spark, root).filter(F.col("delay_probability") > 0.8).select(F.expr("id div 4").alias("shipment_id"))
    return vm.rule_statistics(rule_table(spark), alerts)


@register(
    "model_performance",
    "A-41",
    """WITH c AS (SELECT model_name, model_version, count(*) AS n, count(*) FILTER (s AND w) AS tp, count(*) FILTER (s AND NOT w) AS fp,
         count(*) FILTER (NOT s AND w) AS fn, count(*) FILTER (NOT s AND NOT w) AS tn, sqrt(avg(g * g)) AS rmse, avg(abs(g)) AS mae,
         avg(confidence_score) AS mean_confidence
       FROM (SELECT *, predicted_delay_hours > 2 AS s, actual_delay_hours > 2 AS w, predicted_delay_hours - actual_delay_hours AS g
         FROM predictions WHERE actual_delay_hours IS NOT NULL) GROUP BY 1, 2)
       SELECT model_name, model_version, n AS total_predictions, (tp + tn) * 1e0 / n AS accuracy,
         CASE WHEN tp + fp > 0 THEN tp * 1e0 / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp * 1e0 / (tp + fn) ELSE 0 END AS recall,
         CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, rmse, mae, mean_confidence FROM c""",
)
def model_performance(spark, root):
    return vm.model_performance(shapes.predictions(spark, root))


@register(
    "activity_on_day",
    "A-42",
    "SELECT count(*) FILTER (CAST(sent_at AS DATE) = DATE '2024-01-15') AS activity FROM communications",
)
def activity_on_day(spark, root):
    return vm.activity_on(shapes.communications(spark, root), "sent_at", BUSY_EVENT_DAY)
