"""Filters, pages, lookups and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning, filters
from ..sources import shapes
from .core import register

EVENTS_AS_OF = "2024-01-31 00:00:00"
VOYAGES_AS_OF = "2001-08-02 00:00:00"


@register(
    "shipments_filtered_page",
    "F-01 T-01",
    """SELECT id, asset_id, ts, shipment_status, logistics_delay_reason FROM readings
       WHERE is_active AND logistics_delay AND traffic_status = 'Heavy' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-29'
       ORDER BY ts DESC, id LIMIT 100 OFFSET 50""",
)
def shipments_filtered_page(spark, root):
    rows = filters.select_shipments(
        shapes.readings(spark, root), delayed=True, traffic="Heavy", start="2024-01-03", end="2024-01-28"
    )
    return filters.page(rows, "ts", "id", limit=100, offset=50).select(
        "id", "asset_id", "ts", "shipment_status", "logistics_delay_reason"
    )


@register(
    "shipments_filtered",
    "F-01",
    "SELECT id, asset_id, ts FROM readings WHERE is_active AND shipment_status = 'In Transit' AND traffic_status = 'Clear'",
)
def shipments_filtered(spark, root):
    rows = filters.select_shipments(shapes.readings(spark, root), status="In Transit", traffic="Clear")
    return rows.select("id", "asset_id", "ts")


@register(
    "date_window",
    "F-02",
    """SELECT id, ts FROM readings WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""",
)
def date_window(spark, root):
    return filters.date_window(shapes.readings(spark, root), "2024-01-05", "2024-01-12").select("id", "ts")


@register(
    "point_lookup",
    "F-03",
    """SELECT id, asset_id, shipment_status, ts FROM readings
       WHERE is_active AND id = (SELECT max(id) FROM readings WHERE is_active)""",
)
def point_lookup(spark, root):
    rows = shapes.readings(spark, root)
    newest = rows.filter("is_active").agg(F.max("id")).scalar()
    return filters.by_id(rows, newest).select("id", "asset_id", "shipment_status", "ts")


@register(
    "recent_delayed",
    "F-04",
    """SELECT id, asset_id, ts FROM readings WHERE is_active AND logistics_delay
         AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR""",
)
def recent_delayed(spark, root):
    return filters.recent_delayed(shapes.readings(spark, root), EVENTS_AS_OF, 72).select("id", "asset_id", "ts")


_PAGE = """SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order} DESC, {key}) AS rn FROM {src})
WHERE rn <= {n}"""


@register(
    "voyage_page_per_status",
    "F-05",
    _PAGE.format(cols="status, id, created_at, rn AS page_rank", by="status", order="created_at", key="id", src="voyages", n=20),
)
def voyage_page_per_status(spark, root):
    rows = filters.page_per_key(shapes.voyages(spark, root), "status", "created_at", "id", 20)
    return rows.select("status", "id", "created_at", "page_rank")


@register(
    "voyages_pending_page",
    "F-05 T-01",
    "SELECT id, customer_id, created_at FROM voyages WHERE status = 'pending' ORDER BY created_at DESC, id LIMIT 50 OFFSET 10",
)
def voyages_pending_page(spark, root):
    rows = filters.voyages_where(shapes.voyages(spark, root), status="pending")
    return filters.page(rows, "created_at", "id", 50, 10).select("id", "customer_id", "created_at")


@register("customers_active", "F-06", "SELECT id, name, email FROM customers WHERE is_active")
def customers_active(spark, root):
    return filters.active_customers(shapes.customers(spark, root)).select("id", "name", "email")


@register(
    "voyages_of_each_customer",
    "F-07",
    """SELECT customer_id, id, created_at, rn AS page_rank FROM (SELECT v.*, row_number() OVER (PARTITION BY v.customer_id
         ORDER BY v.created_at DESC, v.id) AS rn FROM voyages v WHERE v.customer_id IN (SELECT id FROM customers)) WHERE rn <= 20""",
)
def voyages_of_each_customer(spark, root):
    known = shapes.customers(spark, root).select(F.col("id").alias("customer_id"))
    mine = shapes.voyages(spark, root).join(known, "customer_id", "left_semi")
    return filters.page_per_key(mine, "customer_id", "created_at", "id", 20).select("customer_id", "id", "created_at", "page_rank")


@register(
    "prediction_history_pages",
    "F-08",
    """SELECT shipment_id, prediction_date, rn AS page_rank FROM (SELECT *, row_number() OVER (PARTITION BY shipment_id
         ORDER BY prediction_date DESC, l_linenumber) AS rn FROM predictions) WHERE rn <= 5""",
)
def prediction_history_pages(spark, root):
    rows = filters.page_per_key(shapes.predictions(spark, root), "shipment_id", "prediction_date", "l_linenumber", 5)
    return rows.select("shipment_id", "prediction_date", "page_rank")


@register(
    "tracking_history_pages",
    "F-09",
    _PAGE.format(cols="shipment_id, id, event_type, event_timestamp, rn AS page_rank", by="shipment_id",
                 order="event_timestamp", key="id", src="tracking_events", n=10),
)
def tracking_history_pages(spark, root):
    rows = filters.page_per_key(shapes.tracking_events(spark, root), "shipment_id", "event_timestamp", "id", 10)
    return rows.select("shipment_id", "id", "event_type", "event_timestamp", "page_rank")


@register(
    "communications_per_shipment",
    "F-10",
    _PAGE.format(cols="shipment_id, id, type, sent_at, rn AS page_rank", by="shipment_id", order="sent_at", key="id",
                 src="communications", n=10),
)
def communications_per_shipment(spark, root):
    rows = filters.page_per_key(shapes.communications(spark, root), "shipment_id", "sent_at", "id", 10)
    return rows.select("shipment_id", "id", "type", "sent_at", "page_rank")


@register(
    "communications_per_customer",
    "F-10",
    _PAGE.format(cols="customer_id, id, type, sent_at, rn AS page_rank", by="customer_id", order="sent_at", key="id",
                 src="communications", n=10),
)
def communications_per_customer(spark, root):
    rows = filters.page_per_key(shapes.communications(spark, root), "customer_id", "sent_at", "id", 10)
    return rows.select("customer_id", "id", "type", "sent_at", "page_rank")


@register(
    "voyages_overdue",
    "F-11",
    """SELECT id, status, scheduled_arrival FROM voyages
       WHERE status IN ('pending', 'in_transit') AND scheduled_arrival < TIMESTAMP '2001-08-02'""",
)
def voyages_overdue(spark, root):
    return filters.overdue(shapes.voyages(spark, root), VOYAGES_AS_OF).select("id", "status", "scheduled_arrival")


@register(
    "voyages_on_time",
    "F-12",
    "SELECT id, actual_arrival FROM voyages WHERE status = 'delivered' AND actual_arrival <= scheduled_arrival",
)
def voyages_on_time(spark, root):
    return filters.on_time(shapes.voyages(spark, root)).select("id", "actual_arrival")


@register(
    "high_risk_counts",
    "F-13",
    """SELECT 'analysis' AS kind, count(*) AS n FROM predictions WHERE delay_probability > 0.8e0
       UNION ALL SELECT 'list', count(*) FROM predictions WHERE delay_probability >= 0.7e0
       UNION ALL SELECT 'alert', count(*) FROM predictions WHERE delay_probability >= 0.8e0""",
)
def high_risk_counts(spark, root):
    p = F.col("delay_probability")
    one = shapes.predictions(spark, root).agg(
        F.count_if(p > 0.8).alias("analysis"), F.count_if(p >= 0.7).alias("list"), F.count_if(p >= 0.8).alias("alert")
    )
    return one.unpivot([], ["analysis", "list", "alert"], "kind", "n")


@register(
    "high_risk_rows",
    "F-13",
    "SELECT id, delay_probability FROM scored WHERE delay_probability > 0.8e0",
)
def high_risk_rows(spark, root):
    return filters.high_risk(cleaning.scored(shapes.readings(spark, root))).select("id", "delay_probability")


@register(
    "notifying_events",
    "F-14",
    """SELECT id, shipment_id, event_type FROM tracking_events
       WHERE event_type IN ('departed', 'arrived', 'delayed', 'customs_cleared')""",
)
def notifying_events(spark, root):
    return filters.notifying_events(shapes.tracking_events(spark, root)).select("id", "shipment_id", "event_type")


@register(
    "last_notifications",
    "T-07",
    "SELECT id, sent_at, type FROM communications ORDER BY sent_at DESC, id DESC LIMIT 50",
)
def last_notifications(spark, root):
    return filters.last_rows(shapes.communications(spark, root), 50, "sent_at", "id").select("id", "sent_at", "type")
