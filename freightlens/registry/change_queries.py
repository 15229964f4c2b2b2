"""Table changes, messages and fan-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import PREDICTION_ADVICE, VOYAGE_STATUSES
from ..functions.scalars import hours_between, sms_text, valid_phone
from ..operators import changes, joins
from ..operators.cleaning import voyage_rules
from ..operators.voyage_metrics import with_accuracy
from ..plans import messages, voyage_prediction
from ..sources import shapes
from .core import register


def _batch(spark, root):
    """Voyages offered for insert: some late, some without customer, some stored, some with a wrong status."""
    i = F.col("id")
    return shapes.voyages(spark, root).select(
        F.when(i % 11 == 0, i - 11).otherwise(i + F.when(i % 13 == 0, 0).otherwise(10000000)).alias("id"),
        F.when(i % 17 == 0, 99999999).otherwise(F.col("customer_id")).alias("customer_id"),
        F.when(i % 19 == 0, "lost").otherwise(F.col("status")).alias("status"),
        F.when(i % 23 == 0, -1.0).otherwise(F.col("cargo_weight")).alias("cargo_weight"),
        "cargo_value", "origin_port", "destination_port", "scheduled_departure", "scheduled_arrival",
    )


_BATCH_SQL = """SELECT CASE WHEN id % 11 = 0 THEN id - 11 ELSE id + CASE WHEN id % 13 = 0 THEN 0 ELSE 10000000 END END AS id,
  CASE WHEN id % 17 = 0 THEN 99999999 ELSE customer_id END AS customer_id, CASE WHEN id % 19 = 0 THEN 'lost' ELSE status END AS status,
  CASE WHEN id % 23 = 0 THEN -1e0 ELSE cargo_weight END AS cargo_weight FROM voyages"""
_VIOLATIONS = """list_filter([CASE WHEN b.cargo_weight < 0 THEN 'negative_weight' END, CASE WHEN b.status = 'lost' THEN 'unknown_status' END,
    CASE WHEN c.id IS NULL THEN 'unknown_customer_id' END, CASE WHEN v.id IS NOT NULL THEN 'existing_id' END], lambda x: x IS NOT NULL)"""


def _checked(spark, root):
    rules = {**voyage_rules(), "unknown_status": ~F.col("status").isin(*VOYAGE_STATUSES)}
    parents = {"customer_id": (shapes.customers(spark, root), "id")}
    return changes.insert_checked(_batch(spark, root), shapes.voyages(spark, root).select("id"), "id", rules, parents)


@register(
    "insert_accepted",
    "D-01 J-13 C-11",
    f"""SELECT b.id, b.customer_id, b.status FROM ({_BATCH_SQL}) b LEFT JOIN customers c ON c.id = b.customer_id LEFT JOIN voyages v ON v.id = b.id
       WHERE len({_VIOLATIONS}) = 0""",
)
def insert_accepted(spark, root):
    return _checked(spark, root)[0].select("id", "customer_id", "status")


@register(
    "insert_rejected",
    "D-01 J-13 C-11",
    f"""SELECT array_to_string({_VIOLATIONS}, ',') AS violations, count(*) AS n FROM ({_BATCH_SQL}) b
       LEFT JOIN customers c ON c.id = b.customer_id LEFT JOIN voyages v ON v.id = b.id WHERE len({_VIOLATIONS}) > 0 GROUP BY 1""",
)
def insert_rejected(spark, root):
    return _checked(spark, root)[1].groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


@register(
    "partial_update",
    "D-02",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 'New Name' ELSE name END AS name, CASE WHEN id % 5 = 0 THEN NULL ELSE phone END AS phone,
         company FROM customers""",
)
def partial_update(spark, root):
    table = shapes.customers(spark, root).select("id", "name", "phone", "company")
    i = F.col("id")
    named = F.array_compact(F.array(F.when(i % 3 == 0, "name"), F.when(i % 5 == 0, "phone")))
    updates = table.filter((i % 3 == 0) | (i % 5 == 0)).select(
        "id", F.lit("New Name").alias("name"), F.lit(None).cast("string").alias("phone"), named.alias("set_fields")
    )
    return changes.partial_update(table, updates, "id")


@register("soft_delete", "D-03", "SELECT id, is_active AND id % 4 <> 0 AS is_active FROM customers")
def soft_delete(spark, root):
    table = shapes.customers(spark, root).select("id", "is_active")
    return changes.soft_delete(table, table.filter(F.col("id") % 4 == 0), "id")[0]


@register("soft_delete_not_found", "D-03", "SELECT id FROM customers WHERE id % 4 = 0 AND NOT is_active")
def soft_delete_not_found(spark, root):
    table = shapes.customers(spark, root).select("id", "is_active")
    return changes.soft_delete(table, table.filter(F.col("id") % 4 == 0), "id")[1]


def _aging(spark, root):
    return {
        "external_data": shapes.external_data(spark, root),
        "communications": shapes.communications(spark, root),
        "predictions": with_accuracy(shapes.predictions(spark, root)),
    }


_OLD_SQL = """SELECT 'external_data' AS "table", count(*) FILTER (expires_at < TIMESTAMP '2024-01-15') AS old_rows, count(*) AS all_rows FROM external_data
  UNION ALL SELECT 'communications', count(*) FILTER (sent_at < TIMESTAMP '2024-01-15' - INTERVAL 10 DAY), count(*) FROM communications
  UNION ALL SELECT 'predictions', count(*) FILTER (prediction_date < TIMESTAMP '2024-01-15' - INTERVAL 10 DAY AND prediction_accuracy IS NULL), count(*) FROM validated"""


@register("retention_report", "D-04", f'SELECT "table", old_rows FROM ({_OLD_SQL})')
def retention_report(spark, root):
    return changes.retention_report(_aging(spark, root), "2024-01-15 00:00:00", 10)


@register("retention_kept", "D-04", f'SELECT "table", all_rows - old_rows AS kept FROM ({_OLD_SQL})')
def retention_kept(spark, root):
    kept = changes.retention_apply(_aging(spark, root), "2024-01-15 00:00:00", 10)
    parts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("kept")) for name, df in kept.items()]
    return parts[0].union(parts[1]).union(parts[2])


@register(
    "backfill_outcomes",
    "D-05 C-30",
    """SELECT shipment_id, l_linenumber, l_partkey, l_suppkey, predicted_delay_hours, a AS actual_delay_hours,
         CASE WHEN a > 0 THEN greatest(0e0, least(1e0, 1 - abs(predicted_delay_hours - a) / greatest(predicted_delay_hours, a, 1e0))) END AS prediction_accuracy
       FROM (SELECT p.*, CASE WHEN v.id IS NOT NULL THEN greatest(date_diff('second', v.scheduled_arrival, v.actual_arrival) / 3600e0, 0e0) ELSE p.actual_delay_hours END AS a
             FROM predictions p LEFT JOIN (SELECT * FROM voyages WHERE actual_arrival IS NOT NULL) v ON v.id = p.shipment_id)""",
)
def backfill_outcomes(spark, root):
    arrived = shapes.voyages(spark, root).filter(F.col("actual_arrival").isNotNull()).select(
        F.col("id").alias("shipment_id"), hours_between("scheduled_arrival", "actual_arrival").alias("delay_hours")
    )
    return changes.backfill_outcomes(shapes.predictions(spark, root), arrived).select(
        "shipment_id", "l_linenumber", "l_partkey", "l_suppkey", "predicted_delay_hours", "actual_delay_hours", "prediction_accuracy"
    )


_HOURS = "greatest(0e0, (2e0 + 12 * w + 8 * (oc + dc)) * CASE WHEN is_priority THEN 0.7e0 ELSE 1e0 END)"
_FACTORS = ["weather", "port_congestion", "route_history", "cargo_complexity", "priority_handling"]


def _prediction_sql(requests: str) -> str:
    """All columns of a prediction from rows (id, is_priority, cargo_weight, m route mean, w severity, oc and dc congestion)."""
    t = PREDICTION_ADVICE
    advice = f"""list_filter([CASE WHEN h >= 24 THEN '{t["high"][0]}' END, CASE WHEN h >= 24 THEN '{t["high"][1]}' END,
        CASE WHEN h >= 8 AND h < 24 THEN '{t["moderate"][0]}' END, CASE WHEN h >= 8 AND h < 24 THEN '{t["moderate"][1]}' END,
        CASE WHEN weather > 0.3e0 THEN '{t["weather"]}' END, CASE WHEN port_congestion > 0.5e0 THEN '{t["congestion"]}' END,
        CASE WHEN route_history > 0.3e0 THEN '{t["history"]}' END], lambda x: x IS NOT NULL)"""
    return f"""WITH q AS ({requests}),
         r AS (SELECT *, {_HOURS} AS h, w * 0.3e0 AS weather, (oc + dc) / 2 * 0.4e0 AS port_congestion, least(m / 24, 0.5e0) AS route_history,
           CASE WHEN cargo_weight > 20000 THEN 0.2e0 ELSE 0e0 END AS cargo_complexity, CASE WHEN is_priority THEN -0.1e0 ELSE 0e0 END AS priority_handling FROM q)
       SELECT id, h AS predicted_delay_hours, least(h / 24, 1e0) AS delay_probability, 0.7e0 AS confidence_score,
         CASE WHEN h >= 24 AND h / 24 >= 0.7e0 THEN 'high' WHEN h >= 8 AND h / 24 >= 0.5e0 THEN 'medium' WHEN h >= 2 AND h / 24 >= 0.3e0 THEN 'low'
           ELSE 'minimal' END AS risk_level, {", ".join(_FACTORS)},
         CASE WHEN len({advice}) = 0 THEN '{t["default"]}' ELSE array_to_string({advice}, ' | ') END AS advice FROM r"""


def _prediction_columns(out):
    factors = [F.col("factors")[f].alias(f) for f in _FACTORS]
    return out.select(
        "id", "predicted_delay_hours", "delay_probability", "confidence_score", "risk_level", *factors, F.array_join("recommendations", " | ").alias("advice")
    )


_SEASON = "0.5e0 + CASE WHEN month(scheduled_departure) IN (12, 1, 2) THEN 0.2e0 WHEN month(scheduled_departure) IN (6, 7, 8) THEN 0.1e0 ELSE 0e0 END"


@register(
    "predict_voyages",
    "R-20 C-23 C-27 C-28 J-08",
    _prediction_sql(
        f"""SELECT id, is_priority, cargo_weight, coalesce(m, 0) AS m, {_SEASON} AS w, 0.5e0 AS oc, 0.5e0 AS dc FROM voyages v
           LEFT JOIN (SELECT origin_port, destination_port, avg(date_diff('second', scheduled_arrival, actual_arrival) / 3600e0) AS m
             FROM voyages WHERE actual_arrival IS NOT NULL GROUP BY 1, 2) s USING (origin_port, destination_port)"""
    ),
)
def predict_voyages(spark, root):
    v = shapes.voyages(spark, root)
    return _prediction_columns(voyage_prediction.predict_voyages(v, v))


_PORTS = ["Shanghai", "Los Angeles", "Singapore", "Rotterdam", "Hamburg", "Antwerp", "Oslo"]
_PORT_LIST = "[" + ", ".join(f"'{p}'" for p in _PORTS) + "]"
_KNOWN_PORTS = f"""SELECT id, is_priority, cargo_weight, {_PORT_LIST}[1 + customer_id % 7] AS o, {_PORT_LIST}[1 + (customer_id + 1 + id % 5) % 7] AS d,
    date_diff('second', scheduled_arrival, actual_arrival) / 3600e0 AS late, actual_arrival IS NOT NULL AS arrived,
    TIMESTAMP '2024-01-01' + to_minutes(CAST(id % 43200 AS INTEGER)) AS dep, TIMESTAMP '2024-01-08' + to_minutes(CAST(id % 43200 + id % 1440 AS INTEGER)) AS arr FROM voyages"""
_LEVELS = "CASE {0} WHEN 'Shanghai' THEN 0.7e0 WHEN 'Los Angeles' THEN 0.8e0 WHEN 'Singapore' THEN 0.4e0 WHEN 'Rotterdam' THEN 0.3e0 WHEN 'Hamburg' THEN 0.3e0 WHEN 'Antwerp' THEN 0.4e0 ELSE 0.5e0 END"


def _busy(port: str, ts: str) -> str:
    level = _LEVELS.format(port)
    return f"CASE WHEN hour({ts}) BETWEEN 6 AND 18 THEN least({level} + 0.1e0, 1e0) ELSE {level} END"


@register(
    "predict_voyages_external",
    "R-20 J-12 C-25 C-33 J-09",
    _prediction_sql(
        f"""WITH k AS ({_KNOWN_PORTS}), s AS (SELECT o, d, avg(late) AS m FROM k WHERE arrived GROUP BY 1, 2),
           e AS (SELECT event_id AS id, {_PORT_LIST}[1 + user_id % 7] AS port, ts AS created_at, ts + to_minutes(CAST(20 + event_id % 7 * 30 AS INTEGER)) AS expires_at,
             event_id % 60 - 12 AS temperature, user_id % 40 AS wind_speed, event_id % 9 AS precipitation FROM events),
           x AS (SELECT k.id, arg_max({{'t': temperature, 'w': wind_speed, 'p': precipitation}}, (created_at, e.id)) AS f
             FROM k JOIN e ON e.port = k.o AND e.created_at <= k.dep AND k.dep < e.expires_at GROUP BY 1)
         SELECT k.id, is_priority, cargo_weight, coalesce(m, 0) AS m, {_busy('k.o', 'dep')} AS oc, {_busy('k.d', 'arr')} AS dc,
           least(CASE WHEN coalesce(f.t, 20) < 0 OR coalesce(f.t, 20) > 40 THEN 0.3e0 ELSE 0e0 END + CASE WHEN coalesce(f.w, 5) > 25 THEN 0.4e0 ELSE 0e0 END
             + CASE WHEN coalesce(f.p, 0) > 5 THEN 0.3e0 ELSE 0e0 END, 1e0) AS w
         FROM k LEFT JOIN s ON s.o = k.o AND s.d = k.d LEFT JOIN x ON x.id = k.id"""
    ),
)
def predict_voyages_external(spark, root):
    """Voyages between known ports, with the newest valid weather at departure and business-hour congestion."""
    ports = F.array(*[F.lit(p) for p in _PORTS])
    port = lambda n: F.get(ports, (n % 7).cast("int"))
    minutes = lambda day, n: F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(mins=n.cast("int"))
    i, customer = F.col("id"), F.col("customer_id")
    history = shapes.voyages(spark, root).withColumns({"origin_port": port(customer), "destination_port": port(customer + 1 + i % 5)})
    requests = history.withColumns(
        {"scheduled_departure": minutes("2024-01-01 00:00:00", i % 43200), "scheduled_arrival": minutes("2024-01-08 00:00:00", i % 43200 + i % 1440)}
    )
    n, user = F.col("event_id"), F.col("user_id")
    observed = F.struct((n % 60 - 12).cast("double").alias("temperature"), (user % 40).cast("double").alias("wind_speed"), (n % 9).cast("double").alias("precipitation"))
    weather = shapes.table(spark, root, "events").select(
        n.alias("id"), F.lit("weather").alias("data_type"), port(user).alias("data_key"), observed.alias("data_value"),
        F.col("ts").alias("created_at"), (F.col("ts") + F.make_dt_interval(mins=(20 + n % 7 * 30).cast("int"))).alias("expires_at"),
    )
    return _prediction_columns(voyage_prediction.predict_voyages(requests, history, weather))


@register(
    "customer_messages",
    "R-21 J-16 X-09 X-10",
    """WITH m AS (SELECT c.id, CASE c.id % 4 WHEN 0 THEN 'delay_notification' WHEN 1 THEN 'shipment_update' WHEN 2 THEN 'proactive_communication' ELSE 'other' END AS context,
           CASE WHEN c.type = 'email' THEN 'email' ELSE 'sms' END AS channel, v.shipment_id, v.status, coalesce(v.cargo_type, 'general cargo') AS cargo, u.name,
           CASE c.id % 5 WHEN 0 THEN 'port congestion' WHEN 1 THEN 'adverse weather' ELSE 'operational factors' END AS reason, coalesce(CASE WHEN c.id % 3 = 0 THEN v.origin_port END, 'n/a') AS place, u.email, u.phone, l.predicted_delay_hours AS h, v.origin_port, v.destination_port,
           v.scheduled_arrival, v.scheduled_arrival + to_seconds(CAST(floor(l.predicted_delay_hours * 3600) AS BIGINT)) AS eta
         FROM communications c LEFT JOIN voyages v ON v.id = c.shipment_id LEFT JOIN customers u ON u.id = c.customer_id LEFT JOIN latest l ON l.shipment_id = c.shipment_id),
       t AS (SELECT *, strftime(coalesce(eta, scheduled_arrival), '%Y-%m-%d %H:%M') AS e, printf('%.1f', coalesce(h, 0)) AS hh,
         shipment_id IS NOT NULL AND name IS NOT NULL AS known FROM m),
       b AS (SELECT *, CASE WHEN context = 'delay_notification' AND channel = 'email' THEN 'Dear ' || name || ', shipment ' || shipment_id || ' (' || cargo || ') from ' || origin_port || ' to ' || destination_port || ', due ' || strftime(scheduled_arrival, '%Y-%m-%d %H:%M') || ', is expected ' || hh || ' hours late due to ' || reason || '. Revised ETA: ' || e || '. Our team is working to minimize any impact to your delivery schedule. We apologize for the inconvenience.'
           WHEN context = 'delay_notification' THEN 'Shipment ' || shipment_id || ' may be delayed by ' || hh || 'h due to ' || reason || '. New ETA: ' || e || '. We apologize for any inconvenience.'
           WHEN context = 'shipment_update' AND channel = 'email' THEN 'Dear ' || name || ', the current status of shipment ' || shipment_id || ' is ' || status || '. Location: ' || place || '. Updated ETA: ' || e || '.'
           WHEN context = 'shipment_update' THEN 'Shipment ' || shipment_id || ' status: ' || status || '. Location: ' || place || '. ETA: ' || e || '.'
           WHEN context = 'proactive_communication' AND channel = 'email' THEN 'Dear ' || name || ', shipment ' || shipment_id || ' is progressing well and remains on schedule for ' || strftime(scheduled_arrival, '%Y-%m-%d %H:%M') || '. Location: ' || place || '. No delays are anticipated at this time.'
           ELSE 'Dear ' || name || ', we have an update regarding your shipment ' || shipment_id || '. Please contact our customer service team for more information.' END AS body FROM t)
       SELECT id, CASE WHEN NOT known THEN 'Shipment Update' WHEN context = 'delay_notification' AND channel = 'email' THEN 'Important Update: Shipment ' || shipment_id || ' Delay Notification'
           WHEN context = 'shipment_update' AND channel = 'email' THEN 'Shipment ' || shipment_id || ' Status Update'
           WHEN context = 'proactive_communication' AND channel = 'email' THEN 'Proactive Update: Your Shipment ' || shipment_id ELSE 'Shipment ' || shipment_id || ' Update' END AS subject,
         CASE WHEN NOT known THEN 'We have an update regarding your shipment. Please contact our customer service team for more information.'
           WHEN channel = 'email' THEN body || chr(10) || chr(10) || '---' || chr(10) || 'For questions or concerns, contact our customer service.'
           WHEN length(body) > 160 THEN substr(body, 1, 157) || '...' ELSE body END AS message,
         CASE WHEN NOT known THEN 'customer@example.com' WHEN channel = 'email' THEN email ELSE phone END AS recipient,
         CASE WHEN known AND (channel = 'sms' OR email IS NULL) THEN 'failed' ELSE 'pending' END AS outbox_status FROM b""",
)
def customer_messages(spark, root):
    i = F.col("id")
    requests = shapes.communications(spark, root).select(
        "id", F.col("shipment_id").alias("shipment_key"), "customer_id",
        F.when(i % 4 == 0, "Delay Notification").when(i % 4 == 1, "shipment_update").when(i % 4 == 2, "proactive_communication").otherwise("other").alias("context"),
        F.when(F.col("type") == "email", "email").otherwise("sms").alias("channel"),
        F.when(i % 5 == 0, "port congestion").when(i % 5 == 1, "adverse weather").alias("primary_reason"),
    )
    contexts = joins.message_context(
        requests, shapes.voyages(spark, root), shapes.customers(spark, root), shapes.predictions(spark, root)
    )
    contexts = contexts.withColumn("current_location", F.when(i % 3 == 0, F.col("origin_port")))
    return messages.customer_messages(contexts).select("id", "subject", "message", "recipient", "outbox_status")


@register(
    "phone_and_text_checks",
    "X-10",
    """SELECT id, false AS short_number, phone IS NOT NULL AS valid, CASE WHEN length(repeat(name, 8)) > 160 THEN substr(repeat(name, 8), 1, 157) || '...' ELSE repeat(name, 8) END AS text,
         true AS bracketed FROM customers""",
)
def phone_and_text_checks(spark, root):
    return shapes.customers(spark, root).select(
        "id", valid_phone("phone").alias("short_number"),
        valid_phone(F.concat("phone", F.lit("-12"))).alias("valid"), sms_text(F.repeat("name", F.lit(8))).alias("text"),
        valid_phone(F.lit("+1 (555) 000-1234")).alias("bracketed"),
    )


def recipients(spark, root):
    """The address book: one recipient per company, some inactive, one preference switched off."""
    companies = shapes.customers(spark, root).select("company").distinct()
    number = F.substring_index("company", " ", -1).cast("int")
    return companies.select(
        F.col("company").alias("recipient_id"),
        (number != 9).alias("active"),
        F.when(number == 3, F.create_map(F.lit("delay_prediction"), F.lit(False)))
        .when(number == 4, F.create_map().cast("map<string,boolean>"))
        .otherwise(messages.default_preferences())
        .alias("preferences"),
    )


def alert_frame(spark, root):
    """Alerts from readings: high probability rows and delayed rows; every third names its recipients."""
    i = F.col("id")
    from ..operators import cleaning

    rows = cleaning.scored(shapes.readings(spark, root))
    kind = F.when(F.col("delay_probability") > 0.8, "delay_prediction").when(F.col("shipment_status") == "Delayed", "status_change")
    return rows.withColumn("type", kind).filter(F.col("type").isNotNull()).select(
        "id", "type", F.col("id").cast("string").alias("shipment_id"), "asset_id", "delay_probability",
        F.lit("High").alias("risk_level"), F.lit("In Transit").alias("old_status"), F.col("shipment_status").alias("new_status"),
        F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("component"), F.lit(None).cast("string").alias("details"),
        F.when(i % 3 == 0, F.array(F.lit("Company 1"), F.lit("Company 9"))).alias("recipients"),
    )


_ALERTS = """SELECT id, CASE WHEN delay_probability > 0.8e0 THEN 'delay_prediction' ELSE 'status_change' END AS type, asset_id, delay_probability, shipment_status
  FROM scored WHERE delay_probability > 0.8e0 OR shipment_status = 'Delayed'"""


@register(
    "alert_rows",
    "E-13 X-09",
    f"""SELECT id, CASE type WHEN 'delay_prediction' THEN 'High Delay Risk Alert - ' || asset_id ELSE 'Status Update - ' || asset_id END AS title,
         CASE type WHEN 'delay_prediction' THEN 'Shipment: ' || id || ', Asset: ' || asset_id || ', Delay Probability: ' || printf('%.1f', delay_probability * 100) || '%, Risk Level: High'
           ELSE 'Shipment: ' || id || ', Status: In Transit to ' || shipment_status END AS message,
         CASE type WHEN 'delay_prediction' THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
         CASE type WHEN 'delay_prediction' THEN 'email,webhook' ELSE 'email' END AS channels FROM ({_ALERTS})""",
)
def alert_rows(spark, root):
    out = messages.alert_rows(alert_frame(spark, root))
    return out.select("id", "title", "message", "priority", F.array_join("channels", ",").alias("channels"))


_FAN = f"""WITH a AS ({_ALERTS}), p AS (SELECT DISTINCT company AS recipient_id, CAST(split_part(company, ' ', 2) AS INTEGER) AS n FROM customers)
  SELECT a.id, p.recipient_id, ch.channel FROM a JOIN p ON n <> 9 AND NOT (n = 3 AND type = 'delay_prediction') AND (a.id % 3 <> 0 OR p.recipient_id IN ('Company 1', 'Company 9'))
  JOIN (VALUES ('delay_prediction', 'email'), ('delay_prediction', 'webhook'), ('status_change', 'email')) ch(kind, channel) ON ch.kind = a.type"""


@register("alert_fan_out", "J-14 E-12", _FAN)
def alert_fan_out(spark, root):
    out = messages.fan_out(messages.alert_rows(alert_frame(spark, root)), recipients(spark, root), ["email", "webhook"])
    return out.select("id", "recipient_id", "channel")


@register(
    "deferred_due",
    "E-10",
    """SELECT id, sent_at FROM communications WHERE id % 4 <> 0 OR sent_at + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-20'""",
)
def deferred_due(spark, root):
    outbox = shapes.communications(spark, root).withColumn(
        "scheduled_for", F.when(F.col("id") % 4 == 0, F.expr("sent_at + interval '6' hour"))
    )
    return messages.due(outbox, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("id", "sent_at")


@register(
    "retry_selection",
    "E-11",
    """SELECT id, id % 5 + 1 AS retry_count, 'pending' AS status FROM communications WHERE delivery_status = 'failed' AND id % 5 < 3""",
)
def retry_selection(spark, root):
    outbox = shapes.communications(spark, root).select(
        "id", F.col("delivery_status").alias("status"), (F.col("id") % 5).alias("retry_count")
    )
    return messages.to_retry(outbox)
