"""Customer messages and alert fan-out, up to the outbox table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import (
    CONTACT_FOOTER,
    DEFAULT_ACTIONS,
    DEFAULT_DELAY_REASON,
    DEFAULT_PREFERENCES,
    FALLBACK_RECIPIENT,
    FALLBACK_SUBJECT,
    FALLBACK_TEXT,
    MAX_RETRIES,
    NOTIFICATION_TYPES,
    TEMPLATES,
)
from ..functions.scalars import sms_text, valid_phone

def _render(template: str, values: dict[str, Column]) -> Column:
    """The template as one concatenation of its literal pieces and column values."""
    import re

    parts: list[Column] = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{"):
            parts.append(F.coalesce(values[piece[1:-1]].cast("string"), F.lit("n/a")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def customer_messages(contexts: DataFrame, signature: str = CONTACT_FOOTER) -> DataFrame:
    """One outbox row per request.

    ``contexts`` carries the request (context, channel) and the joined voyage,
    customer and delay columns.  An unknown voyage or customer gives the generic
    text; an unknown (context, channel) a short neutral one.
    """
    known = F.col("shipment_id").isNotNull() & F.col("customer_name").isNotNull()
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    values = {
        "shipment_id": F.col("shipment_id"),
        "customer_name": F.col("customer_name"),
        "origin_port": F.col("origin_port"),
        "destination_port": F.col("destination_port"),
        "status": F.col("status"),
        "company": F.coalesce(F.nullif(F.col("company"), F.lit("")), F.lit("your company")) if "company" in contexts.columns else F.lit("your company"),
        "cargo_type": F.col("cargo_type") if "cargo_type" in contexts.columns else F.lit("general cargo"),
        "delay_reason": F.col("delay_reason") if "delay_reason" in contexts.columns else F.lit(DEFAULT_DELAY_REASON),
        "actions": F.col("actions_taken") if "actions_taken" in contexts.columns else F.lit(DEFAULT_ACTIONS),
        "location": F.col("current_location") if "current_location" in contexts.columns else F.lit(None),
        "delay_hours": F.format_string("%.1f", F.coalesce("predicted_delay_hours", F.lit(0.0))),
        "new_eta": stamp(F.coalesce("new_eta", "scheduled_arrival")),
        "scheduled_eta": stamp("scheduled_arrival"),
    }
    neutral_subject = _render("Shipment {shipment_id} Update", values)
    subject, body = neutral_subject, _render(
        "Dear {customer_name}, we have an update regarding your shipment {shipment_id}. "
        "Please contact our customer service team for more information.",
        values,
    )
    context = F.lower(F.replace(F.col("context"), F.lit(" "), F.lit("_")))
    kind = F.when(F.col("channel") == "email", "email").otherwise("sms")
    for (name, channel), (title, text) in TEMPLATES.items():
        here = (context == name) & (kind == channel)
        subject = F.when(here, _render(title, values) if title else neutral_subject).otherwise(subject)
        body = F.when(here, _render(text, values)).otherwise(body)
    is_mail = F.col("channel") == "email"
    full = F.when(is_mail, F.concat(body, F.lit(signature))).otherwise(sms_text(body))
    sent = contexts.withColumns(
        {
            "subject": F.when(known, subject).otherwise(FALLBACK_SUBJECT),
            "message": F.when(known, full).otherwise(FALLBACK_TEXT),
            "recipient": F.when(~known, FALLBACK_RECIPIENT).when(is_mail, F.col("email")).otherwise(F.col("phone")),
        }
    )
    deliverable = F.when(F.col("channel") == "email", F.col("recipient").isNotNull()).otherwise(
        ~known | valid_phone("recipient")
    )
    return sent.withColumn("outbox_status", F.when(deliverable, "pending").otherwise("failed"))


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Title, message, priority and channels per alert type.

    ``alerts`` carries type, shipment_id, asset_id, delay_probability, risk_level,
    old_status, new_status, severity, component and details (null where unused).
    """
    kind = F.col("type")
    title = (
        F.when(kind == "delay_prediction", F.concat(F.lit("High Delay Risk Alert - "), "asset_id"))
        .when(kind == "status_change", F.concat(F.lit("Status Update - "), "asset_id"))
        .when(kind == "high_risk_alert", F.concat(F.lit("Multiple High-Risk Shipments Detected ("), F.col("details"), F.lit(")")))
        .otherwise(F.concat(F.coalesce("details", F.lit("System Alert")), F.lit(" - "), F.coalesce("component", F.lit("System"))))
    )
    percent = F.format_string("%.1f", F.col("delay_probability") * 100)
    message = (
        F.when(
            kind == "delay_prediction",
            F.concat(F.lit("Shipment: "), "shipment_id", F.lit(", Asset: "), "asset_id", F.lit(", Delay Probability: "), percent,
                     F.lit("%, Risk Level: "), "risk_level"),
        )
        .when(
            kind == "status_change",
            F.concat(F.lit("Shipment: "), "shipment_id", F.lit(", Status: "), "old_status", F.lit(" to "), "new_status"),
        )
        .when(kind == "high_risk_alert", F.concat(F.lit("High-Risk Shipments: "), "details"))
        .otherwise(F.concat(F.lit("Severity: "), F.coalesce("severity", F.lit("Medium")), F.lit(", Details: "), F.coalesce("details", F.lit(""))))
    )
    priority, channels = F.lit("MEDIUM"), F.array(F.lit("email"))
    for name, level, ways in NOTIFICATION_TYPES:
        priority = F.when(kind == name, level).otherwise(priority)
        channels = F.when(kind == name, F.array(*[F.lit(w) for w in ways])).otherwise(channels)
    priority = F.when((kind == "system_alert") & (F.col("severity") == "Critical"), "HIGH").otherwise(priority)
    return alerts.withColumns({"title": title, "message": message, "priority": priority, "channels": channels})


def fan_out(alerts: DataFrame, recipients: DataFrame, configured: list[str]) -> DataFrame:
    """One outbox row per alert, active recipient who wants the type, and configured channel.

    ``recipients`` is the address book (recipient_id, active, preferences map).
    Alerts that name nobody go to everybody in it; a preference that was never
    set counts as wanted.
    """
    people = recipients.select("recipient_id", "active", "preferences").filter("active")
    by_name = F.size(F.coalesce("recipients", F.array().cast("array<string>"))) > 0
    named = alerts.filter(by_name).withColumn("recipient_id", F.explode("recipients")).join(people, "recipient_id")
    # people are listed under every type they want, so alerts to everybody meet them through an equi join
    kinds = [name for name, _, _ in NOTIFICATION_TYPES]
    kind = F.when(F.col("type").isin(*kinds), F.col("type")).otherwise("other")
    listed = people.withColumn("_kind", F.explode(F.array(*[F.lit(k) for k in [*kinds, "other"]]))).filter(
        (F.col("_kind") == "other") | F.coalesce(F.try_element_at("preferences", F.col("_kind")), F.lit(True))
    )
    general = alerts.filter(~by_name).withColumn("_kind", kind).join(listed, "_kind").drop("_kind")
    aimed = general.unionByName(named)
    wanted = F.coalesce(F.try_element_at("preferences", F.col("type")), F.lit(True))
    ways = F.array_intersect("channels", F.array(*[F.lit(c) for c in configured]))
    return (
        aimed.filter(wanted)
        .withColumn("channel", F.explode(ways))
        .drop("recipients", "channels", "preferences", "active")
    )


def default_preferences() -> Column:
    return F.create_map(*[x for k, v in DEFAULT_PREFERENCES.items() for x in (F.lit(k), F.lit(v))])


def due(outbox: DataFrame, as_of: Column) -> DataFrame:
    """Rows whose time has come; rows without a schedule are due at once."""
    return outbox.filter(F.col("scheduled_for").isNull() | (F.col("scheduled_for") <= as_of))


def to_retry(outbox: DataFrame, limit: int = MAX_RETRIES) -> DataFrame:
    """Failed rows with tries left, counted up and set to pending."""
    open_ = outbox.filter((F.col("status") == "failed") & (F.col("retry_count") < limit))
    return open_.withColumns({"retry_count": F.col("retry_count") + 1, "status": F.lit("pending")})
