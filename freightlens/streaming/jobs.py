"""Stream transformations; those without custom state run unchanged on batch frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.risk import band_exclusive
from ..functions.scalars import drop_nulls, rate
from ..operators.cleaning import scored
from ..operators.filters import notifying_events
from ..session import new_path
from ..sources.shapes import readings_from_events

NOTIFY_STATUSES = {"notify_on_delay": "Delayed", "notify_on_delivery": "Delivered", "notify_on_cancellation": "Cancelled"}


def updates(events: DataFrame) -> DataFrame:
    """Shipment updates with probability and band."""
    return scored(readings_from_events(events)).withColumn("risk_level", band_exclusive("delay_probability"))


def risky_updates(rows: DataFrame, bound: float = 0.8) -> DataFrame:
    return rows.filter(F.col("delay_probability") >= bound)


def delay_risk_alerts(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows that meet an enabled delay-risk rule; bounds come from the rule table.

    The rule table is a handful of rows; it meets the rows through an equi join
    on the band the rule asks for.
    """
    wanted = rules.filter(F.col("enabled") & (F.col("trigger") == "high_delay_risk")).select(
        "rule", "priority", "cooldown_minutes",
        F.col("conditions")["risk_level"].alias("risk_level"),
        F.col("conditions")["min_delay_probability"].cast("double").alias("bound"),
    )
    return rows.join(wanted, "risk_level").filter(F.col("delay_probability") >= F.col("bound")).drop("bound")


def prediction_alerts(rows: DataFrame, bound: float = 0.8) -> DataFrame:
    return rows.filter((F.col("delay_probability") >= bound) & F.col("risk_level").isin("High", "Critical"))


def notify_statuses(changes: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Changes into a status the rule wants to hear of."""
    wanted = [status for flag, status in NOTIFY_STATUSES.items() if conditions.get(flag) == "true"]
    return changes.filter(F.col("new_status").isin(*wanted))


def _window(df: DataFrame, late: str, size: str, slide: str | None = None, ts: str = "ts") -> tuple[DataFrame, Column]:
    watermarked = df.withWatermark(ts, late) if df.isStreaming else df
    return watermarked, F.window(ts, size, slide) if slide else F.window(ts, size)


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def many_high_risks(rows: DataFrame, size: str = "1 hour", late: str = "1 hour", count: int = 3, percent: float = 30.0) -> DataFrame:
    """Windows with at least ``count`` risky rows or a risky share of ``percent``."""
    df, w = _window(rows, late, size)
    high = F.count_if(F.col("delay_probability") >= 0.8)
    per = df.groupBy(w).agg(F.count("*").alias("total"), high.alias("high_risk"), rate(high, F.count("*")).alias("share"))
    return _flat(per.filter((F.col("high_risk") >= count) | (F.col("share") >= percent)))


def model_degradation(
    predictions: DataFrame, size: str = "7 days", late: str = "1 day", min_accuracy: float = 0.7, max_errors: int = 10
) -> DataFrame:
    """Windows in which validated predictions were too often wrong."""
    known = predictions.filter(F.col("actual_delay_hours").isNotNull()).withColumnRenamed("prediction_date", "ts")
    df, w = _window(known, late, size)
    right = (F.col("predicted_delay_hours") > 2) == (F.col("actual_delay_hours") > 2)
    per = df.groupBy(w).agg(
        F.count("*").alias("total"), F.count_if(~right).alias("errors"), F.avg(right.cast("double")).alias("accuracy")
    )
    return _flat(per.filter((F.col("accuracy") < min_accuracy) | (F.col("errors") > max_errors)))


def errors_per_hour(rows: DataFrame, late: str = "1 hour", bound: int = 5) -> DataFrame:
    """Sliding hours with more than ``bound`` errors."""
    df, w = _window(rows.filter(F.col("shipment_status") == "Delayed"), late, "1 hour", "15 minutes")
    return _flat(df.groupBy(w).agg(F.count("*").alias("errors")).filter(F.col("errors") > bound))


def health_alerts(checks: DataFrame) -> DataFrame:
    """Rows (api_response_time, database_errors_per_hour, ml_service_available) with at least one issue."""
    slow, errors = F.col("api_response_time") > 5.0, F.col("database_errors_per_hour") > 5
    issues = drop_nulls(
        F.when(slow, F.format_string("High API response time: %.2fs", F.bround("api_response_time", 2))),
        F.when(errors, F.concat(F.lit("Database errors: "), F.col("database_errors_per_hour").cast("string"), F.lit("/hour"))),
        F.when(~F.coalesce("ml_service_available", F.lit(True)), "ML service unavailable"),
    )
    found = checks.withColumn("issues", issues).filter(F.size("issues") > 0)
    return found.withColumns(
        {
            "severity": F.when(F.size("issues") > 2, "High").otherwise("Medium"),
            "details": F.array_join("issues", "; "),
            "type": F.lit("system_alert"),
        }
    ).drop("issues")


def tracking_notifications(events: DataFrame, voyages: DataFrame, customers: DataFrame) -> DataFrame:
    """Tracking events worth a message, with voyage and customer (stream-static joins)."""
    v = voyages.select(F.col("id").alias("shipment_id"), "customer_id", "status")
    c = customers.select(F.col("id").alias("customer_id"), "name", "email")
    return notifying_events(events).join(v, "shipment_id").join(c, "customer_id")


def live_kpis(rows: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    df, w = _window(rows, late, size)
    delayed = F.count_if("logistics_delay")
    return _flat(
        df.groupBy(w).agg(
            F.count("*").alias("shipments"),
            delayed.alias("delayed"),
            rate(delayed, F.count("*")).alias("delay_rate"),
            F.avg("delay_probability").alias("avg_probability"),
        )
    )


def without_repeats(stream: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows later than the watermark and repeated ids inside it are dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def deliver_due(spark: SparkSession, stream: DataFrame, out: str, waiting: str, as_of: Column, checkpoint: str | None = None):
    """Per micro-batch: due rows go to ``out``, the rest to ``waiting``.

    A batch also takes up what the one before left waiting.  The batch number names
    the target folder and each folder is overwritten, so a repeated batch leaves the
    same files.  A later run goes on where this one ended if it names the same
    ``checkpoint``; a run without one needs folders of its own.
    """
    from ..plans.messages import due

    def write(batch: DataFrame, number: int) -> None:
        if number:
            held_before = batch.sparkSession.read.schema(batch.schema).parquet(f"{waiting}/batch={number - 1}")
            batch = batch.unionByName(held_before)
        batch = batch.persist()
        ready = due(batch, as_of)
        ready.write.mode("overwrite").parquet(f"{out}/batch={number}")
        held = F.col("scheduled_for").isNotNull() & (F.col("scheduled_for") > as_of)
        batch.filter(held).write.mode("overwrite").parquet(f"{waiting}/batch={number}")
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint or new_path(spark, "deliver"))
        .trigger(availableNow=True)
        .start()
    )


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(spark: SparkSession, stream: DataFrame, label: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over everything there is, into a Parquet table in the shared folder.

    State is kept in RocksDB, beside the heap, so it may outgrow the executors' memory.
    """
    path = new_path(spark, label)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or new_path(spark, f"{label}-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
