"""One pass over the readings that every report is cut from.

Reports need the same figures by day, ISO week, hour, weekday, asset, status and
reason, and overall.  Each row is expanded into these eight (kind, key) pairs and
aggregated once: the scan happens once, partial aggregation shrinks each task's
output to its distinct keys, and all later steps run on the small result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import day_label, period_label, rate

def _kinds() -> dict[str, Column]:
    return {
        "all": F.lit("all"),
        "day": day_label("ts"),
        "week": period_label("ts", "weekly"),
        "hour": F.format_string("%02d", F.hour("ts")),
        "weekday": F.date_format("ts", "EEEE"),
        "asset": F.col("asset_id"),
        "status": F.col("shipment_status"),
        "reason": F.col("logistics_delay_reason"),
    }


def profile(df: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in _kinds().items()])
    slim = df.select(
        F.inline(pairs), "logistics_delay", "delay_probability", "waiting_time", "shipment_status", "ts"
    )
    late = F.col("logistics_delay")
    return slim.groupBy("kind", "key").agg(
        F.count("*").alias("shipments"),
        F.count_if("logistics_delay").alias("delayed"),
        F.avg("delay_probability").alias("avg_probability"),
        F.avg("waiting_time").alias("avg_wait"),
        F.avg(F.when(late, F.col("delay_probability"))).alias("avg_delayed_probability"),
        F.avg(F.when(late, F.col("waiting_time"))).alias("avg_delayed_wait"),
        F.count_if(F.col("delay_probability") > 0.8).alias("high_risk"),
        F.count_if(~F.col("shipment_status").eqNullSafe("Delivered")).alias("active"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    ).withColumn("delay_rate", rate(F.col("delayed"), F.col("shipments")))


def cut(profiled: DataFrame, kind: str, key: str) -> DataFrame:
    """The figures of one kind, its key under a proper name."""
    return profiled.filter(F.col("kind") == kind).drop("kind").withColumnRenamed("key", key)
