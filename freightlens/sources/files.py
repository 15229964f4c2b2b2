"""File scans, probes, loads and appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..fixed_values import CSV_COLUMNS, TRAINING_DEFAULTS
from ..functions.scalars import period_label

CSV_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in CSV_COLUMNS])


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, so one bad value never drops or shifts a row."""
    return spark.read.schema(CSV_SCHEMA).option("header", True).option("encoding", "UTF-8").csv(path)


def scan_training_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Training file with an explicit schema; constants stand in for columns it lacks."""
    return with_defaults(spark.read.schema(schema).option("header", True).csv(path))


def with_defaults(df: DataFrame) -> DataFrame:
    missing = {c: F.lit(v) for c, v in TRAINING_DEFAULTS.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def active_rows(df: DataFrame) -> DataFrame:
    return df.filter("is_active") if "is_active" in df.columns else df


def probe(df: DataFrame) -> DataFrame:
    """Row count, size in MB and newest change of the files behind a scan."""
    per_file = df.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count("*").alias("rows"),
        F.max("_metadata.file_size").alias("bytes"),
        F.max("_metadata.file_modification_time").alias("modified"),
    )
    return per_file.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_records"),
        F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / (1024 * 1024), 2).alias("file_size_mb"),
        F.max("modified").alias("last_modified"),
    ).withColumn("status", F.when(F.col("total_records") > 0, "Dataset available").otherwise("Dataset file not found"))


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def bulk_load(df: DataFrame, path: str, replace: bool = False) -> DataFrame:
    """Load once: a populated target is left alone unless ``replace``.  Returns the stored count."""
    df.write.mode("overwrite" if replace else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path).agg(F.count("*").alias("stored_rows"))


def append_predictions(predictions: DataFrame, path: str, feature_columns: list[str], granularity: str = "daily") -> None:
    """Store predictions with their features as JSON, one folder per prediction day (or month, for tables over many years).

    The rebalance hint brings a folder's rows together, so it gets few files, and
    lets adaptive execution split a folder that is too big for one task.
    """
    rows = (
        predictions.withColumn("features_used", F.to_json(F.struct(*feature_columns)))
        .drop(*[c for c in feature_columns if c != "shipment_id"])
        .withColumn("prediction_period", period_label("prediction_date", granularity))
    )
    rows.hint("rebalance", F.col("prediction_period")).write.mode("append").partitionBy("prediction_period").parquet(path)


def delivered_at(status: Column, sent_at: Column) -> Column:
    return F.when(status == "delivered", sent_at)


def append_communications(log: DataFrame, path: str) -> None:
    log.withColumn("delivered_at", delivered_at(F.col("delivery_status"), F.col("sent_at"))).write.mode("append").parquet(path)


def date_range_of_text(df: DataFrame, column: str) -> DataFrame:
    """First and last parseable moment; rows that parse in neither format are skipped."""
    text = F.col(column)
    parsed = F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("MM/dd/yyyy HH:mm")),
        text.try_cast("timestamp"),
    ).cast("timestamp_ntz")
    return df.agg(
        F.date_format(F.min(parsed), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max(parsed), "yyyy-MM-dd").alias("last_day"),
        F.count(parsed).alias("parsed_rows"),
    )


def coverage(df: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Does the table hold rows between two days (both inclusive)?  Verdict as text."""
    first, after = F.lit(start).cast("timestamp_ntz"), F.expr(f"timestamp_ntz'{end}' + interval '1' day")
    found = df.agg(
        F.min(ts).alias("min_timestamp"),
        F.max(ts).alias("max_timestamp"),
        F.count("*").alias("total_records"),
        F.count_if((F.col(ts) >= first) & (F.col(ts) < after)).alias("records_in_range"),
    )
    outside = (F.col("min_timestamp") >= after) | (F.col("max_timestamp") < first)
    return found.withColumn(
        "verdict",
        F.when(F.col("total_records") == 0, "empty")
        .when(F.col("records_in_range") > 0, "ok")
        .when(outside, "outside")
        .otherwise("no match"),
    )


def export_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
