"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "freightlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    Shuffle sizing is left to the cluster: adaptive execution coalesces small
    partitions and splits skewed join partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the benchmark."""
    return build_session(
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": memory,
            "spark.ui.enabled": "false",
        },
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one in the warehouse.

    On a cluster a warehouse on the driver's own disk is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not shared_warehouse(spark.sparkContext.master, warehouse):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_scratch"


def shared_warehouse(master: str, warehouse: str) -> bool:
    """Whether every executor sees the warehouse: in local mode always, on a cluster unless it is a local path."""
    return master.startswith("local[") or master == "local" or ("://" in warehouse and not warehouse.startswith("file:"))


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder nobody else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a result once into the shared folder and go on from the written table.

    Later steps neither repeat the work nor depend on executors that held it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of ``stored`` that no later step reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
