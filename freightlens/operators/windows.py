"""Window steps that stay parallel when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .scan import previous_value, row_index


def status_changes(df: DataFrame, key: str = "asset_id", status: str = "shipment_status") -> DataFrame:
    """Rows whose status differs from the key's previous row."""
    before = previous_value(df, key, ["ts", "id"], status, "old_status")
    return before.filter(F.col("old_status") != F.col(status)).withColumnRenamed(status, "new_status")


def sequences(
    df: DataFrame, key: str, order: list[str], features: list[str], target: str, length: int = 10, block: int = 10000
) -> DataFrame:
    """The ``length`` rows before each row, with that row's target.

    Rows are cut into blocks of the key's own index; each block also receives the
    last ``length`` rows of the one before, so blocks are independent.
    """
    indexed = row_index(df, key, order)
    own = F.floor(F.col("row_index") / block)
    tail = F.col("row_index") % block >= block - length
    blocks = indexed.withColumn(
        "_block", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own)))
    ).withColumn("_context", F.col("_block") != own)
    w = Window.partitionBy(key, "_block").orderBy("row_index").rowsBetween(-length, -1)
    windowed = blocks.withColumn("sequence", F.collect_list(F.struct(*features)).over(w))
    return windowed.filter((F.size("sequence") == length) & ~F.col("_context")).select(
        key, "row_index", "sequence", F.col(target).alias("target")
    )


def ranked(df: DataFrame, value: str, tie: str, out: str = "rank") -> DataFrame:
    """Rank a short list (features of one model), largest first."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(F.col(value).desc(), F.col(tie))))
