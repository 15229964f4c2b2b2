"""Connected components by alternating large-star and small-star.

Each round is a grouped minimum and a join over the remaining edges, written to the
shared folder, so lineage stays short and a lost executor costs one round's task.
Nothing is gathered on the driver but two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import discard, new_path


def _write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its smallest node.

    ``edges`` has two id columns u and v; loops, repeats and nulls carry nothing.
    An empty table gives an empty table.
    """
    current, path = _write(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = _mark(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after, after_path = _write(small, "edges")
        discard(current.sparkSession, path)
        seen, mark = mark, _mark(after)
        current, path = after, after_path
        if seen == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
