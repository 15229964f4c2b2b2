"""Joins that broadcast a side only after counting it, and Python batches of bounded bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a side that may be broadcast; the callers' rows are a few numbers or a short text each.
BROADCAST_ROWS = 200_000


def by_size(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``small``, a written table of narrow rows, without moving ``big`` where its counted size allows.

    Beyond ``limit`` rows it is a shuffled join, which splits skewed partitions; the
    rows are the same either way.
    """
    return big.join(F.broadcast(small) if small.count() <= limit else small, on, how)


#: Bytes of one batch between the JVM and a Python task.
BATCH_BYTES = 4 << 20


def bounded_batches(spark) -> None:
    """Lower the session's bytes per Arrow batch to ``BATCH_BYTES``, so that rows of long texts don't add up in memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def free_name(taken: list[str], name: str) -> str:
    """``name``, longer by underscores until no column has it in any case of letters."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
