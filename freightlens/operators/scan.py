"""Running positions and carried values by a distributed prefix scan.

Rows are dealt by ranges of (key, order), so every task gets the same share however many
rows one key has.  A task scans its rows once; the first key of a range may have begun
earlier, and what that key brings along is worked out from one summary row per range.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..session import stored

# task functions travel by value: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns the scan adds while it runs: range, position inside the key's part of the range,
#: whether the key began the range, whether the row ends the range, the value before.
PART, POSITION, HEAD, LAST, BEFORE = "_part", "_position", "_head", "_last", "_before"


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two equally long columns differ; two nulls don't."""
    same = pc.fill_null(pc.equal(a, b), False)
    nulls = pc.and_(pc.is_null(a), pc.is_null(b))
    return ~pc.or_(same, nulls).to_numpy(zero_copy_only=False)


def _shift(column: pa.Array, first: pa.Array) -> pa.Array:
    return pa.concat_arrays([first, column.slice(0, len(column) - 1)])


def _scan(key: str, value: str | None):
    def run(batches):
        part = TaskContext.get().partitionId()
        carried, position, head, held = None, -1, True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key)
            if carried is None:
                previous = _shift(keys, keys.slice(0, 1))
                new = np.append(True, _differs(keys, previous)[1:])
            else:
                new = _differs(keys, _shift(keys, carried[0]))
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            places = np.where(start >= 0, at - start, at + position + 1)
            # the range's first key goes on until another one begins
            switched = new.copy()
            if carried is None:
                switched[0] = False
            heads = np.logical_not(np.maximum.accumulate(switched)) & head
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(places.astype(np.int64)), pa.array(heads), pa.array(np.zeros(n, bool))]
            names = [*batch.schema.names, PART, POSITION, HEAD, LAST]
            if value is not None:
                values = batch.column(value)
                before = _shift(values, carried[1] if carried else pa.nulls(1, values.type))
                columns.append(pc.if_else(pa.array(new), pa.scalar(None, values.type), before))
                names.append(BEFORE)
            if held is not None:
                yield held
            held = pa.RecordBatch.from_arrays(columns, names)
            carried = (keys.slice(n - 1, 1), batch.column(value).slice(n - 1, 1) if value is not None else None)
            position, head = int(places[-1]), bool(heads[-1])
        if held is not None:
            last = np.zeros(held.num_rows, bool)
            last[-1] = True
            yield held.set_column(held.schema.get_field_index(LAST), LAST, pa.array(last))

    return run


def scanned(df: DataFrame, key: str, order: list[str], value: str | None = None) -> DataFrame:
    """Every row with its range, its position inside the key's part of the range and, if asked, the value before it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = [StructField(PART, IntegerType()), StructField(POSITION, LongType()), StructField(HEAD, BooleanType()), StructField(LAST, BooleanType())]
    if value is not None:
        added.append(StructField(BEFORE, df.schema[value].dataType))
    dealt = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    return stored(dealt.mapInArrow(_scan(key, value), StructType([*df.schema.fields, *added])), "scan")


def _summaries(rows: DataFrame, key: str, value: str | None) -> DataFrame:
    """One row per range: what the key that ends it hands on.  There are as many rows as ranges."""
    handed = F.col(value) if value is not None else F.lit(None)
    ends = rows.where(LAST).select(PART, F.col(key).alias("last_key"), (F.col(POSITION) + 1).alias("run"), F.col(HEAD).alias("single"), handed.alias("value"))
    # the first row of a range: position 0 of its first key
    starts = rows.where(F.col(HEAD) & (F.col(POSITION) == 0)).select(PART, F.col(key).alias("first_key"))
    return starts.join(ends, PART)


def _carries(summaries: DataFrame) -> DataFrame:
    """(range, offset, value) for ranges whose first key began earlier: an exclusive scan over the summary rows."""
    w = Window.orderBy(PART)
    goes_on = F.coalesce(F.lag("last_key").over(w).eqNullSafe(F.col("first_key")) & (F.row_number().over(w) > 1), F.lit(False))
    marked = summaries.withColumns({"goes_on": goes_on, "value_before": F.lag("value").over(w), "upto": F.sum("run").over(w)})
    # rows of the ending key: those of this range, and of all ranges before it that this key fills
    chain = F.sum((~(F.col("goes_on") & F.col("single"))).cast("int")).over(w)
    chained = marked.withColumn("chain", chain)
    total = F.sum("run").over(Window.partitionBy("chain").orderBy(PART))
    ended = chained.withColumn("total", total)
    return ended.withColumn("offset", F.lag("total").over(w)).where("goes_on").select(PART, "offset", F.col("value_before").alias("value"))


def _with_carry(rows: DataFrame, key: str, value: str | None) -> DataFrame:
    carries = _carries(_summaries(rows, key, value)).select(F.col(PART), F.lit(True).alias(HEAD), F.col("offset").alias("_offset"), F.col("value").alias("_carry"))
    # one row per range at most, and there are spark.sql.shuffle.partitions ranges
    return rows.join(F.broadcast(carries), [PART, HEAD], "left")


def previous_value(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """``lag`` of a value inside its key; null at the key's first row."""
    rows = _with_carry(scanned(df, key, order, value), key, value)
    before = F.when(F.col(HEAD) & (F.col(POSITION) == 0), F.col("_carry")).otherwise(F.col(BEFORE))
    return rows.withColumn(out, before).select(*df.columns, out)


def row_index(df: DataFrame, key: str, order: list[str], out: str = "row_index") -> DataFrame:
    """0-based position inside the key."""
    rows = _with_carry(scanned(df, key, order), key, None)
    return rows.withColumn(out, F.col(POSITION) + F.coalesce("_offset", F.lit(0))).select(*df.columns, out)
