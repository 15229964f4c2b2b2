"""Cool-down: after an emitted alert, the same (rule, shipment) stays silent for a while.

The wait counts from the last *emitted* alert, so which rows are emitted depends
on all earlier ones.  The batch form splits a busy key by time all the same:

1. per (key, chunk): for every row a chain could enter at, where that chain ends;
2. these tables are functions from "silent until" at a chunk's start to "silent until" at
   its end, and such functions compose: groups of ``FAN`` neighbours are composed level by
   level up to one table per key, and then each level hands the moment down to its parts,
   so no group holds more than ``FAN`` tables however many chunks a key has;
3. per (key, chunk): emit, starting from that moment.

Keys below ``busy_rows`` rows have a single chunk and skip the first two steps.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import stored

NEVER = -(2**62)
#: Tables composed at once, a power of two.
FAN = 64
#: Added to chunk numbers, so that chunks before 1970 meet the others in one tree.
FIRST = 1 << 40

# task functions travel by value: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["_us", "_tie"], kind="mergesort", ignore_index=True)


def _next(us: np.ndarray, wait: np.ndarray) -> np.ndarray:
    """Position of the first row that may be emitted after each row."""
    return np.searchsorted(us, us + wait, side="left")


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by (key, chunk, time); only the running group's silent time is carried along."""
    group, silent = None, NEVER
    for pdf in batches:
        key, chunk, us = (pdf[c].to_numpy() for c in ("_key", "_chunk", "_us"))
        wait, first = pdf["_wait"].to_numpy(), pdf["_silent"].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        picked: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(us)]):
            if a == b:
                continue
            if (key[a], chunk[a]) != group:
                group, silent = (key[a], chunk[a]), int(first[a])
            i = a + int(np.searchsorted(us[a:b], silent, side="left"))
            while i < b:
                picked.append(i)
                silent = int(us[i] + wait[i])
                i = max(a + int(np.searchsorted(us[a:b], silent, side="left")), i + 1)  # a zero wait still moves on
        if picked:
            yield pdf.iloc[picked][["_key", "_us", "_tie"]]


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk: entry bounds and the time of the last alert of a chain entering there."""
    rows = _sorted(pdf)
    us, wait = rows["_us"].to_numpy(), int(rows["_wait"].iloc[0])
    n = len(us)
    follow = np.maximum(_next(us, np.int64(wait)), np.arange(n) + 1)
    last = np.where(follow < n, follow, np.arange(n))
    while True:  # pointer doubling: log2(chain length) rounds
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    start = int(rows["_chunk"].iloc[0]) * int(rows["_chunk_us"].iloc[0])
    entries = min(int(np.searchsorted(us, start + wait, side="left")), n - 1) + 1
    ends = us[last[:entries]]
    keep = np.append(ends[1:] != ends[:-1], True)
    return pd.DataFrame(
        {
            "_key": [rows["_key"].iloc[0]],
            "_part": [int(rows["_chunk"].iloc[0]) + FIRST],
            "_wait": [wait],
            "_start": [start],
            "_upper": [us[:entries][keep].tolist()],
            "_end": [ends[keep].tolist()],
        }
    )


def _after(silent: int, wait: int, upper: np.ndarray, end: np.ndarray) -> int:
    """Until when a chunk leaves its key silent, given until when it starts out silent."""
    i = int(np.searchsorted(upper, silent, side="left"))
    return int(end[i]) + wait if i < len(end) else silent


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tables of neighbours as one table; the first chunk's entry bounds go through all later ones."""
    rows = pdf.sort_values("_part", kind="mergesort")
    key, wait = rows["_key"].iloc[0], int(rows["_wait"].iloc[0])
    upper, end = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for own_upper, own_end in zip(rows["_upper"], rows["_end"]):
        own_upper, own_end = np.asarray(own_upper, np.int64), np.asarray(own_end, np.int64)
        # chains that ended here go on in this chunk where it has a row late enough
        at = np.searchsorted(own_upper, end + wait, side="left")
        end = np.where(at < len(own_end), own_end[np.minimum(at, len(own_end) - 1)], end)
        # whoever meets no row of the earlier chunks meets this one first
        beyond = own_upper > (upper[-1] if len(upper) else NEVER)
        upper, end = np.append(upper, own_upper[beyond]), np.append(end, own_end[beyond])
        keep = np.append(end[1:] != end[:-1], True)
        upper, end = upper[keep], end[keep]
    # nobody starts out silent for longer than one wait
    used = int(np.searchsorted(upper, int(rows["_start"].iloc[0]) + wait, side="left")) + 1
    return pd.DataFrame(
        {
            "_key": [key], "_part": [int(rows["_part"].iloc[0]) >> FAN.bit_length() - 1], "_wait": [wait], "_start": [int(rows["_start"].iloc[0])],
            "_upper": [upper[:used].tolist()], "_end": [end[:used].tolist()],
        }
    )


def _hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
    """Until when each part of a group starts out silent, from the group's own moment."""
    rows = pdf.sort_values("_part", kind="mergesort")
    silent, out = int(rows["_silent"].iloc[0]), []
    for wait, upper, end in zip(rows["_wait"], rows["_upper"], rows["_end"]):
        out.append(silent)
        silent = _after(silent, int(wait), np.asarray(upper, np.int64), np.asarray(end, np.int64))
    return pd.DataFrame({"_key": rows["_key"].to_numpy(), "_part": rows["_part"].to_numpy(), "_silent": out})


TABLE = "_key string, _part bigint, _wait bigint, _start bigint, _upper array<bigint>, _end array<bigint>"


def _silent_starts(exits: DataFrame) -> DataFrame:
    """(key, part, silent) of every chunk by composing tables up and handing moments down a tree."""
    levels = [stored(exits, "cooldown-level")]
    parent = F.expr(f"shiftright(_part, {FAN.bit_length() - 1})").alias("_part")
    while levels[-1].groupBy("_key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] not in (None, 1):
        levels.append(stored(levels[-1].groupBy("_key", parent).applyInPandas(_compose, TABLE), "cooldown-level"))
    silent = levels[-1].select("_key", "_part", F.lit(NEVER).alias("_silent"))
    for level in reversed(levels[:-1]):
        above = silent.withColumnRenamed("_part", "_parent")
        joined = level.withColumn("_parent", parent.alias("_parent")).join(above, ["_key", "_parent"])
        silent = joined.groupBy("_key", "_parent").applyInPandas(_hand_down, "_key string, _part bigint, _silent bigint")
    return silent


def with_cooldown(
    alerts: DataFrame,
    keys: list[str],
    ts: str,
    minutes: str | int,
    tie: str,
    busy_rows: int = 1_000_000,
    chunk_minutes: int | None = None,
) -> DataFrame:
    """Rows of ``alerts`` that are emitted; ``minutes`` is a number or a column name.

    Alerts of a key with another wait are a chain of their own.  Whether a key is
    walked whole or in chunks doesn't change what is emitted.

    A chunk is by default twice the wait, so few rows of it can be entry rows.
    """
    wait = F.col(minutes) if isinstance(minutes, str) else F.lit(minutes)
    base = alerts.withColumns(
        {
            "_key": F.to_json(F.struct(*keys, wait.alias("_minutes"))),
            "_us": F.unix_micros(F.col(ts).cast("timestamp")),
            "_wait": wait.cast("bigint") * 60_000_000,
            "_tie": F.col(tie).cast("bigint"),
        }
    )
    size = F.lit(chunk_minutes * 60_000_000) if chunk_minutes else F.greatest(F.col("_wait") * 2, F.lit(60_000_000))
    busy = base.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > busy_rows).select("_key", F.lit(True).alias("_busy"))
    # only the columns the walk needs go through Python; emitted rows are matched back afterwards
    lean = (
        base.select("_key", "_us", "_wait", "_tie", size.cast("bigint").alias("_chunk_us"))
        .join(busy, "_key", "left")
        .withColumn("_chunk", F.when(F.col("_busy"), F.floor(F.col("_us") / F.col("_chunk_us"))).otherwise(F.lit(0)))
    )
    crowded = lean.filter("_busy").drop("_busy")
    exits = crowded.groupBy("_key", "_chunk").applyInPandas(_exits, TABLE)
    silent = _silent_starts(exits).select("_key", (F.col("_part") - FIRST).alias("_chunk"), "_silent")
    started = lean.join(silent, ["_key", "_chunk"], "left").withColumn("_silent", F.coalesce("_silent", F.lit(NEVER)))
    emitted = (
        started.select("_key", "_chunk", "_us", "_tie", "_wait", "_silent")
        .repartition("_key", "_chunk")
        .sortWithinPartitions("_key", "_chunk", "_us", "_tie")
        .mapInPandas(_emit, "_key string, _us bigint, _tie bigint")
    )
    return base.join(emitted, ["_key", "_us", "_tie"], "left_semi").drop("_key", "_us", "_wait", "_tie")
