"""Keyed streams whose rows must be handled in event-time order, and rows that wait for a time of their own.

State is in the RocksDB store: rows that wait for their turn are packed blocks by hour, so
no more than an hour of a key is in memory at once; what a key remembers is a typed value.  Event-time timers hand over rows once the watermark has passed them and
remove what can't matter any more, so a key that falls silent leaves no state behind.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

# task functions travel by value: executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOUR_US = 3600 * 1_000_000
DAY_US = 24 * HOUR_US


def _rows(pdf: pd.DataFrame, ts: str, columns: list[str]) -> list[tuple]:
    """(microseconds, columns...) with None for nulls and whole numbers as int."""
    us = pdf[ts].astype("datetime64[us]").astype("int64").tolist()
    values = []
    for c in columns:
        known = pdf[c].notna().tolist()
        values.append([v if k else None for v, k in zip(pdf[c].tolist(), known)])
    return list(zip(us, *values))


def _ms(us: int) -> int:
    """The first millisecond that isn't before ``us``."""
    return -(-us // 1000)


@dataclass
class Fold:
    """How a key's rows become output rows.

    ``step(memory, rows) -> (memory, output rows)`` gets rows (microseconds, columns...)
    in order; ``memory`` is a tuple of ``memory_schema`` or None.  ``matters(memory)`` is
    the microsecond from which the memory can't change a result any more.
    """

    memory_schema: str
    step: Callable
    matters: Callable


class InOrder(StatefulProcessor):
    def __init__(self, keys: list[str], ts: str, columns: dict[str, str], output: list[str], fold: Fold):
        self.keys, self.ts, self.columns, self.output, self.fold = keys, ts, columns, output, fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "hour bigint, part bigint", "packed binary")
        self.parts = handle.getValueState("parts", "n bigint")
        self.memory = handle.getValueState("memory", self.fold.memory_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part, first = self.parts.get()[0] if self.parts.exists() else 0, None
        for pdf in rows:
            new = sorted(_rows(pdf, self.ts, list(self.columns)), key=lambda r: r[0])
            for hour, block in groupby(new, lambda r: r[0] // HOUR_US):
                self.waiting.updateValue((hour, part), (pickle.dumps(list(block)),))
            if new:
                part, first = part + 1, new[0][0] if first is None else min(first, new[0][0])
        if first is not None:
            self.parts.update((part,))
            self.handle.registerTimer(_ms(first))
        return iter([])

    def _block(self, places: list[tuple[int, int]]) -> list[tuple]:
        return [tuple(r) for p in places for r in pickle.loads(bytes(self.waiting.getValue(p)[0]))]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        places = sorted((int(k[0]), int(k[1])) for k in self.waiting.keys()) if self.waiting.exists() else []
        memory = tuple(self.memory.get()) if self.memory.exists() else None
        stepped, next_at = False, None
        for _, own in groupby(places, lambda p: p[0]):  # parts in the order they came
            own = list(own)
            block = self._block(own)
            ready = sorted((r for r in block if r[0] <= now), key=lambda r: (r[0], r[1] is not None, r[1]))
            later = [r for r in block if r[0] > now]
            if ready:
                memory, out = self.fold.step(memory, ready)
                stepped = True
                for p in own:
                    self.waiting.removeKey(p)
                if later:
                    self.waiting.updateValue(own[0], (pickle.dumps(later),))
                if out:
                    yield pd.DataFrame([[*key, pd.Timestamp(r[0], unit="us"), *r[1:]] for r in out], columns=self.output)
            if later:
                next_at = min(r[0] for r in later)
                break
        if stepped:
            self.memory.update(memory)
            if next_at is not None:
                self.handle.registerTimer(_ms(next_at))
            else:
                self.parts.clear()
                self.handle.registerTimer(_ms(max(self.fold.matters(memory), now + 1000)))
        elif not places and memory is not None and self.fold.matters(memory) <= now:
            self.memory.clear()

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, keys: list[str], ts: str, columns: dict[str, str], output: str, fold: Fold) -> DataFrame:
    """Apply ``fold`` to each key's rows in event-time order; equal times are ordered by the first of ``columns``.

    Rows that arrive out of order wait until the watermark passes them, so a key holds no
    more rows than the watermark's delay; later rows are dropped, as everywhere.  They wait in
    blocks by hour and leave an hour at a time, so a catch-up batch of any length takes the
    memory of one hour of a key.  A key's memory is removed once the watermark has passed what it matters for.
    """
    names = [c.split()[0] for c in output.split(", ")]
    processor = InOrder(keys, ts, columns, names, fold)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, StructType.fromDDL(output), "Append", "EventTime")


def cooldown(stream: DataFrame, keys: str, minutes: int) -> DataFrame:
    """Emitted alerts of a watermarked stream with columns (keys..., ts, id); ``keys`` is a DDL list."""
    wait = minutes * 60_000_000

    def step(memory, rows):
        last, out = memory[0] if memory else None, []
        for row in rows:
            if last is None or row[0] >= last + wait:
                out.append(row)
                last = row[0]
        return (last,), out

    fold = Fold("last bigint", step, lambda memory: memory[0] + wait)
    names = [k.split()[0] for k in keys.split(", ")]
    return in_order(stream, names, "ts", {"id": "bigint"}, f"{keys}, ts timestamp, id bigint", fold)


def status_changes(stream: DataFrame, forget_days: int = 366) -> DataFrame:
    """Status changes per asset on a watermarked stream with columns (asset_id, ts, id, shipment_status).

    An asset's last status is forgotten ``forget_days`` after its last row; a row that
    comes later starts anew and is no change.
    """

    def step(memory, rows):
        last, out = memory[1] if memory else None, []
        for at, i, status in rows:
            if last is not None and status is not None and status != last:
                out.append((at, i, last, status))
            last = status
        return (rows[-1][0], last), out

    fold = Fold("at bigint, status string", step, lambda memory: memory[0] + forget_days * DAY_US)
    output = "asset_id string, ts timestamp, id bigint, old_status string, new_status string"
    return in_order(stream, ["asset_id"], "ts", {"id": "bigint", "shipment_status": "string"}, output, fold)


# --- deferred release ------------------------------------------------------------------
class Release(StatefulProcessor):
    """Rows of one (bucket, due hour): they leave when the watermark reaches their due time."""

    def __init__(self, due: str, schema: StructType):
        self.due, self.schema = due, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([list(r) for r in rows], columns=self.schema.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            due = pdf[self.due].astype("datetime64[us]").astype("int64")
            ready = pdf[self.due].isna() | (due <= now * 1000)
            if ready.any():
                yield pdf.loc[ready, self.schema.names]
            held = pdf.loc[~ready, self.schema.names].astype(object)
            if len(held):
                self.waiting.appendList([tuple(r) for r in held.where(held.notna(), None).itertuples(index=False)])
                for at in sorted({_ms(t) for t in due[~ready].tolist()}):
                    self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        at = self.schema.names.index(self.due)
        ready = [r for r in waiting if pd.Timestamp(r[at]) <= now]
        if ready:
            later = [r for r in waiting if pd.Timestamp(r[at]) > now]
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            yield self._frame(ready)

    def close(self) -> None:
        pass


def release_when_due(stream: DataFrame, due: str, id_: str, buckets: int = 64) -> DataFrame:
    """Every row of a watermarked stream once the watermark has reached its ``due`` time.

    Rows without a due time, or due already, leave in the batch they come in.  Waiting
    rows are kept by (bucket of ``id_``, hour they are due), so a release touches the rows of
    that hour only and a busy hour is spread over ``buckets``.  Times are timestamps.
    """
    schema = stream.schema
    bucket, hour = (f"{'_' * max(map(len, schema.names))}{c}" for c in ("bucket", "hour"))  # longer than any name
    dealt = stream.withColumns({bucket: F.pmod(F.xxhash64(id_), F.lit(buckets)), hour: F.unix_micros(F.date_trunc("hour", F.coalesce(due, F.timestamp_seconds(F.lit(0)))))})
    return dealt.groupBy(bucket, hour).transformWithStateInPandas(Release(due, schema), schema, "Append", "EventTime")

