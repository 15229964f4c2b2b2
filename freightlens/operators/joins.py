"""Joins between shipments, customers, predictions, events and external data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import DEFAULT_DELAY_REASON, ROUTE_COMPLEXITY
from ..functions.risk import band_hours, congestion_level
from ..functions.scalars import hours_between, lookup, plus_hours
from ..session import stored
from .filters import is_open


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The newest row of every key.

    ``order`` are ascending-comparable columns, largest wins.  ``max_by`` is a
    partial aggregate: each task keeps one row per key, so a key holding a large
    share of the table is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(best.alias("_row")).select(key, "_row.*")


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """Latest prediction per shipment with a full tie-break."""
    return latest_per_key(
        predictions,
        "shipment_id",
        [
            F.col("prediction_date"),
            -F.col("l_linenumber"),
            -F.col("l_partkey"),
            -F.col("l_suppkey"),
            -F.col("predicted_delay_hours"),
            -F.col("confidence_score"),
        ],
    )


def with_latest_prediction(voyages: DataFrame, predictions: DataFrame) -> DataFrame:
    latest = latest_predictions(predictions).select(
        F.col("shipment_id").alias("id"), "predicted_delay_hours", "delay_probability", "prediction_date"
    )
    return voyages.join(latest, "id", "left")


def recent_shipments(voyages: DataFrame, customers: DataFrame, predictions: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` voyages with customer name and latest prediction; the limit comes first."""
    newest = voyages.orderBy(F.col("created_at").desc(), "id").limit(n)
    names = customers.select(F.col("id").alias("customer_id"), "name")
    mine = predictions.join(newest.select(F.col("id").alias("shipment_id")), "shipment_id", "left_semi")
    named = newest.join(names, "customer_id", "left").withColumn("customer_name", F.coalesce("name", F.lit("Unknown")))
    return with_latest_prediction(named.drop("name"), mine).withColumn("risk_level", band_hours("predicted_delay_hours"))


def track(voyages: DataFrame, events: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per voyage and tracking event, newest event as rank 1, with the voyage's latest prediction.

    A voyage without events has one row with a null event.
    """
    rank = F.row_number().over(Window.partitionBy("shipment_id").orderBy(F.col("event_timestamp").desc(), F.col("id").desc()))
    ranked = events.select(
        "shipment_id", "event_timestamp", F.col("id").alias("event_id"), "event_type", rank.alias("event_rank")
    ).withColumnRenamed("shipment_id", "id")
    return with_latest_prediction(voyages, predictions).join(ranked, "id", "left")


def high_risk_list(voyages: DataFrame, customers: DataFrame, predictions: DataFrame, n: int = 20) -> DataFrame:
    """Top ``n`` predictions by probability first, open voyages among them second."""
    top = (
        predictions.filter(F.col("delay_probability") >= 0.7)
        .orderBy(
            F.col("delay_probability").desc(), "shipment_id", "l_linenumber", "l_partkey", "l_suppkey", "predicted_delay_hours"
        )
        .limit(n)
        .select(F.col("shipment_id").alias("id"), "delay_probability", "predicted_delay_hours")
    )
    names = customers.select(F.col("id").alias("customer_id"), "name")
    return (
        top.join(voyages.filter(is_open()), "id")
        .join(names, "customer_id", "left")
        .withColumn("customer_name", F.coalesce("name", F.lit("Unknown")))
        .drop("name")
        .withColumn("risk_level", F.lit("high"))
    )


def predictions_of_voyages(predictions: DataFrame, voyages: DataFrame) -> DataFrame:
    keep = voyages.select(F.col("id").alias("shipment_id"), "status", "scheduled_arrival", "actual_arrival")
    return predictions.join(keep, "shipment_id")


def asset_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("asset_id").agg(
        F.avg("delay_hours").alias("asset_delay_hours_mean"),
        F.stddev_samp("delay_hours").alias("asset_delay_hours_std"),
        F.count("delay_hours").alias("asset_delay_hours_count"),
        F.avg("fuel_efficiency").alias("asset_fuel_efficiency_mean"),
        F.avg("distance_traveled").alias("asset_distance_traveled_mean"),
    )


def with_asset_statistics(df: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    """Asset averages on every row.

    The statistics side has one row per asset.  No broadcast is forced: adaptive
    execution broadcasts it when its real size allows, and splits a hot asset's
    partition otherwise.
    """
    return df.join(asset_statistics(df) if statistics is None else statistics, "asset_id", "left")


def _with_route_mean(counted: DataFrame) -> DataFrame:
    """The route's mean beside its counted delays; moments around it don't cancel."""
    route = Window.partitionBy("origin_port", "destination_port")
    return counted.withColumn("route_avg_delay", F.sum(F.col("hours") * F.col("n")).over(route) / F.sum("n").over(route))


def route_statistics(voyages: DataFrame) -> DataFrame:
    """Delay figures per port pair from one pass over the arrivals.

    Arrivals are first counted per (route, delay): delays are whole seconds within
    a bounded range, so the exact median and the moments then see few rows per
    route however many voyages a route has.
    """
    hours = hours_between("scheduled_arrival", "actual_arrival")
    counted = (
        voyages.filter(F.col("actual_arrival").isNotNull())
        .groupBy("origin_port", "destination_port", hours.alias("hours"))
        .agg(F.count("*").alias("n"))
    )
    n, x, mean = F.col("n"), F.col("hours"), F.col("route_avg_delay")
    sums = _with_route_mean(counted).groupBy("origin_port", "destination_port", "route_avg_delay").agg(
        F.expr("percentile(hours, 0.5D, n)").alias("route_median_delay"),
        F.sum("n").alias("route_frequency"),
        F.sum((x - mean) * (x - mean) * n).alias("off"),
    )
    variance = F.when(F.col("route_frequency") > 1, F.col("off") / (F.col("route_frequency") - 1))
    return sums.select(
        "origin_port", "destination_port", "route_avg_delay", F.sqrt(variance).alias("route_delay_std"), "route_median_delay", "route_frequency"
    )


def with_route_statistics(voyages: DataFrame, statistics: DataFrame | None = None) -> DataFrame:
    stats = route_statistics(voyages) if statistics is None else statistics
    return voyages.join(stats, ["origin_port", "destination_port"], "left")


def route_history(voyages: DataFrame, last: int | None = None) -> DataFrame:
    """Figures over the arrivals of each route; ``last`` keeps the latest ones only.

    Equal delays are counted first, so a busy route is a short list of values.
    """
    arrived = voyages.filter(F.col("actual_arrival").isNotNull())
    if last is not None:
        w = Window.partitionBy("origin_port", "destination_port").orderBy(F.col("actual_arrival").desc(), "id")
        arrived = arrived.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= last)
    hours = hours_between("scheduled_arrival", "actual_arrival")
    counted = arrived.groupBy("origin_port", "destination_port", hours.alias("hours")).agg(F.count("*").alias("n"))
    n, x = F.col("n"), F.col("hours")
    off = x - F.col("route_avg_delay")
    return (
        _with_route_mean(counted)
        .groupBy("origin_port", "destination_port", "route_avg_delay")
        .agg(
            F.expr("percentile(hours, 0.5D, n)").alias("route_median_delay"),
            F.sqrt(F.sum(off * off * n) / F.sum(n)).alias("route_delay_std"),
            F.max("hours").alias("route_max_delay"),
            F.sum("n").alias("route_frequency"),
        )
    )


def with_route_history(requests: DataFrame, voyages: DataFrame, last: int | None = None) -> DataFrame:
    joined = requests.join(route_history(voyages, last), ["origin_port", "destination_port"], "left")
    return joined.na.fill(
        0, ["route_avg_delay", "route_median_delay", "route_delay_std", "route_max_delay", "route_frequency"]
    )


def with_congestion(df: DataFrame, default: float) -> DataFrame:
    """Congestion at both ports from the fixed table; ``default`` for unknown ports."""
    return df.withColumns(
        {
            "origin_congestion": congestion_level("origin_port", default),
            "destination_congestion": congestion_level("destination_port", default),
        }
    )


def with_route_complexity(df: DataFrame, default: float = 0.5) -> DataFrame:
    """Complexity of a route in either direction."""
    a, b = F.lower("origin_port"), F.lower("destination_port")
    pair = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    known = [("|".join(sorted([o, d])), value) for o, d, value in ROUTE_COMPLEXITY]
    return df.withColumn("complexity", lookup(pair, known, F.lit(default)))


#: Rows of a side that may be broadcast once they are counted; its rows are a few numbers each.
BROADCAST_ROWS = 200_000
def _nodes(start: Column, end: Column) -> Column:
    """The aligned intervals [place * 2^level, (place + 1) * 2^level) that make up [start, end), at most two a level."""

    each = F.transform(
        F.sequence(F.lit(0), F.length(F.bin(end - start))),
        lambda k: F.transform(
            F.array(F.struct(-F.call_function("shiftright", -start, k), F.call_function("shiftright", end, k))),
            lambda x: F.array(
                F.when((x["col1"] < x["col2"]) & (x["col1"] % 2 != 0), F.struct(k.alias("level"), x["col1"].alias("place"))),
                F.when((x["col1"] < x["col2"]) & (x["col2"] % 2 != 0), F.struct(k.alias("level"), (x["col2"] - 1).alias("place"))),
            ),
        ),
    )
    return F.array_compact(F.flatten(F.flatten(each)))


def _placed(edges: DataFrame, asked: DataFrame, key: list[str], slot_seconds: int) -> DataFrame:
    """Both sides with ``place``: how many edges of the key lie at or before the row's moment.

    An interval holds a moment exactly if its places hold the moment's place, so places
    stand for times and are as few as there are edges.  They are counted inside time slots
    and carried from slot to slot by one row each.
    """
    slot = F.floor(F.col("moment") / (slot_seconds * 1_000_000)).alias("slot")
    rows = edges.withColumn("edge", F.lit(1)).unionByName(asked.withColumn("edge", F.lit(0)), allowMissingColumns=True).select("*", slot)
    sizes = rows.groupBy(*key, "slot").agg(F.sum("edge").alias("n"))
    earlier = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, "slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # the default frame takes in all rows of the same moment
    inside = F.sum("edge").over(Window.partitionBy(*key, "slot").orderBy("moment"))
    return rows.withColumn("inside", inside).join(offsets, [*key, "slot"]).withColumn("place", F.col("before") + F.col("inside")).drop("slot", "inside", "before")


def _newest(alive: DataFrame, asked: DataFrame, key: list[str], slot_seconds: int) -> DataFrame:
    """Observations (``edge`` 1, with ``until``) and probes (0), each with ``newest``: the key's observation before it.

    The newest one is found inside time slots; a slot hands its last observation on by one row.
    """
    own = F.struct("at", "tie", "until", "data_value", "created_at")
    slot = F.floor(F.col("moment") / (slot_seconds * 1_000_000)).alias("slot")
    seen = alive.select(*key, F.col("at").alias("moment"), F.lit(1).alias("edge"), own.alias("own"))
    rows = seen.unionByName(asked.withColumn("edge", F.lit(0)), allowMissingColumns=True).select("*", slot)
    # an observation made at the probe's moment counts, so observations go first
    order = [F.col("moment"), F.desc("edge"), F.col("own.tie"), F.col("own.until"), F.col("own.data_value")]
    inside = F.last("own", ignorenulls=True).over(Window.partitionBy(*key, "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    slots = rows.groupBy(*key, "slot").agg(F.max("own").alias("own"))
    earlier = Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    handed = slots.select(*key, "slot", F.last("own", ignorenulls=True).over(earlier).alias("handed"))
    found = rows.withColumn("inside", inside).join(handed, [*key, "slot"])
    return found.select(*key, "moment", "edge", F.col("own.until").alias("until"), F.coalesce("inside", "handed").alias("newest"))


def _older(asked: DataFrame, alive: DataFrame, key: list[str], slot_seconds: int) -> DataFrame:
    """For probes that find one: the newest of the observations of any lifetime that hold the probe's moment.

    Times are replaced by places among the key's own beginnings and ends.  An observation is
    stored under the few aligned intervals that make up its lifetime, at most two per power
    of two, and of each interval only the newest is kept; a probe looks its place up once per
    interval size that occurs.
    """
    same = [*key, "at", "until", "tie"]
    edges = alive.withColumn("moment", F.explode(F.array("at", "until")))
    placed = stored(_placed(edges, asked, key, slot_seconds), "as-of-places")
    lives = placed.where("edge = 1").groupBy(*same).agg(
        F.min("place").alias("first"), F.max("place").alias("past"), F.max("data_value").alias("data_value"), F.max("created_at").alias("created_at")
    )
    spread = lives.select("*", F.explode(_nodes(F.col("first"), F.col("past"))).alias("node"))
    newest = spread.groupBy(*key, "node.level", F.col("node.place").alias("place")).agg(F.max(F.struct("at", "tie", "until", "data_value", "created_at")).alias("found"))
    nodes = stored(newest, "as-of-nodes")
    count, levels = nodes.agg(F.count("*"), F.sort_array(F.collect_set("level"))).first()  # a level is one of 63
    looked = placed.where("edge = 0").select(*key, "moment", "place")
    looked = looked.withColumn("level", F.explode(F.array([F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")))
    looked = looked.withColumn("place", F.call_function("shiftright", "place", "level"))
    hits = looked.join(F.broadcast(nodes) if count <= BROADCAST_ROWS else nodes, [*key, "level", "place"])
    return hits.groupBy(*key, "moment").agg(F.max("found").alias("found"))


def as_of_external(probes: DataFrame, external: DataFrame, default: float | None, time: str = "ts", slot_seconds: int = 3600) -> DataFrame:
    """The newest external value of a key that is still valid at the probe's time.

    Every observation lives from ``created_at`` until before its own ``expires_at``; one
    that lives longer counts again when a newer one has expired.  Equal times are ordered
    by ``id``.  Where the newest observation still lives it is the answer.  Where it has
    expired, only an observation that outlived the one right after it can be, so just these
    are searched by lifetime.  No pairs are formed, a lifetime of years costs a few dozen
    rows, and no Python runs.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    key = ["data_type", "data_key"]
    alive = external.where("expires_at > created_at").select(
        *key, micros("created_at").alias("at"), micros("expires_at").alias("until"), F.col("id").alias("tie"), "data_value", "created_at"
    )
    asked = probes.select(*key, micros(time).alias("moment")).distinct()
    rows = stored(_newest(alive, asked, key, slot_seconds), "as-of-newest")
    lives = F.col("newest.until") > F.col("moment")
    best = rows.where((F.col("edge") == 0) & lives).select(*key, "moment", F.col("newest").alias("found"))
    outlived = rows.where((F.col("edge") == 1) & (F.col("newest.until") > F.col("until"))).select(*key, "newest.*")
    if outlived.limit(1).count():
        expired = rows.where((F.col("edge") == 0) & ~lives).select(*key, "moment")
        best = best.unionByName(_older(expired, outlived, key, slot_seconds))
    best = best.select(*key, F.col("moment").alias("_asked"), F.col("found.data_value").alias("_value"), F.col("found.created_at").alias("observed_at"))
    joined = probes.withColumn("_asked", micros(time)).join(best, [*key, "_asked"], "left")
    return joined.select(*probes.columns, F.coalesce("_value", F.lit(default)).alias("data_value"), "observed_at")


def check_references(rows: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows whose parent exists, and rows whose parent is missing."""
    known = parents.select(F.col(parent_key).alias(key))
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")


def new_and_unique(batch: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a batch whose key is not stored yet; the first of repeated keys wins."""
    firsts = batch.groupBy(key).agg(F.min_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("_row"))
    return firsts.select(key, "_row.*").join(existing.select(key), key, "left_anti")


def message_context(requests: DataFrame, voyages: DataFrame, customers: DataFrame, predictions: DataFrame) -> DataFrame:
    """Request, voyage, customer and delay information side by side, with the shifted arrival and the reason.

    A request may name its ``primary_reason``.
    """
    v = voyages.select(
        F.col("id").alias("shipment_key"), "shipment_id", "origin_port", "destination_port", "scheduled_arrival", "status", "cargo_type"
    )
    c = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"), "company", "email", "phone")
    p = latest_predictions(predictions).select(
        F.col("shipment_id").alias("shipment_key"), "predicted_delay_hours", "delay_probability"
    )
    joined = requests.join(v, "shipment_key", "left").join(c, "customer_id", "left").join(p, "shipment_key", "left")
    reason = F.col("primary_reason") if "primary_reason" in requests.columns else F.lit(None).cast("string")
    return joined.withColumns(
        {
            "new_eta": plus_hours("scheduled_arrival", "predicted_delay_hours"),
            "delay_reason": F.coalesce(reason, F.lit(DEFAULT_DELAY_REASON)),
            "company": F.coalesce("company", F.lit("")),
            "cargo_type": F.coalesce("cargo_type", F.lit("general cargo")),
        }
    )
