"""Table changes as new snapshots: inserts, partial updates, soft deletes, retention, outcomes.

Each function returns the changed table (and what was refused), so the caller
writes it as a new version; nothing is modified in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import MAX_PREDICTION_KEEP_DAYS, MIN_COMMUNICATION_KEEP_DAYS
from ..functions.risk import accuracy_of
from .cleaning import check_rules


def insert_checked(
    batch: DataFrame,
    table: DataFrame,
    key: str,
    rules: dict[str, Column],
    parents: dict[str, tuple[DataFrame, str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows fit to append, and the rest with every reason they were refused.

    Checked are the rules, parent rows, keys already stored and keys repeated in
    the batch (the first row in key-independent order of all columns wins).
    """
    checked = check_rules(batch, rules)
    for column, (parent, parent_key) in (parents or {}).items():
        known = parent.select(F.col(parent_key).alias(column)).distinct().withColumn("_known", F.lit(True))
        missing = F.when(F.col("_known").isNull(), F.array(F.lit(f"unknown_{column}"))).otherwise(F.array().cast("array<string>"))
        checked = checked.join(known, column, "left").withColumn("violations", F.concat("violations", missing)).drop("_known")
    stored = table.select(key).distinct().withColumn("_stored", F.lit(True))
    order = F.xxhash64(*[F.col(c).cast("string") for c in batch.columns])
    checked = checked.withColumn("_order", order)
    # one aggregated row per repeated key: the winner is known before any row is compared with another
    firsts = checked.groupBy(key).agg(F.min("_order").alias("_winner"), F.count("*").alias("_copies")).filter("_copies > 1")
    marked = checked.join(stored, key, "left").join(firsts, key, "left")
    extra = F.array_compact(
        F.array(
            F.when(F.col("_stored").isNotNull(), f"existing_{key}"),
            F.when(F.col("_order") > F.col("_winner"), f"repeated_{key}"),
        )
    )
    done = marked.withColumn("violations", F.concat("violations", extra)).drop("_stored", "_order", "_winner", "_copies")
    good = F.size("violations") == 0
    fit = done.filter(good).select(*batch.columns)
    # of rows equal in every column one is accepted; counting them keeps a much repeated row out of one task
    copies = fit.groupBy(*batch.columns).agg(F.count("*").alias("_n"))
    again = copies.filter("_n > 1").withColumn("_i", F.explode(F.expr("sequence(2, _n)"))).select(*batch.columns, F.array(F.lit(f"repeated_{key}")).alias("violations"))
    return copies.dropDuplicates([key]).select(*batch.columns), done.filter(~good).select(*batch.columns, "violations").unionByName(again)


def partial_update(table: DataFrame, updates: DataFrame, key: str, set_fields: str = "set_fields", order: str | None = None) -> DataFrame:
    """Replace exactly the fields an update names; a named field may be set to null.

    Of several updates of a key, the last by ``order`` that names a field sets it (a
    fixed order of the rows' contents without one), so a table row stays one row.
    """
    fields = [c for c in updates.columns if c not in (key, set_fields, order)]
    last = F.struct(F.col(order) if order else F.lit(0), F.xxhash64(*[F.col(c).cast("string") for c in updates.columns]))
    named = lambda c: F.array_contains(set_fields, c)
    folded = updates.groupBy(key).agg(*[F.max_by(F.struct(F.col(c).alias("v")), F.when(named(c), last)).alias(f"_new_{c}") for c in fields])
    joined = table.join(folded, key, "left")
    changed = {c: F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}")["v"]).otherwise(F.col(c)) for c in fields}
    return joined.withColumns(changed).select(*table.columns)


def soft_delete(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Switch rows off.  Also returns the requested keys with no active row."""
    asked = keys.select(key).distinct()
    marked = table.join(asked.withColumn("_asked", F.lit(True)), key, "left")
    switched = marked.withColumn("is_active", F.col("is_active") & F.col("_asked").isNull()).select(*table.columns)
    return switched, asked.join(table.filter("is_active").select(key), key, "left_anti")


def retention_conditions(as_of: str, days_to_keep: int) -> dict[str, Column]:
    """What the clean-up removes from each table.

    Messages stay when the horizon is at least seven years; unvalidated
    predictions go after the horizon, at the latest after half a year.
    """
    before = lambda days: F.expr(f"timestamp_ntz'{as_of}' - interval '{days}' day")
    old_prediction = F.col("prediction_date") < before(min(days_to_keep, MAX_PREDICTION_KEEP_DAYS))
    return {
        "external_data": F.col("expires_at") < F.lit(as_of).cast("timestamp_ntz"),
        "communications": F.col("sent_at") < before(days_to_keep),
        "predictions": old_prediction & F.col("prediction_accuracy").isNull(),
    }


def retention_report(tables: dict[str, DataFrame], as_of: str, days_to_keep: int) -> DataFrame:
    """Dry run: rows each table would lose."""
    conditions = retention_conditions(as_of, days_to_keep)
    out = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("table"), F.count_if(conditions[name]).alias("old_rows"))
        out = part if out is None else out.union(part)
    return out


def retention_apply(tables: dict[str, DataFrame], as_of: str, days_to_keep: int) -> dict[str, DataFrame]:
    """The kept rows per table."""
    conditions = retention_conditions(as_of, days_to_keep)
    kept = {}
    for name, df in tables.items():
        untouched = name == "communications" and days_to_keep >= MIN_COMMUNICATION_KEEP_DAYS
        kept[name] = df if untouched else df.filter(~F.coalesce(conditions[name], F.lit(False)))
    return kept


def backfill_outcomes(predictions: DataFrame, outcomes: DataFrame, order: str | None = None) -> DataFrame:
    """Actual hours from arrivals (never negative) and the accuracy that follows.

    Of several outcomes of a voyage the last by ``order`` counts, without one the longest delay.
    """
    last = outcomes.groupBy("shipment_id").agg(F.max_by("delay_hours", F.struct(F.col(order or "delay_hours"), F.col("delay_hours"))).alias("delay_hours"))
    known = last.select("shipment_id", F.greatest(F.col("delay_hours"), F.lit(0.0)).alias("_actual"))
    joined = predictions.join(known, "shipment_id", "left")
    actual = F.coalesce("_actual", "actual_delay_hours")
    return joined.withColumn("actual_delay_hours", actual).drop("_actual").withColumn(
        "prediction_accuracy", accuracy_of("predicted_delay_hours", "actual_delay_hours")
    )
