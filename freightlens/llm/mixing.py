"""Source mixing by temperature: tempered weights, realised as permuted blocks.

Each source's share of all tokens is raised to an exponent alpha in [0, 1] and
normalised.  Entropy and the largest repetition both fall as alpha grows, so alpha is
bisected to meet a target; one pass over the per-source totals evaluates 15 inner
points, which is four halvings of the bracket, so sources never meet on the driver.

Every source then yields copies of its documents, epoch after epoch, each epoch in
its own keyed order, until its token budget (weight x total budget) is reached.  A
block takes the same share of every source's budget, and copies inside a block are
permuted by key.  Running totals use sums per hash bucket, so the largest source is
split over many tasks; texts don't take part until the plan is made.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from .joins import by_size, free_name
from .words import WORD

PASSES = 8
BUCKET_ROWS = 2000


def with_tokens(docs: DataFrame) -> DataFrame:
    """Per distinct (doc_id, text, source): its key, source (null: empty), words of all its rows (1 for a row without words)."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    return (
        docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("doc_id", "text", "source").alias("key"), F.greatest(words, F.lit(1)).cast("long").alias("n"))
        .groupBy("doc_id", "source", "key")
        .agg(F.sum("n").alias("n_tokens"))
    )


def curve(totals: DataFrame, alphas: list[float]) -> list[tuple[float, float]]:
    """(entropy in nats, largest over least repetition) at each exponent, in one pass."""
    columns = []
    for i, a in enumerate(alphas):
        p = F.pow("share", F.lit(a))
        columns += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log(p)).alias(f"e{i}"), (F.max(p / F.col("share")) / F.min(p / F.col("share"))).alias(f"r{i}")]
    row = totals.agg(*columns).first()
    return [(math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"], row[f"r{i}"]) if row[f"z{i}"] else (0.0, 1.0) for i in range(len(alphas))]


def exponent(totals: DataFrame, entropy: float | None, repetition: float | None) -> float:
    """The exponent that meets the targets; a repetition limit wins over an entropy.

    For an entropy it is the largest exponent that reaches it (0 if none does), for a
    limit the least that keeps it; without targets 1, the natural shares.
    """

    def end_of(good) -> tuple[float, float]:
        """Bisect for the end of the run of exponents from 0 on that are ``good``: (inside, outside)."""
        lo, hi = 0.0, 1.0
        if good(curve(totals, [hi])[0]):
            return hi, hi
        for _ in range(PASSES):
            at = [lo + (hi - lo) * i / 16 for i in range(1, 16)]
            passed = sum(1 for x in curve(totals, at) if good(x))
            points = [lo, *at, hi]
            lo, hi = points[passed], points[passed + 1]
        return lo, hi

    found = []
    if entropy is not None:
        found.append(end_of(lambda x: x[0] >= entropy)[0])
    if repetition is not None:
        found.append(0.0 if curve(totals, [0.0])[0][1] <= repetition else end_of(lambda x: x[1] > repetition)[1])
    return max(found, default=1.0)


def source_weights(tokens: DataFrame, entropy: float | None, repetition: float | None, budget: int | None) -> DataFrame:
    """One row per source: n_docs, own tokens, weight, target tokens, and the total budget."""
    totals = stored(tokens.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("own")), "totals")
    everything = totals.agg(F.sum("own")).first()[0] or 0
    shares = totals.withColumn("share", F.col("own") / F.lit(float(everything or 1)))
    alpha = exponent(shares, entropy, repetition)
    z, least = shares.agg(F.sum(F.pow("share", F.lit(alpha))), F.min(F.pow("share", F.lit(alpha)) / F.col("own"))).first()
    total = float(budget) if budget is not None else (z or 0.0) / (least or 1.0)
    weight = F.pow("share", F.lit(alpha)) / F.lit(z or 1.0)
    return stored(totals.withColumn("share", F.col("own") / F.lit(float(everything or 1))).withColumn("weight", weight).withColumn("target", F.col("weight") * total).withColumn("total", F.lit(total)), "weights")


def plan(docs: DataFrame, entropy: float | None = None, repetition: float | None = 2.0, budget: int | None = None, block_tokens: int = 200_000, seed: int = 1) -> DataFrame:
    """One row per emitted copy: doc_id, key, source, n_tokens, weight, epoch, block, place.

    Without ``budget`` the total is the least at which every document appears, so the
    source repeated least appears once and the others up to ``repetition`` times.  With
    it, a source is cut at the document that reaches its budget.  A text without words
    counts one token; a null source is the source ``''``; rows equal in id, text and
    source move together as one document; null ids are ids like others.  Only doc_id,
    text and source are read.  An empty table gives an empty plan.
    """
    tokens = stored(with_tokens(docs), "tokens")
    weights = source_weights(tokens, entropy, repetition, budget)
    blocks = weights.agg(F.max("total")).first()[0] or 0.0
    n_blocks = max(1, math.ceil(blocks / block_tokens))
    copies = (
        by_size(tokens, weights.select("source", "weight", "own", "target", F.ceil(F.col("n_docs") / BUCKET_ROWS).alias("buckets")), "source")
        .where("target > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("own") - 1e-9).cast("int") - 1)))
        .withColumn("order", F.pmod(F.xxhash64("key", "epoch", F.lit(seed)), F.lit(1 << 52)))
        .withColumn("bucket", F.floor(F.col("order") * F.col("buckets") / float(1 << 52)))
    )
    by = ["source", "epoch", "bucket"]
    sums = copies.groupBy(*by).agg(F.sum("n_tokens").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("source", "epoch").orderBy("bucket")) - F.col("s")).drop("s")
    inside = Window.partitionBy(*by).orderBy("order", "key")
    placed = (
        copies.join(before, by)
        .withColumn("at", F.col("epoch") * F.col("own") + F.col("before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
        .where("at < target")
        .withColumn("block", F.least(F.floor(F.col("at") / F.col("target") * n_blocks), F.lit(n_blocks - 1)))
    )
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("order", "block"), "order", "key", "epoch"))).select(
        "doc_id", "key", "source", "n_tokens", "weight", "epoch", "block", "place"
    )


def mix(docs: DataFrame, **targets) -> DataFrame:
    """The rows of ``docs``, each as often as its plan says, with its columns only."""
    key = free_name(docs.columns, "mix_key")
    copies = plan(docs, **targets).select(F.col("key").alias(key))
    return docs.withColumn(key, F.xxhash64("doc_id", "text", "source")).join(copies, key).select(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    """The mixing plan of ``documents`` with no source over twice the repetition of the least repeated."""
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")
