"""Passages that repeat across documents: sparse suffix arrays over words.

1. Of every text, the suffixes at minimiser positions are retained: places whose
   5-word hash is the least of some window of 16 consecutive places.  Two texts that
   share 50 words share such a place in the passage's first 16 words, and the 35 words
   after it (the stem).
2. Suffixes are brought together by their stems, which puts equal ones side by side as a
   sorted suffix array does; stems of a single text are dropped before anything moves.
3. A shared place is extended to the left and to the right: by l words before the stem
   and 15 - l words behind it, for every l.  Each such stretch of 50 words that two texts
   have in common counts, and stretches that overlap become one span.

Equal texts are one unit all along, so copies cost a row each.  Everything is grouped by
hashes with partial sums; no pairs of documents are formed, no group is cut, and nothing
depends on how many documents share a passage.  Of the documents that hold a stretch, the
one of the smallest key holds the original.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import discard, new_path, stored
from . import words as W
from .joins import bounded_batches, free_name

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Settings:
    """Least words of a passage, window of places, words hashed per place."""

    least: int = 50
    window: int = 16
    gram: int = 5

    @property
    def stem(self) -> int:
        return self.least - self.window + 1


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on (fewer at the end)."""
    n = len(hashes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * W.powers(W.BASE, n), out=sums[1:])
    at = np.arange(n)
    return W.mix((sums[np.minimum(at + k, n)] - sums[at]) * W.powers(W.INVERSE, n))


def _sliding(x: np.ndarray, w: int, pick, fill) -> np.ndarray:
    """pick over x[i : i + w] at each i."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = pick(out, np.concatenate([out[step:], np.full(min(step, len(out)), fill, out.dtype)]))
        done += step
    return out


def minimisers(values: np.ndarray, w: int) -> np.ndarray:
    """Places whose value is the least of some window of w places; equal least ones all count."""
    top = np.iinfo(values.dtype).max
    least = _sliding(values, w, np.minimum, top)
    # windows that run over the end have taken the fill value's place as the rest of the text
    most = _sliding(least[::-1], w, np.maximum, 0)[::-1]
    return np.flatnonzero(most == values)


def _cut(hashes: np.ndarray, first: np.ndarray, cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Retained places of a slice's words with room for a stem, and their documents."""
    at = minimisers(grams(hashes, cfg.gram), cfg.window)
    doc = np.searchsorted(first, at, "right") - 1
    fits = (at + cfg.stem <= first[doc + 1]) & (first[doc + 1] - first[doc] >= cfg.least)
    return at[fits], doc[fits]


def suffixes(texts: DataFrame, cfg: Settings) -> DataFrame:
    """(stem, unit, place) of the retained suffixes; the place counts from the text's first word."""

    def run(batches):
        for batch in batches:
            units = batch.column("unit")
            for lo, raw, offsets in W.slices(batch.column("text")):
                found = W.Words(raw, offsets)
                if len(found.hash) < cfg.least:
                    continue
                at, doc = _cut(found.hash, found.first, cfg)
                stem = grams(found.hash, cfg.stem)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(stem.view(np.int64)), units.take(pa.array(doc + lo)), pa.array((at - found.first[doc]).astype(np.int32))], ["stem", "unit", "place"]
                )

    return texts.mapInArrow(run, "stem long, unit long, place int")


def stretches(texts: DataFrame, cfg: Settings) -> DataFrame:
    """(h1, h2, unit, lo, starts) of every stretch of ``least`` words that holds one of the text's ``places``.

    A stretch that a text holds several times is one row.  A text also has one row
    without hashes whose only start is its number of words.
    """

    def run(batches):
        for batch in batches:
            units, lows, places = batch.column("unit"), batch.column("lo"), batch.column("places")
            for lo, raw, offsets in W.slices(batch.column("text")):
                found = W.Words(raw, offsets)
                sizes = np.diff(found.first)
                rows = np.arange(lo, lo + len(sizes))
                none = pa.nulls(len(rows), pa.int64())
                names = ["h1", "h2", "unit", "lo", "starts"]
                lengths = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32)), pa.array(sizes.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([none, none, units.take(pa.array(rows)), lows.take(pa.array(rows)), lengths], names)
                starts, owner = [], []
                for i, n in enumerate(sizes.tolist()):
                    own = places[lo + i].values if places[lo + i].is_valid else None
                    if own is None or n < cfg.least:
                        continue
                    begin = own.to_numpy(zero_copy_only=False)[:, None] - np.arange(cfg.window)
                    begin = np.unique(begin[(begin >= 0) & (begin + cfg.least <= n)])
                    starts.append(begin)
                    owner.append(np.full(len(begin), i))
                if not starts:
                    continue
                start, doc = np.concatenate(starts), np.concatenate(owner)
                at = found.first[doc] + start
                one, two = grams(found.hash, cfg.least)[at], grams(W.mix(found.hash + W.STEP), cfg.least)[at]
                order = np.lexsort((start, two, one, doc))
                doc, one, two, start = doc[order], one[order], two[order], start[order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
                at = np.flatnonzero(new)
                rows = pa.array(doc[at] + lo)
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(new)).astype(np.int32)), pa.array(start.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), units.take(rows), lows.take(rows), lists], names)

    return texts.mapInArrow(run, "h1 long, h2 long, unit long, lo long, starts array<int>")


def _joined(starts: np.ndarray, least: int) -> list[dict]:
    """Spans of the words that stretches from these places cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > least)
    return [{"start": int(x), "stop": int(y) + least} for x, y in zip(starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]])]


SPANS = "array<struct<start:int,stop:int>>"


def _spans(found: DataFrame, cfg: Settings) -> DataFrame:
    """(unit, spans, later) from a unit's places of shared stretches and of those an earlier document holds."""

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            parts = [pa.array([_joined(x.values.flatten().to_numpy(zero_copy_only=False), cfg.least) for x in batch.column(c)], kind) for c in ("shared", "earlier")]
            yield pa.RecordBatch.from_arrays([batch.column("unit"), *parts], ["unit", "spans", "later"])

    return found.select("unit", "shared", "earlier").mapInArrow(run, f"unit long, spans {SPANS}, later {SPANS}")


def repeats(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """One row per document that shares a passage with another one.

    doc_id, doc_key, spans (word places of all shared passages), later (those of which
    a document of a smaller key holds the original), and their lengths n_repeated and
    n_later.

    Rows that repeat id and text are one document; equal texts of other ids repeat
    each other.  A null id is an id like others.  Null, empty and shorter texts share
    nothing; a passage that repeats inside one document only doesn't count.  Only
    doc_id and text are read.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc_key"), F.xxhash64("text").alias("unit"), "text")
    units = keyed.groupBy("unit").agg(F.min("doc_key").alias("lo"), (F.min("doc_key") != F.max("doc_key")).alias("copied"))
    units = stored(units, "units")

    made: list[str] = []

    def written(df: DataFrame, label: str) -> DataFrame:
        made.append(new_path(spark, label))
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    found = written(suffixes(keyed.select("unit", "text"), cfg), "suffixes")
    shared = found.groupBy("stem").agg(F.min("unit").alias("a"), F.max("unit").alias("b")).where("a <> b").select("stem")
    shared = written(shared, "stems")
    # both sides are written tables, so the joins are plain shuffles whose hot keys Spark splits
    places = found.join(shared.hint("merge"), "stem", "left_semi").groupBy("unit").agg(F.collect_set("place").alias("places"))
    wanted = units.join(places, "unit", "left").where(F.col("copied") | F.col("places").isNotNull())
    wanted = written(wanted.select("unit", "lo", "places"), "wanted")
    # the texts of one document each; repeated rows give equal stretches, which are counted once
    texts = keyed.select("doc_key", "text").join(wanted.withColumnRenamed("lo", "doc_key").hint("merge"), "doc_key").withColumnRenamed("doc_key", "lo")
    rows = written(stretches(texts.select("unit", "lo", "places", "text"), cfg), "stretches")
    owners = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("unit").alias("a"), F.max("unit").alias("b"), F.min("lo").alias("first"))
    owners = written(owners.where("a <> b").select("h1", "h2", "first"), "owners")
    hits = rows.where("h1 IS NOT NULL").join(owners.hint("merge"), ["h1", "h2"])
    marks = hits.groupBy("unit").agg(F.collect_list("starts").alias("shared"), F.collect_list(F.when(F.col("first") < F.col("lo"), F.col("starts"))).alias("earlier"))
    sizes = rows.where("h1 IS NULL").groupBy("unit").agg(F.max(F.get("starts", F.lit(0))).alias("n"))
    per = stored(units.join(sizes, "unit").join(_spans(marks, cfg), "unit", "left"), "spans")
    for path in made:
        discard(spark, path)

    whole = F.when(F.col("n") >= cfg.least, F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("stop")))).otherwise(F.array().cast(SPANS))
    none = F.array().cast(SPANS)
    copy = F.col("copied") & (F.col("doc_key") != F.col("lo"))
    length = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    each = keyed.select("doc_id", "doc_key", "unit").distinct().join(per, "unit")
    each = each.select(
        "doc_id", "doc_key", F.when(F.col("copied"), whole).otherwise(F.coalesce("spans", none)).alias("spans"), F.when(copy, whole).otherwise(F.coalesce("later", none)).alias("later")
    )
    return each.where(F.size("spans") > 0).withColumn("n_repeated", length(F.col("spans"))).withColumn("n_later", length(F.col("later")))


def without_repeats(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``docs`` with the later copies of shared passages cut from their texts; other columns stay."""
    key, cut = free_name(docs.columns, "passage_key"), free_name(docs.columns, "passage_cuts")
    cuts = stored(repeats(docs, cfg).where("n_later > 0").select(F.col("doc_key").alias(key), F.col("later").alias(cut)), "cuts")
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            later = batch.column(cut).to_pylist()
            texts = batch.column("text").to_pylist()
            for lo, raw, offsets in W.slices(batch.column("text")):
                found = W.Words(raw, offsets)
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    if not later[lo + i]:
                        continue
                    keep, done = [], a
                    for s in later[lo + i]:
                        first = found.first[i]
                        keep.append(raw[done : found.start[first + s["start"]]].tobytes())
                        done = found.end[first + s["stop"] - 1]
                    texts[lo + i] = b"".join([*keep, raw[done:b].tobytes()]).decode("utf-8", "replace")
            columns = [batch.column(c) for c in names]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(cuts, key, "left").select(*names, cut)
    return joined.mapInArrow(run, docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    """Documents of ``documents`` with passages of at least 50 words that other documents hold too."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_repeated", "n_later", F.col("spans").cast("string").alias("spans"))
