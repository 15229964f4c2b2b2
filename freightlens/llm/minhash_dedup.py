"""Near-duplicate groups: universal hash minima, banding, verification, star components.

1. One pass over the texts gives each document's set size, a fingerprint of its set
   and 240 hash minima of 8 bits (40 bands of 6).
2. Documents of equal sets form a class; its smallest id stands for it, so copies
   take part once whatever their number.
3. Classes that share a band are compared with one hub of the band's bucket, in two
   rounds with different hubs.  A pair inside one component needs no test.
4. What is left are the pairs of a bucket that lie in different components.  They are
   compared in blocks of bounded size, by their minima and then by half-width shingle
   hashes; none is left out.
5. Every pair whose minima agree enough is confirmed on the full shingle sets.

At a similarity of 0.8 a pair shares no band with probability (1 - 0.8^6)^40, about
5 in a million.  It fails the estimate of 0.55 with less than 1 in 10^15 (binomial, 240
minima that agree with 0.8), so the banding alone decides what is lost.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from . import words as W
from .components import components
from .joins import bounded_batches, by_size

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Settings:
    """Words per shingle, least similarity in percent, bands, minima per band, least estimate, documents and set elements per block."""

    k: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    estimate: float = 0.55
    block: int = 4096
    elements: int = 4_000_000


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * 2 + 1, rng.integers(0, 2**32, n, dtype=np.uint32)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash (a x + b) mod 2^32 over a set, reduced to 8 bits."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        np.minimum(least, (a[:, None] * x[None, lo : lo + 1024] + b[:, None]).min(1), out=least)
    return (W.mix(least.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def sketch(texts: DataFrame, cfg: Settings) -> DataFrame:
    """doc_id, n, two halves of the set's fingerprint, and the minima (null for an empty set)."""
    a, b = _coefficients(cfg.bands * cfg.rows)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, raw, offsets in W.slices(batch.column("text")):
                found = W.Words(raw, offsets)
                n, f1, f2, sig = [], [], [], []
                for values in W.sets(found.first, found.hash, cfg.k):
                    n.append(len(values))
                    f1.append(int(values.sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(W.mix(values ^ W.STEP).sum(dtype=np.uint64).view(np.int64)))
                    sig.append(minima(values, a, b).tobytes() if len(values) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(n)), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())],
                    ["doc_id", "n", "f1", "f2", "sig"],
                )

    return texts.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sig binary")


def full_sets(texts: DataFrame, cfg: Settings) -> DataFrame:
    """doc_id, its distinct shingle hashes, and their upper halves as packed 32-bit numbers."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, raw, offsets in W.slices(batch.column("text")):
                found = W.Words(raw, offsets)
                parts = [x.view(np.int64) for x in W.sets(found.first, found.hash, cfg.k)]
                halves = pa.array([np.unique(x.view(np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(parts)), W.list_column(parts, pa.int64()), halves], ["doc_id", "grams", "halves"])

    return texts.mapInArrow(run, "doc_id long, grams array<long>, halves binary")


def _alike(pairs: DataFrame, cfg: Settings) -> DataFrame:
    """Pairs whose minima agree in the least share."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, cfg.bands * cfg.rows) for c in ("sig_u", "sig_v"))
            yield batch.select(["u", "v"]).filter(pa.array((a == b).mean(1) >= cfg.estimate))

    return pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u long, v long")


def confirm(pairs: DataFrame, reps: DataFrame, grams: DataFrame, cfg: Settings) -> DataFrame:
    """The pairs (u, v) whose sizes, minima and then full sets reach the similarity."""
    one = reps.select(F.col("rep").alias("u"), F.col("n").alias("n_u"), F.col("sig").alias("sig_u"))
    other = reps.select(F.col("rep").alias("v"), F.col("n").alias("n_v"), F.col("sig").alias("sig_v"))
    fit = pairs.join(one, "u").join(other, "v").where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * cfg.percent)
    both = F.size(F.array_intersect("g_u", "g_v"))
    return (
        _alike(fit, cfg)
        .join(grams.select(F.col("rep").alias("u"), F.col("grams").alias("g_u")), "u")
        .join(grams.select(F.col("rep").alias("v"), F.col("grams").alias("g_v")), "v")
        .where(both * 100 >= (F.size("g_u") + F.size("g_v") - both) * cfg.percent)
        .select("u", "v")
    )


def _across(rows: DataFrame, cfg: Settings) -> DataFrame:
    """Pairs of different components within each (bucket, block of outliers, block of members) that can reach the similarity.

    Two sets can share no more elements than halves of elements, so no link is lost.
    A pair comes out in the first band that its documents share only.
    """
    width, kind = cfg.bands * cfg.rows, "u long, v long"

    def possible(a, b, n_a, n_b):
        both = len(np.intersect1d(a, b, assume_unique=True)) + n_a - len(a) + n_b - len(b)
        return both * 100 >= (n_a + n_b - both) * cfg.percent

    def pairs(t):
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, width)
        halves = [np.frombuffer(x, np.uint32) for x in t["halves"].to_pylist()]
        rep, comp, n, band = t["rep"].to_numpy(), t["comp"].to_numpy(), t["n"].to_numpy(), int(t["band"][0].as_py())
        moved = t["moved"].to_numpy(zero_copy_only=False)
        out, here = np.flatnonzero(moved), np.flatnonzero(~moved)
        u, v = [], []
        for i in out:
            other = here[comp[here] != comp[i]]
            same = sig[other] == sig[i]
            near = np.flatnonzero(same.sum(1) >= cfg.estimate * width)
            first = same[near].reshape(len(near), cfg.bands, cfg.rows).all(2).argmax(1)
            for j in other[near[first == band]]:
                if possible(halves[i], halves[j], n[i], n[j]):
                    u.append(rep[i])
                    v.append(rep[j])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            key, block, far = (t[c].to_numpy() for c in ("key", "block", "far"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (far[1:] != far[:-1])) + 1
            lo = 0
            for hi in cuts:
                if hi - lo > 1:
                    yield pairs(t.slice(lo, hi - lo))
                lo = hi
            rest = t.slice(lo)
        if rest is not None and len(rest) > 1:
            yield pairs(rest)

    return (
        rows.repartition("key", "block", "far")
        .sortWithinPartitions("key", "block", "far")
        .select("key", "block", "far", "band", "moved", "rep", "comp", "n", "sig", "halves")
        .mapInArrow(run, kind)
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _in_buckets(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """The members with their present component, of buckets that hold more than one."""
    if found is None:
        return members.withColumn("comp", F.col("rep"))
    now = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return now.join(mixed, "key", "left_semi")


def groups(texts: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``texts`` (doc_id, text).

    Null and empty texts have no shingle and stand alone.  Rows without a doc_id are
    counted but link with nothing: their component is null.  Rows that repeat a
    doc_id count as one document, whose texts all belong to its component.  Other
    columns are not read.  An empty table gives an empty table.
    """
    bounded_batches(texts.sparkSession)
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(sketch(texts, cfg), "sketches")
    fingerprint = ["f1", "f2", "n"]
    usable = sketches.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy(*fingerprint).agg(F.min("doc_id").alias("rep")), "classes")
    reps = stored(
        usable.withColumnRenamed("doc_id", "rep").join(classes, [*fingerprint, "rep"], "left_semi").groupBy("rep", "f1", "f2").agg(F.first("n").alias("n"), F.first("sig").alias("sig")).select("rep", "n", "sig"),
        "representatives",
    )
    banded = reps.select(
        "rep",
        F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * cfg.rows + 1, cfg.rows)) for i in range(cfg.bands)])).alias("band", "key"),
    )
    shared = banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    members = stored(banded.join(shared, "key", "left_semi"), "members")
    wanted = stored(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    grams = full_sets(by_size(texts, wanted, "doc_id", "left_semi"), cfg)
    grams = stored(grams.withColumnRenamed("doc_id", "rep"), "grams")

    links, found, tested = None, None, None
    for turn in range(2):
        now = _in_buckets(members, found)
        hubs = now.groupBy("key").agg(F.min_by(F.struct(F.col("rep").alias("v"), F.col("comp").alias("c")), F.xxhash64("rep", F.lit(turn))).alias("hub"))
        pairs = now.join(hubs, "key").where("comp <> hub.c").select(F.greatest("rep", "hub.v").alias("u"), F.least("rep", "hub.v").alias("v")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs
        new = stored(confirm(pairs, reps, grams, cfg), "links")
        links = new if links is None else links.unionByName(new)
        found = components(links)
    now = _in_buckets(members, found)
    # a block holds at most cfg.block documents and about cfg.elements set elements
    sized = now.join(reps, "rep")
    blocks = lambda m, e: F.greatest(F.ceil(m / cfg.block), F.ceil(e / cfg.elements)).cast("int")
    by_comp = sized.groupBy("key", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("e"))
    sizes = by_comp.groupBy("key").agg(F.sum("m").alias("m"), F.sum("e").alias("e"), F.max_by(F.struct("comp", "m", "e"), F.struct("m", "comp")).alias("main"))
    sizes = sizes.where("m > 2").select(
        "key", F.col("main.comp").alias("main"), blocks(F.col("m"), F.col("e")).alias("blocks"), blocks(F.col("m") - F.col("main.m"), F.col("e") - F.col("main.e")).alias("fars")
    )
    placed = sized.join(sizes, "key").join(grams.select("rep", "halves"), "rep")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    home = placed.withColumn("moved", F.lit(False)).withColumn("block", own("blocks")).withColumn("far", spread("fars"))
    moved = placed.where("comp <> main").withColumn("moved", F.lit(True)).withColumn("block", spread("blocks")).withColumn("far", own("fars"))
    last = _across(home.unionByName(moved), cfg)
    # texts of one id are one document: its id links the classes of all of them
    repeated = stored(usable.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").select("doc_id"), "repeated")
    own = by_size(usable.select("doc_id", *fingerprint), repeated, "doc_id", "left_semi").join(classes, fingerprint)
    own = own.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components(links.unionByName(stored(confirm(last, reps, grams, cfg), "links")).unionByName(own))

    return (
        sketches.select("doc_id", *fingerprint)
        .join(classes, fingerprint, "left")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep"))).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def keep_one(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without all but the first document of each group.

    Rows without a doc_id stay; of rows that repeat the kept id one stays.
    """
    kept = groups(docs, cfg).where("kept").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Groups of ``documents`` by two-word shingles at a similarity of 0.8."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), Settings(k=2)).select("doc_id", "n_shingles", "component_id", "kept")
