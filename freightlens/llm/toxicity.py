"""Toxic passages: maximum-scoring segments over token log-odds.

1. Counts of words (letters and digits, lower case) in toxic and clean training texts
   give each word a log-odds under a Dirichlet prior.  The prior of a word is centred
   on its stem's (first five bytes) posterior, and the stem's on the class shares, so
   unseen words lean on their stem.  Words are hashed into a fixed number of buckets,
   so the model's size does not depend on the corpus.
2. A token's score is its log-odds less a shift.  The linear-time scan finds all
   maximal segments of a text: disjoint passages whose total no change of their ends
   improves.
3. Segment sums are calibrated as extreme values: lambda solves
   sum p e^(lambda s) = 1 over clean tokens, and lambda S - ln(length) of clean texts
   follows a Gumbel law whose place and scale are fitted on training rows not used for
   the counts.  Passages of expectation below ``expect`` are significant; a text's
   evidence is the sum of their excess, mapped to a probability by a logistic curve
   fitted on the same rows.

The counts use a sample of at most ``rows`` labelled training rows (all, if fewer),
chosen by hash; every text is scored whole.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .joins import bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEM = 5


@dataclass(frozen=True)
class Settings:
    """Bound on training rows, hash buckets (powers of two), prior strengths, shift, significance."""

    rows: int = 40_000
    word_bits: int = 20
    stem_bits: int = 18
    word_prior: float = 3.0
    stem_prior: float = 10.0
    shift: float = 1.0
    expect: float = 0.05


@dataclass
class Model:
    tables: tuple  # word counts, toxic share by stem, share of the class
    scale: float  # lambda
    place: float  # Gumbel place and scale
    spread: float
    slope: float  # logistic curve
    offset: float
    cfg: Settings


def buckets(found: W.Words, cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    word = (found.hash >> np.uint64(64 - cfg.word_bits)).astype(np.int64)
    return word, (found.stem >> np.uint64(64 - cfg.stem_bits)).astype(np.int64)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, stop, sum) of a sequence, left to right, in linear time.

    Runs of one sign are taken together; a stack keeps for every candidate the totals
    before it and up to its end.
    """
    up = scores > 0
    if not up.any():
        return []
    cuts = np.flatnonzero(up[1:] != up[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    sums = np.add.reduceat(scores, starts)
    stops = np.append(cuts, len(scores))
    total, stack, back = 0.0, [], []  # back: the nearest candidate to the left with a lower total before it
    for a, b, s, positive in zip(starts.tolist(), stops.tolist(), sums.tolist(), up[starts].tolist()):
        if not positive:
            total += s
            continue
        left, total = total, total + s
        item = (a, b, left, total)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j = back[j]
            if j < 0 or stack[j][3] >= item[3]:
                stack.append(item)
                back.append(j)
                break
            item = (stack[j][0], item[1], stack[j][2], item[3])
            del stack[j:], back[j:]
    return [(a, b, r - l) for a, b, l, r in stack]


def count_words(texts: DataFrame, cfg: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per word and stem bucket, columns clean and toxic, of texts (text, toxic); sizes are fixed by ``cfg``."""

    def run(batches):
        words, stems = np.zeros((2, 1 << cfg.word_bits), np.int64), np.zeros((2, 1 << cfg.stem_bits), np.int64)
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, raw, offsets in W.slices(batch.column("text")):
                found = W.Words(raw, offsets, STEM, W.MARKS)
                toxic = np.repeat(label[lo : lo + len(offsets) - 1], np.diff(found.first))
                for table, place in zip((words, stems), buckets(found, cfg)):
                    for c in (0, 1):
                        table[c] += np.bincount(place[toxic == c], minlength=table.shape[1])
        for kind, table in enumerate((words, stems)):
            at = np.flatnonzero(table.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(table[0, at]), pa.array(table[1, at])], ["kind", "at", "clean", "toxic"])

    sums = texts.select("text", "toxic").mapInArrow(run, "kind int, at int, clean long, toxic long").groupBy("kind", "at").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    kind, at = sums["kind"].to_numpy(), sums["at"].to_numpy()
    out = []
    for k, bits in ((0, cfg.word_bits), (1, cfg.stem_bits)):
        table = np.zeros((1 << bits, 2))
        for c, name in enumerate(("clean", "toxic")):
            table[at[kind == k], c] = sums[name].to_numpy()[kind == k]
        out.append(table)
    return out[0], out[1]


def log_odds(words: np.ndarray, stems: np.ndarray, cfg: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """(the two count tables reduced to what tokens need): toxic share by stem, counts by word, share of the class."""
    share = (stems[:, 1].sum() + 1) / (stems.sum() + 2)
    by_stem = (stems[:, 1] + cfg.stem_prior * share) / (stems.sum(1) + cfg.stem_prior)
    return words.astype(np.float32), by_stem.astype(np.float32), float(share)


def token_scores(found: W.Words, tables, cfg: Settings) -> np.ndarray:
    """Log-odds of each token less the shift."""
    counts, by_stem, share = tables
    word, stem = buckets(found, cfg)
    c = counts[word]
    p = (c[:, 1] + cfg.word_prior * by_stem[stem]) / (c.sum(1) + cfg.word_prior)
    return np.log(p / (1 - p)) - math.log(share / (1 - share)) - cfg.shift


def positive_root(p: np.ndarray, s: np.ndarray) -> float:
    """The positive solution of sum p e^(x s) = 1, or a small one where the mean isn't negative."""
    lo, hi = 1e-3, 8.0
    for _ in range(60):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if (p * np.exp(np.minimum(x * s, 50))).sum() < 1 else (lo, x)
    return lo


def texts_segments(batch_text, tables, cfg: Settings):
    """Per text of a column: (number of tokens, its maximal segments, byte places of its tokens)."""
    for _, raw, offsets in W.slices(batch_text):
        found = W.Words(raw, offsets, STEM, W.MARKS)
        scores = token_scores(found, tables, cfg)
        for i, (a, b) in enumerate(zip(found.first[:-1], found.first[1:])):
            yield b - a, segments(scores[a:b]), found.start[a:b] - offsets[i], found.end[a:b] - offsets[i]


def evidence(n: int, found: list, scale: float, place: float, spread: float, expect: float) -> tuple[float, list]:
    """Summed excess of the significant passages, and those passages; without any, the best passage's shortfall."""
    best, total, kept, base = -8.0, 0.0, [], math.log(max(n, 1))
    for seg in found:
        z = (scale * seg[2] - base - place) / spread
        best = max(best, z)
        if z > -math.log(expect):
            total += z
            kept.append(seg)
    return (total if kept else min(best, -math.log(expect))), kept


def fit(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> Model:
    """Learn from labelled rows whose crc32(doc_id) mod 5 is not 0: remainder 1 calibrates, the others are counted.

    Labels that repeat count once; an id whose labels contradict each other teaches nothing.
    """
    bounded_batches(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("toxic"), F.max("toxic").cast("int").alias("most"))
    wanted = known.where("toxic = most").select("doc_id", "toxic", fold.alias("fold")).where("fold <> 0")
    n = wanted.count()
    if n > cfg.rows:  # the documented bound on labelled rows
        wanted = wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (cfg.rows / n)))
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    counted = log_odds(*count_words(rows.where("fold <> 1"), cfg), cfg)
    shared = docs.sparkSession.sparkContext.broadcast(counted)

    words, by_stem, share = counted
    p = (words[:, 1] + cfg.word_prior * share) / (words.sum(1) + cfg.word_prior)
    s = np.log(p / (1 - p)) - math.log(share / (1 - share)) - cfg.shift
    clean = words[:, 0] / max(words[:, 0].sum(), 1)
    scale = positive_root(clean.astype(np.float64), s.astype(np.float64))

    held_rows = rows.where("fold = 1").select("text", "toxic")

    def best(batches):
        """The best passage of each clean text."""
        for batch in batches:
            out = [(n, max((x[2] for x in found), default=None)) for n, found, _, _ in texts_segments(batch.column("text"), shared.value, cfg)]
            yield pa.RecordBatch.from_arrays([pa.array([int(n) for n, _ in out], pa.int64()), pa.array([x for _, x in out], pa.float64())], ["n", "best"])

    # at most cfg.rows rows of two numbers
    clean_best = held_rows.where("toxic = 0").mapInArrow(best, "n long, best double").where("best IS NOT NULL").toArrow().to_pylist()
    x = np.array([scale * r["best"] - math.log(max(r["n"], 1)) for r in clean_best])
    # by quartiles, which a few wrong labels don't move
    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75]) if len(x) > 9 else (-1.0, 0.0, 1.0)
    spread = max(float(high - low) / 1.5725, 0.2)
    place = float(middle) - 0.3665 * spread

    def weighed(batches):
        """The evidence of each text, as scoring sees it."""
        for batch in batches:
            z = [float(evidence(int(n), found, scale, place, spread, cfg.expect)[0]) for n, found, _, _ in texts_segments(batch.column("text"), shared.value, cfg)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(z, pa.float64())], ["toxic", "z"])

    held = held_rows.mapInArrow(weighed, "toxic int, z double").toArrow().to_pylist()
    z = np.array([r["z"] for r in held])
    y = np.array([r["toxic"] for r in held], float)
    slope, offset = logistic(z, y)
    return Model(counted, scale, place, spread, slope, offset, cfg)


def compressed(z):
    """Evidence on a scale that grows like its logarithm above 1, so that single wrong labels don't rule the fit."""
    return np.where(z > 1, 1 + np.log(np.maximum(z, 1)), np.maximum(z, -8.0))


def logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over compressed evidence: Newton steps, halved until the loss falls."""
    prior = np.array([2.0, -5.0])
    x = np.stack([compressed(z), np.ones(len(z))], 1)

    def loss(w):
        t = x @ w
        return float((np.logaddexp(0, t) - y * t).sum() + 0.05 * ((w - prior) ** 2).sum())

    w = prior
    for _ in range(50 if len(z) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return max(float(w[0]), 1e-3), float(w[1])


def _chance(model: Model, z: float) -> float:
    t = model.slope * float(compressed(np.float64(z))) + model.offset
    return 1 / (1 + math.exp(-max(min(t, 30.0), -30.0)))


def _ready(docs: DataFrame, model: Model):
    """The tables as a broadcast of plain arrays (their sizes are fixed), and the rest for the closure."""
    bounded_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(model.tables), replace(model, tables=())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): score, predicted, passages as byte spans with their expectation.

    Null and empty texts have no passage and the lowest score.  Rows are scored one by
    one, so repeats, null ids and other columns don't matter.
    """
    cfg = model.cfg
    tables, m = _ready(docs, model)

    def run(batches):
        for batch in batches:
            scores, spans = [], []
            for n, found, start, end in texts_segments(batch.column("text"), tables.value, cfg):
                z, kept = evidence(int(n), found, m.scale, m.place, m.spread, cfg.expect)
                scores.append(_chance(m, z))
                spans.append([{"start": int(start[a]), "stop": int(end[b - 1]), "sum": float(s)} for a, b, s in kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("sum", pa.float64())])))],
                ["doc_id", "score", "predicted", "passages"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, passages array<struct<start:long,stop:long,sum:double>>")


def keep_clean(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    model = fit(docs, labels, cfg)
    tables, m = _ready(docs, model)

    def run(batches):
        for batch in batches:
            keep = []
            for n, found, _, _ in texts_segments(batch.column("text"), tables.value, cfg):
                z, _ = evidence(int(n), found, m.scale, m.place, m.spread, cfg.expect)
                keep.append(_chance(m, z) < 0.5)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
