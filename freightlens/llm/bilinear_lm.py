"""Log-bilinear language model over word units, trained by noise-contrastive estimation.

Units.  The ``units`` most frequent words are units of their own, the text's end is
one, and every other word belongs to one of ``groups`` units by its first bytes; both
numbers grow with the fifth root of the vocabulary.  A token's probability is P(unit | two units before) x P(word | unit): the first from the
neural model, the second from training counts with one count added per word and one
for all unseen words, so the probabilities of all words and the unseen sum to one.

Model.  The predicted vector is the sum of the context units' vectors, each weighted
per dimension by its place; a unit's logit is its product with the unit's own vector
plus a bias.  Noise-contrastive estimation trains it on every training token against
noise from the unit frequencies, in numpy, per Spark partition; partitions' parameters
are averaged by tokens between rounds through Spark.  As a logit is the sum of a part
for each place, its exponential is a product, and one matrix product of the places'
exponentials gives the normaliser of every context; that table, of the square of the
units (the vocabulary to the power 0.4), is the largest thing a scoring task holds.

Counts of all words come from a Spark aggregate.  The ``kept`` most frequent words
travel to the scoring tasks (a fixed number); counts of the others are joined to the
texts' remaining words by shuffle.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from . import words as W
from .joins import bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = np.uint64(0x5851F42D4C957F2D)
STEM = 3


@dataclass(frozen=True)
class Settings:
    """Unit words and word groups (0: by ``share`` and the vocabulary), words sent to tasks, dimensions, noise per batch, batch size, rounds, learning rate."""

    units: int = 0
    groups: int = 0
    share: int = 40
    least: int = 64
    kept: int = 200_000
    size: int = 16
    noise: int = 24
    batch: int = 2048
    rounds: int = 2
    rate: float = 0.15

    @property
    def all(self) -> int:
        return 1 + self.units + self.groups

    def sized(self, vocabulary: int) -> Settings:
        """The settings with the numbers of unit words and of groups for so many distinct words."""
        n = max(self.least, round(self.share * vocabulary**0.2))
        return replace(self, units=self.units or n, groups=self.groups or n)


def stem_number(stem: np.ndarray) -> np.ndarray:
    return (stem >> np.uint64(40)).astype(np.int64)


def group_of(stem: np.ndarray, cfg: Settings) -> np.ndarray:
    return stem_number(stem) % cfg.groups


def count_words(texts: DataFrame) -> DataFrame:
    """word (hash), stem (-1 for the end), n over all tokens of ``texts``, one end per text included."""

    def run(batches):
        def flush(parts):
            h, g = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            n = np.concatenate([p[2] for p in parts])
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return u, g[first], np.bincount(back, n).astype(np.int64)

        held, size = [], 0
        for batch in batches:
            for lo, raw, offsets in W.slices(batch.column("text")):
                found = W.Words(raw, offsets, STEM)
                u, first, n = np.unique(found.hash, return_index=True, return_counts=True)
                ends = len(offsets) - 1
                held.append((np.append(u, END), np.append(stem_number(found.stem[first]), -1), np.append(n, ends)))
                size += len(u)
                if size > 1_000_000:
                    held = [flush(held)]
                    if len(held[0][0]) > 500_000:
                        yield _counts(held[0])
                        held = []
                    size = sum(len(p[0]) for p in held)
        if held:
            yield _counts(flush(held))

    sums = texts.select("text").mapInArrow(run, "word long, stem int, n long")
    return sums.groupBy("word").agg(F.max("stem").alias("stem"), F.sum("n").alias("n"))


def _counts(part):
    u, g, n = part
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(g.astype(np.int32)), pa.array(n)], ["word", "stem", "n"])


def to_units(found: W.Words, top: np.ndarray, cfg: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units of all tokens with one end per text, is-rare marks, first token of each text).  ``top`` is sorted."""
    at = np.searchsorted(top, found.hash)
    at[at == len(top)] = 0
    own = (top[at] == found.hash) if len(top) else np.zeros(len(at), bool)
    unit = np.where(own, 1 + at, 1 + cfg.units + group_of(found.stem, cfg))
    ends = found.first[1:]
    units = np.insert(unit, ends, 0)
    rare = np.insert(~own, ends, False)
    return units.astype(np.int64), rare, found.first + np.arange(len(found.first))


def contexts(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two places before each token; before a text's start it is the end."""
    one = np.concatenate([[0], units[:-1]])
    two = np.concatenate([[0, 0], units[:-2]])[: len(units)]
    starts = first[:-1]
    one[starts] = 0
    two[starts] = 0
    second = starts + 1
    two[second[second < len(units)]] = 0
    return one, two


class Params:
    """Context vectors R, place weights C, unit vectors Q, biases b, as one flat vector."""

    def __init__(self, flat: np.ndarray, cfg: Settings):
        v, d = cfg.all, cfg.size
        self.flat = flat
        self.R = flat[: v * d].reshape(v, d)
        self.C = flat[v * d : v * d + 2 * d].reshape(2, d)
        self.Q = flat[v * d + 2 * d : 2 * v * d + 2 * d].reshape(v, d)
        self.b = flat[2 * v * d + 2 * d :]


def start_params(freq: np.ndarray, cfg: Settings) -> np.ndarray:
    v, d = cfg.all, cfg.size
    rng = np.random.default_rng(3)
    flat = np.concatenate([rng.normal(0, 0.3, v * d), np.full(2 * d, 0.7), rng.normal(0, 0.3, v * d), np.log(freq)])
    return flat.astype(np.float32)


def scatter(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by index."""
    return np.stack([np.bincount(index, rows[:, j], n) for j in range(rows.shape[1])], 1).astype(np.float32)


def nce_step(p: Params, one, two, word, log_noise, noise, seen, cfg: Settings):
    """One batch of noise-contrastive estimation with noise shared by the batch, by AdaGrad; ``seen`` are squared gradients."""
    v, k, m = cfg.all, len(noise), len(word)
    r1, r2 = p.R[one], p.R[two]
    q = r1 * p.C[0] + r2 * p.C[1]
    qw = p.Q[word]
    good = np.einsum("ij,ij->i", q, qw) + p.b[word] - log_noise[word] - np.float32(math.log(k))
    bad = q @ p.Q[noise].T + p.b[noise] - log_noise[noise] - np.float32(math.log(k))
    g = 1 / (1 + np.exp(np.clip(good, -30, 30)))  # towards 1
    h = -1 / (1 + np.exp(np.clip(-bad, -30, 30)))  # towards 0
    dq = g[:, None] * qw + h @ p.Q[noise]
    gq = scatter(word, g[:, None] * q, v)
    np.add.at(gq, noise, h.T @ q)
    gb = np.bincount(word, g, v)
    np.add.at(gb, noise, h.sum(0))
    gr = scatter(one, dq * p.C[0], v) + scatter(two, dq * p.C[1], v)
    gc = np.stack([(dq * r1).sum(0), (dq * r2).sum(0)])
    grad = np.concatenate([gr.reshape(-1), gc.reshape(-1), gq.reshape(-1), gb]).astype(np.float32) / m
    seen += grad * grad
    p.flat += np.float32(cfg.rate) * grad / (np.sqrt(seen) + np.float32(1e-6))


def train_round(texts: DataFrame, flat: np.ndarray, top: np.ndarray, freq: np.ndarray, turn: int, cfg: Settings) -> np.ndarray:
    """One pass over all training texts; each partition starts from ``flat``, their results are averaged by tokens."""

    def run(batches):
        p, seen, total = Params(flat.copy(), cfg), np.full(len(flat), 1e-4, np.float32), 0
        log_noise = np.log(freq).astype(np.float32)
        rng = np.random.default_rng([turn, TaskContext.get().partitionId()])
        for batch in batches:
            for _, raw, offsets in W.slices(batch.column("text")):
                units, _, first = to_units(W.Words(raw, offsets, STEM), top, cfg)
                one, two = contexts(units, first)
                order = rng.permutation(len(units))
                noise = rng.choice(cfg.all, (len(units) // cfg.batch + 1, cfg.noise), p=freq)
                for i, lo in enumerate(range(0, len(units), cfg.batch)):
                    at = order[lo : lo + cfg.batch]
                    nce_step(p, one[at], two[at], units[at], log_noise, noise[i], seen, cfg)
                total += len(units)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(p.flat.astype(np.float64) * total), pa.array(np.full(len(flat), float(total)))], ["i", "x", "w"])

    sums = texts.select("text").mapInArrow(run, "i int, x double, w double").groupBy("i").agg((F.sum("x") / F.sum("w")).alias("x")).toArrow()
    out = flat.copy()
    out[sums["i"].to_numpy()] = sums["x"].to_numpy()
    return out


@dataclass
class Model:
    """What scoring needs, in log10; every array's size is fixed by the settings and the fifth root of the vocabulary."""

    top: np.ndarray  # sorted hashes of unit words
    near: np.ndarray  # weighted vector of the unit one before
    far: np.ndarray  # and of the unit two before
    out: np.ndarray  # vectors of the predicted units
    bias: np.ndarray
    norm: np.ndarray  # log normaliser by (one before, two before)
    within: np.ndarray  # log10 of the denominator inside a group unit
    kept: np.ndarray  # sorted hashes of the most frequent words
    kept_n: np.ndarray
    total: int
    vocabulary: int

    @property
    def one(self) -> np.ndarray:
        """Logit part of the unit one before, by unit."""
        return self.near @ self.out.T

    @property
    def two(self) -> np.ndarray:
        return self.far @ self.out.T


def normalised(flat: np.ndarray, cfg: Settings):
    """Weighted context vectors, unit vectors, biases, and the log normaliser of every context.

    The sum over units of exp(one + two + bias) is a matrix product of exponentials;
    each side is scaled by its rows' maxima, in double precision.
    """
    p = Params(flat, cfg)
    near, far, out = p.R * p.C[0], p.R * p.C[1], p.Q.copy()
    two = (far @ out.T + p.b).astype(np.float64)
    top_two = two.max(1)
    two = np.exp(two - top_two[:, None]).T
    norm = np.empty((cfg.all, cfg.all), np.float32)
    for lo in range(0, cfg.all, 512):
        one = (near[lo : lo + 512] @ out.T).astype(np.float64)
        top_one = one.max(1)[:, None]
        norm[lo : lo + 512] = np.log(np.exp(one - top_one) @ two) + top_one + top_two
    return near, far, out, p.b.copy(), norm


def fit(texts: DataFrame, cfg: Settings = Settings()) -> tuple[Model, DataFrame]:
    """Train on every row of ``texts`` (text); returns the model and the written word counts."""
    bounded_batches(texts.sparkSession)
    counts = stored(count_words(texts), "counts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cfg = cfg.sized(vocabulary)
    order = [F.desc("n"), F.asc("word")]
    end = F.lit(int(END.view(np.int64)))
    best = counts.orderBy(*order).limit(cfg.kept).toArrow()  # a fixed number of rows
    word, n = best["word"].to_numpy().view(np.uint64), best["n"].to_numpy()
    is_end = word == END
    top = np.sort(word[~is_end][: cfg.units])
    groups = (
        counts.where((F.col("word") != end) & ~F.col("word").isin([int(x) for x in top.view(np.int64)])).groupBy((F.col("stem") % cfg.groups).alias("grp")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    )
    mass, kinds = np.zeros(cfg.groups), np.zeros(cfg.groups)
    mass[groups["grp"].to_numpy()], kinds[groups["grp"].to_numpy()] = groups["n"].to_numpy(), groups["v"].to_numpy()
    sizes = np.zeros(cfg.all)
    sizes[0] = n[is_end].sum()
    by_word = dict(zip(word.tolist(), n.tolist()))
    sizes[1 : 1 + len(top)] = [by_word[x] for x in top.tolist()]
    sizes[1 + cfg.units :] = mass
    freq = (sizes + 1) / (sizes + 1).sum()
    flat = start_params(freq, cfg)
    for turn in range(cfg.rounds if total else 0):
        flat = train_round(texts, flat, top, freq, turn, cfg)
    near, far, out, bias, norm = normalised(flat, cfg)
    by_hash = np.argsort(word)
    model = Model(top, near, far, out, bias, norm, np.log10(mass + kinds + 1), word[by_hash], n[by_hash], int(total), int(vocabulary))
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, n_known, train_tokens, base_score, score, the latter in log10.

    Null and empty texts hold the end token only.  Repeated rows, null ids and other
    columns don't matter: rows are told apart by their place.
    """
    bounded_batches(docs.sparkSession)
    cfg = cfg.sized(model.vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((model.top, model.near, model.far, model.out, model.bias, model.norm, model.within, model.kept, model.kept_n))
    total, vocabulary = model.total, model.vocabulary

    def run(batches):
        top, near, far, out, bias, norm, within, kept, kept_n = shared.value
        kept_log = np.log10(kept_n + 1.0)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, raw, offsets in W.slices(batch.column("text")):
                found = W.Words(raw, offsets, STEM)
                units, rare, first = to_units(found, top, cfg)
                one, two = contexts(units, first)
                logp = (np.einsum("ij,ij->i", near[one] + far[two], out[units]) + bias[units] - norm[one, two]) / math.log(10)
                hashes = np.insert(found.hash, found.first[1:], END)
                at = np.searchsorted(kept, hashes)
                at[at == len(kept)] = 0
                known = (kept[at] == hashes) if len(kept) else np.zeros(len(hashes), bool)
                plus = np.where(known, kept_log[at] if len(kept) else 0.0, 0.0)
                logp = logp + np.where(rare, plus - within[np.maximum(units - 1 - cfg.units, 0)], 0.0)
                n = len(offsets) - 1
                doc = np.repeat(np.arange(n), np.diff(first))
                rest = [np.unique(hashes[a:b][~known[a:b]], return_counts=True) for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)),
                        ids.slice(lo, n),
                        pa.array(np.diff(first)),
                        pa.array(np.bincount(doc, known, n).astype(np.int64)),
                        pa.array(np.bincount(doc, plus, n)),
                        pa.array(np.bincount(doc, logp, n)),
                        W.list_column([x[0].view(np.int64) for x in rest], pa.int64()),
                        W.list_column([x[1] for x in rest], pa.int64()),
                    ],
                    ["row", "doc_id", "n_tokens", "known", "plus", "logp", "words", "times"],
                )
                row += n

    schema = "row long, doc_id long, n_tokens long, known long, plus double, logp double, words array<long>, times array<long>"
    first = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "scores")
    rest = first.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = (
        rest.join(counts.select("word", "n"), "word")
        .groupBy("row")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("bits"))
    )
    bits = F.coalesce("bits", F.lit(0.0))
    return first.join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("plus") + bits - F.col("n_tokens") * math.log10(total + vocabulary + 1)).alias("base_score"),
        (F.col("logp") + bits).alias("score"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from those whose crc32(doc_id) mod 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model, counts = fit(docs.where(~held_out))
    return score(docs, model, counts).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
