"""Phrase collocation mining by top-order marginalisation.

Every word position gives one window: the word and the four after it, padded where
the piece ends.  Only these longest windows are counted.  A phrase of k words occurs as
often as windows start with it, so one ROLLUP over the five window columns yields the
counts of all shorter phrases; there is no explosion per phrase length.

A window is also padded where a phrase of ``least`` occurrences can't go on: at a pair of
adjacent words that is rarer than ``least``.  Which pairs may be frequent is read from a
bitmap of 2^28 hashed pair counts (32 MB whatever the input), built by an earlier pass.
A rare pair that shares its bit with others only makes windows longer than need be, so
the counts of all phrases of ``least`` occurrences stay exact.

Words are held as 64-bit hashes until the phrases are known; their texts come from the
same pass.  Two words of equal hash would be counted as one (for ten million words the
chance is 3 in a million).
"""

from __future__ import annotations

import hashlib
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from ..session import discard, new_path, stored
from . import words as wd
from .joins import bounded_batches, by_size

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 19
NO_LANG = "und"
BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
GAPS = BREAKS.copy()
GAPS[list(b" \t")] = True
#: Pair counts by hash: 2^28 counters in blocks of 2^18; a task sends counters on when it holds so many pairs.
BITS, BLOCK_BITS, HELD = 28, 18, 4 << 20
COLUMNS = [f"w{i}" for i in range(1, 6)]


@dataclass(frozen=True)
class Settings:
    least: int = 100
    percent: int = 100
    top: int = 2000


def _salt(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


def _adjacent(batch: pa.RecordBatch):
    """Per slice: words, language of each, whether the next word goes on in the same piece, and the pair's counter."""
    langs = pc.fill_null(batch.column("lang"), NO_LANG).dictionary_encode()
    names = langs.dictionary.to_pylist()
    codes = langs.indices.to_numpy(zero_copy_only=False)
    salts = np.array([_salt(x) for x in names], np.uint64)
    for lo, raw, offsets in wd.slices(batch.column("text"), SLICE_BYTES):
        found = wd.Words(raw, offsets, spaces=GAPS)
        n = len(found.start)
        if not n:
            continue
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(found.first))
        code = codes[lo + doc]
        marks = np.concatenate([[0], np.cumsum(BREAKS[raw], dtype=np.int32)])
        goes_on = np.zeros(n, bool)
        goes_on[:-1] = (doc[1:] == doc[:-1]) & (marks[found.start[1:]] == marks[found.end[:-1]])
        after = np.append(found.hash[1:], np.uint64(0))
        pair = wd.mix((found.hash * wd.STEP + after) ^ salts[code]) >> np.uint64(64 - BITS)
        yield names, raw, found, code, goes_on, pair


def _pair_counts(batches):
    """Sums of hashed pair counts, block by block: the counters that occur and their counts."""
    held, size = [], 0

    def flush():
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.uint32)
        block = (keys >> np.uint64(BLOCK_BITS)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
        low = (keys & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(block[cuts[:-1]].astype(np.int32)),
                pa.array([low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
            ],
            ["block", "counter", "n"],
        )

    for batch in batches:
        for *_, goes_on, pair in _adjacent(batch):
            keys, counts = np.unique(pair[goes_on], return_counts=True)
            if len(keys):
                held.append((keys, counts.astype(np.float64)))
                size += len(keys)
        if size >= HELD:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _frequent(least: int):
    def run(batches):
        """Rows come sorted by block: one array of counters at a time."""
        here, total = None, None

        def bits():
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, counter, n in zip(*(batch.column(c).to_pylist() for c in ("block", "counter", "n"))):
                if block != here:
                    if here is not None:
                        yield bits()
                    here, total = block, np.zeros(1 << BLOCK_BITS, np.int64)
                total[np.frombuffer(counter, np.uint32)] += np.frombuffer(n, np.uint32)
        if here is not None:
            yield bits()

    return run


def frequent_pairs(docs: DataFrame, least: int) -> np.ndarray:
    """A bitmap of all hashed pairs that may occur ``least`` times: 2^BITS bits."""
    sums = docs.select("lang", "text").mapInArrow(_pair_counts, "block int, counter binary, n binary")
    found = sums.repartition("block").sortWithinPartitions("block").mapInArrow(_frequent(least), "block int, bits binary")
    out = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (BLOCK_BITS - 3)
    for row in found.toLocalIterator():  # 2^BITS bits in all, whatever the input
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _windows(bitmap):
    fields = [("lang", pa.string()), *[(c, pa.int64()) for c in COLUMNS], ("word", pa.string()), ("n", pa.int64())]

    def run(batches):
        bits = bitmap.value
        kept = set()
        for batch in batches:
            for names, raw, found, code, goes_on, pair in _adjacent(batch):
                n = len(found.hash)
                goes_on &= ((bits[pair >> np.uint64(3)] >> (7 - (pair & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)
                # lead columns: each one ends where the one before it ends
                lead = [found.hash.view(np.int64)]
                inside = np.ones(n, bool)
                for k in range(1, 5):
                    step = np.zeros(n, bool)
                    step[: n - k] = goes_on[k - 1 : n - 1] if n > k else False
                    inside = inside & step
                    lead.append(np.where(inside, np.concatenate([lead[0][k:], np.zeros(min(k, n), np.int64)])[:n], 0))
                key = code.astype(np.uint64)
                for column in lead:
                    key = wd.mix(key * wd.STEP + column.view(np.uint64))
                _, at, count = np.unique(key, return_index=True, return_counts=True)
                lang = pa.array(names, pa.string()).take(pa.array(code[at]))
                absent = [np.zeros(len(at), bool), *[lead[k][at] == 0 for k in range(1, 5)]]
                yield pa.RecordBatch.from_arrays(
                    [lang, *[pa.array(c[at], mask=m) for c, m in zip(lead, absent)], pa.nulls(len(at), pa.string()), pa.array(count, pa.int64())],
                    schema=pa.schema(fields),
                )
                # texts of the words that phrases can hold, once a task
                used = goes_on.copy()
                used[1:] |= goes_on[:-1]
                hashes, at = np.unique(found.hash[used].view(np.int64), return_index=True)
                spots = np.flatnonzero(used)[at]
                fresh = [i for i, h in enumerate(hashes.tolist()) if h not in kept]
                if fresh:
                    if len(kept) < HELD:
                        kept.update(hashes[fresh].tolist())
                    folded = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8).tobytes()
                    texts = [folded[found.start[i] : found.end[i]] for i in spots[fresh]]
                    m = len(fresh)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([""] * m), pa.array(hashes[fresh]), *[pa.nulls(m, pa.int64())] * 4, pa.array(texts, pa.binary()).cast(pa.string()), pa.array([0] * m, pa.int64())],
                        schema=pa.schema(fields),
                    )

    return run


def counted_windows(docs: DataFrame, least: int) -> DataFrame:
    """Counts of the padded five-word windows, and rows with the text of each word hash."""
    spark = docs.sparkSession
    bounded_batches(spark)
    bitmap = spark.sparkContext.broadcast(frequent_pairs(docs, least))
    kinds = "lang string, " + ", ".join(f"{c} long" for c in COLUMNS) + ", word string, n long"
    rows = docs.select("lang", "text").mapInArrow(_windows(bitmap), kinds)
    return rows.groupBy("lang", *COLUMNS, "word").agg(F.sum("n").alias("n"))


def phrase_counts(windows: DataFrame, least: int) -> DataFrame:
    """(lang, k, words, n): the language's total (k = 0) and every phrase of 1 to 5 words with ``least`` occurrences."""
    rolled = windows.rollup("lang", *COLUMNS).agg(F.sum("n").alias("n"), F.grouping_id().alias("left_out"))
    k = F.lit(None).cast("int")
    for i in range(6):
        k = F.when(F.col("left_out") == (1 << (5 - i)) - 1, F.lit(i)).otherwise(k)
    # a prefix that ends in padding repeats a shorter phrase
    words = F.filter(F.array(*COLUMNS), lambda w: w.isNotNull())
    rows = rolled.select("lang", k.alias("k"), words.alias("words"), "n")
    return rows.where((F.size("words") == F.col("k")) & ((F.col("k") == 0) | (F.col("n") >= least)))


def phrases(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A text is cut into pieces at ``. , ; : ! ?`` and 0x0A-0x0D, a piece into words at
    spaces and tabs; A-Z is lower-cased.  A phrase of 2 to 5 words inside a piece with
    a >= ``least`` occurrences is a candidate; n counts the language's words.  Cut after
    its first words it has l and r occurrences of its parts and floor(1000 * a * n / (l * r))
    as score; the lowest cut counts, the shorter first part among equals.  A candidate
    goes where a longer candidate, dropped or not, holds it in a row and
    100 * its count >= ``percent`` * a.  Each language's first ``top`` stay, by score, a
    (both descending) and phrase (UTF-8 bytes).

    A null language is ``und``.  Null, empty and blank texts hold no words; rows that
    repeat count each.  Texts are read whole.  An empty table gives an empty table.  Only
    ``lang`` and ``text`` are read.
    """
    windows = stored(counted_windows(docs, settings.least), "windows")
    dictionary = stored(windows.where("word IS NOT NULL").groupBy("w1").agg(F.min("word").alias("word")), "words")
    counts = stored(phrase_counts(windows.where("word IS NULL").drop("word"), settings.least), "phrases")
    totals = counts.where("k = 0").select("lang", F.col("n").alias("total"))
    parts = counts.where("k > 0").select("lang", "words", "n")
    found = counts.where("k > 1").select("lang", "words", "k", F.col("n").alias("a"))

    cuts = found.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    cuts = cuts.withColumns({"first": F.expr("slice(words, 1, cut)"), "rest": F.expr("slice(words, cut + 1, k - cut)")})
    cuts = cuts.join(parts.select("lang", F.col("words").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("words").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = by_size(cuts, stored(totals, "totals"), "lang")
    score = F.expr("(1000BD * cast(a as decimal(16, 0)) * cast(total as decimal(17, 0))) div (cast(l as decimal(17, 0)) * cast(r as decimal(17, 0)))")
    lowest = cuts.select("lang", "words", "a", "total", F.struct(score.alias("score"), "cut", "l", "r").alias("at"))
    scored = lowest.groupBy("lang", "words").agg(F.min("at").alias("at"), F.first("a").alias("a"), F.first("total").alias("total"))

    # a longer candidate holds one of one word more that occurs at least as often, so one step is enough
    inner = found.where("k > 2").select(
        "lang", F.explode(F.array(F.expr("slice(words, 1, k - 1)"), F.expr("slice(words, 2, k - 1)"))).alias("words"), F.col("a").alias("longer")
    )
    inner = inner.groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    left = scored.join(inner, ["lang", "words"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * settings.percent)
    )
    left = stored(left.drop("longer"), "candidates")

    spelled = left.select("lang", "words", F.posexplode("words").alias("pos", "w1"))
    spelled = by_size(spelled, dictionary, "w1").groupBy("lang", "words").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("texts"))
    full = left.join(spelled, ["lang", "words"]).select(
        "lang", F.array_join(F.col("texts.word"), " ").alias("phrase"), "a", "at.l", "at.r", F.col("total").alias("n"), F.col("at.score").cast("long").alias("score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = full.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= settings.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL11 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
parts AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM parts GROUP BY lang),
grams AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS phrase
  FROM parts),
f AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM grams GROUP BY lang, phrase HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, w, a, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n, CAST(1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT DISTINCT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(w))) AS m FROM f WHERE len(w) > 2))),
left_over AS (SELECT * FROM lowest c WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_over QUALIFY rank <= 2000
"""
