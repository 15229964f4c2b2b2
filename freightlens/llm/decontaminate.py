"""Benchmark passages inside documents: size-partitioned MinHash containment search.

Only DataFrame functions.  Test items are partitioned by their number of shingles, a
class per power of two, and each class has its own sketch and its own test.  An item's
sketch is its smallest hash values.  Small items keep a fifth of them and one more: an
item that is contained to 80 % lacks at most a fifth, so at least one of these occurs in
the document, without any loss.  From 80 shingles on it is 16 values, of which 3 have to
occur (with a true containment of 0.8 fewer do with probability about 1 in 10^8).  The
share of an item's minima among a document's shingles says how much of the item the
document contains, whatever the document's length, so a short item is found in a very
long text.  A class's cut is the largest value its sketches hold; a document's shingles
above all cuts are never looked up.  Candidates are confirmed by exact containment of
the distinct shingle sets.

An item of fewer words than a shingle is one hash of all its words.  Where ``short`` is
set, a document's runs of as many words are looked up too, for the sizes that occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .joins import by_size, free_name

WORDS = 5
PERCENT = 80
MINIMA = 16
HITS = 3


def shingle_hashes(text: Column, k: int = WORDS) -> Column:
    """Hashes of the k-word shingles of a text; fewer words are one shingle, no words none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")
    # the inner variable binds the words once for all shingles of a row
    each = F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k))))
        .when(F.size(w) > 0, F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>")),
    )
    return F.element_at(each, 1)


def item_sketches(benchmark: DataFrame) -> DataFrame:
    """item_id, its shingles, their number, size class, minima and the hits they need.  Items without a word or an id take no part."""
    fifth = F.floor(F.col("n") * (100 - PERCENT) / 100) + 1  # one of so many shingles occurs in any document that contains the item
    return (
        benchmark.where("item_id IS NOT NULL")
        .select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.col("text")))).alias("grams"))
        .withColumn("n", F.size("grams"))
        .where("n > 0")
        .withColumn("class", F.floor(F.log2("n")).cast("int"))
        .withColumn("need", F.when(fifth <= MINIMA, 1).otherwise(HITS))
        .withColumn("minima", F.slice("grams", F.lit(1), F.least(fifth, F.lit(MINIMA)).cast("int")))
    )


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), ""))


def short_sizes(benchmark: DataFrame) -> list[int]:
    """The numbers of words, below a shingle's, that items have."""
    size = n_words(F.col("text"))
    return sorted(r[0] for r in benchmark.where("item_id IS NOT NULL").select(size.alias("k")).where((F.col("k") > 0) & (F.col("k") < WORDS)).distinct().collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """Per document and contained test item: n_shingles of the item, n_shared, containment.

    A document contains an item if at least 80 % of the item's distinct five-word
    shingles occur in it.  An item of 1 to 4 words is one shingle: a document contains it
    if it has these words and no others or, with ``short`` (as ``SQL10`` states it), if
    they follow each other anywhere in it.  ``doc_key`` tells rows of equal id but other texts apart;
    rows that repeat id and text give one row.  A null id is an id like others; null
    and empty texts contain nothing.  Items of one id and several texts count each
    by itself, the best stays.  Other columns of either table are not read.
    """
    items = stored(item_sketches(benchmark.select("item_id", "text")), "items")
    index = items.select("item_id", "n", "class", "need", F.explode("minima").alias("h"), F.xxhash64("grams").alias("item_key"))
    index = stored(index, "minima")
    cuts = index.groupBy("class").agg(F.max("h").alias("cut"))
    cut = cuts.agg(F.max("cut")).first()[0]
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    sizes = short_sizes(benchmark) if short else []

    def looked_up(text):
        hashes = shingle_hashes(text)
        return F.array_distinct(F.concat(hashes, *[shingle_hashes(text, k) for k in sizes])) if sizes else hashes

    looked = keyed.select("doc_id", "doc_key", F.explode(looked_up(F.col("text"))).alias("h"))
    looked = looked.where(F.col("h") <= F.lit(cut if cut is not None else 0))
    hits = by_size(looked, index, "h")
    pairs = stored(
        hits.groupBy("doc_id", "doc_key", "item_id", "item_key", "n", "need").agg(F.count_distinct("h").alias("hits")).where("hits >= need"),
        "pairs",
    )
    keys = stored(pairs.select("doc_key").distinct(), "keys")
    texts = by_size(keyed, keys, "doc_key", "left_semi").dropDuplicates(["doc_key"])
    grams = stored(texts.select("doc_key", looked_up(F.col("text")).alias("found")), "grams")
    both = pairs.drop("need", "hits").join(grams, "doc_key").join(
        items.select("item_id", F.xxhash64("grams").alias("item_key"), "grams").dropDuplicates(["item_id", "item_key"]), ["item_id", "item_key"]
    )
    return (
        both.withColumn("shared", F.size(F.array_intersect("grams", "found")))
        .where(F.col("shared") * 100 >= F.col("n") * PERCENT)
        .groupBy("doc_id", "doc_key", "item_id")
        .agg(F.max_by(F.struct("n", "shared"), F.col("shared") / F.col("n")).alias("best"))
        .select("doc_id", "doc_key", "item_id", F.col("best.n").cast("long").alias("n_shingles"), F.col("best.shared").cast("long").alias("n_shared"), (F.col("best.shared") / F.col("best.n")).alias("containment"))
    )


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no test item."""
    key = free_name(docs.columns, "item_doc")
    bad = stored(contaminated(docs, benchmark, short=True).select(F.col("doc_key").alias(key)).distinct(), "contaminated")
    return by_size(docs.withColumn(key, F.xxhash64("doc_id", "text")), bad, key, "left_anti").drop(key)


def op10(spark, sf_dir: str) -> DataFrame:
    """Every (document, test item) pair where the document contains the item."""
    read = spark.read.parquet
    return contaminated(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet"), short=True).drop("doc_key")


#: The same pairs by an equality join of all exact shingles, as texts; items of 1 to 4 words meet runs of as many words.
SQL10 = """
WITH words AS (
  SELECT doc_id AS id, 0 AS side, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT item_id, 1, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 5) AS k FROM words WHERE side = 1 AND len(w) > 0),
grams AS (
  SELECT DISTINCT id, side, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM words, sizes WHERE len(w) >= k AND (side = 0 OR k = least(len(w), 5))),
items AS (SELECT id AS item_id, g, count(*) OVER (PARTITION BY id) AS n FROM grams WHERE side = 1)
SELECT d.id AS doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM grams d JOIN items USING (g) WHERE d.side = 0
GROUP BY d.id, item_id, n HAVING count(*) * 100 >= n * 80
"""
