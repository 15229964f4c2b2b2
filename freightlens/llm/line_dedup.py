"""Line dedup with levelled sorted runs of line hashes.

Only DataFrame functions.  Documents are taken in batches of ascending doc_id.  A batch
groups its lines by hash, merge-anti-joins the runs of all earlier batches, and adds the
hashes that are new as its own sorted run.  Once a level holds ``fanout`` runs they are
merged into one run of the next level, so a batch meets few runs however many came
before.  As ids ascend, a line known to a run belongs to an earlier document, and the
smallest id of a new line's batch is its smallest id of all.

A line's hash is two 64-bit hashes of its key.  A line that makes up more than one in
``HOT_SHARE`` of a batch is looked up from a broadcast table of at most ``HOT_SHARE``
rows; all other lines meet the batch's run by a shuffled join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, new_path
from .joins import free_name

#: Lines whose key has fewer code points are never dropped.
MIN_POINTS = 10
BATCHES = 6
FANOUT = 3
HOT_SHARE = 2000
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: without blanks at both ends, A-Z lower-cased."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(BLANKS)))
    return F.transform(bare, lambda x: F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))


def hashed_lines(docs: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, doc_key, pos, h1, h2) of every line whose key is long enough; pos counts from 0."""
    keys = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), F.posexplode(line_keys(F.col("text"))).alias("pos", "key"))
    keys = keys.where(F.char_length("key") >= min_points)
    return keys.select("doc_id", "doc_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class Runs:
    """Sorted runs of hashes (h1, h2, owner), bucketed alike so that merging them moves no rows."""

    def __init__(self, spark, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        writer = rows.repartition(self.buckets, "h1", "h2").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        writer.option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, self.paths.pop(name))

    def unknown(self, hashes: DataFrame) -> DataFrame:
        """The rows of ``hashes`` that no run holds."""
        for name in [n for level in self.levels for n in level]:
            hashes = hashes.join(self.spark.table(name).hint("merge"), ["h1", "h2"], "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> DataFrame:
        """Add the unknown rows of ``hashes`` as a run of their own and return it."""
        name = self._write(self.unknown(hashes))
        own = self.spark.table(name)
        self.levels = self.levels or [[]]
        self.levels[0].append(name)
        return own

    def compact(self) -> None:
        """Merge every level that holds ``fanout`` runs into one run of the next."""
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                old = self.levels[i]
                merged = self.spark.table(old[0])
                for name in old[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(merged))
                self.levels[i] = []
                for name in old:
                    self._drop(name)

    def close(self) -> None:
        for name in list(self.paths):
            self._drop(name)


def repeated_in_batch(lines: DataFrame, runs: Runs) -> str:
    """Write (doc_id, doc_key, pos) of the batch's lines that an earlier document holds and add the batch to the runs; returns the path."""
    spark, path = lines.sparkSession, new_path(lines.sparkSession, "line-firsts")
    firsts = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"))
    firsts.write.parquet(path)
    firsts = spark.read.schema(firsts.schema).parquet(path)
    total = firsts.agg(F.sum("n")).first()[0] or 0
    own = runs.add(firsts.select("h1", "h2", "owner")).withColumn("new", F.lit(True))
    # at most HOT_SHARE keys can hold that share of the lines
    hot = firsts.where(F.col("n") * HOT_SHARE > total).select("h1", "h2").join(own, ["h1", "h2"], "left")
    later = F.col("new").isNull() | ~F.col("owner").eqNullSafe(F.col("doc_id"))
    hot = hot.withColumn("hot", F.lit(True))
    split = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    frequent = split.where(F.col("hot") & later)
    others = split.where("hot IS NULL").drop("hot", "owner", "new").join(own.hint("merge"), ["h1", "h2"], "left").where(later)
    columns = ["doc_id", "doc_key", "pos"]
    out = new_path(spark, "line-drops")
    frequent.select(columns).unionByName(others.select(columns)).write.parquet(out)
    discard(spark, path)
    return out


def repeated_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_points: int = MIN_POINTS) -> DataFrame:
    """(doc_id, doc_key, gone): per document the positions of the lines that an earlier document holds."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    shares = [(i + 1) / batches for i in range(batches - 1)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares)).first()[0] if shares else []
    number = F.lit(0)
    for bound in bounds or []:
        number = number + (F.col("doc_id") > F.lit(bound)).cast("int")
    lines = hashed_lines(docs, min_points)
    lines = lines.withColumn("batch", F.when(F.col("doc_id").isNull(), F.lit(batches - 1)).otherwise(number))
    path = new_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs, outs = Runs(spark, fanout), []
    for i in range(batches):
        outs.append(repeated_in_batch(lines.where(F.col("batch") == i).drop("batch"), runs))
        runs.compact()
    runs.close()
    discard(spark, path)
    drops = spark.read.schema(lines.select("doc_id", "doc_key", "pos").schema).parquet(*outs)
    return drops.groupBy("doc_id", "doc_key").agg(F.collect_set("pos").alias("gone"))


def with_kept_lines(docs: DataFrame, out: str, **settings) -> DataFrame:
    """``docs`` with a struct column ``out``: text, n_lines, n_dropped."""
    key, own, gone, id_ = (free_name([*docs.columns, out], c) for c in ("line_doc", "line_own", "line_gone", "line_id"))
    drops = repeated_lines(docs, **settings).toDF(id_, own, gone)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(drops, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(own)), "left")
    # the inner variable binds the lines once; what is left is found by hashing, in linear time
    whole = F.transform(
        F.array(F.split(F.coalesce("text", F.lit("")), "\n")),
        lambda lines: F.struct(
            F.array_join(
                F.transform(
                    F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(gone, F.array().cast("array<int>"))), lambda i: F.get(lines, i)
                ),
                "\n",
            ).alias("text"),
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long").alias("n_dropped"),
        ),
    )
    return joined.withColumn(out, F.element_at(whole, 1)).drop(key, own, gone, id_)


def drop_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with each repeated line left only in the document of the smallest id that holds it.

    A line's key is the line without blanks (space, 0x09-0x0D) at both ends, A-Z
    lower-cased.  Keys of at least ``min_points`` code points that two documents hold
    lose all lines but those of the smallest doc_id; that document keeps all of its own.
    Lines are cut at \\n only, kept as they are and joined by \\n.  A null text counts as
    empty, which is one empty line, and comes back empty.  Rows of one doc_id are one
    document: they own a line together.  A null doc_id is an id after all others.  Texts
    of any length are read whole.  An empty table gives an empty table.  Other columns,
    whatever their names, stay as they are.
    """
    out = free_name(docs.columns, "kept_lines")
    kept = with_kept_lines(docs, out, **settings)
    return kept.withColumn("text", F.col(out).getField("text")).select(docs.columns)


def op13(spark, sf_dir: str) -> DataFrame:
    """Per document: lines, dropped lines, and the hash of the text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_kept_lines(docs, "kept").select("doc_id", "kept.n_lines", "kept.n_dropped", F.sha2("kept.text", 256).alias("kept_sha256"))


SQL13 = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT r, doc_id, line, pos, length(k) < 10 OR owner IS NOT DISTINCT FROM doc_id AS keep FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keep), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
