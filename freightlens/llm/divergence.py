"""Source divergence audit by one-hot level products.

A term's share in a source depends on its count there only: its *level*.  Two sources'
divergence therefore needs no terms, just the joint table of how many terms have level
a in the one and level b in the other.  Terms are dealt into blocks; a block is an
indicator matrix with one column per (source, level), and its transpose times itself, in
tiles, holds the joint tables of all pairs of sources at once.  Each table is priced with
whole numbers where it was made, and the prices of the blocks are summed by Spark.

Blocks hold terms of similar counts, so that few levels occur in one block.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored
from . import words as wd
from .joins import bounded_batches, by_size

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_DOCS = 10
TOP = 10
UNIT = 1_000_000_000
#: Terms of a block and columns of a tile; counts in a product stay below 2^24, where float32 is exact.
BLOCK_TERMS, TILE = 2048, 2048
#: Bytes that end a term: all ASCII but letters.
OTHERS = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])


def _term_counts(batches):
    """Per slice: (lang, source, term, n, docs)."""
    for batch in batches:
        both = pa.StructArray.from_arrays([pc.fill_null(batch.column(c), "") for c in ("lang", "source")], ["lang", "source"])
        groups: dict = {}
        code = np.array([groups.setdefault((x["lang"], x["source"]), len(groups)) for x in both.to_pylist()], np.int64)
        names = list(groups)
        for lo, raw, offsets in wd.slices(batch.column("text"), 1 << 19):
            found = wd.Words(raw, offsets, spaces=OTHERS)
            if not len(found.hash):
                continue
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(found.first))
            group = code[lo + doc]
            # sorted by (group, word, document): runs are words of a group, and of a document
            order = np.lexsort((doc, found.hash, group))
            g, h, d = group[order], found.hash[order], doc[order]
            new = np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))
            in_doc = new | np.append(True, d[1:] != d[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(order)))
            docs = np.add.reduceat(in_doc.astype(np.int64), at)
            folded = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8).tobytes()
            spots = order[at]
            terms = [folded[a:b] for a, b in zip(found.start[spots].tolist(), found.end[spots].tolist())]
            own = g[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in names]).take(pa.array(own)),
                    pa.array([x[1] for x in names]).take(pa.array(own)),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(n, pa.int64()),
                    pa.array(docs, pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, levels): terms in ``min_docs`` documents of a language; levels lists (source, n)."""
    bounded_batches(docs.sparkSession)
    counts = (
        docs.select("lang", "source", "text")
        .mapInArrow(_term_counts, "lang string, source string, term string, n long, docs long")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    return (
        counts.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("levels"))
        .where(F.col("docs") >= min_docs)
        .drop("docs")
    )


def share(count: str, total: str, terms: str) -> str:
    """p of a count as exact SQL over whole numbers."""
    top = f"{UNIT}BD * (cast({count} as decimal(18, 0)) + 2BD)"
    return f"1 + ({top} div (cast({total} as decimal(18, 0)) + 2BD * cast({terms} as decimal(18, 0))))"


def group_sizes(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, total, terms, lang_total) of every group that occurs, however few terms it has."""
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    own = terms.select("lang", F.inline("levels")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    sizes = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    return sizes.na.fill(0, ["total", "terms", "lang_total"])


def _priced(batches):
    """Per block: the summed price of every pair of its language's sources."""
    for batch in batches:
        for lang, sources, totals, v, rows in zip(*(batch.column(c) for c in ("lang", "sources", "totals", "terms", "rows"))):
            sources, totals, v = sources.as_py(), totals.as_py(), v.as_py()
            position = {s: i for i, s in enumerate(sources)}
            n_terms, width = len(rows), len(sources)
            flat = rows.values
            sizes = np.diff(np.append(np.asarray([0]), np.cumsum([len(x) for x in rows])))
            term = np.repeat(np.arange(n_terms), sizes)
            inner = flat.flatten()
            own = np.array([position[s] for s in inner.field("source").to_pylist()], np.int64)
            count = inner.field("n").to_numpy(zero_copy_only=False)
            level = np.zeros((n_terms, width), np.int64)
            level[term, own] = count
            yield _block(lang.as_py(), sources, totals, v, level)


def _block(lang: str, sources: list, totals: list, v: int, level: np.ndarray) -> pa.RecordBatch:
    """Price the joint tables of one block of terms; ``level`` is (term, source) -> count."""
    n_terms, width = level.shape
    column = np.empty((n_terms, width), np.int64)
    group, price = [], []
    for j in range(width):
        values, back = np.unique(level[:, j], return_inverse=True)
        column[:, j] = back + len(group)
        group += [j] * len(values)
        # whole numbers of any size
        price += [1 + UNIT * (int(c) + 2) // (int(totals[j]) + 2 * v) for c in values]
    group, price = np.array(group), np.array(price, np.int64)
    rows = np.repeat(np.arange(n_terms), width)
    columns = column.ravel()
    out = np.zeros((width, width), np.int64)
    tiles = []
    for lo in range(0, len(price), TILE):
        inside = (columns >= lo) & (columns < lo + TILE)
        one_hot = np.zeros((n_terms, min(TILE, len(price) - lo)), np.float32)
        one_hot[rows[inside], columns[inside] - lo] = 1
        tiles.append((lo, one_hot))
    for i, (lo, x) in enumerate(tiles):
        for hi, y in tiles[i:]:
            joint = x.T @ y
            a, b = np.nonzero(joint)
            terms = joint[a, b].astype(np.int64)
            p, q = price[a + lo], price[b + hi]
            np.add.at(out, (group[a + lo], group[b + hi]), terms * ((p - q) * (p - q) // (p + q)))
    # a pair of columns lies in one tile product; within a tile both orders occur, across tiles one
    out = np.where(np.arange(width)[:, None] < np.arange(width)[None, :], out, 0)
    a, b = np.nonzero(out)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(a), pa.string()), pa.array([sources[i] for i in a], pa.string()), pa.array([sources[i] for i in b], pa.string()), pa.array(out[a, b])],
        ["lang", "source", "item", "value"],
    )


def pair_values(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every pair of a language's sources, in one order each; pairs worth 0 are left out."""
    band = F.floor(F.log2("total"))
    blocks = terms.groupBy("lang", band.alias("band")).agg(F.ceil(F.count("*") / BLOCK_TERMS).alias("blocks"))
    dealt = by_size(terms.withColumn("band", band), stored(blocks, "bands"), ["lang", "band"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    rows = dealt.groupBy("lang", "band", "block").agg(F.collect_list("levels").alias("rows"))
    order = F.sort_array(F.collect_list(F.struct("source", "total")))
    sources = sizes.groupBy("lang", "terms").agg(order.alias("all")).select("lang", "terms", F.col("all.source").alias("sources"), F.col("all.total").alias("totals"))
    blocked = by_size(rows, stored(sources, "sources"), "lang").select("lang", "sources", "totals", "terms", "rows")
    priced = blocked.mapInArrow(_priced, "lang string, source string, item string, value long")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """How far each (lang, source) lies from its language's other sources and from the language.

    Returns lang, source, part, item, value, rank.  A term is a run of letters A-Z, a-z
    or non-ASCII characters, A-Z lower-cased; a language keeps the terms that
    ``min_docs`` of its documents hold (V in number).  A group gives a term with count c
    the share p = 1 + floor(10^9 (c + 2) / (N + 2 V)), N being its count of kept terms;
    f = floor((p - q)^2 / (p + q)).  Part ``pair``: f summed over the kept terms for
    every other source of the language, each order a row.  Part ``term``: the ``top``
    terms that the group uses more than the language, by f.  Ranks go by value
    descending, then item in UTF-8 order.

    Null text, lang and source count as ''.  A group without a term has rows against
    all others; without kept terms the value is 0.  Rows that repeat are documents of
    their own.  An empty table gives an empty table.  Only text, lang and source are read.
    """
    terms = stored(kept_terms(docs, min_docs), "terms")
    sizes = stored(group_sizes(docs, terms), "groups")

    one_way = stored(pair_values(terms, sizes), "pairs")
    both = one_way.unionByName(one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # the result itself: every source of a language against every other one
    others = sizes.select("lang", "source").join(sizes.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(both, ["lang", "source", "item"], "left").na.fill(0, ["value"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    used = by_size(terms.select("lang", "term", F.col("total").alias("all"), F.inline("levels")), sizes, ["lang", "source"])
    used = used.select("lang", "source", F.col("term").alias("item"), F.expr(share("n", "total", "terms")).alias("p"), F.expr(share("`all`", "lang_total", "terms")).alias("q"))
    worth = F.expr("(cast(p - q as decimal(19, 0)) * cast(p - q as decimal(19, 0))) div cast(p + q as decimal(19, 0))")
    used = used.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", worth.cast("long").alias("value"))
    first = used.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(first.select(pairs.columns))


def op12(spark, sf_dir: str) -> DataFrame:
    """All pairs of sources of a language, and each source's ten terms most above its language."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL12 = """
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
uses AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM uses GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM uses SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY g.lang, g.source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (g.n + 2 * v.v) AS p,
         1 + 1000000000::HUGEINT * (k.c + 2) // (v.n + 2 * v.v) AS q
  FROM sizes g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM shares WHERE c > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms QUALIFY rank <= 10
"""
