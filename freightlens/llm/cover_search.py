"""Exact top-k inner products by dual-tree cover-tree search, in blocks.

Queries and candidates are dealt into blocks by hash; every query block meets every
candidate block once, in its own task.  Inside, both get a cover tree: a node's points
lie within its radius of its centre, and its children's centres are picked farthest
first until they cover it at half the radius, or are ``FAN`` in number.  All distances of
a level are one matrix product, so a tree costs a few per cent of what comparing the
blocks would.  For a query node with centre q, radius a and a candidate node with centre
c, radius b, no score exceeds q.c + a |c| + b |q| + a b.  Pairs of nodes are visited by
this bound, the best first, and dropped once it is below the worst k-th score of the
node's queries; two leaves meet only in the queries whose own bound q.c + b |q| still
counts.  Equal bounds stay, so ties resolve by id.  The k best of each block are merged
per query.

Vectors are integers, so products are exact.  Block sizes bound a task's memory
whatever the number of rows.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from ..session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a leaf, children of a node, rows the children's centres are picked from.
LEAF, FAN, PICKED = 256, 32, 1024
SLACK = 1e-6


@dataclass(frozen=True)
class Settings:
    """Results per query, queries per block, candidates per block."""

    k: int = 20
    queries: int = 4096
    candidates: int = 16384


class Node:
    __slots__ = ("center", "norm", "radius", "rows", "children")

    def __init__(self, center, radius, rows, children):
        self.center, self.radius, self.rows, self.children = center, radius, rows, children
        self.norm = float(np.sqrt(center @ center))


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _centres(x: np.ndarray, start: np.ndarray, radius: float) -> np.ndarray:
    """Points of ``x``, farthest first, until they cover it at half the radius."""
    picked = [int(np.argmax(_squares(x - start)))]
    near = _squares(x - x[picked[0]])
    while len(picked) < FAN and near.max() > (radius / 2) ** 2:
        picked.append(int(np.argmax(near)))
        near = np.minimum(near, _squares(x - x[picked[-1]]))
    return x[picked]


def cover_tree(x: np.ndarray, rows: np.ndarray) -> Node:
    """A cover tree of some rows of ``x``; small or single-valued sets are leaves."""
    own = x[rows]
    center = own.mean(0)
    radius = float(np.sqrt(_squares(own - center).max()))
    if len(rows) <= LEAF or radius == 0:
        return Node(center, radius, rows, [])
    step = -(-len(rows) // PICKED)
    centres = _centres(own[::step], center, radius)
    nearest = np.argmin(_squares(centres)[None, :] - 2 * (own @ centres.T), axis=1)
    order = np.argsort(nearest, kind="stable")
    parts = np.split(rows[order], np.flatnonzero(np.diff(nearest[order])) + 1)
    if len(parts) == 1:  # the picked rows are all alike
        parts = np.array_split(rows, -(-len(rows) // LEAF))
    # sets too small for a node of their own share leaves, neighbours by centre
    children, loose = [], []
    for part in parts:
        if len(part) > LEAF // 2:
            children.append(cover_tree(x, part))
            continue
        loose.append(part)
        if sum(map(len, loose)) > LEAF // 2:
            children.append(cover_tree(x, np.concatenate(loose)))
            loose = []
    if loose:
        children.append(cover_tree(x, np.concatenate(loose)))
    return Node(center, radius, rows, children)


class Search:
    """The k best candidates of every query of one pair of blocks; ``compared`` counts the products it took."""

    def __init__(self, q, q_ids, c, c_ids, k):
        self.q, self.q_ids, self.c, self.c_ids, self.k = q, q_ids, c, c_ids, k
        self.score = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.norm = np.sqrt(_squares(q)) if len(q) else np.zeros(0)
        self.compared = 0

    def run(self):
        if len(self.q) and len(self.c):
            self.visit(cover_tree(self.q, np.arange(len(self.q))), cover_tree(self.c, np.arange(len(self.c))))
        return self.score, self.ids

    def visit(self, a: Node, b: Node):
        if not (a.children or b.children):
            self.compare(a.rows, b)
            return
        for bound, x, y in sorted(self.pairs(a, b), key=lambda t: -t[0]):
            if bound + SLACK * (1 + abs(bound)) >= self.score[x.rows, -1].min():
                self.visit(x, y)

    def pairs(self, a: Node, b: Node):
        """The children of both nodes with their bounds, by one matrix product."""
        left, right = a.children or [a], b.children or [b]
        ra, rb = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        na, nb = np.array([n.norm for n in left]), np.array([n.norm for n in right])
        bound = np.stack([n.center for n in left]) @ np.stack([n.center for n in right]).T + ra[:, None] * nb + na[:, None] * rb + ra[:, None] * rb
        return [(bound[i, j], x, y) for i, x in enumerate(left) for j, y in enumerate(right)]

    def compare(self, rows: np.ndarray, node: Node):
        own = self.q[rows] @ node.center + self.norm[rows] * node.radius
        rows = rows[own + SLACK * (1 + np.abs(own)) >= self.score[rows, -1]]
        others = node.rows
        if not len(rows):
            return
        self.compared += len(rows) * len(others)
        s = self.q[rows] @ self.c[others].T
        s[self.q_ids[rows][:, None] == self.c_ids[others][None, :]] = -np.inf
        good = s >= self.score[rows, -1][:, None]
        if np.count_nonzero(good) > 2 * self.k * len(rows) and s.shape[1] > self.k:
            # what is below the k-th score of this leaf alone can't stay either
            good &= s >= -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        use = np.flatnonzero(good.any(1))
        if not len(use):
            return
        row, column = np.nonzero(good[use])
        rows = rows[use]
        # the kept ones and the new ones of each query, best first, smaller ids first among equals
        owner = np.concatenate([np.repeat(np.arange(len(rows)), self.k), row])
        score = np.concatenate([self.score[rows].ravel(), s[use][row, column]])
        ids = np.concatenate([self.ids[rows].ravel(), self.c_ids[others[column]]])
        order = np.lexsort((ids, -score, owner))
        begin = np.searchsorted(owner[order], np.arange(len(rows)))
        best = order[begin[:, None] + np.arange(self.k)]
        self.score[rows], self.ids[rows] = score[best], ids[best]


def top_k(queries: DataFrame, candidates: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates other than itself.

    Both tables have vec_id and an integer array ``v``; vectors of other lengths than
    a query's don't match it.  Rows without an id or a vector take no part.  Repeated
    ids count as one row, whichever comes first by vector.  Empty tables give none.
    """
    queries, candidates = (stored(t.where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")), "vectors") for t in (queries, candidates))
    q_blocks = max(1, -(-queries.count() // cfg.queries))
    c_blocks = max(1, -(-candidates.count() // cfg.candidates))
    mine = queries.select("vec_id", "v", F.lit(True).alias("query"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("cb"))
    theirs = candidates.select("vec_id", "v", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("vec_id"), F.lit(c_blocks)).alias("cb"))

    def search(table: pa.Table) -> pa.Table:
        query = table["query"].to_numpy(zero_copy_only=False)
        ids = table["vec_id"].to_numpy()
        vectors = table["v"].combine_chunks()
        sizes = np.diff(np.asarray(vectors.offsets))
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = []
        for size in np.unique(sizes[query]):
            pick = [np.flatnonzero(m & (sizes == size)) for m in (query, ~query)]
            q, c = (flat[(starts[p][:, None] + np.arange(size)).reshape(-1)].reshape(len(p), size) for p in pick)
            score, found = Search(q, ids[pick[0]], c, ids[pick[1]], cfg.k).run()
            ok = np.isfinite(score)
            out.append(pa.table({"query_id": np.repeat(ids[pick[0]], ok.sum(1)), "vec_id": found[ok], "score": score[ok].astype(np.int64)}))
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        return pa.concat_tables(out) if out else kind.empty_table()

    best = mine.unionByName(theirs).groupBy("qb", "cb").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and floor(64 x) of each component; null for a vector that is null or holds a null or non-finite component."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("long"))
    wrong = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embeddings.select("vec_id", F.when(~wrong, whole).alias("v"))


def op5(spark, sf_dir: str) -> DataFrame:
    """The 20 best candidates of every twentieth vector of ``embeddings``."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)


SQL5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
