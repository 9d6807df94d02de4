"""Exact top-k inner products by M-trees, one for each block of vectors.

Inner products become a metric by one more coordinate, sqrt(M^2 - |x|^2) with the
block's largest norm M (0 for queries): |q - x|^2 = |q|^2 + M^2 - 2 q.x. A tree
has pages of routing objects with covering radii and distances to the parent; a
search takes pages by least possible distance, and stored distances rule out
entries (by the triangle inequality) before any distance is computed. Scores are
integers, so results are exact, ties included; bounds keep a slack below one
unit of score. Queries are searched in batches by one best-first queue of pages: an entry is a
page with the queries that have it in one place of their own order, keyed by
their least bound, and those queries share the page's distances. Blocks have a fixed size: no task grows with the table, and the
k best of each query and block are merged by a ranked shuffle.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; a query is compared with the vectors of its own length;
scores are exact below 2^53; a query has fewer than k rows if there are fewer
candidates; a repeated vec_id is a row each time, and a query leaves out every
row of its own id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from colonnade.llm.sparkio import stored

PAGE, FAN, BLOCK, QUERIES = 512, 32, 16384, 8192


class Node:
    __slots__ = ("center", "children", "entries", "ids", "leaf", "radius", "to_parent")


class MTree:
    """points (n x d) are paged by distance to pivots; ids order ties."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, page: int = PAGE, fan: int = FAN):
        self.points, self.ids, self.page, self.fan = points, ids, page, fan
        self.computed = 0
        self.root = self._build(np.arange(len(points)), points.mean(0) if len(points) else np.zeros(points.shape[1]))

    def _distances(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((self.points[rows] - to) ** 2).sum(1), 0))

    def _build(self, rows: np.ndarray, center: np.ndarray) -> Node:
        node = Node()
        node.center = center
        d = self._distances(rows, center)
        node.radius = float(d.max(initial=0))
        node.leaf = len(rows) <= self.page or node.radius == 0
        node.children = []
        if node.leaf:
            order = np.argsort(d, kind="stable")
            node.entries, node.ids, node.to_parent = self.points[rows[order]], self.ids[rows[order]], d[order]
            return node
        pivots = [int(np.argmax(d))]
        nearest = self._distances(rows, self.points[rows[pivots[0]]])
        home = np.zeros(len(rows), np.int64)
        fan = min(self.fan, max(2, -(-2 * len(rows) // self.page)))
        while len(pivots) < fan and nearest.max() > 0:
            pivots.append(int(np.argmax(nearest)))
            to = self._distances(rows, self.points[rows[pivots[-1]]])
            closer = to < nearest
            home[closer], nearest = len(pivots) - 1, np.minimum(to, nearest)
        node.children = [self._build(rows[home == k], self.points[rows[home == k]].mean(0)) for k in range(len(pivots)) if (home == k).any()]
        node.entries = np.stack([c.center for c in node.children])
        node.to_parent = np.sqrt(((node.entries - center) ** 2).sum(1))
        return node

    def search(self, queries: np.ndarray, k: int, skip: np.ndarray, slack: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k largest inner products and their ids, in no order; -inf where there are fewer.

        skip: each query's own id, whose rows don't count. Ties at the k-th place go to smaller ids.
        """
        state = _Search(queries, k, skip, slack, float((self.points**2).sum(1).max(initial=0)))
        everyone = np.arange(len(queries))
        d = np.sqrt(np.maximum(((queries - self.root.center) ** 2).sum(1), 0))
        queue = [(0.0, 0, self.root, everyone, d, np.zeros(len(queries)))]
        pushed = 1
        while queue:
            _, _, node, who, dist, bound = heapq.heappop(queue)
            go = bound <= state.reach(who)
            if not go.any():
                continue
            who, dist = who[go], dist[go]
            if node.leaf:
                self._scan(node, who, dist, state)
                continue
            for entry in self._open(node, who, dist, state):
                heapq.heappush(queue, (entry[0], pushed, *entry[1:]))
                pushed += 1
        return state.score, state.ids

    def _scan(self, node: Node, who: np.ndarray, dist: np.ndarray, state: _Search) -> None:
        reach = state.reach(who)
        a, b = np.searchsorted(node.to_parent, dist - reach), np.searchsorted(node.to_parent, dist + reach, "right")
        use = a < b
        if use.any():
            a, b, who = int(a[use].min()), int(b[use].max()), who[use]
            self.computed += (b - a) * len(who)
            state.add(who, state.queries[who] @ node.entries[a:b].T, node.ids[a:b])

    def _open(self, node: Node, who: np.ndarray, dist: np.ndarray, state: _Search) -> Iterator[tuple]:
        """Queue entries: each child with the queries that have it in one place of their own order, keyed by their least bound."""
        reach = state.reach(who)
        radius = np.array([c.radius for c in node.children])
        maybe = np.abs(dist[:, None] - node.to_parent) - radius <= reach[:, None]
        far = np.full(maybe.shape, np.inf)
        for c in np.flatnonzero(maybe.any(0)):
            q = np.flatnonzero(maybe[:, c])
            far[q, c] = np.sqrt(np.maximum(((state.queries[who[q]] - node.entries[c]) ** 2).sum(1), 0))
        self.computed += int(maybe.sum())
        low = np.maximum(far - radius, 0)
        order = np.argsort(low, 1)
        for turn in range(len(node.children)):
            child = order[:, turn]
            bound = low[np.arange(len(who)), child]
            for c in np.unique(child[bound <= reach]):
                at = np.flatnonzero((child == c) & (bound <= reach))
                yield float(bound[at].min()), node.children[c], who[at], far[at, c], bound[at]


class _Search:
    """The best so far of each query of a batch."""

    def __init__(self, queries: np.ndarray, k: int, skip: np.ndarray, slack: float, top: float):
        self.queries, self.k, self.skip, self.slack = queries, k, skip, slack
        self.score, self.ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
        self.base = (queries**2).sum(1) + top

    def reach(self, who: np.ndarray) -> np.ndarray:
        """The distance beyond which a point can't be among a query's best."""
        return np.sqrt(np.maximum(self.base[who] - 2 * self.score[who].min(1) + self.slack, 0))

    def add(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        worst = self.score[who].min(1)
        new = np.isneginf(worst)
        other = ids[None, :] != self.skip[who][:, None]
        if new.any() and score.shape[1] > 2 * self.k:  # a query's own rows, however many, are none of its best
            worst[new] = np.partition(np.where(other[new], score[new], -np.inf), -self.k, 1)[:, -self.k]
        row, column = np.nonzero((score >= worst[:, None]) & other)
        if not len(row):
            return
        score, ids = score[row, column], ids[column]
        n = np.bincount(row, minlength=len(who))
        own = np.repeat(np.arange(len(who)), self.k)
        r, s, i = np.concatenate([own, row]), np.concatenate([self.score[who].ravel(), score]), np.concatenate([self.ids[who].ravel(), ids])
        order = np.lexsort((i, -s, r))
        first = np.cumsum(n + self.k) - (n + self.k)
        keep = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[who], self.ids[who] = s[keep].reshape(-1, self.k), i[keep].reshape(-1, self.k)


def block_top_k(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, vec_id, score of each query's k best in one block."""
    norms = (vectors**2).sum(1)
    tree = MTree(np.column_stack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))]), ids)
    parts = []
    for a in range(0, len(queries), 4096):
        q, own = queries[a : a + 4096], query_ids[a : a + 4096]
        score, who = tree.search(np.column_stack([q, np.zeros(len(q))]), k, own)
        there = np.isfinite(score)
        parts.append(pd.DataFrame({"query_id": np.repeat(own, k).reshape(-1, k)[there], "vec_id": who[there], "score": np.rint(score[there]).astype(np.int64)}))
    return pd.concat(parts)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors (vec_id, embedding) whose id is divisible by ``every``."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & ~bad)
    rows = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.count(), asked.count()
    blocks, lots = max(1, -(-n // block)), max(1, -(-m // queries))
    deal = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    copies = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.select("vec_id", "v", deal(blocks, 1).alias("block"), copies(lots).alias("lot"))
    right = asked.select("vec_id", "v", deal(lots, 2).alias("lot"), copies(blocks).alias("block"))

    def run(data: pa.Table, ask: pa.Table) -> pa.Table:
        got = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if data.num_rows and ask.num_rows:
            size = lambda t: np.diff(t["v"].combine_chunks().offsets.to_numpy())
            parts = []
            for width in np.intersect1d(size(data), size(ask)):
                d, a = data.filter(pa.array(size(data) == width)), ask.filter(pa.array(size(ask) == width))
                as_matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(-1, width)  # noqa: E731, B023
                parts.append(block_top_k(as_matrix(d), d["vec_id"].to_numpy(), as_matrix(a), a["vec_id"].to_numpy(), k))
            got = pd.concat([got, *parts])
        return pa.Table.from_pandas(got.astype("int64"), preserve_index=False)

    best = left.groupBy("block", "lot").cogroup(right.groupBy("block", "lot")).applyInArrow(run, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
