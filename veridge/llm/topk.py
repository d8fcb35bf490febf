"""Exact top-k search by inner product: shards dealt by balls, a tree in each, branch and bound, kth scores shared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridge.runtime import written

K, SCALE, EVERY = 5, 256.0, 50
#: Rows of a shard and of a block of queries, and of a tree's leaf.
SHARD, BLOCK, LEAF = 16_384, 4_096, 256
#: Vectors, a bounded sample, that others are dealt by; which they are changes what is sent, not what is found.
PIVOTS = 256
_EXACT = 1 << 53
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """``(vec_id, v)``: floor(scale * x) of each component x as a double. Rows that are null, or hold a null or non-finite component or no id, are left out; of rows with one id the smallest vector stays."""
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return rows.groupBy("vec_id").agg(F.min("x").alias("x")).select("vec_id", F.transform("x", lambda c: F.when(F.abs(c * scale) < float(_EXACT), F.floor(c * scale).cast("double")).otherwise(c * scale)).alias("v"))


class BallTree:
    """Balls that halve their points along the coordinate of widest spread; equal points halve too."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.nodes: list[tuple[np.ndarray, float, np.ndarray | None, int, int]] = []
        self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        pts = self.x[rows]
        centre = pts.mean(0)
        radius = float(np.sqrt(((pts - centre) ** 2).sum(1).max())) if pts.shape[1] else 0.0
        me = len(self.nodes)
        self.nodes.append((centre, radius, rows, -1, -1))
        if len(rows) > LEAF:
            axis = int(np.ptp(pts, axis=0).argmax()) if pts.shape[1] else 0
            order = rows[np.argpartition(pts[:, axis], len(rows) // 2)] if pts.shape[1] else rows
            left, right = self._build(order[: len(rows) // 2]), self._build(order[len(rows) // 2 :])
            self.nodes[me] = (centre, radius, None, left, right)
        return me

    def search(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple]:
        """(query, vector, score) of each query's k best here that reach its bound, all queries at once.

        A node is visited, after its sibling of higher upper bound, by queries whose kth score so far it may still meet.
        """
        n = len(qid)
        norm = np.sqrt((q * q).sum(1))
        best = np.full((n, k), -np.inf)
        ids = np.full((n, k), np.iinfo(np.int64).max)

        def upper(node: int, at: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[node][:2]
            up = q[at] @ centre + norm[at] * radius
            return up + 1e-9 * (np.abs(up) + norm[at] * radius + 1)

        stack = [(0, np.arange(n))]
        while stack:
            node, at = stack.pop()
            at = at[upper(node, at) >= np.maximum(best[at, -1], bound[at])]
            if not len(at):
                continue
            _, _, rows, left, right = self.nodes[node]
            if rows is None:
                first, second = (left, right) if upper(left, at).sum() >= upper(right, at).sum() else (right, left)
                stack += [(second, at), (first, at)]
                continue
            s = q[at] @ self.x[rows].T
            own = np.broadcast_to(self.ids[rows], s.shape)
            s = np.where(own == qid[at][:, None], -np.inf, s)
            s, own = np.concatenate([best[at], s], 1), np.concatenate([ids[at], own], 1)
            order = np.lexsort((own, -s), axis=1)[:, :k]
            best[at], ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(own, order, 1)
        hit = np.isfinite(best) & (best >= bound[:, None])
        for i, j in zip(*np.nonzero(hit), strict=True):
            yield int(qid[i]), int(ids[i, j]), int(best[i, j])


def _large(ids, x, qid, q, bound, k):
    """The same by integers of any size, for components whose products a double can't hold; scores are cut to 64 bits."""
    for i, a in zip(qid, q, strict=True):
        got = sorted((-sum(int(u) * int(v) for u, v in zip(a, b, strict=True)), int(j)) for j, b in zip(ids, x, strict=True) if j != i)[:k]
        yield from ((int(i), j, max(min(-s, (1 << 63) - 1), -(1 << 63))) for s, j in got)


def _search(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame([], columns=["query_id", "vec_id", "score"])
        ids, x = vectors["vec_id"].to_numpy(), np.array(vectors["v"].tolist(), dtype=np.float64).reshape(len(vectors), -1)
        qid, q = queries["vec_id"].to_numpy(), np.array(queries["v"].tolist(), dtype=np.float64).reshape(len(queries), -1)
        bound = queries["bound"].to_numpy(dtype=np.float64, na_value=-np.inf)
        top = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1])
        found = BallTree(ids, x).search(qid, q, bound, k) if top < _EXACT else _large(ids, x, qid, q, bound, k)
        return pd.DataFrame(list(found), columns=["query_id", "vec_id", "score"])

    return run


def _pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """At most ``n`` of the vectors, those whose hashed ids come first, by their dimension."""
    found: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("vec_id")).limit(n).select("dim", "v").collect():
        found.setdefault(r["dim"], []).append(r["v"])
    return {dim: np.array(v, dtype=np.float64).reshape(len(v), -1) for dim, v in found.items()}


def _dealt(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the nearest pivot of their dimension, -1 if it has none, and how far it is."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pivot, far = np.full(len(pdf), -1), np.full(len(pdf), np.inf)
            for dim, at in pdf.groupby("dim").indices.items():
                if (p := pivots.get(dim)) is not None:
                    x = np.array(pdf["v"].iloc[at].tolist(), dtype=np.float64).reshape(len(at), -1)
                    with np.errstate(over="ignore", invalid="ignore"):
                        pivot[at] = np.argmin((p * p).sum(1) - 2 * (x @ p.T), 1)
                        far[at] = np.sqrt(((x - p[pivot[at]]) ** 2).sum(1))
            yield pdf.assign(pivot=pivot, far=np.nan_to_num(far, nan=np.inf))

    return vectors.mapInPandas(deal, "vec_id long, v array<double>, dim int, pivot int, far double")


def _visits(queries: DataFrame, pivots: dict[int, np.ndarray], balls: dict[tuple[int, int], tuple[float, int]]) -> DataFrame:
    """``queries`` with ``to``, the pivots of their dimension around which a shard may hold what reaches their bound."""

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            to = []
            for dim, v, bound, home in zip(pdf["dim"], pdf["v"], pdf["bound"], pdf["home"], strict=True):
                q, p = np.array(v, dtype=np.float64), pivots.get(dim)
                near = [-1] if p is None else [i for i in range(len(p)) if (dim, i) in balls]
                if p is not None and len(near):
                    radius = np.array([balls[dim, i][0] for i in near])
                    with np.errstate(over="ignore", invalid="ignore"):
                        reach = np.sqrt((q * q).sum()) * radius
                        up = p[near] @ q
                        up = up + reach + 1e-9 * (np.abs(up) + reach + 1)
                    near = [i for i, out in zip(near, np.maximum(up, -(2.0**63)) < bound, strict=True) if not out]
                to.append([i for i in near if i != home or i < 0 or balls[dim, i][1] > 1])
            yield pdf.assign(to=to)

    return queries.mapInPandas(choose, "vec_id long, v array<double>, dim int, bound double, home int, home_chunk int, to array<int>")


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, id_col: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, the k other rows of highest integer inner product, ties to the smaller id.

    Rows are dealt to the nearest of at most ``PIVOTS`` vectors, and by hashed id to shards of about ``SHARD`` rows around each; vectors of unlike dimension don't meet. Each query is first searched for in its own shard; its kth score there then rules out pivots whose ball can't reach it, and bounds the search of the shards of the others, which return only what reaches it. A shard's visitors come in blocks of about ``BLOCK``, so a task holds one shard and one block; shards that none visits aren't sent again. Fewer than k candidates give fewer rows, an empty table none. Other columns aren't read.
    """
    v = written(quantised(vectors, id_col, vector, scale).withColumn("dim", F.size("v")))
    pivots = _pivots(v, min(PIVOTS, max(1, v.count() // SHARD)))
    near = written(_dealt(v, pivots))
    cells = written(near.groupBy("dim", "pivot").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / SHARD).cast("int").alias("chunks")))
    sharded = written(near.join(cells, ["dim", "pivot"]).select("dim", "pivot", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "v"))
    search = _search(k)
    home = written(sharded.groupBy("dim", "pivot", "chunk").applyInPandas(lambda pdf: search(pdf, pdf[pdf["vec_id"] % every == 0].assign(bound=np.nan)), FOUND))
    kth = home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("bound"))
    queries = sharded.where(F.col("vec_id") % every == 0).join(kth, F.col("vec_id") == F.col("query_id"), "left")
    queries = queries.select("vec_id", "v", "dim", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), F.col("pivot").alias("home"), F.col("chunk").alias("home_chunk"))
    balls = {(r["dim"], r["pivot"]): (r["radius"], r["chunks"]) for r in cells.where("pivot >= 0").collect()}  # one for each pivot at most
    wanted = written(_visits(queries, pivots, balls))
    visitors = wanted.select("dim", F.explode("to").alias("pivot")).groupBy("dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    open_cells = written(cells.join(visitors, ["dim", "pivot"]).select("dim", "pivot", "chunks", "blocks"))
    numbered = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = sharded.join(open_cells, ["dim", "pivot"]).withColumn("block", numbered("blocks")).select("dim", "pivot", "chunk", "block", "vec_id", "v")
    away = wanted.withColumn("pivot", F.explode("to")).join(open_cells, ["dim", "pivot"]).withColumn("chunk", numbered("chunks")).where((F.col("pivot") != F.col("home")) | (F.col("chunk") != F.col("home_chunk")))
    away = away.select("dim", "pivot", "chunk", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "v", "bound")
    keys = ["dim", "pivot", "chunk", "block"]
    other = spread.groupBy(*keys).cogroup(away.groupBy(*keys)).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return home.union(other).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
