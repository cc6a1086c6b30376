"""Nearest neighbours by inner product: one hierarchical navigable small-world graph per shard, results merged.

Graphs are flat int32 neighbour arrays. Inserts and searches run in blocks of queries, each step one array
operation for the whole block. Vectors get one more component that makes their lengths equal, so that the graph can be
built on angles while searches rank by inner product; final scores are taken in double precision on the vectors given.
"""

from __future__ import annotations

import pickle
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut

M = 16
EF_BUILD = 96
EF_SEARCH = 128
BLOCK = 256
#: Dimensions that a broadcast table of them may have.
MOST_DIMENSIONS = 4096


def search_layer(x: np.ndarray, nbr: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for a block of queries. entry: (queries, k) node ids, -1 for none. Returns ids (-1: none) and
    similarities, best first, ef of each."""
    n, rows = len(q), np.arange(len(q))[:, None]
    visited = np.zeros((n, len(x) + 1), bool)
    ids = np.full((n, ef), -1, np.int64)
    ids[:, : entry.shape[1]] = entry[:, :ef]
    visited[rows, ids] = True
    visited[:, -1] = True  # the place of -1
    sim = np.where(ids >= 0, np.einsum("qed,qd->qe", x[ids], q), -np.inf).astype(np.float32)
    done = ids < 0
    while True:
        open_ = np.where(done, -np.inf, sim)
        live = np.flatnonzero(open_.max(1) > -np.inf)
        if not len(live):
            break
        r = live[:, None]
        best = np.argpartition(-open_[live], min(step, ef - 1), axis=1)[:, :step]
        chosen = np.where(np.take_along_axis(open_[live], best, 1) > -np.inf, ids[r, best], -1)
        done[r, best] = True
        new = np.where(chosen[:, :, None] >= 0, nbr[chosen], -1).reshape(len(live), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[visited[r, new]] = -1
        visited[r, new] = True
        got = np.where(new >= 0, np.einsum("qed,qd->qe", x[new], q[live]), -np.inf).astype(np.float32)
        all_sim = np.concatenate([sim[live], got], 1)
        all_ids = np.concatenate([ids[live], new], 1)
        all_done = np.concatenate([done[live], new < 0], 1)
        top = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
        sim[live], ids[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_sim, all_ids, all_done))
    ids[sim == -np.inf] = -1
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


def select(x: np.ndarray, q: np.ndarray, ids: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """The neighbour heuristic, for a block: a candidate is kept unless a kept one is nearer to it than the point is;
    free places then go to the nearest of the rest. Candidates come nearest first."""
    n, k = ids.shape
    among = np.einsum("qad,qbd->qab", x[ids], x[ids])
    kept = np.zeros((n, k), bool)
    for j in range(k):
        near = np.where(kept[:, :j], among[:, j, :j], -np.inf).max(1, initial=-np.inf) if j else np.full(n, -np.inf)
        kept[:, j] = (ids[:, j] >= 0) & (near < sim[:, j]) & (kept[:, :j].sum(1) < m)
    order = np.argsort(np.where(ids < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < m:
        out = np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)
    return out


def _link_back(x: np.ndarray, nbr: np.ndarray, new: np.ndarray, to: np.ndarray) -> None:
    """Add the reverse links of nodes new to their neighbours to, pruning full lists by the heuristic."""
    src, dst = np.repeat(new, to.shape[1]), to.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    if not len(dst):
        return
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
    nodes, counts = dst[first], np.diff(np.r_[first, len(dst)])
    deg = nbr.shape[1]
    extra = np.full((len(nodes), counts.max()), -1, np.int64)
    extra[np.repeat(np.arange(len(nodes)), counts), np.arange(len(dst)) - np.repeat(first, counts)] = src
    for lo in range(0, len(nodes), BLOCK):
        at = nodes[lo : lo + BLOCK]
        cand = np.concatenate([nbr[at], extra[lo : lo + BLOCK]], 1)
        sim = np.where(cand >= 0, np.einsum("qed,qd->qe", x[cand], x[at]), -np.inf).astype(np.float32)
        order = np.argsort(-sim, axis=1, kind="stable")[:, : 2 * deg]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        fits = (cand >= 0).sum(1) <= deg
        rows = np.full((len(at), deg), -1, np.int64)
        rows[fits, : cand.shape[1]] = cand[fits, :deg]
        if not fits.all():
            rows[~fits] = select(x, x[at[~fits]], cand[~fits], sim[~fits], deg)
        nbr[at] = rows


class Graph:
    """layers[l]: neighbours of every node on layer l, -1 for none; layer 0 has 2 M places a node."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray, m: int = M, ef: int = EF_BUILD):
        self.vectors, self.scale = vectors, 1.0
        n = len(vectors)
        self.scale = np.abs(vectors).max() or 1.0
        unit = vectors / self.scale
        norm = (unit**2).sum(1)
        self.top = float(norm.max())
        self.x = (np.c_[unit, np.sqrt(np.maximum(self.top - norm, 0))] / np.sqrt(self.top)).astype(np.float32)
        rng = np.random.default_rng(np.abs(keys[:16]).astype(np.uint64))
        levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 8)
        levels[0] = levels.max(initial=0)  # the first node is on every layer: the entry point
        self.layers = [np.full((n, 2 * m if layer == 0 else m), -1, np.int64) for layer in range(levels[0] + 1)]
        start = 1
        while start < n:
            block = np.arange(start, min(n, start + min(start, BLOCK)))
            self._insert(block, levels, m, ef)
            start = block[-1] + 1

    def _insert(self, block: np.ndarray, levels: np.ndarray, m: int, ef: int) -> None:
        q, entry = self.x[block], np.zeros((len(block), 1), np.int64)
        among = q @ q.T
        for layer in range(len(self.layers) - 1, -1, -1):
            nbr, here = self.layers[layer], np.flatnonzero(levels[block] >= layer)
            ids, sim = search_layer(self.x, nbr, q, entry, ef if len(here) else 8)
            if len(here):
                # those inserted with it that come before it are candidates too
                mates = np.where(np.tril(np.ones((len(here), len(here)), bool), -1), among[np.ix_(here, here)], -np.inf)
                k = min(m, len(here))
                best = np.argpartition(-mates, k - 1, axis=1)[:, :k]
                mate_sim = np.take_along_axis(mates, best, 1)
                mate_ids = np.where(mate_sim > -np.inf, block[here][best], -1)
                all_ids, all_sim = np.concatenate([ids[here], mate_ids], 1), np.concatenate([sim[here], mate_sim], 1)
                order = np.argsort(-all_sim, axis=1, kind="stable")[:, :ef]
                to = select(self.x, q[here], np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sim, order, 1), m)
                nbr[block[here], :m] = to
                _link_back(self.x, nbr, block[here], to)
            entry = ids[:, :8]

    def search(self, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """(queries, k) nodes of the largest inner products found, -1 where there are fewer."""
        ef = max(ef, k)
        out = np.full((len(queries), k), -1, np.int64)
        for lo in range(0, len(queries), BLOCK):
            q = queries[lo : lo + BLOCK]
            q = q / np.abs(q).max(1, keepdims=True)
            q = np.c_[q / np.sqrt((q**2).sum(1, keepdims=True)), np.zeros(len(q))].astype(np.float32)
            entry = np.zeros((len(q), 1), np.int64)
            for layer in range(len(self.layers) - 1, 0, -1):
                entry = search_layer(self.x, self.layers[layer], q, entry, 8)[0]
            ids = search_layer(self.x, self.layers[0], q, entry, ef)[0][:, :k]
            out[lo : lo + BLOCK, : ids.shape[1]] = ids
        return out

    def scan(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """Of each query the nodes of the k largest inner products of all, with all that tie with the least of them."""
        out = []
        for lo in range(0, len(queries), BLOCK):
            sims = queries[lo : lo + BLOCK] @ self.vectors.T
            for q, sim in zip(queries[lo : lo + BLOCK], sims):
                least = np.partition(sim, len(sim) - k)[len(sim) - k] if len(sim) > k else -np.inf
                slack = 1e-9 * np.sqrt((q**2).sum()) * self.scale * np.sqrt(self.top)
                out.append(np.flatnonzero(sim >= least - slack))
        return out

    def dump(self) -> bytes:
        return pickle.dumps((self.vectors, self.x, [layer.astype(np.int32) for layer in self.layers], self.scale, self.top), protocol=5)

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        g = cls.__new__(cls)
        g.vectors, g.x, g.layers, g.scale, g.top = pickle.loads(raw)
        return g


def classes(df: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """One row per distinct vector: cid (its smallest id), vector array<double>, ids (its keep smallest ids), dim.

    Rows that repeat id and vector count once.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id.
    """
    v = F.col("vector")
    rows = df.select(col(id_col).cast("long").alias("id"), F.transform(col(vector_col), lambda c: c.cast("double") + F.lit(0.0)).alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0))
    few = rows.withColumn("k", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("k") <= keep)
    return few.groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("cid", F.col("ids")[0]).withColumn("dim", F.size("vector"))


def by_dimension(df: DataFrame, shards: DataFrame) -> DataFrame:
    """df with the shards of its dimension. They are broadcast while they are few, else joined by a shuffle."""
    few = shards.limit(MOST_DIMENSIONS + 1).count() <= MOST_DIMENSIONS
    return df.join(F.broadcast(shards) if few else shards, "dim")


def build_index(cls: DataFrame, shard_rows: int = 8192) -> DataFrame:
    """cls as from classes(). Gives dim, shard, graph binary, ids: one row per shard of about shard_rows distinct vectors of
    one dimension; none for no vectors."""
    n = cls.groupBy("dim").count().withColumn("shards", F.ceil(F.col("count") / shard_rows).cast("int")).select("dim", "shards")
    sharded = by_dimension(cls, n).withColumn("shard", F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        g = Graph(np.stack(pdf.vector.to_list()).astype(float), pdf.cid.to_numpy())
        return pd.DataFrame({"dim": [pdf.dim.iloc[0]], "shard": [pdf["shard"].iloc[0]], "shards": [pdf.shards.iloc[0]], "graph": [g.dump()], "ids": [pickle.dumps([np.asarray(i, np.int64) for i in pdf.ids])]})

    return cut(sharded.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, shards int, graph binary, ids binary"), "hnsw-index")


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, shard_rows: int = 8192, wave_rows: int = 16384, ef: int = EF_SEARCH, exact: bool = False) -> DataFrame:
    """For every row whose id is divisible by every: its k nearest other rows by inner product.

    Returns query_id, rank int from 1, vec_id, score double; nearest first, ties to the smaller id. Equal vectors are
    indexed once and given back as all their rows. A query meets vectors of its own dimension. Every shard's graph
    answers queries in waves of about wave_rows, so no task holds more than a shard and a wave. Fewer candidates than k
    give fewer rows; an empty table gives none. Rows that repeat id and vector count once; where rows of one id hold
    several vectors, the least is the query, none of them its candidate, and each a candidate of other queries.
    Graphs find most neighbours, not all; with exact every vector of a shard is compared instead. Other columns of df are
    ignored.
    """
    cls = cut(classes(df, id_col, vector_col, k + 1), "hnsw-classes")
    index = build_index(cls, shard_rows)
    # of equal vectors more than k + 1 may be queries: their ids come from the table
    q = df.filter(F.pmod(col(id_col).cast("long"), F.lit(every)) == 0).select(col(id_col).cast("long").alias("query_id"), F.transform(col(vector_col), lambda c: c.cast("double") + F.lit(0.0)).alias("vector"))
    v = F.col("vector")
    q = q.filter(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0))
    q = q.groupBy("query_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    waves = max(1, ceil(q.count() / wave_rows))
    shards = index.select("dim", F.col("shards")).distinct()
    asked = by_dimension(q, shards).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("wave", F.pmod(F.xxhash64("query_id"), F.lit(waves)).cast("int"))
    graphs = index.select("dim", "shard", "graph", "ids", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))).alias("wave"))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            g, ids = Graph.load(left.graph.iloc[0]), pickle.loads(left.ids.iloc[0])
            for lo in range(0, len(right), 1024):
                part = right.iloc[lo : lo + 1024]
                vectors = np.stack(part.vector.to_list()).astype(float)
                found = g.scan(vectors, k + 1) if exact else g.search(vectors, k + 1, ef)
                for query, vector, nodes in zip(part.query_id.to_numpy(), vectors, found):
                    nodes = nodes[nodes >= 0]
                    score = (g.vectors[nodes] * vector).sum(1)
                    rows = sorted((-s, i) for node, s in zip(nodes, score) for i in ids[node] if i != query)[:k]
                    out["query_id"] += [query] * len(rows)
                    out["vec_id"] += [i for _, i in rows]
                    out["score"] += [-s for s, _ in rows]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["dim", "shard", "wave"]
    hits = graphs.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
