"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

1. Equal vectors are one *point*; a point keeps its least ids (a map-side limited window), so a
   vector that a third of the rows share is one graph node.
2. Points are dealt by hash to shards of about ``SHARD`` points. Each shard builds its graph in one task and
   stores it as one row of flat arrays: vectors, and per layer a neighbour array with offsets.
3. The stated queries travel in blocks of ``BLOCK``; each block meets each shard once, searches its graph and returns
   its nearest points. So a graph is loaded, and travels, once for every ``BLOCK`` queries. The shards' results are merged by one limited window per query.

Shards have the same size at any corpus size; only their number grows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W

from .tables import prepared, read, written

#: Points of a shard; links of a node (twice that on the lowest layer); list sizes when building and searching.
SHARD, M, EF_BUILD, EF_SEARCH = 4096, 16, 80, 96
#: Queries of a block: a shard's graph travels once for so many of them.
BLOCK = 4096


class Graph:
    """A graph over unit vectors. ``layers[l]`` has a neighbour row per node of layer l, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 7):
        self.v, self.m = vectors, m
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / math.log(m)).astype(np.int64), 12)
        top = int(self.level.max()) if n else 0
        self.layers = [np.full((n, 2 * m if layer == 0 else m), -1, np.int32) for layer in range(top + 1)]
        self.degree = [np.zeros(n, np.int32) for _ in self.layers]
        self.entry = -1
        self._seen, self._mark = np.zeros(n, np.int64), 0
        for node in range(n):
            self._insert(node, ef)

    def _near(self, q: np.ndarray, starts: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nodes most similar to q that a best-first walk of the layer finds, best first."""
        self._mark += 1
        seen, mark, links, degree, v = self._seen, self._mark, self.layers[layer], self.degree[layer], self.v
        seen[starts] = mark
        sims = v[starts] @ q
        todo = [(-float(s), x) for s, x in zip(sims, starts, strict=True)]
        best = [(float(s), x) for s, x in zip(sims, starts, strict=True)]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            s, x = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            near = links[x, : degree[x]]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            seen[near] = mark
            sims = v[near] @ q
            if len(best) >= ef:
                good = sims > best[0][0]
                near, sims = near[good], sims[good]
            for sim, y in zip(sims.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (sim, y))
                    heapq.heappush(todo, (-sim, y))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, y))
                    heapq.heappush(todo, (-sim, y))
        return sorted(best, key=lambda p: (-p[0], p[1]))

    def _chosen(self, found: list[tuple[float, int]], limit: int) -> list[int]:
        """Neighbours that no nearer chosen neighbour is closer to; then the nearest others up to the limit."""
        nodes = [y for _, y in found]
        if len(nodes) <= limit:
            return nodes
        between = self.v[nodes] @ self.v[nodes].T
        out: list[int] = []
        for k, (s, _) in enumerate(found):
            if len(out) == limit:
                break
            if not out or between[k, out].max() <= s:
                out.append(k)
        rest = (k for k in range(len(nodes)) if k not in set(out))
        return [nodes[k] for k in [*out, *[k for k, _ in zip(rest, range(limit - len(out)), strict=False)]]]

    def _insert(self, node: int, ef: int) -> None:
        if self.entry < 0:
            self.entry = node
            return
        q, at = self.v[node], [self.entry]
        top = int(self.level[self.entry])
        for layer in range(top, int(self.level[node]), -1):
            at = [self._near(q, at, 1, layer)[0][1]]
        for layer in range(min(top, int(self.level[node])), -1, -1):
            found = self._near(q, at, ef, layer)
            chosen = self._chosen(found, self.m)
            links, degree = self.layers[layer], self.degree[layer]
            links[node, : len(chosen)] = chosen
            degree[node] = len(chosen)
            for y in chosen:
                if degree[y] < links.shape[1]:
                    links[y, degree[y]] = node
                    degree[y] += 1
                else:  # full: keep the best spread of the old ones and the new one
                    all_of = np.append(links[y], node)
                    sims = self.v[all_of] @ self.v[y]
                    by = np.lexsort((all_of, -sims))
                    kept = self._chosen([(float(sims[k]), int(all_of[k])) for k in by], links.shape[1])
                    links[y, : len(kept)] = kept
                    degree[y] = len(kept)
            at = [y for _, y in found]
        if self.level[node] > top:
            self.entry = node

    def search(self, q: np.ndarray, k: int, ef: int) -> list[int]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for layer in range(int(self.level[self.entry]), 0, -1):
            at = [self._near(q, at, 1, layer)[0][1]]
        return [y for _, y in self._near(q, at, max(ef, k), 0)[:k]]

    def flat(self) -> dict:
        """The graph as flat arrays: per layer the nodes' degrees, then all neighbours in node order."""
        return {"entry": self.entry, "top": len(self.layers) - 1,
                "degrees": np.concatenate([d for d in self.degree] or [np.zeros(0, np.int32)]),
                "neighbours": np.concatenate([x[np.arange(x.shape[1])[None, :] < d[:, None]] for x, d in zip(self.layers, self.degree, strict=True)] or [np.zeros(0, np.int32)])}

    @classmethod
    def of(cls, vectors: np.ndarray, entry: int, top: int, degrees: np.ndarray, neighbours: np.ndarray, m: int = M) -> Graph:
        g = cls.__new__(cls)
        n = len(vectors)
        g.v, g.m, g.entry, g.layers, g.degree, at = vectors, m, entry, [], [], 0
        for layer in range(top + 1):
            d = degrees[layer * n: (layer + 1) * n]
            links = np.full((n, 2 * m if layer == 0 else m), -1, np.int32)
            links[np.arange(links.shape[1])[None, :] < d[:, None]] = neighbours[at: at + int(d.sum())]
            at += int(d.sum())
            g.layers.append(links)
            g.degree.append(d)
        g.level = np.full(n, top)
        g._seen, g._mark = np.zeros(n, np.int64), 0
        return g


def _usable(v: Column) -> Column:
    """Holds components, all finite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def points(vectors: DataFrame, keep: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(point, v, ids)``: distinct usable vectors with their ``keep`` least ids; null ids take no part."""
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & _usable(F.col("v"))))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))  # -0.0 is 0.0
    rows = rows.dropDuplicates(["id", "v"])
    # The limit of the window is applied before the shuffle too, so a hot vector sends a few rows a task.
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("k") <= keep)
    return rows.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("point", F.element_at("ids", 1))


def index(pts: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per shard: its points, vectors and flat graph."""
    prepared(pts.sparkSession)
    n = max(1, math.ceil(pts.count() / shard))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in pdf.sort_values("point").groupby(pdf["v"].map(len)):  # vectors of another length are in another space
            v = np.stack(part["v"].to_numpy()).astype(np.float64)
            unit = v / np.abs(v).max(axis=1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            g = Graph(unit.astype(np.float32)).flat()
            ids = part["ids"].tolist()
            out.append({"shard": int(part["shard"].iloc[0]), "dim": int(dim), "vectors": v.tobytes(), "ids": np.concatenate(ids).astype(np.int64).tobytes(),
                        "n_ids": np.array([len(x) for x in ids], np.int32).tobytes(), "entry": g["entry"], "top": g["top"],
                        "degrees": g["degrees"].astype(np.int32).tobytes(), "neighbours": g["neighbours"].astype(np.int32).tobytes()})
        return pd.DataFrame(out)

    dealt = pts.withColumn("shard", F.pmod(F.xxhash64("point", "v"), F.lit(n)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(build, "shard int, dim int, vectors binary, ids binary, n_ids binary, entry int, top int, degrees binary, neighbours binary")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of every row of a with b in double precision."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        out = (a @ b) / (np.sqrt((a * a).sum(axis=1)) * math.sqrt(float(b @ b)))
    if not np.isfinite(out).all():  # only where squares overflow or vanish
        a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max()
        out = (a @ b) / (np.sqrt((a * a).sum(axis=1)) * math.sqrt(float(b @ b)))
    return out


def nearest(queries: DataFrame, shards: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", ef: int = EF_SEARCH) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k nearest found, nearest first, ties to the smaller id.

    A query's own id is no candidate; equal vectors of other ids are. Unusable queries (null, zero, non-finite) and
    null ids get no rows; vectors of another length than the query's are no candidates; an empty index gives no rows.
    """
    q = (queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vec_col).cast("array<double>").alias("q"))
         .where(F.col("query_id").isNotNull() & _usable(F.col("q"))).dropDuplicates(["query_id", "q"]).withColumn("dim", F.size("q")))
    prepared(queries.sparkSession)
    n = q.count()
    blocks = max(1, math.ceil(n / BLOCK))
    # Every block has to meet every shard: the keys say so; each (shard, block) is one bounded task.
    asked = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    last = shards.agg(F.max("shard")).first()[0]  # a number without a shard finds nothing
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    graphs = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for row in right.itertuples():
            v = np.frombuffer(row.vectors).reshape(-1, row.dim)
            unit = v / np.abs(v).max(axis=1, keepdims=True)
            unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
            g = Graph.of(unit, row.entry, row.top, np.frombuffer(row.degrees, np.int32), np.frombuffer(row.neighbours, np.int32))
            ids, n_ids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.n_ids, np.int32)
            starts = np.append(0, np.cumsum(n_ids))
            for one in left[left["dim"] == row.dim].itertuples():
                b = np.asarray(one.q, np.float64)
                u = b / np.abs(b).max()
                found = np.array(g.search((u / np.linalg.norm(u)).astype(np.float32), 4 * k, ef), np.int64)
                if not len(found):
                    continue
                best: list[tuple[float, int]] = []
                for score, p in zip(cosine(v[found], b).tolist(), found.tolist(), strict=True):
                    best += [(-score, int(i)) for i in ids[starts[p]: starts[p + 1]] if i != one.query_id]
                out += [(one.query_id, i, -s) for s, i in sorted(best)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = asked.groupBy("shard", "block").cogroup(graphs.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50 among all ``embeddings``."""
    vectors = read(prepared(spark), sf_dir, "embeddings")
    pts = written(points(vectors, 6), "points")
    shards = written(index(pts), "shards")
    return nearest(vectors.where(F.col("vec_id") % 50 == 0), shards, 5)
