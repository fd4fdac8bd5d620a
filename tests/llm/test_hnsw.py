"""Recall against brute force, copies of vectors, several shards, edge rows."""

import math

import numpy as np
from conftest import SF01
from pyspark.sql import functions as F

from cordon.llm import hnsw
from cordon.llm.tables import read, written

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    out = {}
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float64)
    for i, q in queries:
        q = np.array(q, np.float64)
        s = (v @ q) / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))
        best = sorted((-round(float(x), 12), int(j)) for x, j in zip(s, ids) if j != i)[:k]
        out[i] = [(j, -x) for x, j in best]
    return out


def run(spark, vectors, queries, k=5, shard=300):
    pts = written(hnsw.points(vectors, k + 1), "points")
    rows = hnsw.nearest(queries, written(hnsw.index(pts, shard), "shards"), k).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def usable(df):
    return [(r.vec_id, [float(np.float32(x)) for x in r.embedding]) for r in df.collect()]


def test_recall_on_the_given_vectors(spark):
    vectors = read(spark, SF01, "embeddings")
    queries = vectors.where("vec_id % 5 = 0")
    got, want = run(spark, vectors, queries), brute(usable(vectors), usable(queries), 5)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    for q in want:
        scores = dict(want[q])
        assert all(abs(s - scores[i]) < 1e-9 for i, s in got[q] if i in scores)


def test_a_graph_by_itself():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = hnsw.Graph(v)
    flat = g.flat()
    again = hnsw.Graph.of(v, flat["entry"], flat["top"], flat["degrees"], flat["neighbours"])
    hits = 0
    for q in v[:100]:
        found = again.search(q, 10, 96)
        assert found == g.search(q, 10, 96)
        hits += len(set(found) & set(np.argsort(-(v @ q), kind="stable")[:10].tolist()))
    assert hits >= 950


def test_copies_ties_and_unusable_rows(spark):
    base = [[float(k), 1.0, 0.0] for k in range(1, 40)]
    rows = [(k, v, 0) for k, v in enumerate(base)] + [(1000 + k, base[0], 0) for k in range(50)]
    rows += [(2000, None, 0), (2001, [0.0, 0.0, 0.0], 0), (2002, [math.nan, 1.0, 0.0], 0), (2003, [math.inf, 1.0, 0.0], 0), (2004, [None, 1.0, 0.0], 0), (2005, [], 0),
             (2006, [1.0, 2.0], 0), (None, base[0], 0), (7, base[7], 0), (2007, [-0.0, 1.0, 0.0], 0), (2008, [0.0, 1.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("shard", F.lit(2))
    got = run(spark, vectors, vectors, shard=20)
    good = [(i, v) for i, v, _ in rows if i is not None and i < 2000 or i in (2007, 2008)]
    want = brute(sorted(dict(good).items()), sorted(dict(good).items()), 5)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
    assert set(got) == set(want)  # the lone vector of another length has no candidate


def test_few_and_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert run(spark, empty, empty) == {}
    two = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 1.0], 0)], SCHEMA)
    got = run(spark, two, two)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {1: [2], 2: [1]}
    assert run(spark, empty, two) == {}


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    """Queries in one block or in many, shard numbers without a shard among them, give the same rows."""
    vectors = read(spark, SF01, "embeddings").where("vec_id < 400")
    queries = vectors.where("vec_id % 4 = 0")
    one = run(spark, vectors, queries, shard=30)
    monkeypatch.setattr(hnsw, "BLOCK", 9)
    assert run(spark, vectors, queries, shard=30) == one and len(one) > 50
    shards = written(hnsw.index(written(hnsw.points(vectors, 6), "points"), 30), "shards")
    some = shards.where("shard % 2 = 1")
    left = {r.vec_id for r in hnsw.nearest(queries, some, 5).collect()}
    held = set()
    for r in some.collect():
        held |= set(np.frombuffer(r.ids, np.int64).tolist())
    assert left and left <= held
