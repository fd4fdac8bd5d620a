"""Whitening against a dense eigensolver and whole-number deviations; filters, many tasks, edge rows."""

import math

import numpy as np
import pytest
from conftest import SF001, SF01
from pyspark.sql import functions as F

from cordon.llm import whitening
from cordon.llm.tables import read

SCHEMA = "vec_id long, embedding array<float>, label int"


def dense(rows, components=8):
    """vec_id -> whitened coordinates, deviation; and explained shares, by numpy over all vectors."""
    x = np.floor(1024 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s).astype(np.float64) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    z = y @ (vectors / np.sqrt(values))
    deviation = [sum(int(v) ** 2 for v in row) for row in (n * x.astype(object) - s)]
    return z, deviation, values / (y * y).sum() * n


def compare(frame, rows, tolerance=1e-8):
    out = frame.orderBy("vec_id", "component").collect()
    rows = sorted(rows)
    z, deviation, explained = dense(rows)
    k = z.shape[1]
    assert [(r.vec_id, r.component) for r in out] == [(i, c) for i, _ in rows for c in range(1, k + 1)]
    got = np.array([r.whitened for r in out]).reshape(-1, k)
    sign = np.sign((got * z).sum(axis=0))
    assert np.abs(got * sign - z).max() < tolerance
    assert [r.deviation for r in out[::k]] == deviation and {r.n for r in out} == {len(rows)}
    assert np.allclose([r.explained for r in out[:k]], explained, rtol=1e-10)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9


def usable(df):
    return [(r.vec_id, [float(np.float32(x)) for x in r.embedding]) for r in df.collect()]


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_given_vectors(spark, folder):
    compare(whitening.op12_chebyshev_whitening(spark, folder), usable(read(spark, folder, "embeddings")))


def test_many_tasks_and_flat_spectrum(spark, monkeypatch):
    monkeypatch.setattr(whitening, "SLOTS", 3)
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=48)]) for k in range(700)]
    frame = spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA).repartition(7)
    fit = whitening.fitted(whitening.moments(frame), block=12)
    assert fit.passes > 20
    compare(whitening.whitened(fit), rows)


def test_few_dimensions_and_null_directions(spark):
    rows = [(k, [k / 8, (k * k % 7) / 4, 0.5]) for k in range(20)]  # the third has no variance
    out = whitening.whiten(spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA))
    assert {r.component for r in out.collect()} == {1, 2} and out.count() == 40
    z, _, _ = dense(rows, 2)
    got = np.array([r.whitened for r in out.orderBy("vec_id", "component").collect()]).reshape(-1, 2)
    assert np.abs(np.abs(got) - np.abs(z)).max() < 1e-9


def test_edges(spark):
    good = [(k, [float(k % 5), float(k % 3), float(k)]) for k in range(30)]
    rows = [(k, v, 0) for k, v in good] + [(100, None, 0), (101, [math.nan, 1.0, 2.0], 0), (102, [math.inf, 1.0, 2.0], 0), (103, [None, 1.0, 2.0], 0), (104, [], 0),
                                           (105, [1.0, 2.0], 0), (106, [3e38, 1.0, 2.0], 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit(7)).withColumn("dim", F.lit(1)).withColumn("id", F.lit(1)).withColumn("x", F.lit(1))
    out = whitening.whiten(frame)
    assert {r.vec_id for r in out.collect()} == {k for k, _ in good}
    z, deviation, _ = dense(good, 3)
    assert [r.deviation for r in out.where("component = 1").orderBy("vec_id").collect()] == deviation
    twice = spark.createDataFrame([(k % 10, v, 0) for k, v in good] + [(None, good[3][1], 0)], SCHEMA)
    got = whitening.whiten(twice)
    assert got.count() == 31 * 3 and got.where("vec_id IS NULL").count() == 3


def test_empty_single_and_equal_vectors(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(9)], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [1e9, 0.0], 0), (2, [-1e9, 1.0], 0), (3, [0.0, 0.5], 0)]
    out = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    _, deviation, _ = dense([(k, v) for k, v, _ in rows], 2)
    assert out == {k: d if d < 1 << 63 else None for (k, _, _), d in zip(rows, deviation, strict=True)} and None in out.values()


def test_not_certified_raises(spark):
    fit = whitening.moments(read(spark, SF01, "embeddings"))
    with pytest.raises(ArithmeticError):
        whitening.fitted(fit, block=9, rounds=1)
