"""Embedding whitening: leading components by Chebyshev-filtered subspace iteration.

Vectors become integers once and lie in blocks (``Fit.blocks``: ids and one binary matrix a row). The sums, and so the
mean, are exact. A pass is one Spark job: every task multiplies its centred blocks with a ``dim x width`` basis,
``X'(XQ)``, and only such partial products leave it; they are added in two steps where tasks are many, so the driver
sees at most ``SLOTS`` matrices a pass, whatever the number of vectors. Between passes the driver holds bases of
``dim x BLOCK`` numbers: a polynomial recurrence damps the spectrum below the block's least Ritz value, QR
makes the basis orthonormal, Rayleigh-Ritz gives values and vectors, until the residuals of the wanted ones are at
rounding level (``CERTIFIED``). A lost executor costs a task of one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .tables import prepared, read, written

#: Entries become floor(SCALE * c) + SHIFT; greater ones than LARGEST have no exact integer of that kind.
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 40)
#: Components returned, and width of the iterated basis: the more beyond those wanted, the faster it converges.
COMPONENTS, BLOCK = 8, 32
#: Highest degree of the filter, and how far it may raise the first Ritz vector over the last one wanted.
DEGREE, SPREAD = 12, 1e8
#: A pair is certified when its residual is at most this (times the root of the dimension) of the first Ritz value.
CERTIFIED = 1e-14
#: Ritz values below this share of the first are null: such directions hold no variance that could be scaled to 1.
NULL = 1e-12
#: Vectors of one block, and partial products that the driver adds up itself.
ROWS, SLOTS = 4096, 32


@dataclass
class Fit:
    """Exact moments of the fit list, its blocks, and the certified components once fitted."""

    blocks: DataFrame
    tasks: int
    dim: int
    n: int
    sums: list[int]  # per dimension
    trace: float = 0.0
    values: np.ndarray | None = None  # eigenvalues, falling
    vectors: np.ndarray | None = None  # dim x components
    passes: int = 0

    @property
    def base(self) -> np.ndarray:
        """Whole part of the mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """What n times ``base`` leaves of the sums: from 0 to n - 1."""
        return [s % self.n for s in self.sums]

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n in double precision: the whole part is taken off exactly."""
        base, part = self.base, np.array([r / self.n for r in self.rest])
        return lambda x: (x - base) - part


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, v)``: vectors without null or non-finite entries (nor any beyond ``LARGEST``), of the commonest length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad)
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1)
    return rows.join(F.broadcast(lengths.select("dim")), F.size("v") == F.col("dim"))  # one row


def packed(rows: DataFrame) -> DataFrame:
    """``(dim, ids, x)``: up to ``ROWS`` integer vectors a row, as little-endian longs."""

    def pack(batches):
        ids, xs, held, dim = [], [], 0, 0

        def block():
            x = np.concatenate(xs)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([[i for p in ids for i in p]], pa.list_(pa.int64())), pa.array([x.astype("<i8").tobytes()], pa.binary())],
                                              names=["dim", "ids", "x"])

        for batch in batches:
            if not batch.num_rows:
                continue
            dim = batch.column(2)[0].as_py()
            c = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            xs.append(np.floor(SCALE * c).astype(np.int64) + SHIFT)
            ids.append(batch.column(0).to_pylist())
            held += batch.num_rows
            if held >= ROWS:
                yield block()
                ids, xs, held = [], [], 0
        if held:
            yield block()

    prepared(rows.sparkSession)
    return rows.select("id", "v", "dim").mapInArrow(pack, "dim int, ids array<long>, x binary")


def _added(parts: DataFrame, tasks: int) -> np.ndarray:
    """Sum of the partial products (binary doubles) of all tasks, in task order."""
    if tasks > SLOTS:

        def add(pdf):
            pdf = pdf.sort_values("task")
            total = sum(np.frombuffer(m) for m in pdf["m"])
            return pdf.head(1).assign(m=[total.tobytes()])

        parts = parts.groupBy(F.pmod("task", F.lit(SLOTS))).applyInPandas(add, "task int, m binary")
    return sum((np.frombuffer(r["m"]) for r in sorted(parts.collect(), key=lambda r: r["task"])), np.zeros(1))


def passed(fit: Fit, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``partial(centred block)`` over all blocks: one Spark job."""
    centred, dim = fit.centred(), fit.dim

    def run(batches):
        total = None
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dim)
                y = partial(centred(x))
                total = y if total is None else total + y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["task", "m"])

    fit.passes += 1
    return _added(fit.blocks.select("x").mapInArrow(run, "task int, m binary"), fit.tasks)


def moments(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Fit | None:
    """Blocks, number and exact sums per dimension of the usable vectors; None without any."""
    blocks = written(packed(usable(vectors, id_col, vec_col)), "whitening")

    def run(batches):
        for batch in batches:
            for dim, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, len(x), np.int64)), pa.array(x.sum(axis=0))], names=["axis", "n", "s"])

    sums = (blocks.select("dim", "x").mapInArrow(run, "axis int, n long, s long").groupBy("axis")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).orderBy("axis").collect())  # one row a dimension
    if not sums:
        return None
    fit = Fit(blocks, blocks.rdd.getNumPartitions(), len(sums), int(sums[0]["n"]), [int(r["s"]) for r in sums])
    fit.trace = float(passed(fit, lambda y: np.array([(y * y).sum()]))[0]) / fit.n
    return fit


def multiplied(fit: Fit, q: np.ndarray) -> np.ndarray:
    """V Q for the covariance V of the fit list, without V."""
    return passed(fit, lambda y: y.T @ (y @ q)).reshape(q.shape) / fit.n


def filtered(fit: Fit, x: np.ndarray, vx: np.ndarray, values: np.ndarray, wanted: int) -> np.ndarray:
    """Chebyshev polynomial of V, small on [0, least Ritz value of the block] and steep above, times the Ritz vectors ``x``.

    ``vx`` is V x. Each step of the three-term recurrence is one pass; both terms are scaled alike, so nothing overflows.
    The degree keeps the ratio of the first to the last wanted direction below ``SPREAD``.
    """
    half = max(float(values[-1]), NULL * float(values[0])) / 2
    steep = lambda v: math.acosh(max(1.0, v / half - 1))  # noqa: E731  growth of log T_m(v) per degree
    apart = steep(float(values[0])) - steep(float(values[wanted - 1]))
    degree = DEGREE if apart <= 0 else int(min(DEGREE, max(2, math.log(SPREAD) / apart)))
    before, now = x, (vx - half * x) / half
    for _ in range(degree - 1):
        before, now = now, 2 * (multiplied(fit, now) - half * now) / half - before
        size = np.linalg.norm(now, axis=0)
        before, now = before / size, now / size
    return now


def fitted(fit: Fit, components: int = COMPONENTS, block: int = BLOCK, rounds: int = 200) -> Fit:
    """``fit`` with its leading eigenpairs (at most ``components``, none whose variance is null).

    Raises if ``rounds`` filters do not certify them.
    """
    width, wanted = min(block, fit.dim), min(components, fit.dim)
    if fit.trace <= 0:  # all vectors are equal
        fit.values, fit.vectors = np.zeros(0), np.zeros((fit.dim, 0))
        return fit
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(fit.dim, width)))[0]
    for _ in range(rounds):
        vq = multiplied(fit, q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, vx = q @ turn, vq @ turn
        left = np.linalg.norm(vx - x * values, axis=0)
        alive = values > NULL * values[0]
        if (left[:wanted] <= CERTIFIED * math.sqrt(fit.dim) * values[0]).all():
            keep = alive[:wanted]
            fit.values, fit.vectors = values[:wanted][keep], x[:, :wanted][:, keep]
            return fit
        q = np.linalg.qr(np.linalg.qr(filtered(fit, x, vx, values, wanted))[0])[0]
    raise ArithmeticError(f"not certified after {rounds} filters: residuals {left[:wanted] / values[0]}")


def whitened(fit: Fit) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark, n, dim = fit.blocks.sparkSession, fit.n, fit.dim
    k = len(fit.values)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return spark.createDataFrame([], schema)
    to, centred, base, rest = fit.vectors / np.sqrt(fit.values), fit.centred(), fit.base, fit.rest
    explained = fit.values / fit.trace

    def squares(y):
        z = y @ to
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    m = passed(fit, squares)
    mean = m[:k] / n
    error = float(np.abs(m[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())

    def deviations(x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 = (n y - r)^2 over dimensions, in whole numbers; null beyond a long."""
        y = x - base
        top = int(np.abs(y).max(initial=0)) + 1
        kind = np.int64 if top * max(top, n) * dim < 1 << 62 else object
        y, r = y.astype(kind), np.array(rest, kind)
        yy, yr, rr = (y * y).sum(axis=1).tolist(), (y * r).sum(axis=1).tolist(), sum(v * v for v in rest)
        out = [n * n * int(a) - 2 * n * int(b) + rr for a, b in zip(yy, yr, strict=True)]
        return [d if d < 1 << 63 else None for d in out]

    def run(batches):
        for batch in batches:
            for ids, raw in zip(batch.column(0), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dim)
                rows = len(x)
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)),
                     pa.array(deviations(x), pa.int64()).take(each), pa.array((centred(x) @ to).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return fit.blocks.select("ids", "x").mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The whitened coordinates of every usable vector, one row for each of at most ``components`` components.

    Vectors that are null, empty, hold null or non-finite entries or entries beyond ``LARGEST``, or have another length than
    the commonest (ties: the shorter), take no part. Repeated rows count and return as often as they stand there; a null id
    stays null. Directions without variance are left out (equal vectors alone, or a single one: no rows), an empty
    table gives no rows. A ``deviation`` that no long holds is null. Other columns are ignored, whatever their names.
    """
    fit = moments(vectors, id_col, vec_col)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whitened(fitted(fit, components))


def op12_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened coordinates of every vector of ``embeddings``."""
    return whiten(read(prepared(spark), sf_dir, "embeddings"))
