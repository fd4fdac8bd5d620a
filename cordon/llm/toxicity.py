"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

``P(grade >= j) = sigmoid(w . x - theta_j)`` with one weight vector ``w`` shared by all ordered
thresholds ``theta_1 <= theta_2 <= ...``; x marks the words present in a text. The model is fitted on a
bounded sample of labelled rows (``SAMPLE``, the documented bound) and its weights, at most
``FEATURES``, are broadcast; every text is then scored whole, in one map without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W

from .tables import dropped, prepared, read, written
from .words import PUNCT, mix, shingles, word_hashes

#: Labelled rows that the model is fitted on, at most: those with the least hash of their id.
SAMPLE = 10_000
#: Different texts of those ids, at most: of each id as many with the least hash as fit in evenly, ``PER_ID`` at most.
ROWS, PER_ID = 4 * SAMPLE, 1_000
#: Words that may carry a weight, at most: those that part the grades best in the sample.
FEATURES = 512
#: A word needs this many labelled texts and this z-score against the grades.
MIN_DOCS, MIN_Z = 5, 4.0
COPY_WORDS = 5
#: Copies agree in this share of so many minima of their runs of words; the first few find the texts to compare.
SIMILAR, MINIMA, FIRST = 0.8, 128, 8
L1, ROUNDS = 1e-4, 1500
#: Words that the fit takes at once, and rows of a block of its features: the driver holds no second copy of the sample.
PART_WORDS, BLOCK = 200_000, 1_000


@dataclass
class Model:
    words: np.ndarray  # sorted fingerprints
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def score(self, words: np.ndarray) -> float:
        if not len(self.words) or not len(words):
            return 0.0
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        return float(self.weights[np.unique(at[self.words[at] == words])].sum())

    def above(self, score: float) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def _log_lik_parts(z: np.ndarray, y: np.ndarray, theta: np.ndarray):
    """Probability of each row's grade and its derivatives by the score and the thresholds."""
    up = np.concatenate([np.ones((len(z), 1)), 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -50, 50))), np.zeros((len(z), 1))], axis=1)
    slope = up * (1 - up)  # d P(grade >= j) / dz
    rows = np.arange(len(z))
    p = np.maximum(up[rows, y] - up[rows, y + 1], 1e-12)
    dz = (slope[rows, y] - slope[rows, y + 1]) / p
    dt = np.zeros((len(z), len(theta)))
    low, high = y >= 1, y < len(theta)
    dt[rows[low], y[low] - 1] = -slope[rows[low], y[low]] / p[low]
    dt[rows[high], y[high]] = slope[rows[high], y[high] + 1] / p[high]
    return p, dz, dt


def _parts(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, word)`` of the texts in order, in parts of about ``PART_WORDS``."""
    ends = np.cumsum([len(t) for t in texts])
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PART_WORDS, side="right")))
        yield np.repeat(np.arange(at, to), [len(t) for t in texts[at:to]]), np.concatenate(texts[at:to])
        at = to


def _vocabulary(texts: list[np.ndarray]) -> np.ndarray:
    """The words of ``MIN_DOCS`` texts or more, ascending."""
    words, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _, part in _parts(texts):
        new, n = np.unique(part, return_counts=True)
        words, at = np.unique(np.concatenate([words, new]), return_inverse=True)
        times = np.bincount(at, np.concatenate([times, n]), len(words)).astype(np.int64)
    return words[times >= MIN_DOCS]


def _columns(texts: list[np.ndarray], words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, place in words)`` of the occurrences of ``words``, part by part."""
    for rows, part in _parts(texts):
        at = np.searchsorted(words, part)
        at[at == len(words)] = 0
        known = words[at] == part
        yield rows[known], at[known]


def fit(texts: list[np.ndarray], grades: np.ndarray, n_grades: int, copies: np.ndarray | None = None) -> Model:
    """The model of word sets and their grades 0 .. n_grades - 1.

    Texts with one number in ``copies`` share one vote, so a group of copies with a wrong label
    teaches little. Without rows of both sorts, no word has a weight.
    """
    top = n_grades - 1
    y = np.asarray(grades, np.int64)
    if len(y) == 0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(top, 50.0))
    _, group, size = np.unique(np.arange(len(y)) if copies is None else copies, return_inverse=True, return_counts=True)
    votes = 1.0 / size[group]
    votes /= votes.sum()
    share = [float(votes[y >= j].sum()) for j in range(1, n_grades)]
    theta = np.array([-np.log(max(s, 1e-4) / max(1 - s, 1e-4)) for s in share])
    theta = np.maximum.accumulate(theta)
    tokens = _vocabulary(texts)
    if not len(tokens) or y.max() == y.min():
        return Model(np.zeros(0, np.uint64), np.zeros(0), theta)
    raw = votes * len(np.unique(group))  # votes in texts
    mean = float((raw * y).sum() / raw.sum())
    var = float((raw * (y - mean) ** 2).sum() / raw.sum())
    df, pull = np.zeros(len(tokens)), np.zeros(len(tokens))
    for rows, column in _columns(texts, tokens):
        np.add.at(df, column, raw[rows])
        np.add.at(pull, column, (raw * (y - mean))[rows])
    z = pull / np.sqrt(np.maximum(df * var, 1e-9))
    good = np.flatnonzero((df >= MIN_DOCS) & (np.abs(z) >= MIN_Z))
    good = np.sort(good[np.argsort(-np.abs(z[good]), kind="stable")[:FEATURES]])
    if not len(good):
        return Model(np.zeros(0, np.uint64), np.zeros(0), theta)
    x = np.zeros((len(texts), len(good)))
    for rows, column in _columns(texts, tokens[good]):
        x[rows, column] = 1
    w = np.zeros(len(good))
    # Proximal gradient with momentum; the step from the largest curvature of the logistic parts.
    curvature = sum(x[k: k + BLOCK].T @ (x[k: k + BLOCK] * votes[k: k + BLOCK, None]) for k in range(0, len(x), BLOCK))
    step = 1 / (0.5 * float(np.linalg.eigvalsh(curvature)[-1]) + 0.5)
    ahead_w, ahead_t, t = w.copy(), theta.copy(), 1.0
    for _ in range(ROUNDS):
        _, dz, dt = _log_lik_parts(x @ ahead_w, y, ahead_t)
        new_w = ahead_w + step * (x.T @ (votes * dz))
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * L1, 0)
        new_t = np.maximum.accumulate(ahead_t + step * (votes @ dt))
        k = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_t = new_w + (t - 1) / k * (new_w - w), np.maximum.accumulate(new_t + (t - 1) / k * (new_t - theta))
        w, theta, t = new_w, new_t, k
    kept = np.flatnonzero(w)
    return Model(tokens[good][kept], w[kept], theta)


def graded(texts: list[np.ndarray], toxic: np.ndarray, copies: np.ndarray, n_grades: int) -> np.ndarray:
    """Severity grades from a yes/no mark: 0 for no; a yes is graded by evenly sized ranges of its evidence.

    The evidence is the score under the two-grade model of the same rows; marked rows without any are of grade 1.
    """
    m = fit(texts, toxic, 2, copies)
    score = np.array([m.score(t) for t in texts])
    strong = score[(toxic == 1) & (score > 0)]
    cuts = np.quantile(strong, np.arange(1, n_grades - 1) / (n_grades - 1)) if len(strong) else np.zeros(0)
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, score, side="left"), 0)


_SALTS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64))


def minima(words: np.ndarray) -> np.ndarray:
    """Least fingerprint of a text's runs of words under each of ``MINIMA`` orders; zeros without words."""
    if not len(words):
        return np.zeros(MINIMA, np.uint64)
    runs = np.unique(shingles(words, COPY_WORDS))
    return np.array([mix(runs ^ salt).min() for salt in _SALTS])


def copy_groups(signs: np.ndarray) -> np.ndarray:
    """A number for each row of minima: that of the first row it is a copy of (``SIMILAR``), or its own."""
    out, same = np.arange(len(signs)), {}
    heads: list[dict[int, list[int]]] = [{} for _ in range(FIRST)]
    for i, sign in enumerate(signs):
        if (first := same.setdefault(hashlib.blake2b(sign, digest_size=16).digest(), i)) != i:
            out[i] = out[first]
            continue
        found = [h[int(v)] for h, v in zip(heads, sign, strict=False) if int(v) in h]
        if found:
            near = np.unique(np.concatenate(found))
            alike = (signs[near] == sign).mean(axis=1)
            if alike.max() >= SIMILAR:
                out[i] = near[alike.argmax()]
                continue
        for h, v in zip(heads, sign, strict=False):
            h.setdefault(int(v), []).append(i)
    return out


def train(docs: DataFrame, labels: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
          label_id: str = "doc_id", grade_col: str = "grade", binary: bool = False) -> Model:
    """Fits on at most ``SAMPLE`` rows of ``labels`` (id, grade) and ``ROWS`` texts; null ids and grades don't count.

    Where an id repeats, its equal texts count once, and of its different ones those with the least hash are taken.

    ``binary``: the labels say only yes or no, and ``graded`` derives the grades.
    """
    spark = prepared(docs.sparkSession)
    known = written(labels.select(F.col(label_id).cast("long").alias("_l"), F.col(grade_col).cast("int").alias("_g"))
             .where("_l IS NOT NULL AND _g IS NOT NULL").groupBy("_l").agg(F.max("_g").alias("_g"))
             .orderBy(F.xxhash64("_l"), "_l").limit(SAMPLE), "known")
    each = max(1, min(PER_ID, ROWS // max(1, known.count())))

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            new = [key not in seen and not seen.add(key) for key in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            batch = batch.filter(pa.array(new, pa.bool_()))
            found = [w for _, w in word_hashes(batch.column(0), PUNCT)]
            sets, signs = (pa.array([f(w).tobytes() for w in found], pa.binary()) for f in (np.unique, minima))
            yield pa.RecordBatch.from_arrays([batch.column(1), sets, signs, batch.column(2), batch.column(3)], names=["g", "w", "c", "l", "h"])

    texts = docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).cast("string").alias("_t"))
    own = texts.join(F.broadcast(known), texts["_d"] == known["_l"]).select("_t", "_g", "_l", F.xxhash64("_t").alias("_h"))
    # Hashes alone choose the rows; each task keeps few of an id, so one that repeats much is no hot key.
    nth = F.row_number().over(W.partitionBy("_l").orderBy("_h"))
    chosen = written(own.select("_l", "_h").distinct().withColumn("_n", nth).where(F.col("_n") <= each).select("_l", "_h"), "chosen")
    sample = written(own.join(F.broadcast(chosen), ["_l", "_h"]).select("_t", "_g", "_l", "_h")
                     .mapInArrow(run, "g int, w binary, c binary, l long, h long").dropDuplicates(["l", "h"]).select("g", "w", "c"), "sample")
    # A partition at a time, into one buffer each: they go back to the system as a whole, thousands of small arrays would not.
    grades, ends, words, signs = [], [0], bytearray(), bytearray()
    for r in sample.toLocalIterator():
        grades.append(r.g)
        words += r.w
        signs += r.c
        ends.append(len(words) // 8)
    dropped(known, chosen, sample)
    flat = np.frombuffer(words, np.uint64)
    sets = [flat[a:b] for a, b in pairwise(ends)]
    # The fit doesn't hang on task order.
    by = sorted(range(len(sets)), key=lambda k: (len(sets[k]), int(sets[k].sum()), grades[k]))
    sets = [sets[k] for k in by]
    grades = np.clip(np.array([grades[k] for k in by], np.int64), 0, n_grades - 1)
    copies = copy_groups(np.frombuffer(signs, np.uint64).reshape(-1, MINIMA)[by])
    del signs
    if binary:
        grades = graded(sets, np.minimum(grades, 1), copies, n_grades)
    return fit(sets, grades, n_grades, copies)


def scored(docs: DataFrame, model: Model, n_grades: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, p_toxic, expected_severity, grade)`` for every row.

    ``p_toxic`` is P(grade >= 1), ``expected_severity`` the mean grade, ``grade`` the most probable one (ties to the
    smaller). Null and empty texts have no words: their grade is what the thresholds alone say. Repeated
    rows score alike, null ids stay null.
    """
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            above = np.array([m.above(m.score(w)) for _, w in word_hashes(batch.column(1), PUNCT)]).reshape(batch.num_rows, n_grades - 1)
            full = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            grade = (full[:, :-1] - full[:, 1:]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32))],
                                             names=["doc_id", "p_toxic", "expected_severity", "grade"])

    return (docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
            .mapInArrow(run, "doc_id long, p_toxic double, expected_severity double, grade int"))


#: Grades of the registered query: 0 not toxic, 1 to 3 from mild to severe.
GRADES = 4


def toxicity_model(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the ``toxic`` marks in ``labels``."""
    return train(docs, labels, GRADES, grade_col="toxic", binary=True)


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all ``docs`` by a model of their labelled rows, with ``toxic`` 1 where P(grade >= 1) is 0.5 or more."""
    return scored(docs, toxicity_model(docs, labels), GRADES).withColumn("toxic", (F.col("p_toxic") >= 0.5).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text is graded toxic (row by row; ids may repeat or be null)."""
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(toxicity_model(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            keep = np.array([m.above(m.score(w))[0] < 0.5 for _, w in word_hashes(batch.column(at), PUNCT)], bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of all ``documents``; grades from ``labels``."""
    return severities(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
