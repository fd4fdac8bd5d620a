"""Benchmark decontamination by greedy string tiling.

A benchmark item and a text share *seeds*: equal Karp-Rabin fingerprints of ``MIN_MATCH`` running words.
Seeds on one diagonal join to maximal matches; of the seeds only those where a match begins or ends are kept, ``PAIRS`` are
looked at at once, so a text and an item that repeat themselves cost memory by their lengths, not by the product. The longest match whose words are unmarked on both
sides becomes a tile and is marked; what is left of a cut match is queued again, until no match of
``MIN_MATCH`` words is left. Tiles may lie in any order in the text, so a passage whose sentences were
swapped around is still covered. A text leaks an item if its tiles cover ``COVERAGE`` of the item's words.
An item of fewer than ``MIN_MATCH`` words has one seed, all of its words, and is leaked where they stand whole in the text.

The benchmark is the stated, small side: it is cut into blocks of bounded size, each broadcast to one
map over the texts (one block for benchmarks up to ``BLOCK_CHARS`` characters). Texts are never shuffled
and no group of documents meets in a task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .tables import prepared, read
from .words import PUNCT, shingles, word_hashes

MIN_MATCH, COVERAGE = 5, 0.5
#: Shared seeds (position in the text, position in an item) looked at at once.
PAIRS = 1 << 20
#: Characters of benchmark text in one broadcast block (about 24 bytes each when indexed).
BLOCK_CHARS = 16_000_000


@dataclass
class Block:
    """Seeds of some benchmark items: sorted fingerprints, and for each the (item, position) pairs."""
    ids: list
    lengths: np.ndarray
    seeds: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    places: np.ndarray
    filter: np.ndarray
    words: np.ndarray  # of all items, one after the other
    offsets: np.ndarray
    min_match: int
    short: list  # per length below min_match: that length, sorted fingerprints of whole items, and their items

    @classmethod
    def of(cls, ids: list, texts: pa.Array, min_match: int) -> Block:
        lengths, hashes, items, places, every = np.zeros(len(ids), np.int64), [], [], [], [np.zeros(0, np.uint64)]
        whole: dict[int, list] = {}
        for row, words in word_hashes(texts, PUNCT):
            lengths[row] = len(words)
            every.append(words.copy())
            if 0 < len(words) < min_match:
                whole.setdefault(len(words), []).append((int(shingles(words, len(words))[0]), row))
            elif len(words):
                s = shingles(words, min_match)
                hashes.append(s)
                items.append(np.full(len(s), row))
                places.append(np.arange(len(s)))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        by = np.argsort(h, kind="stable")
        seeds, starts = np.unique(h[by], return_index=True)
        table = np.zeros(1 << 20, bool)
        table[(seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        flat = lambda x: np.concatenate(x)[by] if x else np.zeros(0, np.int64)
        return cls(ids, lengths, seeds, np.append(starts, len(h)), flat(items), flat(places), table, np.concatenate(every), np.append(0, np.cumsum(lengths)), min_match,
                   [(n, np.array([k for k, _ in sorted(pairs)], np.uint64), np.array([row for _, row in sorted(pairs)], np.int64)) for n, pairs in sorted(whole.items())])

    def shorts(self, words: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, words) of every short item that stands whole in the text."""
        for n, hashes, items in self.short:
            if len(words) >= n:
                at = np.isin(hashes, shingles(words, n))
                yield from ((int(item), n) for item in items[at])

    def matches(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, start in the text, start in the item, length) of every maximal match, by item, diagonal and start."""
        none = np.zeros(0, np.int64)
        if len(words) < self.min_match or not len(self.seeds):
            return none, none, none, none
        s = shingles(words, self.min_match)
        maybe = np.flatnonzero(self.filter[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.seeds, s[maybe])
        at[at == len(self.seeds)] = 0
        same = self.seeds[at] == s[maybe]
        maybe, at = maybe[same], at[same]
        upto = np.cumsum(self.starts[at + 1] - self.starts[at])
        begins, ends = [], []
        for low in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
            pair = np.arange(low, min(low + PAIRS, int(upto[-1])))
            k = np.searchsorted(upto, pair, side="right")
            pick = self.starts[at[k] + 1] - (upto[k] - pair)
            item, i, j = self.items[pick], maybe[k], self.places[pick]
            first, size = self.offsets[item], self.lengths[item]
            # A match begins where the words before differ or one side begins, and ends likewise.
            head = (i == 0) | (j == 0)
            head[~head] = words[i[~head] - 1] != self.words[first[~head] + j[~head] - 1]
            m = self.min_match
            tail = (i + m == len(words)) | (j + m == size)
            tail[~tail] = words[i[~tail] + m] != self.words[first[~tail] + j[~tail] + m]
            begins.append(np.stack([item[head], i[head] - j[head], i[head]]))
            ends.append(np.stack([item[tail], i[tail] - j[tail], i[tail]]))
        if not begins:
            return none, none, none, none
        b, e = np.concatenate(begins, axis=1), np.concatenate(ends, axis=1)
        b, e = b[:, np.lexsort(b[::-1])], e[:, np.lexsort(e[::-1])]  # begins and ends of a diagonal take turns
        return b[0], b[2], b[2] - b[1], e[2] - b[2] + self.min_match


def tiles(i: np.ndarray, j: np.ndarray, length: np.ndarray, min_match: int, item_length: int = 1 << 60) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(start in text, start in item, length)`` from the maximal matches; longest first, ties to the front.

    Ends early once the item has no room for another tile.
    """
    queue = [(-n, x, y) for n, x, y in zip(length.tolist(), i.tolist(), j.tolist(), strict=True)]
    heapq.heapify(queue)
    in_text, in_item, out = set(), set(), []
    while queue and item_length - len(in_item) >= min_match:
        length, x, y = heapq.heappop(queue)
        length = -length
        free = [x + k not in in_text and y + k not in in_item for k in range(length)]
        if all(free):
            out.append((x, y, length))
            in_text.update(range(x, x + length))
            in_item.update(range(y, y + length))
            continue
        k = 0
        while k < length:  # queue the unmarked rests again
            if free[k]:
                to = k
                while to < length and free[to]:
                    to += 1
                if to - k >= min_match:
                    heapq.heappush(queue, (-(to - k), x + k, y + k))
                k = to
            k += 1
    return out


def reached(j: np.ndarray, length: np.ndarray) -> int:
    """Words of the item that some match covers: a bound on what its tiles cover."""
    by = np.argsort(j, kind="stable")
    start, end = j[by], (j + length)[by]
    before = np.append(0, np.maximum.accumulate(end)[:-1])
    return int(np.maximum(0, end - np.maximum(start, before)).sum())


def leaks(words: np.ndarray, block: Block, coverage: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, coverage, tiles, longest tile) of every item that the text covers enough; short ones in one tile."""
    for one, n in block.shorts(words):
        yield one, 1.0, 1, n
    item, i, j, length = block.matches(words)
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(item) != 0)), len(item)) if len(item) else np.zeros(1, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        one = int(item[a])
        need = coverage * block.lengths[one]
        if reached(j[a:b], length[a:b]) < need:
            continue
        found = tiles(i[a:b], j[a:b], length[a:b], block.min_match, int(block.lengths[one]))
        covered = sum(t[2] for t in found)
        if covered >= need:
            yield one, covered / int(block.lengths[one]), len(found), max(t[2] for t in found)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", min_match: int = MIN_MATCH, chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark's index in blocks of about ``chars`` characters; null texts are left out."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    n = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / chars))
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).orderBy("id", "text").toArrow()
        texts = part["text"].combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else pa.chunked_array(texts).combine_chunks()
        yield Block.of(part["id"].to_pylist(), texts, min_match)


def leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
           min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, item_id, coverage, tiles, longest)``: every row of ``docs`` with every item it leaks.

    Null and empty texts leak nothing, and items without words aren't leaked; repeated rows
    and items give repeated results; rows with a null id are reported with it. Empty tables give no rows.
    """
    spark = prepared(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    out = None
    for block in blocks(benchmark, item_id, item_text, min_match):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            b = shared.value
            for batch in batches:
                rows = [(row, b.ids[one], c, n, most) for row, words in word_hashes(batch.column(1), PUNCT) for one, c, n, most in leaks(words, b, coverage)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                     pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())], names=["doc_id", "item_id", "coverage", "tiles", "longest"])

        found = texts.mapInArrow(run, "doc_id long, item_id long, coverage double, tiles int, longest int")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the rows that leak an item, decided row by row."""
    spark = prepared(docs.sparkSession)
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, min_match=min_match):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            b = shared.value
            for batch in batches:
                keep = [next(leaks(words, b, coverage), None) is None for _, words in word_hashes(batch.column(at), PUNCT)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of all ``benchmark`` items in all ``documents``."""
    return leaked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
