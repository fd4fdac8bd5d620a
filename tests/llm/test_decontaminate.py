"""Tiles against a plain greedy search; leaks, reordered passages, edge rows."""

import random

import pyarrow as pa
import pytest
from llm.frames import docs, prose

from cordon.llm import decontaminate as d
from cordon.llm.words import PUNCT, word_hashes


def greedy(text, item, least):
    """Repeatedly the longest unmarked common run, first in the text, then in the item."""
    a, b, out = [False] * len(text), [False] * len(item), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        out.append((i, j, k))
        a[i:i + k], b[j:j + k] = [True] * k, [True] * k


@pytest.mark.parametrize("seed", range(12))
def test_tiles_equal_the_plain_search(seed):
    rng = random.Random(seed)
    item = [f"v{rng.randrange(6)}" for _ in range(30)]
    cuts = sorted(rng.sample(range(30), 3))
    parts = [item[:cuts[0]], item[cuts[0]:cuts[1]], item[cuts[1]:cuts[2]], item[cuts[2]:]]
    rng.shuffle(parts)
    text = [w for p in parts for w in [*p, f"x{rng.randrange(3)}"]]
    block = d.Block.of([1], pa.array([" ".join(item)]), 3)
    words = next(word_hashes(pa.array([" ".join(text)]), PUNCT))[1]
    _, i, j, n = block.matches(words)
    assert sorted(d.tiles(i, j, n, 3)) == sorted(greedy(text, item, 3))


@pytest.mark.parametrize("seed", range(6))
def test_matches_equal_the_plain_search(seed, monkeypatch):
    """All maximal common runs of several items, however few pairs are looked at at once."""
    monkeypatch.setattr(d, "PAIRS", 7)
    rng = random.Random(seed)
    items = [[f"v{rng.randrange(3)}" for _ in range(rng.randrange(1, 25))] for _ in range(5)]
    text = [f"v{rng.randrange(3)}" for _ in range(60)]
    block = d.Block.of(list(range(5)), pa.array([" ".join(x) for x in items]), 3)
    words = next(word_hashes(pa.array([" ".join(text)]), PUNCT))[1]
    want = []
    for one, item in enumerate(items):
        for i in range(len(text)):
            for j in range(len(item)):
                if text[i] == item[j] and (i == 0 or j == 0 or text[i - 1] != item[j - 1]):
                    k = 0
                    while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k]:
                        k += 1
                    if k >= 3:
                        want.append((one, i, j, k))
    item, i, j, n = block.matches(words)
    assert sorted(zip(item.tolist(), i.tolist(), j.tolist(), n.tolist(), strict=True)) == sorted(want)
    for one, own in enumerate(items):
        at = item == one
        covered = {y + k for _, x, y, m in want if _ == one for k in range(m)}
        assert d.reached(j[at], n[at]) == len(covered) <= len(own)


ITEM = prose(1, 40)
HALVES = ITEM.split()


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_whole_reordered_and_not_short_ones(spark):
    reordered = " ".join(HALVES[20:]) + " zz " + prose(5, 30) + " " + " ".join(HALVES[:20])
    rows = [(1, prose(2, 50) + " " + ITEM.upper() + "! " + prose(3, 9)), (2, reordered), (3, prose(4, 300)),
            (4, prose(6, 20) + " " + " ".join(HALVES[:12])), (5, None), (6, ""), (7, ITEM), (7, ITEM), (None, ITEM)]
    got = d.leaked(docs(spark, rows), bench(spark, [(9, ITEM), (10, None), (11, "a b"), (12, prose(77, 30))])).collect()
    assert sorted([(r.doc_id if r.doc_id is not None else -1, r.item_id) for r in got]) == [(-1, 9), (1, 9), (2, 9), (7, 9), (7, 9)]
    two = next(r for r in got if r.doc_id == 2)
    assert two.coverage == 1.0 and two.tiles == 2 and two.longest == 20
    kept = d.clean(docs(spark, rows).selectExpr("*", "1 AS coverage"), bench(spark, [(9, ITEM)]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_short_items_are_matched_whole(spark):
    rows = [(1, "so: What IS this? " + prose(3, 9)), (2, "what is, but this"), (3, "is this"), (4, "this"), (5, None), (6, ""), (7, "what is this")]
    items = bench(spark, [(20, "what is this"), (21, "is this"), (22, ""), (23, "..."), (24, "what is this"), (25, "no such words")])
    got = sorted((r.doc_id, r.item_id, r.coverage, r.tiles, r.longest) for r in d.leaked(docs(spark, rows), items).collect())
    assert got == sorted([(k, i, 1.0, 1, 3) for k in (1, 7) for i in (20, 24)] + [(k, 21, 1.0, 1, 2) for k in (1, 3, 7)])
    assert sorted(r.doc_id for r in d.clean(docs(spark, rows), items).collect()) == [2, 4, 5, 6]


def test_blocks_change_nothing(spark):
    rows = [(k, prose(100 + k, 40)) for k in range(6)]
    one = list(d.blocks(bench(spark, rows)))
    many = list(d.blocks(bench(spark, rows), chars=300))
    assert len(one) == 1 and len(many) > 2
    texts = [(k, prose(500 + k, 30) + " " + prose(100 + k, 40)) for k in range(6)]
    found = []
    for block in many:
        for row, words in word_hashes(pa.array([t for _, t in texts]), PUNCT):
            found += [(row, block.ids[x[0]]) for x in d.leaks(words, block, 0.5)]
    assert sorted(found) == [(k, k) for k in range(6)]


def test_empty_tables(spark):
    assert d.leaked(docs(spark, []), bench(spark, [(1, ITEM)])).count() == 0
    assert d.leaked(docs(spark, [(1, ITEM)]), bench(spark, [])).count() == 0
    assert d.clean(docs(spark, [(1, ITEM)]), bench(spark, [])).count() == 1


def test_long_repetitive_text_is_quick():
    block = d.Block.of([1], pa.array(["from " * 40]), 5)
    words = next(word_hashes(pa.array(["from " * 3000]), PUNCT))[1]
    (one,) = d.leaks(words, block, 0.5)
    assert one[1] == 1.0


def test_repetitive_text_and_item_stay_small():
    """20 million shared seeds of 50,000 by 400 equal words: memory follows the lengths, not their product."""
    import tracemalloc
    block = d.Block.of([1, 2], pa.array(["from " * 400, prose(1, 40)]), 5)
    words = next(word_hashes(pa.array(["from " * 50_000 + prose(1, 40)]), PUNCT))[1]
    tracemalloc.start()
    found = list(d.leaks(words, block, 0.5))
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert [(x[0], x[1]) for x in found] == [(0, 1.0), (1, 1.0)]
