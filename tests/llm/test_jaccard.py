"""The join against brute force: random near copies, hot tokens, blocks of large families, edge rows."""

import os
import random

import duckdb
import numpy as np
import pytest
from conftest import SF001
from llm.frames import docs, prose

from cordon.llm import jaccard_join as j


def brute(rows, size, percent):
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        sets.append(frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
                if x != y:
                    links[a].add(y)
                    links[b].add(x)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [r[0] for b, r in enumerate(rows) if find(b) == find(a) and r[0] is not None]
        out.append((i, len(sets[a]), min(ids) if ids else None, len(links[a])))
    return sorted(out, key=str)


def got(spark, rows, **how):
    return sorted((tuple(r) for r in j.jaccard_components(docs(spark, rows), **how).collect()), key=str)


def near(base, seed, edits):
    rng, words = random.Random(seed), base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(words)


def corpus():
    rows, k = [], 0
    for g in range(12):
        base = prose(g, 30 + 25 * g)
        for c in range(6):
            rows.append((k, near(base, 100 * g + c, c * (1 + g // 3))))
            k += 1
        rows.append((k, base.upper().replace(" ", "\t ")))
        k += 1
    return rows


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_equals_brute_force(spark, size, percent):
    rows = corpus() + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one"), (None, prose(3, 105)), (0, corpus()[0][1])]
    assert got(spark, rows, size=size, percent=percent) == brute(rows, size, percent)


def test_hot_tokens_and_blocks(spark, monkeypatch):
    """Star edges, several length bands and blocks give the same result as pairs in one unit."""
    passage = prose(999, 60)
    rows = [(k, near(passage, k, 1 + k % 3) + " " + prose(5000 + k, k % 7)) for k in range(90)]
    rows += [(200 + k, passage + " " + prose(7000 + k, 400)) for k in range(10)]
    rows += [(300, passage)]
    want = brute(rows, 4, 85)
    monkeypatch.setattr(j, "HOT", 3)
    monkeypatch.setattr(j, "UNIT_SETS", 8)
    assert got(spark, rows) == want
    monkeypatch.setattr(j, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(j, "UNIT_TOKENS", 500)
    assert got(spark, rows) == want


def test_empty_and_clashing_columns(spark):
    assert j.jaccard_components(docs(spark, [])).count() == 0
    extra = docs(spark, corpus()[:14]).selectExpr("*", "1 AS k", "2 AS n", "3 AS at", "4 AS component_id")
    kept = j.one_of_each(extra)
    assert kept.columns == extra.columns
    want = {r[2] for r in brute(corpus()[:14], 4, 85)}
    assert {r.doc_id for r in kept.collect()} == want


def test_long_text(spark):
    long = prose(1, 120_000, 50_000)
    rows = [(1, long), (2, long + " tail"), (3, prose(2, 500))]
    assert [r[2] for r in got(spark, rows)] == [1, 1, 3]


def test_overlap_matrix():
    sets = [np.unique(np.random.default_rng(s).integers(0, 60, 40).astype(np.uint64)) for s in range(5)]
    want = [[len(np.intersect1d(a, b)) if a is not b else len(a) for b in sets] for a in sets]
    shared = j._gram(sets)
    assert all(shared[a, b] == want[a][b] for a in range(5) for b in range(5) if a != b)


def test_query_equals_sql(spark):
    rows = sorted(map(tuple, j.op8_ngram_jaccard(spark, SF001).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(SF001, 'documents.parquet')}'")
    assert rows == sorted(con.execute(f"SELECT doc_id, n_shingles, component_id, n_links FROM ({j.ORACLE_SQL})").fetchall())


def test_links_count_once_where_blocks_are_empty(spark, monkeypatch):
    """More blocks than sets, cut by tokens: some units of two blocks hold one side only."""
    base = prose(77, 120)
    rows = [(k, near(base, k, 1)) for k in range(14)]
    for tokens in (20, 60, 150):
        monkeypatch.setattr(j, "UNIT_TOKENS", tokens)
        assert got(spark, rows) == brute(rows, 4, 85)


def test_one_of_each_decides_by_row(spark):
    """An id that repeats loses only its copied text; near copies without an id leave one row."""
    a, b, own = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a), (5, near(a, 1, 1)), (5, own), (None, near(a, 2, 1)), (None, b), (None, b), (None, near(b, 3, 1)), (None, near(b, 4, 1)), (None, None), (None, ""), (7, None)]
    kept = sorted(((r.doc_id, r.text) for r in j.one_of_each(docs(spark, rows)).collect()), key=str)
    of_b = [r for r in kept if r[0] is None and r[1]]
    assert len(of_b) == 1 and of_b[0][1] in [rows[k][1] for k in (4, 6, 7)]
    assert [r for r in kept if r not in of_b] == sorted([(1, a), (5, own), (None, None), (None, ""), (7, None)], key=str)


def test_stars_connect_the_classes_of_each_token(spark):
    """With few or many parts: one tree per token, ends among its classes, nothing for tokens of one class."""
    rng = random.Random(5)
    groups = {1: list(range(500)), 2: [7], 3: [rng.randrange(10_000, 20_000) for _ in range(90)], 4: [30_001, 30_000], 5: [499, 40_000]}
    table = spark.createDataFrame([(t, k) for t, ks in groups.items() for k in ks + ks[:3]], "token long, k long")
    for salts in (1, 3, 64, 5000):
        edges = {(r.a, r.b) for r in j._stars(table, salts).collect()}
        up = {}

        def root(x, up=up):
            while x in up:
                x = up[x]
            return x

        for a, b in edges:
            if root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
        parts = {frozenset(x for x in up.keys() | up.values() if root(x) == r) for r in {root(x) for x in up}}
        assert parts == {frozenset(groups[1] + groups[5]), frozenset(groups[3]), frozenset(groups[4])}
        assert len(edges) == sum(len(set(ks)) - 1 for ks in groups.values())


def test_no_query_reads_many_tables_at_once(spark, monkeypatch):
    """Each scan, stage and small side of a query holds the driver's memory while it runs: pairs, stars, units and names are queries of their own."""
    scans, written, edges = {}, j.written, j._edges

    def counted(df, name):
        scans[name] = df._jdf.queryExecution().executedPlan().toString().count("FileScan")
        return df

    monkeypatch.setattr(j, "written", lambda df, name: written(counted(df, name), name))
    monkeypatch.setattr(j, "_edges", lambda *a: counted(edges(*a), "edges"))
    rows = [(k, prose(k % 9, 60) + f" t{k}") for k in range(30)] + [(90, ""), (None, prose(3, 60))]
    j.one_of_each(docs(spark, rows), size=5, percent=80).collect()
    assert {"pairs", "stars", "units", "named", "edges"} <= set(scans) and max(scans.values()) <= 9, scans
