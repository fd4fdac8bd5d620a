"""Mixing: targets against a plain water-filling loop, whole results, reruns, edge rows."""

import os

import duckdb
import pytest
from conftest import SF001
from llm.frames import docs

from cordon.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Plain loop: fill by weight, cap, share what is left among the uncapped."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_ = {}, [s for s in names]
    rest = share * sum(sizes.values())
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > cap * sizes[s]]
        if not over:
            out.update({s: level * w[s] for s in open_})
            break
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
            open_.remove(s)
    return out


ROWS = [(k, "w " * (k % 17 + 1), ["a", "b", "Z", None, "é"][k % 5 if k % 7 else 0]) for k in range(400)]


def test_targets_and_rates(spark):
    got = mixing.copies(docs(spark, ROWS)).select("source", "_size", "_source_size", "_target", "_copies", "doc_id").collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r._size
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r._source_size == sizes[r.source]
        assert r._target == pytest.approx(want[r.source], rel=1e-12)
        rate = want[r.source] / sizes[r.source]
        assert int(rate) <= r._copies <= min(2, int(rate) + 1)
        taken[r.source] = taken.get(r.source, 0) + r._copies * r._size
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in want:
        assert taken[s] == pytest.approx(want[s], rel=0.25)


def test_reruns_agree_and_copies_are_rows(spark):
    a = sorted(map(tuple, mixing.mixed(docs(spark, ROWS)).select("doc_id", "copy").collect()))
    b = sorted(map(tuple, mixing.mixed(docs(spark, ROWS).repartition(7)).select("doc_id", "copy").collect()))
    assert a == b and len(a) == len(set(a))
    n = {r.doc_id: r._copies for r in mixing.copies(docs(spark, ROWS)).collect()}
    assert len(a) == sum(n.values())


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "x y", "a"), (None, None, None), (3, "x", "a"), (3, "x", "a")]
    got = mixing.copies(docs(spark, rows)).collect()
    assert len(got) == 6 and all(r._copies is not None for r in got)
    assert len({r._copies for r in got if r.doc_id == 3}) == 1
    assert all(r._target == 0 and r._copies == 0 for r in got if r.source is None)
    assert mixing.copies(docs(spark, [])).count() == 0
    extra = docs(spark, rows).selectExpr("*", "1 AS copy", "2 AS rate", "3 AS target", "4 AS _size", "5 AS _copies", "6 AS _source")
    out = mixing.mixed(extra)
    assert out.columns == [*extra.columns, "_copy"] and out.count() == mixing.mixed(docs(spark, rows)).count()
    assert {(r._size, r._copies, r._source) for r in out.collect()} == {(4, 5, 6)}


def test_query_equals_sql(spark):
    got = sorted(map(tuple, mixing.op5_mix_sources(spark, SF001).select("doc_id", "size", "source_size", "target", "taken").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(SF001, 'documents.parquet')}'")
    want = sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE_SQL})").fetchall())
    assert got == want


def test_no_python_in_the_plan(spark):
    plan = mixing.copies(docs(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
