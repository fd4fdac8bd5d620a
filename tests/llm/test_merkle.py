"""Manifest against a plain tree, audit paths, tampering, SQL, edge rows."""

import hashlib
import zlib

import duckdb
import pytest
from conftest import SF001
from llm.frames import docs
from pyspark.sql import functions as F

from cordon.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain(nodes):
    """Root of a list of digests, and for each its siblings level by level, with its place."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i: i + 3] for i in range(0, len(nodes), 3)]
        for k, w in enumerate(where):
            run, at = runs[w // 3], w % 3
            paths[k].append(("".join(run[:at]), "".join(run[at + 1:])))
            where[k] = w // 3
        nodes = [h(*r) for r in runs]
    return nodes[0], paths


def wanted(rows):
    """The contract's result of rows (doc_id, text, source, lang, n_chars)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        leaves = sorted(((r[0] is not None, r[0] or 0, h(*map(field, (r[0], r[2], r[3], r[4], r[1])))), r) for r in by[s])
        root, paths = plain([k[2] for k, _ in leaves])
        trees[s] = root, list(zip(leaves, paths, strict=True))
    root, tops = plain([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        sub, leaves = trees[s]
        for ((_, _, leaf), r), path in leaves:
            path = path + top
            t = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                t = h(*map(field, (r[0], r[2], r[3], r[4], None if r[1] is None else r[1].replace("\n", ""))))
            for left, right in path:
                t = h(left, t, right)
            out.append((r[0], leaf, sub, root, h(*[a + b for a, b in path]), t, t == root))
    return out


def run(spark, frame, monkeypatch):
    monkeypatch.setattr(merkle, "read", lambda *a: frame)
    return merkle.op11_merkle_manifest(spark, "")


def check(spark, rows, monkeypatch):
    """rows: (doc_id, text, source, lang)."""
    frame = docs(spark, rows)
    full = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1])) for r in rows]
    got = [tuple(r) for r in run(spark, frame, monkeypatch).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(wanted(full), key=key)


def test_sources_of_many_sizes(spark, monkeypatch):
    rows, k = [], 0
    for size in (1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 244):
        for _ in range(size):
            rows.append((k * 7919 % 10007, f"text {k}\nline" + "\n" * (k % 2), f"s{size}", "en"))
            k += 1
    check(spark, rows, monkeypatch)


def test_nulls_repeats_and_names(spark, monkeypatch):
    rows = [(1, "a\nb", None, "en"), (2, None, "Z", None), (None, "x\n", "z", "en"), (None, None, "z", None), (5, "é€\n", "é", "fr"), (5, "other", "é", "fr"),
            (6, "", "", "en"), (7, "-", "-", "-")] + [(9, "same\n", "dup", "en")] * 200 + [(8, "same\n", "dup", "en")] * 100
    check(spark, rows, monkeypatch)


def test_one_row_one_source_and_none(spark, monkeypatch):
    check(spark, [(3, "a\nb", "s", "en")], monkeypatch)
    check(spark, [(k, "a\nb", "s", "en") for k in range(5)], monkeypatch)
    check(spark, [(k, "a\nb", f"s{k}", "en") for k in range(100)], monkeypatch)
    out = run(spark, docs(spark, []), monkeypatch)
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_clashing_columns_and_long_texts(spark, monkeypatch):
    rows = [(k, "word\n" * 200_000 if k == 3 else f"t{k}", "s", "en") for k in range(10)]
    extra = docs(spark, rows).selectExpr("*", "1 AS leaf", "2 AS tree", "3 AS rank", "4 AS root", "5 AS path", "6 AS n", "7 AS key", "8 AS tampered")
    a = sorted(map(tuple, run(spark, docs(spark, rows), monkeypatch).collect()))
    assert sorted(map(tuple, run(spark, extra, monkeypatch).collect())) == a


def test_requests_of_some_leaves_and_of_none(spark):
    rows = [(k, f"t{k}", "big" if k % 3 else "small", "en") for k in range(600)]
    m = merkle.manifest(docs(spark, rows), merkle.COLUMNS)
    few = m.leaves.where("key IN (5, 6, 300, 599)").select("tree", "rank", F.col("key").alias("doc_id"))
    got = merkle.proofs(m, few.unionByName(few), ("doc_id",)).withColumn("folds", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert {r.doc_id for r in got} == {5, 6, 300, 599} and len(got) == 4
    assert all(r.folds == m.root for r in got)
    there = {(r.tree, r.rank): r.leaf for r in m.leaves.collect()}
    assert all(there[r.tree, r.rank] == r.leaf for r in got)
    beyond = spark.createDataFrame([(0, 10_000), (9, 0), (0, 399)], "tree long, rank long")
    assert [(r.tree, r.rank) for r in merkle.proofs(m, beyond).collect()] == [(0, 399)]


def test_equal_subtrees_are_one_record(spark):
    rows = [(9, "same", "s", "en")] * 243
    m = merkle.manifest(docs(spark, rows), merkle.COLUMNS)
    assert m.pages[0].count() == 3 and m.pages[0].select("digest").distinct().count() == 1
    assert merkle.proofs(m, m.leaves.select("tree", "rank")).count() == 243


def test_ranges_split_a_source(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 10)
    check(spark, [(k * 31 % 1009, f"t{k}", "hot" if k % 5 else f"s{k}", "en") for k in range(400)], monkeypatch)


def test_query_equals_sql(spark):
    got = sorted(map(tuple, merkle.op11_merkle_manifest(spark, SF001).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF001}/documents.parquet'")
    assert got == sorted(con.execute(merkle.ORACLE_SQL).fetchall())
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n,height", [(0, 0), (1, 0), (2, 1), (81, 1), (82, 2), (6561, 2), (6562, 3)])
def test_heights(n, height):
    assert merkle._height(n) == height
