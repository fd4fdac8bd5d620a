"""Connected components of an edge table: labels, odd rows, and how often the edges are found."""

import pyarrow as pa

from cordon.llm.components import components


def test_labels_and_odd_edges(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 4), (9, 9), (8, None), (None, None), (20, 10), (10, 30)], "a long, b long")
    got = {r.v: r.c for r in components(edges).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 9, 10: 10, 20: 10, 30: 10}
    assert components(edges.limit(0)).count() == 0


def test_edges_are_found_once(spark):
    """Both directions come from one run of what finds the edges; a union would plan and run it twice."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"])

    edges = spark.range(0, 100, 1, 4).selectExpr("id AS a", "id + 1 AS b").mapInArrow(run, "a long, b long")
    assert {r.c for r in components(edges).collect()} == {0} and seen.value == 100


def test_a_round_is_one_query(spark, monkeypatch):
    """What a round changed is counted while its labels are written; no query reads them for that."""
    def no(*a, **k):
        raise AssertionError("a second query of a round")
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 40)], "a long, b long")
    for name in ("count", "collect", "first", "isEmpty"):
        monkeypatch.setattr(type(edges), name, no)
    assert {(r.v, r.c) for r in components(edges).toLocalIterator()} == {(k, 0) for k in range(21)} | {(40, 40), (50, 40)}
    assert not list(components(edges.where("a < 0")).toLocalIterator())
