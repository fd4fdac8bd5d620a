"""The as-of join against a plain loop, time slices, validators and headers, edge rows, SQL."""

import os
import random

import duckdb
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from cordon.llm import revisits as r

SCHEMA = "id long, url string, ts long, full boolean, headers map<string,string>, digest string, length long"


@pytest.mark.parametrize("slice_rows", [4, 500])
def test_latest_before_equals_a_loop(spark, slice_rows):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(60)]), rng.random() < 0.4) for k in range(300)]
    got = {x.id: x.response_id for x in r.latest_before(spark.createDataFrame(rows, "id long, key string, ts long, full boolean"), slice_rows).collect()}
    for i, key, ts, full in rows:
        if not full and key is not None and ts is not None:
            earlier = [(t, j) for j, k, t, f in rows if f and k == key and t is not None and t < ts]
            assert got[i] == (max(earlier)[1] if earlier else None)


def test_slices_split_a_hot_key_and_a_moment(spark):
    """Ranges may cut one key, and even one second of it; the answer is that of a loop."""
    rng = random.Random(4)
    rows = [(k, "hot" if k % 3 else f"u{k % 7}", rng.choice([5, 5, 5, 6, 7, 7, 20]), rng.random() < 0.3) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, key string, ts long, full boolean")
    got = {x.id: x.response_id for x in r.latest_before(df, 5).collect()}
    for i, key, ts, full in rows:
        if not full:
            earlier = [(t, j) for j, k, t, f in rows if f and k == key and t < ts]
            assert got[i] == (max(earlier)[1] if earlier else None)
    assert len(got) == sum(not f for *_, f in rows)


def test_clashing_rows_of_one_id_have_a_defined_choice(spark):
    rows = [(1, "http://x/a", 0, True, {"etag": "1"}, "d1", 9), (2, "http://x/a", 5, False, {"etag": "1"}, None, None), (2, "http://x/a", 4, False, {"etag": "2"}, None, None),
            (2, "http://x/a", 4, False, {"etag": "1", "x": "y"}, None, None), (3, None, None, None, None, None, None), (3, "http://x/a", 9, False, {}, None, None)]
    want = None
    for k in range(4):
        got = sorted(map(str, r.resolve(spark.createDataFrame(random.Random(k).sample(rows, len(rows)), SCHEMA).repartition(3)).collect()))
        want = want or got
        assert got == want and len(got) == 2
    assert "verdict='etag'" in want[0] and "age=4" in want[0] and "verdict='missing'" in want[1]


def test_canonical_urls(spark):
    same = ["http://WWW.Example.org:80/a/?b=2&a=1&utm_source=x#top", "https://example.org/a?a=1&b=2", "  https://user@example.org:443/a/?utm_x=&b=2&a=1 "]
    other = ["https://example.org/A?a=1&b=2", "https://m.example.org/a?a=1&b=2", "", None, "https://"]
    df = spark.createDataFrame([(u,) for u in same + other], "u string").select(r.canonical(F.col("u")).alias("c"))
    got = [x.c for x in df.collect()]
    assert set(got[:3]) == {"example.org/a?a=1&b=2"}
    assert got[3:] == ["example.org/A?a=1&b=2", "m.example.org/a?a=1&b=2", None, None, None]


def test_validators_and_headers(spark):
    full = {"etag": 'W/"1"', "last-modified": "mon", "content-length": "9", "server": "a", "date": "0"}
    rows = [(1, "http://x/a", 0, True, full, "d1", 9),
            (2, "https://x/a#f", 5, False, {"etag": '"1"', "content-length": "0", "date": "5"}, None, None),
            (3, "http://x/a", 6, False, {"last-modified": "mon"}, None, None),
            (4, "http://x/a", 7, False, {"last-modified": "tue"}, None, None),
            (5, "http://x/a", 8, False, {"date": "8"}, None, None),
            (6, "http://x/b", 8, False, {"etag": '"1"'}, None, None),
            (7, None, 8, None, None, None, None),
            (8, "http://x/a", None, False, {}, None, None),
            (9, "http://x/a", 0, False, {"etag": '"1"'}, None, None),
            (2, "https://x/a#f", 5, False, {"etag": '"1"', "content-length": "0", "date": "5"}, None, None)]
    got = {x.id: x for x in r.resolve(spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("rts", F.lit(2))).collect()}
    assert {i: x.verdict for i, x in got.items()} == {2: "etag", 3: "last-modified", 4: "mismatch", 5: "unchecked", 6: "missing", 7: "missing", 8: "missing", 9: "missing"}
    assert got[2].headers == 'content-length: 9\ndate: 5\netag: "1"\nlast-modified: mon\nserver: a' and got[2].age == 5 and got[2].digest == "d1"
    assert got[4].headers is None and got[4].response_id == 1 and got[4].length is None
    assert r.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    cols = ["id", "url_key", "response_id", "age", "verdict", "headers", "digest", "length"]
    got = sorted(map(str, (tuple(x) for x in r.op7_warc_revisits(spark, SF001).select(cols).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{os.path.join(SF001, 'pages.parquet')}'")
    assert got == sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({r.ORACLE_SQL})").fetchall()))
