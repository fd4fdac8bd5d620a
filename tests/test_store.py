"""The materialised flagged-trip store: reuse, invalidation, partial writes."""

import os
import shutil

import pytest

from conftest import SF001
from cordon.plans import store


@pytest.fixture()
def sf_copy(tmp_path):
    d = tmp_path / "sf"
    d.mkdir()
    for t in ("lineitem", "orders", "pages"):
        shutil.copy(f"{SF001}/{t}.parquet", d / f"{t}.parquet")
    return str(d)


@pytest.fixture()
def root(spark, tmp_path):
    spark.conf.set("cordon.store.dir", str(tmp_path / "store"))
    yield str(tmp_path / "store")
    spark.conf.unset("cordon.store.dir")


def _tables(root):
    return sorted(n for n in os.listdir(root) if n.startswith("cordon-flagged-"))


def test_reused_within_session_and_after_reopen(spark, sf_copy, root):
    a = store.flagged_table(spark, sf_copy)
    assert store.flagged_table(spark, sf_copy) is a
    store._OPENED.clear()
    b = store.flagged_table(spark, sf_copy)
    assert b.count() == a.count() == 6000
    assert len(_tables(root)) == 1


def test_new_table_when_source_changes(spark, sf_copy, root):
    store.flagged_table(spark, sf_copy)
    path = os.path.join(sf_copy, "lineitem.parquet")
    st = os.stat(path)
    os.utime(path, ns=(st.st_atime_ns, st.st_mtime_ns + 10_000_000_000))
    a = store.flagged_table(spark, sf_copy)
    assert len(_tables(root)) == 1  # listed once a session
    store.refresh()
    assert store.flagged_table(spark, sf_copy) is not a
    assert len(_tables(root)) == 2


def _writers(root, name):
    return sorted(n for n in os.listdir(os.path.join(root, name)) if n.startswith("w-"))


def test_partial_write_is_not_reused(spark, sf_copy, root):
    store.flagged_table(spark, sf_copy)
    (name,) = _tables(root)
    (first,) = _writers(root, name)
    os.remove(os.path.join(root, name, first, "_SUCCESS"))
    store._OPENED.clear()
    df = store.flagged_table(spark, sf_copy)
    writers = _writers(root, name)
    assert len(writers) == 2  # a new writer folder; the partial one is left untouched
    assert df.count() == 6000


def test_clean_store(spark, sf_copy, root):
    store.flagged_table(spark, sf_copy)
    (name,) = _tables(root)
    os.makedirs(os.path.join(root, "cordon-flagged-old", "w-1"))
    os.makedirs(os.path.join(root, name, "w-left"))
    assert len(store.clean_store(spark)) == 2
    assert _tables(root) == [name] and len(_writers(root, name)) == 1
    assert store.flagged_table(spark, sf_copy).count() == 6000


def test_other_store_failures_are_raised(spark, sf_copy, root, monkeypatch):
    from cordon.plans import queries

    def broken(spark, sf):
        raise ConnectionError("transient")

    monkeypatch.setattr(store, "flagged_table", broken)
    with pytest.raises(ConnectionError):
        queries.QUERIES["trip_counts"](spark, sf_copy)


def test_rerun_leaves_no_old_partition(spark, tmp_path):
    from helpers import trips

    from cordon.operators.flag import flag
    out = str(tmp_path / "flagged")
    two = [dict(pickup_time="2024-03-01 10:00:00", dropoff_time="2024-03-01 10:20:00"), dict(pickup_time="2025-03-01 10:00:00", dropoff_time="2025-03-01 10:20:00")]
    store.write_flagged(flag(trips(spark, two)), out)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        store.write_flagged(flag(trips(spark, two[1:])), out)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert [r.pickup_time.year for r in spark.read.parquet(out).collect()] == [2025]


def test_year_partitions(spark, sf_copy, root):
    store.flagged_table(spark, sf_copy)
    (name,) = _tables(root)
    (w,) = _writers(root, name)
    years = sorted(n for n in os.listdir(os.path.join(root, name, w)) if n.startswith("pickup_year="))
    assert years[0] == "pickup_year=2022" and len(years) == 7


def test_second_process_view_reuses_committed_table(spark, sf_copy, root):
    a = store.flagged_table(spark, sf_copy)
    store._OPENED.clear()  # as a fresh process would start
    b = store.flagged_table(spark, sf_copy)
    (name,) = _tables(root)
    assert len(_writers(root, name)) == 1 and a.count() == b.count()


def test_parallel_callers_write_once(spark, sf_copy, root):
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(4) as pool:
        frames = list(pool.map(lambda _: store.flagged_table(spark, sf_copy), range(4)))
    (name,) = _tables(root)
    assert len(_writers(root, name)) == 1
    assert all(f is frames[0] for f in frames)


def test_store_write_shuffles_trips_only_and_sorts_nothing(spark):
    """Flags follow from a row, so they are added behind the shuffle; a sort would spill what a task holds."""
    from helpers import trips

    rows = trips(spark, [dict(pickup_time="2025-03-01 10:00:00", dropoff_time="2025-03-01 10:20:00")])
    plan = store.dealt_flagged(rows)._jdf.queryExecution().optimizedPlan().toString()
    flags, shuffled = plan.split("RebalancePartitions")
    assert "Sort" not in plan
    assert "ghost_type" in flags and "ghost_type" not in shuffled and "avg_speed_mph" not in shuffled


def test_partitioned_writes_append_to_open_files(spark, tmp_path, monkeypatch):
    """Rows keep the order they come in (a sorting write would put March and early days first), and the setting is put back."""
    from helpers import trips

    rows = trips(spark, [dict(pickup_time=f"2025-{m}-{d:02d} 10:00:00", dropoff_time=f"2025-{m}-{d:02d} 10:20:00", vendor_id=v)
                         for v, (m, d) in enumerate([("04", 9), ("03", 5), ("04", 2), ("03", 1)])]).coalesce(1)
    seen = []
    whole = store.with_partitions
    monkeypatch.setattr(store, "with_partitions", lambda t: (seen.append(spark.conf.get(store._WRITERS, "0")), whole(t))[1])
    store.write_flagged(rows, str(tmp_path / "t"))
    assert seen == [str(store.OPEN_FILES)] and spark.conf.get(store._WRITERS, "0") in (None, "0")
    april = [r.vendor_id for r in spark.read.parquet(str(tmp_path / "t" / "pickup_year=2025" / "pickup_month=4")).collect()]
    assert april == [0, 2]
