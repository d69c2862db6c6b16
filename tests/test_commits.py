"""Committed runs: what readers see, which files stay, and what a run that dies leaves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stallbook.checks import state_checks as SC
from stallbook.operators import state as S
from stallbook.plans import committed
from stallbook.sources.commits import BUCKET_ROWS, RunConflict, RunStore, buckets_for

SF_DIR = "/root/testdata/sf0.001"
DAY = dt.timedelta(days=1)


@pytest.fixture()
def store(spark, tmp_path):
    made = RunStore(spark, str(tmp_path / "store"), committed.KEYED, buckets=16)
    old = SC.full_history(spark, SF_DIR)
    assert committed.found_tables(made, old, SC.review(spark, SF_DIR), old.where("false")) == 0
    return made


def files(store, name="listings"):
    return {p: p.stat().st_mtime_ns for p in __import__("pathlib").Path(f"{store.folder}/{name}").rglob("*.parquet")}


def rows(df):
    return sorted(map(str, df.collect()))


def test_small_scan_keeps_untouched_buckets(spark, store):
    few = SC.batch(spark, SF_DIR)
    few = few.where(F.col("listing_id").isin([r[0] for r in few.select("listing_id").distinct().orderBy("listing_id").limit(3).collect()]))
    venues = SC.part_venues(spark, SF_DIR)
    scan = dt.date(1992, 1, 10)  # nothing is due yet: only scanned buckets are touched
    before, versions = files(store), store.record()["tables"]["listings"]["versions"]
    assert committed.committed_scan(store, few, venues, scan) == 1
    after, now = files(store), store.record()["tables"]["listings"]["versions"]
    touched = {b for b, (a, c) in enumerate(zip(versions, now)) if a != c}
    assert 1 <= len(touched) <= 3 and before.items() <= after.items() and len(after) - len(before) == len(touched)
    whole = S.apply_scan(SC.full_history(spark, SF_DIR), few, SC.review(spark, SF_DIR), venues, scan).table
    assert rows(SC.history(store.read("listings"))) == rows(SC.history(S.conform(whole)))
    assert store.read("listings", run=0).count() == SC.full_history(spark, SF_DIR).count()


def test_listings_turn_inactive_in_buckets_without_a_scan(spark, store):
    few = SC.batch(spark, SF_DIR).limit(1)
    later = SC.SCAN + 400 * DAY
    committed.committed_scan(store, few, SC.part_venues(spark, SF_DIR), later)
    whole = S.apply_scan(SC.full_history(spark, SF_DIR), few, SC.review(spark, SF_DIR), SC.part_venues(spark, SF_DIR), later).table
    assert rows(SC.history(store.read("listings"))) == rows(SC.history(S.conform(whole)))
    assert all(d is None for b, d in enumerate(store.record()["tables"]["listings"]["waiting"])
               if b not in store.begin().touched("listings", few))


def test_stored_side_is_not_shuffled(spark, store):
    tx = store.begin()
    batch = SC.E.enrich(S.last_wins(SC.batch(spark, SF_DIR)).drop("seq"), SC.part_venues(spark, SF_DIR), SC.SCAN)
    for change in (
        S.merge_history(tx.read("listings", [1, 3]).drop("action"), batch, tx.read("review"), SC.SCAN).table,
        S.update_rows(tx.read("listings", [1, 3]), batch.select("listing_id", "city")),
    ):
        plan = change._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan
        stored = plan[: plan.index("FileScan parquet spark_catalog")].rsplit("Join", 1)[1]
        assert "Exchange" not in stored and "Bucketed: true" in plan and "_bucket" in plan


def test_run_that_dies_is_not_seen(spark, store, monkeypatch):
    before = {name: rows(store.read(name)) for name in ("listings", "review", "archive")}
    batch, venues = SC.batch(spark, SF_DIR), SC.part_venues(spark, SF_DIR)

    def dies(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(committed, "market_dashboard", dies)
        with pytest.raises(RuntimeError, match="lost"):
            committed.committed_scan(store, batch, venues, SC.SCAN)
    assert store.runs() == [0] and {name: rows(store.read(name)) for name in before} == before
    # the next attempt is not disturbed by what was left, and it can be cleared away
    assert committed.committed_scan(store, batch, venues, SC.SCAN) == 1
    whole = S.conform(SC.merged(spark, SF_DIR).table)
    assert rows(SC.history(store.read("listings"))) == rows(SC.history(whole))
    assert store.vacuum(keep=2) > 0 and {name: rows(store.read(name, run=0)) for name in before} == before
    assert store.vacuum(keep=1) > 0 and rows(SC.history(store.read("listings"))) == rows(SC.history(whole))
    assert store.vacuum(keep=1) == 0


def test_of_two_runs_one_wins(spark, store):
    first, second = store.begin(), store.begin()
    first.append("review", store.read("review").limit(1))
    second.replace("dashboard", spark.range(3).toDF("n"))
    assert first.commit() == 1
    with pytest.raises(RunConflict):
        second.commit()
    assert store.runs() == [0, 1] and "dashboard" not in store.record()["tables"]


def test_another_session_reads_what_is_committed(spark, store):
    committed.committed_scan(store, SC.batch(spark, SF_DIR).limit(2), SC.part_venues(spark, SF_DIR), SC.SCAN)
    other = RunStore(spark, store.folder, committed.KEYED, buckets=99)
    assert rows(other.read("listings")) == rows(store.read("listings"))
    assert rows(other.read("listings", run=0)) == rows(store.read("listings", run=0))
    with pytest.raises(ValueError):
        store.read("listings", run=7)


def test_keyed_table_of_another_kind(spark, tmp_path):
    """Null and blank keys, an empty table, and a change that adds and removes keys."""
    store = RunStore(spark, str(tmp_path / "keyed"), {"prices": "k"}, buckets=4)
    tx = store.begin()
    assert tx.put("prices", spark.createDataFrame([], "k STRING, v INT")).count() == 0
    tx.commit()
    tx = store.begin()
    changes = spark.createDataFrame([("a", 1), ("b", 2), ("", 3)], "k STRING, v INT")
    assert len(tx.touched("prices", spark.createDataFrame([(None,), ("",), (None,)], "k STRING"))) <= 2
    tx.update("prices", changes, lambda stored: stored.join(changes.select("k"), "k", "left_anti").unionByName(changes))
    assert store.read("prices").count() == 0 and tx.read("prices").count() == 3
    tx.commit()
    tx = store.begin()
    gone = changes.where("k = 'a'")
    tx.update("prices", gone, lambda stored: stored.join(gone.select("k"), "k", "left_anti"))
    tx.commit()
    assert rows(store.read("prices")) == rows(changes.where("k <> 'a'"))


def test_buckets_grow_with_the_table():
    assert buckets_for(0, 16) == buckets_for(16 * BUCKET_ROWS, 16) == 16
    for n in (17 * BUCKET_ROWS, 10**9):
        assert -(-n // buckets_for(n, 16)) <= BUCKET_ROWS


def test_a_bucket_of_a_large_table_holds_few_rows():
    for n in (600_000, 36_000_000, 216_000_000):
        assert n / buckets_for(n, 16) <= 50_000


def test_dealt_rows_are_founded_without_a_second_shuffle(spark, tmp_path):
    made = RunStore(spark, str(tmp_path / "store"), committed.KEYED, buckets=16)
    found = S.last_wins(made.dealt("listings", SC.listings(spark, SF_DIR)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(listing_id") == 1 and "REPARTITION_BY_NUM" in plan
    committed.found_tables(made, found, SC.review(spark, SF_DIR), S.conform(found).where("false"), placed=True)
    assert len(files(made)) == 16
    assert rows(made.read("listings").select("listing_id", "event_name")) == rows(S.last_wins(SC.listings(spark, SF_DIR)).select("listing_id", "event_name"))


def test_committed_trash_writes_the_moved_rows_once(spark, tmp_path, monkeypatch):
    made = RunStore(spark, str(tmp_path / "store"), committed.KEYED, buckets=4)
    old = S.conform(SC.listings(spark, SF_DIR).where("listing_id IN ('11', '12', '21', '22')")).withColumn(
        "event_name", F.when(F.col("listing_id") == "11", "Unbekannt").otherwise(F.col("event_name")))
    committed.found_tables(made, S.last_wins(old.withColumn("seq", F.lit(1))), SC.review(spark, SF_DIR), old.where("false"))
    paths, real = [], committed.materialise
    monkeypatch.setattr(committed, "materialise", lambda df, path: paths.append(path) or real(df, path))
    committed.committed_trash(made)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["gone"]
    kept, moved = ({r.listing_id for r in made.read(t).select("listing_id").collect()} for t in ("listings", "trash"))
    assert "11" not in kept and moved <= {"11"} and not kept & moved
