"""Stored steps: what they leave on disk."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from stallbook.checks import match_checks as M, run_checks as RC, state_checks as S, views as V
from stallbook.llm import components as C, group_join as G
from stallbook.operators import enrich as E, extraction as X
from stallbook.operators.state import last_wins
from stallbook.plans import runs
from stallbook.sources import tables as T
from stallbook.sources.commits import RunStore
from stallbook.sources.scratch import discard, materialise, step_settings


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _left(spark, before):
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def test_a_stored_step_leaves_no_shuffle_files(spark, tmp_path):
    rows = spark.range(5000).groupBy((F.col("id") % 701).alias("k")).count()
    before = _shuffle_files(spark)
    stored = materialise(rows, str(tmp_path / "rows"))
    assert not _left(spark, before)
    assert stored.count() == rows.count() == 701


def test_committed_tables_leave_no_shuffle_files(spark, tmp_path):
    store = RunStore(spark, str(tmp_path), {"listings": "listing_id"}, 4)
    before = _shuffle_files(spark)
    tx = store.begin()
    rows = spark.range(500).select(F.col("id").cast("string").alias("listing_id"), (F.col("id") % 7).alias("n"))
    tx.put("listings", rows)
    tx.replace("counts", rows.groupBy("n").count())
    tx.commit()
    assert not _left(spark, before)
    assert store.read("listings").count() == 500 and store.read("counts").count() == 7


def test_discarded_steps_are_gone(spark, tmp_path):
    materialise(spark.range(3), str(tmp_path / "rows"))
    discard(spark, str(tmp_path / "rows"))
    assert not os.path.exists(tmp_path / "rows")


def test_the_join_drops_its_large_steps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "shared_folder", lambda spark: str(tmp_path / "join"))
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words only"), (4, None)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in G.jaccard_join(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
    assert not os.path.exists(tmp_path / "join/heads") and not os.path.exists(tmp_path / "join/sets")


def test_few_and_many_links_have_the_same_components(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(i, i + 1) for i in range(2000, 2300)] + [(7, None), (3, 3)]
    for kind in ("long", "binary"):
        edges = spark.createDataFrame(pairs, "a long, b long").select(
            *[F.col(c) if kind == "long" else F.unhex(F.lpad(F.hex(c), 6, "0")).alias(c) for c in "ab"])
        monkeypatch.setattr(C, "FEW_LINKS", 200_000)
        few = {tuple(map(str, r)) for r in C.components(edges).collect()}
        monkeypatch.setattr(C, "FEW_LINKS", -1)
        assert few == {tuple(map(str, r)) for r in C.components(edges).collect()}
        none = edges.where("a is null")
        assert C.components(none).count() == 0
        monkeypatch.setattr(C, "FEW_LINKS", 200_000)
        assert C.components(none).count() == 0


# --- runs over small tables of their own ---------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A handful of line items and what they belong to; ids repeat."""
    folder = str(tmp_path_factory.mktemp("tables"))
    day = dt.datetime(1997, 5, 1)
    lines = [
        (i % 9, i % 4, i % 3, i % 2 + 1, 2.0, 100.0 + i, 0.01, 0.02, "ANR"[i % 3], "OF"[i % 2], day + dt.timedelta(days=i)) for i in range(40)]
    made = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": ([(i, day, f"{i % 5 + 1}-X") for i in range(9)], "o_orderkey long, o_orderdate timestamp, o_orderpriority string"),
        "part": ([(i, f"red {i}", f"Brand#{i + 10}", "VIP", 50.0 + i) for i in range(4)], "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double"),
        "supplier": ([(i, f"Supplier {i}", i) for i in range(3)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(i, f"NATION_{i}") for i in range(3)], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_derived_of_a_listing_is_not_shuffled(spark, tables):
    newest = M.unique_listings(spark, tables, lambda rows: rows.repartition(4, "listing_id"))
    dealt = _plan(newest)
    assert "market.example" in dealt and "market.example" not in dealt[dealt.index("RepartitionByExpression"):]
    # the same rows as those chosen among whole listings
    whole = last_wins(V.listings(spark, tables))
    shown = [c for c in whole.columns if c != "seq"]
    assert sorted(map(str, newest.select(*shown).collect())) == sorted(map(str, whole.select(*shown).collect()))


def test_the_archive_is_not_stored_a_second_time(spark, tables, tmp_path):
    old = S.full_history(spark, tables)
    done = runs.finish_run(old, S.batch(spark, tables), S.review(spark, tables), old.where("false"), V.part_venues(spark, tables), S.SCAN, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["listings", "review_added"]
    rows = done.archive.select("listing_id", "archived_on").collect()
    assert len(rows) == done.listings.where("event_date < '2001-11-01'").count() > 0 and {r.archived_on for r in rows} == {S.SCAN}
    assert {r.action: r.n for r in done.counts.collect()}["archived"] == len(rows)


def test_the_key_of_a_venue_is_made_once_a_row(spark, tables):
    rows = E.with_venue(V.listings(spark, tables).select("venue"), V.part_venues(spark, tables))
    search = next(line for line in _plan(rows).splitlines() if "lambdafunction(Contains(" in line)
    assert "trim" not in search[search.index("lambdafunction(Contains("):search.index("lambdafunction(struct(")]


def test_a_history_that_is_dealt_is_founded_without_a_further_shuffle(spark, tables, monkeypatch):
    placed = []
    monkeypatch.setattr(RC.committed, "found_tables", lambda *a, **k: placed.append((a[1], k.get("placed"))))
    monkeypatch.setattr(RC.committed, "committed_scan", lambda *a, **k: None)
    RC.scanned(spark, tables)
    (rows, at_once), = placed
    assert at_once and "RepartitionByExpression" in _plan(rows)


def test_an_export_can_be_compressed(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a;b"), ("2", None)], "id string, text string")
    T.write_csv(rows, str(tmp_path / "plain"))
    T.write_csv(rows, str(tmp_path / "packed"), compression="gzip")
    ends = [{f.split(".", 1)[1] for f in os.listdir(tmp_path / k) if f.startswith("part-")} for k in ("plain", "packed")]
    assert ends == [{"csv"}, {"csv.gz"}]
    assert [sorted(map(str, T.load_listings(spark, str(tmp_path / k), "csv").select("id", "text").collect())) for k in ("plain", "packed")] == [
        ["Row(id='1', text='a;b')", "Row(id='2', text=None)"]] * 2


def test_prompts_are_removed_once_they_are_answered(spark, tmp_path):
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(9)], "listing_id string, prompt string")
    found = X.ask(prompts, [("up", str.upper)], str(tmp_path / "log"), wave=4)
    assert {r.listing_id: r.raw for r in found.collect()} == {str(i): f"P{i}" for i in range(9)}
    attempt, = [d for d in os.listdir(tmp_path / "log") if d.startswith("attempt-")]
    assert {d.split("=")[0] for d in os.listdir(tmp_path / "log" / attempt)} == {"answers"}


def test_settings_of_a_step_end_with_it(spark):
    names = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.codegen.hugeMethodLimit")
    before = [spark.conf.get(n) for n in names]
    with step_settings(spark):
        assert [spark.conf.get(n) for n in names] == ["true", "8000"]
    assert [spark.conf.get(n) for n in names] == before
