"""Work that goes on after a failure, spreads evenly, or does not grow with what is stored."""

import datetime as dt
import os
import threading
import time

import pytest
from pyspark.sql import Window as W, functions as F

from stallbook.operators import enrich as E, extraction as X
from stallbook.operators.windows import equal_parts
from stallbook.sources.tables import stored_versions
from stallbook.streaming import jobs as J


def Model(path, dies_at=None, lists=False, fails=()):  # noqa: N802
    """A model that counts its calls in a file; it ends its process at a prompt, if it is told to."""

    class Counting:  # a class within a function reaches the workers by value
        def __call__(self, prompt):
            if prompt == dies_at:
                os._exit(1)
            with open(where, "a") as f:
                f.write(prompt + "\n")
            if prompt in fails:
                raise ValueError(prompt)
            return prompt.upper()

    class InLists(Counting):
        def many(self, prompts):
            if set(prompts) & set(fails):
                raise ValueError("list")
            with open(where, "a") as f:
                f.write(f"[{len(prompts)}]\n")
            return [p.upper() for p in prompts]

    where = str(path)
    return InLists() if lists else Counting()


def lines(path):
    return open(path).read().split()


def test_a_run_goes_on_where_it_died(spark, tmp_path):
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(200)], "listing_id string, prompt string").repartition(4)
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    late = prompts.where("pmod(xxhash64(listing_id), 10) = 6").first().prompt
    with pytest.raises(Exception):
        X.ask(prompts, [("m", Model(calls, dies_at=late))], log, wave=20)
    before = len(lines(calls))
    committed = {r.listing_id for r in spark.read.parquet(*X.committed_parts(spark, log)).collect()}
    assert len(committed) > 80
    rows = X.ask(prompts, [("m", Model(calls))], log, wave=20).collect()
    assert {r.listing_id: r.raw for r in rows} == {str(i): f"P{i}" for i in range(200)}
    asked = lines(calls)
    # what was committed was not asked again; only the wave that died was asked in part twice
    assert len(asked) - before == 200 - len(committed) and len(asked) <= 200 + 60
    assert X.ask(prompts, [("m", Model(calls))], log, wave=20).count() == 200 and len(lines(calls)) == len(asked)
    changed = prompts.withColumn("prompt", F.when(F.col("listing_id") == "5", "other").otherwise(F.col("prompt")))
    again = {r.listing_id: r.raw for r in X.ask(changed, [("m", Model(calls))], log).collect()}
    assert again["5"] == "OTHER" and len(again) == 200 and len(lines(calls)) == len(asked) + 1


def test_lists_of_prompts(spark, tmp_path):
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(50)], "listing_id string, prompt string").coalesce(1)
    calls = tmp_path / "calls"
    rows = X.run_extractors(prompts, [("m", Model(calls, lists=True, fails=["p3"])), ("n", Model(tmp_path / "second"))], batch=10).collect()
    got = {r.listing_id: r for r in rows}
    assert all(got[str(i)].raw == f"P{i}" for i in range(50)) and sorted(lines(calls)) == sorted(["[10]"] * 4 + ["[1]"] * 9)
    assert got["3"].model == "n" and got["3"].fallback_used and "ValueError" in got["3"].error and lines(tmp_path / "second") == ["p3"]
    assert X.ask(prompts.limit(0), [("m", Model(calls))], str(tmp_path / "none")).count() == 0


def test_two_prompts_of_one_listing(spark, tmp_path):
    prompts = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "listing_id string, prompt string")
    rows = X.ask(prompts, [("m", Model(tmp_path / "calls"))], str(tmp_path / "log")).collect()
    assert sorted((r.listing_id, r.raw) for r in rows) == [("1", "A"), ("1", "B"), ("2", "A")]


@pytest.mark.parametrize("burst", [0.0, 0.9])
def test_parts_are_even_in_a_burst(spark, burst):
    """Nine rows of ten within one second of a year."""
    n = 20_000
    second = F.when(F.col("id") < int(n * burst), F.col("id") / n).otherwise(F.col("id") * 1500.0)
    rows = spark.range(n).select(F.lit("r").alias("run"), (F.lit(1.7e9) + second).cast("timestamp").alias("seq"))
    parts = equal_parts(rows, "seq", 500)
    sizes = [r["count"] for r in parts.groupBy("_chunk").count().collect()]
    assert len(sizes) >= 35 and max(sizes) <= 1000
    ordered = parts.withColumn("before", F.lag("_chunk").over(W.orderBy("seq")))
    assert ordered.where("before > _chunk").count() == 0
    assert equal_parts(rows.limit(0), "seq", 500).count() == 0
    assert [r._chunk for r in equal_parts(spark.createDataFrame([(None,), (3,)], "seq int"), "seq", 1).orderBy("seq").collect()][0] == -1


def test_panes_of_activity(spark, tmp_path):
    """Late and repeated batches; an id seen twice in a week counts once a day."""
    day = dt.datetime(2026, 6, 1, 12)
    folder = str(tmp_path / "panes")
    each = J.store_activity(spark, folder)
    schema = "event_name string, listing_id string, seen_ts timestamp"
    batches = [
        [("X ", "1", day), ("x", "1", day), ("x", "2", day), ("y", None, day), ("y", "9", None)],
        [("x", "1", day + dt.timedelta(days=3)), ("x", "3", day + dt.timedelta(days=20))],
        [("x", "4", day - dt.timedelta(days=2))],
    ]
    for i, rows in enumerate([*batches, batches[2]]):
        each(spark.createDataFrame(rows, schema), min(i, 2))
    assert stored_versions(spark, folder) == [0, 1, 2]
    got = {(r.event_key, r.until): r.active for r in J.active_counts(spark, folder, dt.date(2026, 5, 25), dt.date(2026, 6, 30)).collect()}
    want = {}
    seen = {("x", i, (d if isinstance(d, dt.date) and not isinstance(d, dt.datetime) else d.date())) for rows in batches for e, i, d in rows if i and d for e in [e.strip().lower()]}
    for k in range(37):
        until = dt.date(2026, 5, 25) + dt.timedelta(days=k)
        n = len({i for _, i, d in seen if 1 <= (until - d).days <= 7})
        if n:
            want["x", until] = n
    assert got == want
    part = J.active_counts(spark, folder, dt.date(2026, 6, 4), dt.date(2026, 6, 6))
    assert {(r.event_key, r.until): r.active for r in part.collect()} == {k: v for k, v in want.items() if dt.date(2026, 6, 4) <= k[1] <= dt.date(2026, 6, 6)}
    # panes of other days are not read
    assert part._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [isnotnull(day") >= 1


@pytest.mark.parametrize("most", [2000, 0])
def test_venues_within_the_row(spark, monkeypatch, most):
    monkeypatch.setattr(E, "INLINE_LABELS", most)
    names = [("happel stadion",), ("Ernst Happel Wien",), (" GASOMETER ",), ("Unbekannte Halle Linz",), (None,), ("",)]
    rows = E.with_venue(spark.createDataFrame(names, "venue string"), E.venue_dimension(spark), with_city=True)
    got = {r.venue: (r.venue_norm, r.venue_type, r.city) for r in rows.collect()}
    assert got[None] == got[""] == (None, None, None) and got["Unbekannte Halle Linz"][0] == "Unbekannte Halle Linz"
    assert got["happel stadion"][0] == got["Ernst Happel Wien"][0] != "happel stadion" and got[" GASOMETER "][0] == "Gasometer Wien"


def test_enrich_reads_its_input_once(spark):
    from stallbook.checks import state_checks as SC

    rows = SC.batch(spark, "/root/testdata/sf0.001")
    plan = E.enrich(rows, SC.part_venues(spark, "/root/testdata/sf0.001"), SC.SCAN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_price_stream_reads_stored_days_of_late_listings_only(spark, tmp_path, monkeypatch):
    """Twenty days in order leave the stored days unread, and touch the buckets of their listings only; a late one reads them."""
    folder = str(tmp_path / "prices")
    each = J.track_prices(spark, folder, buckets=8)
    scans = lambda rows: spark.createDataFrame(rows, "listing_id string, scan_ts timestamp, ask_unit double, seq long")
    start = dt.datetime(2024, 1, 1, 9)
    read, seen, written = J.Run.read, [], []
    monkeypatch.setattr(J.Run, "read", lambda self, name, *a: seen.append(name) or read(self, name, *a))
    for k in range(20):
        day = start + dt.timedelta(days=k)
        each(scans([("a", day, 10.0 + k // 9, 2 * k), (f"x{k}", day, 5.0, 2 * k + 1)]), k)
        written.append(len([v for v in J.RunStore(spark, folder).record()["tables"]["prices"]["versions"] if v >= k * 10**9]))
    assert "days" not in seen and max(written[1:]) <= 2
    each(scans([("a", start + dt.timedelta(days=19), 12.0, 39)]), 19 + 1)  # the last day in a second part
    assert seen.count("days") == 1
    with pytest.raises(RuntimeError):
        each(scans([("b", start, 1.0, 1)]), 3)
    with pytest.raises(RuntimeError):
        each(scans([("b", start, 1.0, 1)]), 20)
    each(scans([("a", start + dt.timedelta(days=19), 12.0, 39)]), 20)  # repeated
    got = {r.listing_id: r for r in J.tracked_prices(spark, folder).collect()}
    a = got["a"]
    assert len(got) == 21 and (a.scan_count, a.price_changes, a.price_current, a.price_prev7) == (20, 2, 12.0, 11.0)
    stored = J.RunStore(spark, folder).read("days")
    from stallbook.operators.state import fold_prices

    whole = {r.listing_id: r for r in fold_prices(stored.withColumn("o", F.struct("seq", "batch")), seq="o").collect()}
    assert all(got[i].asDict().items() >= whole[i].asDict().items() for i in whole) and len(whole) == 21


def test_waves_do_not_grow_with_the_prompts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "WAVES", 3)
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(60)], "listing_id string, prompt string")
    calls, log = tmp_path / "calls", tmp_path / "log"
    rows = X.ask(prompts, [("m", Model(calls))], str(log), wave=5).collect()
    assert {r.listing_id: r.raw for r in rows} == {str(i): f"P{i}" for i in range(60)} and len(lines(calls)) == 60
    assert len(list(log.glob("attempt-*/answers=*"))) == 3


def test_adverts_are_put_together_once(spark, tmp_path, monkeypatch):
    from stallbook.operators import enrich as E

    ad = ("1", "http://x", "Konzert Tickets", "€ 5", "Verkaufe 2 Tickets für Konzert", "Privat", "A", "S1", "", None, None)
    ads = spark.createDataFrame([ad], "listing_id string, listing_url string, title string, price_raw string, body string, seller_type string, "
                                "seller_name string, seller_id string, member_since string, posted_on date, scraped_at timestamp")
    asked = []
    real = X.ask
    monkeypatch.setattr(X, "ask", lambda prompts, *a, **k: asked.append(prompts.inputFiles()) or real(prompts, *a, **k))
    model = [("m", lambda prompt: '{"events":[{"event_name":"A"}]}')]
    X.parse_new(ads, model, E.venue_dimension(spark), dt.date(2026, 1, 1), str(tmp_path)).collect()
    assert asked and asked[0] and all("/prompts/" in f for f in asked[0])


def test_a_thread_takes_several_calls_at_once(spark):
    def model(prompt):
        time.sleep(0.001)
        return f"{prompt} {threading.get_ident()}"

    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(1000)], "listing_id string, prompt string").coalesce(1)
    rows = X.run_extractors(prompts, [("m", model)], threads=4).collect()
    assert [r.raw.split()[0] for r in rows] == [f"p{i}" for i in range(1000)] and [r.listing_id for r in rows] == [str(i) for i in range(1000)]
    by = [r.raw.split()[1] for r in rows]
    assert len(set(by)) == 4 and sum(a != b for a, b in zip(by, by[1:])) < 50
