"""Edge values of merges, price history, lifecycle, matching, stores and streams."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from stallbook import config
from stallbook.operators import dashboard as B, enrich as E, extraction as X, matching as M, state as S
from stallbook.plans import runs
from stallbook.schemas import LISTING
from stallbook.sources import tables as T
from stallbook.sources.scratch import materialise
from stallbook.streaming import jobs as J

D = dt.date
DAY = D(2026, 4, 8)
BATCH = (
    "listing_id string, listing_url string, event_name string, event_date date, venue string, city string, category string, quantity int, "
    "ask_total double, is_unit_price boolean, ref_price double, ref_source string, confidence string, confidence_reason string, "
    "seller_type string, seller_name string, seq bigint"
)


def row(listing_id, total, seq=0, qty=2, ref=None, confidence="hoch"):
    return (listing_id, "u", "Linkin Park", D(2026, 6, 9), "Gasometer", None, "Stehplatz", qty, total, False, ref, None, confidence, None, "Privat", "Max", seq)


def scan(spark, table, rows, day, review=None):
    batch = spark.createDataFrame(rows, BATCH)
    queue = review if review is not None else spark.createDataFrame([], "listing_id string")
    return S.apply_scan(table, batch, queue, E.venue_dimension(spark), day)


def empty(spark):
    return spark.createDataFrame([], LISTING)


def test_review_queue_of_a_run_reads_the_stored_merge(spark, monkeypatch, tmp_path):
    plans = {}

    def stored(df, path):
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialise(df, path)

    monkeypatch.setattr(runs, "materialise", stored)
    queue = spark.createDataFrame([("b",)], "listing_id string")
    table = scan(spark, empty(spark), [row("a", 90.0), row("d", 90.0)], D(2026, 4, 1)).table
    table = table.unionByName(table)  # stored ids may repeat
    events = [row("a", 80.0, 1), row("a", 70.0, 2, confidence="niedrig"), row("b", 50.0, confidence="niedrig"), row("c", 40.0), row("e", 30.0, confidence="niedrig")]
    batch = spark.createDataFrame(events, BATCH)
    done = runs.finish_run(table, batch, queue, table.where("false"), E.venue_dimension(spark), DAY, str(tmp_path))
    assert "Window" in plans["listings"] and "Window" not in plans["review_added"]
    want = scan(spark, table, events, DAY, queue)
    got = done.review.where("listing_id <> 'b'").select(*want.review_added.columns)
    assert sorted(got.collect()) == sorted(want.review_added.collect()) and {r.listing_id for r in got.collect()} == {"a", "e"}
    assert sorted(done.listings.columns) == sorted(want.table.columns)
    assert {(r.action, r.n) for r in done.counts.collect()} >= {("inserted", 3), ("updated", 2), ("review_added", 2)}


def test_three_scans(spark):
    table = empty(spark)
    for week, total in enumerate((100.0, 90.0, 90.0)):
        table = S.conform(scan(spark, table, [row("1", total)], DAY + dt.timedelta(days=7 * week)).table)
    got = table.first()
    assert (got.scan_count, got.first_seen, got.last_seen, got.price_current, got.price_prev7, got.price_changes) == (
        3, DAY, DAY + dt.timedelta(days=14), 45.0, 50.0, 1,
    )
    assert got.venue_norm == "Gasometer Wien" and got.status == "aktiv"


def test_last_of_a_batch_wins_and_counts(spark):
    merge = scan(spark, empty(spark), [row("1", 100.0, 0), row("1", 200.0, 1, confidence="niedrig"), row(" ", 5.0, 2)], DAY)
    assert [r.ask_total for r in merge.table.collect()] == [200.0]
    assert {r.action: r.n for r in merge.counts().collect()} == {"inserted": 1, "review_added": 1}


def test_scan_never_fills_the_reference_price_but_upsert_does(spark):
    table = S.conform(scan(spark, empty(spark), [row("1", 100.0)], DAY).table)
    assert scan(spark, table, [row("1", 100.0, ref=89.9)], DAY).table.first().ref_price is None
    queue = spark.createDataFrame([], "listing_id string")
    batch = spark.createDataFrame([row("1", 100.0, 0), row("1", 50.0, 1, ref=89.9), row("1", 70.0, 2, ref=99.9)], BATCH)
    merged = S.upsert(table, batch, queue).table.first()
    assert (merged.ref_price, merged.ask_total, merged.first_seen) == (89.9, 70.0, DAY)


STATE = "price_current double, price_changed_on date, first_seen date, price_prev7 double, price_changes int, price double"


@pytest.mark.parametrize(
    "state, expected",
    [
        ((50.0, D(2026, 4, 1), None, None, 0, 45.0), (45.0, 50.0, 1, DAY)),
        ((50.0, D(2026, 4, 5), None, None, 0, 45.0), (45.0, None, 1, DAY)),
        ((60.0, None, D(2026, 4, 1), None, None, 55.0), (55.0, 60.0, 1, DAY)),
        ((50.0, D(2026, 4, 1), None, None, 0, 50.0), (50.0, None, 0, D(2026, 4, 1))),
        ((None, None, None, None, 0, 50.0), (50.0, None, 0, DAY)),
        ((50.0, D(2026, 4, 1), None, None, 0, None), (50.0, None, 0, D(2026, 4, 1))),
    ],
)
def test_price_step(spark, state, expected):
    df = spark.createDataFrame([state], STATE)
    names = ("price_current", "price_changed_on", "first_seen", "price_prev7", "price_changes", "price")
    step = S.price_step(*[F.col(n) for n in names], F.lit(DAY))
    out = df.select(*[step[k].alias(k) for k in ("price_current", "price_prev7", "price_changes", "price_changed_on")]).first()
    assert tuple(out) == expected


def test_inactive(spark):
    rows = [("a", "aktiv", D(2026, 4, 1)), ("b", "aktiv", D(2026, 4, 16)), ("c", "verkauft", D(2026, 1, 1)), ("d", "inaktiv", D(2026, 1, 1))]
    df = spark.createDataFrame(rows, "listing_id string, status string, last_seen date")
    now = spark.createDataFrame([("d",), ("d",)], "listing_id string")
    got = {r.listing_id: r.status for r in S.mark_inactive(df, now, D(2026, 4, 22)).collect()}
    assert got == {"a": "inaktiv", "b": "aktiv", "c": "verkauft", "d": "aktiv"}


def test_archive_bounds(spark):
    as_of = D(2026, 5, 1)
    rows = [(str(n), as_of - dt.timedelta(days=n)) for n in (31, 30, 29, 8, 6, 1, -1)]
    df = spark.createDataFrame(rows, "listing_id string, event_date date")
    none = df.where("false")
    ids = lambda days: sorted(r.listing_id for r in S.archive_additions(df, none, as_of, days).collect())
    assert ids(30) == ["31"] and ids(7) == ["29", "30", "31", "8"]
    assert "1" in ids(0) and "-1" not in ids(0)
    assert S.archive_additions(df, df.where("listing_id = '31'"), as_of).count() == 0


def test_days_at_once_equal_day_after_day(spark):
    rng = random.Random(7)
    days = [DAY + dt.timedelta(days=3 * i) for i in range(12)]
    per_day = {d: [row(str(k), float(rng.choice((80, 90, 100))), i) for i, k in enumerate(rng.sample(range(6), 3))] for d in days}
    one = empty(spark)
    for d in days:
        one = spark.createDataFrame(S.conform(scan(spark, one, per_day[d], d).table).collect(), LISTING)
    rows = [(*r, d) for d in days for r in per_day[d]]
    scans = spark.createDataFrame(rows, BATCH + ", scan_date date")
    queue = spark.createDataFrame([], "listing_id string")
    # the second half merges into the result of the first
    first = S.merge_scans(empty(spark), scans.where(F.col("scan_date") <= F.lit(days[5])), queue, E.venue_dimension(spark), days[5])
    second = S.merge_scans(
        S.conform(first.table), scans.where(F.col("scan_date") > F.lit(days[5])), queue, E.venue_dimension(spark), days[-1]
    )
    assert sorted(S.conform(second.table).collect()) == sorted(one.collect())


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("listing_id"), F.col("id").alias("seq"))
    plan = S.last_wins(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# --- dashboard ------------------------------------------------------------------------------


def listing(seller, unit, **more):
    base = {"event_name": "Linkin Park", "event_date": D(2026, 6, 9), "category": "Stehplatz", "seller_type": seller, "ask_unit": unit, "ref_price": 89.9}
    return {**base, **more}


def board(spark, rows, ddl=""):
    schema = "event_name string, event_date date, category string, seller_type string, ask_unit double, ref_price double" + ddl + ", seq int"
    names = [f.split()[0] for f in schema.split(", ")]
    data = [tuple({**r, "seq": i}.get(n) for n in names) for i, r in enumerate(rows)]
    return B.market_dashboard(spark.createDataFrame(data, schema), D(2026, 4, 18)).collect()


def test_dashboard_group(spark):
    (got,) = board(spark, [listing("Händler", 250.0), listing("Händler", 300.0), listing("Privat", 150.0, event_name=" linkin  PARK")])
    assert (got.dealer_count, got.dealer_min, got.dealer_avg, got.dealer_max) == (2, 250.0, 275.0, 300.0)
    assert (got.private_count, got.private_min, got.private_avg, got.private_max) == (1, 150.0, 150.0, 150.0)
    assert got.dealer_margin_pct == pytest.approx((89.9 - 275) / 89.9 * 100) and got.dealer_margin_abs == 185.1
    assert got.ref_status == "nur extrahiert ⚠" and got.event_name == "Linkin Park"


def test_dashboard_verification_and_manual_price(spark):
    ddl = ", verif_status string, verif_sources array<string>, ref_price_manual double"
    rows = [
        listing(None, 10.0, verif_status="verifiziert", verif_sources=["bandsintown", "musicbrainz"], ref_price=100.0, ref_price_manual=80.0),
        listing(None, float("nan"), verif_status="verifiziert", verif_sources=["bandsintown"], ref_price=100.0),
        listing(None, None, verif_status="nicht_verifiziert", ref_price=100.0),
    ]
    (got,) = board(spark, rows, ddl)
    assert (got.verif_status_mode, got.verif_confirmed_pct, got.verif_top_source) == ("verifiziert", 66.7, "bandsintown")
    assert (got.ref_price, got.ref_status, got.private_count) == (80.0, "manuell gepflegt ✓", 1)


def test_junk_rows(spark):
    good = ("X", D(2026, 6, 9), 1.0)
    rows = [("unbekannt", *good[1:]), ("None", *good[1:]), (None, *good[1:]), (" ", *good[1:]), (good[0], None, 1.0), (*good[:2], 0.0), (*good[:2], -1.0), (*good[:2], None), good]
    df = spark.createDataFrame(rows, "event_name string, event_date date, ask_total double")
    assert B.drop_junk(df).count() == 1
    assert B.drop_junk(df.drop("ask_total")).count() == 4


def test_medians_of_small_and_even_groups(spark):
    rows = [listing("Privat", 1.0, ref_price=v) for v in (1.0, 2.0, 2.0, 9.0)] + [listing("Privat", 1.0, category="VIP", ref_price=v) for v in (5.0, 1.0)]
    assert sorted(r.ref_price for r in board(spark, rows)) == [2.0, 3.0]


# --- matching and store ------------------------------------------------------------------------


def brute_force(queries, candidates):
    """Best candidate of every query by comparing all pairs."""
    best = {}
    for (qid, name, day, city), (cname, cday, ccity, seq) in itertools.product(queries, candidates):
        a, b = set(name.lower().split()), set(cname.lower().split())
        ns = len(a & b) / len(a | b)
        if ns < 0.3:
            continue
        gap = abs((day - cday).days) if day and cday else 99
        ds = 1.0 if gap == 0 else 0.5 if gap <= 7 else 0.0
        x, y = (city or "").lower(), (ccity or "").lower()
        cs = 0.0 if not x or not y else 1.0 if x == y else 0.5 if x in y or y in x else 0.0
        key = (-round(ns * 0.5 + ds * 0.3 + cs * 0.2, 4), seq)
        best[qid] = min(best.get(qid, key), key)
    return {q: (-t, s) for q, (t, s) in best.items()}


@pytest.mark.parametrize("rare, words_of_class", [(64, 6), (20, 6), (20, 2), (3, 1)])
def test_blocked_match_equals_all_pairs(spark, monkeypatch, rare, words_of_class):
    monkeypatch.setattr(M, "RARE_NAMES", rare)
    monkeypatch.setattr(M, "CLASS_WORDS", words_of_class)
    rng = random.Random(3)
    words = ["live", "wien", "tour", "rock", "jazz", "open", "air", "nacht", "fest", "pop"]
    weights = [9, 8, 5, 2, 2, 1, 1, 1, 1, 1]  # a few words are in most names

    def name():
        return " ".join(dict.fromkeys(rng.choices(words, weights, k=rng.randint(1, 6))))

    def day():
        return rng.choice([None, D(2026, 6, 1) + dt.timedelta(days=rng.randint(0, 20))])

    def city():
        return rng.choice([None, "Wien", "Wien Mitte", "Graz", "Linz"])

    queries = [(str(i), name(), day(), city()) for i in range(120)]
    candidates = [(name(), day(), city(), i) for i in range(150)]
    q = spark.createDataFrame(queries, "query_id string, event_name string, event_date date, city string")
    c = spark.createDataFrame(candidates, "event_name string, event_date date, city string, cand_seq int")
    got = {r.query_id: (r.total, r.cand_seq) for r in M.best_matches(q, c).collect()}
    assert got == brute_force(queries, candidates)


@pytest.mark.parametrize("n", [500, 2000])
def test_names_of_one_pattern_make_rows_in_proportion(spark, n):
    """Two words that all names share: names meet as classes, and on the words that few of them have."""
    names = spark.range(n).select(F.concat(F.lit("live tour a"), F.col("id").cast("string")).alias("key"))
    names = names.withColumn("tokens", F.split("key", " "))
    frequency = names.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    split = M.split_words(names, frequency)
    pairs = M.bounded_pairs(split, split, 0.3)
    assert pairs.where("right_key NOT LIKE '\u0001%'").count() == n
    assert pairs.count() == n * (1 + 2 * 1 + 4) and M.class_keys(split, 0.3).count() == n * 4
    # every name is its own best match, and no date is probed more than three times a city
    q = names.select(F.col("key").alias("query_id"), F.col("key").alias("event_name"), F.lit(DAY).alias("event_date"), F.lit("Wien").alias("city"))
    c = names.select(F.col("key").alias("event_name"), F.date_add(F.lit(DAY), F.length("key") % 9).alias("event_date"), F.lit("Wien").alias("city"),
                     F.substring("key", 12, 9).cast("int").alias("cand_seq"))
    best = M.best_matches(q, c)
    assert best.where("query_id = cand_name").count() == n


def status_of(spark, confirmed, answered=("musicbrainz", "wikidata", "bandsintown"), name="A", total=0.8):
    q = spark.createDataFrame([("1", name)], "query_id string, event_name string")
    a = spark.createDataFrame([("1", s) for s in answered], "query_id string, source string")
    ddl = "query_id string, source string, cand_name string, cand_seq int, name_score double, date_score double, city_score double, total double"
    m = spark.createDataFrame([("1", s, "A", 0, 1.0, 1.0, 1.0, total) for s in confirmed], ddl)
    return M.verification_status(q, a, m, DAY).first()


def test_status(spark):
    assert status_of(spark, ["bandsintown", "wikidata"]).status == config.VERIFIED
    assert status_of(spark, ["bandsintown", "wikidata"], total=0.55).status == config.LIKELY
    assert status_of(spark, ["wikidata", "musicbrainz"]).sources_confirmed == ["musicbrainz", "wikidata"]
    assert status_of(spark, ["wikidata"]).status == config.LIKELY
    assert status_of(spark, ["wikidata"], total=0.4).status == config.UNVERIFIED
    assert status_of(spark, [], answered=()).status == config.FAILED
    assert status_of(spark, [], name=" ").status == config.SKIPPED


STORE = (
    "name_key string, event_date date, status string, best struct<name:string,name_score:double,date_score:double,city_score:double,total:double,source:string>, "
    "sources_checked array<string>, sources_confirmed array<string>, cached_on date"
)


def test_store_lifetime(spark):
    store = spark.createDataFrame([("taylor swift", None, "verifiziert", None, [], [], DAY - dt.timedelta(days=1))], STORE)
    q = spark.createDataFrame([("Taylor Swift ", None)], "event_name string, event_date date")
    hit = lambda ttl: M.store_get(q, store, DAY, ttl).first().hit
    assert hit(0) is None and hit(1).status == "verifiziert"
    new = spark.createDataFrame([("taylor swift", None, s, None, [], [], i) for i, s in enumerate(("a", "b"))], STORE.replace("cached_on date", "seq int"))
    assert [(r.status, r.cached_on) for r in M.store_put(store, new, DAY).collect()] == [("b", DAY)]
    assert M.store_invalidate(store, q).count() == 0
    old = spark.createDataFrame([(k, None, "x", None, [], [], DAY - dt.timedelta(days=10)) for k in "ab"], STORE)
    assert M.store_purge(old.union(store), DAY)[1].first().purged == 2


# --- streams ----------------------------------------------------------------------------------------


def price_stream(spark, base, batches):
    for rows in batches:
        df = spark.createDataFrame(rows, "listing_id string, d string, ask_unit double, seq bigint")
        df = df.select("listing_id", F.to_timestamp("d").alias("scan_ts"), "ask_unit", "seq")
        df.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
        J.start(stream, f"{base}/checkpoint", each=J.track_prices(spark, f"{base}/out")).awaitTermination()
    return {(r.listing_id, r.scan_count, r.status, r.price_prev7) for r in J.tracked_prices(spark, f"{base}/out").collect()}


def test_inactivity(spark, tmp_path):
    batches = [[("a", "2024-01-01", 10.0, 1), ("b", "2024-01-01", 10.0, 2)], [("b", "2024-01-30", 12.0, 3)]]
    assert price_stream(spark, tmp_path, batches) == {("a", 1, "inaktiv", None), ("b", 2, "aktiv", 10.0)}


def test_stream_keeps_late_and_returning_listings(spark, tmp_path):
    batches = [
        [("a", "2024-01-10", 5.0, 1), ("c", "2024-01-10 08:00:00", 7.0, 2)],
        [("b", "2024-01-09", 9.0, 3), ("c", "2024-01-10 20:00:00", 8.0, 4)],  # late; a day in two parts
        [("a", "2024-03-11", 6.0, 5)],  # after the grace period
    ]
    assert price_stream(spark, tmp_path, batches) == {("a", 2, "aktiv", 5.0), ("b", 1, "inaktiv", None), ("c", 1, "inaktiv", None)}


def test_missing_snapshot_is_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError):
        J.version_before(spark, str(tmp_path), 7)
    assert J.version_before(spark, str(tmp_path), 0) is None
    for v in (0, 5):
        spark.range(1).write.parquet(J.snapshot_path(str(tmp_path), v))
    assert J.version_before(spark, str(tmp_path), 7) == 5
    with pytest.raises(RuntimeError):  # a new checkpoint on an old folder
        J.version_before(spark, str(tmp_path), 0)


def test_late_day_does_not_set_back(spark):
    queue = spark.createDataFrame([], "listing_id string")
    scans = lambda total, day: spark.createDataFrame([(*row("a", total), day)], BATCH + ", scan_date date")
    late = DAY - dt.timedelta(days=8)
    first = S.conform(S.merge_scans(empty(spark), scans(100.0, DAY), queue, E.venue_dimension(spark), DAY).table)
    got = S.merge_scans(first, scans(60.0, late), queue, E.venue_dimension(spark), DAY).table.first()
    assert (got.last_seen, got.ask_total, got.price_current, got.scan_count) == (DAY, 100.0, 50.0, 1)


def test_one_call_per_advert(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(prompt):
        calls.add(1)
        return '{"events":[{"event_name":"A","city":"","ask_total":10}]}'

    cols = "listing_id listing_url title price_raw body seller_type seller_id seller_name member_since".split()
    ads = [(str(i), "u", "Konzert Tickets", "10", "Konzert", "Privat", "s", "n", "") for i in (1, 2, 3, 4, 1, 2)]
    df = spark.createDataFrame(ads, cols).withColumns(
        {"posted_on": F.lit(None).cast("date"), "scraped_at": F.lit("2024-01-01").cast("timestamp")})
    fields = X.finish_events(X.answered_events(X.run_extractors(df.withColumn("prompt", F.col("title")), [("m", model)]), [("m", model)], DAY), df, E.venue_dimension(spark)).drop("listing_id").schema
    order = sorted(fields, key=lambda f: f.name != "event_no")
    ddl = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in order)
    store = spark.createDataFrame([], f"listing_id STRING, events ARRAY<STRUCT<{ddl}>>")
    events, entries = X.parse_incremental(df, store, [("m", model)], E.venue_dimension(spark), DAY, str(tmp_path))
    assert events.count() == 4 and entries.count() == 4 and events.count() == 4
    assert calls.value == 4


def test_missing_table_is_empty(spark):
    df = T.load_listings(spark, "/nonexistent/table")
    assert df.count() == 0 and "ask_unit" in df.columns
