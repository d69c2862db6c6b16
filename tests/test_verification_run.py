"""Verification of listings whose names have many equal responses."""

import datetime as dt

import pytest

from stallbook import config
from stallbook.checks.match_checks import BEST_TYPE
from stallbook.plans import committed, runs

DAY = dt.date(2024, 5, 1)
LISTING = "listing_id string, event_name string, event_date date, city string, verif_status string, verif_sources array<string>, verif_on date, verif_name string, verif_score double, seq int"
CANDIDATE = "query_name string, source string, event_name string, event_date date, city string, cand_seq long"


@pytest.fixture
def offered(monkeypatch):
    """Numbers of candidate rows that were compared."""
    seen = []
    match = runs.match_own_candidates

    def counted(queries, candidates, *args, **kwargs):
        seen.append(candidates.count())
        return match(queries, candidates, *args, **kwargs)

    monkeypatch.setattr(runs, "match_own_candidates", counted)
    return seen


def verified(spark, tmp_path, names):
    days = [DAY, DAY + dt.timedelta(days=3), DAY + dt.timedelta(days=60)]
    rows = [(f"{n}-{i}", n, d, "Wien", *[None] * 5, i) for n in names for i, d in enumerate(days)]
    listings = spark.createDataFrame(rows, LISTING)
    store = spark.createDataFrame([], f"name_key string, event_date date, status string, best {BEST_TYPE}, sources_checked array<string>, sources_confirmed array<string>, cached_on date")
    found = [(n.lower(), s, n, DAY, "Wien", i) for n in names for s in ("bandsintown", "wikidata") for i in range(40)]
    candidates = spark.createDataFrame(found, CANDIDATE)
    answered = candidates.select("query_name", "source").distinct()
    return runs.verify_listings(listings, store, candidates, answered, DAY, str(tmp_path))


def test_equal_candidates_are_compared_once(spark, tmp_path, offered):
    done = verified(spark, tmp_path, ["Bolt", "Red Wall"])
    # two names with three dates and two sources; 40 copies each would be 480
    assert offered == [12]
    got = {r.listing_id: (r.verif_status, r.verif_score) for r in done.listings.collect()}
    for name in ("Bolt", "Red Wall"):
        assert got[f"{name}-0"] == (config.VERIFIED, 1.0)
        assert got[f"{name}-1"][1] == 0.85 and got[f"{name}-2"][1] == 0.7
    counts = {r.action: r.n for r in done.counts.collect()}
    assert counts["total"] == 6 and counts["cached"] == 0


def test_counters_of_no_listings(spark, tmp_path):
    assert {r.action: r.n for r in verified(spark, tmp_path, []).counts.collect()} == {"total": 0, "cached": 0}


def test_write_back_columns_are_enough(spark, tmp_path):
    done = verified(spark, tmp_path, ["Bolt"])
    narrow = done.results.select("listing_id", "status", "sources_confirmed", "verif_on", "best")
    assert sorted(map(str, committed.write_back(done.listings, narrow).collect())) == sorted(map(str, done.listings.collect()))
