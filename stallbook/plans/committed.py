"""Runs over committed tables: one scan, one verification, each visible as a whole or not at all."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from stallbook import config
from stallbook.operators.dashboard import market_dashboard
from stallbook.operators.enrich import enrich
from stallbook.operators.matching import normalise_responses, unverified, write_back
from stallbook.operators.state import (
    archive_additions, conform, last_wins, merge_history, review_additions, split_trash,
)
from stallbook.plans.runs import Verification, verify_listings
from stallbook.schemas import REVIEW_COLUMNS
from stallbook.sources.commits import Run, RunStore, bucket_of
from stallbook.sources.scratch import materialise, shared_folder

#: tables of a store of listings; those with a key are kept in buckets
KEYED = {"listings": "listing_id"}


def _with_deadlines(tx: Run, rows: DataFrame, buckets: list[int]) -> None:
    """Notes for each bucket the day on which its oldest active listing was seen last."""
    key, n = "listing_id", len(tx.tables["listings"]["versions"])
    waiting = rows.where(~F.coalesce(F.col("status").isin(config.SOLD, config.INACTIVE), F.lit(False)))
    oldest = {r[0]: str(r[1]) for r in waiting.groupBy(bucket_of(key, n)).agg(F.min("last_seen")).collect() if r[1]}
    days = tx.tables["listings"].get("waiting") or [None] * n
    tx.note("listings", waiting=[oldest.get(b) if b in set(buckets) else d for b, d in enumerate(days)])


def _due(tx: Run, scan_date: dt.date, grace_days: int) -> list[int]:
    """Buckets in which a listing may turn inactive on that day although none of them was seen."""
    limit = str(scan_date - dt.timedelta(days=grace_days))
    return [b for b, day in enumerate(tx.tables["listings"]["waiting"]) if day is not None and day <= limit]


def found_tables(
    store: RunStore, listings: DataFrame, review: DataFrame, archive: DataFrame, results: DataFrame | None = None, placed: bool = False
) -> int:
    """First run of a store: the tables as they are, listings dealt into buckets by id unless they are ``placed`` there."""
    tx = store.begin()
    rows = tx.put("listings", conform(listings).withColumn("action", F.lit("kept")), placed=placed)
    _with_deadlines(tx, rows, list(range(store.buckets)))
    tx.replace("review", review.select(*[F.col(c).cast("string") for c in REVIEW_COLUMNS]))
    tx.replace("archive", conform(archive))
    tx.replace("trash", conform(listings.limit(0)))
    if results is not None:
        tx.replace("results", results)
    return tx.commit()


def committed_scan(
    store: RunStore, events: DataFrame, venues: DataFrame, scan_date: dt.date, seq: str = "seq",
    grace_days: int = config.INACTIVE_GRACE_DAYS,
) -> int:
    """One scan into the committed tables: history, review queue, archive, dashboard and counters.

    The result is that of ``finish_run`` over whole tables. Only the buckets that hold a scanned id, or a
    listing that turns inactive on that day, are read and written for the merge; all others keep
    their files. Returns the number of the run.
    """
    tx = store.begin()
    folder = shared_folder(store.spark)
    batch = materialise(enrich(last_wins(events, seq=seq).drop(seq), venues, scan_date), folder + "/batch")
    due = _due(tx, scan_date, grace_days)
    buckets = sorted({*tx.touched("listings", batch), *due})

    def merged(stored: DataFrame) -> DataFrame:
        return merge_history(stored.drop("action"), batch, tx.read("review"), scan_date, grace_days=grace_days).rows

    rows = tx.update("listings", batch, merged, due)
    _with_deadlines(tx, rows, buckets)
    added = tx.append("review", review_additions(batch, tx.read("review")))
    table = tx.read("listings").drop("action")
    old = tx.append("archive", archive_additions(table, tx.read("archive"), scan_date))
    tx.replace("dashboard", market_dashboard(table, scan_date, seq="listing_id"))
    actions = rows.where("action <> 'kept'").groupBy("action").agg(F.count("*").alias("n"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("action"), "n") for df, name in ((added, "review_added"), (old, "archived"))]
    tx.replace("counts", actions.union(counts[0]).union(counts[1]))
    return tx.commit()


def committed_trash(store: RunStore, seq: str = "listing_id") -> int:
    """Junk rows leave the listings for the trash; buckets without junk keep their files."""
    tx = store.begin()
    table = tx.read("listings")
    split = split_trash(table.drop("action"), tx.read("trash"), seq)
    tx.append("trash", conform(split.moved))
    junk = table.select("listing_id").where("listing_id IS NOT NULL").join(split.kept.select("listing_id").distinct(), "listing_id", "left_anti")
    gone = materialise(junk.distinct(), shared_folder(store.spark) + "/gone")
    tx.update("listings", gone, lambda stored: stored.join(gone, "listing_id", "left_anti"))
    return tx.commit()


# --- verification from stored responses ------------------------------------------------------


def answers(responses: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """responses(query_name, source, ok, body) → (candidates, answered) of ``verify_listings``.

    ``query_name`` is the verification key a source was asked for; a source that failed did not answer.
    """
    asked = responses.select(F.col("query_name").alias("query_id"), "query_name", "source", "ok", "body")
    found = normalise_responses(asked, limit=limit).withColumnRenamed("query_id", "query_name")
    return found, responses.where("ok").select("query_name", "source").distinct()


def verify_responses(
    listings: DataFrame, store: DataFrame, responses: DataFrame, as_of: dt.date, folder: str, **options
) -> Verification:
    """``verify_listings`` from the stored bodies of the sources."""
    candidates, answered = answers(responses)
    candidates = materialise(candidates, folder + "/candidates")
    return verify_listings(listings, store, candidates, answered, as_of, folder, **options)


def committed_verification(store: RunStore, responses: DataFrame, as_of: dt.date, seq: str = "listing_id", **options) -> int:
    """A verification of the committed listings: write-back, result store, unverified extract and counters in one run.

    Listings are written back by bucket: those without a verified event in this run keep their files.
    """
    tx = store.begin()
    folder = shared_folder(store.spark)
    done = verify_responses(tx.read("listings").drop("action"), tx.read("results"), responses, as_of, folder, seq=seq, **options)
    # what the write-back reads; the rest of a result would be written for every listing
    results = materialise(done.results.select("listing_id", "status", "sources_confirmed", "verif_on", "best"), folder + "/written")
    tx.update("listings", results, lambda stored: write_back(stored, results))
    table = tx.read("listings").drop("action")
    tx.replace("results", materialise(done.store, folder + "/results"))
    tx.replace("unverified", unverified(table))
    tx.replace("counts", done.counts)
    return tx.commit()
