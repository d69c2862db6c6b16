"""Whole runs: scan → history → archive → dashboard, and verification."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stallbook import config
from stallbook.functions.keys import strip, verification_key
from stallbook.operators.dashboard import market_dashboard
from stallbook.operators.extraction import Extractor, parse_incremental
from stallbook.operators.matching import (
    match_own_candidates, store_get, store_put, unverified, verification_status, write_back,
)
from stallbook.operators.pages import age_cutoff, extract_ads, first_wins, newest
from stallbook.operators.refprice import apply_ref_prices, lookup_ref_prices
from stallbook.operators.state import QUEUED, apply_scan, archive_additions, conform, queued_additions
from stallbook.sources.scratch import materialise
from stallbook.sources.tables import missing_from


@dataclass(frozen=True)
class Finished:
    """Tables after a run, and its counters as (action, n)."""

    listings: DataFrame
    review: DataFrame
    archive: DataFrame
    dashboard: DataFrame
    counts: DataFrame


def finish_run(
    listings: DataFrame,
    events: DataFrame,
    review: DataFrame,
    archive: DataFrame,
    venues: DataFrame,
    as_of: dt.date,
    folder: str,
    seq: str = "seq",
) -> Finished:
    """History merge, archive and dashboard. The new snapshot is written once
    under ``folder`` and everything after reads it: the review queue, and the
    archive, whose rows are not stored a second time."""
    merge = apply_scan(listings, events, review, venues, as_of, seq=seq, queue=True)
    stored = materialise(merge.rows, folder + "/listings")
    added = materialise(queued_additions(stored, review), folder + "/review_added")
    snapshot = stored.drop(QUEUED)
    table = snapshot.drop("action")
    old = archive_additions(table, archive, as_of)
    merged = snapshot.where("action <> 'kept'").groupBy("action").agg(F.count("*").alias("n"))

    def counter(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("action"), "n")

    counts = merged.union(counter(added, "review_added")).union(counter(old, "archived"))
    return Finished(
        listings=table,
        review=review.unionByName(added, allowMissingColumns=True),
        archive=archive.unionByName(old, allowMissingColumns=True),
        dashboard=market_dashboard(table, as_of, seq="listing_id"),
        counts=counts,
    )


def ads_of_pages(
    pages: DataFrame,
    as_of: dt.date,
    stored: DataFrame | None = None,
    site: config.SiteProfile = config.SiteProfile(),
    first_run: bool = False,
    limit: int | None = None,
    scraped_at: Column | None = None,
) -> DataFrame:
    """Stored pages → the adverts a run works on (``Inputs.ads``).

    Extracted, within the age window of the run, without the ids of ``stored``, and
    only the newest ``limit`` if one is given. The first copy of an id counts.
    """
    ads = age_cutoff(extract_ads(pages, as_of, site, scraped_at), as_of, first_run)
    if stored is not None:
        ads = missing_from(ads, stored, "listing_id")
    ads = first_wins(ads, ["listing_id"], F.col("listing_url"))
    return ads if limit is None else newest(ads, limit, "listing_id")


@dataclass(frozen=True)
class Inputs:
    """Stored tables a full run reads."""

    ads: DataFrame
    parse_store: DataFrame
    ref_store: DataFrame
    watchlist: DataFrame
    direct_pages: DataFrame
    search_hits: DataFrame
    listings: DataFrame
    review: DataFrame
    archive: DataFrame
    venues: DataFrame


@dataclass(frozen=True)
class FullRun:
    events: DataFrame
    parse_entries: DataFrame
    ref_entries: DataFrame
    finished: Finished | None
    counts: DataFrame


def full_run(
    inputs: Inputs,
    chain: Sequence[Extractor],
    as_of: dt.date,
    folder: str,
    dry_run: bool = False,
    template: str = "{text}",
) -> FullRun:
    """Adverts → events → reference prices → history, archive, dashboard.

    Model answers and new reference prices are written before they are used
    again, so no model is asked twice. A dry run stops before the tables change.
    """
    ads = materialise(inputs.ads, folder + "/ads")
    _, entries = parse_incremental(
        ads, inputs.parse_store, chain, inputs.venues, as_of, folder + "/parse", template
    )
    entries = materialise(entries, folder + "/parse_entries")
    store = inputs.parse_store.unionByName(entries, allowMissingColumns=True)
    events = (
        store.join(ads.select("listing_id").distinct(), "listing_id", "left_semi")
        .select("listing_id", F.explode("events").alias("e"))
        .select("listing_id", "e.*")
    )
    prices = materialise(
        lookup_ref_prices(
            events, inputs.ref_store, inputs.watchlist, inputs.direct_pages, inputs.search_hits
        ),
        folder + "/ref_entries",
    )
    priced = materialise(
        apply_ref_prices(events, inputs.ref_store.unionByName(prices)), folder + "/events"
    )
    counters = priced.agg(
        F.count("*").alias("parsed"), F.count("ref_price").alias("ref_found")
    ).select(F.expr("stack(2, 'parsed', parsed, 'ref_found', ref_found) AS (action, n)"))
    if dry_run:
        return FullRun(priced, entries, prices, None, counters)
    batch = priced.withColumn("seq", F.struct("parsed_at", "event_no")).withColumn(
        "event_date", F.col("event_date").try_cast("date")
    )
    batch = batch.drop("event_no", "fallback_used", "parsed_at", "price_raw")
    done = finish_run(
        conform(inputs.listings), batch, inputs.review, inputs.archive, inputs.venues, as_of, folder
    )
    return FullRun(priced, entries, prices, done, counters.union(done.counts))


@dataclass(frozen=True)
class Verification:
    """Tables after a verification; ``results`` has one row per listing that was looked at."""

    listings: DataFrame
    results: DataFrame
    store: DataFrame
    unverified: DataFrame
    counts: DataFrame


def verify_listings(
    listings: DataFrame,
    store: DataFrame,
    candidates: DataFrame,
    answered: DataFrame,
    as_of: dt.date,
    folder: str,
    ttl_days: int = config.VERIFICATION_TTL_DAYS,
    limit: int | None = None,
    force: bool = False,
    dry_run: bool = False,
    status_filter: str | None = None,
    seq: str = "seq",
) -> Verification:
    """Verifies the distinct events of the listings and writes the result back.

    ``candidates(query_name, source, event_name, event_date, city, cand_seq)``
    and ``answered(query_name, source)`` are stored source responses, keyed by
    the verification key of the name they were asked for. An event is
    looked up once per (name, date), with the city of its first listing; with
    ``force`` once per (name, date, city) and without the store. Counts are per
    listing: total, cached, and one per status.
    """
    rows = listings
    if status_filter is not None:
        rows = rows.where(strip(F.coalesce("verif_status", F.lit(""))) == status_filter)
    if limit is not None:
        rows = rows.orderBy(seq).limit(limit)
    rows = rows.select(
        "listing_id", "event_name", "event_date", "city", F.col(seq).alias("seq"),
        F.coalesce(verification_key(F.col("event_name")), F.lit("")).alias("name_key"),
    )
    if limit is not None:
        rows = materialise(rows, folder + "/limited")
    parts = ["name_key", "event_date"] + (["city"] if force else [])
    named = rows.where("name_key <> ''")
    queries = first_wins(named, parts, F.col("seq")).drop("listing_id")
    # one row per distinct event from here on
    if force:
        found = queries.withColumn("hit", F.lit(None).cast(store_hit_type(store)))
    else:
        found = store_get(queries, store, as_of, ttl_days)
    found = materialise(found, folder + "/queries")
    todo = found.where("hit IS NULL").withColumn(
        "query_id", F.concat_ws("\u0001", "name_key", F.coalesce(F.col("event_date").cast("string"), F.lit("")),
                                *([F.coalesce("city", F.lit(""))] if force else []))
    )
    # candidates that score alike are one, the first: responses of a name may repeat it for each of its events
    own = candidates.groupBy(F.col("query_name").alias("name_key"), "source", "event_name", "event_date", "city").agg(
        F.min(F.struct("cand_seq"))["cand_seq"].alias("cand_seq"))
    offered = own.join(todo.select("name_key", "query_id"), "name_key").drop("name_key")
    asked = answered.withColumnRenamed("query_name", "name_key").join(
        todo.select("name_key", "query_id"), "name_key"
    )
    status = verification_status(todo, asked, match_own_candidates(todo, offered), as_of)
    fresh = materialise(
        status.select(*parts, "seq", "status", "best", "sources_checked", "sources_confirmed"),
        folder + "/fresh",
    )
    reused = found.where("hit IS NOT NULL").select(
        *parts, "seq", "hit.status", "hit.best", "hit.sources_checked", "hit.sources_confirmed",
        F.col("hit.cached_on").alias("verif_on"), F.lit(True).alias("stored"),
    )
    results = reused.unionByName(
        fresh.withColumn("verif_on", F.lit(as_of)).withColumn("stored", F.lit(False))
    )
    left = rows.select("listing_id", "name_key", "event_date", "city", F.col("seq").alias("row_seq"))
    on = left["name_key"] == results["name_key"]
    for p in parts[1:]:
        on = on & left[p].eqNullSafe(results[p])
    per_row = left.join(results, on, "left").select(
        left["listing_id"], left["name_key"], "row_seq", "seq", "stored", "verif_on",
        F.when(left["name_key"] == "", config.SKIPPED).otherwise(F.col("status")).alias("status"),
        "best", F.coalesce("sources_confirmed", F.array().cast("array<string>")).alias("sources_confirmed"),
    ).withColumn("verif_on", F.coalesce("verif_on", F.lit(as_of)))
    # later listings of a key verified in this run find it in the store
    cached = F.coalesce(F.col("stored") | (F.col("row_seq") != F.col("seq")), F.lit(False))
    if force:
        cached = F.lit(False)
    per_status = per_row.groupBy(F.col("status").alias("action")).agg(F.count("*").alias("n"), F.count_if(cached).alias("c"))
    # reading c keeps both users on one shuffle, so the rows are joined once
    by_status = per_status.where("c >= 0").select("action", "n")
    totals = per_status.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")
    ).select(F.expr("stack(2, 'total', t, 'cached', c) AS (action, n)"))
    counts = totals.union(by_status)
    new_store = store_put(store, fresh.drop("city"), as_of)
    usable = per_row.where(F.coalesce(strip(F.col("listing_id")) != "", F.lit(False)))
    written = first_wins(usable, ["listing_id"], F.col("row_seq").desc())
    if dry_run:
        return Verification(listings, written, new_store, unverified(listings), counts)
    table = write_back(listings, written)
    return Verification(table, written, new_store, unverified(table), counts)


def store_hit_type(store: DataFrame) -> str:
    """Type of a stored entry as ``store_get`` returns it."""
    entry = store.select(
        F.struct("status", "best", "sources_checked", "sources_confirmed", "cached_on").alias("hit")
    )
    return entry.schema["hit"].dataType.simpleString()
