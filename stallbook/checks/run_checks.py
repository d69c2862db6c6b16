"""Committed runs: rows of every table after a scan, after a verification, and as the run before left them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stallbook import config
from stallbook.checks.catalogue import Catalogue
from stallbook.checks.match_checks import BEST_TYPE, NORMAL_SQL, STATUS_SQL, UNIQUE_SQL, responses, tokens_sql, unique_listings
from stallbook.checks.state_checks import (
    DIRTY_SQL, HISTORY, MERGE_SQL, REVIEW_SQL, SCAN, batch, full_history, history, review,
)
from stallbook.checks.views import AS_OF, LISTINGS_SQL, as_listings, listing_rows, part_venues, table
from stallbook.operators.state import conform, last_wins
from stallbook.plans import committed
from stallbook.sources.commits import RunStore, buckets_for
from stallbook.sources.scratch import shared_folder

CATALOGUE = Catalogue()
check = CATALOGUE.check

BUCKETS = 16


def new_store(spark, sf_dir) -> RunStore:
    """No table of listings has more rows than line items."""
    return RunStore(spark, shared_folder(spark), committed.KEYED, buckets_for(table(spark, sf_dir, "lineitem").count(), BUCKETS))


def scanned(spark, sf_dir) -> RunStore:
    """A store with the history as run 0 and one scan as run 1."""
    store = new_store(spark, sf_dir)
    old = full_history(spark, sf_dir, lambda rows: store.dealt("listings", rows))
    committed.found_tables(store, old, review(spark, sf_dir), old.where("false"), placed=True)
    committed.committed_scan(store, batch(spark, sf_dir), part_venues(spark, sf_dir), SCAN)
    return store


@check("run_committed_listings", f"WITH {MERGE_SQL} SELECT {', '.join(HISTORY)} FROM merged")
def committed_listings(spark, sf_dir):
    """The history after a scan that touched its buckets only."""
    return history(scanned(spark, sf_dir).read("listings"))


@check(
    "run_committed_tables",
    f"""WITH {MERGE_SQL}, a AS (SELECT coalesce(b.listing_id, e.listing_id) AS listing_id, coalesce(b.event_name, e.event_name) AS name, coalesce(b.event_date, e.event_date) AS d,
      coalesce(b.category, e.category) AS category FROM e FULL JOIN b ON e.listing_id = b.listing_id),
    queue AS (SELECT DISTINCT listing_id FROM listings WHERE CAST(listing_id AS BIGINT) % 9 = 0)
    SELECT 'review' AS part, listing_id AS id, CAST(NULL AS VARCHAR) AS day, CAST(NULL AS BIGINT) AS n FROM queue UNION ALL SELECT 'review', listing_id, NULL, NULL FROM ({REVIEW_SQL})
    UNION ALL SELECT 'archive', listing_id, CAST(d AS VARCHAR), NULL FROM a WHERE d < DATE '2001-11-01'
    UNION ALL SELECT 'dashboard', lower(name) || '|' || category, CAST(d AS VARCHAR), count(*) FROM a GROUP BY lower(name), category, d
    UNION ALL SELECT 'counts', 'inserted', NULL, count(*) FROM merged WHERE NOT in_e UNION ALL SELECT 'counts', 'updated', NULL, count(*) FROM merged WHERE in_e AND in_b
    UNION ALL SELECT 'counts', 'review_added', NULL, count(*) FROM ({REVIEW_SQL}) UNION ALL SELECT 'counts', 'archived', NULL, count(*) FROM a WHERE d < DATE '2001-11-01'""",
)
def committed_tables(spark, sf_dir):
    store = scanned(spark, sf_dir)
    day, n = F.col("event_date").cast("string").alias("day"), F.lit(None).cast("bigint").alias("n")
    parts = {
        "review": store.read("review").select(F.col("listing_id").alias("id"), F.lit(None).cast("string").alias("day"), n),
        "archive": store.read("archive").select(F.col("listing_id").alias("id"), day, n),
        "dashboard": store.read("dashboard").select(F.concat(F.lower("event_name"), F.lit("|"), "category").alias("id"), day, F.col("n_listings").cast("bigint").alias("n")),
        "counts": store.read("counts").select(F.col("action").alias("id"), F.lit(None).cast("string").alias("day"), "n"),
    }
    out = None
    for part, rows in parts.items():
        rows = rows.select(F.lit(part).alias("part"), "id", "day", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@check(
    "run_previous_tables",
    f"""WITH {MERGE_SQL} SELECT 'listings' AS part, listing_id, e_status AS status, CAST(day AS VARCHAR) AS last_seen FROM e
    UNION ALL SELECT DISTINCT 'review', listing_id, NULL, NULL FROM listings WHERE CAST(listing_id AS BIGINT) % 9 = 0""",
)
def previous_tables(spark, sf_dir):
    """The tables of run 0, read after run 1 was committed."""
    store = scanned(spark, sf_dir)
    old = store.read("listings", run=0).select(F.lit("listings").alias("part"), "listing_id", "status", F.col("last_seen").cast("string").alias("last_seen"))
    queue = store.read("review", run=0).select(F.lit("review").alias("part"), "listing_id")
    return old.unionByName(queue, allowMissingColumns=True)


@check(
    "run_committed_trash",
    f"""WITH {LISTINGS_SQL}, {DIRTY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY s1 DESC, s2 DESC, s3 DESC) AS rk FROM dirty)
    SELECT CASE WHEN name = 'Unbekannt' THEN 'trash' ELSE 'listings' END AS part, listing_id, name AS event_name, category FROM r WHERE rk = 1""",
)
def committed_trash(spark, sf_dir):
    """Junk moved out of a committed table; both tables of the run."""
    store = new_store(spark, sf_dir)
    rows = as_listings(last_wins(store.dealt("listings", listing_rows(spark, sf_dir)))).withColumn(
        "event_name", F.when(F.col("seq.l_suppkey") % 5 == 0, "Unbekannt").otherwise(F.col("event_name")))
    committed.found_tables(store, rows, review(spark, sf_dir), conform(rows).where("false"), placed=True)
    committed.committed_trash(store)
    parts = [store.read(name).select(F.lit(name).alias("part"), "listing_id", "event_name", "category") for name in ("listings", "trash")]
    return parts[0].unionByName(parts[1])


# --- verification from stored responses ----------------------------------------------------------


def verified(spark, sf_dir) -> RunStore:
    """A store of the unique listings after a verification from stored responses; events of 1996 were verified before."""
    store = new_store(spark, sf_dir)
    rows = unique_listings(spark, sf_dir, lambda df: store.dealt("listings", df))
    old = unique_listings(spark, sf_dir).where(F.year("event_date") == 1996).select(F.lower("event_name").alias("name_key"), "event_date").distinct().select(
        "*", F.lit(config.VERIFIED).alias("status"), F.lit(None).cast(BEST_TYPE).alias("best"),
        F.array(F.lit("wikidata")).alias("sources_checked"), F.array(F.lit("wikidata")).alias("sources_confirmed"),
        F.lit(AS_OF - dt.timedelta(days=6)).alias("cached_on"),
    )
    committed.found_tables(store, rows, review(spark, sf_dir), conform(rows).where("false"), old, placed=True)
    bodies = responses(spark, sf_dir).withColumn("query_name", F.lower("query_name"))
    committed.committed_verification(store, bodies, AS_OF)
    return store


VERIFY_SQL = f"""{LISTINGS_SQL}, {UNIQUE_SQL}, {NORMAL_SQL},
ordered AS (SELECT *, lower(event_name) AS name_key, row_number() OVER (PARTITION BY lower(event_name), event_date ORDER BY listing_id) AS nth FROM uniq),
queries AS (SELECT event_name, event_date, city, name_key || chr(1) || CAST(event_date AS VARCHAR) AS query_id FROM ordered WHERE nth = 1 AND year(event_date) <> 1996),
offered AS (SELECT q.query_id, q.event_date AS q_date, q.city AS q_city, {tokens_sql('q.event_name')} AS qt, {tokens_sql('n.event_name')} AS ct,
    n.source, CASE WHEN n.source = 'bandsintown' THEN lower(n.event_name) ELSE n.event_name END AS event_name, n.event_date, n.city, n.cand_seq
  FROM queries q JOIN part p ON lower(p.p_name) = lower(q.event_name) JOIN normal n ON n.p_partkey = p.p_partkey),
named AS (SELECT *, CAST(len(list_intersect(qt, ct)) AS DOUBLE) / len(list_distinct(list_concat(qt, ct))) AS name_score FROM offered),
totals AS (SELECT query_id, source, event_name AS cand_name, cand_seq, round(name_score * 0.5
  + CASE WHEN q_date = event_date THEN 1.0 WHEN abs(date_diff('day', q_date, event_date)) <= 7 THEN 0.5 ELSE 0.0 END * 0.3
  + CASE WHEN city IS NULL THEN 0.0 WHEN lower(q_city) = lower(trim(city)) THEN 1.0 WHEN contains(lower(q_city), lower(trim(city)))
    OR contains(lower(trim(city)), lower(q_city)) THEN 0.5 ELSE 0.0 END * 0.2, 4) AS total FROM named WHERE name_score >= 0.3),
answered AS (SELECT DISTINCT q.query_id, CASE p_partkey % 4 WHEN 0 THEN 'musicbrainz' WHEN 1 THEN 'wikidata' WHEN 2 THEN 'songkick' ELSE 'bandsintown' END AS source
  FROM queries q JOIN part p ON lower(p.p_name) = lower(q.event_name) WHERE p_partkey % 3 <> 0),
{STATUS_SQL},
per_row AS (SELECT o.listing_id, CASE WHEN year(o.event_date) = 1996 THEN 'verifiziert' ELSE s.status END AS status,
    CASE WHEN year(o.event_date) = 1996 THEN 'wikidata' ELSE s.sources_confirmed END AS sources,
    CASE WHEN year(o.event_date) = 1996 THEN '1998-11-25' ELSE '1998-12-01' END AS verif_on, coalesce(best_name, '') AS name, round(best_total, 3) AS score
  FROM ordered o LEFT JOIN statuses s ON s.query_id = o.name_key || chr(1) || CAST(o.event_date AS VARCHAR))
"""


@check(
    "verify_committed_listings",
    f"WITH {VERIFY_SQL} SELECT listing_id, status AS verif_status, sources AS verif_sources, verif_on, name AS verif_name, score AS verif_score FROM per_row",
)
def verified_listings(spark, sf_dir):
    return verified(spark, sf_dir).read("listings").select(
        "listing_id", "verif_status", F.concat_ws("; ", "verif_sources").alias("verif_sources"), F.col("verif_on").cast("string").alias("verif_on"),
        "verif_name", "verif_score",
    )


@check(
    "verify_committed_tables",
    f"""WITH {VERIFY_SQL} SELECT 'results' AS part, split_part(query_id, chr(1), 1) AS id, split_part(query_id, chr(1), 2) AS day, status, '1998-12-01' AS cached_on FROM statuses
    UNION ALL SELECT DISTINCT 'results', lower(event_name), CAST(event_date AS VARCHAR), 'verifiziert', '1998-11-25' FROM uniq WHERE year(event_date) = 1996
    UNION ALL SELECT 'unverified', listing_id, NULL, status, NULL FROM per_row WHERE status = 'nicht_verifiziert'""",
)
def verified_tables(spark, sf_dir):
    store = verified(spark, sf_dir)
    kept = store.read("results").select(
        F.lit("results").alias("part"), F.col("name_key").alias("id"), F.col("event_date").cast("string").alias("day"), "status",
        F.col("cached_on").cast("string").alias("cached_on"))
    rest = store.read("unverified").select(F.lit("unverified").alias("part"), F.col("listing_id").alias("id"), F.col("verif_status").alias("status"))
    return kept.unionByName(rest, allowMissingColumns=True)
