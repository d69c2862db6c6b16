"""Dedup, merges, price history, lifecycle, whole runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stallbook import config
from stallbook.checks.catalogue import Catalogue
from stallbook.checks.match_checks import SEARCHED_SQL, UNIQUE_SQL
from stallbook.checks.response_checks import ONE_AD_SQL
from stallbook.checks.text_checks import PROVIDER_SQL
from stallbook.checks.views import (
    AS_OF, LISTINGS_SQL, SCANS_SQL, as_listings, listing_rows, listings, part_venues, scans, table,
)
from stallbook.operators import enrich as E, state as S
from stallbook.operators.pages import first_wins
from stallbook.plans import runs
from stallbook.schemas import LISTING_TYPES, REVIEW_COLUMNS
from stallbook.sources.scratch import shared_folder

CATALOGUE = Catalogue()
check = CATALOGUE.check

SCAN = dt.date(2001, 12, 1)
HISTORY = (
    "listing_id", "ask_unit", "first_seen", "last_seen", "status", "scan_count", "price_current", "price_prev7",
    "price_changes", "price_changed_on", "ref_price", "ref_price_manual", "confidence", "seller_name",
)
DATES = ("first_seen", "last_seen", "price_changed_on")


def text_dates(df, columns=DATES):
    return df.withColumns({c: F.col(c).cast("string") for c in columns if c in df.columns})


# --- dedup -----------------------------------------------------------------------------------

PICK = "ask_total, s2 AS part, s3 AS supp"


def picked(df):
    return df.select("listing_id", "ask_total", F.col("seq.l_partkey").alias("part"), F.col("seq.l_suppkey").alias("supp"))


@check("state_last_wins", f"WITH {LISTINGS_SQL}, {UNIQUE_SQL} SELECT listing_id, {PICK} FROM uniq WHERE CAST(listing_id AS BIGINT) % 13 <> 0")
def last_wins(spark, sf_dir):
    blank = F.when(F.col("listing_id").cast("bigint") % 13 == 0, " ").otherwise(F.col("listing_id"))
    return picked(S.last_wins(listings(spark, sf_dir).withColumn("listing_id", blank)))


@check(
    "state_first_wins",
    f"""WITH {LISTINGS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY listing_url ORDER BY s1, s2, s3, s4, s5) AS rk FROM listings)
    SELECT listing_url, listing_id FROM r WHERE rk = 1""",
)
def first(spark, sf_dir):
    return first_wins(listings(spark, sf_dir), ["listing_url"], F.col("seq")).select("listing_url", "listing_id")


@check("state_dedup_table", f"WITH {LISTINGS_SQL} SELECT count(*) - count(DISTINCT listing_id) AS removed, count(DISTINCT listing_id) AS kept FROM listings")
def dedup_table(spark, sf_dir):
    kept, removed = S.dedup_table(listings(spark, sf_dir))
    return removed.withColumn("kept", kept.agg(F.count("*")).scalar())


# --- merges ------------------------------------------------------------------------------------


def existing(spark, sf_dir, dealt=lambda rows: rows):
    """History of the lines with status F: seen first and last on the ship day."""
    rows = E.with_prices(as_listings(S.last_wins(dealt(listing_rows(spark, sf_dir).where("l_linestatus = 'F'")))))
    k = F.col("seq.l_suppkey")
    day = F.to_date("seq.l_shipdate")
    return rows.select(
        "listing_id", "event_name", "event_date", "category", "city", "venue", "quantity", "ask_total", "is_unit_price", "ask_unit",
        F.when(k % 4 != 0, F.col("ref_price")).alias("ref_price"), "ref_source", "ref_price_manual", "confidence", "confidence_reason",
        "seller_type", "seller_name", day.alias("first_seen"), day.alias("last_seen"),
        F.when(k % 11 == 0, config.SOLD).otherwise(config.ACTIVE).alias("status"), F.lit(1).alias("scan_count"),
        F.when(k % 13 != 0, F.col("ask_unit")).alias("price_current"), F.lit(None).cast("double").alias("price_prev7"),
        F.lit(0).alias("price_changes"), F.when(k % 5 != 0, day).alias("price_changed_on"), F.col("listing_url"),
    )


def batch(spark, sf_dir):
    """Scan rows of the lines with status O; ids repeat."""
    return listings(spark, sf_dir).where("snapshot = 'O'").select(
        "listing_id", "listing_url", "event_name", "event_date", "category", "city", "venue", "quantity", "ask_total", "is_unit_price",
        "ref_price", "ref_source", "confidence", "confidence_reason", "seller_type", "seller_name", "seq",
    )


def review(spark, sf_dir):
    """Queue that already holds every ninth id."""
    rows = listings(spark, sf_dir).where(F.col("listing_id").cast("bigint") % 9 == 0).select("listing_id").distinct()
    return rows.select(*[F.col(c) if c == "listing_id" else F.lit(None).cast("string").alias(c) for c in REVIEW_COLUMNS])


def last_of(snapshot: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY s1 DESC, s2 DESC, s3 DESC) AS rk
      FROM listings WHERE snapshot = '{snapshot}') WHERE rk = 1"""


def last_of_table(table_name: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY s1 DESC, s2 DESC, s3 DESC) AS rk
      FROM {table_name}) WHERE rk = 1"""


MERGE_SQL = f"""{LISTINGS_SQL},
e AS (SELECT *, CASE WHEN l_suppkey % 4 <> 0 THEN ref_price END AS e_ref, CAST(s1 AS DATE) AS day, unit_c / 100.0 AS unit,
  CASE WHEN l_suppkey % 11 = 0 THEN 'verkauft' ELSE 'aktiv' END AS e_status, CASE WHEN l_suppkey % 13 <> 0 THEN unit_c / 100.0 END AS e_price,
  CASE WHEN l_suppkey % 5 <> 0 THEN CAST(s1 AS DATE) END AS e_changed FROM ({last_of('F')})),
b AS (SELECT *, unit_c / 100.0 AS unit FROM ({last_of('O')})),
j AS (SELECT coalesce(e.listing_id, b.listing_id) AS listing_id, e.listing_id IS NOT NULL AS in_e, b.listing_id IS NOT NULL AS in_b,
  e.unit AS e_unit, b.unit AS b_unit, e.day, e.e_status, e.e_price, e.e_changed, e.e_ref, b.ref_price AS b_ref, e.ref_price_manual AS e_man,
  e.confidence AS e_conf, b.confidence AS b_conf, e.seller_name AS e_seller, b.seller_name AS b_seller FROM e FULL JOIN b ON e.listing_id = b.listing_id),
steps AS (SELECT *, in_e AND in_b AND e_price IS NOT NULL AND abs(e_price - b_unit) >= 0.01 AS changed, in_e AND in_b AND e_price IS NULL AS first_price,
  date_diff('day', coalesce(e_changed, day), DATE '2001-12-01') AS age FROM j),
merged AS (SELECT listing_id, in_e, in_b, CASE WHEN in_b THEN b_unit ELSE e_unit END AS ask_unit,
  CAST(CASE WHEN in_e THEN day ELSE DATE '2001-12-01' END AS VARCHAR) AS first_seen,
  CAST(CASE WHEN in_b THEN DATE '2001-12-01' ELSE day END AS VARCHAR) AS last_seen,
  CASE WHEN in_b THEN 'aktiv' WHEN e_status = 'verkauft' THEN 'verkauft' WHEN date_diff('day', day, DATE '2001-12-01') >= 21 THEN 'inaktiv' ELSE e_status END AS status,
  CASE WHEN in_e AND in_b THEN 2 ELSE 1 END AS scan_count,
  CASE WHEN NOT in_b THEN e_price WHEN NOT in_e OR changed OR first_price THEN b_unit ELSE e_price END AS price_current,
  CASE WHEN changed AND age >= 7 THEN e_price END AS price_prev7, CASE WHEN changed THEN 1 ELSE 0 END AS price_changes,
  CAST(CASE WHEN NOT in_e OR changed OR first_price THEN DATE '2001-12-01' ELSE e_changed END AS VARCHAR) AS price_changed_on,
  CASE WHEN in_e THEN e_ref ELSE b_ref END AS ref_price, e_man AS ref_price_manual, CASE WHEN in_b THEN b_conf ELSE e_conf END AS confidence,
  CASE WHEN in_b THEN b_seller ELSE e_seller END AS seller_name FROM steps)
"""
REVIEW_SQL = "SELECT listing_id FROM b WHERE confidence = 'niedrig' AND CAST(listing_id AS BIGINT) % 9 <> 0"


def merged(spark, sf_dir):
    return S.apply_scan(existing(spark, sf_dir), batch(spark, sf_dir), review(spark, sf_dir), part_venues(spark, sf_dir), SCAN)


def history(df):
    return text_dates(df.select(*HISTORY))


@check("state_merge_existing", f"WITH {MERGE_SQL} SELECT {', '.join(HISTORY)} FROM merged WHERE in_e AND in_b")
def merge_existing(spark, sf_dir):
    m = merged(spark, sf_dir)
    return history(m.rows.where("action = 'updated'"))


@check("state_merge_new", f"WITH {MERGE_SQL} SELECT {', '.join(HISTORY)} FROM merged WHERE NOT in_e")
def merge_new(spark, sf_dir):
    return history(merged(spark, sf_dir).rows.where("action = 'inserted'"))


@check("state_merge_scan", f"WITH {MERGE_SQL} SELECT {', '.join(HISTORY)} FROM merged")
def merge_scan(spark, sf_dir):
    return history(merged(spark, sf_dir).table)


@check(
    "state_merge_counts",
    f"""WITH {MERGE_SQL} SELECT 'inserted' AS action, count(*) AS n FROM merged WHERE NOT in_e UNION ALL
    SELECT 'updated', count(*) FROM merged WHERE in_e AND in_b UNION ALL SELECT 'review_added', count(*) FROM ({REVIEW_SQL})""",
)
def merge_counts(spark, sf_dir):
    return merged(spark, sf_dir).counts()


@check("state_review_queue", f"WITH {MERGE_SQL} {REVIEW_SQL}")
def review_queue(spark, sf_dir):
    return merged(spark, sf_dir).review_added.select("listing_id")


@check(
    "state_upsert",
    f"""WITH {MERGE_SQL}, lo AS (SELECT DISTINCT listing_id FROM listings WHERE snapshot = 'O' AND confidence = 'niedrig' AND CAST(listing_id AS BIGINT) % 9 <> 0),
    firsts AS (SELECT listing_id, arg_min(nullif(ref_source, ''), (s1, s2, s3)) AS src FROM listings WHERE snapshot = 'O' AND nullif(ref_source, '') IS NOT NULL GROUP BY ALL),
    fr AS (SELECT listing_id, arg_min(ref_price, (s1, s2, s3)) AS ref FROM listings WHERE snapshot = 'O' GROUP BY ALL)
    SELECT j.listing_id, CASE WHEN NOT in_e THEN 'inserted' WHEN in_b THEN 'updated' ELSE 'kept' END AS action,
      coalesce(j.e_ref, fr.ref) AS ref_price, coalesce(nullif(e.ref_source, ''), f.src) AS ref_source, CASE WHEN in_b THEN b_seller ELSE e_seller END AS seller_name,
      j.e_status AS status, lo.listing_id IS NOT NULL AS queued
    FROM j LEFT JOIN e USING (listing_id) LEFT JOIN firsts f USING (listing_id) LEFT JOIN fr USING (listing_id) LEFT JOIN lo USING (listing_id)""",
)
def upsert(spark, sf_dir):
    m = S.upsert(existing(spark, sf_dir), batch(spark, sf_dir), review(spark, sf_dir))
    queued = m.review_added.select("listing_id", F.lit(True).alias("q"))
    return m.rows.join(queued, "listing_id", "left").select(
        "listing_id", "action", "ref_price", "ref_source", "seller_name", "status", F.coalesce("q", F.lit(False)).alias("queued")
    )


# --- price progression ----------------------------------------------------------------------------

FOLD_SQL = f"""RECURSIVE {SCANS_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY scan_date) AS i FROM scans),
fold AS (
  SELECT listing_id, i, scan_date AS first_seen, scan_date AS last_seen, 1 AS scan_count, ask_unit AS price_current, CAST(NULL AS DOUBLE) AS price_prev7,
    0 AS price_changes, scan_date AS price_changed_on FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.listing_id, n.i, first_seen, n.scan_date, scan_count + 1,
    CASE WHEN abs(price_current - ask_unit) >= 0.01 THEN ask_unit ELSE price_current END,
    CASE WHEN abs(price_current - ask_unit) >= 0.01 AND date_diff('day', price_changed_on, n.scan_date) >= 7 THEN price_current ELSE price_prev7 END,
    CASE WHEN abs(price_current - ask_unit) >= 0.01 THEN price_changes + 1 ELSE price_changes END,
    CASE WHEN abs(price_current - ask_unit) >= 0.01 THEN n.scan_date ELSE price_changed_on END
  FROM fold f JOIN numbered n ON n.listing_id = f.listing_id AND n.i = f.i + 1)
"""
FOLDED_SQL = """SELECT listing_id, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen, scan_count, price_current, price_prev7,
  price_changes, CAST(price_changed_on AS VARCHAR) AS price_changed_on FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY i DESC) AS rk FROM fold) WHERE rk = 1"""


@check("state_price_fold", f"WITH {FOLD_SQL} {FOLDED_SQL}")
def price_fold(spark, sf_dir):
    return text_dates(S.fold_prices(scans(spark, sf_dir)))


# --- updates and lifecycle ---------------------------------------------------------------------------


@check(
    "state_mark_inactive",
    f"""WITH {MERGE_SQL} SELECT listing_id, CASE WHEN e_status = 'verkauft' THEN e_status WHEN in_b THEN 'aktiv'
      WHEN date_diff('day', day, DATE '2001-11-15') >= 21 THEN 'inaktiv' ELSE e_status END AS status FROM j WHERE in_e""",
)
def mark_inactive(spark, sf_dir):
    rows = S.mark_inactive(existing(spark, sf_dir), batch(spark, sf_dir), dt.date(2001, 11, 15))
    return rows.select("listing_id", "status")


@check(
    "state_partial_update",
    f"""WITH {MERGE_SQL} SELECT listing_id, CASE WHEN CAST(listing_id AS BIGINT) % 2 = 0 THEN 'Graz' ELSE city END AS city,
      ref_price_manual, CASE WHEN CAST(listing_id AS BIGINT) % 2 = 0 THEN 'neu' ELSE confidence_reason END AS confidence_reason FROM e""",
)
def partial_update(spark, sf_dir):
    rows = existing(spark, sf_dir)
    updates = rows.where(F.col("listing_id").cast("bigint") % 2 == 0).select(
        "listing_id", F.lit("Graz").alias("city"), F.lit(1.0).alias("ref_price_manual"), F.lit("neu").alias("confidence_reason")
    )
    return S.update_rows(rows, updates).select("listing_id", "city", "ref_price_manual", "confidence_reason")


@check(
    "state_update_ref_price",
    f"""WITH {MERGE_SQL}, u AS (SELECT *, CAST(listing_id AS BIGINT) AS k FROM e)
    SELECT listing_id, CASE WHEN k % 2 = 0 AND k % 4 = 0 THEN 77.5 ELSE e_ref END AS ref_price, CASE WHEN k % 2 = 0 THEN 'eventim' ELSE ref_source END AS ref_source,
      CASE WHEN k % 2 = 0 THEN 'ja' END AS sold_out, k % 2 = 0 AS updated FROM u""",
)
def update_ref_price(spark, sf_dir):
    rows = existing(spark, sf_dir).withColumn("sold_out", F.lit(None).cast("string"))
    k = F.col("listing_id").cast("bigint")
    updates = rows.where(k % 2 == 0).select(
        "listing_id", F.when(k % 4 == 0, 77.5).alias("ref_price"), F.lit("eventim").alias("ref_source"), F.lit("ja").alias("sold_out")
    )
    return S.update_ref_prices(rows, updates).select("listing_id", "ref_price", "ref_source", "sold_out", "updated")


@check(
    "state_archive",
    f"""WITH {LISTINGS_SQL}, {UNIQUE_SQL} SELECT listing_id, CAST(event_date AS VARCHAR) AS event_date, '1998-12-01' AS archived_on FROM uniq
    WHERE event_date < DATE '1998-11-01' AND CAST(listing_id AS BIGINT) % 5 <> 0""",
)
def archive(spark, sf_dir):
    rows = S.last_wins(listings(spark, sf_dir))
    old = rows.where(F.col("listing_id").cast("bigint") % 5 == 0).select("listing_id")
    added = S.archive_additions(rows, old, AS_OF)
    return text_dates(added.select("listing_id", "event_date", "archived_on"), ("event_date", "archived_on"))


DIRTY_SQL = """dirty AS (SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN 'Unbekannt' ELSE event_name END AS name FROM listings),
ids AS (SELECT listing_id, count(*) FILTER (name <> 'Unbekannt') AS clean, count(*) AS n FROM dirty GROUP BY ALL)"""


@check(
    "state_trash",
    f"""WITH {LISTINGS_SQL}, {DIRTY_SQL} SELECT count(*) FILTER (clean = 0 AND CAST(listing_id AS BIGINT) % 4 <> 0) AS moved,
      CAST(sum(n) FILTER (clean > 0) AS BIGINT) AS kept FROM ids""",
)
def trash(spark, sf_dir):
    return trash_split(spark, sf_dir).counts()


def trash_split(spark, sf_dir):
    dirty = listings(spark, sf_dir).withColumn(
        "event_name", F.when(F.col("seq.l_suppkey") % 5 == 0, "Unbekannt").otherwise(F.col("event_name"))
    )
    old = dirty.where(F.col("listing_id").cast("bigint") % 4 == 0).select("listing_id").distinct()
    return S.split_trash(dirty, old)


@check(
    "trash_rows",
    f"""WITH {LISTINGS_SQL}, {DIRTY_SQL}, r AS (SELECT d.*, clean, row_number() OVER (PARTITION BY d.listing_id ORDER BY s1, s2, s3, s4, s5) AS rk
      FROM dirty d JOIN ids USING (listing_id))
    SELECT 'moved' AS part, listing_id, name AS event_name, category, ask_total FROM r WHERE clean = 0 AND rk = 1 AND CAST(listing_id AS BIGINT) % 4 <> 0
    UNION ALL SELECT 'kept', listing_id, name, category, ask_total FROM r WHERE clean > 0""",
)
def trash_rows(spark, sf_dir):
    split = trash_split(spark, sf_dir)
    columns = ("listing_id", "event_name", "category", "ask_total")
    moved, kept = (df.select(F.lit(part).alias("part"), *columns) for part, df in (("moved", split.moved), ("kept", split.kept)))
    return moved.unionByName(kept)


def finished_run(spark, sf_dir):
    return runs.finish_run(
        full_history(spark, sf_dir), batch(spark, sf_dir), review(spark, sf_dir), full_history(spark, sf_dir).where("false"),
        part_venues(spark, sf_dir), SCAN, shared_folder(spark),
    )


# --- whole runs --------------------------------------------------------------------------------------


def full_history(spark, sf_dir, dealt=lambda rows: rows):
    return S.conform(existing(spark, sf_dir, dealt))


FINISH_SQL = f"""WITH {MERGE_SQL}, days AS (SELECT coalesce(b.event_date, e.event_date) AS d FROM e FULL JOIN b ON e.listing_id = b.listing_id)
SELECT 'inserted' AS action, count(*) AS n FROM merged WHERE NOT in_e UNION ALL SELECT 'updated', count(*) FROM merged WHERE in_e AND in_b
UNION ALL SELECT 'review_added', count(*) FROM ({REVIEW_SQL}) UNION ALL SELECT 'archived', count(*) FROM days WHERE d < DATE '2001-11-01'
UNION ALL SELECT 'dashboard', count(*) FROM (SELECT DISTINCT lower(coalesce(b.event_name, e.event_name)), coalesce(b.event_date, e.event_date),
  coalesce(b.category, e.category) FROM e FULL JOIN b ON e.listing_id = b.listing_id)"""


@check("state_finish_run", FINISH_SQL)
def finish_run(spark, sf_dir):
    done = finished_run(spark, sf_dir)
    boards = done.dashboard.agg(F.count("*").alias("n")).select(F.lit("dashboard").alias("action"), "n")
    return done.counts.union(boards)


@check(
    "run_archive",
    f"""WITH {MERGE_SQL} SELECT coalesce(b.listing_id, e.listing_id) AS listing_id, coalesce(b.event_name, e.event_name) AS event_name,
      CAST(coalesce(b.event_date, e.event_date) AS VARCHAR) AS event_date, coalesce(b.category, e.category) AS category
    FROM e FULL JOIN b ON e.listing_id = b.listing_id WHERE coalesce(b.event_date, e.event_date) < DATE '2001-11-01'""",
)
def run_archive(spark, sf_dir):
    done = finished_run(spark, sf_dir)
    return text_dates(done.archive.select("listing_id", "event_name", "event_date", "category"), ("event_date",))


@check(
    "run_listings",
    f"""WITH {MERGE_SQL} SELECT coalesce(b.listing_id, e.listing_id) AS listing_id, coalesce(b.event_name, e.event_name) AS event_name,
      CAST(coalesce(b.event_date, e.event_date) AS VARCHAR) AS event_date, coalesce(b.category, e.category) AS category
    FROM e FULL JOIN b ON e.listing_id = b.listing_id""",
)
def run_listings(spark, sf_dir):
    done = finished_run(spark, sf_dir)
    return text_dates(done.listings.select("listing_id", "event_name", "event_date", "category"), ("event_date",))


def run_inputs(spark, sf_dir):
    from stallbook.checks import response_checks as RC
    from stallbook.operators.refprice import first_provider_hit
    from stallbook.checks.match_checks import searched

    everything = RC.one_per_id(spark, sf_dir)
    venues = part_venues(spark, sf_dir)
    kind = RC.event_columns(everything, RC.CHAIN, venues)
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in sorted(kind, key=lambda f: f.name != "event_no"))
    found = searched(spark, sf_dir)
    watch = table(spark, sf_dir, "part").select(F.lit(1).alias("line_no"), F.col("p_name").alias("event_name")).distinct().where(
        F.col("event_name").startswith("red")
    ).withColumns({"ref_price": F.lit(49.9), "ref_link": F.lit("")})
    return runs.Inputs(
        ads=everything,
        parse_store=spark.createDataFrame([], f"listing_id STRING, events ARRAY<STRUCT<{fields}>>"),
        ref_store=spark.createDataFrame([], "ref_key STRING, price DOUBLE, source STRING, sold_out STRING"),
        watchlist=watch, direct_pages=found.select("url", "price", "sold_out", "source").distinct(),
        search_hits=first_provider_hit(found), listings=full_history(spark, sf_dir), review=review(spark, sf_dir),
        archive=full_history(spark, sf_dir).where("false"), venues=venues,
    )


RUN_SQL = f"""WITH {ONE_AD_SQL}, {PROVIDER_SQL}, {SEARCHED_SQL}, facts AS ({last_of_table('offers')}),
parsed AS (SELECT w.id AS listing_id, f.event_name, f.event_date, w.offered, CASE WHEN w.offered THEN 'hoch' ELSE 'niedrig' END AS confidence
  FROM wanted w JOIN facts f ON f.listing_id = w.id),
e AS ({last_of('F')}), found AS (SELECT p.*, CASE WHEN event_name LIKE 'red%' THEN 49.9 ELSE h.price END AS price FROM parsed p LEFT JOIN hits h USING (event_name)),
after AS (SELECT coalesce(p.listing_id, e.listing_id) AS listing_id, CASE WHEN p.listing_id IS NULL THEN e.event_date WHEN p.offered THEN
    CASE WHEN p.event_date < DATE '1998-12-01' AND year(p.event_date) IN (1998, 1997) AND p.event_date + INTERVAL 1 YEAR > DATE '1998-12-01'
      THEN p.event_date + INTERVAL 1 YEAR ELSE p.event_date END END AS d FROM parsed p FULL JOIN e ON e.listing_id = p.listing_id)
SELECT 'parsed' AS action, count(*) AS n FROM parsed UNION ALL SELECT 'ref_found', count(price) FILTER (offered) FROM found
UNION ALL SELECT 'inserted', count(*) FROM parsed WHERE listing_id NOT IN (SELECT listing_id FROM e)
UNION ALL SELECT 'updated', count(*) FROM parsed WHERE listing_id IN (SELECT listing_id FROM e)
UNION ALL SELECT 'review_added', count(*) FROM parsed WHERE confidence = 'niedrig' AND CAST(listing_id AS BIGINT) % 9 <> 0
UNION ALL SELECT 'archived', count(*) FROM after WHERE d < DATE '1998-11-01'"""


@check("state_full_run", RUN_SQL)
def full_run(spark, sf_dir):
    from stallbook.checks.response_checks import CHAIN

    return runs.full_run(run_inputs(spark, sf_dir), CHAIN, AS_OF, shared_folder(spark)).counts


assert len(LISTING_TYPES) == 52