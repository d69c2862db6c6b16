"""Streaming jobs, run to the end of their input; the final state is the batch result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W, functions as F

from stallbook.checks.catalogue import Catalogue
from stallbook.checks.page_checks import TODAY, pages
from stallbook.checks.state_checks import FOLD_SQL, text_dates
from stallbook.checks.views import part_venues, table
from stallbook.operators.pages import extract_ads
from stallbook.schemas import LISTING
from stallbook.sources.scratch import shared_folder
from stallbook.sources.tables import write_raw_ads
from stallbook.streaming import jobs as J

CATALOGUE = Catalogue()
check = CATALOGUE.check


def finish(query):
    query.awaitTermination()


@check("stream_ingest", "SELECT url AS listing_url, count(*) AS n FROM pages GROUP BY ALL")
def ingest(spark, sf_dir):
    """Two scheduled runs over a growing folder take every file once."""
    base = shared_folder(spark)
    ads = extract_ads(pages(spark, sf_dir), TODAY, scraped_at=F.lit("2024-03-01 08:00:00").cast("timestamp"))
    early = F.crc32(F.encode("listing_url", "utf-8")) % 2 == 0
    for name, part in (("first", ads.where(early)), ("second", ads.where(~early))):
        write_raw_ads(part, f"{base}/in/{name}")
        # lines that are no adverts arrive as well
        spark.createDataFrame([('{"listing_id": "x", "title": ',), ("kein json",)], "value string").write.text(f"{base}/in/broken_{name}")
        finish(J.start(J.stream_ads(spark, base + "/in/*"), base + "/checkpoint", base + "/out"))
    out = spark.read.parquet(base + "/out")
    return out.groupBy("listing_url").agg(F.count("*").alias("n"))


EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def slices(spark, sf_dir, base, columns, cuts=("2024-01-11", "2024-01-21")):
    """Writes the events in three steps of time; yields after each, as if files had arrived."""
    e = table(spark, sf_dir, "events")
    bounds = ["0001-01-01", *cuts, "9999-12-31"]
    for low, high in zip(bounds, bounds[1:]):
        part = e.where((F.col("ts") >= F.lit(low).cast("timestamp")) & (F.col("ts") < F.lit(high).cast("timestamp")))
        part.select(*columns).write.mode("append").parquet(base + "/in")
        yield


def mixed_slices(spark, sf_dir, base, columns, n=3):
    """Writes the events in steps that cut through every day and are in no order of time."""
    e = table(spark, sf_dir, "events")
    for i in range(n):
        part = e.where(F.pmod(F.xxhash64("event_id"), F.lit(n)) == i)
        part.select(*columns).write.mode("append").parquet(base + "/in")
        yield


@check("stream_drop_seen", "SELECT CAST(user_id AS VARCHAR) AS listing_id, 1 AS n FROM events GROUP BY ALL")
def drop_seen(spark, sf_dir):
    base = shared_folder(spark)
    columns = (F.col("user_id").cast("string").alias("listing_id"), F.col("ts").alias("scraped_at"))
    for _ in slices(spark, sf_dir, base, columns):
        stream = spark.readStream.schema("listing_id STRING, scraped_at TIMESTAMP").parquet(base + "/in")
        finish(J.start(J.drop_seen(stream, within="60 days"), base + "/checkpoint", base + "/out"))
    return spark.read.parquet(base + "/out").groupBy("listing_id").agg(F.count("*").cast("int").alias("n"))


@check("stream_append_unseen", "SELECT CAST(user_id AS VARCHAR) AS listing_id, CAST(min(ts) AS VARCHAR)[1:19] AS scraped_at FROM events GROUP BY ALL")
def append_unseen(spark, sf_dir):
    base = shared_folder(spark)
    columns = (F.col("user_id").cast("string").alias("listing_id"), F.col("ts").alias("scraped_at"))
    for _ in slices(spark, sf_dir, base, columns):
        stream = spark.readStream.schema("listing_id STRING, scraped_at TIMESTAMP").parquet(base + "/in")
        finish(J.start(stream, base + "/checkpoint", each=J.append_unseen(spark, base + "/out")))
    out = spark.read.parquet(base + "/out")
    return out.select("listing_id", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"))


@check("stream_drop_old", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'")
def drop_old(spark, sf_dir):
    base = shared_folder(spark)
    stream = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet")
    finish(J.start(J.drop_old(stream, "ts", 7, dt.date(2024, 1, 31)), base + "/checkpoint", base + "/out"))
    return spark.read.parquet(base + "/out").select("event_id")


@check(
    "stream_merge_history",
    f"""WITH {FOLD_SQL} SELECT listing_id, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen, scan_count, price_current,
      price_prev7, price_changes, CAST(price_changed_on AS VARCHAR) AS price_changed_on
    FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY i DESC) AS rk FROM fold) WHERE rk = 1""",
)
def merge_history(spark, sf_dir):
    """Scans that arrive in no order; every micro-batch merges its days into the snapshot."""
    folder, version = merged_stream(spark, sf_dir)
    out = spark.read.schema(LISTING).parquet(J.snapshot_path(folder, version))
    columns = ("listing_id", "first_seen", "last_seen", "scan_count", "price_current", "price_prev7", "price_changes", "price_changed_on")
    return text_dates(out.select(*columns))


def merged_stream(spark, sf_dir):
    """(folder, last version) after three micro-batches cut inside days."""
    base = shared_folder(spark)
    columns = (
        F.col("user_id").cast("string").alias("listing_id"), F.to_date("ts").alias("scan_date"), F.lit("Konzert").alias("event_name"),
        F.lit("Brand#2").alias("venue"), F.lit(1).alias("quantity"), F.col("value").alias("ask_total"), F.lit(True).alias("is_unit_price"),
        F.lit(None).cast("double").alias("ref_price"), F.lit(None).cast("string").alias("ref_source"),
        F.when(F.col("user_id") % 3 == 0, "niedrig").otherwise("hoch").alias("confidence"),
        F.lit(None).cast("string").alias("confidence_reason"), F.lit("Privat").alias("seller_type"), F.lit("S").alias("seller_name"),
        F.to_date("ts").alias("event_date"), F.col("event_id").alias("seq"),
    )
    each = J.merge_each(spark, base + "/listings", part_venues(spark, sf_dir))
    version = -1
    for version, _ in enumerate(mixed_slices(spark, sf_dir, base, columns)):
        schema = spark.read.parquet(base + "/in").schema
        stream = spark.readStream.schema(schema).parquet(base + "/in")
        finish(J.start(stream, base + "/checkpoint", each=each))
    return base + "/listings", version


@check("stream_review_queue", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS listing_id, 'niedrig' AS confidence FROM events WHERE user_id % 3 = 0")
def review_queue(spark, sf_dir):
    """Every id of low confidence is queued once, in whichever batch it came first."""
    folder, version = merged_stream(spark, sf_dir)
    return J.review_queue(spark, folder, version).select("listing_id", "confidence")


@check(
    "stream_track_prices",
    f"""WITH {FOLD_SQL} SELECT listing_id, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen, scan_count, price_current,
      price_prev7, price_changes, CAST(price_changed_on AS VARCHAR) AS price_changed_on
    FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY i DESC) AS rk FROM fold) WHERE rk = 1""",
)
def track_prices(spark, sf_dir):
    """The same fold as a stream over three arrivals, cut inside days and in no order."""
    base = shared_folder(spark)
    columns = (F.col("user_id").cast("string").alias("listing_id"), F.col("ts").alias("scan_ts"), F.col("value").alias("ask_unit"), F.col("event_id").alias("seq"))
    each = J.track_prices(spark, base + "/out", buckets=8)
    for _ in mixed_slices(spark, sf_dir, base, columns):
        stream = spark.readStream.schema("listing_id STRING, scan_ts TIMESTAMP, ask_unit DOUBLE, seq BIGINT").parquet(base + "/in")
        finish(J.start(stream, base + "/checkpoint", each=each))
    return text_dates(J.tracked_prices(spark, base + "/out").drop("status"))


@check(
    "stream_rolling_activity",
    """WITH days AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events),
    spans AS (SELECT event_type AS event_key, CAST(d + CAST(k AS INTEGER) AS DATE) AS until, user_id FROM days, range(1, 8) t(k))
    SELECT event_key, CAST(until AS VARCHAR) AS until, count(DISTINCT user_id) > 0 AS active FROM spans GROUP BY event_key, until""",
)
def rolling_activity(spark, sf_dir):
    """The windows that are closed, completed by one late row per key that moves the watermark."""
    base = shared_folder(spark)
    stream = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events*.parquet").select(
        F.col("ts").alias("seen_ts"), F.col("event_type").alias("event_name"), F.col("user_id").cast("string").alias("listing_id")
    )

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    finish(J.start(J.rolling_activity(stream), base + "/checkpoint", each=keep, mode="update"))
    # an update replaces the window's earlier row
    last = W.partitionBy("event_key", "until").orderBy(F.col("batch").desc())
    out = spark.read.parquet(base + "/out").withColumn("rk", F.row_number().over(last)).where("rk = 1")
    return out.select("event_key", F.date_format("until", "yyyy-MM-dd").alias("until"), (F.col("active") > 0).alias("active"))


@check(
    "stream_active_counts",
    """WITH days AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events),
    spans AS (SELECT event_type AS event_key, CAST(d + CAST(k AS INTEGER) AS DATE) AS until, user_id FROM days, range(1, 8) t(k))
    SELECT event_key, CAST(until AS VARCHAR) AS until, count(DISTINCT user_id) AS active FROM spans GROUP BY event_key, until""",
)
def active_counts(spark, sf_dir):
    """Exact counts of every trailing week, from panes of batches in no order of time."""
    base = shared_folder(spark)
    columns = (F.col("ts").alias("seen_ts"), F.col("event_type").alias("event_name"), F.col("user_id").cast("string").alias("listing_id"))
    each = J.store_activity(spark, base + "/panes")
    for _ in mixed_slices(spark, sf_dir, base, columns):
        stream = spark.readStream.schema("seen_ts TIMESTAMP, event_name STRING, listing_id STRING").parquet(base + "/in")
        finish(J.start(stream, base + "/checkpoint", each=each))
    first, last = table(spark, sf_dir, "events").agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    week = dt.timedelta(days=7)
    out = J.active_counts(spark, base + "/panes", first, last + week)
    return out.select("event_key", F.col("until").cast("string").alias("until"), "active")
