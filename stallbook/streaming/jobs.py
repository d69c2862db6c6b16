"""Incremental versions of the batch jobs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import DataStreamWriter

from stallbook import config
from stallbook.functions.keys import event_key
from stallbook.operators.pages import first_wins
from stallbook.operators.state import PRICE_STATE, _fold, conform, fold_prices, merge_scans, scan_days
from stallbook.schemas import LISTING, REVIEW_COLUMNS
from stallbook.sources.commits import BUCKETS, Run, RunStore
from stallbook.sources.scratch import materialise, shared_folder
from stallbook.sources.tables import (
    RAW_AD_OPTIONS, RAW_AD_TEXT, read_store, read_versions, stored_versions, typed_ads,
)

# --- ingestion --------------------------------------------------------------------------


def stream_ads(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New advert files of a folder, each read once; a line that is not JSON drops out."""
    reader = spark.readStream.schema(RAW_AD_TEXT).options(**RAW_AD_OPTIONS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return typed_ads(reader.json(folder))


def start(
    stream: DataFrame,
    checkpoint: str,
    path: str | None = None,
    each: Callable[[DataFrame, int], None] | None = None,
    every: str | None = None,
    mode: str = "append",
):
    """Starts a stream into Parquet files or a batch function.

    Without ``every`` the query takes all input that is there and stops; with it
    ('360 minutes') it runs on a schedule.
    """
    writer: DataStreamWriter = stream.writeStream.outputMode(mode).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if each is not None:
        return writer.foreachBatch(each).start()
    return writer.format("parquet").option("path", path).start()


def drop_seen(
    ads: DataFrame, key: str = "listing_id", at: str = "scraped_at", within: str = "30 days"
) -> DataFrame:
    """First sighting of every id within the watermark; the state is bounded by it.

    An id that comes back after ``within`` counts as new, and a row that is later than
    that is dropped. ``append_unseen`` has neither limit and is the default choice.
    """
    return ads.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def drop_old(
    ads: DataFrame, posted: str = "posted_ts", days: int = config.MAX_AGE_DAYS,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Watermark for stateful steps downstream, and the exact age filter when a day is given."""
    marked = ads.withWatermark(posted, f"{days} days")
    if as_of is None:
        return marked
    oldest = F.lit(as_of - dt.timedelta(days=days)).cast("timestamp")
    return marked.where(F.col(posted).isNull() | (F.col(posted) >= oldest))


def append_unseen(
    spark: SparkSession, folder: str, key: str = "listing_id", at: str = "scraped_at"
) -> Callable[[DataFrame, int], None]:
    """Exact form of ``drop_seen``: anti join with everything stored before.

    A batch writes its own sub-folder, so a repeated batch replaces itself.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        stored = read_store(spark, folder, batch.schema.simpleString()[7:-1].replace(":", " ") + ", batch BIGINT")
        before = stored.where(F.col("batch") < batch_id)
        new = first_wins(batch, [key], F.col(at)).join(before.select(key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return each


# --- history ------------------------------------------------------------------------------


def snapshot_path(folder: str, batch_id: int) -> str:
    return f"{folder}/version={batch_id}"


def version_before(spark: SparkSession, folder: str, batch_id: int) -> int | None:
    """Newest stored version below a batch; None only for the first batch of a new folder."""
    stored = stored_versions(spark, folder)
    if batch_id == 0 and any(v > 0 for v in stored):
        raise RuntimeError(f"{folder} holds later versions: continue with its checkpoint or take a new folder")
    before = [v for v in stored if v < batch_id]
    if batch_id > 0 and not before:
        raise RuntimeError(f"{folder} has no version before batch {batch_id}")
    return before[-1] if before else None


def _all_days(
    spark: SparkSession, folder: str, new: DataFrame, batch_id: int, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Stores a batch's days; gives (all days of its keys, one row with the newest day of all)."""
    new.write.mode("overwrite").parquet(snapshot_path(folder, batch_id))
    stored = read_versions(spark, folder, batch_id)
    mine = stored.join(spark.read.parquet(snapshot_path(folder, batch_id)).select(*keys).distinct(), list(keys), "left_semi")
    # a day that came in parts counts once; its last scan gives the price
    days = first_wins(mine, [*keys, "scan_date"], F.struct("seq", "version").desc())
    return days, stored.agg(F.max("scan_date").alias("day"))


def merge_each(
    spark: SparkSession, folder: str, venues: DataFrame, keys: Sequence[str] = ("listing_id",)
) -> Callable[[DataFrame, int], None]:
    """History merge per micro-batch.

    The snapshot of batch n is built from the newest one before it and written to
    its own folder: a batch that is repeated after a failure gives the same
    snapshot. All scan days of a batch go into one merge. The days on which a
    key was seen are kept in ``folder``_days, so days that come late, in parts or
    out of order give the history of the days in order; a late day never
    replaces values of a later one. New rows of the review queue are in
    ``folder``_review.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        before = version_before(spark, folder, batch_id)
        empty = spark.createDataFrame([], LISTING)
        table = empty if before is None else spark.read.schema(LISTING).parquet(snapshot_path(folder, before))
        rows = batch.persist()
        days, newest = _all_days(spark, folder + "_days", scan_days(rows, keys), batch_id, keys)
        last_day = newest.first()[0]
        if last_day is not None:
            queue = review_queue(spark, folder, batch_id - 1)
            merge = merge_scans(table, rows, queue, venues, last_day, keys, history=days)
            merge.review_added.write.mode("overwrite").parquet(snapshot_path(folder + "_review", batch_id))
            table = merge.table
        conform(table).write.mode("overwrite").parquet(snapshot_path(folder, batch_id))
        rows.unpersist()

    return each


def review_queue(spark: SparkSession, folder: str, upto: int) -> DataFrame:
    """Review rows that ``merge_each`` has added up to a batch."""
    if not any(v <= upto for v in stored_versions(spark, folder + "_review")):
        return spark.createDataFrame([], ", ".join(f"{c} STRING" for c in REVIEW_COLUMNS))
    return read_versions(spark, folder + "_review", upto).drop("version")


# --- price progression ----------------------------------------------------------------------


PRICES = "listing_id STRING, " + PRICE_STATE.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")


def _next_batch(store: RunStore, batch: DataFrame, batch_id: int, name: str) -> str | None:
    """A digest of the batch if it is the next one of a store, None if it was committed before."""
    digest = str(tuple(batch.agg(F.count("*"), F.bit_xor(F.xxhash64(*batch.columns))).first()))
    entry = store.record()["tables"].get(name, {})
    last = entry.get("batch", -1)
    if batch_id == last and digest == entry["digest"]:
        return None
    if batch_id != last + 1:
        raise RuntimeError(f"{store.folder} stands at batch {last}, not before {batch_id}: continue with its checkpoint or take a new folder")
    return digest


def track_prices(
    spark: SparkSession, folder: str, buckets: int = BUCKETS
) -> Callable[[DataFrame, int], None]:
    """scans(listing_id, scan_ts, ask_unit, seq) per micro-batch → price state per listing.

    The states are a committed table in buckets by listing: a batch reads and writes the
    buckets of its own listings, and their days go on from the stored state. The
    days are kept as well, but read only for listings of the batch with a day that is not
    after their last one: these are folded anew from all their days, so a
    scan may come however late and a day in parts. Nothing expires, a listing that returns after
    any pause goes on where it was. A repeated batch is seen and left out.
    """
    store = RunStore(spark, folder, {"prices": "listing_id"}, buckets)

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        digest = _next_batch(store, rows, batch_id, "prices")
        if digest is not None:
            scans = rows.withColumn("scan_date", F.to_date("scan_ts"))
            new = first_wins(scans, ["listing_id", "scan_date"], F.col("seq").desc()).select(
                "listing_id", "scan_date", "seq", "ask_unit", F.lit(batch_id).alias("batch"))
            tx = store.begin()
            if "prices" not in tx.tables:
                tx.put("prices", spark.createDataFrame([], PRICES))
            new = tx.append("days", new)
            _fold_into(tx, new)
            tx.note("prices", batch=batch_id, digest=digest)
            tx.commit()
        rows.unpersist()

    return each


def _fold_into(tx: Run, new: DataFrame) -> None:
    """Brings the stored states of the listings of ``new`` (days of one batch) up to date."""
    folder = shared_folder(new.sparkSession)
    state = tx.read("prices", tx.touched("prices", new))
    mine = new.groupBy("listing_id").agg(
        F.array_sort(F.collect_list(F.struct("scan_date", "ask_unit"))).alias("days"), F.min("scan_date").alias("day"))
    stored = state.select("listing_id", F.struct(*state.columns[1:]).cast(PRICE_STATE).alias("s"))
    known = materialise(mine.join(stored, "listing_id", "left"), folder + "/known")
    late = known.where("day <= s.last_seen").select("listing_id")
    changed = known.where("s IS NULL OR day > s.last_seen").select("listing_id", _fold(F.col("days"), F.col("s")).alias("s")).select("listing_id", "s.*")
    if not late.isEmpty():
        days = tx.read("days").join(late, "listing_id", "left_semi").withColumn("order", F.struct("seq", "batch"))
        changed = changed.unionByName(fold_prices(days, seq="order"))
    changed = materialise(changed, folder + "/changed").select("listing_id", F.struct(*state.columns[1:]).alias("new"))
    tx.update("prices", new, lambda old: old.select("listing_id", F.struct(*old.columns[1:]).alias("old")).join(
        changed, "listing_id", "full_outer").select("listing_id", F.coalesce("new", "old").alias("s")).select("listing_id", "s.*"))


def tracked_prices(
    spark: SparkSession, folder: str, grace_days: int = config.INACTIVE_GRACE_DAYS
) -> DataFrame:
    """Newest state of every listing; inactive when the newest day of all is past its grace period."""
    states = RunStore(spark, folder).read("prices")
    newest = states.agg(F.max("last_seen")).scalar()
    gone = F.datediff(newest, F.col("last_seen")) >= grace_days
    return states.withColumn("status", F.when(gone, config.INACTIVE).otherwise(config.ACTIVE))


# --- rolling activity ------------------------------------------------------------------------


def rolling_activity(
    sightings: DataFrame, at: str = "seen_ts", days: int = config.RECENT_DAYS, late: str = "1 day"
) -> DataFrame:
    """Listings seen per event in every trailing week, one window per day.

    The count is approximate, which keeps the state of a window small and its
    partial results mergeable.
    """
    return (
        sightings.withWatermark(at, late)
        .groupBy(F.window(at, f"{days} days", "1 day"), event_key(F.col("event_name")).alias("event_key"))
        .agg(F.approx_count_distinct("listing_id", 0.01).alias("active"))
        .select(
            F.col("window.end").alias("until"), "event_key", "active"
        )
    )


def store_activity(
    spark: SparkSession, folder: str, at: str = "seen_ts"
) -> Callable[[DataFrame, int], None]:
    """Daily panes of sightings(event_name, listing_id, ``at``) per micro-batch, for ``active_counts``.

    A batch writes the listings it saw per event and day, one row each, and reads
    nothing that is stored, so its work does not grow with history. A repeated
    batch replaces its own panes; sightings may come however late.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        day = F.to_date(at).alias("day")
        seen = batch.select(event_key(F.col("event_name")).alias("event_key"), "listing_id", day).where("day IS NOT NULL AND listing_id IS NOT NULL")
        seen.distinct().write.mode("overwrite").partitionBy("day").parquet(snapshot_path(folder, batch_id))

    return each


def active_counts(
    spark: SparkSession, folder: str, first: dt.date, last: dt.date, days: int = config.RECENT_DAYS
) -> DataFrame:
    """(event_key, until, active): listings seen in the ``days`` days before each day from ``first`` to ``last``; exact.

    Only the panes of those days are read. A listing counts from the day after a
    sighting until ``days`` later; its sightings are merged to spans without
    overlap, and a running sum over the ends of spans gives the counts of all days.
    Days on which nothing changes are filled; those without an active listing are left out.
    """
    oldest = first - dt.timedelta(days=days)
    panes = spark.read.option("basePath", folder).parquet(*[
        snapshot_path(folder, v) for v in stored_versions(spark, folder)]).where(F.col("day").between(F.lit(oldest), F.lit(last - dt.timedelta(days=1))))
    # as many days as the range has
    seen = panes.groupBy("event_key", "listing_id").agg(F.array_sort(F.collect_set("day")).alias("seen"))
    end = lambda d: F.date_add(d, days + 1)
    spans = F.transform("seen", lambda d, i: F.struct(
        F.date_add(d, 1).alias("start"),
        F.least(end(d), F.coalesce(F.date_add(F.get("seen", i + 1), 1), end(d))).alias("stop")))
    changes = seen.select("event_key", F.explode(spans).alias("s")).select(
        "event_key", F.explode(F.array(
            F.struct(F.greatest("s.start", F.lit(first)).alias("until"), F.lit(1).alias("n")),
            F.struct(F.greatest("s.stop", F.lit(first)).alias("until"), F.lit(-1).alias("n")))).alias("c"))
    steps = changes.groupBy("event_key", "c.until").agg(F.sum("c.n").alias("n"))
    running = W.partitionBy("event_key").orderBy("until")
    levels = steps.select(
        "event_key", "until", F.sum("n").over(running).alias("active"), F.lead("until").over(running).alias("following"))
    through = F.least(F.lit(last), F.date_sub(F.coalesce("following", F.lit(last + dt.timedelta(days=1))), 1))
    return levels.where((F.col("active") > 0) & (F.col("until") <= F.lit(last))).select(
        "event_key", F.explode(F.sequence("until", through)).alias("until"), "active")
