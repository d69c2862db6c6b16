"""Keyed state: dedup, merges with history, lifecycle, review, archive, trash.

Plain Parquet has no MERGE, so a merge is one full outer join of the stored
snapshot with the batch and the result is written as a new snapshot version.
Both sides have one row per key at that point, so a hot key cannot grow a
partition; what a hot key repeats within a batch is cut per task before the
shuffle.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stallbook import config
from stallbook.functions import pricing
from stallbook.functions.keys import strip
from stallbook.operators.dashboard import is_clean_row
from stallbook.operators.enrich import enrich
from stallbook.operators.pages import first_wins
from stallbook.schemas import LISTING_TYPES, REVIEW_COLUMNS

KEY = ("listing_id",)
SCAN_KEEP = config.SCAN_POLICY.keep + config.HISTORY_COLUMNS
#: what the review queue takes of a merged row; NULL for most
QUEUED = "_queued"


def _not_blank(key: str) -> Column:
    return F.coalesce(strip(F.col(key).cast("string")) != "", F.lit(False))


def last_wins(df: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """One row per key, the last by ``seq``; rows with a blank key drop out."""
    rows = df
    for k in keys:
        rows = rows.where(_not_blank(k))
    return first_wins(rows, list(keys), F.col(seq).desc())


def dedup_table(df: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(table with the last row per key, one-row count of removed rows)."""
    rows = df
    for k in keys:
        rows = rows.where(_not_blank(k))
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    removed = per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed"))
    return last_wins(df, keys, seq), removed


# --- price progression -----------------------------------------------------------------


def price_step(
    current: Column, changed_on: Column, first_seen: Column, prev7: Column, changes: Column,
    price: Column, day: Column,
) -> dict[str, Column]:
    """State after one more price. A missing price changes nothing.

    The old price moves to ``price_prev7`` when it was at least a week old; its
    age counts from the last change, else from the first sighting.
    """
    first = price.isNotNull() & current.isNull()
    changed = price.isNotNull() & current.isNotNull() & (F.abs(current - price) >= config.PRICE_NOOP)
    age = F.coalesce(F.datediff(day, F.coalesce(changed_on, first_seen)), F.lit(0))
    return {
        "price_current": F.when(first | changed, price).otherwise(current),
        "price_prev7": F.when(changed & (age >= config.PRICE_HISTORY_DAYS), current).otherwise(prev7),
        "price_changes": F.when(changed, F.coalesce(changes, F.lit(0)) + 1).otherwise(changes),
        "price_changed_on": F.when(first | changed, day).otherwise(changed_on),
    }


PRICE_STATE = (
    "struct<first_seen:date,last_seen:date,scan_count:int,price_current:double,"
    "price_prev7:double,price_changes:int,price_changed_on:date>"
)


def daily_prices(scans: DataFrame, seq: str = "seq") -> DataFrame:
    """Last price per listing and day."""
    return first_wins(scans, ["listing_id", "scan_date"], F.col(seq).desc()).select(
        "listing_id", "scan_date", "ask_unit"
    )


def fold_prices(scans: DataFrame, seq: str = "seq") -> DataFrame:
    """Price state of every listing after all its scans, in date order.

    The step depends on the state before it, so it is a fold over the listing's
    days. Scans reduce to one price per day first: the list that is folded is
    bounded by the calendar, however often a listing was seen.
    """
    history = F.array_sort(F.collect_list(F.struct("scan_date", "ask_unit")))
    return (
        daily_prices(scans, seq)
        .groupBy("listing_id")
        .agg(history.alias("history"))
        .select("listing_id", _fold(F.col("history"), F.lit(None).cast(PRICE_STATE)).alias("s"))
        .select("listing_id", "s.*")
    )


def _fold(history: Column, start: Column) -> Column:
    """``start`` (a PRICE_STATE, NULL for a new listing) after the days of ``history``."""

    def step(s: Column, x: Column) -> Column:
        day, price = x["scan_date"], x["ask_unit"]
        moved = price_step(
            s["price_current"], s["price_changed_on"], s["first_seen"], s["price_prev7"],
            s["price_changes"], price, day,
        )
        new = F.struct(
            day.alias("first_seen"), day.alias("last_seen"), F.lit(1).alias("scan_count"),
            price.alias("price_current"), F.lit(None).cast("double").alias("price_prev7"),
            F.lit(0).alias("price_changes"), day.alias("price_changed_on"),
        ).cast(PRICE_STATE)
        # the day of the last scan again is no further scan
        again = F.when(day > s["last_seen"], 1).otherwise(0)
        old = F.struct(
            s["first_seen"].alias("first_seen"), day.alias("last_seen"),
            (s["scan_count"] + again).alias("scan_count"), *[c.alias(k) for k, c in moved.items()],
        ).cast(PRICE_STATE)
        return F.when(s.isNull(), new).otherwise(old)

    return F.aggregate(history, start, step)


# --- merges --------------------------------------------------------------------------------


def _both(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join with columns as structs ``e`` and ``b`` (NULL when absent)."""
    e = existing.select(*keys, F.struct(*existing.columns).alias("e"))
    b = batch.select(*keys, F.struct(*batch.columns).alias("b"))
    return e.join(b, list(keys), "full_outer")


def _merged(existing: DataFrame, batch: DataFrame, policy: config.MergePolicy) -> dict[str, Column]:
    """Value of every column of either side under the policy."""
    in_e, in_b = F.col("e").isNotNull(), F.col("b").isNotNull()
    out: dict[str, Column] = {}
    for c in [*existing.columns, *[x for x in batch.columns if x not in existing.columns]]:
        if c not in batch.columns:
            out[c] = F.col(f"e.{c}")
        elif c not in existing.columns:
            out[c] = F.col(f"b.{c}")
        elif c in policy.keep:
            out[c] = F.when(in_e, F.col(f"e.{c}")).otherwise(F.col(f"b.{c}"))
        elif c in policy.fill:
            old = F.col(f"e.{c}")
            if dict(existing.dtypes)[c] == "string":
                old = F.when(old != "", old)
            out[c] = F.coalesce(old, F.col(f"b.{c}"))
        else:
            out[c] = F.when(in_b, F.col(f"b.{c}")).otherwise(F.col(f"e.{c}"))
    return out


def _action() -> Column:
    return (
        F.when(F.col("b").isNull(), "kept").when(F.col("e").isNull(), "inserted").otherwise("updated")
    )


@dataclass(frozen=True)
class Merge:
    """Result of a merge: the new table with an ``action`` column, and new review rows."""

    rows: DataFrame
    review_added: DataFrame

    @property
    def table(self) -> DataFrame:
        return self.rows.drop("action")

    def counts(self) -> DataFrame:
        """(action, n) for inserted, updated and review_added."""
        merged = self.rows.where("action <> 'kept'").groupBy("action").agg(F.count("*").alias("n"))
        review = self.review_added.agg(F.count("*").alias("n")).select(
            F.lit("review_added").alias("action"), "n"
        )
        return merged.union(review)


def review_additions(batch: DataFrame, review: DataFrame) -> DataFrame:
    """Low-confidence rows whose id is not queued yet."""
    low = batch.where(F.col("confidence") == config.LOW_CONFIDENCE)
    return low.join(review.select("listing_id"), "listing_id", "left_anti").select(*_review_columns(batch))


def _review_columns(batch: DataFrame, prefix: str = "") -> list[Column]:
    return [
        (F.col(prefix + c) if c in batch.columns else F.lit(None).cast("string")).alias(c)
        for c in REVIEW_COLUMNS
    ]


def queued_additions(stored: DataFrame, review: DataFrame) -> DataFrame:
    """``review_additions`` from the stored rows of a merge with ``queue``: the batch is not made a second time.

    The batch has one row per id; stored copies of an id carry that row each.
    """
    low = stored.where(F.col(QUEUED).isNotNull()).select(QUEUED + ".*").dropDuplicates(["listing_id"])
    return low.join(review.select("listing_id"), "listing_id", "left_anti").select(*REVIEW_COLUMNS)


def upsert(
    existing: DataFrame,
    batch: DataFrame,
    review: DataFrame,
    policy: config.MergePolicy = config.UPSERT_POLICY,
    seq: str = "seq",
) -> Merge:
    """Generic upsert: the last row of the batch wins, except ``fill`` columns.

    Those take the stored value, else the first one in batch order, as if the
    rows had been applied one after the other.
    """
    rows = batch.where(_not_blank("listing_id"))
    fills = [c for c in policy.fill if c in batch.columns]
    latest = last_wins(rows, seq=seq)
    if fills:
        kinds = dict(batch.dtypes)

        def present(c: str) -> Column:
            return F.col(c) != "" if kinds[c] == "string" else F.col(c).isNotNull()

        firsts = rows.groupBy("listing_id").agg(
            *[F.min_by(c, F.when(present(c), F.col(seq))).alias(c) for c in fills]
        )
        latest = latest.drop(*fills).join(firsts, "listing_id")
    latest = latest.drop(seq)
    first_low = first_wins(
        rows.where(F.col("confidence") == config.LOW_CONFIDENCE), ["listing_id"], F.col(seq)
    )
    merged = _merged(existing, latest, policy)
    out = _both(existing, latest, KEY).select(
        *[v.alias(k) for k, v in merged.items()], _action().alias("action")
    )
    return Merge(out, review_additions(first_low, review))


def merge_history(
    existing: DataFrame,
    batch: DataFrame,
    review: DataFrame,
    scan_date: dt.date,
    policy: config.MergePolicy = config.SCAN_POLICY,
    keys: Sequence[str] = KEY,
    grace_days: int = config.INACTIVE_GRACE_DAYS,
    queue: bool = False,
) -> Merge:
    """One scan into the listing history. ``batch`` is enriched, one row per key.

    Seen listings become active and take one price step; listings that were not
    seen turn inactive after the grace period, sold ones stay sold. With ``queue`` the rows
    carry what the review queue takes of them, for ``queued_additions``.
    """
    day = F.lit(scan_date)
    plain = config.MergePolicy(keep=policy.keep + config.HISTORY_COLUMNS, fill=policy.fill)
    stamped = batch.withColumn("scan_date", day).withColumn("watchlist", F.lit("nein"))
    merged = _merged(existing, stamped, plain)
    in_e, in_b = F.col("e").isNotNull(), F.col("b").isNotNull()
    price = F.col("b.ask_unit")
    step = price_step(
        F.col("e.price_current"), F.col("e.price_changed_on"), F.col("e.first_seen"),
        F.col("e.price_prev7"), F.col("e.price_changes"), price, day,
    )
    initial = {
        "price_current": price, "price_prev7": F.lit(None).cast("double"),
        "price_changes": F.lit(0), "price_changed_on": day,
    }
    for c in step:
        merged[c] = (
            F.when(~in_b, F.col(f"e.{c}")).when(in_e, step[c]).otherwise(initial[c])
        )
    merged["first_seen"] = F.when(in_e, F.col("e.first_seen")).otherwise(day)
    merged["last_seen"] = F.when(in_b, day).otherwise(F.col("e.last_seen"))
    merged["scan_count"] = F.when(in_b, F.coalesce("e.scan_count", F.lit(0)) + 1).otherwise(
        F.col("e.scan_count")
    )
    merged["status"] = inactive_status(
        F.col("e.status"), F.col("e.last_seen"), in_b, scan_date, grace_days, sold_is_final=False
    )
    if queue:
        merged[QUEUED] = F.when(F.col("b.confidence") == config.LOW_CONFIDENCE, F.struct(*_review_columns(batch, "b.")))
    out = _both(existing, stamped, keys).select(
        *[v.alias(k) for k, v in merged.items()], _action().alias("action")
    )
    return Merge(out, review_additions(batch, review))


def apply_scan(
    existing: DataFrame,
    events: DataFrame,
    review: DataFrame,
    venues: DataFrame,
    scan_date: dt.date,
    keys: Sequence[str] = KEY,
    seq: str = "seq",
    queue: bool = False,
) -> Merge:
    """Dedup → enrich → history merge with inactive marking → review queue."""
    batch = enrich(last_wins(events, keys, seq).drop(seq), venues, scan_date)
    return merge_history(existing, batch, review, scan_date, keys=keys, queue=queue)


def scan_days(scans: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """(keys, scan_date, seq, ask_unit): the last scan of every day on which a key was seen."""
    rows = scans
    for k in keys:
        rows = rows.where(_not_blank(k))
    unit = pricing.unit_ask(F.col("ask_total"), F.col("quantity"), F.col("is_unit_price"))
    daily = first_wins(rows, [*keys, "scan_date"], F.col(seq).desc())
    return daily.select(*keys, "scan_date", F.col(seq).alias("seq"), unit.alias("ask_unit"))


def merge_scans(
    existing: DataFrame,
    scans: DataFrame,
    review: DataFrame,
    venues: DataFrame,
    last_day: dt.date,
    keys: Sequence[str] = KEY,
    seq: str = "seq",
    grace_days: int = config.INACTIVE_GRACE_DAYS,
    history: DataFrame | None = None,
) -> Merge:
    """Several scan days at once: the result of ``apply_scan`` day after day, in one merge.

    ``scans`` has a ``scan_date``. The rows of a key reduce to its last per day;
    its days fold over the stored price state, and its last row gives the rest
    unless the stored row is of a later day.

    ``history`` (keys, scan_date, ask_unit) holds all days of the keys of
    ``scans``, these scans included. The price state is then folded anew, so days
    may come in any order and in parts. Without it, days before the stored
    ``last_seen`` change nothing.
    """
    rows = scans
    for k in keys:
        rows = rows.where(_not_blank(k))
    daily = first_wins(rows, [*keys, "scan_date"], F.col(seq).desc())
    seen = scan_days(rows, keys, seq) if history is None else history
    days = seen.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("scan_date", "ask_unit"))).alias("_days")
    )
    low = first_wins(daily.where(F.col("confidence") == config.LOW_CONFIDENCE), list(keys), F.col("scan_date"))
    latest = first_wins(daily, list(keys), F.col("scan_date").desc()).drop(seq)
    batch = enrich(latest, venues, last_day).withColumn("watchlist", F.lit("nein"))
    plain = config.MergePolicy(keep=SCAN_KEEP)
    merged = _merged(existing, batch, plain)
    in_e, in_b = F.col("e").isNotNull(), F.col("b").isNotNull()
    start = F.when(
        in_e,
        F.struct(
            "e.first_seen", "e.last_seen", F.coalesce("e.scan_count", F.lit(0)).alias("scan_count"),
            "e.price_current", "e.price_prev7", "e.price_changes", "e.price_changed_on",
        ).cast(PRICE_STATE),
    )

    def older(day: Column) -> Column:
        return F.coalesce(day < F.col("e.last_seen"), F.lit(False))

    joined = _both(existing, batch.join(days, list(keys)), keys).withColumn(
        "_s", F.when(in_b, _fold(F.col("b._days"), F.lit(None).cast(PRICE_STATE)))
        if history is not None
        else F.when(in_b, _fold(F.filter("b._days", lambda d: ~older(d["scan_date"])), start))
    )
    for c in existing.columns:
        if c not in config.HISTORY_COLUMNS:
            merged[c] = F.when(in_b & older(F.col("b.scan_date")), F.col(f"e.{c}")).otherwise(merged[c])
    for c in config.HISTORY_COLUMNS:
        if c != "status":
            merged[c] = F.when(in_b, F.col(f"_s.{c}")).otherwise(F.col(f"e.{c}"))
    gone = F.datediff(F.lit(last_day), F.col("_s.last_seen")) >= grace_days
    merged["status"] = F.when(in_b, F.when(gone, config.INACTIVE).otherwise(config.ACTIVE)).otherwise(
        inactive_status(F.col("e.status"), F.col("e.last_seen"), F.lit(False), last_day, grace_days)
    )
    out = joined.select(*[v.alias(k) for k, v in merged.items()], _action().alias("action"))
    return Merge(out, review_additions(low, review))


def inactive_status(
    status: Column, last_seen: Column, seen: Column, scan_date: dt.date,
    grace_days: int = config.INACTIVE_GRACE_DAYS, sold_is_final: bool = True,
) -> Column:
    """Status after a scan. Sold wins over seen only where the merge has not run before."""
    rule = F.when(status == config.SOLD, status) if sold_is_final else None
    rule = F.when(seen, config.ACTIVE) if rule is None else rule.when(seen, config.ACTIVE)
    if not sold_is_final:
        rule = rule.when(status == config.SOLD, status)
    gone = F.datediff(F.lit(scan_date), last_seen) >= grace_days
    return rule.when(gone, config.INACTIVE).otherwise(status)


def mark_inactive(
    listings: DataFrame, current_ids: DataFrame, scan_date: dt.date,
    grace_days: int = config.INACTIVE_GRACE_DAYS,
) -> DataFrame:
    """Status update of a whole table against the ids of the current scan."""
    ids = current_ids.select("listing_id").distinct().withColumn("_seen", F.lit(True))
    status = inactive_status(
        F.col("status"), F.col("last_seen"), F.coalesce("_seen", F.lit(False)), scan_date, grace_days
    )
    return listings.join(ids, "listing_id", "left").withColumn("status", status).select(
        *listings.columns
    )


def update_rows(
    existing: DataFrame, updates: DataFrame, policy: config.MergePolicy = config.PARTIAL_POLICY
) -> DataFrame:
    """Overwrites the columns present in ``updates`` (one row per id), except protected ones."""
    fields = [c for c in updates.columns if c != "listing_id" and c not in policy.keep]
    new = updates.select("listing_id", F.struct(*fields).alias("_u"))
    joined = existing.join(new, "listing_id", "left")
    for c in fields:
        old = F.col(c) if c in existing.columns else F.lit(None).cast(dict(updates.dtypes)[c])
        joined = joined.withColumn(c, F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(old))
    return joined.drop("_u")


def update_ref_prices(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Point updates: price only when given, source and sold_out always."""
    new = updates.select("listing_id", F.struct("ref_price", "ref_source", "sold_out").alias("_u"))
    hit = F.col("_u").isNotNull()
    return (
        existing.join(new, "listing_id", "left")
        .withColumn("ref_price", F.coalesce("_u.ref_price", "ref_price"))
        .withColumn("ref_source", F.when(hit, F.col("_u.ref_source")).otherwise(F.col("ref_source")))
        .withColumn("sold_out", F.when(hit, F.col("_u.sold_out")).otherwise(F.col("sold_out")))
        .withColumn("updated", hit)
        .drop("_u")
    )


# --- lifecycle ------------------------------------------------------------------------------


def archive_additions(
    listings: DataFrame, archive: DataFrame, as_of: dt.date, days: int = config.ARCHIVE_AFTER_DAYS,
    cutoff: dt.date | None = None,
) -> DataFrame:
    """Rows of past events to append to the archive, each id once; the table keeps them."""
    limit = cutoff or as_of - dt.timedelta(days=days)
    old = listings.where(F.col("event_date") < F.lit(limit))
    return old.join(archive.select("listing_id"), "listing_id", "left_anti").withColumn(
        "archived_on", F.lit(as_of)
    )


@dataclass(frozen=True)
class TrashSplit:
    kept: DataFrame
    moved: DataFrame

    def counts(self) -> DataFrame:
        """One row: moved, kept."""
        tag = F.lit
        both = self.moved.select(tag(1).alias("m")).union(self.kept.select(tag(0).alias("m")))
        return both.agg(
            F.count_if(F.col("m") == 1).alias("moved"), F.count_if(F.col("m") == 0).alias("kept")
        )


def split_trash(listings: DataFrame, trash: DataFrame, seq: str = "seq") -> TrashSplit:
    """Junk rows leave the table; an id with one clean row keeps all its rows.

    ``moved`` has one row per junk id that the trash does not hold yet.
    """
    rows = listings.where(F.col("listing_id").isNotNull())
    clean = rows.where(is_clean_row(rows.columns)).select("listing_id").distinct()
    junk = rows.join(clean, "listing_id", "left_anti")
    new = first_wins(junk, ["listing_id"], F.col(seq)).join(
        trash.select("listing_id"), "listing_id", "left_anti"
    )
    return TrashSplit(rows.join(clean, "listing_id", "left_semi"), new)


def conform(df: DataFrame, types: dict[str, str] = LISTING_TYPES) -> DataFrame:
    """Exactly the columns of ``types``, in order; missing ones become NULL."""
    return df.select(
        *[
            (F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c)
            for c, t in types.items()
        ]
    )
