"""Market dashboard: one row per event, date and category.

Three tables feed it. ``measures`` are counts, extremes and exact decimal sums.
``representatives`` holds the first row of a group. ``value_counts`` counts the distinct values of the
columns that need a median, a mode or a top value; each key carries the value,
so a group with a third of all rows spreads over as many keys as it has values
and is combined per task first.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallbook import config
from stallbook.functions import pricing
from stallbook.functions.casting import no_nan, strict_double
from stallbook.functions.keys import event_key, strip
from stallbook.functions.pricing import exact_mean, fine
from stallbook.operators.pages import first_wins
from stallbook.schemas import DASHBOARD_HEADERS

GROUP = ("event_key", "event_date", "category")
REPRESENTATIVE = (
    "event_name", "venue", "city", "venue_norm", "venue_type", "venue_capacity",
)
SIDES = {"private": config.PRIVATE, "dealer": config.DEALER}
# columns a listing table may lack, with the type of the NULL that stands in
OPTIONAL = {
    "seller_type": "string", "ref_price": "double", "ref_price_manual": "double",
    "confidence": "string", "seller_name": "string", "seller_class": "string",
    "last_seen": "date", "status": "string", "price_current": "double",
    "price_prev7": "double", "event_name": "string", "event_date": "date",
    "category": "string", "venue": "string", "city": "string", "venue_norm": "string",
    "venue_type": "string", "venue_capacity": "int", "verif_status": "string",
    "verif_sources": "array<string>", "ask_unit": "double", "ask_total": "double",
    "quantity": "int",
}


def is_clean_row(columns: list[str]) -> Column:
    """A real event name, a date and, where the column exists, a positive total."""
    name = F.lower(strip(F.coalesce("event_name", F.lit(""))))
    day = strip(F.coalesce(F.col("event_date").cast("string"), F.lit("")))
    clean = ~name.isin(*config.INVALID_EVENT_NAMES) & ~day.isin("", "None")
    if "ask_total" in columns:
        total = strict_double(F.col("ask_total").cast("string"))
        clean = clean & F.coalesce(total > 0, F.lit(False))
    return clean


def drop_junk(listings: DataFrame) -> DataFrame:
    return listings.where(is_clean_row(listings.columns))


def prepare(listings: DataFrame) -> DataFrame:
    """Missing columns as NULL, unit prices filled, seller default, group key."""
    full = listings.select(
        "*",
        *[F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items() if c not in listings.columns],
    )
    doubles = ("ask_unit", "ref_price", "ref_price_manual", "price_current", "price_prev7")
    full = full.withColumns({c: no_nan(F.col(c).cast("double")) for c in doubles})
    unit = pricing.fill_unit_ask(F.col("ask_unit"), F.col("ask_total"), F.col("quantity"))
    return full.withColumns(
        {
            "unit": fine(unit),
            "side": F.coalesce("seller_type", F.lit(config.PRIVATE)),
            "event_key": event_key(F.col("event_name")),
        }
    )


# --- measures: each returns (aggregates, projection over them) ------------------------


def price_stats() -> tuple[list[Column], dict[str, Column]]:
    aggs, out = [F.count("*").alias("n_listings")], {"n_listings": F.col("n_listings")}
    for side, label in SIDES.items():
        price = F.when(F.col("side") == label, F.col("unit"))
        aggs += [
            F.count(price).alias(f"{side}_count"), F.min(price).alias(f"_{side}_min"),
            F.max(price).alias(f"_{side}_max"), F.sum(price).alias(f"_{side}_sum"),
        ]
        out |= {
            f"{side}_count": F.col(f"{side}_count"),
            f"{side}_min": F.round(f"_{side}_min", 2).cast("double"),
            f"{side}_avg": exact_mean(F.col(f"_{side}_sum"), F.col(f"{side}_count")),
            f"{side}_max": F.round(f"_{side}_max", 2).cast("double"),
        }
    return aggs, out


def commercial_share() -> tuple[list[Column], dict[str, Column]]:
    aggs = [
        F.count("*").alias("n_listings"),
        F.count_if(F.col("seller_class") == "gewerblich").alias("_commercial"),
    ]
    return aggs, {
        "n_listings": F.col("n_listings"),
        "commercial_share_pct": percent(F.col("_commercial"), F.col("n_listings")),
    }


def percent(part: Column, whole: Column) -> Column:
    exact = part.cast("decimal(20,0)") * 100
    return F.round(F.try_divide(exact, whole.cast("decimal(20,0)")), 1).cast("double")


def recency(as_of: dt.date) -> tuple[list[Column], dict[str, Column]]:
    """A row without a last sighting counts as past."""
    since = F.lit(as_of - dt.timedelta(days=config.RECENT_DAYS))
    recent = F.coalesce(F.col("last_seen") >= since, F.lit(False))
    aggs = [F.count_if(recent & (F.col("status") == config.ACTIVE)).alias("active_7d")]
    out = {"active_7d": F.col("active_7d")}
    for side, label in SIDES.items():
        for name, when in (("current", recent), ("past", ~recent)):
            price = F.when(when & (F.col("side") == label), F.col("unit"))
            s, n = f"_{side}_{name}_sum", f"_{side}_{name}_n"
            aggs += [F.sum(price).alias(s), F.count(price).alias(n)]
            out[f"{side}_avg_{name}"] = exact_mean(F.col(s), F.col(n))
    return aggs, out


def movement() -> tuple[list[Column], dict[str, Column]]:
    now, then = fine(F.col("price_current")), fine(F.col("price_prev7"))
    aggs = [
        F.sum(now).alias("_now_sum"), F.count(now).alias("_now_n"),
        F.sum(then).alias("_then_sum"), F.count(then).alias("_then_n"),
    ]
    current = exact_mean(F.col("_now_sum"), F.col("_now_n"), 6)
    past = exact_mean(F.col("_then_sum"), F.col("_then_n"), 6)
    return aggs, {"price_movement": pricing.movement_label(current, past)}


def verified_share() -> tuple[list[Column], dict[str, Column]]:
    confirmed = F.col("verif_status").isin(config.VERIFIED, config.LIKELY)
    aggs = [F.count("*").alias("n_listings"), F.count_if(confirmed).alias("_confirmed")]
    return aggs, {"verif_confirmed_pct": percent(F.col("_confirmed"), F.col("n_listings"))}


def representatives(prepared: DataFrame, seq: str = "seq") -> DataFrame:
    """Values of the first row of every group, NULLs included.

    Apart from the measures, which stay a hash aggregate; rows are cut to one per group and task.
    """
    rows = prepared.select(*GROUP, *REPRESENTATIVE, F.col(seq).alias("_seq"))
    return first_wins(rows, list(GROUP), F.col("_seq").asc_nulls_last()).drop("_seq")


def grouped(prepared: DataFrame, *parts: tuple[list[Column], dict[str, Column]]) -> DataFrame:
    """One aggregation for all parts; measures several parts share are computed once."""
    aggs: dict[str, Column] = {}
    out: dict[str, Column] = {}
    for part_aggs, part_out in parts:
        for a in part_aggs:
            aggs.setdefault(str(a), a)
        out |= part_out
    table = prepared.groupBy(*GROUP).agg(*aggs.values())
    return table.select(*GROUP, *[v.alias(k) for k, v in out.items()])


# --- distributions ---------------------------------------------------------------------


def value_counts(prepared: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(group, kind, num, txt, n): how often each value occurs in each group."""

    def entry(kind: str, value: Column, numeric: bool = False) -> Column:
        num = value.cast("double") if numeric else F.lit(None).cast("double")
        txt = F.lit(None).cast("string") if numeric else value.cast("string")
        return F.when(
            value.isNotNull(), F.struct(F.lit(kind).alias("kind"), num.alias("num"), txt.alias("txt"))
        )

    single = {
        "ref": entry("ref", F.col("ref_price"), True),
        "manual": entry("manual", F.col("ref_price_manual"), True),
        "seller": entry("seller", F.col("seller_name")),
        "confidence": entry("confidence", F.col("confidence")),
        "status": entry("status", F.col("verif_status")),
    }
    entries = F.array(*[single[k] for k in kinds if k in single])
    if "source" in kinds:
        names = F.filter(F.transform("verif_sources", strip), lambda s: s != "")
        sources = F.transform(names, lambda s: entry("source", s))
        entries = F.concat(entries, F.coalesce(sources, F.slice(entries, 1, 0)))
    return (
        prepared.select(*GROUP, F.explode(F.array_compact(entries)).alias("v"))
        .select(*GROUP, "v.*")
        .groupBy(*GROUP, "kind", "num", "txt")
        .agg(F.count("*").alias("n"))
    )


def medians(counts: DataFrame) -> DataFrame:
    """Exact median per (group, kind) of the numeric values, from their counts.

    Values are first counted in buckets of a 1024th of their natural logarithm, in ascending order.
    Only the buckets of the middle ranks, two at most, are then ranked value by value: however many
    different prices a group has, no task orders all of them.
    """
    keys = [*GROUP, "kind"]
    # reading n keeps the filter above the aggregation, so both users share its shuffle
    numeric = F.when(F.col("n") > 0, F.col("num")).isNotNull()
    bucket = F.signum("num") * F.rint(F.log1p(F.abs("num")) * 1024)
    values = counts.where(numeric).select(*keys, "num", "n", bucket.alias("bucket"))
    whole = W.partitionBy(*keys)
    upto = whole.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = values.groupBy(*keys, "bucket").agg(F.sum("n").alias("held")).select(
        *keys, "bucket", (F.sum("held").over(upto) - F.col("held")).alias("before"), "held", F.sum("held").over(whole).alias("total")
    )
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = sums.where((F.col("before") < high) & (F.col("before") + F.col("held") >= low)).select(
        *[F.col(c).alias("_m_" + c) for c in (*keys, "bucket")], "before", "total"
    )
    same = F.lit(True)
    for c in (*keys, "bucket"):
        same = same & F.col(c).eqNullSafe(F.col("_m_" + c))
    running = W.partitionBy(*keys, "bucket").orderBy("num").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = values.join(middle, same).select(
        *keys, "num", "total", (F.col("before") + F.sum("n").over(running)).alias("upto"), "n"
    )
    before = F.col("upto") - F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((before < rank) & (F.col("upto") >= rank), F.col("num")))

    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def top_values(counts: DataFrame) -> DataFrame:
    """Most frequent value per (group, kind) and its count; ties take the smallest value."""
    best = F.min_by(F.struct("txt", "n"), F.struct((-F.col("n")).alias("n"), F.col("txt")))
    return (
        counts.where(F.when(F.col("n") > 0, F.col("txt")).isNotNull())
        .groupBy(*GROUP, "kind")
        .agg(best.alias("b"))
        .select(*GROUP, "kind", F.col("b.txt").alias("top"), F.col("b.n").alias("top_n"))
    )


def distributions(counts: DataFrame) -> DataFrame:
    """Medians, modes and tops of a group in one row."""
    nothing = F.lit(None)
    rows = medians(counts).select(
        *GROUP, "kind", "median", nothing.cast("string").alias("top"), nothing.cast("long").alias("top_n")
    ).unionByName(top_values(counts).withColumn("median", nothing.cast("double")))

    def pick(kind: str, value: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(value)))

    return rows.groupBy(*GROUP).agg(
        pick("ref", "median").alias("_ref"), pick("manual", "median").alias("_manual"),
        pick("seller", "top").alias("top_seller"),
        F.coalesce(pick("seller", "top_n"), F.lit(0)).alias("top_seller_count"),
        pick("confidence", "top").alias("confidence_mode"),
        pick("status", "top").alias("verif_status_mode"),
        pick("source", "top").alias("verif_top_source"),
    )


def with_group_ref_price(df: DataFrame) -> DataFrame:
    """Reference price of a group from its medians, and where it came from."""
    ref = pricing.final_ref_price(F.col("_ref"), F.col("_manual"))
    source = pricing.final_ref_source(F.col("_ref"), F.col("_manual"))
    return df.withColumn("ref_price", ref).withColumn(
        "ref_status", pricing.ref_status_label(source)
    )


def with_group_margins(df: DataFrame) -> DataFrame:
    """EUR is price minus reference; percent is the saving, so its sign is opposite."""
    ref = F.col("ref_price")
    for side in SIDES:
        avg = F.col(f"{side}_avg")
        df = df.withColumn(
            f"{side}_margin_abs", F.round(fine(avg) - fine(ref), 2).cast("double")
        ).withColumn(f"{side}_margin_pct", F.try_divide(ref - avg, ref) * 100)
    return df


def join_groups(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the group key, with NULL dates and categories equal to each other."""
    r = right.withColumnsRenamed({c: "_r_" + c for c in GROUP})
    on = F.lit(True)
    for c in GROUP:
        on = on & left[c].eqNullSafe(r["_r_" + c])
    return left.join(r, on, "left").drop(*["_r_" + c for c in GROUP])


def market_dashboard(
    listings: DataFrame, as_of: dt.date, filter_junk: bool = False, seq: str = "seq"
) -> DataFrame:
    """All 36 columns, in the order of the dashboard."""
    rows = prepare(drop_junk(listings) if filter_junk else listings)
    measures = grouped(rows, price_stats(), commercial_share(), recency(as_of), movement(), verified_share())
    measures = join_groups(measures, representatives(rows, seq))
    counts = value_counts(rows, ("ref", "manual", "seller", "confidence", "status", "source"))
    joined = join_groups(measures, distributions(counts))
    full = with_group_margins(with_group_ref_price(joined)).withColumn(
        "top_seller_count", F.coalesce("top_seller_count", F.lit(0))
    )
    return full.select(*DASHBOARD_HEADERS)


def search_dashboard(
    dashboard: DataFrame, search: str = "", sort: str = "", literal: bool = False
) -> DataFrame:
    """Case-insensitive search of the event name (a regular expression unless
    ``literal``) and an ascending sort with NULLs last; unknown columns sort nothing."""
    out = dashboard
    if search:
        name = F.lower("event_name")
        found = name.contains(search.lower()) if literal else name.rlike(search.lower())
        out = out.where(found)
    return out.orderBy(F.col(sort).asc_nulls_last()) if sort in out.columns else out
