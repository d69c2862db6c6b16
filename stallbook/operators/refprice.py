"""Reference-price resolution per distinct event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallbook import config
from stallbook.functions import text
from stallbook.functions.casting import blank_to_null
from stallbook.functions.keys import ref_price_key, strip


def check_provider_pages(pages: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """Price, availability and provider name of every stored provider page."""
    loaded = F.coalesce(F.col(body) != "", F.lit(False))
    return pages.withColumns(
        {
            "price": F.when(loaded, text.first_price(F.col(body))),
            "sold_out": F.when(loaded, text.availability(F.col(body))).otherwise("unbekannt"),
            "source": F.when(loaded, text.provider_name(F.col(url))),
            "loaded": loaded,
        }
    )


def first_provider_hit(checked: DataFrame, key: str = "event_name") -> DataFrame:
    """Per event the first provider with a price or a sold-out notice.

    The order is the template order. ``min_by`` combines per task first, so an
    event searched on many pages moves one row per task.
    """
    hit = F.col("price").isNotNull() | (F.col("sold_out") == "ja")
    best = F.struct("price", "sold_out", "source")
    return (
        checked.where(F.col("loaded") & hit)
        .groupBy(key)
        .agg(F.min_by(best, F.col("provider_ord")).alias("hit"))
        .select(key, "hit.price", "hit.sold_out", "hit.source")
    )


def resolvable(name: Column) -> Column:
    present = F.coalesce(name, F.lit(""))
    return (present != "") & (present != config.MULTI_EVENT_NAME)


def lookup_ref_prices(
    events: DataFrame,
    store: DataFrame,
    watchlist: DataFrame,
    direct_pages: DataFrame,
    search_hits: DataFrame,
) -> DataFrame:
    """New store entries (key, price, source, sold_out) for events not stored yet.

    ``watchlist(event_name, ref_price, ref_link)``; ``direct_pages`` are checked
    pages by ``url``; ``search_hits`` come from ``first_provider_hit``. Misses
    are entries too, with a NULL price.
    """
    key = ref_price_key(F.col("event_name"), F.col("event_date"))
    wanted = (
        events.where(resolvable(F.col("event_name")))
        .select(key.alias("ref_key"), F.lower(strip(F.col("event_name"))).alias("_name"))
        .distinct()
        .join(store.select("ref_key"), "ref_key", "left_anti")
    )
    # later entries of the same name replace earlier ones
    watched = (
        watchlist.where(F.coalesce("event_name", F.lit("")) != "")
        .groupBy(F.lower(strip(F.col("event_name"))).alias("_name"))
        .agg(F.max_by(F.struct("ref_price", "ref_link"), F.col("line_no")).alias("w"))
        .select(
            "_name",
            F.when(F.col("w.ref_price") != 0, F.col("w.ref_price")).alias("_known"),
            blank_to_null(F.col("w.ref_link")).alias("_link"),
        )
    )
    direct = direct_pages.select(
        F.col("url").alias("_target"), F.col("price").alias("_d_price"),
        F.col("sold_out").alias("_d_sold"), F.col("source").alias("_d_source"),
    )
    found = search_hits.select(
        F.lower(strip(F.col("event_name"))).alias("_name"), F.col("price").alias("_s_price"),
        F.col("sold_out").alias("_s_sold"), F.col("source").alias("_s_source"),
    )
    known, linked = F.col("_known").isNotNull(), F.col("_link").isNotNull()
    # most events have no link: their keys must not meet in one partition
    own_link = F.coalesce("_link", F.concat(F.lit("\u0001"), F.col("ref_key")))
    return (
        wanted.join(watched, "_name", "left")
        .withColumn("_target", own_link)
        .join(direct, "_target", "left")
        .join(found, "_name", "left")
        .select(
            "ref_key",
            F.when(known, F.col("_known"))
            .when(linked, F.col("_d_price"))
            .otherwise(F.col("_s_price"))
            .alias("price"),
            F.when(known, "manuell")
            .when(linked, F.coalesce("_d_source", F.lit("")))
            .otherwise(F.coalesce("_s_source", F.lit("")))
            .alias("source"),
            F.when(known, "unbekannt")
            .when(linked, F.coalesce("_d_sold", F.lit("unbekannt")))
            .otherwise(F.coalesce("_s_sold", F.lit("unbekannt")))
            .alias("sold_out"),
        )
    )


def apply_ref_prices(events: DataFrame, store: DataFrame) -> DataFrame:
    """The stored price wins; else the advert's own price with source 'Anzeige'."""
    entry = store.select(
        "ref_key", F.col("price").alias("_price"), F.col("source").alias("_source"),
        F.col("sold_out").alias("_sold"),
    )
    todo = resolvable(F.col("event_name"))
    own = F.col("ref_price")
    # events without a name to look up must not meet in one partition either
    nobody = F.coalesce("listing_id", F.lit("")) if "listing_id" in events.columns else F.lit("")
    key = F.when(todo, ref_price_key(F.col("event_name"), F.col("event_date"))).otherwise(
        F.concat(F.lit("\u0001"), nobody)
    )
    joined = events.withColumn("ref_key", key).join(entry, "ref_key", "left")
    old_source = F.col("ref_source") if "ref_source" in events.columns else F.lit(None).cast("string")
    old_sold = F.col("sold_out") if "sold_out" in events.columns else F.lit(None).cast("string")
    online = F.col("_price")
    return joined.withColumns(
        {
            "ref_source": F.when(
                todo,
                F.when(online.isNotNull(), F.col("_source"))
                .when(own.isNotNull(), "Anzeige")
                .otherwise(""),
            ).otherwise(old_source),
            "sold_out": F.when(todo, F.coalesce("_sold", F.lit("unbekannt"))).otherwise(old_sold),
            "ref_price": F.when(todo, F.coalesce(online, own)).otherwise(own),
        }
    ).drop("_price", "_source", "_sold", "ref_key")


def resolve_ref_prices(
    events: DataFrame,
    store: DataFrame,
    watchlist: DataFrame,
    direct_pages: DataFrame,
    search_hits: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(events with prices, store including the new entries)."""
    new = lookup_ref_prices(events, store, watchlist, direct_pages, search_hits)
    full = store.unionByName(new)
    return apply_ref_prices(events, full), full
