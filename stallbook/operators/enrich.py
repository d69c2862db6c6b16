"""Venue, city and seller dimensions, derived prices, data-quality rules, labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallbook import config
from stallbook.functions import pricing
from stallbook.functions.casting import plain_number, strict_date
from stallbook.functions.keys import strip

VENUE_SCHEMA = (
    "canonical STRING, capacity INT, venue_type STRING, aliases ARRAY<STRING>, city STRING, ord INT"
)


def venue_dimension(spark: SparkSession, venues=config.VENUES) -> DataFrame:
    """The configured venues as a table; ``ord`` breaks ties."""
    return spark.createDataFrame([(*v, i) for i, v in enumerate(venues)], VENUE_SCHEMA)


def resolve_venues(names: DataFrame, venues: DataFrame) -> DataFrame:
    """Venue names → (venue_key, venue_norm, venue_capacity, venue_type, city).

    An exact canonical name or alias wins over an alias contained in the name.
    "Contained" is an equality join as well: every name is cut into its
    substrings of the lengths that occur among the aliases, so no pair of name
    and venue is compared that does not share text.
    """
    labels = (
        venues.withColumn("label", F.explode(F.concat(F.array(F.lower("canonical")), "aliases")))
        .withColumn("is_canonical", F.col("label") == F.lower("canonical"))
        .select("label", "is_canonical", "canonical", "capacity", "venue_type", "city", "ord")
    )
    # one row: the distinct label lengths, a subset of 1..longest label
    lengths = labels.agg(F.array_sort(F.collect_set(F.length("label"))).alias("lens")).scalar()
    keys = names.select(F.lower(strip(F.col("venue"))).alias("venue_key")).where(
        "venue_key <> ''"
    ).distinct()
    pieces = keys.withColumn("_lens", lengths).select(
        "venue_key",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.filter("_lens", lambda n: n <= F.length("venue_key")),
                        lambda n: F.transform(
                            F.sequence(F.lit(1), F.length("venue_key") - n + 1),
                            lambda at: F.substring(F.col("venue_key"), at, n),
                        ),
                    )
                )
            )
        ).alias("label"),
    )
    rank = F.struct(F.when(F.col("label") == F.col("venue_key"), 1).otherwise(2), F.col("ord"))
    hit = F.struct("canonical", "capacity", "venue_type", "city")
    return (
        pieces.join(labels, "label")
        .groupBy("venue_key")
        .agg(F.min_by(hit, rank).alias("hit"))
        .select(
            "venue_key",
            F.col("hit.canonical").alias("venue_norm"),
            F.col("hit.capacity").alias("venue_capacity"),
            F.col("hit.venue_type").alias("venue_type"),
            F.col("hit.city").alias("venue_city"),
        )
    )


#: labels of venues that are looked through within a row; a larger dimension is joined
INLINE_LABELS = 2000


def _labels_of(venues: DataFrame) -> Column:
    """A dimension of a checked size as one value."""
    label = F.explode(F.concat(F.array(F.lower("canonical")), "aliases"))
    return venues.withColumn("label", label).agg(
        F.collect_list(F.struct("label", "ord", "canonical", "capacity", "venue_type", "city"))).scalar()


def _hit_in_row(key: Column, labels: Column) -> Column:
    """What ``resolve_venues`` finds for a name."""
    found = F.filter(labels, lambda v: F.contains(key, v["label"]))
    best = F.array_min(F.transform(found, lambda v: F.struct(
        F.when(v["label"] == key, 1).otherwise(2).alias("rank"), v["ord"].alias("ord"), v["canonical"].alias("venue_norm"),
        v["capacity"].alias("venue_capacity"), v["venue_type"].alias("venue_type"), v["city"].alias("venue_city"))))
    return F.when(key != "", best)


def with_venue(
    df: DataFrame, venues: DataFrame, prefix: str = "", with_city: bool = False
) -> DataFrame:
    """Adds venue_norm, venue_capacity, venue_type (and the venue's city).

    A dimension of INLINE_LABELS names and aliases at most is looked through
    within the row, so ``df`` is read once and not shuffled. A larger one is
    joined on the distinct names of ``df``, which reads it twice.
    """
    found = ("venue_norm", "venue_capacity", "venue_type", "venue_city")
    size = venues.select(F.explode(F.concat(F.array("canonical"), "aliases"))).limit(INLINE_LABELS + 1).count()
    if size <= INLINE_LABELS:
        hit = F.col("_hit")
        # a column of its own: written into the search, the key would be made anew for every label
        joined = df.withColumns({"_labels": _labels_of(venues), "_key": F.lower(strip(F.col("venue")))}).withColumn(
            "_hit", _hit_in_row(F.col("_key"), F.col("_labels"))
        ).withColumns({"_k_" + c: hit[c] for c in found}).drop("_hit", "_labels", "_key")
    else:
        known = resolve_venues(df, venues).withColumnRenamed("venue_key", "_venue_key")
        known = known.withColumnsRenamed({c: "_k_" + c for c in found})
        joined = df.withColumn("_venue_key", F.lower(strip(F.col("venue")))).join(known, "_venue_key", "left").drop("_venue_key")
    raw = strip(F.col("venue"))
    named = raw != ""
    out = {
        "venue_norm": F.when(named, F.coalesce("_k_venue_norm", raw)),
        "venue_capacity": F.when(named, F.col("_k_venue_capacity")),
        "venue_type": F.when(
            named,
            F.when(F.col("_k_venue_norm").isNull(), config.UNKNOWN_VENUE_TYPE).otherwise(
                F.col("_k_venue_type")
            ),
        ),
    }
    if with_city:
        out["city"] = F.when(named, F.col("_k_venue_city"))
    return joined.withColumns({prefix + k: v for k, v in out.items()}).drop(*["_k_" + c for c in found])


def with_venue_city(df: DataFrame, venues: DataFrame) -> DataFrame:
    """City of a normalised venue; NULL when the venue is not in the dimension."""
    cities = venues.select(
        F.col("canonical").alias("venue_norm"), F.col("city").alias("venue_city")
    )
    return df.join(cities, "venue_norm", "left")


def conflicts(as_of: dt.date) -> Column:
    """Messages of the broken data-quality rules, in rule order."""
    total, qty, ref = F.col("ask_total"), F.col("quantity"), F.col("ref_price")
    day = F.col("event_date").cast("string")
    blank = F.lit("")

    def missing(c: Column) -> Column:
        return strip(F.coalesce(c, blank)) == ""

    rules = (
        F.when(
            (total > 0) & (qty.isNull() | (qty == 0)),
            F.concat(
                F.lit("PREIS_LOGIK: gesamt="), plain_number(total), F.lit(" aber anzahl_karten="),
                F.coalesce(qty.cast("string"), F.lit("None")),
            ),
        ),
        F.when(strict_date(day) < F.lit(as_of), F.concat(F.lit("DATUM_VERGANGENHEIT: "), day)),
        F.when(
            (ref > 0) & missing(F.col("ref_source")),
            F.concat(F.lit("OVP_INKONSISTENZ: ovp="), plain_number(ref), F.lit(" aber quelle leer")),
        ),
        F.when(total > 5000, F.concat(F.lit("PREIS_ZU_HOCH: "), plain_number(total))),
        F.when(
            F.lower(strip(F.coalesce("event_name", blank))).isin(*config.INVALID_EVENT_NAMES),
            "NAME_FEHLT",
        ),
        F.when(
            (F.col("confidence") == config.LOW_CONFIDENCE) & missing(F.col("confidence_reason")),
            "CONFIDENCE_NIEDRIG_KEIN_GRUND",
        ),
    )
    return F.array_compact(F.array(*rules))


def conflict_report(df: DataFrame) -> DataFrame:
    """Rows per broken rule."""
    return (
        df.select(F.explode("conflicts").alias("message"))
        .groupBy(F.substring_index("message", ":", 1).alias("rule"))
        .agg(F.count("*").alias("n"))
    )


def with_prices(df: DataFrame) -> DataFrame:
    """ask_unit, margins and needs_review."""
    unit = pricing.unit_ask(F.col("ask_total"), F.col("quantity"), F.col("is_unit_price"))
    priced = df.withColumn("ask_unit", unit)
    return priced.withColumns(
        {
            "margin_abs": pricing.row_margin_abs(F.col("ask_unit"), F.col("ref_price")),
            "margin_pct": pricing.row_margin_pct(F.col("ask_unit"), F.col("ref_price")),
            "needs_review": pricing.needs_review(F.col("confidence")),
        }
    )


def enrich(events: DataFrame, venues: DataFrame, as_of: dt.date) -> DataFrame:
    """Every derived column of a scan batch."""
    priced = with_prices(events).withColumns(
        {
            "seller_class": pricing.seller_class(F.col("seller_type"), F.col("seller_name")),
            "conflicts": conflicts(as_of),
        }
    )
    return with_venue(priced, venues)


def with_final_ref_price(df: DataFrame) -> DataFrame:
    """Manual against extracted reference price, with where the choice came from."""
    extracted, manual = F.col("ref_price"), F.col("ref_price_manual")
    return df.withColumns(
        {
            "ref_final": pricing.final_ref_price(extracted, manual),
            "ref_final_source": pricing.final_ref_source(extracted, manual),
        }
    )


def quality_labels(df: DataFrame) -> DataFrame:
    """Row labels: origin of the reference price, confidence, final source, verification."""
    source = F.coalesce("ref_source", F.lit(""))
    no_price = F.coalesce(F.col("ref_price") == 0, F.lit(True))
    final = F.coalesce("ref_final_source", F.lit(""))
    status = F.col("verif_status")
    return df.withColumns(
        {
            "ref_label": F.when(source.isin(*config.CONFIRMED_PROVIDERS), "provider")
            .when(source == "Anzeige", "listing")
            .when(no_price, "missing"),
            "confidence_label": F.when(
                F.col("confidence").isin(*config.CONFIDENCES), F.col("confidence")
            ),
            "final_label": F.when(final == "konflikt", "konflikt")
            .when(final == "extrahiert", "extrahiert")
            .when(final.isin("manuell", "beide_übereinstimmend"), "manuell")
            .otherwise("fehlt"),
            "verif_label": F.when(
                status.isin(
                    config.VERIFIED, config.LIKELY, config.UNVERIFIED, config.FAILED, config.SKIPPED
                ),
                status,
            ),
        }
    )


def label_counts(labelled: DataFrame) -> DataFrame:
    """Rows per (label kind, label)."""
    kinds = ("ref_label", "confidence_label", "final_label", "verif_label")
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("label")) for k in kinds])
    return (
        labelled.select(F.explode(pairs).alias("p"))
        .groupBy("p.kind", "p.label")
        .agg(F.count("*").alias("n"))
    )
