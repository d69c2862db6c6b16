"""Extraction responses (free JSON text) → typed, checked, repaired events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from stallbook import config
from stallbook.functions import jsons
from stallbook.functions.casting import half_even_text, strict_date, strict_double, strict_int
from stallbook.functions.jsons import VARIANTS
from stallbook.functions.keys import strip
from stallbook.operators.enrich import with_venue
from stallbook.schemas import EVENT_COLUMNS

_FENCED = r"(?s)```(?:json)?\s*(\[.*?\]|\{.*?\})\s*```"
_FENCED_LIST = r"(?s)```(?:json)?\s*(\[.*?\])\s*```"
_FIRST_LIST = r"(?s)(\[.*?\])"
_FIRST_OBJECT = r"(?s)(\{.*?\})"


def _starts(text: str, char: str) -> Column:
    """A text that is valid JSON is a list or an object by its first character."""
    return F.left(F.col(text), F.lit(1)) == char


def _maybe_json(text: str) -> Column:
    """The text if it can be a list or an object as a whole. Any other is not parsed: a parser that fails costs many times one that succeeds."""
    t = F.col(text)
    return F.when((_starts(text, "[") & t.endswith("]")) | (_starts(text, "{") & t.endswith("}")), t)


def _list_of(text: str, value: str) -> Column:
    """A list as it is, an object as a list of one."""
    v = F.col(value)
    return F.when(_starts(text, "["), jsons.elements(v)).when(
        _starts(text, "{") & v.isNotNull(), F.array(v)
    )


def split_events(
    responses: DataFrame, structured: Column, raw: str = "raw", legacy: bool = False
) -> DataFrame:
    """One row per raw event: adds ``event_no``, ``event`` (VARIANT) and ``failure``.

    The whole text counts first: its ``events`` list, its own list, or the object.
    A structured answer with an empty ``events`` list counts as the object. Free
    text then tries its fenced block, its first list and its first object, one
    match each. ``legacy`` knows lists only and no ``events`` wrapper.

    ``failure`` holds the reason when the response gave nothing usable; the row
    is kept and becomes a default event. A valid empty list gives no row. Every
    text is parsed once, in steps, and a later step only where the earlier ones
    found nothing.
    """
    is_structured = F.lit(False) if legacy else structured
    df = responses.withColumns({"_text": strip(F.col(raw)), "_strict": is_structured})
    df = jsons.with_json(df.withColumn("_whole", _maybe_json("_text")), "_whole", "_json")
    whole = _list_of("_text", "_json")
    if not legacy:
        df = df.withColumn("_events", jsons.field(F.col("_json"), "events", VARIANTS))
        wrapped = F.when(~F.col("_strict") | (F.size("_events") > 0), F.col("_events"))
        whole = F.coalesce(F.when(_starts("_text", "{"), wrapped), whole)
    df = df.withColumn("_items", whole)
    for pattern in (_FENCED_LIST, _FIRST_LIST) if legacy else (_FENCED, _FIRST_LIST, _FIRST_OBJECT):
        open_rows = F.col("_items").isNull() & ~F.col("_strict")
        df = df.withColumn("_part", F.when(open_rows, F.regexp_extract("_text", pattern, 1)))
        df = jsons.with_json(df.withColumn("_whole", _maybe_json("_part")), "_whole", "_json")
        df = df.withColumn("_items", F.coalesce(F.col("_items"), _list_of("_part", "_json")))
    items = F.when(F.col("_text") != "", F.col("_items"))
    if legacy:
        items = F.when(F.size(items) > 0, items)
        reason = F.lit(config.REASON_LEGACY)
    else:
        reason = (
            F.when(F.coalesce(F.col("_text") == "", F.lit(True)), config.REASON_EMPTY)
            .when(F.col("_strict"), config.REASON_STRUCTURED)
            .otherwise(config.REASON_TEXT)
        )
    df = df.withColumn("_items", items).withColumn(
        "failure", F.when(F.col("_items").isNull(), reason)
    )
    usable = F.coalesce("_items", F.array(F.lit(None).cast("variant")))
    return df.select(*responses.columns, "failure", F.posexplode(usable).alias("event_no", "event"))


_EVENT_STRUCT = (
    "struct<event_name:string,event_date:string,venue:string,city:string,category:string,"
    "quantity:variant,ask_total:variant,is_unit_price:variant,ref_price:variant,"
    "confidence:string,confidence_reason:variant>"
)


def coerce_events(df: DataFrame, event: str = "event", failure: str = "failure") -> DataFrame:
    """Typed event columns from a VARIANT; unknown keys drop, missing keys default.

    One cast takes all fields out of an object; anything else casts to NULL.
    """
    rest = [c for c in df.columns if c not in (event, failure)]
    fields = df.withColumn("_o", F.try_variant_get(event, "$", _EVENT_STRUCT))
    mixed = ("quantity", "ask_total", "is_unit_price", "ref_price")
    read = fields.select(
        *rest, failure, "_o",
        *[jsons.kind(F.col(f"_o.{c}")).alias(f"_kind_{c}") for c in mixed],
        *[F.try_variant_get(f"_o.{c}", "$", "string").alias(f"_text_{c}") for c in mixed],
        F.try_variant_get("_o.confidence_reason", "$", "string").alias("_reason"),
    )

    def is_text(name: str) -> Column:
        return F.col(f"_kind_{name}") == "STRING"

    def number(name: str) -> Column:
        return F.when(is_text(name), strict_double(F.col(f"_text_{name}"))).otherwise(
            F.try_variant_get(f"_o.{name}", "$", "double")
        )

    # a JSON number is truncated, a text must be a plain integer
    quantity = F.when(is_text("quantity"), strict_int(F.col("_text_quantity"))).otherwise(
        F.try_variant_get("_o.quantity", "$", "double").try_cast("int")
    )
    flag_text = F.lower("_text_is_unit_price")
    flag = F.when(
        is_text("is_unit_price"),
        F.when(flag_text.isin("true", "ja", "yes"), True).when(
            flag_text.isin("false", "nein", "no"), False
        ),
    ).when(
        F.col("_kind_is_unit_price") == "BOOLEAN", F.try_variant_get("_o.is_unit_price", "$", "boolean")
    )
    category, confidence = F.col("_o.category"), F.col("_o.confidence")
    values = {c: F.col(f"_o.{c}") for c in ("event_name", "event_date", "venue", "city")} | {
        "category": F.when(category.isin(*config.CATEGORIES), category).otherwise("Unbekannt"),
        "quantity": quantity,
        "ask_total": number("ask_total"),
        "is_unit_price": flag,
        "ref_price": number("ref_price"),
        "confidence": F.when(confidence.isin(*config.CONFIDENCES), confidence).otherwise(
            config.LOW_CONFIDENCE
        ),
        # stated as null stays NULL, not stated takes the default
        "confidence_reason": F.when(F.col("_o.confidence_reason").isNotNull(), F.col("_reason"))
        .otherwise(F.coalesce(failure, F.lit(config.REASON_DEFAULT))),
    }
    return read.select(*rest, *[values[c].alias(c) for c in EVENT_COLUMNS])


def check_unit_price(events: DataFrame) -> DataFrame:
    """A stated unit price that only makes sense as a total loses its confidence."""
    total, qty, ref = F.col("ask_total"), F.col("quantity"), F.col("ref_price")
    unit = total / qty
    head = F.concat(
        F.lit("preis_ist_pro_karte=True aber "), half_even_text(total), F.lit("€/"),
        qty.cast("string"), F.lit(" Karten = "), half_even_text(unit), F.lit("€"),
    )
    near_ref = F.concat(
        head, F.lit(" liegt nahe am OVP ("), half_even_text(ref),
        F.lit("€) — wahrscheinlich Gesamtpreis"),
    )
    low = F.concat(head, F.lit(" — wahrscheinlich Gesamtpreis"))
    applies = F.col("is_unit_price") & (qty > 1) & (total > config.PLAUSIBLE_TOTAL)
    reason = F.when(
        applies,
        F.when(ref > 0, F.when(unit <= ref * config.PLAUSIBLE_REF_FACTOR, near_ref)).when(
            unit < config.PLAUSIBLE_UNIT, low
        ),
    )
    return (
        events.withColumn("_why", reason)
        .withColumn(
            "confidence",
            F.when(F.col("_why").isNotNull(), config.LOW_CONFIDENCE).otherwise(F.col("confidence")),
        )
        .withColumn("confidence_reason", F.coalesce("_why", "confidence_reason"))
        .drop("_why")
    )


def repair_dates(events: DataFrame, as_of: dt.date) -> DataFrame:
    """Move a past date of this or last year one year ahead when that makes it upcoming.

    29 February has no counterpart in the next year and stays as it is.
    """
    old = strict_date(F.col("event_date"))
    iso = strip(F.col("event_date"))
    new = F.concat((F.year(old) + 1).cast("string"), F.substring(iso, 5, 6)).try_cast("date")
    moves = (
        (old < F.lit(as_of)) & F.year(old).isin(as_of.year, as_of.year - 1) & (new > F.lit(as_of))
    )
    note = F.concat(
        F.lit("[datum_shift: "), iso, F.lit(" → "), new.cast("string"), F.lit("]")
    )
    return (
        events.withColumn("_note", F.when(moves, note))
        .withColumn("event_date", F.when(moves, new.cast("string")).otherwise(F.col("event_date")))
        .withColumn(
            "confidence_reason",
            F.when(F.col("_note").isNull(), F.col("confidence_reason")).otherwise(
                F.concat_ws(" ", "confidence_reason", "_note")
            ),
        )
        .drop("_note")
    )


def validate_events(split: DataFrame, as_of: dt.date) -> DataFrame:
    """Coerce, check plausibility, repair dates: one projection, no shuffle."""
    return repair_dates(check_unit_price(coerce_events(split)), as_of)


def is_valid_extraction(name: Column, date: Column, total: Column) -> Column:
    """Fit for the dashboard: a real name, a date and a positive total."""
    clean = F.lower(strip(F.coalesce(name, F.lit(""))))
    day = strip(F.coalesce(date.cast("string"), F.lit("")))
    price = strict_double(total.cast("string"))
    return (
        ~clean.isin(*config.INVALID_EVENT_NAMES)
        & ~day.isin("", "None")
        & F.coalesce(price > 0, F.lit(False))
    )


def attach_metadata(
    events: DataFrame, ads: DataFrame, venues: DataFrame, parsed_at: Column | None = None
) -> DataFrame:
    """Advert columns joined back by id; a missing city comes from the venue.

    The venue lookup reads ``events`` a second time, for its distinct names:
    hand in a stored table where they are dear.
    """
    advert = ads.select(
        "listing_id", "listing_url", "seller_type", "seller_name", "seller_id", "member_since",
        "price_raw", "posted_on",
    )
    stamp = F.current_timestamp() if parsed_at is None else parsed_at
    located = with_venue(events, venues, prefix="_v_", with_city=True).join(advert, "listing_id", "left")
    city = F.when(F.coalesce(F.col("city"), F.lit("")) != "", F.col("city"))
    return (
        located.withColumn("city", F.coalesce(city, F.col("_v_city"), F.col("city")))
        .withColumn("parsed_at", stamp)
        .drop("_v_venue_norm", "_v_venue_capacity", "_v_venue_type", "_v_city")
    )
