"""Unit price, margins, reference-price choice and price-movement labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stallbook import config
from stallbook.functions.casting import FINE_MONEY, money


def positive(c: Column) -> Column:
    return F.when(~F.isnan(c) & (c > 0), c)


def unit_ask(ask_total: Column, quantity: Column, is_unit_price: Column) -> Column:
    """Total over quantity in cents; without a quantity only a stated unit price counts."""
    return (
        F.when(quantity > 0, F.round(money(ask_total) / quantity, 2).cast("double"))
        .when(is_unit_price, ask_total)
    )


def fill_unit_ask(ask_unit: Column, ask_total: Column, quantity: Column) -> Column:
    """Dashboard fill: unrounded total / quantity where the unit price is missing."""
    unit = F.when(~F.isnan(ask_unit), ask_unit)
    return F.coalesce(unit, F.when(quantity > 0, ask_total / quantity))


def row_margin_abs(ask_unit: Column, ref_price: Column) -> Column:
    return F.when(
        ref_price > 0, F.round(money(ask_unit) - money(ref_price), 2).cast("double")
    )


def row_margin_pct(ask_unit: Column, ref_price: Column) -> Column:
    """Share of the reference price; positive means dearer than the original."""
    ref = money(positive(ref_price))
    return F.round(F.try_divide((money(ask_unit) - ref) * 100, ref), 1).cast("double")


def needs_review(confidence: Column) -> Column:
    return F.coalesce(confidence == config.LOW_CONFIDENCE, F.lit(False))


def final_ref_price(extracted: Column, manual: Column) -> Column:
    """The manual price wins whenever there is one."""
    return F.coalesce(positive(manual), positive(extracted))


def final_ref_source(
    extracted: Column, manual: Column, conflict_share: float = config.REF_CONFLICT_SHARE
) -> Column:
    e, m = positive(extracted), positive(manual)
    deviation = F.abs(e - m) / F.greatest(e, m)
    return (
        F.when(e.isNull() & m.isNull(), "")
        .when(m.isNull(), "extrahiert")
        .when(e.isNull(), "manuell")
        .when(deviation < conflict_share, "beide_übereinstimmend")
        .otherwise("konflikt")
    )


def ref_status_label(source: Column) -> Column:
    return (
        F.when(source == "", "fehlt ❌")
        .when(source == "extrahiert", "nur extrahiert ⚠")
        .otherwise("manuell gepflegt ✓")
    )


def valid_provider_link(url: Column) -> Column:
    text = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?U)^\s+|\s+$", "")
    return (text == "") | text.rlike("^https?://")


def movement_label(
    current: Column, past: Column, threshold: float = config.MOVEMENT_PCT
) -> Column:
    """📉 / ➡ / 📈 by relative change; the band is inclusive, percent ties go to even."""
    pct = F.try_divide(current - past, F.abs(past)) * 100
    whole = F.bround(pct, 0).try_cast("bigint").cast("string")
    return (
        F.when(pct <= -threshold, F.concat(F.lit("📉 "), whole, F.lit("%")))
        .when(pct >= threshold, F.concat(F.lit("📈 +"), whole, F.lit("%")))
        .otherwise("➡ stabil")
    )


def seller_class(seller_type: Column, seller_name: Column) -> Column:
    """Dealers are commercial; a business word in the name overrides 'private'."""
    kind = F.trim(F.coalesce(seller_type, F.lit("")))
    words = "|".join("\\Q" + w + "\\E" for w in config.BUSINESS_KEYWORDS)
    business = F.lower(F.coalesce(seller_name, F.lit(""))).rlike(words)
    return (
        F.when(kind == config.DEALER, "gewerblich")
        .when(business, "gewerblich")
        .when(kind == config.PRIVATE, "privat")
        .otherwise("unbekannt")
    )


def exact_mean(total: Column, n: Column, digits: int = 2) -> Column:
    """Mean of a decimal sum, rounded half up; NULL for an empty group."""
    return F.round(F.try_divide(total, n.cast("decimal(20,0)")), digits).cast("double")


def fine(c: Column) -> Column:
    return c.try_cast(FINE_MONEY)
