"""Text rules over advert bodies and provider pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from stallbook import config
from stallbook.functions.casting import blank_to_null
from stallbook.functions.keys import strip

_I = "(?iU)"  # ignore case, Unicode classes and word boundaries


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def any_of(words: Sequence[str]) -> str:
    """Regular expression that finds any of the literal words."""
    return "|".join("\\Q" + w + "\\E" for w in words)


def strip_nav_prefix(text: Column, keywords: Sequence[str] = config.NAV_KEYWORDS) -> Column:
    """Drop the leading block of navigation lines and counters.

    One block is blank lines followed by a navigation or number line; the body
    starts after the last such block, and only line feeds are trimmed from it.
    The quantifiers are possessive, so a block of any length matches in a loop.
    """
    blank = r"(?:[^\S\n]*+\n)*+"
    navigation = r"[^\n]*(?:" + any_of(keywords) + r")[^\n]*+"
    number = r"[^\S\n]*+[\d.,](?:[\d.,]|[^\S\n])*+"
    block = f"{blank}(?:{navigation}|{number}(?=\\n|\\z))(?:\\n|\\z)"
    return F.regexp_replace(text, f"(?iU)\\A(?:(?:{block})++\\n*+|\\n++)", "")


def main_description(text: Column, marker: str = config.SIMILAR_ADS_MARKER) -> Column:
    """Body without navigation, cut at the list of similar adverts."""
    return F.get(F.split(strip_nav_prefix(text), _I + marker, 2), F.lit(0))


def is_category_page(title: Column, body: Column) -> Column:
    """Overview pages: counting title, empty body, or nothing that looks like an offer."""
    stripped = strip_nav_prefix(text_or_empty(body))
    return (
        text_or_empty(title).rlike(_I + config.CATEGORY_TITLE)
        | stripped.rlike(r"(?U)^\s*\z")
        | ~stripped.rlike(_I + config.CONTENT_HINT)
    )


def is_category_page_extended(
    title: Column, body: Column, listing_id: Column, seller_id: Column
) -> Column:
    anonymous = (text_or_empty(listing_id) == "") & (text_or_empty(seller_id) == "")
    return is_category_page(title, body) | (anonymous & (strip(text_or_empty(title)) == ""))


def is_non_ticket(title: Column, body: Column) -> Column:
    """No event word in the title or the main description."""
    text = F.concat(text_or_empty(title), F.lit("\n"), main_description(text_or_empty(body)))
    return ~text.rlike(_I + config.EVENT_KEYWORDS)


def scrub_injections(text: Column) -> Column:
    return F.regexp_replace(text, "(?iUmd)" + config.INJECTION, config.SCRUBBED)


def build_context(
    title: Column, price_raw: Column, body: Column, max_chars: int | None = None
) -> Column:
    """Model input: title, price, body. The body is whole, or cut first and scrubbed after
    where a model needs a bound (``config.CONTEXT_CHARS``)."""
    cut = _upto(strip_nav_prefix(text_or_empty(body)), max_chars)
    return F.concat(
        F.lit("Titel: "), scrub_injections(text_or_empty(title)),
        F.lit("\nPreis: "), text_or_empty(price_raw),
        F.lit("\n\nBeschreibung:\n"), scrub_injections(cut),
    )


def build_context_v1(
    title: Column, price_raw: Column, body: Column, max_chars: int | None = None
) -> Column:
    """Older model input: nothing is stripped or scrubbed."""
    return F.concat(
        F.lit("Titel: "), text_or_empty(title), F.lit("\nPreis: "), text_or_empty(price_raw),
        F.lit("\n\n"), _upto(text_or_empty(body), max_chars),
    )


def _upto(text: Column, max_chars: int | None) -> Column:
    return text if max_chars is None else F.substring(text, 1, max_chars)


def build_prompt(context: Column, template: str) -> Column:
    """``template`` with its ``{text}`` placeholder replaced."""
    return F.replace(F.lit(template), F.lit("{text}"), context)


def first_price(
    text: Column,
    patterns: Sequence[str] = config.PRICE_PATTERNS,
    bounds: tuple[float, float] = config.PRICE_RANGE,
) -> Column:
    """First amount within bounds; earlier patterns beat earlier positions."""
    low, high = bounds

    def by_pattern(pattern: str) -> Column:
        raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        amounts = F.transform(raw, lambda a: F.replace(a, F.lit(","), F.lit(".")).try_cast("double"))
        return F.get(F.filter(amounts, lambda v: (v >= low) & (v <= high)), F.lit(0))

    return F.coalesce(*[by_pattern(p) for p in patterns])


def availability(
    text: Column,
    sold_out: Sequence[str] = config.SOLD_OUT_KEYWORDS,
    available: Sequence[str] = config.AVAILABLE_KEYWORDS,
) -> Column:
    lower = F.lower(text)
    return (
        F.when(lower.rlike(any_of(sold_out)), "ja")
        .when(lower.rlike(any_of(available)), "nein")
        .otherwise("unbekannt")
    )


def provider_name(url: Column, providers: Sequence[str] = config.PROVIDERS) -> Column:
    lower = F.lower(url)
    rule = F.when(lower.contains(providers[0]), providers[0])
    for p in providers[1:]:
        rule = rule.when(lower.contains(p), p)
    return rule.otherwise("unbekannt")


def seller_type_from_text(text: Column) -> Column:
    return (
        F.when(text.rlike(_I + config.DEALER_KEYWORDS), config.DEALER)
        .when(text.rlike(_I + config.PRIVATE_KEYWORDS), config.PRIVATE)
        .otherwise("unbekannt")
    )


def member_since(text: Column) -> Column:
    return blank_to_null(
        F.regexp_extract(
            text, _I + r"(?:User:in seit|Mitglied seit|seit)\s+(\d{2}/\d{4})", 1
        )
    )


def decode_entities(c: Column) -> Column:
    """The named entities that occur in listing pages; ``&amp;`` goes last."""
    for entity, char in (
        ("&nbsp;", " "), ("&euro;", "€"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"),
        ("&gt;", ">"), ("&amp;", "&"),
    ):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def drop_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<[^>]*>", "")


def visible_text(html: Column) -> Column:
    """Body text of a page: no scripts, styles or comments; blocks end a line."""
    body = F.regexp_replace(
        html, r"(?is)<head\b.*?</head>|<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", ""
    )
    body = F.regexp_replace(body, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|article|nav)>", "\n")
    return decode_entities(drop_tags(body))
