"""Stored pages → raw adverts.

Input is a ``pages(page_id, url, html)`` table. All extraction is expressions
over one row, so a page table is read once and never shuffled, except where a
job deduplicates URLs across pages.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stallbook import config
from stallbook.functions import jsons, text
from stallbook.functions.casting import blank_to_null, date_prefix
from stallbook.functions.keys import strip

Day = dt.date


def canonical_url(raw: Column, site: config.SiteProfile = config.SiteProfile()) -> Column:
    """Absolute detail-page URL without its query; NULL for other pages."""
    url = strip(raw)
    absolute = F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(
        F.concat(F.lit(site.base_url), url)
    )
    return F.when(url.contains(site.detail_marker), F.substring_index(absolute, "?", 1))


def id_from_url(url: Column) -> Column:
    """Trailing ``-digits``, else the URL itself."""
    return F.coalesce(blank_to_null(F.regexp_extract(url, r"-(\d+)/?$", 1)), url)


def first_wins(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by ``order``.

    ``row_number() = 1`` lets Spark cut every key to one row per task before
    the shuffle, so a key that holds a third of the rows costs one row per task.
    """
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def page_links(pages: DataFrame, site: config.SiteProfile = config.SiteProfile()) -> DataFrame:
    """(page_id, pos, url) of every detail link, item lists before anchors."""
    lists = F.filter(
        jsons.json_ld(F.col("html")), lambda v: F.try_variant_get(v, '$["@type"]', "string") == "ItemList"
    )
    listed = F.flatten(
        F.transform(
            lists,
            lambda v: F.transform(
                F.coalesce(
                    jsons.field(v, "itemListElement", jsons.VARIANTS),
                    F.array().cast(jsons.VARIANTS),
                ),
                lambda e: jsons.field(e, "url"),
            ),
        )
    )
    anchors = F.regexp_extract_all(
        "html", F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1)
    )
    return (
        pages.select("page_id", F.posexplode(F.concat(listed, anchors)).alias("pos", "raw"))
        .select("page_id", "pos", canonical_url(F.col("raw"), site).alias("url"))
        .where("url IS NOT NULL")
    )


def harvest_links(pages: DataFrame, site: config.SiteProfile = config.SiteProfile()) -> DataFrame:
    """Distinct detail URLs; the first sighting in crawl order stays."""
    return first_wins(page_links(pages, site), ["url"], F.col("page_id"), F.col("pos"))


def posting_date(html: Column, body: Column, as_of: Day) -> Column:
    """Linked data, then 'Heute', 'Gestern', 'vor N Tagen', then the first DD.MM.YYYY."""
    today = F.lit(as_of)

    def stated(v: Column) -> Column:
        names = ("datePosted", "dateCreated", "datePublished")
        return date_prefix(F.coalesce(*[blank_to_null(jsons.field(v, n)) for n in names]))

    dates = F.transform(jsons.json_ld(html), stated)
    days_ago = F.regexp_extract(body, r"(?iU)vor\s+(\d+)\s+Tag", 1).try_cast("int")
    day_text = F.regexp_extract(body, r"(?U)\b(\d{1,2}\.\d{1,2}\.\d{4})\b", 1)
    return F.coalesce(
        F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0)),
        F.when(body.rlike(r"(?iU)\bHeute\b"), today),
        F.when(body.rlike(r"(?iU)\bGestern\b"), F.date_sub(today, 1)),
        F.date_sub(today, days_ago),
        F.try_to_date(day_text, "d.M.yyyy"),
    )


def title(html: Column) -> Column:
    inner = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    return strip(text.decode_entities(text.drop_tags(inner)))


def _markup(html: Column, pattern: str) -> Column:
    found = F.regexp_extract(html, pattern, 1)
    return blank_to_null(strip(text.decode_entities(text.drop_tags(found))))


def price_text(html: Column, body: Column) -> Column:
    """Marked-up price, else the first amount next to a euro sign."""
    return F.coalesce(
        _markup(html, r"""(?is)<[^>]*data-testid=["']price-box-price-value["'][^>]*>(.*?)</"""),
        _markup(html, r"""(?is)<[^>]*data-testid=["']ad-price["'][^>]*>(.*?)</"""),
        _markup(html, r"""(?is)<span[^>]*class=["']price["'][^>]*>(.*?)</span>"""),
        _markup(html, r"(?is)<span[^>]*>([^<]*€[^<]*)</span>"),
        F.regexp_extract(body, r"(\d[\d.,]* ?€|€ ?\d[\d.,]*)", 1),
    )


def _seller(html: Column, name: str) -> Column:
    """First non-empty seller (or author) attribute of the linked data."""

    def attribute(v: Column) -> Column:
        holder = F.when(jsons.field(v, "seller", "variant").isNotNull()
                        & (jsons.kind(jsons.field(v, "seller", "variant")) != "VOID"), "seller")
        return blank_to_null(
            F.when(holder.isNotNull(), jsons.field(v, "seller." + name))
            .otherwise(jsons.field(v, "author." + name))
        )

    values = F.transform(jsons.json_ld(html), attribute)
    return F.get(F.filter(values, lambda a: a.isNotNull()), F.lit(0))


def vendor_link_id(html: Column, site: config.SiteProfile = config.SiteProfile()) -> Column:
    pattern = r"""(?i)href=["'][^"']*\Q%s\E(\d+)""" % site.vendor_marker
    return blank_to_null(F.regexp_extract(html, pattern, 1))


def seller_id(html: Column, site: config.SiteProfile = config.SiteProfile()) -> Column:
    return F.coalesce(vendor_link_id(html, site), _seller(html, "identifier"), F.lit(""))


def seller_name(
    html: Column, body: Column, site: config.SiteProfile = config.SiteProfile()
) -> Column:
    """Linked data (read only when no profile link gave the id), markup, then body text."""
    return F.coalesce(
        F.when(vendor_link_id(html, site).isNull(), _seller(html, "name")),
        _markup(html, r"""(?is)<[^>]*data-testid=["']seller-profile-name["'][^>]*>(.*?)</"""),
        _markup(html, r"""(?is)<[^>]*class=["'][^"']*SellerName[^"']*["'][^>]*>(.*?)</"""),
        _markup(html, r"""(?is)<[^>]*class=["'][^"']*UserName[^"']*["'][^>]*>(.*?)</"""),
        blank_to_null(strip(F.regexp_extract(body, r"Verkäuferdetails\s*\n\s*(.+)", 1))),
        F.lit(""),
    )


def extract_ads(
    pages: DataFrame,
    as_of: Day,
    site: config.SiteProfile = config.SiteProfile(),
    scraped_at: Column | None = None,
) -> DataFrame:
    """Raw adverts, one per page; pages that failed to load become placeholders."""
    html = F.coalesce(F.col("html"), F.lit(""))
    body = F.col("_body")
    failed = F.col("html").isNull()
    stamp = F.current_timestamp() if scraped_at is None else scraped_at

    def loaded(c: Column, otherwise: Column = F.lit("")) -> Column:
        return F.when(failed, otherwise).otherwise(c)

    return pages.withColumn("_body", text.visible_text(html)).select(
        id_from_url(F.col("url")).alias("listing_id"),
        F.col("url").alias("listing_url"),
        loaded(title(html)).alias("title"),
        loaded(price_text(html, body)).alias("price_raw"),
        loaded(body, F.lit(config.PAGE_FAILED_TEXT)).alias("body"),
        loaded(text.seller_type_from_text(body), F.lit("unbekannt")).alias("seller_type"),
        loaded(seller_id(html, site)).alias("seller_id"),
        loaded(seller_name(html, body, site)).alias("seller_name"),
        loaded(F.coalesce(text.member_since(body), F.lit(""))).alias("member_since"),
        F.when(~failed, posting_date(html, body, as_of)).alias("posted_on"),
        stamp.alias("scraped_at"),
    )


def age_cutoff(
    ads: DataFrame,
    as_of: Day,
    first_run: bool = False,
    max_age_days: int = config.MAX_AGE_DAYS,
    first_run_days: int = config.FIRST_RUN_MAX_AGE_DAYS,
) -> DataFrame:
    """Drop adverts older than the window; an unknown date stays."""
    days = first_run_days if first_run else max_age_days
    oldest = F.lit(as_of - dt.timedelta(days=days))
    return ads.where(F.col("posted_on").isNull() | (F.col("posted_on") >= oldest))


def newest(ads: DataFrame, n: int, *ties: str) -> DataFrame:
    """The n newest adverts: a top-k per task and one merge, not a full sort."""
    return ads.orderBy(F.col("posted_on").desc_nulls_last(), *ties).limit(n)
