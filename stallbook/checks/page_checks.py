"""Page extraction over stored pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stallbook import config
from stallbook.checks.catalogue import Catalogue
from stallbook.checks.views import AS_OF, LISTINGS_SQL, listings, table
from stallbook.functions import text as T
from stallbook.operators import pages as P

CATALOGUE = Catalogue()
check = CATALOGUE.check

SITE = config.SiteProfile(base_url="https://market.example", detail_marker="/en/", vendor_marker="/vendor/")


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def enriched_pages(spark, sf_dir):
    """Pages with the markup the extractors look for, derived from page id and URL."""
    k = F.col("page_id")
    path = F.substring_index(F.substring_index(F.col("url"), "?", 1), "#", 1)
    key = k.cast("string")
    day = F.date_format(F.date_add(F.lit(dt.date(2024, 1, 1)), (k % 60).cast("int")), "yyyy-MM-dd")
    listed = F.concat(
        F.lit('<script type="application/ld+json">[{"@type":"ItemList","itemListElement":[{"url":"'), path, F.lit("?a=1"),
        F.lit('"},{"url":"/en/item-'), (k % 40).cast("string"), F.lit('"},{"pos":3}]},{"@type":"WebPage"}]</script>'),
    )
    person = F.concat(
        F.lit('<script type="application/ld+json">{"@type":"Product","datePosted":"'), day,
        F.lit('T08:00:00","seller":{"name":"Verk&'), key, F.lit('","identifier":'), key, F.lit("}}</script>"),
    )
    author = F.concat(
        F.lit('<script type="application/ld+json">{"@type":"Product","datePosted":"bald","author":{"name":"Autor '), key,
        F.lit('","identifier":"A'), key, F.lit('"}}</script><script type="application/ld+json">{kaputt</script>'),
    )
    linked = F.when(k % 4 == 0, F.concat(listed, person)).when(k % 4 == 1, F.concat(listed, author)).otherwise("")
    notes = (
        F.when(k % 5 == 0, "<p>Online seit Heute</p>").when(k % 5 == 1, "<p>Eingestellt gestern</p>")
        .when(k % 5 == 2, F.concat(F.lit("<p>vor "), (k % 30).cast("string"), F.lit(" Tagen</p>")))
        .when(k % 5 == 3, F.concat(F.lit("<p>am "), (k % 40).cast("string"), F.lit(".2.2024</p>")))
        .otherwise("")
    )
    price = (
        F.when(k % 3 == 0, F.concat(F.lit('<span data-testid="price-box-price-value"><b>€ '), key, F.lit("</b></span>")))
        .when(k % 3 == 1, F.concat(F.lit("<p>VB "), key, F.lit(",50 € fix</p>"))).otherwise("")
    )
    seller = (
        F.when(k % 6 == 0, "<p>Gewerblicher Anbieter</p>").when(k % 6 == 1, "<p>PRIVATPERSON</p>")
        .when(k % 6 == 2, F.concat(F.lit('<a href="/x/vendor/'), key, F.lit('/">Profil</a>')))
        .when(k % 6 == 3, F.concat(F.lit('<span data-testid="seller-profile-name">Händlerin '), key, F.lit("</span>")))
        .when(k % 6 == 4, F.concat(F.lit("<p>Verkäuferdetails</p><p> Max "), key, F.lit("</p>")))
        .otherwise("")
    )
    since = F.when(k % 2 == 0, F.concat(F.lit("<p>User:in seit 0"), (k % 9 + 1).cast("string"), F.lit("/2019</p>"))).otherwise("")
    link = F.concat(F.lit('<a class="l" href="/en/item-'), (k % 50).cast("string"), F.lit('?src=x">mehr</a>'))
    extra = F.concat(linked, notes, price, seller, since, link)
    return pages(spark, sf_dir).select("page_id", "url", F.concat("html", extra).alias("html"))


EP_SQL = """
raw AS (SELECT *, page_id AS k, split_part(split_part(url, '?', 1), '#', 1) AS path,
  CAST(DATE '2024-01-01' + CAST(page_id % 60 AS INTEGER) AS VARCHAR) AS day FROM pages),
parts AS (SELECT *,
  '<script type="application/ld+json">[{"@type":"ItemList","itemListElement":[{"url":"' || path || '?a=1"},{"url":"/en/item-' || k % 40
    || '"},{"pos":3}]},{"@type":"WebPage"}]</script>' AS listed,
  '<script type="application/ld+json">{"@type":"Product","datePosted":"' || day || 'T08:00:00","seller":{"name":"Verk&' || k
    || '","identifier":' || k || '}}</script>' AS person,
  '<script type="application/ld+json">{"@type":"Product","datePosted":"bald","author":{"name":"Autor ' || k || '","identifier":"A' || k
    || '"}}</script><script type="application/ld+json">{kaputt</script>' AS author FROM raw),
ep AS (SELECT page_id, k, url, path, day, html ||
    CASE k % 4 WHEN 0 THEN listed || person WHEN 1 THEN listed || author ELSE '' END
    || CASE k % 5 WHEN 0 THEN '<p>Online seit Heute</p>' WHEN 1 THEN '<p>Eingestellt gestern</p>' WHEN 2 THEN '<p>vor ' || k % 30 || ' Tagen</p>'
      WHEN 3 THEN '<p>am ' || k % 40 || '.2.2024</p>' ELSE '' END
    || CASE k % 3 WHEN 0 THEN '<span data-testid="price-box-price-value"><b>€ ' || k || '</b></span>' WHEN 1 THEN '<p>VB ' || k || ',50 € fix</p>' ELSE '' END
    || CASE k % 6 WHEN 0 THEN '<p>Gewerblicher Anbieter</p>' WHEN 1 THEN '<p>PRIVATPERSON</p>' WHEN 2 THEN '<a href="/x/vendor/' || k || '/">Profil</a>'
      WHEN 3 THEN '<span data-testid="seller-profile-name">Händlerin ' || k || '</span>'
      WHEN 4 THEN '<p>Verkäuferdetails</p><p> Max ' || k || '</p>' ELSE '' END
    || CASE k % 2 WHEN 0 THEN '<p>User:in seit 0' || k % 9 + 1 || '/2019</p>' ELSE '' END
    || '<a class="l" href="/en/item-' || k % 50 || '?src=x">mehr</a>' AS html FROM parts)
"""


def decode(x: str) -> str:
    for entity, char in (("&nbsp;", " "), ("&euro;", "€"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def untag(x: str) -> str:
    return f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


BODY = decode(
    untag(
        "regexp_replace(regexp_replace(html, '(?is)<head\\b.*?</head>|<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g'),"
        " '(?i)<br\\s*/?>|</(?:p|div|li|tr|h[1-6]|article|nav)>', E'\\n', 'g')"
    )
)
TITLE = trim(decode(untag("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")))
CANON = """CASE WHEN contains(trim(raw), '/en/') THEN split_part(CASE WHEN regexp_matches(trim(raw), '^[a-zA-Z][a-zA-Z0-9+.-]*://')
  THEN trim(raw) ELSE 'https://market.example' || trim(raw) END, '?', 1) END"""
BODY_SQL = f"bodies AS (SELECT *, {BODY} AS body FROM ep)"


@check("page_canonical_url", f"WITH u AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ' ' || substr(url, strpos(url, '/en/')) ELSE url END AS raw FROM pages) SELECT page_id, {CANON} AS url FROM u")
def canonical_url(spark, sf_dir):
    raw = F.when(F.col("page_id") % 3 == 0, F.expr("concat(' ', substr(url, greatest(locate('/en/', url), 0)))")).otherwise(F.col("url"))
    return pages(spark, sf_dir).select("page_id", P.canonical_url(raw, SITE).alias("url"))


@check(
    "page_id_from_url",
    """WITH u AS (SELECT page_id, split_part(url, '?', 1) || CASE page_id % 3 WHEN 0 THEN '-' || page_id WHEN 1 THEN '-' || page_id || '/' ELSE '' END AS url FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(url, '-\\d+/?$') THEN regexp_extract(url, '-(\\d+)/?$', 1) ELSE url END AS listing_id FROM u""",
)
def id_from_url(spark, sf_dir):
    k = F.col("page_id")
    tail = F.when(k % 3 == 0, F.concat(F.lit("-"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("-"), k.cast("string"), F.lit("/"))).otherwise("")
    url = F.concat(F.substring_index("url", "?", 1), tail)
    return pages(spark, sf_dir).select("page_id", P.id_from_url(url).alias("listing_id"))


@check(
    "page_links",
    f"""WITH {EP_SQL}, l AS (SELECT page_id, 0 AS pos, path || '?a=1' AS raw FROM ep WHERE k % 4 IN (0, 1)
      UNION ALL SELECT page_id, 1, '/en/item-' || k % 40 FROM ep WHERE k % 4 IN (0, 1)
      UNION ALL SELECT page_id, 2 + generate_subscripts(h, 1), unnest(h) FROM (
        SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS h FROM ep)),
    c AS (SELECT page_id, pos, {CANON} AS url FROM l)
    SELECT url, page_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS rk FROM c WHERE url IS NOT NULL) WHERE rk = 1""",
)
def links(spark, sf_dir):
    return P.harvest_links(enriched_pages(spark, sf_dir), SITE).select("url", "page_id")


TODAY = dt.date(2024, 3, 1)
HEUTE, GESTERN = ("(?i)(?:^|[^\\p{L}\\p{N}_])" + w + "(?:$|[^\\p{L}\\p{N}_])" for w in ("heute", "gestern"))
DATE_SQL = f"""CASE WHEN k % 4 = 0 THEN CAST(day AS DATE)
  WHEN regexp_matches(body, '{HEUTE}') THEN DATE '2024-03-01' WHEN regexp_matches(body, '{GESTERN}') THEN DATE '2024-02-29'
  WHEN regexp_matches(body, '(?i)vor\\s+\\d+\\s+Tag') THEN CAST(DATE '2024-03-01' - CAST(regexp_extract(body, '(?i)vor\\s+(\\d+)\\s+Tag', 1) AS INTEGER) AS DATE)
  ELSE CAST(try_strptime(regexp_extract(body, '(?:^|[^\\p{{L}}\\p{{N}}_])(\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), '%d.%m.%Y') AS DATE) END"""


@check("page_posting_date", f"WITH {EP_SQL}, {BODY_SQL} SELECT page_id, CAST({DATE_SQL} AS VARCHAR) AS posted_on FROM bodies")
def posting_date(spark, sf_dir):
    df = enriched_pages(spark, sf_dir).withColumn("body", T.visible_text(F.col("html")))
    return df.select("page_id", P.posting_date(F.col("html"), F.col("body"), TODAY).cast("string").alias("posted_on"))


@check("page_title", f"SELECT page_id, {TITLE} AS title FROM pages")
def title(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", P.title(F.col("html")).alias("title"))


PRICE_SQL = """CASE WHEN k % 3 = 0 THEN '€ ' || k ELSE regexp_extract(body, '(\\d[\\d.,]* ?€|€ ?\\d[\\d.,]*)', 1) END"""
TYPE_SQL = """CASE WHEN regexp_matches(body, '(?i)Gewerblicher Anbieter|Händler|Gewerblich') THEN 'Händler'
  WHEN regexp_matches(body, '(?i)Privater Anbieter|Privatperson|Privat') THEN 'Privat' ELSE 'unbekannt' END"""
ID_SQL = "CASE WHEN k % 6 = 2 THEN CAST(k AS VARCHAR) WHEN k % 4 = 0 THEN CAST(k AS VARCHAR) WHEN k % 4 = 1 THEN 'A' || k ELSE '' END"
NAME_SQL = """CASE WHEN k % 6 <> 2 AND k % 4 = 0 THEN 'Verk&' || k WHEN k % 6 <> 2 AND k % 4 = 1 THEN 'Autor ' || k
  WHEN k % 6 = 3 THEN 'Händlerin ' || k WHEN k % 6 = 4 THEN 'Max ' || k ELSE '' END"""
SINCE_SQL = "regexp_extract(body, '(?i)(?:User:in seit|Mitglied seit|seit)\\s+(\\d{2}/\\d{4})', 1)"


def one(expression):
    """Query over the enriched pages and their visible text."""

    def run(spark, sf_dir):
        df = enriched_pages(spark, sf_dir).withColumn("body", T.visible_text(F.col("html")))
        return df.select("page_id", expression())

    return run


html, body = (lambda: F.col("html")), (lambda: F.col("body"))
check("page_visible_text", f"WITH {EP_SQL}, {BODY_SQL} SELECT page_id, body FROM bodies")(one(body))
check("page_price", f"WITH {EP_SQL}, {BODY_SQL} SELECT page_id, {PRICE_SQL} AS price_raw FROM bodies")(
    one(lambda: P.price_text(html(), body()).alias("price_raw")))
check("page_seller_type", f"WITH {EP_SQL}, {BODY_SQL} SELECT page_id, {TYPE_SQL} AS seller_type FROM bodies")(
    one(lambda: T.seller_type_from_text(body()).alias("seller_type")))
check("page_seller_id", f"WITH {EP_SQL} SELECT page_id, {ID_SQL} AS seller_id FROM ep")(
    one(lambda: P.seller_id(html(), SITE).alias("seller_id")))
check("page_seller_name", f"WITH {EP_SQL} SELECT page_id, {NAME_SQL} AS seller_name FROM ep")(
    one(lambda: P.seller_name(html(), body(), SITE).alias("seller_name")))
check("page_member_since", f"WITH {EP_SQL}, {BODY_SQL} SELECT page_id, nullif({SINCE_SQL}, '') AS member_since FROM bodies")(
    one(lambda: T.member_since(body()).alias("member_since")))


@check(
    "page_extract_ads",
    f"""WITH {EP_SQL}, {BODY_SQL} SELECT CASE WHEN regexp_matches(url, '-\\d+/?$') THEN regexp_extract(url, '-(\\d+)/?$', 1) ELSE url END AS listing_id,
      url AS listing_url, {TITLE} AS title, {PRICE_SQL} AS price_raw, body, {TYPE_SQL} AS seller_type, {ID_SQL} AS seller_id,
      {NAME_SQL} AS seller_name, {SINCE_SQL} AS member_since, CAST({DATE_SQL} AS VARCHAR) AS posted_on FROM bodies""",
)
def extract_ads(spark, sf_dir):
    ads = P.extract_ads(enriched_pages(spark, sf_dir), TODAY, SITE)
    return ads.withColumn("posted_on", F.col("posted_on").cast("string")).drop("scraped_at")


@check(
    "page_failed",
    """SELECT url AS listing_url, 'FEHLER: Seite nicht ladbar' AS body, '' AS title, 'unbekannt' AS seller_type, CAST(NULL AS VARCHAR) AS posted_on
    FROM pages WHERE page_id % 10 = 3""",
)
def failed(spark, sf_dir):
    broken = pages(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 10 != 3, F.col("html")))
    ads = P.extract_ads(broken, TODAY, SITE).where(F.col("body") == config.PAGE_FAILED_TEXT)
    return ads.select("listing_url", "body", "title", "seller_type", F.col("posted_on").cast("string").alias("posted_on"))


def posted(spark, sf_dir):
    day = F.when(F.col("seq.l_suppkey") % 10 != 0, F.col("last_seen"))
    return listings(spark, sf_dir).select("listing_id", day.alias("posted_on"), "seq")


POSTED_SQL = LISTINGS_SQL + ", posted AS (SELECT *, CASE WHEN l_suppkey % 10 <> 0 THEN last_seen END AS posted_on FROM listings)"


@check(
    "page_age_cutoff",
    f"""WITH {POSTED_SQL} SELECT 'next' AS run, listing_id, CAST(posted_on AS VARCHAR) AS posted_on FROM posted WHERE posted_on IS NULL OR posted_on >= DATE '1998-11-30'
    UNION ALL SELECT 'first', listing_id, CAST(posted_on AS VARCHAR) FROM posted WHERE posted_on IS NULL OR posted_on >= DATE '1998-11-28'""",
)
def age_cutoff(spark, sf_dir):
    def run(name, first):
        kept = P.age_cutoff(posted(spark, sf_dir), AS_OF, first_run=first)
        return kept.select(F.lit(name).alias("run"), "listing_id", F.col("posted_on").cast("string").alias("posted_on"))

    return run("next", False).union(run("first", True))


@check(
    "page_newest",
    f"""WITH {POSTED_SQL} SELECT listing_id, CAST(posted_on AS VARCHAR) AS posted_on FROM posted
    ORDER BY posted.posted_on DESC NULLS LAST, s1, s2, s3, s4, s5 LIMIT 90""",
)
def newest(spark, sf_dir):
    top = P.newest(posted(spark, sf_dir), 90, "seq")
    return top.select("listing_id", F.col("posted_on").cast("string").alias("posted_on"))


@check(
    "page_ads_of_a_run",
    f"""WITH {EP_SQL}, {BODY_SQL}, ads AS (SELECT page_id, CASE WHEN regexp_matches(url, '-\\d+/?$') THEN regexp_extract(url, '-(\\d+)/?$', 1) ELSE url END AS listing_id,
      url AS listing_url, {TITLE} AS title, {PRICE_SQL} AS price_raw, {TYPE_SQL} AS seller_type, CAST({DATE_SQL} AS DATE) AS posted_on FROM bodies),
    kept AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY listing_url) AS rk FROM ads WHERE (posted_on IS NULL OR posted_on >= DATE '{TODAY - dt.timedelta(days=3)}')
      AND listing_id NOT IN (SELECT listing_id FROM ads WHERE page_id % 7 = 0))
    SELECT listing_id, listing_url, title, price_raw, seller_type, CAST(posted_on AS VARCHAR) AS posted_on FROM kept WHERE rk = 1""",
)
def ads_of_a_run(spark, sf_dir):
    """Pages to the adverts of a first run: extracted, young enough, not stored yet."""
    from stallbook.plans.runs import ads_of_pages

    every = enriched_pages(spark, sf_dir)
    stored = P.extract_ads(every.where(F.col("page_id") % 7 == 0), TODAY, SITE).select("listing_id")
    ads = ads_of_pages(every, TODAY, stored, SITE, first_run=True)
    return ads.select("listing_id", "listing_url", "title", "price_raw", "seller_type", F.col("posted_on").cast("string").alias("posted_on"))
