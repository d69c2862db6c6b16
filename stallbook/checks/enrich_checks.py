"""Venue and seller dimensions, prices, rules, labels, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallbook.checks.catalogue import Catalogue
from stallbook.checks.views import AS_OF, LISTINGS_SQL, VENUES_SQL, listings, part_venues
from stallbook.functions import keys, pricing
from stallbook.operators import enrich as E

CATALOGUE = Catalogue()
check = CATALOGUE.check


def loose_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings whose venue is written in several ways, or missing."""
    k = F.col("seq.l_suppkey") % 6
    num = F.regexp_extract("venue", r"(\d+)$", 1)
    return listings(spark, sf_dir).withColumn(
        "venue",
        F.when(k == 0, F.upper("venue"))
        .when(k == 1, F.concat(F.lit("  Haus "), num))
        .when(k == 2, F.concat(F.lit("Konzert im "), F.col("venue"), F.lit(" Nord")))
        .when(k == 3, F.lit("  "))
        .when(k == 4, F.col("venue")),
    )


LOOSE_SQL = LISTINGS_SQL + ", " + VENUES_SQL + """,
loose AS (SELECT * REPLACE (CASE l_suppkey % 6 WHEN 0 THEN upper(venue)
  WHEN 1 THEN '  Haus ' || regexp_extract(venue, '(\\d+)$', 1) WHEN 2 THEN 'Konzert im ' || venue || ' Nord'
  WHEN 3 THEN '  ' WHEN 4 THEN venue END AS venue) FROM listings),
labels AS (SELECT *, lower(canonical) AS label FROM venue_dim UNION ALL SELECT *, unnest(aliases) AS label FROM venue_dim),
names AS (SELECT DISTINCT lower(trim(venue)) AS venue_key FROM loose WHERE trim(venue) <> ''),
hits AS (SELECT venue_key, canonical, capacity, venue_type, city FROM (
  SELECT *, row_number() OVER (PARTITION BY venue_key ORDER BY CASE WHEN label = venue_key THEN 1 ELSE 2 END, ord) AS rk
  FROM names JOIN labels ON contains(venue_key, label)) WHERE rk = 1),
placed AS (SELECT l.*, h.city AS venue_city,
    CASE WHEN trim(venue) <> '' THEN coalesce(h.canonical, trim(venue)) END AS venue_norm,
    CASE WHEN trim(venue) <> '' THEN h.capacity END AS venue_capacity,
    CASE WHEN trim(venue) <> '' THEN CASE WHEN h.canonical IS NULL THEN 'unbekannt' ELSE h.venue_type END END AS venue_type
  FROM loose l LEFT JOIN hits h ON h.venue_key = lower(trim(l.venue)))
"""


@check("enrich_venue", f"WITH {LOOSE_SQL} SELECT listing_id, venue, venue_norm, venue_capacity, venue_type FROM placed")
def venue(spark, sf_dir):
    df = E.with_venue(loose_venues(spark, sf_dir), part_venues(spark, sf_dir))
    return df.select("listing_id", "venue", "venue_norm", "venue_capacity", "venue_type")


@check("enrich_venue_city", f"WITH {LOOSE_SQL} SELECT listing_id, venue_norm, venue_city FROM placed")
def venue_city(spark, sf_dir):
    venues = part_venues(spark, sf_dir)
    df = E.with_venue(loose_venues(spark, sf_dir), venues)
    return E.with_venue_city(df, venues).select("listing_id", "venue_norm", "venue_city")


CLASS_SQL = """CASE WHEN seller_type = 'Händler' THEN 'gewerblich'
  WHEN regexp_matches(lower(seller_name), 'ticket|event|concert|box office|agency|gmbh|kg|ltd|resell|shop') THEN 'gewerblich'
  WHEN seller_type = 'Privat' THEN 'privat' ELSE 'unbekannt' END"""


@check("enrich_seller_class", f"WITH {LISTINGS_SQL} SELECT listing_id, seller_type, seller_name, {CLASS_SQL} AS seller_class FROM listings")
def seller_class(spark, sf_dir):
    df = listings(spark, sf_dir)
    rule = pricing.seller_class(F.col("seller_type"), F.col("seller_name"))
    return df.select("listing_id", "seller_type", "seller_name", rule.alias("seller_class"))


def broken(df: DataFrame) -> DataFrame:
    """Knocks out values so that every rule fires somewhere."""
    k = F.col("seq.l_suppkey")
    return df.withColumns(
        {
            "quantity": F.when(k % 5 == 0, None).when(k % 5 == 1, 0).otherwise(F.col("quantity")),
            "event_name": F.when(k % 8 == 0, "k. A.").when(k % 8 == 1, None).otherwise(F.col("event_name")),
        }
    )


CONFLICTS_SQL = """list_filter([
  CASE WHEN ask_total > 0 AND coalesce(quantity, 0) = 0 THEN 'PREIS_LOGIK: gesamt=' || CAST(ask_total AS VARCHAR)
    || ' aber anzahl_karten=' || coalesce(CAST(quantity AS VARCHAR), 'None') END,
  CASE WHEN event_date < DATE '1998-12-01' THEN 'DATUM_VERGANGENHEIT: ' || CAST(event_date AS VARCHAR) END,
  CASE WHEN ref_price > 0 AND coalesce(trim(ref_source), '') = '' THEN 'OVP_INKONSISTENZ: ovp=' || CAST(ref_price AS VARCHAR)
    || ' aber quelle leer' END,
  CASE WHEN ask_total > 5000 THEN 'PREIS_ZU_HOCH: ' || CAST(ask_total AS VARCHAR) END,
  CASE WHEN lower(trim(coalesce(event_name, ''))) IN ('', 'k. a.') THEN 'NAME_FEHLT' END,
  CASE WHEN confidence = 'niedrig' AND coalesce(trim(confidence_reason), '') = '' THEN 'CONFIDENCE_NIEDRIG_KEIN_GRUND' END
], lambda x: x IS NOT NULL)"""
BROKEN_SQL = LISTINGS_SQL + f""",
broken AS (SELECT * REPLACE (CASE l_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE quantity END AS quantity,
  CASE l_suppkey % 8 WHEN 0 THEN 'k. A.' WHEN 1 THEN NULL ELSE event_name END AS event_name) FROM listings),
checked AS (SELECT *, {CONFLICTS_SQL} AS conflicts FROM broken)
"""


@check("enrich_conflicts", f"WITH {BROKEN_SQL} SELECT listing_id, array_to_string(conflicts, '; ') AS conflicts FROM checked")
def conflicts(spark, sf_dir):
    df = broken(listings(spark, sf_dir)).withColumn("conflicts", E.conflicts(AS_OF))
    return df.select("listing_id", F.concat_ws("; ", "conflicts").alias("conflicts"))


@check(
    "enrich_conflict_report",
    f"""WITH {BROKEN_SQL}, m AS (SELECT unnest(conflicts) AS message FROM checked)
    SELECT split_part(message, ':', 1) AS rule, count(*) AS n FROM m GROUP BY ALL""",
)
def conflict_report(spark, sf_dir):
    return E.conflict_report(broken(listings(spark, sf_dir)).withColumn("conflicts", E.conflicts(AS_OF)))


def half_up(x: str, unit: str) -> str:
    return f"(sign({x}) * ((2 * abs({x}) + {unit}) // (2 * {unit})))"


PRICED_SQL = BROKEN_SQL + f""",
unit AS (SELECT *, CASE WHEN quantity > 0 THEN (2 * total_c + quantity) // (2 * quantity)
  WHEN is_unit_price THEN total_c END AS u_c FROM checked),
priced AS (SELECT * EXCLUDE (ask_unit), u_c / 100.0 AS ask_unit,
  CASE WHEN ref_c > 0 THEN (u_c - ref_c) / 100.0 END AS margin_abs,
  CASE WHEN ref_c > 0 THEN {half_up('((u_c - ref_c) * 1000)', 'ref_c')} / 10.0 END AS margin_pct,
  confidence = 'niedrig' AS needs_review FROM unit)
"""


def priced(spark, sf_dir):
    return E.with_prices(broken(listings(spark, sf_dir)))


@check("enrich_unit_price", f"WITH {PRICED_SQL} SELECT listing_id, quantity, ask_total, ask_unit FROM priced")
def unit_price(spark, sf_dir):
    return priced(spark, sf_dir).select("listing_id", "quantity", "ask_total", "ask_unit")


@check("enrich_margin", f"WITH {PRICED_SQL} SELECT listing_id, ask_unit, ref_price, margin_abs, margin_pct FROM priced")
def margin(spark, sf_dir):
    return priced(spark, sf_dir).select("listing_id", "ask_unit", "ref_price", "margin_abs", "margin_pct")


@check("enrich_needs_review", f"WITH {PRICED_SQL} SELECT confidence, needs_review, count(*) AS n FROM priced GROUP BY ALL")
def needs_review(spark, sf_dir):
    return priced(spark, sf_dir).groupBy("confidence", "needs_review").agg(F.count("*").alias("n"))


@check(
    "enrich_all",
    f"""WITH {LOOSE_SQL}, l2 AS (SELECT *, {CONFLICTS_SQL} AS conflicts, (2 * total_c + quantity) // (2 * quantity) AS u_c FROM placed)
    SELECT listing_id, u_c / 100.0 AS ask_unit, (u_c - ref_c) / 100.0 AS margin_abs, confidence = 'niedrig' AS needs_review,
      {CLASS_SQL} AS seller_class, venue_norm, venue_capacity, venue_type, array_to_string(conflicts, '; ') AS conflicts FROM l2""",
)
def enrich_all(spark, sf_dir):
    df = E.enrich(loose_venues(spark, sf_dir), part_venues(spark, sf_dir), AS_OF)
    return df.select(
        "listing_id", "ask_unit", "margin_abs", "needs_review", "seller_class", "venue_norm",
        "venue_capacity", "venue_type", F.concat_ws("; ", "conflicts").alias("conflicts"),
    )


FINAL_SQL = LISTINGS_SQL + """,
manual AS (SELECT * REPLACE (CASE WHEN l_suppkey % 5 = 0 THEN ref_price * 1.5 WHEN l_suppkey % 5 = 1 THEN 0
    ELSE ref_price_manual END AS ref_price_manual,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE ref_price END AS ref_price) FROM listings),
final AS (SELECT *, CASE WHEN ref_price_manual > 0 THEN ref_price_manual ELSE ref_price END AS ref_final,
  CASE WHEN ref_price IS NULL AND NOT coalesce(ref_price_manual > 0, false) THEN ''
    WHEN NOT coalesce(ref_price_manual > 0, false) THEN 'extrahiert' WHEN ref_price IS NULL THEN 'manuell'
    WHEN abs(ref_price - ref_price_manual) / greatest(ref_price, ref_price_manual) < 0.05 THEN 'beide_übereinstimmend'
    ELSE 'konflikt' END AS ref_final_source FROM manual)
"""


def manual_prices(spark, sf_dir):
    k = F.col("seq.l_suppkey")
    df = listings(spark, sf_dir).withColumn(
        "ref_price_manual",
        F.when(k % 5 == 0, F.col("ref_price") * 1.5).when(k % 5 == 1, 0.0).otherwise(F.col("ref_price_manual")),
    )
    return E.with_final_ref_price(df.withColumn("ref_price", F.when(k % 7 != 0, F.col("ref_price"))))


@check("enrich_final_ref_price", f"WITH {FINAL_SQL} SELECT listing_id, ref_price, ref_price_manual, ref_final, ref_final_source FROM final")
def final_ref_price(spark, sf_dir):
    df = manual_prices(spark, sf_dir)
    return df.select("listing_id", "ref_price", "ref_price_manual", "ref_final", "ref_final_source")


@check(
    "enrich_valid_link",
    """SELECT url, regexp_matches(trim(url), '^https?://') AS ok FROM (
      SELECT CASE WHEN page_id % 3 = 0 THEN ' ' || url WHEN page_id % 3 = 1 THEN replace(url, 'http', 'ftp') ELSE url END AS url FROM pages)""",
)
def valid_link(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    k = F.col("page_id") % 3
    url = F.when(k == 0, F.concat(F.lit(" "), F.col("url"))).when(
        k == 1, F.replace(F.col("url"), F.lit("http"), F.lit("ftp"))
    ).otherwise(F.col("url"))
    return pages.select(url.alias("url")).withColumn("ok", pricing.valid_provider_link(F.col("url")))


@check(
    "enrich_quality_labels",
    f"""WITH {FINAL_SQL}, labels AS (SELECT
      CASE WHEN ref_source IN ('oeticket', 'myticket', 'konzerthaus') THEN 'provider' WHEN ref_source = 'Anzeige' THEN 'listing'
        WHEN coalesce(ref_price, 0) = 0 THEN 'missing' END AS ref_label, confidence AS confidence_label,
      CASE WHEN ref_final_source = 'konflikt' THEN 'konflikt' WHEN ref_final_source = 'extrahiert' THEN 'extrahiert'
        WHEN ref_final_source IN ('manuell', 'beide_übereinstimmend') THEN 'manuell' ELSE 'fehlt' END AS final_label,
      verif_status AS verif_label FROM final)
    SELECT kind, label, count(*) AS n FROM (
      SELECT 'ref_label' AS kind, ref_label AS label FROM labels UNION ALL SELECT 'confidence_label', confidence_label FROM labels
      UNION ALL SELECT 'final_label', final_label FROM labels UNION ALL SELECT 'verif_label', verif_label FROM labels) GROUP BY ALL""",
)
def quality_labels(spark, sf_dir):
    return E.label_counts(E.quality_labels(manual_prices(spark, sf_dir)))


@check(
    "enrich_label_rows",
    f"""WITH {FINAL_SQL} SELECT listing_id, s5 AS line,
      CASE WHEN ref_source IN ('oeticket', 'myticket', 'konzerthaus') THEN 'provider' WHEN ref_source = 'Anzeige' THEN 'listing'
        WHEN coalesce(ref_price, 0) = 0 THEN 'missing' END AS ref_label, confidence AS confidence_label,
      CASE WHEN ref_final_source = 'konflikt' THEN 'konflikt' WHEN ref_final_source = 'extrahiert' THEN 'extrahiert'
        WHEN ref_final_source IN ('manuell', 'beide_übereinstimmend') THEN 'manuell' ELSE 'fehlt' END AS final_label,
      verif_status AS verif_label FROM final""",
)
def label_rows(spark, sf_dir):
    """The four labels of every row."""
    rows = E.quality_labels(manual_prices(spark, sf_dir))
    return rows.select("listing_id", F.col("seq.l_linenumber").alias("line"), "ref_label", "confidence_label", "final_label", "verif_label")


@check(
    "enrich_key_normalisers",
    f"""WITH {LISTINGS_SQL}, n AS (SELECT DISTINCT '  ' || upper(event_name) || '!  (' || category || ') ' AS name, event_date FROM listings)
    SELECT name, lower(regexp_replace(trim(name), '\\s+', ' ', 'g')) AS event_key,
      lower(trim(name)) || '|' || CAST(event_date AS VARCHAR) AS ref_key, trim(lower(name)) AS verif_key,
      trim(regexp_replace(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS match_key FROM n""",
)
def key_normalisers(spark, sf_dir):
    name = F.concat(F.lit("  "), F.upper("event_name"), F.lit("!  ("), F.col("category"), F.lit(") "))
    df = listings(spark, sf_dir).select(name.alias("name"), "event_date").distinct()
    return df.select(
        "name", keys.event_key(F.col("name")).alias("event_key"),
        keys.ref_price_key(F.col("name"), F.col("event_date")).alias("ref_key"),
        keys.verification_key(F.col("name")).alias("verif_key"),
        keys.match_name(F.col("name")).alias("match_key"),
    )
