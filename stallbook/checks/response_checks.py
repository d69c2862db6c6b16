"""Extraction responses: splitting, coercion, repair, metadata, incremental parse."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from stallbook.checks.catalogue import Catalogue
from stallbook.checks.text_checks import CATEGORY, EVENT_WORDS, MARKER, STRIP_SQL
from stallbook.checks.views import ADS_SQL, LISTINGS_SQL, VENUES_SQL, as_ads, as_listings, listing_rows, listings, part_venues
from stallbook.functions.text import build_context
from stallbook.operators import extraction as X, responses as R
from stallbook.schemas import EVENT_COLUMNS
from stallbook.sources.scratch import materialise, shared_folder

CATALOGUE = Catalogue()
check = CATALOGUE.check

AS_OF = dt.date(1998, 12, 1)


def _object():
    """One JSON object per listing row, with the type mix models produce."""
    num = F.col("listing_id").cast("bigint")
    total = F.col("ask_total").cast("decimal(18,2)").cast("string")
    qty = F.col("quantity").cast("string")
    return F.concat(
        F.lit('{"event_name":"'), F.col("event_name"), F.lit('","event_date":"'),
        F.when(num % 5 == 0, "bald").otherwise(F.col("event_date").cast("string")),
        F.lit('","venue":"'), F.col("venue"), F.lit('","city":'),
        F.when(num % 3 == 0, "null").when(num % 3 == 1, '""').otherwise(F.concat(F.lit('"'), F.col("city"), F.lit('"'))),
        F.lit(',"category":"'), F.when(num % 4 == 0, "VIP").otherwise(F.col("category")),
        F.lit('","quantity":'),
        F.when(num % 7 == 0, F.concat(F.lit('"'), qty, F.lit('"'))).when(num % 7 == 1, F.concat(F.lit('"'), qty, F.lit('.0"')))
        .when(num % 7 == 2, F.concat(qty, F.lit(".7"))).when(num % 7 == 3, "null").otherwise(qty),
        F.lit(',"ask_total":'),
        F.when(num % 11 == 0, F.concat(F.lit('"'), total, F.lit('"'))).when(num % 11 == 1, '"12f"')
        .when(num % 11 == 2, "null").otherwise(total),
        F.lit(',"is_unit_price":'),
        F.when(num % 9 == 0, '"Ja"').when(num % 9 == 1, '"no"').when(num % 9 == 2, '"null"').when(num % 9 == 3, "false")
        .when(num % 9 == 4, "null").otherwise("true"),
        F.when(num % 2 == 0, F.concat(F.lit(',"ref_price":'), (num % 400).cast("string"))).otherwise(""),
        F.when(num % 13 == 0, ',"confidence":"sicher"').when(num % 13 == 1, "").otherwise(',"confidence":"hoch"'),
        F.when(num % 17 == 0, "").when(num % 17 == 1, ',"confidence_reason":null').otherwise(',"confidence_reason":"klar"'),
        F.lit(',"extra":1}'),
    )


def responses(spark, sf_dir):
    num = F.col("listing_id").cast("bigint")
    o = F.col("o")
    k = F.floor(num / 10) % 12
    raw = (
        F.when(k == 0, F.concat(F.lit('{"events":['), o, F.lit("]}")))
        .when(k == 1, F.concat(F.lit(" ["), o, F.lit(","), o, F.lit("] ")))
        .when(k == 2, o)
        .when(k == 3, "kein Ergebnis")
        .when(k == 4, "  ")
        .when(k == 5, '{"events":[]}')
        .when(k == 6, F.concat(F.lit("Hier: ```json\n["), o, F.lit("]\n``` fertig")))
        .when(k == 7, F.concat(F.lit("Liste [ "), o, F.lit(" ] und mehr [1]")))
        .when(k == 8, F.concat(F.lit("Antwort: "), o, F.lit(" ok")))
        .when(k == 9, F.concat(F.lit("```"), o, F.lit("```")))
        .when(k == 10, '"nur text"')
        .otherwise(F.concat(F.lit('{"events":['), o, F.lit(',"x"]} Ende')))
    )
    return listings(spark, sf_dir).withColumn("o", _object()).select(
        "listing_id", (F.col("seq.l_suppkey") % 2 == 0).alias("structured"), raw.alias("raw")
    )


RESPONSES_SQL = LISTINGS_SQL + """,
objects AS (SELECT listing_id, l_suppkey, CAST(listing_id AS BIGINT) AS num,
  '{"event_name":"' || event_name || '","event_date":"' || CASE WHEN CAST(listing_id AS BIGINT) % 5 = 0 THEN 'bald' ELSE CAST(event_date AS VARCHAR) END
  || '","venue":"' || venue || '","city":' || CASE CAST(listing_id AS BIGINT) % 3 WHEN 0 THEN 'null' WHEN 1 THEN '""' ELSE '"' || city || '"' END
  || ',"category":"' || CASE WHEN CAST(listing_id AS BIGINT) % 4 = 0 THEN 'VIP' ELSE category END || '","quantity":'
  || CASE CAST(listing_id AS BIGINT) % 7 WHEN 0 THEN '"' || quantity || '"' WHEN 1 THEN '"' || quantity || '.0"' WHEN 2 THEN quantity || '.7'
    WHEN 3 THEN 'null' ELSE CAST(quantity AS VARCHAR) END
  || ',"ask_total":' || CASE CAST(listing_id AS BIGINT) % 11
    WHEN 0 THEN '"' || total_c // 100 || '.' || lpad(CAST(total_c % 100 AS VARCHAR), 2, '0') || '"' WHEN 1 THEN '"12f"' WHEN 2 THEN 'null'
    ELSE total_c // 100 || '.' || lpad(CAST(total_c % 100 AS VARCHAR), 2, '0') END
  || ',"is_unit_price":' || CASE CAST(listing_id AS BIGINT) % 9 WHEN 0 THEN '"Ja"' WHEN 1 THEN '"no"' WHEN 2 THEN '"null"' WHEN 3 THEN 'false'
    WHEN 4 THEN 'null' ELSE 'true' END
  || CASE WHEN CAST(listing_id AS BIGINT) % 2 = 0 THEN ',"ref_price":' || CAST(listing_id AS BIGINT) % 400 ELSE '' END
  || CASE CAST(listing_id AS BIGINT) % 13 WHEN 0 THEN ',"confidence":"sicher"' WHEN 1 THEN '' ELSE ',"confidence":"hoch"' END
  || CASE CAST(listing_id AS BIGINT) % 17 WHEN 0 THEN '' WHEN 1 THEN ',"confidence_reason":null' ELSE ',"confidence_reason":"klar"' END
  || ',"extra":1}' AS o FROM listings),
responses AS (SELECT row_number() OVER () AS rid, listing_id, l_suppkey % 2 = 0 AS structured, CASE (num // 10) % 12
  WHEN 0 THEN '{"events":[' || o || ']}' WHEN 1 THEN ' [' || o || ',' || o || '] ' WHEN 2 THEN o WHEN 3 THEN 'kein Ergebnis' WHEN 4 THEN '  '
  WHEN 5 THEN '{"events":[]}' WHEN 6 THEN E'Hier: ```json\\n[' || o || E']\\n``` fertig' WHEN 7 THEN 'Liste [ ' || o || ' ] und mehr [1]'
  WHEN 8 THEN 'Antwort: ' || o || ' ok' WHEN 9 THEN '```' || o || '```' WHEN 10 THEN '"nur text"'
  ELSE '{"events":[' || o || ',"x"]} Ende' END AS raw FROM objects)
"""


def as_json(x: str) -> str:
    return f"CASE WHEN json_valid({x}) THEN CAST({x} AS JSON) END"


def plain_items(x: str) -> str:
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) WHEN 'OBJECT' THEN [{x}] END"


# found: the three search patterns; items: the list the rules pick
SPLIT_SQL = RESPONSES_SQL + f""",
found AS (SELECT *, trim(raw) = '' AS blank, {as_json('trim(raw)')} AS j,
  {as_json("regexp_extract(raw, '(?s)```(?:json)?\\s*(\\[.*?\\]|\\{.*?\\})\\s*```', 1)")} AS fenced,
  {as_json("regexp_extract(raw, '(?s)(\\[.*?\\])', 1)")} AS lst, {as_json("regexp_extract(raw, '(?s)(\\{.*?\\})', 1)")} AS obj FROM responses),
events_of AS (SELECT *, CASE WHEN json_type(j, '$.events') = 'ARRAY' THEN CAST(json_extract(j, '$.events') AS JSON[]) END AS ev FROM found),
picked AS (SELECT *,
  CASE WHEN blank THEN NULL WHEN structured THEN CASE WHEN len(ev) > 0 THEN ev ELSE {plain_items('j')} END
    ELSE coalesce(ev, {plain_items('j')}, {plain_items('fenced')}, {plain_items('lst')}, {plain_items('obj')}) END AS items,
  coalesce({plain_items('j')},
    CASE WHEN json_type(fenced) = 'ARRAY' THEN {plain_items('fenced')} END, {plain_items('lst')}) AS old_items FROM events_of),
split AS (SELECT rid, listing_id, unnest(coalesce(items, [CAST(NULL AS JSON)])) AS e, generate_subscripts(coalesce(items, [CAST(NULL AS JSON)]), 1) - 1 AS event_no,
  CASE WHEN items IS NULL THEN CASE WHEN blank THEN 'Leere Antwort vom Modell' WHEN structured THEN 'Structured-Output-Parse-Fehler'
    ELSE 'JSON-Extraktion fehlgeschlagen' END END AS failure FROM picked)
"""


def number(name: str) -> str:
    v = f"json_extract_string(e, '$.{name}')"
    return f"""CASE json_type(e, '$.{name}') WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim({v}), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')
      THEN CAST({v} AS DOUBLE) END ELSE TRY_CAST({v} AS DOUBLE) END"""


def text_of(name: str) -> str:
    return f"CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.{name}') END"


COERCED_SQL = SPLIT_SQL + f""",
coerced AS (SELECT rid, listing_id, event_no, {", ".join(f"{text_of(c)} AS {c}" for c in ("event_name", "event_date", "venue", "city"))},
  CASE WHEN {text_of('category')} IN ('Stehplatz', 'Sitzplatz', 'VIP', 'Front-of-Stage', 'Gemischt', 'Unbekannt') THEN {text_of('category')} ELSE 'Unbekannt' END AS category,
  CASE json_type(e, '$.quantity') WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(json_extract_string(e, '$.quantity'), '[+-]?\\d+')
      THEN CAST(json_extract_string(e, '$.quantity') AS INTEGER) END
    ELSE CAST(trunc(TRY_CAST(json_extract_string(e, '$.quantity') AS DOUBLE)) AS INTEGER) END AS quantity,
  {number('ask_total')} AS ask_total,
  CASE lower(json_extract_string(e, '$.is_unit_price')) WHEN 'true' THEN true WHEN 'ja' THEN true WHEN 'yes' THEN true
    WHEN 'false' THEN false WHEN 'nein' THEN false WHEN 'no' THEN false END AS is_unit_price,
  {number('ref_price')} AS ref_price,
  CASE WHEN {text_of('confidence')} IN ('hoch', 'mittel', 'niedrig') THEN {text_of('confidence')} ELSE 'niedrig' END AS confidence,
  CASE WHEN json_type(e) = 'OBJECT' AND json_type(e, '$.confidence_reason') IS NOT NULL THEN json_extract_string(e, '$.confidence_reason')
    ELSE coalesce(failure, 'Parse-Fehler') END AS confidence_reason FROM split)
"""
I = "CAST(CAST(round_even({}, 0) AS BIGINT) AS VARCHAR)".format
CHECKED_SQL = COERCED_SQL + f""",
reasons AS (SELECT *, 'preis_ist_pro_karte=True aber ' || {I('ask_total')} || '€/' || quantity || ' Karten = ' || {I('ask_total / quantity')} || '€' AS head FROM coerced),
whys AS (SELECT *, CASE WHEN is_unit_price AND quantity > 1 AND ask_total > 300 THEN
  CASE WHEN ref_price > 0 THEN CASE WHEN ask_total / quantity <= ref_price * 2 THEN head || ' liegt nahe am OVP (' || {I('ref_price')} || '€) — wahrscheinlich Gesamtpreis' END
    WHEN ask_total / quantity < 150 THEN head || ' — wahrscheinlich Gesamtpreis' END END AS why FROM reasons),
plausible AS (SELECT * EXCLUDE (head, why) REPLACE (CASE WHEN why IS NOT NULL THEN 'niedrig' ELSE confidence END AS confidence,
  coalesce(why, confidence_reason) AS confidence_reason) FROM whys)
"""
REPAIRED_SQL = CHECKED_SQL + """,
days AS (SELECT *, CASE WHEN regexp_full_match(event_date, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(event_date AS DATE) END AS d FROM plausible),
shifts AS (SELECT *, TRY_CAST((year(d) + 1) || event_date[5:10] AS DATE) AS nd FROM days),
repaired AS (SELECT * EXCLUDE (d, nd) REPLACE (
  CASE WHEN d < DATE '1998-12-01' AND year(d) IN (1998, 1997) AND nd > DATE '1998-12-01' THEN CAST(nd AS VARCHAR) ELSE event_date END AS event_date,
  CASE WHEN d < DATE '1998-12-01' AND year(d) IN (1998, 1997) AND nd > DATE '1998-12-01'
    THEN concat_ws(' ', confidence_reason, '[datum_shift: ' || event_date || ' → ' || CAST(nd AS VARCHAR) || ']') ELSE confidence_reason END AS confidence_reason)
  FROM shifts)
"""
FIELDS = ", ".join(("listing_id", "event_no", *EVENT_COLUMNS))


def split(spark, sf_dir, structured=None):
    df = responses(spark, sf_dir)
    if structured is not None:
        df = df.where(F.col("structured") == structured)
    return R.split_events(df, F.col("structured")).drop("raw", "structured")


def named(df):
    name = F.try_variant_get(F.col("event"), "$.event_name", "string")
    return df.select("listing_id", "event_no", name.alias("event_name"), "failure")


def split_sql(only: str) -> str:
    sql = SPLIT_SQL.replace("FROM responses)", f"FROM responses WHERE {only})")
    return f"WITH {sql} SELECT listing_id, event_no, {text_of('event_name')} AS event_name, failure FROM split"


@check("resp_structured", split_sql("structured"))
def structured(spark, sf_dir):
    return named(split(spark, sf_dir, True))


@check("resp_text", split_sql("NOT structured"))
def text(spark, sf_dir):
    return named(split(spark, sf_dir, False))


@check(
    "resp_text_legacy",
    f"""WITH {SPLIT_SQL}, old AS (SELECT listing_id, CASE WHEN blank THEN [CAST(NULL AS JSON)] WHEN len(old_items) > 0 THEN old_items
      ELSE [CAST(NULL AS JSON)] END AS items, blank OR coalesce(len(old_items), 0) = 0 AS failed FROM picked),
    rows AS (SELECT listing_id, failed, unnest(items) AS e, generate_subscripts(items, 1) - 1 AS event_no FROM old)
    SELECT listing_id, event_no, {text_of('event_name')} AS event_name, CASE WHEN failed THEN 'Ollama-Fehler oder leere Antwort' END AS failure FROM rows""",
)
def text_legacy(spark, sf_dir):
    return named(R.split_events(responses(spark, sf_dir), F.lit(False), legacy=True))


def typed(df):
    return df.select("listing_id", "event_no", *EVENT_COLUMNS)


@check("resp_coerce", f"WITH {COERCED_SQL} SELECT {FIELDS} FROM coerced")
def coerce(spark, sf_dir):
    return typed(R.coerce_events(split(spark, sf_dir)))


@check("resp_unit_price_check", f"WITH {CHECKED_SQL} SELECT {FIELDS} FROM plausible")
def unit_price_check(spark, sf_dir):
    return typed(R.check_unit_price(R.coerce_events(split(spark, sf_dir))))


@check("resp_repair_dates", f"WITH {REPAIRED_SQL} SELECT listing_id, event_no, event_date, confidence_reason FROM repaired")
def repair_dates(spark, sf_dir):
    df = R.repair_dates(R.check_unit_price(R.coerce_events(split(spark, sf_dir))), AS_OF)
    return df.select("listing_id", "event_no", "event_date", "confidence_reason")


@check("resp_validate", f"WITH {REPAIRED_SQL} SELECT {FIELDS} FROM repaired")
def validate(spark, sf_dir):
    return typed(R.validate_events(split(spark, sf_dir), AS_OF))


@check(
    "resp_valid",
    f"""WITH {REPAIRED_SQL} SELECT listing_id, event_no, coalesce(lower(trim(event_name)), '') NOT IN ('', 'unbekannt') AND coalesce(trim(event_date), '') <> ''
      AND coalesce(ask_total > 0, false) AS valid FROM repaired""",
)
def valid(spark, sf_dir):
    ok = R.is_valid_extraction(F.col("event_name"), F.col("event_date"), F.col("ask_total"))
    return R.validate_events(split(spark, sf_dir), AS_OF).select("listing_id", "event_no", ok.alias("valid"))


def adverts(spark, sf_dir):
    """One advert per listing id: the metadata of its last row."""
    from stallbook.operators.state import last_wins

    last = as_listings(last_wins(listing_rows(spark, sf_dir)))
    return last.select(
        "listing_id", "listing_url", "seller_type", "seller_name", F.lit("S1").alias("seller_id"),
        F.lit("01/2020").alias("member_since"), F.lit("€").alias("price_raw"), F.col("last_seen").alias("posted_on"),
    )


LAST_SQL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY s1 DESC, s2 DESC, s3 DESC) AS rk FROM {}) WHERE rk = 1"
CITY_SQL = """hits AS (SELECT name, city FROM (SELECT v.name, d.city, row_number() OVER (PARTITION BY v.name
    ORDER BY CASE WHEN d.label = v.name THEN 1 ELSE 2 END, d.ord) AS rk
  FROM (SELECT DISTINCT lower(venue) AS name FROM {}) v
  JOIN (SELECT *, lower(canonical) AS label FROM venue_dim UNION ALL SELECT *, unnest(aliases) FROM venue_dim) d ON contains(v.name, d.label)) WHERE rk = 1)"""


@check(
    "resp_metadata",
    f"""WITH {REPAIRED_SQL}, {VENUES_SQL}, {CITY_SQL.format('repaired')}, ads AS ({LAST_SQL.format('listings')})
    SELECT r.listing_id, event_no, r.event_name, r.venue, CASE WHEN coalesce(r.city, '') <> '' THEN r.city ELSE coalesce(h.city, r.city) END AS city,
      a.listing_url, a.seller_type, a.seller_name, CAST(a.last_seen AS VARCHAR) AS posted_on
    FROM repaired r LEFT JOIN ads a USING (listing_id) LEFT JOIN hits h ON h.name = lower(r.venue)""",
)
def metadata(spark, sf_dir):
    events = materialise(R.validate_events(split(spark, sf_dir), AS_OF), shared_folder(spark) + "/events")
    df = R.attach_metadata(events, adverts(spark, sf_dir), part_venues(spark, sf_dir), F.lit(None).cast("timestamp"))
    return df.select(
        "listing_id", "event_no", "event_name", "venue", "city", "listing_url", "seller_type", "seller_name",
        F.col("posted_on").cast("string").alias("posted_on"),
    )


# --- a rule in place of a model: reads the fields out of the advert text ---------------

OFFER = re.compile(r"Verkaufe (\d+) Tickets für (.+?) am (\d{2})\.(\d{2})\.(\d{4}) in (\S+) € ([\d.]+)")


def rule_model(prompt: str) -> str:
    found = OFFER.search(prompt)
    if not found:
        raise ValueError("no offer in the text")
    n, name, d, m, y, city, total = found.groups()
    return (
        f'{{"events":[{{"event_name":"{name}","event_date":"{y}-{m}-{d}","city":"{city}","category":"VIP",'
        f'"quantity":{n},"ask_total":{total},"is_unit_price":false,"confidence":"hoch","confidence_reason":null}}]}}'
    )


def backup_model(prompt: str) -> str:
    if "Verkaufe" not in prompt and "Konzert" not in prompt:
        raise ValueError("nothing to say")
    return "Leider nichts gefunden"


CHAIN = (("rule", rule_model), ("backup", backup_model))


def event_columns(ads, chain, venues):
    """Fields of a stored event."""
    answers = X.run_extractors(ads.withColumn("prompt", F.col("title")), chain)
    return X.finish_events(X.answered_events(answers, chain, AS_OF), ads, venues).drop("listing_id").schema


def one_per_id(spark, sf_dir):
    from stallbook.operators.pages import first_wins

    last = first_wins(listing_rows(spark, sf_dir), ["listing_id"], F.col("seq").desc())
    return as_ads(as_listings(last)).drop("seq").select(
        "*", F.lit("S1").alias("seller_id"), F.lit("").alias("member_since"), F.lit(None).cast("date").alias("posted_on"),
        F.lit("2024-03-01 08:00:00").cast("timestamp").alias("scraped_at"),
    )


ONE_AD_SQL = ADS_SQL + f""",
src AS (SELECT listing_id AS id, title, price_raw, body, regexp_matches(body, 'Verkaufe \\d+ Tickets') AS offered FROM ({LAST_SQL.format('ads')})),
{STRIP_SQL},
wanted AS (SELECT s.*, t.body AS stripped FROM src s JOIN stripped t USING (id)
  WHERE NOT {CATEGORY} AND regexp_matches(s.title || E'\\n' || CASE WHEN regexp_matches(t.body, '{MARKER}')
      THEN t.body[1:strpos(t.body, regexp_extract(t.body, '{MARKER}')) - 1] ELSE t.body END, '{EVENT_WORDS}'))
"""


@check(
    "resp_model_calls",
    """WITH """ + ONE_AD_SQL + """ SELECT id AS listing_id, offered OR contains(title || body, 'Konzert') AS answered,
      CASE WHEN offered THEN 'rule' ELSE 'backup' END AS model, NOT offered AS fallback_used FROM src""",
)
def model_calls(spark, sf_dir):
    context = build_context(F.col("title"), F.col("price_raw"), F.col("body"))
    out = X.run_extractors(one_per_id(spark, sf_dir).withColumn("prompt", context), CHAIN)
    return out.select("listing_id", (F.col("raw") != "").alias("answered"), "model", "fallback_used")


@check(
    "resp_incremental",
    f"""WITH {ONE_AD_SQL}, {VENUES_SQL}, facts AS (SELECT * FROM ({LAST_SQL.format('offers')})),
    parsed AS (SELECT w.id AS listing_id, f.event_name, 'hoch' AS confidence,
        CASE WHEN event_date < DATE '1998-12-01' AND year(event_date) IN (1998, 1997) AND event_date + INTERVAL 1 YEAR > DATE '1998-12-01'
          THEN CAST(CAST(event_date + INTERVAL 1 YEAR AS DATE) AS VARCHAR) ELSE CAST(event_date AS VARCHAR) END AS event_date,
        f.quantity, f.ask_total, 'rule' AS model FROM wanted w JOIN facts f ON f.listing_id = w.id WHERE w.offered AND CAST(w.id AS BIGINT) % 3 <> 0),
    stored AS (SELECT listing_id, 'gespeichert' AS event_name, 'mittel' AS confidence, CAST(NULL AS VARCHAR) AS event_date, 1 AS quantity,
        CAST(5 AS DOUBLE) AS ask_total, 'old' AS model FROM facts WHERE CAST(listing_id AS BIGINT) % 3 = 0)
    SELECT * FROM parsed UNION ALL SELECT * FROM stored""",
)
def incremental(spark, sf_dir):
    folder = shared_folder(spark)
    # the adverts, their copies and the store all come from here
    everything = materialise(one_per_id(spark, sf_dir), folder + "/adverts")
    venues = part_venues(spark, sf_dir)
    # the store holds one old event for every third advert
    kind = event_columns(everything, CHAIN, venues)
    old = {
        "event_no": F.lit(0), "event_name": F.lit("gespeichert"), "confidence": F.lit("mittel"), "quantity": F.lit(1),
        "ask_total": F.lit(5.0), "model": F.lit("old"),
    }
    event = F.struct(
        *[old.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name != "event_no")]
    )
    store = everything.where(F.col("listing_id").cast("bigint") % 3 == 0).select("listing_id", F.array(event).alias("events"))
    # every fifth advert has an older copy, which no model may see
    older = everything.where(F.col("listing_id").cast("bigint") % 5 == 0).withColumn(
        "scraped_at", F.col("scraped_at") - F.expr("INTERVAL 1 DAY")
    ).withColumn("body", F.lit("Verkaufe 9 Tickets für Alt am 01.01.1998 in Wien € 1.0 Konzert"))
    copies = everything.unionByName(older)
    events, _ = X.parse_incremental(copies, store, CHAIN, venues, AS_OF, folder)
    return events.select("listing_id", "event_name", "confidence", "event_date", "quantity", "ask_total", "model")
