"""Matching, verification, result store, reference-price resolution."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stallbook import config
from stallbook.checks.catalogue import Catalogue
from stallbook.checks.text_checks import PRICE_SQL, PROVIDER_NAME_SQL, PROVIDER_SQL, SOLD_SQL, provider_pages
from stallbook.checks.views import AS_OF, LISTINGS_SQL, as_listings, listing_rows, listings, table
from stallbook.functions import keys, scores
from stallbook.operators import matching as M, refprice as R
from stallbook.operators.state import last_wins
from stallbook.plans.runs import verify_listings
from stallbook.sources.scratch import shared_folder

CATALOGUE = Catalogue()
check = CATALOGUE.check


def queries(spark, sf_dir):
    """Distinct events: (name, date, city)."""
    q = listings(spark, sf_dir).select("event_name", "event_date", "city").distinct()
    return q.withColumn(
        "query_id", F.concat_ws("|", "event_name", F.col("event_date").cast("string"), "city")
    )


QUERIES_SQL = LISTINGS_SQL + """,
queries AS (SELECT DISTINCT event_name, event_date, city, event_name || '|' || CAST(event_date AS VARCHAR) || '|' || city AS query_id FROM listings)
"""


def candidates(spark, sf_dir):
    """Parts as candidates of four sources; dates near year starts, cities partly longer."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    source = F.element_at(F.array(*[F.lit(s) for s in config.VERIFICATION_SOURCES]), (k % 4 + 1).cast("int"))
    year = F.make_date(1995 + (k % 7).cast("int"), F.lit(1), F.lit(1))
    return p.select(
        source.alias("source"),
        F.when(k % 3 == 0, F.concat(F.upper("p_name"), F.lit(" - "), F.col("p_type"), F.lit(" Live"))).otherwise(F.col("p_name")).alias("event_name"),
        F.when(k % 5 != 0, F.date_add(year, (k % 11).cast("int") - 5)).alias("event_date"),
        F.when(k % 6 == 0, None).when(k % 6 == 1, F.concat(F.lit("Nation_"), (k % 25).cast("string")))
        .otherwise(F.concat(F.lit(" NATION_"), (k % 25).cast("string"), F.lit(" Süd"))).alias("city"),
        k.alias("cand_seq"),
    )


CANDIDATES_SQL = """
candidates AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'musicbrainz' WHEN 1 THEN 'wikidata' WHEN 2 THEN 'songkick' ELSE 'bandsintown' END AS source,
  CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) || ' - ' || p_type || ' Live' ELSE p_name END AS event_name,
  CASE WHEN p_partkey % 5 <> 0 THEN CAST(make_date(1995 + p_partkey % 7, 1, 1) + CAST(p_partkey % 11 AS INTEGER) - 5 AS DATE) END AS event_date,
  CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Nation_' || p_partkey % 25 ELSE ' NATION_' || p_partkey % 25 || ' Süd' END AS city,
  p_partkey AS cand_seq FROM part)
"""


def tokens_sql(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> ''))"


# name scores of all pairs of distinct names, then every query against every candidate
PAIRS_SQL = f"""
qn AS (SELECT DISTINCT event_name AS q, {tokens_sql('event_name')} AS qt FROM queries),
cn AS (SELECT DISTINCT event_name AS c, {tokens_sql('event_name')} AS ct FROM candidates),
name_pairs AS (SELECT q, c, CAST(len(list_intersect(qt, ct)) AS DOUBLE) / len(list_distinct(list_concat(qt, ct))) AS name_score FROM qn CROSS JOIN cn),
good_pairs AS (SELECT * FROM name_pairs WHERE name_score >= 0.3),
scored AS (SELECT query_id, source, c.event_name AS cand_name, cand_seq, name_score,
  CASE WHEN q.event_date = c.event_date THEN 1.0 WHEN abs(date_diff('day', q.event_date, c.event_date)) <= 7 THEN 0.5 ELSE 0.0 END AS date_score,
  CASE WHEN c.city IS NULL THEN 0.0 WHEN lower(q.city) = lower(trim(c.city)) THEN 1.0
    WHEN contains(lower(q.city), lower(trim(c.city))) OR contains(lower(trim(c.city)), lower(q.city)) THEN 0.5 ELSE 0.0 END AS city_score
  FROM queries q JOIN good_pairs ON q.event_name = good_pairs.q JOIN candidates c ON good_pairs.c = c.event_name),
totals AS (SELECT *, round(name_score * 0.5 + date_score * 0.3 + city_score * 0.2, 4) AS total FROM scored)
"""
BEST = "SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY {} ORDER BY total DESC, cand_seq) AS rk FROM totals) WHERE rk = 1"


@check("match_best", f"WITH {QUERIES_SQL}, {CANDIDATES_SQL}, {PAIRS_SQL}, b AS ({BEST.format('query_id')}) SELECT * EXCLUDE (source) FROM b")
def best(spark, sf_dir):
    return M.best_matches(queries(spark, sf_dir), candidates(spark, sf_dir))


@check("match_best_by_source", f"WITH {QUERIES_SQL}, {CANDIDATES_SQL}, {PAIRS_SQL} {BEST.format('query_id, source')}")
def best_by_source(spark, sf_dir):
    return M.best_matches(queries(spark, sf_dir), candidates(spark, sf_dir), by=["source"])


def _names(df, key):
    toks = keys.name_tokens(F.col("event_name"))
    return df.select(toks.alias("tokens")).withColumn("key", F.concat_ws(" ", "tokens")).select("key", "tokens").distinct()


@check(
    "match_name_score",
    f"""WITH {QUERIES_SQL}, {CANDIDATES_SQL}, {PAIRS_SQL}
    SELECT DISTINCT array_to_string(list_sort({tokens_sql('q')}), ' ') AS left_key, array_to_string(list_sort({tokens_sql('c')}), ' ') AS right_key, name_score FROM good_pairs""",
)
def name_score(spark, sf_dir):
    return M.similar_names(_names(queries(spark, sf_dir), "q"), _names(candidates(spark, sf_dir), "c"))


ORDER_PAIRS = """pairs AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b, l_linenumber,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'NATION_' || l_suppkey % 25 END AS x, 'Nation_' || l_partkey % 12 AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def order_pairs(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("l_suppkey")
    return o.join(li, o.o_orderkey == li.l_orderkey).select(
        "o_orderkey", F.to_date("o_orderdate").alias("a"), F.to_date("l_shipdate").alias("b"), "l_linenumber",
        F.when(k % 5 != 0, F.concat(F.lit("NATION_"), (k % 25).cast("string"))).alias("x"),
        F.concat(F.lit("Nation_"), (F.col("l_partkey") % 12).cast("string")).alias("y"),
    )


@check("match_date_score", f"WITH {ORDER_PAIRS} SELECT o_orderkey, l_linenumber, CASE WHEN a = b THEN 1.0 WHEN abs(date_diff('day', a, b)) <= 7 THEN 0.5 ELSE 0.0 END AS score FROM pairs")
def date_score(spark, sf_dir):
    return order_pairs(spark, sf_dir).select("o_orderkey", "l_linenumber", scores.date_score(F.col("a"), F.col("b")).alias("score"))


@check(
    "match_city_score",
    f"""WITH {ORDER_PAIRS} SELECT o_orderkey, l_linenumber, CASE WHEN x IS NULL THEN 0.0 WHEN lower(x) = lower(y) THEN 1.0
      WHEN contains(lower(x), lower(y)) OR contains(lower(y), lower(x)) THEN 0.5 ELSE 0.0 END AS score FROM pairs""",
)
def city_score(spark, sf_dir):
    return order_pairs(spark, sf_dir).select("o_orderkey", "l_linenumber", scores.city_score(F.col("x"), F.col("y")).alias("score"))


@check("match_weighted_total", "SELECT l_orderkey, l_linenumber, round(l_discount * 0.5 + l_tax * 0.3 + l_quantity * 0.2, 4) AS total FROM lineitem")
def weighted_total(spark, sf_dir):
    total = scores.weighted_total(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", total.alias("total"))


# --- stored responses: one per distinct event name and source, built from the parts -------


def responses(spark, sf_dir):
    """JSON bodies in the four source shapes; six items each, every third query unanswered."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    source = F.element_at(F.array(*[F.lit(s) for s in config.VERIFICATION_SOURCES]), (k % 4 + 1).cast("int"))
    year = F.concat((1995 + k % 7).cast("string"), F.lit("-01-0"), (k % 9 + 1).cast("string"))
    name = F.col("p_name")
    city = F.concat(F.lit("NATION_"), (k % 25).cast("string"))
    items = {
        "musicbrainz": F.concat(F.lit('{"name":"'), name, F.lit('","score":'), (k % 101).cast("string"), F.lit("}")),
        "wikidata": F.concat(F.lit('{"itemLabel":{"value":"'), name, F.lit(' Tour"},"dateLabel":{"value":"'), year, F.lit('T00:00:00Z"}}')),
        "songkick": F.concat(F.lit('{"displayName":"'), name, F.lit('","start":{"date":"'), year, F.lit('"},"venue":{"displayName":"'), F.col("p_brand"),
                             F.lit('","metroArea":{"displayName":"'), city, F.lit('"}}}')),
        "bandsintown": F.concat(F.lit('{"datetime":"'), year, F.lit('T20:00:00","venue":{"name":"'), F.col("p_brand"), F.lit('","city":"'), city, F.lit('"}}')),
    }
    wrap = {"musicbrainz": '{"artists":[', "wikidata": '{"results":{"bindings":[', "songkick": '{"resultsPage":{"results":{"event":[', "bandsintown": "["}
    close = {"musicbrainz": "]}", "wikidata": "]}}", "songkick": "]}}}", "bandsintown": "]"}
    item, head, tail = F.lit(None).cast("string"), F.lit(""), F.lit("")
    for s in config.VERIFICATION_SOURCES:
        item = F.when(source == s, items[s]).otherwise(item)
        head = F.when(source == s, wrap[s]).otherwise(head)
        tail = F.when(source == s, close[s]).otherwise(tail)
    six = F.concat_ws(",", *([item] * 6))
    return p.select(
        F.concat(k.cast("string"), F.lit("|"), name).alias("query_id"), name.alias("query_name"), source.alias("source"),
        (k % 3 != 0).alias("ok"),
        F.when(k % 10 == 0, "kein json").otherwise(F.concat(head, six, tail)).alias("body"),
    )


NORMAL_SQL = """
normal AS (SELECT p_partkey || '|' || p_name AS query_id, CASE p_partkey % 4 WHEN 0 THEN 'musicbrainz' WHEN 1 THEN 'wikidata' WHEN 2 THEN 'songkick' ELSE 'bandsintown' END AS source,
  pos AS cand_seq, CASE WHEN p_partkey % 4 = 1 THEN p_name || ' Tour' ELSE p_name END AS event_name,
  CASE WHEN p_partkey % 4 <> 0 THEN make_date(1995 + p_partkey % 7, 1, p_partkey % 9 + 1) END AS event_date,
  CASE WHEN p_partkey % 4 > 1 THEN p_brand END AS venue, CASE WHEN p_partkey % 4 > 1 THEN 'NATION_' || p_partkey % 25 END AS city,
  CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 101) / 100.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.7 ELSE 0.75 END AS source_score, p_partkey
  FROM part, range(6) t(pos) WHERE p_partkey % 3 <> 0 AND p_partkey % 10 <> 0)
"""


@check("match_normalise", f"WITH {NORMAL_SQL} SELECT query_id, source, cand_seq, event_name, CAST(event_date AS VARCHAR) AS event_date, venue, city, source_score FROM normal")
def normalise(spark, sf_dir):
    return M.normalise_responses(responses(spark, sf_dir)).withColumn("event_date", F.col("event_date").cast("string"))


@check("match_normalise_first", f"WITH {NORMAL_SQL} SELECT query_id, source, cand_seq, event_name, CAST(event_date AS VARCHAR) AS event_date, venue, city, source_score FROM normal WHERE cand_seq < 5")
def normalise_first(spark, sf_dir):
    """The first candidates of a response only."""
    df = M.normalise_responses(responses(spark, sf_dir), limit=config.CANDIDATES_PER_QUERY)
    return df.withColumn("event_date", F.col("event_date").cast("string"))


ANSWERED_SQL = "answered AS (SELECT query_id, source FROM queries, (VALUES ('musicbrainz'), ('wikidata'), ('songkick'), ('bandsintown')) s(source) WHERE length(event_name) % 3 <> 0)"
LAYER = "CASE source WHEN 'musicbrainz' THEN 1 WHEN 'wikidata' THEN 2 WHEN 'songkick' THEN 3 ELSE 4 END"
STATUS_SQL = f"""
best AS ({BEST.format('query_id, source')}),
kept AS (SELECT b.* FROM best b JOIN answered a USING (query_id, source)),
confirmed AS (SELECT query_id, string_agg(source, '; ' ORDER BY {LAYER}) AS sources, count(*) FILTER (source = 'bandsintown') AS bit,
  count(*) FILTER (source IN ('musicbrainz', 'wikidata')) AS known, max(total) AS top FROM kept WHERE total >= 0.5 GROUP BY query_id),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, {LAYER}) AS rk FROM kept WHERE total >= 0.5) WHERE rk = 1),
checks AS (SELECT query_id, string_agg(source, '; ' ORDER BY {LAYER}) AS checked FROM answered GROUP BY query_id),
statuses AS (SELECT q.query_id, q.event_name, q.event_date, q.city, coalesce(checked, '') AS sources_checked, coalesce(sources, '') AS sources_confirmed,
  CASE WHEN checked IS NULL THEN 'fehler' WHEN bit > 0 AND known > 0 AND top >= 0.6 THEN 'verifiziert' WHEN sources IS NOT NULL THEN 'wahrscheinlich'
    ELSE 'nicht_verifiziert' END AS status, t.cand_name AS best_name, t.total AS best_total, t.source AS best_source
  FROM queries q LEFT JOIN checks USING (query_id) LEFT JOIN confirmed USING (query_id) LEFT JOIN tops t USING (query_id))
"""


@check("match_status", f"WITH {QUERIES_SQL}, {CANDIDATES_SQL}, {PAIRS_SQL}, {ANSWERED_SQL}, {STATUS_SQL} SELECT query_id, status, sources_checked, sources_confirmed, best_name, best_total, best_source FROM statuses")
def status(spark, sf_dir):
    q = queries(spark, sf_dir)
    answered = q.where(F.length("event_name") % 3 != 0).select(
        "query_id", F.explode(F.array(*[F.lit(s) for s in config.VERIFICATION_SOURCES])).alias("source")
    )
    matches = M.best_matches(q, candidates(spark, sf_dir), by=["source"]).join(answered, ["query_id", "source"])
    out = M.verification_status(q, answered, matches, AS_OF)
    return out.select(
        "query_id", "status", F.concat_ws("; ", "sources_checked").alias("sources_checked"),
        F.concat_ws("; ", "sources_confirmed").alias("sources_confirmed"), F.col("best.name").alias("best_name"),
        F.col("best.total").alias("best_total"), F.col("best.source").alias("best_source"),
    )


# --- result store ---------------------------------------------------------------------------

BEST_TYPE = "struct<name:string,name_score:double,date_score:double,city_score:double,total:double,source:string>"
TODAY = dt.date(1998, 8, 2)


def store(spark, sf_dir):
    """One entry per part name and year, cached on the day of an order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    one = o.select(
        F.concat(F.lit("event "), (k % 5000).cast("string")).alias("name_key"),
        F.when(k % 9 != 0, F.trunc("o_orderdate", "year")).alias("event_date"),
        F.when(k % 2 == 0, config.VERIFIED).otherwise(config.UNVERIFIED).alias("status"),
        F.lit(None).cast(BEST_TYPE).alias("best"), F.array(F.lit("wikidata")).alias("sources_checked"),
        F.array().cast("array<string>").alias("sources_confirmed"), F.to_date("o_orderdate").alias("cached_on"), k.alias("seq"),
    )
    from stallbook.operators.pages import first_wins

    return first_wins(one, ["name_key", "event_date"], F.col("seq").desc()).drop("seq")


STORE_SQL = """
entries AS (SELECT 'event ' || o_orderkey % 5000 AS name_key, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS event_date,
  CASE WHEN o_orderkey % 2 = 0 THEN 'verifiziert' ELSE 'nicht_verifiziert' END AS status, CAST(o_orderdate AS DATE) AS cached_on, o_orderkey FROM orders),
store AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name_key, event_date ORDER BY o_orderkey DESC) AS rk FROM entries) WHERE rk = 1)
"""


def asked(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit(" EVENT "), (k % 6000).cast("string"), F.lit(" ")).alias("event_name"),
        F.when(k % 9 != 0, F.trunc("o_orderdate", "year")).alias("event_date"),
    ).distinct()


ASKED_SQL = """asked AS (SELECT DISTINCT ' EVENT ' || o_orderkey % 6000 || ' ' AS event_name,
  CASE WHEN o_orderkey % 9 <> 0 THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS event_date FROM orders)"""


def shown(df):
    return df.select("name_key", F.col("event_date").cast("string").alias("event_date"), "status", F.col("cached_on").cast("string").alias("cached_on"))


SHOWN = "name_key, CAST(event_date AS VARCHAR) AS event_date, status, CAST(cached_on AS VARCHAR) AS cached_on"


@check(
    "cache_get",
    f"""WITH {STORE_SQL}, {ASKED_SQL} SELECT event_name, CAST(a.event_date AS VARCHAR) AS event_date, s.status FROM asked a LEFT JOIN store s
      ON s.name_key = trim(lower(a.event_name)) AND s.event_date IS NOT DISTINCT FROM a.event_date AND s.cached_on >= DATE '1998-07-26'""",
)
def cache_get(spark, sf_dir):
    hits = M.store_get(asked(spark, sf_dir), store(spark, sf_dir), TODAY)
    return hits.select("event_name", F.col("event_date").cast("string").alias("event_date"), F.col("hit.status").alias("status"))


@check(
    "cache_put",
    f"""WITH {STORE_SQL}, fresh AS (SELECT 'event ' || o_orderkey % 7000 AS name_key, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS event_date,
        CASE WHEN o_orderkey % 4 = 0 THEN 'fehler' ELSE 'wahrscheinlich' END AS status, DATE '1998-08-02' AS cached_on, o_orderkey FROM orders WHERE o_orderkey % 5 = 0),
      last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name_key, event_date ORDER BY o_orderkey DESC) AS rk FROM fresh) WHERE rk = 1)
    SELECT {SHOWN} FROM last UNION ALL SELECT {SHOWN} FROM store s WHERE NOT EXISTS
      (SELECT 1 FROM last l WHERE l.name_key = s.name_key AND l.event_date IS NOT DISTINCT FROM s.event_date)""",
)
def cache_put(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 5 == 0)
    k = F.col("o_orderkey")
    new = o.select(
        F.concat(F.lit("event "), (k % 7000).cast("string")).alias("name_key"),
        F.when(k % 9 != 0, F.trunc("o_orderdate", "year")).alias("event_date"),
        F.when(k % 4 == 0, config.FAILED).otherwise(config.LIKELY).alias("status"), F.lit(None).cast(BEST_TYPE).alias("best"),
        F.array().cast("array<string>").alias("sources_checked"), F.array().cast("array<string>").alias("sources_confirmed"), k.alias("seq"),
    )
    return shown(M.store_put(store(spark, sf_dir), new, TODAY))


@check(
    "cache_invalidate",
    f"""WITH {STORE_SQL}, {ASKED_SQL} SELECT {SHOWN} FROM store s WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE trim(lower(a.event_name)) = s.name_key
      AND a.event_date IS NOT DISTINCT FROM s.event_date AND length(a.event_name) < 11)""",
)
def cache_invalidate(spark, sf_dir):
    return shown(M.store_invalidate(store(spark, sf_dir), asked(spark, sf_dir).where(F.length("event_name") < 11)))


@check("cache_purge", f"WITH {STORE_SQL} SELECT count(*) FILTER (cached_on < DATE '1998-07-26') AS purged, count(*) FILTER (cached_on >= DATE '1998-07-26') AS kept FROM store")
def cache_purge(spark, sf_dir):
    kept, gone = M.store_purge(store(spark, sf_dir), TODAY)
    rest = kept.agg(F.count("*").alias("n"))
    both = gone.select(F.lit("purged").alias("k"), F.col("purged").alias("n")).union(rest.select(F.lit("kept"), "n"))
    return both.agg(F.max(F.when(F.col("k") == "purged", F.col("n"))).alias("purged"), F.max(F.when(F.col("k") == "kept", F.col("n"))).alias("kept"))


@check("cache_purge_rows", f"WITH {STORE_SQL} SELECT {SHOWN} FROM store WHERE cached_on >= DATE '1998-07-26'")
def cache_purge_rows(spark, sf_dir):
    """What a purge leaves."""
    return shown(M.store_purge(store(spark, sf_dir), TODAY)[0])


# --- write-back and the whole verification run -------------------------------------------------


def unique_listings(spark, sf_dir, dealt=lambda rows: rows):
    return as_listings(last_wins(dealt(listing_rows(spark, sf_dir)))).withColumns(
        {"verif_on": F.lit(None).cast("date"), "verif_name": F.lit(None).cast("string"), "verif_score": F.lit(None).cast("double")}
    )


UNIQUE_SQL = "uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY s1 DESC, s2 DESC, s3 DESC) AS rk FROM listings) WHERE rk = 1)"


def results(spark, sf_dir):
    """A result for every second listing, and for ids that do not exist."""
    k = F.col("listing_id").cast("bigint")
    best = F.struct(
        F.col("event_name").alias("name"), F.lit(1.0).alias("name_score"), F.lit(0.0).alias("date_score"), F.lit(0.0).alias("city_score"),
        (k % 1000 / 1000).alias("total"), F.lit("wikidata").alias("source"),
    )
    return unique_listings(spark, sf_dir).where(k % 2 == 0).select(
        F.when(k % 14 == 0, F.concat(F.lit("x"), F.col("listing_id"))).otherwise(F.col("listing_id")).alias("listing_id"),
        F.lit(config.LIKELY).alias("status"), F.array(F.lit("wikidata")).alias("sources_confirmed"), F.lit(AS_OF).alias("verif_on"),
        F.when(k % 6 != 0, best).alias("best"),
    )


WRITTEN_SQL = f"""{LISTINGS_SQL}, {UNIQUE_SQL}, hit AS (SELECT *, CAST(listing_id AS BIGINT) % 2 = 0 AND CAST(listing_id AS BIGINT) % 14 <> 0 AS w,
  CAST(listing_id AS BIGINT) AS k FROM uniq),
written AS (SELECT listing_id, CASE WHEN w THEN 'wahrscheinlich' ELSE verif_status END AS verif_status,
  CASE WHEN w THEN 'wikidata' ELSE coalesce(array_to_string(verif_sources, '; '), '') END AS verif_sources,
  CASE WHEN w THEN '1998-12-01' END AS verif_on, CASE WHEN w THEN CASE WHEN k % 6 <> 0 THEN event_name ELSE '' END END AS verif_name,
  CASE WHEN w AND k % 6 <> 0 THEN (k % 1000) / 1000.0 END AS verif_score FROM hit)
"""


@check("match_write_back", f"WITH {WRITTEN_SQL} SELECT * FROM written")
def write_back(spark, sf_dir):
    out = M.write_back(unique_listings(spark, sf_dir), results(spark, sf_dir))
    return out.select(
        "listing_id", "verif_status", F.concat_ws("; ", "verif_sources").alias("verif_sources"), F.col("verif_on").cast("string").alias("verif_on"),
        "verif_name", "verif_score",
    )


@check("match_unknown_ids", f"WITH {LISTINGS_SQL}, {UNIQUE_SQL} SELECT 'x' || listing_id AS listing_id FROM uniq WHERE CAST(listing_id AS BIGINT) % 14 = 0")
def unknown_ids(spark, sf_dir):
    return M.unknown_ids(unique_listings(spark, sf_dir), results(spark, sf_dir))


@check("match_unverified", f"WITH {LISTINGS_SQL}, {UNIQUE_SQL} SELECT listing_id, verif_status FROM uniq WHERE verif_status IS NULL OR verif_status = 'nicht_verifiziert'")
def unverified(spark, sf_dir):
    return M.unverified(unique_listings(spark, sf_dir)).select("listing_id", "verif_status")


RUN_SQL = f"""{LISTINGS_SQL}, {UNIQUE_SQL}, {CANDIDATES_SQL},
ordered AS (SELECT *, lower(event_name) AS name_key, row_number() OVER (PARTITION BY lower(event_name), event_date ORDER BY s1, s2, s3, s4, s5) AS nth FROM uniq),
queries AS (SELECT event_name, event_date, city, name_key || chr(1) || CAST(event_date AS VARCHAR) AS query_id FROM ordered WHERE nth = 1 AND year(event_date) <> 1996),
offered AS (SELECT q.query_id, q.event_date AS q_date, q.city AS q_city, {tokens_sql('q.event_name')} AS qt, {tokens_sql('c.event_name')} AS ct, c.*
  FROM queries q JOIN part p ON p.p_name = q.event_name JOIN candidates c ON c.cand_seq = p.p_partkey),
named AS (SELECT *, CAST(len(list_intersect(qt, ct)) AS DOUBLE) / len(list_distinct(list_concat(qt, ct))) AS name_score FROM offered),
totals AS (SELECT query_id, source, event_name AS cand_name, cand_seq, round(name_score * 0.5
  + CASE WHEN q_date = event_date THEN 1.0 WHEN abs(date_diff('day', q_date, event_date)) <= 7 THEN 0.5 ELSE 0.0 END * 0.3
  + CASE WHEN city IS NULL THEN 0.0 WHEN lower(q_city) = lower(trim(city)) THEN 1.0 WHEN contains(lower(q_city), lower(trim(city)))
    OR contains(lower(trim(city)), lower(q_city)) THEN 0.5 ELSE 0.0 END * 0.2, 4) AS total FROM named WHERE name_score >= 0.3),
answered AS (SELECT DISTINCT query_id, source FROM offered),
{STATUS_SQL},
per_row AS (SELECT CASE WHEN year(o.event_date) = 1996 THEN 'verifiziert' ELSE s.status END AS status, year(o.event_date) = 1996 OR nth > 1 AS cached
  FROM ordered o LEFT JOIN statuses s ON s.query_id = o.name_key || chr(1) || CAST(o.event_date AS VARCHAR))
"""


@check(
    "match_verification_run",
    f"""WITH {RUN_SQL} SELECT status AS action, count(*) AS n FROM per_row GROUP BY ALL UNION ALL SELECT 'total', count(*) FROM per_row
    UNION ALL SELECT 'cached', count(*) FILTER (cached) FROM per_row""",
)
def verification_run(spark, sf_dir):
    rows = unique_listings(spark, sf_dir)
    # events of 1996 are in the store, verified six days ago
    old = rows.where(F.year("event_date") == 1996).select(F.lower("event_name").alias("name_key"), "event_date").distinct().select(
        "*", F.lit(config.VERIFIED).alias("status"), F.lit(None).cast(BEST_TYPE).alias("best"),
        F.array(F.lit("wikidata")).alias("sources_checked"), F.array(F.lit("wikidata")).alias("sources_confirmed"),
        F.lit(AS_OF - dt.timedelta(days=6)).alias("cached_on"),
    )
    c = candidates(spark, sf_dir).join(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_seq"), F.lower("p_name").alias("query_name")), "cand_seq"
    )
    answered = c.select("query_name", "source").distinct()
    return verify_listings(rows, old, c, answered, AS_OF, shared_folder(spark)).counts


# --- reference prices ------------------------------------------------------------------------------


def searched(spark, sf_dir):
    """Search results: provider pages spread over the event names, three providers each."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("event_name"))
    every = names.agg(F.count("*")).scalar()
    pages = provider_pages(spark, sf_dir).withColumn("p_partkey", F.col("k") % every).withColumn("provider_ord", F.col("k"))
    return R.check_provider_pages(pages).join(names, "p_partkey")


SEARCHED_SQL = f"""
checked AS (SELECT k, p_name AS event_name, CASE WHEN body <> '' THEN {PRICE_SQL} END AS price, CASE WHEN body <> '' THEN {SOLD_SQL} ELSE 'unbekannt' END AS sold_out,
  {PROVIDER_NAME_SQL} AS source, body <> '' AS loaded FROM provider_pages JOIN part ON p_partkey = k % (SELECT count(*) FROM part)),
hits AS (SELECT event_name, price, sold_out, source FROM (SELECT *, row_number() OVER (PARTITION BY event_name ORDER BY k) AS rk FROM checked
  WHERE loaded AND (price IS NOT NULL OR sold_out = 'ja')) WHERE rk = 1)
"""


@check("join_provider_hit", f"WITH {PROVIDER_SQL}, {SEARCHED_SQL} SELECT * FROM hits")
def provider_hit(spark, sf_dir):
    return R.first_provider_hit(searched(spark, sf_dir))


@check(
    "join_ref_price_cascade",
    f"""WITH {LISTINGS_SQL}, {PROVIDER_SQL}, {SEARCHED_SQL},
    ev AS (SELECT *, CASE WHEN l_suppkey % 50 = 0 THEN 'MEHRERE' ELSE event_name END AS name, CASE WHEN l_suppkey % 3 = 0 THEN ref_price END AS own FROM listings),
    direct AS (SELECT min(k) AS k, p_name FROM orders_k JOIN part ON p_partkey = k % (SELECT count(*) FROM part) GROUP BY p_name),
    orders_k AS (SELECT k FROM provider_pages),
    cascade AS (SELECT ev.*, CASE WHEN name = 'MEHRERE' THEN NULL WHEN year(event_date) = 1997 THEN CASE WHEN length(name) % 2 = 0 THEN 99.0 END
        WHEN name LIKE 'red%' THEN 49.9 WHEN name LIKE 'blue%' THEN d.price ELSE h.price END AS online,
      CASE WHEN year(event_date) = 1997 THEN 'oeticket' WHEN name LIKE 'red%' THEN 'manuell' WHEN name LIKE 'blue%' THEN d.source ELSE h.source END AS online_source,
      CASE WHEN year(event_date) = 1997 THEN 'nein' WHEN name LIKE 'red%' THEN 'unbekannt' WHEN name LIKE 'blue%' THEN d.sold_out ELSE coalesce(h.sold_out, 'unbekannt') END AS sold
      FROM ev LEFT JOIN hits h ON h.event_name = name
      LEFT JOIN (SELECT p_name, c.price, c.sold_out, c.source FROM direct JOIN checked c USING (k)) d ON d.p_name = name)
    SELECT listing_id, name AS event_name, CASE WHEN name = 'MEHRERE' THEN own ELSE coalesce(online, own) END AS ref_price,
      CASE WHEN name = 'MEHRERE' THEN ref_source WHEN online IS NOT NULL THEN online_source WHEN own IS NOT NULL THEN 'Anzeige' ELSE '' END AS ref_source,
      CASE WHEN name <> 'MEHRERE' THEN sold END AS sold_out FROM cascade""".replace(
        "direct AS (SELECT min(k) AS k, p_name FROM orders_k JOIN part ON p_partkey = k % (SELECT count(*) FROM part) GROUP BY p_name),\n    orders_k AS (SELECT k FROM provider_pages),",
        "direct AS (SELECT min(k) AS k, p_name FROM provider_pages JOIN part ON p_partkey = k % (SELECT count(*) FROM part) GROUP BY p_name),",
    ),
)
def ref_price_cascade(spark, sf_dir):
    k = F.col("seq.l_suppkey")
    events = listings(spark, sf_dir).withColumns(
        {"event_name": F.when(k % 50 == 0, config.MULTI_EVENT_NAME).otherwise(F.col("event_name")), "ref_price": F.when(k % 3 == 0, F.col("ref_price"))}
    )
    found = searched(spark, sf_dir)
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("event_name")).distinct()
    stored = listings(spark, sf_dir).where(F.year("event_date") == 1997).select("event_name", "event_date").distinct().select(
        keys.ref_price_key(F.col("event_name"), F.col("event_date")).alias("ref_key"),
        F.when(F.length("event_name") % 2 == 0, 99.0).alias("price"), F.lit("oeticket").alias("source"), F.lit("nein").alias("sold_out"),
    )
    links = found.groupBy("event_name").agg(F.min_by("url", "k").alias("ref_link"))
    watchlist = names.join(links, "event_name").select(
        F.lit(1).alias("line_no"), F.upper("event_name").alias("event_name"), F.when(F.col("event_name").startswith("red"), 49.9).alias("ref_price"),
        F.when(F.col("event_name").startswith("blue"), F.col("ref_link")).alias("ref_link"),
    ).where("ref_price IS NOT NULL OR ref_link IS NOT NULL")
    direct = found.select("url", "price", "sold_out", "source").distinct()
    priced, _ = R.resolve_ref_prices(events, stored, watchlist, direct, R.first_provider_hit(found))
    return priced.select("listing_id", "event_name", "ref_price", "ref_source", "sold_out")
