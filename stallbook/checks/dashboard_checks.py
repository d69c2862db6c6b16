"""Dashboard aggregates and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stallbook.checks.catalogue import Catalogue
from stallbook.checks.views import AS_OF, LISTINGS_SQL, listings
from stallbook.operators import dashboard as D
from stallbook.schemas import DASHBOARD_HEADERS

CATALOGUE = Catalogue()
check = CATALOGUE.check

KEYS = "event_key, event_date, category"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.prepare(listings(spark, sf_dir))


def mean(total: str, n: str, scale: int = 100) -> str:
    """Exact half-up mean of integer micro-units, as a double with two digits."""
    unit = 1_000_000 // scale
    return (
        f"CASE WHEN {n} > 0 THEN ((2 * {total} + {n} * {unit}) // (2 * {n} * {unit})) / {scale}.0 END"
    )


# unit price in micro-units, as the dashboard sees it
ROWS_SQL = LISTINGS_SQL + """,
prepared AS (
  SELECT *, lower(event_name) AS event_key, coalesce(seller_type, 'Privat') AS side,
    CAST(round(CAST(coalesce(ask_unit, ask_total / quantity) AS DECIMAL(18,6)) * 1000000) AS HUGEINT) AS unit_u,
    CAST(round(price_current * 1000000) AS HUGEINT) AS now_u,
    CAST(round(price_prev7 * 1000000) AS HUGEINT) AS then_u
  FROM listings
)
"""


def share(part: str, n: str = "count(*)") -> str:
    """Percent with one digit, half up."""
    return f"((2000 * ({part}) + {n}) // (2 * {n})) / 10.0"


STATS_SQL = "count(*) AS n_listings," + ",".join(
    f"""
  count(unit_u) FILTER (side = '{label}') AS {side}_count,
  (min(unit_u) FILTER (side = '{label}') + 5000) // 10000 / 100.0 AS {side}_min,
  {mean(f"sum(unit_u) FILTER (side = '{label}')", f"count(unit_u) FILTER (side = '{label}')")} AS {side}_avg,
  (max(unit_u) FILTER (side = '{label}') + 5000) // 10000 / 100.0 AS {side}_max"""
    for side, label in D.SIDES.items()
)
SHARE_SQL = f"{share('count(*) FILTER (seller_class = $$gewerblich$$)')} AS commercial_share_pct"
RECENT = "(last_seen >= DATE '1998-11-24')"
RECENCY_SQL = f"count(*) FILTER ({RECENT} AND status = 'aktiv') AS active_7d," + ",".join(
    f"""
  {mean(f"sum(unit_u) FILTER (side = '{label}' AND {when})",
        f"count(unit_u) FILTER (side = '{label}' AND {when})")} AS {side}_avg_{name}"""
    for side, label in D.SIDES.items()
    for name, when in (("current", RECENT), ("past", f"NOT {RECENT}"))
)
MOVE_SQL = f"""
  {mean("sum(now_u)", "count(now_u)", 1_000_000)} AS cur_mean,
  {mean("sum(then_u)", "count(then_u)", 1_000_000)} AS old_mean"""
MOVE_LABEL = """CASE
  WHEN cur_mean IS NULL OR old_mean IS NULL OR old_mean = 0 THEN '➡ stabil'
  WHEN (cur_mean - old_mean) / abs(old_mean) * 100 <= -3 THEN '📉 ' || CAST(CAST(round_even((cur_mean - old_mean) / abs(old_mean) * 100, 0) AS BIGINT) AS VARCHAR) || '%'
  WHEN (cur_mean - old_mean) / abs(old_mean) * 100 >= 3 THEN '📈 +' || CAST(CAST(round_even((cur_mean - old_mean) / abs(old_mean) * 100, 0) AS BIGINT) AS VARCHAR) || '%'
  ELSE '➡ stabil' END AS price_movement"""
VERIF_SQL = f"{share('count(*) FILTER (verif_status IN ($$verifiziert$$, $$wahrscheinlich$$))')} AS verif_confirmed_pct"
MEDIAN_SQL = "median(ref_price) AS med_ref, median(ref_price_manual) AS med_man"
REF_LABEL = """
  coalesce(med_man, med_ref) AS ref_price,
  CASE WHEN med_man IS NOT NULL THEN 'manuell gepflegt ✓' WHEN med_ref IS NOT NULL THEN 'nur extrahiert ⚠'
    ELSE 'fehlt ❌' END AS ref_status"""


def margin(avg: str) -> str:
    """avg - ref_price in micro-units, rounded half up to cents."""
    micro = f"(CAST(round({avg} * 1000000) AS BIGINT) - CAST(round(ref_price * 1000000) AS BIGINT))"
    return f"sign({micro}) * ((abs({micro}) + 5000) // 10000) / 100.0"


def top(column: str, name: str, rows_from: str = "prepared") -> str:
    return f"""
{name} AS (SELECT {KEYS}, v, n FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY n DESC, v) AS rk
  FROM (SELECT {KEYS}, {column} AS v, count(*) AS n FROM {rows_from} WHERE {column} IS NOT NULL GROUP BY ALL)
) WHERE rk = 1)"""


EXPLODED_SQL = "sources AS (SELECT event_key, event_date, category, unnest(verif_sources) AS src FROM prepared)"
DAY = "CAST(event_date AS VARCHAR) AS event_date"


def shown(df: DataFrame) -> DataFrame:
    """Dates as text, so both engines print the same value."""
    return df.withColumn("event_date", F.col("event_date").cast("string"))


@check(
    "dash_drop_junk",
    f"""WITH {LISTINGS_SQL}, dirty AS (SELECT listing_id, ask_total,
      CASE WHEN l_suppkey % 5 = 0 THEN ' Unbekannt ' WHEN l_suppkey % 5 = 1 THEN NULL ELSE event_name END AS event_name,
      CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE event_date END AS event_date FROM listings)
    SELECT listing_id, event_name, CAST(event_date AS VARCHAR) AS event_date, ask_total FROM dirty
    WHERE event_name IS NOT NULL AND event_name <> ' Unbekannt ' AND event_date IS NOT NULL AND ask_total > 0""",
)
def drop_junk(spark, sf_dir):
    k = F.col("seq.l_suppkey")
    dirty = listings(spark, sf_dir).select(
        "listing_id", "ask_total",
        F.when(k % 5 == 0, " Unbekannt ").when(k % 5 == 1, None).otherwise(F.col("event_name")).alias("event_name"),
        F.when(k % 6 == 0, None).otherwise(F.col("event_date")).alias("event_date"),
    )
    return shown(D.drop_junk(dirty))


@check(
    "dash_fill_unit_price",
    f"""WITH {LISTINGS_SQL} SELECT listing_id, s2 AS part, s3 AS supp,
      coalesce(ask_unit, ask_total / quantity) AS ask_unit FROM listings""",
)
def fill_unit_price(spark, sf_dir):
    from stallbook.functions.pricing import fill_unit_ask

    return listings(spark, sf_dir).select(
        "listing_id", F.col("seq.l_partkey").alias("part"), F.col("seq.l_suppkey").alias("supp"),
        fill_unit_ask(F.col("ask_unit"), F.col("ask_total"), F.col("quantity")).alias("ask_unit"),
    )


@check(
    "dash_group_keys",
    f"""WITH {ROWS_SQL}, loose AS (SELECT CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE event_key END AS event_key,
      CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE event_date END AS event_date,
      CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE category END AS category FROM prepared)
    SELECT event_key, {DAY}, category, count(*) AS n_listings FROM loose GROUP BY ALL""",
)
def group_keys(spark, sf_dir):
    k = F.col("seq.l_suppkey")
    loose = listings(spark, sf_dir).withColumns(
        {
            "event_name": F.when(k % 9 == 0, None).otherwise(F.concat(F.lit(" "), F.upper("event_name"))),
            "event_date": F.when(k % 4 != 0, F.col("event_date")),
            "category": F.when(k % 5 != 0, F.col("category")),
        }
    )
    part = ([F.count("*").alias("n_listings")], {"n_listings": F.col("n_listings")})
    return shown(D.grouped(D.prepare(loose), part))


@check("dash_price_stats", f"WITH {ROWS_SQL} SELECT event_key, {DAY}, category, {STATS_SQL} FROM prepared GROUP BY {KEYS}")
def price_stats(spark, sf_dir):
    return shown(D.grouped(rows(spark, sf_dir), D.price_stats()))


@check(
    "dash_ref_price_medians",
    f"""WITH {ROWS_SQL}, g AS (SELECT {KEYS}, {MEDIAN_SQL} FROM prepared GROUP BY {KEYS})
    SELECT event_key, {DAY}, category, {REF_LABEL} FROM g""",
)
def ref_price_medians(spark, sf_dir):
    counts = D.value_counts(rows(spark, sf_dir), ("ref", "manual"))
    full = D.with_group_ref_price(D.distributions(counts))
    return shown(full.select(*D.GROUP, "ref_price", "ref_status"))


@check(
    "dash_margins",
    f"""WITH {ROWS_SQL}, g AS (SELECT {KEYS}, {STATS_SQL}, {MEDIAN_SQL} FROM prepared GROUP BY {KEYS}),
    r AS (SELECT *, {REF_LABEL} FROM g)
    SELECT event_key, {DAY}, category, ref_price,
      {margin('dealer_avg')} AS dealer_margin_abs, {margin('private_avg')} AS private_margin_abs,
      CASE WHEN ref_price <> 0 THEN (ref_price - dealer_avg) / ref_price * 100 END AS dealer_margin_pct,
      CASE WHEN ref_price <> 0 THEN (ref_price - private_avg) / ref_price * 100 END AS private_margin_pct FROM r""",
)
def margins(spark, sf_dir):
    prepared = rows(spark, sf_dir)
    stats = D.grouped(prepared, D.price_stats())
    dist = D.distributions(D.value_counts(prepared, ("ref", "manual")))
    full = D.with_group_margins(D.with_group_ref_price(D.join_groups(stats, dist)))
    return shown(
        full.select(
            *D.GROUP, "ref_price", "dealer_margin_abs", "private_margin_abs", "dealer_margin_pct",
            "private_margin_pct",
        )
    )


@check(
    "dash_top_seller",
    f"WITH {ROWS_SQL}, {top('seller_name', 't')} SELECT event_key, {DAY}, category, v AS top_seller, n AS top_seller_count FROM t",
)
def top_seller(spark, sf_dir):
    dist = D.top_values(D.value_counts(rows(spark, sf_dir), ("seller",)))
    return shown(dist.select(*D.GROUP, F.col("top").alias("top_seller"), F.col("top_n").alias("top_seller_count")))


@check(
    "dash_modes",
    f"""WITH {ROWS_SQL}, g AS (SELECT DISTINCT {KEYS} FROM prepared), {top('confidence', 'c')}, {top('verif_status', 'v')}
    SELECT g.event_key, CAST(g.event_date AS VARCHAR) AS event_date, g.category, c.v AS confidence_mode, v.v AS verif_status_mode
    FROM g LEFT JOIN c USING ({KEYS}) LEFT JOIN v USING ({KEYS})""",
)
def modes(spark, sf_dir):
    dist = D.distributions(D.value_counts(rows(spark, sf_dir), ("confidence", "status")))
    return shown(dist.select(*D.GROUP, "confidence_mode", "verif_status_mode"))


@check("dash_commercial_share", f"WITH {ROWS_SQL} SELECT event_key, {DAY}, category, count(*) AS n_listings, {SHARE_SQL} FROM prepared GROUP BY {KEYS}")
def commercial(spark, sf_dir):
    return shown(D.grouped(rows(spark, sf_dir), D.commercial_share()))


@check("dash_recency", f"WITH {ROWS_SQL} SELECT event_key, {DAY}, category, {RECENCY_SQL} FROM prepared GROUP BY {KEYS}")
def recency(spark, sf_dir):
    return shown(D.grouped(rows(spark, sf_dir), D.recency(AS_OF)))


@check(
    "dash_price_movement",
    f"WITH {ROWS_SQL}, g AS (SELECT {KEYS}, {MOVE_SQL} FROM prepared GROUP BY {KEYS}) SELECT event_key, {DAY}, category, {MOVE_LABEL} FROM g",
)
def movement(spark, sf_dir):
    return shown(D.grouped(rows(spark, sf_dir), D.movement()))


@check(
    "dash_verification",
    f"""WITH {ROWS_SQL}, {EXPLODED_SQL}, {top('src', 't', 'sources')},
    g AS (SELECT {KEYS}, {VERIF_SQL} FROM prepared GROUP BY {KEYS})
    SELECT g.event_key, CAST(g.event_date AS VARCHAR) AS event_date, g.category, verif_confirmed_pct, t.v AS verif_top_source
    FROM g LEFT JOIN t USING ({KEYS})""",
)
def verification(spark, sf_dir):
    prepared = rows(spark, sf_dir)
    dist = D.distributions(D.value_counts(prepared, ("source",))).select(*D.GROUP, "verif_top_source")
    return shown(D.join_groups(D.grouped(prepared, D.verified_share()), dist))


@check(
    "dash_first_row",
    f"""WITH {ROWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY s1, s2, s3, s4, s5) AS rk FROM prepared)
    SELECT event_key, {DAY}, category, event_name, venue, city, CAST(NULL AS VARCHAR) AS venue_norm,
      CAST(NULL AS VARCHAR) AS venue_type, CAST(NULL AS INTEGER) AS venue_capacity FROM r WHERE rk = 1""",
)
def first_row(spark, sf_dir):
    return shown(D.representatives(rows(spark, sf_dir)))


FULL_SQL = f"""WITH {ROWS_SQL}, {EXPLODED_SQL}, {top('seller_name', 'ts')}, {top('confidence', 'tc')},
  {top('verif_status', 'tv')}, {top('src', 'tq', 'sources')},
f AS (SELECT {KEYS}, event_name, venue, city FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY s1, s2, s3, s4, s5) AS rk FROM prepared) WHERE rk = 1),
g AS (SELECT {KEYS}, {STATS_SQL}, {SHARE_SQL}, {RECENCY_SQL}, {MOVE_SQL}, {VERIF_SQL}, {MEDIAN_SQL} FROM prepared GROUP BY {KEYS}),
r AS (SELECT *, {REF_LABEL}, {MOVE_LABEL} FROM g),
d AS (SELECT f.event_name, category, {DAY}, f.venue, f.city, CAST(NULL AS VARCHAR) AS venue_norm,
  CAST(NULL AS VARCHAR) AS venue_type, CAST(NULL AS INTEGER) AS venue_capacity, n_listings,
  private_count, private_min, private_avg, private_max, dealer_count, dealer_min, dealer_avg, dealer_max, ref_price, ref_status,
  {margin('dealer_avg')} AS dealer_margin_abs, {margin('private_avg')} AS private_margin_abs,
  CASE WHEN ref_price <> 0 THEN (ref_price - dealer_avg) / ref_price * 100 END AS dealer_margin_pct,
  CASE WHEN ref_price <> 0 THEN (ref_price - private_avg) / ref_price * 100 END AS private_margin_pct,
  ts.v AS top_seller, coalesce(ts.n, 0) AS top_seller_count, tc.v AS confidence_mode, commercial_share_pct, active_7d,
  private_avg_current, private_avg_past, dealer_avg_current, dealer_avg_past, price_movement,
  tv.v AS verif_status_mode, verif_confirmed_pct, tq.v AS verif_top_source
FROM r JOIN f USING ({KEYS}) LEFT JOIN ts USING ({KEYS}) LEFT JOIN tc USING ({KEYS})
  LEFT JOIN tv USING ({KEYS}) LEFT JOIN tq USING ({KEYS}))
"""


@check("dash_market_dashboard", FULL_SQL + "SELECT * FROM d")
def market_dashboard(spark, sf_dir):
    return shown(D.market_dashboard(listings(spark, sf_dir), AS_OF))


@check("dash_search_sort", FULL_SQL + "SELECT event_name, category, event_date, n_listings, dealer_avg FROM d WHERE regexp_matches(lower(event_name), 'r.d w|bolt')")
def search_sort(spark, sf_dir):
    board = D.market_dashboard(listings(spark, sf_dir), AS_OF)
    found = D.search_dashboard(board, "R.d W|Bolt", "dealer_avg")
    return shown(found.select("event_name", "category", "event_date", "n_listings", "dealer_avg"))


assert len(DASHBOARD_HEADERS) == 36
