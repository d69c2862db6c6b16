"""Sources, sinks, stores, migrations, and windows and limits over runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stallbook import config
from stallbook.checks.catalogue import Catalogue
from stallbook.checks.dashboard_checks import FULL_SQL
from stallbook.checks.match_checks import UNIQUE_SQL
from stallbook.checks.page_checks import BODY, TITLE, TODAY, TYPE_SQL, pages
from stallbook.checks.views import AS_OF, LISTINGS_SQL, listings, table
from stallbook.operators import dashboard as D, pages as P, state as S
from stallbook.operators.windows import run_progress
from stallbook.schemas import DASHBOARD_HEADERS, HEADER_TO_COLUMN
from stallbook.sources import migrations as G, tables as T, watchlist as L
from stallbook.sources.scratch import shared_folder

CATALOGUE = Catalogue()
check = CATALOGUE.check


def unique(spark, sf_dir):
    return S.last_wins(listings(spark, sf_dir))


# --- raw adverts: write, read, replace ---------------------------------------------------------


def raw_ads(spark, sf_dir):
    return P.extract_ads(pages(spark, sf_dir), TODAY, scraped_at=F.lit("2024-03-01 08:00:00").cast("timestamp"))


RAW_SQL = f"""raw AS (SELECT CASE WHEN regexp_matches(url, '-\\d+/?$') THEN regexp_extract(url, '-(\\d+)/?$', 1) ELSE url END AS listing_id,
  url AS listing_url, {TITLE} AS title, {BODY} AS body, page_id FROM pages),
ads AS (SELECT *, {TYPE_SQL} AS seller_type FROM raw)"""


@check("src_roundtrip_raw_ads", f"WITH {RAW_SQL} SELECT listing_id, title, body, seller_type, '2024-03-01 08:00:00' AS scraped_at FROM ads")
def roundtrip_raw_ads(spark, sf_dir):
    folder = shared_folder(spark) + "/ads"
    T.write_raw_ads(raw_ads(spark, sf_dir), folder)
    back = T.read_raw_ads(spark, folder, one_per_file=False)
    return back.select("listing_id", "title", "body", "seller_type", F.col("scraped_at").cast("string").alias("scraped_at"))


@check(
    "src_raw_ads_files",
    """SELECT 'p' || page_id AS listing_id, url AS listing_url, CASE WHEN page_id % 3 = 0 THEN '2026-04-01' END AS posted_on
    FROM pages WHERE page_id % 4 <> 0""",
)
def raw_ads_files(spark, sf_dir):
    """One JSON document per file; every fourth file is cut off in the middle. Days are ISO, German, empty or absent."""
    folder = shared_folder(spark) + "/files"
    kind = F.col("page_id") % 3
    day = F.when(kind == 0, "2026-04-01").when(kind == 1, F.when(F.col("page_id") % 2 == 0, "01.04.2026").otherwise(""))
    doc = F.to_json(F.struct(F.concat(F.lit("p"), F.col("page_id")).alias("listing_id"), F.col("url").alias("listing_url"), F.col("page_id").cast("string").alias("title"), day.alias("posted_on")))
    docs = pages(spark, sf_dir).select("page_id", doc.alias("doc")).select(
        F.when(F.col("page_id") % 4 == 0, F.expr("substr(doc, 1, length(doc) - 5)")).otherwise(F.col("doc")).alias("value"), "page_id"
    )
    docs.repartitionByRange(F.col("page_id")).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return T.read_raw_ads(spark, folder).select("listing_id", "listing_url", F.col("posted_on").cast("string").alias("posted_on"))


@check(
    "src_replace_keyed",
    f"""WITH {LISTINGS_SQL}, {UNIQUE_SQL}, old AS (SELECT * FROM uniq WHERE CAST(listing_id AS BIGINT) % 3 <> 0),
    new AS (SELECT listing_id, max(ask_total) AS ask_total FROM listings WHERE CAST(listing_id AS BIGINT) % 2 = 0 GROUP BY ALL)
    SELECT listing_id, ask_total FROM new UNION ALL SELECT listing_id, ask_total FROM old WHERE listing_id NOT IN (SELECT listing_id FROM new)""",
)
def replace_keyed(spark, sf_dir):
    k = F.col("listing_id").cast("bigint")
    old = unique(spark, sf_dir).where(k % 3 != 0).select("listing_id", "ask_total")
    new = listings(spark, sf_dir).where(k % 2 == 0).select("listing_id", "ask_total")
    return T.replace_keyed(old, new, ["listing_id"], F.col("ask_total"))


# --- main table -----------------------------------------------------------------------------------

SHOWN = ("event_name", "event_date", "category", "quantity", "ask_total", "ask_unit", "ref_price", "seller_type", "last_seen")


@check(
    "src_load_listings",
    f"""WITH {LISTINGS_SQL} SELECT event_name, CAST(event_date AS VARCHAR) AS event_date, category, quantity, ask_total,
      coalesce(ask_unit, ask_total / quantity) AS ask_unit, ref_price, seller_type, CAST(last_seen AS VARCHAR) AS last_seen,
      coalesce(array_to_string(verif_sources, ';'), '') AS sources, CAST(NULL AS VARCHAR) AS posted_on FROM listings""",
)
def load_listings(spark, sf_dir):
    """Exported with display headers as CSV text, read back typed."""
    folder = shared_folder(spark) + "/export"
    rows = listings(spark, sf_dir)
    columns = [c for c in HEADER_TO_COLUMN.values() if c in rows.columns]
    names = {v: k for k, v in HEADER_TO_COLUMN.items()}
    T.write_csv(T.export_rows(rows.select(*columns)).withColumnsRenamed(names), folder)
    df = T.load_listings(spark, folder, "csv")
    sources = F.concat_ws(";", F.filter("verif_sources", lambda s: s != ""))
    return df.select(
        *[F.col(c).cast("string").alias(c) if c in ("event_date", "last_seen") else c for c in SHOWN], sources.alias("sources"),
        F.col("posted_on").cast("string").alias("posted_on"),
    )


@check(
    "src_drop_empty_rows",
    f"""WITH {LISTINGS_SQL} SELECT listing_id, ask_total, q FROM (SELECT CASE WHEN l_suppkey % 3 = 0 THEN listing_id WHEN l_suppkey % 3 = 1 THEN '' END AS listing_id,
      CASE WHEN l_suppkey % 4 = 0 THEN ask_total END AS ask_total, CASE WHEN l_suppkey % 5 = 0 THEN 0 END AS q FROM listings)
    WHERE listing_id <> '' OR ask_total IS NOT NULL""",
)
def drop_empty_rows(spark, sf_dir):
    k = F.col("seq.l_suppkey")
    rows = listings(spark, sf_dir).select(
        F.when(k % 3 == 0, F.col("listing_id")).when(k % 3 == 1, "").alias("listing_id"), F.when(k % 4 == 0, F.col("ask_total")).alias("ask_total"),
        F.when(k % 5 == 0, 0).alias("q"),
    )
    return T.drop_empty_rows(rows)


@check("src_roundtrip_csv", f"WITH {LISTINGS_SQL} SELECT listing_id, event_name, seller_name, CAST(quantity AS VARCHAR) AS quantity FROM listings")
def roundtrip_csv(spark, sf_dir):
    folder = shared_folder(spark) + "/csv"
    T.write_csv(listings(spark, sf_dir).select("listing_id", "event_name", "seller_name", "quantity"), folder)
    return spark.read.option("header", True).schema("listing_id STRING, event_name STRING, seller_name STRING, quantity STRING").csv(folder)


@check(
    "src_table_to_dashboard",
    FULL_SQL + "SELECT event_name, category, event_date, n_listings, dealer_avg, top_seller, price_movement, round(dealer_margin_pct, 2) AS dealer_margin_pct FROM d",
)
def table_to_dashboard(spark, sf_dir):
    """Exported CSV with display headers → stored dashboard with display headers."""
    folder = shared_folder(spark)
    rows = listings(spark, sf_dir)
    columns = [c for c in HEADER_TO_COLUMN.values() if c in rows.columns]
    others = [c for c in D.OPTIONAL if c in rows.columns and c not in columns]
    parts = [F.date_format("seq.l_shipdate", "yyyy-MM-dd"), *[F.lpad(F.col(f"seq.{c}").cast("string"), 12, "0") for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")]]
    # the order of the rows as text that sorts like its parts
    shown = T.export_rows(rows.select("listing_id", *columns, *others, F.concat_ws("|", *parts).alias("seq")))
    T.write_csv(shown.withColumnsRenamed({v: k for k, v in HEADER_TO_COLUMN.items()}), folder + "/export", compression="gzip")
    board = D.market_dashboard(T.load_listings(spark, folder + "/export", "csv"), AS_OF)
    T.write_dashboard(board, folder + "/dashboard", headers=True)
    back = spark.read.parquet(folder + "/dashboard")
    assert back.columns == list(DASHBOARD_HEADERS.values())
    names = ("event_name", "category", "event_date", "n_listings", "dealer_avg", "top_seller", "price_movement", "dealer_margin_pct")
    return back.select(*[F.col(DASHBOARD_HEADERS[c]).cast("string").alias(c) if c == "event_date" else F.col(DASHBOARD_HEADERS[c]).alias(c) for c in names])


@check(
    "src_roundtrip_dashboard",
    FULL_SQL + """SELECT event_name, category, event_date, n_listings, dealer_avg, top_seller, price_movement,
      round(dealer_margin_pct, 2) AS dealer_margin_pct FROM d""",
)
def roundtrip_dashboard(spark, sf_dir):
    folder = shared_folder(spark) + "/dashboard"
    T.write_dashboard(D.market_dashboard(listings(spark, sf_dir), AS_OF), folder)
    back = spark.read.parquet(folder)
    assert back.columns == list(DASHBOARD_HEADERS)
    return back.select(
        "event_name", "category", F.col("event_date").cast("string").alias("event_date"), "n_listings", "dealer_avg", "top_seller",
        "price_movement", "dealer_margin_pct",
    )


@check(
    "src_export_rows",
    f"""WITH {LISTINGS_SQL} SELECT listing_id, CASE WHEN is_unit_price THEN 'ja' ELSE 'nein' END AS is_unit_price, coalesce(seller_type, '') AS seller_type,
      coalesce(array_to_string(verif_sources, '; '), '') AS verif_sources, CAST(quantity AS VARCHAR) AS quantity FROM listings""",
)
def export_rows(spark, sf_dir):
    return T.export_rows(listings(spark, sf_dir).select("listing_id", "is_unit_price", "seller_type", "verif_sources", "quantity"))


# --- stores -------------------------------------------------------------------------------------------


@check(
    "src_roundtrip_parse_store",
    """SELECT 'hit' AS kind, CAST(conv_id AS VARCHAR) AS listing_id, count(*) AS n FROM conversations WHERE conv_id % 2 = 0 GROUP BY ALL
    UNION ALL SELECT DISTINCT 'miss', CAST(conv_id AS VARCHAR), 0 FROM conversations WHERE conv_id % 2 = 1""",
)
def roundtrip_parse_store(spark, sf_dir):
    """Conversations stand for parsed adverts: the turns are the events."""
    folder = shared_folder(spark) + "/parsed"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("listing_id"), "conv_id", "turn", "role")
    entries = turns.where("conv_id % 2 = 0").groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("events"))
    entries.write.parquet(folder)
    store = T.read_store(spark, folder, "listing_id STRING, events ARRAY<STRUCT<turn: BIGINT, role: STRING>>")
    wanted = turns.select("listing_id").distinct()
    hits = T.store_hits(wanted, store, "listing_id").select(F.lit("hit").alias("kind"), "listing_id", F.size("events").cast("bigint").alias("n"))
    misses = T.store_misses(wanted, store, "listing_id").select(F.lit("miss"), "listing_id", F.lit(0).cast("bigint"))
    return hits.union(misses)


@check(
    "src_roundtrip_ref_store",
    f"""WITH {LISTINGS_SQL} SELECT lower(event_name) || '|' || CAST(event_date AS VARCHAR) AS ref_key, min(ref_price) AS price FROM listings GROUP BY ALL""",
)
def roundtrip_ref_store(spark, sf_dir):
    from stallbook.functions.keys import ref_price_key

    folder = shared_folder(spark) + "/refs"
    key = ref_price_key(F.col("event_name"), F.col("event_date")).alias("ref_key")
    listings(spark, sf_dir).groupBy(key).agg(F.min("ref_price").alias("price")).write.parquet(folder)
    return T.read_store(spark, folder, "ref_key STRING, price DOUBLE")


@check("src_roundtrip_incremental_copy", "SELECT page_id, url FROM pages")
def incremental_copy(spark, sf_dir):
    """Two copies into the same target: the second brings only what is missing."""
    folder = shared_folder(spark) + "/copy"
    source = pages(spark, sf_dir).select("page_id", "url")
    source.where("page_id % 3 = 0").write.parquet(folder)
    for _ in range(2):
        T.append_missing(source, spark.read.schema(source.schema).parquet(folder), "page_id", folder)
    return spark.read.schema(source.schema).parquet(folder)


# --- watchlist and search URLs -----------------------------------------------------------------------


@check(
    "src_watchlist",
    """SELECT p_name AS event_name, CASE WHEN p_partkey % 4 <> 3 THEN CAST(p_retailprice AS DOUBLE) END AS ref_price,
      CASE WHEN p_partkey % 3 = 0 THEN 'https://x.example/' || p_partkey END AS ref_link FROM part WHERE p_partkey % 7 <> 0""",
)
def watchlist(spark, sf_dir):
    folder = shared_folder(spark) + "/watchlist"
    k = F.col("p_partkey")
    price = F.replace(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    line = F.concat(
        F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))),
        F.when(k % 3 == 0, F.concat(F.lit("| link: https://x.example/"), k.cast("string"))).otherwise(""),
        F.when(k % 4 == 3, "| OVP: gratis").otherwise(F.concat(F.lit("| ovp: "), price)),
    )
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(folder)
    return L.read_watchlist(spark, folder).drop("line_no")


@check(
    "src_watchlist_json",
    """SELECT p_name AS event_name, CASE WHEN p_partkey % 4 <> 3 THEN CAST(p_retailprice AS DOUBLE) END AS ref_price,
      CASE WHEN p_partkey % 3 = 0 THEN 'https://x.example/' || p_partkey END AS ref_link FROM part WHERE p_partkey % 7 <> 0""",
)
def watchlist_json(spark, sf_dir):
    """Settings documents, one per line, each with the entry of a part and one without a name."""
    folder = shared_folder(spark) + "/settings"
    k = F.col("p_partkey")
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    entry = F.struct(
        F.when(k % 7 != 0, F.concat(F.lit(" "), F.col("p_name"))).alias("event_name"),
        F.when(k % 4 == 3, "gratis").otherwise(price).alias("ovp_preis"),
        F.when(k % 3 == 0, F.concat(F.lit("https://x.example/"), k.cast("string"))).otherwise("").alias("ovp_link"),
    )
    nameless = F.struct(F.lit("").alias("event_name"), F.lit("1").alias("ovp_preis"), F.lit("").alias("ovp_link"))
    table(spark, sf_dir, "part").select(F.array(entry, nameless).alias("watchlist")).write.json(folder)
    return L.read_watchlist_json(spark, folder, one_per_file=False).drop("line_no")


@check(
    "src_provider_urls",
    "SELECT event_name, provider_ord, replace(template, '{event}', replace(event_name, ' ', '+')) AS url FROM (SELECT DISTINCT p_name AS event_name FROM part), (VALUES "
    + ", ".join(f"({i}, '{t}')" for i, t in enumerate(config.PROVIDER_TEMPLATES)) + ") t(provider_ord, template)",
)
def provider_urls(spark, sf_dir):
    return L.provider_urls(table(spark, sf_dir, "part").select(F.col("p_name").alias("event_name")).distinct())


# --- migrations -----------------------------------------------------------------------------------------


@check(
    "src_migrate_columns",
    f"""WITH {LISTINGS_SQL} SELECT listing_id, ref_price_manual, CAST(NULL AS VARCHAR) AS ref_link, CAST(NULL AS VARCHAR) AS ref_note,
      CAST(NULL AS VARCHAR) AS ref_manual_on, 4 AS added, 0 AS added_again FROM listings""",
)
def migrate_columns(spark, sf_dir):
    once, n = G.add_missing_columns(listings(spark, sf_dir))
    twice, again = G.add_missing_columns(once)
    return twice.select(
        "listing_id", "ref_price_manual", "ref_link", "ref_note", F.col("ref_manual_on").cast("string").alias("ref_manual_on"),
        F.lit(n).alias("added"), F.lit(again).alias("added_again"),
    )


@check(
    "src_migrate_history",
    f"""WITH {LISTINGS_SQL} SELECT listing_id, CAST(CASE WHEN l_suppkey % 3 = 0 THEN DATE '1990-01-01' ELSE last_seen END AS VARCHAR) AS first_seen,
      CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'aktiv' END AS status, CASE WHEN l_suppkey % 3 <> 0 THEN 1 END AS scan_count,
      CASE WHEN l_suppkey % 3 <> 0 THEN ask_unit END AS price_current, CASE WHEN l_suppkey % 3 <> 0 THEN 0 END AS price_changes FROM listings""",
)
def migrate_history(spark, sf_dir):
    """A third of the rows is migrated already and stays as it is."""
    done = F.col("seq.l_suppkey") % 3 == 0
    old = listings(spark, sf_dir).select(
        "listing_id", "ask_unit", F.concat(F.col("last_seen").cast("string"), F.lit(" 10:00")).alias("scan_date"),
        F.when(done, F.lit("1990-01-01").cast("date")).alias("first_seen"),
    )
    out = G.add_history(G.add_history(old))
    return out.select("listing_id", F.col("first_seen").cast("string").alias("first_seen"), "status", "scan_count", "price_current", "price_changes")


# --- windows, limits, set operations ------------------------------------------------------------------------


@check("win_rank_one", """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rk FROM events) WHERE rk = 1""")
def rank_one(spark, sf_dir):
    best = P.first_wins(table(spark, sf_dir, "events"), ["user_id"], F.col("value").desc(), F.col("event_id"))
    return best.select("user_id", "event_id", "value")


@check(
    "win_run_progress",
    """WITH runs AS (SELECT user_id AS run_id, event_id AS seq, CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS d, event_type = 'error' AS failed FROM events),
    n AS (SELECT *, count(*) OVER w AS current, count(d) OVER w AS known, count(*) FILTER (failed) OVER w AS errors, count(*) OVER (PARTITION BY run_id) AS total
      FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT run_id, seq, current, errors, sum(d) OVER k AS sum_ms, count(d) OVER k AS n_ms,
      current || '/' || total || ' (' || CAST(floor(CAST(current AS DOUBLE) / total * 100) AS BIGINT) || '%)' AS progress
    FROM n WINDOW k AS (PARTITION BY run_id ORDER BY known RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def progress(spark, sf_dir):
    """Users stand for runs; small chunks, so that runs cross them."""
    ms = F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("bigint"))
    runs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), ms.alias("duration_ms"), (F.col("event_type") == "error").alias("failed")
    )
    out = run_progress(runs, chunk=500)
    n = F.least(F.col("known"), F.lit(10))
    return out.select(
        "run_id", "seq", "current", "errors", F.round(F.col("avg_duration_ms") * n).cast("bigint").alias("sum_ms"), n.alias("n_ms"), "progress"
    )


@check("win_limit", "SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 500")
def limit(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(500).select("event_id", "user_id")


@check(
    "win_union_results",
    """SELECT event_id, 'stored' AS origin, CAST(NULL AS DOUBLE) AS value FROM events WHERE event_type = 'view'
    UNION ALL SELECT event_id, 'fresh', value FROM events WHERE event_type <> 'view'""",
)
def union_results(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    stored = e.where("event_type = 'view'").select("event_id", F.lit("stored").alias("origin"))
    fresh = e.where("event_type <> 'view'").select("value", "event_id", F.lit("fresh").alias("origin"))
    return stored.unionByName(fresh, allowMissingColumns=True)


@check(
    "win_set_difference",
    """SELECT 'new' AS kind, user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 480) GROUP BY ALL
    UNION ALL SELECT 'known', user_id, count(*) FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 480) GROUP BY ALL""",
)
def set_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    known = e.where("value > 480").select("user_id")

    def count(rows, kind):
        return rows.groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "user_id", "n")

    return count(T.missing_from(e, known, "user_id"), "new").union(count(T.store_hits(known, e, "user_id"), "known"))
