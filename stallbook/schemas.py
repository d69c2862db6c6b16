"""Explicit table schemas; nothing in the package infers one."""

from __future__ import annotations

RAW_AD = (
    "listing_id STRING, listing_url STRING, title STRING, price_raw STRING, body STRING, "
    "seller_type STRING, seller_id STRING, seller_name STRING, member_since STRING, "
    "posted_on DATE, scraped_at TIMESTAMP"
)

# one extracted event; dates stay text until the date repair has seen them
EVENT_FIELDS = (
    "event_name STRING, event_date STRING, venue STRING, city STRING, category STRING, "
    "quantity INT, ask_total DOUBLE, is_unit_price BOOLEAN, ref_price DOUBLE, "
    "confidence STRING, confidence_reason STRING"
)
EVENT_COLUMNS = tuple(f.split()[0] for f in EVENT_FIELDS.split(", "))

SCAN_BATCH = (
    "listing_id STRING, listing_url STRING, event_name STRING, event_date DATE, venue STRING, "
    "city STRING, category STRING, quantity INT, ask_total DOUBLE, is_unit_price BOOLEAN, "
    "ref_price DOUBLE, ref_source STRING, sold_out STRING, confidence STRING, "
    "confidence_reason STRING, seller_type STRING, seller_name STRING, seller_id STRING, "
    "member_since STRING, model STRING, pipeline_version STRING, parse_ms BIGINT, seq BIGINT"
)

# the main table: 52 columns
LISTING = (
    "scan_date DATE, listing_url STRING, listing_id STRING, seller_id STRING, seller_name STRING, "
    "seller_type STRING, member_since STRING, event_name STRING, event_date DATE, venue STRING, "
    "city STRING, category STRING, quantity INT, ask_total DOUBLE, is_unit_price BOOLEAN, "
    "ask_unit DOUBLE, ref_price DOUBLE, ref_source STRING, margin_abs DOUBLE, margin_pct DOUBLE, "
    "sold_out STRING, watchlist STRING, confidence STRING, needs_review BOOLEAN, "
    "confidence_reason STRING, model STRING, pipeline_version STRING, parse_ms BIGINT, "
    "posted_on DATE, seller_class STRING, venue_norm STRING, venue_capacity INT, "
    "venue_type STRING, archived_on DATE, first_seen DATE, last_seen DATE, status STRING, "
    "scan_count INT, price_current DOUBLE, price_prev7 DOUBLE, price_changes INT, "
    "price_changed_on DATE, verif_status STRING, verif_sources ARRAY<STRING>, verif_on DATE, "
    "verif_name STRING, verif_score DOUBLE, ref_price_manual DOUBLE, ref_link STRING, "
    "ref_final_source STRING, ref_manual_on DATE, ref_note STRING"
)


def ddl_types(ddl: str) -> dict[str, str]:
    """Column name → type name of a flat DDL string."""
    return dict(part.split(" ", 1) for part in ddl.split(", "))


LISTING_TYPES = ddl_types(LISTING)
REVIEW_COLUMNS = (
    "listing_id", "listing_url", "event_name", "event_date", "confidence", "confidence_reason",
    "ask_total", "seller_type", "note",
)

# --- fixed values: display headers of the main table ------------------------------
HEADER_TO_COLUMN = {
    "Event-Name": "event_name",
    "Event-Datum": "event_date",
    "Venue": "venue",
    "Stadt": "city",
    "Kategorie": "category",
    "Verkäufertyp": "seller_type",
    "Verkäufername": "seller_name",
    "Anzahl Karten": "quantity",
    "Angebotspreis gesamt": "ask_total",
    "Angebotspreis pro Karte": "ask_unit",
    "Originalpreis pro Karte": "ref_price",
    "Confidence": "confidence",
    "Venue (normiert)": "venue_norm",
    "Venue-Kapazität": "venue_capacity",
    "Venue-Typ": "venue_type",
    "Vertriebsklasse": "seller_class",
    "Eingestellt am": "posted_on",
    "Zuletzt gesehen": "last_seen",
    "Status": "status",
    "Preis aktuell €/K": "price_current",
    "Preis vor 7+ Tagen €/K": "price_prev7",
    "Verif. Status": "verif_status",
    "Verif. Quellen": "verif_sources",
    "Verif. Score": "verif_score",
    "OVP manuell €/K": "ref_price_manual",
}

# --- fixed values: display headers of the dashboard, in order ----------------------
DASHBOARD_HEADERS = {
    "event_name": "Event",
    "category": "Kategorie",
    "event_date": "Datum",
    "venue": "Venue",
    "city": "Stadt",
    "venue_norm": "Venue (normiert)",
    "venue_type": "Venue-Typ",
    "venue_capacity": "Venue-Kapazität",
    "n_listings": "Gesamt Angebote",
    "private_count": "Privat Anz.",
    "private_min": "Privat Min €/K",
    "private_avg": "Privat Avg €/K",
    "private_max": "Privat Max €/K",
    "dealer_count": "Händler Anz.",
    "dealer_min": "Händler Min €/K",
    "dealer_avg": "Händler Avg €/K",
    "dealer_max": "Händler Max €/K",
    "ref_price": "OVP €/K",
    "ref_status": "OVP Status",
    "dealer_margin_abs": "Händler Marge €",
    "private_margin_abs": "Privat Marge €",
    "dealer_margin_pct": "Händler Marge %",
    "private_margin_pct": "Privat Marge %",
    "top_seller": "Top Verkäufer",
    "top_seller_count": "Top Verk. Anz.",
    "confidence_mode": "Confidence",
    "commercial_share_pct": "Gewerbl. Anteil %",
    "active_7d": "Aktiv letzte 7 Tage",
    "private_avg_current": "Privat Ø aktuell €/K",
    "private_avg_past": "Privat Ø historisch €/K",
    "dealer_avg_current": "Händler Ø aktuell €/K",
    "dealer_avg_past": "Händler Ø historisch €/K",
    "price_movement": "Preis-Bewegung",
    "verif_status_mode": "Verif. Status",
    "verif_confirmed_pct": "Verif. Bestätigt %",
    "verif_top_source": "Verif. Top-Quelle",
}
