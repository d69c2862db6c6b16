"""Fixed values, thresholds and column policies.

Everything here is a default: operators take the values as parameters, so a
deployment can pass its own keyword lists, venues or thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: enumerations -------------------------------------------
CATEGORIES = ("Stehplatz", "Sitzplatz", "VIP", "Front-of-Stage", "Gemischt", "Unbekannt")
CONFIDENCES = ("hoch", "mittel", "niedrig")
PRIVATE, DEALER = "Privat", "Händler"
ACTIVE, INACTIVE, SOLD = "aktiv", "inaktiv", "verkauft"
LOW_CONFIDENCE = "niedrig"
VERIFIED, LIKELY, UNVERIFIED = "verifiziert", "wahrscheinlich", "nicht_verifiziert"
FAILED, SKIPPED = "fehler", "übersprungen"
VERIFICATION_SOURCES = ("musicbrainz", "wikidata", "songkick", "bandsintown")
INVALID_EVENT_NAMES = ("unbekannt", "none", "", "n/a", "k.a.", "k. a.", "unbekanntes event")
MULTI_EVENT_NAME = "MEHRERE"

# --- fixed values: text keywords and patterns -------------------------------
NAV_KEYWORDS = (
    "zum inhalt", "zu den suchergebnissen", "nachrichten", "einloggen", "registrieren",
    "neue anzeige aufgeben", "marktplatz", "rechtlicher hinweis",
    "noch mehr ähnliche anzeigen", "startseite", "auto & motor", "immobilien",
)
SIMILAR_ADS_MARKER = r"noch mehr ähnliche anzeigen|weitere anzeigen von\s+\S|sende eine nachricht"
CATEGORY_TITLE = r"^\d[\d.,]+ Anzeigen in "
CONTENT_HINT = (
    r"€|\beur\b|\d{1,2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2}"
    r"|\bkonzert\b|\bticket\b|\bstehplatz\b|\bsitzplatz\b|\bverkaufe\b"
)
EVENT_KEYWORDS = (
    r"\btickets?\b|\bkarten?\b|\beintrittskarten?\b|\bkonzert\b|\bfestival\b|\bevent\b"
    r"|\bveranstaltung(?:en)?\b|\blive\b|\btour\b|\bstehplatz\b|\bsitzplatz\b"
)
INJECTION = (
    r"ignoriere\s+(?:alle\s+)?(?:bisherigen?\s+)?(?:anweisungen?|instruktionen?)"
    r"|ignore\s+(?:all\s+)?(?:previous\s+)?(?:instructions?)"
    r"|(?:^|\n)\s*system\s*:"
)
SCRUBBED = "[ENTFERNT]"
CONTEXT_CHARS, CONTEXT_CHARS_V1 = 6000, 4000
# tried in this order; group 1 is the amount
PRICE_PATTERNS = (
    r"(\d{1,4}[.,]\d{2})\s*€",
    r"€\s*(\d{1,4}[.,]\d{2})",
    r"(\d{2,4})\s*€",
    r"EUR\s*(\d{1,4}[.,]?\d{0,2})",
)
PRICE_RANGE = (5.0, 5000.0)
SOLD_OUT_KEYWORDS = (
    "ausverkauft", "sold out", "sold-out", "nicht mehr verfügbar", "vergriffen",
    "nicht verfügbar", "keine tickets mehr",
)
AVAILABLE_KEYWORDS = (
    "in den warenkorb", "ticket kaufen", "jetzt kaufen", "tickets bestellen",
    "add to cart", "buy now",
)
PROVIDERS = ("oeticket", "myticket", "konzerthaus", "eventim", "ticketmaster")
CONFIRMED_PROVIDERS = ("oeticket", "myticket", "konzerthaus")
DEALER_KEYWORDS = r"Gewerblicher Anbieter|Händler|Gewerblich"
PRIVATE_KEYWORDS = r"Privater Anbieter|Privatperson|Privat"
BUSINESS_KEYWORDS = (
    "ticket", "tickets", "event", "events", "concert", "concerts", "box office",
    "agency", "gmbh", "kg", "ltd", "resell", "shop",
)
PAGE_FAILED_TEXT = "FEHLER: Seite nicht ladbar"

# --- fixed values: reason texts ---------------------------------------------
REASON_DEFAULT = "Parse-Fehler"
REASON_EMPTY = "Leere Antwort vom Modell"
REASON_STRUCTURED = "Structured-Output-Parse-Fehler"
REASON_TEXT = "JSON-Extraktion fehlgeschlagen"
REASON_LEGACY = "Ollama-Fehler oder leere Antwort"

# --- fixed values: thresholds ---------------------------------------------------
PLAUSIBLE_TOTAL, PLAUSIBLE_UNIT, PLAUSIBLE_REF_FACTOR = 300.0, 150.0, 2.0
REF_CONFLICT_SHARE = 0.05
PRICE_HISTORY_DAYS, INACTIVE_GRACE_DAYS, RECENT_DAYS = 7, 21, 7
PRICE_NOOP = 0.01
MOVEMENT_PCT = 3.0
ARCHIVE_AFTER_DAYS = 30
VERIFICATION_TTL_DAYS = 7
MIN_NAME_SCORE, CONFIRM_SCORE, VERIFIED_SCORE = 0.3, 0.5, 0.6
NAME_WEIGHT, DATE_WEIGHT, CITY_WEIGHT = 0.5, 0.3, 0.2
DATE_BAND_DAYS = 7
CANDIDATES_PER_QUERY = 5
MAX_AGE_DAYS, FIRST_RUN_MAX_AGE_DAYS = 1, 3

# --- fixed values: provider search templates, in priority order ----------------
PROVIDER_TEMPLATES = (
    "https://www.oeticket.com/search?q={event}",
    "https://www.eventim.at/search?searchterm={event}",
    "https://www.myticket.at/search?q={event}",
    "https://www.barracuda.at/?s={event}",
    "https://www.wien-ticket.at/suche?q={event}",
    "https://www.konzerthaus.at/suche?q={event}",
    "https://www.stadthalle.com/de/programm?q={event}",
    "https://www.szene-wien.com/?s={event}",
    "https://gasometer.at/?s={event}",
    "https://www.ticketmaster.at/search?q={event}",
)

# --- fixed values: venues (canonical, capacity, type, aliases, city) ------------
VENUES = (
    ("Ernst-Happel-Stadion", 51000, "Stadion",
     ["ernst happel", "happel stadion", "prater stadion", "happel"], "Wien"),
    ("Wiener Stadthalle", 16000, "Halle", ["stadthalle wien", "stadthalle", "tipsarena"], "Wien"),
    ("Gasometer Wien", 4800, "Halle", ["gasometer"], "Wien"),
    ("Szene Wien", 1200, "Club", ["szene wien"], "Wien"),
    ("Arena Wien", 2200, "Club", ["arena wien"], "Wien"),
    ("Wiener Konzerthaus", 1840, "Halle", ["konzerthaus wien", "konzerthaus"], "Wien"),
    ("Musikverein Wien", 1744, "Halle", ["musikverein"], "Wien"),
    ("Open Air Donauinsel", 200000, "Festival", ["donauinsel"], "Wien"),
    ("Wiener Volksoper", 1400, "Halle", ["volksoper"], "Wien"),
)
UNKNOWN_VENUE_TYPE = "unbekannt"


@dataclass(frozen=True)
class SiteProfile:
    """Where a marketplace keeps its detail pages and seller profiles."""

    base_url: str = "https://marketplace.example"
    detail_marker: str = "/iad/kaufen-und-verkaufen/d/"
    vendor_marker: str = "/vendor/"


# --- column groups that a merge treats specially ---------------------------------
HISTORY_COLUMNS = (
    "first_seen", "last_seen", "status", "scan_count", "price_current", "price_prev7",
    "price_changes", "price_changed_on",
)
REF_PRICE_COLUMNS = ("ref_price", "ref_source", "sold_out")
MANUAL_COLUMNS = (
    "ref_price_manual", "ref_link", "ref_final_source", "ref_manual_on", "ref_note",
)
VERIFICATION_COLUMNS = ("verif_status", "verif_sources", "verif_on", "verif_name", "verif_score")


@dataclass(frozen=True)
class MergePolicy:
    """How columns of a stored row react to a new value for the same key.

    ``keep`` columns never change, ``fill`` columns change only while they are
    missing, and every other column of the batch overwrites.
    """

    keep: tuple[str, ...] = ()
    fill: tuple[str, ...] = ()


SCAN_POLICY = MergePolicy(keep=REF_PRICE_COLUMNS + MANUAL_COLUMNS)
UPSERT_POLICY = MergePolicy(fill=REF_PRICE_COLUMNS)
PARTIAL_POLICY = MergePolicy(keep=MANUAL_COLUMNS)
