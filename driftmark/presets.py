"""Domain vocabulary of the health-app registry this library is preset for.

Every value below is a fixed value: it has to be equal, character by character, to what
existing event files, snapshots and mails of that registry contain.  Operators take a
``Profile`` and read the vocabulary from it, so another registry needs another profile only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: identity and diff -------------------------------------------------------
IDENTITY_KEYS = ("id", "identifier", "url", "name", "title")
DISPLAY_NAME_KEYS = ("name", "title", "id", "identifier")
UNNAMED = "Unnamed entry"
IGNORED_PATHS = ("structured_text_sections", "content_sections", "rendered_structure_metadata")
IGNORED_PREFIXES = ("raw_public_fhir",)

# ---- fixed values: change types and labels -------------------------------------------------
ENTRY_FIELD = "<entry>"
ADDED = "new_diga"
REMOVED = "removed_diga"
STATUS = "status_change"
TEXT = "text_change"
PRICE = "price_change"
OTHER = "other_field_change"
PRICE_PATH_MARKERS = ("price", "pricing_information", "preis")

CHANGE_LABELS = {
    "new_diga": "Neue DiGA",
    "removed_diga": "Nicht mehr gefunden",
    "status_change": "Statusänderung",
    "text_change": "Textänderung",
    "price_change": "Preisänderung",
    "other_field_change": "Sonstige Feldänderung",
}
DELISTED_STATUS = "gestrichen"
DELISTED_LABEL = "Streichung"
CHANGE_LABEL_DEFAULT = "Änderung"
MAIL_CHANGE_LABEL_DEFAULT = "Unbekannt"

EVENT_FIELD_LABELS = {
    "evidence_summary_text": "Bewertungsentscheidung des BfArM",
    "descriptive_texts": "Beschreibung der DiGA",
    "pricing_information": "Vergütung / Preisangaben",
    "source_update_notice": "Aktualisierungshinweis im DiGA-Verzeichnis",
    "status": "Aufnahmestatus",
    "indication": "Anwendungsgebiet / Indikation",
    "manufacturer": "Hersteller",
    "name": "Name der DiGA",
    "bfarm_directory_url": "BfArM-Verzeichniseintrag",
}
FEED_FIELD_LABELS = {
    "evidence_summary_text": "Bewertungsentscheidung des BfArM",
    "descriptive_texts": "Beschreibung der DiGA",
    "pricing_information": "Vergütung / Preisangaben",
    "source_update_notice": "Aktualisierungshinweis im DiGA-Verzeichnis",
    "source_update_notice.notice_text": "Aktualisierungshinweis im DiGA-Verzeichnis",
    "source_update_notice.last_updated_at": "Zuletzt aktualisiert",
    "status": "Aufnahmestatus",
    "name": "Name der DiGA",
    "indication": "Anwendungsgebiet / Indikation",
    "manufacturer": "Hersteller",
    "manufacturer_website": "Herstellerlink / Website",
    "bfarm_directory_url": "BfArM-Verzeichniseintrag",
    "platforms": "Plattformen",
    "languages": "Sprachen",
    "modules": "Module / Funktionsumfang",
}
MAIL_FIELD_LABELS = {
    "evidence_summary_text": "Bewertungsentscheidung des BfArM",
    "descriptive_texts": "Beschreibung der DiGA",
    "pricing_information": "Vergütung / Preisangaben",
    "source_update_notice": "Aktualisierungshinweis im DiGA-Verzeichnis",
    "status": "Aufnahmestatus",
    "indication": "Anwendungsgebiet / Indikation",
    "manufacturer": "Hersteller",
}
UNKNOWN_AREA = "Unbekannter Bereich"
TEXT_KIND_LABELS = {
    "text_removed": "Text entfernt",
    "text_added": "Text ergänzt",
    "text_modified": "Text angepasst",
    "text_replaced": "Formulierung angepasst",
    "mixed_text_change": "Text geändert",
}
SECTION_CHANGE_LABELS = {
    "added_section": "Hinzugefügte Section",
    "removed_section": "Entfernte Section",
    "changed_text": "Geänderter Text",
    "changed_field_value": "Geändertes Feld/Wert-Paar",
}

# ---- fixed values: text fields, sections and suppression ------------------------------------
EVIDENCE_FIELD = "evidence_summary_text"
EVIDENCE_SECTION = "Bewertungsentscheidung des BfArM"
DESCRIPTION_PREFIX = "descriptive_texts."
QUESTIONNAIRE_PREFIX = "questionnaire."
BOILERPLATE_START = "bitte geben sie hier einen steckbrief"
BOILERPLATE_PART = "steckbrief zu ihrer diga"
PROFILE_QUESTION_WORDS = ("steckbrief", "diga")
PROFILE_QUESTION_LABEL = "Steckbrief der DiGA"
UNASSIGNED_SECTION = "Nicht eindeutig zugeordneter Textabschnitt"
MOVED_MIN_WORDS = 20
MOVED_PREFIX_CHARS = 240
LABEL_COLON_LIMIT = 180
SECTION_ROUTES = (
    (
        "Informationen zum positiven Versorgungseffekt",
        (
            "versorgungseffekt",
            "nachweis",
            "pico",
            "studie",
            "studiendesign",
            "erprobungszeitraum",
            "medizinischer nutzen",
            "patientenrelevante struktur",
        ),
    ),
    (
        "Informationen zu Datenschutz und Datensicherheit",
        ("datenschutz", "datensicherheit", "datenverarbeitung"),
    ),
    (
        "Weitere Informationen zur digitalen Gesundheitsanwendung",
        ("zweckbestimmung", "zielsetzung", "wirkungsweise", "inhalt", "nutzung"),
    ),
    ("Weitere Informationen", ("preis", "kosten", "vergütung")),
)
SECTION_DEFAULT = "Beschreibung der DiGA"

# ---- fixed values: metadata events -----------------------------------------------------------
NOTICE_FIELD = "source_update_notice"
NOTICE_TIME_FIELD = "source_update_notice.last_updated_at"
METADATA_FIELDS = (
    "source_update_notice",
    "source_update_notice.checked_sources",
    "source_update_notice.last_updated_at",
    "source_update_notice.notice_text",
)
METADATA_PREFIX = "raw_public_fhir"
METADATA_MARKERS = ("last_updated", "updated_at", "timestamp", "checked_sources")
CHECKED_SOURCES = "checked_sources"

# ---- fixed values: summaries and digest ------------------------------------------------------
SUMMARY_TEXT = {
    "text_removed": "Im Abschnitt '%s' wurde ein Textabschnitt entfernt.",
    "text_added": "Im Abschnitt '%s' wurde Text ergänzt.",
    "text_replaced": "Die Formulierung im Abschnitt '%s' wurde angepasst.",
    "text_modified": "Die Formulierung im Abschnitt '%s' wurde angepasst.",
}
SUMMARY_TEXT_DEFAULT = "Im Abschnitt '%s' wurde Text geändert."
SUMMARY_PRICE = "Die Preisangabe wurde von %s auf %s geändert."
SUMMARY_STATUS = "Der Aufnahmestatus wurde von '%s' auf '%s' geändert."
SUMMARY_ADDED = "Eine neue DiGA wurde in das Verzeichnis aufgenommen."
SUMMARY_REMOVED = "Eine DiGA ist im aktuellen Verzeichnis nicht mehr vorhanden."
SUMMARY_OTHER = "Im Abschnitt '%s' wurde ein Wert geändert."
SHORT_TEXT = {
    "text_removed": "Ein Textabschnitt wurde entfernt.",
    "text_added": "Der Text wurde ergänzt.",
    "text_modified": "Die Formulierung wurde angepasst.",
    "text_replaced": "Die Formulierung wurde angepasst.",
}
SHORT_TEXT_DEFAULT = "Text wurde geändert."
SHORT_OTHER = {
    "new_diga": "Eine neue DiGA wurde aufgenommen.",
    "removed_diga": "Eine DiGA wurde gestrichen.",
    "status_change": "Der Aufnahmestatus wurde geändert.",
    "price_change": "Preisangaben wurden geändert.",
}
SHORT_DEFAULT = "Ein Feld wurde geändert."
LONG_TEXT_REMOVED = "Text entfernt · ca. %d Wörter entfernt"
LONG_TEXT_ADDED = "Text ergänzt · ca. %d Wörter ergänzt"
LONG_TEXT_BOTH = "Text stark angepasst · ca. %d Wörter entfernt, ca. %d Wörter ergänzt"
LONG_TEXT_DEFAULT = "Text stark angepasst"
UNKNOWN_ENTITY = "Unbekannte DiGA"
DIGEST_SUBJECT = "%d Änderung(en) erkannt"
DIGEST_NO_CHANGES = "Keine echten Änderungen erkannt."
DIGEST_NOT_SENT = "Dry-run: email not sent."
EXCERPT_REMOVED = "Entfernt: "
EXCERPT_ADDED = "Hinzugefügt: "
EXCERPT_DEFAULT = "Text/Wert geändert."

# ---- fixed values: prices -----------------------------------------------------------------------
PERIOD_KEYS = ("effective_period", "effectivePeriod", "period")
PRICE_VERDICTS = {
    "amount": "Preiswert geändert",
    "period": "Preiszeitraum aktualisiert",
    "order": "Keine fachliche Preisänderung",
    "opaque": "Technische Änderung in Preis-/Vergütungsdaten",
}
PRICE_MISSING = "Preis nicht angegeben"
VALIDITY = {
    "both": "gültig von %s bis %s",
    "start": "gültig ab %s",
    "end": "gültig bis %s",
    "none": "Gültigkeitszeitraum nicht angegeben",
}
PRICE_LINE = "Preiszeitraum %d: %s, %s"
PRICE_TEXT_MARKERS = ("€", "EUR", "preis")

# ---- fixed values: record assembly ----------------------------------------------------------------
ENTITY_IDENTIFIER = "DigaId"
ENTITY_ID_WIDTH = 5
DEVICE_REFERENCE = "DeviceDefinition/"
ORGANIZATION_REFERENCE = "Organization/"
STATUS_RULES = (
    ("listed", ("dauerhaft", "permanent")),
    ("provisional", ("vorläufig", "vorlaeufig", "provisional")),
    ("removed", ("gestrichen", "entfernt", "removed")),
)
DESCRIPTION_MARKERS = (
    "description",
    "summary",
    "summaries",
    "steckbrief",
    "text",
    "subtitle",
    "information",
    "purpose",
    "effect",
)
DESCRIPTION_MIN_CHARS = 40
EVIDENCE_KEYWORDS = ("evidenz", "versorgungseffekt", "studie", "nachweis", "evaluation", "endpunkt")
EVIDENCE_EXCLUDED = "steckbrief"
HISTORY_EXTENSION = "https://fhir.bfarm.de/StructureDefinition/HealthAppCatalogEntryHistory"
HISTORY_CHILD = "entry"
DATA_NOTICE = "Wiedergabe der vom Hersteller übermittelten Angaben"
UPDATE_NOTICE = "Zuletzt aktualisiert am %s um %s"
UPDATE_NOTICE_RAW = "Zuletzt aktualisiert am %s"
DIRECTORY_URL_PATTERN = r"^https://diga\.bfarm\.de/de/verzeichnis/\d{5}$"
DIRECTORY_URL_TEMPLATE = "https://diga.bfarm.de/de/verzeichnis/%s"
STUB_STATUS = "unknown"
STUB_SOURCE = "BfArM sitemap only; no matching FHIR record found"

# ---- fixed values: page sections --------------------------------------------------------------------
REJECTED_TEXTS = (
    "diga-verzeichnis",
    "bfarm-eintrag öffnen",
    "mehr erfahren",
    "zurück",
    "menü",
    "suche",
    "teilen",
    "kontakt",
    "impressum",
    "datenschutz",
    "informationen für fachkreise",
    "hilfe & support",
    "hilfe und support",
    "leichte sprache",
    "gebaerdensprache",
)
REJECTED_ROOTS = (
    "Seiteninhalt",
    "Informationen für Fachkreise",
    "Hilfe & Support",
    "Hilfe und Support",
    "Leichte Sprache",
    "Gebärdensprache",
)
REJECTED_NODE = "Gebrauchsanweisung (PDF)"
FALLBACK_ROOT = "Seiteninhalt"
SOURCE_KIND = "visible_directory"
SLUG_FALLBACK = "diga"

# ---- fixed values: column names in existing event files ----------------------------------------------
LEGACY_EVENT_COLUMNS = {
    "entity_id": "diga_id",
    "entity_name": "diga_name",
    "entity_url": "bfarm_directory_url",
    "field": "changed_field",
    "before": "previous_value",
    "after": "new_value",
    "previous_snapshot_ts": "previous_snapshot_timestamp",
    "current_snapshot_ts": "current_snapshot_timestamp",
    "field_label": "user_facing_field_label",
    "summary": "summary_de",
}
SNAPSHOT_TIME_FORMAT = "yyyyMMdd'T'HHmmssSSSSSS'Z'"
DISPLAY_TIMEZONE = "Europe/Berlin"


@dataclass(frozen=True)
class Profile:
    """The vocabulary an operator needs; defaults are the registry preset above."""

    identity_keys: tuple = IDENTITY_KEYS
    name_keys: tuple = DISPLAY_NAME_KEYS
    ignored_paths: tuple = IGNORED_PATHS
    ignored_prefixes: tuple = IGNORED_PREFIXES
    price_markers: tuple = PRICE_PATH_MARKERS
    evidence_field: str = EVIDENCE_FIELD
    section_routes: tuple = SECTION_ROUTES
    section_default: str = SECTION_DEFAULT
    field_labels: dict = field(default_factory=lambda: dict(EVENT_FIELD_LABELS))
    timezone: str = DISPLAY_TIMEZONE


DEFAULT = Profile()

# How amounts are found in text.
AMOUNT_IN_TEXT = r"(?i)(\d+(?:[.,]\d{1,2})?)\s*(€|EUR)"
AMOUNT_WITH_CURRENCY = r"(?i)(\d+(?:[.,]\d+)?)\s*([A-Z]{3}|€)"
