"""Fixed values that results depend on: column names, label codes, texts, thresholds and patterns."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CatalogFormat:
    """How one mission's catalogue is recognised and which labels it carries."""

    title: str
    key_columns: tuple[str, ...]
    label_columns: tuple[str, ...]
    object_column: str
    documentation: str
    expected_labels: tuple[str, ...]
    strict_name: str
    strict_columns: tuple[str, ...]


# The three known catalogue formats, in detection order.
FORMATS: dict[str, CatalogFormat] = {
    "kepler": CatalogFormat(
        title="Kepler Objects of Interest (KOI)",
        key_columns=("kepoi_name",),
        label_columns=("koi_pdisposition", "koi_disposition"),
        object_column="kepoi_name",
        documentation="https://exoplanetarchive.ipac.caltech.edu/docs/API_kepcandidate_columns.html",
        expected_labels=("CONFIRMED", "CANDIDATE", "FALSE POSITIVE"),
        strict_name="kepler_koi",
        strict_columns=("kepoi_name", "koi_period"),
    ),
    "tess": CatalogFormat(
        title="TESS Objects of Interest (TOI)",
        key_columns=("toi",),
        label_columns=("tfopwg_disp",),
        object_column="toi",
        documentation="https://exoplanetarchive.ipac.caltech.edu/docs/API_TOI_columns.html",
        expected_labels=("APC", "CP", "FA", "FP", "KP", "PC"),
        strict_name="tess_toi",
        strict_columns=("toi", "tfopwg_disp", "pl_orbper"),
    ),
    "k2": CatalogFormat(
        title="K2 Planets and Candidates",
        key_columns=("pl_name", "pl_orbper"),
        label_columns=("disposition",),
        object_column="pl_name",
        documentation="https://exoplanetarchive.ipac.caltech.edu/docs/API_k2pandc_columns.html",
        expected_labels=("CANDIDATE", "FALSE POSITIVE", "CONFIRMED", "FALSE POSITIVE CANDIDATE"),
        strict_name="k2",
        strict_columns=("pl_name", "disposition", "pl_orbper"),
    ),
}

# Object-name columns in lookup order.
OBJECT_COLUMNS = ("planet_name", "kepoi_name", "toi", "pl_name")

# Label codes by priority, best first, and their long names.
LABEL_PRIORITY = ("KP", "CP", "APC", "PC", "EB", "FP", "FA")
LABEL_NAMES = {
    "KP": "Known planet",
    "CP": "Confirmed planet",
    "APC": "Ambiguous planetary candidate",
    "PC": "Planetary candidate",
    "EB": "Eclipsing Binary",
    "FP": "False positive",
    "FA": "False alarm",
}

# Score classes, the two upper bounds, and the text for an unlisted target.
FALSE_POSITIVE = "False positive"
CANDIDATE = "Planetary candidate"
CONFIRMED = "Confirmed planet"
FALSE_POSITIVE_MAX = 0.5
CANDIDATE_MAX = 0.9
NOT_ANALYZED = "Not officially analyzed yet"

# Class texts and headers of the two exports.
EXPORT_CLASS_TEXT = {CONFIRMED: "Confirmée", CANDIDATE: "Candidate", FALSE_POSITIVE: "Faux Positif"}
SCORE_EXPORT_HEADER = ("TIC ID", "Résultat", "Score")
CONFIRMED_EXPORT_HEADER = ("Nom", "Statut Original", "Confiance", "Période (j)", "Rayon (R⊕)")

# The confirmable rule.
CONFIRMABLE_LABELS = ("CONFIRMED", "CP", "Confirmed")
CONFIRMABLE_ABOVE = 0.70
HIGH_SCORE_ABOVE = 0.8
UNKNOWN_LABEL = "UNKNOWN"

# Alias columns of the four characteristics (the transit duration of the TESS format added).
CHARACTERISTIC_COLUMNS = {
    "period": ("koi_period", "pl_orbper", "orbital_period"),
    "duration": ("koi_duration", "pl_trandur", "pl_trandurh", "transit_duration"),
    "depth": ("koi_depth", "pl_trandep", "transit_depth"),
    "radius": ("koi_prad", "pl_rade", "planet_radius"),
}

# Standardised columns and label values of the training check.
STANDARD_COLUMNS = ("orbital_period", "transit_duration", "transit_depth", "planet_radius")
STANDARD_LABEL = "disposition"
STANDARD_LABEL_VALUES = ("CONFIRMED", "FALSE POSITIVE", "CANDIDATE")
FEW_TRAINING_ROWS = 10

# Patterns of file names, download scripts and links.
TIC_PATTERN = r"-0+(\d+)-"
SECTOR_PATTERN = r"-s(\d+)-"
URL_PATTERN = r"(https://[^\s]+)"
FITS_NAME_PATTERN = r"/([^/]+\.fits)"
LC_SCRIPT_LINK = r"(?i)/tesscurl_sector_(\d+)_lc\.sh$"
DV_SCRIPT_LINK = r"(?i)/tesscurl_sector_(\d+)_dv\.sh$"
ID_SEPARATORS = r"[,\n\s]+"

# Quantiles of the numeric profile.
PROFILE_QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0)

# Job statuses that may be cleaned up, and the age in whole days.
FINISHED_STATUSES = ("completed", "failed", "error")
KEEP_DAYS = 7
