"""Audit thresholds and name tables.

Everything the rule engine decides on is a parameter of :class:`AuditConfig`;
the defaults reproduce the behaviour of the analyst tool this library rebuilds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. These must equal the surveyed tool's constants for the audit
# to reach the same decisions; they are listed here verbatim, in their
# original order.
# ---------------------------------------------------------------------------

# name substring -> (low, high, force whole numbers); first hit wins, in this order
DOMAIN_BOUNDS = (
    ("age", 0.0, 60.0, True),
    ("rating", 0.0, 5.0, False),
    ("discount", 0.0, 1.0, False),
    ("margin", 0.0, 1.0, False),
    ("percent", 0.0, 100.0, False),
)

# classic disguised-missing codes
SENTINELS = (-9999.0, -999.0, -99.0, 999.0, 9999.0, 99999.0, 999999.0)

# names that imply a non-negative quantity (lower bound 0 only)
NON_NEGATIVE_HINTS = (
    "age", "price", "cost", "count", "qty", "quantity", "revenue", "sales",
    "salary", "amount", "weight", "height", "duration", "distance", "volume",
    "units", "refund",
)

# names whose range fix is rounded to whole numbers
WHOLE_ON_FIX_HINTS = ("age", "count", "qty", "quantity", "units", "people", "rooms", "children")

# names that suggest an integer field (float -> integer rule)
INTEGER_LIKE_HINTS = (
    "age", "count", "qty", "quantity", "units", "year", "people", "rooms",
    "children", "_id", "id_",
)

# text that looks like a date (matched at the start of the value)
DATE_LIKE_PATTERN = r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})|(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
# the two leading numeric slots of a d/m or m/d date
DATE_SLOTS_PATTERN = r"^(\d{1,2})[-/](\d{1,2})[-/]\d{2,4}"
# accounting negative "(x)" and the characters stripped from numeric text
ACCOUNTING_NEGATIVE_PATTERN = r"^\((.*)\)$"
NUMERIC_STRIP_PATTERN = r"[₹$€£,%\s]"
NUMERIC_TEXT_PATTERN = r"^-?\d+(\.\d+)?$"

# date formats tried in order (Spark datetime patterns)
DAY_FIRST_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy")
MONTH_FIRST_FORMATS = ("M/d/yyyy", "M-d-yyyy", "M/d/yy", "M-d-yy")
UNAMBIGUOUS_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "yyyyMMdd",
    "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
)
# last-resort day-first parse of whatever is left (dates, then ISO date-times)
FALLBACK_FORMATS = (
    "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d-M-yy", "d.M.yy",
    "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d'T'H:m",
    "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d MMM yyyy H:m:s",
)

# tokens a CSV reader treats as missing
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# quantiles every audit computes (quartiles and p99 for the rules, the median for the evidence pack)
AUDIT_PROBS = (0.25, 0.5, 0.75, 0.99)


@dataclass(frozen=True)
class AuditConfig:
    """Thresholds of the audit; defaults follow the surveyed tool."""

    date_rate: float = 0.6           # share of values that must look like a date (strictly more)
    numeric_rate: float = 0.8
    percent_share: float = 0.5
    category_max_distinct: int = 25
    category_min_rows: int = 50
    drop_null_pct: float = 50.0      # rounded null % strictly above -> drop column
    min_rows_stats: int = 10         # IQR / skew need this many non-null values
    iqr_k: float = 1.5
    skew_threshold: float = 1.0
    skew_severe: float = 2.0
    sentinel_p99_factor: float = 1.5
    two_digit_year_pivot: int = 69   # yy >= pivot -> 19yy, else 20yy
    domain_bounds: tuple = DOMAIN_BOUNDS
    sentinels: tuple = SENTINELS
    non_negative_hints: tuple = NON_NEGATIVE_HINTS
    whole_on_fix_hints: tuple = WHOLE_ON_FIX_HINTS
    integer_like_hints: tuple = INTEGER_LIKE_HINTS
    # "substring" (the tool's behaviour) or "token" (split the name on non-alphanumerics)
    name_match: str = "substring"
    # True keeps the tool's quirk where "discount" also matches the "count" hint
    strict_parity: bool = False
    # exact quantiles: columns with at most this many non-null values use one
    # exact percentile aggregate; larger ones are narrowed first (see operators.quantiles)
    exact_quantile_max_band: int = 16_384
    quantile_accuracy: int = 10_000

    def name_has(self, name: str, hint: str) -> bool:
        """Does column ``name`` carry ``hint``, under the configured matching mode."""
        lname = name.lower()
        if not self.strict_parity and hint == "count":
            lname = lname.replace("discount", "")
        if self.name_match == "token":
            tokens = [t for t in re.split(r"[^0-9a-z]+", lname) if t]
            h = hint.strip("_")
            return h in tokens
        return hint in lname

    def name_has_any(self, name: str, hints) -> bool:
        return any(self.name_has(name, h) for h in hints)


DEFAULT = AuditConfig()
