"""Text checks and case-insensitive matching.

Validation of a *parameter* (a search term) happens in Python before a plan
is built; validation of a *column* (incoming records) is a Spark expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's rules.
LOGIN_MIN_LEN = 4
LOGIN_MAX_LEN = 20

# Java regex: \A ... \z so that a trailing newline never matches.
_ALNUM_JAVA = r"\A[A-Za-z0-9]+\z"
_EMAIL_JAVA = r"\A[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\z"
_ALNUM_PY = re.compile(r"[A-Za-z0-9]+")


def is_alnum_value(value) -> bool:
    """Python-side check of a parameter: non-empty ASCII letters/digits only."""
    return isinstance(value, str) and _ALNUM_PY.fullmatch(value) is not None


def require_term(term) -> str:
    """Reject search terms the reference would not answer."""
    if not is_alnum_value(term):
        raise ValueError(f"search term must be non-empty and alphanumeric: {term!r}")
    return term


def is_alnum(col: Column) -> Column:
    """Column check; NULL input gives false."""
    return F.coalesce(col.rlike(_ALNUM_JAVA), F.lit(False))


def is_email(col: Column) -> Column:
    return F.coalesce(col.rlike(_EMAIL_JAVA), F.lit(False))


def length_between(col: Column, lo: int, hi: int) -> Column:
    return F.coalesce(F.length(col).between(lo, hi), F.lit(False))


def contains_ci(col: Column, term: str, fold_accents: bool = False) -> Column:
    """Case-insensitive substring match (``LIKE '%term%'`` under a _ci collation).

    ``term`` is validated alphanumeric, so it can hold no LIKE wildcard.
    ``fold_accents=True`` also ignores accents (as the reference's
    ``utf8_general_ci`` does: 'Café' matches 'cafe') via Spark's
    ``UNICODE_CI_AI`` collation.
    """
    if fold_accents:
        return F.contains(F.collate(col, "UNICODE_CI_AI"), F.lit(term))
    return col.ilike(f"%{term}%")


def text_key(col: Column) -> Column:
    """The column as a key that ignores case and accents in joins, groups and
    comparisons ("nut" = "Nut", "cafe" = "Café")."""
    return F.collate(col, "UNICODE_CI_AI")


def strip_chars(col: Column, chars: str) -> Column:
    """Remove every occurrence of each char in ``chars`` (``replaceAll`` chain)."""
    return F.translate(col, chars, "")


def nonzero_number(col: Column) -> Column:
    """JavaScript ``Number(x)`` truthiness: numeric and not zero."""
    d = col.try_cast("double")
    return F.coalesce((d != 0) & ~F.isnan(d), F.lit(False))
