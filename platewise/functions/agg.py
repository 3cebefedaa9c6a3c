"""Aggregate helpers with a fixed output order (GROUP_CONCAT leaves it open)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_sorted_distinct(col: Column | str, sep: str = ",") -> Column:
    """``GROUP_CONCAT(DISTINCT x)`` with ascending order. NULLs are skipped."""
    return F.array_join(F.array_sort(F.collect_set(col)), sep)


def concat_sorted(col: Column | str, sep: str = ",") -> Column:
    """``GROUP_CONCAT(x)`` keeping duplicates, ascending order."""
    return F.array_join(F.array_sort(F.collect_list(col)), sep)
