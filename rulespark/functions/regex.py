"""Regular expressions (Java's syntax)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespark.functions.std import col


def regex(pattern: str) -> str:
    return pattern


def try_regex(pattern: str) -> str | None:
    """The pattern, or none if it cannot be compiled."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return None
    return pattern


def regex_match(pattern, s) -> Column:
    return F.regexp_like(col(s), col(pattern))


def regex_first_match(pattern, s) -> Column:
    return F.regexp_substr(col(s), col(pattern))


def regex_all_matches(pattern, s) -> Column:
    return F.regexp_extract_all(col(s), col(pattern), F.lit(0))


def regex_set(patterns: list[str]) -> list[str]:
    return list(patterns)


def try_regex_set(patterns: list[str]) -> list[str] | None:
    return None if any(try_regex(p) is None for p in patterns) else list(patterns)


def regex_set_match(patterns: list[str], s) -> Column:
    """The numbers of the patterns that match."""
    hits = F.array(*(F.when(F.regexp_like(col(s), F.lit(p)), F.lit(i)) for i, p in enumerate(patterns)))
    return F.filter(hits, lambda x: x.isNotNull())
