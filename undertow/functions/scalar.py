"""Scalar expressions: money, dates, entities, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_currency(c: str | Column) -> Column:
    """"$1,234.5" to a double; what isn't a number is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c.cast("string"), "[$,]", "").try_cast("double")


def coerce_date(c: str, fmt: str | None = None) -> Column:
    """A date, or null where there is none to read."""
    return (F.try_to_timestamp(F.col(c), F.lit(fmt)) if fmt else F.try_to_timestamp(F.col(c))).cast("date")


def fiscal_year(c: str | Column) -> Column:
    """The fiscal year from October to September."""
    return F.year(c) + F.when(F.month(c) >= 10, 1).otherwise(0)


def resolved_entity(parent: str, own: str) -> Column:
    return F.coalesce(F.col(parent), F.col(own))


def money_label(c: str) -> Column:
    """$1.2B, $3.4M, $5K, $6."""
    x = F.col(c)
    return (
        F.when(x >= 1e9, F.concat(F.lit("$"), F.format_number(x / 1e9, 1), F.lit("B")))
        .when(x >= 1e6, F.concat(F.lit("$"), F.format_number(x / 1e6, 1), F.lit("M")))
        .when(x >= 1e3, F.concat(F.lit("$"), F.format_number(x / 1e3, 0), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), F.format_number(x, 0)))
    )


def contains_count(text: Column, words: list[str]) -> Column:
    """How many of the words occur as substrings."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def pattern_count(text: Column, patterns: list[str]) -> Column:
    """How many patterns of a bag match; repeated patterns count again. A dot stops at line feeds only."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.coalesce(text.rlike("(?id)" + p), F.lit(False)).cast("int")
    return total


def any_pattern(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(text.rlike("(?id)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def platform_node(c: str | Column) -> Column:
    return F.concat(F.lit("PLATFORM:"), F.col(c) if isinstance(c, str) else c)
