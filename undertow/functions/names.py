"""Names for display."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms cut off a name's end, words that stay lower case inside a name, acronyms that keep their case.
LEGAL_FORMS = ["LIMITED LIABILITY COMPANY", "PROFESSIONAL SERVICES", "CORPORATION", "L.L.C", "L.P", "INC", "LLC", "CORP"]
SMALL_WORDS = ["And", "Of", "The", "For"]
ACRONYMS = ["MERP"]

# Tokens written in capitals, and brands with a case of their own.
CAPITALS = [
    "LLC", "L.L.C.", "LP", "L.P.", "LLP", "PLC", "AG", "NV", "SA", "SHI", "DLT", "CDW", "IBM", "SAIC", "CGI", "GDIT", "NCI", "ECS", "IT", "US", "USA", "DC", "HP", "AT&T",
    "NTT", "KPMG", "EY", "PWC",
]
BRANDS = {"Teksystems": "TEKsystems", "Servicenow": "ServiceNow", "Salesforce.Com": "Salesforce.com", "Amazon.Com": "Amazon.com"}


def title(c: Column) -> Column:
    """Every run of letters with a capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def short_name(c: str | Column) -> Column:
    """Title case without legal forms at the end; words of at most three letters are taken as acronyms. Null stays null."""
    forms = "|".join(re.escape(f) for f in LEGAL_FORMS)
    bare = F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), r"[,. ]+$", "")
    bare = F.regexp_replace(bare, rf"(?i)(?:[,. ]* (?:{forms})[,. ]*)+$", "")

    def word(w: Column, i: Column) -> Column:
        cased = title(w)
        return F.when((i > 0) & cased.isin(SMALL_WORDS), F.lower(w)).when(w.isin(ACRONYMS) | w.rlike(r"^\p{L}{1,3}$"), w).otherwise(cased)

    return F.array_join(F.transform(F.filter(F.split(bare, r"\s+"), lambda w: w != ""), word), " ")


def humanise(c: str | Column, is_platform: Column) -> Column:
    """A label in title case, with acronyms and brands in their own case; platforms stay as they are."""
    own = F.col(c) if isinstance(c, str) else c

    def token(w: Column) -> Column:
        cased = title(w)
        bare = F.regexp_replace(cased, r"^[.,()]+|[.,()]+$", "")
        brand = F.lit(None).cast("string")
        for plain, known in BRANDS.items():
            brand = F.when(bare == plain, known).otherwise(brand)
        mine = F.when(F.upper(bare).isin(CAPITALS), F.upper(bare)).otherwise(brand)
        return F.when(mine.isNotNull(), F.replace(cased, bare, mine)).otherwise(cased)

    return F.when(F.coalesce(is_platform, F.lit(False)), own).otherwise(F.array_join(F.transform(F.filter(F.split(own, r"\s+"), lambda w: w != ""), token), " "))
