"""Text columns of position messages: ship groups, empties, normal forms, destinations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ship groups by the first listed part that the lower-case type contains.
GROUPS = [
    ("Teherhajó", ["cargo"]),
    ("Tanker", ["tanker"]),
    ("Személyszállító", ["passenger"]),
    ("Halászhajó", ["fishing"]),
    ("Kedvtelési", ["pleasure", "sailing"]),
    ("Szolgálati", ["tug", "pilot", "search and rescue", "law enforcement", "port tender", "dredging", "military", "medical", "anti-pollution", "towing", "spare", "wing in ground", "high speed craft", "diving"]),
]
OTHER = "Egyéb / ismeretlen"
COMMERCIAL = ("Teherhajó", "Tanker")
NOT_SHIPS = ("AtoN", "Base Station", "Search and Rescue Transponder")
EMPTY_STATS = ("", "UNKNOWN", "UNDEFINED", "NAN", "NONE", "N/A", "UNKNOWN VALUE", "NOT AVAILABLE", "RESERVED FOR FUTURE USE")
EMPTY_DESTINATION = ("", "UNKNOWN", "UNDEFINED", "NAN", "NONE", "NA", "NIL", "NODEST", "NODESTINATION", "NONAME")

#: Destination categories by country of the port code, and Suez texts.
EUROPE = ("AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE", "NO", "IS", "GB", "CH")
EAST = ("EG", "SA", "AE", "OM", "IN", "PK", "LK", "BD", "CN", "SG", "MY", "ID", "TH", "VN", "KR", "JP", "TW", "PH")
EAST_TEXTS = ("PORT SAID", "SUEZ", "SINGAPORE", "FUJAIRAH")
CAT_EUROPE, CAT_EAST, CAT_ORDER, CAT_OTHER, CAT_NONE = "EU/EGT/UK", "Szuez/Ázsia/Közel-Kelet", "FOR ORDER", "Egyéb", "Nem értelmezhető"
STRICT_CODE = r"^([A-Z]{2}) ?([A-Z2-9]{3})$"
LENIENT_CODE = r"(?<![A-Z0-9])([A-Z]{2}) ?([A-Z2-9]{3})(?![A-Z0-9])"


def ship_group(raw: Column) -> Column:
    low, out = F.lower(raw), F.lit(None).cast("string")
    for name, parts in GROUPS:
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        out = F.coalesce(out, F.when(hit, name))
    return F.coalesce(out, F.lit(OTHER))


def coarse_group(raw: Column) -> Column:
    """k: cargo or tanker, s: passenger, e: anything else."""
    low = F.lower(raw)
    return F.when(low.contains("cargo") | low.contains("tanker"), "k").when(low.contains("passenger"), "s").otherwise("e")


def not_empty(raw: Column, empties=EMPTY_STATS) -> Column:
    return F.coalesce(~F.upper(F.trim(raw)).isin(*empties), F.lit(False))


def clean_text(raw: Column, empties=EMPTY_STATS) -> Column:
    return F.when(not_empty(raw, empties), F.trim(raw)).otherwise("")


def normal_form(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z0-9]", "")


def collapsed(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.coalesce(raw, F.lit("")))), r"\s+", " ")


def port_code(s: Column, pattern: str) -> Column:
    """The code that the pattern finds, or an empty text."""
    return F.concat(F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2))


def category_of_country(country: Column) -> Column:
    return F.when(country == "RU", "RU").when(country.isin(*EUROPE), CAT_EUROPE).when(country.isin(*EAST), CAT_EAST).otherwise(CAT_OTHER)


def category_of_text(s: Column) -> Column:
    east = F.lit(False)
    for t in EAST_TEXTS:
        east = east | s.contains(t)
    return F.when(east, CAT_EAST).when(s.contains("ORDER"), CAT_ORDER).otherwise(CAT_NONE)


def degrees_of(raw: Column, digits: int, positive: str) -> Column:
    """DDMM[NS] or DDDMM[EW] to degrees."""
    pattern = rf"(\d{{{digits}}})(\d{{2}})([NSEW])"
    d = F.regexp_extract(raw, pattern, 1).try_cast("double") + F.regexp_extract(raw, pattern, 2).try_cast("double") / 60
    return F.when(F.regexp_extract(raw, pattern, 3) == positive, d).otherwise(-d)
