"""Postcodes, cities, countries and registry identifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import blank_to_null, col

# Common names of countries, and the United States' postal codes of states.
COUNTRY_NAMES = {
    "UK": "GB", "UNITED KINGDOM": "GB", "GREAT BRITAIN": "GB", "USA": "US", "U.S.A.": "US", "UNITED STATES": "US",
    "UNITED STATES OF AMERICA": "US", "HONG KONG": "HK", "CAYMAN": "KY", "CAYMAN ISLANDS": "KY", "IRELAND": "IE",
    "LUXEMBOURG": "LU", "SINGAPORE": "SG", "SWITZERLAND": "CH", "GERMANY": "DE", "FRANCE": "FR", "NETHERLANDS": "NL",
    "BRITISH VIRGIN ISLANDS": "VG", "BVI": "VG", "JERSEY": "JE", "GUERNSEY": "GG", "UAE": "AE", "UNITED ARAB EMIRATES": "AE",
}
US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT",
    "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR",
]
#: Order in which the parts of an address are put together.
ADDRESS_PARTS = "house_number road unit city_district suburb city state_district state postcode country".split()


def normalize_postcode(c: Column | str) -> Column:
    return F.nullif(F.regexp_replace(F.upper(col(c)), "[^A-Z0-9]", ""), F.lit(""))


normalize_identifier = normalize_postcode


def postcode_outward(c: Column | str) -> Column:
    """The part of a British postcode that names its post town's district; null for other formats."""
    return F.nullif(F.regexp_extract(col(c), r"^([A-Z]{1,2}[0-9][A-Z0-9]?)", 1), F.lit(""))


def normalize_city(c: Column | str) -> Column:
    return blank_to_null(F.regexp_replace(F.lower(col(c)), r"\s+", " "))


def normalize_country(c: Column | str) -> Column:
    return blank_to_null(F.upper(col(c)))


def country_code(c: Column | str) -> Column:
    """Code of a country given by code or common name."""
    plain = normalize_country(c)
    names = F.create_map(*[F.lit(x) for pair in COUNTRY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, plain), plain)


def country_of_jurisdiction(c: Column | str) -> Column:
    return F.split(country_code(c), "-")[0]


def filer_country(c: Column | str) -> Column:
    """US for a state of the United States, else the code as given."""
    plain = normalize_country(c)
    return F.when(plain.isin(US_STATES), "US").otherwise(plain)


def pad_cik(c: Column | str) -> Column:
    return F.lpad(F.regexp_replace(F.trim(col(c)), "^0+", ""), 10, "0")


def pad_cik_or_null(c: Column | str) -> Column:
    return F.nullif(pad_cik(c), F.lit("0" * 10))


def clean_cusip(c: Column | str) -> Column:
    """Upper case; null if blank or all zeros."""
    plain = F.upper(F.trim(col(c)))
    return F.when(F.regexp_replace(plain, "0", "") != "", plain)


def is_lei(c: Column | str) -> Column:
    return col(c).rlike("^[0-9A-Z]{18}[0-9]{2}$")


def is_isin(c: Column | str) -> Column:
    return col(c).rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$")


def address_line(*parts: Column | str, parse: Callable[[str], dict[str, str]] | None = None) -> Column:
    """One line for an address. With parse, a function from a text to labelled parts (see ADDRESS_PARTS), they are put
    in that order; without, the parts are joined as given. Both are lower-cased and single-spaced; null if empty."""
    joined = F.concat_ws(" ", *[blank_to_null(p) for p in parts])
    if parse is None:
        return blank_to_null(F.regexp_replace(F.lower(joined), r"[\s,]+", " "))

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rank = {k: i for i, k in enumerate(ADDRESS_PARTS)}
        for texts in batches:
            yield texts.map(lambda t: " ".join(v for _, v in sorted(parse(t).items(), key=lambda kv: rank.get(kv[0], len(rank)))) or None if t else None)

    return F.pandas_udf(label, "string")(joined)
