"""Names, addresses and text patterns as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street words and their short forms.
STREET_WORDS = {"STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD"}

# Company suffixes left out of names.
COMPANY_SUFFIXES = ["LLC", "INC", "CORP", "LTD"]

# Borough codes.
BOROUGH_CODES = {
    "1": "Manhattan",
    "2": "Bronx",
    "3": "Brooklyn",
    "4": "Queens",
    "5": "Staten Island",
}

# Words that place an address in a borough, first match wins.
BOROUGH_WORDS = [
    (["MANHATTAN", "NEW YORK"], "Manhattan"),
    (["BROOKLYN"], "Brooklyn"),
    (["QUEENS"], "Queens"),
    (["BRONX"], "Bronx"),
    (["STATEN ISLAND"], "Staten Island"),
]


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def first_present(*values: Column) -> Column:
    """First value that is neither NULL nor blank."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def clean(value: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.lower(F.regexp_replace(value, "[^A-Za-z0-9]", ""))


def _swap_words(value: Column, words: dict[str, str]) -> Column:
    return reduce(
        lambda col, word: F.regexp_replace(col, rf"\b{word}\b", words[word]), words, F.upper(value)
    )


def normalize_address(value: Column) -> Column:
    return clean(_swap_words(value, STREET_WORDS))


def normalize_name(value: Column) -> Column:
    return clean(_swap_words(value, dict.fromkeys(COMPANY_SUFFIXES, "")))


def match_key(value: Column) -> Column:
    """Key for exact matching of free text; blank text has no key."""
    return blank_to_null(F.lower(F.trim(value)))


def address_hash(normalized: Column) -> Column:
    return F.md5(normalized)


def borough_name(code: Column) -> Column:
    """Borough of a code; other values pass through."""
    text = code.cast("string")
    named = reduce(
        lambda col, item: F.when(text == item[0], item[1]) if col is None else col.when(text == item[0], item[1]),
        BOROUGH_CODES.items(),
        None,
    )
    return named.otherwise(text)


def borough_in_text(address: Column) -> Column:
    found = None
    for words, name in BOROUGH_WORDS:
        hit = reduce(lambda a, b: a | b, [address.contains(w) for w in words])
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return F.when(address.isNotNull(), found.otherwise("Unknown"))


def zip_in_text(address: Column) -> Column:
    """First run of five digits."""
    return blank_to_null(F.regexp_extract(address, r"(\d{5})", 1))


def join_words(*parts: Column) -> Column:
    """Parts joined by blanks, missing parts left out, ends trimmed."""
    return F.trim(F.concat_ws(" ", *parts))


def owner_name(business: Column, first: Column, last: Column) -> Column:
    """Business name, else first and last name; NULL without either."""
    person = F.when(
        blank_to_null(first).isNotNull() & blank_to_null(last).isNotNull(),
        F.concat_ws(" ", first, last),
    )
    return F.coalesce(blank_to_null(business), person)


def split_list(value: Column) -> Column:
    """Comma list to an array of trimmed items."""
    return F.transform(F.split(value, ","), lambda item: F.trim(item))


def has_company_word(name: Column) -> Column:
    return name.rlike("LLC|CORP|INC")


def is_multi_entity(name: Column) -> Column:
    """Several parties in one name: a comma and a company word."""
    return name.contains(",") & has_company_word(name)


def is_llc(name: Column) -> Column:
    return name.contains("LLC")


def is_long_name(name: Column) -> Column:
    return F.length(name) > 50


def first_three(values: Column) -> Column:
    return F.slice(F.array_sort(values), 1, 3)
