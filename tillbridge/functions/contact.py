"""E-mail, phone, names and postal codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbridge.functions.text import clean_text, let, smart_title_case

# State names and their postal codes.
STATE_CODES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA",
    "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC",
    "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL",
    "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA",
    "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI",
    "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT",
    "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND",
    "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA",
    "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN",
    "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA",
    "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def normalize_email(value: Column, reject_urls: bool = True) -> Column:
    def check(email: Column) -> Column:
        ok = email.rlike(EMAIL)
        return F.when(ok & ~email.rlike(r"^(www\.|https?://)") if reject_urls else ok, email)

    return let(F.lower(clean_text(value)), check)


def normalize_us_phone(value: Column) -> Column:
    def check(digits: Column) -> Column:
        ten = F.regexp_extract(digits, r"^1?(\d{10})$", 1)
        return F.when((ten != "") & ~ten.rlike(r"^(\d)\1{9}$"), F.concat(F.lit("+1"), ten))

    return let(F.regexp_replace(value, r"\D+", ""), check)


def split_name(value: Column) -> Column:
    """struct(first, last): a single word is a last name."""
    def split(text: Column) -> Column:
        words = F.split(text, " ")
        n = F.size(words)
        rest = F.array_join(F.slice(words, F.least(n, F.lit(2)), n), " ")
        return F.struct(F.when(n > 1, words[0]).alias("first"), F.when(n > 0, rest).alias("last"))

    return let(F.nullif(smart_title_case(value), F.lit("")), split)


def pos_ids_in_tags(tags: Column) -> Column:
    """Lower-cased customer numbers from ``POS ID:`` labels in a comma list."""
    labels = F.transform(F.split(clean_text(tags), ","), lambda x: F.trim(x))
    wanted = F.filter(labels, lambda t: t.rlike(r"(?i)^pos id\s*:"))
    ids = F.transform(wanted, lambda t: F.lower(clean_text(F.regexp_replace(t, r"^[^:]*:", ""))))
    return F.filter(ids, lambda t: t.isNotNull())


def csv_text(value: Column) -> Column:
    """Flat text for a CSV cell: plain quotes, no line breaks, never null."""
    text = F.coalesce(clean_text(value), F.lit(""))
    text = F.translate(text, "“”‘’\x00", "\"\"''")
    return F.trim(F.regexp_replace(text, r"[\r\n]+", " | "))


def country_code(value: Column) -> Column:
    return let(F.upper(csv_text(value)), lambda text: F.when(F.length(text) == 2, text).otherwise("US"))


def province_code(value: Column, country: Column) -> Column:
    def code(text: Column) -> Column:
        named = F.coalesce(F.try_element_at(literal_map(STATE_CODES), text), F.lit(""))
        return (
            F.when(text == "", "")
            .when(country == "US", F.when(F.length(text) == 2, text).otherwise(named))
            .when(F.length(text) <= 3, text)
            .otherwise("")
        )

    return let(F.upper(csv_text(value)), code)
