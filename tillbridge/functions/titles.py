"""Storefront titles and their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbridge.functions.contact import literal_map
from tillbridge.functions.text import (
    case_core, clean_text, contains_phrase, let, mentions_type, normalize_spaces,
    singular, smart_title_case,
)

# Whole colour texts.
COLOR_VALUES = {
    "APH34": None, "BEIGE MARL": "Beige Marl", "BLACK": "Black", "BLK": "Black",
    "BLK/WHT": "Black / White", "BLUE": "Blue", "BROWN": "Brown", "BROWN/BLAC": "Brown / Black",
    "BURG": "Burgundy", "BURGUNDY": "Burgundy", "BUTTER": "Butter", "CHARCOAL": "Charcoal",
    "DK BROWN": "Dark Brown", "DKBRWN": "Dark Brown", "GRASS": "Grass", "GRAY": "Gray",
    "GREEN": "Green", "KHAKI": "Khaki", "L GRAY": "Light Gray", "LT GRAY": "Light Gray",
    "MARRONE": "Marrone", "MED.BROWN": "Medium Brown", "MUSTARD": "Mustard", "NAVY": "Navy",
    "OLIVE": "Olive", "OLIVE MIX": "Olive Mix", "ORN": "Orange", "RED": "Red", "TAN": "Tan",
    "WHITE": "White", "WHT": "White",
}

# Single colour words.
COLOR_WORDS = {
    "BEIGE": "Beige", "BLACK": "Black", "BLK": "Black", "BLUE": "Blue", "BRN": "Brown",
    "BROWN": "Brown", "BRWN": "Brown", "BURG": "Burgundy", "DK": "Dark", "GRAY": "Gray",
    "GRY": "Gray", "KHAKI": "Khaki", "LT": "Light", "MED": "Medium", "NAVY": "Navy",
    "OLIVE": "Olive", "ORN": "Orange", "RED": "Red", "TAN": "Tan", "WHT": "White",
    "WHITE": "White",
}

# Group codes and product types.
GROUP_TYPES = {
    "ACC": "ACCESSORIES", "BEL": "BELTS", "BOW": "BOW TIES", "BRA": "BRACES", "DE": "DENIM",
    "JERSEY": "JERSEY", "MC": "SPORT COAT", "MCP": "CASUAL PANTS", "MCS": "CASUAL SHIRTS",
    "MDP": "DRESS PANTS", "MDS": "DRESS SHIRT", "MKS": "KNIT SHIRT", "MS": "SUIT",
    "OU WE": "OUTERWEAR", "PS": "POCKET SQUARE", "SHO": "SHOES", "SOC": "SOCKS", "TIE": "TIES",
    "TUX": "TUXEDOS", "UND": "UNDERWEAR", "VES": "VEST",
}

# Standard sizes, and second descriptions that say nothing.
STANDARD_SIZES = ("XS", "S", "M", "L", "XL", "XXL", "XXXL", "OVER CALF")
GENERIC_SECOND = ("CFT", "STATUS")


def group_product_type(code: Column) -> Column:
    return F.try_element_at(literal_map(GROUP_TYPES), F.upper(F.trim(code)))


def _color(upper: Column) -> Column:
    known = {k: v for k, v in COLOR_VALUES.items() if v is not None}
    silent = [k for k, v in COLOR_VALUES.items() if v is None]
    pieces = F.regexp_extract_all(F.replace(upper, F.lit("."), F.lit(" ")), F.lit("[/ ]|[^/ ]+"), 0)
    words = F.transform(
        pieces,
        lambda p: F.when(p.isin("/", " "), p).otherwise(
            F.coalesce(F.try_element_at(literal_map(COLOR_WORDS), p), case_core(p))
        ),
    )
    return (
        F.when(upper.isin(*silent), None)
        .when(upper.isin(*known), F.try_element_at(literal_map(known), upper))
        .when(upper.rlike(r"\d") | upper.rlike(r"^[A-Z]{1,4}$"), None)
        .otherwise(clean_text(F.array_join(words, "")))
    )


def color_for_title(value: Column) -> Column:
    return let(F.upper(clean_text(value)), _color)


def size_for_title(value: Column) -> Column:
    shapes = r"^(\d{1,3}/\d{1,3}|\d{1,3}(\.\d)?[A-Z]{0,2})$"
    return let(
        F.upper(clean_text(value)),
        lambda upper: F.when(upper == "OVER CALF", "Over Calf").when(
            upper.isin(*STANDARD_SIZES) | upper.rlike(shapes), upper
        ),
    )


def _second(text: Column) -> Column:
    no_word = ~text.rlike("[A-Za-z]{4,}")
    coded = text.rlike(r"\d") | F.upper(text).rlike(r"^[A-Z0-9./' -]+$")
    generic = F.upper(text).isin(*GENERIC_SECOND)
    return F.when(text.isNotNull() & ~generic & ~(coded & no_word), smart_title_case(text))


def second_description(value: Column) -> Column:
    """A readable second description, or null when it is only a code."""
    return let(clean_text(value), _second)


def _code_heavy(tokens: Column) -> Column:
    n = F.size(tokens)
    score = F.size(F.filter(tokens, lambda t: t.rlike(r"[\d/-]")))
    lone = (n == 1) & tokens[0].rlike("[A-Z]") & (F.length(tokens[0]) >= 5)
    score = score + F.when(lone, 1).otherwise(0)
    return (n > 0) & (score >= F.greatest(F.lit(1), F.floor(n / 2)))


def looks_code_heavy(value: Column) -> Column:
    return let(F.regexp_extract_all(F.upper(value), F.lit("[A-Za-z0-9./'-]+"), 0), _code_heavy)


def strip_vendor_prefix(description: Column, vendor_code: Column) -> Column:
    def strip(v: Column) -> Column:
        rest = F.substring(v["desc"], F.length(v["code"]) + 1, F.length(v["desc"]))
        bare = F.trim(F.regexp_replace(rest, r"^[\s/-]+", ""))
        hit = (v["code"] != "") & F.startswith(F.lower(v["desc"]), F.lower(v["code"])) & rest.rlike(r"^[\s/-]")
        return F.when(hit & (bare != ""), bare).otherwise(v["desc"])

    given = F.struct(normalize_spaces(description).alias("desc"), F.coalesce(vendor_code, F.lit("")).alias("code"))
    return let(given, strip)


def simplify_vendor(vendor_name: Column, product_type: Column) -> Column:
    """Vendor name without a trailing product type."""
    def simplify(v: Column) -> Column:
        vw, tw = F.split(v["vendor"], " "), F.split(v["kind"], " ")
        n, k = F.size(vw), F.size(tw)
        keep = F.greatest(n - k, F.lit(0))
        tail = F.transform(F.slice(vw, keep + 1, k), singular)
        trimmed = F.array_join(F.slice(vw, F.lit(1), keep), " ")
        ends = v["kind"].isNotNull() & (n > k) & (tail == F.transform(tw, singular))
        return F.when(ends, trimmed).otherwise(v["vendor"])

    return let(
        F.struct(
            smart_title_case(F.nullif(vendor_name, F.lit(""))).alias("vendor"),
            smart_title_case(F.nullif(product_type, F.lit(""))).alias("kind"),
        ),
        simplify,
    )


def smart_title(
    description: Column, vendor_name: Column, vendor_code: Column, product_type: Column,
    size: Column, color: Column, second: Column,
) -> Column:
    """Title from description, vendor, type, second description, colour and size."""
    def with_lead(v: Column) -> Column:
        branded = F.coalesce(contains_phrase(v["pretty"], v["vendor"]), F.lit(False))
        plain = ~contains_phrase(v["pretty"], v["kind"]) & ~mentions_type(v["pretty"], v["kind"])
        lead = F.when(v["coded"] & plain & ~branded, v["kind"])
        return F.struct(
            F.concat_ws(" ", F.when(~branded, v["vendor"]), lead, v["pretty"]).alias("title"),
            v["coded"].alias("coded"), second_description(second).alias("note"),
        )

    def with_note(v: Column) -> Column:
        add = v["coded"] & ~contains_phrase(v["title"], v["note"])
        title = F.when(add, F.concat(v["title"], F.lit(" - "), v["note"])).otherwise(v["title"])
        return F.struct(title.alias("title"), color_for_title(color).alias("shade"), size_for_title(size).alias("fit"))

    def with_extras(v: Column) -> Column:
        extras = F.concat_ws(" / ", *[F.when(~contains_phrase(v["title"], v[x]), v[x]) for x in ("shade", "fit")])
        return normalize_spaces(F.concat_ws(" - ", v["title"], F.nullif(extras, F.lit(""))))

    start = let(
        strip_vendor_prefix(description, vendor_code),
        lambda bare: F.struct(
            smart_title_case(bare).alias("pretty"), looks_code_heavy(bare).alias("coded"),
            simplify_vendor(vendor_name, product_type).alias("vendor"),
            smart_title_case(F.nullif(product_type, F.lit(""))).alias("kind"),
        ),
    )
    return let(let(let(start, with_lead), with_note), with_extras)


def plain_title_case(value: Column) -> Column:
    """Capitalise each word; words with a digit go upper case; blank is null."""
    words = F.split(clean_text(value), " ")
    cased = F.transform(
        words,
        lambda w: F.when(w.rlike(r"\d"), F.upper(w)).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
        ),
    )
    return F.array_join(cased, " ")


def archive_title(description: Column, vendor: Column, size: Column, color: Column) -> Column:
    """The plainer title of the archive profile."""
    def build(title: Column) -> Column:
        lead = (F.coalesce(vendor, F.lit("")) != "") & ~F.contains(F.lower(title), F.lower(vendor))
        extras = F.concat_ws(" / ", plain_title_case(color), plain_title_case(size))
        named = F.when(lead, F.concat(vendor, F.lit(" "), title)).otherwise(title)
        return normalize_spaces(F.concat_ws(" - ", named, F.nullif(extras, F.lit(""))))

    return let(plain_title_case(description), build)
