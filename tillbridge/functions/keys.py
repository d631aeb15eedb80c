"""SKU identity, hashes, resource ids and payload keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbridge.functions.text import let

# "<base>. <row> <column>"
MATRIX_CHILD = r"^(.+?)\.\s*\d+\s+\d+$"


def is_matrix_child(sku: Column) -> Column:
    return F.trim(sku).rlike(MATRIX_CHILD)


def base_sku(sku: Column) -> Column:
    text = F.trim(sku)
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, MATRIX_CHILD, 1)), F.lit("")), text)


def child_sku(base: Column, row: Column, column: Column) -> Column:
    return F.concat(base, F.lit(". "), row.cast("string"), F.lit(" "), column.cast("string"))


def adjustment_key(system: str, sku: Column, *values: Column) -> Column:
    parts = [F.lit(system), sku, *[v.cast("string") for v in values]]
    return F.sha2(F.concat_ws("|", *parts), 256)


def fingerprint(*values: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*values)), 256)


def numeric_id(value: Column) -> Column:
    """Trailing id of a resource URI; a plain id passes through."""
    return F.element_at(F.split(F.trim(value), "/"), -1)


def resource_uri(kind: str, value: Column, authority: str) -> Column:
    text = F.trim(value)
    return F.when(text.startswith("gid://"), text).otherwise(
        F.concat(F.lit(f"gid://{authority}/{kind}/"), text)
    )


def normalize_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), r"[^\p{L}\p{N}]", "")


def normalize_name(name: str) -> str:
    return "".join(ch for ch in name.strip().lower() if ch.isalnum())


def folded_keys(payload: Column) -> Column:
    """Payload map keyed by normalised name; the first key wins a collision."""
    entries = F.filter(
        F.transform(
            F.map_entries(payload),
            lambda e: F.struct(normalize_key(e["key"]).alias("key"), e["value"].alias("value")),
        ),
        lambda e: e["key"] != "",
    )

    def firsts(v: Column) -> Column:
        return F.filter(v["entries"], lambda e, i: F.array_position(v["names"], e["key"]) == i + 1)

    named = let(entries, lambda es: F.struct(es.alias("entries"), F.transform(es, lambda e: e["key"]).alias("names")))
    return F.map_from_entries(let(named, firsts))


def filled(payload: Column) -> Column:
    """The payload map without its blank values."""
    return F.map_filter(payload, lambda _, value: value != "")


def pick(payload: Column, folded: Column, *names: str) -> Column:
    """First non-blank value: exact names first, then normalised names."""
    return pick_filled(filled(payload), filled(folded), *names)


def pick_filled(payload: Column, folded: Column, *names: str) -> Column:
    """``pick`` from ``filled`` maps; each lookup walks its map, so what blanks cost is paid once for all names."""
    exact = [F.try_element_at(payload, F.lit(n)) for n in names]
    loose = [F.try_element_at(folded, F.lit(n)) for n in dict.fromkeys(map(normalize_name, names))]
    return F.coalesce(*exact, *loose)


# Keys whose presence marks a product write.
MUTATION_KEYS = (
    "name", "title", "description", "description_html", "price", "regular_price", "sale_price",
    "cost", "cost_price", "unit_cost", "quantity", "stock_quantity", "barcode", "images",
    "image_url", "image", "metafields",
)

# Groups of keys that mark a stock record.
STOCK_MARKERS = (
    ("sku",),
    ("qty", "quantity", "stock_quantity"),
    ("price", "regular_price"),
    ("vendor",),
    ("department",),
    ("alternate sku", "alternate_sku"),
)


def is_product_write(payload: Column) -> Column:
    return F.arrays_overlap(F.map_keys(payload), F.array(*[F.lit(k) for k in MUTATION_KEYS]))


def is_stock_record(value: Callable[..., Column]) -> Column:
    """Two or more groups of stock keys have a value; ``value`` picks the first of several names."""
    hits = [value(*names).isNotNull().cast("int") for names in STOCK_MARKERS]
    return sum(hits[1:], hits[0]) >= 2
