"""Payload parts: tags, images, metafields, HTML, import policy and archiving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbridge.functions.money import decimal_or_none, nonzero_money_text, stock_quantity, till_money
from tillbridge.functions.text import clean_text, compare_text, escape_html, first_nonempty, let
from tillbridge.functions.titles import second_description

METAFIELDS = "array<struct<namespace:string,key:string,value:string,type:string>>"
# marker of products this system archived for lack of stock
ARCHIVE_MARKER = ("pos", "auto_archived_zero_stock")
LINE, LONG, DATE, NUMBER, WHOLE, FLAG, JSON = (
    "single_line_text_field", "multi_line_text_field", "date", "number_decimal",
    "number_integer", "boolean", "json",
)


def label_tags(labels: Sequence[tuple[str, Column]]) -> Column:
    """``Label:value`` for every non-blank value, first copy kept."""
    tags = [F.concat(F.lit(f"{label}:"), clean_text(value)) for label, value in labels]
    return F.array_distinct(F.array_compact(F.array(*tags)))


def build_tags(
    *, department: Column, product_type: Column, style: Column, size: Column, color: Column,
    vendor_code: Column, vendor_item: Column, fields: Sequence[Column],
) -> Column:
    return label_tags([
        ("Department", department), ("Product Type", product_type), ("Style", style), ("Size", size),
        ("Color", color), ("Vendor Code", vendor_code), ("Vendor Item", vendor_item),
        *[(f"PField{i}", f) for i, f in enumerate(fields, 1)],
    ])


def build_images(*columns: Column) -> Column:
    """Distinct http(s) URLs in column order."""
    urls = F.array(*[clean_text(c) for c in columns])
    return F.array_distinct(F.filter(urls, lambda u: u.rlike("(?i)^https?://")))


def media_inputs(urls: Column, title: Column, sku: Column) -> Column:
    """One media entry per distinct URL, with a derived file name and alt text."""
    trimmed = F.array_distinct(F.filter(F.transform(urls, lambda x: F.trim(x)), lambda u: u != ""))

    def entry(url: Column, i: Column) -> Column:
        path = F.substring_index(url, "?", 1)
        name = F.nullif(F.regexp_extract(path, "([^/]*)/?$", 1), F.lit(""))
        fallback = F.concat(F.lit("product-"), (i + 1).cast("string"), F.lit(".jpg"))
        return F.struct(
            url.alias("source"),
            first_nonempty(title, sku, F.lit("Product image")).alias("alt"),
            F.coalesce(name, fallback).alias("filename"),
            F.lit("IMAGE").alias("content_type"),
        )

    return F.transform(trimmed, entry)


def metafields(entries: Sequence[tuple[str, Column, str]], namespace: str = "pos") -> Column:
    """Typed key/value entries; null, blank and NUL-bearing values are dropped."""
    clean = "".join(ch if ch.isascii() and (ch.isalnum() or ch in "_-") else "_" for ch in namespace.strip()).strip("_")
    given = F.array(*[
        F.struct(F.lit(key).alias("key"), column.cast("string").alias("value"), F.lit(kind).alias("type"))
        for key, column, kind in entries
    ])

    def entry(m: Column) -> Column:
        plain = let(clean_text(m["value"]), lambda text: F.when(~F.contains(text, F.lit("\x00")), text))
        value = F.when(m["type"] == JSON, F.nullif(m["value"], F.lit("{}"))).otherwise(plain)
        return F.struct(F.lit(clean or "pos").alias("namespace"), m["key"].alias("key"), value.alias("value"), m["type"].alias("type"))

    return F.filter(F.transform(given, entry), lambda m: m["value"].isNotNull())


def compact_json(df: DataFrame, prefix: str = "") -> Column:
    """JSON of a source row without blanks, zeros and false, keys sorted."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        if not f.name.startswith(prefix) or f.name.startswith("_"):
            continue
        column = F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            kept = F.when(column, column)
        elif isinstance(f.dataType, T.NumericType):
            kept = F.when(column != 0, column.cast("string"))
        elif isinstance(f.dataType, T.StringType):
            kept = let(clean_text(column), lambda text: F.when(~F.contains(text, F.lit("\x00")), text))
        else:
            continue
        parts.append(kept.alias(f.name[len(prefix):]))
    return F.to_json(F.struct(*parts)) if parts else F.lit(None).cast("string")


def item_metafields(rows: DataFrame, stock: Column, namespace: str) -> Column:
    """Key/value description of a built item row."""
    def get(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    def money(column: Column) -> Column:
        return till_money(decimal_or_none(column)).cast("string")

    item = rows.select(*[c for c in rows.columns if c.isupper() and not c.startswith("_")])
    entries = [
        ("sku", F.col("sku_key"), LINE), ("raw_description", F.col("raw_desc"), LONG),
        ("generated_title", F.col("title"), LINE), ("desc2", F.col("second"), LONG),
        ("vendor_name", F.col("vendor_name"), LINE), ("vendor_code", F.col("vendor_code"), LINE),
        ("vendor_item", F.col("vendor_item"), LINE), ("department_code", F.col("department"), LINE),
        ("product_type", F.col("product_type"), LINE), ("style", F.col("style_text"), LINE),
        ("size", F.col("size_text"), LINE), ("color", F.col("color_text"), LINE),
        ("barcode", F.col("barcode_text"), LINE), ("pos_type", get("TYPE"), LINE),
        ("sellweb", get("SELLWEB"), FLAG), ("web_product_id", get("WEBPRODID"), LINE),
        ("web_variant_id", get("VARIANTID"), LINE),
        ("bin", first_nonempty(clean_text(get("BIN_NUM")), clean_text(get("BIN"))), LINE),
        ("last_ordered", get("LAST_ORD"), DATE), ("last_activity", get("LAST_ACT"), DATE),
        ("last_updated", get("L_UPDATE"), DATE), ("edit_date", get("EDITDATE"), DATE),
        ("price", money(F.col("price_exact")), NUMBER),
        ("compare_at_price", money(F.col("compare_exact")), NUMBER),
        *[(key, money(get(name)), NUMBER) for key, name in (
            ("cost", "COST"), ("last_cost", "LAST_COST"), ("vendor_cost", "VEND_COST"),
            ("base_cost", "BASE_COST"), ("case_cost", "CASE_COST"))],
        ("selected_quantity", stock, WHOLE),
        ("item_quantity", stock_quantity(decimal_or_none(get("QTY"))), WHOLE),
        ("itemmqty_quantity", stock_quantity(F.col("cell_quantity")), WHOLE),
        *[(key, money(get(name)), NUMBER) for key, name in (
            ("committed", "COMMITTED"), ("on_order", "ON_ORDER"), ("reorder_level", "REORDER"),
            ("stock_level", "STK_LEVEL"))],
        ("taxable", get("TAXABLE"), LINE), ("item_data", compact_json(item), JSON),
        ("price_change_data", compact_json(rows, "pc_"), JSON),
        ("vendor_item_data", compact_json(rows, "vi_"), JSON),
    ]
    return metafields(entries, namespace)


def dedupe_metafields(rows: DataFrame, owner: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Long metafield rows: last wins per (owner, namespace, key)."""
    namespace = F.trim(F.coalesce(F.col("namespace"), F.lit("custom")))
    value = F.nullif(F.trim(F.col("value").cast("string")), F.lit(""))
    rows = rows.select(
        *owner, namespace.alias("namespace"), F.trim("key").alias("key"), value.alias("value"),
        F.trim(F.coalesce(F.col("type"), F.lit(LINE))).alias("type"), *[o for o in order if o not in owner],
    ).where("namespace <> '' AND key <> '' AND value IS NOT NULL")
    rows = rows.where(~((F.col("namespace") == ARCHIVE_MARKER[0]) & (F.col("key") == ARCHIVE_MARKER[1])))
    kept = F.max_by(F.struct("value", "type"), F.struct(*order)).alias("_kept")
    return rows.groupBy(*owner, "namespace", "key").agg(kept).select(*owner, "namespace", "key", "_kept.*")


def detail_list(details: Sequence[tuple[str, Column]]) -> Column:
    """``<ul>`` of the details that are neither blank nor zero; blank when none is left."""
    given = F.array(*[F.struct(F.lit(label).alias("label"), v.cast("string").alias("value")) for label, v in details])
    told = F.filter(given, lambda d: ~F.coalesce(d["value"], F.lit("")).isin("", "0", "0.00"))
    items = F.transform(
        told,
        lambda d: F.concat(F.lit("<li><strong>"), escape_html(d["label"]), F.lit(":</strong> "), escape_html(d["value"]), F.lit("</li>")),
    )
    return let(
        F.array_join(items, ""),
        lambda body: F.when(body != "", F.concat(F.lit("<ul>"), body, F.lit("</ul>"))).otherwise(""),
    )


def description_html(rows: DataFrame, stock: Column) -> Column:
    def get(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    def money(column: Column) -> Column:
        return till_money(decimal_or_none(column)).cast("string")

    renamed = compare_text(F.col("raw_desc")) != compare_text(F.col("title"))
    summary = F.concat_ws(
        "<br>",
        F.when(renamed, F.concat(F.lit("POS name: "), escape_html(F.col("raw_desc")))),
        escape_html(second_description(F.col("second"))),
    )
    details = [
        ("SKU", F.col("sku_key")), ("Vendor", F.col("vendor_name")), ("Vendor Code", F.col("vendor_code")),
        ("Vendor Item", F.col("vendor_item")), ("Product Type", F.col("product_type")),
        ("Department", F.col("department")), ("Style", F.col("style_text")), ("Size", F.col("size_text")),
        ("Color", F.col("color_text")), ("Barcode", F.col("barcode_text")),
        ("Price", money(F.col("price_exact"))), ("Compare At Price", money(F.col("compare_exact"))),
        ("Quantity", stock), ("Committed", nonzero_money_text(get("COMMITTED"))),
        ("On Order", nonzero_money_text(get("ON_ORDER"))), ("Reorder Level", nonzero_money_text(get("REORDER"))),
        ("Stock Level", nonzero_money_text(get("STK_LEVEL"))), ("Cost", money(get("COST"))),
        ("Last Cost", money(get("LAST_COST"))), ("Vendor Cost", money(get("VEND_COST"))),
        ("Base Cost", money(get("vi_BASE_COST"))), ("Case Cost", money(get("vi_CASE_COST"))),
        ("Bin", first_nonempty(clean_text(get("BIN_NUM")), clean_text(get("BIN")))),
        ("Last Ordered", clean_text(get("LAST_ORD"))), ("Last Activity", clean_text(get("LAST_ACT"))),
    ]
    return F.concat(
        F.lit("<p>"), escape_html(F.col("title")), F.lit("</p>"),
        let(summary, lambda x: F.when(x != "", F.concat(F.lit("<p>"), x, F.lit("</p>"))).otherwise("")),
        detail_list(details),
    )


# -- storefront payload rules (nested arrays are bounded by one payload) -------

def _trimmed(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def normalize_products(products: DataFrame) -> DataFrame:
    """Trim a product payload; duplicate variant SKUs or barcodes set ``error``."""
    variants = F.transform(
        F.col("variants"),
        lambda v: v.withField("sku", F.trim(v["sku"]))
        .withField("barcode", F.trim(v["barcode"]))
        .withField(
            "option_values",
            F.map_filter(
                F.transform_values(
                    F.transform_keys(v["option_values"], lambda k, _: F.trim(k)), lambda _, x: F.trim(x)
                ),
                lambda k, x: (k != "") & (x != ""),
            ),
        ),
    )
    skus = F.transform(F.col("variants"), lambda v: v["sku"])
    barcodes = F.transform(F.col("variants"), lambda v: v["barcode"])
    error = F.when(F.size(skus) != F.size(F.array_distinct(skus)), "duplicate_variant_sku").when(
        F.size(barcodes) != F.size(F.array_distinct(barcodes)), "duplicate_variant_barcode"
    )
    tags = F.filter(F.transform(F.col("tags"), lambda x: F.trim(x)), lambda t: t != "")
    return (
        products.withColumns({
            "variants": variants, "tags": tags, "sku": _trimmed(F.col("sku")),
            "title": _trimmed(first_nonempty(F.col("title"), F.col("name"))),
            "vendor": _trimmed(first_nonempty(F.col("vendor"), F.col("brand"))),
            "handle": _trimmed(F.col("handle")), "barcode": _trimmed(F.col("barcode")),
            "product_type": _trimmed(F.col("product_type")),
        })
        .withColumn("error", error)
    )


def total_quantity(quantity: Column, variants: Column) -> Column:
    """Product quantity when given, else the sum over variants that have one."""
    known = F.filter(F.transform(variants, lambda v: v["quantity"].cast("bigint")), lambda q: q.isNotNull())
    summed = F.aggregate(known, F.lit(0).cast("bigint"), lambda a, q: a + q)
    return F.coalesce(quantity.cast("bigint"), F.when(F.size(known) > 0, summed))


def apply_import_policy(products: DataFrame, total: Column) -> DataFrame:
    """Clear descriptions, tag with the title, archive what is out of stock."""
    title = F.nullif(F.col("title"), F.lit(""))
    tagged = F.exists("tags", lambda t: F.lower(t) == F.lower(title))
    return products.withColumns({
        "description_html": F.lit(""),
        "update_description": F.lit(True),
        "tags": F.when(title.isNotNull() & ~tagged, F.array_append("tags", title)).otherwise(F.col("tags")),
        "status": F.when(total <= 0, "archived").otherwise(F.col("status")),
    })


def product_status(value: Column, default: str) -> Column:
    text = F.upper(F.trim(value))
    return F.when(text.isin("ACTIVE", "ARCHIVED", "DRAFT"), text).otherwise(default)


def archive_ownership(products: DataFrame, total: Column) -> DataFrame:
    """Who archives a product: this system for lack of stock, or the caller.

    Input columns: status, mapped (an online product exists), online_status,
    marked (this system archived it before).
    """
    wants_archive = F.upper(F.trim(F.coalesce(F.col("status"), F.lit("")))) == "ARCHIVED"
    requested = F.coalesce(total <= 0, F.lit(False)) & ~wants_archive
    not_archived = F.upper(F.coalesce(F.col("online_status"), F.lit(""))) != "ARCHIVED"
    owned = requested & (~F.col("mapped") | not_archived | F.coalesce(F.col("marked"), F.lit(False)))
    return products.withColumns({
        "explicit_archive": wants_archive, "auto_archive": requested, "owns_archive": owned,
    })


def restore_candidates(products: DataFrame, quantity: Column) -> DataFrame:
    """Marked products back in stock: clear the marker, unarchive to DRAFT."""
    archived = F.upper(F.coalesce(F.col("online_status"), F.lit(""))) == "ARCHIVED"
    return products.where(F.col("marked") & (quantity > 0)).withColumns({
        "clear_marker": F.lit(True), "new_status": F.when(archived, "DRAFT"),
    })


def negative_money_field(variants: Column | None = None) -> Column:
    """Path of the first negative amount, product first, then variants."""
    names = ("price", "compare_at_price", "cost")
    found = [F.when(F.col(n) < 0, F.lit(n)) for n in names]
    if variants is not None:
        paths = F.transform(
            variants,
            lambda v, i: F.coalesce(*[
                F.when(v[n] < 0, F.concat(F.lit("variants["), (i + 1).cast("string"), F.lit(f"].{n}"))) for n in names
            ]),
        )
        found.append(F.try_element_at(F.array_compact(paths), F.lit(1)))
    return F.coalesce(*found)
