"""Catalog build: item dedup, lookups, field fallbacks, filters and paging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.functions.money import EXACT, decimal_or_none, stock_quantity, till_money
from tillbridge.functions.text import clean_text, first_nonempty, smart_title_case
from tillbridge.functions.titles import (
    archive_title, group_product_type, plain_title_case, simplify_vendor, smart_title,
)
from tillbridge.operators import payloads
from tillbridge.operators.ordering import first_wins, last_wins, order_key, spread

# What makes an item not sellable.
NON_SELLABLE_GROUPS = ("ALT", "ALTCFT", "CMS", "COUPON", "CS", "GIFTCT", "HOLGC", "MSC", "RENTAL")
NON_SELLABLE_PATTERNS = (
    r"\bACCIDENT DAMAGE\b", r"\bALTERATIONS?\b", r"\bGIFT CARD\b", r"\bREWARDS?\b",
    r"\bRENTAL\b", r"\bSHIPPING\b", r"\bSPECIAL ORDER\b",
)
QUALITY_DATES = ("LAST_ACT", "EDITDATE", "DATE_ST")
QUALITY_TEXTS = ("DESC", "GROUP", "VENDOR", "VEND_ID", "ALT_SKU", "STYLE", "SIZE", "COLOR")
PRICE_TIERS = ("PRICE_R", "PRICE_B", "PRICE_C", "PRICE_D", "PRICE_E")
ARRIVAL = ("_rec_no",)


def field(df: DataFrame, name: str, kind: str = "string") -> Column:
    """Column of a dynamic schema; null when the table has no such field."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _amount(df: DataFrame, name: str) -> Column:
    return decimal_or_none(field(df, name))


# -- dedup and lookups -------------------------------------------------------

def item_quality(items: DataFrame, order: Sequence[str] = ARRIVAL) -> Column:
    """Ordering key of item rows with one SKU; the greatest row is kept."""
    dates = [F.coalesce(clean_text(field(items, d)), F.lit("")) for d in QUALITY_DATES]
    filled = [clean_text(field(items, t)).isNotNull().cast("int") for t in QUALITY_TEXTS]
    return F.struct(
        (F.coalesce(_amount(items, "PRICE"), F.lit(0)) > 0).alias("priced"),
        F.greatest(*dates).alias("latest"),
        (F.coalesce(_amount(items, "QTY"), F.lit(0)) > 0).alias("stocked"),
        sum(filled[1:], filled[0]).alias("filled"),
        *order,
    )


def dedupe_items(items: DataFrame, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """Best row per SKU plus every row without a SKU.

    ``first_seen`` is the arrival key of the SKU's first row and ``copies``
    its row count; rows without a SKU sort after the others. The aggregate
    sorts its rows: they are dealt by arrival first, and each holds its
    arrival key once, in its quality, as the only copy beside ``first_seen``.
    """
    sku = clean_text(F.col("SKU"))
    rest = [c for c in items.columns if c not in order]
    columns = [F.col(f"_best.{'quality' if c in order else 'rest'}.{c}").alias(c) for c in items.columns]
    keyed = (
        spread(items.where(sku.isNotNull()), *order, per_core=16)
        .groupBy(sku.alias("_sku"))
        .agg(
            F.max(F.struct(item_quality(items, order).alias("quality"), F.struct(*rest).alias("rest"))).alias("_best"),
            F.min(order_key(order)).alias("first_seen"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select(*columns, "first_seen", "copies", F.lit(False).alias("without_sku"))
    )
    blank = items.where(sku.isNull()).select(
        "*", order_key(order).alias("first_seen"), F.lit(1).cast("bigint").alias("copies"),
        F.lit(True).alias("without_sku"),
    )
    return keyed.unionByName(blank)


def vendor_lookup(vendors: DataFrame, order: Sequence[str] = ARRIVAL, title_case: bool = False) -> DataFrame:
    """vendor_id -> company, last complete row wins."""
    company = clean_text(F.col("COMPANY"))
    rows = vendors.select(
        clean_text(F.col("VENDOR_ID")).alias("vendor_id"),
        (plain_title_case(company) if title_case else company).alias("company"),
        *order,
    ).where("vendor_id IS NOT NULL AND company IS NOT NULL")
    return last_wins(rows, ["vendor_id"], order, "company")


def _keyed_by_sku(rows: DataFrame) -> DataFrame:
    return rows.withColumn("SKU", clean_text(F.col("SKU"))).where("SKU IS NOT NULL")


def price_change_lookup(rows: DataFrame, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """SKU -> latest price-change row."""
    rest = [c for c in rows.columns if c != "SKU" and c not in order]
    return last_wins(_keyed_by_sku(rows), ["SKU"], order, *rest)


def vendor_item_lookup(rows: DataFrame, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """SKU -> first vendor row."""
    rest = [c for c in rows.columns if c != "SKU" and c not in order]
    return first_wins(_keyed_by_sku(rows), ["SKU"], order, *rest)


def quantity_lookup(rows: DataFrame, source: str = "itemmqty", cell: str | None = None) -> DataFrame:
    """SKU -> summed quantity; empty unless the source reads cell rows."""
    amount = decimal_or_none(F.col("QTY"))
    rows = rows.select(clean_text(F.col("SKU")).alias("SKU"), clean_text(field(rows, "CELL")).alias("CELL"), amount.alias("QTY"))
    rows = rows.where("SKU IS NOT NULL AND QTY IS NOT NULL")
    if source not in ("itemmqty", "best"):
        rows = rows.where(F.lit(False))
    if cell and cell.strip():
        rows = rows.where(F.col("CELL") == " ".join(cell.split()))
    return rows.groupBy("SKU").agg(F.sum("QTY").cast(EXACT).alias("cell_quantity"))


def select_quantity(item: Column, cells: Column, source: str) -> Column:
    if source == "itemmqty":
        chosen = F.coalesce(cells, item)
    elif source == "best":
        chosen = F.greatest(item, cells)
    else:
        chosen = item
    return stock_quantity(chosen)


def choose_compare_at(price: Column, *tiers: Column) -> Column:
    """Highest tier above the price and at most three times it."""
    fits = F.filter(F.array(*tiers), lambda t: (t > price) & (t <= price * 3))
    return F.when(price > 0, F.array_max(fits))


def non_sellable_reason(group: Column, sku: Column, description: Column) -> Column:
    code = F.upper(clean_text(group))
    text = clean_text(description)
    reason = F.when(code.isin(*NON_SELLABLE_GROUPS), F.concat(F.lit("group:"), code))
    reason = reason.when(F.upper(clean_text(sku)) == "SHIPPING", F.lit("sku:SHIPPING"))
    for pattern in NON_SELLABLE_PATTERNS:
        reason = reason.when(text.rlike(f"(?i){pattern}"), F.lit(f"desc:{pattern}"))
    return reason


def source_skus(items: DataFrame) -> DataFrame:
    """Every distinct SKU of the item table, whatever the filters."""
    return items.select(clean_text(F.col("SKU")).alias("sku")).where("sku IS NOT NULL").distinct()


# -- product build -----------------------------------------------------------

@dataclass(frozen=True)
class BuildOptions:
    profile: str = "till"  # or "archive"
    quantity_source: str = "best"
    raw_titles: bool = False
    status: str | None = None
    full_sync: bool = False
    in_stock_status: str = "draft"
    zero_quantity_status: str = "archived"
    tags: bool = True
    metafields: bool = False
    html: bool = False
    namespace: str = "pos"


@dataclass(frozen=True)
class FilterOptions:
    skus: tuple[str, ...] = ()
    skip_non_sellable: bool = True
    skip_zero_price: bool = True
    skip_zero_quantity: bool = False


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def resolve_vendor_name(by_code: Column, second: Column, by_change: Column, code: Column) -> Column:
    return first_nonempty(by_code, clean_text(second), by_change, code)


def build_products(
    items: DataFrame, vendors: DataFrame, vendor_items: DataFrame, price_changes: DataFrame,
    quantities: DataFrame, options: BuildOptions = BuildOptions(), matrix: DataFrame | None = None,
) -> DataFrame:
    """Join the four lookups onto deduplicated items and project products.

    ``vendors`` is (vendor_id, company); the other lookups are keyed by SKU.
    ``matrix`` is (sku, variant_count, variant_quantity) for TYPE = M items.
    No side is hinted: sizes decide between broadcast and shuffle joins.
    Items without a SKU or description stay, with ``missing`` set.
    """
    archive = options.profile == "archive"
    pc, vi = _prefixed(price_changes, "pc_"), _prefixed(vendor_items, "vi_")
    rows = items.withColumn("_sku", clean_text(F.col("SKU")))
    rows = rows.join(vi, F.col("_sku") == F.col("vi_SKU"), "left")
    rows = rows.join(quantities.select(F.col("SKU").alias("_q_sku"), "cell_quantity"), F.col("_sku") == F.col("_q_sku"), "left")
    if not archive:
        rows = rows.join(pc, F.col("_sku") == F.col("pc_SKU"), "left")

    def text(*names: str) -> Column:
        return first_nonempty(*[clean_text(field(rows, n)) for n in names])

    def amount(*names: str) -> Column:
        return F.coalesce(*[_amount(rows, n) for n in names])

    code = text("VENDOR", "vi_VENDOR") if archive else text("VENDOR", "pc_VENDOR", "vi_VENDOR")
    rows = rows.withColumn("_code", code).withColumn("_change_code", clean_text(field(rows, "pc_VENDOR")))
    rows = rows.join(vendors.select(F.col("vendor_id").alias("_v1"), F.col("company").alias("_c1")), F.col("_code") == F.col("_v1"), "left")
    rows = rows.join(vendors.select(F.col("vendor_id").alias("_v2"), F.col("company").alias("_c2")), F.col("_change_code") == F.col("_v2"), "left")

    price = amount("PRICE") if archive else amount("PRICE", "pc_PRICE")
    tiers = [*PRICE_TIERS, "PRICE_W"] if archive else [t for p in PRICE_TIERS for t in (p, f"pc_{p}")]
    cost = amount("COST", "LAST_COST", "VEND_COST", "BASE_COST", "vi_BASE_COST")
    item_quantity = amount("QTY")
    # built in steps, so that every step is computed once
    changed = (lambda *names: text(*names[:1])) if archive else text
    rows = rows.withColumns({
        "department": text("GROUP"), "size_text": changed("SIZE", "pc_SIZE"), "color_text": changed("COLOR", "pc_COLOR"),
        "style_text": changed("STYLE", "pc_STYLE"), "vendor_item": changed("VEND_ID", "pc_VEND_ID", "vi_VEND_SKU"),
        "barcode_text": text("ALT_SKU", "BARCODE") if archive else text("ALT_SKU"), "second": text("DESC2"),
        "raw_desc": text("DESC"), "price_exact": price, "cost_exact": cost, "sku_key": F.col("_sku"), "vendor_code": F.col("_code"),
    })
    rows = rows.withColumn("compare_exact", choose_compare_at(F.col("price_exact"), *[_amount(rows, t) for t in tiers]))
    group_kind = group_product_type(F.col("department"))
    if archive:
        rows = rows.withColumns({
            "type_tag": first_nonempty(group_kind, plain_title_case(first_nonempty(text("PFIELD1"), F.col("department")))),
            "vendor_name": first_nonempty(F.col("_c1"), plain_title_case(first_nonempty(text("PFIELD2"), F.col("_code")))),
            "item_stock": F.coalesce(select_quantity(item_quantity, F.col("cell_quantity"), "best"), F.lit(0)),
        })
        rows = rows.withColumn("product_type", F.col("type_tag"))
        title = archive_title(F.col("raw_desc"), F.col("vendor_name"), F.col("size_text"), F.col("color_text"))
    else:
        rows = rows.withColumn("type_tag", first_nonempty(group_kind, text("PFIELD1"), F.col("department")))
        company = resolve_vendor_name(F.col("_c1"), field(rows, "PFIELD2"), F.col("_c2"), F.col("_code"))
        rows = rows.withColumns({
            "vendor_name": simplify_vendor(company, F.col("type_tag")), "product_type": smart_title_case(F.col("type_tag")),
            "item_stock": select_quantity(item_quantity, F.col("cell_quantity"), options.quantity_source),
        })
        title = F.col("raw_desc") if options.raw_titles else smart_title(
            F.col("raw_desc"), F.col("vendor_name"), F.col("vendor_code"), F.col("product_type"), F.col("size_text"),
            F.col("color_text"), F.col("second"),
        )
    rows = rows.withColumn("title", title)
    variant_count, stock = F.lit(0), F.col("item_stock")
    if matrix is not None:
        rows = rows.join(
            matrix.select(F.col("sku").alias("_m_sku"), "variant_count", "variant_quantity"),
            (F.col("sku_key") == F.col("_m_sku")) & (F.upper(clean_text(field(rows, "TYPE"))) == "M"),
            "left",
        )
        variant_count = F.coalesce(F.col("variant_count"), F.lit(0))
        stock = F.when(variant_count > 0, F.col("variant_quantity")).otherwise(F.col("item_stock"))
    status = F.lit(options.status).cast("string")
    if options.status is None and options.full_sync:
        status = F.when(stock > 0, options.in_stock_status).when(stock <= 0, options.zero_quantity_status)
    tags = payloads.build_tags(
        department=F.col("department"), product_type=F.col("type_tag"), style=F.col("style_text"),
        size=F.col("size_text"), color=F.col("color_text"), vendor_code=F.col("vendor_code"),
        vendor_item=F.col("vendor_item"), fields=[field(rows, f"PFIELD{i}") for i in range(1, 6)],
    ) if options.tags else F.array().cast("array<string>")
    metafields = (
        payloads.item_metafields(rows, stock, options.namespace) if options.metafields
        else F.array().cast(payloads.METAFIELDS)
    )
    html = payloads.description_html(rows, stock) if options.html else F.lit(None).cast("string")
    arrival = [c for c in ("first_seen", "without_sku", "_rec_no") if c in rows.columns]
    return rows.select(
        F.col("sku_key").alias("sku"), "raw_desc", "title", F.col("vendor_name").alias("vendor"),
        "vendor_code", "product_type", "department", F.col("size_text").alias("size"),
        F.col("color_text").alias("color"), F.col("style_text").alias("style"), "vendor_item",
        F.col("second").alias("desc2"), F.col("barcode_text").alias("barcode"),
        till_money(F.col("price_exact")).alias("price"),
        till_money(F.col("compare_exact")).alias("compare_at_price"),
        till_money(F.col("cost_exact")).alias("cost"), stock.alias("quantity"), status.alias("status"),
        tags.alias("tags"), payloads.build_images(*[field(rows, f) for f in ("IMAGE", "IMAGE2", "IMAGE3", "IMAGE4")]).alias("images"),
        metafields.alias("metafields"), html.alias("description_html"), variant_count.alias("variant_count"),
        non_sellable_reason(field(rows, "GROUP"), F.col("sku_key"), F.col("raw_desc")).alias("non_sellable"),
        (F.col("sku_key").isNull() | F.col("raw_desc").isNull()).alias("missing"), *arrival,
    )


def skip_reason(options: FilterOptions = FilterOptions()) -> Column:
    """First filter a built product fails, or null."""
    reason = F.when(F.lit(False), F.lit(""))
    if options.skus:
        reason = reason.when(~F.coalesce(F.col("sku").isin(*options.skus), F.lit(False)), "not_selected")
    if options.skip_non_sellable:
        reason = reason.when(F.col("non_sellable").isNotNull(), "non_sellable")
    reason = reason.when(F.col("missing"), "missing_payload")
    if options.skip_zero_price:
        reason = reason.when(F.coalesce(F.col("price"), F.lit(0)) <= 0, "zero_price")
    if options.skip_zero_quantity:
        reason = reason.when(F.coalesce(F.col("quantity"), F.lit(0)) <= 0, "zero_quantity")
    return reason


def filter_products(
    products: DataFrame, options: FilterOptions = FilterOptions(), limit: int | None = None,
    order: Sequence[str] = ("without_sku", "first_seen"),
) -> DataFrame:
    """Products that pass every filter; the limit counts in file order."""
    kept = products.where(skip_reason(options).isNull())
    return kept.orderBy(*order).limit(limit) if limit is not None else kept


def page_products(products: DataFrame, order: Sequence[str], limit: int = 50, offset: int = 0, most: int = 250) -> DataFrame:
    """One page, 1 to ``most`` rows."""
    return products.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))
