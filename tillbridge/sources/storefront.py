"""Landed storefront pages (nested JSON) to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.functions.keys import resource_uri

_STATES = "array<struct<name:string,quantity:int>>"
_LEVELS = f"struct<nodes:array<struct<location:struct<id:string,name:string>,updatedAt:string,quantities:{_STATES}>>>"
_ITEM = f"struct<id:string,unitCost:struct<amount:string>,inventoryLevels:{_LEVELS}>"
PRODUCT = (
    "id string, title string, handle string, status string, vendor string, productType string, updatedAt string,"
    "autoArchivedZeroStock struct<value:string>, metafield struct<value:string>,"
    "media struct<nodes:array<struct<alt:string,image:struct<url:string>>>>,"
    "variants struct<pageInfo:struct<hasNextPage:boolean>,"
    f"nodes:array<struct<id:string,sku:string,barcode:string,price:string,inventoryItem:{_ITEM}>>>"
)
INVENTORY_ITEM = (
    "id string, sku string, duplicateSkuCount int,"
    f"inventoryLevel struct<updatedAt:string,quantities:{_STATES}>"
)
VARIANT = (
    "id string, sku string, price string,"
    "product struct<id:string,title:string,status:string,autoArchivedZeroStock:struct<value:string>>,"
    f"inventoryItem {_ITEM}"
)


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def first_level_quantity(levels: Column) -> Column:
    """First state of the first level that has states, at any location."""
    filled = F.filter(levels, lambda x: F.size(x["quantities"]) > 0)
    return _first(_first(filled)["quantities"])["quantity"]


def is_marked(marker: Column) -> Column:
    return F.lower(F.trim(F.coalesce(marker, F.lit("")))) == "true"


def flatten_catalog(products: DataFrame) -> DataFrame:
    """One row per variant; a product without variants still gives one."""
    urls = F.filter(F.transform("media.nodes", lambda m: m["image"]["url"]), lambda u: F.coalesce(u, F.lit("")) != "")
    rows = products.select("*", _first(urls).alias("image_url"), F.explode_outer("variants.nodes").alias("v"))
    return rows.select(
        F.col("id").alias("product_id"), F.col("v.id").alias("variant_id"),
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled product")).alias("title"), "handle", "status",
        F.col("v.sku").alias("sku"), F.col("v.barcode").alias("barcode"), F.col("v.price").try_cast("double").alias("price"),
        F.col("v.inventoryItem.unitCost.amount").try_cast("double").alias("cost"),
        first_level_quantity(F.col("v.inventoryItem.inventoryLevels.nodes")).alias("quantity"), "vendor",
        F.col("productType").alias("product_type"), "image_url", F.col("updatedAt").alias("updated_at"),
        F.trim("metafield.value").alias("marker"), is_marked(F.col("autoArchivedZeroStock.value")).alias("marked"),
        F.coalesce("variants.pageInfo.hasNextPage", F.lit(False)).alias("truncated"),
    )


def catalog_record(products: DataFrame, sku: Column) -> DataFrame:
    """One row per product: the variant with the SKU, else the first one."""
    nodes = F.col("variants.nodes")
    hit = _first(F.filter(nodes, lambda v: (sku != "") & (F.trim(v["sku"]) == sku)))
    one = F.coalesce(hit, _first(nodes))
    return products.select(
        F.col("id").alias("product_id"), one["id"].alias("variant_id"), "title", "handle", "status", one["sku"].alias("sku"),
        one["price"].try_cast("double").alias("price"),
        first_level_quantity(one["inventoryItem"]["inventoryLevels"]["nodes"]).alias("quantity"),
    )


def flatten_inventory_snapshot(items: DataFrame, location: str, authority: str) -> DataFrame:
    """Inventory item pages to one row per non-blank SKU."""
    level = F.col("inventoryLevel")
    available = _first(F.filter(level["quantities"], lambda q: q["name"] == "available"))["quantity"]
    return items.where("trim(sku) <> ''").select(
        F.trim("sku").alias("sku"), available.alias("quantity"), F.col("id").alias("inventory_item_id"),
        resource_uri("Location", F.lit(location), authority).alias("location_id"),
        level["updatedAt"].alias("inventory_level_updated_at"), level.isNotNull().alias("available_at_location"),
        F.coalesce("duplicateSkuCount", F.lit(0)).alias("duplicate_sku_count"),
    )


def variant_inventory_rows(products: DataFrame, location: str, authority: str) -> DataFrame:
    """Variants of product pages with their stock at one location."""
    target = resource_uri("Location", F.lit(location), authority)
    rows = products.select(F.col("id").alias("product_id"), F.explode("variants.nodes").alias("v"))
    item = F.col("v.inventoryItem")
    here = _first(F.filter(
        item["inventoryLevels"]["nodes"], lambda x: resource_uri("Location", x["location"]["id"], authority) == target
    ))
    available = _first(F.filter(here["quantities"], lambda q: (q["name"] == "available") & q["quantity"].isNotNull()))
    return rows.where("trim(v.sku) <> '' AND trim(v.inventoryItem.id) <> ''").select(
        "product_id", F.trim("v.sku").alias("sku"), resource_uri("InventoryItem", item["id"], authority).alias("inventory_item_id"),
        target.alias("location_id"), available["quantity"].alias("quantity"),
        F.nullif(F.trim(here["updatedAt"]), F.lit("")).alias("inventory_level_updated_at"),
    )


def level_states(items: DataFrame) -> DataFrame:
    """Long stock states of every item and location."""
    rows = items.select(F.col("id").alias("item_id"), F.explode("inventoryLevels.nodes").alias("x"))
    return rows.select("item_id", F.col("x.location.id").alias("location_id"), F.explode_outer("x.quantities").alias("q")).select(
        "item_id", "location_id", F.col("q.name").alias("state"), F.col("q.quantity").alias("quantity")
    )


def parse_variant_mapping(variants: DataFrame) -> DataFrame:
    """Variant nodes to mapping rows."""
    levels = F.transform("inventoryItem.inventoryLevels.nodes", lambda x: F.struct(
        x["location"]["id"].alias("location_id"), x["location"]["name"].alias("location_name"),
        _first(x["quantities"])["quantity"].alias("quantity"),
    ))
    return variants.select(
        "sku", F.col("id").alias("variant_id"), F.col("product.id").alias("product_id"),
        F.col("inventoryItem.id").alias("inventory_item_id"), F.col("product.status").alias("product_status"),
        is_marked(F.col("product.autoArchivedZeroStock.value")).alias("marked"), F.col("price").try_cast("double").alias("current_price"),
        F.col("inventoryItem.unitCost.amount").try_cast("double").alias("current_cost"), levels.alias("levels"),
    )
