"""Inbound payloads, as JSON or forms, to typed rows; bad values become an ``error`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.functions.keys import filled, folded_keys, is_stock_record, pick_filled, resource_uri
from tillbridge.functions.money import as_flag, as_number, as_whole
from tillbridge.functions.text import first_nonempty, let
from tillbridge.functions.times import parse_time
from tillbridge.operators.ordering import spread
from tillbridge.operators.orders import ADDRESS, LINE_ITEM, ORDER
from tillbridge.operators.payloads import JSON, LINE

# Accepted names of each product field.
TITLE = ("title", "name", "product_name")
HTML = ("description_html", "body_html", "long_description", "full_description")
BARCODE = ("barcode", "ean", "upc", "gtin", "alternate sku", "alternate_sku")
PRICE = ("price", "regular_price", "web price", "web_price", "our sell price", "our_sell_price")
SUGGESTED = ("sugg retail", "sugg. retail", "suggested retail")
COMPARE_AT = ("compare_at_price", "sale_price", *SUGGESTED)
COST = ("cost", "cost_price", "cost price", "unit_cost", "unit cost", "cost per item", "our cost", "item cost")
UPDATE = ("update_description", "update description", "overwrite_description", "overwrite description")
CATEGORIES = (
    "categories", "category", *[f"category{i}" for i in range(1, 7)], "web categories",
    *[f"web category {i}" for i in range(1, 7)],
)
LABELS = (
    ("Style", ("style",)), ("Size", ("size",)), ("Color", ("color",)), ("Department", ("department",)),
    ("Vendor Item", ("vendor item", "vendor_item")), *[(f"PField{i}", (f"pfield{i}",)) for i in range(1, 6)],
)
IMAGES = ("images", "image_urls", "image urls")
ONE_IMAGE = ("image_url", "image url", "image")


def _blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _list_items(value: Column, kind: str = "array<string>") -> Column:
    return F.when(F.trim(value).startswith("["), F.from_json(value, kind))


def named_values(value: Column) -> Column:
    """Names in a comma list or a JSON array of texts or ``{name: ...}``."""
    def names(text: Column) -> Column:
        listed = F.transform(
            _list_items(text),
            lambda x: F.trim(F.when(x.startswith("{"), F.get_json_object(x, "$.name")).otherwise(x)),
        )
        split = F.transform(F.split(text, ","), lambda x: F.trim(x))
        return F.coalesce(listed, split, F.array().cast("array<string>"))

    return F.filter(let(value, names), lambda x: x.isNotNull() & (x != ""))


def image_urls(value: Column) -> Column:
    def urls(text: Column) -> Column:
        listed = F.transform(
            _list_items(text),
            lambda x: F.trim(
                F.when(
                    x.startswith("{"),
                    F.coalesce(F.nullif(F.get_json_object(x, "$.src"), F.lit("")), F.get_json_object(x, "$.url")),
                ).otherwise(x)
            ),
        )
        return F.coalesce(listed, F.transform(F.split(text, ","), lambda x: F.trim(x)), F.array().cast("array<string>"))

    return F.filter(let(value, urls), lambda x: x.isNotNull() & (x != ""))


def metafield_list(value: Column) -> Column:
    """Metafields given as an array, one object, or a plain map of values."""
    shape = "struct<namespace:string,key:string,value:string,type:string>"

    def entries(text: Column) -> Column:
        many = _list_items(text, f"array<{shape}>")
        is_object = F.trim(text).startswith("{")
        one = F.when(is_object & (F.coalesce(F.get_json_object(text, "$.key"), F.lit("")) != ""), F.array(F.from_json(text, shape)))
        plain = F.when(is_object, F.transform(
            F.map_entries(F.from_json(text, "map<string,string>")),
            lambda e: F.struct(
                F.lit("custom").alias("namespace"), e["key"].alias("key"), e["value"].alias("value"),
                F.when(e["value"].rlike(r"^[\[{]"), JSON).otherwise(LINE).alias("type"),
            ),
        ))
        return F.coalesce(many, one, plain, F.array().cast(f"array<{shape}>"))

    cleaned = F.transform(let(value, entries), lambda m: F.struct(
        F.coalesce(_blank_to_null(m["namespace"]), F.lit("custom")).alias("namespace"), _blank_to_null(m["key"]).alias("key"),
        F.nullif(m["value"], F.lit("")).alias("value"), F.coalesce(_blank_to_null(m["type"]), F.lit(LINE)).alias("type"),
    ))
    return F.filter(cleaned, lambda m: m["key"].isNotNull() & m["value"].isNotNull())


FORM, MULTIPART, JSON_BODY = "application/x-www-form-urlencoded", "multipart/form-data", "application/json"
BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"
PAIRS = "array<struct<name:string,value:string>>"


def unquoted(text: Column) -> Column:
    """Plus signs and percent escapes of a form undone as UTF-8; a percent sign that begins no escape stays."""
    return F.url_decode(F.regexp_replace(text, BAD_ESCAPE, "%25"))


def form_pairs(body: Column) -> Column:
    """Names and values of a URL-encoded form or query, in order; a name without a value has an empty one."""
    fields = F.filter(F.split(F.coalesce(body, F.lit("")), "&"), lambda x: x != "")

    def pair(field: Column) -> Column:
        def parts(at: Column) -> Column:
            name = F.when(at > 0, F.substring(field, F.lit(1), at - 1)).otherwise(field)
            value = F.when(at > 0, F.substring(field, at + 1, F.length(field))).otherwise("")
            return F.struct(unquoted(name).alias("name"), unquoted(value).alias("value"))

        return let(F.instr(field, "="), parts)

    return F.transform(fields, pair)


def multipart_pairs(body: Column, content_type: Column) -> Column:
    """Names and values of the text parts of a multipart form, in order; file parts are left out."""
    boundary = F.regexp_extract(content_type, '(?i)boundary="?([^";]+)', 1)
    parts = F.filter(F.split(F.coalesce(body, F.lit("")), F.concat(F.lit("\\Q--"), boundary, F.lit("\\E"))), lambda x: F.contains(x, F.lit("\r\n\r\n")))

    def pair(part: Column) -> Column:
        at = F.instr(part, "\r\n\r\n")
        head = F.substring(part, F.lit(1), at)
        value = F.regexp_replace(F.substring(part, at + 4, F.length(part)), "\r\n$", "")
        return F.struct(F.regexp_extract(head, '(?i)[; ]name="([^"]*)"', 1).alias("name"), value.alias("value"), F.contains(F.lower(head), F.lit("filename=")).alias("file"))

    texts = F.filter(F.transform(parts, pair), lambda p: ~p["file"])
    return F.transform(texts, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))


def multimap(pairs: Column) -> Column:
    """Names to values; a repeated name has the JSON list of its values. Bounded by one payload."""
    def mapped(v: Column) -> Column:
        def values(name: Column) -> Column:
            own = F.transform(F.filter(v["pairs"], lambda p: p["name"] == name), lambda p: p["value"])
            return let(own, lambda o: F.when(F.size(o) > 1, F.to_json(o)).otherwise(F.get(o, F.lit(0))))

        return F.map_from_arrays(v["names"], F.transform(v["names"], values))

    named = let(pairs, lambda ps: F.struct(ps.alias("pairs"), F.array_distinct(F.transform(ps, lambda p: p["name"])).alias("names")))
    return let(named, mapped)


def payload_fields(payload: Column, content_type: Column | None = None, ignored: tuple[str, ...] = ()) -> Column:
    """Fields of a JSON object or a form as texts, null when the body is neither.

    Without a type, or with an unknown one, a body counts as JSON. ``ignored``
    names form fields that are left out, such as credentials in a query.
    """
    json = F.from_json(payload, "map<string,string>")
    if content_type is None:
        return json
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    pairs = F.when(kind == FORM, form_pairs(payload)).when(kind == MULTIPART, multipart_pairs(payload, content_type))
    pairs = F.filter(pairs, lambda p: ~p["name"].isin(*ignored)) if ignored else pairs
    return F.when(kind.isin(FORM, MULTIPART), multimap(F.coalesce(pairs, F.array().cast(PAIRS)))).otherwise(json)


class Picks:
    """Values picked from a payload's maps, all in one expression; ``of`` names a value, ``added`` computes them.

    Hundreds of lookups in one lambda are evaluated as they are: as generated
    code they make methods too long for the virtual machine to compile.
    """

    def __init__(self, column: str = "_picks"):
        self.column, self.wanted = column, {}

    def of(self, *names: str) -> Column:
        key = self.wanted.setdefault(names, f"v{len(self.wanted)}")
        return F.col(f"{self.column}.{key}")

    def added(self, rows: DataFrame, raw: Column, folded: Column) -> DataFrame:
        maps = F.struct(filled(raw).alias("raw"), filled(folded).alias("folded"))
        fields = let(maps, lambda v: F.struct(*[pick_filled(v["raw"], v["folded"], *names).alias(key) for names, key in self.wanted.items()]))
        return rows.withColumn(self.column, fields)


def _first_error(*checks: tuple[Column, str]) -> Column:
    error = F.when(F.lit(False), F.lit(""))
    for bad, name in checks:
        error = error.when(F.coalesce(bad, F.lit(False)), name)
    return error


def parse_product_events(rows: DataFrame, payload: str = "payload", content_type: str | None = None, refuse_bad_escapes: bool = False) -> DataFrame:
    """Canonical product columns from JSON objects, or forms, with any key spelling.

    ``content_type`` names the column that tells forms from JSON. A percent sign
    without two hex digits stays in the text, or makes an error row on request.
    """
    kind = None if content_type is None else F.col(content_type)
    parsed = spread(rows).withColumn("_map", payload_fields(F.col(payload), kind))
    parsed = parsed.withColumn("_folded", folded_keys(F.col("_map")))
    raw, picks = F.col("_map"), Picks()
    value = picks.of
    bare = F.lit("") if kind is None else F.lower(F.trim(F.substring_index(F.coalesce(kind, F.lit("")), ";", 1)))
    form, typed_other = bare.isin(FORM, MULTIPART), ~bare.isin("", JSON_BODY)

    def text(*names: str) -> Column:
        return _blank_to_null(value(*names))

    listed = F.array_distinct(F.flatten(F.array(*[named_values(value(c)) for c in CATEGORIES])))
    categories = F.col("_categories")
    labels = [F.concat(F.lit(f"{label}:"), text(*names)) for label, names in LABELS]
    tags = F.array_distinct(F.concat(named_values(value("tags")), categories, F.array_compact(F.array(*labels))))
    titled = first_nonempty(F.try_element_at(raw, F.lit("Description")), F.try_element_at(raw, F.lit("DESCRIPTION")))
    generic = _blank_to_null(F.try_element_at(raw, F.lit("description")))
    title = F.coalesce(text(*TITLE), _blank_to_null(titled))
    borrowed = title.isNull() & generic.isNotNull() & is_stock_record(value)
    price, bad_price = as_number(F.coalesce(value(*PRICE), value(*SUGGESTED)))
    compare, bad_compare = as_number(value(*COMPARE_AT))
    cost, bad_cost = as_number(value(*COST))
    stock, bad_stock = as_whole(F.coalesce(value("quantity", "qty"), value("stock_quantity")))
    tracked, bad_tracked = as_flag(F.coalesce(value("tracked"), value("manage_stock", "manage stock")))
    shipped, bad_shipped = as_flag(value("requires_shipping", "requires shipping"))
    update, bad_update = as_flag(value(*UPDATE))
    images = image_urls(value(*IMAGES))
    single = text(*ONE_IMAGE)
    images = F.when(single.isNotNull() & ~F.array_contains(images, single), F.array_prepend(images, single)).otherwise(images)
    error = _first_error(
        *([] if kind is None else [(form & F.lit(refuse_bad_escapes) & F.col(payload).rlike(BAD_ESCAPE), "invalid_form_escape"), (typed_other & raw.isNull(), "unsupported_content_type")]),
        (raw.isNull() | (~form & ~F.trim(payload).startswith("{")), "invalid_product_payload"),
        (bad_price | bad_compare | bad_cost, "invalid_price"), (bad_stock, "invalid_quantity"),
        (bad_tracked | bad_shipped | bad_update, "invalid_boolean"),
    )
    fields = [
        *rows.columns, text("sku").alias("sku"), F.when(borrowed, generic).otherwise(title).alias("title"),
        text("name").alias("name"), text("handle", "slug").alias("handle"),
        text("external_id", "id", "product_id").alias("external_id"),
        F.coalesce(text(*HTML), F.when(~borrowed, generic)).alias("description_html"),
        text("short_description", "short description").alias("short_description"),
        F.coalesce(update, F.lit(False)).alias("update_description"), text("vendor", "brand").alias("vendor"),
        text("brand").alias("brand"),
        F.coalesce(text("product_type", "product type"), text("department"), F.try_element_at(categories, F.lit(1))).alias("product_type"),
        tags.alias("tags"), text("status").alias("status"), text(*BARCODE).alias("barcode"), price.alias("price"),
        compare.alias("compare_at_price"), cost.alias("cost"), stock.alias("quantity"), tracked.alias("tracked"),
        shipped.alias("requires_shipping"), images.alias("images"),
        metafield_list(value("metafields", "metafield")).alias("metafields"), error.alias("error"),
    ]
    return picks.added(parsed, raw, F.col("_folded")).withColumn("_categories", listed).select(*fields)


def unwrap_bulk(rows: DataFrame, plural: str, payload: str = "payload") -> DataFrame:
    """One row per item of a bulk request, with its index.

    A list, ``{<plural>: [...]}``, ``{create: [...], update: [...]}`` or one object.
    """
    body = F.trim(payload)
    fields = F.when(body.startswith("{"), F.from_json(body, "map<string,string>"))

    def listed(name: str) -> Column:
        return _list_items(F.try_element_at(fields, F.lit(name)))

    empty = F.array().cast("array<string>")
    both = F.when(
        listed("create").isNotNull() | listed("update").isNotNull(),
        F.concat(F.coalesce(listed("create"), empty), F.coalesce(listed("update"), empty)),
    )
    items = F.coalesce(_list_items(body), listed(plural), both, F.when(fields.isNotNull(), F.array(body)))
    error = F.when(items.isNull(), "invalid_bulk_payload")
    return rows.select(
        *[c for c in rows.columns if c != payload], error.alias("bulk_error"), F.posexplode_outer(items).alias("item_index", payload)
    )


def _parse_address(item: Column) -> Column:
    def fields(v: Column) -> Column:
        def text(*names: str) -> Column:
            return _blank_to_null(pick_filled(v["raw"], v["folded"], *names))

        return F.struct(
            text("firstName", "first_name", "first name").alias("first_name"),
            text("lastName", "last_name", "last name").alias("last_name"), text("company").alias("company"),
            text("address1", "address_1", "address").alias("address1"), text("address2", "address_2").alias("address2"),
            text("city").alias("city"), text("provinceCode", "province_code", "state").alias("province_code"),
            text("zip", "zipcode", "postal_code").alias("zip"),
            F.coalesce(text("countryCode", "country_code", "country"), F.lit("US")).alias("country_code"),
            text("phone").alias("phone"),
        )

    keyed = let(F.from_json(item, "map<string,string>"), lambda raw: F.struct(filled(raw).alias("raw"), filled(folded_keys(raw)).alias("folded")))
    return let(keyed, fields)


def parse_customer_events(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Canonical customer columns from JSON objects with any key spelling."""
    parsed = spread(rows).withColumn("_map", F.from_json(payload, "map<string,string>"))
    parsed = parsed.withColumn("_folded", folded_keys(F.col("_map")))
    raw, picks = F.col("_map"), Picks()
    value = picks.of

    def text(*names: str) -> Column:
        return _blank_to_null(value(*names))

    places = value("addresses", "address")
    items = let(places, lambda p: F.coalesce(_list_items(p), F.when(F.trim(p).startswith("{"), F.array(p)), F.array().cast("array<string>")))
    addresses = F.transform(F.filter(items, lambda x: x.startswith("{")), _parse_address)
    exempt, bad_exempt = as_flag(value("taxExempt", "tax_exempt", "tax exempt"))
    error = _first_error(
        (raw.isNull() | ~F.trim(payload).startswith("{"), "invalid_customer_payload"), (bad_exempt, "invalid_boolean")
    )
    fields = [
        *rows.columns, text("source", "source_file").alias("source"),
        text("pos_customer_number", "customer_number", "customer number", "cust_num", "cust num", "id").alias("pos_customer_number"),
        text("firstName", "first_name", "first name").alias("first_name"),
        text("lastName", "last_name", "last name").alias("last_name"), text("email", "internet").alias("email"),
        text("phone", "phone_h", "phone_w").alias("phone"), text("company").alias("company"),
        named_values(value("tags")).alias("tags"), exempt.alias("tax_exempt"), addresses.alias("addresses"),
        text("note", "notes").alias("note"),
        metafield_list(value("metafields", "metafield")).alias("metafields"), error.alias("error"),
    ]
    return picks.added(parsed, raw, F.col("_folded")).select(*fields)


_WEBHOOK = (
    "id string, name string, order_number string, confirmation_number string, created_at string, updated_at string,"
    "processed_at string, cancelled_at string, closed_at string, financial_status string, fulfillment_status string,"
    "currency string, current_subtotal_price string, subtotal_price string, current_total_discounts string,"
    "total_discounts string, current_total_tax string, total_tax string, current_total_price string,"
    "total_price string, contact_email string, email string, phone string, note string, tags string, redacted boolean,"
    "current_shipping_price_set struct<shop_money:struct<amount:string>>,"
    "total_shipping_price_set struct<shop_money:struct<amount:string>>,"
    "customer struct<first_name:string,last_name:string,phone:string>,"
    f"billing_address {ADDRESS}, shipping_address {ADDRESS}, line_items array<{LINE_ITEM}>,"
    "shipping_lines array<struct<id:string,code:string,title:string,price:string,discounted_price:string>>"
)


def parse_order_events(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Compact order from a webhook body; the schema is the allow-list."""
    body = rows.withColumn("_b", F.from_json(payload, _WEBHOOK))
    b = F.col("_b")
    plain = (
        "id", "name", "order_number", "confirmation_number", "created_at", "updated_at", "processed_at", "cancelled_at",
        "closed_at", "financial_status", "fulfillment_status", "currency",
    )

    def preferred(*names: str) -> Column:
        return first_nonempty(*[b[n] for n in names])

    shipping = F.coalesce(b["current_shipping_price_set"], b["total_shipping_price_set"])["shop_money"]["amount"]
    order = F.struct(
        *[F.nullif(b[n], F.lit("")).alias(n) for n in plain],
        preferred("current_subtotal_price", "subtotal_price").alias("subtotal_price"),
        preferred("current_total_discounts", "total_discounts").alias("total_discounts"),
        F.nullif(shipping, F.lit("")).alias("shipping_price"),
        preferred("current_total_tax", "total_tax").alias("total_tax"),
        preferred("current_total_price", "total_price").alias("total_price"),
        preferred("contact_email", "email").alias("email"),
        first_nonempty(b["phone"], b["customer"]["phone"]).alias("phone"),
        F.nullif(b["customer"]["first_name"], F.lit("")).alias("customer_first_name"),
        F.nullif(b["customer"]["last_name"], F.lit("")).alias("customer_last_name"),
        F.nullif(b["note"], F.lit("")).alias("note"), F.nullif(b["tags"], F.lit("")).alias("tags"), b["redacted"].alias("redacted"),
        b["billing_address"].alias("billing_address"), b["shipping_address"].alias("shipping_address"),
        F.filter(b["line_items"], lambda x: x.isNotNull()).alias("line_items"),
        F.filter(b["shipping_lines"], lambda x: x.isNotNull()).alias("shipping_lines"),
    ).cast(ORDER)
    return body.select(*[c for c in rows.columns if c != payload], order.alias("order"))


def parse_inventory_events(
    rows: DataFrame, shops: DataFrame, items: DataFrame, location: str, authority: str, payload: str = "payload"
) -> DataFrame:
    """Stock webhooks with their SKU; ignored ones keep a reason.

    rows (shop, payload, ...); shops (shop); items (shop, inventory_item_id,
    sku). Both lookups are keyed left joins, usable stream-static as well.
    """
    body = F.from_json(payload, "inventory_item_id string, location_id string, available string, updated_at string")
    parsed = rows.withColumn("_b", body)
    item, place = F.nullif(F.col("_b.inventory_item_id"), F.lit("")), F.nullif(F.col("_b.location_id"), F.lit(""))
    parsed = parsed.withColumns({
        "inventory_item_id": resource_uri("InventoryItem", item, authority),
        "location_id": resource_uri("Location", place, authority),
        "quantity": F.col("_b.available").try_cast("int"),
    })
    known = shops.select("shop", F.lit(True).alias("_installed")).distinct()
    parsed = parsed.join(known, "shop", "left").join(items, ["shop", "inventory_item_id"], "left")
    target = resource_uri("Location", F.lit(location), authority)
    reason = (
        F.when(item.isNull() | place.isNull() | F.col("_b.available").isNull(), "missing_inventory_fields")
        .when(F.col("_installed").isNull(), "shop_not_installed")
        .when(F.col("location_id") != target, "different_location")
        .when(F.coalesce("sku", F.lit("")) == "", "inventory_item_has_no_sku")
    )
    return parsed.withColumns({
        "reason": reason, "status": F.when(reason.isNull(), "queued").otherwise("ignored"),
        "source_updated_at": parse_time(F.col("_b.updated_at")),
    }).drop("_b", "_installed", payload)
