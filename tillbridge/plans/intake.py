"""Payloads and landed pages derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.operators import payloads, reports
from tillbridge.plans import proxies as p
from tillbridge.plans.registry import Tables, query
from tillbridge.sources import events, profile, storefront

AUTHORITY = "shop.example"


def concat(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def product_payloads(t: Tables) -> DataFrame:
    """Product JSON with mixed key spellings, one form per third of the parts."""
    k, price, size = F.col("p_partkey"), p.money("p_retailprice"), F.col("p_size")
    canonical = concat('{"sku":"P', k, '","title":" ', F.col("p_name"), ' ","price":', price, ',"quantity":"', size, '.9","tags":"a, b,,a","vendor":"', F.col("p_brand"), '","images":["http://x/', k, '",{"url":"http://y"}]}')
    spelled = concat('{"SKU":"P', k, '","Description":"', F.col("p_name"), '","Regular Price":"', price, '","QTY":', size, ',"Department":"', F.col("p_type"), '","Category 1":"c1, c2","Alternate SKU":"A', k, '","Manage Stock":"Yes","image":"http://z"}')
    odd = concat('{"sku":"P', k, '","description":"', F.col("p_name"), '","vendor":"V","qty":"', F.when(k % 5 == 0, "many").otherwise(size.cast("string")), '","Sugg. Retail":"', F.when(k % 7 == 0, "n/a").otherwise(price.cast("string")), '","metafields":{"m1":"1","m2":[1]}}')
    body = F.when(k % 3 == 0, canonical).when(k % 3 == 1, spelled).otherwise(odd)
    return t.part.select(k.alias("k"), body.alias("payload"))


PRODUCT_SQL = """
SELECT p_partkey AS k, 'P' || p_partkey AS sku, p_name AS title,
  CASE WHEN p_partkey % 3 = 2 AND p_partkey % 7 = 0 THEN NULL ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) END AS price,
  CASE WHEN p_partkey % 3 = 2 AND p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS quantity,
  CASE p_partkey % 3 WHEN 0 THEN 'a;b' WHEN 1 THEN 'c1;c2;Department:' || p_type ELSE '' END AS tags, CASE p_partkey % 3 WHEN 1 THEN p_type END AS product_type,
  CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 2 THEN 'V' END AS vendor, CASE p_partkey % 3 WHEN 1 THEN 'A' || p_partkey END AS barcode, CASE WHEN p_partkey % 3 = 1 THEN true END AS tracked,
  CASE p_partkey % 3 WHEN 0 THEN 'http://x/' || p_partkey || ';http://y' WHEN 1 THEN 'http://z' ELSE '' END AS images, CAST(CASE WHEN p_partkey % 3 = 2 THEN 2 ELSE 0 END AS INTEGER) AS metafields,
  CASE WHEN p_partkey % 3 = 2 THEN CASE WHEN p_partkey % 7 = 0 THEN 'invalid_price' WHEN p_partkey % 5 = 0 THEN 'invalid_quantity' END END AS error FROM part"""


@query("parse_product_events", PRODUCT_SQL)
def parse_product_events(t: Tables) -> DataFrame:
    rows = events.parse_product_events(product_payloads(t))
    return rows.select(
        "k", "sku", "title", "price", "quantity", F.concat_ws(";", "tags").alias("tags"), "product_type", "vendor", "barcode", "tracked",
        F.concat_ws(";", "images").alias("images"), F.size("metafields").alias("metafields"), "error",
    )


def form_payloads(t: Tables) -> DataFrame:
    """The same products: a third as URL-encoded forms, a third as multipart forms, the rest as JSON."""
    k, price, size = F.col("p_partkey"), p.money("p_retailprice"), F.col("p_size")
    coded = concat("sku=P", k, "&title=+", F.url_encode("p_name"), "%20&price=", price, "&quantity=", size, ".9&tags=a%2C+b%2C%2Ca&vendor=", F.url_encode("p_brand"), "&images=http%3A%2F%2Fx%2F", k, "&images=http%3a%2f%2fy&note=50%25+off+100%&blank")
    cells = [("SKU", concat("P", k)), ("Description", F.col("p_name")), ("Regular Price", price), ("QTY", size), ("Department", F.col("p_type")), ("Category 1", F.lit("c1, c2")), ("Alternate SKU", concat("A", k)), ("Manage Stock", F.lit("Yes")), ("image", F.lit("http://z"))]
    lines = [concat("--x-", k, '\r\nContent-Disposition: form-data; name="', name, '"\r\n\r\n', value, "\r\n") for name, value in cells]
    upload = concat("--x-", k, '\r\nContent-Disposition: form-data; name="title"; filename="t.txt"\r\n\r\nnot a title\r\n--x-', k, "--\r\n")
    form = k % 3 == 0
    # the supplied file is small, its bodies are not: sizes would send them all through the driver
    rows = product_payloads(t).hint("merge").join(t.part.select(k.alias("k"), F.when(form, coded).when(k % 3 == 1, F.concat(*lines, upload)).alias("form")), "k")
    kind = F.when(F.col("k") % 3 == 0, "application/x-www-form-urlencoded; charset=utf-8").when(F.col("k") % 3 == 1, concat('multipart/form-data; boundary="x-', F.col("k"), '"')).otherwise("application/json")
    return rows.select("k", F.coalesce("form", "payload").alias("payload"), kind.alias("content_type"))


@query("parse_form_events", PRODUCT_SQL)
def parse_form_events(t: Tables) -> DataFrame:
    rows = events.parse_product_events(form_payloads(t), content_type="content_type")
    return rows.select(
        "k", "sku", "title", "price", "quantity", F.concat_ws(";", "tags").alias("tags"), "product_type", "vendor", "barcode", "tracked",
        F.concat_ws(";", "images").alias("images"), F.size("metafields").alias("metafields"), "error",
    )


@query("unwrap_bulk", """
SELECT p_partkey // 4 AS k, CASE WHEN (p_partkey // 4) % 5 = 4 THEN NULL ELSE p_partkey % 4 END::INTEGER AS item_index, CASE WHEN (p_partkey // 4) % 5 = 4 THEN NULL ELSE p_name END AS name, CASE WHEN (p_partkey // 4) % 5 = 4 THEN 'invalid_bulk_payload' END AS bulk_error
FROM part WHERE (p_partkey // 4) % 5 < 3 OR p_partkey % 4 = 0""")
def unwrap_bulk(t: Tables) -> DataFrame:
    item = concat('{"name":"', F.col("p_name"), '"}')
    four = t.part.groupBy(F.floor(F.col("p_partkey") / 4).alias("k")).agg(*[F.max(F.when(F.col("p_partkey") % 4 == i, item)).alias(f"i{i}") for i in range(4)])

    def listed(*names: str) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *names), F.lit("]"))

    k, every = F.col("k"), ("i0", "i1", "i2", "i3")
    body = (
        F.when(k % 5 == 0, listed(*every)).when(k % 5 == 1, F.concat(F.lit('{"products":'), listed(*every), F.lit("}")))
        .when(k % 5 == 2, F.concat(F.lit('{"create":'), listed("i0", "i1"), F.lit(',"update":'), listed("i2", "i3"), F.lit("}")))
        .when(k % 5 == 3, F.col("i0")).otherwise("42")
    )
    rows = events.unwrap_bulk(four.select(k.cast("bigint").alias("k"), body.alias("payload")), "products")
    return rows.select("k", "item_index", F.get_json_object("payload", "$.name").alias("name"), "bulk_error")


@query("parse_customer_events", """
SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 3 THEN 'C' || c_custkey END AS pos_customer_number, CASE WHEN c_custkey % 4 <> 3 THEN c_name END AS last_name, CASE WHEN c_custkey % 2 = 0 THEN 'a@b.co' END AS email,
  CAST(CASE WHEN c_custkey % 4 = 3 THEN 0 WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS addresses, CASE WHEN c_custkey % 4 <> 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'NY|US' ELSE 'ON|CA' END END AS place,
  CASE WHEN c_custkey % 4 = 3 THEN 'invalid_customer_payload' WHEN c_custkey % 8 = 2 THEN 'invalid_boolean' END AS error FROM customer""")
def parse_customer_events(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    many = concat('{"Cust Num":"C', k, '","last_name":"', F.col("c_name"), '","INTERNET":"a@b.co","tax exempt":"', F.when(k % 8 == 2, "maybe").otherwise("no"), '","addresses":[{"Address 1":"x","State":"NY"},{"city":"y"},5]}')
    one = concat('{"id":"C', k, '","Last Name":"', F.col("c_name"), '","address":{"address":"x","province_code":"ON","country":"CA"}}')
    body = F.when(k % 2 == 0, many).when(k % 4 == 3, "[1]").otherwise(one)
    rows = events.parse_customer_events(t.customer.select(k.alias("k"), body.alias("payload")))
    first = F.try_element_at("addresses", F.lit(1))
    return rows.select(
        "k", "pos_customer_number", "last_name", "email", F.size("addresses").alias("addresses"), F.concat(first["province_code"], F.lit("|"), first["country_code"]).alias("place"), "error",
    )


@query("parse_order_events", """
SELECT o_orderkey AS k, 'O' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) ELSE '9.99' END AS total_price, CASE WHEN o_orderkey % 3 = 0 THEN 'c@d.co' ELSE 'e@f.co' END AS email,
  '555' AS phone, '4.50' AS shipping_price, CAST(o_orderkey % 3 AS INTEGER) AS lines, CASE WHEN o_orderkey % 5 <> 0 THEN 'Ann' END AS customer_first_name FROM orders""")
def parse_order_events(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    lines = F.array_join(F.slice(F.array(F.lit('{"id":1,"sku":"a","quantity":2,"secret":"x"}'), F.lit('{"id":2,"sku":"b"}')), F.lit(1), (k % 3).cast("int")), ",")
    body = concat(
        '{"id":"O', k, '","current_total_price":"', F.when(k % 2 == 0, p.money("o_totalprice").cast("string")).otherwise(""), '","total_price":"9.99","contact_email":"', F.when(k % 3 == 0, "c@d.co").otherwise(""),
        '","email":"e@f.co","customer":{"first_name":"', F.when(k % 5 != 0, "Ann").otherwise(""), '","phone":"555"},"total_shipping_price_set":{"shop_money":{"amount":"4.50"}},"browser_ip":"1.1.1.1","line_items":[', lines, "]}",
    )
    rows = events.parse_order_events(t.orders.select(k.alias("k"), body.alias("payload")))
    kept = ("id", "total_price", "email", "phone", "shipping_price", "customer_first_name")
    return rows.select("k", *[F.col(f"order.{c}").alias(c) for c in kept], F.size("order.line_items").alias("lines"))


@query("parse_inventory_events", """
SELECT event_id AS k, CASE WHEN event_id % 13 = 0 THEN 'missing_inventory_fields' WHEN user_id % 10 = 9 THEN 'shop_not_installed' WHEN event_id % 7 = 0 THEN 'different_location' WHEN user_id % 6 = 5 THEN 'inventory_item_has_no_sku' END AS reason,
  CASE WHEN event_id % 13 = 0 OR user_id % 10 = 9 OR event_id % 7 = 0 OR user_id % 6 = 5 THEN 'ignored' ELSE 'queued' END AS status,
  CASE WHEN user_id % 10 <> 9 AND user_id % 6 <> 5 THEN 'P' || user_id END AS sku, CAST(floor(value) AS INTEGER) AS quantity, epoch_us(date_trunc('second', ts)) AS source_at FROM events""")
def parse_inventory_events(t: Tables) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    body = concat('{"inventory_item_id":', u, ',"location_id":"', F.when(k % 13 == 0, "").when(k % 7 == 0, "77").otherwise("1"), '","available":', F.floor("value"), ',"updated_at":"', p.iso(F.col("ts")), '"}')
    shop = F.concat(F.lit("s"), (u % 10).cast("string"))
    rows = t.events.select(k.alias("k"), shop.alias("shop"), body.alias("payload"))
    shops = rows.select("shop").distinct().where("shop <> 's9'")
    users = t.events.select("user_id", shop.alias("shop")).distinct().where("user_id % 6 <> 5 AND shop <> 's9'")
    items = users.select("shop", concat(f"gid://{AUTHORITY}/InventoryItem/", u).alias("inventory_item_id"), p.code("P", "user_id").alias("sku"))
    out = events.parse_inventory_events(rows, shops, items, "1", AUTHORITY)
    return out.select("k", "reason", "status", "sku", "quantity", F.unix_micros("source_updated_at").alias("source_at"))


def product_pages(t: Tables) -> DataFrame:
    """Three parts per product page; every seventh page has no variants."""
    k = F.col("p_partkey")
    variant = F.struct(
        p.code("v", "p_partkey").alias("id"), F.concat(F.lit(" P"), k.cast("string")).alias("sku"), F.lit("b").alias("barcode"), p.money("p_retailprice").cast("string").alias("price"),
        F.struct(
            p.code("i", "p_partkey").alias("id"), F.struct(F.when(k % 2 == 0, "1.5").otherwise("").alias("amount")).alias("unitCost"),
            F.struct(F.array(
                F.struct(F.struct(F.lit("L1").alias("id"), F.lit("Main").alias("name")).alias("location"), F.lit("t").alias("updatedAt"), F.array().cast("array<struct<name:string,quantity:int>>").alias("quantities")),
                F.struct(F.struct(F.lit("L2").alias("id"), F.lit("Back").alias("name")).alias("location"), F.lit("t").alias("updatedAt"), F.array(F.struct(F.lit("available").alias("name"), F.col("p_size").alias("quantity"))).alias("quantities")),
            ).alias("nodes")).alias("inventoryLevels"),
        ).alias("inventoryItem"),
    )
    page = F.floor(k / 3).cast("bigint")
    rows = t.part.select(page.alias("page"), (k % 3).alias("slot"), variant.alias("v"))
    three = rows.groupBy("page").agg(*[F.max(F.when(F.col("slot") == i, F.col("v"))).alias(f"v{i}") for i in range(3)])
    nodes = F.when(F.col("page") % 7 != 0, F.array_compact(F.array("v0", "v1", "v2")))
    body = F.to_json(F.struct(
        F.concat(F.lit("p"), F.col("page").cast("string")).alias("id"), F.when(F.col("page") % 3 != 0, "Title").otherwise("").alias("title"), F.lit("ACTIVE").alias("status"),
        F.struct(F.when(F.col("page") % 2 == 0, " True").alias("value")).alias("autoArchivedZeroStock"), F.struct(F.lit("m ").alias("value")).alias("metafield"),
        F.struct(F.array(F.struct(F.struct(F.lit("").alias("url")).alias("image")), F.struct(F.struct(F.lit("http://img").alias("url")).alias("image"))).alias("nodes")).alias("media"),
        F.struct(F.struct((F.col("page") % 5 == 0).alias("hasNextPage")).alias("pageInfo"), nodes.alias("nodes")).alias("variants"),
    ))
    return three.select(F.from_json(body, storefront.PRODUCT).alias("b")).select("b.*")


@query("flatten_catalog", """
WITH v AS (SELECT p_partkey AS k, p_partkey // 3 AS page, p_size, p_retailprice FROM part)
SELECT 'p' || page AS product_id, 'v' || k AS variant_id, CASE WHEN page % 3 <> 0 THEN 'Title' ELSE 'Untitled product' END AS title, ' P' || k AS sku, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CASE WHEN k % 2 = 0 THEN CAST(1.5 AS DOUBLE) END AS cost,
  p_size AS quantity, 'http://img' AS image_url, 'm' AS marker, page % 2 = 0 AS marked, page % 5 = 0 AS truncated FROM v WHERE page % 7 <> 0
UNION ALL SELECT DISTINCT 'p' || page, NULL, CASE WHEN page % 3 <> 0 THEN 'Title' ELSE 'Untitled product' END, NULL, NULL::DOUBLE, NULL::DOUBLE, NULL, 'http://img', 'm', page % 2 = 0, page % 5 = 0 FROM v WHERE page % 7 = 0""")
def flatten_catalog(t: Tables) -> DataFrame:
    rows = storefront.flatten_catalog(product_pages(t))
    return rows.select("product_id", "variant_id", "title", "sku", "price", "cost", "quantity", "image_url", "marker", "marked", "truncated")


@query("catalog_records", """
SELECT 'p' || (p_partkey // 3) AS product_id, arg_min('v' || p_partkey, p_partkey) AS variant_id FROM part WHERE (p_partkey // 3) % 7 <> 0 GROUP BY 1
UNION ALL SELECT DISTINCT 'p' || (p_partkey // 3), NULL FROM part WHERE (p_partkey // 3) % 7 = 0""")
def catalog_records(t: Tables) -> DataFrame:
    return storefront.catalog_record(product_pages(t), F.lit("none")).select("product_id", "variant_id")


@query("variant_inventory_rows", f"""
SELECT 'p' || (p_partkey // 3) AS product_id, 'P' || p_partkey AS sku, 'gid://{AUTHORITY}/InventoryItem/i' || p_partkey AS inventory_item_id, 'gid://{AUTHORITY}/Location/L2' AS location_id, p_size AS quantity FROM part WHERE (p_partkey // 3) % 7 <> 0""")
def variant_inventory_rows(t: Tables) -> DataFrame:
    return storefront.variant_inventory_rows(product_pages(t), "L2", AUTHORITY).drop("inventory_level_updated_at")


@query("flatten_inventory_snapshot", f"""
SELECT 'P' || p_partkey AS sku, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS quantity, 'i' || p_partkey AS inventory_item_id, 'gid://{AUTHORITY}/Location/L1' AS location_id, p_partkey % 4 <> 0 AS available_at_location, CAST(p_partkey % 2 AS INTEGER) AS duplicate_sku_count FROM part WHERE p_partkey % 9 <> 0""")
def flatten_inventory_snapshot(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    level = concat(',"inventoryLevel":{"updatedAt":"t","quantities":[{"name":"committed","quantity":99},{"name":"available","quantity":', F.col("p_size"), "}]}")
    body = concat('{"id":"i', k, '","sku":"', F.when(k % 9 == 0, "  ").otherwise(p.code("P", "p_partkey")), '","duplicateSkuCount":', k % 2, F.when(k % 4 != 0, level).otherwise(""), "}")
    items = t.part.select(F.from_json(body, storefront.INVENTORY_ITEM).alias("b")).select("b.*")
    return storefront.flatten_inventory_snapshot(items, "L1", AUTHORITY).drop("inventory_level_updated_at")


@query("level_states", "SELECT 'i' || p_partkey AS item_id, l AS location_id, CASE WHEN l = 'L1' THEN 'available' END AS state, CASE WHEN l = 'L1' THEN p_size END AS quantity FROM part, (VALUES ('L1'), ('L2')) x(l)")
def level_states(t: Tables) -> DataFrame:
    body = concat('{"id":"i', F.col("p_partkey"), '","inventoryLevels":{"nodes":[{"location":{"id":"L1"},"quantities":[{"name":"available","quantity":', F.col("p_size"), '}]},{"location":{"id":"L2"},"quantities":[]}]}}')
    shape = "id string, inventoryLevels struct<nodes:array<struct<location:struct<id:string>,quantities:array<struct<name:string,quantity:int>>>>>"
    return storefront.level_states(t.part.select(F.from_json(body, shape).alias("b")).select("b.*"))


@query("parse_variant_mapping", """
SELECT 'P' || p_partkey AS sku, 'p' || (p_partkey // 3) AS product_id, p_partkey % 2 = 0 AS marked, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS current_price, CASE WHEN p_partkey % 3 = 0 THEN CAST(2.5 AS DOUBLE) END AS current_cost, CAST(1 AS INTEGER) AS levels, p_size AS quantity FROM part""")
def parse_variant_mapping(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    body = concat(
        '{"id":"v', k, '","sku":"P', k, '","price":"', p.money("p_retailprice"), '","product":{"id":"p', F.floor(k / 3), '","status":"ACTIVE","autoArchivedZeroStock":{"value":"', F.when(k % 2 == 0, " TRUE ").otherwise("no"),
        '"}},"inventoryItem":{"id":"i","unitCost":{"amount":"', F.when(k % 3 == 0, "2.5").otherwise(""), '"},"inventoryLevels":{"nodes":[{"location":{"id":"L","name":"N"},"quantities":[{"name":"available","quantity":', F.col("p_size"), "}]}]}}}",
    )
    rows = storefront.parse_variant_mapping(t.part.select(F.from_json(body, storefront.VARIANT).alias("b")).select("b.*"))
    return rows.select("sku", "product_id", "marked", "current_price", "current_cost", F.size("levels").alias("levels"), F.col("levels")[0]["quantity"].alias("quantity"))


NAMES = ("Item", "mcust2", "VENDX", "ordhdr", "invoice_no_x", "x_invoice_no", "emptime", "brideDat", "zzz", "Contacts")


@query("classify_tables", """
WITH n AS (SELECT p_partkey AS k, ['item', 'mcust2', 'vendx', 'ordhdr', 'invoice_no_x', 'x_invoice_no', 'emptime', 'bridedat', 'zzz', 'contacts'][CAST(p_partkey % 10 + 1 AS INTEGER)] AS n, p_size % 4 AS f FROM part)
SELECT k, CASE WHEN n = 'item' OR f = 1 THEN 'products_inventory' WHEN n IN ('mcust2', 'contacts') OR f = 2 THEN 'customers' WHEN n = 'vendx' OR f = 3 THEN 'vendors' WHEN n IN ('ordhdr', 'invoice_no_x') THEN 'sales_orders' WHEN n = 'emptime' THEN 'operations' WHEN n = 'bridedat' THEN 'special_programs' ELSE 'system_other' END AS category,
  CASE WHEN n = 'item' OR f = 1 THEN 'products_inventory' WHEN n IN ('mcust2', 'contacts') OR f = 2 THEN 'customers' WHEN n = 'vendx' OR f = 3 THEN 'vendors' WHEN n IN ('ordhdr', 'invoice_no_x', 'x_invoice_no') THEN 'sales_orders' WHEN n = 'emptime' THEN 'operations' WHEN n = 'bridedat' THEN 'special_programs' ELSE 'system_other' END AS archive_category,
  CASE f WHEN 0 THEN 'INTERNET;Cell_2;ADDR1' WHEN 2 THEN '' ELSE '' END AS sensitive FROM n""")
def classify_tables(t: Tables) -> DataFrame:
    def names(*values: str) -> Column:
        return F.array(*[F.lit(v) for v in values])

    fields = (
        F.when(F.col("p_size") % 4 == 0, names("INTERNET", "NOTE", "Cell_2", "ADDR1")).when(F.col("p_size") % 4 == 1, names("sku", "QTY", "Price"))
        .when(F.col("p_size") % 4 == 2, names("CUST_NUM", "LAST_NAME")).otherwise(names("VENDOR_ID", "COMPANY", "X"))
    )
    name = F.element_at(names(*NAMES), (F.col("p_partkey") % 10 + 1).cast("int"))
    return t.part.select(
        F.col("p_partkey").alias("k"), profile.classify_table(name, fields).alias("category"), profile.classify_table(name, fields, archive=True).alias("archive_category"),
        F.concat_ws(";", profile.sensitive_columns(fields)).alias("sensitive"),
    )


@query("write_payloads", "SELECT 'P' || p_partkey AS sku, p_name AS title, 'x;' || p_type AS tags FROM part")
def write_payloads(t: Tables) -> DataFrame:
    """Payloads written as JSON lines and read back."""
    from tillbridge.session import scratch_path

    rows = t.part.select(p.code("P", "p_partkey").alias("sku"), F.col("p_name").alias("title"), F.array(F.lit("x"), F.col("p_type")).alias("tags"))
    path = scratch_path(t.spark, "payloads")
    reports.write_payloads(rows, path)
    back = t.spark.read.schema("sku string, title string, tags array<string>").json(path)
    return reports.joined_lists(back, "tags")


@query("total_quantities", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) WHEN p_partkey % 3 = 1 THEN p_size * 2 END AS total FROM part")
def total_quantities(t: Tables) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    variants = F.array(*[F.struct(F.when(k % 3 == 1, z).alias("quantity")) for _ in range(2)])
    return t.part.select("p_partkey", payloads.total_quantity(F.when(k % 3 == 0, z), variants).alias("total"))
