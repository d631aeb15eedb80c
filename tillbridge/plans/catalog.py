"""Catalog build over parts, suppliers and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.functions.money import decimal_or_none
from tillbridge.operators import catalog, payloads, reports
from tillbridge.operators.catalog import BuildOptions, FilterOptions
from tillbridge.plans import proxies as p
from tillbridge.plans.registry import Tables, query

ARRIVAL_DESC = "l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC"


@query("dedupe_items", f"""
WITH {p.ITEM_ROWS_SQL},
q AS (
  SELECT *, row_number() OVER (PARTITION BY sku ORDER BY (price > 0) DESC, last_act DESC, (qty > 0) DESC,
    (CASE WHEN descr IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN grp IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN vendor IS NOT NULL THEN 1 ELSE 0 END) DESC, {ARRIVAL_DESC}) AS r,
    count(*) OVER (PARTITION BY sku) AS copies FROM item_rows)
SELECT sku, price, qty, last_act, vendor, CASE WHEN trim(sku) = '' THEN 1 ELSE copies END AS copies, trim(sku) = '' AS without_sku FROM q WHERE r = 1 OR trim(sku) = ''""")
def dedupe_items(t: Tables) -> DataFrame:
    rows = catalog.dedupe_items(p.item_rows(t), p.LINE_ARRIVAL)
    return rows.select(
        F.col("SKU").alias("sku"), F.col("PRICE").alias("price"), F.col("QTY").alias("qty"), F.col("LAST_ACT").alias("last_act"),
        F.col("VENDOR").alias("vendor"), "copies", "without_sku",
    )


@query("vendor_lookup", f"WITH {p.VENDORS_SQL} SELECT * FROM vendors")
def vendor_lookup(t: Tables) -> DataFrame:
    return catalog.vendor_lookup(p.vendor_rows(t))


@query("price_change_lookup", f"WITH {p.CHANGES_SQL} SELECT * FROM pc")
def price_change_lookup(t: Tables) -> DataFrame:
    rows = catalog.price_change_lookup(p.price_change_rows(t), p.LINE_ARRIVAL)
    return rows.select(F.col("SKU").alias("sku"), F.col("PRICE").alias("price"), F.col("VENDOR").alias("vendor"))


@query("vendor_item_lookup", f"WITH {p.CHANGES_SQL} SELECT * FROM vi")
def vendor_item_lookup(t: Tables) -> DataFrame:
    rows = catalog.vendor_item_lookup(p.vendor_item_rows(t), p.LINE_ARRIVAL)
    return rows.select(F.col("SKU").alias("sku"), F.col("VENDOR").alias("vendor"), F.col("VEND_SKU").alias("vend_sku"), F.col("BASE_COST").alias("base_cost"))


@query("quantity_lookup", f"""
WITH {p.CELLS_SQL}
SELECT sku, CAST(sum(qty) AS BIGINT) AS quantity FROM cells GROUP BY 1""")
def quantity_lookup(t: Tables) -> DataFrame:
    rows = catalog.quantity_lookup(p.cell_rows(t))
    return rows.select(F.col("SKU").alias("sku"), F.col("cell_quantity").cast("bigint").alias("quantity"))


@query("quantity_lookup_one_cell", f"""
WITH {p.CELLS_SQL}
SELECT sku, CAST(sum(qty) AS BIGINT) AS quantity FROM cells WHERE cell = '2 1' GROUP BY 1""")
def quantity_lookup_one_cell(t: Tables) -> DataFrame:
    rows = catalog.quantity_lookup(p.cell_rows(t), "best", " 2  1 ")
    return rows.select(F.col("SKU").alias("sku"), F.col("cell_quantity").cast("bigint").alias("quantity"))


@query("select_quantity", f"""
WITH {p.CELLS_SQL}, s AS (SELECT sku, sum(qty) AS q FROM cells WHERE cell = '2 1' GROUP BY 1)
SELECT p_partkey, CAST(greatest(0, coalesce(q, p_size - 10)) AS INTEGER) AS by_cells, CAST(greatest(0, greatest(q, p_size - 10)) AS INTEGER) AS best,
  CAST(greatest(0, p_size - 10) AS INTEGER) AS by_item
FROM part LEFT JOIN s ON s.sku = 'P' || p_partkey""")
def select_quantity(t: Tables) -> DataFrame:
    cells = catalog.quantity_lookup(p.cell_rows(t), "best", "2 1")
    rows = t.part.join(cells, p.code("P", "p_partkey") == F.col("SKU"), "left")
    item = (F.col("p_size") - 10).cast("decimal(38,10)")
    return rows.select("p_partkey", *[
        catalog.select_quantity(item, F.col("cell_quantity"), source).alias(name)
        for source, name in (("itemmqty", "by_cells"), ("best", "best"), ("item", "by_item"))
    ])


@query("compare_at_price", f"""
WITH {p.ITEMS_SQL}, {p.CHANGES_SQL}
SELECT i.sku, i.price, CASE WHEN i.price > 0 THEN greatest(CASE WHEN price_r > i.price AND price_r <= i.price * 3 THEN price_r END, CASE WHEN c.price > i.price AND c.price <= i.price * 3 THEN c.price END) END AS compare_at
FROM items i LEFT JOIN pc c ON i.sku = c.sku WHERE i.sku IS NOT NULL""")
def compare_at_price(t: Tables) -> DataFrame:
    changes = catalog.price_change_lookup(p.price_change_rows(t), p.LINE_ARRIVAL).select("SKU", F.col("PRICE").alias("change_price"))
    rows = p.items(t).where("SKU IS NOT NULL").join(changes, "SKU", "left")
    tier = catalog.choose_compare_at(F.col("PRICE"), F.col("PRICE_R"), F.col("change_price"))
    return rows.select(F.col("SKU").alias("sku"), F.col("PRICE").alias("price"), tier.alias("compare_at"))


@query("non_sellable", """
WITH d AS (
  SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'giftct ' WHEN p_partkey % 9 = 1 THEN 'CS' ELSE p_type END AS grp,
    CASE WHEN p_partkey % 101 = 0 THEN ' shipping' ELSE 'P' || p_partkey END AS sku,
    p_name || CASE p_partkey % 10 WHEN 0 THEN ' Alterations' WHEN 1 THEN ' alteration fee' WHEN 2 THEN ' gift   card' WHEN 3 THEN ' Reward' WHEN 4 THEN ' rentals' WHEN 5 THEN ' special order' WHEN 6 THEN ' accident damage' ELSE '' END AS descr FROM part)
SELECT p_partkey, CASE WHEN upper(trim(grp)) IN ('GIFTCT', 'CS') THEN 'group:' || upper(trim(grp)) WHEN upper(trim(sku)) = 'SHIPPING' THEN 'sku:SHIPPING'
  WHEN regexp_matches(descr, '(?i)\\bACCIDENT DAMAGE\\b') THEN 'desc:\\bACCIDENT DAMAGE\\b' WHEN regexp_matches(descr, '(?i)\\bALTERATIONS?\\b') THEN 'desc:\\bALTERATIONS?\\b'
  WHEN regexp_matches(descr, '(?i)\\bGIFT +CARD\\b') THEN 'desc:\\bGIFT CARD\\b' WHEN regexp_matches(descr, '(?i)\\bREWARDS?\\b') THEN 'desc:\\bREWARDS?\\b'
  WHEN regexp_matches(descr, '(?i)\\bRENTAL\\b') THEN 'desc:\\bRENTAL\\b' WHEN regexp_matches(descr, '(?i)\\bSPECIAL ORDER\\b') THEN 'desc:\\bSPECIAL ORDER\\b' END AS reason
FROM d""")
def non_sellable(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    endings = (" Alterations", " alteration fee", " gift   card", " Reward", " rentals", " special order", " accident damage")
    ending = F.when(F.lit(False), "")
    for i, text in enumerate(endings):
        ending = ending.when(k % 10 == i, text)
    group = F.when(k % 9 == 0, "giftct ").when(k % 9 == 1, "CS").otherwise(F.col("p_type"))
    sku = F.when(k % 101 == 0, " shipping").otherwise(p.code("P", "p_partkey"))
    reason = catalog.non_sellable_reason(group, sku, F.concat("p_name", ending.otherwise("")))
    return t.part.select("p_partkey", reason.alias("reason"))


# every lookup joined onto the items, as plain columns
BUILD_SQL = f"""
{p.ITEMS_SQL}, {p.VENDORS_SQL}, {p.CHANGES_SQL}, {p.CELLS_SQL},
qty AS (SELECT sku, sum(qty) AS cell_quantity FROM cells WHERE cell = '2 1' GROUP BY 1),
joined AS MATERIALIZED (
  SELECT i.*, coalesce(i.vendor, c.vendor, v.vendor) AS code, c.vendor AS change_code, c.price AS change_price, v.vend_sku, v.base_cost, cell_quantity,
    i.sku IS NULL OR descr IS NULL AS missing
  FROM items i LEFT JOIN pc c ON i.sku = c.sku LEFT JOIN vi v ON i.sku = v.sku LEFT JOIN qty q ON i.sku = q.sku),
named AS MATERIALIZED (
  SELECT j.*, coalesce(a.company, pfield2, b.company, code) AS company, coalesce(j.price, change_price) AS final_price,
    coalesce(cost, base_cost) AS final_cost, greatest(0, greatest(qty, cell_quantity)) AS stock,
    CASE grp WHEN 'MS' THEN 'SUIT' WHEN 'SHO' THEN 'SHOES' ELSE grp END AS kind
  FROM joined j LEFT JOIN vendors a ON j.code = a.vendor_id LEFT JOIN vendors b ON j.change_code = b.vendor_id),
built AS MATERIALIZED (
  SELECT *, CASE WHEN grp = 'RENTAL' THEN 'group:RENTAL' END AS non_sellable,
    CASE WHEN final_price > 0 THEN greatest(CASE WHEN price_r > final_price AND price_r <= final_price * 3 THEN price_r END) END AS compare_at FROM named)
"""


def lookups(t: Tables) -> dict[str, DataFrame]:
    return {
        "vendors": catalog.vendor_lookup(p.vendor_rows(t)),
        "vendor_items": catalog.vendor_item_lookup(p.vendor_item_rows(t), p.LINE_ARRIVAL),
        "price_changes": catalog.price_change_lookup(p.price_change_rows(t), p.LINE_ARRIVAL),
        "quantities": catalog.quantity_lookup(p.cell_rows(t), "best", "2 1"),
    }


def products(t: Tables, options: BuildOptions = BuildOptions(), **more) -> DataFrame:
    items = catalog.dedupe_items(p.items(t))
    return catalog.build_products(items, **lookups(t), options=options, **more)


@query("build_products", f"""
WITH {BUILD_SQL}
SELECT sku, descr AS raw_desc, code AS vendor_code, 'V' || replace(company, ' ', '') AS vendor_flat, grp AS department, size, color, vend_sku AS vendor_item,
  alt_sku AS barcode, CAST(final_price AS DECIMAL(18,2)) AS price, CAST(compare_at AS DECIMAL(18,2)) AS compare_at_price,
  CAST(final_cost AS DECIMAL(18,2)) AS cost, CAST(stock AS INTEGER) AS quantity, non_sellable, missing
FROM built""")
def build_products(t: Tables) -> DataFrame:
    rows = products(t)
    kept = ("raw_desc", "vendor_code", "department", "size", "color", "vendor_item", "barcode", "price", "compare_at_price", "cost", "quantity", "non_sellable", "missing")
    return rows.select("sku", F.concat(F.lit("V"), F.regexp_replace("vendor", " ", "")).alias("vendor_flat"), *kept)


TITLE_SQL = f"""
{BUILD_SQL},
words AS (
  SELECT sku, size, array_to_string(list_transform(string_split(kind, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS kind_title,
    array_to_string(list_transform(string_split(descr, ' '), lambda w: CASE WHEN length(w) <= 2 THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS name_title,
    company AS vendor_title, CASE color WHEN 'BLK' THEN 'Black' WHEN 'navy' THEN 'Navy' END AS shade
  FROM built WHERE NOT missing),
led AS (
  SELECT *, CASE WHEN contains(lower(regexp_replace(name_title, '[^A-Za-z0-9]', '', 'g')), lower(regexp_replace(vendor_title, '[^A-Za-z0-9]', '', 'g'))) THEN name_title ELSE vendor_title || ' ' || name_title END AS lead FROM words),
flat AS (SELECT *, lower(regexp_replace(lead, '[^A-Za-z0-9]', '', 'g')) AS plain FROM led),
titled AS (SELECT sku, kind_title, vendor_title, concat_ws(' - ', lead, nullif(concat_ws(' / ', CASE WHEN NOT contains(plain, lower(shade)) THEN shade END, CASE WHEN NOT contains(plain, size) THEN size END), '')) AS title FROM flat),
whole AS (SELECT b.*, title, kind_title, vendor_title FROM built b JOIN titled t ON b.sku = t.sku WHERE NOT missing)
"""


@query("product_titles", f"WITH {TITLE_SQL} SELECT sku, kind_title AS product_type, title FROM whole")
def product_titles(t: Tables) -> DataFrame:
    return products(t).where("NOT missing").select("sku", "product_type", "title")


@query("archive_products", f"""
WITH {BUILD_SQL}
SELECT i.sku, i.price, CAST(CASE WHEN i.price > 0 AND price_r > i.price AND price_r <= i.price * 3 THEN price_r END AS DECIMAL(18,2)) AS compare_at_price,
  CAST(coalesce(cost, base_cost) AS DECIMAL(18,2)) AS cost, CAST(coalesce(greatest(0, greatest(qty, cell_quantity)), 0) AS INTEGER) AS quantity,
  coalesce(i.vendor, v.vendor) AS vendor_code
FROM items i LEFT JOIN vi v ON i.sku = v.sku LEFT JOIN qty q ON i.sku = q.sku""")
def archive_products(t: Tables) -> DataFrame:
    return products(t, BuildOptions(profile="archive")).select("sku", "price", "compare_at_price", "cost", "quantity", "vendor_code")


@query("vendor_names", f"""
WITH {BUILD_SQL}
SELECT company, count(*) AS products FROM named WHERE sku IS NOT NULL GROUP BY 1""")
def vendor_names(t: Tables) -> DataFrame:
    parts = lookups(t)
    rows = p.items(t).where("SKU IS NOT NULL").select("SKU", "VENDOR", "PFIELD2")
    rows = rows.join(parts["price_changes"].select("SKU", F.col("VENDOR").alias("change_code")), "SKU", "left")
    rows = rows.join(parts["vendor_items"].select("SKU", F.col("VENDOR").alias("first_code")), "SKU", "left")
    rows = rows.withColumn("code", F.coalesce("VENDOR", "change_code", "first_code"))
    names = parts["vendors"]
    rows = rows.join(names.select(F.col("vendor_id").alias("code"), F.col("company").alias("a")), "code", "left")
    rows = rows.join(names.select(F.col("vendor_id").alias("change_code"), F.col("company").alias("b")), "change_code", "left")
    company = catalog.resolve_vendor_name(F.col("a"), F.col("PFIELD2"), F.col("b"), F.col("code"))
    return rows.groupBy(company.alias("company")).agg(F.count(F.lit(1)).alias("products"))


SKIP_SQL = BUILD_SQL + """,
judged AS (
  SELECT *, CASE WHEN non_sellable IS NOT NULL THEN 'non_sellable' WHEN missing THEN 'missing_payload' WHEN coalesce(final_price, 0) <= 0 THEN 'zero_price' WHEN coalesce(stock, 0) <= 0 THEN 'zero_quantity' END AS reason FROM built)
"""
ALL_FILTERS = FilterOptions(skip_zero_quantity=True)


@query("filter_reasons", f"WITH {SKIP_SQL} SELECT coalesce(reason, 'kept') AS outcome, count(*) AS products FROM judged GROUP BY 1")
def filter_reasons(t: Tables) -> DataFrame:
    return reports.run_summary(products(t), options=ALL_FILTERS)


@query("filter_products", f"WITH {SKIP_SQL} SELECT sku FROM judged WHERE reason IS NULL ORDER BY rec_no LIMIT 100")
def filter_products(t: Tables) -> DataFrame:
    return catalog.filter_products(products(t), ALL_FILTERS, limit=100).select("sku")


@query("page_products", f"WITH {SKIP_SQL} SELECT sku FROM judged WHERE reason IS NULL ORDER BY rec_no LIMIT 250 OFFSET 40")
def page_products(t: Tables) -> DataFrame:
    kept = catalog.filter_products(products(t), ALL_FILTERS)
    return catalog.page_products(kept, ("without_sku", "first_seen"), limit=900, offset=40).select("sku")


@query("source_skus", f"WITH {p.ITEM_ROWS_SQL} SELECT DISTINCT sku FROM item_rows WHERE trim(sku) <> ''")
def source_skus(t: Tables) -> DataFrame:
    return catalog.source_skus(p.item_rows(t))


@query("build_tags", f"""
WITH {BUILD_SQL}
SELECT sku, array_to_string(list_filter([
  'Department:' || grp, 'Product Type:' || kind, 'Size:' || size, 'Color:' || color, 'Vendor Code:' || code, 'Vendor Item:' || vend_sku, 'PField2:' || pfield2], lambda x: x IS NOT NULL), ';') AS tags
FROM built WHERE NOT missing""")
def build_tags(t: Tables) -> DataFrame:
    return reports.joined_lists(products(t).where("NOT missing").select("sku", "tags"), "tags")


@query("build_images", f"""
WITH {p.ITEMS_SQL}
SELECT rec_no, CASE WHEN image LIKE 'http%' AND image <> image2 THEN image || ';' || image2 ELSE image2 END AS images FROM items""")
def build_images(t: Tables) -> DataFrame:
    rows = p.items(t).select(F.col("_rec_no").alias("rec_no"), payloads.build_images(F.col("IMAGE"), F.col("IMAGE2")).alias("images"))
    return reports.joined_lists(rows, "images")


@query("media_inputs", f"""
WITH {p.ITEMS_SQL}
SELECT rec_no, CASE WHEN image <> image2 THEN 2 ELSE 1 END AS media,
  regexp_extract(image, '[^/]*$') || '|' || coalesce(descr, sku, 'Product image') AS first_media FROM items""")
def media_inputs(t: Tables) -> DataFrame:
    media = payloads.media_inputs(F.array("IMAGE", "IMAGE2"), F.col("DESC"), F.col("SKU"))
    rows = p.items(t).select(F.col("_rec_no").alias("rec_no"), media.alias("m"))
    return rows.select("rec_no", F.size("m").alias("media"), F.concat_ws("|", F.col("m")[0]["filename"], F.col("m")[0]["alt"]).alias("first_media"))


# what a product says of itself: key, value in terms of ``whole``, type
METAFIELD_SQL = (
    ("sku", "sku", "single_line_text_field"), ("raw_description", "descr", "multi_line_text_field"), ("generated_title", "title", "single_line_text_field"),
    ("vendor_name", "vendor_title", "single_line_text_field"), ("vendor_code", "code", "single_line_text_field"), ("vendor_item", "vend_sku", "single_line_text_field"),
    ("department_code", "grp", "single_line_text_field"), ("product_type", "kind_title", "single_line_text_field"), ("size", "size", "single_line_text_field"), ("color", "color", "single_line_text_field"),
    ("barcode", "alt_sku", "single_line_text_field"), ("pos_type", "item_type", "single_line_text_field"), ("price", "CAST(final_price AS DECIMAL(18,2))", "number_decimal"),
    ("compare_at_price", "CAST(compare_at AS DECIMAL(18,2))", "number_decimal"), ("cost", "cost", "number_decimal"), ("selected_quantity", "CAST(stock AS BIGINT)", "number_integer"),
    ("item_quantity", "greatest(0, qty)", "number_integer"), ("itemmqty_quantity", "CASE WHEN cell_quantity IS NOT NULL THEN CAST(greatest(0, cell_quantity) AS BIGINT) END", "number_integer"),
    ("item_data", """'{' || concat_ws(',', '"ALT_SKU":"' || alt_sku || '"', '"COLOR":"' || color || '"', '"COST":"' || nullif(cost, 0) || '"', '"DESC":"' || descr || '"', '"GROUP":"' || grp || '"',
      '"IMAGE":"' || image || '"', '"IMAGE2":"' || image2 || '"', '"PFIELD2":"' || pfield2 || '"', '"PRICE":"' || nullif(price, 0) || '"', '"PRICE_R":"' || nullif(price_r, 0) || '"', '"QTY":"' || nullif(qty, 0) || '"',
      '"SIZE":"' || size || '"', '"SKU":"' || sku || '"', '"TYPE":"' || item_type || '"', '"VENDOR":"' || vendor || '"') || '}'""", "json"),
    ("price_change_data", """CASE WHEN change_code IS NOT NULL THEN '{' || concat_ws(',', '"PRICE":"' || nullif(change_price, 0) || '"', '"SKU":"' || sku || '"', '"VENDOR":"' || change_code || '"') || '}' END""", "json"),
    ("vendor_item_data", """'{"BASE_COST":"' || base_cost || '","SKU":"' || sku || '","VENDOR":"' || (SELECT vendor FROM vi WHERE vi.sku = whole.sku) || '","VEND_SKU":"' || vend_sku || '"}'""", "json"),
)


@query("item_metafields", f"WITH {TITLE_SQL}, entries AS (" + " UNION ALL ".join(
    f"SELECT sku, '{key}' AS key, CAST({value} AS VARCHAR) AS value, '{kind}' AS type FROM whole" for key, value, kind in METAFIELD_SQL) + ") SELECT * FROM entries WHERE value IS NOT NULL AND value <> ''")
def item_metafields(t: Tables) -> DataFrame:
    rows = products(t, BuildOptions(metafields=True)).where("NOT missing").select("sku", F.explode("metafields").alias("m"))
    return rows.select("sku", "m.key", "m.value", "m.type")


DETAIL_SQL = (
    ("SKU", "sku"), ("Vendor", "vendor_title"), ("Vendor Code", "code"), ("Vendor Item", "vend_sku"), ("Product Type", "kind_title"), ("Department", "grp"), ("Size", "size"), ("Color", "color"),
    ("Barcode", "alt_sku"), ("Price", "CAST(final_price AS DECIMAL(18,2))"), ("Compare At Price", "CAST(compare_at AS DECIMAL(18,2))"), ("Quantity", "CAST(stock AS BIGINT)"), ("Cost", "cost"), ("Base Cost", "base_cost"),
)


@query("description_html", f"WITH {TITLE_SQL} SELECT sku, '<p>' || title || '</p>' || CASE WHEN lower(regexp_replace(descr, '[^A-Za-z0-9]', '', 'g')) <> lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')) THEN '<p>POS name: ' || descr || '</p>' ELSE '' END || '<ul>' || concat_ws('', "
       + ", ".join(f"'<li><strong>{label}:</strong> ' || CASE WHEN CAST({value} AS VARCHAR) NOT IN ('', '0', '0.00') THEN CAST({value} AS VARCHAR) END || '</li>'" for label, value in DETAIL_SQL) + ") || '</ul>' AS html FROM whole")
def description_html(t: Tables) -> DataFrame:
    return products(t, BuildOptions(html=True)).where("NOT missing").select("sku", F.col("description_html").alias("html"))


@query("title_audit", f"""
WITH {BUILD_SQL}
SELECT sku, descr AS raw_desc, coalesce(code, '') AS vendor_code, coalesce(size, '') AS size, coalesce(color, '') AS color, coalesce(alt_sku, '') AS barcode,
  CAST(1 + CASE WHEN kind IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN size IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN color IS NOT NULL THEN 1 ELSE 0 END
    + CASE WHEN code IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN vend_sku IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS tag_count, CAST(0 AS INTEGER) AS metafield_count, CAST(0 AS INTEGER) AS variant_count
FROM built WHERE NOT missing""")
def title_audit(t: Tables) -> DataFrame:
    audit = reports.title_audit(products(t).where("NOT missing"))
    return audit.select("sku", "raw_desc", "vendor_code", "size", "color", "barcode", "tag_count", "metafield_count", "variant_count")


@query("metafield_dedup", """
WITH m AS (
  SELECT user_id AS owner, event_id AS pos, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'pos' ELSE ' ' || event_type END AS namespace,
    CASE event_id % 4 WHEN 0 THEN 'auto_archived_zero_stock' WHEN 1 THEN ' ' ELSE event_type END AS key, CASE WHEN event_id % 6 <> 0 THEN CAST(event_id AS VARCHAR) END AS value FROM events),
c AS (SELECT owner, pos, trim(coalesce(namespace, 'custom')) AS namespace, trim(key) AS key, value FROM m)
SELECT owner, namespace, key, arg_max(value, pos) AS value FROM c WHERE key <> '' AND value IS NOT NULL AND NOT (namespace = 'pos' AND key = 'auto_archived_zero_stock') GROUP BY 1, 2, 3""")
def metafield_dedup(t: Tables) -> DataFrame:
    k = F.col("event_id")
    rows = t.events.select(
        F.col("user_id").alias("owner"), k.alias("pos"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, "pos").otherwise(F.concat(F.lit(" "), "event_type")).alias("namespace"),
        F.when(k % 4 == 0, "auto_archived_zero_stock").when(k % 4 == 1, " ").otherwise(F.col("event_type")).alias("key"),
        F.when(k % 6 != 0, k.cast("string")).alias("value"), F.lit(None).cast("string").alias("type"),
    )
    return payloads.dedupe_metafields(rows, ["owner"], ["pos"]).drop("type")


@query("negative_money", """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'price' WHEN p_partkey % 11 = 0 THEN 'cost' WHEN p_size % 5 = 0 THEN 'variants[1].compare_at_price' WHEN p_size % 3 = 0 THEN 'variants[2].price' END AS field FROM part""")
def negative_money(t: Tables) -> DataFrame:
    k, z, price = F.col("p_partkey"), F.col("p_size"), p.money("p_retailprice")
    rows = t.part.select("p_partkey", F.when(k % 7 == 0, -price).otherwise(price).alias("price"), F.lit(None).cast("decimal(18,2)").alias("compare_at_price"),
                         F.when(k % 11 == 0, -price).alias("cost"), z.alias("z"))
    one = F.struct(F.lit(1).cast("decimal(18,2)").alias("price"), F.when(F.col("z") % 5 == 0, -1).cast("decimal(18,2)").alias("compare_at_price"), F.lit(None).cast("decimal(18,2)").alias("cost"))
    two = F.struct(F.when(F.col("z") % 3 == 0, -1).cast("decimal(18,2)").alias("price"), F.lit(None).cast("decimal(18,2)").alias("compare_at_price"), F.lit(None).cast("decimal(18,2)").alias("cost"))
    return rows.select("p_partkey", payloads.negative_money_field(F.array(one, two)).alias("field"))


PAYLOADS_SQL = """
pay AS (
  SELECT 'P' || p_partkey AS sku, p_name AS title, CASE p_partkey % 5 WHEN 0 THEN ' archived ' WHEN 1 THEN 'active' END AS status,
    CASE WHEN p_partkey % 3 = 0 THEN p_size - 20 END AS quantity, p_size % 4 AS q1, CASE WHEN p_partkey % 2 = 0 THEN -(p_size % 7) END AS q2, p_partkey AS k FROM part),
tot AS (SELECT *, coalesce(quantity, q1 + coalesce(q2, 0)) AS total FROM pay)
"""


def payload_rows(t: Tables) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")

    def variant(n: int, quantity) -> F.Column:
        return F.struct(
            F.concat(F.lit(" "), p.code("P", "p_partkey"), F.lit(f". 1 {n} ")).alias("sku"),
            F.concat(p.code("B", "p_partkey"), F.when(k % 31 == 0, "").otherwise(str(n))).alias("barcode"),
            F.create_map(F.lit(" Size "), F.lit(f" {n} "), F.lit("Blank"), F.lit("  ")).alias("option_values"), quantity.cast("int").alias("quantity"),
        )

    variants = F.array(variant(1, z % 4), variant(2, F.when(k % 2 == 0, -(z % 7))))
    return t.part.select(
        F.concat(F.lit(" "), p.code("P", "p_partkey")).alias("sku"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("name"),
        F.when(k % 2 == 0, "").otherwise(F.col("p_type")).alias("vendor"), F.concat(F.col("p_brand"), F.lit(" ")).alias("brand"),
        F.lit("  ").alias("handle"), F.lit(None).cast("string").alias("barcode"), F.col("p_type").alias("product_type"),
        F.array(F.lit(" new "), F.lit(" "), F.when(k % 4 == 0, F.upper("p_name")).otherwise("x")).alias("tags"), variants.alias("variants"),
        F.when(k % 3 == 0, z - 20).cast("int").alias("quantity"), F.when(k % 5 == 0, " archived ").when(k % 5 == 1, "active").alias("status"), k.alias("k"),
    )


@query("normalize_products", """
SELECT 'P' || p_partkey AS sku, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS vendor, CAST(NULL AS VARCHAR) AS handle,
  'new;' || CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE 'x' END AS tags, 'P' || p_partkey || '. 1 1' AS first_sku, 'Size=1' AS first_options,
  CASE WHEN p_partkey % 31 = 0 THEN 'duplicate_variant_barcode' END AS error FROM part""")
def normalize_products(t: Tables) -> DataFrame:
    rows = payloads.normalize_products(payload_rows(t))
    first = F.col("variants")[0]
    options = F.array_join(F.transform(F.map_entries(first["option_values"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return rows.select("sku", "vendor", "handle", F.concat_ws(";", "tags").alias("tags"), first["sku"].alias("first_sku"), options.alias("first_options"), "error")


@query("import_policy", f"""
WITH {PAYLOADS_SQL}
SELECT k, CAST(total AS BIGINT) AS total, CASE WHEN total <= 0 THEN 'archived' ELSE status END AS status,
  CAST(CASE WHEN k % 4 = 0 THEN 3 ELSE 4 END AS INTEGER) AS tag_count, true AS update_description FROM tot""")
def import_policy(t: Tables) -> DataFrame:
    rows = payload_rows(t).withColumn("total", payloads.total_quantity(F.col("quantity"), F.col("variants")))
    out = payloads.apply_import_policy(rows, F.col("total"))
    return out.select("k", "total", "status", F.size("tags").alias("tag_count"), "update_description")


OWNER_SQL = PAYLOADS_SQL + """,
own AS (
  SELECT k, total, upper(trim(coalesce(status, ''))) = 'ARCHIVED' AS explicit_archive, k % 4 <> 0 AS mapped,
    CASE k % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'ACTIVE' END AS online_status, k % 6 = 0 AS marked FROM tot)
"""


def owned(t: Tables) -> DataFrame:
    k = F.col("k")
    rows = payload_rows(t).withColumns({
        "total": payloads.total_quantity(F.col("quantity"), F.col("variants")), "mapped": k % 4 != 0,
        "online_status": F.when(k % 3 == 0, "archived").when(k % 3 == 1, "ACTIVE"), "marked": k % 6 == 0,
    })
    return payloads.archive_ownership(rows, F.col("total"))


@query("archive_ownership", f"""
WITH {OWNER_SQL}
SELECT k, explicit_archive, total <= 0 AND NOT explicit_archive AS auto_archive,
  total <= 0 AND NOT explicit_archive AND (NOT mapped OR upper(coalesce(online_status, '')) <> 'ARCHIVED' OR marked) AS owns_archive FROM own""")
def archive_ownership(t: Tables) -> DataFrame:
    return owned(t).select("k", "explicit_archive", "auto_archive", "owns_archive")


@query("restore_candidates", f"""
WITH {OWNER_SQL}
SELECT k, true AS clear_marker, CASE WHEN upper(online_status) = 'ARCHIVED' THEN 'DRAFT' END AS new_status FROM own WHERE marked AND total > 0""")
def restore_candidates(t: Tables) -> DataFrame:
    return payloads.restore_candidates(owned(t), F.col("total")).select("k", "clear_marker", "new_status")


@query("export_table", "SELECT p_partkey, p_name, true AS truncated FROM part ORDER BY p_partkey LIMIT 100")
def export_table(t: Tables) -> DataFrame:
    return reports.export_table(t.part.select("p_partkey", "p_name"), 100, ["p_partkey"])


@query("catalog_csv_rows", f"""
WITH {p.ITEMS_SQL}
SELECT coalesce(sku, '') AS sku, coalesce(descr, '') AS descr, coalesce(CAST(price AS VARCHAR), '') AS price, CAST(rec_no AS VARCHAR) AS rec_no FROM items""")
def catalog_csv_rows(t: Tables) -> DataFrame:
    rows = p.items(t).select(F.col("SKU").alias("sku"), F.col("DESC").alias("descr"), F.col("PRICE").alias("price"), F.col("_rec_no").alias("rec_no"))
    return reports.flat_export(rows, ["sku", "descr", "price", "rec_no"])


@query("exact_amounts", """
SELECT l_returnflag, CAST(sum(round_even(amount, 2)) AS DECIMAL(28,2)) AS half_even, CAST(sum(round(amount, 2)) AS DECIMAL(28,2)) AS half_up
FROM (SELECT l_returnflag, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS amount FROM lineitem) GROUP BY 1""")
def exact_amounts(t: Tables) -> DataFrame:
    from tillbridge.functions.money import shop_money, till_money

    amount = (p.money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,4)")
    return t.lineitem.groupBy("l_returnflag").agg(
        F.sum(till_money(decimal_or_none(amount))).alias("half_even"), F.sum(shop_money(amount)).alias("half_up")
    )
