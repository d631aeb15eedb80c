"""Online catalog checks: matching, diffs, reconciliation, stability, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.operators import reports, storefront
from tillbridge.plans import proxies as p
from tillbridge.plans.registry import Tables, query

# online variants: one per line item of every fourth part, plus one for other parts
ONLINE_SQL = """
online AS (
  SELECT CASE WHEN p_partkey % 10 = 3 THEN ' P' || (p_partkey - 1) ELSE 'P' || p_partkey || ' ' END AS sku, p_partkey AS variant_id, p_partkey // 3 AS product_id,
    'h' || (p_partkey // 3) AS handle, p_partkey % 3 AS pos, p_partkey AS k FROM part WHERE p_partkey % 5 <> 4)
"""


def online(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    sku = F.when(k % 10 == 3, F.concat(F.lit(" P"), (k - 1).cast("string"))).otherwise(F.concat(p.code("P", "p_partkey"), F.lit(" ")))
    product = F.floor(k / 3).cast("bigint")
    return t.part.where("p_partkey % 5 <> 4").select(
        sku.alias("sku"), k.alias("variant_id"), product.alias("product_id"), F.concat(F.lit("h"), product.cast("string")).alias("handle"), (k % 3).alias("pos"), k.alias("k"),
    )


@query("exact_sku_match", f"""
WITH {ONLINE_SQL},
m AS (SELECT trim(sku) AS sku, count(*) AS matches, min(variant_id) AS v, arg_min(product_id, variant_id) AS pr FROM online GROUP BY 1)
SELECT 'P' || p_partkey AS sku, CASE WHEN matches IS NULL THEN 'not_found' WHEN matches = 1 THEN 'found' ELSE 'duplicate' END AS status, coalesce(matches, 0) AS matches,
  CASE WHEN matches = 1 THEN v END AS variant_id, CASE WHEN matches = 1 THEN pr END AS product_id
FROM part LEFT JOIN m ON m.sku = 'P' || p_partkey""")
def exact_sku_match(t: Tables) -> DataFrame:
    return storefront.exact_sku_match(t.part.select(p.code("P", "p_partkey").alias("sku")), online(t))


@query("duplicate_variants", f"""
WITH {ONLINE_SQL}
SELECT trim(sku) AS sku, variant_id FROM online WHERE trim(sku) IN (SELECT trim(sku) FROM online GROUP BY 1 HAVING count(*) > 1)""")
def duplicate_variants(t: Tables) -> DataFrame:
    return storefront.duplicate_variants(exact_sku_match(t), online(t))


@query("match_existing", f"""
WITH {ONLINE_SQL},
pay AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN p_partkey // 2 END AS ext, CASE WHEN p_partkey % 4 <> 0 THEN 'P' || p_partkey END AS sku,
  CASE WHEN p_partkey % 2 = 0 THEN 'h' || (p_partkey // 5) END AS handle, p_partkey % 6 = 0 AS has_variants, 'P' || (p_partkey + 1) AS v1, 'P' || (p_partkey + 2) AS v2 FROM part),
firsts AS (SELECT product_id, arg_min(variant_id, pos) AS first_variant, any_value(handle) AS handle, count(*) AS n FROM online GROUP BY 1),
inp AS (SELECT product_id, trim(sku) AS sku, arg_min(variant_id, pos) AS v FROM online GROUP BY 1, 2),
bysku AS (SELECT trim(sku) AS sku, arg_min(product_id, (product_id, pos)) AS product_id, arg_min(variant_id, (product_id, pos)) AS variant_id, count(*) AS n FROM online GROUP BY 1),
cand AS (
  SELECT id, 1 AS pr, 0 AS pos, f.product_id, coalesce(i.v, first_variant) AS variant_id, NULL AS error FROM pay JOIN firsts f ON ext = f.product_id LEFT JOIN inp i ON i.product_id = f.product_id AND i.sku = pay.sku
  UNION ALL SELECT id, 2, 0, b.product_id, b.variant_id, CASE WHEN n > 1 THEN 'duplicate_sku' END FROM pay JOIN bysku b ON b.sku = pay.sku
  UNION ALL SELECT id, 3, 0, b.product_id, b.variant_id, CASE WHEN n > 1 THEN 'duplicate_sku' END FROM pay JOIN bysku b ON b.sku = v1 WHERE has_variants
  UNION ALL SELECT id, 3, 1, b.product_id, b.variant_id, CASE WHEN n > 1 THEN 'duplicate_sku' END FROM pay JOIN bysku b ON b.sku = v2 WHERE has_variants
  UNION ALL SELECT id, 4, 0, f.product_id, coalesce(i.v, first_variant), CASE WHEN n > 1 AND NOT has_variants THEN 'ambiguous_handle' END
    FROM pay JOIN firsts f ON f.handle = pay.handle LEFT JOIN inp i ON i.product_id = f.product_id AND i.sku = CASE WHEN has_variants THEN v1 ELSE pay.sku END),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pr, pos) AS r FROM cand)
SELECT pay.id AS payload_id, ['external_id', 'sku', 'variant_sku', 'handle'][pr] AS matched_by, CASE WHEN error IS NULL THEN product_id END AS product_id, CASE WHEN error IS NULL THEN variant_id END AS variant_id, error
FROM pay LEFT JOIN best ON best.id = pay.id AND r = 1""")
def match_existing(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    payloads = t.part.select(
        k.alias("payload_id"), F.when(k % 7 == 0, F.floor(k / 2).cast("bigint")).alias("external_id"), F.when(k % 4 != 0, p.code("P", "p_partkey")).alias("sku"),
        F.when(k % 2 == 0, F.concat(F.lit("h"), F.floor(k / 5).cast("string"))).alias("handle"),
    )
    variants = t.part.where("p_partkey % 6 = 0").select(k.alias("payload_id"), F.posexplode(F.array(*[F.concat(F.lit("P"), (k + i).cast("string")) for i in (1, 2)])).alias("pos", "sku"))
    return storefront.match_existing(payloads, variants, online(t))


@query("product_changes", """
WITH pay AS (SELECT 'P' || p_partkey AS sku, p_name AS title, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_retailprice AS DECIMAL(18,3)) + CAST(0.004 AS DECIMAL(18,3)) END AS price,
    CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_retailprice AS DECIMAL(18,3)) + CAST(0.004 AS DECIMAL(18,3)) END AS cost, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS quantity FROM part),
onl AS (SELECT 'P' || p_partkey AS sku, p_partkey AS product_id, CAST(p_retailprice AS DECIMAL(18,3)) AS price, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_retailprice AS DECIMAL(18,3)) END AS cost, CASE WHEN p_partkey % 11 <> 0 THEN p_size - p_size % 2 END AS quantity FROM part WHERE p_partkey % 6 <> 0)
SELECT p.sku, o.product_id, CASE WHEN o.product_id IS NULL THEN 'create' ELSE 'update' END AS action, o.product_id IS NOT NULL AND p.price IS NOT NULL AND p.price IS DISTINCT FROM o.price AS price_changed,
  p.cost IS NOT NULL AND round(p.cost, 2) IS DISTINCT FROM round(o.cost, 2) AS cost_changed, p.quantity IS NOT NULL AND p.quantity IS DISTINCT FROM o.quantity AS quantity_changed,
  '{"title":"' || title || '"' || coalesce(',"price":' || CAST(round(p.price, 2) AS DECIMAL(18,2)), '') || coalesce(',"cost":' || CAST(round(p.cost, 2) AS DECIMAL(18,2)), '') || coalesce(',"quantity":' || p.quantity, '') || '}' AS record
FROM pay p LEFT JOIN onl o ON p.sku = o.sku""")
def product_changes(t: Tables) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    listed = F.col("p_retailprice").cast("decimal(18,3)")
    above = listed + F.lit("0.004").cast("decimal(18,3)")
    pay = t.part.select(p.code("P", "p_partkey").alias("sku"), F.col("p_name").alias("title"), F.when(k % 3 != 0, above).alias("price"), F.when(k % 4 != 0, above).alias("cost"), F.when(k % 5 != 0, z).alias("quantity"))
    known = t.part.where("p_partkey % 6 <> 0").select(
        p.code("P", "p_partkey").alias("sku"), k.alias("product_id"), listed.alias("online_price"), F.when(k % 7 != 0, listed).alias("online_cost"), F.when(k % 11 != 0, z - z % 2).alias("online_quantity"),
    )
    return storefront.plan_product_changes(pay, known)


CATALOG_SQL = """
cat AS (
  SELECT l_partkey AS product_id, CASE WHEN l_partkey % 4 = 0 THEN 'archived' ELSE 'active' END AS status,
    CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 'other' ELSE 'p' || l_partkey END AS marker, l_partkey % 17 = 0 AS truncated,
    CASE WHEN l_partkey % 11 = 0 THEN ' ' ELSE 'P' || l_partkey || '. ' || l_linenumber || ' 1' END AS sku FROM lineitem),
src AS (SELECT DISTINCT lower('P' || p_partkey) AS folded FROM part WHERE p_partkey % 3 = 0 UNION SELECT 'p' || p_partkey || '. 2 1' FROM part WHERE p_partkey % 5 = 0),
pr AS (
  SELECT product_id, any_value(upper(status)) AS status, any_value(lower(marker)) AS marker, bool_or(truncated) AS truncated, count(nullif(trim(sku), '')) AS skus,
    coalesce(bool_or(trim(sku) <> '' AND 'p' || product_id = lower(marker)), false) AS managed, coalesce(bool_or(lower(nullif(trim(sku), '')) IN (SELECT folded FROM src)), false) AS known FROM cat GROUP BY 1),
cls AS (SELECT product_id, status, CASE WHEN truncated THEN 'truncated' WHEN skus = 0 THEN 'without_sku' WHEN NOT managed THEN 'unmanaged' WHEN known OR marker IN (SELECT folded FROM src) THEN 'matched' WHEN status = 'ARCHIVED' THEN 'already_archived' ELSE 'candidate' END AS class FROM pr)
"""


def catalog_classes(t: Tables) -> DataFrame:
    k = F.col("l_partkey")
    rows = t.lineitem.select(
        k.alias("product_id"), F.when(k % 4 == 0, "archived").otherwise("active").alias("status"),
        F.when(k % 9 == 0, None).when(k % 13 == 0, "other").otherwise(p.code("p", "l_partkey")).alias("marker"), (k % 17 == 0).alias("truncated"),
        F.when(k % 11 == 0, " ").otherwise(F.concat(p.code("P", "l_partkey"), F.lit(". "), F.col("l_linenumber").cast("string"), F.lit(" 1"))).alias("sku"),
    )
    parts = t.part.where("p_partkey % 3 = 0").select(p.code("P", "p_partkey").alias("sku"))
    children = t.part.where("p_partkey % 5 = 0").select(F.concat(p.code("P", "p_partkey"), F.lit(". 2 1")).alias("sku"))
    source = parts.unionByName(children)
    return storefront.reconcile_catalog(source, rows, minimum=20)


@query("reconcile_catalog", f"WITH {CATALOG_SQL} SELECT * FROM cls")
def reconcile_catalog(t: Tables) -> DataFrame:
    return catalog_classes(t)


@query("reconcile_catalog_counts", f"WITH {CATALOG_SQL} SELECT class, count(*) AS products FROM cls GROUP BY 1")
def reconcile_catalog_counts(t: Tables) -> DataFrame:
    return catalog_classes(t).groupBy("class").agg(F.count(F.lit(1)).alias("products"))


@query("reconciliation_report", f"""
WITH {CATALOG_SQL}, keyed AS (SELECT product_id, trim(sku) AS sku, row_number() OVER (PARTITION BY product_id ORDER BY pos) AS pos FROM (
  SELECT DISTINCT l_partkey AS product_id, CASE WHEN l_partkey % 11 = 0 THEN ' ' ELSE 'P' || l_partkey || '. ' || l_linenumber || ' 1' END AS sku, l_linenumber AS pos FROM lineitem) WHERE trim(sku) <> ''),
listed AS (SELECT product_id, string_agg(sku, ';' ORDER BY pos) AS skus FROM keyed GROUP BY 1)
SELECT CAST(cls.product_id AS VARCHAR) AS product_id, coalesce(p_name, '') AS title, status, coalesce(skus, '') AS skus FROM cls LEFT JOIN part ON p_partkey = cls.product_id LEFT JOIN listed ON listed.product_id = cls.product_id WHERE class = 'candidate'""")
def reconciliation_report(t: Tables) -> DataFrame:
    k = F.col("l_partkey")
    sku = F.when(k % 11 == 0, " ").otherwise(F.concat(p.code("P", "l_partkey"), F.lit(". "), F.col("l_linenumber").cast("string"), F.lit(" 1")))
    variants = t.lineitem.select(k.alias("product_id"), F.col("l_linenumber").alias("pos"), sku.alias("sku")).distinct()
    return reports.reconciliation_report(catalog_classes(t), t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title")), variants)


@query("search_catalog", """
SELECT p_partkey, p_name AS title FROM part WHERE lower(p_type) = 'economy' AND (contains(lower(p_name), 'ring') OR contains('p' || p_partkey, 'ring')) ORDER BY p_partkey LIMIT 20 OFFSET 20""")
def search_catalog(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_name").alias("title"), p.code("P", "p_partkey").alias("sku"), F.lit(None).cast("string").alias("handle"), F.col("p_type").alias("status"))
    return storefront.search_catalog(rows, ["p_partkey"], status="Economy", search="RING", page=2, per_page=20).select("p_partkey", "title")


@query("upload_order_batches", """
WITH s AS (SELECT l_partkey, sum(CAST(l_quantity AS BIGINT) - 25) AS q FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1),
o AS (SELECT p_partkey, CASE WHEN coalesce(q, p_size - 25) > 0 THEN 0 ELSE 1 END AS priority FROM part LEFT JOIN s ON l_partkey = p_partkey),
i AS (SELECT *, row_number() OVER (ORDER BY priority, p_partkey) - 1 AS idx FROM o)
SELECT p_partkey, CAST(priority AS INTEGER) AS priority, (idx - 30) // 25 AS batch FROM i WHERE idx >= 30 AND (idx - 30) // 25 < 40""")
def upload_order_batches(t: Tables) -> DataFrame:
    products = t.part.select(p.code("P", "p_partkey").alias("sku"), (F.col("p_size") - 25).alias("quantity"), "p_partkey")
    variants = t.lineitem.where("l_partkey % 2 = 0").select(p.code("P", "l_partkey").alias("base"), (F.col("l_quantity").cast("bigint") - 25).alias("quantity"))
    ordered = storefront.upload_order(products, variants)
    rows = reports.plan_batches(ordered, ["priority", "p_partkey"], 25, start_offset=10, next_index=30, max_batches=40)
    return rows.select("p_partkey", "priority", "batch")


@query("bulk_results", """
SELECT o_orderkey % 100 AS request, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS succeeded, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1""")
def bulk_results(t: Tables) -> DataFrame:
    rows = t.orders.select((F.col("o_orderkey") % 100).alias("request"), (F.col("o_orderstatus") != "P").alias("success"))
    return reports.bulk_result_summary(rows, "request")


STABLE_SQL = """
sc AS (SELECT 'S' || (user_id % 60) AS sku, event_id AS scan, CASE WHEN value < 30 THEN 'a' ELSE event_type END AS title FROM events),
ch AS (SELECT *, CASE WHEN title IS DISTINCT FROM lag(title) OVER w THEN 1 ELSE 0 END AS changed FROM sc WINDOW w AS (PARTITION BY sku ORDER BY scan)),
gr AS (SELECT *, sum(changed) OVER (PARTITION BY sku ORDER BY scan) AS g FROM ch)
"""


def scans(t: Tables) -> DataFrame:
    return t.events.select(
        F.concat(F.lit("S"), (F.col("user_id") % 60).cast("string")).alias("sku"), F.col("event_id").alias("scan"),
        F.when(F.col("value") < 30, "a").otherwise(F.col("event_type")).alias("title"),
    )


@query("stable_payload_history", f"""
WITH {STABLE_SQL}, n AS (SELECT sku, scan, row_number() OVER (PARTITION BY sku, g ORDER BY scan) AS observations FROM gr)
SELECT *, observations >= 2 AS ready FROM n""")
def stable_payload_history(t: Tables) -> DataFrame:
    rows = storefront.stability_history(scans(t), "sku", "scan", "title")
    return rows.select("sku", "scan", F.col("observations").cast("bigint").alias("observations"), "ready")


@query("stable_payload_scan", """
SELECT 'P' || p_partkey AS sku, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE p_partkey % 4 + 1 END AS BIGINT) AS observations, CASE WHEN p_partkey % 3 = 0 THEN false ELSE p_partkey % 4 >= 1 END AS ready FROM part""")
def stable_payload_scan(t: Tables) -> DataFrame:
    now = t.part.select(p.code("P", "p_partkey").alias("sku"), F.col("p_name").alias("title"), "p_size", "p_partkey")
    before = storefront.stable_payloads(
        now.withColumn("title", F.when(F.col("p_partkey") % 3 == 0, "old").otherwise(F.col("title"))),
        now.where("false").select("sku", F.lit("").alias("fingerprint"), F.lit(0).cast("bigint").alias("observations")), ["title", "p_size"],
    )
    previous = before.select("sku", "fingerprint", (F.col("p_partkey") % 4).alias("observations"))
    return storefront.stable_payloads(now, previous, ["title", "p_size"]).select("sku", "observations", "ready")


def numeric_sql(known: str, mark: str = "NULL") -> str:
    return f"""
WITH i AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'X' || p_partkey WHEN p_partkey % 50 = 1 THEN '99999999999999' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') ELSE '0123456789012' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END AS sku, p_partkey AS n FROM part),
num AS (SELECT *, TRY_CAST(sku AS HUGEINT) AS v FROM i WHERE regexp_full_match(sku, '[0-9]+')),
w AS (SELECT length(arg_max(sku, n)) AS width FROM num),
known AS (SELECT sku FROM i WHERE {known}),
m AS (SELECT width, coalesce(CAST({mark} AS HUGEINT), (SELECT max(TRY_CAST(sku AS HUGEINT)) FROM known WHERE length(sku) = width), 0) AS high, (SELECT max(v) FROM num WHERE length(sku) = width) AS observed FROM w),
fresh AS (SELECT DISTINCT sku FROM num, m WHERE length(sku) = width AND v > high AND sku NOT IN (SELECT sku FROM known))
SELECT sku, CAST(high AS DECIMAL(38,0)) AS previous_high, CAST(greatest(high, observed) AS DECIMAL(38,0)) AS new_high, CAST(width AS INTEGER) AS width FROM m LEFT JOIN fresh ON true"""


def numeric_items(t: Tables) -> DataFrame:
    """SKUs of 20 and 21 digits, and others."""
    k, padded = F.col("p_partkey"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    sku = F.when(k % 3 == 0, F.concat(F.lit("X"), k.cast("string"))).when(k % 50 == 1, F.concat(F.lit("9" * 14), padded))
    return t.part.select(sku.otherwise(F.concat(F.lit("0123456789012"), padded)).alias("sku"), k.alias("n"))


@query("new_numeric_skus", numeric_sql("n % 2 = 0 AND n < (SELECT max(n) // 2 FROM i)"))
def new_numeric_skus(t: Tables) -> DataFrame:
    items = numeric_items(t)
    half = F.floor(t.part.agg(F.max("p_partkey")).scalar() / 2)
    return storefront.new_numeric_skus(items, items.where((F.col("n") % 2 == 0) & (F.col("n") < half)).select("sku"), ["n"])


@query("new_numeric_skus_above_mark", numeric_sql("n % 5 = 0", "1234567890120000100"))
def new_numeric_skus_above_mark(t: Tables) -> DataFrame:
    """Known SKUs on both sides of a given mark."""
    items = numeric_items(t)
    return storefront.new_numeric_skus(items, items.where("n % 5 = 0").select("sku"), ["n"], high_water=1234567890120000100)


@query("new_numeric_skus_none", numeric_sql("true"))
def new_numeric_skus_none(t: Tables) -> DataFrame:
    """All SKUs are known: only the marks come back."""
    items = numeric_items(t)
    return storefront.new_numeric_skus(items, items.select("sku"), ["n"])


@query("sku_base_mapping", f"WITH {p.MAP_SQL} SELECT DISTINCT sku, base FROM sku_map")
def sku_base_mapping(t: Tables) -> DataFrame:
    mapping = p.sku_map(t)
    return storefront.sku_base_mapping(t.part.select(p.code(" P", "p_partkey").alias("sku")), storefront.matrix_children_only(mapping))


@query("flatten_quantities", f"""
WITH {p.MAP_SQL}
SELECT sku, CAST(7 AS INTEGER) AS quantity FROM sku_map WHERE sku <> base
UNION ALL SELECT 'P' || p_partkey, p_size FROM part WHERE 'P' || p_partkey NOT IN (SELECT base FROM sku_map WHERE sku <> base)""")
def flatten_quantities(t: Tables) -> DataFrame:
    children = storefront.matrix_children_only(p.sku_map(t)).withColumn("quantity", F.lit(7))
    return storefront.flatten_quantities(t.part.select(p.code("P", "p_partkey").alias("sku"), F.col("p_size").alias("quantity")), children)


@query("related_skus", f"""
WITH {p.MAP_SQL}, b AS (SELECT DISTINCT base FROM sku_map WHERE sku <> base)
SELECT base, base AS sku FROM b UNION SELECT base, sku FROM sku_map WHERE sku <> base
UNION SELECT 'P' || l_partkey, 'P' || l_partkey || '. ' || l_linenumber || ' 9' FROM lineitem WHERE 'P' || l_partkey IN (SELECT base FROM b)""")
def related_skus(t: Tables) -> DataFrame:
    snapshot = t.lineitem.select(F.concat(p.code("P", "l_partkey"), F.lit(". "), F.col("l_linenumber").cast("string"), F.lit(" 9")).alias("sku"))
    return storefront.related_skus(storefront.matrix_children_only(p.sku_map(t)), snapshot)
