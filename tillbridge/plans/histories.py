"""Repair stages over a history, exact CSV parts, and plans of products with variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.operators import customers, grid_plans, pages, parts, repair, reports
from tillbridge.plans import proxies as p
from tillbridge.plans.registry import Tables, query


def one_of(column: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column + 1).cast("int"))


def repair_events(t: Tables) -> DataFrame:
    """Events as scans, payload checks and answers; one base has a third of them."""
    k, v = F.col("event_id"), F.floor("value").cast("long")
    return t.events.select(
        F.when(k % 3 == 0, "B").otherwise(p.code("B", "user_id")).alias("base"), k.alias("seq"), one_of(F.floor(k / 3) % 5, "scan", "payload", "scan", "payload", "result").alias("kind"),
        F.when(v % 11 == 0, "y").otherwise("x").alias("print"), one_of(v % 7, "scalar", "correct", "scalar", "scalar", "blocked", "scalar", "scalar").alias("shape"),
        one_of(v % 5, "repaired", "already_correct", "quantity_mismatch", "blocked", "failed").alias("status"), (k % 2 == 0).alias("confirmed"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


@query("repair_history", """
WITH RECURSIVE ev AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) AS n FROM (
    SELECT CASE WHEN event_id % 3 = 0 THEN 'B' ELSE 'B' || user_id END AS base, event_id AS seq, ['scan', 'payload', 'scan', 'payload', 'result'][CAST((event_id // 3) % 5 + 1 AS INTEGER)] AS kind,
      CASE WHEN CAST(floor(value) AS BIGINT) % 11 = 0 THEN 'y' ELSE 'x' END AS print, ['scalar', 'correct', 'scalar', 'scalar', 'blocked', 'scalar', 'scalar'][CAST(CAST(floor(value) AS BIGINT) % 7 + 1 AS INTEGER)] AS shape,
      ['repaired', 'already_correct', 'quantity_mismatch', 'blocked', 'failed'][CAST(CAST(floor(value) AS BIGINT) % 5 + 1 AS INTEGER)] AS status, event_id % 2 = 0 AS confirmed, strftime(ts, '%Y-%m-%d') AS day FROM events)),
st AS (
  SELECT DISTINCT base, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS stage, CAST(NULL AS VARCHAR) AS shown, CAST(0 AS BIGINT) AS seen, CAST(NULL AS VARCHAR) AS told, false AS ready FROM ev
  UNION ALL
  SELECT base, n, seq, stage, shown, seen, CASE WHEN stage IS NULL THEN NULL WHEN kind = 'result' THEN day WHEN fresh THEN NULL ELSE told END,
    kind = 'payload' AND same AND ((was = 'server_blocked' AND told IS DISTINCT FROM day) OR (was = 'candidate' AND seen >= 2))
  FROM (
    SELECT base, n, seq, kind, day, told, was, same, stage, fresh, CASE WHEN kind = 'result' THEN shown ELSE print END AS shown,
      CASE WHEN stage IS NULL THEN 0 WHEN kind = 'scan' AND fresh AND NOT (shape = 'blocked' AND same) THEN 1
        WHEN kind = 'payload' AND (was = 'candidate' OR (was = 'server_blocked' AND told IS DISTINCT FROM day)) THEN seen + 1 ELSE seen END AS seen
    FROM (
      SELECT *, kind = 'scan' AND shape <> 'correct' AND NOT (same AND ((shape = 'scalar' AND was IN ('candidate', 'verification', 'server_blocked')) OR (shape = 'blocked' AND was IN ('verification', 'quantity_reconciliation')))) AS fresh,
        CASE kind
          WHEN 'scan' THEN CASE shape
            WHEN 'correct' THEN CASE WHEN same AND ((was IN ('candidate', 'verification') AND NOT confirmed) OR was = 'server_blocked') THEN was END
            WHEN 'scalar' THEN CASE WHEN same AND was IN ('candidate', 'verification', 'server_blocked') THEN was ELSE 'candidate' END
            ELSE CASE WHEN same AND was IN ('verification', 'quantity_reconciliation') THEN was ELSE 'snapshot_blocked' END END
          WHEN 'payload' THEN CASE WHEN same THEN was END
          ELSE CASE WHEN was IS NULL THEN NULL WHEN status IN ('repaired', 'already_correct') AND confirmed THEN 'verification'
            WHEN status = 'quantity_mismatch' THEN 'quantity_reconciliation' WHEN status = 'blocked' THEN 'server_blocked' ELSE 'candidate' END END AS stage
      FROM (SELECT e.*, s.stage AS was, s.shown, s.seen, s.told, s.stage IS NOT NULL AND s.shown IS NOT DISTINCT FROM e.print AS same FROM st s JOIN ev e ON e.base = s.base AND e.n = s.n + 1))))
SELECT base, seq, stage, seen AS observations, ready FROM st WHERE n > 0""")
def repair_history(t: Tables) -> DataFrame:
    return repair.repair_history(repair_events(t), block_rows=1_000)


PART_LIMIT = 100_000


@query("csv_parts", f"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) AS upto, row_number() OVER (ORDER BY doc_id) AS r
  FROM (SELECT doc_id, CAST(octet_length(encode(doc_id || ',' || CASE WHEN regexp_matches(text, '[",\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || chr(10))) AS BIGINT) AS n FROM documents)),
cut AS (
  SELECT 1 AS part, CAST(1 AS BIGINT) AS first, (SELECT coalesce(min(CASE WHEN upto > {PART_LIMIT} - 12 AND r > 1 THEN r END), 1 + max(r)) FROM l) AS next
  UNION ALL
  SELECT part + 1, next, (SELECT coalesce(min(CASE WHEN b.upto > a.upto - a.n + {PART_LIMIT} - 12 AND b.r > a.r THEN b.r END), 1 + max(b.r)) FROM l b)
  FROM cut JOIN l a ON a.r = cut.next)
SELECT CAST(part AS BIGINT) AS part_number, count(*) AS rows, CAST(sum(n) + 12 AS BIGINT) AS bytes, min(doc_id) AS first_id, max(doc_id) AS last_id FROM cut JOIN l ON r >= first AND r < next GROUP BY part""")
def csv_parts(t: Tables) -> DataFrame:
    """Whole documents as CSV lines in the parts a sequential writer makes; the header has 12 bytes."""
    lines = t.documents.select("doc_id", customers.csv_line(["doc_id", "text"]).alias("line"))
    cut = parts.cut_parts(lines, ["doc_id"], "line", PART_LIMIT, header_bytes=12)
    return cut.groupBy("part_number").agg(F.count(F.lit(1)).alias("rows"), (F.sum("line_bytes") + 12).alias("bytes"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


# grids of line items; two thirds of the products exist online, with most of their variants
GRID_SQL = """
v AS (SELECT l_partkey AS k, l_linenumber * 10 + l_suppkey % 3 + 1 AS pos, l_linenumber AS r, l_suppkey % 3 + 1 AS c, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) - 20 AS q, CAST(max(l_extendedprice) AS DECIMAL(18,2)) AS price FROM lineitem GROUP BY 1, 2, 3, 4),
pay AS (SELECT 'P' || p_partkey AS base, p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS product_id, CASE WHEN p_partkey % 7 = 0 THEN 'archived' WHEN p_partkey % 7 = 1 THEN 'Active' END AS status, CASE WHEN p_partkey % 10 = 3 THEN p_size - 5 END AS quantity FROM part),
vars AS (
  SELECT 'P' || k AS base, k, pos, 'P' || k || '. ' || r || ' ' || c AS sku, 'B' || (k * 10 + r) AS barcode, CASE WHEN (k + r) % 6 <> 0 THEN price + CAST(0.004 AS DECIMAL(18,3)) END AS price, CASE WHEN k % 4 = 0 THEN price END AS cost,
    CASE WHEN k % 9 = 1 THEN NULL WHEN k % 9 = 2 THEN 0 ELSE q END AS quantity, CASE WHEN k % 37 = 0 THEN 'none' WHEN k % 31 = 0 AND r = 1 THEN 'blank' ELSE 'good' END AS options FROM v),
onl AS (
  SELECT k AS product_id, pos, 'P' || k || '. ' || r || ' ' || c AS sku, k * 1000 + pos AS variant_id, price + CASE WHEN r % 2 = 0 THEN 1 ELSE 0 END AS price, CASE WHEN c = 1 THEN price END AS cost, q + CASE WHEN c = 3 THEN 1 ELSE 0 END AS quantity
  FROM v WHERE k % 3 <> 0 AND (k + r + c) % 5 <> 0 AND k % 13 <> 0
  UNION ALL SELECT p_partkey, 0, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE 'P' || p_partkey END, p_partkey * 1000, NULL, NULL, 0 FROM part WHERE p_partkey % 3 <> 0 AND (p_partkey % 13 = 0 OR p_partkey % 8 = 1))
"""


def grid(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Payloads, their variants and the online variants."""
    k, r, c = F.col("k"), F.col("r"), F.col("c")
    v = t.lineitem.groupBy(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("r"), (F.col("l_suppkey") % 3 + 1).alias("c")).agg(
        (F.sum(F.col("l_quantity").cast("bigint")) - 20).alias("q"), F.max("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    v = v.withColumn("pos", r * 10 + c).withColumn("sku", F.concat(p.code("P", "k"), F.lit(". "), r.cast("string"), F.lit(" "), c.cast("string")))
    pk = F.col("p_partkey")
    payloads = t.part.select(
        p.code("P", "p_partkey").alias("base"), F.when(pk % 3 != 0, pk).alias("product_id"), F.when(pk % 7 == 0, "archived").when(pk % 7 == 1, "Active").alias("status"),
        F.when(pk % 10 == 3, F.col("p_size") - 5).alias("quantity"),
    )
    good = F.create_map(F.lit("Size "), r.cast("string"), F.lit("Color"), F.when((k % 31 == 0) & (r == 1), " ").otherwise(c.cast("string")))
    variants = v.select(
        p.code("P", "k").alias("base"), "pos", "sku", F.concat(F.lit("B"), (k * 10 + r).cast("string")).alias("barcode"), F.when(k % 37 != 0, good).alias("option_values"),
        F.when((k + r) % 6 != 0, F.col("amount") + F.lit("0.004").cast("decimal(18,3)")).alias("price"), F.lit(None).cast("decimal(18,2)").alias("compare_at_price"),
        F.when(k % 4 == 0, F.col("amount")).alias("cost"), F.when(k % 9 == 1, None).when(k % 9 == 2, 0).otherwise(F.col("q")).alias("quantity"),
        F.lit(None).cast("boolean").alias("tracked"), F.lit(None).cast("boolean").alias("requires_shipping"),
    )
    there = v.where("k % 3 <> 0 AND (k + r + c) % 5 <> 0 AND k % 13 <> 0").select(
        k.alias("product_id"), "pos", "sku", (k * 1000 + F.col("pos")).alias("variant_id"), (F.col("amount") + F.when(r % 2 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("price"),
        F.when(c == 1, F.col("amount")).alias("cost"), (F.col("q") + F.when(c == 3, 1).otherwise(0)).alias("quantity"),
    )
    scalar = t.part.where("p_partkey % 3 <> 0 AND (p_partkey % 13 = 0 OR p_partkey % 8 = 1)").select(
        pk.alias("product_id"), F.lit(0).cast("long").alias("pos"), F.when(pk % 13 == 0, " ").otherwise(p.code("P", "p_partkey")).alias("sku"), (pk * 1000).alias("variant_id"),
        F.lit(None).cast("decimal(18,2)").alias("price"), F.lit(None).cast("decimal(18,2)").alias("cost"), F.lit(0).cast("long").alias("quantity"),
    )
    return payloads, variants, there.unionByName(scalar)


@query("grid_variant_changes", f"""
WITH {GRID_SQL},
f AS (SELECT k, min(pos) AS first FROM vars GROUP BY 1),
spare AS (SELECT product_id, min(variant_id) AS variant_id FROM onl WHERE pos = 0 GROUP BY 1),
m AS (
  SELECT vars.*, pay.product_id, coalesce(o.variant_id, CASE WHEN vars.pos = first THEN spare.variant_id END) AS variant_id
  FROM vars JOIN f USING (k) JOIN pay ON pay.k = vars.k LEFT JOIN onl o ON o.product_id = pay.product_id AND o.sku = vars.sku LEFT JOIN spare ON spare.product_id = pay.product_id),
j AS (
  SELECT coalesce(m.base, 'P' || o.product_id) AS base, coalesce(m.product_id, o.product_id) AS product_id, m.pos, coalesce(m.sku, trim(o.sku)) AS sku, o.variant_id, m.price AS mp, o.price AS op, m.cost AS mc, o.cost AS oc, m.quantity AS mq, o.quantity AS oq,
    m.sku AS ms, trim(o.sku) AS os, m.barcode
  FROM m FULL JOIN onl o ON o.product_id = m.product_id AND o.variant_id = m.variant_id),
ch AS (
  SELECT *, variant_id IS NOT NULL AND mp IS NOT NULL AND round(mp, 2) IS DISTINCT FROM op AS price_changed, variant_id IS NOT NULL AND mc IS NOT NULL AND mc IS DISTINCT FROM oc AS cost_changed,
    variant_id IS NOT NULL AND mq IS NOT NULL AND mq IS DISTINCT FROM oq AS quantity_changed FROM j)
SELECT base, product_id, pos, sku, variant_id, CASE WHEN pos IS NULL THEN 'remove' WHEN variant_id IS NULL THEN 'create' WHEN price_changed OR cost_changed OR quantity_changed OR ms IS DISTINCT FROM os THEN 'update' ELSE 'unchanged' END AS action,
  price_changed, cost_changed, quantity_changed,
  CASE WHEN pos IS NOT NULL THEN '{{' || coalesce('"id":' || variant_id || ',', '') || '"sku":"' || sku || '","barcode":"' || barcode || '","tracked":true,"requires_shipping":true' || coalesce(',"price":' || CAST(round(mp, 2) AS DECIMAL(18,2)), '')
    || coalesce(',"cost":' || mc, '') || coalesce(',"quantity":' || mq, '') || '}}' END AS record
FROM ch""")
def grid_variant_changes(t: Tables) -> DataFrame:
    return grid_plans.plan_variant_changes(*grid(t))


@query("grid_product_changes", f"""
WITH {GRID_SQL},
tot AS (SELECT k, count(*) AS variant_count, count(DISTINCT barcode) AS barcode_count, sum(quantity) AS s, bool_or(cost IS NOT NULL) AS cost_updated, bool_or(quantity IS NOT NULL) AS inventory_updated, arg_min(options, pos) FILTER (options <> 'good') AS bad FROM vars GROUP BY 1),
x AS (
  SELECT pay.*, variant_count, barcode_count, cost_updated, inventory_updated, CAST(coalesce(quantity, s) AS BIGINT) AS total, coalesce(upper(status), '') AS asked, product_id IS NULL AS created,
    CASE WHEN product_id % 17 = 0 THEN 'matrix_product_not_found' WHEN bad = 'none' THEN 'missing_matrix_option' WHEN bad = 'blank' THEN 'invalid_matrix_option' END AS error,
    product_id IS NOT NULL AND product_id % 17 <> 0 AND product_id % 4 <= 1 AS archived, product_id IS NOT NULL AND product_id % 17 <> 0 AND product_id % 8 IN (0, 2) AS ours
  FROM pay JOIN tot USING (k)),
y AS (SELECT *, asked = 'ARCHIVED' AS manual, coalesce(total <= 0, false) AND asked <> 'ARCHIVED' AS empty, coalesce(total > 0, false) AND asked <> 'ARCHIVED' AND ours AS back FROM x)
SELECT base, product_id, CASE WHEN created THEN 'create' ELSE 'update' END AS action, error, total AS total_quantity, variant_count, barcode_count, cost_updated, inventory_updated, empty AND error IS NULL AS archives, back AND error IS NULL AS restores,
  CASE WHEN error IS NOT NULL THEN NULL WHEN empty AND (created OR NOT archived OR ours) THEN true WHEN (manual AND NOT created) OR back THEN false END AS marker,
  CASE WHEN error IS NOT NULL THEN NULL WHEN back AND archived THEN 'DRAFT' WHEN empty OR manual THEN 'ARCHIVED' WHEN asked <> '' THEN asked WHEN created THEN 'DRAFT' END AS status
FROM y""")
def grid_product_changes(t: Tables) -> DataFrame:
    payloads, variants, _ = grid(t)
    k = F.col("p_partkey")
    products = t.part.where("p_partkey % 3 <> 0 AND p_partkey % 17 <> 0").select(
        k.alias("product_id"), F.when(k % 4 <= 1, "Archived").otherwise("ACTIVE").alias("status"), (k % 8).isin(0, 2).alias("auto_archived"))
    return grid_plans.plan_grid_products(payloads, variants, products)


@query("grid_options", f"""
WITH {GRID_SQL},
o AS (SELECT base, pos, 'Size' AS option, 1 AS position, CAST(pos // 10 AS VARCHAR) AS value FROM vars WHERE options <> 'none' UNION ALL SELECT base, pos, 'Color', 2, CASE WHEN options = 'blank' THEN '' ELSE CAST(pos % 10 AS VARCHAR) END FROM vars WHERE options <> 'none'),
w AS (SELECT base, option, position, value, min(pos) AS first FROM o GROUP BY ALL)
SELECT base, CAST(position AS INT) AS position, option, CAST(row_number() OVER (PARTITION BY base, option ORDER BY first) AS INT) AS value_position, value FROM w""")
def grid_options(t: Tables) -> DataFrame:
    return grid_plans.product_options(grid(t)[1].where("option_values IS NOT NULL"))


@query("stored_page", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50 OFFSET 2450")
def stored_page(t: Tables) -> DataFrame:
    """Page 50 of all line items by price; it opens the ranges that hold it."""
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    folder = pages.store_pages(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), order)
    return pages.read_page(t.spark, folder, page=50)


@query("feed_report", """
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS source, '/api/' || event_type AS endpoint, 'POST' AS method, CASE WHEN event_id % 3 <> 0 THEN 'P' || user_id ELSE '' END AS sku, '' AS title, CASE WHEN event_id % 4 = 0 THEN 'false' ELSE 'true' END AS success,
  'm' || event_id AS message, CASE WHEN event_id % 5 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS product_id, '' AS variant_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS received_at, props AS request_payload, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS normalized_payload
FROM events ORDER BY date_trunc('second', ts) DESC, event_id DESC LIMIT 1000""")
def feed_report(t: Tables) -> DataFrame:
    k = F.col("event_id")
    return reports.feed_report(t.events.select(
        k.alias("id"), F.col("event_type").alias("source"), F.concat(F.lit("/api/"), "event_type").alias("endpoint"), F.lit("POST").alias("method"), F.when(k % 3 != 0, p.code("P", "user_id")).alias("sku"),
        F.lit(None).cast("string").alias("title"), (k % 4 != 0).alias("success"), p.code("m", "event_id").alias("message"), F.when(k % 5 == 0, F.col("user_id")).alias("product_id"), F.lit(None).cast("long").alias("variant_id"),
        p.iso(F.col("ts")).alias("received_at"), F.col("props").alias("request_payload"), F.when(k % 2 == 0, F.col("props")).alias("normalized_payload"),
    ))


@query("request_log_report", """
SELECT CAST(event_id AS VARCHAR) AS id, 'shop' || (user_id % 3) AS shop_domain, CASE WHEN event_id % 3 = 0 THEN 'key-' || user_id ELSE '' END AS api_key_preview, 'GET' AS method, '/' || event_type AS path, '' AS query_string, CAST(200 + event_id % 3 * 100 AS VARCHAR) AS status_code,
  '/' || event_type AS route_path, CASE WHEN event_id % 2 = 0 THEN props ELSE '' END AS request_body, '' AS user_agent, '' AS source_ip, CAST(user_id AS VARCHAR) AS duration_ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at
FROM events ORDER BY date_trunc('second', ts) DESC, event_id DESC LIMIT 2000""")
def request_log_report(t: Tables) -> DataFrame:
    k, none = F.col("event_id"), F.lit(None).cast("string")
    path = F.concat(F.lit("/"), "event_type")
    return reports.request_log_report(t.events.select(
        k.alias("id"), F.concat(F.lit("shop"), (F.col("user_id") % 3).cast("string")).alias("shop_domain"), F.when(k % 3 == 0, p.code("key-", "user_id")).alias("api_key_preview"), F.lit("GET").alias("method"), path.alias("path"),
        none.alias("query_string"), (200 + k % 3 * 100).alias("status_code"), path.alias("route_path"), F.when(k % 2 == 0, F.col("props")).alias("request_body"), none.alias("user_agent"), none.alias("source_ip"),
        F.col("user_id").alias("duration_ms"), p.iso(F.col("ts")).alias("created_at"),
    ))
