"""DBF files and streams, fed from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.functions.money import decimal_or_none, stock_quantity
from tillbridge.operators import orders, reports
from tillbridge.plans import inbox as order_inbox
from tillbridge.plans import proxies as p
from tillbridge.plans.online import STABLE_SQL
from tillbridge.plans.registry import Tables, query
from tillbridge.session import scratch_path
from tillbridge.sources import dbf, profile
from tillbridge.streaming import folds, inbox

ITEM_LAYOUT = [("SKU", "C", 16, 0), ("DESC", "C", 30, 0), ("PRICE", "N", 12, 2), ("QTY", "N", 8, 0), ("SELLWEB", "L", 1, 0), ("LAST_ACT", "D", 8, 0)]


def item_files(t: Tables, table: str = "Item") -> str:
    """Parts fitted to a layout and written as DBF files, one per task."""
    k = F.col("p_partkey")
    rows = t.part.select(
        p.code("P", "p_partkey").alias("SKU"), F.when(k % 5 != 0, F.col("p_name")).alias("DESC"), F.col("p_retailprice").cast("decimal(18,2)").alias("PRICE"), F.col("p_size").alias("QTY"),
        (k % 2 == 0).alias("SELLWEB"), F.lit("2024-02-29").alias("LAST_ACT"),
    )
    path = scratch_path(t.spark, "dbf")
    dbf.write_dbf(orders.fit_fixed_width(rows, ITEM_LAYOUT), path, ITEM_LAYOUT, table)
    return path


ITEM_SQL = """
SELECT 'P' || p_partkey AS sku, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS descr, CAST(p_retailprice AS DECIMAL(12,2)) AS price, CAST(p_size AS DECIMAL(8,0)) AS qty, p_partkey % 2 = 0 AS sellweb"""


def named(rows: DataFrame) -> DataFrame:
    rows = rows.drop(*[c for c in rows.columns if c.startswith("_raw_")])  # all null: the files are fitted
    return rows.withColumnsRenamed({"SKU": "sku", "DESC": "descr", "PRICE": "price", "QTY": "qty", "SELLWEB": "sellweb", "LAST_ACT": "last_act"}).drop("_rec_no", "_file", "_reset")


@query("dbf_scan", f"{ITEM_SQL}, '2024-02-29' AS last_act FROM part")
def dbf_scan(t: Tables) -> DataFrame:
    return named(dbf.read_dbf(t.spark, item_files(t)))


@query("dbf_exact_numbers", """
SELECT 'P' || p_partkey AS sku, CAST(CASE p_partkey % 4 WHEN 0 THEN CAST('12.3451' AS DECIMAL(38,4)) WHEN 1 THEN 100 WHEN 2 THEN CAST('123456789012345678' AS DECIMAL(38,4)) + p_partkey ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS DECIMAL(38,4)) AS exact,
  CASE p_partkey % 4 WHEN 0 THEN '12.35' WHEN 1 THEN '100.00' WHEN 2 THEN CAST(123456789012345678 + p_partkey AS VARCHAR) || '.00' ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
  CAST(CASE p_partkey % 3 WHEN 0 THEN 13 WHEN 1 THEN p_size END AS INTEGER) AS stock FROM part""")
def dbf_exact_numbers(t: Tables) -> DataFrame:
    """Numbers beyond what their fields declare: more decimals, an exponent, more digits, and text."""
    k = F.col("p_partkey")
    price = F.when(k % 4 == 0, "12.3451").when(k % 4 == 1, "1E2").when(k % 4 == 2, (F.lit(123456789012345678) + k).cast("string")).otherwise(p.money("p_retailprice").cast("string"))
    quantity = F.when(k % 3 == 0, "13.5").when(k % 3 == 1, F.col("p_size").cast("string")).otherwise("n/a")
    layout = [("SKU", "C", 16, 0), ("PRICE", "N", 19, 2), ("QTY", "N", 8, 0)]
    path = scratch_path(t.spark, "dbf")
    dbf.write_dbf(t.part.select(p.code("P", "p_partkey").alias("SKU"), price.alias("PRICE"), quantity.alias("QTY")), path, layout, "Item")
    rows = dbf.read_exact_dbf(t.spark, path)
    exact = F.col("PRICE").cast("decimal(38,4)")
    return rows.select(
        F.col("SKU").alias("sku"), exact.alias("exact"), F.bround(exact, 2).cast("decimal(38,2)").cast("string").alias("price"),
        stock_quantity(decimal_or_none(F.col("QTY"))).alias("stock"),
    )


@query("core_export", """
SELECT 'Item' AS table, (SELECT count(*) FROM part) AS records, least(1000, (SELECT count(*) FROM part)) AS rows_written, (SELECT count(*) FROM part) > 1000 AS truncated, '' AS sensitive_columns
UNION ALL SELECT 'Customer', (SELECT count(*) FROM customer), least(1000, (SELECT count(*) FROM customer)), (SELECT count(*) FROM customer) > 1000, 'EMAIL;PHONE'""")
def core_export(t: Tables) -> DataFrame:
    paths = {"Item": item_files(t), "Customer": scratch_path(t.spark, "dbf")}
    layout = [("CUST_NUM", "C", 16, 0), ("EMAIL", "C", 40, 0), ("PHONE", "C", 20, 0)]
    people = t.customer.select(p.code("C", "c_custkey").alias("CUST_NUM"), F.concat(p.code("c", "c_custkey"), F.lit("@x.com")).alias("EMAIL"), p.code("+1", "c_custkey").alias("PHONE"))
    dbf.write_dbf(orders.fit_fixed_width(people, layout), paths["Customer"], layout, "Customer")
    first, second = (profile.profile_tables(t.spark, path) for path in paths.values())
    return reports.export_core_tables(first.unionByName(second), lambda name: dbf.read_dbf(t.spark, paths[name]), scratch_path(t.spark, "core-export"), 1000)


def published_orders(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The inbox after the changes, one generation, fitted."""
    stamped = orders.stamp_generation(*orders.upsert_orders(*order_inbox.inbox(t), order_inbox.changes(t), order_inbox.SYNCED), "gen-1")
    return tuple(orders.fit_fixed_width(rows, layout) for rows, layout in zip(stamped, (orders.HEADER_LAYOUT, orders.DETAIL_LAYOUT)))


@query("order_header_file", f"""
WITH {order_inbox.UPSERT_SQL}
SELECT oid AS order_id, 'gen-1' AS gen_id, trim(import_st) AS import_st, pos_ord_no, at_ AS order_at, CAST(total AS DECIMAL(18,2)) AS total,
  CAST(CASE WHEN l.oid IS NULL THEN 2 ELSE line_count END AS DECIMAL(6,0)) AS line_count, coalesce(seq % 600 > 508, false) AS truncated
FROM heads LEFT JOIN (SELECT oid, seq, line_count FROM last WHERE NOT removed) l USING (oid)""")
def order_header_file(t: Tables) -> DataFrame:
    """Headers published in their real layout and read back strictly; a record has 3,409 bytes, mostly blank, so the files are compressed."""
    path = scratch_path(t.spark, "order-headers")
    dbf.write_dbf(published_orders(t)[0], path, orders.HEADER_LAYOUT, "webhdr", compression="zstd")
    rows = dbf.read_dbf(t.spark, path, mode="strict", layout=dbf.layout_text(orders.HEADER_LAYOUT), compression="zstd")
    return rows.select(*[F.col(c).alias(c.lower()) for c in ("ORDER_ID", "GEN_ID", "IMPORT_ST", "POS_ORD_NO", "ORDER_AT", "TOTAL", "LINE_COUNT", "TRUNCATED")])


@query("order_detail_file", f"""
WITH {order_inbox.UPSERT_SQL}
SELECT oid AS order_id, 'gen-1' AS gen_id, CASE WHEN i = 1 THEN 'a' ELSE 'b' END AS line_key, NULL AS line_no, NULL AS qty, NULL AS unit_price, CAST(1 AS DECIMAL(10,0)) AS src_ver FROM old, range(1, 3) r(i) WHERE oid NOT IN (SELECT oid FROM last)
UNION ALL SELECT oid, 'gen-1', CASE WHEN seq % 5 <> 0 THEN seq || '-' || i ELSE 'line-' || i END, CAST(i AS DECIMAL(6,0)), CAST(seq % 4 + i AS DECIMAL(10,0)), CASE WHEN seq % 11 <> 0 THEN CAST(total AS DECIMAL(18,2)) END, CAST(version AS DECIMAL(10,0))
FROM last, range(1, 3) r(i) WHERE NOT removed AND i <= line_count""")
def order_detail_file(t: Tables) -> DataFrame:
    """Lines published in their real layout and read back strictly."""
    path = scratch_path(t.spark, "order-details")
    dbf.write_dbf(published_orders(t)[1], path, orders.DETAIL_LAYOUT, "webdtl")
    rows = dbf.read_dbf(t.spark, path, mode="strict", layout=dbf.layout_text(orders.DETAIL_LAYOUT))
    return rows.select(*[F.col(c).alias(c.lower()) for c in ("ORDER_ID", "GEN_ID", "LINE_KEY", "LINE_NO", "QTY", "UNIT_PRICE", "SRC_VER")])


@query("manifest_report", """
SELECT 'products_inventory' AS category, CAST(sum(1) AS BIGINT) AS records, 'SKU;DESC;PRICE;QTY;SELLWEB;LAST_ACT' AS fields, '6' AS field_count, '76' AS record_length, '' AS sensitive_fields, '' AS error FROM part""")
def manifest_report(t: Tables) -> DataFrame:
    """The report of item files, their records summed: their number is that of the writing tasks."""
    rows = reports.manifest_report(profile.profile_tables(t.spark, item_files(t)))
    same = ("category", "fields", "field_count", "record_length", "sensitive_fields", "error")
    return rows.groupBy(*same).agg(F.sum(F.col("records").cast("long")).alias("records")).where("records > 0")


@query("dbf_strict_scan", f"{ITEM_SQL}, DATE '2024-02-29' AS last_act FROM part")
def dbf_strict_scan(t: Tables) -> DataFrame:
    return named(dbf.read_dbf(t.spark, item_files(t), mode="strict", layout=dbf.layout_text(ITEM_LAYOUT)))


@query("dbf_key_filter", "SELECT 'P' || p_partkey AS sku, CAST(p_size AS DECIMAL(8,0)) AS qty FROM part WHERE p_partkey IN (3, 50, 77)")
def dbf_key_filter(t: Tables) -> DataFrame:
    rows = dbf.read_dbf(t.spark, item_files(t), columns="SKU,QTY").where(F.col("SKU").isin("P3", "P50", "P77"))
    return named(rows)


@query("dbf_selected_rows", "SELECT 'P' || p_partkey AS sku, CAST(p_size AS DECIMAL(8,0)) AS qty FROM part WHERE p_size = 7")
def dbf_selected_rows(t: Tables) -> DataFrame:
    wanted = t.part.where("p_size = 7").select(p.code("P", "p_partkey").alias("key"))
    return named(dbf.read_selected(t.spark, item_files(t), "SKU", wanted, ["QTY"]))


@query("dbf_appended_rows", f"{ITEM_SQL}, '2024-02-29' AS last_act FROM part")
def dbf_appended_rows(t: Tables) -> DataFrame:
    """Event files streamed from their first record."""
    landed = inbox.drain(dbf.read_dbf_stream(t.spark, item_files(t), startingRecord="0"), "appended", mode="append")
    return named(landed.drop("batch"))


@query("profile_tables", """
SELECT 'products_inventory' AS category, 'Item' AS name, CAST(count(*) AS BIGINT) AS records, 'LAST_ACT' AS last_field, '' AS sensitive FROM part""")
def profile_tables(t: Tables) -> DataFrame:
    rows = profile.profile_tables(t.spark, item_files(t))
    return rows.groupBy("category", F.substring_index("table", "-", 1).alias("name")).agg(
        F.sum("records").alias("records"), F.max(F.element_at("fields", -1)).alias("last_field"), F.max(F.concat_ws(";", "sensitive_fields")).alias("sensitive"),
    )


@query("category_totals", "SELECT 'products_inventory' AS category, count(*) AS records, CAST(0 AS BIGINT) AS sensitive_tables FROM part")
def category_totals(t: Tables) -> DataFrame:
    return profile.category_totals(profile.profile_tables(t.spark, item_files(t))).drop("tables")


def event_stream(t: Tables) -> DataFrame:
    """The event table as a stream; the input limit bounds what a key may bring at once."""
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet")
    return source.option("maxBytesPerTrigger", 1 << 30).parquet(t.folder)


@query("stream_fold_inventory", f"""
WITH {p.FOLD_SQL} SELECT shop || '/' || item AS key, version, quantity FROM folded""")
def stream_fold_inventory(t: Tables) -> DataFrame:
    rows = event_stream(t)
    at = p.micros(F.col("ts")) - (F.col("event_id") % 7) * 3_600_000_000
    keyed = rows.select(
        F.concat(F.lit("shop"), (F.col("user_id") % 3).cast("string"), F.lit("/I"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 11 != 0, at).alias("at"), F.floor("value").cast("bigint").alias("quantity"),
    )
    return inbox.current_rows(inbox.drain(folds.fold_inventory_stream(keyed), "fold"), "key").select("key", "version", "quantity")


@query("stream_fold_orders", """
SELECT user_id, count(*) AS version, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def stream_fold_orders(t: Tables) -> DataFrame:
    return inbox.current_rows(inbox.drain(folds.fold_order_stream(event_stream(t), "user_id", "event_id", "event_type"), "orders"), "user_id")


@query("stream_stable_payloads", f"""
WITH {STABLE_SQL}, n AS (SELECT sku, scan, row_number() OVER (PARTITION BY sku, g ORDER BY scan) AS observations FROM gr)
SELECT *, observations >= 2 AS ready FROM n""")
def stream_stable_payloads(t: Tables) -> DataFrame:
    rows = event_stream(t).select(
        F.concat(F.lit("S"), (F.col("user_id") % 60).cast("string")).alias("sku"), F.col("event_id").alias("scan"), F.when(F.col("value") < 30, "a").otherwise(F.col("event_type")).alias("title"),
    )
    return inbox.drain(folds.stable_payload_stream(rows, ["title"]), "stable", mode="append").select("sku", "scan", "observations", "ready")


@query("stream_repair_stage")
def stream_repair_stage(t: Tables) -> DataFrame:
    """Repair events per base; checked against a plain fold in the tests."""
    k, u = F.col("event_id"), F.col("user_id")

    def one_of(column, *values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (column + 1).cast("int"))

    rows = event_stream(t).select(
        p.code("B", "user_id").alias("base"), k.alias("seq"), one_of(k % 3, "scan", "payload", "result").alias("kind"), F.when(F.col("value") < 60, "x").otherwise("y").alias("print"),
        one_of(F.floor("value") % 3, "correct", "scalar", "blocked").alias("shape"), one_of(F.floor("value") % 4, "repaired", "quantity_mismatch", "blocked", "failed").alias("status"),
        (k % 2 == 0).alias("confirmed"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )
    return inbox.drain(folds.repair_stage_stream(rows), "stages", mode="append").drop("batch")
