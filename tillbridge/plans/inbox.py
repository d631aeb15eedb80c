"""Order inbox over orders, line items and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbridge.operators import orders
from tillbridge.plans import proxies as p
from tillbridge.plans.registry import Tables, query

SYNCED = "2024-01-01T00:00:00+00:00"

# changes: four per order; arrival is the order key. Half of the inbox, of every fifth order key, is of orders without a change
CHANGES_SQL = """
chg AS (
  SELECT o_orderkey AS seq, o_orderkey % 3 + 1 AS version, 'O' || (o_orderkey // 4) AS oid, CASE WHEN o_orderkey % 23 = 0 THEN 'orders/delete' WHEN o_orderkey % 2 = 0 THEN 'orders/create' ELSE '' END AS topic,
    o_orderkey % 29 = 0 AS redacted, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created, o_orderpriority, o_custkey,
    CASE WHEN o_custkey % 3 <> 0 THEN 'Ann' ELSE ' ' END AS cf, CASE WHEN o_custkey % 4 = 0 THEN 'Bill To' END AS bname, o_orderkey % 3 AS line_count FROM orders),
lat AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY seq DESC) AS r, bool_or(topic = 'orders/delete' OR redacted) OVER (PARTITION BY oid) AS ever_removed FROM chg),
last AS (SELECT *, topic = 'orders/delete' OR redacted AS removed FROM lat WHERE r = 1),
old AS (SELECT 'O' || k AS oid, k, CASE WHEN k % 3 = 0 THEN 'IMPORTED' WHEN k % 3 = 1 THEN 'pending ' ELSE 'ERROR' END AS st, strftime(TIMESTAMP '1990-01-01' + to_days(CAST(k % 20000 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS at_
  FROM (SELECT DISTINCT o_orderkey // 2 AS k FROM orders WHERE o_orderkey % 5 = 0))
"""


def changes(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = F.expr("o_orderkey div 4").cast("string")

    def line(n: int) -> F.Column:
        tax = F.array(
            F.struct(F.when(k % 7 == 0, "bad").otherwise("1.005").alias("price"), F.lit(None).cast("struct<shop_money:struct<amount:string>>").alias("price_set")),
            F.struct(F.lit("").alias("price"), F.struct(F.struct(F.lit("0.50").alias("amount")).alias("shop_money")).alias("price_set")),
        )
        return F.struct(
            F.when(k % 5 != 0, F.concat(k.cast("string"), F.lit(f"-{n}"))).otherwise(" ").alias("id"), F.lit("p").alias("product_id"), F.lit("v").alias("variant_id"),
            F.concat(F.lit(" S"), c.cast("string")).alias("sku"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("variant_title"), F.lit("V").alias("vendor"),
            (k % 4 + n).alias("quantity"), F.lit(None).cast("bigint").alias("current_quantity"), F.when(k % 11 == 0, "n/a").otherwise(p.money("o_totalprice").cast("string")).alias("price"),
            F.when(k % 3 == 0, "1.125").alias("total_discount"), tax.alias("tax_lines"), F.lit(10).cast("bigint").alias("grams"), F.lit(True).alias("requires_shipping"), F.lit("").alias("fulfillment_status"),
        )

    lines = F.slice(F.array(line(1), line(2)), F.lit(1), (k % 3).cast("int"))
    text = F.lit(None).cast("string")
    place = F.struct(
        text.alias("first_name"), F.lit(" Last ").alias("last_name"), F.when(c % 4 == 0, "Bill To").alias("name"), text.alias("company"), F.lit("1 Road").alias("address1"), text.alias("address2"),
        *[text.alias(x) for x in ("city", "province", "province_code", "country", "country_code", "zip", "phone")],
    )
    plain = {
        "id": text, "name": F.concat(F.lit("#"), number), "order_number": text, "confirmation_number": text, "created_at": p.iso(F.col("o_orderdate")),
        "updated_at": text, "processed_at": text, "cancelled_at": text, "closed_at": text, "financial_status": F.lower("o_orderstatus"), "fulfillment_status": text, "currency": F.lit("USD"),
        "subtotal_price": F.lit(""), "total_discounts": text, "shipping_price": text, "total_tax": text, "total_price": p.money("o_totalprice").cast("string"), "email": text, "phone": text,
        "customer_first_name": F.when(c % 3 != 0, "Ann").otherwise(" "), "customer_last_name": text, "note": F.repeat(F.lit("n"), (k % 600).cast("int")), "tags": text,
        "redacted": k % 29 == 0,
    }
    shipping = F.array(*[F.struct(text.alias("id"), F.lit(code).alias("code"), F.lit(title).alias("title"), text.alias("price"), text.alias("discounted_price")) for code, title in (("x", "Ground"), ("AIR", ""), ("", ""))])
    fields = plain | {"billing_address": place, "shipping_address": place, "line_items": lines, "shipping_lines": shipping}
    # cast field by field: of a cast struct no step can leave out what it does not read
    order = F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in T.DataType.fromDDL(orders.ORDER)])
    topic = F.when(k % 23 == 0, "orders/delete").when(k % 2 == 0, "orders/create").otherwise("")
    return t.orders.select(
        k.alias("seq"), (k % 3 + 1).alias("version"), F.concat(F.lit(" O"), number).alias("order_id"), text.alias("order_name"), topic.alias("topic"), order.alias("order"),
    )


@query("order_headers", f"""
WITH {CHANGES_SQL}
SELECT oid AS order_id, CASE WHEN seq % 600 <= 508 THEN seq % 600 END AS n, '#' || substr(oid, 2) AS invoice_no, created AS order_at, CASE WHEN cf <> ' ' THEN cf ELSE coalesce(bname, 'Last') END AS cust_name, coalesce(bname, 'Last') AS bill_name, 'Ground, AIR' AS ship_meth, total,
  CASE WHEN topic = '' THEN 'orders/updated' ELSE topic END AS src_event, CASE WHEN seq % 600 > 0 THEN least(254, seq % 600) END AS note1_length, CASE WHEN seq % 600 > 254 THEN least(254, seq % 600 - 254) END AS note2_length, seq % 600 > 508 AS truncated FROM chg""")
def order_headers(t: Tables) -> DataFrame:
    rows = orders.order_headers(changes(t), SYNCED)
    length = F.coalesce(F.length("NOTE1"), F.lit(0)) + F.coalesce(F.length("NOTE2"), F.lit(0))
    return rows.select(
        F.col("ORDER_ID").alias("order_id"), F.when(F.col("TRUNCATED"), F.lit(None)).otherwise(length).cast("bigint").alias("n"), F.col("INVOICE_NO").alias("invoice_no"), F.col("ORDER_AT").alias("order_at"),
        F.col("CUST_NAME").alias("cust_name"), F.col("BILL_NAME").alias("bill_name"), F.col("SHIP_METH").alias("ship_meth"), F.col("TOTAL").alias("total"), F.col("SRC_EVENT").alias("src_event"),
        F.length("NOTE1").cast("bigint").alias("note1_length"), F.length("NOTE2").cast("bigint").alias("note2_length"), F.col("TRUNCATED").alias("truncated"),
    )


@query("order_lines", f"""
WITH {CHANGES_SQL},
l AS (SELECT chg.*, i FROM chg, range(1, 3) r(i) WHERE i <= line_count)
SELECT oid AS order_id, seq, CAST(i AS INTEGER) AS line_no, CASE WHEN seq % 5 <> 0 THEN seq || '-' || i ELSE 'line-' || i END AS line_key, seq % 4 + i AS qty, CASE WHEN seq % 11 = 0 THEN 'n/a' ELSE total END AS unit_price,
  CASE WHEN seq % 3 = 0 THEN '1.12' END AS discount, CASE WHEN seq % 7 = 0 THEN '0.50' ELSE '1.50' END AS tax,
  CASE WHEN seq % 11 <> 0 THEN CAST(CAST(CAST(total AS DECIMAL(18,2)) * (seq % 4 + i) - CASE WHEN seq % 3 = 0 THEN 1.12 ELSE 0 END AS DECIMAL(18,2)) AS VARCHAR) END AS extension, true AS truncated FROM l""")
def order_lines(t: Tables) -> DataFrame:
    rows = orders.order_lines(changes(t).withColumn("order_name", F.col("seq").cast("string")).withColumn("order", F.col("order").withField("name", F.lit(""))))
    return rows.select(
        F.col("ORDER_ID").alias("order_id"), F.col("INVOICE_NO").cast("bigint").alias("seq"), F.col("LINE_NO").alias("line_no"), F.col("LINE_KEY").alias("line_key"), F.col("QTY").alias("qty"), F.col("UNIT_PRICE").alias("unit_price"),
        F.col("DISCOUNT").alias("discount"), F.col("TAX").alias("tax"), F.col("EXTENSION").alias("extension"), F.col("TRUNCATED").alias("truncated"),
    )


def inbox(t: Tables) -> tuple[DataFrame, DataFrame]:
    """An existing inbox with two lines per order."""
    k = F.col("k")
    keys = t.orders.where("o_orderkey % 5 = 0").selectExpr("o_orderkey div 2 AS k").distinct()
    status = F.when(k % 3 == 0, "IMPORTED").when(k % 3 == 1, "pending ").otherwise("ERROR")
    day = F.date_add(F.lit("1990-01-01").cast("date"), (k % 20000).cast("int")).cast("timestamp_ntz")
    text = F.lit(None).cast("string")
    heads = keys.select(
        F.concat(F.lit("O"), k.cast("string")).alias("ORDER_ID"), F.lit("g1").alias("GEN_ID"), p.iso(day).alias("ORDER_AT"), F.lit(SYNCED).alias("SYNCED_AT"),
        text.alias("CANCEL_AT"), F.lit("PRINTED").alias("PRINT_ST"), text.alias("PRINTED_AT"), status.alias("IMPORT_ST"), text.alias("IMPORTEDAT"), F.concat(F.lit("N"), k.cast("string")).alias("POS_ORD_NO"),
        text.alias("IMP_ERROR"), F.lit("0").alias("TOTAL"), F.lit(1).cast("bigint").alias("SRC_VER"), F.lit(2).cast("bigint").alias("LINE_COUNT"), F.lit(False).alias("TRUNCATED"),
    )
    lines = heads.select("ORDER_ID", "GEN_ID", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("LINE_KEY"), F.lit(1).cast("bigint").alias("SRC_VER"), F.lit(False).alias("TRUNCATED"))
    return heads, lines


UPSERT_SQL = CHANGES_SQL + """,
heads AS (
  SELECT oid, st AS import_st, 'N' || k AS pos_ord_no, 'PRINTED' AS print_st, '0' AS total, at_, st AS retain_as FROM old WHERE oid NOT IN (SELECT oid FROM last)
  UNION ALL
  SELECT l.oid, coalesce(o.st, 'PENDING'), CASE WHEN o.oid IS NOT NULL THEN 'N' || o.k END, CASE WHEN o.oid IS NOT NULL THEN 'PRINTED' ELSE 'PENDING' END, total, created,
    CASE WHEN o.oid IS NOT NULL AND NOT ever_removed THEN o.st ELSE 'PENDING' END
  FROM last l LEFT JOIN old o ON o.oid = l.oid WHERE NOT removed)
"""


@query("upsert_orders", f"WITH {UPSERT_SQL} SELECT oid AS order_id, import_st, pos_ord_no, print_st, total, retain_as FROM heads")
def upsert_orders(t: Tables) -> DataFrame:
    heads, _ = orders.upsert_orders(*inbox(t), changes(t), SYNCED)
    return heads.select(*[F.col(c).alias(c.lower()) for c in ("ORDER_ID", "IMPORT_ST", "POS_ORD_NO", "PRINT_ST", "TOTAL", "RETAIN_AS")])


@query("upsert_order_lines", f"""
WITH {UPSERT_SQL}
SELECT oid AS order_id, count(*) AS lines FROM (
  SELECT oid FROM old, range(1, 3) WHERE oid NOT IN (SELECT oid FROM last) UNION ALL SELECT oid FROM last, range(1, 3) r(i) WHERE NOT removed AND i <= line_count) GROUP BY 1""")
def upsert_order_lines(t: Tables) -> DataFrame:
    _, lines = orders.upsert_orders(*inbox(t), changes(t), SYNCED)
    return lines.groupBy(F.col("ORDER_ID").alias("order_id")).agg(F.count(F.lit(1)).alias("lines"))


RETAIN_SQL = UPSERT_SQL + """,
prot AS (SELECT oid FROM old WHERE upper(trim(st)) <> 'IMPORTED' AND k < 60),
cl AS (SELECT *, CASE WHEN upper(trim(retain_as)) = 'IMPORTED' THEN 3 WHEN oid IN (SELECT oid FROM prot) THEN 1 ELSE 2 END AS cls FROM heads),
rk AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY CASE WHEN cls <> 3 THEN at_ END, CASE WHEN cls <> 3 THEN oid END, CASE WHEN cls = 3 THEN at_ END DESC, CASE WHEN cls = 3 THEN oid END DESC) AS r FROM cl),
n1 AS (SELECT count(*) AS n FROM cl WHERE cls = 1), n2 AS (SELECT least(count(*), greatest(0, {limit} - (SELECT n FROM n1))) AS n FROM cl WHERE cls = 2),
ret AS (SELECT oid, cls FROM rk WHERE cls = 1 OR (cls = 2 AND r <= {limit} - (SELECT n FROM n1)) OR (cls = 3 AND r <= {limit} - (SELECT n FROM n1) - (SELECT n FROM n2)))
"""


def retained(t: Tables, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    heads, lines = orders.upsert_orders(*inbox(t), changes(t), SYNCED)
    number = F.substring("ORDER_ID", 2, 20).cast("bigint")
    protected = inbox(t)[0].where(~orders.imported() & (number < 60)).select("ORDER_ID")
    kept, kept_lines = orders.retain_orders(heads, lines, limit, protected, status="RETAIN_AS")
    return heads, kept, kept_lines


@query("retain_orders", f"WITH {RETAIN_SQL.replace('{limit}', '250')} SELECT oid AS order_id FROM ret")
def retain_orders(t: Tables) -> DataFrame:
    return retained(t, 250)[1].select(F.col("ORDER_ID").alias("order_id"))


@query("retain_many_orders", f"WITH {RETAIN_SQL.replace('{limit}', '1000000')} SELECT CAST(cls AS INTEGER) AS cls, count(*) AS orders FROM ret GROUP BY 1")
def retain_many_orders(t: Tables) -> DataFrame:
    """A limit above the inbox size keeps everything."""
    _, kept, _ = retained(t, 1_000_000)
    number = F.substring("ORDER_ID", 2, 20).cast("bigint")
    protected = inbox(t)[0].where(~orders.imported() & (number < 60)).select("ORDER_ID", F.lit(True).alias("p"))
    rows = kept.join(protected, "ORDER_ID", "left")
    cls = F.when(orders.imported("RETAIN_AS"), 3).when(F.col("p"), 1).otherwise(2)
    return rows.groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("orders"))


@query("delivered_orders", f"""
WITH {RETAIN_SQL.replace('{limit}', '250')}
SELECT l.oid AS order_id, l.removed OR l.oid IN (SELECT oid FROM ret) OR coalesce(upper(trim(h.retain_as)) = 'IMPORTED', false) AS delivered FROM last l LEFT JOIN heads h ON h.oid = l.oid""")
def delivered_orders(t: Tables) -> DataFrame:
    heads, kept, _ = retained(t, 250)
    return orders.delivered_orders(changes(t), kept, heads).select(F.col("ORDER_ID").alias("order_id"), "delivered")


# headers from orders, lines from line items; both carry deliberate faults
FAULTS_SQL = """
h AS (SELECT CASE WHEN o_orderkey % 101 = 0 THEN ' ' WHEN o_orderkey % 103 = 0 THEN 'é' || o_orderkey ELSE 'O' || o_orderkey END AS oid, o_orderkey % 9 AS declared, 'g1' AS g FROM orders WHERE o_orderkey % 7 <> 0),
l AS (SELECT 'O' || l_orderkey AS oid, CASE WHEN l_suppkey % 50 = 0 THEN '' ELSE 'k' || l_linenumber END AS line_key FROM lineitem),
hc AS (SELECT trim(oid) AS oid, count(*) AS n, max(declared) AS declared FROM h GROUP BY 1), lc AS (SELECT oid, count(*) AS n FROM l GROUP BY 1)
"""


@query("order_integrity", f"""
WITH {FAULTS_SQL}
SELECT 'missing_order_id' AS problem, oid AS order_id, '' AS value FROM hc WHERE oid = ''
UNION ALL SELECT 'bad_order_id', oid, '' FROM hc WHERE oid LIKE 'é%'
UNION ALL SELECT 'orphan_lines', oid, CAST(n AS VARCHAR) FROM lc WHERE oid NOT IN (SELECT oid FROM hc)
UNION ALL SELECT 'duplicate_line_key', oid, line_key FROM l GROUP BY oid, line_key HAVING count(*) > 1 OR line_key = ''
UNION ALL SELECT 'line_count_mismatch', hc.oid, CAST(coalesce(lc.n, 0) AS VARCHAR) FROM hc LEFT JOIN lc USING (oid) WHERE declared <> coalesce(lc.n, 0)
UNION ALL SELECT 'mixed_generations', '', ''""")
def order_integrity(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    heads = t.orders.where("o_orderkey % 7 <> 0").select(
        F.when(k % 101 == 0, " ").when(k % 103 == 0, p.code("é", "o_orderkey")).otherwise(p.code("O", "o_orderkey")).alias("ORDER_ID"), (k % 9).alias("LINE_COUNT"), F.lit("g1").alias("GEN_ID"),
    )
    lines = t.lineitem.select(
        p.code("O", "l_orderkey").alias("ORDER_ID"), F.when(F.col("l_suppkey") % 50 == 0, "").otherwise(p.code("k", "l_linenumber")).alias("LINE_KEY"), F.when(F.col("l_suppkey") % 2 == 0, "g1").otherwise("g2").alias("GEN_ID"),
    )
    return orders.check_order_integrity(heads, lines)


def plain_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    heads = t.orders.select(
        p.code("O", "o_orderkey").alias("ORDER_ID"), F.lit("old").alias("GEN_ID"), F.when(k % 5 == 0, "IMPORTED").otherwise("PENDING").alias("IMPORT_ST"), F.when(k % 7 == 0, "2024").alias("CANCEL_AT"),
        (k % 11 == 0).alias("TRUNCATED"), (k % 3).alias("SRC_VER"), (k % 6).alias("LINE_COUNT"),
    )
    lines = t.lineitem.select(
        p.code("O", "l_orderkey").alias("ORDER_ID"), F.when(F.col("l_suppkey") % 40 == 0, "older").otherwise("old").alias("GEN_ID"), (F.col("l_tax") > 0.07).alias("TRUNCATED"),
        F.when(F.col("l_linenumber") == 1, F.lit(9).cast("bigint")).alias("SRC_VER"), *p.LINE_ARRIVAL,
    )
    return heads, lines


@query("stamp_generation", """
SELECT 'O' || o_orderkey AS order_id, 'gen-2' AS gen_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS line_count, (SELECT CAST(sum(CASE WHEN l_linenumber = 1 THEN 9 ELSE o_orderkey % 3 END) AS BIGINT) FROM lineitem WHERE l_orderkey = o_orderkey) AS versions FROM orders""")
def stamp_generation(t: Tables) -> DataFrame:
    heads, lines = orders.stamp_generation(*plain_tables(t), "gen-2")
    sums = lines.groupBy("ORDER_ID").agg(F.sum("SRC_VER").alias("versions"))
    return heads.join(sums, "ORDER_ID", "left").select(F.col("ORDER_ID").alias("order_id"), F.col("GEN_ID").alias("gen_id"), F.col("LINE_COUNT").alias("line_count"), "versions")


@query("importable_orders", """
WITH l AS (SELECT l_orderkey, count(*) AS n, bool_or(l_tax > 0.07) AS cut, bool_or(l_suppkey % 40 = 0) AS mixed FROM lineitem GROUP BY 1)
SELECT 'O' || o_orderkey AS order_id FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND coalesce(n, 0) = o_orderkey % 6 AND NOT coalesce(cut, false) AND NOT coalesce(mixed, false) AND o_orderkey % 13 <> 0""")
def importable_orders(t: Tables) -> DataFrame:
    already = t.orders.where("o_orderkey % 13 = 0").select(p.code("O", "o_orderkey").alias("ORDER_ID"))
    return orders.importable_orders(*plain_tables(t), already).select(F.col("ORDER_ID").alias("order_id"))


@query("backfill_legacy_orders", """
WITH i AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS g FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY g) AS line_no FROM i)
SELECT 'O' || l_orderkey AS order_id, line_no, CASE WHEN l_suppkey % 4 = 0 THEN 'line-' || line_no ELSE 'K' || l_suppkey END AS line_key,
  CASE WHEN l_suppkey % 3 = 0 THEN '7.50' ELSE CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS BIGINT) - CAST(l_discount AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS VARCHAR) END AS extension,
  CASE WHEN o_orderkey IS NOT NULL THEN '#' || o_orderkey END AS invoice_no FROM n LEFT JOIN orders ON o_orderkey = l_orderkey""")
def backfill_legacy_orders(t: Tables) -> DataFrame:
    from tillbridge.operators.ordering import with_global_index

    heads = t.orders.select(p.code("O", "o_orderkey").alias("order_id"), p.code("#", "o_orderkey").alias("order_name"), F.lit(1).alias("source_version"), F.lit("note").alias("note"))
    items = with_global_index(t.lineitem, p.LINE_ARRIVAL, "rowid").select(
        p.code("O", "l_orderkey").alias("order_id"), F.when(F.col("l_suppkey") % 4 == 0, " ").otherwise(p.code("K", "l_suppkey")).alias("line_key"), F.col("l_quantity").cast("bigint").alias("quantity"),
        p.money("l_extendedprice").cast("string").alias("price"), p.money("l_discount").cast("string").alias("total_discount"), F.when(F.col("l_suppkey") % 3 == 0, "7.50").alias("line_total"), "rowid",
    )
    header_names = {"ORDER_ID": "order_id", "INVOICE_NO": "order_name", "SRC_VER": "source_version", "PRINT_ST": "print_status", "IMPORT_ST": "import_status"}
    line_names = {"ORDER_ID": "order_id", "LINE_KEY": "line_key", "QTY": "quantity", "UNIT_PRICE": "price", "DISCOUNT": "total_discount", "EXTENSION": "line_total"}
    _, lines = orders.backfill_legacy_orders(heads, items, header_names, line_names, "rowid")
    return lines.select(F.col("ORDER_ID").alias("order_id"), F.col("LINE_NO").cast("bigint").alias("line_no"), F.col("LINE_KEY").alias("line_key"), F.col("EXTENSION").alias("extension"), F.col("INVOICE_NO").alias("invoice_no"))


@query("purge_orders", """
SELECT 'headers' AS kind, count(*) AS rows FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey % 9 <> 0""")
def purge_orders(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderkey % 9 = 0").select(p.code(" O", "o_orderkey").alias("ORDER_ID"))
    left = orders.purge_orders(gone, *plain_tables(t))
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("kind"), "rows") for kind, df in zip(("headers", "lines"), left)]
    return counts[0].unionByName(counts[1])


@query("fit_fixed_width", """
SELECT doc_id, nullif(rtrim(substr(regexp_replace(text, '[^\\x{00}-\\x{7f}\\x{a0}-\\x{ff}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]', '?', 'g'), 1, 40), ' '), '') AS title_cut, CASE WHEN n_chars < 100000 THEN CAST(round_even(CAST(n_chars * 0.125 AS DECIMAL(18,3)), 2) AS DECIMAL(18,2))::VARCHAR ELSE 'wide' END AS amount,
  CASE WHEN doc_id % 3 = 0 THEN 'T' WHEN doc_id % 3 = 1 THEN 'F' ELSE '?' END AS flag, CASE WHEN doc_id % 2 = 0 THEN '20240229' END AS day,
  CASE WHEN length(text) > 40 OR regexp_matches(text, '[^\\x{00}-\\x{7f}\\x{a0}-\\x{ff}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]') OR (n_chars % 8) NOT IN (0, 2, 4, 6) OR (n_chars % 2) <> 0 OR doc_id % 2 <> 0 THEN 'T' ELSE 'F' END AS truncated FROM documents""")
def fit_fixed_width(t: Tables) -> DataFrame:
    layout = [("DOC", "N", 12, 0), ("TITLE", "C", 40, 0), ("AMOUNT", "N", 12, 2), ("FLAG", "L", 1, 0), ("DAY", "D", 8, 0)]
    k = F.col("doc_id")
    rows = t.documents.select(
        k.alias("DOC"), F.col("text").alias("TITLE"), (F.col("n_chars") * F.lit(0.125).cast("decimal(4,3)")).alias("AMOUNT"), F.when(k % 3 == 0, "yes").when(k % 3 == 1, "0").alias("FLAG"), F.when(k % 2 == 0, "2024-02-29").otherwise("2023-02-29").alias("DAY"),
    )
    out = orders.fit_fixed_width(rows, layout)
    return out.select(
        F.col("DOC").cast("bigint").alias("doc_id"), F.col("TITLE").alias("title_cut"), F.col("AMOUNT").alias("amount"), F.col("FLAG").alias("flag"), F.col("DAY").alias("day"), F.col("TRUNCATED").alias("truncated"),
    )
