"""The supplied tables seen as till and storefront tables.

Parts stand for items, suppliers for vendors, line items for quantity rows and
order lines, events for change streams. Each ``*_SQL`` text is the same view
for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.plans.registry import Tables

# arrival order of line items; no two rows share all of it
LINE_ARRIVAL = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
LINE_ARRIVAL_SQL = "(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def code(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def micros(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp"))


def iso(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# -- two-sided stock ---------------------------------------------------------

def stock_sides(t: Tables) -> DataFrame:
    """One aggregate with every side of a part's stock."""
    quantity = F.col("l_quantity").cast("bigint")

    def total(condition: str) -> Column:
        return F.sum(F.when(F.expr(condition), quantity))

    return t.lineitem.groupBy(code("P", "l_partkey").alias("sku")).agg(
        total("l_linestatus = 'F'").alias("pos_quantity"), total("l_linestatus = 'O'").alias("shop_quantity"),
        total("l_returnflag = 'N'").alias("canonical"),
        total("l_returnflag = 'N' AND l_linestatus = 'F'").alias("pos_seen"),
        total("l_returnflag = 'N' AND l_linestatus = 'O'").alias("shop_seen"),
        F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("last_at"),
    )


SIDES_SQL = """
sides AS (
  SELECT 'P' || l_partkey AS sku,
    CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'F') AS BIGINT) AS pos_quantity,
    CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'O') AS BIGINT) AS shop_quantity,
    CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'N') AS BIGINT) AS canonical,
    CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS BIGINT) AS pos_seen,
    CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS BIGINT) AS shop_seen,
    count(*) AS n, max(l_shipdate) AS last_at
  FROM lineitem GROUP BY 1),
pos AS (SELECT sku, pos_quantity FROM sides WHERE pos_quantity IS NOT NULL),
shop AS (SELECT sku, shop_quantity, strftime(last_at, '%Y-%m-%dT%H:%M:%SZ') AS shop_at FROM sides WHERE shop_quantity IS NOT NULL),
state AS (
  SELECT sku, canonical, pos_seen, shop_seen, n % 5 AS revision,
    n % 11 = 0 AS has_shop_action, n % 13 = 0 AS has_pos_action
  FROM sides WHERE canonical IS NOT NULL AND n % 3 <> 0)
"""


def pos_side(t: Tables) -> DataFrame:
    return stock_sides(t).where("pos_quantity IS NOT NULL").select("sku", "pos_quantity")


def shop_side(t: Tables) -> DataFrame:
    return stock_sides(t).where("shop_quantity IS NOT NULL").select("sku", "shop_quantity", iso(F.col("last_at")).alias("shop_at"))


def stock_state(t: Tables) -> DataFrame:
    n = F.col("n")
    shop = F.struct(F.lit(1).alias("delta"), F.lit(10).alias("target"), F.concat(F.lit("s"), F.col("sku")).alias("key"))
    pos = F.struct(F.lit(-1).alias("delta"), F.lit(10).alias("target"), F.lit(11).alias("expected"), F.concat(F.lit("p"), F.col("sku")).alias("key"))
    return stock_sides(t).where("canonical IS NOT NULL AND n % 3 <> 0").select(
        "sku", "canonical", "pos_seen", "shop_seen", F.lit(None).cast("string").alias("shop_seen_at"), (n % 5).alias("revision"),
        F.when(n % 11 == 0, shop).alias("pending_shop"), F.when(n % 13 == 0, pos).alias("pending_pos"),
    )


MERGE_SQL = SIDES_SQL + """,
merged AS (
  SELECT sku, pos_quantity, shop_quantity, shop_at, revision, has_shop_action, has_pos_action, previous_pos, previous_shop,
    previous_canonical, pos_quantity - previous_pos AS pos_delta, shop_quantity - previous_shop AS shop_delta,
    greatest(0, previous_canonical + pos_quantity - previous_pos + shop_quantity - previous_shop) AS target
  FROM (
    SELECT p.sku, pos_quantity, shop_quantity, shop_at, revision, has_shop_action, has_pos_action,
      coalesce(pos_seen, pos_quantity) AS previous_pos, coalesce(shop_seen, shop_quantity) AS previous_shop,
      coalesce(canonical, pos_seen, pos_quantity) AS previous_canonical
    FROM pos p JOIN shop h ON p.sku = h.sku LEFT JOIN state s ON p.sku = s.sku))
"""


# -- change stream -----------------------------------------------------------

def stock_events(t: Tables) -> DataFrame:
    """Late and undated stock changes, one item per user and three shops."""
    e = t.events
    at = micros(F.col("ts")) - (F.col("event_id") % 7) * 3_600_000_000
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("shop"), (F.col("user_id") % 3).cast("string")).alias("shop"),
        code("I", "user_id").alias("item"), F.floor("value").cast("bigint").alias("quantity"),
        F.when(F.col("event_id") % 11 != 0, at).alias("at"), "event_type", "ts", "props", "user_id", "value",
    )


EVENTS_SQL = """
ev AS (
  SELECT event_id AS seq, 'shop' || (user_id % 3) AS shop, 'I' || user_id AS item, CAST(floor(value) AS BIGINT) AS quantity,
    CASE WHEN event_id % 11 <> 0 THEN epoch_us(ts) - (event_id % 7) * 3600000000 END AS src_at,
    event_type, ts, props, user_id, value
  FROM events)
"""

# the fold as accept flags: seg restarts at undated events, prev is the latest time before the row
FOLD_SQL = EVENTS_SQL + """,
segs AS (SELECT *, count(*) FILTER (src_at IS NULL) OVER (PARTITION BY shop, item ORDER BY seq) AS seg FROM ev),
prevs AS (SELECT *, max(src_at) OVER (PARTITION BY shop, item, seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM segs),
folded AS (
  SELECT shop, item, count(*) AS version, arg_max(quantity, seq) AS quantity, max(seq) AS last_seq
  FROM prevs WHERE src_at IS NULL OR prev IS NULL OR src_at >= prev GROUP BY 1, 2)
"""


# -- items and vendors -------------------------------------------------------

def item_rows(t: Tables) -> DataFrame:
    """Every line item as one row of an item table, SKUs repeated or blank."""
    return t.lineitem.select(
        F.when(F.col("l_suppkey") % 17 != 0, code("P", "l_partkey")).otherwise("  ").alias("SKU"),
        F.when(F.col("l_linenumber") == 1, F.lit(0)).otherwise(F.col("l_extendedprice")).cast("decimal(18,2)").alias("PRICE"),
        (F.col("l_quantity").cast("bigint") - 10).alias("QTY"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("LAST_ACT"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("DESC"),
        F.when(F.col("l_linestatus") == "F", F.lit("MS")).otherwise(" ").alias("GROUP"),
        F.when(F.col("l_tax") > 0.03, code("V", "l_suppkey")).alias("VENDOR"), *LINE_ARRIVAL,
    )


ITEM_ROWS_SQL = """
item_rows AS (
  SELECT CASE WHEN l_suppkey % 17 <> 0 THEN 'P' || l_partkey ELSE '  ' END AS sku,
    CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_extendedprice END AS DECIMAL(18,2)) AS price,
    CAST(l_quantity AS BIGINT) - 10 AS qty, strftime(l_shipdate, '%Y-%m-%d') AS last_act,
    CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS descr,
    CASE WHEN l_linestatus = 'F' THEN 'MS' END AS grp,
    CASE WHEN l_tax > 0.03 THEN 'V' || l_suppkey END AS vendor,
    l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem)
"""


def items(t: Tables) -> DataFrame:
    """Parts as an item table with gaps, codes and price tiers."""
    k = F.col("p_partkey")
    price = money("p_retailprice")
    return t.part.select(
        F.when(k % 97 != 0, code("P", "p_partkey")).alias("SKU"), F.when(k % 89 != 0, F.col("p_name")).alias("DESC"),
        F.when(k % 5 == 0, "MS").when(k % 5 == 1, "SHO").when(k % 41 == 2, "RENTAL").otherwise(F.col("p_type")).alias("GROUP"),
        F.when(k % 3 == 0, F.concat(F.lit("V"), (k % 50).cast("string"))).alias("VENDOR"),
        F.col("p_brand").alias("PFIELD2"), F.lit(None).cast("string").alias("PFIELD1"),
        F.when(k % 4 == 0, F.col("p_size").cast("string")).alias("SIZE"), F.when(k % 6 == 0, "BLK").when(k % 6 == 1, "navy").alias("COLOR"),
        F.when(k % 7 == 0, code("A", "p_partkey")).alias("ALT_SKU"),
        F.when(k % 11 != 0, F.when(k % 13 == 0, F.lit(0)).otherwise(price)).cast("decimal(18,2)").alias("PRICE"),
        (price * F.when(k % 2 == 0, 2).otherwise(4)).cast("decimal(18,2)").alias("PRICE_R"),
        F.when(k % 9 != 0, (price * F.lit(0.5).cast("decimal(2,1)")).cast("decimal(18,2)")).alias("COST"),
        (F.col("p_size") - 10).cast("bigint").alias("QTY"), F.when(k % 10 == 0, F.lit("M")).otherwise("S").alias("TYPE"),
        F.when(k % 3 == 0, F.concat(F.lit("http://img.example/"), k.cast("string"), F.lit(".jpg"))).otherwise("local.jpg").alias("IMAGE"),
        F.when(k % 6 == 0, F.concat(F.lit("http://img.example/"), k.cast("string"), F.lit(".jpg"))).otherwise(F.concat(F.lit("HTTPS://img.example/b"), k.cast("string"))).alias("IMAGE2"),
        k.alias("_rec_no"),
    )


ITEMS_SQL = """
items AS (
  SELECT CASE WHEN p_partkey % 97 <> 0 THEN 'P' || p_partkey END AS sku,
    CASE WHEN p_partkey % 89 <> 0 THEN p_name END AS descr,
    CASE WHEN p_partkey % 5 = 0 THEN 'MS' WHEN p_partkey % 5 = 1 THEN 'SHO' WHEN p_partkey % 41 = 2 THEN 'RENTAL' ELSE p_type END AS grp,
    CASE WHEN p_partkey % 3 = 0 THEN 'V' || (p_partkey % 50) END AS vendor, p_brand AS pfield2,
    CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS VARCHAR) END AS size,
    CASE WHEN p_partkey % 6 = 0 THEN 'BLK' WHEN p_partkey % 6 = 1 THEN 'navy' END AS color,
    CASE WHEN p_partkey % 7 = 0 THEN 'A' || p_partkey END AS alt_sku,
    CAST(CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(18,2)) END END AS DECIMAL(18,2)) AS price,
    CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 4 END AS DECIMAL(18,2)) AS price_r,
    CASE WHEN p_partkey % 9 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(18,2)) END AS cost,
    CAST(p_size - 10 AS BIGINT) AS qty, CASE WHEN p_partkey % 10 = 0 THEN 'M' ELSE 'S' END AS item_type,
    CASE WHEN p_partkey % 3 = 0 THEN 'http://img.example/' || p_partkey || '.jpg' ELSE 'local.jpg' END AS image,
    CASE WHEN p_partkey % 6 = 0 THEN 'http://img.example/' || p_partkey || '.jpg' ELSE 'HTTPS://img.example/b' || p_partkey END AS image2,
    p_partkey AS rec_no
  FROM part)
"""


def vendor_rows(t: Tables) -> DataFrame:
    """Suppliers as vendor rows: codes repeat, some names are blank."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        F.concat(F.lit("V"), (k % 50).cast("string")).alias("VENDOR_ID"),
        F.when(k % 7 != 0, F.regexp_replace("s_name", "#", "  ")).otherwise("  ").alias("COMPANY"), k.alias("_rec_no"),
    )


VENDORS_SQL = """
vendors AS (
  SELECT 'V' || (s_suppkey % 50) AS vendor_id, arg_max(regexp_replace(s_name, '#', ' '), s_suppkey) AS company
  FROM supplier WHERE s_suppkey % 7 <> 0 GROUP BY 1)
"""


def price_change_rows(t: Tables) -> DataFrame:
    """Line items as a price-change history of parts."""
    return t.lineitem.select(
        code("P", "l_partkey").alias("SKU"), (money("l_extendedprice") * F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(1)).cast("decimal(18,2)").alias("PRICE"),
        F.concat(F.lit("V"), (F.col("l_suppkey") % 50).cast("string")).alias("VENDOR"), *LINE_ARRIVAL,
    )


CHANGES_SQL = f"""
price_rows AS (
  SELECT 'P' || l_partkey AS sku, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS DECIMAL(18,2)) AS price,
    'V' || (l_suppkey % 50) AS vendor, l_suppkey, l_quantity,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS newest,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS oldest
  FROM lineitem),
pc AS (SELECT sku, price, vendor FROM price_rows WHERE newest = 1),
vi AS (SELECT sku, vendor, 'VS' || l_suppkey AS vend_sku, CAST(CAST(l_quantity AS BIGINT) AS DECIMAL(18,2)) AS base_cost FROM price_rows WHERE oldest = 1)
"""


def vendor_item_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(
        code("P", "l_partkey").alias("SKU"), F.concat(F.lit("V"), (F.col("l_suppkey") % 50).cast("string")).alias("VENDOR"),
        code("VS", "l_suppkey").alias("VEND_SKU"), F.col("l_quantity").cast("bigint").cast("decimal(18,2)").alias("BASE_COST"), *LINE_ARRIVAL,
    )


def cell_rows(t: Tables) -> DataFrame:
    """Line items as grid quantity rows."""
    return t.lineitem.select(
        code("P", "l_partkey").alias("SKU"),
        F.concat(F.col("l_linenumber").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, " ").otherwise(""), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("CELL"),
        F.when(F.col("l_suppkey") % 5 == 0, F.concat(code("P", "l_partkey"), F.lit(". "), F.col("l_linenumber").cast("string"), F.lit(" "), (F.col("l_suppkey") % 3 + 1).cast("string"))).alias("BARCODE"),
        (F.col("l_quantity").cast("bigint") - 20).alias("QTY"), *LINE_ARRIVAL,
    )


CELLS_SQL = """
cells AS (
  SELECT 'P' || l_partkey AS sku, l_linenumber || CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE '' END || (l_suppkey % 3 + 1) AS cell,
    CASE WHEN l_suppkey % 5 = 0 THEN 'P' || l_partkey || '. ' || l_linenumber || ' ' || (l_suppkey % 3 + 1) END AS barcode,
    CAST(l_quantity AS BIGINT) - 20 AS qty, l_linenumber AS r, l_suppkey % 3 + 1 AS c, l_partkey,
    l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice
  FROM lineitem)
"""


def sku_map(t: Tables) -> DataFrame:
    """Distinct grid children of all parts, plus the parts themselves."""
    grid = t.lineitem.select(
        F.concat(code("P", "l_partkey"), F.lit(". "), F.col("l_linenumber").cast("string"), F.lit(" "), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("sku"),
        code("P", "l_partkey").alias("base"),
    ).distinct()
    return grid.unionByName(t.part.select(code("P", "p_partkey").alias("sku"), code("P", "p_partkey").alias("base")))


MAP_SQL = """
sku_map AS (
  SELECT DISTINCT 'P' || l_partkey || '. ' || l_linenumber || ' ' || (l_suppkey % 3 + 1) AS sku, 'P' || l_partkey AS base
  FROM lineitem
  UNION ALL SELECT 'P' || p_partkey, 'P' || p_partkey FROM part)
"""
