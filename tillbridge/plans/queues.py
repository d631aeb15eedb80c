"""Queues, logs and status over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.operators import queues
from tillbridge.plans import proxies as p
from tillbridge.plans.registry import Tables, query

KEYS = ("shop", "item")


def folded(t: Tables) -> DataFrame:
    events = p.stock_events(t).select("shop", "item", "seq", "at", "quantity")
    return queues.fold_inventory_events(events, KEYS, "seq", "at", ["quantity", "seq"])


@query("fold_inventory_events", f"WITH {p.FOLD_SQL} SELECT shop, item, version, quantity, last_seq FROM folded")
def fold_inventory_events(t: Tables) -> DataFrame:
    return folded(t).select("shop", "item", "version", "quantity", F.col("seq").alias("last_seq"))


@query("fold_inventory_events_resumed", f"WITH {p.FOLD_SQL} SELECT shop, item, version, quantity, last_seq FROM folded")
def fold_inventory_events_resumed(t: Tables) -> DataFrame:
    """The same fold in two runs, the second one starting from stored state."""
    events = p.stock_events(t).select("shop", "item", "seq", "at", "quantity")
    middle = F.floor(events.agg(F.max("seq")).scalar() / 2)
    early, late = events.where(F.col("seq") < middle), events.where(F.col("seq") >= middle)
    first = queues.fold_inventory_events(early, KEYS, "seq", "at", ["quantity", "seq"])
    both = queues.fold_inventory_events(late, KEYS, "seq", "at", ["quantity", "seq"], state=first)
    return both.select("shop", "item", "version", "quantity", F.col("seq").alias("last_seq"))


@query("fold_order_events", f"""
WITH {p.EVENTS_SQL}
SELECT shop, item, count(*) AS version, arg_max(event_type, seq) AS event_type, max(seq) AS last_seq FROM ev GROUP BY 1, 2""")
def fold_order_events(t: Tables) -> DataFrame:
    rows = queues.fold_order_events(p.stock_events(t), KEYS, "seq", ["event_type", "seq"])
    return rows.withColumnRenamed("seq", "last_seq")


ACKS_SQL = p.FOLD_SQL + ", acks AS (SELECT shop, item, version - CASE WHEN last_seq % 3 = 0 THEN 1 ELSE 0 END AS version FROM folded WHERE last_seq % 2 = 0)"


def acks(t: Tables) -> DataFrame:
    older = F.when(F.col("seq") % 3 == 0, 1).otherwise(0)
    return folded(t).where("seq % 2 = 0").select("shop", "item", (F.col("version") - older).alias("version"))


@query("ack_versions", f"""
WITH {ACKS_SQL}
SELECT f.shop, f.item, f.version FROM folded f LEFT JOIN acks a ON f.shop = a.shop AND f.item = a.item AND f.version = a.version WHERE a.shop IS NULL""")
def ack_versions(t: Tables) -> DataFrame:
    return queues.acknowledge(folded(t), acks(t), KEYS).select("shop", "item", "version")


@query("ack_counts", f"""
WITH {ACKS_SQL}
SELECT f.shop, count(*) AS deleted FROM folded f JOIN acks a ON f.shop = a.shop AND f.item = a.item AND f.version = a.version GROUP BY 1""")
def ack_counts(t: Tables) -> DataFrame:
    return queues.acknowledged(folded(t), acks(t), KEYS).groupBy("shop").agg(F.count(F.lit(1)).alias("deleted"))


@query("pending_changes", f"WITH {p.FOLD_SQL} SELECT shop, item, version, last_seq FROM folded ORDER BY last_seq LIMIT 50")
def pending_changes(t: Tables) -> DataFrame:
    return queues.pending_changes(folded(t).select("shop", "item", "version", F.col("seq").alias("last_seq")), "last_seq", 50)


@query("upsert_items", f"""
WITH {p.EVENTS_SQL}
SELECT shop, item, arg_max(event_type, seq) AS sku, arg_max(CASE WHEN seq % 4 <> 0 THEN quantity END, seq) FILTER (seq % 4 <> 0) AS last_quantity FROM ev GROUP BY 1, 2""")
def upsert_items(t: Tables) -> DataFrame:
    rows = p.stock_events(t).select("shop", "item", "seq", F.col("event_type").alias("sku"), F.when(F.col("seq") % 4 != 0, F.col("quantity")).alias("quantity"))
    return queues.upsert_items(rows, KEYS, "seq")


@query("restored_items", f"""
WITH {p.EVENTS_SQL},
q AS (SELECT shop, item, seq, greatest(0, quantity - 20) AS quantity FROM ev),
l AS (SELECT *, lag(quantity) OVER (PARTITION BY shop, item ORDER BY seq) AS previous_quantity FROM q)
SELECT shop, item, seq, quantity, previous_quantity FROM l WHERE quantity > 0 AND coalesce(previous_quantity, 0) <= 0""")
def restored_items(t: Tables) -> DataFrame:
    rows = p.stock_events(t).select("shop", "item", "seq", F.greatest(F.lit(0), F.col("quantity") - 20).alias("quantity"))
    return queues.restored_items(rows, KEYS, "seq")


@query("retain_per_group", f"""
WITH {p.EVENTS_SQL}
SELECT shop, seq, event_type FROM (SELECT *, row_number() OVER (PARTITION BY shop ORDER BY quantity DESC, seq DESC) AS r FROM ev) WHERE r <= 500""")
def retain_per_group(t: Tables) -> DataFrame:
    return queues.retain_per_group(p.stock_events(t), ["shop"], ["quantity", "seq"], 500).select("shop", "seq", "event_type")


@query("retain_global", f"WITH {p.EVENTS_SQL} SELECT shop, seq, event_type FROM ev ORDER BY seq DESC LIMIT 200")
def retain_global(t: Tables) -> DataFrame:
    return queues.retain_global(p.stock_events(t).select("shop", "seq", "event_type"), ["seq"], 200)


@query("recent_orders", """
WITH q AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'P')
SELECT o.o_orderkey AS order_id, o_totalprice, CASE WHEN q.o_orderkey IS NULL THEN 'sent_to_pos' ELSE 'queued' END AS delivery_status
FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50) o LEFT JOIN q ON o.o_orderkey = q.o_orderkey""")
def recent_orders(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_orderkey").alias("order_id"), "o_totalprice", "o_orderdate", "o_orderstatus")
    queue = orders.where("o_orderstatus = 'P'").select("order_id")
    rows = queues.recent_orders(orders, queue, ["order_id"], ["o_orderdate", "order_id"], 60)
    return rows.select("order_id", "o_totalprice", "delivery_status")


@query("recent_prices", f"""
WITH {p.EVENTS_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY shop ORDER BY ts DESC, seq DESC) AS r FROM ev WHERE event_type = 'purchase')
SELECT shop, seq, quantity FROM k WHERE r <= 50 ORDER BY ts DESC, seq DESC LIMIT 10""")
def recent_prices(t: Tables) -> DataFrame:
    rows = p.stock_events(t).where("event_type = 'purchase'")
    return queues.recent_prices(rows, ["shop"], ["ts", "seq"], 10).select("shop", "seq", "quantity")


BEATS_SQL = """
polls AS (SELECT 'shop' || (user_id % 50) AS shop, CASE user_id % 3 WHEN 0 THEN 'inventory' WHEN 1 THEN 'orders' ELSE 'catalog' END AS channel, epoch_us(ts) AS src_at FROM events),
now AS (SELECT max(src_at) AS now_at FROM polls),
beats AS (
  SELECT shop, max(src_at) AS last_seen, max(src_at) FILTER (channel = 'inventory') AS last_inventory, max(src_at) FILTER (channel = 'orders') AS last_orders,
    max(src_at) FILTER (channel = 'catalog') AS last_catalog FROM polls GROUP BY 1)
"""


def polls(t: Tables) -> DataFrame:
    kind = F.when(F.col("user_id") % 3 == 0, "inventory").when(F.col("user_id") % 3 == 1, "orders").otherwise("catalog")
    return t.events.select(F.concat(F.lit("shop"), (F.col("user_id") % 50).cast("string")).alias("shop"), kind.alias("channel"), F.col("ts").alias("at"))


def beats(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts")).scalar()
    return queues.heartbeats(polls(t), "shop", now)


@query("heartbeats", f"""
WITH {BEATS_SQL}
SELECT shop, last_seen, last_inventory, last_orders, last_catalog, last_seen >= now_at - 480000000 AS active, coalesce(last_orders >= now_at - 480000000, false) AS orders_active FROM beats, now""")
def heartbeats(t: Tables) -> DataFrame:
    rows = beats(t)
    times = ("last_seen", "last_inventory", "last_orders", "last_catalog")
    return rows.select("shop", *[p.micros(F.col(c)).alias(c) for c in times], "active", "orders_active")


@query("bridge_status", f"""
WITH {BEATS_SQL}, {p.FOLD_SQL}
SELECT b.shop, last_seen >= now_at - 480000000 AS active, coalesce(i.n, 0) AS queued_changes, coalesce(o.n, 0) AS queued_orders, coalesce(s.n, 0) AS recent_orders, coalesce(r.n, 0) AS recent_prices
FROM beats b CROSS JOIN now
LEFT JOIN (SELECT shop, count(*) AS n FROM folded GROUP BY 1) i ON i.shop = b.shop
LEFT JOIN (SELECT 'shop' || (o_custkey % 50) AS shop, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON o.shop = b.shop
LEFT JOIN (SELECT 'shop' || (o_custkey % 50) AS shop, count(*) AS n FROM orders GROUP BY 1) s ON s.shop = b.shop
LEFT JOIN (SELECT shop, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY 1) r ON r.shop = b.shop""")
def bridge_status(t: Tables) -> DataFrame:
    shop = F.concat(F.lit("shop"), (F.col("o_custkey") % 50).cast("string")).alias("shop")
    orders = t.orders.select(shop, "o_orderstatus")
    sales = p.stock_events(t).where("event_type = 'purchase'")
    rows = queues.bridge_status(beats(t), "shop", folded(t), orders.where("o_orderstatus = 'P'"), orders, sales)
    return rows.select("shop", "active", "queued_changes", "queued_orders", "recent_orders", "recent_prices")


@query("feed_events", """
SELECT doc_id, 'POST' AS method, CASE WHEN n_chars % 2 = 0 THEN 1 ELSE 0 END AS success, md5(substr(text, 1, 4000)) AS request_md5, length(substr(text, 1, 4000)) AS request_length
FROM documents""")
def feed_events(t: Tables) -> DataFrame:
    rows = t.documents.select(
        "doc_id", F.lit("post").alias("method"), (F.col("n_chars") % 2 == 0).alias("success"),
        F.col("text").alias("request_payload"), F.col("text").alias("normalized_payload"),
    )
    out = queues.feed_events(rows)
    return out.select("doc_id", "method", "success", F.md5("request_payload").alias("request_md5"), F.length("request_payload").cast("bigint").alias("request_length"))


@query("request_log_page", f"""
WITH {p.EVENTS_SQL}
SELECT seq, shop, event_type FROM (SELECT seq, CASE WHEN seq % 9 <> 0 THEN shop END AS shop, event_type, ts FROM ev) WHERE shop = 'shop1' OR shop IS NULL ORDER BY ts DESC, seq DESC LIMIT 1000""")
def request_log_page(t: Tables) -> DataFrame:
    rows = p.stock_events(t).withColumn("shop", F.when(F.col("seq") % 9 != 0, F.col("shop")))
    return queues.list_log(rows, "shop", ["ts", "seq"], 2000, 1000, shop="shop1").select("seq", "shop", "event_type")


@query("mask_logs", f"""
WITH {p.EVENTS_SQL},
l AS (
  SELECT seq, CASE seq % 4 WHEN 0 THEN '/sync//items/ /' || item WHEN 1 THEN '/wc-api/v3/' || event_type || '/' WHEN 2 THEN '/health' ELSE '/wp-json/wc/v3//products' END AS path,
    CASE seq % 3 WHEN 0 THEN 'consumer_secret=cs_' || seq || '&page=2' WHEN 1 THEN 'consumer_key=ck_abcdefgh' || seq || '&q=' ELSE '' END AS qs,
    'key' || repeat('x', CAST(seq % 12 AS INTEGER)) || seq AS api_key, repeat('b', CAST(seq % 5000 AS INTEGER)) AS body
  FROM ev)
SELECT seq, '/' || array_to_string(list_filter(list_transform(string_split(path, '/'), lambda s: trim(s)), lambda s: s <> ''), '/') AS path,
  CASE seq % 3 WHEN 0 THEN 'consumer_secret=%2A%2A%2A&page=2' WHEN 1 THEN 'consumer_key=' || CASE WHEN length('ck_abcdefgh' || seq) <= 10 THEN 'ck_abcdefgh' || seq ELSE 'ck_abcde...' || right('ck_abcdefgh' || seq, 4) END || '&q=' END AS query_string,
  CASE WHEN length(api_key) <= 10 THEN api_key ELSE left(api_key, 8) || '...' || right(api_key, 4) END AS api_key,
  length(CASE WHEN length(body) > 4000 THEN left(body, 4000) || '... [truncated]' ELSE nullif(body, '') END) AS body_length
FROM l WHERE path NOT LIKE '/health%'""")
def mask_logs(t: Tables) -> DataFrame:
    seq, text = F.col("seq"), F.col("seq").cast("string")
    rows = p.stock_events(t).select(
        "seq", F.when(seq % 4 == 0, F.concat(F.lit("/sync//items/ /"), F.col("item"))).when(seq % 4 == 1, F.concat(F.lit("/wc-api/v3/"), F.col("event_type"), F.lit("/")))
        .when(seq % 4 == 2, "/health").otherwise("/wp-json/wc/v3//products").alias("path"),
        F.when(seq % 3 == 0, F.concat(F.lit("consumer_secret=cs_"), text, F.lit("&page=2"))).when(seq % 3 == 1, F.concat(F.lit("consumer_key=ck_abcdefgh"), text, F.lit("&q="))).otherwise("").alias("query_string"),
        F.concat(F.lit("key"), F.repeat(F.lit("x"), (seq % 12).cast("int")), text).alias("api_key"), F.repeat(F.lit("b"), (seq % 5000).cast("int")).alias("request_body"),
    )
    return queues.mask_request_logs(rows).select("seq", "path", "query_string", "api_key", F.length("request_body").cast("bigint").alias("body_length"))


@query("purge_tenant", f"""
WITH {p.EVENTS_SQL}
SELECT shop, count(*) AS rows FROM ev WHERE shop <> 'shop1' GROUP BY 1
UNION ALL SELECT DISTINCT shop || ' gone', 0 FROM ev WHERE shop = 'shop1'""")
def purge_tenant(t: Tables) -> DataFrame:
    events = p.stock_events(t)
    shops = events.select("shop").distinct().withColumn("uninstalled_at", F.lit(None).cast("string"))
    marked, left = queues.purge_tenant(shops, "shop1", "shop", F.lit("now"), events)
    counts = left.groupBy("shop").agg(F.count(F.lit(1)).alias("rows"))
    gone = marked.where("uninstalled_at IS NOT NULL").select(F.concat("shop", F.lit(" gone")).alias("shop"), F.lit(0).cast("bigint").alias("rows"))
    return counts.unionByName(gone)
