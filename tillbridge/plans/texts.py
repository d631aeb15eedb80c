"""Text, contact and key functions over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.functions import contact, keys, money, text, times, titles
from tillbridge.operators import orders
from tillbridge.plans import proxies as p
from tillbridge.plans.registry import Tables, query

# fixed values: every character Python and Java both treat as a space
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CP1252 = "[^\\x{00}-\\x{7f}\\x{a0}-\\x{ff}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"


@query("clean_text", f"""
SELECT 'd' || doc_id AS id, md5(trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))) AS cleaned FROM documents
UNION ALL SELECT 'c' || conv_id || '-' || turn, md5(trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))) FROM conversations""")
def clean_text(t: Tables) -> DataFrame:
    docs = t.documents.select(p.code("d", "doc_id").alias("id"), "text")
    talk = t.conversations.select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return docs.unionByName(talk).select("id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"))


@query("normalize_email", f"""
WITH w AS (SELECT doc_id, lower(unnest(regexp_split_to_array(text, '{SPACE}+'))) AS word FROM documents)
SELECT doc_id, word AS email, count(*) AS uses FROM w WHERE regexp_full_match(word, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') AND NOT regexp_matches(word, '^(www\\.|https?://)') GROUP BY 1, 2""")
def normalize_email(t: Tables) -> DataFrame:
    words = t.documents.select("doc_id", F.explode(F.split("text", text.ANY_SPACE)).alias("word")).where(F.contains("word", F.lit("@")))
    rows = words.select("doc_id", contact.normalize_email(F.col("word")).alias("email")).where("email IS NOT NULL")
    return rows.groupBy("doc_id", "email").agg(F.count(F.lit(1)).alias("uses"))


@query("normalize_phone", """
WITH w AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[+(]?[0-9][0-9() .-]{8,}[0-9]')), '[^0-9]', '', 'g') AS digits FROM documents),
d AS (SELECT doc_id, CASE WHEN length(digits) = 11 AND digits LIKE '1%' THEN substr(digits, 2) ELSE digits END AS ten FROM w)
SELECT doc_id, '+1' || ten AS phone, count(*) AS uses FROM d WHERE length(ten) = 10 AND ten <> repeat(ten[1], 10) GROUP BY 1, 2""")
def normalize_phone(t: Tables) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("[+(]?[0-9][0-9() .-]{8,}[0-9]"), 0)
    rows = t.documents.select("doc_id", F.explode(found).alias("raw")).select("doc_id", contact.normalize_us_phone(F.col("raw")).alias("phone"))
    return rows.where("phone IS NOT NULL").groupBy("doc_id", "phone").agg(F.count(F.lit(1)).alias("uses"))


@query("normalize_order_phone", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE '+1' || CAST(2000000000 + o_custkey AS VARCHAR) END AS phone FROM orders""")
def normalize_order_phone(t: Tables) -> DataFrame:
    k, digits = F.col("o_orderkey"), (F.col("o_custkey") + 2_000_000_000).cast("string")
    raw = F.when(k % 4 == 0, digits).when(k % 4 == 1, F.concat(F.lit("1-"), digits)).when(k % 4 == 2, F.concat(F.lit("("), F.substring(digits, 1, 3), F.lit(") "), F.substring(digits, 4, 7))).otherwise("777-777-7777")
    return t.orders.select("o_orderkey", contact.normalize_us_phone(raw).alias("phone"))


@query("base_sku", """
SELECT 'P' || l_partkey AS base, count(*) AS rows, count(*) FILTER (l_suppkey % 4 <> 0) AS children FROM lineitem GROUP BY 1""")
def base_sku(t: Tables) -> DataFrame:
    tail = F.concat(F.when(F.col("l_suppkey") % 2 == 0, ". ").otherwise("."), F.col("l_linenumber").cast("string"), F.lit("  3 "))
    sku = F.concat(F.lit(" "), p.code("P", "l_partkey"), F.when(F.col("l_suppkey") % 4 != 0, tail).otherwise(""))
    return t.lineitem.groupBy(keys.base_sku(sku).alias("base")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(keys.is_matrix_child(sku)).alias("children"))


@query("title_case", """
WITH s AS (SELECT p_partkey AS k, p_name || ' ' || ['o''neil-smith', 'a&b co.', 'tux PKSQ', 'mid.town x9/zed', '(hello) #odd', 'brand#7'][CAST(p_partkey % 6 + 1 AS INTEGER)] AS raw FROM part)
SELECT k, array_to_string(list_transform(string_split(split_part(raw, ' ', 1) || ' ' || split_part(raw, ' ', 2), ' '), lambda w: CASE WHEN length(w) <= 2 THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ')
  || ' ' || ['O''Neil-Smith', 'A&B CO', 'TUX PKSQ', 'Mid.Town X9/Zed', '(Hello) #Odd', 'brand#7'][CAST(k % 6 + 1 AS INTEGER)] AS title FROM s""")
def title_case(t: Tables) -> DataFrame:
    tails = F.array(*[F.lit(x) for x in ("o'neil-smith", "a&b  co.", "tux PKSQ", "mid.town x9/zed", "(hello) #odd", "brand#7")])
    raw = F.concat("p_name", F.lit(" "), F.element_at(tails, (F.col("p_partkey") % 6 + 1).cast("int")))
    return t.part.select(F.col("p_partkey").alias("k"), text.smart_title_case(raw).alias("title"))


@query("split_note", f"""
WITH n AS (SELECT doc_id, text, regexp_replace(text, '{CP1252}', '?', 'g') AS plain FROM documents)
SELECT doc_id, md5(substr(plain, 1, 254)) AS note1, md5(nullif(substr(plain, 255, 254), '')) AS note2, length(text) > 508 OR regexp_matches(text, '{CP1252}') AS changed FROM n""")
def split_note(t: Tables) -> DataFrame:
    first, second, changed = orders.split_note(F.col("text"))
    return t.documents.select("doc_id", F.md5(first).alias("note1"), F.md5(second).alias("note2"), changed.alias("changed"))


@query("color_and_size_names", """
SELECT p_partkey, ['Black / White', NULL, 'Light Blue', NULL, 'Medium Brown', 'Dark Green'][CAST(p_partkey % 6 + 1 AS INTEGER)] AS color, ['XL', '34/32', 'Over Calf', NULL, '10.5D'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS size FROM part""")
def color_and_size_names(t: Tables) -> DataFrame:
    colors = F.array(*[F.lit(x) for x in (" blk/wht", "APH34", "lt  BLUE", "XYZ", "med.brown", "dk green")])
    sizes = F.array(*[F.lit(x) for x in ("xl ", "34/32", "over calf", "one size", "10.5d")])
    k = F.col("p_partkey")
    return t.part.select(
        "p_partkey", titles.color_for_title(F.element_at(colors, (k % 6 + 1).cast("int"))).alias("color"), titles.size_for_title(F.element_at(sizes, (k % 5 + 1).cast("int"))).alias("size"),
    )


@query("observation_order", """
WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS cand, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S+02:00') ELSE 'zzz' END AS cur FROM events)
SELECT event_id, event_id % 4 IN (0, 1) AS newer, event_id % 4 IN (2, 3) AS older FROM e""")
def observation_order(t: Tables) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts")
    shape = "yyyy-MM-dd'T'HH:mm:ss"
    current = (
        F.when(k % 4 == 0, "").when(k % 4 == 1, F.date_format(ts - F.expr("INTERVAL 1 HOUR"), shape))
        .when(k % 4 == 2, F.concat(F.date_format(ts + F.expr("INTERVAL 3 HOUR"), shape), F.lit("+02:00"))).otherwise("zzz")
    )
    return t.events.select("event_id", times.is_newer(p.iso(ts), current).alias("newer"), times.is_older(p.iso(ts), current).alias("older"))


@query("payload_keys", """
SELECT event_id, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k, 'gid://shop.example/Item/' || event_id AS uri, CAST(event_id AS VARCHAR) AS id, event_id % 2 = 0 AS is_write FROM events""")
def payload_keys(t: Tables) -> DataFrame:
    raw = F.from_json("props", "map<string,string>")
    rows = t.events.select("event_id", raw.alias("m")).withColumn("f", keys.folded_keys(F.col("m")))
    uri = keys.resource_uri("Item", F.col("event_id").cast("string"), "shop.example")
    write = F.when(F.col("event_id") % 2 == 0, F.map_concat("m", F.create_map(F.lit("price"), F.lit("1")))).otherwise(F.col("m"))
    return rows.select(
        "event_id", keys.pick(F.col("m"), F.col("f"), "missing", " K_").cast("bigint").alias("k"), uri.alias("uri"), keys.numeric_id(uri).alias("id"), keys.is_product_write(write).alias("is_write"),
    )


@query("amount_texts", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN '1.00' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
  CASE o_orderkey % 4 WHEN 3 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) WHEN 2 THEN '1.00' END AS nonzero, o_orderkey % 4 = 1 AS bad FROM orders""")
def amount_texts(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, "").when(k % 4 == 1, "n/a").when(k % 4 == 2, "1.005").otherwise(p.money("o_totalprice").cast("string"))
    return t.orders.select("o_orderkey", money.money_text(raw).alias("amount"), money.nonzero_money_text(raw).alias("nonzero"), money.as_number(raw)[1].alias("bad"))
