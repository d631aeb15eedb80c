"""Customers: build, identity, addresses, contact matching, storefront CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.operators import customers, reports
from tillbridge.operators.parts import cut_parts
from tillbridge.plans import proxies as p
from tillbridge.plans.registry import Tables, query
from tillbridge.session import scratch_path

CUSTOMERS_SQL = """
src AS (
  SELECT 'Customer.dbf' AS source, 0 AS source_rank, c_custkey AS n, c_custkey AS k, c_mktsegment, c_acctbal FROM customer
  UNION ALL SELECT 'mcust.DBF', 1, c_custkey, c_custkey + (c_custkey % 2) * 7, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 3 = 0),
cust AS (
  SELECT source, source_rank, n, k, CASE WHEN k % 19 <> 0 THEN 'C' || k END AS num,
    CASE WHEN k % 3 = 0 THEN 'mail' || (k % 400) || '@example.com' WHEN k % 17 = 0 THEN NULL END AS email,
    CASE WHEN k % 4 = 0 THEN '+1' || lpad(CAST(2000000000 + k % 500 AS VARCHAR), 10, '0') END AS phone,
    CASE WHEN k % 5 <> 0 THEN 'Anna' END AS first_name, CASE WHEN k % 5 <> 0 THEN 'O''Neil-Smith' END AS last_name,
    CASE WHEN k % 10 = 0 THEN upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS company, k % 29 = 0 AS deleted, c_mktsegment, c_acctbal
  FROM src),
built AS (SELECT *, CASE WHEN deleted THEN 'deleted' WHEN coalesce(email, phone, first_name, company) IS NULL THEN 'missing_identity' END AS skip FROM cust),
named AS (SELECT *, coalesce('email:' || email, 'phone:' || phone, 'pos_customer_number:' || lower(num)) AS identity FROM built WHERE skip IS NULL),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY source_rank, n) AS r, count(*) OVER (PARTITION BY identity) AS copies FROM named WHERE identity IS NOT NULL) WHERE r = 1)
"""


def customer_rows(t: Tables) -> list[tuple[str, DataFrame]]:
    k = F.col("k")

    def shaped(rows: DataFrame) -> DataFrame:
        digits = F.lpad((2_000_000_000 + k % 500).cast("string"), 10, "0")
        return rows.select(
            F.when(k % 19 != 0, F.concat(F.lit(" C"), k.cast("string"))).alias("CUST_NUM"),
            F.when(k % 3 == 0, F.concat(F.lit(" Mail"), (k % 400).cast("string"), F.lit("@Example.com"))).when(k % 17 == 0, "www.example.com").alias("INTERNET"),
            F.when(k % 4 == 0, F.concat(F.lit("1 ("), F.substring(digits, 1, 3), F.lit(") "), F.substring(digits, 4, 7))).when(k % 6 == 1, "555-5555").alias("PHONE"),
            F.when(k % 5 != 0, "ANNA").alias("FIRST_NAME"), F.when(k % 5 != 0, "o'neil-SMITH").alias("LAST_NAME"),
            F.when(k % 10 == 0, F.col("c_mktsegment")).alias("COMPANY"), F.when(k % 29 == 0, "y").alias("DELETED"),
            F.when(k % 2 == 0, F.concat((k % 100).cast("string"), F.lit(" Main  St"))).alias("ADDRESS"), F.when(k % 2 == 0, "ny").alias("STATE"),
            F.when(k % 3 == 0, F.concat((k % 7).cast("string"), F.lit(" Main St"))).alias("SHIPADD"), F.when(k % 6 == 0, "NEW YORK").alias("CITY_STATE"),
            F.col("c_mktsegment").alias("CLASS"), F.lit(" ").alias("LOC"), p.money("c_acctbal").alias("TOTAL_PUR"), F.when(k % 9 == 0, "yes").alias("TAXEXEMPT"),
            F.lit("2020-01-02").alias("LAST_ACT"), F.col("n").alias("_rec_no"),
        )

    base = t.customer.select(F.col("c_custkey").alias("n"), F.col("c_custkey").alias("k"), "c_mktsegment", "c_acctbal")
    more = base.where("k % 3 = 0").withColumn("k", k + (k % 2) * 7)
    return [("Customer.dbf", shaped(base)), ("mcust.DBF", shaped(more))]


def ship_rows(t: Tables) -> DataFrame:
    """Orders as ship-to rows: few places, many repeats."""
    o = F.col("o_orderkey")
    return t.orders.select(
        p.code("C", "o_custkey").alias("CUST_NUM"), F.when(o % 11 != 0, F.concat((o % 13).cast("string"), F.lit(" Dock  Rd"))).alias("SHIPADD"),
        F.lit("BOB jones").alias("SHIPNAME"), F.when(o % 11 != 0, F.lit("nj")).alias("SHIPSTATE"), o.alias("_rec_no"),
    )


SHIP_SQL = """
ship AS (
  SELECT cust_num, street, n, row_number() OVER (PARTITION BY cust_num ORDER BY n) AS r
  FROM (SELECT 'C' || o_custkey AS cust_num, (o_orderkey % 13) || ' Dock Rd' AS street, min(o_orderkey) AS n FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1, 2))
"""


@query("shipping_lists", f"""
WITH {SHIP_SQL}
SELECT cust_num, r AS n, street, 'Bob' AS first_name, 'Jones' AS last_name, 'NJ' AS province FROM ship""")
def shipping_lists(t: Tables) -> DataFrame:
    place = F.col("place")
    return customers.shipping_places(ship_rows(t)).select(
        "cust_num", "n", place["address1"].alias("street"), place["name"]["first"].alias("first_name"),
        place["name"]["last"].alias("last_name"), place["province_code"].alias("province"),
    )


def built(t: Tables, shipping: bool = False) -> DataFrame:
    sources = customer_rows(t)
    frames = [df.withColumns({"source": F.lit(name), "source_rank": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    return customers.build_customers(frames[0].unionByName(frames[1]), customers.shipping_addresses(ship_rows(t)) if shipping else None)


@query("build_customers", f"""
WITH {CUSTOMERS_SQL}
SELECT source, n, num AS pos_customer_number, email, phone, first_name, last_name, company, skip, k % 9 = 0 AS tax_exempt, 'POS Customer;POS Class:' || c_mktsegment AS tags,
  concat_ws('|', 'POS customer: ' || num, CASE WHEN k % 10 = 0 THEN 'Company: ' || c_mktsegment END, 'Last activity: 2020-01-02', 'Total purchased: ' || CAST(c_acctbal AS DECIMAL(18,2)), 'Class: ' || c_mktsegment) AS note FROM built""")
def build_customers(t: Tables) -> DataFrame:
    rows = built(t)
    return rows.select(
        "source", F.col("_rec_no").alias("n"), "pos_customer_number", "email", "phone", "first_name", "last_name", "company", "skip", "tax_exempt",
        F.concat_ws(";", "tags").alias("tags"), F.translate("note", "\n", "|").alias("note"),
    )


@query("customer_addresses", f"""
WITH {CUSTOMERS_SQL}, {SHIP_SQL},
a AS (
  SELECT source, n, 1 AS cls, 0 AS at_, (k % 100) || ' Main St' AS street, CASE WHEN k % 6 = 0 THEN 'new york' ELSE '' END AS city, 'ny' AS prov FROM built WHERE k % 2 = 0
  UNION ALL SELECT source, n, 1, 0, NULL, 'new york', '' FROM built WHERE k % 2 <> 0 AND k % 6 = 0
  UNION ALL SELECT source, n, 2, 0, (k % 7) || ' Main St', '', '' FROM built WHERE k % 3 = 0
  UNION ALL SELECT source, b.n, 3, s.n, street, '', 'nj' FROM built b JOIN ship s ON s.cust_num = b.num),
d AS (SELECT source, n, street, city, prov, min((cls, at_)) AS first_at FROM a GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT *, row_number() OVER (PARTITION BY source, n ORDER BY first_at) AS r FROM d)
SELECT b.source, b.n, coalesce(string_agg(coalesce(street, ''), ';' ORDER BY r), '') AS streets FROM built b LEFT JOIN (SELECT * FROM r WHERE r <= 10) r ON r.source = b.source AND r.n = b.n GROUP BY 1, 2""")
def customer_addresses(t: Tables) -> DataFrame:
    rows = built(t, shipping=True)
    streets = F.array_join(F.transform("addresses", lambda a: F.coalesce(a["address1"], F.lit(""))), ";")
    return rows.select("source", F.col("_rec_no").alias("n"), F.coalesce(streets, F.lit("")).alias("streets"))


@query("customers_dedup", f"""
WITH {CUSTOMERS_SQL}
SELECT identity, source, n, copies FROM kept UNION ALL SELECT 'record', source, n, CAST(1 AS BIGINT) FROM named WHERE identity IS NULL""")
def customers_dedup(t: Tables) -> DataFrame:
    rows = customers.dedupe_customers(built(t))
    named = F.when(F.contains("identity", F.lit(":")), F.col("identity")).otherwise("record")
    return rows.select(named.alias("identity"), "source", F.col("_rec_no").alias("n"), "copies")


@query("customer_identity", f"""
WITH {CUSTOMERS_SQL}
SELECT split_part(coalesce(identity, 'record:'), ':', 1) AS kind, count(*) AS rows FROM named GROUP BY 1""")
def customer_identity(t: Tables) -> DataFrame:
    rows = built(t).where("skip IS NULL")
    key = customers.identity_key(*rows.columns)
    kind = F.when(F.contains(key, F.lit(":")), F.substring_index(key, ":", 1)).otherwise("record")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


@query("load_customers", f"""
WITH {CUSTOMERS_SQL},
whole AS (SELECT source, source_rank, n FROM kept UNION ALL SELECT source, source_rank, n FROM named WHERE identity IS NULL)
SELECT source, n FROM whole ORDER BY source_rank, n LIMIT 200""")
def load_customers(t: Tables) -> DataFrame:
    rows = customers.load_customers(customer_rows(t), ship_rows(t), limit=200)
    return rows.select("source", F.col("_rec_no").alias("n"))


@query("customer_source_summary", f"""
WITH {CUSTOMERS_SQL},
whole AS (SELECT source FROM kept UNION ALL SELECT source FROM named WHERE identity IS NULL)
SELECT source, count(*) AS rows_seen, count(*) FILTER (skip = 'deleted') AS skipped_deleted, count(*) FILTER (skip = 'missing_identity') AS skipped_missing_identity,
  (SELECT count(*) FROM whole w WHERE w.source = b.source) AS payloads FROM built b GROUP BY 1""")
def customer_source_summary(t: Tables) -> DataFrame:
    rows = built(t)
    return reports.source_summary(rows, customers.dedupe_customers(rows))


@query("missing_customers", f"""
WITH {CUSTOMERS_SQL}
SELECT source, n FROM built WHERE skip IS NULL AND NOT coalesce(num IN (SELECT 'C' || c_custkey FROM customer WHERE c_custkey % 8 = 0), false)
  AND NOT coalesce(email IN (SELECT 'mail' || (c_custkey % 50) || '@example.com' FROM customer), false) AND NOT coalesce(phone IN (SELECT '+1' || (2000000000 + c_custkey % 25) FROM customer), false)""")
def missing_customers(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    export = t.customer.select(
        F.when(k % 8 == 0, F.concat(F.lit("POS Customer, Pos Id : C"), k.cast("string"))).otherwise("POS Customer").alias("﻿Tags"),
        F.concat(F.lit("MAIL"), (k % 50).cast("string"), F.lit("@example.com")).alias("Email"), (2_000_000_000 + k % 20).cast("string").alias("Phone"),
        F.concat(F.lit("+1 "), (2_000_000_000 + k % 25).cast("string")).alias("Default Address Phone"),
    )
    rows = built(t).where("skip IS NULL")
    return customers.missing_customers(rows, *customers.read_existing_customers(export)).select("source", F.col("_rec_no").alias("n"))


@query("existing_customer_index", """
SELECT 'id' AS kind, count(*) AS keys FROM customer WHERE c_custkey % 8 = 0 UNION ALL SELECT 'email', count(DISTINCT c_custkey % 50) FROM customer UNION ALL SELECT 'phone', count(DISTINCT c_custkey % 25) FROM customer""")
def existing_customer_index(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    export = t.customer.select(
        F.when(k % 8 == 0, F.concat(F.lit("a, pos id: C"), k.cast("string"))).alias("Tags"), F.concat(F.lit("Mail"), (k % 50).cast("string"), F.lit("@example.com")).alias("Email"),
        (2_000_000_000 + k % 20).cast("string").alias("Phone"), F.concat(F.lit("+1 "), (2_000_000_000 + k % 25).cast("string")).alias("Default Address Phone"),
    )
    frames = customers.read_existing_customers(export)
    counts = [f.agg(F.count(F.lit(1)).alias("keys")).select(F.lit(kind).alias("kind"), "keys") for kind, f in zip(("id", "email", "phone"), frames)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("customer_match_keys", f"""
WITH {CUSTOMERS_SQL}
SELECT source, n, coalesce('id:' || source || ':' || num, 'email:' || email, 'phone:' || phone) AS match_key,
  coalesce(CASE WHEN first_name IS NOT NULL THEN first_name || ' ' || last_name END, company, email, phone, num, 'POS customer') AS display_name FROM built""")
def customer_match_keys(t: Tables) -> DataFrame:
    return built(t).select("source", F.col("_rec_no").alias("n"), customers.match_key().alias("match_key"), customers.display_name().alias("display_name"))


@query("deleted_customers", "SELECT c_custkey, c_custkey % 4 IN (0, 1) AS deleted FROM customer")
def deleted_customers(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    flag = F.when(k % 4 == 0, " yes").when(k % 4 == 1, "True ").when(k % 4 == 2, "no")
    return t.customer.select("c_custkey", customers.is_deleted(flag).alias("deleted"))


@query("customer_audit", f"""
WITH {CUSTOMERS_SQL}
SELECT source, coalesce(num, '') AS cust_num, coalesce(email, '') AS email, CAST(c_acctbal AS DECIMAL(18,2))::VARCHAR AS total_purchased, CAST(2 AS INTEGER) AS tag_count,
  CAST(3 + CASE WHEN num IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN CAST(c_acctbal AS DECIMAL(18,2)) <> 0 THEN 1 ELSE 0 END AS INTEGER) AS metafield_count FROM built WHERE skip IS NULL""")
def customer_audit(t: Tables) -> DataFrame:
    audit = reports.customer_audit(built(t).where("skip IS NULL"))
    return audit.select("source", "cust_num", "email", "total_purchased", "tag_count", "metafield_count")


@query("customer_csv_rows", f"""
WITH {CUSTOMERS_SQL}
SELECT source, n, coalesce(last_name, company, '') AS last_name, coalesce(email, '') AS email, CASE WHEN k % 2 = 0 THEN 'NY' ELSE '' END AS province,
  'POS Customer, POS Class:' || c_mktsegment || CASE WHEN num IS NOT NULL THEN ', POS ID:' || num ELSE '' END || ', POS Source:' || source AS tags, CASE WHEN k % 9 = 0 THEN 'yes' ELSE 'no' END AS tax_exempt
FROM built WHERE skip IS NULL""")
def customer_csv_rows(t: Tables) -> DataFrame:
    rows = customers.csv_rows(built(t).where("skip IS NULL"))
    return rows.select(
        F.regexp_extract("Tags", "POS Source:(.*)$", 1).alias("source"), F.col("_rec_no").alias("n"), F.col("`Last Name`").alias("last_name"), F.col("Email").alias("email"), F.col("`Default Address Province Code`").alias("province"),
        F.col("Tags").alias("tags"), F.col("`Tax Exempt`").alias("tax_exempt"),
    )


@query("storefront_csv", """
SELECT 'c' || c_custkey || '@x.com' AS email, 'vip, POS ID:' || c_custkey AS tags, CASE WHEN c_custkey % 3 <> 0 THEN ' ' || c_mktsegment || chr(10) || 'said "yes, ' || c_name || '"' END AS note FROM customer""")
def storefront_csv(t: Tables) -> DataFrame:
    """An export with a byte order mark, quotes and notes of two lines, written and read."""
    k = F.col("c_custkey").cast("string")
    note = F.concat(F.lit(" "), "c_mktsegment", F.lit('\nsaid "yes, '), "c_name", F.lit('"'))
    path = scratch_path(t.spark, "storefront-csv")
    reports.write_csv(t.customer.select(
        F.concat(F.lit("c"), k, F.lit("@x.com")).alias("\ufeffEmail"), F.concat(F.lit("vip, POS ID:"), k).alias("Tags"), F.when(F.col("c_custkey") % 3 != 0, note).alias("Note"),
    ), path)
    return customers.read_storefront_csv(t.spark, path).select(F.col("Email").alias("email"), F.col("Tags").alias("tags"), F.col("Note").alias("note"))


@query("clear_duplicate_contacts", """
WITH r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Mail' || user_id || CASE WHEN event_id % 2 = 0 THEN '@X.com' ELSE '@x.com' END END AS email, CASE WHEN event_id % 4 <> 0 THEN '+1' || (event_id % 3000) ELSE '' END AS phone FROM events),
f AS (SELECT *, email <> '' AND event_id > min(event_id) OVER (PARTITION BY lower(email)) AS ec, phone <> '' AND event_id > min(event_id) OVER (PARTITION BY phone) AS pc FROM r)
SELECT event_id, CASE WHEN ec THEN '' ELSE email END AS email, CASE WHEN pc THEN '' ELSE phone END AS phone, CASE WHEN pc AND event_id % 2 = 0 THEN '' WHEN event_id % 2 = 0 THEN phone ELSE 'other' END AS address_phone, ec AS email_cleared, pc AS phone_cleared FROM f""")
def clear_duplicate_contacts(t: Tables) -> DataFrame:
    k = F.col("event_id")
    email = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Mail"), F.col("user_id").cast("string"), F.when(k % 2 == 0, "@X.com").otherwise("@x.com")))
    phone = F.when(k % 4 != 0, F.concat(F.lit("+1"), (k % 3000).cast("string"))).otherwise("")
    rows = t.events.select("event_id", email.alias("Email"), phone.alias("Phone"), F.when(k % 2 == 0, phone).otherwise("other").alias("Default Address Phone"))
    rows = customers.clear_duplicate_contacts(rows, ["event_id"])
    return rows.select("event_id", F.col("Email").alias("email"), F.col("Phone").alias("phone"), F.col("`Default Address Phone`").alias("address_phone"), "email_cleared", "phone_cleared")


@query("split_csv_by_bytes", """
SELECT count(*) AS rows, CAST(sum(octet_length(encode(doc_id || ',' || CASE WHEN regexp_matches(text, '[",\r\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || chr(10)))) AS BIGINT) AS bytes,
  true AS parts_fit, true AS order_kept FROM documents""")
def split_csv_by_bytes(t: Tables) -> DataFrame:
    """Whole documents as CSV lines; the parts must fit and keep the order."""
    limit = 100_000
    lines = t.documents.select("doc_id", customers.csv_line(["doc_id", "text"]).alias("line"))
    per_part = cut_parts(lines, ["doc_id"], "line", limit).groupBy("part_number").agg(
        F.count(F.lit(1)).alias("n"), F.sum("line_bytes").alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
    )
    following = per_part.select((F.col("part_number") - 1).alias("part_number"), F.col("low").alias("next_low"))
    per_part = per_part.join(following, "part_number", "left")
    return per_part.agg(
        F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.bool_and((F.col("bytes") <= limit) | (F.col("n") == 1)).alias("parts_fit"),
        F.bool_and(F.col("next_low").isNull() | (F.col("high") < F.col("next_low"))).alias("order_kept"),
    )
