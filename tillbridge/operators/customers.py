"""Customer build, identity dedup, addresses and contact matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillbridge.functions.contact import (
    country_code, csv_text, normalize_email, normalize_us_phone, pos_ids_in_tags, province_code, split_name,
)
from tillbridge.functions.money import decimal_or_none, nonzero_money_text, nonzero_or_text, till_money
from tillbridge.functions.text import clean_text, first_nonempty, let, smart_title_case
from tillbridge.operators.catalog import field
from tillbridge.operators.ordering import order_key, spread
from tillbridge.operators.payloads import LINE, metafields

MAX_ADDRESSES = 10
ADDRESS_KEY = ("address1", "address2", "city", "province_code", "zip")
# The storefront's customer CSV columns.
CSV_COLUMNS = (
    "First Name", "Last Name", "Email", "Accepts Email Marketing", "Default Address Company",
    "Default Address Address1", "Default Address Address2", "Default Address City",
    "Default Address Province Code", "Default Address Country Code", "Default Address Zip",
    "Default Address Phone", "Phone", "Accepts SMS Marketing", "Accepts WhatsApp Marketing", "Tags",
    "Note", "Tax Exempt",
)


def is_deleted(value: Column) -> Column:
    return F.coalesce(F.upper(clean_text(value.cast("string"))).isin("Y", "YES", "TRUE", "1"), F.lit(False))


def address(
    name: Column, company: Column, address1: Column, address2: Column, city: Column,
    province: Column, zip_code: Column, phone: Column,
) -> Column:
    """Address struct, or null when no part gives a place."""
    parts = [clean_text(c) for c in (address1, address2, city, province, zip_code)]
    built = F.struct(
        split_name(name).alias("name"), F.nullif(company, F.lit("")).alias("company"),
        parts[0].alias("address1"), parts[1].alias("address2"), smart_title_case(parts[2]).alias("city"),
        F.upper(parts[3]).alias("province_code"), parts[4].alias("zip"), F.lit("US").alias("country_code"),
        phone.alias("phone"),
    )
    return F.when(F.coalesce(*parts).isNotNull(), built)


def address_key(a: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.lower(a[part]), F.lit("")) for part in ADDRESS_KEY])


def dedupe_addresses(addresses: Column, most: int = MAX_ADDRESSES) -> Column:
    """First copy of each place, at most ``most``."""
    def firsts(v: Column) -> Column:
        return F.filter(v["places"], lambda _, i: F.array_position(v["keys"], v["keys"][i]) == i + 1)

    keyed = let(F.array_compact(addresses), lambda a: F.struct(a.alias("places"), F.transform(a, address_key).alias("keys")))
    return F.slice(let(keyed, firsts), 1, most)


def shipping_places(rows: DataFrame, order: Sequence[str] = ("_rec_no",)) -> DataFrame:
    """(cust_num, n, place): all distinct ship-to places of a customer, numbered in file order.

    Repeats fold in a partial aggregate before anything is numbered.
    """
    null = F.lit(None).cast("string")
    built = address(*[null if n is None else field(rows, n) for n in (
        "SHIPNAME", None, "SHIPADD", "SHIPADD2", "SHIPCITY", "SHIPSTATE", "SHIPZIP", None)])
    places = rows.select(clean_text(F.col("CUST_NUM")).alias("cust_num"), built.alias("a"), order_key(order).alias("_at"))
    places = places.where("cust_num IS NOT NULL AND a IS NOT NULL")
    once = places.groupBy("cust_num", address_key(F.col("a")).alias("_key")).agg(
        F.min_by("a", "_at").alias("a"), F.min("_at").alias("_at")
    )
    number = F.row_number().over(Window.partitionBy("cust_num").orderBy("_at")).cast("long")
    return once.select("cust_num", number.alias("n"), F.col("a").alias("place"))


def shipping_addresses(rows: DataFrame, order: Sequence[str] = ("_rec_no",), most: int = MAX_ADDRESSES) -> DataFrame:
    """cust_num -> the places that a customer's final list of ``most`` addresses can draw on."""
    top = shipping_places(rows, order).where(F.col("n") <= most)
    listed = top.groupBy("cust_num").agg(F.sort_array(F.collect_list(F.struct("n", "place"))).alias("l"))
    return listed.select("cust_num", F.transform("l", lambda x: x["place"]).alias("shipping"))


def build_customers(rows: DataFrame, shipping: DataFrame | None = None, tags: Sequence[str] = ("POS Customer",)) -> DataFrame:
    """Project customer rows (with ``source``) to payloads.

    ``skip`` is set for deleted rows and rows without any identity. A row grows
    many times when built, so rows are dealt over the cluster before.
    """
    arrival = [c for c in ("source_rank", "_rec_no") if c in rows.columns]
    rows = spread(rows, *arrival)
    def get(name: str) -> Column:
        return clean_text(field(rows, name).cast("string"))

    def cased(name: str) -> Column:
        return F.nullif(smart_title_case(get(name)), F.lit(""))

    base = rows.select(
        "*", get("CUST_NUM").alias("_num"), cased("FIRST_NAME").alias("_first"),
        cased("LAST_NAME").alias("_last"), cased("COMPANY").alias("_company"),
        normalize_email(field(rows, "INTERNET")).alias("_email"),
        normalize_us_phone(first_nonempty(get("PHONE"), get("PHONE_H"), get("PHONE_W"))).alias("_phone"),
    )
    if shipping is not None:
        base = base.join(shipping.withColumnRenamed("cust_num", "_ship_num"), F.col("_num") == F.col("_ship_num"), "left")
    company, phone = F.col("_company"), F.col("_phone")
    full_name = F.nullif(F.concat_ws(" ", "_first", "_last"), F.lit(""))
    primary = address(
        first_nonempty(full_name, get("SHIPNAME")), company,
        *[field(rows, n) for n in ("ADDRESS", "ADDRESS2", "CITY_STATE", "STATE", "ZIP")], phone,
    )
    ship_to = address(
        get("SHIPNAME"), company,
        *[field(rows, n) for n in ("SHIPADD", "SHIPADD2", "SHIPCITY", "SHIPSTATE", "SHIPZIP")], phone,
    )
    base = base.withColumns({"_primary": primary, "_ship_to": ship_to})
    places = F.array("_primary", "_ship_to")
    if shipping is not None:
        places = F.concat(places, F.coalesce("shipping", F.array().cast(shipping.schema["shipping"].dataType)))
    labels = [("POS Class", "CLASS"), ("POS Location", "LOC"), ("POS Price Level", "PRICE_LEV")]
    all_tags = F.array_distinct(F.array_compact(F.array(
        *[F.lit(t) for t in tags], *[F.concat(F.lit(f"{label}:"), get(name)) for label, name in labels]
    )))
    tax_exempt = get("TAX_EXEMPT").isNotNull() | F.coalesce(F.upper(get("TAXEXEMPT")).isin("Y", "YES", "TRUE"), F.lit(False))
    bought = till_money(decimal_or_none(field(rows, "TOTAL_PUR"))).cast("string")
    note_parts = [
        ("POS customer", get("CUST_NUM")), ("Company", get("COMPANY")), ("Last activity", get("LAST_ACT")),
        ("Total purchased", bought), ("Class", get("CLASS")), ("Location", get("LOC")),
    ]
    note = F.nullif(F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), v) for label, v in note_parts]), F.lit(""))
    plain = [
        ("source_file", "source"), ("customer_number", "CUST_NUM"), ("legacy_customer_number", "MSCUST_NUM"),
    ]
    plain_after = [
        ("last_activity", "LAST_ACT"), ("start_date", "START_DATE"), ("first_contact", "FIRST_CONT"),
        ("edit_date", "EDITDATE"), ("customer_class", "CLASS"), ("price_level", "PRICE_LEV"), ("location", "LOC"),
    ]
    amounts = [("total_purchased", "TOTAL_PUR"), ("ytd", "YTD"), ("qtd", "QTD"), ("lastq", "LASTQ")]
    entries = [
        *[(k, field(rows, n), LINE) for k, n in plain],
        ("web_customer_number", nonzero_or_text(field(rows, "WEBCUSTNUM")), LINE),
        *[(k, field(rows, n), LINE) for k, n in plain_after],
        *[(k, nonzero_money_text(field(rows, n)), LINE) for k, n in amounts],
    ]
    no_identity = F.coalesce("_email", "_phone", "_first", "_last", "_company").isNull()
    skip = F.when(is_deleted(field(rows, "DELETED")), "deleted").when(no_identity, "missing_identity")
    return base.select(
        "source", *arrival, F.col("_num").alias("pos_customer_number"), F.col("_first").alias("first_name"),
        F.col("_last").alias("last_name"), company.alias("company"), F.col("_email").alias("email"), phone.alias("phone"),
        dedupe_addresses(places).alias("addresses"), all_tags.alias("tags"), tax_exempt.alias("tax_exempt"),
        note.alias("note"), metafields(entries).alias("metafields"), get("LAST_ACT").alias("last_activity"),
        bought.alias("total_purchased"), skip.alias("skip"),
    )


def identity_key(*columns: str) -> Column:
    """First of e-mail, phone and customer number; else a hash of the whole record."""
    named = [
        F.concat(F.lit(f"{c}:"), F.lower(clean_text(F.col(c)))) for c in ("email", "phone", "pos_customer_number")
    ]
    return F.coalesce(*named, F.sha2(F.to_json(F.struct(*columns)), 256))


def dedupe_customers(customers: DataFrame, order: Sequence[str] = ("source_rank", "_rec_no")) -> DataFrame:
    """First customer per identity, over all sources in source then file order."""
    columns = [c for c in customers.columns if c not in order]
    kept = customers.where("skip IS NULL").groupBy(identity_key(*columns).alias("identity")).agg(
        F.min_by(F.struct(*customers.columns), order_key(order)).alias("_c"), F.count(F.lit(1)).alias("copies")
    )
    return kept.select("identity", "copies", "_c.*")


def load_customers(
    sources: Sequence[tuple[str, DataFrame]], custship: DataFrame | None = None,
    tags: Sequence[str] = ("POS Customer",), limit: int | None = None,
) -> DataFrame:
    """Union up to three sources in order, build, and keep one row per identity."""
    frames = [df.withColumns({"source": F.lit(name), "source_rank": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    shipping = shipping_addresses(custship) if custship is not None else None
    kept = dedupe_customers(build_customers(rows, shipping, tags))
    return kept.orderBy("source_rank", "_rec_no").limit(limit) if limit is not None else kept


def match_key(default_source: str = "Customer.dbf") -> Column:
    """Storefront identity: ``source:number``, else e-mail, else phone; null is an error."""
    number = F.nullif(F.trim("pos_customer_number"), F.lit(""))
    source = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit(default_source))
    return F.coalesce(
        F.concat(F.lit("id:"), source, F.lit(":"), number),
        F.concat(F.lit("email:"), F.nullif("email", F.lit(""))),
        F.concat(F.lit("phone:"), F.nullif("phone", F.lit(""))),
    )


def display_name() -> Column:
    name = F.trim(F.concat_ws(" ", F.nullif("first_name", F.lit("")), F.nullif("last_name", F.lit(""))))
    return first_nonempty(name, F.col("company"), F.col("email"), F.col("phone"), F.col("pos_customer_number"), F.lit("POS customer"))


def read_storefront_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text of a storefront CSV export: byte order mark, doubled quotes and notes over several lines.

    A file with such notes cannot be split, so each file is one task; the
    storefront exports in parts of a bounded size.
    """
    rows = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return rows.withColumnsRenamed({c: c.lstrip("\ufeff") for c in rows.columns})


def read_existing_customers(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, emails, phones) already online, from the storefront's CSV export."""
    rows = rows.withColumnsRenamed({c: c.lstrip("﻿") for c in rows.columns})
    ids = rows.select(F.explode(pos_ids_in_tags(F.col("Tags"))).alias("pos_id")).distinct()
    emails = rows.select(normalize_email(F.col("Email")).alias("email")).where("email IS NOT NULL").distinct()
    phones = rows.select(
        F.explode(F.array(*[normalize_us_phone(F.col(f"`{c}`")) for c in ("Phone", "Default Address Phone")])).alias("phone")
    ).where("phone IS NOT NULL").distinct()
    return ids, emails, phones


def missing_customers(customers: DataFrame, ids: DataFrame, emails: DataFrame, phones: DataFrame) -> DataFrame:
    """Customers whose number, e-mail and phone are all unknown: three anti-joins."""
    rows = customers.withColumns({
        "_id": F.lower(clean_text(F.col("pos_customer_number"))),
        "_email": normalize_email(F.col("email")), "_phone": normalize_us_phone(F.col("phone")),
    })
    rows = rows.join(ids.select(F.col("pos_id").alias("_id")), "_id", "left_anti")
    rows = rows.join(emails.select(F.col("email").alias("_email")), "_email", "left_anti")
    rows = rows.join(phones.select(F.col("phone").alias("_phone")), "_phone", "left_anti")
    return rows.drop("_id", "_email", "_phone")


# -- storefront CSV ----------------------------------------------------------

def csv_rows(customers: DataFrame) -> DataFrame:
    """The 18 storefront columns plus the arrival columns."""
    a = F.try_element_at("addresses", F.lit(1))
    country = country_code(a["country_code"])
    tags = F.filter(F.transform("tags", csv_text), lambda t: t != "")
    for label, column in (("POS ID", "pos_customer_number"), ("POS Source", "source")):
        text = csv_text(F.col(column))
        tag = F.concat(F.lit(f"{label}:"), text)
        tags = F.when((text != "") & ~F.array_contains(tags, tag), F.array_append(tags, tag)).otherwise(tags)
    values = [
        csv_text(F.col("first_name")), csv_text(first_nonempty(F.col("last_name"), F.col("company"))),
        csv_text(F.col("email")), F.lit("no"), csv_text(first_nonempty(a["company"], F.col("company"))),
        csv_text(a["address1"]), csv_text(a["address2"]), csv_text(a["city"]),
        province_code(a["province_code"], country), country, csv_text(a["zip"]),
        csv_text(first_nonempty(a["phone"], F.col("phone"))), csv_text(F.col("phone")), F.lit("no"), F.lit("no"),
        F.array_join(tags, ", "), csv_text(F.col("note")), F.when(F.col("tax_exempt"), "yes").otherwise("no"),
    ]
    arrival = [c for c in ("source_rank", "_rec_no") if c in customers.columns]
    return customers.select(*arrival, *[v.alias(n) for n, v in zip(CSV_COLUMNS, values)])


def clear_duplicate_contacts(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Blank an e-mail or phone that an earlier row already has.

    The owner of each contact is a partial minimum joined back by key, so a
    contact shared by a third of all rows never sits in one sort.
    """
    rows = rows.withColumns({
        "_at": order_key(order), "_email": F.lower(F.nullif("Email", F.lit(""))), "_phone": F.nullif("Phone", F.lit("")),
    })
    for key in ("_email", "_phone"):
        owners = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_at").alias(f"{key}_owner"))
        rows = rows.join(owners, key, "left")
    email_later = F.coalesce(F.col("_at") > F.col("_email_owner"), F.lit(False))
    phone_later = F.coalesce(F.col("_at") > F.col("_phone_owner"), F.lit(False))
    same = F.col("Default Address Phone") == F.col("Phone")
    return rows.withColumns({
        "email_cleared": email_later, "phone_cleared": phone_later,
        "Email": F.when(email_later, "").otherwise(F.col("Email")),
        "Default Address Phone": F.when(phone_later & same, "").otherwise(F.col("Default Address Phone")),
        "Phone": F.when(phone_later, "").otherwise(F.col("Phone")),
    }).drop("_at", "_email", "_phone", "_email_owner", "_phone_owner")


def csv_line(columns: Sequence[str]) -> Column:
    """One RFC 4180 line; only cells that need it are quoted."""
    def cell(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\r\n]'), quoted).otherwise(text)

    return F.concat(F.concat_ws(",", *[cell(c) for c in columns]), F.lit("\n"))
