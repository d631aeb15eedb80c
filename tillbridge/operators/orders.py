"""Order inbox: header and line tables, upsert, retention, integrity, import."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbridge.functions.money import EXACT, money_text, text_decimal, till_money
from tillbridge.functions.text import has_unencodable, to_cp1252
from tillbridge.operators.ordering import number_within
from tillbridge.session import materialize

# Header table layout (name, type, width, decimals).
HEADER_LAYOUT = [
    ("GEN_ID", "C", 32, 0), ("ORDER_ID", "C", 24, 0), ("INVOICE_NO", "C", 32, 0), ("ORDER_NUM", "C", 24, 0),
    ("CONFIRM_NO", "C", 64, 0), ("ORDER_AT", "C", 35, 0), ("UPDATED_AT", "C", 35, 0), ("PROC_AT", "C", 35, 0),
    ("CANCEL_AT", "C", 35, 0), ("CLOSED_AT", "C", 35, 0), ("FIN_STATUS", "C", 24, 0), ("FUL_STATUS", "C", 24, 0),
    ("CURRENCY", "C", 3, 0), ("CUST_NAME", "C", 80, 0), ("CUST_FIRST", "C", 40, 0), ("CUST_LAST", "C", 40, 0),
    ("EMAIL", "C", 254, 0), ("PHONE", "C", 30, 0), ("BILL_NAME", "C", 80, 0), ("BILL_FIRST", "C", 40, 0),
    ("BILL_LAST", "C", 40, 0), ("BILL_COMP", "C", 80, 0), ("BILL_ADR1", "C", 100, 0), ("BILL_ADR2", "C", 100, 0),
    ("BILL_CITY", "C", 50, 0), ("BILL_PROV", "C", 40, 0), ("BILL_PCODE", "C", 10, 0), ("BILL_CTRY", "C", 40, 0),
    ("BILL_CCODE", "C", 2, 0), ("BILL_ZIP", "C", 20, 0), ("BILL_PHONE", "C", 30, 0), ("SHIP_NAME", "C", 80, 0),
    ("SHIP_FIRST", "C", 40, 0), ("SHIP_LAST", "C", 40, 0), ("SHIP_COMP", "C", 80, 0), ("SHIP_ADR1", "C", 100, 0),
    ("SHIP_ADR2", "C", 100, 0), ("SHIP_CITY", "C", 50, 0), ("SHIP_PROV", "C", 40, 0), ("SHIP_PCODE", "C", 10, 0),
    ("SHIP_CTRY", "C", 40, 0), ("SHIP_CCODE", "C", 2, 0), ("SHIP_ZIP", "C", 20, 0), ("SHIP_PHONE", "C", 30, 0),
    ("SHIP_METH", "C", 80, 0), ("SUBTOTAL", "N", 18, 2), ("DISCOUNT", "N", 18, 2), ("SHIPPING", "N", 18, 2),
    ("HANDLING", "N", 18, 2), ("TAX", "N", 18, 2), ("TOTAL", "N", 18, 2), ("NOTE1", "C", 254, 0),
    ("NOTE2", "C", 254, 0), ("TAGS", "C", 200, 0), ("PRINT_ST", "C", 12, 0), ("PRINTED_AT", "C", 35, 0),
    ("IMPORT_ST", "C", 12, 0), ("IMPORTEDAT", "C", 35, 0), ("POS_ORD_NO", "C", 32, 0), ("IMP_ERROR", "C", 200, 0),
    ("SRC_EVENT", "C", 24, 0), ("SRC_VER", "N", 10, 0), ("SYNCED_AT", "C", 35, 0), ("LINE_COUNT", "N", 6, 0),
    ("TRUNCATED", "L", 1, 0),
]

# Line table layout.
DETAIL_LAYOUT = [
    ("GEN_ID", "C", 32, 0), ("ORDER_ID", "C", 24, 0), ("INVOICE_NO", "C", 32, 0), ("LINE_NO", "N", 6, 0),
    ("LINE_KEY", "C", 32, 0), ("LINE_ID", "C", 24, 0), ("PRODUCT_ID", "C", 24, 0), ("VARIANT_ID", "C", 24, 0),
    ("SKU", "C", 64, 0), ("QTY", "N", 10, 0), ("CURR_QTY", "N", 10, 0), ("UNIT_PRICE", "N", 18, 2),
    ("DISCOUNT", "N", 18, 2), ("TAX", "N", 18, 2), ("EXTENSION", "N", 18, 2), ("DESCRIPT", "C", 254, 0),
    ("VAR_TITLE", "C", 254, 0), ("VENDOR", "C", 100, 0), ("GRAMS", "N", 12, 0), ("REQ_SHIP", "L", 1, 0),
    ("FUL_STATUS", "C", 24, 0), ("SRC_VER", "N", 10, 0), ("TRUNCATED", "L", 1, 0),
]

# Header fields the till owns once an order is in the inbox.
TILL_FIELDS = ("PRINT_ST", "PRINTED_AT", "IMPORT_ST", "IMPORTEDAT", "POS_ORD_NO", "IMP_ERROR")
REMOVAL_TOPICS = ("orders/delete", "customers/redact")

ADDRESS = (
    "struct<first_name:string,last_name:string,name:string,company:string,address1:string,address2:string,"
    "city:string,province:string,province_code:string,country:string,country_code:string,zip:string,phone:string>"
)
TAX_LINE = "struct<price:string,price_set:struct<shop_money:struct<amount:string>>>"
LINE_ITEM = (
    "struct<id:string,product_id:string,variant_id:string,sku:string,title:string,variant_title:string,"
    "vendor:string,quantity:bigint,current_quantity:bigint,price:string,total_discount:string,"
    f"tax_lines:array<{TAX_LINE}>,grams:bigint,requires_shipping:boolean,fulfillment_status:string>"
)
ORDER = (
    "struct<id:string,name:string,order_number:string,confirmation_number:string,created_at:string,"
    "updated_at:string,processed_at:string,cancelled_at:string,closed_at:string,financial_status:string,"
    "fulfillment_status:string,currency:string,subtotal_price:string,total_discounts:string,"
    "shipping_price:string,total_tax:string,total_price:string,email:string,phone:string,"
    "customer_first_name:string,customer_last_name:string,note:string,tags:string,redacted:boolean,"
    f"billing_address:{ADDRESS},shipping_address:{ADDRESS},line_items:array<{LINE_ITEM}>,"
    "shipping_lines:array<struct<id:string,code:string,title:string,price:string,discounted_price:string>>>"
)
CHANGE = f"seq bigint, version bigint, order_id string, order_name string, topic string, order {ORDER}"


def _text(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def _joined(*columns: Column) -> Column:
    return F.nullif(F.concat_ws(" ", *[_text(c) for c in columns]), F.lit(""))


def split_note(note: Column) -> tuple[Column, Column, Column]:
    """(first 254 bytes, next 254 bytes, changed) in a single-byte encoding."""
    first = F.nullif(to_cp1252(F.substring(note, 1, 254)), F.lit(""))
    second = F.nullif(to_cp1252(F.substring(note, 255, 254)), F.lit(""))
    return first, second, F.coalesce(has_unencodable(note) | (F.length(note) > 508), F.lit(False))


def order_id(change: str = "order_id") -> Column:
    return F.coalesce(_text(F.col(change)), _text(F.col("order.id")))


def is_removal() -> Column:
    return F.coalesce(F.col("topic").isin(*REMOVAL_TOPICS) | F.col("order.redacted"), F.lit(False))


def order_headers(changes: DataFrame, synced_at: str, *carried: str) -> DataFrame:
    """Header row of each order change, with the ``carried`` columns of the change."""
    o = F.col("order")
    bill, ship = o["billing_address"], o["shipping_address"]
    names = {p: F.coalesce(_text(a["name"]), _joined(a["first_name"], a["last_name"])) for p, a in (("BILL", bill), ("SHIP", ship))}
    blocks = {}
    for prefix, a in (("BILL", bill), ("SHIP", ship)):
        blocks |= {
            f"{prefix}_NAME": names[prefix], f"{prefix}_FIRST": _text(a["first_name"]), f"{prefix}_LAST": _text(a["last_name"]),
            f"{prefix}_COMP": a["company"], f"{prefix}_ADR1": a["address1"], f"{prefix}_ADR2": a["address2"],
            f"{prefix}_CITY": a["city"], f"{prefix}_PROV": a["province"], f"{prefix}_PCODE": a["province_code"],
            f"{prefix}_CTRY": a["country"], f"{prefix}_CCODE": a["country_code"], f"{prefix}_ZIP": a["zip"],
            f"{prefix}_PHONE": a["phone"],
        }
    methods = F.filter(
        F.transform(o["shipping_lines"], lambda s: F.trim(F.coalesce(F.nullif(s["title"], F.lit("")), s["code"], F.lit("")))),
        lambda t: t != "",
    )
    note1, note2, note_changed = split_note(F.nullif(o["note"], F.lit("")))

    def number(name: str) -> Column:
        return F.nullif(o[name], F.lit(""))

    null = F.lit(None).cast("string")
    columns = {
        "ORDER_ID": order_id(), "INVOICE_NO": F.coalesce(F.nullif(o["name"], F.lit("")), "order_name"),
        "ORDER_NUM": F.nullif(o["order_number"], F.lit("")), "CONFIRM_NO": o["confirmation_number"],
        "ORDER_AT": o["created_at"], "UPDATED_AT": o["updated_at"], "PROC_AT": o["processed_at"],
        "CANCEL_AT": o["cancelled_at"], "CLOSED_AT": o["closed_at"], "FIN_STATUS": o["financial_status"],
        "FUL_STATUS": o["fulfillment_status"], "CURRENCY": o["currency"],
        "CUST_NAME": F.coalesce(_joined(o["customer_first_name"], o["customer_last_name"]), names["BILL"], names["SHIP"]),
        "CUST_FIRST": _text(o["customer_first_name"]), "CUST_LAST": _text(o["customer_last_name"]),
        "EMAIL": o["email"], "PHONE": o["phone"], **blocks,
        "SHIP_METH": F.nullif(F.array_join(methods, ", "), F.lit("")),
        "SUBTOTAL": number("subtotal_price"), "DISCOUNT": number("total_discounts"), "SHIPPING": number("shipping_price"),
        "HANDLING": F.lit("0.00"), "TAX": number("total_tax"), "TOTAL": number("total_price"),
        "NOTE1": note1, "NOTE2": note2, "TAGS": o["tags"], "PRINT_ST": F.lit("PENDING"), "PRINTED_AT": null,
        "IMPORT_ST": F.lit("PENDING"), "IMPORTEDAT": null, "POS_ORD_NO": null, "IMP_ERROR": null,
        "SRC_EVENT": F.coalesce(F.nullif("topic", F.lit("")), F.lit("orders/updated")),
        "SRC_VER": F.coalesce(F.nullif(F.col("version"), F.lit(0)), F.lit(1)), "SYNCED_AT": F.lit(synced_at),
        "TRUNCATED": note_changed,
    }
    return changes.select(*[c.alias(n) for n, c in columns.items()], *carried)


def line_tax(tax_lines: Column) -> tuple[Column, Column]:
    """(sum at two places, coerced): unreadable entries are skipped and flagged."""
    amounts = F.transform(
        tax_lines, lambda t: text_decimal(F.coalesce(F.nullif(t["price"], F.lit("")), t["price_set"]["shop_money"]["amount"]))
    )
    narrow = lambda x: x.try_cast("decimal(37,10)")  # noqa: E731  # a sum of two keeps ten decimals; of two EXACT ones it has nine
    total = F.aggregate(
        F.filter(amounts, lambda a: a.isNotNull()), F.lit(0).cast(EXACT),
        lambda acc, a: F.coalesce((narrow(acc) + narrow(a)).cast(EXACT), (acc + a).cast(EXACT)),
    )
    total = F.coalesce(total, F.lit(0).cast(EXACT))
    bad = F.coalesce(F.exists(amounts, lambda a: a.isNull()), F.lit(False))
    return till_money(total), bad | (till_money(total) != total)


def line_total(price: Column, quantity: Column, discount: Column) -> Column:
    """price x quantity - discount, half-even; null without a price."""
    amount = price.try_cast(EXACT) * quantity.cast("decimal(18,0)") - F.coalesce(discount, F.lit("0")).try_cast(EXACT)
    return till_money(amount)


def order_lines(changes: DataFrame) -> DataFrame:
    """Line rows of each order change, numbered from 1."""
    rows = changes.select(
        order_id().alias("ORDER_ID"), F.coalesce(F.nullif(F.col("order.name"), F.lit("")), "order_name").alias("INVOICE_NO"),
        F.coalesce(F.nullif(F.col("version"), F.lit(0)), F.lit(1)).alias("SRC_VER"),
        F.posexplode("order.line_items").alias("pos", "item"),
    )
    item, number = F.col("item"), F.col("pos") + 1
    line_id = _text(item["id"])
    quantity = F.coalesce(item["quantity"], F.lit(0))
    price, discount = money_text(item["price"]), money_text(item["total_discount"])
    tax, coerced = line_tax(item["tax_lines"])
    columns = {
        "ORDER_ID": F.col("ORDER_ID"), "INVOICE_NO": F.col("INVOICE_NO"), "LINE_NO": number,
        "LINE_KEY": F.coalesce(line_id, F.concat(F.lit("line-"), number.cast("string"))), "LINE_ID": line_id,
        "PRODUCT_ID": F.nullif(item["product_id"], F.lit("")), "VARIANT_ID": F.nullif(item["variant_id"], F.lit("")),
        "SKU": _text(item["sku"]), "QTY": quantity, "CURR_QTY": item["current_quantity"], "UNIT_PRICE": price,
        "DISCOUNT": discount, "TAX": tax.cast("string"), "EXTENSION": line_total(price, quantity, discount).cast("string"),
        "DESCRIPT": item["title"], "VAR_TITLE": item["variant_title"], "VENDOR": item["vendor"], "GRAMS": item["grams"],
        "REQ_SHIP": item["requires_shipping"], "FUL_STATUS": item["fulfillment_status"], "SRC_VER": F.col("SRC_VER"),
        "TRUNCATED": coerced,
    }
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def latest_changes(changes: DataFrame) -> DataFrame:
    """Last change of each order, with ``removed`` and ``ever_removed``.

    Only ids and positions are aggregated; the payload is fetched by
    (order, position), which no single order can skew.
    """
    keyed = changes.withColumns({"_order": order_id(), "removed": is_removal()})
    last = keyed.groupBy("_order").agg(F.max("seq").alias("seq"), F.bool_or("removed").alias("ever_removed"))
    return keyed.join(last, ["_order", "seq"])


def upsert_orders(headers: DataFrame, lines: DataFrame, changes: DataFrame, synced_at: str) -> tuple[DataFrame, DataFrame]:
    """Apply order changes: headers merged, lines replaced as a set.

    Orders already in the inbox keep their six till fields. ``RETAIN_AS`` is
    the import status retention and acknowledgement go by: a removal among the
    changes makes the re-created order pending again. The latest changes and
    the merged headers are stored once, so that every later step reads them.
    """
    latest = materialize(latest_changes(changes), "latest-changes")
    live = latest.where("NOT removed")
    fresh = order_headers(live, synced_at, "ever_removed")
    gone = latest.where("removed").select(F.col("_order").alias("ORDER_ID"), F.lit(True).alias("_gone"))
    touched = fresh.select("ORDER_ID", F.struct("*").alias("_new")).unionByName(gone, allowMissingColumns=True)
    rows = headers.select("ORDER_ID", F.struct("*").alias("_old")).join(touched, "ORDER_ID", "full").where("_gone IS NULL")

    known, renewed = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    merged = {}
    for name in dict.fromkeys([*headers.columns, *fresh.drop("ever_removed").columns]):
        old = F.col(f"_old.{name}") if name in headers.columns else F.lit(None)
        new = F.col(f"_new.{name}") if name in fresh.columns else F.lit(None)
        merged[name] = F.when(known, old).otherwise(new) if name in TILL_FIELDS else F.when(renewed, new).otherwise(old)
    merged["RETAIN_AS"] = F.when(known & ~F.coalesce("_new.ever_removed", F.lit(False)), F.col("_old.IMPORT_ST")).otherwise(F.col("_new.IMPORT_ST"))
    new_headers = materialize(rows.select(*[c.alias(n) for n, c in merged.items()]), "inbox-headers")
    changed = latest.select(F.col("_order").alias("ORDER_ID"))
    new_lines = lines.join(changed, "ORDER_ID", "left_anti").unionByName(order_lines(live), allowMissingColumns=True)
    return new_headers, new_lines


def imported(status: str = "IMPORT_ST") -> Column:
    return F.upper(F.trim(F.coalesce(F.col(status), F.lit("")))) == "IMPORTED"


def retain_orders(headers: DataFrame, lines: DataFrame, limit: int, protected: DataFrame, status: str = "IMPORT_ST") -> tuple[DataFrame, DataFrame]:
    """Bound the inbox: protected pending, then oldest pending, then newest imported.

    The two ordered classes are ranked with a group limit, which every task
    applies before the shuffle: at most ``limit`` rows of each travel on.
    Protected orders are never ranked or cut. Headers are stored once with
    their class, which each branch reads.
    """
    limit = max(100, limit)
    at = F.coalesce(F.nullif("ORDER_AT", F.lit("")), F.nullif("SYNCED_AT", F.lit("")), F.lit(""))
    oid = F.coalesce("ORDER_ID", F.lit(""))
    marks = protected.select("ORDER_ID", F.lit(True).alias("_protected")).distinct()
    rows = headers.join(marks, "ORDER_ID", "left")
    kind = F.when(imported(status), "imported").when(F.col("_protected"), "protected").otherwise("pending")
    rows = materialize(rows.withColumn("_class", kind).drop("_protected"), "inbox-classes")
    pending = F.col("_class") == "pending"
    order = [F.when(pending, at).asc(), F.when(pending, oid).asc(), F.when(~pending, at).desc(), F.when(~pending, oid).desc()]
    ranked = (
        rows.where("_class <> 'protected'")
        .withColumn("_rank", F.row_number().over(Window.partitionBy("_class").orderBy(*order)))
        .where(F.col("_rank") <= limit)
    )
    first = rows.where("_class = 'protected'")
    room = F.greatest(F.lit(0), F.lit(limit) - first.agg(F.count(F.lit(1))).scalar())
    # at most two times ``limit`` rows are left here
    waiting = F.max(F.when(F.col("_class") == "pending", F.col("_rank"))).over(Window.partitionBy())
    taken = F.least(F.coalesce("_waiting", F.lit(0)), room)
    ranked = ranked.withColumn("_waiting", waiting)
    kept = ranked.where(F.col("_rank") <= F.when(pending, room).otherwise(room - taken))
    kept = first.drop("_class").unionByName(kept.drop("_class", "_rank", "_waiting"))
    return kept, lines.join(kept.select("ORDER_ID"), "ORDER_ID", "left_semi")


def delivered_orders(changes: DataFrame, retained: DataFrame, merged: DataFrame) -> DataFrame:
    """(ORDER_ID, delivered) of every changed order; the others are deferred.

    ``merged`` carries RETAIN_AS for orders that survived the changes.
    """
    latest = changes.groupBy(order_id().alias("ORDER_ID")).agg(F.max_by(is_removal(), "seq").alias("removed")).where("ORDER_ID IS NOT NULL")
    rows = latest.join(retained.select("ORDER_ID", F.lit(True).alias("_kept")), "ORDER_ID", "left")
    rows = rows.join(merged.select("ORDER_ID", imported("RETAIN_AS").alias("_imported")), "ORDER_ID", "left")
    hit = F.col("removed") | F.coalesce("_kept", F.lit(False)) | F.coalesce("_imported", F.lit(False))
    return rows.select("ORDER_ID", hit.alias("delivered"))


def check_order_integrity(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """(problem, order_id, value): one row per violated rule and order."""
    oid, key = F.trim(F.coalesce("ORDER_ID", F.lit(""))), F.trim(F.coalesce("LINE_KEY", F.lit("")))
    heads = headers.select(oid.alias("order_id"), F.coalesce("LINE_COUNT", F.lit(0)).cast("bigint").alias("declared"))
    rows = lines.select(oid.alias("order_id"), key.alias("line_key"))

    def problem(name: str, df: DataFrame, value: Column | None = None) -> DataFrame:
        value = F.lit("") if value is None else value
        return df.select(F.lit(name).alias("problem"), "order_id", value.cast("string").alias("value"))

    counts = heads.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"), F.max("declared").alias("declared"))
    actual = rows.groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"))
    per_key = rows.groupBy("order_id", "line_key").agg(F.count(F.lit(1)).alias("n"))
    plain = r"^[\x00-\x7f]*$"
    generations = (
        headers.select(F.trim(F.coalesce("GEN_ID", F.lit(""))).alias("g"))
        .unionByName(lines.select(F.trim(F.coalesce("GEN_ID", F.lit(""))).alias("g")))
        .agg(F.min("g").alias("low"), F.max("g").alias("high"))
        .where("low <> high OR low = ''").select(F.lit("").alias("order_id"))
    )
    mismatch = counts.join(actual, "order_id", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    frames = [
        problem("missing_order_id", counts.where("order_id = ''")),
        problem("duplicate_order_id", counts.where("n > 1 AND order_id <> ''"), F.col("n")),
        problem("bad_order_id", counts.where(~F.col("order_id").rlike(plain) | (F.length("order_id") > 24))),
        problem("orphan_lines", actual.join(counts, "order_id", "left_anti"), F.col("lines")),
        problem("duplicate_line_key", per_key.where("n > 1 OR line_key = ''"), F.col("line_key")),
        problem("bad_line_key", per_key.where(~F.col("line_key").rlike(plain) | (F.length("line_key") > 32)), F.col("line_key")),
        problem("mixed_generations", generations),
        problem("line_count_mismatch", mismatch.where("declared <> lines"), F.col("lines")),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def stamp_generation(headers: DataFrame, lines: DataFrame, generation: str) -> tuple[DataFrame, DataFrame]:
    """One generation id and recounted lines; lines inherit the source version."""
    counts = lines.groupBy("ORDER_ID").agg(F.count(F.lit(1)).alias("LINE_COUNT"))
    heads = headers.drop("LINE_COUNT", "GEN_ID").join(counts, "ORDER_ID", "left").withColumns({
        "LINE_COUNT": F.coalesce("LINE_COUNT", F.lit(0)), "GEN_ID": F.lit(generation),
    })
    versions = headers.select("ORDER_ID", F.col("SRC_VER").alias("_ver"))
    rows = lines.join(versions, "ORDER_ID", "left").withColumn(
        "SRC_VER", F.coalesce("SRC_VER", "_ver") if "SRC_VER" in lines.columns else F.col("_ver")
    ).drop("_ver").withColumn("GEN_ID", F.lit(generation))
    return heads, rows


def importable_orders(headers: DataFrame, lines: DataFrame, already: DataFrame) -> DataFrame:
    """Orders the till may create now; ``already`` lists imported ORDER_IDs."""
    per_order = lines.groupBy("ORDER_ID").agg(
        F.count(F.lit(1)).alias("_lines"), F.bool_or(F.coalesce("TRUNCATED", F.lit(False))).alias("_cut"),
        F.min("GEN_ID").alias("_low"), F.max("GEN_ID").alias("_high"),
    )
    pending = (F.upper(F.trim("IMPORT_ST")) == "PENDING") & (F.coalesce(F.trim("CANCEL_AT"), F.lit("")) == "")
    rows = headers.where(pending & ~F.coalesce("TRUNCATED", F.lit(False))).join(per_order, "ORDER_ID", "left")
    same = (F.col("_lines").isNull()) | ((F.col("_low") == F.col("GEN_ID")) & (F.col("_high") == F.col("GEN_ID")))
    whole = (F.coalesce("_lines", F.lit(0)) == F.col("LINE_COUNT")) & ~F.coalesce("_cut", F.lit(False)) & same
    return rows.where(whole).drop("_lines", "_cut", "_low", "_high").join(already.select("ORDER_ID").distinct(), "ORDER_ID", "left_anti")


def backfill_legacy_orders(
    orders: DataFrame, items: DataFrame, header_names: dict[str, str], line_names: dict[str, str], seq: str, **blocks
) -> tuple[DataFrame, DataFrame]:
    """Rename legacy tables to the inbox layout and fill what they lack.

    ``*_names`` map inbox columns to legacy columns; absent ones become null.
    Lines are numbered by arrival inside their order.
    """
    def renamed(df: DataFrame, names: dict[str, str]) -> list[Column]:
        return [(F.col(old) if old in df.columns else F.lit(None).cast("string")).alias(new) for new, old in names.items()]

    note1, note2, changed = split_note(F.nullif("note", F.lit("")) if "note" in orders.columns else F.lit(None).cast("string"))
    heads = orders.select(*renamed(orders, header_names), note1.alias("NOTE1"), note2.alias("NOTE2"), changed.alias("TRUNCATED"))
    heads = heads.withColumns({
        "HANDLING": F.lit("0.00"), "PRINT_ST": F.coalesce(F.nullif("PRINT_ST", F.lit("")), F.lit("PENDING")),
        "IMPORT_ST": F.coalesce(F.nullif("IMPORT_ST", F.lit("")), F.lit("PENDING")),
    })
    rows = number_within(items.select(*renamed(items, line_names), seq), ["ORDER_ID"], seq, "LINE_NO", **blocks)
    computed = line_total(money_text(F.col("UNIT_PRICE")), F.coalesce("QTY", F.lit(0)), money_text(F.col("DISCOUNT")))
    rows = rows.join(heads.select("ORDER_ID", "INVOICE_NO", "SRC_VER"), "ORDER_ID", "left").withColumns({
        "LINE_KEY": F.coalesce(_text(F.col("LINE_KEY")), F.concat(F.lit("line-"), F.col("LINE_NO").cast("string"))),
        "EXTENSION": F.coalesce(F.nullif(F.col("EXTENSION").cast("string"), F.lit("")), computed.cast("string")),
        "TRUNCATED": F.lit(False),
    })
    return heads, rows


def purge_orders(removals: DataFrame, *tables: DataFrame, key: str = "ORDER_ID") -> tuple[DataFrame, ...]:
    """Drop removed orders from every copy."""
    gone = removals.select(F.trim(key).alias(key)).where(F.col(key) != "").distinct()
    return tuple(t.join(gone, key, "left_anti") for t in tables)


# -- fixed-width fitting -----------------------------------------------------

def fit_fixed_width(df: DataFrame, layout: Sequence[tuple[str, str, int, int]]) -> DataFrame:
    """Fit columns to a fixed-width layout.

    TRUNCATED is set when a value changed. A number too wide for its field is
    an error, named in ``width_error``.
    """
    out: dict[str, Column] = {}
    changed = F.coalesce(F.col("TRUNCATED"), F.lit(False)) if "TRUNCATED" in df.columns else F.lit(False)
    error = F.when(F.lit(False), F.lit(""))
    for name, kind, width, decimals in layout:
        if name == "TRUNCATED":
            continue
        value = F.col(name) if name in df.columns else F.lit(None).cast("string")
        if kind == "C":
            text = value.cast("string")
            fitted = F.nullif(F.rtrim(to_cp1252(F.substring(text, 1, width))), F.lit(""))
            moved = has_unencodable(text) | (F.length(text) > width)
        elif kind == "N":
            text = F.nullif(value.cast("string"), F.lit(""))
            number = text_decimal(text)
            rounded = F.bround(number, decimals)
            fitted = rounded.cast(f"decimal(38,{decimals})").cast("string")
            moved = text.isNotNull() & (number.isNull() | (rounded != number))
            error = error.when(F.length(fitted) > width, name)
        elif kind == "D":
            day = F.trim(value.cast("string")).try_cast("date")
            fitted = F.date_format(day, "yyyyMMdd")
            moved = (F.coalesce(value.cast("string"), F.lit("")) != "") & day.isNull()
        else:
            text = F.lower(F.trim(value.cast("string")))
            fitted = F.when(text.isin("true", "t", "yes", "y", "1"), "T").when(text.isin("false", "f", "no", "n", "0"), "F").otherwise("?")
            moved = text.isNotNull() & ~text.isin("", "?") & (fitted == "?")
        out[name] = fitted
        changed = changed | F.coalesce(moved, F.lit(False))
    columns = [c.alias(n) for n, c in out.items()]
    columns.append(F.when(changed, "T").otherwise("F").alias("TRUNCATED"))
    passed = [c for c in df.columns if c not in out and c != "TRUNCATED"]
    return df.select(*passed, *columns, error.alias("width_error"))
