from conftest import rows
from pyspark.sql import functions as F

from tillbridge.operators import orders


def change(spark, seq, order_id, topic="orders/create", items=(), **order):
    body = {"line_items": [dict(i) for i in items], **order}
    return spark.createDataFrame([(seq, 1, order_id, "#1", topic, body)], orders.CHANGE)


LINE = {"id": "11", "sku": "S", "quantity": 2, "price": "20.00", "total_discount": "0.00", "tax_lines": [{"price": "1.60"}, {"price": "1.60"}]}


def test_line_amounts(spark):
    got = rows(orders.order_lines(change(spark, 1, "1", items=[LINE])), "EXTENSION", "TAX", "TRUNCATED", "LINE_KEY", "LINE_NO")
    assert got == [("40.00", "3.20", False, "11", 1)]


def test_bad_and_three_decimal_amounts(spark):
    bad = dict(LINE, id="", price="1.005", tax_lines=[{"price": "free"}])
    got = rows(orders.order_lines(change(spark, 1, "1", items=[bad])), "UNIT_PRICE", "TAX", "TRUNCATED", "LINE_KEY")
    assert got == [("1.00", "0.00", True, "line-1")]


def test_note_is_split_and_flagged(spark):
    df = spark.createDataFrame([("é" * 300,), ("日本",), (None,)], "note string")
    first, second, changed = orders.split_note(F.col("note"))
    got = rows(df.select(F.length(first).alias("a"), F.length(second).alias("b"), changed.alias("c")))
    assert got == sorted([(254, 46, False), (2, None, True), (None, None, False)], key=str)


def existing(spark, status="IMPORTED"):
    heads = orders.order_headers(change(spark, 0, "1"), "t0").withColumns({"IMPORT_ST": F.lit(status), "POS_ORD_NO": F.lit("N1")})
    return heads, orders.order_lines(change(spark, 0, "1", items=[LINE]))


def test_update_keeps_till_fields_and_replaces_lines(spark):
    heads, lines = orders.upsert_orders(*existing(spark), change(spark, 1, "1", items=[LINE, dict(LINE, id="12")]), "t1")
    assert rows(heads, "IMPORT_ST", "POS_ORD_NO", "RETAIN_AS") == [("IMPORTED", "N1", "IMPORTED")]
    assert rows(lines, "LINE_KEY") == [("11",), ("12",)]


def test_delete_removes_and_recreate_is_pending_for_retention(spark):
    heads, lines = orders.upsert_orders(*existing(spark), change(spark, 1, "1", topic="orders/delete"), "t1")
    assert heads.count() == 0 and lines.count() == 0
    both = change(spark, 1, "1", topic="orders/delete").union(change(spark, 2, "1"))
    heads, _ = orders.upsert_orders(*existing(spark), both, "t1")
    assert rows(heads, "RETAIN_AS") == [("PENDING",)]


def headers(spark, count, status):
    return spark.createDataFrame(
        [(f"{status[0]}{i:04d}", f"2024-01-{i % 28 + 1:02d}", None, status) for i in range(count)], "ORDER_ID string, ORDER_AT string, SYNCED_AT string, IMPORT_ST string"
    )


def test_retention_never_evicts_protected(spark):
    lines = spark.createDataFrame([("P0001",)], "ORDER_ID string")
    pending, done = headers(spark, 101, "PENDING"), headers(spark, 40, "IMPORTED")
    kept, _ = orders.retain_orders(pending, lines, 1, pending.select("ORDER_ID"))
    assert kept.count() == 101
    kept, _ = orders.retain_orders(pending, lines, 1, pending.where("false").select("ORDER_ID"))
    assert kept.count() == 100
    kept, left = orders.retain_orders(headers(spark, 70, "PENDING").union(done), lines, 100, pending.where("false").select("ORDER_ID"))
    assert rows(kept.groupBy("IMPORT_ST").count()) == [("IMPORTED", 30), ("PENDING", 70)]
    assert left.count() == 1


def test_integrity_problems(spark):
    heads = spark.createDataFrame([("1", "g", 2), ("2", "g", 0), ("2", "g", 0), ("", "g", 0)], "ORDER_ID string, GEN_ID string, LINE_COUNT int")
    lines = spark.createDataFrame([("1", "a", "g"), ("1", "a", "g"), ("9", "z", "h")], "ORDER_ID string, LINE_KEY string, GEN_ID string")
    found = {r[0] for r in rows(orders.check_order_integrity(heads, lines), "problem")}
    assert found == {"missing_order_id", "duplicate_order_id", "orphan_lines", "duplicate_line_key", "mixed_generations"}
    clean_heads, clean_lines = orders.stamp_generation(heads.where("ORDER_ID = '1'").withColumn("SRC_VER", F.lit(3)), lines.where("ORDER_ID = '1'").dropDuplicates(["LINE_KEY"]), "g2")
    assert orders.check_order_integrity(clean_heads, clean_lines).count() == 0
    assert rows(clean_lines, "SRC_VER", "GEN_ID") == [(3, "g2")]


def test_fit_reports_numbers_that_are_too_wide(spark):
    df = spark.createDataFrame([("1234567", "ok"), ("1.005", "cafł")], "A string, B string")
    out = orders.fit_fixed_width(df, [("A", "N", 6, 2), ("B", "C", 3, 0)])
    assert rows(out, "A", "B", "TRUNCATED", "width_error") == [("1.00", "caf", "T", None), ("1234567.00", "ok", "F", "A")]
