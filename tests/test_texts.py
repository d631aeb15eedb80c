import pytest
from pyspark.sql import functions as F

from tillbridge.functions import contact, keys, text, titles
from tillbridge.operators import matrix


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [
    ("BLACK  o'neil-smith", "Black O'Neil-Smith"), ("a&b co.", "A&B CO"), ("tux PKSQ x9z", "TUX PKSQ X9Z"),
    ("mid.town", "Mid.Town"), ("(hello)", "(Hello)"), ("brand#7", "brand#7"), ("x/y suit", "X/Y Suit"),
])
def test_title_case(spark, raw, want):
    assert one(spark, text.smart_title_case(F.lit(raw))) == want


def title(spark, desc, vendor, code, kind, size=None, color=None, second=None):
    return one(spark, titles.smart_title(*[F.lit(v).cast("string") for v in (desc, vendor, code, kind, size, color, second)]))


def test_smart_titles(spark):
    assert title(spark, "ACM-WOOL COAT", "ACME OUTERWEAR", "ACM", "OUTERWEAR", "42R", "NAVY") == "Acme Wool Coat - Navy / 42R"
    assert title(spark, "X12/34", "ACME", None, "SHOES", None, "LT BLUE", "leather sole") == "Acme Shoes X12/34 - Leather Sole - Light Blue"
    assert title(spark, "ACME SHOES", "ACME", None, "SHOE") == "Acme Shoes"


def test_contacts(spark):
    assert one(spark, contact.normalize_email(F.lit(" A@B.co "))) == "a@b.co"
    assert one(spark, contact.normalize_email(F.lit("www.a@b.co"))) is None
    assert one(spark, contact.normalize_us_phone(F.lit("1 (212) 555-0100"))) == "+12125550100"
    assert one(spark, contact.normalize_us_phone(F.lit("777-777-7777"))) is None
    assert tuple(one(spark, contact.split_name(F.lit("ann marie jones")))) == ("Ann", "Marie Jones")
    assert tuple(one(spark, contact.split_name(F.lit("jones")))) == (None, "Jones")
    assert one(spark, contact.province_code(F.lit("new  york"), F.lit("US"))) == "NY"


def test_sku_identity(spark):
    assert one(spark, keys.base_sku(F.lit("21741. 1 10"))) == "21741"
    assert one(spark, keys.base_sku(F.lit("21741"))) == "21741"
    assert one(spark, keys.child_sku(F.lit("21741"), F.lit(1), F.lit(10))) == "21741. 1 10"


@pytest.mark.parametrize("cell, rows, columns, want", [
    ("1 10", 3, 11, (1, 10)), ("110", 3, 11, (1, 10)), ("111", 11, 11, None), ("23", 3, 3, (2, 3)), ("01", 3, 3, None), ("4 1", 3, 3, None), ("", 3, 3, None),
])
def test_parse_cell(spark, cell, rows, columns, want):
    got = one(spark, matrix.parse_cell(F.lit(cell), F.lit(rows), F.lit(columns)))
    assert (tuple(got) if got else None) == want


def test_resolve_variant_row(spark):
    known = spark.createDataFrame([("21741", "21741. 1 10"), ("21741", "21741. 11 1"), ("21741", "21741. 1 11")], "base string, child string")
    cells = spark.createDataFrame([("21741", "110", ""), ("21741", "111", ""), ("21741", "1 11", ""), ("21741", "9", "21741. 11 1")], "sku string, cell string, barcode string")
    got = {(r.cell): r.child for r in matrix.resolve_variant_row(cells, known).collect()}
    assert got == {"110": "21741. 1 10", "111": None, "1 11": "21741. 1 11", "9": "21741. 11 1"}


def test_money_beyond_ten_decimals_rounds_exactly(spark):
    from tillbridge.functions.money import money_text

    given = ["1.005", "1.00500000000001", "1.0050000000000", "1.015", "2.5", "abc", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").select("i", money_text(F.col("x")).alias("m"))
    assert [r["m"] for r in df.orderBy("i").collect()] == ["1.00", "1.01", "1.00", "1.02", "2.50", "abc", None]


def test_all_money_readers_round_exactly(spark):
    from tillbridge.functions import money
    from tillbridge.operators import orders, prices

    given = ["1.00500000000001", "1.0050000000000", "-1.00500000000001", "7", "abc"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    taxed = orders.line_tax(F.from_json(F.concat(F.lit('[{"price":"'), "x", F.lit('"}]')), "array<struct<price:string,price_set:struct<shop_money:struct<amount:string>>>>"))
    got = df.select("i", money.nonzero_money_text(F.col("x")).alias("m"), taxed[0].cast("string").alias("tax"), money.stock_quantity(money.decimal_or_none(F.lit("0.99999999999999"))).alias("q"))
    rows = got.orderBy("i").collect()
    assert [r["m"] for r in rows] == ["1.01", "1.00", "-1.01", "7.00", None]
    assert [r["tax"] for r in rows] == ["1.01", "1.00", "-1.01", "7.00", "0.00"] and {r["q"] for r in rows} == {0}
    snapshot = prices.price_snapshot(df.selectExpr("cast(i as string) as SKU", "x as PRICE", "i as n"), ["n"])
    assert {r["sku"]: r["price"] for r in snapshot.collect()} == {"0": "1.01", "1": "1.00", "3": "7.00"}
    fitted = orders.fit_fixed_width(df.selectExpr("x as AMT"), [("AMT", "N", 8, 2)]).collect()
    assert sorted(str(r["AMT"]) for r in fitted) == ["-1.01", "1.00", "1.01", "7.00", "None"]
