"""Form bodies, stored pages, exact DBF numbers and refused sources."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillbridge.operators import pages, storefront
from tillbridge.sources import dbf, events

FORM = "application/x-www-form-urlencoded"


def fields(spark, body, kind):
    df = spark.createDataFrame([(body, kind)], "body string, kind string")
    return df.select(events.payload_fields(F.col("body"), F.col("kind"), ("token",)).alias("m")).first()["m"]


@pytest.mark.parametrize("body, kind, want", [
    ("a=1&b=x+y%20z&a=2&a=&c", FORM, {"a": '["1","2",""]', "b": "x y z", "c": ""}),
    ("name=caf%C3%A9%zz&&=v&100%=1&token=t", f"{FORM}; charset=utf-8", {"name": "café%zz", "": "v", "100%": "1"}),
    ("a=b=c", FORM.upper(), {"a": "b=c"}),
    ("", FORM, {}),
    ('{"a": [1], "b": null}', "application/json", {"a": "[1]", "b": None}),
    ("no json", "text/plain", None),
    ('--x\r\nContent-Disposition: form-data; name="t"\r\n\r\nline 1\r\nline 2\r\n--x\r\nContent-Disposition: form-data; name="f"; filename="n"\r\n\r\nbytes\r\n--x--\r\n', "multipart/form-data; boundary=x", {"t": "line 1\r\nline 2"}),
])
def test_fields_of_bodies(spark, body, kind, want):
    assert fields(spark, body, kind) == want


def test_bad_escapes_make_error_rows_on_request(spark):
    df = spark.createDataFrame([("sku=a&title=50%+off", FORM), ("sku=b&price=x", FORM), ("sku=c", "text/plain")], "payload string, kind string")
    lenient = events.parse_product_events(df, content_type="kind")
    assert rows(lenient, "sku", "title", "error") == sorted([("a", "50% off", None), ("b", None, "invalid_price"), (None, None, "unsupported_content_type")], key=str)
    strict = events.parse_product_events(df, content_type="kind", refuse_bad_escapes=True)
    assert rows(strict.where("sku = 'a'"), "error") == [("invalid_form_escape",)]


def test_a_page_opens_only_its_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = pages.store_pages(spark.range(2000).select((F.col("id") * 7 % 2000).alias("k"), F.lit("x").alias("v")).repartition(5), ["k"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for number, size in ((1, 50), (17, 50), (40, 50), (41, 50), (3, 1000), (0, 0)):
        page = pages.read_page(spark, folder, number, size)
        start, size = (max(1, number) - 1) * max(1, min(size, 250)), max(1, min(size, 250))
        assert [r["k"] for r in page.collect()] == list(range(2000))[start:start + size]
        assert sum("/rows/" in f for f in page.inputFiles()) <= 3
    assert len(spark.read.parquet(f"{folder}/rows").inputFiles()) >= 10


def test_exact_numbers_keep_every_digit(spark, tmp_path):
    wide = (("A", 12, 2), ("B", 60, 2), ("C", 6, 0))
    head = bytearray(dbf.header_bytes(tuple(dbf.DbfField(n, "N", w, d) for n, w, d in wide), 4))
    values = [("12.345", "1" * 25, "13.5"), ("1E2", "-.5", "x"), ("+.0625", "9" * 36 + ".25", ""), ("1e-3", "7.", "12.50")]
    (tmp_path / "n.dbf").write_bytes(bytes(head) + b"".join(b" " + b"".join(v.encode().rjust(w) for v, (_, w, _) in zip(r, wide)) for r in values) + b"\x1a")
    assert dbf.number_census(spark, str(tmp_path)) == {"A": (14, 4), "B": (38, 2), "C": (7, 1)}
    got = dbf.read_exact_dbf(spark, str(tmp_path)).orderBy("_rec_no").select(F.col("A").cast("string"), F.col("B").cast("string"), F.col("C").cast("string"), "_raw_C").collect()
    assert [tuple(r) for r in got] == [
        ("12.3450", "1" * 25 + ".00", "13.5", None), ("100.0000", "-0.50", None, "x"), ("0.0625", "9" * 36 + ".25", None, None), ("0.0010", "7.00", "12.5", None),
    ]
    (tmp_path / "n.dbf").write_bytes(bytes(head) + b"".join(b" " + b"1".rjust(12) + v.encode().rjust(60) + b"1".rjust(6) for v in ("8" * 39, "1.5", "2", "3")) + b"\x1a")
    assert dbf.number_census(spark, str(tmp_path))["B"] == "text"
    assert [r["B"] for r in dbf.read_exact_dbf(spark, str(tmp_path), columns="B").orderBy("_rec_no").collect()] == ["8" * 39, "1.5", "2", "3"]


def test_a_short_source_is_refused(spark):
    source = spark.createDataFrame([("a",), ("A ",), (" ",)], "sku string")
    online = spark.createDataFrame([(1, "active", "a", False, "a. 1 1")], "product_id long, status string, marker string, truncated boolean, sku string")
    with pytest.raises(ValueError, match="fewer than 3"):
        storefront.reconcile_catalog(source, online, minimum=3)
    assert storefront.reconcile_catalog(source, online, minimum=2).count() == 1
