"""Exports and storefront CSV files."""

import pytest

from tillbridge.operators import customers, reports


@pytest.mark.parametrize("limit,truncated", [(100, True), (100, False), (7, True)])
def test_export_looks_one_row_past_its_limit(spark, limit, truncated):
    rows = spark.range(120).selectExpr("cast(id as int) as _rec_no", "concat('n', id) as name").where(f"_rec_no < {limit} + {int(truncated)}")
    got = reports.export_table(rows, limit).collect()
    assert [r["_rec_no"] for r in got] == list(range(limit)) and {r["truncated"] for r in got} == {truncated}


def test_storefront_csv_with_mark_quotes_and_line_ends(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_bytes(b'\xef\xbb\xbfEmail,Tags,Note\na@x.com,"vip, POS ID:7","two\nlines, ""quoted"""\nb@x.com,,plain\n')
    rows = customers.read_storefront_csv(spark, str(path))
    assert rows.columns == ["Email", "Tags", "Note"]
    assert [tuple(r) for r in rows.orderBy("Email").collect()] == [("a@x.com", "vip, POS ID:7", 'two\nlines, "quoted"'), ("b@x.com", None, "plain")]


def test_core_export_reports_each_table(spark, tmp_path):
    profile = spark.createDataFrame(
        [("Item-00000-0a1b2c3d", 3, ["EMAIL"], None), ("Item-00001-0a1b2c3d", 2, ["EMAIL"], None), ("other", 9, [], None), ("Vendor", 0, [], "broken")],
        "table string, records bigint, sensitive_fields array<string>, error string",
    )
    rows = spark.range(5).selectExpr("'f' as _file", "id as _rec_no", "concat('s', id, ', \"') as SKU")
    report = reports.export_core_tables(profile, lambda name: rows, str(tmp_path / "out"), 4).collect()
    assert [tuple(r) for r in report] == [("Item", 5, 4, True, "EMAIL")]
