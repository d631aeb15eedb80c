import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillbridge.sources import dbf, profile
from tillbridge.streaming import inbox

FIELDS = (dbf.DbfField("SKU", "C", 12), dbf.DbfField("QTY", "N", 6, 2), dbf.DbfField("WEB", "L", 1), dbf.DbfField("DAY", "D", 8))


def record(sku, qty, web="T", day="20240229", marker=b" "):
    return marker + sku.encode("latin1").ljust(12) + str(qty).encode().rjust(6) + web.encode() + day.encode().ljust(8)


def write(path, records, count=None, end=b"\x1a"):
    head = bytearray(dbf.header_bytes(FIELDS, len(records)))
    if count is not None:
        head[4:8] = struct.pack("<I", count)
    path.write_bytes(bytes(head) + b"".join(records) + end)


def test_lenient_read_skips_deleted_and_keeps_bad_text(spark, tmp_path):
    write(tmp_path / "Item.DBF", [record("A", "1.50"), record("B", 2, marker=b"*"), record("\xe9", "x?", "Z", "2024")])
    df = dbf.read_dbf(spark, str(tmp_path), table="item", keepRaw="true")
    got = rows(df.select("SKU", F.col("QTY").cast("string"), "_raw_QTY", "WEB", "_raw_WEB", "DAY", "_rec_no"))
    assert got == sorted([("A", "1.50", None, True, None, "2024-02-29", 0), ("é", None, "x?", None, "Z", "2024", 2)], key=str)


def test_default_read_keeps_text_the_type_does_not_hold(spark, tmp_path):
    write(tmp_path / "Item.DBF", [record("A", "12.345"), record("B", "1.50")])
    got = rows(dbf.read_dbf(spark, str(tmp_path)).select("SKU", F.col("QTY").cast("string"), "_raw_QTY"))
    assert got == [("A", "12.34", "12.345"), ("B", "1.50", None)]


def test_splits_cover_every_record_once(spark, tmp_path):
    write(tmp_path / "a.dbf", [record(f"S{i}", i) for i in range(95)])
    df = dbf.read_dbf(spark, str(tmp_path), splitRecords="10")
    assert df.rdd.getNumPartitions() == 10
    assert sorted(r[0] for r in df.select("_rec_no").collect()) == list(range(95))


def test_key_filter_is_pushed_into_the_scan(spark, tmp_path):
    write(tmp_path / "a.dbf", [record(f"S{i}", i) for i in range(20)])
    df = dbf.read_dbf(spark, str(tmp_path), columns="SKU,QTY").where(F.col("SKU").isin("S3", "S4"))
    assert df.columns == ["SKU", "QTY", "_rec_no", "_file"]
    assert sorted(r.SKU for r in df.collect()) == ["S3", "S4"]
    reader = dbf.DbfReader(dbf.table_schema(FIELDS, {}), {"path": str(tmp_path)})
    left = list(reader.pushFilters([dbf.In(("SKU",), ("S3",)), dbf.EqualTo(("QTY",), 1)]))
    assert reader.keys == [("SKU", ("S3",))] and left == [dbf.EqualTo(("QTY",), 1)]


@pytest.mark.parametrize("records, count, end, problem", [
    ([record("A", "1.5")], None, b"", "end marker"),
    ([record("A", "1.5")], None, b"\x1ax", "trailing"),
    ([record("A", "1.5")], 2, b"\x1a", "inside a record"),
    ([record("A", "1.555")], None, b"\x1a", "invalid value in QTY"),
    ([record("A", "1.5", "Q")], None, b"\x1a", "invalid value in WEB"),
    ([record("A", "1.5", "T", "20230229")], None, b"\x1a", "invalid value in DAY"),
    ([record("A", "1.5", marker=b"!")], None, b"\x1a", "record marker"),
])
def test_strict_read_rejects(spark, tmp_path, records, count, end, problem):
    write(tmp_path / "a.dbf", records, count, end)
    with pytest.raises(Exception, match=problem):
        dbf.read_dbf(spark, str(tmp_path), mode="strict").collect()


def test_strict_read_checks_the_layout(spark, tmp_path):
    write(tmp_path / "a.dbf", [record("A", "1.5", "?")])
    layout = "SKU:C:12;QTY:N:6:2;WEB:L:1;DAY:D:8"
    assert rows(dbf.read_dbf(spark, str(tmp_path), mode="strict", layout=layout), "SKU", "WEB") == [("A", None)]
    with pytest.raises(Exception, match="expected fields"):
        dbf.read_dbf(spark, str(tmp_path), mode="strict", layout=layout.replace("12", "13")).collect()


def test_two_files_of_one_name_are_ambiguous(spark, tmp_path):
    (tmp_path / "x").mkdir()
    write(tmp_path / "item.dbf", [record("A", 1)])
    write(tmp_path / "x" / "ITEM.DBF", [record("A", 1)])
    with pytest.raises(dbf.DbfError, match="several"):
        dbf.find_files(str(tmp_path), "Item")
    assert profile.profile_tables(spark, str(tmp_path)).where("ambiguous").count() == 2


def test_offsets_skip_half_records_and_report_resets(tmp_path):
    path = tmp_path / "invdtl.dbf"
    write(path, [record(f"S{i}", i) for i in range(5)])
    schema = dbf.table_schema(FIELDS, {}, stream=True)
    reader = dbf.DbfStreamReader(schema, {"path": str(path)})
    start = reader.initialOffset()
    assert start == {str(path): 5}  # first sight starts at the end
    write(path, [record(f"S{i}", i) for i in range(7)] + [record("half", 1)[:9]], 8, b"")
    end = reader.latestOffset()
    assert end == {str(path): 7}
    parts = reader.partitions(start, end)
    assert [r[0] for part in parts for r in reader.read(part)] == ["S5", "S6"]
    write(path, [record("new", 1)])
    parts = reader.partitions(end, reader.latestOffset())
    got = [dict(zip(schema.names, r)) for part in parts for r in reader.read(part)]
    assert len(got) == 1 and got[0]["_reset"] is True and got[0]["_file"] == str(path)


def test_stream_reads_appended_records(spark, tmp_path):
    write(tmp_path / "invdtl.dbf", [record(f"S{i}", i) for i in range(5)])
    landed = inbox.drain(dbf.read_dbf_stream(spark, str(tmp_path / "invdtl.dbf"), startingRecord="3"), "dbf", mode="append")
    assert rows(landed, "SKU", "_rec_no") == [("S3", 3), ("S4", 4)]


def test_profile_reports_broken_files(spark, tmp_path):
    (tmp_path / "bad.dbf").write_bytes(b"x")
    write(tmp_path / "mcust.dbf", [record("A", 1)] * 3)
    got = rows(profile.profile_tables(spark, str(tmp_path)), "table", "category", "records")
    assert got == [("bad", "unreadable", 0), ("mcust", "customers", 3)]


def test_legal_numbers_of_any_spelling_are_kept():
    """Raw field bytes: only text that is no number, or too large for the field, is null."""
    import numpy as np

    from tillbridge.sources.dbf import DbfField, decode_field

    def decoded(texts, width, decimals):
        block = np.frombuffer("".join(t.rjust(width) for t in texts).encode(), np.uint8).reshape(-1, width)
        values, rejected = decode_field(block, DbfField("X", "N", width, decimals), 0, "latin1", False)
        return [None if v is None else str(v) for v in values.to_pylist()], rejected.to_pylist()

    values, rejected = decoded([".50", "-.25", "12.345", "1E2", "+3", "7.", "", "abc", "1E99", "12.355"], 12, 2)
    assert values == ["0.50", "-0.25", "12.34", "100.00", "3.00", "7.00", None, None, None, "12.36"]
    assert rejected == [None, None, "12.345", None, None, None, None, "abc", "1E99", "12.355"]
    values, rejected = decoded([".50", "12.5", "13.5", "4.0"], 12, 0)
    assert values == ["0", "12", "14", "4"] and rejected == [".50", "12.5", "13.5", None]


def test_paths_keep_the_scheme_they_came_with(spark, tmp_path):
    write(tmp_path / "item.dbf", [record("S0", 1)])
    plain, named = str(tmp_path), f"file://{tmp_path}"
    assert dbf.find_files(plain) == [f"{plain}/item.dbf"]
    assert dbf.find_files(named) == dbf.find_files(f"{named}/") == [f"{named}/item.dbf"]
    assert dbf.find_files(f"{named}/item.dbf") == [f"{named}/item.dbf"]
    assert dbf.resolve(spark, plain) == plain
    assert dbf.read_dbf(spark, named).count() == 1
