"""Compressed DBF files hold the bytes of plain ones, are read by range, and keep blank fields off the disk."""

import os
import random

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tillbridge.operators import orders
from tillbridge.plans import live
from tillbridge.plans.registry import Tables
from tillbridge.sources import dbf, frames

LAYOUT = [("SKU", "C", 12, 0), ("QTY", "N", 6, 2), ("WEB", "L", 1, 0)]


def written(folder, batches, **options):
    os.makedirs(folder)
    writer = dbf.DbfWriter({"path": str(folder), "layout": dbf.layout_text(LAYOUT), "table": "item", **options})
    writer.commit([writer.write(iter(batches))])
    (name,) = os.listdir(folder)
    return str(folder / name)


def batch(first, count):
    keys = range(first, first + count)
    return pa.record_batch({"SKU": [f"S{k}" if k % 7 else "é" for k in keys], "QTY": [f"{k}.50" if k % 5 else None for k in keys], "WEB": ["T" if k % 2 else "?" for k in keys]})


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_frames_unpack_to_the_plain_file(tmp_path, monkeypatch, size):
    monkeypatch.setattr(frames, "FRAME_BYTES", size)
    batches = [batch(0, 30), batch(30, 0), batch(30, 23)]
    path, packed = written(tmp_path / "plain", batches), written(tmp_path / "packed", batches, compression="zstd")
    assert path.endswith(".dbf") and packed.endswith(".dbf.zst")
    plain = open(path, "rb").read()
    with open(packed, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()[4:] == plain[4:]  # but for the day
    assert dbf.header_of(packed) == dbf.header_of(path) and dbf.header_of(packed)[1] == len(plain)
    with dbf.open_dbf(packed) as handle:
        for _ in range(40):
            at, length = random.randrange(4, len(plain) + 3), random.randrange(90)
            handle.seek(at)
            assert [bytes(handle.read(length)), bytes(handle.read(5))] == [plain[at:at + length], plain[at + length:at + length + 5]]


def test_a_file_without_records(tmp_path):
    path = written(tmp_path / "none", [], compression="zstd")
    header, size = dbf.header_of(path)
    dbf.check_strict(header, size, path, dbf.parse_layout(dbf.layout_text(LAYOUT)))
    assert header.records == 0


def test_packed_tables_are_read_like_plain_ones(spark, tmp_path):
    source = spark.range(95).selectExpr("concat('S', id) AS SKU", "cast(id AS decimal(6,2)) AS QTY", "'T' AS WEB").repartition(3)
    for name, options in (("plain", {}), ("packed", {"compression": "zstd"})):
        dbf.write_dbf(source, str(tmp_path / name), LAYOUT, "item", **options)
    asked = {"mode": "strict", "layout": dbf.layout_text(LAYOUT), "splitRecords": "10"}
    plain = dbf.read_dbf(spark, str(tmp_path / "plain"), **asked).drop("_file")
    packed = dbf.read_dbf(spark, str(tmp_path / "packed"), compression="zstd", **asked).drop("_file")
    assert packed.count() == 95 and packed.exceptAll(plain).count() == 0
    assert [r.SKU for r in packed.where("SKU = 'S40'").collect()] == ["S40"]
    exact = dbf.read_exact_dbf(spark, str(tmp_path / "packed"), compression="zstd")
    assert exact.agg(F.sum("QTY")).first()[0] == 95 * 47
    with pytest.raises(dbf.DbfError, match="no DBF file"):  # plain reads do not take them
        dbf.DbfDataSource({"path": str(tmp_path / "packed")})._fields()
    assert dbf.find_files(str(tmp_path / "plain"), compression="zstd") == []
    with pytest.raises(dbf.DbfError, match="compression gzip is not known"):
        dbf.find_files(str(tmp_path / "plain"), compression="gzip")


def test_broken_packed_files_are_refused(spark, tmp_path):
    path = written(tmp_path / "whole", [batch(1, 6)], compression="zstd")
    whole = open(path, "rb").read()
    cut = {"cut": (whole[:-1], "no seek table"), "more": (b"x" + whole, "does not fit its frames"), "few": (whole[-9:], "no whole seek table"), "none": (b"", "no seek table")}
    for name, (data, problem) in cut.items():
        (tmp_path / f"{name}.dbf.zst").write_bytes(data)
        with pytest.raises(dbf.DbfError, match=problem):
            dbf.header_of(str(tmp_path / f"{name}.dbf.zst"))
    with dbf.open_dbf(path) as handle:
        plain = bytes(handle.read(1 << 20))
    os.makedirs(tmp_path / "marker")
    with pa.OSFile(str(tmp_path / "marker" / "a.dbf.zst"), "wb") as out:
        pack = frames.FrameWriter(out)
        pack.write(plain[:-1] + b"x")
        pack.end_file()
    with pytest.raises(Exception, match="no end marker"):
        dbf.read_dbf(spark, str(tmp_path / "marker"), mode="strict", compression="zstd").collect()


def test_order_headers_keep_blank_fields_off_the_disk(spark, tmp_path, monkeypatch):
    table = spark.range(4000).selectExpr("id AS o_orderkey", "id % 150 AS o_custkey", "'O' AS o_orderstatus", "id * 1.25D AS o_totalprice", "timestamp_ntz'2024-01-02 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    table.write.parquet(str(tmp_path / "tables" / "orders.parquet"))
    monkeypatch.setattr(live, "scratch_path", lambda _, label: str(tmp_path / label))
    rows = live.order_header_file(Tables(spark, str(tmp_path / "tables"))).count()
    files = [os.path.join(folder, f) for folder, _, names in os.walk(tmp_path / "order-headers") for f in names]
    headers = [dbf.header_of(f)[0] for f in files]
    assert rows == sum(h.records for h in headers) > 1000
    assert {h.fields for h in headers} == {dbf.parse_layout(dbf.layout_text(orders.HEADER_LAYOUT))}  # all of the real layout
    assert sum(map(os.path.getsize, files)) < rows * headers[0].record_length / 4
