"""Fixed-width records are fitted, written and read by column, and plain text is not searched for odd characters."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillbridge.functions.text import to_cp1252
from tillbridge.operators import matrix, orders
from tillbridge.plans import inbox
from tillbridge.sources import dbf


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_columns_are_written_at_once(monkeypatch):
    columns = [(pa.array(["ab", None, "abcdef", "  ", ""]).slice(1), dbf.DbfField("A", "C", 4)), (pa.array(["1.5", None, "-12"]), dbf.DbfField("B", "N", 5, 2)), (pa.array(["T", None, "?"]), dbf.DbfField("D", "L", 1))]
    slow = [dbf.encode_values(*c) for c in columns]
    assert slow == [b"    abcd        ", b"  1.5       -12", b"T??"]
    odd = (pa.array(["é€", "漢"]), dbf.DbfField("A", "C", 3))
    assert dbf.encode_column(*odd).tobytes() == b"\xe9\x80 ?  "
    with pytest.raises(dbf.DbfError, match="123456 is too wide for B"):
        dbf.encode_column(pa.array(["1", "123456"]), columns[1][1])
    monkeypatch.setattr(dbf, "encode_values", None)
    assert [dbf.encode_column(*c).tobytes() for c in columns] == slow


def test_plain_columns_are_read_at_once(monkeypatch):
    def block(*records):
        return np.frombuffer(b"".join(b" " + r for r in records), np.uint8).reshape(len(records), -1)

    field = dbf.DbfField("A", "C", 4)
    assert dbf.decode_field(block(b" \xe9  ", b"\x80ab\x00"), field, 1, "cp1252", True)[0].to_pylist() == [" é", "€ab"]
    monkeypatch.setattr(dbf.np.char, "decode", None)
    plain = block(b" a  ", b"    ", b"b\x00c\x00", b"abcd")
    assert dbf.decode_field(plain, field, 1, "cp1252", True)[0].to_pylist() == [" a", None, "b\x00c", "abcd"]
    assert dbf.decode_field(plain, field, 1, "latin1", False)[0].to_pylist() == ["a", None, "b\x00c", "abcd"]


def test_plain_text_is_not_searched(spark):
    df = spark.createDataFrame([("a~\x7f",), ("é€ÿ\xa0",), ("ż漢😀\x81a",), (None,)], "t string")
    out = df.select(to_cp1252(F.col("t")).alias("t"))
    assert [r["t"] for r in out.collect()] == ["a~\x7f", "é€ÿ\xa0", "????a", None]
    assert "octet_length" in optimized(out)


def test_order_steps_build_only_what_they_read(spark):
    source = spark.createDataFrame([(29, 4, 1.0, "2024-01-01", "F"), (30, 5, 2.0, "2024-01-02", "O")], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string, o_orderstatus string").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    changes = inbox.changes(SimpleNamespace(orders=source))
    assert changes.schema["order"].dataType.simpleString() == orders.ORDER.replace(" ", "")
    removed = changes.groupBy(orders.order_id().alias("id")).agg(F.bool_or(orders.is_removal()).alias("removed"))
    assert sorted((r["id"], r["removed"]) for r in removed.collect()) == [("O7", True)]
    assert "repeat" not in optimized(removed)  # the note


def test_cell_readings_test_their_digits_once(spark):
    df = spark.createDataFrame([("12",), ("1 2",), ("102",), ("112",), ("0 1",), ("01",), ("1a",), (None,)], "c string")
    out = df.select("c", matrix.parse_cell(F.col("c"), F.lit(11), F.lit(3)).alias("at"))
    got = {r["c"]: r["at"] and tuple(r["at"]) for r in out.collect()}
    assert got == {"12": (1, 2), "1 2": (1, 2), "102": (10, 2), "112": (11, 2), "0 1": None, "01": None, "1a": None, None: None}
    assert optimized(out).count("RLIKE") <= 2
