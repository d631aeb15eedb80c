"""Claims of grid variants are sorted by a hash before their texts."""

from conftest import rows

from tillbridge.operators import matrix


def test_claims_are_sorted_by_their_hash(spark):
    variants = spark.createDataFrame(
        [("P1", "a", "a", {"Size": "S", "Color": "x"}), ("P1", "b", " a ", {"Color": "x", "Size": "S"}), ("P2", None, "c", {}), ("P2", "d", "d", {}), ("P3", "e", "e", {"Size": "S"}), ("P0", "e", "e", {"Size": "S"})],
        "base string, sku string, barcode string, option_values map<string,string>",
    )
    out = matrix.validate_variants(variants)
    assert out.columns == ["base", "problem", "value", "rows"]
    assert rows(out) == sorted([("P1", "duplicate_barcode", "a", 2), ("P0", "duplicate_barcode", "e", 2), ("P1", "duplicate_option", "Color=x;Size=S", 2), ("P2", "missing_code", "", 1), ("P2", "missing_option", "", 2)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64") >= 1


def test_cells_are_read_once(spark):
    heads = spark.createDataFrame([("P", "R", 1, "x"), ("P", "R", 2, "y"), ("P", "C", 1, "S"), ("Q", "R", 1, "")], "sku string, axis string, position long, header string")
    cells = spark.createDataFrame([(" P", "2 1", "7", None), ("P", "11", "-1", "b"), ("P", "3 1", "1", None), ("P", None, "1", None), ("Q", "1 1", "1", None)], "SKU string, CELL string, QTY string, BARCODE string")
    good, rejects = matrix.build_matrix(cells, heads)
    assert rows(good, "sku", "row", "column", "cell", "quantity", "barcode") == [("P", 1, 1, "1 1", 0, "b"), ("P", 2, 1, "2 1", 7, "P. 2 1")]
    assert rows(rejects, "sku", "cell") == sorted([("P", "3 1"), ("P", None)], key=str)
    joined = matrix.explode_variants(good, heads)
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 10000)
    try:
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert plan.count("[0-9]{2,20}") == 1
