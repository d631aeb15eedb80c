"""Rows of one scan task are dealt over the cluster before they are sorted for an aggregate."""

from conftest import rows

from tillbridge.operators import catalog, customers


def parts(df):
    return df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_of_one_task_are_dealt_before_the_aggregate(spark):
    items = spark.createDataFrame(
        [("a", 1.0, "2020-01-01", 1), ("a", 1.0, "2020-01-02", 2), (" a ", None, "2020-01-03", 3), (" ", 5.0, None, 4), (None, 5.0, None, 4), ("b", None, None, None), ("b", None, None, 5)],
        "SKU string, PRICE double, LAST_ACT string, _rec_no long",
    ).coalesce(1)
    out = catalog.dedupe_items(items)
    assert out.columns == ["SKU", "PRICE", "LAST_ACT", "_rec_no", "first_seen", "copies", "without_sku"]
    got = rows(out, "SKU", "PRICE", "LAST_ACT", "_rec_no", "first_seen._rec_no", "copies", "without_sku")
    assert got == sorted([("a", 1.0, "2020-01-02", 2, 1, 3, False), ("b", None, None, 5, None, 2, False), (" ", 5.0, None, 4, 4, 1, True), (None, 5.0, None, 4, 4, 1, True)], key=str)
    text = plan(out)
    assert "REPARTITION_BY_NUM" in text and text.index("partial_max") < text.index("REPARTITION_BY_NUM")


def test_customers_of_one_task_are_dealt_before_they_are_built(spark):
    source = spark.createDataFrame([(0, 1, "c", " C1", "X@y.co "), (0, 2, "c", "C2", "x@Y.co"), (1, 1, "d", "c2", None), (1, 2, "d", " ", None)], "source_rank int, _rec_no long, source string, CUST_NUM string, INTERNET string")
    built = customers.build_customers(source.coalesce(1))
    cores, found = parts(built)
    assert found >= 4 * cores
    kept = customers.dedupe_customers(built)
    assert rows(kept, "identity", "source", "_rec_no", "copies") == [("email:x@y.co", "c", 1, 2)]
