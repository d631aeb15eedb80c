from conftest import rows
from pyspark.sql import functions as F

from tillbridge.operators import prices, reconcile, storefront


def sides(spark, pos, shop, state=None):
    a = spark.createDataFrame([("s", pos)], "sku string, pos_quantity int")
    b = spark.createDataFrame([("s", shop, None)], "sku string, shop_quantity int, shop_at string")
    c = spark.createDataFrame([state] if state else [], reconcile.STATE)
    return a, b, c


def test_merge_sales_on_both_sides(spark):
    merged = reconcile.merge_quantities(*sides(spark, 9, 9, ("s", 10, 10, 10, None, 0, None, None)))
    assert rows(merged, "target", "shop_adjustment", "pos_adjustment") == [(8, -1, -1)]
    plan = reconcile.plan_adjustments(merged)
    assert rows(plan, "system", "delta", "target_quantity", "revision") == [("pos", -1, 8, 1), ("shop", -1, 8, 1)]


def test_merge_never_goes_below_zero(spark):
    merged = reconcile.merge_quantities(*sides(spark, 0, 0, ("s", 3, 5, 5, None, 0, None, None)))
    assert rows(merged, "target") == [(0,)]


def test_missing_state_lets_the_till_win(spark):
    merged = reconcile.merge_quantities(*sides(spark, 7, 1))
    assert rows(merged, "target", "shop_adjustment", "pos_adjustment") == [(7, 6, 0)]


def test_open_actions_are_not_planned_again(spark):
    state = ("s", 10, 10, 10, None, 1, (1, 10, "k"), None)
    merged = reconcile.merge_quantities(*sides(spark, 9, 9, state))
    assert reconcile.plan_adjustments(merged).count() == 0
    assert rows(reconcile.next_state(merged), "canonical", "pos_seen", "shop_seen") == [(10, 10, 10)]


def test_shop_result_that_missed_its_target_replans_the_till(spark):
    state = spark.createDataFrame([("s", 8, 9, 9, None, 1, (-1, 8, "a"), (-1, 8, 9, "b"))], reconcile.STATE)
    results = spark.createDataFrame([("s", True, 6, "2024-01-01T00:00:00Z")], "sku string, success boolean, quantity_after int, updated_at string")
    after = reconcile.apply_shop_results(state, results)
    assert rows(after, "canonical", "shop_seen", "revision", "pending_pos.delta", "pending_pos.expected") == [(6, 6, 2, -3, 9)]
    unconfirmed = reconcile.apply_shop_results(state, results.withColumn("quantity_after", F.lit(None).cast("int")))
    assert rows(unconfirmed, "canonical", "shop_seen", "pending_pos") == [(8, 8, None)]


def test_overlay_of_a_newer_sale(spark):
    usable = spark.createDataFrame([("s", 6, "2024-01-01T00:00:00Z")], "sku string, quantity int, observed_at string")
    snapshot = spark.createDataFrame([("s", "i1")], "sku string, inventory_item_id string")
    schema = "sku string, quantity int, inventory_item_id string, location_id string, updated_at string"
    skus = spark.createDataFrame([("s",)], "sku string")
    none = skus.where("false")

    def act(*change):
        df = spark.createDataFrame([("s", *change)], schema)
        return rows(reconcile.overlay_changes(usable, snapshot, df, skus, none, "L"), "action", "quantity", "delta")

    assert act(5, "i1", "L", "2024-01-01T01:00:00+00:00") == [("overlay", 5, -1)]
    assert act(6, "i1", "L", "2024-01-02T00:00:00Z") == [("advance", 6, 0)]
    assert act(5, "i1", "L", "2023-01-01T00:00:00Z") == [("ignore", 6, 0)]
    assert act(5, "i1", "L", None) == [("conflict:no_time", 6, 0)]
    assert act(5, "i1", "L", "2024-01-01T00:00:00Z") == [("conflict:same_time", 6, 0)]
    assert act(5, "i2", "L", "2024-01-02T00:00:00Z") == [("conflict:item", 6, 0)]
    assert act(5, "i1", "X", "2024-01-02T00:00:00Z") == [("conflict:location", 6, 0)]


def test_price_diff_targets_the_children(spark):
    previous = spark.createDataFrame([("1", "49.00"), ("2", "5.00")], "sku string, price string")
    current = spark.createDataFrame([("1", "59"), ("2", "5")], "sku string, price string")
    mapping = spark.createDataFrame([("1. 1 1", "1"), ("1. 1 2", "1"), ("1", "1")], "sku string, base string")
    diff = prices.detect_price_changes(previous, current, mapping)
    assert rows(diff) == [("1", "1. 1 1", "49.00", "59.00"), ("1", "1. 1 2", "49.00", "59.00")]
    kept = prices.next_price_snapshot(current, previous, diff, spark.createDataFrame([("1", False)], "source_sku string, success boolean"))
    assert rows(kept) == [("1", "49.00"), ("2", "5")]


def test_new_numeric_skus(spark):
    items = spark.createDataFrame([(1, "22299"), (2, "22301"), (3, "ABC"), (4, "22300")], "n int, sku string")
    known = spark.createDataFrame([("22299",)], "sku string")
    got = storefront.new_numeric_skus(items, known, ["n"])
    assert rows(got) == [("22300", 22299, 22301, 5), ("22301", 22299, 22301, 5)]


def test_reconcile_counts(spark):
    variants = spark.createDataFrame(
        [("a", "ACTIVE", "A1", False, "a1"), ("b", "ACTIVE", "gone", False, "gone"), ("b2", "ACTIVE", "gone2", False, "gone2. 1 1"), ("c", "ARCHIVED", "old", False, "old"),
         ("d", "ACTIVE", None, False, "x"), ("e", "ACTIVE", "e", False, None), ("f", "ACTIVE", "f", True, "f")],
        "product_id string, status string, marker string, truncated boolean, sku string",
    )
    source = spark.createDataFrame([("A1",)], "sku string")
    got = dict(rows(storefront.reconcile_catalog(source, variants), "product_id", "class"))
    assert got == {"a": "matched", "b": "candidate", "b2": "candidate", "c": "already_archived", "d": "unmanaged", "e": "without_sku", "f": "truncated"}
