"""Repair history, exact parts and plans of products with variants."""

import random
from types import SimpleNamespace

import pytest

from conftest import rows
from tillbridge.operators import grid_plans, parts, repair
from tillbridge.streaming import folds

EVENT = "base string, seq long, kind string, print string, shape string, status string, confirmed boolean, day string"


def plain_stages(events):
    names, state, out = EVENT.replace(",", "").split()[::2], {}, []
    for event in events:
        row = SimpleNamespace(**dict(zip(names, event)))
        *kept, ready = folds.advance(*state.get(row.base, (None, None, 0, None)), row)
        state[row.base] = tuple(kept)
        out.append((row.base, row.seq, kept[0], kept[2], ready))
    return sorted(out)


@pytest.fixture(scope="module")
def events():
    pick = random.Random(5).choice
    return [
        (pick(["hot", "hot", "a", "b"]), k, pick(["scan", "scan", "payload", "payload", "result"]), pick(["x", "x", "x", "y", None]), pick(["correct", "scalar", "scalar", "blocked"]),
         pick(["repaired", "already_correct", "quantity_mismatch", "blocked", "failed"]), pick([True, False]), pick(["d1", "d2", None]))
        for k in range(2500)
    ]


@pytest.mark.parametrize("block_rows", [7, 100, 1_000_000])
def test_repair_history_equals_fold(spark, events, block_rows):
    found = repair.repair_history(spark.createDataFrame(events, EVENT), block_rows)
    assert sorted(map(tuple, found.select("base", "seq", "stage", "observations", "ready").collect())) == plain_stages(events)


def test_repair_history_of_nothing(spark):
    assert repair.repair_history(spark.createDataFrame([], EVENT)).count() == 0


def plain_parts(sizes, limit, header):
    limit, part, size, held, out = max(limit, header + 1024), 1, header, 0, []
    for n in sizes:
        if held and size + n > limit:
            part, size, held = part + 1, header, 0
        size, held = size + n, held + 1
        out.append(part)
    return out


@pytest.mark.parametrize("partitions", [1, 200])
@pytest.mark.parametrize("choices", [range(1, 300), [1, 5, 900, 1500, 30_000], [0, 0, 3000]])
def test_parts_equal_a_sequential_cut(spark, partitions, choices):
    sizes = random.Random(3).choices(list(choices), k=600)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = spark.createDataFrame([(k, "x" * n) for k, n in enumerate(sizes)], "k long, line string")
        cut = parts.cut_parts(lines, ["k"], "line", 1500, 100).orderBy("k").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["part_number"] for r in cut] == plain_parts(sizes, 1500, 100)


def test_no_lines_no_parts(spark):
    assert parts.cut_parts(spark.createDataFrame([], "k long, line string"), ["k"], "line", 1500).count() == 0


PAYLOAD = "base string, product_id long, status string, quantity long"
VARIANT = ("base string, pos long, sku string, barcode string, option_values map<string,string>, price decimal(18,3), compare_at_price decimal(18,2), "
           "cost decimal(18,2), quantity long, tracked boolean, requires_shipping boolean")
ONLINE = "product_id long, pos long, variant_id long, sku string, price decimal(18,2), cost decimal(18,2), quantity long"


def variant(base, pos, quantity=1, options={"Size": "1"}, sku=None):  # noqa: B006
    from decimal import Decimal

    return (base, pos, sku or f"{base}. {pos} 1", f"B{pos}", options, Decimal("9.995"), None, None, quantity, None, None)


def test_variants_claim_once(spark):
    """The first variant takes the base SKU's variant; a repeated SKU counts as its last; the others go."""
    payloads = spark.createDataFrame([("P", 1, None, None), ("Q", 2, None, None), ("N", None, None, None)], PAYLOAD)
    variants = spark.createDataFrame([variant("P", 1), variant("P", 2), variant("P", 3, sku="P. 2 1"), variant("Q", 5), variant("N", 1)], VARIANT)
    from decimal import Decimal

    ten = Decimal("10.00")
    online = spark.createDataFrame([
        (1, 0, 10, "P", ten, None, 1), (1, 1, 11, "P. 2 1", ten, None, 1), (1, 2, 12, " P. 2 1 ", ten, None, 1), (1, 3, 13, "gone", ten, None, 0), (2, 0, 20, "", ten, None, 1), (3, 0, 30, "other", ten, None, 1),
    ], ONLINE)
    plan = grid_plans.plan_variant_changes(payloads, variants, online)
    assert rows(plan, "base", "pos", "variant_id", "action") == sorted([
        ("P", 1, 10, "update"), ("P", 2, 12, "unchanged"), ("P", 3, None, "create"), ("P", None, 11, "remove"), ("P", None, 13, "remove"),
        ("Q", 5, 20, "update"), ("N", 1, None, "create"),
    ], key=str)


def test_totals_decide_restore_and_archive(spark):
    payloads = spark.createDataFrame([
        ("a", 1, None, None), ("b", 2, None, None), ("c", 3, None, 0), ("d", 4, "archived", None), ("e", None, None, None), ("f", 9, None, None), ("g", 5, "draft", None), ("h", 1, None, None),
    ], PAYLOAD)
    variants = spark.createDataFrame([
        variant("a", 1, 2), variant("a", 2, 3), variant("b", 1, 5), variant("c", 1, 5), variant("d", 1, 5), variant("e", 1, 0), variant("f", 1), variant("g", 1, None), variant("h", 1, 1, {"Size": " "}),
    ], VARIANT)
    products = spark.createDataFrame([(1, "archived", True), (2, "ARCHIVED", False), (3, "ACTIVE", None), (4, "ACTIVE", True), (5, "ACTIVE", False)], "product_id long, status string, auto_archived boolean")
    plan = grid_plans.plan_grid_products(payloads, variants, products)
    assert rows(plan, "base", "action", "error", "total_quantity", "archives", "restores", "marker", "status") == sorted([
        ("a", "update", None, 5, False, True, False, "DRAFT"), ("b", "update", None, 5, False, False, None, None), ("c", "update", None, 0, True, False, True, "ARCHIVED"),
        ("d", "update", None, 5, False, False, False, "ARCHIVED"), ("e", "create", None, 0, True, False, True, "ARCHIVED"), ("f", "update", "matrix_product_not_found", 1, False, False, None, None),
        ("g", "update", None, None, False, False, None, "DRAFT"), ("h", "update", "invalid_matrix_option", 1, False, False, None, None),
    ], key=str)
