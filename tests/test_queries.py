"""A spread of registered queries against their SQL, and plan checks."""

import re

import pytest

import __spark_entry__ as entry_module
from check_oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"
SPREAD = (
    "plan_adjustments", "overlay_changes", "next_price_snapshot", "fold_inventory_events", "ack_versions", "mask_logs", "dedupe_items", "build_products",
    "item_metafields", "match_existing", "reconcile_catalog", "upload_order_batches", "stable_payload_history", "explode_variants", "validate_variants",
    "matrix_structure", "customers_dedup", "customer_addresses", "clear_duplicate_contacts", "split_csv_by_bytes", "order_lines", "delivered_orders",
    "backfill_legacy_orders", "parse_product_events", "parse_inventory_events", "clean_text", "dbf_scan",
)


@pytest.mark.parametrize("name", SPREAD)
def test_query_matches_sql(spark, name):
    df = entry_module.queries()[name](spark, FOLDER)
    assert compare(df, duck(FOLDER), entry_module.oracle_sql()[name]) == ""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
