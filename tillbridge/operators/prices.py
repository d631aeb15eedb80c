"""Price snapshots, changes and retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.functions.keys import is_matrix_child
from tillbridge.functions.money import decimal_or_none, money_text, till_money
from tillbridge.operators.catalog import ARRIVAL, price_change_lookup

MAX_CHANGES, MAX_TARGETS = 100, 1000


def price_snapshot(rows: DataFrame, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """sku -> price text of the latest row; negative and unreadable prices drop out."""
    latest = price_change_lookup(rows.select("SKU", "PRICE", *order), order)
    price = till_money(decimal_or_none(F.col("PRICE")))
    return latest.select(F.col("SKU").alias("sku"), price.alias("p")).where("p >= 0").select("sku", F.col("p").cast("string").alias("price"))


def detect_price_changes(previous: DataFrame, current: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source_sku, target_sku, old_price, new_price), one row per target.

    A base with matrix children targets those; anything else targets itself.
    SKUs that left the snapshot are ignored.
    """
    old = previous.select("sku", money_text(F.col("price")).alias("old_price"))
    changed = (
        current.select("sku", money_text(F.col("price")).alias("new_price")).join(old, "sku", "left")
        .where(F.col("new_price").isNotNull() & ~F.col("old_price").eqNullSafe(F.col("new_price")))
    )
    children = mapping.where(is_matrix_child(F.col("sku")) & (F.col("sku") != F.col("base"))).select(
        F.col("base").alias("_base"), F.col("sku").alias("_child")
    ).distinct()
    base = F.when(~is_matrix_child(F.col("sku")), F.col("sku"))
    return changed.withColumn("_base", base).join(children, "_base", "left").select(
        F.col("sku").alias("source_sku"), F.coalesce("_child", "sku").alias("target_sku"), "old_price", "new_price"
    )


def next_price_snapshot(current: DataFrame, previous: DataFrame | None, changes: DataFrame, results: DataFrame) -> DataFrame:
    """Snapshot to compare with next time.

    Changes without a success keep their previous price, or drop out, so they
    are found again. Without a previous snapshot the current one is stored.
    """
    if previous is None:
        return current.select("sku", "price")
    done = results.groupBy("source_sku").agg(F.bool_or("success").alias("ok"))
    failed = (
        changes.select("source_sku").distinct().join(done, "source_sku", "left")
        .where(~F.coalesce("ok", F.lit(False))).select(F.col("source_sku").alias("sku"), F.lit(True).alias("_failed"))
    )
    rows = current.select("sku", "price").join(failed, "sku", "left").join(
        previous.select("sku", F.col("price").alias("_before")), "sku", "left"
    )
    kept = F.when(F.coalesce("_failed", F.lit(False)), F.col("_before")).otherwise(F.col("price"))
    return rows.select("sku", kept.alias("price")).where("price IS NOT NULL")


def validate_price_changes(
    changes: DataFrame, results: DataFrame, max_changes: int = MAX_CHANGES, max_targets: int = MAX_TARGETS
) -> DataFrame:
    """Per change: error, targets asked and done, success only when all succeed.

    changes (request_id, source_sku, new_price, target_sku); results
    (target_sku, success). Requests over the limits fail as a whole.
    """
    target = F.nullif(F.trim("target_sku"), F.lit(""))
    rows = changes.withColumn("target", target)
    sizes = rows.groupBy("request_id").agg(
        F.count_distinct("source_sku").alias("request_changes"), F.count("target").alias("request_targets")
    )
    answers = results.groupBy(F.col("target_sku").alias("target")).agg(F.bool_and("success").alias("ok"))
    once = rows.select("request_id", F.trim("source_sku").alias("source_sku"), "new_price", "target").distinct()
    per_change = once.join(answers, "target", "left").groupBy("request_id", "source_sku", "new_price").agg(
        F.count("target").alias("targets"),
        F.count_if(F.col("target").isNotNull() & F.coalesce("ok", F.lit(False))).alias("done"),
    )
    price = decimal_or_none(F.col("new_price"))
    error = (
        F.when(F.col("request_changes") > max_changes, "too_many_price_changes")
        .when(F.col("request_targets") > max_targets, "too_many_price_targets")
        .when((F.coalesce("source_sku", F.lit("")) == "") | price.isNull() | (price < 0), "invalid_price_change")
        .when(F.col("targets") == 0, "invalid_price_targets")
    )
    rows = per_change.join(sizes, "request_id").withColumn("error", error)
    ok = F.col("error").isNull() & (F.col("done") == F.col("targets"))
    return rows.select("request_id", "source_sku", "new_price", "targets", "done", "error", ok.alias("success"))


