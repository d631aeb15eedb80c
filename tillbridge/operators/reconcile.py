"""Two-sided stock reconciliation: baselines, merge, plans, overlays, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.functions.keys import adjustment_key, base_sku, is_matrix_child
from tillbridge.functions.times import is_older, parse_time
from tillbridge.operators.ordering import stored_time_before

STATE = (
    "sku string, canonical int, pos_seen int, shop_seen int, shop_seen_at string, revision int, "
    "pending_shop struct<delta:int,target:int,key:string>, "
    "pending_pos struct<delta:int,target:int,expected:int,key:string>"
)


def initialize_baselines(pos: DataFrame, shop: DataFrame, state: DataFrame, overlay: DataFrame | None = None, rebased: DataFrame | None = None) -> DataFrame:
    """State rows for SKUs on both sides that have none yet.

    pos (sku, pos_quantity); shop (sku, shop_quantity, shop_at); overlay
    (sku, delta); rebased (sku). The till wins, moved by the overlay, unless
    the online product was just rebuilt.
    """
    rows = pos.join(shop, "sku").join(state.select("sku"), "sku", "left_anti")
    delta, fresh = F.lit(0), F.lit(False)
    if overlay is not None:
        rows = rows.join(overlay.select("sku", F.col("delta").alias("_delta")), "sku", "left")
        delta = F.coalesce("_delta", F.lit(0))
    if rebased is not None:
        rows = rows.join(rebased.select("sku", F.lit(True).alias("_rebased")).distinct(), "sku", "left")
        fresh = F.coalesce("_rebased", F.lit(False))
    canonical = F.when(fresh, F.col("shop_quantity")).otherwise(F.greatest(F.lit(0), F.col("pos_quantity") + delta))
    return rows.select(
        "sku", canonical.cast("int").alias("canonical"), F.col("pos_quantity").cast("int").alias("pos_seen"),
        F.col("shop_quantity").cast("int").alias("shop_seen"), F.col("shop_at").alias("shop_seen_at"),
    )


def merge_quantities(pos: DataFrame, shop: DataFrame, state: DataFrame) -> DataFrame:
    """Three-way merge of both sides' changes since they were last seen."""
    rows = pos.join(shop, "sku").join(state, "sku", "left")
    pos_q, shop_q = F.col("pos_quantity"), F.col("shop_quantity")
    previous_pos = F.coalesce("pos_seen", pos_q)
    previous_shop = F.coalesce("shop_seen", shop_q)
    canonical = F.coalesce("canonical", previous_pos)
    target = F.greatest(F.lit(0), canonical + (pos_q - previous_pos) + (shop_q - previous_shop))
    kept = [c for c in rows.columns if c not in ("canonical",)]
    return rows.select(
        *kept, previous_pos.alias("previous_pos"), previous_shop.alias("previous_shop"),
        canonical.alias("previous_canonical"), (pos_q - previous_pos).alias("pos_delta"),
        (shop_q - previous_shop).alias("shop_delta"), target.alias("target"),
        (target - shop_q).alias("shop_adjustment"), (target - pos_q).alias("pos_adjustment"),
    )


def plan_adjustments(merged: DataFrame, rebased: DataFrame | None = None) -> DataFrame:
    """Adjustments of both systems for SKUs without open actions.

    One row per action; ``idempotency_key`` depends on the observed values
    only, so a replay plans the same keys.
    """
    rows = merged.where("pending_shop IS NULL AND pending_pos IS NULL")
    if rebased is not None:
        rows = rows.join(rebased.select("sku"), "sku", "left_anti")
    rows = rows.where("shop_adjustment <> 0 OR pos_adjustment <> 0")
    revision = F.coalesce("revision", F.lit(0)) + 1
    observed = [revision, *[F.col(c) for c in ("previous_pos", "pos_quantity", "previous_shop", "shop_quantity", "target")]]

    def action(system: str, delta: str, expected: Column) -> Column:
        return F.struct(
            F.lit(system).alias("system"), F.col(delta).cast("int").alias("delta"), expected.cast("int").alias("expected_quantity"),
            adjustment_key(system, F.col("sku"), *observed).alias("idempotency_key"),
        )

    actions = F.array(
        action("shop", "shop_adjustment", F.lit(None)), action("pos", "pos_adjustment", F.col("pos_quantity"))
    )
    return rows.select(
        "sku", revision.cast("int").alias("revision"), F.col("target").cast("int").alias("target_quantity"),
        F.explode(F.filter(actions, lambda a: a["delta"] != 0)).alias("a"),
    ).select("sku", "a.system", "revision", "a.delta", "target_quantity", "a.expected_quantity", "a.idempotency_key")


def next_state(merged: DataFrame, rebased: DataFrame | None = None, till_writes: bool = True) -> DataFrame:
    """State after planning: both sides seen, open actions stored."""
    held = F.col("pending_shop").isNotNull() | F.col("pending_pos").isNotNull()
    rows = merged
    if rebased is not None:
        rows = rows.join(rebased.select("sku", F.lit(True).alias("_rebased")).distinct(), "sku", "left")
        held = held | F.coalesce("_rebased", F.lit(False))
    moves = ~held & ((F.col("shop_adjustment") != 0) | (F.col("pos_adjustment") != 0))
    revision = F.coalesce("revision", F.lit(0)) + F.when(moves, 1).otherwise(0)
    observed = [revision, *[F.col(c) for c in ("previous_pos", "pos_quantity", "previous_shop", "shop_quantity", "target")]]
    shop = F.struct(
        F.col("shop_adjustment").cast("int").alias("delta"), F.col("target").cast("int").alias("target"),
        adjustment_key("shop", F.col("sku"), *observed).alias("key"),
    )
    pos = F.struct(
        F.col("pos_adjustment").cast("int").alias("delta"), F.col("target").cast("int").alias("target"),
        F.col("pos_quantity").cast("int").alias("expected"), adjustment_key("pos", F.col("sku"), *observed).alias("key"),
    )
    return rows.select(
        "sku", F.when(held, F.col("previous_canonical")).otherwise(F.col("target")).cast("int").alias("canonical"),
        F.when(held, F.col("previous_pos")).otherwise(F.col("pos_quantity")).cast("int").alias("pos_seen"),
        F.when(held, F.col("previous_shop")).otherwise(F.col("shop_quantity")).cast("int").alias("shop_seen"),
        F.when(held, F.col("shop_seen_at")).otherwise(F.coalesce("shop_at", "shop_seen_at")).alias("shop_seen_at"),
        revision.cast("int").alias("revision"),
        F.when(held, F.col("pending_shop")).when(F.col("shop_adjustment") != 0, shop).alias("pending_shop"),
        F.when(held, F.col("pending_pos")).when((F.col("pos_adjustment") != 0) & F.lit(till_writes), pos).alias("pending_pos"),
    )


def apply_shop_results(state: DataFrame, results: DataFrame, till_writes: bool = True) -> DataFrame:
    """Fold storefront answers into the state.

    results (sku, success, quantity_after, updated_at). An unconfirmed success
    moves shop_seen by the delta and drops the paired till action; a confirmed
    quantity that missed its target replans the till side.
    """
    answers = results.select("sku", "success", "quantity_after", "updated_at")
    rows = state.join(answers, "sku", "left")
    ok = F.coalesce("success", F.lit(False)) & F.col("pending_shop").isNotNull()
    actual = F.col("quantity_after")
    confirmed = ok & actual.isNotNull()
    target = F.col("pending_shop.target")
    missed = confirmed & target.isNotNull() & (actual != target)
    replan = missed & (F.col("pos_seen") != actual) & F.lit(till_writes)
    revision = F.coalesce("revision", F.lit(0)) + F.when(replan, 1).otherwise(0)
    replanned = F.struct(
        (actual - F.col("pos_seen")).cast("int").alias("delta"), actual.cast("int").alias("target"),
        F.col("pos_seen").cast("int").alias("expected"),
        adjustment_key("pos", F.col("sku"), revision, F.col("pos_seen"), actual, target).alias("key"),
    )
    unconfirmed = ok & actual.isNull()
    return rows.select(
        "sku", F.when(confirmed, actual).otherwise(F.col("canonical")).cast("int").alias("canonical"), "pos_seen",
        F.when(confirmed, actual).when(unconfirmed, F.col("shop_seen") + F.col("pending_shop.delta"))
        .otherwise(F.col("shop_seen")).cast("int").alias("shop_seen"),
        F.when(ok, F.coalesce(F.nullif(F.trim("updated_at"), F.lit("")), "shop_seen_at")).otherwise(F.col("shop_seen_at")).alias("shop_seen_at"),
        revision.cast("int").alias("revision"),
        F.when(~ok, F.col("pending_shop")).alias("pending_shop"),
        F.when(replan, replanned).when(missed | unconfirmed, None).otherwise(F.col("pending_pos")).alias("pending_pos"),
    )


def apply_till_results(state: DataFrame, results: DataFrame) -> DataFrame:
    """Fold till answers (sku, success) into the state."""
    rows = state.join(results.select("sku", F.col("success").alias("_ok")), "sku", "left")
    done = F.coalesce("_ok", F.lit(False)) & F.col("pending_pos").isNotNull()
    seen = F.when(done, F.col("pending_pos.expected") + F.col("pending_pos.delta")).otherwise(F.col("pos_seen"))
    return rows.withColumns({"pos_seen": seen.cast("int"), "pending_pos": F.when(~done, F.col("pending_pos"))}).drop("_ok")


def retry_pending(state: DataFrame, excluded: DataFrame) -> DataFrame:
    """Open actions of SKUs that are not excluded, one row per action."""
    rows = state.join(excluded.select("sku").distinct(), "sku", "left_anti")
    shop = F.when(F.col("pending_shop").isNotNull(), F.struct(F.lit("shop").alias("system"), F.col("pending_shop.delta").alias("delta"), F.col("pending_shop.key").alias("key")))
    pos = F.when(F.col("pending_pos").isNotNull(), F.struct(F.lit("pos").alias("system"), F.col("pending_pos.delta").alias("delta"), F.col("pending_pos.key").alias("key")))
    return rows.select("sku", F.explode(F.array_compact(F.array(shop, pos))).alias("a")).select("sku", "a.*")


def apply_adjustments_cas(items: DataFrame, cells: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Compare-and-set result of each till adjustment.

    items (sku, quantity); cells (sku, cell, quantity); adjustments (sku,
    delta, expected). A SKU may have one action per run: repeats are rejected.
    """
    child = is_matrix_child(F.col("sku"))
    cell = F.regexp_replace(F.regexp_extract("sku", r"(\d+\s+\d+)$", 1), r"\s+", " ")
    rows = adjustments.withColumns({"base": base_sku(F.col("sku")), "cell": F.when(child, cell)})
    repeats = adjustments.groupBy("sku").agg(F.count(F.lit(1)).alias("actions"))
    own = items.groupBy(F.col("sku").alias("base")).agg(F.count(F.lit(1)).alias("item_rows"), F.max("quantity").alias("item_quantity"))
    grid = cells.groupBy(F.col("sku").alias("base"), "cell").agg(F.count(F.lit(1)).alias("cell_rows"), F.max("quantity").alias("cell_quantity"))
    rows = rows.join(repeats, "sku").join(own, "base", "left").join(grid, ["base", "cell"], "left")
    is_cell = F.col("cell").isNotNull()
    n = F.coalesce(F.when(is_cell, F.col("cell_rows")).otherwise(F.col("item_rows")), F.lit(0))
    current = F.when(is_cell, F.col("cell_quantity")).otherwise(F.col("item_quantity"))
    target = F.col("expected") + F.col("delta")
    parent_missing = is_cell & (F.coalesce("item_rows", F.lit(0)) != 1)
    result = (
        F.when(F.col("actions") > 1, "repeated_action").when(n != 1, "not_one_row")
        .when(current == target, "already_applied").when(current != F.col("expected"), "conflict")
        .when(parent_missing, "parent_not_one_row").otherwise("applied")
    )
    return rows.select(
        "sku", "base", "cell", "delta", current.alias("current"), result.alias("result"),
        F.when(result == "applied", target).otherwise(current).alias("quantity_after"),
    )


def parent_totals(results: DataFrame) -> DataFrame:
    """Change each matrix parent's total needs after its cells were applied."""
    return results.where("result = 'applied' AND cell IS NOT NULL").groupBy("base").agg(F.sum("delta").alias("delta"))


def usable_snapshot(snapshot: DataFrame, state: DataFrame, location: str, expected: DataFrame) -> DataFrame:
    """Status of every snapshot and expected SKU, with the quantity to use.

    snapshot (sku, quantity, location_id, updated_at, available,
    duplicate_count); state (sku, shop_seen, shop_seen_at); expected (sku).
    """
    rows = snapshot.where("trim(sku) <> ''").withColumn("sku", F.trim("sku")).join(
        state.select("sku", "shop_seen", "shop_seen_at"), "sku", "left"
    )
    stale = is_older(F.coalesce("updated_at", F.lit("")), F.coalesce("shop_seen_at", F.lit("")))
    status = (
        F.when(F.coalesce("location_id", F.lit("")) != location, "error_location")
        .when(F.coalesce("duplicate_count", F.lit(0)) > 0, "blocked_duplicate")
        .when(~F.coalesce("available", F.lit(False)) | F.col("quantity").isNull(), "blocked_unavailable")
        .when(stale, "stored").otherwise("usable")
    )
    rows = rows.withColumn("status", status)
    seen = rows.select(
        "sku", "status",
        F.when(F.col("status") == "usable", F.col("quantity")).when(F.col("status") == "stored", F.coalesce("shop_seen", F.lit(0))).cast("int").alias("quantity"),
        F.when(F.col("status") == "usable", F.nullif("updated_at", F.lit(""))).when(F.col("status") == "stored", F.col("shop_seen_at")).alias("observed_at"),
    )
    missing = expected.select("sku").distinct().join(rows.select("sku"), "sku", "left_anti").select(
        "sku", F.lit("blocked_missing").alias("status"), F.lit(None).cast("int").alias("quantity"), F.lit(None).cast("string").alias("observed_at")
    )
    return seen.unionByName(missing)


def overlay_changes(usable: DataFrame, snapshot: DataFrame, changes: DataFrame, relevant: DataFrame, ignored: DataFrame, location: str) -> DataFrame:
    """Decide what each queued change does to a full snapshot.

    usable (sku, quantity, observed_at), only usable rows; snapshot (sku,
    inventory_item_id); changes (sku, quantity, inventory_item_id,
    location_id, updated_at). One row per relevant SKU: overlay, advance,
    keep, ignore or conflict:<reason>.
    """
    per_sku = changes.where("trim(sku) <> ''").groupBy(F.trim("sku").alias("sku")).agg(
        F.count(F.lit(1)).alias("n"), F.max("quantity").alias("change_quantity"),
        F.trim(F.max("inventory_item_id")).alias("change_item"), F.trim(F.max("location_id")).alias("change_location"),
        F.max("updated_at").alias("change_at"),
    )
    rows = per_sku.join(relevant.select("sku").distinct(), "sku", "left_semi").join(ignored.select("sku").distinct(), "sku", "left_anti")
    items = snapshot.groupBy(F.trim("sku").alias("sku")).agg(F.trim(F.max("inventory_item_id")).alias("item"))
    rows = rows.join(items, "sku", "left").join(usable.select("sku", "quantity", "observed_at"), "sku", "left")
    new, old = parse_time(F.col("change_at")), parse_time(F.col("observed_at"))
    same = F.col("change_quantity") == F.col("quantity")
    action = (
        F.when(F.col("n") > 1, "conflict:several_items").when(F.col("quantity").isNull(), "conflict:no_row")
        .when(F.coalesce("change_location", F.lit("")) != location, "conflict:location")
        .when((F.coalesce("item", F.lit("")) == "") | ~F.col("item").eqNullSafe(F.col("change_item")), "conflict:item")
        .when(F.col("change_quantity").isNull(), "conflict:quantity")
        .when(same & new.isNotNull() & (old.isNull() | (new > old)), "advance").when(same, "keep")
        .when(new.isNull() | old.isNull(), "conflict:no_time").when(new > old, "overlay")
        .when(new == old, "conflict:same_time").otherwise("ignore")
    )
    rows = rows.withColumn("action", action)
    over = F.col("action") == "overlay"
    return rows.select(
        "sku", "action", F.when(over, F.col("change_quantity")).otherwise(F.col("quantity")).cast("int").alias("quantity"),
        F.when(over | (F.col("action") == "advance"), F.col("change_at")).otherwise(F.col("observed_at")).alias("observed_at"),
        F.when(over, F.col("change_quantity") - F.col("quantity")).otherwise(0).cast("int").alias("delta"),
    )


def ambiguous_skus(changes: DataFrame) -> DataFrame:
    """SKUs that queued changes tie to more than one inventory item."""
    items = changes.where("trim(sku) <> '' AND trim(inventory_item_id) <> ''").select(F.trim("sku").alias("sku"), F.trim("inventory_item_id").alias("item"))
    return items.groupBy("sku").agg(F.min("item").alias("low"), F.max("item").alias("high")).where("low <> high").select("sku")


def latest_observations(changes: DataFrame, state: DataFrame, blocked: DataFrame, **blocks) -> DataFrame:
    """Without a snapshot: the quantity each SKU's queue leads to.

    changes (seq, sku, quantity, inventory_item_id, updated_at timestamp);
    state (sku, seen_at timestamp). A change without a time always applies
    and leaves the comparison time alone; a timed one must be newer.
    """
    stop = blocked.select("sku").union(ambiguous_skus(changes)).distinct()
    rows = changes.withColumn("sku", F.trim("sku")).where("sku <> ''").join(stop, "sku", "left_anti")
    rows = rows.join(state.select("sku", F.col("seen_at").alias("_seen")), "sku", "left")
    rows = stored_time_before(rows, ["sku"], "seq", "updated_at", "_before", resets_on_null=False, opening="_seen", **blocks)
    newer = F.col("updated_at").isNull() | F.col("_before").isNull() | (F.col("updated_at") > F.col("_before"))
    return rows.where(newer).groupBy("sku").agg(
        F.max_by("quantity", "seq").cast("int").alias("quantity"), F.max("updated_at").alias("observed_at"),
        F.count(F.lit(1)).alias("applied"),
    )


def blocked_skus(*reasons: tuple[str, DataFrame]) -> DataFrame:
    """Every blocked SKU with its reasons, one row each."""
    frames = [df.select(F.trim("sku").alias("sku"), F.lit(reason).alias("reason")) for reason, df in reasons]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.union(frame)
    # the reason list is bounded by the reasons passed in
    return rows.where("sku <> ''").groupBy("sku").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


