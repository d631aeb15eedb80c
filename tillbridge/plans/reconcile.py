"""Stock and price reconciliation over line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.operators import prices, reconcile, storefront
from tillbridge.plans import proxies as p
from tillbridge.plans.registry import Tables, query

MERGED = ("sku", "pos_quantity", "shop_quantity", "previous_pos", "previous_shop", "pos_delta", "shop_delta", "target", "shop_adjustment", "pos_adjustment")


def merged(t: Tables) -> DataFrame:
    return reconcile.merge_quantities(p.pos_side(t), p.shop_side(t), p.stock_state(t))


@query("merge_quantities", f"""
WITH {p.MERGE_SQL}
SELECT sku, pos_quantity, shop_quantity, previous_pos, previous_shop, pos_delta, shop_delta, target,
  target - shop_quantity AS shop_adjustment, target - pos_quantity AS pos_adjustment FROM merged""")
def merge_quantities(t: Tables) -> DataFrame:
    return merged(t).select(*MERGED)


PLAN_SQL = p.MERGE_SQL + """,
open_rows AS (
  SELECT *, coalesce(revision, 0) + 1 AS rev, target - shop_quantity AS shop_adj, target - pos_quantity AS pos_adj FROM merged
  WHERE NOT coalesce(has_shop_action, false) AND NOT coalesce(has_pos_action, false)
    AND (target <> shop_quantity OR target <> pos_quantity)),
tails AS (
  SELECT *, sku || '|' || rev || '|' || previous_pos || '|' || pos_quantity || '|' || previous_shop || '|' || shop_quantity || '|' || target AS tail
  FROM open_rows),
planned AS (
  SELECT sku, 'shop' AS system, rev AS revision, shop_adj AS delta, target AS target_quantity, NULL AS expected_quantity, sha256('shop|' || tail) AS idempotency_key FROM tails WHERE shop_adj <> 0
  UNION ALL
  SELECT sku, 'pos', rev, pos_adj, target, pos_quantity, sha256('pos|' || tail) FROM tails WHERE pos_adj <> 0)
"""


@query("plan_adjustments", f"""
WITH {PLAN_SQL}
SELECT sku, system, CAST(revision AS INTEGER) AS revision, CAST(delta AS INTEGER) AS delta, CAST(target_quantity AS INTEGER) AS target_quantity,
  CAST(expected_quantity AS INTEGER) AS expected_quantity, idempotency_key FROM planned""")
def plan_adjustments(t: Tables) -> DataFrame:
    return reconcile.plan_adjustments(merged(t))


@query("init_baselines", f"""
WITH {p.SIDES_SQL}
SELECT p.sku, CAST(CASE WHEN n % 4 = 0 THEN shop_quantity ELSE greatest(0, pos_quantity + CASE WHEN n % 2 = 0 THEN n - 40 ELSE 0 END) END AS INTEGER) AS canonical,
  CAST(pos_quantity AS INTEGER) AS pos_seen, CAST(shop_quantity AS INTEGER) AS shop_seen, shop_at AS shop_seen_at
FROM pos p JOIN shop USING (sku) JOIN (SELECT sku, n FROM sides) USING (sku) WHERE sku NOT IN (SELECT sku FROM state)""")
def init_baselines(t: Tables) -> DataFrame:
    sides = p.stock_sides(t)
    overlay = sides.where("n % 2 = 0").select("sku", (F.col("n") - 40).alias("delta"))
    rebased = sides.where("n % 4 = 0").select("sku")
    return reconcile.initialize_baselines(p.pos_side(t), p.shop_side(t), p.stock_state(t), overlay, rebased)


@query("next_quantity_state", f"""
WITH {PLAN_SQL}
SELECT m.sku,
  CAST(CASE WHEN held THEN previous_canonical ELSE target END AS INTEGER) AS canonical,
  CAST(CASE WHEN held THEN previous_pos ELSE pos_quantity END AS INTEGER) AS pos_seen,
  CAST(CASE WHEN held THEN previous_shop ELSE shop_quantity END AS INTEGER) AS shop_seen,
  CASE WHEN NOT held THEN shop_at END AS shop_seen_at,
  CAST(coalesce(m.revision, 0) + CASE WHEN NOT held AND (target <> shop_quantity OR target <> pos_quantity) THEN 1 ELSE 0 END AS INTEGER) AS revision,
  CASE WHEN has_shop_action THEN 's' || m.sku WHEN NOT held THEN a.idempotency_key END AS shop_key,
  CASE WHEN has_pos_action THEN 'p' || m.sku WHEN NOT held THEN b.idempotency_key END AS pos_key
FROM (SELECT *, coalesce(has_shop_action, false) OR coalesce(has_pos_action, false) AS held FROM merged) m
LEFT JOIN (SELECT * FROM planned WHERE system = 'shop') a ON a.sku = m.sku
LEFT JOIN (SELECT * FROM planned WHERE system = 'pos') b ON b.sku = m.sku""")
def next_quantity_state(t: Tables) -> DataFrame:
    state = reconcile.next_state(merged(t))
    return state.select(
        *state.columns[:6], F.col("pending_shop.key").alias("shop_key"), F.col("pending_pos.key").alias("pos_key")
    )


@query("apply_shop_results", f"""
WITH {p.SIDES_SQL},
st AS (SELECT sku, canonical, pos_seen, shop_seen, revision, has_shop_action, has_pos_action, n FROM state JOIN (SELECT sku, n FROM sides) USING (sku)),
res AS (SELECT sku, n % 2 = 1 AS success, CASE WHEN n % 4 <> 1 THEN CASE WHEN n % 5 = 0 THEN 10 ELSE n END END AS quantity_after FROM sides WHERE n % 11 = 0),
j AS (SELECT st.*, quantity_after, coalesce(success, false) AND has_shop_action AS ok FROM st LEFT JOIN res USING (sku)),
k AS (SELECT *, ok AND quantity_after IS NOT NULL AS confirmed, ok AND quantity_after <> 10 AS missed FROM j),
l AS (SELECT *, coalesce(missed, false) AND pos_seen <> quantity_after AS replan FROM k)
SELECT sku, CAST(CASE WHEN confirmed THEN quantity_after ELSE canonical END AS INTEGER) AS canonical,
  CAST(CASE WHEN confirmed THEN quantity_after WHEN ok THEN shop_seen + 1 ELSE shop_seen END AS INTEGER) AS shop_seen,
  CAST(revision + CASE WHEN replan THEN 1 ELSE 0 END AS INTEGER) AS revision,
  has_shop_action AND NOT ok AS shop_open,
  CASE WHEN replan THEN sha256('pos|' || sku || '|' || (revision + 1) || '|' || pos_seen || '|' || quantity_after || '|10')
       WHEN coalesce(missed, false) OR (ok AND NOT confirmed) THEN NULL WHEN has_pos_action THEN 'p' || sku END AS pos_key
FROM l""")
def apply_shop_results(t: Tables) -> DataFrame:
    n = F.col("n")
    results = p.stock_sides(t).where("n % 11 = 0").select(
        "sku", (n % 2 == 1).alias("success"),
        F.when(n % 4 != 1, F.when(n % 5 == 0, 10).otherwise(n)).alias("quantity_after"), F.lit(None).cast("string").alias("updated_at"),
    )
    state = reconcile.apply_shop_results(p.stock_state(t), results)
    return state.select("sku", "canonical", "shop_seen", "revision", F.col("pending_shop").isNotNull().alias("shop_open"), F.col("pending_pos.key").alias("pos_key"))


@query("apply_till_results", f"""
WITH {p.SIDES_SQL}
SELECT sku, CAST(CASE WHEN has_pos_action AND n % 2 = 0 THEN 10 ELSE pos_seen END AS INTEGER) AS pos_seen,
  has_pos_action AND n % 2 <> 0 AS pos_open
FROM state JOIN (SELECT sku, n FROM sides) USING (sku)""")
def apply_till_results(t: Tables) -> DataFrame:
    results = p.stock_sides(t).where("n % 13 = 0").select("sku", (F.col("n") % 2 == 0).alias("success"))
    state = reconcile.apply_till_results(p.stock_state(t), results)
    return state.select("sku", "pos_seen", F.col("pending_pos").isNotNull().alias("pos_open"))


@query("retry_pending", f"""
WITH {p.SIDES_SQL},
st AS (SELECT s.* FROM state s JOIN (SELECT sku, n FROM sides) USING (sku) WHERE n % 7 <> 0)
SELECT sku, 'shop' AS system, CAST(1 AS INTEGER) AS delta, 's' || sku AS key FROM st WHERE has_shop_action
UNION ALL SELECT sku, 'pos', -1, 'p' || sku FROM st WHERE has_pos_action""")
def retry_pending(t: Tables) -> DataFrame:
    return reconcile.retry_pending(p.stock_state(t), p.stock_sides(t).where("n % 7 = 0").select("sku"))


@query("apply_adjustments_cas", f"""
WITH {p.CELLS_SQL},
own AS (SELECT sku AS base, count(*) AS item_rows, max(qty) AS item_quantity FROM (SELECT 'P' || p_partkey AS sku, p_size AS qty FROM part WHERE p_partkey % 23 <> 0 UNION ALL SELECT 'P' || p_partkey, p_size FROM part WHERE p_partkey % 29 = 0) GROUP BY 1),
grid AS (SELECT sku AS base, r || ' ' || c AS cell, count(*) AS cell_rows, max(q) AS cell_quantity FROM (SELECT sku, r, c, min(qty) AS q FROM cells GROUP BY 1, 2, 3) GROUP BY 1, 2),
adj AS (
  SELECT sku || '. ' || r || ' ' || c AS sku, sku AS base, r || ' ' || c AS cell, CAST(r AS BIGINT) AS delta, min(qty) + CASE r WHEN 3 THEN -3 WHEN 4 THEN 1 ELSE 0 END AS expected FROM cells GROUP BY sku, r, c
  UNION ALL SELECT 'P' || p_partkey, 'P' || p_partkey, NULL, 5, p_size - CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END FROM part),
j AS (
  SELECT adj.*, CASE WHEN adj.cell IS NULL THEN item_rows ELSE cell_rows END AS n, coalesce(item_rows, 0) AS item_rows,
    CASE WHEN adj.cell IS NULL THEN item_quantity ELSE cell_quantity END AS current
  FROM adj LEFT JOIN own ON adj.base = own.base LEFT JOIN grid ON adj.base = grid.base AND adj.cell = grid.cell),
k AS (
  SELECT *, CASE WHEN coalesce(n, 0) <> 1 THEN 'not_one_row' WHEN current = expected + delta THEN 'already_applied'
    WHEN current <> expected THEN 'conflict' WHEN cell IS NOT NULL AND item_rows <> 1 THEN 'parent_not_one_row' ELSE 'applied' END AS result FROM j)
SELECT sku, base, cell, delta, CAST(current AS BIGINT) AS current, result, CAST(CASE WHEN result = 'applied' THEN expected + delta ELSE current END AS BIGINT) AS quantity_after FROM k""")
def apply_adjustments_cas(t: Tables) -> DataFrame:
    part = t.part.select(p.code("P", "p_partkey").alias("sku"), F.col("p_size").cast("bigint").alias("quantity"), "p_partkey")
    items = part.where("p_partkey % 23 <> 0").unionByName(part.where("p_partkey % 29 = 0")).select("sku", "quantity")
    row, column = F.col("l_linenumber"), F.col("l_suppkey") % 3 + 1
    cells = t.lineitem.groupBy(p.code("P", "l_partkey").alias("sku"), row.alias("r"), column.alias("c")).agg(
        F.min(F.col("l_quantity").cast("bigint") - 20).alias("quantity")
    )
    cell = F.concat_ws(" ", F.col("r").cast("string"), F.col("c").cast("string"))
    shift = F.when(F.col("r") == 3, -3).when(F.col("r") == 4, 1).otherwise(0)
    by_cell = cells.select(F.concat(F.col("sku"), F.lit(". "), cell).alias("sku"), F.col("r").cast("bigint").alias("delta"), (F.col("quantity") + shift).alias("expected"))
    by_item = part.select("sku", F.lit(5).cast("bigint").alias("delta"), (F.col("quantity") - F.when(F.col("p_partkey") % 2 == 0, 5).otherwise(0)).alias("expected"))
    return reconcile.apply_adjustments_cas(items, cells.select("sku", cell.alias("cell"), "quantity"), by_cell.unionByName(by_item))


@query("adjustment_parent_totals", f"""
WITH {p.CELLS_SQL}
SELECT sku AS base, CAST(sum(r) AS BIGINT) AS delta FROM (SELECT DISTINCT sku, r, c FROM cells WHERE r NOT IN (3, 4)) GROUP BY 1""")
def adjustment_parent_totals(t: Tables) -> DataFrame:
    row, column = F.col("l_linenumber"), F.col("l_suppkey") % 3 + 1
    cells = t.lineitem.groupBy(p.code("P", "l_partkey").alias("sku"), row.alias("r"), column.alias("c")).agg(F.min(F.col("l_quantity").cast("bigint")).alias("quantity"))
    cell = F.concat_ws(" ", F.col("r").cast("string"), F.col("c").cast("string"))
    items = t.part.select(p.code("P", "p_partkey").alias("sku"), F.col("p_size").cast("bigint").alias("quantity"))
    shift = F.when(F.col("r").isin(3, 4), 7).otherwise(0)
    plan = cells.select(F.concat(F.col("sku"), F.lit(". "), cell).alias("sku"), F.col("r").cast("bigint").alias("delta"), (F.col("quantity") + shift).alias("expected"))
    results = reconcile.apply_adjustments_cas(items, cells.select("sku", cell.alias("cell"), "quantity"), plan)
    return reconcile.parent_totals(results)


SNAPSHOT_SQL = p.SIDES_SQL + """,
snap AS (
  SELECT sku, CASE WHEN n % 9 <> 0 THEN shop_quantity END AS quantity, CASE WHEN n % 37 = 0 THEN 'L2' ELSE 'L1' END AS location_id,
    CASE WHEN n % 10 <> 0 THEN strftime(last_at, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS updated_at,
    n % 12 <> 0 AS available, CASE WHEN n % 14 = 0 THEN 1 ELSE 0 END AS duplicate_count, n
  FROM sides WHERE shop_quantity IS NOT NULL AND n % 8 <> 0),
seen AS (
  SELECT sku, shop_seen, strftime(last_at + to_days(CASE WHEN n % 5 = 0 THEN 1 ELSE -1 END), '%Y-%m-%dT%H:%M:%SZ') AS shop_seen_at FROM sides WHERE n % 3 <> 0),
judged AS (
  SELECT snap.*, shop_seen, shop_seen_at, CASE WHEN location_id <> 'L1' THEN 'error_location' WHEN duplicate_count > 0 THEN 'blocked_duplicate'
    WHEN NOT available OR quantity IS NULL THEN 'blocked_unavailable'
    WHEN updated_at <> '' AND coalesce(shop_seen_at, '') <> '' AND updated_at < shop_seen_at THEN 'stored' ELSE 'usable' END AS status
  FROM snap LEFT JOIN seen USING (sku)),
usable AS (
  SELECT sku, status, CAST(CASE status WHEN 'usable' THEN quantity WHEN 'stored' THEN coalesce(shop_seen, 0) END AS INTEGER) AS quantity,
    CASE status WHEN 'usable' THEN nullif(updated_at, '') WHEN 'stored' THEN shop_seen_at END AS observed_at
  FROM judged
  UNION ALL SELECT sku, 'blocked_missing', NULL, NULL FROM sides WHERE sku NOT IN (SELECT sku FROM snap))
"""


def snapshot(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, sides = F.col("n"), p.stock_sides(t)
    snap = sides.where("shop_quantity IS NOT NULL AND n % 8 <> 0").select(
        "sku", F.when(n % 9 != 0, F.col("shop_quantity")).alias("quantity"), F.when(n % 37 == 0, "L2").otherwise("L1").alias("location_id"),
        F.when(n % 10 != 0, p.iso(F.col("last_at"))).otherwise("").alias("updated_at"), (n % 12 != 0).alias("available"),
        F.when(n % 14 == 0, 1).otherwise(0).alias("duplicate_count"), F.concat(F.lit("I"), F.col("sku")).alias("inventory_item_id"), "n", "last_at", "shop_quantity",
    )
    shift = F.make_dt_interval(F.when(n % 5 == 0, 1).otherwise(-1))
    seen = sides.where("n % 3 <> 0").select("sku", "shop_seen", p.iso(F.col("last_at") + shift).alias("shop_seen_at"))
    return snap, seen, sides.select("sku")


@query("usable_snapshot", f"WITH {SNAPSHOT_SQL} SELECT * FROM usable")
def usable_snapshot(t: Tables) -> DataFrame:
    snap, seen, expected = snapshot(t)
    return reconcile.usable_snapshot(snap, seen, "L1", expected)


@query("overlay_changes", f"""
WITH {SNAPSHOT_SQL},
chg AS (
  SELECT sku, CAST(CASE WHEN n % 6 = 0 THEN shop_quantity ELSE n END AS INTEGER) AS quantity, 'I' || sku || CASE WHEN n % 19 = 0 THEN 'x' ELSE '' END AS item,
    CASE WHEN n % 17 = 0 THEN 'L2' ELSE 'L1' END AS location_id,
    CASE WHEN n % 7 <> 0 THEN strftime(last_at + to_days(CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END), '%Y-%m-%dT%H:%M:%SZ') END AS src_at, n % 21 = 0 AS twice
  FROM sides WHERE n % 2 = 0),
j AS (
  SELECT c.sku, c.quantity AS new_q, c.item, c.location_id, c.src_at, c.twice, u.quantity AS old_q, u.observed_at,
    CAST(src_at AS TIMESTAMP) AS new_t, CAST(observed_at AS TIMESTAMP) AS old_t, s.sku IS NOT NULL AS in_snap
  FROM chg c LEFT JOIN (SELECT * FROM usable WHERE status IN ('usable', 'stored')) u ON c.sku = u.sku
  LEFT JOIN snap s ON s.sku = c.sku
  WHERE c.sku NOT IN (SELECT sku FROM usable WHERE status LIKE 'blocked%' OR status = 'error_location')),
k AS (
  SELECT *, CASE WHEN twice THEN 'conflict:several_items' WHEN old_q IS NULL THEN 'conflict:no_row' WHEN location_id <> 'L1' THEN 'conflict:location'
    WHEN item <> 'I' || sku THEN 'conflict:item'
    WHEN new_q = old_q AND new_t IS NOT NULL AND (old_t IS NULL OR new_t > old_t) THEN 'advance' WHEN new_q = old_q THEN 'keep'
    WHEN new_t IS NULL OR old_t IS NULL THEN 'conflict:no_time' WHEN new_t > old_t THEN 'overlay' WHEN new_t = old_t THEN 'conflict:same_time' ELSE 'ignore' END AS action
  FROM j)
SELECT sku, action, CASE WHEN action = 'overlay' THEN new_q ELSE old_q END AS quantity,
  CASE WHEN action IN ('overlay', 'advance') THEN src_at ELSE observed_at END AS observed_at,
  CAST(CASE WHEN action = 'overlay' THEN new_q - old_q ELSE 0 END AS INTEGER) AS delta FROM k""")
def overlay_changes(t: Tables) -> DataFrame:
    snap, seen, expected = snapshot(t)
    status = reconcile.usable_snapshot(snap, seen, "L1", expected)
    n = F.col("n")
    shift = F.make_dt_interval(F.when(n % 3 == 0, 1).when(n % 3 == 1, -1).otherwise(0))
    changes = p.stock_sides(t).where("n % 2 = 0").select(
        "sku", F.when(n % 6 == 0, F.col("shop_quantity")).otherwise(n).cast("int").alias("quantity"),
        F.concat(F.lit("I"), F.col("sku"), F.when(n % 19 == 0, "x").otherwise("")).alias("inventory_item_id"),
        F.when(n % 17 == 0, "L2").otherwise("L1").alias("location_id"), F.when(n % 7 != 0, p.iso(F.col("last_at") + shift)).alias("updated_at"), "n",
    )
    changes = changes.unionByName(changes.where("n % 21 = 0")).drop("n")
    usable = status.where("status IN ('usable', 'stored')")
    ignored = status.where("status LIKE 'blocked%' OR status = 'error_location'")
    return reconcile.overlay_changes(usable, snap, changes, expected, ignored, "L1")


@query("latest_observations", f"""
WITH {p.EVENTS_SQL},
c AS (SELECT seq, 'S' || (user_id % 40) AS sku, quantity, src_at, CASE WHEN user_id % 40 = 7 THEN 'I' || user_id ELSE 'I' || (user_id % 40) END AS item FROM ev),
amb AS (SELECT sku FROM c GROUP BY 1 HAVING count(DISTINCT item) > 1),
ok AS (SELECT *, CASE WHEN sku IN ('S1', 'S2', 'S3') THEN (SELECT epoch_us(min(ts)) + 86400000000 * 3 FROM events) END AS seen FROM c WHERE sku NOT IN (SELECT sku FROM amb) AND sku <> 'S9'),
pr AS (SELECT *, greatest(seen, max(src_at) OVER (PARTITION BY sku ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS before FROM ok)
SELECT sku, CAST(arg_max(quantity, seq) AS INTEGER) AS quantity, max(src_at) AS observed_at, count(*) AS applied
FROM pr WHERE src_at IS NULL OR before IS NULL OR src_at > before GROUP BY 1""")
def latest_observations(t: Tables) -> DataFrame:
    group = F.col("user_id") % 40
    changes = p.stock_events(t).select(
        "seq", F.concat(F.lit("S"), group.cast("string")).alias("sku"), "quantity", F.col("at").alias("updated_at"),
        F.when(group == 7, p.code("I", "user_id")).otherwise(F.concat(F.lit("I"), group.cast("string"))).alias("inventory_item_id"),
    )
    start = t.events.agg(F.min(p.micros(F.col("ts"))).alias("first"))
    state = start.select(F.explode(F.array(F.lit("S1"), F.lit("S2"), F.lit("S3"))).alias("sku"), (F.col("first") + 86_400_000_000 * 3).alias("seen_at"))
    blocked = changes.where("sku = 'S9'").select("sku").distinct()
    return reconcile.latest_observations(changes, state, blocked)


@query("blocked_skus", f"""
WITH {SNAPSHOT_SQL},
r AS (
  SELECT sku, status AS reason FROM usable WHERE status LIKE 'blocked%'
  UNION SELECT sku, 'open_action' FROM state WHERE has_shop_action OR has_pos_action)
SELECT sku, string_agg(reason, ';' ORDER BY reason) AS reasons FROM r GROUP BY 1""")
def blocked_skus(t: Tables) -> DataFrame:
    snap, seen, expected = snapshot(t)
    status = reconcile.usable_snapshot(snap, seen, "L1", expected)
    named = [(s, status.where(F.col("status") == s)) for s in ("blocked_duplicate", "blocked_unavailable", "blocked_missing")]
    held = p.stock_state(t).where("pending_shop IS NOT NULL OR pending_pos IS NOT NULL")
    return reconcile.blocked_skus(*named, ("open_action", held)).select("sku", F.concat_ws(";", "reasons").alias("reasons"))


@query("affected_base_skus", f"""
WITH {p.MAP_SQL}
SELECT DISTINCT 'P' || l_partkey AS base FROM lineitem
UNION SELECT base FROM sku_map WHERE sku LIKE '%1'
UNION SELECT 'P' || p_partkey FROM part WHERE p_size = 7""")
def affected_base_skus(t: Tables) -> DataFrame:
    child = F.concat(p.code("P", "l_partkey"), F.lit(".  "), F.col("l_linenumber").cast("string"), F.lit(" 2"))
    events = t.lineitem.select(child.alias("sku"))
    mapping = p.sku_map(t)
    changes = mapping.where("sku LIKE '%1'").select("sku")
    fresh = t.part.where("p_size = 7").select(p.code("P", "p_partkey").alias("sku"))
    return storefront.affected_base_skus(events, changes, fresh, mapping)


# -- prices ------------------------------------------------------------------

PRICES_SQL = p.CHANGES_SQL + """,
curr AS (SELECT sku, CAST(price AS VARCHAR) AS price FROM pc WHERE price >= 0),
prev AS (
  SELECT 'P' || p_partkey AS sku, CASE WHEN p_partkey % 3 = 0 THEN (SELECT c.price FROM curr c WHERE c.sku = 'P' || p_partkey) ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END AS price
  FROM part WHERE p_partkey % 7 <> 0)
"""
DIFF_SQL = PRICES_SQL + f""",
{p.MAP_SQL},
changed AS (SELECT c.sku AS source_sku, p.price AS old_price, c.price AS new_price FROM curr c LEFT JOIN prev p ON c.sku = p.sku WHERE c.price IS DISTINCT FROM p.price),
diff AS (
  SELECT source_sku, coalesce(m.sku, source_sku) AS target_sku, old_price, new_price
  FROM changed LEFT JOIN (SELECT * FROM sku_map WHERE sku <> base) m ON m.base = source_sku)
"""


@query("price_snapshot", f"WITH {PRICES_SQL} SELECT * FROM curr")
def price_snapshot(t: Tables) -> DataFrame:
    return prices.price_snapshot(p.price_change_rows(t), p.LINE_ARRIVAL)


def price_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    current = prices.price_snapshot(p.price_change_rows(t), p.LINE_ARRIVAL)
    known = t.part.where("p_partkey % 7 <> 0").select(p.code("P", "p_partkey").alias("sku"), "p_partkey", p.money("p_retailprice").cast("string").alias("listed"))
    previous = known.join(current, "sku", "left").select(
        "sku", F.when(F.col("p_partkey") % 3 == 0, F.col("price")).otherwise(F.col("listed")).alias("price")
    )
    return previous, current


@query("price_changes", f"WITH {DIFF_SQL} SELECT * FROM diff")
def price_changes(t: Tables) -> DataFrame:
    previous, current = price_sides(t)
    return prices.detect_price_changes(previous, current, p.sku_map(t))


@query("next_price_snapshot", f"""
WITH {DIFF_SQL},
failed AS (SELECT source_sku FROM changed WHERE CAST(substr(source_sku, 2) AS BIGINT) % 4 <> 0),
nxt AS (SELECT c.sku, CASE WHEN f.source_sku IS NOT NULL THEN p.price ELSE c.price END AS price
  FROM curr c LEFT JOIN failed f ON f.source_sku = c.sku LEFT JOIN prev p ON p.sku = c.sku)
SELECT * FROM nxt WHERE price IS NOT NULL""")
def next_price_snapshot(t: Tables) -> DataFrame:
    previous, current = price_sides(t)
    changes = prices.detect_price_changes(previous, current, p.sku_map(t))
    number = F.substring("sku", 2, 20).cast("bigint")
    # every third answer is missing, the rest succeed for every fourth part
    results = current.where(number % 3 != 1).select(F.col("sku").alias("source_sku"), (number % 4 == 0).alias("success"))
    results = results.unionByName(current.where((number % 3 == 1) & (number % 4 == 0)).select(F.col("sku").alias("source_sku"), F.lit(True).alias("success")))
    return prices.next_price_snapshot(current, previous, changes, results)


@query("validate_price_changes", f"""
WITH {DIFF_SQL},
c AS (
  SELECT CAST(substr(source_sku, 2) AS BIGINT) % 37 AS request_id, source_sku,
    CASE WHEN CAST(substr(source_sku, 2) AS BIGINT) % 43 = 0 THEN '-1' ELSE new_price END AS new_price,
    CASE WHEN CAST(substr(source_sku, 2) AS BIGINT) % 47 <> 0 THEN target_sku ELSE ' ' END AS target_sku FROM diff),
sizes AS (SELECT request_id, count(DISTINCT source_sku) AS request_changes, count(nullif(trim(target_sku), '')) AS request_targets FROM c GROUP BY 1),
per AS (
  SELECT request_id, source_sku, new_price, count(nullif(trim(target_sku), '')) AS targets,
    count(*) FILTER (trim(target_sku) <> '' AND length(target_sku) % 5 <> 0) AS done FROM c GROUP BY 1, 2, 3),
e AS (
  SELECT per.*, CASE WHEN request_changes > 100 THEN 'too_many_price_changes' WHEN request_targets > 1000 THEN 'too_many_price_targets'
    WHEN CAST(new_price AS DECIMAL(18,2)) < 0 THEN 'invalid_price_change' WHEN targets = 0 THEN 'invalid_price_targets' END AS error
  FROM per JOIN sizes USING (request_id))
SELECT request_id, source_sku, new_price, targets, done, error, error IS NULL AND done = targets AS success FROM e""")
def validate_price_changes(t: Tables) -> DataFrame:
    previous, current = price_sides(t)
    diff = prices.detect_price_changes(previous, current, p.sku_map(t))
    number = F.substring("source_sku", 2, 20).cast("bigint")
    changes = diff.select(
        (number % 37).alias("request_id"), "source_sku", F.when(number % 43 == 0, "-1").otherwise(F.col("new_price")).alias("new_price"),
        F.when(number % 47 != 0, F.col("target_sku")).otherwise(" ").alias("target_sku"),
    )
    results = p.sku_map(t).select(F.col("sku").alias("target_sku"), (F.length("sku") % 5 != 0).alias("success"))
    return prices.validate_price_changes(changes, results)
