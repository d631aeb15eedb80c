"""Size/colour grids built from line items and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.operators import matrix, reports
from tillbridge.plans import proxies as p
from tillbridge.plans.catalog import BuildOptions, products
from tillbridge.plans.registry import Tables, query


# every part has 7 rows and 3 columns; some have one of each, some use S/R/L
HEADERS_SQL = """
heads AS (
  SELECT 'P' || p_partkey AS sku, 'R' AS axis, i AS position, CASE WHEN p_partkey % 4 = 0 AND i = 2 THEN '' WHEN p_partkey % 4 = 1 AND i > 5 THEN CASE WHEN i = 6 THEN 'Same' ELSE 'same' END ELSE 'Shade ' || i END AS header, p_partkey AS k
  FROM part, range(1, 8) r(i) WHERE p_partkey % 7 <> 0 OR i = 1
  UNION ALL
  SELECT 'P' || p_partkey, 'C', i, CASE WHEN p_partkey % 5 = 0 THEN ['S', 'R', 'L'][i] WHEN p_partkey % 7 = 0 AND p_partkey % 2 = 0 THEN '' ELSE 'Size ' || i END, p_partkey
  FROM part, range(1, 4) r(i) WHERE p_partkey % 7 <> 0 OR i = 1)
"""


def header_rows(t: Tables) -> DataFrame:
    k, i = F.col("p_partkey"), F.col("i")
    rows = t.part.select(k, F.explode(F.sequence(F.lit(1), F.lit(7))).alias("i")).where("p_partkey % 7 <> 0 OR i = 1")
    shade = F.when((k % 4 == 0) & (i == 2), "  ").when((k % 4 == 1) & (i > 5), F.when(i == 6, "Same").otherwise("same ")).otherwise(F.concat(F.lit("Shade  "), i.cast("string")))
    size = F.when(k % 5 == 0, F.element_at(F.array(F.lit("S"), F.lit("R"), F.lit("L")), i)).when((k % 7 == 0) & (k % 2 == 0), F.lit(None)).otherwise(F.concat(F.lit("Size "), i.cast("string")))
    down = rows.select(p.code("P", "p_partkey").alias("SKU"), F.lit("r").alias("RC"), shade.alias("HEADER"), (k * 100 + i).alias("_rec_no"))
    across = rows.where("i <= 3").select(p.code("P", "p_partkey").alias("SKU"), F.lit("C ").alias("RC"), size.alias("HEADER"), (k * 100 + 10 + i).alias("_rec_no"))
    return down.unionByName(across)


def headers(t: Tables) -> DataFrame:
    return matrix.matrix_headers(header_rows(t))


@query("matrix_headers", f"WITH {HEADERS_SQL} SELECT sku, axis, position, header FROM heads")
def matrix_headers(t: Tables) -> DataFrame:
    return headers(t).select("sku", "axis", F.col("position").cast("bigint").alias("position"), "header")


@query("header_values", f"""
WITH {HEADERS_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY sku, axis, lower(header)) AS n FROM heads)
SELECT sku, axis, position, CASE WHEN header <> '' THEN header WHEN axis = 'R' THEN 'Row ' || position ELSE 'Column ' || position END || CASE WHEN n > 1 THEN ' (' || position || ')' ELSE '' END AS value FROM c""")
def header_values(t: Tables) -> DataFrame:
    return matrix.header_values(headers(t)).select("sku", "axis", F.col("position").cast("bigint").alias("position"), "value")


@query("option_names", f"""
WITH {HEADERS_SQL}
SELECT sku, count(*) FILTER (axis = 'R') AS row_count, count(*) FILTER (axis = 'C') AS column_count, 'Color' AS row_option, CASE WHEN k % 5 = 0 AND k % 7 <> 0 THEN 'Length' ELSE 'Size' END AS column_option FROM heads GROUP BY sku, k""")
def option_names(t: Tables) -> DataFrame:
    return matrix.axis_summary(headers(t)).select("sku", "row_count", "column_count", "row_option", "column_option")


@query("matrix_cells", """
WITH c AS (
  SELECT l_orderkey % 1300 AS n, l_linenumber + 8 AS rows, l_suppkey % 9 + 4 AS cols, CASE WHEN l_orderkey % 3 = 0 THEN (l_orderkey % 13) || ' ' || (l_suppkey % 12) ELSE CAST(l_orderkey % 1300 AS VARCHAR) END AS cell FROM lineitem),
d AS (SELECT DISTINCT rows, cols, cell FROM c),
hit AS (SELECT d.rows, d.cols, d.cell, r, k FROM d JOIN range(1, 20) a(r) ON r <= rows JOIN range(1, 20) b(k) ON k <= cols WHERE cell = r || ' ' || k OR cell = r || '' || k),
one AS (SELECT rows, cols, cell, min(r) AS r, min(k) AS k FROM hit GROUP BY 1, 2, 3 HAVING count(*) = 1)
SELECT d.rows, d.cols, d.cell, CAST(r AS INTEGER) AS row_no, CAST(k AS INTEGER) AS column_no FROM d LEFT JOIN one USING (rows, cols, cell)""")
def matrix_cells(t: Tables) -> DataFrame:
    k = F.col("l_orderkey")
    pair = F.concat_ws(" ", (k % 13).cast("string"), (F.col("l_suppkey") % 12).cast("string"))
    rows = t.lineitem.select(
        (F.col("l_linenumber") + 8).alias("rows"), (F.col("l_suppkey") % 9 + 4).alias("cols"), F.when(k % 3 == 0, pair).otherwise((k % 1300).cast("string")).alias("cell"),
    ).distinct()
    at = matrix.parse_cell(F.col("cell"), F.col("rows"), F.col("cols"))
    return rows.withColumn("at", at).select("rows", "cols", "cell", F.col("at.row").alias("row_no"), F.col("at.column").alias("column_no"))


GRID_SQL = p.CELLS_SQL + ", " + HEADERS_SQL + """,
ax AS (SELECT sku, k, CASE WHEN k % 7 = 0 THEN 1 ELSE 7 END AS nr, CASE WHEN k % 7 = 0 THEN 1 ELSE 3 END AS nc FROM (SELECT DISTINCT sku, k FROM heads)),
g AS (SELECT c.*, ax.k, nr, nc, r <= nr AND c <= nc AS fits FROM cells c JOIN ax USING (sku)),
good AS (SELECT sku, k, r, c, r || ' ' || c AS cell, greatest(0, qty) AS quantity, coalesce(barcode, sku || '. ' || r || ' ' || c) AS barcode, nr, nc FROM g WHERE fits)
"""


@query("build_matrix", f"WITH {GRID_SQL} SELECT sku, r AS row_no, CAST(c AS INTEGER) AS column_no, cell, CAST(quantity AS INTEGER) AS quantity, barcode FROM good")
def build_matrix(t: Tables) -> DataFrame:
    cells, _ = matrix.build_matrix(p.cell_rows(t), headers(t))
    return cells.select("sku", F.col("row").alias("row_no"), F.col("column").alias("column_no"), "cell", "quantity", "barcode")


@query("matrix_rejects", f"WITH {GRID_SQL} SELECT sku, cell, count(*) AS rows FROM g WHERE NOT fits GROUP BY 1, 2")
def matrix_rejects(t: Tables) -> DataFrame:
    _, rejects = matrix.build_matrix(p.cell_rows(t), headers(t))
    return rejects.groupBy("sku", "cell").agg(F.count(F.lit(1)).alias("rows"))


def variants(t: Tables) -> DataFrame:
    heads = headers(t)
    cells, _ = matrix.build_matrix(p.cell_rows(t), heads)
    return matrix.explode_variants(cells, heads)


OPTIONS_SQL = GRID_SQL + """,
vals AS (SELECT sku, axis, position, CASE WHEN header <> '' THEN header WHEN axis = 'R' THEN 'Row ' || position ELSE 'Column ' || position END || CASE WHEN n > 1 THEN ' (' || position || ')' ELSE '' END AS value, header
  FROM (SELECT *, count(*) OVER (PARTITION BY sku, axis, lower(header)) AS n FROM heads)),
vr AS (
  SELECT good.*, CASE WHEN k % 5 = 0 AND k % 7 <> 0 THEN 'Length' ELSE 'Size' END AS copt, cv.value AS cval, rv.value AS rval, cv.header AS chead, rv.header AS rhead
  FROM good JOIN vals cv ON cv.sku = good.sku AND cv.axis = 'C' AND cv.position = c JOIN vals rv ON rv.sku = good.sku AND rv.axis = 'R' AND rv.position = r),
variants AS (
  SELECT sku AS base, barcode, quantity, cell, CASE WHEN nc > 1 THEN copt || '=' || cval || ';' || 'Color=' || rval
    WHEN chead <> '' THEN copt || '=' || cval WHEN rhead <> '' THEN 'Color=' || rval ELSE 'Title=Default Title' END AS options FROM vr)
"""


@query("explode_variants", f"WITH {OPTIONS_SQL} SELECT base, barcode, CAST(quantity AS INTEGER) AS quantity, cell AS pos_cell, options FROM variants")
def explode_variants(t: Tables) -> DataFrame:
    options = F.array_join(F.transform(F.map_entries("option_values"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return variants(t).select("base", "barcode", "quantity", "pos_cell", options.alias("options"))


@query("validate_variants", f"""
WITH {OPTIONS_SQL}
SELECT min(base) AS base, 'duplicate_barcode' AS problem, count(*) AS rows FROM variants GROUP BY barcode HAVING count(*) > 1
UNION ALL SELECT base, 'duplicate_option', count(*) FROM variants GROUP BY base, options HAVING count(*) > 1""")
def validate_variants(t: Tables) -> DataFrame:
    return matrix.validate_variants(variants(t)).select("base", "problem", "rows")


@query("matrix_variant_audit", f"""
WITH {OPTIONS_SQL}
SELECT base AS base_sku, barcode AS variant_sku, cell AS pos_cell, CAST(quantity AS INTEGER) AS quantity, CASE WHEN options LIKE 'Size=%' THEN regexp_extract(options, 'Size=([^;]*)', 1) ELSE '' END AS size,
  CASE WHEN options LIKE '%Color=%' THEN regexp_extract(options, 'Color=([^;]*)', 1) ELSE '' END AS color, CASE WHEN options LIKE 'Length=%' THEN regexp_extract(options, 'Length=([^;]*)', 1) ELSE '' END AS length,
  CASE WHEN options LIKE 'Title=%' THEN 'Default Title' ELSE '' END AS option_title, p_name AS product_title
FROM variants JOIN part ON 'P' || p_partkey = base""")
def matrix_variant_audit(t: Tables) -> DataFrame:
    titles = t.part.select(p.code("P", "p_partkey").alias("sku"), F.col("p_name").alias("title"), p.money("p_retailprice").alias("price"), F.lit(None).alias("cost"))
    return reports.matrix_variant_audit(variants(t), titles).drop("barcode", "price", "cost")


@query("matrix_products", f"""
WITH {GRID_SQL}
SELECT 'P' || p_partkey AS sku, CAST(count(good.sku) AS INTEGER) AS variant_count, CAST(coalesce(sum(quantity), 0) AS INTEGER) AS quantity FROM part LEFT JOIN good ON good.sku = 'P' || p_partkey
WHERE p_partkey % 10 = 0 AND p_partkey % 97 <> 0 AND p_partkey % 89 <> 0 GROUP BY 1 HAVING count(good.sku) > 0""")
def matrix_products(t: Tables) -> DataFrame:
    totals = matrix.variant_totals(variants(t))
    rows = products(t, BuildOptions(raw_titles=True, tags=False), matrix=totals)
    return rows.where("NOT missing AND variant_count > 0").select("sku", "variant_count", "quantity")


@query("resolve_variant_row", f"""
WITH {p.CELLS_SQL}, {p.MAP_SQL},
kn AS (SELECT base AS sku, sku AS child FROM sku_map WHERE sku <> base AND NOT sku LIKE '% 2')
SELECT c.sku, c.cell, count(k.child) AS resolved, count(*) AS rows FROM cells c LEFT JOIN kn k ON k.sku = c.sku AND k.child = c.sku || '. ' || r || ' ' || c.c GROUP BY 1, 2""")
def resolve_variant_row(t: Tables) -> DataFrame:
    known = p.sku_map(t).where("sku <> base AND NOT sku LIKE '% 2'").select("base", F.col("sku").alias("child"))
    rows = p.cell_rows(t).select(F.col("SKU").alias("sku"), F.col("CELL").alias("cell"), F.col("BARCODE").alias("barcode"))
    return matrix.resolve_variant_row(rows, known).groupBy("sku", "cell").agg(F.count("child").alias("resolved"), F.count(F.lit(1)).alias("rows"))


@query("targeted_quantities", f"""
WITH {p.CELLS_SQL}, {p.MAP_SQL},
tg AS (SELECT 'P' || p_partkey AS base FROM part WHERE p_partkey % 3 = 0),
kids AS (SELECT base, sku AS child FROM sku_map WHERE sku <> base AND base IN (SELECT base FROM tg)),
last AS (SELECT sku || '. ' || r || ' ' || c AS child, arg_max(greatest(0, qty), {p.LINE_ARRIVAL_SQL}) AS q FROM cells WHERE l_linenumber < 6 GROUP BY 1)
SELECT child AS sku, CAST(coalesce(q, 0) AS INTEGER) AS quantity FROM kids LEFT JOIN last USING (child)
UNION ALL SELECT 'P' || p_partkey, CAST(greatest(0, p_size - 10) AS INTEGER) FROM part WHERE p_partkey % 3 = 0 AND 'P' || p_partkey NOT IN (SELECT base FROM kids)""")
def targeted_quantities(t: Tables) -> DataFrame:
    items = t.part.select(p.code("P", "p_partkey").alias("sku"), (F.col("p_size") - 10).alias("qty"), F.col("p_partkey").alias("seq"))
    cells = p.cell_rows(t).where("l_linenumber < 6").select(
        F.col("SKU").alias("sku"), F.col("CELL").alias("cell"), F.col("BARCODE").alias("barcode"), F.col("QTY").alias("qty"), F.struct(*p.LINE_ARRIVAL).alias("seq"),
    )
    targets = t.part.where("p_partkey % 3 = 0").select(p.code("P", "p_partkey").alias("base"))
    return matrix.targeted_quantities(items, cells, targets, p.sku_map(t))


@query("product_options", f"""
WITH {OPTIONS_SQL},
v AS (SELECT base, r * 10 + c AS pos, copt, cval, rval, nc, chead, rhead FROM (SELECT sku AS base, * FROM vr)),
o AS (SELECT base, pos, copt AS option, cval AS value FROM v WHERE nc > 1 OR chead <> ''
  UNION ALL SELECT base, pos, 'Color', rval FROM v WHERE nc > 1 OR (chead = '' AND rhead <> '')
  UNION ALL SELECT base, pos, 'Title', 'Default Title' FROM v WHERE nc = 1 AND chead = '' AND rhead = '')
SELECT base, option, value, min(pos) AS first_variant FROM o GROUP BY 1, 2, 3""")
def product_options(t: Tables) -> DataFrame:
    rows = variants(t)
    place = F.split("pos_cell", " ")
    rows = rows.withColumn("pos", place[0].cast("bigint") * 10 + place[1].cast("bigint"))
    return matrix.product_options(rows).select("base", "option", "value", "first_variant")


@query("reuse_variant_ids", """
WITH v AS (SELECT 'P' || (p_partkey // 4 * 4) AS base, p_partkey % 4 AS pos, 'P' || p_partkey AS sku FROM part),
o AS (SELECT 'P' || (p_partkey // 4 * 4) AS base, p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'P' || p_partkey WHEN 1 THEN 'P' || (p_partkey - 1) || 'x' ELSE 'P' || p_partkey END AS sku FROM part WHERE p_partkey % 12 NOT IN (0, 5) AND p_partkey % 4 <> 3),
own AS (SELECT base, sku, max(id) AS own_id FROM o GROUP BY 1, 2), fb AS (SELECT base, max(CASE WHEN sku = base THEN id END) AS base_id, CASE WHEN count(*) = 1 THEN min(id) END AS only_id FROM o GROUP BY 1),
c AS (SELECT v.*, coalesce(own_id, CASE WHEN pos = 0 THEN coalesce(base_id, only_id) END) AS claim FROM v LEFT JOIN own USING (base, sku) LEFT JOIN fb USING (base))
SELECT base, pos, sku, CASE WHEN pos = min(pos) OVER (PARTITION BY base, claim) THEN claim END AS variant_id FROM c""")
def reuse_variant_ids(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    base = F.concat(F.lit("P"), (F.floor(k / 4) * 4).cast("string"))
    wanted = t.part.select(base.alias("base"), (k % 4).alias("pos"), p.code("P", "p_partkey").alias("sku"))
    known = t.part.where("p_partkey % 12 NOT IN (0, 5) AND p_partkey % 4 <> 3").select(
        base.alias("base"), k.alias("variant_id"), F.when(k % 4 == 1, F.concat(F.lit("P"), (k - 1).cast("string"), F.lit("x"))).otherwise(p.code("P", "p_partkey")).alias("sku"), k.alias("pos"),
    )
    return matrix.reuse_variant_ids(wanted, known)


@query("matrix_structure", f"""
WITH {p.MAP_SQL},
ex AS (SELECT base, sku FROM sku_map WHERE sku <> base),
snap AS (
  SELECT sku, base FROM ex WHERE CAST(substr(base, 2) AS BIGINT) % 30 <> 10
  UNION ALL SELECT base, base FROM ex WHERE CAST(substr(base, 2) AS BIGINT) % 30 = 10 OR CAST(substr(base, 2) AS BIGINT) % 70 = 0 GROUP BY 1, 2
  UNION ALL SELECT base || '. 9 9', base FROM ex WHERE CAST(substr(base, 2) AS BIGINT) % 80 = 0 GROUP BY 1, 2),
rows AS (SELECT sku, base, CAST(substr(base, 2) AS BIGINT) % 90 <> 0 AS usable FROM snap),
per AS (
  SELECT e.base, count(*) AS wanted, count(r.sku) AS present, bool_and(coalesce(usable, false)) AS good FROM ex e LEFT JOIN rows r USING (sku) GROUP BY 1),
own AS (SELECT sku AS base, usable AS own FROM rows WHERE sku = base),
extra AS (SELECT base, count(*) AS extra FROM rows WHERE sku LIKE '%. 9 9' GROUP BY 1)
SELECT base, CASE WHEN own IS NULL AND extra IS NULL AND present = wanted AND good THEN 'correct' WHEN coalesce(own, false) AND extra IS NULL AND present = 0 THEN 'scalar' ELSE 'blocked' END AS shape, wanted, present
FROM per LEFT JOIN own USING (base) LEFT JOIN extra USING (base)""")
def matrix_structure(t: Tables) -> DataFrame:
    expected = p.sku_map(t).where("sku <> base").select("base", "sku")
    n = F.substring("base", 2, 20).cast("bigint")
    bases = expected.select("base").distinct()
    rows = (
        expected.where(n % 30 != 10).select("sku", "base")
        .unionByName(bases.where((n % 30 == 10) | (n % 70 == 0)).select(F.col("base").alias("sku"), "base"))
        .unionByName(bases.where(n % 80 == 0).select(F.concat("base", F.lit(". 9 9")).alias("sku"), "base"))
    )
    snapshot = rows.select(
        "sku", F.when(n % 270 == 0, "L2").otherwise("L1").alias("location_id"), F.when(n % 180 == 90, 1).otherwise(0).alias("duplicate_sku_count"),
        F.lit(True).alias("available_at_location"), F.when(n % 90 != 0, 1).alias("quantity"),
    )
    return matrix.matrix_structure(expected, snapshot, "L1")


@query("repair_eligibility", """
WITH b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 20 = 17 THEN '' ELSE 'P' || p_partkey END AS base, p_partkey % 20 AS c FROM part)
SELECT DISTINCT base, CASE WHEN c IN (0, 19) THEN 'repairable' WHEN c = 2 THEN 'already_correct' WHEN c = 18 THEN 'quantity_mismatch' ELSE 'blocked' END AS status,
  CASE c WHEN 1 THEN 'unknown_quantity' WHEN 3 THEN 'child_equals_base' WHEN 4 THEN 'stock_not_zero' WHEN 5 THEN 'base_and_children_missing' WHEN 6 THEN 'several_products' WHEN 7 THEN 'not_managed'
    WHEN 8 THEN 'truncated' WHEN 9 THEN 'other_variants' WHEN 10 THEN 'no_inventory' WHEN 11 THEN 'children_exist' WHEN 12 THEN 'not_single_variant' WHEN 13 THEN 'no_locations'
    WHEN 14 THEN 'unavailable_at_location' WHEN 15 THEN 'stock_not_zero' WHEN 16 THEN 'too_many_variants' WHEN 17 THEN 'no_base_sku' END AS reason FROM b""")
def repair_eligibility(t: Tables) -> DataFrame:
    """Twenty cases by part number: each way to be refused, and the ways not to be. Grids have two variants, three at most are repaired."""
    k, c = F.col("p_partkey"), F.col("c")
    part = t.part.select(k, F.when(k % 20 == 17, "").otherwise(p.code("P", "p_partkey")).alias("base"), p.code("P", "p_partkey").alias("name"), (k % 20).alias("c"))
    tails = F.array(*[F.lit(x) for x in (". 1 1", ". 1 2", ". 1 3", ". 1 4")])
    wanted = part.select(k, "base", "name", "c", F.posexplode(F.slice(tails, F.lit(1), F.when(c == 16, 4).otherwise(2))).alias("n", "tail")).select(
        k, "base", "name", "c", "n", F.when((c == 3) & (F.col("n") == 0), F.col("base")).otherwise(F.concat("name", "tail")).alias("sku"), F.when(c != 1, 3).alias("quantity"),
    )
    grids = c.isin(2, 6, 7, 8, 9, 10, 18) | ((c == 11) & (F.col("n") == 0))
    children = wanted.where(grids).select(
        F.when((c == 6) & (F.col("n") == 1), F.concat("name", F.lit("b"))).otherwise(F.col("name")).alias("product_id"), F.when(c == 7, "other").otherwise(F.col("base")).alias("managed_sku"),
        (c == 8).alias("truncated"), F.col("sku").alias("variant_id"), "sku", F.col("sku").alias("item_id"), F.when(c == 18, 4).when(c != 10, 3).alias("quantity"),
    )
    held = part.where(c.isin(0, 4, 11, 12, 13, 14, 15, 19))
    own = held.select(
        F.col("name").alias("product_id"), F.col("base").alias("managed_sku"), F.lit(False).alias("truncated"), F.col("name").alias("variant_id"), F.col("base").alias("sku"), F.col("name").alias("item_id"),
        F.when(c == 15, 5).when(c != 14, 0).alias("quantity"),
    )
    others = part.where(c.isin(9, 12)).select(
        F.col("name").alias("product_id"), F.col("base").alias("managed_sku"), F.lit(False).alias("truncated"), F.concat(F.lit("X"), "name").alias("variant_id"), F.concat(F.lit("X"), "name").alias("sku"),
        F.concat(F.lit("X"), "name").alias("item_id"), F.lit(0).alias("quantity"),
    )
    states = F.array(*[F.lit(s) for s in matrix.STOCK_STATES])
    places = F.slice(F.array(F.lit("L1"), F.lit("L2")), F.lit(1), F.when(c == 19, 1).otherwise(2))
    levels = held.where(c != 13).select(F.col("name").alias("item_id"), "c", F.explode(places).alias("location_id")).select("item_id", "location_id", "c", F.explode(states).alias("state"))
    levels = levels.withColumn("quantity", F.when((c == 4) & (F.col("state") == "committed"), 2).otherwise(0)).drop("c")
    found = matrix.repair_eligibility(wanted.select("base", "sku", "quantity"), own.unionByName(children).unionByName(others), levels, "L1", most=3)
    return found.select("base", "status", "reason")


@query("repair_stage", """
WITH e AS (
  SELECT event_id, ['candidate', 'verification', 'quantity_reconciliation', 'server_blocked', 'snapshot_blocked'][CAST(event_id % 5 + 1 AS INTEGER)] AS stage, event_id % 3 <> 0 AS same,
    ['correct', 'scalar', 'blocked'][CAST(user_id % 3 + 1 AS INTEGER)] AS shape, event_id % 2 = 0 AS confirmed, ['repaired', 'already_correct', 'quantity_mismatch', 'blocked', 'failed'][CAST(user_id % 5 + 1 AS INTEGER)] AS status FROM events),
k AS (SELECT *, CASE WHEN same THEN stage END AS kept FROM e)
SELECT event_id, CASE WHEN shape = 'correct' THEN CASE WHEN (kept IN ('candidate', 'verification') AND NOT confirmed) OR kept = 'server_blocked' THEN kept END
  WHEN shape = 'scalar' THEN CASE WHEN kept IN ('candidate', 'verification', 'server_blocked') THEN kept ELSE 'candidate' END
  WHEN kept IN ('verification', 'quantity_reconciliation') THEN kept ELSE 'snapshot_blocked' END AS after_scan,
  CASE WHEN status IN ('repaired', 'already_correct') AND confirmed THEN 'verification' WHEN status = 'quantity_mismatch' THEN 'quantity_reconciliation' WHEN status = 'blocked' THEN 'server_blocked' ELSE 'candidate' END AS after_result FROM k""")
def repair_stage(t: Tables) -> DataFrame:
    def one_of(column: F.Column, *values: str) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (column + 1).cast("int"))

    k, u = F.col("event_id"), F.col("user_id")
    stage = one_of(k % 5, "candidate", "verification", "quantity_reconciliation", "server_blocked", "snapshot_blocked")
    shape, confirmed = one_of(u % 3, "correct", "scalar", "blocked"), k % 2 == 0
    status = one_of(u % 5, "repaired", "already_correct", "quantity_mismatch", "blocked", "failed")
    return t.events.select(
        "event_id", matrix.stage_after_scan(stage, k % 3 != 0, shape, confirmed).alias("after_scan"), matrix.stage_after_result(status, confirmed).alias("after_result"),
    )


@query("length_option_repairs", f"""
WITH {OPTIONS_SQL}, b AS (SELECT DISTINCT base, CAST(substr(base, 2) AS BIGINT) AS k FROM variants WHERE options LIKE 'Length=%')
SELECT base, CASE WHEN k % 20 = 0 THEN 'already_correct' WHEN k % 15 = 0 THEN 'not_applicable' WHEN k % 25 = 0 THEN 'not_found' ELSE 'rename' END AS status FROM b""")
def length_option_repairs(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    found = t.part.where("p_partkey % 5 = 0 AND (p_partkey % 25 <> 0 OR p_partkey % 20 = 0 OR p_partkey % 15 = 0)").select(
        p.code("P", "p_partkey").alias("base"), F.when(k % 20 == 0, " length").otherwise("Color").alias("option"),
        F.explode(F.when(k % 15 == 0, F.array(F.lit("S"), F.lit("R"))).otherwise(F.array(F.lit("s "), F.lit("R"), F.lit("L")))).alias("value"),
    )
    return matrix.length_option_repairs(variants(t), found)


@query("length_lookup_skus", f"""
WITH {p.MAP_SQL}, r AS (SELECT base, sku, row_number() OVER (PARTITION BY base ORDER BY sku) AS n FROM sku_map WHERE sku <> base)
SELECT base, sku, CAST(n AS INTEGER) AS n FROM r WHERE n <= 10""")
def length_lookup_skus(t: Tables) -> DataFrame:
    children = p.sku_map(t).where("sku <> base").withColumn("pos", F.col("sku"))
    return matrix.length_lookup_skus(children).select("base", "sku", "n")


@query("probe_candidates", f"""
WITH {p.MAP_SQL}
SELECT 'P' || p_partkey AS sku FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 3 <> 0 AND 'P' || p_partkey NOT IN (SELECT base FROM sku_map WHERE sku <> base) AND (p_partkey % 8 <> 0 OR p_size < 25)""")
def probe_candidates(t: Tables) -> DataFrame:
    sku = p.code("P", "p_partkey")
    items = t.part.select(sku.alias("sku"), F.when(F.col("p_partkey") % 4 == 0, "m ").otherwise("S").alias("type"))
    waits = t.part.where("p_partkey % 8 = 0").select(sku.alias("sku"), (F.col("p_size") * 100).alias("not_before"))
    return matrix.probe_candidates(items, t.part.where("p_partkey % 3 <> 0").select(sku.alias("sku")), p.sku_map(t), waits, F.lit(2499))
