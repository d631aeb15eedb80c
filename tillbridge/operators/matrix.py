"""Size/colour grids: headers, cells, variants, structure checks and repairs.

Grids stay in long form, one row per header or cell; no grid is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbridge.functions.keys import base_sku, child_sku, is_matrix_child
from tillbridge.functions.money import decimal_or_none, stock_quantity
from tillbridge.functions.text import clean_text, let, normalize_spaces
from tillbridge.operators.ordering import number_within
from tillbridge.session import materialize

# The stock states every location must report as zero before a repair.
STOCK_STATES = (
    "available", "committed", "damaged", "incoming", "on_hand", "quality_control", "reserved", "safety_stock",
)
MAX_REPAIR_VARIANTS = 100


def matrix_headers(rows: DataFrame, **blocks) -> DataFrame:
    """(sku, axis, position, header) in file order; blank headers stay as ''.

    Numbered once and stored: cells, options and audits all read them.
    """
    axis = F.upper(clean_text(F.col("RC")))
    kept = rows.select(
        clean_text(F.col("SKU")).alias("sku"), axis.alias("axis"),
        F.coalesce(clean_text(F.col("HEADER")), F.lit("")).alias("header"), "_rec_no",
    ).where("sku IS NOT NULL AND axis IN ('R', 'C')")
    return materialize(number_within(kept, ["sku", "axis"], "_rec_no", "position", **blocks).drop("_rec_no"), "grid-headers")


def header_values(headers: DataFrame) -> DataFrame:
    """Add ``value``: numbered fallback for blanks, ``(n)`` on repeats."""
    folded = F.lower(normalize_spaces(F.col("header")))
    repeats = headers.groupBy("sku", "axis", folded.alias("_folded")).agg(F.count(F.lit(1)).alias("_copies"))
    rows = headers.withColumn("_folded", folded).join(repeats, ["sku", "axis", "_folded"])
    prefix = F.when(F.col("axis") == "R", "Row ").otherwise("Column ")
    number = F.col("position").cast("string")
    value = F.coalesce(clean_text(F.col("header")), F.concat(prefix, number))
    value = F.when(F.col("_copies") > 1, F.concat(value, F.lit(" ("), number, F.lit(")"))).otherwise(value)
    return rows.withColumn("value", value).drop("_folded", "_copies")


def axis_summary(headers: DataFrame) -> DataFrame:
    """One row per SKU with both axes: sizes, option names, first headers."""
    upper = F.upper(normalize_spaces(F.col("header")))
    lengths = [F.bool_or(upper == x) for x in ("S", "R", "L")]
    only = F.coalesce(F.bool_and(F.when(upper != "", upper.isin("S", "R", "L"))), F.lit(False))
    per_axis = headers.groupBy("sku", "axis").agg(
        F.count(F.lit(1)).alias("n"), (only & lengths[0] & lengths[1] & lengths[2]).alias("is_length"),
        F.min_by("header", "position").alias("first_header"),
    )
    name = F.when(F.col("is_length"), "Length").when(F.col("axis") == "R", "Color").otherwise("Size")
    per_axis = per_axis.withColumn("option", name)

    def of(axis: str, column: str) -> Column:
        return F.max(F.when(F.col("axis") == axis, F.col(column)))

    return (
        per_axis.groupBy("sku").agg(
            of("R", "n").alias("row_count"), of("C", "n").alias("column_count"),
            of("R", "option").alias("row_option"), of("C", "option").alias("column_option"),
            of("R", "first_header").alias("first_row"), of("C", "first_header").alias("first_column"),
        )
        .where("row_count IS NOT NULL AND column_count IS NOT NULL")
    )


def parse_cell(cell: Column, row_count: Column, column_count: Column) -> Column:
    """(row, column) named by "r c" or "rc"; null unless exactly one reading fits.

    A compact text has one candidate split per digit, so nothing here grows
    with the grid.
    """
    def reading(row: Column, column: Column) -> Column:
        plain = ~row.startswith("0") & ~column.startswith("0")  # both are digits only, as the whole text was tested
        r, c = row.try_cast("int"), column.try_cast("int")
        return F.when(plain & (r <= row_count) & (c <= column_count), F.struct(r.alias("row"), c.alias("column")))

    def readings(text: Column) -> Column:
        spaced = F.array(reading(F.substring_index(text, " ", 1), F.substring_index(text, " ", -1)))
        n = F.length(text)
        splits = F.transform(F.sequence(F.lit(1), n - 1), lambda i: reading(F.substring(text, 1, i), F.substring(text, i + 1, n)))
        return F.array_compact(
            F.when(text.rlike("^[0-9]{2,20}$"), splits).when(text.rlike("^[0-9]+ [0-9]+$"), spaced)
        )

    fits = let(clean_text(cell), readings)
    return let(fits, lambda f: F.when(F.size(f) == 1, f[0]))


def build_matrix(cells: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, rejects) of SKUs with both axes; rejects name no single cell."""
    rows = cells.withColumn("sku", clean_text(F.col("SKU"))).join(axis_summary(headers), "sku")
    at = parse_cell(F.col("CELL"), F.col("row_count"), F.col("column_count"))
    rejects = rows.where(at.isNull()).select("sku", F.col("CELL").alias("cell"), "row_count", "column_count")
    # exploded, since a plain column is read anew by every later filter that moves below it
    good = rows.select("*", F.explode(F.array_compact(F.array(at))).alias("at")).select(
        "sku", F.col("at.row").alias("row"), F.col("at.column").alias("column"),
        F.concat_ws(" ", F.col("at.row").cast("string"), F.col("at.column").cast("string")).alias("cell"),
        F.coalesce(stock_quantity(decimal_or_none(F.col("QTY"))), F.lit(0)).alias("quantity"),
        F.coalesce(clean_text(F.col("BARCODE")), child_sku(F.col("sku"), F.col("at.row"), F.col("at.column"))).alias("barcode"),
        "row_count", "column_count", "row_option", "column_option", "first_row", "first_column",
    )
    return good, rejects


def raise_if_any(rejects: DataFrame, message: str) -> None:
    """Fail loudly when a reject frame has rows; an explicit action."""
    sample = rejects.limit(5).collect()
    if sample:
        raise ValueError(f"{message}: {[r.asDict() for r in sample]}")


def explode_variants(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """One variant per cell with its option values.

    When both axes share an option name the row value replaces the column
    value.
    """
    values = materialize(header_values(headers).select("sku", "axis", "position", "value"), "grid-values")
    rows_v = values.where("axis = 'R'").select("sku", F.col("position").alias("row"), F.col("value").alias("row_value"))
    cols_v = values.where("axis = 'C'").select("sku", F.col("position").alias("column"), F.col("value").alias("column_value"))
    joined = cells.join(cols_v, ["sku", "column"]).join(rows_v, ["sku", "row"])
    use_rows, use_columns = F.col("row_count") > 1, F.col("column_count") > 1
    none = ~use_rows & ~use_columns
    has_column, has_row = F.trim("first_column") != "", F.trim("first_row") != ""
    entries = F.array_compact(F.array(
        F.when((use_columns & ~(use_rows & (F.col("row_option") == F.col("column_option")))) | (none & has_column),
               F.struct(F.col("column_option").alias("key"), F.col("column_value").alias("value"))),
        F.when(use_rows | (none & ~has_column & has_row),
               F.struct(F.col("row_option").alias("key"), F.col("row_value").alias("value"))),
        F.when(none & ~has_column & ~has_row,
               F.struct(F.lit("Title").alias("key"), F.lit("Default Title").alias("value"))),
    ))
    return joined.select(
        F.col("sku").alias("base"), F.col("barcode").alias("sku"), "barcode",
        F.map_from_entries(entries).alias("option_values"), "quantity",
        F.lit(True).alias("tracked"), F.lit(True).alias("requires_shipping"), F.col("cell").alias("pos_cell"),
    )


def variant_totals(variants: DataFrame) -> DataFrame:
    """(sku, variant_count, variant_quantity) per base, for the product build."""
    return variants.groupBy(F.col("base").alias("sku")).agg(
        F.count(F.lit(1)).cast("int").alias("variant_count"), F.sum("quantity").cast("int").alias("variant_quantity")
    )


def validate_variants(variants: DataFrame) -> DataFrame:
    """Problems: missing codes, barcodes used twice, missing or repeated options."""
    options = F.array_join(F.transform(F.array_sort(F.map_entries("option_values")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    code = clean_text(F.col("barcode"))
    rows = variants.select("base", options.alias("options"), code.alias("code"), clean_text(F.col("sku")).alias("sku"))

    def claim(problem: str, owner: Column, value: Column) -> Column:
        return F.struct(F.lit(problem).alias("problem"), owner.alias("owner"), value.alias("value"))

    none = F.lit("")
    claims = F.array(
        F.when(F.col("sku").isNull() | F.col("code").isNull(), claim("missing_code", F.col("base"), none)),
        F.when(F.col("code").isNotNull(), claim("duplicate_barcode", none, F.col("code"))),
        F.when(F.col("options") == "", claim("missing_option", F.col("base"), none))
        .otherwise(claim("duplicate_option", F.col("base"), F.col("options"))),
    )
    # one pass: every rule is a key that may be claimed once, or not at all; the
    # aggregate sorts claims, whose texts begin alike, so a hash of them comes first
    counted = (
        rows.select("base", F.explode(F.array_compact(claims)).alias("c"))
        .groupBy(F.xxhash64("c").alias("_hash"), "c.problem", "c.owner", "c.value").agg(F.count(F.lit(1)).alias("rows"), F.min("base").alias("base"))
    )
    return counted.where("rows > 1 OR problem LIKE 'missing%'").select("base", "problem", "value", "rows")


def resolve_variant_row(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Known child SKU of each quantity row, or null.

    rows (sku, cell, barcode, ...); known (base, child). Barcode first, then
    two numbers, then compact digits when they name exactly one child.
    """
    children = materialize(known.select(F.col("base").alias("sku"), F.col("child")).distinct(), "grid-children")
    suffix = F.substring(F.col("child"), F.length(F.regexp_extract("child", r"^(.+?)\.\s*\d+\s+\d+$", 1)) + 1, F.length("child"))
    compact = (
        children.where(is_matrix_child(F.col("child")))
        .groupBy("sku", F.regexp_replace(suffix, r"\D", "").alias("_digits"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("child").alias("_compact")).where("_n = 1").drop("_n")
    )
    numbers = F.regexp_extract_all(F.col("cell"), F.lit(r"\d+"), 0)
    pair = F.when(F.size(numbers) == 2, child_sku(F.col("sku"), numbers[0].try_cast("bigint"), numbers[1].try_cast("bigint")))
    rows = rows.withColumns({
        "_barcode": F.trim("barcode"), "_pair": pair, "_digits": F.coalesce(F.array_join(numbers, ""), F.lit("")),
    })
    for key, name in (("_barcode", "_b"), ("_pair", "_p")):
        rows = rows.join(children.select("sku", F.col("child").alias(key), F.col("child").alias(name)), ["sku", key], "left")
    rows = rows.join(compact, ["sku", "_digits"], "left")
    return rows.withColumn("child", F.coalesce("_b", "_p", "_compact")).drop("_barcode", "_pair", "_digits", "_b", "_p", "_compact")


def targeted_quantities(items: DataFrame, cells: DataFrame, targets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Current quantities of the target bases only.

    items (sku, qty, seq); cells (sku, cell, barcode, qty, seq); targets
    (base); mapping (sku, base). Known children start at zero, rows of unknown
    children are ignored, and a base with children has no quantity of its own.
    The last row of a SKU wins.
    """
    wanted = targets.select(F.trim("base").alias("base")).where("base <> ''").distinct()
    children = materialize(mapping.where("sku <> base").join(wanted, "base", "left_semi").select("base", F.col("sku").alias("child")).distinct(), "grid-targets")
    parents = materialize(children.select(F.col("base").alias("sku")).distinct(), "grid-parents")
    number = stock_quantity(decimal_or_none(F.col("qty")))
    scalars = (
        items.select(F.trim("sku").alias("sku"), F.coalesce(number, F.lit(0)).alias("quantity"), "seq")
        .join(wanted.select(F.col("base").alias("sku")), "sku", "left_semi").join(parents, "sku", "left_anti")
        .groupBy("sku").agg(F.max_by("quantity", "seq").alias("quantity"))
    )
    found = resolve_variant_row(
        cells.withColumn("sku", F.trim("sku")).join(parents, "sku", "left_semi"), children
    ).where("child IS NOT NULL")
    found = found.groupBy("child").agg(F.max_by(F.coalesce(number, F.lit(0)), F.col("seq")).alias("quantity"))
    filled = children.select("child").distinct().join(found, "child", "left").select(
        F.col("child").alias("sku"), F.coalesce("quantity", F.lit(0)).alias("quantity")
    )
    return scalars.unionByName(filled)


def usable_rows(snapshot: DataFrame, location: str) -> DataFrame:
    """(sku, usable): one row, right location, no duplicates, stock known."""
    good = (
        (F.col("location_id") == location) & (F.coalesce("duplicate_sku_count", F.lit(0)) == 0)
        & F.coalesce("available_at_location", F.lit(False)) & F.col("quantity").isNotNull()
    )
    return snapshot.where("trim(sku) <> ''").groupBy(F.trim("sku").alias("sku")).agg(
        ((F.count(F.lit(1)) == 1) & F.bool_and(F.coalesce(good, F.lit(False)))).alias("usable")
    )


def matrix_structure(expected: DataFrame, snapshot: DataFrame, location: str) -> DataFrame:
    """Online shape of each matrix base: correct, scalar or blocked.

    expected (base, sku): the children the till knows.
    """
    rows = materialize(usable_rows(snapshot, location), "grid-usable")
    wanted = materialize(expected.select(F.trim("base").alias("base"), F.trim("sku").alias("sku")).where("sku <> ''").distinct(), "grid-expected")
    seen = wanted.join(rows, "sku", "left")
    bases = seen.groupBy("base").agg(
        F.count(F.lit(1)).alias("wanted"), F.count("usable").alias("present"),
        F.coalesce(F.bool_and(F.coalesce("usable", F.lit(False))), F.lit(False)).alias("all_usable"),
        F.bool_or(F.col("sku") == F.col("base")).alias("self_child"),
    )
    derived = rows.select(base_sku(F.col("sku")).alias("base"), "sku").where("sku <> base")
    extra = derived.join(wanted, ["base", "sku"], "left_anti").groupBy("base").agg(F.count(F.lit(1)).alias("extra"))
    own = rows.select(F.col("sku").alias("base"), F.col("usable").alias("base_usable"))
    joined = bases.join(extra, "base", "left").join(own, "base", "left")
    none_extra = F.coalesce("extra", F.lit(0)) == 0
    correct = F.col("base_usable").isNull() & none_extra & (F.col("present") == F.col("wanted")) & F.col("all_usable")
    scalar = F.coalesce("base_usable", F.lit(False)) & none_extra & (F.col("present") == 0)
    shape = (
        F.when((F.coalesce("base", F.lit("")) == "") | F.col("self_child"), "blocked")
        .when(correct, "correct").when(scalar, "scalar").otherwise("blocked")
    )
    return joined.select("base", shape.alias("shape"), "wanted", "present")


def product_options(variants: DataFrame) -> DataFrame:
    """(base, option, value, first_variant): distinct values in variant order.

    variants (base, pos, option_values).
    """
    entries = variants.select("base", "pos", F.posexplode(F.map_entries("option_values")).alias("option_pos", "e"))
    rows = entries.select("base", "pos", "option_pos", F.trim("e.key").alias("option"), F.trim("e.value").alias("value"))
    values = rows.groupBy("base", "option", "value").agg(
        F.min("pos").alias("first_variant"), F.min(F.struct("pos", "option_pos")).alias("_seen")
    )
    values = materialize(values, "grid-options")
    names = values.groupBy("base", "option").agg(F.min("_seen").alias("option_seen"))
    return values.drop("_seen").join(names, ["base", "option"])


def reuse_variant_ids(variants: DataFrame, online: DataFrame) -> DataFrame:
    """Online variant id each variant keeps: its SKU's, or the base's for the first.

    variants (base, pos, sku), pos from 0; online (base, variant_id, sku, pos).
    An id is given to the earliest claimant only.
    """
    by_sku = online.where("trim(sku) <> ''").groupBy("base", F.trim("sku").alias("sku")).agg(F.max_by("variant_id", "pos").alias("own_id"))
    fallback = online.groupBy("base").agg(
        F.max_by(F.when(F.trim("sku") == F.col("base"), F.col("variant_id")), F.when(F.trim("sku") == F.col("base"), F.col("pos"))).alias("base_id"),
        F.when(F.count(F.lit(1)) == 1, F.min("variant_id")).alias("only_id"),
    )
    rows = variants.join(by_sku, ["base", "sku"], "left").join(fallback, "base", "left")
    claim = F.coalesce("own_id", F.when(F.col("pos") == 0, F.coalesce("base_id", "only_id")))
    rows = rows.select("base", "pos", "sku", claim.alias("claim"))
    owner = rows.where("claim IS NOT NULL").groupBy("base", "claim").agg(F.min("pos").alias("_owner"))
    return rows.join(owner, ["base", "claim"], "left").select(
        "base", "pos", "sku", F.when(F.col("pos") == F.col("_owner"), F.col("claim")).alias("variant_id")
    )


def repair_eligibility(
    variants: DataFrame, online: DataFrame, levels: DataFrame, location: str, most: int = MAX_REPAIR_VARIANTS
) -> DataFrame:
    """Can a one-variant product become its grid: one status and reason per base.

    variants (base, sku, quantity); online (product_id, managed_sku,
    truncated, variant_id, sku, item_id, quantity at ``location``); levels
    (item_id, location_id, state, quantity).
    """
    wanted = variants.groupBy("base").agg(
        F.count(F.lit(1)).alias("wanted"), F.bool_or(F.col("quantity").isNull()).alias("unknown_stock"),
        F.bool_or(F.col("sku") == F.col("base")).alias("self_child"),
    )
    by_sku = online.groupBy("sku").agg(F.min_by(F.struct("product_id", "variant_id", "item_id", "quantity"), "variant_id").alias("v"))
    children = variants.join(by_sku, "sku", "left").groupBy("base").agg(
        F.count("v").alias("children"), F.min("v.product_id").alias("low"), F.max("v.product_id").alias("high"),
        F.bool_or(F.col("v.quantity").isNull()).alias("no_level"),
        F.bool_or(~F.col("v.quantity").eqNullSafe(F.col("quantity"))).alias("differs"),
    )
    products = online.groupBy("product_id").agg(
        F.first("managed_sku").alias("managed_sku"), F.bool_or("truncated").alias("truncated"),
        F.count(F.lit(1)).alias("variant_count"), F.count_if(F.coalesce(F.trim("sku"), F.lit("")) == "").alias("unnamed"),
    )
    states = levels.groupBy("item_id", F.coalesce(F.trim("location_id"), F.lit("")).alias("location_id")).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count_if(F.col("state").isin(*STOCK_STATES) & (F.col("quantity") == 0)) == len(STOCK_STATES)).alias("zero"),
        F.count_distinct("state").alias("states"),
    )
    empty = states.groupBy("item_id").agg(
        F.bool_and(F.col("zero") & (F.col("rows") == len(STOCK_STATES)) & (F.col("states") == len(STOCK_STATES)) & (F.col("location_id") != "")).alias("all_zero")
    )
    rows = (
        wanted.join(by_sku.select(F.col("sku").alias("base"), F.col("v").alias("own")), "base", "left")
        .join(children, "base", "left")
        .withColumn("product_id", F.coalesce("own.product_id", "low"))
        .join(products, "product_id", "left")
        .join(empty.withColumnRenamed("item_id", "_item"), F.col("own.item_id") == F.col("_item"), "left")
    )
    has_own = F.col("own").isNotNull()
    stock = F.col("own.quantity")
    reason = (
        F.when(F.coalesce("base", F.lit("")) == "", "no_base_sku")
        .when(F.col("unknown_stock"), "unknown_quantity")
        .when(F.col("wanted") > most, "too_many_variants")
        .when(F.col("self_child"), "child_equals_base")
        .when(~has_own & (F.col("children") < F.col("wanted")), "base_and_children_missing")
        .when(~has_own & (F.col("low") != F.col("high")), "several_products")
        .when(~F.col("managed_sku").eqNullSafe(F.col("base")), "not_managed")
        .when(F.coalesce("truncated", F.lit(True)), "truncated")
        .when(~has_own & ((F.col("variant_count") != F.col("wanted")) | (F.col("unnamed") > 0)), "other_variants")
        .when(~has_own & F.col("no_level"), "no_inventory")
        .when(has_own & (F.col("children") > 0), "children_exist")
        .when(has_own & (F.col("variant_count") != 1), "not_single_variant")
        .when(has_own & F.col("all_zero").isNull(), "no_locations")
        .when(has_own & ~F.col("all_zero"), "stock_not_zero")
        .when(has_own & stock.isNull(), "unavailable_at_location")
        .when(has_own & (stock != 0), "stock_not_zero")
    )
    rows = rows.withColumn("reason", reason)
    status = (
        F.when(F.col("reason").isNotNull(), "blocked")
        .when(has_own, "repairable")
        .when(F.col("differs"), "quantity_mismatch")
        .otherwise("already_correct")
    )
    return rows.select("base", status.alias("status"), "reason", "product_id")


def stage_after_scan(stage: Column, same: Column, shape: Column, confirmed: Column) -> Column:
    """Repair stage after a snapshot scan; null means nothing is pending.

    ``same`` says the payload is unchanged, ``confirmed`` that confirmed
    quantities equal the payload.
    """
    kept = F.when(same, stage)
    open_repair = kept.isin("candidate", "verification") & ~F.coalesce(confirmed, F.lit(False))
    return (
        F.when(shape == "correct", F.when(open_repair | (kept == "server_blocked"), kept))
        .when((shape == "scalar") & kept.isin("candidate", "verification", "server_blocked"), kept)
        .when(shape == "scalar", "candidate")
        .when(kept.isin("verification", "quantity_reconciliation"), kept)
        .otherwise("snapshot_blocked")
    )


def stage_after_result(status: Column, confirmed: Column) -> Column:
    """Repair stage after the storefront answered."""
    return (
        F.when(status.isin("repaired", "already_correct") & confirmed, "verification")
        .when(status == "quantity_mismatch", "quantity_reconciliation")
        .when(status == "blocked", "server_blocked")
        .otherwise("candidate")
    )


def length_option_repairs(variants: DataFrame, options: DataFrame) -> DataFrame:
    """Plan renaming a Color option that really holds S, R and L.

    variants (base, pos, sku, option_values); options (base, option, value)
    of the product found online. One row per base with a Length option.
    """
    bases = variants.groupBy("base").agg(F.bool_or(F.map_contains_key("option_values", F.lit("Length"))).alias("has")).where("has").select("base")
    upper = F.upper(F.trim("value"))
    per_option = options.groupBy("base", F.lower(F.trim("option")).alias("option")).agg(
        F.coalesce(F.bool_and(F.when(upper != "", upper.isin("S", "R", "L"))), F.lit(False)).alias("only"),
        *[F.bool_or(upper == x).alias(x) for x in "SRL"],
    )
    found = per_option.groupBy("base").agg(
        F.bool_or(F.col("option") == "length").alias("named"),
        F.bool_or((F.col("option") == "color") & F.col("only") & F.col("S") & F.col("R") & F.col("L")).alias("renames"),
    )
    status = (
        F.when(F.col("named").isNull(), "not_found").when(F.col("named"), "already_correct")
        .when(F.col("renames"), "rename").otherwise("not_applicable")
    )
    return bases.join(found, "base", "left").select("base", status.alias("status"))


def length_lookup_skus(variants: DataFrame, per_base: int = 10) -> DataFrame:
    """First child SKUs of a base, the ones used to find its product."""
    order = Window.partitionBy("base").orderBy("pos")
    return variants.where("trim(sku) <> ''").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_base)


def probe_candidates(items: DataFrame, known: DataFrame, mapping: DataFrame, not_before: DataFrame, now: Column) -> DataFrame:
    """Known matrix items without known children whose cooldown has passed."""
    parents = mapping.where("trim(sku) <> '' AND trim(base) <> '' AND trim(sku) <> trim(base)").select(F.trim("base").alias("sku")).distinct()
    matrix = items.where(F.upper(F.trim("type")) == "M").select(F.trim("sku").alias("sku")).where("sku <> ''").distinct()
    return (
        matrix.join(known.select(F.trim("sku").alias("sku")).distinct(), "sku", "left_semi")
        .join(parents, "sku", "left_anti")
        .join(not_before, "sku", "left")
        .where(now >= F.coalesce("not_before", F.lit(0)))
        .select("sku")
    )
