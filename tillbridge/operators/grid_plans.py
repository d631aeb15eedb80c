"""Change plan of products with variants, in two levels of rows.

Variants stay rows from end to end: the till's and the storefront's are matched by
a full outer join on product and SKU, and group totals, as partial aggregates, decide
what happens to each product. A product may hold any share of all variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.functions.money import shop_money
from tillbridge.operators.ordering import first_wins, last_wins
from tillbridge.session import materialize


def _blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def option_errors(variants: DataFrame) -> DataFrame:
    """(base, error): the first variant without options, or with a blank option name or value."""
    options = F.col("option_values")
    missing = options.isNull() | (F.size(F.map_keys(options)) == 0)
    invalid = F.exists(F.map_entries(options), lambda e: _blank(e["key"]) | _blank(e["value"]))
    error = F.when(missing, "missing_matrix_option").when(invalid, "invalid_matrix_option")
    return first_wins(variants.select("base", "pos", error.alias("error")).where("error IS NOT NULL"), ["base"], ["pos"], "error")


def product_options(variants: DataFrame) -> DataFrame:
    """(base, position, option, value_position, value): option names and values, each at its first place, trimmed."""
    entries = variants.select("base", "pos", F.posexplode(F.map_entries("option_values")).alias("at", "entry"))
    entries = entries.select("base", "pos", "at", F.trim("entry.key").alias("option"), F.trim("entry.value").alias("value"))
    values = entries.groupBy("base", "option", "value").agg(F.min(F.struct("pos", "at")).alias("first"))
    names = values.groupBy("base", "option").agg(F.min("first").alias("name_first"))
    # a place is the number of names, or values, that appear no later; both are bounded by a product's grid headers
    position = names.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("name_first", "option"))).alias("_names"))
    placed = values.groupBy("base", "option").agg(F.array_sort(F.collect_list(F.struct("first", "value"))).alias("_values"))
    flat = position.select("base", F.posexplode("_names").alias("position", "n")).select("base", (F.col("position") + 1).alias("position"), F.col("n.option").alias("option"))
    listed = flat.join(placed, ["base", "option"]).select("base", "position", "option", F.posexplode("_values").alias("value_position", "v"))
    return listed.select("base", "position", "option", (F.col("value_position") + 1).alias("value_position"), F.col("v.value").alias("value"))


def match_variants(payloads: DataFrame, variants: DataFrame, online: DataFrame) -> DataFrame:
    """Till and online variants side by side: base, product_id, the till's columns, and ``there`` (the online variant or null).

    An online SKU that repeats counts as its last variant. The first variant of a
    payload without an online one takes the base SKU's variant, or else a product's
    only one. An online variant goes to the first that claims it; those that nobody
    claims come with a null ``pos``.
    """
    named = online.withColumn("sku", F.coalesce(F.trim("sku"), F.lit("")))
    columns = ["variant_id", "sku", "price", "cost", "quantity"]
    by_sku = last_wins(named.where("sku <> ''"), ["product_id", "sku"], ["pos"], "variant_id")
    only = online.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.min("variant_id").alias("single")).where("n = 1")
    known = payloads.where("product_id IS NOT NULL").select("base", "product_id")
    spare = known.join(by_sku.select("product_id", F.col("sku").alias("base"), F.col("variant_id").alias("own")), ["product_id", "base"], "left")
    spare = spare.join(only.select("product_id", "single"), "product_id", "left").select("base", F.coalesce("own", "single").alias("_spare"))
    first = variants.groupBy("base").agg(F.min("pos").alias("_first"))
    wanted = variants.join(payloads.select("base", "product_id"), "base").join(first, "base")
    wanted = wanted.join(by_sku.withColumnRenamed("variant_id", "_same"), ["product_id", "sku"], "left").join(spare, "base", "left")
    claimed = wanted.withColumn("_claim", F.coalesce("_same", F.when(F.col("pos") == F.col("_first"), F.col("_spare")))).drop("_same", "_spare", "_first")
    claimed = materialize(claimed, "claims")
    winner = claimed.where("_claim IS NOT NULL").groupBy("product_id", F.col("_claim").alias("variant_id")).agg(F.min(F.struct("base", "pos")).alias("_winner"))
    there = named.join(winner, ["product_id", "variant_id"], "left").select(F.col("product_id").alias("_product"), F.struct(*columns).alias("there"), "_winner")
    match = (F.col("_product") == F.col("product_id")) & (F.col("_winner.base") == F.col("base")) & (F.col("_winner.pos") == F.col("pos"))
    # a variant that claims nothing, and an online one without a claim, stay on their own side
    both = claimed.join(there, match, "full")
    owner = known.select(F.col("base").alias("_base"), F.col("product_id").alias("_of"))
    both = both.join(owner, F.col("_product") == F.col("_of"), "left").where("pos IS NOT NULL OR _base IS NOT NULL")
    return both.select(F.coalesce("base", "_base").alias("base"), F.coalesce("product_id", "_product").alias("product_id"),
                       *[c for c in variants.columns if c != "base"], "there")


def plan_variant_changes(payloads: DataFrame, variants: DataFrame, online: DataFrame) -> DataFrame:
    """One row per variant: create, update, unchanged or remove, what changed, and the record to send.

    payloads (base, product_id or null); variants (base, pos, sku, barcode,
    option_values, price, compare_at_price, cost, quantity, tracked,
    requires_shipping); online (product_id, pos, variant_id, sku, price, cost, quantity).
    Only fields that are given are in the record; a product's listed variants replace
    those it has, so the others go.
    """
    rows = match_variants(payloads, variants, online)
    there = F.col("there").isNotNull()
    money = lambda c: shop_money(F.col(c))
    price = there & F.col("price").isNotNull() & ~money("price").eqNullSafe(money("there.price"))
    cost = there & F.col("cost").isNotNull() & ~money("cost").eqNullSafe(money("there.cost"))
    stock = there & F.col("quantity").isNotNull() & ~F.col("quantity").eqNullSafe(F.col("there.quantity"))
    renamed = there & ~F.col("sku").eqNullSafe(F.col("there.sku"))
    action = F.when(F.col("pos").isNull(), "remove").when(~there, "create").when(price | cost | stock | renamed, "update").otherwise("unchanged")
    record = F.to_json(F.struct(
        F.col("there.variant_id").alias("id"), "sku", "barcode", F.coalesce("tracked", F.lit(True)).alias("tracked"),
        F.coalesce("requires_shipping", F.lit(True)).alias("requires_shipping"), money("price").alias("price"),
        money("compare_at_price").alias("compare_at_price"), money("cost").alias("cost"), "quantity",
    ))
    return rows.select(
        "base", "product_id", "pos", F.coalesce("sku", "there.sku").alias("sku"), F.col("there.variant_id").alias("variant_id"), action.alias("action"),
        price.alias("price_changed"), cost.alias("cost_changed"), stock.alias("quantity_changed"), F.when(F.col("pos").isNotNull(), record).alias("record"),
    )


def plan_grid_products(payloads: DataFrame, variants: DataFrame, products: DataFrame) -> DataFrame:
    """One row per payload: create or update, its stock in total, and whether it is archived or restored.

    payloads (base, product_id or null, status, quantity); products (product_id,
    status, auto_archived). A payload's own quantity counts before the sum of
    its variants'. No stock archives and marks the product, unless an archived one
    is not ours; stock restores a product that this system archived, as a draft,
    unless the payload itself archives it. ``marker`` is what the mark is set to.
    """
    totals = variants.groupBy("base").agg(
        F.count(F.lit(1)).alias("variant_count"), F.sum("quantity").alias("_sum"), F.count_distinct("barcode").alias("barcode_count"),
        F.coalesce(F.bool_or(F.col("cost").isNotNull()), F.lit(False)).alias("cost_updated"),
        F.coalesce(F.bool_or(F.col("quantity").isNotNull()), F.lit(False)).alias("inventory_updated"),
    )
    known = products.select("product_id", F.upper(F.coalesce("status", F.lit(""))).alias("_status"), F.coalesce("auto_archived", F.lit(False)).alias("_ours"), F.lit(True).alias("_there"))
    rows = payloads.join(totals, "base").join(option_errors(variants), "base", "left").join(known, "product_id", "left")
    created = F.col("product_id").isNull()
    error = F.when(~created & F.col("_there").isNull(), "matrix_product_not_found").otherwise(F.col("error"))
    total = F.coalesce("quantity", "_sum").cast("long")
    asked = F.upper(F.trim(F.coalesce("status", F.lit(""))))
    manual = asked == "ARCHIVED"
    empty = F.coalesce(total <= 0, F.lit(False)) & ~manual
    archived = F.coalesce(F.col("_status") == "ARCHIVED", F.lit(False))
    ours = F.coalesce("_ours", F.lit(False))
    marks = empty & (created | ~archived | ours)
    restores = F.coalesce(total > 0, F.lit(False)) & ~manual & ours
    plan = rows.select(
        "base", "product_id", F.when(created, "create").otherwise("update").alias("action"), error.alias("error"), total.alias("total_quantity"),
        "variant_count", "barcode_count", "cost_updated", "inventory_updated", empty.alias("archives"), restores.alias("restores"),
        F.when(marks, True).when((manual & ~created) | restores, False).alias("marker"),
        F.when(restores & archived, "DRAFT").when(empty | manual, "ARCHIVED").when(asked != "", asked).when(created, "DRAFT").alias("status"),
    )
    refused = F.col("error").isNotNull()
    return plan.withColumns({
        "archives": F.col("archives") & ~refused, "restores": F.col("restores") & ~refused,
        "marker": F.when(~refused, F.col("marker")), "status": F.when(~refused, F.col("status")),
    })
