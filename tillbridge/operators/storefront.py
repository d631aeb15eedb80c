"""Compare product payloads with the online catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.functions.keys import base_sku, fingerprint, is_matrix_child
from tillbridge.functions.money import shop_money
from tillbridge.operators.ordering import running_length, previous_value


def exact_sku_match(requested: DataFrame, variants: DataFrame) -> DataFrame:
    """Match trimmed SKUs exactly: found, not_found or duplicate.

    ``requested`` has (sku); ``variants`` has (sku, variant_id, product_id).
    A duplicate keeps its count; ``duplicate_variants`` lists the ids.
    """
    online = variants.select(F.trim("sku").alias("sku"), "variant_id", "product_id").groupBy("sku").agg(
        F.count(F.lit(1)).alias("matches"),
        F.min_by(F.struct("variant_id", "product_id"), "variant_id").alias("one"),
    )
    n = F.coalesce(F.col("matches"), F.lit(0))
    found = n == 1
    return (
        requested.select(F.trim("sku").alias("sku"))
        .distinct()
        .join(online, "sku", "left")
        .select(
            "sku",
            F.when(n == 0, "not_found").when(found, "found").otherwise("duplicate").alias("status"),
            n.alias("matches"),
            F.when(found, F.col("one.variant_id")).alias("variant_id"),
            F.when(found, F.col("one.product_id")).alias("product_id"),
        )
    )


def duplicate_variants(matched: DataFrame, variants: DataFrame) -> DataFrame:
    """Every variant id behind a duplicate SKU, one row each."""
    clashing = matched.where("status = 'duplicate'").select("sku")
    return variants.select(F.trim("sku").alias("sku"), "variant_id").join(clashing, "sku", "left_semi")


def match_existing(payloads: DataFrame, payload_variants: DataFrame, online: DataFrame) -> DataFrame:
    """Find each payload's online variant: external id, SKU, variant SKUs, handle.

    payloads (payload_id, external_id, sku, handle); payload_variants
    (payload_id, pos, sku); online (product_id, handle, variant_id, sku, pos).
    Each lookup side has one row per key, so no key pair can multiply.
    """
    firsts = online.groupBy("product_id").agg(
        F.min_by("variant_id", "pos").alias("first_variant"),
        F.first("handle").alias("handle"),
        F.count(F.lit(1)).alias("variant_count"),
    )
    in_product = online.groupBy("product_id", F.trim("sku").alias("sku")).agg(
        F.min_by("variant_id", "pos").alias("sku_variant")
    )
    by_sku = online.groupBy(F.trim("sku").alias("sku")).agg(
        F.min_by(F.struct("product_id", "variant_id"), F.struct("product_id", "pos")).alias("hit"),
        F.count(F.lit(1)).alias("copies"),
    )
    lead = payload_variants.groupBy("payload_id").agg(F.min_by("sku", "pos").alias("lead_sku"))
    wanted = payloads.join(lead, "payload_id", "left")

    def product_level(rows: DataFrame, priority: int, target: Column, error: Column) -> DataFrame:
        rows = rows.withColumn("_target", target).join(
            in_product.select("product_id", F.col("sku").alias("_target"), "sku_variant"),
            ["product_id", "_target"], "left",
        )
        return rows.select(
            "payload_id", F.struct(F.lit(priority), F.lit(0)).alias("rank"), "product_id",
            F.coalesce("sku_variant", "first_variant").alias("variant_id"), error.alias("error"),
        )

    external = product_level(
        wanted.join(firsts.drop("handle"), wanted["external_id"] == firsts["product_id"]),
        1, F.col("sku"), F.lit(None).cast("string"),
    )

    def sku_level(rows: DataFrame, priority: int, pos: Column) -> DataFrame:
        return rows.join(by_sku, "sku").select(
            "payload_id", F.struct(F.lit(priority), pos).alias("rank"), "hit.product_id", "hit.variant_id",
            F.when(F.col("copies") > 1, "duplicate_sku").alias("error"),
        )

    direct = sku_level(payloads.select("payload_id", F.trim("sku").alias("sku")), 2, F.lit(0))
    nested = sku_level(payload_variants.select("payload_id", "pos", F.trim("sku").alias("sku")), 3, F.col("pos").cast("int"))
    # a handle names one product; the lowest id wins if two share it
    handles = firsts.where("handle <> ''").groupBy("handle").agg(
        F.min_by(F.struct("product_id", "first_variant", "variant_count"), "product_id").alias("p")
    ).select("handle", "p.*")
    handled = product_level(
        wanted.join(handles, "handle"), 4, F.coalesce("lead_sku", "sku"),
        F.when((F.col("variant_count") > 1) & F.col("lead_sku").isNull(), "ambiguous_handle"),
    )
    ranked = external.unionByName(direct).unionByName(nested).unionByName(handled)
    best = ranked.groupBy("payload_id").agg(F.min_by(F.struct("rank", "product_id", "variant_id", "error"), "rank").alias("b"))
    how = F.try_element_at(
        F.array(*[F.lit(x) for x in ("external_id", "sku", "variant_sku", "handle")]), F.col("b.rank.col1")
    )
    failed = F.col("b.error").isNotNull()
    return payloads.select("payload_id").join(best, "payload_id", "left").select(
        "payload_id", how.alias("matched_by"),
        F.when(~failed, F.col("b.product_id")).alias("product_id"),
        F.when(~failed, F.col("b.variant_id")).alias("variant_id"), F.col("b.error").alias("error"),
    )


def plan_product_changes(payloads: DataFrame, online: DataFrame) -> DataFrame:
    """Create or update per SKU, what changed, and the fields to send.

    payloads (sku, title, price, cost, quantity); online (sku, product_id,
    online_price, online_cost, online_quantity), one row per SKU. Price
    compares as given, cost after rounding half-up.
    """
    rows = payloads.join(online, "sku", "left")
    mapped = F.col("product_id").isNotNull()
    price = F.col("price").isNotNull() & ~F.col("price").eqNullSafe(F.col("online_price"))
    cost = F.col("cost").isNotNull() & ~shop_money(F.col("cost")).eqNullSafe(shop_money(F.col("online_cost")))
    stock = F.col("quantity").isNotNull() & ~F.col("quantity").eqNullSafe(F.col("online_quantity"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("sku", F.lit("")), F.lit("POS Imported Product"))
    record = F.to_json(F.struct(
        F.when(mapped, F.nullif("title", F.lit(""))).otherwise(title).alias("title"),
        shop_money(F.col("price")).alias("price"), shop_money(F.col("cost")).alias("cost"), "quantity",
    ))
    return rows.select(
        "sku", "product_id", F.when(mapped, "update").otherwise("create").alias("action"),
        (mapped & price).alias("price_changed"), cost.alias("cost_changed"),
        stock.alias("quantity_changed"), record.alias("record"),
    )


def reconcile_catalog(source: DataFrame, variants: DataFrame, minimum: int | None = None) -> DataFrame:
    """Class of every online product against the till's SKU list.

    With ``minimum`` a source of fewer distinct SKUs is refused before anything is
    compared. ``source`` has (sku); ``variants`` has one row per online variant
    (product_id, status, marker, truncated, sku), sku null for a product
    without variants. Comparison ignores case.
    """
    if minimum is not None:
        refuse_incomplete_source(source, minimum)
    known = source.select(F.lower(F.trim("sku")).alias("folded")).where("folded <> ''").distinct()
    sku = F.nullif(F.trim("sku"), F.lit(""))
    marker = F.lower(F.nullif(F.trim("marker"), F.lit("")))
    rows = variants.select(
        "product_id", F.upper(F.coalesce("status", F.lit(""))).alias("status"), "truncated",
        F.lower(sku).alias("folded"), marker.alias("marker"),
        (F.lower(base_sku(sku)) == marker).alias("own"),
    ).join(known.withColumn("hit", F.lit(True)), "folded", "left")
    products = rows.groupBy("product_id").agg(
        F.first("status").alias("status"), F.first("marker").alias("marker"),
        F.bool_or("truncated").alias("truncated"), F.count("folded").alias("sku_count"),
        F.coalesce(F.bool_or("own"), F.lit(False)).alias("managed"),
        F.coalesce(F.bool_or("hit"), F.lit(False)).alias("sku_known"),
    ).join(known.select(F.col("folded").alias("marker"), F.lit(True).alias("marker_known")), "marker", "left")
    matched = F.col("sku_known") | F.coalesce(F.col("marker_known"), F.lit(False))
    label = (
        F.when(F.col("truncated"), "truncated")
        .when(F.col("sku_count") == 0, "without_sku")
        .when(~F.col("managed"), "unmanaged")
        .when(matched, "matched")
        .when(F.col("status") == "ARCHIVED", "already_archived")
        .otherwise("candidate")
    )
    return products.select("product_id", "status", label.alias("class"))


def refuse_incomplete_source(source: DataFrame, minimum: int = 100) -> None:
    """Raise when the till's SKU list is empty or too short to be whole."""
    found = source.select(F.trim("sku").alias("sku")).where("sku <> ''").distinct().limit(minimum).count()
    if found < minimum:
        raise ValueError(f"source lists {found} SKUs, fewer than {minimum}: refusing to reconcile")


def search_catalog(
    catalog: DataFrame, order: Sequence[str], sku: str | None = None, status: str | None = None,
    search: str | None = None, page: int = 1, per_page: int = 50, most: int = 250,
) -> DataFrame:
    """Exact SKU, status without case, text in title, SKU or handle; one page."""
    if sku and sku.strip():
        catalog = catalog.where(F.trim("sku") == sku.strip())
    if status and status.strip():
        catalog = catalog.where(F.lower("status") == status.strip().lower())
    if search and search.strip():
        needle = F.lit(search.strip().lower())
        hits = [F.coalesce(F.contains(F.lower(c), needle), F.lit(False)) for c in ("title", "sku", "handle")]
        catalog = catalog.where(hits[0] | hits[1] | hits[2])
    size = max(1, min(per_page, most))
    return catalog.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


# -- stability, new SKUs, flattening -----------------------------------------

def stable_payloads(payloads: DataFrame, previous: DataFrame, columns: Sequence[str], needed: int = 2) -> DataFrame:
    """One scan: how often each payload was seen unchanged, and if it is ready.

    ``previous`` is (sku, fingerprint, observations) of the scan before.
    """
    now = payloads.withColumn("fingerprint", fingerprint(*[F.col(c) for c in columns]))
    before = previous.select("sku", F.col("fingerprint").alias("_was"), F.col("observations").alias("_seen"))
    same = F.col("_was") == F.col("fingerprint")
    seen = F.when(same, F.col("_seen") + 1).otherwise(1)
    return now.join(before, "sku", "left").withColumn("observations", seen).withColumn(
        "ready", F.col("observations") >= max(1, needed)
    ).drop("_was", "_seen")


def stability_history(scans: DataFrame, key: str, seq: str, print_column: str, needed: int = 2, **blocks) -> DataFrame:
    """All scans at once: run length of equal fingerprints and readiness."""
    rows = previous_value(scans, [key], seq, print_column, "_was", **blocks)
    changed = ~F.col(print_column).eqNullSafe(F.col("_was"))
    rows = running_length(rows.withColumn("_changed", changed), [key], seq, "_changed", "observations", **blocks)
    return rows.withColumn("ready", F.col("observations") >= max(1, needed)).drop("_was", "_changed")


def _magnitude(digits: Column) -> Column:
    """Digit texts of any length, ordered as numbers."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.struct(F.length(plain).alias("n"), plain.alias("text"))


def new_numeric_skus(
    items: DataFrame, known: DataFrame, order: Sequence[str], high_water: int | None = None, width: int | None = None
) -> DataFrame:
    """Digit-only SKUs above the high-water mark that are not known yet.

    Output (sku, previous_high, new_high, width). SKUs are compared as digit
    texts of any length; a mark of more than 38 digits is reported as null, its
    SKUs are not lost. Without a given width the last numeric SKU in file order sets
    it; there is no row if no SKU is numeric then. If nothing is new, one row
    with a null SKU carries the marks.
    """
    digits = F.trim("sku").rlike(r"^\d+$")
    numeric = items.where(digits).select(F.trim("sku").alias("sku"), F.struct(*order).alias("at")).withColumn("width", F.length("sku"))
    old = known.where(digits).select(F.trim("sku").alias("sku")).withColumn("width", F.length("sku"))
    observed = F.max(_magnitude(F.col("sku"))).alias("observed")
    if width is None:  # one row per width, and there are few widths
        lengths = numeric.groupBy("width").agg(observed, F.max("at").alias("at")).orderBy(F.col("at").desc()).limit(1)
    else:
        lengths = numeric.where(F.col("width") == width).agg(observed).withColumn("width", F.lit(width))
    before = old.groupBy("width").agg(F.max(_magnitude(F.col("sku"))).alias("known_high"))
    mark = F.coalesce("known_high", _magnitude(F.lit("0"))) if high_water is None else _magnitude(F.lit(str(high_water)))
    marks = lengths.join(before, "width", "left").select("width", mark.alias("high"), F.greatest(mark, F.coalesce("observed", mark)).alias("top"))
    fresh = numeric.select("sku", "width").distinct().join(marks, "width").where(_magnitude(F.col("sku")) > F.col("high"))
    fresh = fresh.join(old.select("sku").distinct(), "sku", "left_anti").select("sku", "high", "top", "width")
    none = marks.join(fresh.select("width").distinct(), "width", "left_anti").select(F.lit(None).cast("string").alias("sku"), "high", "top", "width")
    number = lambda mark: F.col(f"{mark}.text").try_cast("decimal(38,0)")
    return fresh.unionByName(none).select("sku", number("high").alias("previous_high"), number("top").alias("new_high"), "width")


def sku_base_mapping(products: DataFrame, variants: DataFrame) -> DataFrame:
    """sku -> base: products map to themselves, variants to their product."""
    own = products.select(F.trim("sku").alias("sku"), F.trim("sku").alias("base"))
    children = variants.select(F.trim("sku").alias("sku"), F.trim("base").alias("base"))
    rows = own.unionByName(children).where("sku <> '' AND base <> ''")
    # a child of another product beats the product's own row, as later entries do
    return rows.groupBy("sku").agg(F.max_by("base", F.struct(F.col("base") != F.col("sku"), "base")).alias("base"))


def flatten_quantities(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Variant quantities where a product has variants, else its own."""
    parents = variants.select(F.trim("base").alias("sku")).distinct()
    children = variants.select(F.trim("sku").alias("sku"), F.coalesce("quantity", F.lit(0)).alias("quantity")).where("sku <> ''")
    scalars = products.select(F.trim("sku").alias("sku"), F.coalesce("quantity", F.lit(0)).alias("quantity")).where("sku <> ''")
    return children.unionByName(scalars.join(parents, "sku", "left_anti"))


def related_skus(variants: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(base, sku): the base, its variants and online SKUs that derive from it."""
    bases = variants.select(F.trim("base").alias("base")).where("base <> ''").distinct()
    own = bases.select("base", F.col("base").alias("sku"))
    children = variants.select(F.trim("base").alias("base"), F.trim("sku").alias("sku")).where("base <> '' AND sku <> ''")
    online = snapshot.select(base_sku(F.col("sku")).alias("base"), F.trim("sku").alias("sku")).where("sku <> ''")
    return own.unionByName(children).unionByName(online.join(bases, "base", "left_semi")).distinct()


def upload_order(products: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """Add ``priority``: 0 in stock (variant sum when there are variants), else 1."""
    stock = F.coalesce(F.col("quantity"), F.lit(0))
    if variants is not None:
        sums = variants.groupBy(F.trim("base").alias("sku")).agg(F.sum(F.coalesce("quantity", F.lit(0))).alias("_stock"))
        products = products.join(sums, "sku", "left")
        stock = F.coalesce(F.col("_stock"), stock)
    return products.withColumn("priority", F.when(stock > 0, 0).otherwise(1)).drop("_stock")


def affected_base_skus(events: DataFrame, changes: DataFrame, fresh: DataFrame, mapping: DataFrame) -> DataFrame:
    """Bases touched by appended events, mapped online changes or new SKUs."""
    from_events = events.select(base_sku(F.col("sku")).alias("base"))
    from_changes = (
        changes.select(F.trim("sku").alias("sku")).join(mapping, "sku", "left")
        .select(F.coalesce("base", base_sku(F.col("sku"))).alias("base"))
    )
    return from_events.union(from_changes).union(fresh.select(F.trim("sku").alias("base"))).where("base <> ''").distinct()


def matrix_children_only(mapping: DataFrame) -> DataFrame:
    """Mapping rows whose SKU is a matrix child of another base."""
    return mapping.where((F.col("sku") != F.col("base")) & is_matrix_child(F.col("sku")))
