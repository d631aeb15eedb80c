"""Audits, summaries, batch plans and flat exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.operators.catalog import FilterOptions, skip_reason
from tillbridge.operators.ordering import with_global_index

# Tables written by the core export.
CORE_TABLES = (
    "Item", "Itemmqty", "Vendor", "vendors", "price", "pricechg", "Customer", "CustShip", "Contacts",
    "invhdr", "invdtl", "minvhdr", "minvdtl", "ordhdr", "orddtl", "giftcert", "BrideDAT",
)


def write_payloads(payloads: DataFrame, path: str) -> None:
    """JSON lines, one file per task."""
    payloads.write.json(path)


def title_audit(products: DataFrame) -> DataFrame:
    """Raw against generated title with the size of each payload part."""
    blanks = ("vendor", "vendor_code", "product_type", "department", "size", "color", "desc2", "barcode")
    return products.select(
        "sku", "raw_desc", F.col("title").alias("generated_title"), *[F.coalesce(c, F.lit("")).alias(c) for c in blanks],
        "price", "compare_at_price", "cost", "quantity", F.size("tags").alias("tag_count"),
        F.size("metafields").alias("metafield_count"), "variant_count",
    )


def variant_samples(audit: DataFrame, variants: DataFrame) -> DataFrame:
    """Add the first variant barcode of each product to its audit row."""
    first = variants.groupBy(F.col("base").alias("sku")).agg(F.min_by("barcode", "pos_cell").alias("variant_barcode_sample"))
    return audit.join(first, "sku", "left").withColumn("variant_barcode_sample", F.coalesce("variant_barcode_sample", F.lit("")))


def matrix_variant_audit(variants: DataFrame, products: DataFrame) -> DataFrame:
    """One row per variant with its options as columns."""
    def option(name: str) -> Column:
        return F.coalesce(F.try_element_at("option_values", F.lit(name)), F.lit(""))

    titles = products.select(F.col("sku").alias("base"), F.col("title").alias("product_title"), "price", "cost")
    return variants.join(titles, "base").select(
        F.col("base").alias("base_sku"), "product_title", F.col("sku").alias("variant_sku"), "barcode",
        option("Size").alias("size"), option("Color").alias("color"), option("Length").alias("length"),
        option("Title").alias("option_title"), "pos_cell", "quantity", "price", "cost",
    )


def customer_audit(customers: DataFrame) -> DataFrame:
    texts = ("source", "pos_customer_number", "first_name", "last_name", "company", "email", "phone", "last_activity", "total_purchased")
    return customers.select(
        *[F.coalesce(c, F.lit("")).alias("cust_num" if c == "pos_customer_number" else c) for c in texts],
        F.size("addresses").alias("address_count"), F.size("tags").alias("tag_count"), F.size("metafields").alias("metafield_count"),
    )


def joined_lists(df: DataFrame, *columns: str) -> DataFrame:
    """Array columns as ``;``-joined text, ready for CSV."""
    return df.withColumns({c: F.concat_ws(";", c) for c in columns})


def run_summary(products: DataFrame, copies: str = "copies", options: FilterOptions = FilterOptions()) -> DataFrame:
    """(outcome, products) of a build: kept, and each reason to skip."""
    return products.groupBy(F.coalesce(skip_reason(options), F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("products"))


def source_summary(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Per source: rows seen and customers kept."""
    seen = rows.groupBy("source").agg(F.count(F.lit(1)).alias("rows_seen"), *[
        F.count_if(F.col("skip") == reason).alias(f"skipped_{reason}") for reason in ("deleted", "missing_identity")
    ])
    out = kept.groupBy("source").agg(F.count(F.lit(1)).alias("payloads"))
    return seen.join(out, "source", "left").withColumn("payloads", F.coalesce("payloads", F.lit(0)))


def plan_batches(
    df: DataFrame, order: Sequence[str], size: int, start_offset: int = 0, next_index: int = 0, max_batches: int | None = None
) -> DataFrame:
    """Number rows in order and cut consecutive batches after a checkpoint."""
    start = max(start_offset, next_index, 0)
    size = max(1, size)
    rows = with_global_index(df, order).where(F.col("_index") >= start)
    rows = rows.withColumn("batch", F.floor((F.col("_index") - start) / size).cast("bigint"))
    return rows.where(F.col("batch") < max_batches) if max_batches is not None else rows


def bulk_result_summary(results: DataFrame, *keys: str) -> DataFrame:
    """total / succeeded / failed per request."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed")
    )


def flat_export(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every column as text, nulls as blanks."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


# Columns of the exports.
FEED_COLUMNS = (
    "id", "source", "endpoint", "method", "sku", "title", "success", "message", "product_id", "variant_id", "received_at", "request_payload", "normalized_payload",
)
REQUEST_LOG_COLUMNS = (
    "id", "shop_domain", "api_key_preview", "method", "path", "query_string", "status_code", "route_path", "request_body", "user_agent", "source_ip", "duration_ms", "created_at",
)
MANIFEST_COLUMNS = ("table", "path", "category", "records", "record_length", "field_count", "sensitive_fields", "fields", "error")


def feed_report(events: DataFrame, limit: int = 1000) -> DataFrame:
    """The newest feed events, every column as text."""
    return flat_export(events.orderBy(F.desc("received_at"), F.desc("id")).limit(max(1, limit)), FEED_COLUMNS)


def request_log_report(logs: DataFrame, limit: int = 2000) -> DataFrame:
    """The newest requests, every column as text."""
    return flat_export(logs.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, limit)), REQUEST_LOG_COLUMNS)


def manifest_report(profile: DataFrame) -> DataFrame:
    """The profile of a table archive, lists joined."""
    return flat_export(joined_lists(profile, "fields", "sensitive_fields"), MANIFEST_COLUMNS)


def reconciliation_report(classes: DataFrame, products: DataFrame, variants: DataFrame) -> DataFrame:
    """product_id, title, status and joined SKUs of the products that a reconciliation wants archived.

    classes (product_id, status, class); products (product_id, title); variants
    (product_id, pos, sku), blank SKUs left out. A product's SKUs are one cell of the report.
    """
    candidates = classes.where(F.col("class") == "candidate").select("product_id", "status")
    sku = F.trim("sku")
    listed = variants.where(sku != "").join(candidates.select("product_id"), "product_id", "left_semi")
    skus = listed.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("pos", sku.alias("sku")))).alias("s"))
    rows = candidates.join(products, "product_id", "left").join(skus.select("product_id", F.transform("s", lambda x: x["sku"]).alias("skus")), "product_id", "left")
    return flat_export(joined_lists(rows, "skus"), ("product_id", "title", "status", "skus"))


def write_csv(df: DataFrame, path: str) -> None:
    """Header in each file; quotes are doubled, blanks kept."""
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def export_table(table: DataFrame, row_limit: int, order: Sequence[str] = ("_rec_no",)) -> DataFrame:
    """First rows of a core table in file order, with its ``truncated`` flag.

    One row more than the limit is looked at; the table is not counted.
    """
    limit = max(1, row_limit)
    first = table.orderBy(*order).limit(limit + 1)
    more = first.agg(F.count(F.lit(1)) > limit)
    return first.orderBy(*order).limit(limit).withColumn("truncated", more.scalar())


def export_core_tables(
    profile: DataFrame, read: Callable[[str], DataFrame], target: str, row_limit: int, tables: Sequence[str] = CORE_TABLES,
    order: Sequence[str] = ("_file", "_rec_no"),
) -> DataFrame:
    """Write the first rows of each core table as CSV under ``target`` and report on them.

    ``profile`` has one row per file (numbered files of one writer are one
    table), ``read`` gives a table's rows. The report
    has one row per table found: table, records, rows_written, truncated,
    sensitive_columns. The loop is over ``tables``, never over data.
    """
    spark, limit = profile.sparkSession, max(1, row_limit)
    stem = F.regexp_replace("table", "-[0-9]{5}-[0-9a-f]{8}$", "")
    wanted = profile.withColumn("table", stem).where(F.col("error").isNull() & F.lower("table").isin(*[t.lower() for t in tables]))
    found = wanted.groupBy("table").agg(
        F.sum("records").alias("records"),
        F.concat_ws(";", F.array_sort(F.array_distinct(F.flatten(F.collect_list("sensitive_fields"))))).alias("sensitive_columns"),
    )
    written = []
    for row in found.select("table").collect():
        name, path = row["table"], f"{target}/{row['table']}"
        rows = read(name).orderBy(*order).limit(limit)
        write_csv(flat_export(rows, [c for c in rows.columns if not c.startswith("_")]), path)
        back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        written.append(back.agg(F.count(F.lit(1)).alias("rows_written")).select(F.lit(name).alias("table"), "rows_written"))
    counts = reduce(DataFrame.unionByName, written, spark.createDataFrame([], "table string, rows_written bigint"))
    return found.join(counts, "table").select("table", "records", "rows_written", (F.col("records") > limit).alias("truncated"), "sensitive_columns")
