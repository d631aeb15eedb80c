"""Inventory of a folder of till tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbridge.session import materialize
from tillbridge.sources.dbf import DbfError, header_of

# Table names with a known category.
PRODUCT_TABLES = ("item", "mproduct", "itemmqty", "itemmrc", "prod_aux", "price", "pricechg")
SALES_TABLES = ("invhdr", "invdtl", "minvhdr", "minvdtl", "ordhdr", "orddtl")
# Field names that suggest personal or payment data.
SENSITIVE = (
    "card", "acct|account", "password|pass", "track2", "micr", "auth", "email|internet",
    "phone|cell|fax|pager", "address|addr|zip",
)

SCHEMA = (
    "path string, table string, records bigint, record_length int, field_count int, fields array<string>, error string"
)


def classify_table(name: Column, fields: Column, archive: bool = False) -> Column:
    """Category from table name and field names; the first rule that fits."""
    n = F.lower(name)
    upper = F.transform(fields, F.upper)

    def has(*names: str) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(x) for x in names]), upper)) == 0

    def named(*parts: str) -> Column:
        return n.rlike("|".join(parts))

    sales = n.startswith("inv") | n.startswith("ord")
    if archive:
        sales = sales | F.contains(n, F.lit("invoice_no"))
    return (
        F.when(n.isin(*PRODUCT_TABLES) | named("item", "prod") | has("SKU", "QTY", "PRICE"), "products_inventory")
        .when(named("cust", "contact") | has("CUST_NUM", "LAST_NAME"), "customers")
        .when(named("vend") | has("VENDOR_ID", "COMPANY"), "vendors")
        .when(n.isin(*SALES_TABLES) | sales, "sales_orders")
        .when(named("employee", "emptime", "closeout"), "operations")
        .when(named("bride", "gift", "rent"), "special_programs")
        .otherwise("system_other")
    )


def sensitive_columns(fields: Column) -> Column:
    return F.filter(fields, lambda f: f.rlike("(?i)" + "|".join(SENSITIVE)))


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            row = {"path": path, "table": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "records": 0,
                   "record_length": None, "field_count": 0, "fields": [], "error": None}
            try:
                header, _ = header_of(path)
                names = [f.name for f in header.fields]
                row |= {"records": header.records, "record_length": header.record_length,
                        "field_count": len(names), "fields": names}
            except (DbfError, OSError) as problem:
                row["error"] = str(problem)
            rows.append(row)
        schema = pa.schema([
            ("path", pa.string()), ("table", pa.string()), ("records", pa.int64()), ("record_length", pa.int32()),
            ("field_count", pa.int32()), ("fields", pa.list_(pa.string())), ("error", pa.string()),
        ])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def profile_tables(spark: SparkSession, folder: str, only: tuple[str, ...] = ()) -> DataFrame:
    """One row per DBF file: size, fields, category, sensitive fields, problems.

    Only paths are listed by Spark and only header bytes are read, so table
    sizes do not matter. ``only`` limits the profile to some table names.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.[dD][bB][fF]").load(folder).select("path")
    )
    rows = materialize(files.mapInArrow(_headers, SCHEMA), "profile")  # each header is opened once
    if only:
        rows = rows.where(F.lower("table").isin(*[t.lower() for t in only]))
    copies = rows.groupBy(F.lower("table").alias("_name")).agg(F.count(F.lit(1)).alias("_copies"))
    return (
        rows.join(copies, F.lower("table") == F.col("_name"))
        .withColumns({
            "ambiguous": F.col("_copies") > 1,
            "category": F.when(F.col("error").isNotNull(), "unreadable").otherwise(classify_table(F.col("table"), F.col("fields"))),
            "sensitive_fields": sensitive_columns(F.col("fields")),
        })
        .drop("_name", "_copies")
    )


def profile_order(profile: DataFrame) -> DataFrame:
    return profile.orderBy(F.col("records").desc(), F.col("field_count").desc(), "path")


def category_totals(profile: DataFrame) -> DataFrame:
    return profile.groupBy("category").agg(
        F.count(F.lit(1)).alias("tables"), F.sum("records").alias("records"),
        F.count_if(F.size("sensitive_fields") > 0).alias("sensitive_tables"),
    )
