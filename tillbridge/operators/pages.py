"""Pages of a stored order: any page costs what its rows cost.

An order is stored once, one folder per range of it, with the number of rows
before each range. A page opens only the ranges that hold its rows, so page
10,000 is as cheap as page 1, where an offset sorts all rows up to its end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbridge.session import scratch_path


def store_pages(rows: DataFrame, order: Sequence[str], folder: str | None = None) -> str:
    """Stores ``rows`` in ``order``, which should be total, and returns the folder."""
    folder = folder or scratch_path(rows.sparkSession, "pages")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    place = F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)
    ranged.select("*", part.alias("_part"), place.alias("_place")).write.partitionBy("_part").parquet(f"{folder}/rows")
    stored = rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("_place", T.LongType()), T.StructField("_part", T.IntegerType())])).parquet(f"{folder}/rows")
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes.select("_part", "_rows", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_first")).coalesce(1).write.parquet(f"{folder}/ranges")
    return folder


def read_page(spark: SparkSession, folder: str, page: int = 1, per_page: int = 50, most: int = 250) -> DataFrame:
    """Rows of one page, 1 to ``most`` of them, in order."""
    size = max(1, min(per_page, most))
    start = (max(1, page) - 1) * size
    ranges = spark.read.parquet(f"{folder}/ranges")
    held = ranges.where((F.col("_first") < start + size) & (F.col("_first") + F.col("_rows") > start))
    parts = [r["_part"] for r in held.select("_part").collect()]  # the ranges of one page
    if parts:
        rows = spark.read.option("basePath", f"{folder}/rows").parquet(*[f"{folder}/rows/_part={k}" for k in parts])
    else:
        rows = spark.read.parquet(f"{folder}/rows").where("false")
    placed = rows.join(F.broadcast(held.select("_part", "_first")), "_part").withColumn("_at", F.col("_first") + F.col("_place"))
    return placed.where((F.col("_at") >= start) & (F.col("_at") < start + size)).orderBy("_at").drop("_at", "_first", "_place", "_part")
