"""Landing stream output in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbridge.session import scratch_path


def drain(stream: DataFrame, label: str, mode: str = "update") -> DataFrame:
    """Process what is available and return every emitted row with its batch.

    Each micro-batch owns one folder that a replay overwrites, so a restarted
    batch cannot leave rows twice.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").foreachBatch(land)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")


def current_rows(landed: DataFrame, *keys: str) -> DataFrame:
    """Newest emission per key."""
    columns = [c for c in landed.columns if c not in (*keys, "batch")]
    kept = F.max_by(F.struct(*columns), "batch").alias("_kept")
    return landed.groupBy(*keys).agg(kept).select(*keys, "_kept.*")
