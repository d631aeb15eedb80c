"""Arrival order at scale: first/last wins, numbering and running folds.

A key may hold a third of all rows, so nothing here sorts or collects one
whole key in one task. First/last wins are partial aggregates. Running values
cut each key into blocks of ``block_rows`` consecutive arrivals, fold every
block on its own, and then carry one summary row per block forward.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbridge.session import materialize

BLOCK_ROWS = 1_000_000


def order_key(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def spread(rows: DataFrame, *by: str, per_core: int = 4) -> DataFrame:
    """Rows dealt evenly over the cluster, by the hash of ``by`` or in turn.

    A small file is one scan task, whatever its rows become later: work per
    row, or a sort before an aggregate, would stay in that one task.
    """
    spark = rows.sparkSession
    return rows.repartition(max(per_core * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """One row per key: the values of the last arrival."""
    kept = F.max_by(F.struct(*values), order_key(order)).alias("_kept")
    return df.groupBy(*keys).agg(kept).select(*keys, "_kept.*")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """One row per key: the values of the first arrival."""
    kept = F.min_by(F.struct(*values), order_key(order)).alias("_kept")
    return df.groupBy(*keys).agg(kept).select(*keys, "_kept.*")


def with_block(df: DataFrame, seq: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Block of a unique integer arrival number: at most ``block_rows`` rows per key."""
    return df.withColumn("_block", F.floor(F.col(seq) / F.lit(block_rows)))


def with_global_index(df: DataFrame, order: Sequence[str], name: str = "_index", keep: Sequence[str | Column] = ("*",)) -> DataFrame:
    """0-based position in a total order, without a single-partition window; ``keep`` chooses what is stored of each row.

    Range partitions are sorted in place, stored once so that positions stay
    put, and shifted by the number of rows in earlier partitions (one row per
    partition, so that running sum is tiny).
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id()
    placed = materialize(
        ranged.select(
            *keep,
            part.alias("_part"),
            (F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)).alias("_pos"),
        ),
        "index",
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"))
    # one row per range partition: bounded by the partition count
    return (
        placed.join(F.broadcast(shifts), "_part")
        .withColumn(name, F.col("_shift") + F.col("_pos"))
        .drop("_part", "_pos", "_shift")
    )


def number_within(
    df: DataFrame, keys: Sequence[str], seq: str, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """1-based arrival number inside each key, for a unique integer ``seq``."""
    blocked = with_block(df, seq, block_rows)
    local = blocked.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(seq))
    )
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *keys, "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift")
    )
    return (
        local.join(shifts, [*keys, "_block"])
        .withColumn(name, F.col("_shift") + F.col("_local"))
        .drop("_block", "_local", "_shift")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Value of the previous arrival of the key (null for the first)."""
    blocked = with_block(df, seq, block_rows)
    inside = Window.partitionBy(*keys, "_block").orderBy(seq)
    local = blocked.select("*", F.lag(value).over(inside).alias("_lag"), F.row_number().over(inside).alias("_n"))
    tails = blocked.groupBy(*keys, "_block").agg(F.max_by(value, seq).alias("_tail"))
    carried = tails.select(
        *keys, "_block", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry")
    )
    return (
        local.join(carried, [*keys, "_block"])
        .withColumn(name, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_block", "_lag", "_n", "_carry")
    )


def known_before(df: DataFrame, keys: Sequence[str], seq: str, values: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row and name, the last value that is not null among earlier arrivals of the key (null if there is none)."""
    blocked = with_block(df.withColumns({f"_own{n}": c for n, c in values.items()}), seq, block_rows)
    earlier = Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumns({n: F.last(f"_own{n}", ignorenulls=True).over(earlier) for n in values})
    tails = blocked.groupBy(*keys, "_block").agg(*[F.max_by(f"_own{n}", F.when(F.col(f"_own{n}").isNotNull(), F.col(seq))).alias(f"_tail{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_block", *[F.last(f"_tail{n}", ignorenulls=True).over(before).alias(f"_carry{n}") for n in values])
    joined = local.join(carried, [*keys, "_block"])
    return joined.withColumns({n: F.coalesce(n, f"_carry{n}") for n in values}).drop("_block", *[f"{x}{n}" for n in values for x in ("_own", "_carry")])


def running_length(
    df: DataFrame, keys: Sequence[str], seq: str, changed: str, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Arrivals since the last row flagged ``changed`` (that row counts 1)."""
    blocked = with_block(df, seq, block_rows)
    inside = Window.partitionBy(*keys, "_block").orderBy(seq)
    local = (
        blocked.withColumn("_n", F.row_number().over(inside))
        .withColumn("_start", F.max(F.when(F.col(changed), F.col("_n"))).over(inside))
    )
    rows = F.count(F.lit(1))
    ends = local.groupBy(*keys, "_block").agg(rows.alias("_rows"), F.max("_start").alias("_last"))
    # rows after the last flag, and a running total that restarts where a flag was seen
    order = Window.partitionBy(*keys).orderBy("_block")
    ends = ends.withColumn("_group", F.count("_last").over(order)).withColumn(
        "_open", F.col("_rows") - F.coalesce(F.col("_last") - 1, F.lit(0))
    )
    total = F.sum("_open").over(Window.partitionBy(*keys, "_group").orderBy("_block"))
    ends = ends.withColumn("_total", total)
    carried = ends.select(*keys, "_block", F.coalesce(F.lag("_total").over(order), F.lit(0)).alias("_carry"))
    return (
        local.join(carried, [*keys, "_block"])
        .withColumn(
            name,
            F.when(F.col("_start").isNull(), F.col("_carry") + F.col("_n")).otherwise(
                F.col("_n") - F.col("_start") + 1
            ),
        )
        .drop("_block", "_n", "_start", "_carry")
    )


def stored_time_before(
    df: DataFrame, keys: Sequence[str], seq: str, time: str, name: str,
    resets_on_null: bool, block_rows: int = BLOCK_ROWS, opening: str | None = None,
) -> DataFrame:
    """Latest accepted ``time`` of the key just before each arrival.

    With ``resets_on_null`` an arrival without a time clears the comparison
    time; otherwise it leaves it alone. ``opening`` names a per-key column
    with the time stored before the first arrival.
    """
    blocked = with_block(df, seq, block_rows)
    inside = Window.partitionBy(*keys, "_block").orderBy(seq)
    cleared = F.col(time).isNull() if resets_on_null else F.lit(False)
    local = blocked.withColumn("_seg", F.sum(cleared.cast("int")).over(inside))
    strictly_before = (
        Window.partitionBy(*keys, "_block", "_seg").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = local.withColumn("_prev", F.max(time).over(strictly_before))
    tails = local.groupBy(*keys, "_block").agg(
        F.max_by(F.greatest(F.col("_prev"), F.col(time)), seq).alias("_tail"), F.max("_seg").alias("_clears")
    )
    order = Window.partitionBy(*keys).orderBy("_block")
    tails = tails.withColumn("_group", F.sum(F.least(F.col("_clears"), F.lit(1))).over(order))
    best = F.max("_tail").over(Window.partitionBy(*keys, "_group").orderBy("_block"))
    tails = tails.withColumn("_best", best)
    carried = tails.select(
        *keys, "_block",
        F.lag("_best").over(order).alias("_carry"),
        F.coalesce(F.lag("_group").over(order), F.lit(0)).alias("_cleared"),
    )
    joined = local.join(carried, [*keys, "_block"])
    start = F.col("_carry")
    if opening is not None:
        start = F.when(F.col("_cleared") == 0, F.greatest(F.col("_carry"), F.col(opening))).otherwise(start)
    return joined.withColumn(
        name, F.when(F.col("_seg") == 0, F.greatest(start, F.col("_prev"))).otherwise(F.col("_prev"))
    ).drop("_block", "_seg", "_prev", "_carry", "_cleared")
