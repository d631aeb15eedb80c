"""Ordered lines cut into parts of bounded size, exactly as a sequential writer would.

A line begins a part where the one before it cannot be held any more, so each line
has one next cut if a part began with it: the first line whose end in the byte
prefix sum lies beyond the limit. Which lines do begin parts depends on all
before them. Blocks of a few parts' bytes follow the next cuts inside themselves
for every line that an earlier block's last part can end at, and leave one
pointer per such line into the next block. Pointers are doubled and followed from
the first line, so the rounds grow with the logarithm of the blocks; then each
block knows where its first part begins and numbers its lines on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbridge.session import materialize

SPAN = 4  # parts' bytes in a block


def _placed(rows: DataFrame, order: Sequence[str], line: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows in order with ``_part``, ``_pos`` and bytes up to each inside its partition; rows and bytes before each partition."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("*", F.octet_length(F.coalesce(F.col(line), F.lit(""))).cast("bigint").alias("line_bytes"), F.spark_partition_id().alias("_part"))
    schema = T.StructType([*ranged.schema.fields, T.StructField("_pos", T.LongType()), T.StructField("_upto", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, 0
        for batch in batches:
            upto = pc.add(pc.cumulative_sum(batch.column("line_bytes")), total)
            yield batch.append_column("_pos", pa.array(np.arange(count, count + len(batch)))).append_column("_upto", upto)
            if len(batch):
                count, total = count + len(batch), upto[-1].as_py()

    stored = materialize(ranged.mapInArrow(run, schema), "lines")
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), F.max("_upto").alias("bytes"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    return stored, sizes.select("_part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_first"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_shift"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one block after another, from a partition sorted by block."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for block, part in batch.groupby("block", sort=True):
            if held and held[0]["block"].iat[0] != block:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def next_cuts(before: np.ndarray, upto: np.ndarray, room: int) -> np.ndarray:
    """Place of the first line that a part beginning at each line cannot hold; a part holds one line at least."""
    return np.maximum(np.searchsorted(upto, before + room, side="right"), np.arange(len(before)) + 1)


def _leave(room: int, size: int):
    """(src, dst) of each line of a block that an earlier part can end before: the first cut outside the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _blocks(batches):
            own = int(rows["own"].sum())  # lines lent by the next block follow
            if not own:
                continue
            index, upto = rows["index"].to_numpy(np.int64), rows["upto"].to_numpy(np.int64)
            before = upto - rows["line_bytes"].to_numpy(np.int64)
            to = next_cuts(before, upto, room)[:own]
            while (inside := to < own).any():
                to[inside] = to[to[inside]]
            targets = np.append(index, index[-1] + 1)[to]
            entry = before[:own] <= int(rows["block"].iat[0]) * size + room
            entry[0] = True
            yield pd.DataFrame({"src": index[:own][entry], "dst": targets[entry]})

    return run


def _number(room: int):
    """Lines of a block with the number of its own parts begun so far."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _blocks(batches):
            upto = rows["upto"].to_numpy(np.int64)
            to = next_cuts(upto - rows["line_bytes"].to_numpy(np.int64), upto, room)
            begins = np.zeros(len(rows), np.int64)
            first = np.flatnonzero(rows["begins"].to_numpy(bool))
            at = int(first[0]) if len(first) else len(rows)
            while at < len(rows):  # at most the parts of a block
                begins[at] = 1
                at = int(to[at])
            yield pd.DataFrame({"index": rows["index"], "block": rows["block"], "local": np.cumsum(begins)})

    return run


def reached(pointers: DataFrame, first: int = 0) -> DataFrame:
    """(index) of all lines on the chain of ``pointers`` (src, dst) from ``first``, by doubling."""
    found = pointers.sparkSession.createDataFrame([(first,)], "index long")
    while not pointers.isEmpty():
        step = pointers.select(F.col("src").alias("index"), "dst")
        found = materialize(found.unionByName(found.join(step, "index").select(F.col("dst").alias("index"))), "reached")
        further = pointers.select(F.col("src").alias("dst"), F.col("dst").alias("_next"))
        pointers = materialize(pointers.join(further, "dst").select("src", F.col("_next").alias("dst")), "pointers")
    return found.distinct()


def cut_parts(rows: DataFrame, order: Sequence[str], line: str, max_bytes: int, header_bytes: int = 0, span: int = SPAN) -> DataFrame:
    """``rows`` with ``line_bytes`` and ``part_number`` from 1: consecutive lines, a new part where header and lines would pass the limit.

    The limit is at least header + 1024 bytes; a longer line is a part of its own, a null line has no bytes.
    """
    room = max(max_bytes, header_bytes + 1024) - header_bytes
    size = span * room
    stored, shifts = _placed(rows, order, line)
    shifts = F.broadcast(shifts)  # one row per range partition
    slim = stored.select("_part", "_pos", "line_bytes", "_upto").join(shifts, "_part")
    slim = slim.select((F.col("_first") + F.col("_pos")).alias("index"), "line_bytes", (F.col("_shift") + F.col("_upto")).alias("upto"))
    slim = materialize(slim.withColumn("block", F.expr(f"(upto - line_bytes) div {size}")), "ends")
    lent = slim.where(F.expr(f"block > 0 AND (upto - line_bytes) % {size} <= {room}")).withColumn("block", F.col("block") - 1)
    both = slim.withColumn("own", F.lit(True)).unionByName(lent.withColumn("own", F.lit(False)))
    by_block = lambda df: df.repartition("block").sortWithinPartitions("block", "index")
    pointers = materialize(by_block(both).mapInPandas(_leave(room, size), "src long, dst long"), "pointers")
    begun = slim.join(reached(pointers).withColumn("begins", F.lit(True)), "index", "left").withColumn("begins", F.coalesce("begins", F.lit(False)))
    numbered = materialize(by_block(begun).mapInPandas(_number(room), "index long, block long, local long"), "numbered")
    counts = numbered.groupBy("block").agg(F.max("local").alias("parts"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block of several parts
    offsets = counts.select("block", F.coalesce(F.sum("parts").over(earlier), F.lit(0)).alias("_offset"))
    parts = numbered.join(offsets, "block").select("index", (F.col("_offset") + F.col("local")).alias("part_number"))
    placed = stored.join(shifts, "_part").withColumn("index", F.col("_first") + F.col("_pos"))
    return placed.join(parts, "index").select(*rows.columns, "line_bytes", "part_number")
