"""Stages of grid repairs over a stored history, as a prefix scan over an automaton.

An event turns each of the six stages into one stage, whatever came before, once
two things are known that do not depend on the stage: whether its payload is
that of the last scan or payload check, and whether the last storefront answer
is of another day. So an event is a table of six stages, packed in one number, and
composing tables is associative. Each base is cut into blocks of arrivals; tables
are composed inside blocks, one table per block is composed over the base, and
every event reads its stage from the stage its block starts with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbridge.operators.ordering import BLOCK_ROWS, known_before, with_block
from tillbridge.session import materialize

STAGES = (None, "candidate", "verification", "quantity_reconciliation", "server_blocked", "snapshot_blocked")
NONE, CANDIDATE, VERIFICATION, RECONCILIATION, SERVER, SNAPSHOT = range(6)
BITS = 3
SAME = sum(s << BITS * s for s in range(6))  # the table that leaves every stage alone


def table(*stages: int) -> Column:
    """The packed table that turns stage k into the k-th of ``stages``."""
    return F.lit(sum(s << BITS * k for k, s in enumerate(stages)))


def always(stage: int) -> Column:
    return table(*[stage] * 6)


def transition(kind: Column, shape: Column, status: Column, confirmed: Column, same: Column) -> Column:
    """Packed table of one event; ``same`` says its payload is that of the last scan or check."""
    correct = F.when(~same, always(NONE)).when(confirmed, table(0, 0, 0, 0, SERVER, 0)).otherwise(table(0, CANDIDATE, VERIFICATION, 0, SERVER, 0))
    scalar = F.when(same, table(CANDIDATE, CANDIDATE, VERIFICATION, CANDIDATE, SERVER, CANDIDATE)).otherwise(always(CANDIDATE))
    other = F.when(same, table(SNAPSHOT, SNAPSHOT, VERIFICATION, RECONCILIATION, SNAPSHOT, SNAPSHOT)).otherwise(always(SNAPSHOT))
    scan = F.when(shape == "correct", correct).when(shape == "scalar", scalar).otherwise(other)
    answered = lambda stage: table(NONE, *[stage] * 5)
    answer = (
        F.when(status.isin("repaired", "already_correct") & confirmed, answered(VERIFICATION))
        .when(status == "quantity_mismatch", answered(RECONCILIATION)).when(status == "blocked", answered(SERVER)).otherwise(answered(CANDIDATE))
    )
    check = F.when(same, F.lit(SAME)).otherwise(always(NONE))
    return F.when(kind == "scan", scan).when(kind == "payload", check).otherwise(answer)


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Packed tables of ``first`` followed by ``then``."""
    out = np.zeros_like(first)
    for s in range(6):
        out |= (then >> BITS * (first >> BITS * s & 7) & 7) << BITS * s
    return out


def scan_tables(tables: np.ndarray, groups: np.ndarray, carried: int) -> np.ndarray:
    """Tables composed from the start of each group of consecutive rows; the first group starts with ``carried``."""
    upto = tables.copy()
    if len(upto):
        upto[0] = composed(np.array([carried]), upto[:1])[0]
    reach = 1
    while reach < len(upto):
        linked = np.flatnonzero(groups[reach:] == groups[:-reach])
        upto[linked + reach] = composed(upto[linked], upto[linked + reach])
        reach *= 2
    return upto


def compose_prefixes(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with ``before`` and ``upto``: their ``table`` composed over earlier rows of the keys, without and with the row.

    Streams each partition; what a batch leaves open is carried as one table.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("before", T.LongType()), T.StructField("upto", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, carried = None, SAME
        for batch in batches:
            if not len(batch):
                continue
            own = pd.MultiIndex.from_frame(batch[keys])
            start = np.concatenate([[True], own[1:] != own[:-1]])
            groups = np.cumsum(start)
            upto = scan_tables(batch["table"].to_numpy(np.int64), groups, carried if own[0] == open_key else SAME)
            before = np.where(start, SAME, np.concatenate([[SAME], upto[:-1]]))
            before[0] = carried if own[0] == open_key else SAME
            open_key, carried = own[-1], int(upto[-1])
            yield batch.assign(before=before, upto=upto)

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def _stage(packed: str, entry: str) -> Column:
    return F.expr(f"shiftright({packed}, {BITS} * {entry}) & 7").cast("int")


def repair_history(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stage, observations and readiness after every event.

    events (base, seq, kind, print, shape, status, confirmed, day), ``seq`` unique
    and rising in a base: kind is scan (with ``shape``), payload (a check of the
    payload) or result (with ``status``). Equals the fold of the same events one by one.
    """
    seen = F.col("kind").isin("scan", "payload")
    shown, answered = F.when(seen, F.struct("print")), F.when(F.col("kind") == "result", F.struct("day"))
    rows = known_before(events, ["base"], "seq", {"_shown": shown, "_answered": answered}, block_rows)
    same = F.coalesce(F.col("_shown.print").eqNullSafe(F.col("print")) & F.col("_shown").isNotNull(), F.lit(False))
    confirmed = F.coalesce(F.col("confirmed"), F.lit(False))
    later = ~F.col("_answered.day").eqNullSafe(F.col("day"))
    known = rows.select(
        "base", "seq", "kind", F.coalesce("shape", F.lit("")).alias("shape"), same.alias("same"), later.alias("later"),
        transition(F.col("kind"), F.coalesce("shape", F.lit("")), F.coalesce("status", F.lit("")), confirmed, same).cast("long").alias("table"),
    )
    scanned = materialize(compose_prefixes(with_block(known, "seq", block_rows), ["base", "_block"], "seq"), "tables")
    blocks = scanned.groupBy("base", "_block").agg(F.max_by("upto", "seq").alias("table"))
    starts = compose_prefixes(blocks, ["base"], "_block").select("base", "_block", F.expr("cast(before & 7 as int)").alias("_entry"))
    staged = scanned.join(starts, ["base", "_block"]).withColumn("was", _stage("before", "_entry")).withColumn("now", _stage("upto", "_entry"))

    # observations: a reset to 0 or 1, one more, or the same
    kind, was, same = F.col("kind"), F.col("was"), F.col("same")
    is_ = lambda *stages: was.isin(*stages)
    kept = same & F.when(F.col("shape") == "scalar", is_(CANDIDATE, VERIFICATION, SERVER)).otherwise(was != NONE)
    reset = F.when(F.col("now") == NONE, 0).when((kind == "scan") & (F.col("shape") != "correct") & ~kept, 1)
    more = (kind == "payload") & same & (is_(CANDIDATE) | (is_(SERVER) & F.col("later")))
    counted = running_count(staged.withColumn("_reset", reset).withColumn("_more", more.cast("long")), ["base"], "seq", "_reset", "_more", "observations")
    ready = more & (is_(SERVER) | (F.col("observations") >= 2))
    name = F.element_at(F.array(*[F.lit(s).cast("string") for s in STAGES]), F.col("now") + 1)
    return counted.select("base", "seq", name.alias("stage"), "observations", ready.alias("ready"))


def running_count(rows: DataFrame, keys: list[str], seq: str, reset: str, more: str, name: str) -> DataFrame:
    """Value of the last ``reset`` plus ``more`` of the rows after it; ``rows`` carry ``_block``, and start from 0."""
    inside = Window.partitionBy(*keys, "_block").orderBy(seq)
    local = rows.withColumn("_run", F.count(reset).over(inside))
    local = local.withColumn("_sum", F.sum(F.coalesce(F.col(reset), F.col(more)).cast("long")).over(Window.partitionBy(*keys, "_block", "_run").orderBy(seq)))
    tails = local.groupBy(*keys, "_block").agg(F.max("_run").alias("_runs"), F.max_by("_sum", seq).alias("_tail"))
    order = Window.partitionBy(*keys).orderBy("_block")
    tails = tails.withColumn("_part", F.sum(F.least("_runs", F.lit(1))).over(order))
    total = F.sum("_tail").over(Window.partitionBy(*keys, "_part").orderBy("_block"))
    carried = tails.withColumn("_total", total).select(*keys, "_block", F.coalesce(F.lag("_total").over(order), F.lit(0)).alias("_carry"))
    value = F.col("_sum") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(F.lit(0))
    return local.join(carried, [*keys, "_block"]).withColumn(name, value).drop("_run", "_sum", "_carry")
