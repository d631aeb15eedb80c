"""Keyed state kept by Structured Streaming.

A micro-batch may deliver a key's rows in any order, so every processor sorts
the rows of its key by arrival number. That is bounded by the trigger's input
limit; full histories go through the batch operators, which split hot keys.
State is small and permanent: there is no watermark and no expiry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tillbridge.functions.keys import fingerprint

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InventoryFold(StatefulProcessor):
    """Versioned upsert; late events leave the stored row alone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "version bigint, at bigint, quantity bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, at, quantity = self.stored.get() if self.stored.exists() else (0, None, None)
        arrived = pd.concat(list(rows), ignore_index=True).sort_values("seq")
        before = version
        for time, value in zip(arrived["at"], arrived["quantity"]):
            time = None if pd.isna(time) else int(time)
            if at is None or time is None or time >= at:
                version, at, quantity = version + 1, time, int(value)
        if version != before:
            self.stored.update((version, at, quantity))
        yield pd.DataFrame({
            "key": [key[0]], "version": [version], "at": pd.array([at], dtype="Int64"), "quantity": [quantity],
        })

    def close(self) -> None:
        pass


def fold_inventory_stream(events: DataFrame) -> DataFrame:
    """Stream of (key string, seq, at in microseconds, quantity) to current rows."""
    use_rocksdb(events.sparkSession)
    return events.groupBy("key").transformWithStateInPandas(
        statefulProcessor=InventoryFold(), outputStructType="key string, version bigint, at bigint, quantity bigint",
        outputMode="Update", timeMode="None",
    )


def fold_order_stream(events: DataFrame, key: str, seq: str, *values: str) -> DataFrame:
    """Last arrival wins; a plain streaming aggregate keeps the state."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("version"), F.max_by(F.struct(*values), seq).alias("last")
    ).select(key, "version", "last.*")


class StableScan(StatefulProcessor):
    """Counts consecutive scans with one fingerprint."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "print string, observations bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, seen = self.stored.get() if self.stored.exists() else (None, 0)
        scans = pd.concat(list(rows), ignore_index=True).sort_values("scan")
        counts = []
        for now in scans["print"]:
            seen = seen + 1 if now == last else 1
            last = now
            counts.append(seen)
        self.stored.update((last, seen))
        yield pd.DataFrame({"sku": key[0], "scan": scans["scan"].to_numpy(), "print": scans["print"].to_numpy(), "observations": counts})

    def close(self) -> None:
        pass


def stable_payload_stream(scans: DataFrame, columns: list[str], needed: int = 2) -> DataFrame:
    """Scans (sku, scan, payload columns) with run length and readiness."""
    use_rocksdb(scans.sparkSession)
    printed = scans.select("sku", "scan", fingerprint(*[F.col(c) for c in columns]).alias("print"))
    counted = printed.groupBy("sku").transformWithStateInPandas(
        statefulProcessor=StableScan(), outputStructType="sku string, scan bigint, print string, observations bigint",
        outputMode="Append", timeMode="None",
    )
    return counted.withColumn("ready", F.col("observations") >= max(1, needed))


class RepairStage(StatefulProcessor):
    """Grid repair of one base: scans and storefront answers in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "stage string, print string, observations bigint, day string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stage, shown, seen, day = self.stored.get() if self.stored.exists() else (None, None, 0, None)
        out = []
        for row in pd.concat(list(rows), ignore_index=True).sort_values("seq").itertuples():
            stage, shown, seen, day, ready = advance(stage, shown, seen, day, row)
            out.append((key[0], row.seq, stage, seen, ready))
        if stage is None:
            self.stored.clear()
        else:
            self.stored.update((stage, shown, seen, day))
        yield pd.DataFrame(out, columns=["base", "seq", "stage", "observations", "ready"])

    def close(self) -> None:
        pass


def advance(stage, shown, seen, day, row):
    """Next (stage, fingerprint, observations, attempt day, ready) after one event.

    ``row.kind`` is scan (with ``shape``), payload (a stable-payload check) or
    result (with ``status``); ``row.confirmed`` says confirmed quantities equal
    the payload.
    """
    same = stage is not None and shown == row.print
    if row.kind == "scan":
        if row.shape == "correct":
            open_repair = same and stage in ("candidate", "verification") and not row.confirmed
            kept = open_repair or (same and stage == "server_blocked")
            return (stage, shown, seen, day, False) if kept else (None, None, 0, None, False)
        if row.shape == "scalar":
            if same and stage in ("candidate", "verification", "server_blocked"):
                return stage, shown, seen, day, False
            return "candidate", row.print, 1, None, False
        if same and stage in ("verification", "quantity_reconciliation"):
            return stage, shown, seen, day, False
        return "snapshot_blocked", row.print, seen if same else 1, None, False
    if stage is None:
        return None, None, 0, None, False
    if row.kind == "payload":
        if not same:
            return None, None, 0, None, False
        if stage == "server_blocked" and day != row.day:
            return stage, shown, seen + 1, day, True
        if stage == "candidate":
            return stage, shown, seen + 1, day, seen + 1 >= 2
        return stage, shown, seen, day, False
    status = row.status if row.status not in ("repaired", "already_correct") or row.confirmed else "failed"
    after = {"repaired": "verification", "already_correct": "verification", "quantity_mismatch": "quantity_reconciliation",
             "blocked": "server_blocked"}.get(status, "candidate")
    return after, shown, seen, row.day, False


def repair_stage_stream(events: DataFrame) -> DataFrame:
    """Events (base, seq, kind, print, shape, status, confirmed, day) to stages."""
    use_rocksdb(events.sparkSession)
    return events.groupBy("base").transformWithStateInPandas(
        statefulProcessor=RepairStage(),
        outputStructType="base string, seq bigint, stage string, observations bigint, ready boolean",
        outputMode="Append", timeMode="None",
    )
