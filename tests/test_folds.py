"""Running folds: block form against a plain sequential fold, hot keys included."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tillbridge.operators import ordering, queues, reconcile, storefront
from tillbridge.streaming import folds, inbox


def make_events(seed, n=600):
    rng = random.Random(seed)
    # one key holds a third of all rows
    return [
        (i, "hot" if rng.random() < 0.34 else f"k{rng.randrange(12)}", None if rng.random() < 0.12 else rng.randrange(80), rng.randrange(50))
        for i in range(n)
    ]


def sequential(events, state=None):
    stored = dict(state or {})
    for _, key, at, quantity in events:
        version, old, _ = stored.get(key, (0, None, None))
        if version == 0 or old is None or at is None or at >= old:
            stored[key] = (version + 1, at, quantity)
    return stored


SCHEMA = "seq bigint, key string, at bigint, quantity bigint"


@pytest.mark.parametrize("block_rows", [7, 64, 1000])
def test_inventory_fold_equals_sequential(spark, block_rows):
    events = make_events(block_rows)
    df = spark.createDataFrame(events, SCHEMA)
    got = queues.fold_inventory_events(df, ["key"], "seq", "at", ["quantity"], block_rows=block_rows)
    want = sorted(((k, v, at, q) for k, (v, at, q) in sequential(events).items()), key=str)
    assert rows(got, "key", "version", "at", "quantity") == want


def test_inventory_fold_carries_state(spark):
    events = make_events(5)
    early, late = events[:250], events[250:]
    first = queues.fold_inventory_events(spark.createDataFrame(early, SCHEMA), ["key"], "seq", "at", ["quantity"], block_rows=20)
    both = queues.fold_inventory_events(spark.createDataFrame(late, SCHEMA), ["key"], "seq", "at", ["quantity"], state=first, block_rows=20)
    want = sorted(((k, v, at, q) for k, (v, at, q) in sequential(events).items()), key=str)
    assert rows(both, "key", "version", "at", "quantity") == want


def test_late_event_is_ignored(spark):
    df = spark.createDataFrame([(1, "a", 10, 5), (2, "a", 20, 4), (3, "a", 15, 9)], SCHEMA)
    got = queues.fold_inventory_events(df, ["key"], "seq", "at", ["quantity"])
    assert rows(got, "version", "quantity") == [(2, 4)]


def test_numbering_and_previous_value(spark):
    events = make_events(9, 300)
    df = spark.createDataFrame(events, SCHEMA)
    numbered = ordering.number_within(df, ["key"], "seq", "n", block_rows=11)
    numbered = ordering.previous_value(numbered, ["key"], "seq", "quantity", "before", block_rows=13)
    want, count, last = [], {}, {}
    for seq, key, _, quantity in events:
        count[key] = count.get(key, 0) + 1
        want.append((seq, count[key], last.get(key)))
        last[key] = quantity
    assert rows(numbered, "seq", "n", "before") == sorted(want, key=str)


def test_stability_history(spark):
    rng = random.Random(3)
    scans = [(i, rng.choice("ab"), rng.choice("xy") if rng.random() < 0.5 else "x") for i in range(200)]
    df = spark.createDataFrame(scans, "scan bigint, sku string, print string")
    got = storefront.stability_history(df, "sku", "scan", "print", block_rows=6)
    want, state = [], {}
    for scan, sku, shown in scans:
        old, seen = state.get(sku, (None, 0))
        state[sku] = (shown, seen + 1 if old == shown else 1)
        want.append((scan, state[sku][1], state[sku][1] >= 2))
    assert rows(got, "scan", "observations", "ready") == sorted(want, key=str)


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = ordering.with_global_index(df, ["v"])
    assert got.where("v <> _index").count() == 0 and got.count() == 1000


def test_latest_observations(spark):
    changes = spark.createDataFrame(
        [(1, "a", 5, "i1", 10), (2, "a", 6, "i1", 9), (3, "a", 7, "i1", None), (4, "a", 8, "i1", 10), (5, "b", 1, "i2", 3), (6, "b", 2, "i3", 4), (7, "c", 3, "i4", 2)],
        "seq bigint, sku string, quantity bigint, inventory_item_id string, updated_at bigint",
    )
    state = spark.createDataFrame([("c", 5)], "sku string, seen_at bigint")
    blocked = spark.createDataFrame([], "sku string")
    got = reconcile.latest_observations(changes, state, blocked, block_rows=2)
    # undated rows apply without moving the time; b names two items; c is stale
    assert rows(got, "sku", "quantity", "applied") == [("a", 7, 2)]


def test_stream_fold_over_several_batches(spark, tmp_path):
    events = make_events(21, 240)
    for i in range(0, 240, 80):
        spark.createDataFrame(events[i:i + 80], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in/*"))
    landed = inbox.drain(folds.fold_inventory_stream(source), "test")
    got = rows(inbox.current_rows(landed, "key"), "key", "version", "at", "quantity")
    assert got == sorted(((k, v, at, q) for k, (v, at, q) in sequential(events).items()), key=str)
    assert landed.select("batch").distinct().count() == 3


def test_stages_stream_equals_fold(spark, tmp_path):
    rng = random.Random(8)
    kinds, shapes = ("scan", "payload", "result"), ("correct", "scalar", "blocked")
    statuses = ("repaired", "quantity_mismatch", "blocked", "failed")
    events = [
        (f"B{rng.randrange(4)}", i, rng.choice(kinds), rng.choice("xxy"), rng.choice(shapes), rng.choice(statuses), rng.random() < 0.5, f"2024-01-0{rng.randrange(1, 4)}")
        for i in range(120)
    ]
    schema = "base string, seq bigint, kind string, print string, shape string, status string, confirmed boolean, day string"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "ev"))
    landed = inbox.drain(folds.repair_stage_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))), "st", mode="append")
    from types import SimpleNamespace

    names = schema.replace(",", "").split()[::2]
    state, want = {}, []
    for event in events:
        row = SimpleNamespace(**dict(zip(names, event)))
        *kept, ready = folds.advance(*state.get(row.base, (None, None, 0, None)), row)
        state[row.base] = tuple(kept)
        want.append((row.seq, kept[0], kept[2], ready))
    assert rows(landed, "seq", "stage", "observations", "ready") == sorted(want, key=str)
