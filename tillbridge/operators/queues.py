"""Versioned change queues, retention, logs and status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbridge.functions.text import let
from tillbridge.operators.ordering import previous_value, stored_time_before

CHANNELS = ("inventory", "orders", "catalog")
ACTIVE_MINUTES = 8
TEXT_LIMIT = 4000
# Query parameters that are hidden, and those that are shortened.
SECRET_KEYS = ("consumer_secret", "oauth_signature", "x-api-secret")
SHORT_KEYS = ("consumer_key", "oauth_consumer_key")
# Request paths that are logged.
SYNC_ROUTES = ("/sync/", "/wc-api/", "/wp-json/wc/")


def fold_inventory_events(
    events: DataFrame, keys: Sequence[str], seq: str, time: str, values: Sequence[str],
    state: DataFrame | None = None, **blocks,
) -> DataFrame:
    """Versioned upsert of out-of-order events, one row per key.

    An event applies when it or the stored row has no time, or when it is not
    older. ``state`` holds earlier results (keys, version, ``time``, values)
    and is carried on.
    """
    opening = None
    rows = events
    if state is not None:
        opening = "_opening"
        rows = rows.join(state.select(*keys, F.col(time).alias(opening)), list(keys), "left")
    rows = stored_time_before(rows, keys, seq, time, "_before", resets_on_null=True, opening=opening, **blocks)
    applies = F.col(time).isNull() | F.col("_before").isNull() | (F.col(time) >= F.col("_before"))
    folded = rows.where(applies).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("version"), F.max_by(F.struct(time, *values), seq).alias("_last")
    ).select(*keys, "version", "_last.*")
    if state is None:
        return folded
    old = state.select(*keys, F.col("version").alias("_v"), *[F.col(c).alias(f"_{c}") for c in (time, *values)])
    merged = folded.join(old, list(keys), "full")
    seen = F.col("version").isNotNull()
    return merged.select(
        *keys, (F.coalesce("version", F.lit(0)) + F.coalesce("_v", F.lit(0))).alias("version"),
        *[F.when(seen, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in (time, *values)],
    )


def fold_order_events(events: DataFrame, keys: Sequence[str], seq: str, values: Sequence[str]) -> DataFrame:
    """Last arrival wins; the version counts arrivals."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("version"), F.max_by(F.struct(*values), seq).alias("_last")
    ).select(*keys, "version", "_last.*")


def acknowledge(queue: DataFrame, acks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Queue rows that stay: an ack of an older version removes nothing."""
    return queue.join(acks.select(*keys, "version").distinct(), [*keys, "version"], "left_anti")


def acknowledged(queue: DataFrame, acks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Queue rows an ack removes; count them for the reply."""
    return queue.join(acks.select(*keys, "version").distinct(), [*keys, "version"], "left_semi")


def pending_changes(queue: DataFrame, seq: str, limit: int, ceiling: int = 10_000) -> DataFrame:
    """Oldest queued changes; the page size is clamped."""
    return queue.orderBy(seq).limit(max(1, min(limit, ceiling)))


def upsert_items(events: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Latest SKU per item and last known quantity; SKU-only rows keep the quantity."""
    known = F.col("quantity").isNotNull()
    return events.groupBy(*keys).agg(
        F.max_by("sku", seq).alias("sku"), F.max_by("quantity", F.when(known, F.col(seq))).alias("last_quantity")
    )


def restored_items(events: DataFrame, keys: Sequence[str], seq: str, **blocks) -> DataFrame:
    """Events that lift an item's stock from nothing or unknown to above zero."""
    rows = previous_value(events, keys, seq, "quantity", "previous_quantity", **blocks)
    return rows.where((F.col("quantity") > 0) & (F.coalesce("previous_quantity", F.lit(0)) <= 0))


def retain_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Newest ``n`` rows per group; the limit is applied before the shuffle too."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def retain_global(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def recent_orders(summaries: DataFrame, queue: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, most: int = 50) -> DataFrame:
    """Newest order summaries and whether each is still queued."""
    waiting = queue.select(*keys).distinct().withColumn("_queued", F.lit(True))
    newest = retain_global(summaries, order, max(1, min(n, most)))
    status = F.when(F.col("_queued"), "queued").otherwise("sent_to_pos")
    return newest.join(waiting, list(keys), "left").withColumn("delivery_status", status).drop("_queued")


def recent_prices(changes: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, kept: int = 50) -> DataFrame:
    """Newest ``n`` of the ``kept`` price changes each shop stores."""
    return retain_global(retain_per_group(changes, keys, order, kept), order, max(1, min(n, kept)))


def heartbeats(polls: DataFrame, shop: str, now: Column, active_minutes: int = ACTIVE_MINUTES) -> DataFrame:
    """Per shop: last poll of each channel and whether polls are recent."""
    def last(channel: str) -> Column:
        return F.max(F.when(F.col("channel") == channel, F.col("at")))

    rows = polls.groupBy(shop).agg(F.max("at").alias("last_seen"), *[last(c).alias(f"last_{c}") for c in CHANNELS])
    since = now - F.make_dt_interval(mins=F.lit(active_minutes))
    return rows.withColumns({
        "active": F.col("last_seen") >= since,
        "orders_active": F.coalesce(F.col("last_orders") >= since, F.lit(False)),
    })


def bridge_status(beats: DataFrame, shop: str, inventory: DataFrame, orders: DataFrame, summaries: DataFrame, prices: DataFrame) -> DataFrame:
    """Heartbeats with the size of each queue and history per shop."""
    rows = beats
    for name, df in (("queued_changes", inventory), ("queued_orders", orders), ("recent_orders", summaries), ("recent_prices", prices)):
        rows = rows.join(df.groupBy(shop).agg(F.count(F.lit(1)).alias(name)), shop, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def feed_events(results: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """Log row of each sync result; payload texts are cut at ``limit`` characters."""
    return results.withColumns({
        "method": F.upper("method"),
        "success": F.when(F.col("success"), 1).otherwise(0),
        "request_payload": F.substring(F.coalesce("request_payload", F.lit("")), 1, limit),
        "normalized_payload": F.nullif(F.substring("normalized_payload", 1, limit), F.lit("")),
    })


def list_log(df: DataFrame, shop_column: str, order: Sequence[str], limit: int, ceiling: int, shop: str | None = None) -> DataFrame:
    """Newest log rows of a shop (rows without a shop included), clamped."""
    if shop is not None:
        df = df.where((F.col(shop_column) == shop) | F.col(shop_column).isNull())
    return retain_global(df, order, max(1, min(limit, ceiling)))


def mask_api_key(value: Column) -> Column:
    def shorten(text: Column) -> Column:
        short = F.concat(F.substring(text, 1, 8), F.lit("..."), F.substring(text, -4, 4))
        return F.when(F.length(text) <= 10, text).otherwise(short)

    return let(F.nullif(F.trim(value), F.lit("")), shorten)


def _form_encode(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _masked_pair(v: Column) -> Column:
    name = F.lower(v["key"])
    shown = (
        F.when(name.isin(*SECRET_KEYS), "***")
        .when(name.isin(*SHORT_KEYS), F.coalesce(mask_api_key(v["value"]), F.lit("")))
        .otherwise(v["value"])
    )
    return F.concat(_form_encode(v["key"]), F.lit("="), _form_encode(shown))


def mask_query(query: Column) -> Column:
    """Hide secrets and shorten keys in a query string."""
    def masked(pair: Column) -> Column:
        raw = F.substring_index(pair, "=", 1)
        rest = F.substring(pair, F.length(raw) + 2, F.length(pair))
        return let(F.struct(_decoded(raw).alias("key"), _decoded(rest).alias("value")), _masked_pair)

    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.when(F.coalesce(query, F.lit("")) != "", F.array_join(F.transform(pairs, masked), "&"))


def truncate_text(value: Column, limit: int = TEXT_LIMIT) -> Column:
    cut = F.concat(F.substring(value, 1, limit), F.lit("... [truncated]"))
    return F.when(value != "", F.when(F.length(value) <= limit, value).otherwise(cut))


def canonical_path(path: Column) -> Column:
    """Drop blank segments from sync routes; leave other paths alone."""
    trimmed = F.trim(path)
    segments = F.filter(F.transform(F.split(trimmed, "/"), lambda x: F.trim(x)), lambda s: s != "")
    return F.when(is_sync_route(trimmed), F.concat(F.lit("/"), F.array_join(segments, "/"))).otherwise(path)


def is_sync_route(path: Column) -> Column:
    hit = path.startswith(SYNC_ROUTES[0])
    for prefix in SYNC_ROUTES[1:]:
        hit = hit | path.startswith(prefix)
    return hit


def mask_request_logs(logs: DataFrame) -> DataFrame:
    """Loggable requests with masked queries, short keys and cut bodies."""
    path = canonical_path(F.col("path"))
    return logs.where(is_sync_route(F.col("path")) | is_sync_route(path)).withColumns({
        "path": path, "query_string": mask_query(F.col("query_string")),
        "api_key": mask_api_key(F.col("api_key")), "request_body": truncate_text(F.col("request_body")),
    })


def purge_tenant(shops: DataFrame, shop: str, key: str, now: Column, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """Mark a shop uninstalled and drop its rows from every table."""
    left = F.when(F.col(key) == shop, now).otherwise(F.col("uninstalled_at"))
    return shops.withColumn("uninstalled_at", left), *[t.where(~F.col(key).eqNullSafe(F.lit(shop))) for t in tables]
