"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. Each text becomes its set of five-word shingles (64-bit hashes), BANDS band
   keys of ROWS MinHash samples each, and an odd sketch: every sample flips one
   of BITS bits, so the differing samples of two texts show as set bits of the
   XOR. Texts with equal sets become one class at once.
2. In each bucket of a band every class is paired with the smallest one. Pairs
   whose sketches differ too much for the threshold are dropped, the rest are
   confirmed on the full sets, and the links are joined into components.
3. Buckets that still hold several components are settled: each class outside
   the bucket's largest component is compared with all others there, in blocks
   of OUTER x INNER rows by sketch, and those with a close one again on full
   sets. Pairs of one component need no comparison, and a block returns one
   link per class and component, so large groups of copies never become pairs.

A pair at the threshold shares no band with probability (1 - 0.75^ROWS)^BANDS,
about 2e-6; sketches are cut SIGMAS standard deviations beyond the threshold.

Defined results: null, empty and blank texts have no set, are linked with nothing
and stay; rows with one id are one document in ``component_id``; a null id is
never the smallest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.llm.common import bound_batches
from tillbridge.session import materialize

WIDTH = 5
BANDS, ROWS = 48, 5
BITS = 1024
PERCENT = 75
SIGMAS = 5.0
OUTER, INNER = 256, 2048
SLICE = 1024
COLUMNS = 4096
BLOCK = ["key", "o", "i"]
_rng = np.random.default_rng(20240501)
SAMPLES = BANDS * ROWS
FACTORS = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
SHIFTS = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
SALTS = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of WIDTH words; of all words if they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    if len(words) < WIDTH:
        return np.array([digest(hashes.tobytes(), 1)], np.uint64)
    runs = np.zeros(len(words) - WIDTH + 1, np.uint64)
    for k in range(WIDTH):
        runs = mix(runs + hashes[k:k + len(runs)])
    return np.unique(runs)


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketch of a set."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), SLICE):
        np.minimum(least, (FACTORS[:, None] * x[at:at + SLICE] + SHIFTS[:, None]).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    flips = np.bincount((mix(least + SALTS) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return keys.view(np.int64), np.packbits(flips.astype(np.uint8)).view(np.int64)


def flipped_limit() -> int:
    """Most bits by which the sketches of a pair at the threshold may differ."""
    share = 1 - PERCENT / 100
    differing = SAMPLES * share + SIGMAS * math.sqrt(SAMPLES * share * (1 - share))
    expected = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * differing))
    spread = math.sqrt(BITS / 4 * (1 - (1 - 4 / BITS) ** (2 * differing)))
    return int(min(BITS, expected + SIGMAS * spread / 2))


LIMIT = flipped_limit()
SIGNED = "doc_id long, text_key long, n_shingles long, set_high long, set_low long, bands array<long>, sketch array<long>"


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            found = shingles(text)
            if len(found):
                whole = xxhash.xxh3_128_intdigest(found.tobytes())
                rows.append((len(found), *np.array([whole >> 64, whole & (2**64 - 1)], np.uint64).view(np.int64), *signature(found)))
            else:
                rows.append((0, None, None, None, None))
        made = {n.split()[0]: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(SIGNED.split(", ")[2:])}
        yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], **made})


def alike(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if PERCENT * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected part of ``links`` (a, b).

    Each round every node hooks to its smallest smaller neighbour and moves four
    hooks on; links are renamed after their moved ends. A link to a hook that was
    not passed stays a link, so nothing has to be followed to its end, and the
    smallest node of a part never moves. A round stores its moves and its links.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low").distinct(), "edges")
    labels = edges.select(F.explode(F.array("high", "low")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        moves = edges.groupBy("high").agg(F.min("low").alias("low"))
        for _ in range(2):  # twice as many hooks each time
            further = moves.select(F.col("high").alias("low"), F.col("low").alias("_end"))
            moves = moves.join(further, "low", "left").select("high", F.coalesce("_end", "low").alias("low"))
        moves = materialize(moves, "moves")
        named = lambda node: moves.select(F.col("high").alias(node), F.col("low").alias(f"_{node}"))
        labels = labels.join(named("component"), "component", "left").select("node", F.coalesce("_component", "component").alias("component"))
        moved = edges.join(named("high"), "high", "left").join(named("low"), "low", "left")
        moved = moved.select(F.coalesce("_high", "high").alias("x"), F.coalesce("_low", "low").alias("y")).where("x <> y")
        edges = materialize(moved.select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct(), "edges")
    return labels


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.withColumnRenamed("component", "_c")
    return members.join(named, "node", "left").withColumn("component", F.coalesce("_c", "node")).drop("_c")


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of unsettled buckets, dealt into blocks: key, outer block, inner block, node, component, outer."""
    named = labelled(members.select("key", "node"), labels)
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    # the largest component of a bucket, ties to the smallest: one long orders both
    largest = sizes.groupBy("key").agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    main = sizes.join(largest, "key").where("n = most").groupBy("key").agg(F.min("component").alias("main"), F.first("rows").alias("rows"), F.first("most").alias("most"))
    inside = named.join(main, "key").withColumn("outer", F.col("component") != F.col("main"))
    outers = F.ceil((F.col("rows") - F.col("most")) / OUTER).cast("int")
    inners = F.ceil(F.col("rows") / INNER).cast("int")
    own_outer, own_inner = F.pmod(F.xxhash64("node"), outers).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), inners).cast("int")
    as_inner = inside.select("key", F.explode(F.sequence(F.lit(0), outers - 1)).alias("o"), own_inner.alias("i"), "node", "component", F.lit(False).alias("outer"))
    as_outer = inside.where("outer").select("key", own_outer.alias("o"), F.explode(F.sequence(F.lit(0), inners - 1)).alias("i"), "node", "component", F.lit(True).alias("outer"))
    return as_inner.unionByName(as_outer)


def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of a partition sorted by block, cut so that each holds whole blocks only."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = held[BLOCK].iloc[-1]
        end = int((held[BLOCK] != last).any(axis=1).to_numpy().nonzero()[0].max(initial=-1)) + 1
        if end:
            yield held.iloc[:end]
            held = held.iloc[end:]
    if held is not None and len(held):
        yield held


def sides(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the outer and the inner side of each block."""
    keys = batch[BLOCK].to_numpy(np.int64)
    starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
    outer = batch["outer"].to_numpy(bool)
    for begin, end in zip(starts[:-1], starts[1:]):
        side = outer[begin:end]
        x, y = begin + np.flatnonzero(side), begin + np.flatnonzero(~side)
        if len(x) and len(y):
            yield x, y


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a block that have a close one of another component on the other side, by sketch and size."""
    for batch in blocks_of(batches):
        sketch = np.stack(list(batch["sketch"])).astype(np.int64).view(np.uint64)
        size, component = batch["n_shingles"].to_numpy(np.int64), batch["component"].to_numpy(np.int64)
        keep = np.zeros(len(batch), bool)
        for xs, y in sides(batch):
            for x in xs:
                fits = y[(component[y] != component[x]) & (100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y]))]
                close = fits[np.bitwise_count(sketch[x] ^ sketch[fits]).sum(axis=1) <= LIMIT]
                keep[close] = True
                keep[x] = keep[x] or len(close) > 0
        yield batch.loc[keep, [*BLOCK, "node", "component", "outer"]]


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a block: per outer row one confirmed inner row of each other component."""
    for batch in blocks_of(batches):
        node, component = batch["node"].to_numpy(np.int64), batch["component"].to_numpy(np.int64)
        found = []
        for x, y in sides(batch):
            met = overlaps([np.frombuffer(batch["shingles"].iat[k], np.uint64) for k in x], [np.frombuffer(batch["shingles"].iat[k], np.uint64) for k in y])
            i, j = np.nonzero(met & (component[x][:, None] != component[y][None]))
            links = np.stack([node[x[i]], node[y[j]], component[y[j]]], axis=1)
            first = np.unique(links[:, [0, 2]], axis=0, return_index=True)[1]
            found.append(links[first, :2])
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which pairs of sets reach the threshold, from exact counts of common elements."""
    n, m = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    x_all, y_all = np.concatenate(xs), np.concatenate(ys)
    common = np.intersect1d(x_all, y_all)  # others add nothing to an intersection
    at_x, row_x = _placed(common, x_all, n)
    at_y, row_y = _placed(common, y_all, m)
    both = np.zeros((len(xs), len(ys)))
    for start in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - start)
        a, b = np.zeros((len(xs), width), np.float32), np.zeros((len(ys), width), np.float32)
        for out, at, row in ((a, at_x, row_x), (b, at_y, row_y)):
            pick = (at >= start) & (at < start + width)
            out[row[pick], at[pick] - start] = 1
        both += a @ b.T
    return 100 * both >= percent * (n[:, None] + m[None] - both)


def _placed(common: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column in ``common`` and row of those values that are common."""
    at = np.searchsorted(common, values)
    inside = at < len(common)
    inside[inside] = common[at[inside]] == values[inside]
    return at[inside], np.repeat(np.arange(len(sizes)), sizes)[inside]


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK)


def _grouped(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Signed rows with their numbers, and (set_high, set_low, component, component_id) of each class of equal sets."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = materialize(rows.mapInPandas(_sign, SIGNED).withColumn("row", F.monotonically_increasing_id()), "signatures")
    filled = signed.where("n_shingles > 0")
    classes = materialize(filled.groupBy("set_high", "set_low").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id")), "classes")
    entries = filled.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1").drop("n")
    members = materialize(entries.join(buckets, "key"), "members")
    involved = members.select("node").distinct()
    facts = materialize(filled.join(involved.withColumnRenamed("node", "row"), "row", "left_semi").select(F.col("row").alias("node"), "doc_id", "text_key", "n_shingles", "sketch"), "facts")
    sets = materialize(_sets(rows, facts), "sets")
    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = materialize(_confirm_pairs(_sift(stars, facts), sets), "links")
    labels = materialize(components(first), "labels")
    rest = materialize(unsettled(members, labels), "rest")
    near = _by_block(rest.join(facts.select("node", "n_shingles", "sketch"), "node")).mapInPandas(_near, "key long, o int, i int, node long, component long, outer boolean")
    near = materialize(near, "near")
    second = _by_block(near.join(sets, "node")).mapInPandas(_confirm, "a long, b long")
    final = components(first.unionByName(materialize(second, "links")))
    named = labelled(classes, final)
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    # one row per class; a class of many copies is the hot side, split by adaptive execution
    of_class = materialize(named.join(smallest, "component").select("set_high", "set_low", "component", "component_id"), "class-components")
    return signed, of_class


def group_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_shingles, component_id and kept."""
    signed, of_class = _grouped(docs, doc_id, text)
    linked = signed.where("n_shingles > 0").join(of_class, ["set_high", "set_low"]).select("doc_id", "text_key", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sets(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """(node, shingles) of the classes that share a bucket, made again from their texts."""
    wanted = facts.select("node", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    same = rows["doc_id"].eqNullSafe(wanted["_id"]) & (rows["text_key"] == wanted["_key"])
    texts = rows.join(wanted, same).groupBy("node").agg(F.first("text").alias("text"))  # copies of one row are combined first

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "shingles": [shingles(t).tobytes() for t in batch["text"]]})

    return texts.mapInPandas(make, "node long, shingles binary")


def _sift(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches allow the threshold."""
    side = lambda s: facts.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    fits = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return joined.where(fits & (differ <= LIMIT)).select("a", "b")


def _confirm_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [alike(a, b) for a, b in zip(batch["set_a"], batch["set_b"])]
            yield batch.loc[keep, ["a", "b"]]

    return both.select("a", "b", "set_a", "set_b").mapInPandas(exact, "a long, b long")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the near copies: of each component one row stays, with the smallest id (null last), then the first stored.

    Rows without a set all stay. Rows that repeat the id and text of the one that
    stays are reduced to one apart from the others; there are none in a table with unique ids.
    """
    signed, of_class = _grouped(docs, doc_id, text)
    filled = signed.where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "text_key")
    of_each = filled.groupBy("set_high", "set_low").agg(F.min(order).alias("first"))
    chosen = of_each.join(of_class, ["set_high", "set_low"]).groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key")
    copies = filled.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    marked = materialize(chosen.join(copies, same).select("_id", "_key", (F.col("n") > 1).alias("repeated")), "chosen")
    alone = signed.where("n_shingles = 0").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()

    def of(wanted: DataFrame) -> Column:
        return docs[doc_id].eqNullSafe(wanted["_id"]) & (F.xxhash64(docs[text]) == wanted["_key"])

    whole = marked.where("NOT repeated").select("_id", "_key").unionByName(alone)
    kept = docs.join(whole, of(whole), "left_semi")
    repeated = marked.where("repeated").select("_id", "_key")
    if repeated.isEmpty():
        return kept
    rows = docs.join(repeated, of(repeated)).select("_id", "_key", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    one = rows.groupBy("_id", "_key").agg(F.first("_row").alias("_row"))  # combined before the shuffle
    return kept.unionByName(one.select("_row.*"))
