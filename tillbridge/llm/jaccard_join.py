"""N-gram Jaccard join, size-aware: fixed-size subsets for small sets, inverted lists for large ones.

1. Each text becomes its set of hashed shingles. Equal sets are one class, and only
   classes are compared.
2. The elements of a set are ordered: those outside a table of frequent elements
   first, by hash, then the frequent ones by count. The table sums summaries of
   bounded size that each task makes of all its elements. Any order gives the same
   links; this one keeps common passages out of the prefixes.
3. Two sets with the required overlap share at least l elements of their prefixes
   of n - ceil(t n) + l elements, and the first l shared ones are in both. So sets
   up to a boundary size enumerate all SUBSET-element subsets of their prefixes and
   meet in the buckets of equal subsets. Each larger set scans the inverted lists
   of its one-element prefix, which hold all sets of a size it can be linked with.
   The boundary is where the sum of both costs, of keys enumerated and of list
   entries read, each counted over all sets by size, is least.
4. Every class is paired with the smallest one of a bucket: of those that sizes and
   parity sketches allow, the one with which it shares most keys. Pairs are confirmed
   on the full sets, made again from their texts, and links joined into components.
5. Buckets with several components that have more than ``SPLIT_ROWS`` members are
   split: the members meet again under one more element, up to ``DEPTH`` elements. In
   the others, members of different components are compared where their sizes and
   the places of the key's last element leave room for the required overlap, then
   by sketch, then on the full sets. Buckets that stay large are compared in blocks:
   all classes outside the bucket's largest component with all others.

The sketch is lossless: a bit is the parity of the elements that fall on it, so two
sketches differ in at most as many bits as the sets have elements not shared. Larger
sets have longer sketches, which fold to shorter ones.

Defined results: null, empty and blank texts have no set and are linked with
nothing; rows with one id are one document in ``component_id``; a null id is
never the smallest; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.llm.common import bound_batches
from tillbridge.llm.dedup import BLOCK, blocks_of, components, labelled, mix, overlaps, sides, unsettled
from tillbridge.session import materialize

WIDTH = 3
PERCENT = 90
SUBSET = 2
DEPTH = 4
FREQUENT = 1 << 19
BITS, SPARSE = 1024, 2000  # bits of the sketch of sets up to so many elements; four times both, and so on, for larger ones
KEY_COST, ENTRY_COST = 10.0, 1.0  # a key is made, shuffled and counted; a list entry read is one step of a join
BINS_PER_OCTAVE = 4
SPLIT_ROWS = 1024
SIGNED = "unnamed boolean, doc_id long, text_key long, n_shingles long, set_high long, set_low long, elements array<long>, counts array<long>"
CHOSEN = "set_high long, set_low long, n_shingles long, prefix array<long>, sketch array<long>"


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of all words if they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    if len(words) < width:
        return np.array([digest(hashes.tobytes(), 1)], np.uint64)
    runs = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        runs = mix(runs + hashes[k:k + len(runs)])
    return np.unique(runs)


def digest(found: np.ndarray) -> tuple[int, int]:
    """Two numbers that stand for a whole set."""
    whole = xxhash.xxh3_128_intdigest(found.tobytes())
    high, low = np.array([whole >> 64, whole & (2**64 - 1)], np.uint64).view(np.int64)
    return int(high), int(low)


class Frequent:
    """Counts of the most frequent elements, low by at most all elements / FREQUENT."""

    def __init__(self):
        self.elements, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, sets: list[np.ndarray]) -> None:
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        both, at = np.unique(np.concatenate([self.elements, found]), return_inverse=True)
        total = np.bincount(at, np.concatenate([self.counts, n])).astype(np.int64)
        if len(both) > FREQUENT:
            total -= np.partition(total, -FREQUENT - 1)[-FREQUENT - 1]
        self.elements, self.counts = both[total > 0], total[total > 0]


def _sign(width: int):
    """Size and digest of each set, and at the end of a task one row with its frequent elements."""
    names = [f.split()[0] for f in SIGNED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = Frequent()
        for batch in batches:
            if not len(batch):
                continue
            sets = [shingles(t, width) for t in batch["text"]]
            frequent.add(sets)
            halves = np.array([digest(x) for x in sets])
            signed = batch[["unnamed", "doc_id", "text_key"]].assign(n_shingles=[len(x) for x in sets], set_high=halves[:, 0], set_low=halves[:, 1])
            yield signed.assign(elements=pd.Series([None] * len(batch), dtype=object, index=batch.index), counts=pd.Series([None] * len(batch), dtype=object, index=batch.index))
        often = frequent.counts > 1
        yield pd.DataFrame([(True, 0, 0, -1, 0, 0, frequent.elements[often].view(np.int64), frequent.counts[often])], columns=names)

    return run


def frequent_elements(signed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most FREQUENT elements with their summed counts, sorted by element."""
    rows = signed.where("n_shingles < 0").select(F.explode(F.arrays_zip("elements", "counts")).alias("x"))
    summed = rows.groupBy("x.elements").agg(F.sum("x.counts").alias("n"))
    found = summed.orderBy(F.desc("n"), "elements").limit(FREQUENT).toPandas()
    element = found["elements"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(element)
    return element[order], found["n"].to_numpy(np.int64)[order]


def spare(n: int, percent: int) -> int:
    """Elements that a set of n may have beyond those it shares."""
    return n - -(-percent * n // 100)


def sketch_bits(n: int) -> int:
    bits = BITS
    while n > SPARSE * bits // BITS:
        bits *= 4
    return bits


def _choose(shared, width: int, percent: int):
    """Prefix in the global order, and parity sketch, of each set that can have a different partner."""
    names = [f.split()[0] for f in CHOSEN.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        element, count = shared.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingles(text, width)
                if not len(found) or 100 * len(found) < percent * (len(found) + 1):
                    continue
                known = np.zeros(len(found), np.int64)
                if len(element):
                    at = np.minimum(np.searchsorted(element, found), len(element) - 1)
                    known = np.where(element[at] == found, count[at], 0)
                order = np.argsort(known, kind="stable")  # the set is sorted by hash
                bits = sketch_bits(len(found))
                parity = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
                rows.append((*digest(found), len(found), found[order[:spare(len(found), percent) + DEPTH]].view(np.int64), np.packbits(parity.astype(np.uint8)).view(np.int64)))
            yield pd.DataFrame(rows, columns=names)

    return run


def shared_at_least(percent: int) -> Column:
    """Elements that a set of n_shingles must share with any set it is linked with."""
    return F.ceil(percent * F.col("n_shingles") / 100)


def _prefix_of(size: int | Column, percent: int) -> Column:
    """The part of the order that holds the first ``size`` elements shared with any set."""
    return F.slice("prefix", F.lit(1), (F.col("n_shingles") - shared_at_least(percent) + size).cast("int"))


def cost_bin(n: Column) -> Column:
    return F.floor(F.log2(n) * BINS_PER_OCTAVE).cast("int")


def choose_boundary(small: dict[int, float], large: dict[int, float]) -> int:
    """The last size bin whose sets enumerate subsets (-1: none), given both costs of each bin."""
    bins = sorted({*small, *large})
    best, at = sum(large.values()), -1
    total = best
    for b in bins:
        total += small.get(b, 0.0) - large.get(b, 0.0)
        if total < best:
            best, at = total, b
    return at


def buckets(chosen: DataFrame, percent: int, boundary: int | None) -> tuple[DataFrame, int]:
    """(key, node, level, last, n_shingles): sets that meet under a subset or in an inverted list, with the elements in the key and the place of its last; and the boundary bin.

    ``boundary`` names the last bin of small sets; by default it is chosen by cost.
    """
    sized = chosen.withColumn("bin", cost_bin(F.col("n_shingles"))).withColumn("subsets", shared_at_least(percent) >= SUBSET)
    entries = chosen.select("node", F.posexplode(_prefix_of(1, percent)).alias("last", "element"))
    lists = entries.groupBy("element").agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")
    entries = materialize(entries.join(lists, "element").join(sized.select("node", "n_shingles", "bin", "subsets"), "node"), "lists")
    if boundary is None:
        # one row per bin; sets without a second one in any list cost nothing to scan
        width = F.size(_prefix_of(SUBSET, percent))
        keys = width * (width - 1) / 2
        small = {r["bin"]: r["cost"] for r in sized.where("subsets").groupBy("bin").agg((KEY_COST * F.sum(keys)).alias("cost")).collect()}
        large = {r["bin"]: r["cost"] for r in entries.groupBy("bin").agg((ENTRY_COST * F.sum("entries")).alias("cost")).collect()}
        boundary = choose_boundary(small, large)
    light = (F.col("bin") <= boundary) & F.col("subsets")
    pairs = sized.where(light).select("node", _prefix_of(SUBSET, percent).alias("part"))
    pairs = pairs.select("node", "part", F.posexplode("part").alias("i", "x")).select("node", "x", "i", F.posexplode(F.slice("part", F.col("i") + 2, F.size("part"))).alias("j", "y"))
    pairs = pairs.select(F.xxhash64(F.lit(2), "x", "y").alias("key"), "node", F.lit(2).alias("level"), (F.col("i") + F.col("j") + 1).alias("last"))
    scanned = ~light
    # a list holds the sets that a scanning one can be linked with: it matters only where one scans
    reach = entries.where(scanned).groupBy("element").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    fits = (100 * F.col("n_shingles") >= percent * F.col("least")) & (percent * F.col("n_shingles") <= 100 * F.col("most"))
    listed = entries.join(reach, "element").where(fits).select(F.xxhash64(F.lit(1), "element").alias("key"), "node", F.lit(1).alias("level"), "last")
    sizes = chosen.select("node", "n_shingles")
    return listed.unionByName(pairs).join(sizes, "node"), boundary


def _shared_keys(entries: DataFrame) -> DataFrame:
    """Entries of keys that several sets have, with the smallest of them."""
    many = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1").drop("n")
    return entries.join(many, "key")


def folded(sketch: str, size: Column) -> Column:
    """A sketch, or the exclusive-or of its quarters where it is longer than ``size``."""
    quarter = [F.slice(sketch, size * k + 1, size) for k in range(4)]
    xor = lambda x, y: F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))
    return F.when(F.size(sketch) == size, F.col(sketch)).otherwise(xor(xor(quarter[0], quarter[1]), xor(quarter[2], quarter[3])))


def _sift(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and sketches allow the threshold."""
    side = lambda s: facts.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    least = F.least(F.size("sketch_a"), F.size("sketch_b"))  # sizes that fit are one step apart at most
    joined = joined.withColumn("sketch_a", folded("sketch_a", least)).withColumn("sketch_b", folded("sketch_b", least))
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return joined.where(fits).where(((100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b")))).select(*pairs.columns)


def _confirm_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, x = None, np.zeros(0, np.uint64)  # pairs come sorted by their first side
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(batch["a"], batch["text_a"], batch["text_b"]):
                if a != last:
                    last, x = a, shingles(text_a, width)
                y = shingles(text_b, width)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.loc[keep, ["a", "b"]]

    return both.select("a", "b", "text_a", "text_b").mapInPandas(exact, "a long, b long")


def _confirmed(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], width: int, percent: int) -> DataFrame:
    """Links among sifted ``pairs``, from the texts of their classes only."""
    pairs = materialize(pairs.select("a", "b"), "pairs")
    texts = materialize(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "texts")
    return materialize(_confirm_pairs(pairs, texts, width, percent), "links")


def _stars(members: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with one of the smallest of their buckets, as sizes and sketches allow."""
    pairs = members.where("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("keys"))
    return _sift(pairs, facts, percent).groupBy("b").agg(F.max_by("a", F.struct("keys", -F.col("a"))).alias("a"))


def _inside(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in buckets of bounded size, where the rest of both orders can hold the overlap."""
    side = lambda s: members.select("key", "level", *[F.col(c).alias(f"{s}{n}") for c, n in (("node", ""), ("component", "_part"), ("n_shingles", "_n"), ("last", "_last"))])
    fits = 100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")
    room = F.col("level") + F.least(F.col("a_n") - F.col("a_last"), F.col("b_n") - F.col("b_last")) - 1
    met = side("a").join(side("b"), ["key", "level"]).where((F.col("a") < F.col("b")) & (F.col("a_part") != F.col("b_part")) & fits)
    return met.where((100 + percent) * room >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b").distinct()


def _near(percent: int):
    """Rows of a block that sizes and sketches allow a link with one of another component on the other side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in blocks_of(batches):
            sketch = np.stack([np.bitwise_xor.reduce(np.asarray(x, np.int64).reshape(-1, BITS // 64), axis=0) for x in batch["sketch"]]).view(np.uint64)
            size, component = batch["n_shingles"].to_numpy(np.int64), batch["component"].to_numpy(np.int64)
            keep = np.zeros(len(batch), bool)
            for xs, y in sides(batch):
                for x in xs:
                    fits = y[(component[y] != component[x]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))]
                    differ = np.bitwise_count(sketch[x] ^ sketch[fits]).sum(axis=1, dtype=np.int64)
                    close = fits[(100 + percent) * differ <= (100 - percent) * (size[x] + size[fits])]
                    keep[close] = True
                    keep[x] = keep[x] or len(close) > 0
            yield batch.loc[keep, [*BLOCK, "node", "component", "outer"]]

    return run


def _confirm(width: int, percent: int):
    """Links of a block: per outer row one confirmed inner row of each other component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in blocks_of(batches):
            node, component = batch["node"].to_numpy(np.int64), batch["component"].to_numpy(np.int64)
            found = [np.zeros((0, 2), np.int64)]
            for x, y in sides(batch):
                met = overlaps([shingles(batch["text"].iat[k], width) for k in x], [shingles(batch["text"].iat[k], width) for k in y], percent)
                i, j = np.nonzero(met & (component[x][:, None] != component[y][None]))
                links = np.stack([node[x[i]], node[y[j]], component[y[j]]], axis=1)
                found.append(links[np.unique(links[:, [0, 2]], axis=0, return_index=True)[1], :2])
            pairs = np.concatenate(found)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def deeper(members: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Members under one more shared element, from the places after the last."""
    level = F.col("level") + 1
    rows = members.join(facts.select("node", "prefix"), "node").withColumn("part", _prefix_of(level, percent))
    after = rows.select("key", "node", "n_shingles", "level", "last", F.posexplode(F.slice("part", F.col("last") + 2, F.size("part"))).alias("j", "x"))
    return after.select(F.xxhash64("key", "x").alias("key"), "node", level.alias("level"), (F.col("last") + F.col("j") + 1).alias("last"), "n_shingles")


def link_classes(chosen: DataFrame, texts_of: Callable[[DataFrame], DataFrame], width: int, percent: int, boundary: int | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(node, component) of the classes that are linked with another one; ``texts_of`` gives (node, text) of some nodes."""
    member = ["key", "node", "level", "last", "n_shingles"]
    entries, _ = buckets(chosen, percent, boundary)
    members = materialize(_shared_keys(entries), "members")
    facts = materialize(chosen.join(members.select("node").distinct(), "node", "left_semi"), "facts")
    links = _confirmed(_stars(members, facts, percent), texts_of, width, percent)
    labels = materialize(components(links), "labels")

    def still_open(rows: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with the bucket's rows."""
        mixed = labelled(rows, labels)
        several = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
        return materialize(mixed.join(several.select("key", "rows"), "key"), "open")

    members = still_open(members.select(*member))
    small, large = members.where(F.col("rows") <= split_rows), members.where(F.col("rows") > split_rows)
    for _ in range(DEPTH - 1):
        if large.isEmpty():
            break
        # sets that need not share one more element with each other stay as they are
        stay = large.where((F.col("level") == DEPTH) | (shared_at_least(percent) <= F.col("level")))
        split = materialize(_shared_keys(deeper(large.where(F.col("level") < DEPTH), facts, percent)), "split")
        links = links.unionByName(_confirmed(_stars(split, facts, percent), texts_of, width, percent))
        labels = materialize(components(links), "labels")
        opened = still_open(split.select(*member))
        small = small.unionByName(opened.where(F.col("rows") <= split_rows))
        large = stay.unionByName(opened.where(F.col("rows") > split_rows))
    links = links.unionByName(_confirmed(_sift(_inside(labelled(small.drop("component"), labels), percent), facts, percent), texts_of, width, percent))
    if large.isEmpty():
        return components(links)
    labels = materialize(components(links), "labels")
    rest = unsettled(large.select("key", "node"), labels)
    by_block = lambda rows: rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK)
    near = by_block(rest.join(facts.select("node", "n_shingles", "sketch"), "node")).mapInPandas(_near(percent), "key long, o int, i int, node long, component long, outer boolean")
    near = materialize(near, "near")
    texts = materialize(texts_of(near.select("node").distinct()), "texts")
    last = by_block(near.join(texts, "node")).mapInPandas(_confirm(width, percent), "a long, b long")
    return components(links.unionByName(materialize(last, "links")))


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
                   boundary: int | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    bound_batches(spark)
    number = F.col(doc_id).cast("long")
    rows = docs.select(number.isNull().alias("unnamed"), F.coalesce(number, F.lit(0)).alias("doc_id"), F.col(text).alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = materialize(rows.mapInPandas(_sign(width), SIGNED).withColumn("row", F.monotonically_increasing_id()), "signatures")
    name = F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id")
    filled = signed.where("n_shingles > 0").select("row", name, "n_shingles", "set_high", "set_low", F.struct("unnamed", F.col("doc_id").alias("id"), "text_key").alias("witness"))
    classes = filled.groupBy("set_high", "set_low").agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id"), F.min("witness").alias("witness"))
    classes = materialize(classes, "classes")
    shared = spark.sparkContext.broadcast(frequent_elements(signed))
    prefixes = rows.select("text").mapInPandas(_choose(shared, width, percent), CHOSEN)
    chosen = materialize(prefixes.join(classes.select("set_high", "set_low", "node"), ["set_high", "set_low"]).drop("set_high", "set_low").dropDuplicates(["node"]), "prefixes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("witness.unnamed").alias("unnamed"), F.col("witness.id").alias("doc_id"), F.col("witness.text_key").alias("text_key"))
        found = rows.join(wanted, ["unnamed", "doc_id", "text_key"])
        return found.groupBy("node").agg(F.first("text").alias("text"))  # copies of one row are combined first

    linked = link_classes(chosen, texts_of, width, percent, boundary, split_rows)
    named = labelled(classes, linked)
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    # one row per class; a class of many copies is the hot side, split by adaptive execution
    of_class = materialize(named.join(smallest, "component").select("set_high", "set_low", "component_id"), "class-components")
    some = filled.join(of_class, ["set_high", "set_low"]).select("doc_id", "n_shingles", "component_id")
    none = signed.where("n_shingles = 0").select(name, "n_shingles", name.alias("component_id"))
    return some.unionByName(none)
