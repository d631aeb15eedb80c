"""Conversation prefix trie: a z-fast trie built in batches of joins.

1. Turns get their depth from a global order, and every prefix a 128-bit name: the
   exclusive-or of its turns' hashes, each with its depth, as running sums over
   blocks of a conversation. Equal sequences are one class with one path.
2. The compacted trie keeps one node per branching or end: its extent (depth and
   name), its parent's depth and a path through it. A node's handle is the prefix
   at the two-fattest depth of its edge, the number with most trailing zeros in
   (parent depth, depth].
3. Classes are inserted in batches that double in size. Each class finds its exit
   by fat binary search: it looks up the name of its prefix at the two-fattest
   depth of the interval left; a hit moves the lower end to that node's extent, a
   miss the upper end before the probe, so it takes as many joins with the
   handles as the depth has bits. The extent of the last node and the edge
   below it give the exact exit depth.
4. Below their exits a batch's paths make new nodes where they branch or end, exits
   inside edges split them, and edges get their parents and handles anew.
5. Sums over the compacted trie give each node's members, leaves and tokens; then
   edges are expanded to one row per prefix.

A conversation, its path or a class may hold any share of the rows: depths, names
and sums come from blocks, joins meet it row by row, and the digest of a class
reads its members in order, in pieces made beforehand. One class's digest is one
task, since SHA-256 has no parallel form.

Defined results: a null role or text is empty; rows without ``conv_id`` belong to no
conversation; equal turn numbers of one conversation go by role, then text;
a conversation without turns is a member of the root, and ends there; without
conversations there is only the root, with null ids; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbridge.operators.ordering import with_global_index
from tillbridge.session import materialize

BATCHES = 2
BLOCK_BITS = 12  # turns of a conversation summed at a time, as a power of two
CHUNK_BITS = 12  # range of ids in one piece of a digest
NAME = ["depth", "a", "b"]
TURN = ["x", "y", "size"]
NOTHING = hashlib.sha256(b"").hexdigest()


def number_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, size): turns of each conversation numbered from 1 by turn, null first; two hashes of role and text, and the text's code points."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
    hashed = [F.xxhash64(F.lit(seed), "role", "text").alias(name) for seed, name in ((1, "x"), (2, "y"))]
    placed = with_global_index(rows, ["conv_id", "turn", "role", "text"], keep=["conv_id", *hashed, F.length("text").cast("long").alias("size")])
    starts = placed.groupBy("conv_id").agg(F.min("_index").alias("_start"))
    return placed.join(starts, "conv_id").select("conv_id", (F.col("_index") - F.col("_start") + 1).alias("depth"), *TURN)


def share_heads(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Numbered ``turns`` with the first h of each conversation c replaced by those of c - c % group, and all conv_ids.

    h is the crc32 of the decimal conv_id modulo ``most``.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("depth").alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), head.alias("h"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("_n")), "base", "left")
    convs = materialize(convs.select("conv_id", "base", "h", F.least("h", F.coalesce("_n", F.lit(0))).alias("kept")), "heads")
    lent = turns.where((F.col("depth") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    heads = lent.join(convs, "base").where("depth <= h").select("conv_id", "depth", *TURN)
    own = turns.join(convs, "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("kept")).alias("depth"), *TURN)
    return materialize(heads.unionByName(own), "rebuilt"), convs.select("conv_id")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, before, upto): name of each prefix and of the one a turn shorter, code points without and with its last turn."""
    rows = turns.select("conv_id", "depth", F.xxhash64("x", "depth").alias("x"), F.xxhash64("y", "depth").alias("y"), "size")
    rows = rows.withColumn("block", F.shiftright(F.col("depth") - 1, BLOCK_BITS))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth")
    local = rows.select("*", F.bit_xor("x").over(inside).alias("a"), F.bit_xor("y").over(inside).alias("b"), F.sum("size").over(inside).alias("upto"))
    tails = rows.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("size").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    none = F.lit(0).cast("long")
    carried = tails.select("conv_id", "block", *[F.coalesce(f(c).over(earlier), none).alias(f"c{c}") for c, f in (("x", F.bit_xor), ("y", F.bit_xor), ("size", F.sum))])
    whole = local.join(carried, ["conv_id", "block"])
    a, b = F.col("a").bitwiseXOR(F.col("cx")), F.col("b").bitwiseXOR(F.col("cy"))
    upto = F.col("upto") + F.col("csize")
    return whole.select("conv_id", "depth", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("pa"), b.bitwiseXOR(F.col("y")).alias("pb"), (upto - F.col("size")).alias("before"), upto.alias("upto"))


def two_fattest(low: str, high: str) -> Column:
    """The number in (low, high] with most trailing zeros."""
    k = f"length(bin({low} ^ {high})) - 1"
    return F.expr(f"shiftleft(shiftright({high}, {k}), {k})")


def _path(paths: DataFrame, depth: str, a: str, b: str) -> DataFrame:
    """The prefix of each path at some depth, under other names."""
    return paths.select("rep", F.col("depth").alias(depth), F.col("a").alias(a), F.col("b").alias(b))


def locate(new: DataFrame, paths: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """(rep, length, exit): how deep each new class goes along the trie."""
    handles = nodes.select(F.col("ha").alias("fa"), F.col("hb").alias("fb"), F.struct("depth", "a", "b", "rep", "parent_depth").alias("met"))
    state = new.select("rep", "length", F.lit(0).cast("long").alias("low"), F.col("length").alias("high"), F.lit(None).cast(handles.schema["met"].dataType).alias("hit"))
    for _ in range(rounds):
        probed = state.withColumn("f", F.when(F.col("low") < F.col("high"), two_fattest("low", "high")))
        probed = probed.join(_path(paths, "f", "fa", "fb"), ["rep", "f"], "left").join(handles, ["fa", "fb"], "left")
        found = F.col("met").isNotNull()
        state = probed.select(
            "rep", "length", F.when(found, F.col("met.depth")).otherwise(F.col("low")).alias("low"),
            F.when(found | F.col("f").isNull(), F.col("high")).otherwise(F.col("f") - 1).alias("high"), F.coalesce("met", "hit").alias("hit"),
        )
    state = materialize(state, "searched").withColumn("end", F.col("hit.depth"))
    checked = state.join(_path(paths, "end", "ea", "eb"), ["rep", "end"], "left")
    whole = F.coalesce((F.col("ea") == F.col("hit.a")) & (F.col("eb") == F.col("hit.b")), F.lit(False))
    checked = checked.select("rep", "length", F.when(whole, F.col("end")).otherwise(F.coalesce("hit.parent_depth", F.lit(0))).alias("reached"), F.when(~whole, F.col("hit")).alias("edge"))
    # below a node that is passed whole, the edge is found by the next prefix
    below = nodes.select(F.col("ca").alias("na"), F.col("cb").alias("nb"), F.struct("depth", "rep").alias("next"))
    stepped = checked.withColumn("step", F.when(F.col("edge").isNull(), F.col("reached") + 1))
    stepped = stepped.join(_path(paths, "step", "na", "nb"), ["rep", "step"], "left").join(below, ["na", "nb"], "left")
    edges = materialize(stepped.select("rep", "length", "reached", F.coalesce("edge.depth", "next.depth").alias("until"), F.coalesce("edge.rep", "next.rep").alias("other")), "exits")
    shared = edges.where("other is not null").join(paths.select("rep", *NAME), "rep").where("depth > reached AND depth <= until")
    shared = shared.join(paths.select(F.col("rep").alias("other"), *NAME), ["other", *NAME]).groupBy("rep").agg(F.max("depth").alias("exit"))
    return edges.join(shared, "rep", "left").select("rep", "length", F.coalesce("exit", "reached").alias("exit"))


def on_path(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes on each path: rep, depth, a, b, upto, node_rep and the node above (``above``, depth 0 for the root)."""
    rows = paths.select("rep", *NAME, "upto").join(names, NAME)
    root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("upto"))
    above = F.lag(F.struct(*NAME, "upto")).over(Window.partitionBy("rep").orderBy("depth"))
    return rows.withColumn("above", F.coalesce(above, root))


def merge(nodes: DataFrame | None, placed: DataFrame, paths: DataFrame, inserted: DataFrame) -> DataFrame:
    """The compacted trie with the classes of a batch: their new nodes, split edges, parents and handles."""
    own = paths.join(placed, "rep")
    new = own.where("depth > exit").groupBy(*NAME, "pa", "pb").agg(F.min("rep").alias("node_rep"), F.max(F.col("depth") == F.col("length")).alias("ends"))
    new = materialize(new, "new-prefixes")
    branches = new.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("ways"))
    fresh = new.join(branches, ["a", "b"], "left").where("ends OR ways > 1").select(*NAME, "node_rep")
    exits = own.where("depth = exit").select(*NAME, F.col("rep").alias("node_rep"))
    every = fresh.unionByName(exits)
    if nodes is not None:
        every = every.unionByName(nodes.select(*NAME, F.col("rep").alias("node_rep")))
    names = every.groupBy(*NAME).agg(F.min("node_rep").alias("node_rep"))
    tree = on_path(paths.join(inserted, "rep", "left_semi"), names).where("rep = node_rep").select("rep", *NAME, F.col("above.depth").alias("parent_depth"))
    tree = tree.withColumn("f", two_fattest("parent_depth", "depth")).withColumn("c", F.col("parent_depth") + 1)
    tree = tree.join(_path(paths, "f", "ha", "hb"), ["rep", "f"]).join(_path(paths, "c", "ca", "cb"), ["rep", "c"])
    return materialize(tree.select(*NAME, "rep", "parent_depth", "ha", "hb", "ca", "cb"), "trie")


def digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the members of each class, in numerical order."""
    chunk = F.shiftright("conv_id", CHUNK_BITS)  # ids are whole numbers, so a piece is bounded
    pieces = ends.groupBy(*NAME, chunk.alias("chunk")).agg(F.array_sort(F.collect_set("conv_id")).alias("ids"))
    pieces = pieces.select(*NAME, "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for batch in batches:
            done = []
            for *here, ids in batch[[*NAME, "ids"]].itertuples(index=False, name=None):
                if here == name:
                    state.update(b"," + ids.encode())
                    continue
                if name is not None:
                    done.append((*name, state.hexdigest()))
                name, state = here, hashlib.sha256(ids.encode())
            yield pd.DataFrame(done, columns=[*NAME, "ends_sha256"])
        if name is not None:
            yield pd.DataFrame([(*name, state.hexdigest())], columns=[*NAME, "ends_sha256"])

    ordered = pieces.repartition(*NAME).sortWithinPartitions(*NAME, "chunk").select(*NAME, "ids")
    return ordered.mapInPandas(run, "depth long, a long, b long, ends_sha256 string")


def insert_all(classes: DataFrame, paths: DataFrame, batches: int) -> DataFrame:
    """The compacted trie of all ``classes`` (rep, length), inserted in batches of 1, 2, 4 ... shares."""
    rounds = int(paths.agg(F.max("depth")).first()[0] or 0).bit_length()
    share = F.pmod(F.xxhash64("rep"), F.lit(2**batches - 1)) + 1
    dealt = materialize(classes.select("rep", "length", (F.length(F.bin(share)) - 1).alias("batch")), "batches")
    nodes = None
    for k in range(batches):
        new = dealt.where(F.col("batch") == k).select("rep", "length")
        placed = new.withColumn("exit", F.lit(0).cast("long")) if nodes is None else locate(new, paths, nodes, rounds)
        nodes = merge(nodes, placed, paths, dealt.where(F.col("batch") <= k).select("rep"))
    return nodes


def build(turns: DataFrame, ids: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per prefix of the numbered ``turns``, members counted among ``ids``.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (code points that members after the first share, over the subtree) and ends_sha256.
    """
    ids = ids.where("conv_id is not null").distinct()
    named = materialize(prefixes(turns.where("conv_id is not null")), "prefixes")
    last = named.groupBy("conv_id").agg(F.max(F.struct(*NAME)).alias("end")).select("conv_id", "end.*")
    zero = F.lit(0).cast("long")
    ends = materialize(ids.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in NAME]), "ends")
    classes = materialize(ends.where("depth > 0").groupBy(*NAME).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    paths = materialize(named.join(classes.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "rep"), "paths")
    trie = insert_all(classes.select("rep", F.col("depth").alias("length")), paths, batches)
    nodes = materialize(on_path(paths, trie.select(*NAME, F.col("rep").alias("node_rep"))), "nodes-on-paths")

    kids = nodes.where("rep = node_rep").groupBy("above.depth", "above.a", "above.b").agg(F.count(F.lit(1)).alias("n_children"))
    final = classes.join(kids, NAME, "left").select("rep", "n", F.col("n_children").isNull().cast("long").alias("leaf"))
    counts = nodes.join(final, "rep").groupBy(*NAME).agg(F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id"), F.sum("leaf").alias("n_leaves"))
    counts = materialize(counts, "counts")
    shared = (F.col("n_convs") - 1) * (F.col("upto") - F.col("above.upto"))
    weighed = nodes.join(counts.select(*NAME, "n_convs"), NAME).select("rep", *NAME, F.when(F.col("rep") == F.col("node_rep"), shared).otherwise(zero).alias("weight"))
    deeper = Window.partitionBy("rep").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    below = weighed.withColumn("deeper", F.coalesce(F.sum("weight").over(deeper), zero)).groupBy(*NAME).agg(F.sum("deeper").alias("below"))
    members = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")).first()
    saved = weighed.agg(F.sum("weight")).first()[0] or 0
    leaves = final.agg(F.sum("leaf")).first()[0] or 1
    above = counts.select(F.struct(*NAME).alias("_above"), F.col("conv_id").alias("above_id"))
    tree = nodes.where("rep = node_rep").join(counts, NAME).join(below, NAME).join(kids, NAME, "left")
    tree = tree.withColumn("_above", F.struct("above.depth", "above.a", "above.b")).join(above, "_above", "left")
    tree = tree.join(digests(ends), NAME, "left").withColumn("above_id", F.coalesce("above_id", F.lit(members["first"]).cast("long")))

    edges = tree.withColumn("at", F.explode(F.sequence(F.col("above.depth") + 1, F.col("depth"))))
    edges = edges.join(paths.select("rep", F.col("depth").alias("at"), "before"), ["rep", "at"])
    end, first = F.col("at") == F.col("depth"), F.col("at") == F.col("above.depth") + 1
    rows = edges.select(
        "conv_id", F.col("at").alias("depth"), F.when(first, F.col("above_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(end, F.coalesce("n_children", zero)).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("upto") - F.col("before"))).alias("saved_tokens"),
        F.when(end, F.coalesce("ends_sha256", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
    )
    spark = turns.sparkSession
    ways = kids.where("depth = 0").agg(F.sum("n_children")).first()[0] or 0
    sha = digests(ends.where("depth = 0")).first()
    top = (members["first"], 0, None, members["n"], ways, leaves, saved, sha["ends_sha256"] if sha else NOTHING)
    root = spark.createDataFrame([top], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    return rows.unionByName(root.select(*rows.columns))
