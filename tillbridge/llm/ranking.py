"""Ranked lexical search by the Best Position Algorithm.

1. Queries are counted into terms and dealt into blocks of at most
   ``BLOCK_TERMS`` distinct terms (or one query). One block at a time is broadcast.
2. One pass over the documents stores, per document, its length and the counts of
   the terms of the block. Sums over all documents give N, L and every df.
3. The stored documents are dealt into shards. A shard holds one impact list per
   term (impact descending, then document) and, for direct access, each
   document's places in all lists. A query reads its lists in parallel. A document
   met for the first time is completed by direct access, which also marks its
   places in the query's other lists as seen. A list's best position is the
   last one before which everything is seen, whether by reading or by direct
   access; the threshold sums the impacts at the best positions, and the search
   ends once it is strictly below the k-th best score, so ties are never lost.
4. A first wave of shards, over one document in ``FIRST_WAVE``, gives each query a
   lower bound of its final k-th score; the second wave, over all others, starts
   from that bound, so few documents are left for the final ranking.

Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. The score
of a document is the sum over a query's terms, with repeats, of
w * ((10^9 tf) div (1000 tf + 8 m)), w = floor(1000 ln((2N + 2) / (2 df + 1))) and
m = 25 + (75 n N) div L.

Defined results: null and empty texts have no terms, so they are neither counted
in N nor ranked, and as queries return nothing; equal scores go by ascending
``doc_id``, null last; repeated rows, of documents or queries, are ranked one by
one; a query's extra columns are ignored, and so are a document's.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbridge.llm.common import bound_batches
from tillbridge.llm.decontaminate import words
from tillbridge.session import materialize

TOP = 10
BLOCK_TERMS = 1_000_000
SHARD_PLACES = 2_000_000
FIRST_WAVE = 16
STEP = 64
FOUND = "item long, unnamed boolean, doc_id long, score long"
COUNTED = ["unnamed", "doc_id", "n", "terms", "tfs"]


def _count_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counted = [Counter(words(t)) for t in batch["text"]]
        yield pd.DataFrame({
            "item": batch["item"], "size": [max(1, len(c)) for c in counted],
            "terms": [[t.decode() for t in c] for c in counted], "counts": [list(c.values()) for c in counted],
        })


def numbered_items(queries: DataFrame, item_id: str, text: str, block_terms: int) -> DataFrame:
    """(item, item_id, terms, counts, block): a row number, the distinct terms with counts, and the block of each query."""
    rows = materialize(queries.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    counted = rows.select("item", "text").mapInPandas(_count_items, "item long, size long, terms array<string>, counts array<long>")
    part = F.shiftright("item", 33)
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("item"))
    placed = materialize(counted.withColumn("part", part).withColumn("inside", inside), "item-terms")
    totals = placed.groupBy("part").agg(F.max("inside").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the queries
    shifts = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("shift"))
    block = F.floor((F.col("shift") + F.col("inside") - 1) / F.lit(block_terms)).cast("long")
    return rows.select("item", "item_id").join(placed.join(shifts, "part").select("item", "terms", "counts", block.alias("block")), "item")


@dataclass
class Block:
    """Queries of a block as term numbers."""

    vocabulary: dict[bytes, int]
    items: np.ndarray
    terms: list[np.ndarray]
    counts: list[np.ndarray]


def compile_block(rows: list) -> Block:
    vocabulary: dict[bytes, int] = {}
    rows = sorted(rows, key=lambda r: r["item"])
    terms = [np.array([vocabulary.setdefault(t.encode(), len(vocabulary)) for t in r["terms"]], np.int32) for r in rows]
    return Block(vocabulary, np.array([r["item"] for r in rows], np.int64), terms, [np.array(r["counts"], np.int64) for r in rows])


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(row, unnamed, doc_id, n, terms, tfs): the length of each document and its counts of the vocabulary, stored."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch["text"]:
                parts = words(text)
                number = np.fromiter((known.get(w, -1) for w in parts), np.int32, len(parts))
                term, tf = np.unique(number[number >= 0], return_counts=True)
                sizes.append(len(parts))
                terms.append(term)
                tfs.append(tf)
            yield batch[["unnamed", "doc_id"]].assign(n=sizes, terms=terms, tfs=tfs)

    counted = docs.mapInPandas(run, "unnamed boolean, doc_id long, n long, terms array<int>, tfs array<long>")
    stored = materialize(counted.where("n > 0").withColumn("row", F.monotonically_increasing_id()), "term-counts")
    shared.unpersist()
    return stored


@dataclass
class Weights:
    """Statistics of all documents: N, L, and w of each term of the block."""

    documents: int
    length: int
    of_term: np.ndarray

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 25 + (75 * n * self.documents) // max(1, self.length)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weigh(counted: DataFrame, size: int) -> Weights:
    total = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    weights = np.zeros(size, np.int64)
    # one row per term of the block
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        weights[r["term"]] = math.floor(1000 * math.log((2 * total["documents"] + 2) / (2 * r["df"] + 1)))
    return Weights(total["documents"], total["length"] or 0, weights)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Shard:
    """Impact lists of some documents, and each document's places in them."""

    def __init__(self, rows: pd.DataFrame, weights: Weights):
        rows = rows.sort_values(["unnamed", "doc_id"], kind="stable")  # a lower number wins a tie
        self.unnamed, self.doc_ids = rows["unnamed"].tolist(), rows["doc_id"].tolist()
        sizes = rows["terms"].map(len).to_numpy(np.int64)
        terms, tfs = np.concatenate([*rows["terms"]]).astype(np.int32), np.concatenate([*rows["tfs"]]).astype(np.int64)
        impacts = weights.impacts(tfs, np.repeat(rows["n"].to_numpy(np.int64), sizes))
        self.of_doc = np.concatenate([[0], np.cumsum(sizes)])
        docs = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.lexsort((docs, -impacts, terms))
        self.starts = np.searchsorted(terms[order], np.arange(len(weights.of_term) + 1))
        self.docs, self.impacts = docs[order], impacts[order]
        self.terms, self.own_impacts = terms, impacts
        self.places = np.empty(len(order), np.int32)
        self.places[order] = np.arange(len(order)) - self.starts[terms[order]]  # of each document's terms, in their lists
        self.slots = np.full(len(weights.of_term), -1, np.int32)
        self.known = np.zeros(len(sizes), bool)

    def best(self, terms: np.ndarray, factors: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with their scores: all that can be among the ``top`` and reach ``floor``."""
        start, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        held = np.flatnonzero((size > 0) & (factors > 0))
        terms, factors, start, size = terms[held], factors[held], start[held], size[held]
        offset = np.concatenate([[0], np.cumsum(size)])
        seen = np.zeros(offset[-1], bool)
        position = np.zeros(len(terms), np.int64)  # places of each list before which all are seen
        self.slots[terms] = np.arange(len(terms))
        docs, scores, read, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, STEP
        met: list[np.ndarray] = []
        while True:
            width = np.clip(size - read, 0, step)
            fresh = np.unique(self.docs[_ranges(start + read, width)])
            fresh = fresh[~self.known[fresh]]
            self.known[fresh] = True
            met.append(fresh)
            # direct access: all places of the new documents in the lists of the query
            count = self.of_doc[fresh + 1] - self.of_doc[fresh]
            at = _ranges(self.of_doc[fresh], count)
            slot = self.slots[self.terms[at]]
            inside = np.flatnonzero(slot >= 0)
            at, slot = at[inside], slot[inside]
            gains = np.concatenate([[0], np.cumsum(factors[slot] * self.own_impacts[at])])
            ends = np.searchsorted(inside, np.concatenate([[0], np.cumsum(count)]))
            docs, scores = _leading(np.concatenate([docs, fresh]), np.concatenate([scores, gains[ends[1:]] - gains[ends[:-1]]]), top, floor)
            seen[offset[slot] + self.places[at]] = True
            threshold = 0
            for k in range(len(terms)):
                unseen = seen[offset[k] + position[k]:offset[k + 1]]
                gap = int(unseen.argmin()) if len(unseen) else 0
                position[k] = size[k] if not len(unseen) or unseen[gap] else position[k] + gap
                if position[k] < size[k]:  # a list seen to its end gives nothing to an unseen document
                    threshold += int(factors[k] * self.impacts[start[k] + max(0, position[k] - 1)])
            least = max(floor, int(scores[-1]) if len(scores) == top else 1)
            if threshold < least:
                break
            read, step = read + step, 2 * step
        self.slots[terms] = -1
        for fresh in met:
            self.known[fresh] = False
        return docs, scores


def _leading(docs: np.ndarray, scores: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``top`` by score, then document, among those with a score of at least ``floor`` and above 0."""
    keep = scores >= max(1, floor)
    docs, scores = docs[keep], scores[keep]
    if len(docs) > 4 * top:
        enough = scores >= np.partition(scores, -top)[-top]
        docs, scores = docs[enough], scores[enough]
    order = np.lexsort((docs, -scores))[:top]
    return docs[order], scores[order]


def _shards(batches: Iterator[pd.DataFrame], weights: Weights) -> Iterator[Shard]:
    """Documents of a partition in shards of about ``SHARD_PLACES`` places."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        sizes = batch["terms"].map(len).to_numpy(np.int64)
        cuts = (size + np.cumsum(sizes)) // SHARD_PLACES
        for cut in np.unique(cuts):
            held.append(batch[cuts == cut])
            size += int(sizes[cuts == cut].sum())
            if size >= SHARD_PLACES:
                yield Shard(pd.concat(held), weights)
                held, size = [], 0
    if held:
        yield Shard(pd.concat(held), weights)


def search_shards(counted: DataFrame, block: Block, weights: Weights, floors: dict[int, int], top: int) -> DataFrame:
    """(item, doc_id, score): the best of each task, scores below a query's floor left out."""
    shared = counted.sparkSession.sparkContext.broadcast((block.items, block.terms, block.counts, weights, floors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, terms, counts, weights, floors = shared.value
        best: list[list[tuple]] = [[] for _ in items]
        for shard in _shards(batches, weights):
            for k, item in enumerate(items):
                floor = max(floors.get(int(item), 1), -best[k][-1][0] if len(best[k]) == top else 1)
                docs, scores = shard.best(terms[k], counts[k] * weights.of_term[terms[k]], top, floor)
                if len(docs):
                    best[k] = sorted(best[k] + [(-int(s), shard.unnamed[d], shard.doc_ids[d]) for d, s in zip(docs, scores)])[:top]
        rows = [(item, unnamed, doc, -score) for item, found in zip(items, best) for score, unnamed, doc in found]
        yield pd.DataFrame(rows, columns=["item", "unnamed", "doc_id", "score"])

    return counted.mapInPandas(run, FOUND)


def search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text",
           top: int = TOP, block_terms: int = BLOCK_TERMS, first_wave: int = FIRST_WAVE) -> DataFrame:
    """Per query its ``top`` documents with a score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    bound_batches(spark)
    number = F.col(doc_id).cast("long")
    rows = docs.select(number.isNull().alias("unnamed"), F.coalesce(number, F.lit(0)).alias("doc_id"), F.col(text).alias("text"))
    items = materialize(numbered_items(queries, item_id, query, block_terms), "query-blocks")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "unnamed", "doc_id")
    ranked = []
    for at in [r["block"] for r in items.select("block").distinct().orderBy("block").collect()]:
        block = compile_block(items.where(F.col("block") == at).select("item", "terms", "counts").collect())
        counted = count_terms(rows, block.vocabulary)
        weights = weigh(counted, len(block.vocabulary))
        leads = F.pmod(F.xxhash64("row"), F.lit(first_wave)) == 0
        found = materialize(search_shards(counted.where(leads).select(*COUNTED), block, weights, {}, top), "first-wave")
        kth = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == top)
        floors = {r["item"]: r["score"] for r in kth.select("item", "score").collect()}  # one number per query of the block
        rest = search_shards(counted.where(~leads).select(*COUNTED), block, weights, floors, top)
        ranked.append(found.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
    if not ranked:
        ranked = [spark.createDataFrame([], FOUND).withColumn("rank", F.lit(0))]
    every = reduce(DataFrame.unionByName, ranked).join(items.select("item", "item_id"), "item")
    return every.select("item_id", "rank", F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "score")
