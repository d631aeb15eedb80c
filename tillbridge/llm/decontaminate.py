"""Benchmark decontamination with suffix arrays of the training text.

The documents are dealt into shards (batches of a partition). A shard's suffix
array sorts the places of its text by the words that follow. Every suffix of a
benchmark item that begins with a whole window is binary-searched in it, all at once and word by word:
the interval of places that share its first k words shrinks as k grows, until it
is empty or as long as a window: that interval gives all places where the window
occurs. Hits of consecutive windows of an item at consecutive places are one
verbatim match, so each document gets its own longest matches with their
locations, whatever else the shard holds.

Only stretches of words that benchmark texts use, as long as the shortest
window, are indexed: no window can match elsewhere, so nothing is lost.
Benchmark items are read in blocks of at most ``BLOCK_WORDS`` words, each a
broadcast of that size, and each block searches all documents.

A shard is held as one number for each word and block. Words exist as strings
only for ``PIECE_BYTES`` of one text at a time, and texts are taken from Arrow
one by one, in batches of ``SMALL_BATCH_BYTES``.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window
is ``WINDOW`` consecutive words, or all words of a shorter item. Defined results:
null and empty texts have no words and no hits; an empty benchmark hits
nothing; repeated rows and items are judged one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.llm.common import SMALL_BATCH_BYTES, bound_batches, replace_columns

WINDOW = 10
BLOCK_WORDS = 1_000_000
SHARD_WORDS = 2_000_000
PIECE_BYTES = 1 << 18
# Bytes that separate words, once A-Z are lower-cased.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(32 if b in set(SEPARATORS) else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_TABLE).split()


def pieces_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, those of PIECE_BYTES (and the rest of the last word) at a time."""
    data, at = (text or "").encode().lower().translate(_TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


@dataclass
class Queries:
    """A block of benchmark items as word numbers, with its suffixes that start a window."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[str] = field(default_factory=list)
    text: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of suffixes, in text
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # words to the end of the item
    windows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # window length, 0 where none starts
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ranks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of items, by their ids as text
    least: int = WINDOW


def compile_queries(rows: list[tuple[object, list[bytes]]], window: int = WINDOW) -> Queries:
    q = Queries()
    text, starts, limits, windows, owners = [], [], [], [], []
    for item_id, parts in rows:
        if not parts:
            continue
        size, at = min(window, len(parts)), len(text)
        text += [q.vocabulary.setdefault(w, len(q.vocabulary) + 1) for w in parts]
        for k in range(len(parts)):
            starts.append(at + k)
            limits.append(len(parts) - k)
            windows.append(size if k + size <= len(parts) else 0)
            owners.append(len(q.items))
        q.items.append(str(item_id))
    q.text = np.array([*text, 0], np.int32)
    q.starts, q.limits, q.windows, q.owners = (np.array(x, np.int64) for x in (starts, limits, windows, owners))
    by_name = {name: k for k, name in enumerate(sorted(set(q.items)))}
    q.ranks = np.array([by_name[name] for name in q.items], np.int64)
    q.least = min((w for w in windows if w), default=window)
    return q


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Queries]:
    """Items in blocks of bounded size, one after another."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator(prefetchPartitions=False):
        parts = words(row["text"])
        if held and size + len(parts) > block_words:
            yield compile_queries(held, window)
            held, size = [], 0
        held.append((row["item_id"], parts))
        size += len(parts)
    if held:
        yield compile_queries(held, window)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` sorted by the ``depth`` words that follow, by doubling ranks."""
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    reach = 1
    while reach < depth:
        following = np.zeros_like(rank)
        following[:-reach] = rank[reach:] + 1 if reach < len(rank) else 0
        key = rank * (int(following.max(initial=0)) + 1) + following
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.cumsum(np.concatenate([[0], (ranked[1:] != ranked[:-1]).astype(np.int64)]))
        rank = np.empty_like(fresh)
        rank[order] = fresh
        reach *= 2
        if fresh[-1] == len(fresh) - 1:
            break
    return order


def stretches(ids: np.ndarray, least: int) -> np.ndarray:
    """Which places lie in a run of at least ``least`` benchmark words (ids above 0)."""
    known = np.concatenate([[0], (ids > 0).astype(np.int8), [0]])
    turn = np.diff(known)
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    keep = end - begin >= least
    delta = np.zeros(len(ids) + 1, np.int32)
    delta[begin[keep]] += 1
    delta[end[keep]] -= 1
    return np.cumsum(delta[:-1]) > 0


def search(q: Queries, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Window hits in a shard: (suffixes, places), all of one item together.

    ``ids`` are word numbers (0: no benchmark word, or the end of a document);
    places are positions in ``ids``.
    """
    inside = stretches(ids, q.least)
    where = np.flatnonzero(inside)
    if not len(where) or not len(q.starts):
        return
    gap = np.flatnonzero(np.diff(where) > 1) + 1
    text = np.insert(ids[where], gap, 0)  # an end between stretches
    place = np.insert(where, gap, -1)
    text, place = np.append(text, 0), np.append(place, -1)
    deepest = int(q.windows.max())
    order = suffix_array(text, deepest)
    padded = np.append(text, np.zeros(deepest + 1, text.dtype))
    alive = np.flatnonzero(q.windows > 0)
    low, high = np.zeros(len(q.starts), np.int64), np.full(len(q.starts), len(order), np.int64)
    depth = 0
    while len(alive):
        wanted = q.text[q.starts[alive] + depth]
        new_low = _bound(padded, order, low[alive], high[alive], wanted, depth, False)
        new_high = _bound(padded, order, new_low, high[alive], wanted, depth, True)
        found = new_low < new_high
        alive, new_low, new_high = alive[found], new_low[found], new_high[found]
        low[alive], high[alive] = new_low, new_high
        depth += 1
        full = alive[q.windows[alive] == depth]
        if len(full):
            yield np.repeat(full, high[full] - low[full]), place[order[_spread(low[full], high[full])]]
        alive = alive[q.windows[alive] > depth]


def matches(q: Queries, suffixes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, item, place) of the verbatim matches that window hits make up: runs of hits that move on by a word together."""
    along = np.lexsort((places, places - suffixes))
    suffix, at, owner = suffixes[along], places[along], q.owners[suffixes[along]]
    fresh = (np.diff(suffix) != 1) | (np.diff(at) != 1) | (np.diff(owner) != 0)
    start = np.flatnonzero(np.concatenate([[True], fresh]))
    length = np.diff(np.append(start, len(at))) - 1 + q.windows[suffix[start]]
    return length, owner[start], at[start]


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All positions of the intervals, one after another."""
    size = high - low
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


def _bound(text: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, depth: int, after: bool) -> np.ndarray:
    """For each interval of the suffix array, where the word at ``depth`` reaches (or passes) the wanted one."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        value = text[order[middle] + depth]
        less = value <= wanted[open_] if after else value < wanted[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


class Shard:
    """Documents as word numbers of each block, 0 after each document."""

    def __init__(self, queries: list[Queries]):
        self.queries, self.sizes, self.size = queries, [], 0
        self.parts: list[list[np.ndarray]] = [[] for _ in queries]

    def add(self, text: str | None) -> None:
        n = 0
        for piece in pieces_of(text):
            n += len(piece)
            for q, parts in zip(self.queries, self.parts):
                parts.append(np.fromiter(map(q.vocabulary.get, piece, repeat(0)), np.int32, len(piece)))
        for parts in self.parts:
            parts.append(np.zeros(1, np.int32))
        self.sizes.append(n)
        self.size += n

    def numbers(self) -> Iterator[tuple[Queries, np.ndarray]]:
        """Each block with its numbers, which the shard then gives up."""
        for k, q in enumerate(self.queries):
            ids = np.concatenate([np.zeros(0, np.int32), *self.parts[k]])
            self.parts[k] = []
            yield q, ids


def judge_shard(shard: Shard) -> list[tuple]:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, longest match, its item and first word."""
    sizes = np.array(shard.sizes, np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    cover = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    items: list[set[str]] = [set() for _ in sizes]
    best: list[tuple] = [(0,)] * len(sizes)  # minus the length, first word, item
    for q, ids in shard.numbers():
        for a, b in search(q, ids):
            np.add.at(cover, b, 1)
            np.add.at(cover, b + q.windows[a], -1)
            owner = np.searchsorted(first, b, side="right") - 1
            for d, item in np.unique(np.stack([owner, q.owners[a]], axis=1), axis=0):
                items[d].add(q.items[item])
            length, item, at = matches(q, a, b)
            owner = np.searchsorted(first, at, side="right") - 1
            longest_first = np.lexsort((q.ranks[item], at, -length, owner))
            begins = np.flatnonzero(np.diff(owner[longest_first], prepend=-1))
            for k in longest_first[begins]:
                d = int(owner[k])
                best[d] = min(best[d], (-int(length[k]), int(at[k] - first[d]), q.items[item[k]]))
    hit = np.cumsum(cover[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(hit)])
    out = []
    for d, (at, n) in enumerate(zip(first, sizes)):
        n_hit = int(sums[at + n] - sums[at])
        digest = hashlib.sha256(",".join(sorted(items[d])).encode()).hexdigest()
        out.append((int(n), n_hit, len(items[d]), digest, n_hit > 0, *((-best[d][0], best[d][2], best[d][1]) if n_hit else (0, None, None))))
    return out


RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_item", "longest_at")
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64())
FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_item string, longest_at long"


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated, and the length, item and first word of its longest verbatim match.

    A match has a window of its item at least. Of equally long ones the first in the
    document counts, then the smallest item id as text; without a hit they are 0 and null.

    No shuffle: each shard is searched where it was read. Extra columns stay, but
    for those with the names of the results.
    """
    bound_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(q) for q in blocks(benchmark, window, block_words)]

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        queries = [b.value for b in shared]
        for texts in batches:
            rows, shard = [], Shard(queries)
            for value in texts:
                shard.add(value.as_py())
                if shard.size >= SHARD_WORDS:
                    rows += judge_shard(shard)
                    shard = Shard(queries)
            rows += judge_shard(shard)
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(KINDS)], list(RESULT))

    marked = docs.withColumn("_found", F.arrow_udf(judge, FIELDS)(F.col(text)))
    return replace_columns(marked, {c: F.col(f"_found.{c}") for c in RESULT}).drop("_found")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents in which a window of the benchmark occurs."""
    marked = find(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), benchmark, "_text", window)
    return marked.where(~F.col("contaminated")).select("_row.*")
