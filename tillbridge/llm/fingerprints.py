"""Quartile bucket digests of texts.

The byte triplets of every window of four bytes (1-2-3, 1-2-4 and 1-3-4, each
with its own seed) are hashed into ``BUCKETS`` counters. The digest is the
length on a logarithmic scale and, for each bucket, which quartile of all
buckets its count falls in. Two digests differ by at most ``WORST``: 0 to 3
quartiles a bucket, the outer jump counted double as it cannot come from a
shifted boundary, and a capped share for the length. Likeness is one minus the
difference over that bound.

Defined results: a null text is an empty one; texts of under four bytes have no
triplets and differ by their length only; equal texts have equal digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbridge.llm.common import bound_batches
from tillbridge.session import materialize

BUCKETS = 256
STEPS = np.array([0, 1, 2, 6])
LENGTH_CAP = 24
WORST = BUCKETS * int(STEPS[-1]) + LENGTH_CAP * 4
BLOCK = 1 << 20


def bucket_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    for at in range(0, len(b) - 3, BLOCK):
        w = b[at:at + BLOCK + 3]
        first, second, third, fourth = w[:-3], w[1:-2], w[2:-1], w[3:]
        for seed, x in ((1, first | second << 8 | third << 16), (2, first | second << 8 | fourth << 16), (3, first | third << 8 | fourth << 16)):
            x = (x ^ np.uint32(seed * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            x = (x ^ x >> np.uint32(15)) * np.uint32(0x85EBCA77)
            counts += np.bincount(x >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint(text: str) -> str:
    """Length code and quartile codes in hexadecimal, two bits a bucket."""
    data = text.encode()
    counts = bucket_counts(data)
    ranked = np.sort(counts)
    quartiles = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles).sum(axis=1).astype(np.uint8)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    length = min(255, int(round(8 * np.log2(1 + len(data)))))
    return f"{length:02x}" + packed.tobytes().hex()


def _codes(digest: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return int(raw[0]), np.stack([raw[1:] >> s & 3 for s in (0, 2, 4, 6)])


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0."""
    (length_a, x), (length_b, y) = _codes(a), _codes(b)
    apart = int(STEPS[np.abs(x.astype(np.int8) - y.astype(np.int8))].sum()) + 4 * min(LENGTH_CAP, abs(length_a - length_b))
    return 1.0 - apart / WORST


def edited(text: str, following: str) -> str:
    """The last third replaced by the first as many code points of the following text."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
PLACED = RESULT + ", part int, is_first boolean, is_last boolean, text string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _pair(doc_id, text: str, own: str, following: str, following_print: str) -> tuple:
    changed = edited(text, following)
    changed_print = fingerprint(changed)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return doc_id, len(text), digest, own, changed_print, likeness(own, changed_print), likeness(own, following_print)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs each row of a sorted partition with the next one; the partition's first and last rows come with their texts."""
    part = TaskContext.get().partitionId()
    held = None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            doc_id, text = (None if pd.isna(doc_id) else int(doc_id)), text or ""
            own = fingerprint(text)
            if held is None:
                out.append((doc_id, len(text), None, own, None, None, None, part, True, False, text))
            else:
                out.append((*_pair(*held, text, own), part, False, False, None))
            held = (doc_id, text, own)
        yield _frame(out)
    if held is not None:
        yield _frame([(held[0], len(held[1]), None, held[2], None, None, None, part, False, True, held[1])])


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*NAMES, "part", "is_first", "is_last", "text"], dtype=object)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Digest of each text and of its edited form, and their likeness to each other and to the next document.

    Documents follow each other by descending doc_id (null last, ties by text
    hash and text), the last by the first. One range shuffle brings neighbours
    together; only the first and last row of each partition meet again.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    placed = materialize(ranged.mapInPandas(_walk, PLACED), "neighbours")
    inner = placed.where("not is_first and not is_last").select(*NAMES)
    # one row per partition: where the one after each non-empty partition starts
    heads = placed.where("is_first").select(F.col("part").alias("head"))
    around = Window.orderBy("head")
    turn = heads.select("head", F.coalesce(F.lead("head").over(around), F.min("head").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    firsts = placed.where("is_first").select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    lasts = placed.where("is_last").select("doc_id", "text", "fingerprint", F.col("part").alias("head"))
    edges = lasts.join(turn, "head").join(firsts, "after").select("doc_id", "text", "fingerprint", "next_text", "next_print")
    return inner.unionByName(edges.mapInPandas(_edges, RESULT))


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [
            _pair(None if pd.isna(d) else int(d), t, own, following, following_print)
            for d, t, own, following, following_print in batch.itertuples(index=False)
        ]
        yield pd.DataFrame(found, columns=NAMES, dtype=object)
