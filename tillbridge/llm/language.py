"""Language identification by prediction by partial matching.

Each language has a byte context tree of up to three bytes. A byte
seen n_s times in a context of n bytes and d distinct ones costs
-log2(n_s / (n + d)) bits there; an unseen one costs the escape
-log2(d / (n + d)) and is coded in the next shorter context, down to a
uniform code over 256 bytes. Statistics are frozen after training, so the code
length of a text is a sum over its positions and the shortest one names the
language.

Defined results: a null text, or one without any letter, is ``und`` with score
0; ties go to the first language by name; without training rows all texts are
``und``. Extra columns stay, but for those that have the names of the results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.llm.common import bound_batches, bounded_share, drawn, fold, per_text, replace_columns
from tillbridge.session import materialize

ROWS_PER_LANGUAGE = 4000
MIN_CONTEXT = 8
MAX_CONTEXTS = 60_000
BLOCK = 1 << 16
NODES = 2048
LATIN = re.compile("[A-Za-z]")
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    symbols: np.ndarray  # byte -> symbol, 0 for bytes never seen
    contexts: np.ndarray  # three symbols -> node of the longest known context
    costs: np.ndarray  # node, symbol -> bits of each language

    @property
    def width(self) -> int:
        return int(self.symbols.max()) + 1


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of four bytes (three of context) of each language, summed in the task."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            codes = []
            for text in texts:
                data = np.frombuffer(b"\0\0\0" + text.encode(), np.uint8).astype(np.uint32)
                codes.append(data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:])
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pd.DataFrame({"lang": lang, "code": code.astype(np.int64), "n": n})


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE,
          min_context: int | None = MIN_CONTEXT, max_contexts: int | None = MAX_CONTEXTS, seed: int = 10) -> Model:
    """Context trees of all languages of ``docs``, from about ``rows_per_language`` whole texts of each.

    Bounded by parameters: the sampled rows of a language, and the contexts
    kept (those seen ``min_context`` times in some language, the most frequent
    ``max_contexts`` of each order; None keeps all). Rows are drawn by a hash of ``key``.
    """
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model((), np.zeros(256, np.int32), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    share = F.create_map(*[F.lit(x) for pair in sorted(bounded_share(counts, rows_per_language).items()) for x in pair])[F.col("lang")]
    sample = known.where(drawn(F.col("key"), share, seed)).select("lang", "text")
    languages = tuple(sorted(counts))
    stored = materialize(sample.mapInPandas(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "windows")
    pieces = []
    for k, name in enumerate(languages):  # one language at a time, as numbers only
        piece = stored.where(F.col("lang") == name).select("code", "n").toPandas()
        pieces.append((piece["code"].to_numpy(np.uint32), piece["n"].to_numpy(np.int64), np.full(len(piece), k, np.int32)))
        del piece
    code, n, which = (np.concatenate([p[i] for p in pieces]) for i in range(3))
    del pieces
    return build(languages, code, n, which, min_context, max_contexts)


def build(languages: tuple[str, ...], code: np.ndarray, n: np.ndarray, which: np.ndarray, min_context: int | None, max_contexts: int | None) -> Model:
    """Dense cost table of the merged trees, from counts ``n`` of four-byte windows ``code`` in the language numbered ``which``.

    Without ``min_context`` and ``max_contexts`` every context that was seen is a node.
    """
    window = np.stack([(code >> np.uint32(shift) & np.uint32(255)).astype(np.uint8) for shift in (24, 16, 8, 0)])
    seen = np.unique(window[3])
    symbols = np.zeros(256, np.int32)
    symbols[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    s = symbols[window].astype(np.int16)
    s[:3][window[:3] == 0] = 0
    del window, code

    def packed(order: int) -> np.ndarray:
        """The last ``order`` bytes before each window's end, as one number."""
        out = np.zeros(s.shape[1], np.int32)
        for k in range(1, order + 1):
            out += s[3 - k].astype(np.int32) * np.int32(width ** (k - 1))
        return out

    nodes: list[dict[int, int]] = [{0: 0}]  # per order: packed context -> node
    parents = [0]
    for order in (1, 2, 3):
        full = np.all(s[3 - order:3] > 0, axis=0)
        keys, inverse = np.unique(packed(order)[full], return_inverse=True)
        often = np.zeros(len(keys))
        for lang in range(len(languages)):
            own = which[full] == lang
            often = np.maximum(often, np.bincount(inverse[own], n[full][own], len(keys)))
        del inverse
        chosen = np.flatnonzero(often >= (min_context or 0))
        chosen = chosen[np.argsort(-often[chosen], kind="stable")[:max_contexts]]
        nodes.append({})
        for k in np.sort(chosen):
            context = int(keys[k])
            shorter = context % width ** (order - 1)
            if shorter in nodes[order - 1]:  # a tree: a node needs its parent
                nodes[order][context] = len(parents)
                parents.append(nodes[order - 1][shorter])
    contexts = np.zeros(width**3, np.int32).reshape(width, width, width)  # third, second, first byte back
    for order in (1, 2, 3):
        for context, node in nodes[order].items():
            back = [context // width**k % width for k in range(order)]
            contexts[(slice(None),) * (3 - order) + tuple(reversed(back))] = node
    costs = np.zeros((len(parents), width, len(languages)), np.float32)
    base = np.full((width, len(languages)), 8.0)
    first = 0
    for order in (0, 1, 2, 3):
        known = np.array(sorted(nodes[order]), np.int32)  # nodes are numbered in this order
        size, own = len(known), packed(order)
        at = np.minimum(np.searchsorted(known, own), max(0, size - 1))
        held = np.flatnonzero(known[at] == own) if size else np.zeros(0, np.int64)
        held = held[np.argsort(at[held], kind="stable")]
        at = at[held]
        for start in range(0, size, NODES):  # tallies of a few nodes at a time
            end = min(size, start + NODES)
            rows = slice(*np.searchsorted(at, [start, end]))
            tally = np.zeros((end - start, width, len(languages)))
            np.add.at(tally, (at[rows] - start, s[3][held[rows]], which[held[rows]]), n[held[rows]])
            total, distinct = tally.sum(axis=1, keepdims=True), (tally > 0).sum(axis=1, keepdims=True)
            shorter = base[None] if order == 0 else costs[np.array(parents[first + start:first + end], dtype=np.int64)]
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                costs[first + start:first + end] = np.where(tally > 0, -np.log2(tally / (total + distinct)), shorter + escape)
        first += size
    return Model(languages, symbols, contexts.reshape(-1), costs.reshape(-1, len(languages)))


def code_lengths(model: Model, text: str) -> np.ndarray:
    """Bits of the text under each language."""
    width = model.width
    s = np.concatenate([np.zeros(3, np.int32), model.symbols[np.frombuffer(text.encode(), np.uint8)]])
    bits = np.zeros(len(model.languages))
    for at in range(0, len(s) - 3, BLOCK):
        part = s[at:at + BLOCK + 3]
        node = model.contexts[(part[:-3] * width + part[1:-2]) * width + part[2:-1]]
        bits += model.costs[node * width + part[3:]].sum(axis=0, dtype=np.float64)
    return bits


def judge(model: Model, text: str) -> tuple[str, float, float]:
    """Language, its share of 2^-bits among all, and bits per byte."""
    if not model.languages or not (LATIN.search(text) or any(map(str.isalpha, text))):
        return UNDETERMINED, 0.0, 0.0
    bits = code_lengths(model, text)
    best = int(bits.argmin())
    return model.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()), float(bits[best] / max(1, len(text.encode())))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = per_text(lambda t: judge(shared.value, t), "lang_pred string, score double, bits_per_byte double")
    marked = docs.withColumn("_found", found(F.col(text)))
    return replace_columns(marked, {c: F.col(f"_found.{c}") for c in ("lang_pred", "score", "bits_per_byte")}).drop("_found")


def identify(docs: DataFrame) -> DataFrame:
    """Trained on the rows outside the held-out fold, applied to all of ``docs``."""
    model = train(docs.where(fold() != 2))
    return predict(replace_columns(docs, {"held_out": fold() == 2}), model)
