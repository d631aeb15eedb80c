"""Text quality by compression with two dictionaries.

Zstandard dictionaries are built from good and from bad labelled text. A text is
cut into pieces of ``PIECE`` bytes, so that the dictionary and not the text's
own past decides, and each piece is compressed under both. The difference of
the two sizes over the text's length is a margin; a logistic curve fitted on
other labelled rows turns it into a score.

Defined results: a null or empty text has margin 0; without both labels the
score is 0.5. Extra columns stay, but for those with the names of the results.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.llm.common import bound_batches, bounded_share, drawn, fold, per_text, replace_columns
from tillbridge.session import materialize

PIECE = 512
PIECES_PER_TEXT = 8
ROWS_PER_LABEL = 2000
DICTIONARY_BYTES = 32_768
LEVEL = 3
THRESHOLD = 0.7
_local = threading.local()


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def pieces(data: bytes) -> list[bytes]:
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """At most PIECES_PER_TEXT pieces of each text, evenly spread over all of it."""
    for batch in batches:
        rows = []
        for label, text in zip(batch["label"], batch["text"]):
            cut = pieces(text.encode())
            step = max(1, -(-len(cut) // PIECES_PER_TEXT))
            rows += [(label, p) for p in cut[::step]]
        yield pd.DataFrame(rows, columns=["label", "piece"])


def _compressors(model: Model) -> tuple[zstandard.ZstdCompressor, ...]:
    """One pair per thread, kept while the model stays the same."""
    held = getattr(_local, "held", None)
    if held is None or held[0] is not model:
        made = tuple(zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in (model.good, model.bad))
        held = _local.held = (model, made)
    return held[1]


def margin(model: Model, text: str) -> float:
    """(bytes under the bad dictionary - bytes under the good one) / bytes of the text."""
    data = text.encode()
    if not data or not model.good or not model.bad:
        return 0.0
    good, bad = _compressors(model)
    cut = pieces(data)
    return (sum(len(bad.compress(p)) for p in cut) - sum(len(good.compress(p)) for p in cut)) / len(data)


def dictionary(parts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; too few parts to train on serve as they are."""
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset of a lightly damped logistic fit, both labels weighing the same."""
    scale = float(np.abs(x).mean()) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 0.01 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id",
          rows_per_label: int = ROWS_PER_LABEL, seed: int = 7) -> Model:
    """Dictionaries from about ``rows_per_label`` rows of each label, the curve from as many others.

    ``labels`` has one row per ``key``. Its sample is drawn by a hash of the key,
    so it has about 4 x rows_per_label rows and is broadcast. What reaches the
    driver is PIECES_PER_TEXT pieces, or one margin, of each sampled text.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Model(b"", b"", 0.0, 0.0)
    share = F.create_map(*[F.lit(x) for pair in sorted(bounded_share(counts, 2 * rows_per_label).items()) for x in pair])[F.col("label")]
    drawn_labels = known.where(drawn(F.col("key"), share, seed))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    sample = materialize(texts.join(F.broadcast(drawn_labels), "key"), "quality-sample")
    half = F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(2))
    parts = sample.where(half == 0).select("label", "text").mapInPandas(_spread, "label int, piece binary").toPandas()
    parts = parts.assign(rank=parts["piece"].map(lambda p: hashlib.md5(p).digest())).sort_values(["label", "rank"])
    made = {q: dictionary([bytes(p) for p in parts["piece"][parts["label"] == q]]) for q in (0, 1)}
    raw = Model(made[1], made[0], 0.0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    measure = per_text(lambda t: (margin(shared.value, t),), "margin double")
    seen = sample.where(half == 1).select("label", measure(F.col("text"))["margin"].alias("margin")).toPandas()
    slope, offset = logistic(seen["margin"].to_numpy(float), seen["label"].to_numpy(float))
    return Model(raw.good, raw.bad, slope, offset)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with margin, score (0 to 1) and predicted (1 from ``threshold`` on)."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    measure = per_text(lambda t: (margin(shared.value, t),), "margin double")
    marked = docs.withColumn("_margin", measure(F.col(text))["margin"])
    curve = F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.lit(700.0), -(F.col("_margin") * F.lit(model.slope) + F.lit(model.offset)))))
    marked = marked.withColumn("_score", curve)
    columns = {"margin": F.col("_margin"), "score": F.col("_score"), "predicted": (F.col("_score") >= threshold).cast("int")}
    return replace_columns(marked, columns).drop("_margin", "_score")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels outside the held-out fold and scores all of ``docs``."""
    known = labels.where((fold() != 2) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    model = train(docs, known)
    return score(replace_columns(docs, {"held_out": fold() == 2}), model)
