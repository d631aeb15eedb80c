"""Helpers shared by the corpus operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BATCH_BYTES = 16 << 20
SMALL_BATCH_BYTES = 4 << 20  # where each word of a text becomes an object or two


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Arrow batches end at ``limit`` bytes, so that long texts do not meet by the ten thousand in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def per_text(fn: Callable[[str], tuple], fields: str) -> Callable[[Column], Column]:
    """Column function in Arrow batches: ``fn`` of each text (null: empty) as a struct of ``fields``."""
    schema = T._parse_datatype_string(fields)
    names = schema.names

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [fn("" if t is None else t) for t in texts]
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def plain_fold(doc_id: object) -> int:
    """The same fold in Python, for tests."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4


def replace_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, in place of any that have their names."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], *[c.alias(n) for n, c in columns.items()])


def bounded_share(counts: dict, limit: int) -> dict:
    """Share of each class's rows that leaves ``limit`` expected rows of it."""
    return {k: min(1.0, limit / n) for k, n in counts.items() if n}


def drawn(key: Column, share: Column, seed: int) -> Column:
    """Whether a row is in the sample: decided by its id alone, so a rerun draws the same rows."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_003)) < share * F.lit(1_000_003)
