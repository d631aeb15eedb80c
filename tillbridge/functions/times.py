"""Observation times kept as text and compared in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("timestamp")


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def is_newer(candidate: Column, current: Column) -> Column:
    """Anything beats a blank; unparseable text compares as text."""
    c, k = parse_time(candidate), parse_time(current)
    return (
        F.when(_blank(current), True)
        .when(c.isNotNull() & k.isNotNull(), c > k)
        .otherwise(F.coalesce(candidate, F.lit("")) > current)
    )


def is_older(candidate: Column, current: Column) -> Column:
    """Nothing is older when either side is blank."""
    c, k = parse_time(candidate), parse_time(current)
    return (
        F.when(_blank(candidate) | _blank(current), False)
        .when(c.isNotNull() & k.isNotNull(), c < k)
        .otherwise(candidate < current)
    )
