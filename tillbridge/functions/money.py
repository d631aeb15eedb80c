"""Money and quantities. Till side rounds half-even, storefront side half-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,10)"
MONEY = "decimal(18,2)"


def decimal_or_none(value: Column) -> Column:
    return text_decimal(value.cast("string"))


def text_decimal(text: Column) -> Column:
    """Number of a text, to ten decimals; what lies beyond them shows as a last digit 1, so rounding it to fewer places is exact."""
    return F.regexp_replace(text, r"(\.\d{9})(?=\d{2})\d*[1-9]\d*$", "$11").try_cast(EXACT)


def till_money(value: Column) -> Column:
    """Two places, half-even."""
    return F.bround(value.cast(EXACT), 2).cast(MONEY)


def shop_money(value: Column) -> Column:
    """Two places, half-up."""
    return F.round(value.cast(EXACT), 2).cast(MONEY)


def money_text(value: Column) -> Column:
    """Till money as text; text that is not a number passes through."""
    text = F.nullif(value.cast("string"), F.lit(""))
    return F.coalesce(till_money(text_decimal(text)).cast("string"), text)


def nonzero_money_text(value: Column) -> Column:
    number = decimal_or_none(value)
    return F.when(number != 0, till_money(number).cast("string"))


def nonzero_or_text(value: Column) -> Column:
    """Null when zero; formatted when numeric; cleaned text otherwise."""
    from tillbridge.functions.text import clean_text

    number = decimal_or_none(value)
    return F.when(number.isNull(), clean_text(value)).otherwise(nonzero_money_text(value))


def stock_quantity(value: Column) -> Column:
    """Floor, then clamp at zero; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.floor(value).cast("int")))


def as_number(value: Column) -> tuple[Column, Column]:
    """(number, is_bad): blanks are null, unparseable text is flagged."""
    text = F.nullif(value, F.lit(""))
    number = text.try_cast("double")
    return number, text.isNotNull() & number.isNull()


def as_whole(value: Column) -> tuple[Column, Column]:
    number, bad = as_number(value)
    whole = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("bigint")
    return whole, bad


def as_flag(value: Column) -> tuple[Column, Column]:
    text = F.nullif(F.lower(F.trim(value)), F.lit(""))
    flag = F.when(text.isin("1", "true", "yes", "y", "on"), True).when(
        text.isin("0", "false", "no", "n", "off"), False
    )
    return flag, text.isNotNull() & flag.isNull()
