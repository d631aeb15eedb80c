"""Whitespace, casing and text comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stay upper case.
KEEP_UPPER = (
    "AG", "BOC", "CS", "DP", "DS", "GB", "HB", "JA", "JV", "PKSQ", "PS", "RT", "SB",
    "SCO", "SP", "TUX", "UW", "ZA",
)

ANY_SPACE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def normalize_spaces(value: Column) -> Column:
    return F.trim(F.regexp_replace(value.cast("string"), ANY_SPACE, " "))


def clean_text(value: Column) -> Column:
    """Collapse whitespace; blank becomes null."""
    return F.nullif(normalize_spaces(value), F.lit(""))


def first_nonempty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def distinct_in_order(values: Column) -> Column:
    return F.array_distinct(values)


def _stays_upper(word: Column) -> Column:
    return (
        word.rlike(r"\d")
        | F.upper(word).isin(*KEEP_UPPER)
        | word.rlike(r"^[A-Za-z]{1,2}$")
    )


def _capitalised(word: Column) -> Column:
    return F.when(_stays_upper(word), F.upper(word)).otherwise(
        F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))
    )


def _by_apostrophe(word: Column) -> Column:
    return F.when(_stays_upper(word), F.upper(word)).otherwise(
        F.array_join(F.transform(F.split(word, "'"), _capitalised), "'")
    )


def case_core(word: Column) -> Column:
    """Case one bare word: dotted parts, then apostrophe parts, then letters."""
    dotted = F.filter(F.split(word, r"\."), lambda p: p != "")
    return F.when(_stays_upper(word), F.upper(word)).otherwise(
        F.array_join(F.transform(dotted, _by_apostrophe), ".")
    )


# lead punctuation, word, trailing punctuation
_WORD = r"^([^A-Za-z0-9']*)([A-Za-z0-9'.]+)([^A-Za-z0-9']*)$"


def _case_piece(piece: Column) -> Column:
    lead, core, tail = (F.regexp_extract(piece, _WORD, i) for i in (1, 2, 3))
    capital = F.concat(F.upper(F.substring(piece, 1, 1)), F.lower(F.substring(piece, 2, 1 << 30)))
    # plain words of three letters or more are most words: one test, no further parts
    plain = F.when(F.upper(piece).isin(*KEEP_UPPER), F.upper(piece)).otherwise(capital)
    return (
        F.when(piece == " ", piece)
        .when(piece.rlike("^[A-Za-z]{3,}$"), plain)
        .when(piece.rlike(_WORD), F.concat(lead, let(core, case_core), tail))
        .otherwise(piece)
    )


def smart_title_case(value: Column) -> Column:
    """Word casing that keeps codes, short words and delimiters intact."""
    pieces = F.regexp_extract_all(normalize_spaces(value), F.lit(r"[ /&-]|[^ /&-]+"), 0)
    return F.array_join(F.transform(pieces, _case_piece), "")


def compare_text(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")


def contains_phrase(text: Column, phrase: Column) -> Column:
    return F.contains(compare_text(text), compare_text(phrase))


def singular(word: Column) -> Column:
    w = F.lower(word)
    n = F.length(w)
    return (
        F.when(w.endswith("ies") & (n > 4), F.concat(F.substring(w, 1, n - 3), F.lit("y")))
        .when(w.endswith("s") & (n > 3), F.substring(w, 1, n - 1))
        .otherwise(w)
    )


def letter_words(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z]+"), 0), singular)


def mentions_type(text: Column, phrase: Column) -> Column:
    return let(
        letter_words(phrase),
        lambda wanted: (F.size(wanted) > 0) & (F.size(F.array_except(wanted, letter_words(text))) == 0),
    )


def escape_html(value: Column) -> Column:
    out = value.cast("string")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


# Characters above U+00FF that the single-byte encoding holds.
CP1252_HIGH = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
# what is above ASCII comes first: of a negated list every member is tried on every plain character
_NOT_CP1252 = rf"[\x{{80}}-\x{{10FFFF}}&&[^\xa0-\xff{CP1252_HIGH}]]"


def has_unencodable(value: Column) -> Column:
    """Characters the encoding lacks; plain ASCII is decided by its length alone."""
    return (F.octet_length(value) != F.length(value)) & value.rlike(_NOT_CP1252)


def to_cp1252(value: Column) -> Column:
    """Unencodable characters become '?'. One character is one byte, so a
    text may be cut before it is converted. Plain ASCII stays as it is."""
    return F.when(F.octet_length(value) != F.length(value), F.regexp_replace(value, _NOT_CP1252, "?")).otherwise(value)
