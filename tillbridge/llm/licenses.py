"""License notices by exact set-similarity join, in DataFrame operations only.

A text is cut into blocks of 2 h words that overlap by half, so a template of up
to h words, repeats counted, lies whole inside some block. h is ``HALF``, doubled as
often as a template's words need; templates of one h share its blocks. A block meets
a template when it holds at least ``threshold`` of the template's distinct words.

The tokens of all templates are ordered by the number of blocks of the corpus
they stand in, rarest first. With n template tokens of which a must be present,
some block token is among the first n - a + 1 of the template (prefix filter);
blocks with under a known tokens cannot meet it (length filter); and after a
first common token at places i and j, no more than 1 + min(rest of template,
rest of block) can be common (positional filter). What remains is counted
exactly.

Defined results: null and empty texts have no words, no labels and score 0;
templates without words label nothing; repeated rows are judged one by one; extra columns are not read.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbridge.session import materialize

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HALF = 32
THRESHOLD = 0.85
MAX_TEMPLATE_WORDS = 20_000
#: Phrases that name a license.
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}
#: Public license notices.
TEMPLATES = {
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-notice": "this is free and unencumbered software released into the public domain",
}


def lowered(text: Column) -> Column:
    """A-Z in lower case. Only the Kelvin sign and the dotted capital I become ASCII letters in ``lower``; texts with them go letter by letter."""
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _places_of(words: Column, label: str, parts: list[str]) -> Column:
    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == w)
        return F.coalesce(found, F.lit(False))

    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), here)
    return F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.alias("start")))


def _phrase_places(words: Column) -> Column:
    """(label, start) of every place of every phrase."""
    none = F.array().cast("array<struct<label: string, start: int>>")
    phrases = [(label, phrase.split()) for label, phrase in PHRASES.items()]
    return F.concat(*[F.when(F.array_contains(words, parts[-1]), _places_of(words, label, parts)).otherwise(none) for label, parts in phrases])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    spark = docs.sparkSession
    texts = {label: [w for w in re.split(SEPARATOR, t.lower()) if w] for label, t in templates.items()}
    wanted = {label: tuple(dict.fromkeys(t)) for label, t in texts.items() if t}
    if sum(map(len, wanted.values())) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold at most {MAX_TEMPLATE_WORDS} distinct words together, the bound of what is broadcast")
    halves = {label: half_for(len(texts[label])) for label in wanted}
    least = {label: max(1, math.ceil(threshold * len(t) - 1e-9)) for label, t in wanted.items()}
    vocabulary = sorted({w for t in wanted.values() for w in t})
    words = F.array_remove(F.split(lowered(F.coalesce(F.col(text), F.lit(""))), SEPARATOR), "")

    def blocks_of(half: int) -> Column:
        """Blocks of 2 * half words, as the words that templates of this length have, where enough of them are."""
        own = [label for label in wanted if halves[label] == half]
        known = F.array(*[F.lit(w) for w in sorted({w for label in own for w in wanted[label]})])
        steps = F.sequence(F.lit(0), F.floor(F.greatest(F.size("_words") - 1, F.lit(0)) / half).cast("int"))
        blocks = F.transform(steps, lambda b: F.struct(F.lit(half).alias("half"), F.array_intersect(F.slice("_words", b * half + 1, 2 * half), known).alias("tokens")))
        return F.filter(blocks, lambda b: F.size(b["tokens"]) >= min(least[label] for label in own))

    none = F.array().cast("array<struct<half: int, tokens: array<string>>>")
    blocks = F.concat(none, *[blocks_of(half) for half in sorted(set(halves.values()))])
    read = (
        docs.select(F.col(doc_id).alias("doc_id"), words.alias("_words"))
        .select("doc_id", F.size("_words").cast("long").alias("n_words"), _phrase_places(F.col("_words")).alias("places"), blocks.alias("blocks"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    rows = materialize(read, "license-rows")  # stored, so that the row numbers stay put
    flat = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.half", "b.tokens")
    counts = {r["token"]: r["n"] for r in flat.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the vocabulary
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    found = _join(spark, flat, {label: sorted(t, key=order.__getitem__) for label, t in wanted.items()}, halves, least, order)
    met = found.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    starts = F.transform("places", lambda p: p["start"].cast("long"))
    return rows.join(met, "row", "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def half_for(words: int) -> int:
    """Half the length of the blocks that hold a template of so many words whole."""
    return HALF * 2 ** max(0, math.ceil(math.log2(words / HALF)))


def _join(spark, flat: DataFrame, ordered: dict[str, list[str]], halves: dict[str, int], least: dict[str, int], order: dict[str, int]) -> DataFrame:
    """(row, label, containment) of the blocks that meet a template."""
    # what is broadcast: templates by label, their prefix tokens and the ranks of all tokens, bounded by MAX_TEMPLATE_WORDS
    listed = F.from_json(F.lit(json.dumps([{"label": label, "half": halves[label], "least": least[label], "template": t} for label, t in ordered.items()])), "array<struct<label: string, half: int, least: int, template: array<string>>>")
    whole = spark.range(1).select(F.explode(listed).alias("t")).select("t.*")
    prefixes = whole.select("label", "half", "least", F.size("template").alias("size"), F.posexplode(F.slice("template", F.lit(1), F.size("template") - F.col("least") + 1)).alias("i", "token"))
    ranks = F.from_json(F.lit(json.dumps(order)), "map<string, int>")
    starters = F.from_json(F.lit(json.dumps(sorted({w for label, t in ordered.items() for w in t[:len(t) - least[label] + 1]}))), "array<string>")
    sorted_block = F.transform(F.array_sort(F.transform("tokens", lambda w: F.struct(F.element_at("ranks", w).alias("rank"), w.alias("token")))), lambda s: s["token"])
    candidates = (
        flat.where(F.arrays_overlap("tokens", starters)).withColumn("ranks", ranks).select("row", "half", sorted_block.alias("tokens"))
        .select("row", "half", "tokens", F.posexplode("tokens").alias("j", "token"))
        .join(F.broadcast(prefixes), ["half", "token"])
        .where(1 + F.least(F.col("size") - F.col("i") - 1, F.size("tokens") - F.col("j") - 1) >= F.col("least"))
        .join(F.broadcast(whole.select("label", "template")), "label")
        .where((F.col("i") == 0) | ~F.arrays_overlap(F.slice("template", 1, F.greatest(F.col("i"), F.lit(1))), "tokens"))
    )
    common = F.size(F.array_intersect("tokens", "template"))
    return candidates.where(common >= F.col("least")).select("row", "label", (common / F.size("template")).alias("containment"))
