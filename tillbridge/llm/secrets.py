"""Secrets in texts: three plain kinds, and weak candidates confirmed by their complement.

A credential has parts: an access identifier, a secret, an endpoint. Alone a
weak part (an account name, a mixed token, a URL) means nothing. Within a scope
(a block of text between blank lines) parts that stand at most ``REACH`` code
points apart are joined, and a weak part is reported only when its complement
is there: an identifier beside a secret, a secret beside an identifier, an
endpoint beside both. One string is not its own complement: only parts that do
not overlap confirm each other, the identifier and the secret beside an endpoint
do not overlap either, a token that is the value of an identifier is no secret,
and an identifier whose value runs into an endpoint ends where that ends. The
interval join is two range frames over the starts and ends of a scope's parts in
one order, one over the ends before a start and one over the starts after an end;
no pairs are made.

Defined results: a null or empty text has no spans; equal rows give equal
results, one per row; a null id is an id of its own. Weak parts that overlap a
plain match are left out. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbridge.llm.common import bound_batches, per_text

REACH = 240
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # the run is maximal, so a minimum inside is the same as one after
HEX = re.compile(r"[0-9a-f]{32,}")
IDENTITY = re.compile(r"""(?:access_?key_?id|client_?id|account(?:_?id)?|user(?:_?name|_?id)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}""", re.A | re.I)
MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]+|(?:host|server|endpoint|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}""", re.A)
BLANK = re.compile(r"\n[\x20\t\r]*\n")
KEYS = ("password", "passwd", "secret", "token", "api")
IDENTITY_KEYS = ("client", "account", "user", "login", "access")
ENDPOINT_KEYS = ("://", "host", "server", "endpoint", "region")
KINDS = ("assign", "access", "hex", "identity", "mixed", "short", "endpoint")  # order inside equal starts
IDENTIFIER, SECRET, PLACE = 0, 1, 2
CLASS = (SECRET, IDENTIFIER, SECRET, IDENTIFIER, SECRET, SECRET, PLACE)
SPAN = "struct<start: int, kind: int, end: int>"
PART = "struct<start: int, kind: int, end: int, scope: int, class: int, reached: int>"


def parts(text: str) -> tuple[list, list]:
    """Plain spans by (start, kind), and all parts with their scope if any of them is weak."""
    lowered = text.lower()
    base, weak = [], []
    if any(k in lowered for k in KEYS):
        for m in ASSIGN.finditer(text):
            size = m.end(2) - m.start(2)
            if size >= 8:
                base.append((m.start(), 0, m.end()))
            elif size >= 4:
                weak.append((m.start(), 5, m.end()))
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    identities = [(m.start(), 3, m.end()) for m in IDENTITY.finditer(text)] if any(k in lowered for k in IDENTITY_KEYS) else []
    places = [(m.start(), 6, m.end()) for m in ENDPOINT.finditer(text)] if any(k in text for k in ENDPOINT_KEYS) else []
    weak += identities
    if identities or places or any(k == 1 for _, k, _ in base):  # without an identifier or endpoint no mixed token can be confirmed
        weak += unlabelled([(m.start(), 4, m.end()) for m in MIXED.finditer(text) if mixed(m[0])], identities)
    weak += places
    base.sort()
    weak = outside(sorted(weak), base)
    if not weak:
        return base, []
    breaks = [m.start() for m in BLANK.finditer(text)]
    scope, place, rows = 0, 0, []
    for start, kind, end in sorted(base + weak):
        while scope < len(breaks) and breaks[scope] < start:
            scope += 1
        reached = end
        if kind == 3:  # the value of an identifier may be an endpoint
            while place < len(places) and places[place][0] < start:
                place += 1
            if place < len(places) and places[place][0] < end:
                reached = max(end, places[place][2])
        rows.append((start, kind, end, scope, CLASS[kind], reached))
    return base, rows


def mixed(token: str) -> bool:
    """Upper case, lower case and digits together."""
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


def unlabelled(tokens: list, identities: list) -> list:
    """Those of the sorted ``tokens`` that do not start inside an identifier, as its value does."""
    kept, at = [], 0
    for token in tokens:
        while at < len(identities) and identities[at][2] <= token[0]:
            at += 1
        if at == len(identities) or identities[at][0] > token[0]:
            kept.append(token)
    return kept


def outside(spans: list, taken: list) -> list:
    """Those of the sorted ``spans`` that overlap none of ``taken``."""
    edges: list[list[int]] = []
    for start, _, end in sorted(taken):
        if edges and start <= edges[-1][1]:
            edges[-1][1] = max(edges[-1][1], end)
        else:
            edges.append([start, end])
    kept, at = [], 0
    for span in spans:
        while at < len(edges) and edges[at][1] <= span[0]:
            at += 1
        if at == len(edges) or edges[at][0] >= span[2]:
            kept.append(span)
    return kept


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: its id, text_key, counts of plain kinds, n_linked and the two span lists.

    Rows of equal id and text are counted first (combined before the shuffle), so
    copies of one row are one group member however many there are.
    """
    bound_batches(docs.sparkSession)
    extract = per_text(parts, f"base array<{SPAN}>, parts array<{PART}>")
    keys = [doc_id, "text_key"]
    read = docs.select(F.col(doc_id), F.xxhash64(F.col(text)).alias("text_key"), extract(F.col(text)).alias("_x"))
    rows = read.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.first("_x").alias("_x"))
    flat = rows.select(*keys, "_rows", F.col("_x.base").alias("base"), F.explode_outer("_x.parts").alias("_p")).select(*keys, "_rows", "base", "_p.*")
    edge = lambda at, is_end: F.struct(F.col(at).alias("at"), F.lit(is_end).alias("is_end"))
    edges = flat.withColumn("_e", F.explode(F.array(edge("start", False), edge("reached", True)))).select("*", "_e.*").drop("_e")
    edges = edges.withColumn("base", F.when(~F.col("is_end"), F.col("base")))
    ordered = Window.partitionBy(*keys, "scope").orderBy("at")
    frames = {"before": (ordered.rangeBetween(-reach, 0), F.col("is_end")), "after": (ordered.rangeBetween(0, reach), ~F.col("is_end"))}

    def near(side: str, which: int) -> Column:
        """First end and last start of the parts of a class on one side, null without any."""
        frame, counted = frames[side]
        of_class = counted & (F.col("class") == which)
        return F.struct(F.min(F.when(of_class, F.col("reached"))).over(frame).alias("end"), F.max(F.when(of_class, F.col("start"))).over(frame).alias("start"))

    def seen(side: str) -> list[Column]:
        """What a part has on one side: an identifier, a secret, and both without an overlap."""
        name, secret = F.col(f"_{side}_id"), F.col(f"_{side}_secret")
        # an edge looks back from a start and ahead from an end
        mine = F.col("is_end") if side == "after" else ~F.col("is_end")
        apart = (name["end"] <= secret["start"]) | (secret["end"] <= name["start"])
        flags = {"id": name["end"].isNotNull(), "secret": secret["end"].isNotNull(), "both": apart}
        return [F.max(F.coalesce(mine & f, F.lit(False))).alias(f"{side}_{n}") for n, f in flags.items()]

    looked = edges.select("*", *[near(s, c).alias(f"_{s}_{n}") for s in frames for n, c in (("id", IDENTIFIER), ("secret", SECRET))])
    beside = looked.groupBy(*keys, "scope", "start", "kind", "end", "class").agg(
        F.first("_rows").alias("_rows"), F.first("base", ignorenulls=True).alias("base"), *seen("before"), *seen("after"),
    ).select(
        *keys, "_rows", "base", "start", "kind", "end", "class",
        (F.col("before_id") | F.col("after_id")).alias("_id"), (F.col("before_secret") | F.col("after_secret")).alias("_secret"),
        (F.col("before_both") | F.col("after_both") | (F.col("before_id") & F.col("after_secret")) | (F.col("before_secret") & F.col("after_id"))).alias("_both"),
    )
    linked = (
        F.when(F.col("kind") < 3, False)
        .when(F.col("class") == IDENTIFIER, F.col("_secret"))
        .when(F.col("class") == SECRET, F.col("_id"))
        .otherwise(F.col("_both"))
    )
    found = beside.groupBy(*keys).agg(
        F.first("_rows").alias("_rows"), F.first("base").alias("base"),
        F.collect_list(F.when(linked, F.struct("start", "kind", "end"))).alias("linked"),
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    result = found.select(
        *keys,
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.size("linked").cast("long").alias("n_linked"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        F.array_sort(F.concat("base", "linked")).alias("secret_spans"),
        F.explode(F.sequence(F.lit(1), F.col("_rows"))).alias("_copy"),
    ).drop("_copy")
    return result.withColumn("spans", _joined(F.col("secret_spans")))


def mask(text: str | None, spans: list | None) -> str | None:
    """The text with each merged run of spans replaced by [secret]."""
    if text is None or spans is None or not len(spans):
        return text
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with secrets masked in ``text``; all rows and columns stay.

    Only the spans of texts that have some are joined back.
    """
    hits = find(docs, doc_id, text).where(F.size("secret_spans") > 0).groupBy(doc_id, "text_key").agg(F.first("secret_spans").alias("_spans"))
    hits = hits.withColumnRenamed(doc_id, "_hit_id").withColumnRenamed("text_key", "_hit_key")
    masked = F.pandas_udf(lambda texts, spans: pd.Series([mask(t, s) for t, s in zip(texts, spans)], dtype=object), "string")
    joined = docs.join(hits, F.col(doc_id).eqNullSafe(F.col("_hit_id")) & (F.xxhash64(F.col(text)) == F.col("_hit_key")), "left")
    return joined.withColumn(text, masked(F.col(text), F.col("_spans"))).select(*docs.columns)
