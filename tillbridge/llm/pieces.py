"""SentencePiece encoding and decoding, with a max-plus scan over giant texts.

A byte-pair segmentation is the only path through the lattice of vocabulary
pieces whose neighbours all stand side by side when encoded alone. With 0 for
such a pair and minus infinity for any other, it is the best path in max-plus
algebra, so a giant text can be cut anywhere: the state at a cut is the piece
that covers the code point after it, a chunk's transfer matrix holds the score
from each state at its left cut to each at its right one, matrices multiply
associatively, and once the states at the cuts are known every chunk writes
its own pieces. Results equal those of the whole text.

A word (a run of spaces and what follows it) is encoded by the library on its
own, as no piece of the model has a space after another sign; the new words of
several texts go to it in one call and are kept. Inside a chunk the words next
to the cuts decide its matrix, and the whole chunk where it has no space at all.

Defined results: null and empty texts have no pieces; U+2581 counts as a space,
as in the library, and comes back as one; repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbridge.llm.common import SMALL_BATCH_BYTES, bound_batches, per_text
from tillbridge.session import materialize

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32_768
BLOCK = 64
KEPT_WORDS = 150_000
KEPT_SIZE = 48
TOGETHER = 50_000
SPACE = "▁"
WORD = re.compile(" +[^ ]*|[^ ]+")
NEVER = -np.inf


class Codec:
    """One model with its caches."""

    def __init__(self, proto: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = self.processor.get_piece_size()
        names = [self.processor.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.processor.is_byte(i) or self.processor.is_control(i) or self.processor.is_unknown(i))]
        self.numbers = {names[i]: i for i in plain}
        self.longest = max((len(n) for n in self.numbers), default=1)
        self.guard = next(c for c in ("\n", "\t", "\x01", "\x02") if not any(c in n for n in self.numbers))
        self.skipped = len(self.processor.encode(self.guard))
        if any(SPACE in n.lstrip(SPACE) for n in self.numbers):
            raise ValueError("the model has pieces with a space after another sign")
        self.bytes = [n.replace(SPACE, " ").encode() for n in names]
        for i in range(size):
            if self.processor.is_byte(i):
                self.bytes[i] = bytes([int(names[i][3:5], 16)])
            elif self.processor.is_control(i):
                self.bytes[i] = b""
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def raw(text: str) -> str:
        """The string that is segmented: a space before, spaces as U+2581."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        guarded = [self.guard + w for w in words]
        if len(words) < 8:  # a call with a list starts a thread
            found = [self.processor.encode(g, num_threads=1) for g in guarded]
        else:
            found = self.processor.encode(guarded, num_threads=1)
        return {w: array("i", ids[self.skipped:]).tobytes() for w, ids in zip(words, found)}

    def _look_up(self, words: set[str]) -> dict[str, bytes]:
        """Piece numbers of each word; at least the last KEPT_WORDS short ones that were met are not encoded again."""
        if len(self.kept) >= KEPT_WORDS:
            self.older, self.kept = self.kept, {}
        kept, older, held, new = self.kept, self.older, {}, []
        for word in words:
            data = kept.get(word)
            if data is None:
                data = older.get(word)
                if data is None:
                    new.append(word)
                    continue
                kept[word] = data
            held[word] = data
        if new:
            encoded = self._encode(new)
            held.update(encoded)
            kept.update((w, data) for w, data in encoded.items() if len(w) <= KEPT_SIZE)
        return held

    def segments(self, raws: list[str]) -> list[np.ndarray]:
        """Piece numbers of raw strings or of parts of them between piece ends."""
        words = [WORD.findall(raw.replace(SPACE, " ")) for raw in raws]
        held = self._look_up(set().union(*words))
        return [np.frombuffer(b"".join(map(held.__getitem__, w)), np.int32) for w in words]

    def segment(self, raw: str) -> np.ndarray:
        return self.segments([raw])[0]

    def decode(self, ids) -> str:
        """The text of the numbers, without the space that encoding puts before it."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        return data.decode(errors="replace")[1:] if data[:1] == b" " else data.decode(errors="replace")

    def read_back(self, ids: list[np.ndarray], texts: list[str]) -> list[pa.Array]:
        """Digest of what each row of numbers decodes to, and whether that is the text."""
        digests, exact = [], []
        for numbers, text in zip(ids, texts):
            decoded = self.decode(numbers.tolist())
            digests.append(hashlib.sha256(decoded.encode()).hexdigest())
            exact.append(decoded == text)
        return [pa.array(digests, pa.string()), pa.array(exact, pa.bool_())]

    def states(self, left: str, right: str) -> list[tuple[int, int]]:
        """(start, end) relative to a cut of all pieces that cover the sign after it, in a fixed order."""
        text, cut = left + right, len(left)
        found = [
            (s - cut, e - cut)
            for s in range(max(0, cut - self.longest + 1), cut + 1)
            for e in range(cut + 1, min(len(text), s + self.longest) + 1)
            if text[s:e] in self.numbers or e - s == 1
        ]
        return sorted(found)

    def begins(self, piece: str, rest: str) -> bool:
        return self._same(self.segment(piece + rest)[:self._size(piece)], piece)

    def ends(self, rest: str, piece: str) -> bool:
        return self._same(self.segment(rest + piece)[-self._size(piece):], piece)

    def _size(self, piece: str) -> int:
        return 1 if piece in self.numbers else len(self.segment(piece))

    def _same(self, ids: np.ndarray, piece: str) -> bool:
        return ids.tolist() == ([self.numbers[piece]] if piece in self.numbers else self.segment(piece).tolist())

    def transfer(self, before: str, body: str, after: str) -> np.ndarray:
        """Scores from the states at the left cut to those at the right one; one state at an end of the text."""
        text, left, right = before + body + after, len(before), len(before) + len(body)
        entries = [(left + s, left + e) for s, e in self.states(before, (body + after)[:self.longest])] if before else [(0, 0)]
        exits = [(right + s, right + e) for s, e in self.states((before + body)[-self.longest:], after)] if after else [(right, right)]
        latest = max(e for _, e in entries)
        soonest = min(s for s, _ in exits)
        cuts = [m.start() + 1 for m in re.finditer(f"[^{SPACE}](?={SPACE})", text[latest:soonest])]
        scores = np.full((len(entries), len(exits)), NEVER)
        if cuts:
            first, last = latest + cuts[0], latest + cuts[-1]
            head = [not before or self.begins(text[s:e], text[e:first]) for s, e in entries]
            tail = [not after or self.ends(text[last:s], text[s:e]) for s, e in exits]
            scores[np.ix_(head, tail)] = 0.0
            return scores
        for i, (s, e) in enumerate(entries):
            for j, (s2, e2) in enumerate(exits):
                if before and after and (s, e) == (s2, e2):
                    scores[i, j] = 0.0
                elif e <= s2:
                    whole = self.segment(text[s:e2])
                    fits = (not before or self._same(whole[:self._size(text[s:e])], text[s:e])) and (not after or self._same(whole[-self._size(text[s2:e2]):], text[s2:e2]))
                    scores[i, j] = 0.0 if fits else NEVER
        return scores

    def backtrace(self, before: str, body: str, after: str, entry: int, leave: int) -> np.ndarray:
        """The pieces that start in the chunk, for the states at its cuts."""
        text, left, right = before + body + after, len(before), len(before) + len(body)
        parts, begin, stop = [], 0, right
        if before:
            s, e = self.states(before, (body + after)[:self.longest])[entry]
            begin = left + e
            if s == 0:
                parts.append(self.segment(text[left:begin]))
        if after:
            s, e = self.states((before + body)[-self.longest:], after)[leave]
            stop = right + s
            if begin > stop:  # one piece covers both cuts
                return np.concatenate([*parts, np.zeros(0, np.int32)])
            parts.append(self.segment(text[begin:stop]))
            if s < 0:
                parts.append(self.segment(text[stop:right + e]))
        else:
            parts.append(self.segment(text[begin:stop]))
        return np.concatenate(parts).astype(np.int32)


_codecs: dict[str, Codec] = {}


class Shared:
    """A model's bytes for the tasks; each Python worker builds its codec once."""

    def __init__(self, context: SparkContext, path: str):
        with open(path, "rb") as source:
            proto = source.read()
        self.key, self.proto = hashlib.md5(proto).hexdigest(), context.broadcast(proto)

    def codec(self) -> Codec:
        if self.key not in _codecs:
            _codecs[self.key] = Codec(self.proto.value)
        return _codecs[self.key]


def as_lists(ids: list[np.ndarray]) -> pa.ListArray:
    """Arrays of piece numbers as one Arrow column, copied as buffers and not number by number."""
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs that end at TOGETHER code points."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield run
            run, size = [], 0
    if run:
        yield run


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(axis=1)


def _pack(m: np.ndarray) -> bytes:
    return np.array(m.shape, np.int32).tobytes() + m.astype(np.float64).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    shape = np.frombuffer(data[:8], np.int32)
    return np.frombuffer(data[8:], np.float64).reshape(shape)


def best_states(matrices: list[np.ndarray], entry: int, leave: int) -> list[tuple[int, int]]:
    """The (left, right) states of each matrix on the best path from ``entry`` to ``leave``."""
    onward = [np.where(np.arange(matrices[-1].shape[1]) == leave, 0.0, NEVER)]
    for m in reversed(matrices):
        onward.append((m + onward[-1][None]).max(axis=1))
    onward.reverse()
    out, at = [], entry
    for m, rest in zip(matrices, onward[1:]):
        following = int((m[at] + rest).argmax())
        out.append((at, following))
        at = following
    return out


KEYS = ["doc_id", "text_key"]


def _scan(giants: DataFrame, shared: Shared, chunk: int) -> DataFrame:
    """doc_id, text_key, pieces of giant texts, chunk by chunk."""
    spark = giants.sparkSession

    def cut(text: str) -> tuple[list]:
        raw, m = Codec.raw(text), shared.codec().longest
        return ([(raw[max(0, i - m):i], raw[i:i + chunk], raw[i + chunk:i + chunk + m]) for i in range(0, len(raw), chunk)],)

    parts = per_text(cut, "chunks array<struct<before: string, body: string, after: string>>")
    chunks = giants.select(*KEYS, F.posexplode(parts(F.col("text"))["chunks"]).alias("chunk", "_c")).select(*KEYS, "chunk", F.floor(F.col("chunk") / BLOCK).cast("int").alias("block"), "_c.*")

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = shared.codec()
        for batch in batches:
            yield batch.assign(matrix=[_pack(codec.transfer(*t)) for t in zip(batch["before"], batch["body"], batch["after"])])

    plain = "doc_id long, text_key long, chunk int, block int"
    spread = chunks.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *KEYS, "chunk")
    held = materialize(spread.mapInPandas(transfers, f"{plain}, before string, body string, after string, matrix binary"), "piece-chunks")

    def combine(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("chunk")
        product = _unpack(ordered["matrix"].iloc[0])
        for data in ordered["matrix"].iloc[1:]:
            product = multiply(product, _unpack(data))
        return ordered.iloc[:1].assign(matrix=_pack(product))[["doc_id", "text_key", "block", "matrix"]]

    def enter(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("block")
        path = best_states([_unpack(m) for m in ordered["matrix"]], 0, 0)
        return ordered.assign(entry=[a for a, _ in path], leave=[b for _, b in path])[["doc_id", "text_key", "block", "entry", "leave"]]

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("chunk")
        path = best_states([_unpack(m) for m in ordered["matrix"]], int(ordered["entry"].iloc[0]), int(ordered["leave"].iloc[0]))
        return ordered.assign(entry=[a for a, _ in path], leave=[b for _, b in path])[["doc_id", "text_key", "chunk", "entry", "leave"]]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for batch in batches:
            rows = zip(*(batch[name].to_pylist() for name in ("before", "body", "after", "entry", "leave")))
            columns = [batch[name] for name in ("doc_id", "text_key", "chunk")] + [as_lists([codec.backtrace(*r) for r in rows])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "chunk", "pieces"])

    small = held.select(*KEYS, "chunk", "block", "matrix")
    products = small.groupBy(*KEYS, "block").applyInPandas(combine, "doc_id long, text_key long, block int, matrix binary")  # BLOCK matrices a group
    borders = products.groupBy(*KEYS).applyInPandas(enter, "doc_id long, text_key long, block int, entry int, leave int")
    inner = small.withColumn("doc", F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).join(
        borders.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("doc"), "text_key", "block", "entry", "leave"), ["doc", "text_key", "block"])
    states = inner.groupBy(*KEYS, "block").applyInPandas(settle, "doc_id long, text_key long, chunk int, entry int, leave int")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")) & (F.col("a.chunk") == F.col("b.chunk"))
    settled = held.alias("a").join(states.alias("b"), same).select("a.doc_id", "a.text_key", "a.chunk", "before", "body", "after", "entry", "leave")
    written = settled.mapInArrow(write, "doc_id long, text_key long, chunk int, pieces array<int>")
    return written.groupBy(*KEYS).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "pieces"))), lambda c: c["pieces"])).alias("pieces"))


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, n_chunks, n_pieces, pieces, decoded_sha256 and exact (decoding gives the text back).

    Texts of up to ``chunk`` code points are encoded where they are read; longer
    ones go through the scan, copies of one row together.
    """
    bound_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    shared = Shared(docs.sparkSession.sparkContext, model)

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = shared.codec()
        for column in batches:
            texts = [t or "" for t in column.to_pylist()]
            ids = [i for run in together(texts) for i in codec.segments([Codec.raw(t) for t in run])]
            yield pa.StructArray.from_arrays([as_lists(ids), *codec.read_back(ids, texts)], ["pieces", "decoded_sha256", "exact"])

    fields = "pieces: array<int>, decoded_sha256: string, exact: boolean"
    size = F.length(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("n_chars", size.cast("long"))
    results = ["doc_id", "n_chars", "n_chunks", "n_pieces", "pieces", "decoded_sha256", "exact"]
    short = rows.where(F.col("n_chars") <= chunk).select("doc_id", "n_chars", F.lit(1).cast("long").alias("n_chunks"), F.arrow_udf(both, f"struct<{fields}>")(F.col("text")).alias("_x"))
    short = short.select("*", "_x.*").withColumn("n_pieces", F.size("pieces").cast("long")).select(*results)
    # checkpointed by writing: the copies of a giant row are counted, its text is kept once
    giants = materialize(rows.where(F.col("n_chars") > chunk).groupBy("doc_id", F.xxhash64("text").alias("text_key")).agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"), F.first("n_chars").alias("n_chars")), "piece-giants")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for batch in batches:
            ids = [row.values.to_numpy() for row in batch["pieces"]]
            columns = [batch[name] for name in ("doc_id", "n_chars", "copies", "pieces")] + codec.read_back(ids, batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "copies", "pieces", "decoded_sha256", "exact"])

    a, b = giants.alias("a"), _scan(giants.select(*KEYS, "text"), shared, chunk).alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    long = a.join(b, same).select("a.doc_id", "a.n_chars", "a.copies", "a.text", "b.pieces").mapInArrow(back, f"doc_id: long, n_chars: long, copies: long, {fields}")
    long = long.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    long = long.withColumn("n_chunks", F.ceil((F.col("n_chars") + 1) / chunk).cast("long")).withColumn("n_pieces", F.size("pieces").cast("long")).select(*results)
    return short.unionByName(long)


def decode(encoded: DataFrame, pieces: str = "pieces", model: str = MODEL) -> DataFrame:
    """``encoded`` with decoded, the text of its piece numbers (null: empty)."""
    shared = Shared(encoded.sparkSession.sparkContext, model)
    text = F.pandas_udf(lambda column: column.map(lambda ids: "" if ids is None else shared.codec().decode(list(ids))), "string")
    return encoded.withColumn("decoded", text(F.col(pieces)))
