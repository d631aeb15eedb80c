"""Fixed-width DBF tables as a Spark data source.

Batch: files split into record ranges; a pushed equality or IN filter on one
text field is tested before anything else is decoded; ``columns`` limits what
is decoded at all. Stream: physical record numbers are the offsets. Write: one
file per task, renamed into place on commit.

Options: ``path`` (file or folder), ``table`` (file stem, any case), ``columns``,
``encoding``, ``mode`` (lenient or strict), ``keepRaw``, ``splitRecords``,
``layout`` (``NAME:TYPE:WIDTH[:DECIMALS];...``; required to write, checked by
strict reads), ``startingRecord`` (stream: ``end`` or a number), ``compression``
(``zstd``: files are written and found as ``.dbf.zst``, the same bytes in frames
with a seek table, which record ranges are read from; blank fields cost no disk).

Lenient numbers have the declared scale. Text that this does not hold as it is
(more decimals, a larger number, no number) is in ``_raw_`` and the field's name:
by default, but for reads that name their ``columns``, which ask by ``keepRaw``.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import date, datetime
from decimal import ROUND_HALF_EVEN, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition,
    WriterCommitMessage,
)

from tillbridge.sources.frames import FrameReader, FrameWriter

VERSION, FIELD_END, FILE_END, LIVE, DELETED = 0x03, 0x0D, 0x1A, 0x20, 0x2A
BATCH_RECORDS = 65_536
SPLIT_RECORDS = 1_000_000
PACKED = ".zst"


class DbfError(ValueError):
    """The file breaks a rule of the format."""


@dataclass(frozen=True)
class DbfField:
    name: str
    kind: str
    width: int
    decimals: int = 0


@dataclass(frozen=True)
class DbfHeader:
    version: int
    records: int
    header_length: int
    record_length: int
    fields: tuple[DbfField, ...]


@dataclass
class RecordRange(InputPartition):
    path: str
    start: int
    stop: int
    last: bool = False
    reset: bool = False


def resolve(spark: SparkSession, path: str) -> str:
    """The path with the file system Spark would resolve it on; local ones stay plain."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return path if full.startswith("file:") else full


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path inside it. Tasks know no default one: without a scheme it is the local disk (see ``resolve``)."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@contextmanager
def open_dbf(path: str) -> Iterator[pa.NativeFile | FrameReader]:
    """The file for reading; of a compressed one, the plain file in it."""
    fs, p = open_fs(path)
    with fs.open_input_file(p) as handle:
        if p.lower().endswith(PACKED):
            try:
                handle = FrameReader(handle, p)
            except ValueError as problem:
                raise DbfError(str(problem)) from None
        yield handle


def file_ending(compression: str | None) -> str:
    if compression not in (None, "zstd"):
        raise DbfError(f"compression {compression} is not known")
    return f".dbf{PACKED}" if compression else ".dbf"


def find_files(path: str, table: str | None = None, compression: str | None = None) -> list[str]:
    """DBF files under a path, plain or compressed ones; a table name must mean one file."""
    ending = file_ending(compression)
    fs, root = open_fs(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [path]
    prefix = path.rstrip("/").removesuffix(root.rstrip("/"))  # what the listing leaves out of its paths
    found = sorted(
        (prefix + i.path for i in fs.get_file_info(pafs.FileSelector(root, recursive=True))
         if i.type == pafs.FileType.File and i.path.lower().endswith(ending)),
        key=str.lower,
    )
    if table:
        stem = table.lower().removesuffix(ending).removesuffix(".dbf")
        found = [p for p in found if p.rsplit("/", 1)[-1].lower() == f"{stem}{ending}"]
        if len(found) > 1:
            raise DbfError(f"several files named {table}: {found[:10]}")
    return found


def parse_layout(text: str) -> tuple[DbfField, ...]:
    fields = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, kind, width, *rest = part.split(":")
        fields.append(DbfField(name, kind, int(width), int(rest[0]) if rest else 0))
    check_layout(fields)
    return tuple(fields)


def layout_text(fields: Iterable[tuple[str, str, int, int]]) -> str:
    return ";".join(f"{n}:{k}:{w}:{d}" for n, k, w, d in fields)


def check_layout(fields: Iterable[DbfField]) -> None:
    """Limits of the format: names, widths, decimals, record size."""
    fields = list(fields)
    names = [f.name for f in fields]
    limits = {"C": 254, "N": 19, "L": 1, "D": 8}
    if len(set(names)) != len(names):
        raise DbfError("field names must be unique")
    for f in fields:
        exact = f.kind in "LD" and f.width != limits[f.kind] if f.kind in limits else True
        wrong = not f.name or len(f.name) > 10 or not f.name.isascii() or exact
        if wrong or not 1 <= f.width <= limits[f.kind] or not 0 <= f.decimals < max(f.width, 1):
            raise DbfError(f"field {f} does not fit the format")
        if f.kind != "N" and f.decimals:
            raise DbfError(f"only numeric fields have decimals: {f.name}")
    if len(fields) > 128 or 1 + sum(f.width for f in fields) > 4000:
        raise DbfError("too many fields or too long a record")


def read_header(handle, path: str) -> DbfHeader:
    """Header and field list; only the header bytes are read."""
    head = handle.read(32)
    if len(head) != 32:
        raise DbfError(f"{path} is not a DBF file")
    version = head[0]
    records, header_length, record_length = struct.unpack("<IHH", head[4:12])
    fields = []
    while True:
        item = handle.read(32)
        if not item:
            raise DbfError(f"{path} ends inside its field list")
        if item[0] == FIELD_END:
            break
        if len(item) != 32:
            raise DbfError(f"{path} ends inside a field descriptor")
        name = item[:11].split(b"\x00", 1)[0].decode("ascii", "ignore")
        fields.append(DbfField(name, chr(item[11]), item[16], item[17]))
    return DbfHeader(version, records, header_length, record_length, tuple(fields))


def header_of(path: str) -> tuple[DbfHeader, int]:
    with open_dbf(path) as handle:
        return read_header(handle, open_fs(path)[1]), handle.size()


def check_strict(header: DbfHeader, size: int, path: str, layout: tuple[DbfField, ...] | None) -> None:
    if header.version != VERSION:
        raise DbfError(f"{path} has version byte {header.version}")
    if layout is not None and header.fields != layout:
        raise DbfError(f"{path} does not have the expected fields")
    expected = (33 + 32 * len(header.fields), 1 + sum(f.width for f in header.fields))
    if (header.header_length, header.record_length) != expected:
        raise DbfError(f"{path} has inconsistent lengths")
    end = header.header_length + header.records * header.record_length
    if size < end:
        raise DbfError(f"{path} ends inside a record")
    if size != end + 1:
        raise DbfError(f"{path} has no end marker or trailing bytes")


def number_kinds(options: dict) -> dict[str, tuple[int, int] | None]:
    """(precision, scale) that option ``numbers`` gives a numeric field, or None for its text; ``*`` names all fields."""
    return {name: None if kind == "text" else tuple(kind) for name, kind in json.loads(options.get("numbers", "{}")).items()}


def given_kind(field: DbfField, numbers: dict) -> tuple[int, int] | str | None:
    """What ``numbers`` says of a numeric field: (precision, scale), "text", or None for what the file declares."""
    for name in (field.name, "*"):
        if field.kind == "N" and name in numbers:
            return numbers[name] or "text"
    return None


def spark_type(field: DbfField, strict: bool, given: tuple[int, int] | str | None = None) -> T.DataType:
    if given == "text":
        return T.StringType()
    if given is not None:
        return T.DecimalType(*given)
    if field.kind == "N":
        return T.DecimalType(min(38, max(field.width, field.decimals + 1)), field.decimals)
    if field.kind == "L":
        return T.BooleanType()
    return T.DateType() if field.kind == "D" and strict else T.StringType()


def table_schema(fields: Iterable[DbfField], options: dict, stream: bool = False) -> T.StructType:
    strict = options.get("mode", "lenient").lower() == "strict"
    wanted = [c.strip() for c in options.get("columns", "").split(",") if c.strip()]
    keep_raw = options.get("keepraw", "false" if wanted else "true").lower() == "true"
    chosen = [f for f in fields if not wanted or f.name in wanted]
    numbers = number_kinds(options)
    schema = T.StructType([T.StructField(f.name, spark_type(f, strict, given_kind(f, numbers))) for f in chosen])
    if keep_raw and not strict:
        for f in chosen:
            if f.kind in "NL":
                schema.add(f"_raw_{f.name}", T.StringType())
    schema.add("_rec_no", T.LongType()).add("_file", T.StringType())
    return schema.add("_reset", T.BooleanType()) if stream else schema


BLANKS = " \t\r\n\x0b\x0c\x00\xa0\x85\x1c\x1d\x1e\x1f"
ASCII = bytes(range(128))


def _texts(block: np.ndarray, offset: int, width: int, encoding: str, right_only: bool) -> pa.Array:
    """Texts of one field without blanks around them, or with those before them."""
    raw = np.ascontiguousarray(block[:, offset:offset + width])
    if not len(raw) or (raw.max() < 0x80 and ASCII.decode(encoding, "ignore").encode() == ASCII):
        ends = np.arange(len(raw) + 1, dtype=np.int32) * width
        text = pa.StringArray.from_buffers(len(raw), pa.py_buffer(ends), pa.py_buffer(raw))
        if not right_only:
            return pc.ascii_trim(text, "".join(c for c in BLANKS if c.isascii()))
        for blank in ("\x00", " ", "\x00"):  # as numpy does below, whose texts never end with a zero
            text = pc.ascii_rtrim(text, blank)
        return text
    text = np.char.decode(raw.view(f"S{width}").ravel(), encoding, "ignore")
    text = np.char.rstrip(text, " \x00") if right_only else np.char.strip(text, BLANKS)
    return pa.array(text.astype(object), pa.string())


def decode_field(block: np.ndarray, field: DbfField, offset: int, encoding: str, strict: bool, given: tuple[int, int] | str | None = None) -> tuple[pa.Array, pa.Array]:
    """(typed values, text that did not parse) of one field; ``given`` is the type to use for a numeric one."""
    column = _texts(block, offset, field.width, encoding, strict and field.kind == "C")
    column = pc.if_else(pc.equal(column, ""), pa.scalar(None, pa.string()), column)
    nothing = pa.nulls(len(column), pa.string())
    if given == "text":
        return column, nothing
    if field.kind == "N":
        kind = spark_type(field, strict, given)
        field = replace(field, decimals=kind.scale)
        decimals = rf"(\.[0-9]{{0,{field.decimals}}})?" if field.decimals else r"(\.0*)?"
        if strict:
            decimals = rf"(\.[0-9]{{1,{field.decimals}}})?" if field.decimals else ""
        ok = pc.match_substring_regex(column, rf"^{'-?' if strict else '[+-]?'}[0-9]+{decimals}$")
        good = pc.if_else(ok, column, pa.scalar(None, pa.string()))
        plain = pc.replace_substring_regex(pc.replace_substring_regex(good, r"^\+", ""), r"\.0*$" if not field.decimals else r"\.$", "")
        values = plain.cast(pa.decimal128(38, field.decimals)).cast(pa.decimal128(kind.precision, kind.scale))
        if strict:
            return values, pc.if_else(ok, nothing, column)
        return _other_numbers(column, values, pc.if_else(ok, nothing, column))
    if field.kind == "L":
        upper = pc.utf8_upper(column)
        yes, no = pc.is_in(upper, pa.array(["T", "Y"])), pc.is_in(upper, pa.array(["F", "N"]))
        known = pc.or_(yes, no)
        blank = pc.equal(column, "?") if strict else pa.scalar(False)
        bad = pc.and_(pc.invert(known), pc.invert(pc.fill_null(blank, False)))
        return pc.if_else(known, yes, pa.scalar(None, pa.bool_())), pc.if_else(bad, column, nothing)
    if field.kind == "D":
        iso = pc.replace_substring_regex(column, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", r"\1-\2-\3")
        if not strict:
            return iso, nothing
        shaped = pc.match_substring_regex(column, "^[0-9]{8}$")
        parsed = pc.strptime(pc.if_else(shaped, column, pa.scalar(None, pa.string())), format="%Y%m%d", unit="s", error_is_null=True)
        real = pc.and_(pc.is_valid(parsed), pc.fill_null(pc.equal(pc.strftime(parsed, format="%Y%m%d"), column), False))
        values = pc.if_else(real, parsed, pa.scalar(None, parsed.type)).cast(pa.date32())
        return values, pc.if_else(real, nothing, column)
    return column, nothing


NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"


def _other_numbers(column: pa.Array, values: pa.Array, rejected: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Fills in legal numbers of other spellings: no leading zero, an exponent, more decimals than declared.

    Digits beyond the declared scale are rounded half-even; the text is then kept
    as rejected too, as it is when the number is too large for the field's type.
    """
    odd = pc.fill_null(pc.match_substring_regex(rejected, NUMBER), False)
    if not pc.any(odd).as_py():
        return values, rejected
    kind = values.type
    context = Context(prec=kind.precision, rounding=ROUND_HALF_EVEN, traps=[])
    found, texts = [], []
    for text in column.filter(odd).to_pylist():
        exact = Decimal(text)
        held = exact.quantize(Decimal(1).scaleb(-kind.scale), context=context)
        fits = held.is_finite()
        found.append(held if fits else None)
        texts.append(None if fits and held == exact else text)
    return pc.replace_with_mask(values, odd, pa.array(found, kind)), pc.replace_with_mask(rejected, odd, pa.array(texts, pa.string()))


@dataclass
class RecordDecoder:
    """Bytes of whole records to Arrow batches."""

    options: dict
    keys: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def strict(self) -> bool:
        return self.options.get("mode", "lenient").lower() == "strict"

    def decode(self, header: DbfHeader, data: bytes | memoryview, first: int, path: str, schema: pa.Schema) -> pa.RecordBatch | None:
        encoding = self.options.get("encoding", "cp1252" if self.strict else "latin1")
        block = np.frombuffer(data, np.uint8).reshape(-1, header.record_length)
        marker = block[:, 0]
        if self.strict and not np.isin(marker, (LIVE, DELETED)).all():
            raise DbfError(f"{path} has an invalid record marker")
        keep = marker != DELETED
        offsets, at = {}, 1
        for f in header.fields:
            offsets[f.name], at = at, at + f.width
        by_name = {f.name: f for f in header.fields}
        # key fields decide first; only surviving records are decoded further
        for name, wanted in self.keys:
            values, _ = decode_field(block, by_name[name], offsets[name], encoding, self.strict)
            keep &= pc.fill_null(pc.is_in(values, pa.array(wanted, pa.string())), False).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(keep)
        if not len(rows):
            return None
        block = block[rows]
        decoded: dict[str, tuple[pa.Array, pa.Array]] = {}
        numbers = number_kinds(self.options)
        columns = []
        for target in schema:
            name = target.name
            if name == "_rec_no":
                columns.append(pa.array(rows.astype(np.int64) + first))
            elif name == "_file":
                columns.append(pa.array([path] * len(rows)))
            elif name == "_reset":
                columns.append(pa.array([False] * len(rows)))
            else:
                raw = name.startswith("_raw_") and name[5:] in by_name
                source = name[5:] if raw else name
                if source not in decoded:
                    decoded[source] = decode_field(block, by_name[source], offsets[source], encoding, self.strict, given_kind(by_name[source], numbers))
                    if self.strict and decoded[source][1].null_count != len(rows):
                        bad = next(x for x in decoded[source][1].to_pylist() if x is not None)
                        raise DbfError(f"{path}: invalid value in {source}: {bad!r}")
                columns.append(decoded[source][1 if raw else 0].cast(target.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def read_range(self, part: RecordRange, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        p = open_fs(part.path)[1]
        with open_dbf(part.path) as handle:
            header = read_header(handle, p)
            handle.seek(header.header_length + part.start * header.record_length)
            at = part.start
            while at < part.stop:
                data = handle.read(min(BATCH_RECORDS, part.stop - at) * header.record_length)
                whole = len(data) // header.record_length
                if not whole:
                    break  # short file: stop at the last whole record
                batch = self.decode(header, memoryview(data)[: whole * header.record_length], at, part.path, schema)
                at += whole
                if batch is not None:
                    yield batch
            if self.strict and part.last and handle.read(1) != bytes([FILE_END]):
                raise DbfError(f"{p} has no end marker")


def arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.LongType: pa.int64(), T.DateType: pa.date32()}
    return pa.schema([
        (f.name, pa.decimal128(f.dataType.precision, f.dataType.scale) if isinstance(f.dataType, T.DecimalType) else kinds[type(f.dataType)])
        for f in schema.fields
    ])


class DbfReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options
        self.keys: list[tuple[str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        texts = {f.name for f in self.schema.fields if isinstance(f.dataType, T.StringType) and not f.name.startswith("_")}
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in texts:
                wanted = f.value if isinstance(f, In) else (f.value,)
                self.keys.append((f.attribute[0], tuple(v for v in wanted if v is not None)))
            else:
                yield f

    def partitions(self) -> list[RecordRange]:
        split = int(self.options.get("splitrecords", SPLIT_RECORDS))
        strict = self.options.get("mode", "lenient").lower() == "strict"
        layout = parse_layout(self.options["layout"]) if strict and "layout" in self.options else None
        parts = []
        for path in find_files(self.options["path"], self.options.get("table"), self.options.get("compression")):
            header, size = header_of(path)
            if strict:
                check_strict(header, size, path, layout)
            stop = min(header.records, max(0, size - header.header_length) // max(1, header.record_length))
            for start in range(0, max(stop, 1), split):
                parts.append(RecordRange(path, start, min(start + split, stop), last=start + split >= stop))
        return parts

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        decoder = RecordDecoder(self.options, tuple(self.keys))
        yield from decoder.read_range(partition, arrow_schema(self.schema))


class DbfStreamReader(DataSourceStreamReader):
    """Appended records only; a file that shrank yields one ``_reset`` row."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def _counts(self) -> dict[str, int]:
        counts = {}
        for path in find_files(self.options["path"], self.options.get("table"), self.options.get("compression")):
            header, size = header_of(path)
            whole = max(0, size - header.header_length) // max(1, header.record_length)
            counts[path] = min(header.records, whole)
        return counts

    def initialOffset(self) -> dict:
        start = self.options.get("startingrecord", "end")
        return {p: n if start == "end" else min(n, int(start)) for p, n in self._counts().items()}

    def latestOffset(self) -> dict:
        return self._counts()

    def partitions(self, start: dict, end: dict) -> list[RecordRange]:
        split = int(self.options.get("splitrecords", SPLIT_RECORDS))
        parts = []
        for path, stop in end.items():
            begin = start.get(path, stop)  # a file seen for the first time starts at its end
            if stop < begin:
                parts.append(RecordRange(path, 0, 0, reset=True))
            for at in range(begin, stop, split):
                parts.append(RecordRange(path, at, min(at + split, stop)))
        return parts

    def read(self, partition: RecordRange) -> Iterator[tuple]:
        for batch in self.batches(partition):
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def batches(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(self.schema)
        if partition.reset:
            yield pa.RecordBatch.from_pylist([{"_reset": True, "_file": partition.path, "_rec_no": -1}], schema=schema)
            return
        yield from RecordDecoder(self.options).read_range(partition, schema)

    def commit(self, end: dict) -> None:
        pass


class DbfBatchStreamReader(DbfStreamReader):
    """The same stream in Arrow batches, as Spark takes it."""

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


@dataclass
class WrittenFile(WriterCommitMessage):
    part: str
    final: str
    records: int


def encode_values(column: pa.Array, field: DbfField) -> bytes:
    """One column value by value, each filled to the field's width."""
    out = []
    for value in column.to_pylist():
        if field.kind == "L":
            text = {True: "T", False: "F", None: "?"}.get(value, value)
        elif field.kind == "D" and isinstance(value, (date, datetime)):
            text = value.strftime("%Y%m%d")
        else:
            text = "" if value is None else str(value)
        data = text.encode("cp1252", "replace")
        if field.kind == "N":
            if len(data) > field.width:
                raise DbfError(f"{text} is too wide for {field.name}")
            out.append(data.rjust(field.width))
        else:
            out.append(data[: field.width].ljust(field.width))
    return b"".join(out)


def encode_column(column: pa.Array, field: DbfField) -> np.ndarray:
    """Bytes of one column, a row per record; plain ASCII texts are fitted at once."""
    shape = (len(column), field.width)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        text = pc.fill_null(column.cast(pa.string()), "?" if field.kind == "L" else "")
        plain = pc.all(pc.string_is_ascii(text), min_count=0).as_py()
        if plain and (field.kind != "N" or (pc.max(pc.binary_length(text)).as_py() or 0) <= field.width):
            if field.kind == "N":
                text = pc.ascii_lpad(text, field.width)
            else:
                text = pc.utf8_slice_codeunits(pc.ascii_rpad(text, field.width), 0, field.width)
            start, data = np.frombuffer(text.buffers()[1], np.int32)[text.offset] if len(text) else 0, text.buffers()[2]
            return np.frombuffer(data or b"", np.uint8, shape[0] * shape[1], start).reshape(shape)
    return np.frombuffer(encode_values(column, field), np.uint8).reshape(shape)


def header_bytes(fields: tuple[DbfField, ...], records: int) -> bytes:
    today = date.today()
    head = struct.pack(
        "<BBBBIHH20x", VERSION, today.year - 1900, today.month, today.day, records,
        33 + 32 * len(fields), 1 + sum(f.width for f in fields),
    )
    items = [struct.pack("<11sc4xBB14x", f.name.encode("ascii"), f.kind.encode("ascii"), f.width, f.decimals) for f in fields]
    return head + b"".join(items) + bytes([FIELD_END])


class DbfWriter(DataSourceArrowWriter):
    """Each task streams its rows to a hidden file; commit renames them."""

    def __init__(self, options: dict):
        self.options, self.fields = options, parse_layout(options["layout"])
        self.packed, self.ending = bool(options.get("compression")), file_ending(options.get("compression"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        from pyspark import TaskContext

        fs, root = open_fs(self.options["path"])
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        stem = self.options.get("table", "part")
        part = f"{root}/.{stem}-{uuid.uuid4().hex}.tmp"
        number = context.partitionId() if context else 0
        body, records = part + ".body", 0
        # the record count comes first in the file, so records are spooled next to it
        with fs.open_output_stream(body) as out:
            spooled = FrameWriter(out) if self.packed else out
            for batch in iterator:
                live = np.full((batch.num_rows, 1), LIVE, np.uint8)
                spooled.write(np.hstack([live, *[encode_column(batch.column(f.name), f) for f in self.fields]]).tobytes())
                records += batch.num_rows
            if self.packed:
                spooled.end_frame()
        with fs.open_output_stream(part) as out, fs.open_input_stream(body) as spool:
            whole = FrameWriter(out) if self.packed else out
            whole.write(header_bytes(self.fields, records))
            if self.packed:
                whole.end_frame()
                whole.frames += spooled.frames  # copied as they are
            while chunk := spool.read(1 << 22):
                out.write(chunk)
            whole.write(bytes([FILE_END]))
            if self.packed:
                whole.end_file()
        fs.delete_file(body)
        return WrittenFile(part, f"{root}/{stem}-{number:05d}-{uuid.uuid4().hex[:8]}{self.ending}", records)

    def commit(self, messages: list[WrittenFile]) -> None:
        fs, _ = open_fs(self.options["path"])
        for m in filter(None, messages):
            fs.move(m.part, m.final)

    def abort(self, messages: list[WrittenFile]) -> None:
        fs, _ = open_fs(self.options["path"])
        for m in filter(None, messages):
            fs.delete_file(m.part)


class DbfDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dbf"

    def _plain(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def _fields(self) -> tuple[DbfField, ...]:
        options = self._plain()
        if "layout" in options:
            return parse_layout(options["layout"])
        files = find_files(options["path"], options.get("table"), options.get("compression"))
        if not files:
            raise DbfError(f"no DBF file in {options['path']}")
        return header_of(files[0])[0].fields

    def schema(self) -> T.StructType:
        stream = self._plain().get("stream", "false") == "true"
        return table_schema(self._fields(), self._plain(), stream)

    def reader(self, schema: T.StructType) -> DbfReader:
        return DbfReader(schema, self._plain())

    def streamReader(self, schema: T.StructType) -> DbfStreamReader:
        return DbfBatchStreamReader(schema, self._plain())

    def writer(self, schema: T.StructType, overwrite: bool) -> DbfWriter:
        return DbfWriter(self._plain())


def register(spark: SparkSession) -> None:
    """Make ``format("dbf")`` available; filters are pushed into the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DbfDataSource)


def read_dbf(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("dbf").options(**options).load(resolve(spark, path))


def number_census(spark: SparkSession, path: str, **options: str) -> dict[str, tuple[int, int] | str]:
    """The decimal type that holds every legal number of each numeric field exactly, or "text" beyond 38 digits.

    One pass over the texts of the numeric fields of all files; a field's type is never smaller than it declares.
    """
    files = find_files(resolve(spark, path), options.get("table"), options.get("compression"))
    fields = [f for f in header_of(files[0])[0].fields if f.kind == "N"] if files else []
    wanted = [c.strip() for c in options.get("columns", "").split(",") if c.strip()]
    fields = [f for f in fields if not wanted or f.name in wanted]
    if not fields:
        return {}
    texts = read_dbf(spark, path, **{**options, "columns": ",".join(f.name for f in fields), "numbers": json.dumps({"*": "text"})})
    found = []
    for f in fields:
        text = F.when(F.col(f.name).rlike(NUMBER), F.col(f.name))
        whole = F.regexp_replace(F.regexp_extract(text, "^[+-]?([0-9]*)", 1), "^0+", "")
        part = F.regexp_replace(F.regexp_extract(text, r"\.([0-9]*)", 1), "0+$", "")
        power = F.coalesce(F.regexp_extract(text, "[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        found += [F.max(F.greatest(F.lit(0), F.length(whole) + power)).alias(f"{f.name}_whole"), F.max(F.greatest(F.lit(0), F.length(part) - power)).alias(f"{f.name}_part")]
    seen = texts.agg(*found).first()
    kinds: dict[str, tuple[int, int] | str] = {}
    for f in fields:
        declared = spark_type(f, False)
        whole, part = seen[f"{f.name}_whole"] or 0, seen[f"{f.name}_part"] or 0
        scale = max(declared.scale, part)
        exact = max(whole + scale, 1)
        kinds[f.name] = "text" if exact > 38 else (min(38, max(exact, declared.precision - declared.scale + scale)), scale)
    return kinds


def read_exact_dbf(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lenient read whose numbers keep all their digits, whatever the fields declare."""
    return read_dbf(spark, path, **{**options, "numbers": json.dumps(number_census(spark, path, **options))})


def read_selected(spark: SparkSession, path: str, key: str, keys: DataFrame, columns: list[str], **options: str) -> DataFrame:
    """Rows of the wanted keys, chosen columns only.

    ``keys`` has one column; it stays a distributed semi-join, so its size is
    no concern.
    """
    wanted = ",".join(dict.fromkeys([key, *columns]))
    rows = read_dbf(spark, path, columns=wanted, **options)
    return rows.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_semi")


def read_dbf_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("dbf").options(stream="true", **options).load(resolve(spark, path))


def write_dbf(rows: DataFrame, path: str, layout: Iterable[tuple[str, str, int, int]], table: str = "part", **options: str) -> None:
    """Append fitted rows to a folder, one file per task."""
    register(rows.sparkSession)
    layout = list(layout)
    kept = rows.select(*[name for name, *_ in layout])
    kept.write.format("dbf").option("layout", layout_text(layout)).option("table", table).options(**options).mode("append").save(resolve(rows.sparkSession, path))
