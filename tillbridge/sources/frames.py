"""Files in independent Zstandard frames that end with a seek table (the published seekable format).

Any Zstandard tool unpacks such a file to the plain one. A range of it costs the frames that
hold it: the seek table, a skippable frame, lists compressed and plain size of each.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa

FRAME_BYTES = 4 << 20
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, HEAD_BYTES, ENTRY_BYTES, FOOTER_BYTES, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 8, 8, 9, 0x80


class FrameWriter:
    """Packs what is written into frames; ``frames`` has the sizes of those that are out."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.codec, self.buffer, self.frames = out, pa.Codec("zstd", LEVEL), bytearray(), []

    def write(self, data: bytes) -> None:
        self.buffer += data
        while len(self.buffer) >= FRAME_BYTES:
            self._put(FRAME_BYTES)

    def _put(self, size: int) -> None:
        frame = self.codec.compress(bytes(self.buffer[:size]))
        self.out.write(frame)
        self.frames.append((len(frame), size))
        del self.buffer[:size]

    def end_frame(self) -> None:
        if self.buffer:
            self._put(len(self.buffer))

    def end_file(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class FrameReader:
    """The plain file: positions and sizes are those of its bytes."""

    def __init__(self, handle: pa.NativeFile, path: str):
        self.handle, self.codec, self.at, self.held = handle, pa.Codec("zstd"), 0, (-1, b"")
        end = handle.size()
        handle.seek(max(0, end - FOOTER_BYTES))
        footer = handle.read(FOOTER_BYTES)
        if len(footer) != FOOTER_BYTES or footer[5:] != struct.pack("<I", SEEKABLE_MAGIC):
            raise ValueError(f"{path} has no seek table")
        count, flags, _ = struct.unpack("<IBI", footer)
        entry = ENTRY_BYTES + (4 if flags & CHECKSUMS else 0)
        begin = end - FOOTER_BYTES - count * entry - HEAD_BYTES
        if begin < 0:
            raise ValueError(f"{path} has no whole seek table")
        handle.seek(begin)
        magic, length = struct.unpack("<II", handle.read(HEAD_BYTES))
        table = handle.read(count * entry)
        sizes = [struct.unpack_from("<II", table, k * entry) for k in range(count)]
        self.starts = list(accumulate((packed for packed, _ in sizes), initial=0))
        self.plain = list(accumulate((plain for _, plain in sizes), initial=0))
        if (magic, length, self.starts[-1]) != (SKIPPABLE_MAGIC, count * entry + FOOTER_BYTES, begin):
            raise ValueError(f"{path} has a seek table that does not fit its frames")

    def size(self) -> int:
        return self.plain[-1]

    def seek(self, position: int) -> None:
        self.at = position

    def read(self, size: int) -> bytearray:
        out = bytearray(max(0, min(size, self.size() - self.at)))
        done = 0
        while done < len(out):
            number = bisect_right(self.plain, self.at) - 1
            start = self.at - self.plain[number]
            part = memoryview(self._frame(number))[start:start + len(out) - done]
            out[done:done + len(part)] = part
            done, self.at = done + len(part), self.at + len(part)
        return out

    def _frame(self, number: int) -> pa.Buffer | bytes:
        """A frame's bytes; the last one stays for the next read."""
        if self.held[0] != number:
            self.handle.seek(self.starts[number])
            packed = self.handle.read(self.starts[number + 1] - self.starts[number])
            self.held = number, self.codec.decompress(packed, self.plain[number + 1] - self.plain[number])
        return self.held[1]
