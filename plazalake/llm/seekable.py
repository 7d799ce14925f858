"""The seekable zstandard layout: independent frames, then a seek table in a skippable frame.

A bundle is  frame*  index  seek-table.  The seek table lists for every frame its
compressed size, its decompressed size and the low 32 bits of the XXH64 of its
content. The index, a skippable frame as well, is what a user of the layout keeps
about its records. Standard zstd tools read such a bundle as the joined content.
"""

from __future__ import annotations

import struct

import xxhash
import zstandard

# Fixed values of the seekable format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80


class BundleWriter:
    def __init__(self, level: int = 3):
        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self._parts: list[bytes] = []
        self._table: list[bytes] = []
        self.size = 0

    def __len__(self) -> int:
        return len(self._parts)

    def add(self, content: bytes) -> int:
        """Write content as a frame of its own; returns the frame's number."""
        frame = self._zstd.compress(content)
        self._parts.append(frame)
        self._table.append(struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.size += len(frame)
        return len(self._parts) - 1

    def finish(self, index: bytes) -> bytes:
        index = self._zstd.compress(index)
        table = b"".join(self._table)
        foot = struct.pack("<IBI", len(self._table), CHECKSUMS, SEEKABLE)
        return b"".join([*self._parts, struct.pack("<II", SKIPPABLE, len(index)), index, struct.pack("<II", SEEK_TABLE, len(table) + len(foot)), table, foot])


class BundleReader:
    """Decompresses single frames of a bundle and counts them in `opened`."""

    def __init__(self, bundle: bytes):
        self._bundle, self._zstd, self.opened = bundle, zstandard.ZstdDecompressor(), 0
        frames, flags, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table at the end")
        at = len(bundle) - 9 - 12 * frames
        self._table, self._starts, offset = [], [], 0
        for i in range(frames):
            entry = struct.unpack_from("<III", bundle, at + 12 * i)
            self._table.append(entry)
            self._starts.append(offset)
            offset += entry[0]
        kind, size = struct.unpack_from("<II", bundle, offset)
        if kind != SKIPPABLE:
            raise ValueError("no index after the frames")
        self.index = self._zstd.decompress(bundle[offset + 8 : offset + 8 + size])

    def __len__(self) -> int:
        return len(self._table)

    def frame(self, number: int) -> bytes:
        packed, plain, check = self._table[number]
        start = self._starts[number]
        content = self._zstd.decompress(self._bundle[start : start + packed], max_output_size=max(plain, 1))
        if len(content) != plain or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} is damaged")
        self.opened += 1
        return content
