"""A wavelet matrix of token ids in one compressed file: access, counting and occurrences without unpacking it.

Plane by plane, from the highest bit of an id to the lowest, the file holds that bit of every id; in the plane below, the
ids whose bit is 0 stand first, in their order, then those whose bit is 1. A position's path down the planes spells its
id; an id's path down narrows all positions to its occurrences, and select leads each back up to its place. A
plane is cut into blocks that are compressed one by one, with the number of ones before each: a lookup unpacks only the
blocks on its path, and the directory of ranks inside a block is made when it is unpacked.

Layout: MAGIC, the header's length (4 bytes, little-endian), the header (JSON), the compressed table of documents (ids,
a flag for null ids, lengths; 64-bit little-endian), then the compressed blocks of the planes in order.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import zstandard

MAGIC = b"WTOK0001"
#: Bytes of a plane's block before it is compressed, and the blocks a reader keeps.
BLOCK, KEPT = 1 << 15, 64
#: Ids of a plane that are dealt with at a time; whole bytes of it.
STRETCH = 1 << 16


def pack(ids: np.ndarray, doc_ids: np.ndarray, null_ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """A file of the ids of consecutive documents."""
    press = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max(initial=0)).bit_length())
    x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    zeros, ones, stored, blocks = [], [], [], []
    for bit in range(bits - 1, -1, -1):
        planes, low, high = [], [], []
        for at in range(0, len(x), STRETCH):  # short enough for a processor's cache
            own = x[at : at + STRETCH]
            one = (own & x.dtype.type(1 << bit)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            low.append(own[np.flatnonzero(~one)])  # positions are taken faster than by a mask
            high.append(own[np.flatnonzero(one)])
        plane = np.concatenate([np.zeros(0, np.uint8), *planes])
        edges = range(0, len(plane), BLOCK)
        ones.append([int(n) for n in np.cumsum([0] + [int(np.bitwise_count(plane[a : a + BLOCK]).sum(dtype=np.int64)) for a in edges])])
        parts = [press(plane[a : a + BLOCK].tobytes()) for a in edges]
        stored.append([len(p) for p in parts])
        blocks += parts
        zeros.append(sum(map(len, low)))
        x = np.concatenate([x[:0], *low, *high])
    table = press(doc_ids.astype("<i8").tobytes() + null_ids.astype("<i8").tobytes() + sizes.astype("<i8").tobytes())
    header = json.dumps({"n": len(ids), "bits": bits, "docs": len(sizes), "table": len(table), "zeros": zeros, "ones": ones, "stored": stored}, separators=(",", ":")).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, table, *blocks])


class WaveletFile:
    """Reads a file through `read(offset, size)`."""

    def __init__(self, read: Callable[[int, int], bytes]):
        head = read(0, len(MAGIC) + 4)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        size = int.from_bytes(head[len(MAGIC) :], "little")
        header = json.loads(read(len(MAGIC) + 4, size))
        self.n, self.bits, self.docs, self.zeros = header["n"], header["bits"], header["docs"], header["zeros"]
        self.ones = [np.array(x, np.int64) for x in header["ones"]]
        self.stored = header["stored"]
        self._read, self._unpack = read, zstandard.ZstdDecompressor().decompress
        self._table_at, self._table = len(MAGIC) + 4 + size, header["table"]
        self._starts, at = [], self._table_at + self._table
        for sizes in self.stored:
            self._starts.append(np.cumsum([at, *sizes]))
            at = int(self._starts[-1][-1])
        self._blocks: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, whether they are null, and lengths of the documents, in order."""
        x = np.frombuffer(self._unpack(self._read(self._table_at, self._table)), "<i8")
        return x[: self.docs], x[self.docs : 2 * self.docs] != 0, x[2 * self.docs :]

    def ids(self) -> np.ndarray:
        """All ids: planes are undone from the lowest up, each in two runs."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            first, last = int(self._starts[level][0]), int(self._starts[level][-1])
            raw, at = self._read(first, last - first), 0
            plane = bytearray()
            for size in self.stored[level]:
                plane += self._unpack(raw[at : at + size])
                at += size
            one = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~one)] = x[: self.zeros[level]]
            above[np.flatnonzero(one)] = x[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            x = above
        return x

    def block(self, level: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits of a block, and the ones before each."""
        got = self._blocks.pop((level, b), None)
        if got is None:
            start = int(self._starts[level][b])
            bits = np.unpackbits(np.frombuffer(self._unpack(self._read(start, self.stored[level][b])), np.uint8), bitorder="little")
            got = bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int32)])
        self._blocks[level, b] = got
        while len(self._blocks) > KEPT:
            self._blocks.popitem(last=False)
        return got

    def rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        out, which = np.empty(len(at), np.int64), at // (8 * BLOCK)
        for b in np.unique(which).tolist():
            here = np.flatnonzero(which == b)
            out[here] = self.ones[level][b]
            if b < len(self.stored[level]):
                out[here] += self.block(level, b)[1][at[here] - b * 8 * BLOCK]
        return out

    def select(self, level: int, nth: np.ndarray, bit: int) -> np.ndarray:
        """The positions of the nth (from 0) ones, or zeros, of a plane."""
        before = self.ones[level] if bit else np.minimum(np.arange(len(self.ones[level])) * 8 * BLOCK, self.n) - self.ones[level]
        which = np.searchsorted(before, nth, side="right") - 1
        out = np.empty(len(nth), np.int64)
        for b in np.unique(which).tolist():
            here = np.flatnonzero(which == b)
            out[here] = np.flatnonzero(self.block(level, b)[0] == bit)[nth[here] - before[b]] + b * 8 * BLOCK
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some positions."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("beyond the file's ids")
        for level in range(self.bits):
            before = self.rank(level, at)
            one = self.rank(level, at + 1) > before
            out = 2 * out + one
            at = np.where(one, self.zeros[level] + before, at - before)
        return out

    def interval(self, token: int) -> tuple[int, int]:
        """Where the id's occurrences stand below the last plane."""
        ends = np.array([0, self.n], np.int64)
        if not 0 <= token < 1 << self.bits:
            return 0, 0
        for level in range(self.bits):
            before = self.rank(level, ends)
            ends = self.zeros[level] + before if token >> (self.bits - 1 - level) & 1 else ends - before
        return int(ends[0]), int(ends[1])

    def count(self, token: int) -> int:
        first, last = self.interval(token)
        return last - first

    def occurrences(self, token: int, most: int = 1 << 16):
        """All positions of an id, rising, in arrays of `most` at a time."""
        first, last = self.interval(token)
        for a in range(first, last, most):
            at = np.arange(a, min(last, a + most))
            for level in range(self.bits - 1, -1, -1):
                bit = token >> (self.bits - 1 - level) & 1
                at = self.select(level, at - self.zeros[level] * bit, bit)
            yield at
