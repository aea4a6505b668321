"""Texts as chunks of word numbers, and the exchange between chunks and tables of counts.

A *chunk* is a bounded stretch of consecutive texts of one task: the hashes of its distinct words, and for each
token the place of its word among these. Texts longer than a piece are cut, with the words before the cut in front
of the next piece, so that no n-gram is lost there and memory does not depend on the length of a text.

Chunks meet tables that grow with the corpus through *messages*: a chunk sends each bucket of a table the sorted,
distinct keys that it has there (``pack``ed, one row for each bucket that is not empty), and gets an answer of the
same length. A key that all texts share is thus sent once for each chunk, however frequent it is.

Words are told apart by 64 bits of their hash; n-grams by the numbers of their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import zstandard

from lacuna.llm.shingles import _BYTE, _DOWN, _UP, mix

#: Bytes of text in a chunk, and in a piece of it that is hashed at a time.
CHUNK_BYTES, PIECE_BYTES = 6 << 20, 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]


@dataclass(frozen=True)
class Splitter:
    """Which bytes lie between words, and which of these also end a stretch that phrases stay inside."""

    blanks: bytes
    breaks: bytes = b""

    @property
    def between(self) -> np.ndarray:
        is_one = np.zeros(256, bool)
        is_one[list(self.blanks + self.breaks)] = True
        return is_one

    @property
    def word(self) -> re.Pattern:
        return re.compile(b"[^" + re.escape(self.blanks + self.breaks) + b"]+")


@dataclass
class Piece:
    row: int  # place of the text among the chunk's rows
    data: bytes
    ahead: int = 0  # words in front that belong to the piece before
    last: bool = True


@dataclass
class Chunk:
    rows: list[tuple]
    pieces: list[Piece]
    hashes: np.ndarray = field(default=None)  # of each word, in order
    piece_of: np.ndarray = field(default=None)  # of each word
    stretch: np.ndarray = field(default=None)  # numbered stretches between breaks and pieces, of each word
    start: np.ndarray = field(default=None)
    end: np.ndarray = field(default=None)
    buffer: bytes = b""

    def word(self, i: int) -> bytes:
        return LOWER[np.frombuffer(self.buffer, np.uint8, self.end[i] - self.start[i], self.start[i])].tobytes()


def cut(data: bytes, splitter: Splitter, overlap: int, size: int) -> Iterator[tuple[bytes, int, bool]]:
    """A text in pieces: bytes, the number of words in front that repeat, and whether it is the last piece."""
    between, at, ahead, front = set(splitter.blanks + splitter.breaks), 0, 0, b""
    while len(data) - at > size:
        stop = at + size
        while stop < len(data) and data[stop] not in between:
            stop += 1
        if stop == len(data):
            break
        yield front + data[at:stop], ahead, False
        back = 64 * (overlap + 1)
        while True:
            lo = max(0, stop - back)
            found = [m.start() for m in splitter.word.finditer(data, lo, stop)]
            if len(found) > overlap or lo == 0:
                found = found[-overlap:] if overlap else []
                break
            back *= 4
        front, ahead, at = data[found[0] : stop] if found else b"", len(found), stop
    yield front + data[at:], ahead, True


def chunks(texts: Iterator[tuple[tuple, bytes]], splitter: Splitter, overlap: int, chunk_bytes: int = CHUNK_BYTES, piece_bytes: int = PIECE_BYTES) -> Iterator[Chunk]:
    """Chunks of (row, text) pairs."""
    rows, pieces, size = [], [], 0
    for row, data in texts:
        rows.append(row)
        for part, ahead, last in cut(data, splitter, overlap, piece_bytes):
            pieces.append(Piece(len(rows) - 1, part, ahead, last))
            size += len(part) + 64
            if size >= chunk_bytes:
                yield _read(Chunk(rows, pieces), splitter, piece_bytes)
                rows, pieces, size = ([] if last else [row]), [], 0
    if pieces:
        yield _read(Chunk(rows, pieces), splitter, piece_bytes)


def _read(chunk: Chunk, splitter: Splitter, piece_bytes: int) -> Chunk:
    between, breaks = splitter.between, np.zeros(256, np.int64)
    breaks[list(splitter.breaks)] = 1
    hashes, places, starts, ends, stretches, at, base, k = [], [], [], [], [], 0, 0, 0
    while k < len(chunk.pieces):
        more, size = k, 0
        while more < len(chunk.pieces) and (more == k or size + len(chunk.pieces[more].data) <= piece_bytes):
            size += len(chunk.pieces[more].data)
            more += 1
        part = chunk.pieces[k:more]
        raw = np.frombuffer(b"\n".join(p.data for p in part) + b"\n", np.uint8)
        offset = np.cumsum([0, *(len(p.data) + 1 for p in part)])
        inside = ~between[raw]
        inside[offset[1:] - 1] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        running = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _UP.up_to(len(raw))[: len(raw)], out=running[1:])
        hashes.append(mix((running[end] - running[start]) * _DOWN.up_to(len(raw))[start] + (end - start).astype(np.uint64)))
        piece = np.searchsorted(offset, start, side="right") - 1
        counted = breaks[raw]
        counted[offset[1:] - 1] = 1
        counted = np.cumsum(counted)
        stretches.append(counted[start] + base)
        base += int(counted[-1])
        places.append(piece + k)
        starts.append(start + at)
        ends.append(end + at)
        at += len(raw)
        k = more
    chunk.buffer = b"".join(p.data + b"\n" for p in chunk.pieces)
    chunk.hashes, chunk.piece_of, chunk.start, chunk.end, chunk.stretch = (np.concatenate(x) for x in (hashes, places, starts, ends, stretches))
    return chunk


# -- packed arrays --------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: the first bytes of all values, then the second bytes, and so on, compressed."""
    squeeze, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        if a.dtype.kind == "i" and len(a) and a.min() >= 0 and a.max() < 1 << 32:
            a = a.astype(np.min_scalar_type(a.max()))
        body = squeeze.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays; integers come back as 64 bits."""
    out, at, grow = [], 0, zstandard.ZstdDecompressor()
    while at < len(data):
        kind, n, size = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little"), int.from_bytes(data[at + 12 : at + 20], "little")
        body = np.frombuffer(grow.decompress(data[at + 20 : at + 20 + size], max_output_size=max(1, n * kind.itemsize)), np.uint8)
        a = np.ascontiguousarray(body.reshape(kind.itemsize, n).T).view(kind).reshape(n)
        out.append(a.astype(np.int64) if kind.kind in "iu" and kind != np.uint64 else a.copy())
        at += 20 + size
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the place of each key among them."""
    return np.unique(keys, return_inverse=True)


def runs(sorted_keys: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(sorted_keys), bool)
    if len(new):
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        for other in more:
            new[1:] |= other[1:] != other[:-1]
    return np.flatnonzero(new)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that is not empty, with the places of its keys in their order."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")  # 16 bits are sorted in linear time
    edges = runs(bucket[order])
    for lo, hi in zip(edges, [*edges[1:], len(order)]):
        yield int(bucket[order[lo]]), order[lo:hi]
