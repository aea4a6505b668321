"""A counting quotient filter, bulk-built, and its lossless merge.

A 64-bit fingerprint is cut into a block number (its top ``block_bits``), a quotient (the next
``quotient_bits``) and a remainder (the rest). A filter holds the remainders of one block in
slots sorted by quotient and remainder. Three bit rows locate them: ``occupied`` has a bit for
each quotient that has a run, ``run_end`` a bit for each slot that ends a run, ``counted`` a
bit for each slot whose fingerprint came more than once; for those, and only those, a counter
follows as variable-length base-128 digits. So quotient, remainder and count all can be read
back exactly, and two filters merge by merging their sorted remainders and adding counters.
"""

from __future__ import annotations

import struct

import numpy as np

#: Blocks of the fingerprint space: 2 ** BLOCK_BITS, or as many as keep about BLOCK_ROWS fingerprints in each.
BLOCK_BITS, BLOCK_ROWS = 10, 1 << 20
_HEAD = struct.Struct("<BII")


def block_bits(rows: int) -> int:
    """How many bits tell a block if there are so many fingerprints at most."""
    return min(31, max(BLOCK_BITS, (rows // BLOCK_ROWS).bit_length()))


def block_of(fingerprints: np.ndarray, bits: int = BLOCK_BITS) -> np.ndarray:
    return (fingerprints >> np.uint64(64 - bits)).astype(np.int32)


def _digits(counts: np.ndarray) -> bytes:
    out = bytearray()
    for c in counts.tolist():
        while c > 127:
            out.append(c & 127 | 128)
            c >>= 7
        out.append(c)
    return bytes(out)


def _numbers(data: bytes, n: int) -> np.ndarray:
    out, value, shift, at = np.empty(n, np.int64), 0, 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out[at], value, shift, at = value, 0, 0, at + 1
    return out


def build(fingerprints: np.ndarray, counts: np.ndarray, bits: int = BLOCK_BITS) -> bytes:
    """A filter of one block from its distinct fingerprints in ascending order and their counts."""
    n = len(fingerprints)
    quotient_bits = max(1, int(n).bit_length())
    low = 64 - bits - quotient_bits
    inside = fingerprints & np.uint64((1 << (64 - bits)) - 1)
    quotients = (inside >> np.uint64(low)).astype(np.int64)
    remainders = inside & np.uint64((1 << low) - 1)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotients] = True
    run_end = np.append(quotients[1:] != quotients[:-1], True) if n else np.zeros(0, bool)
    width = (low + 7) // 8
    slots = remainders.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].tobytes()
    more = counts > 1
    return _HEAD.pack(quotient_bits, n, int(more.sum())) + np.packbits(occupied).tobytes() + np.packbits(run_end).tobytes() + np.packbits(more).tobytes() + slots + _digits(counts[more])


def entries(block: int, data: bytes, block_bits: int = BLOCK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter in ascending order, and their counts."""
    quotient_bits, n, counted = _HEAD.unpack_from(data)
    low = 64 - block_bits - quotient_bits
    width, at, flags = (low + 7) // 8, _HEAD.size, (n + 7) // 8

    def bits(size: int) -> np.ndarray:
        nonlocal at
        row = np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=size).astype(bool)
        at += (size + 7) // 8
        return row

    occupied, run_end, more = bits(1 << quotient_bits), bits(n), bits(n)
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    run = np.cumsum(run_end) - run_end  # which run a slot is in: so many ended before it
    quotients = np.flatnonzero(occupied)[run].astype(np.uint64)
    prints = np.uint64(block << (64 - block_bits)) | quotients << np.uint64(low) | slots.reshape(-1).view("<u8").astype(np.uint64)
    counts = np.ones(n, np.int64)
    counts[more] = _numbers(data[at + n * width :], counted)
    assert flags == (n + 7) // 8
    return prints, counts


def summed(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints with the sums of their counts."""
    order = np.argsort(fingerprints, kind="stable")
    sorted_prints, sorted_counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.append(True, sorted_prints[1:] != sorted_prints[:-1])) if len(order) else np.zeros(0, np.int64)
    return sorted_prints[first], np.add.reduceat(sorted_counts, first) if len(first) else np.zeros(0, np.int64)


def merged(block: int, filters: list[bytes], bits: int = BLOCK_BITS) -> bytes:
    """One filter with the fingerprints and summed counts of all."""
    parts = [entries(block, x, bits) for x in filters]
    return build(*summed(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])), bits)
