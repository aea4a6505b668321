"""Sets of word shingles as sorted 64-bit hashes.

Words are maximal runs of bytes other than blanks (0x20, 0x09-0x0D) of the UTF-8 text with A-Z
lower-cased. A text's set has the hashes of all runs of ``WORDS`` words; a text with fewer words
has one, of the whole sequence; a text without words has none. Whole texts are read, in pieces of
bounded size that overlap by ``WORDS - 1`` words.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
#: A random 64-bit number for each byte; upper-case ASCII letters have those of the lower-case ones.
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _rng.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """base ** 0, base ** 1, ... as far as has been asked for."""

    def __init__(self, base: int):
        self.base, self.known = np.uint64(base), np.ones(1, np.uint64)

    def up_to(self, n: int) -> np.ndarray:
        if n > len(self.known):
            every = np.full(max(n, 1 << 16), self.base, np.uint64)
            every[0] = 1
            self.known = np.cumprod(every)
        return self.known


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """The hash of each word of a piece: a polynomial in its bytes, from one running sum over the piece."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    word = ~_IS_BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _UP.up_to(len(raw))[: len(raw)], out=running[1:])
    return mix((running[end] - running[start]) * _DOWN.up_to(len(raw))[start] + (end - start).astype(np.uint64))


def _pieces(data: bytes):
    at = 0
    while len(data) - at > PIECE:
        cut = at + PIECE
        while cut < len(data) and not _IS_BLANK[data[cut]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def shingle_set(text: str | bytes | None) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    sets, carried, words = [], np.zeros(0, np.uint64), 0
    for piece in _pieces(data):
        own = word_hashes(piece)
        words += len(own)
        run = np.concatenate([carried, own])
        if len(run) >= WORDS:
            n = len(run) - WORDS + 1
            total = run[:n] * _PLACE[0]
            for k in range(1, WORDS):
                total += run[k : k + n] * _PLACE[k]
            sets.append(np.unique(mix(total)))
        carried = run[-(WORDS - 1) :]
    if not words:
        return np.zeros(0, np.uint64)
    if words < WORDS:
        return mix((carried * _PLACE[: len(carried)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(carried)))
    return sets[0] if len(sets) == 1 else np.unique(np.concatenate(sets))
