"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The best segmentation of a text is the path with the largest sum of piece scores. Splitting a
text into chunks, each chunk is a matrix over the max-plus semiring: the best score from each
place where a path can enter it (a piece may stick out of the chunk before by less than the
longest piece) to each place where it can enter the next one. The matrices combine associatively:
a scan over a balanced tree gives the best scores with which each chunk can be entered. From those
every chunk tells by itself where a path enters it that leaves it at a given place; these maps,
composed from the end, give all boundaries, and then every chunk is traced back by itself.

No piece of a word-wise vocabulary has a blank after another character, or a line break, so paths
always meet at those places. Between two of those places a best path is that of the segment alone, which
is remembered, and a chunk's matrix needs work at its two ends only. Giant documents are cut by length before
anything else is done to them, and one pass over a chunk gives all that is ever needed of it: its matrix,
the ids between its first and its last meeting place, and the few characters at its ends that are left to trace.

The result is ``ids``, those of the best path. The public model file was trained for merges (BPE); its
merge order is no sum of scores, so no max-plus scan gives it, and the scan reads the file's pieces and scores as a
unigram lattice. The merge ids, which are what the library gives for the file as it is, come beside them: a merge never
crosses those places either, so they are the library's ids of all segments in a row.

Ties go to the longer last piece. Scores are summed in double precision.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.shared import Scratch, heavy, released, session_of, with_fields

#: Documents with more characters are split into chunks of as many.
CHUNK = 1 << 15
#: Segments that a worker remembers, in each of two generations.
SEGMENTS_HELD = 300_000
#: A segment of so many characters is no word that comes again: it is forgotten at once.
GIANT = 1 << 12
#: Characters of the documents whose new segments are encoded together.
TOGETHER = 1 << 21
#: Rows of chunks that are unpacked at a time, and bytes of ids that are decoded at a time.
CHUNKS_HELD, IDS_HELD = 16, 1 << 22
BLANK = "▁"
#: A word with the blanks before it, blanks alone, or a line break: no piece has one, nor spans the places between these.
_SEGMENT = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
NONE = -np.inf


@dataclass(frozen=True)
class Chunk:
    """What one pass over a chunk leaves of it.

    ``head`` ends at the first place where all paths meet and ``tail`` begins at the last one; the tail goes on
    beyond the chunk as far as a piece reaches. Without such a place the head is all of that and the tail None.
    ``body`` is how many characters of the tail (of the head, without a tail) are the chunk's own.
    """

    matrix: np.ndarray
    head: str
    said: str
    ids: bytes
    merge_ids: bytes
    tail: str | None
    body: int


class Vocabulary:
    """Pieces, scores and ids of a model file; how texts are written and best paths found."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        usual = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.pieces = {self.library.id_to_piece(i): (float(self.library.get_score(i)), i) for i in usual}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        texts = {i: p.replace(BLANK, " ").encode() for p, (_, i) in self.pieces.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        #: What each id stands for.
        self.texts = pa.array([texts.get(i, b"") for i in range(size)], pa.large_binary())
        self.longest = max(map(len, self.pieces))
        #: Score and id of each piece, None for what only begins one.
        self.trie = {p[:n]: None for p in self.pieces for n in range(1, len(p))} | self.pieces
        self.unknown = min(s for s, _ in self.pieces.values()) - 10.0
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.pieces):
            raise ValueError("a piece has a line break, or a blank after another character: segments are not independent")
        self.lattices = Lattices(self)
        self.known: dict[str, tuple[float, bytes, bytes]] = {}
        self.older: dict[str, tuple[float, bytes, bytes]] = {}
        self.passing: list[str] = []

    def written(self, text: str) -> str:
        """Blanks as the blank sign, and one in front."""
        return BLANK + text.replace(" ", BLANK) if text else ""

    def arcs(self, text: str, at: int) -> list[tuple[int, float, int]]:
        """The pieces that start at a place: length, score, id; an unknown character has id -1."""
        out, look = [], self.trie.get
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            got = look(text[at:end], 0)
            if got == 0:
                break
            if got:
                out.append((end - at, *got))
        if not out or out[0][0] != 1:
            out.append((1, self.unknown, -1))
        return out

    def best_path(self, text: str, start: int, end: int) -> tuple[float, list[int]]:
        """The best path from one place to another: its score, and its ids. Unknown characters become bytes."""
        size, look, longest, unknown, limit = end - start, self.trie.get, self.longest, self.unknown, len(text)
        best, back = [NONE] * (size + 1), [(0, 0)] * (size + 1)
        best[0] = 0.0
        for at in range(size):
            here = best[at]
            if here == NONE:
                continue
            single, place = True, start + at
            for to in range(at + 1, min(at + longest, size, limit - start) + 1):
                got = look(text[place : start + to], 0)
                if not got:
                    if got == 0:
                        break
                    continue
                score = here + got[0]
                if to == at + 1:
                    single = False
                if score > best[to]:
                    best[to], back[to] = score, (at, got[1])
            if single and here + unknown > best[at + 1]:
                best[at + 1], back[at + 1] = here + unknown, (at, -1)
        if best[size] == NONE:
            return NONE, []
        ids, at = [], size
        while at:
            before, i = back[at]
            ids += [i] if i >= 0 else [self.bytes[b] for b in reversed(text[start + before : start + at].encode("utf-8", "surrogatepass"))]
            at = before
        return best[size], ids[::-1]

    def learn(self, segments: set[str]) -> None:
        """Encode segments that are not remembered: best score, ids of the best path, merge ids."""
        for s in self.passing:
            self.known.pop(s, None)
        if len(self.known) > SEGMENTS_HELD:
            self.older, self.known = self.known, {}
        new = segments.difference(self.known)
        if self.older:
            again = self.older.keys() & new
            self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
            new -= again
        new = sorted(new, key=len, reverse=True)
        self.passing = new[: next((k for k, s in enumerate(new) if len(s) < GIANT), len(new))]
        short = next((k for k, s in enumerate(new) if len(s) <= Lattices.LONGEST), len(new))
        scores, ids = [0.0] * short, [b""] * short
        slow = list(range(short))
        for lo in range(short, len(new), Lattices.ROWS):
            total, paths, odd = self.lattices.best_paths(new[lo : lo + Lattices.ROWS])
            scores += total
            ids += paths
            slow += [lo + k for k in odd]
        for k in slow:  # long, or with a character that is no piece
            scores[k], path = self.best_path(new[k], 0, len(new[k]))
            ids[k] = _bytes(path)
        self.known.update(zip(new, zip(scores, ids, self.merged(new), strict=True), strict=True))

    def merged(self, segments: list[str]) -> list[bytes]:
        """The library's ids. It puts a blank sign in front of a text: that of a segment that has one, or
        else one before a line break, which is no part of any merge; both are taken off again."""
        asked = [s[1:].replace(BLANK, " ") if s[0] == BLANK else f"\n{s}" for s in segments]
        got = self.library.encode(asked, num_threads=1)
        for k, s in enumerate(segments):
            if s[0] != BLANK:
                del got[k][:2]
            elif s == BLANK:
                got[k] = [self.pieces[BLANK][1]]
        ends = (4 * np.cumsum(list(map(len, got)), dtype=np.int64)).tolist()
        flat = np.fromiter(chain.from_iterable(got), np.uint32).tobytes()
        return [flat[a:e] for a, e in zip([0, *ends], ends)]

    def segments(self, parts: list[str]) -> list[tuple[float, bytes, bytes]]:
        """What is known of each segment, in order."""
        self.learn(set(parts))
        return list(map(self.known.__getitem__, parts))

    def segment(self, part: str) -> tuple[float, bytes, bytes]:
        return self.segments([part])[0]

    def decoded(self, ids: pa.Array) -> list[bytes | None]:
        """The UTF-8 texts that rows of ids (binary) stand for, with the blank in front; None for null rows."""
        rows = [np.frombuffer(x.as_buffer(), np.uint32) if x.is_valid else None for x in ids]
        every = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.uint32)])
        taken = self.texts.take(pa.array(every))
        places = np.frombuffer(taken.buffers()[1], np.int64, len(every) + 1) if len(every) else np.zeros(1, np.int64)
        said, out, at = taken.buffers()[2], [], 0
        for r in rows:
            if r is None:
                out.append(None)
                continue
            first, last, at = int(places[at]), int(places[at + len(r)]), at + len(r)
            out.append(said.slice(first, last - first).to_pybytes() if last > first else b"")
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded(pa.array([ids.astype(np.uint32).tobytes()], pa.binary()))[0].decode("utf-8", "replace").removeprefix(" ")

    # -- chunks -----------------------------------------------------------------------------

    def _reach(self, text: str, start: int, stop: int, end: int) -> np.ndarray:
        """Best scores from each of ``longest`` places from ``start`` on to each of ``longest`` places from
        ``end`` on, over pieces that start before ``stop``."""
        size = self.longest
        best = np.full((end + size - start, size), NONE)
        for i in range(min(size, end + size - start)):
            best[i, i] = 0.0
        for at in range(start, min(stop, len(text))):
            here = best[at - start]
            if here.max() == NONE:
                continue
            for n, score, _ in self.arcs(text, at):
                np.maximum(best[at + n - start], here + score, out=best[at + n - start])
        return best[end - start :].T

    def chunk(self, text: str, a: int, b: int) -> Chunk:
        """One pass over the chunk from a to b; ``text`` goes on beyond b by the longest piece at least."""
        parts, beyond = _SEGMENT.findall(text[a:b]), text[b : b + self.longest]
        if len(parts) < 2:
            head = text[a:b] + beyond
            return Chunk(self._reach(head, 0, b - a, b - a), head, "", b"", b"", None, b - a)
        head, tail, body = parts[0], parts[-1] + beyond, len(parts[-1])
        middle = self.segments(parts[1:-1])
        total = sum(s[0] for s in middle)
        matrix = self._reach(head, 0, len(head), len(head))[:, :1] + total + self._reach(tail, 0, body, body)[:1]
        return Chunk(matrix, head, "".join(parts[1:-1]), b"".join([s[1] for s in middle]), b"".join([s[2] for s in middle]), tail, body)

    def entered(self, head: str, tail: str | None, body: int, scores: np.ndarray) -> list[int]:
        """For each place to leave a chunk at, where the best path enters it; ``scores`` are those of the entries."""
        stop = len(head) if tail is not None else body
        best = [NONE] * (stop + 2 * self.longest)
        best[: len(scores)] = scores.tolist()
        back = list(range(len(best)))
        for at in range(stop):
            if best[at] != NONE:
                for n, score, _ in self.arcs(head, at):
                    if best[at] + score > best[at + n]:
                        best[at + n], back[at + n] = best[at] + score, at

        def entry(node: int) -> int:
            while back[node] != node:
                node = back[node]
            return min(node, self.longest - 1)

        return [entry(stop)] * self.longest if tail is not None else [entry(body + j) for j in range(self.longest)]

    def matrix(self, text: str, a: int, b: int) -> np.ndarray:
        """The transfer matrix of a chunk."""
        return self.chunk(text, a, b).matrix

    def enter_map(self, text: str, a: int, b: int, scores: np.ndarray) -> list[int]:
        c = self.chunk(text, a, b)
        return self.entered(c.head, c.tail, c.body, scores)

    def trace(self, text: str, a: int, b: int, enter: int, leave: int) -> bytes:
        """The ids of the best path from ``a + enter`` to ``b + leave``."""
        c = self.chunk(text, a, b)
        if c.tail is None:
            return _bytes(self.best_path(c.head, enter, c.body + leave)[1])
        return _bytes(self.best_path(c.head, enter, len(c.head))[1]) + c.ids + _bytes(self.best_path(c.tail, 0, c.body + leave)[1])


class Lattices:
    """Best paths of many short segments at once: one step over all of them for each place and length.

    A piece is found by the hash of its characters, in a table without collisions: keys that share a bucket are
    shifted together to places that are free. Hashes are compared in full.
    """

    LONGEST, ROWS = 32, 8192
    PLACES, BUCKETS = 1 << 17, 1 << 14
    _BASE = 0x9E3779B97F4A7C15

    def __init__(self, vocabulary: Vocabulary):
        pieces = list(vocabulary.pieces)
        self.longest = vocabulary.longest
        self.up = np.array([pow(self._BASE, k, 1 << 64) for k in range(self.LONGEST + 1)], np.uint64)
        self.down = np.array([pow(self._BASE, -k, 1 << 64) for k in range(self.LONGEST + 1)], np.uint64)
        # The last place of each row stands for what is no piece, which is found as -1.
        scores = [vocabulary.pieces[p][0] for p in pieces]
        self.single, self.several = np.array([*scores, vocabulary.unknown]), np.array([*scores, NONE])
        self.lengths = np.array([*map(len, pieces), 1])
        self.ids = np.array([vocabulary.pieces[p][1] for p in pieces], np.uint32)
        self._place([self._hash_of(p) for p in pieces])

    def _hash_of(self, piece: str) -> int:
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return int(self._spread((codes * self.up[: len(codes)]).sum(dtype=np.uint64)[None])[0])

    @staticmethod
    def _spread(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def _place(self, hashes: list[int]) -> None:
        buckets: dict[int, list[int]] = {}
        for k, h in enumerate(hashes):
            buckets.setdefault(h % self.BUCKETS, []).append(k)
        self.shift = np.zeros(self.BUCKETS, np.int64)
        self.number, self.hashes = np.full(self.PLACES, -1, np.int32), np.zeros(self.PLACES, np.uint64)
        free = bytearray(b"\1") * self.PLACES
        for bucket, own in sorted(buckets.items(), key=lambda x: -len(x[1])):
            homes = [hashes[k] >> 40 for k in own]
            shift = next(s for s in range(self.PLACES) if len({(h + s) % self.PLACES for h in homes}) == len(own) and all(free[(h + s) % self.PLACES] for h in homes))
            self.shift[bucket] = shift
            for k, h in zip(own, homes, strict=True):
                at = (h + shift) % self.PLACES
                free[at], self.number[at], self.hashes[at] = 0, k, hashes[k]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for what is none."""
        at = ((hashes >> np.uint64(40)).view(np.int64) + self.shift[(hashes & np.uint64(self.BUCKETS - 1)).view(np.int64)]) & (self.PLACES - 1)
        return np.where(self.hashes[at] == hashes, self.number[at], -1)

    def best_paths(self, segments: list[str]) -> tuple[list[float], list[bytes], list[int]]:
        """Scores and ids of segments (longest first), and which of them have a character that is no piece: their ids lack it."""
        rows, size = len(segments), len(segments[0])
        lengths = np.array([len(s) for s in segments])
        codes = np.zeros((rows, size), np.uint64)
        codes[np.arange(size) < lengths[:, None]] = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        running = np.zeros((size + 1, rows), np.uint64)
        np.cumsum((codes * self.up[:size]).T, axis=0, out=running[1:])
        best, piece = np.full((size + 1, rows), NONE), np.full((size + 1, rows), -1, np.int32)
        best[0] = 0.0
        reach = [int(np.searchsorted(-lengths, -n, side="right")) for n in range(size + 1)]  # rows of at least n characters
        for at in range(size):
            for to in range(at + 1, min(at + self.longest, size) + 1):
                n = reach[to]
                found = self._find(self._spread((running[to, :n] - running[at, :n]) * self.down[at]))
                score = best[at, :n] + (self.single if to == at + 1 else self.several)[found]
                better = score > best[to, :n]
                np.copyto(best[to, :n], score, where=better)
                np.copyto(piece[to, :n], found, where=better)
        steps, at, every = [], lengths.copy(), np.arange(rows)
        while at.any():
            last = piece[at, every]
            steps.append(np.where(at > 0, last, -2))
            at = np.where(at > 0, at - self.lengths[last], 0)
        taken = np.array(steps[::-1]).T  # from first to last; what came after a row's start is -2
        used = taken >= 0
        ids, ends = self.ids[taken[used]].tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
        odd = np.flatnonzero((taken == -1).any(axis=1)).tolist()
        return best[lengths, every].tolist(), [ids[a:e] for a, e in zip([0, *ends], ends)], odd


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def combined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def entry_scores(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """For each chunk the best scores of its entries, over all paths from the start: a scan over a balanced tree."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([combined(below[k], below[k + 1]) if k + 1 < len(below) else below[k] for k in range(0, len(below), 2)])
    before = [np.append(0.0, np.full(len(matrices[0]) - 1, NONE))]
    for below in reversed(levels[:-1]):
        before = [before[k // 2] if k % 2 == 0 else (before[k // 2][:, None] + below[k - 1]).max(axis=0) for k in range(len(below))]
    return before


def boundary_states(maps: list[list[int]]) -> list[int]:
    """The states at all boundaries of chunks on the best path, from what each chunk says of its entries."""
    states = [0]
    for of_leave in reversed(maps):
        states.append(of_leave[states[-1]])
    return states[::-1]


def crc32_joined(first: int, second: int, size: int) -> int:
    """The CRC-32 of two byte strings in a row, from both CRCs and the second's size."""
    return _shifted(first, size) ^ second


def _shifted(crc: int, size: int) -> int:
    """What a CRC becomes when ``size`` zero bytes follow: multiplication by x ** (8 size)."""
    power, base = 1 << 31, 1 << 23  # 1 and x ** 8 in reflected order
    while size:
        if size & 1:
            power = _product(power, base)
        base = _product(base, base)
        size >>= 1
    return _product(crc, power)


def _product(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32, in reflected order."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@heavy
@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_model() -> str:
    """The path of the public model file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@contextmanager
def _uncollected() -> Iterator[None]:
    """Many small objects are made and none in cycles: Python's collector would go through them again and again."""
    held = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if held:
            gc.enable()


def _groups(batch: pa.RecordBatch) -> Iterator[list[tuple[int | None, str]]]:
    """Rows of (doc_id, text) in groups of about ``TOGETHER`` characters."""
    group, held = [], 0
    for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = value.as_py() or ""
        group.append((doc_id, text))
        held += len(text)
        if held >= TOGETHER:
            yield group
            group, held = [], 0
    if group:
        yield group


#: What is told of each stretch of a document: the ids, and ``said``, what of the document they stand for ...
_IDS = {"ids": pa.binary(), "merge_ids": pa.binary(), "said": pa.string()}
#: ... or counts and CRCs of the ids, and whether decoding gives what they stand for.
_DIGESTS = {"ids": ("n_ids", "ids_crc32"), "merge_ids": ("n_merge_ids", "merge_ids_crc32")}
_DIGESTED = {c: pa.int64() for pair in _DIGESTS.values() for c in pair} | {"fine": pa.bool_()}
_STRETCH = {"document": pa.string(), "chunk": pa.int32()}
_WHOLE = {"doc_id": pa.int64()} | _STRETCH
_CUT = {"doc_id": pa.int64(), "document": pa.string(), "number": pa.int32(), "no_sign": pa.bool_(), "part": pa.string(), "body": pa.int32()}
_PASSED = _WHOLE | {"number": pa.int32(), "no_sign": pa.bool_(), "body": pa.int32(), "matrix": pa.binary(), "head": pa.string(), "tail": pa.string()}
_ENDS = {"document": pa.string(), "number": pa.int32(), "head": pa.string(), "tail": pa.string(), "body": pa.int32(), "map": pa.list_(pa.int32())}
_OPEN = _STRETCH | {"text": pa.string(), "start": pa.int32(), "stop": pa.int32(), "merges": pa.string()}


def _decoded(v: Vocabulary, batch: pa.RecordBatch, ids: str) -> list[str | None]:
    """The texts of a column of ids; chunk 0 loses the blank in front."""
    at = batch.schema.get_field_index
    said = [None if x is None else x.decode("utf-8", "replace") for x in v.decoded(batch.column(at(ids)))]
    return [t if t is None or k else t.removeprefix(" ") for t, k in zip(said, batch.column(at("chunk")).to_pylist(), strict=True)]


def _digested(v: Vocabulary, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch with ``_DIGESTED`` in place of ``_IDS``."""
    at, out = batch.schema.get_field_index, {}
    for ids, (n, crc) in _DIGESTS.items():
        buffers = [x.as_buffer() for x in batch.column(at(ids))]
        out |= {n: pa.array([x.size // 4 for x in buffers], pa.int64()), crc: pa.array([zlib.crc32(x) for x in buffers], pa.int64())}
    out["fine"] = pa.array([t == x.as_py() for t, x in zip(_decoded(v, batch, "ids"), batch.column(at("said")), strict=True)])
    kept = {c: batch.column(at(c)) for c in batch.schema.names if c not in _IDS}
    return pa.record_batch(kept | out)


def _open_ends(rows: list[dict], states: list[int]) -> list[tuple]:
    """From the chunks of a document and the states at their boundaries, the stretches left to trace (``_OPEN``).

    Of chunk k, stretch 3k is the head and 3k + 2 the tail; 3k + 1, what lies between, is done already. A segment that
    runs over the end of a chunk has its merges with the stretch that it begins in.
    """
    out: list[list] = []
    begun = 0  # the stretch in which the segment begins that is not at its end yet
    for k, r in enumerate(rows):
        enter, leave, body = states[k], states[k + 1], r["body"]
        whole = r["tail"] is None
        out.append([r["document"], 3 * k, r["head"], enter, body + leave if whole else len(r["head"]), ""])
        out[begun][-1] += r["head"][:body] if whole else r["head"]
        if not whole:
            begun = len(out)
            out.append([r["document"], 3 * k + 2, r["tail"], 0, body + leave, r["tail"][:body]])
    return [tuple(x) for x in out]


def _pieces(docs: DataFrame, model: str, digests: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents encoded at once (doc_id, document, chunk), stretches of giant ones (document, chunk), and whose these are.

    Both tell ``_IDS`` of each row or, with ``digests``, ``_DIGESTED``: then ids are decoded and compared where they
    were made, and neither ids nor texts are handed on.
    """
    scratch = Scratch(session_of(docs), "sentencepiece")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    giant = F.length("text") > CHUNK
    tell, told = (_digested, _DIGESTED) if digests else (lambda v, batch: batch, _IDS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for group in (g for batch in batches for g in _groups(batch)):
            with _uncollected():
                cut = [_SEGMENT.findall(v.written(text)) for _, text in group]
                v.learn(set().union(*cut))
                look, out = v.known.__getitem__, []
                for (doc_id, text), parts in zip(group, cut, strict=True):
                    _, ids, merges = zip(*map(look, parts), strict=True) if parts else ((), (), ())
                    out.append((doc_id, None, 0, b"".join(ids), b"".join(merges), text))
                del cut
            yield tell(v, _batch(out, _WHOLE | _IDS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, task, count = vocabulary(model), TaskContext.get().partitionId(), 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                document, written, count = f"{task}-{count}", v.written(text), count + 1
                # Beyond the chunk its text goes on as far as a piece reaches.
                yield _batch([(doc_id, document, k, BLANK not in text, written[lo : lo + CHUNK + v.longest], min(CHUNK, len(written) - lo)) for k, lo in enumerate(range(0, len(written), CHUNK))], _CUT)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in (b.slice(lo, CHUNKS_HELD) for b in batches for lo in range(0, b.num_rows, CHUNKS_HELD)):
            rows = batch.to_pylist()
            with _uncollected():
                found = [v.chunk(r["part"], 0, r["body"]) for r in rows]
            out = [(r["doc_id"], r["document"], 3 * r["number"] + 1, r["number"], r["no_sign"], c.body, c.matrix.tobytes(), c.head, c.tail, c.ids, c.merge_ids, c.said.replace(BLANK, " ")) for r, c in zip(rows, found, strict=True)]
            yield tell(v, _batch(out, _PASSED | _IDS))

    def entries(group: pa.Table) -> pa.Table:
        group = group.sort_by("number")
        size = int(np.sqrt(len(group.column("matrix")[0].as_buffer()) // 8))
        found = entry_scores([np.frombuffer(m.as_buffer(), np.float64).reshape(size, size) for m in group.column("matrix")])
        return pa.table({"document": group.column("document"), "number": group.column("number"), "scores": pa.array([f.tobytes() for f in found], pa.binary())})

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            if batch.num_rows:
                yield _batch([(*(r[c] for c in _ENDS if c != "map"), v.entered(r["head"], r["tail"], r["body"], np.frombuffer(r["scores"], np.float64))) for r in batch.to_pylist()], _ENDS)

    def states(group: pa.Table) -> pa.Table:
        rows = group.sort_by("number").to_pylist()
        return pa.Table.from_batches([_batch(_open_ends(rows, boundary_states([r["map"] for r in rows])), _OPEN)])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = _bytes(v.best_path(r["text"], r["start"], r["stop"])[1])
                said = r["text"][r["start"] : r["stop"]].replace(BLANK, " ")
                merges = b"".join(v.merged(_SEGMENT.findall(r["merges"])))
                out.append((r["document"], r["chunk"], ids, merges, said if r["chunk"] else said[1:]))
            if out:
                yield tell(v, _batch(out, _STRETCH | _IDS))

    at_once = rows.where(F.coalesce(~giant, F.lit(True))).mapInArrow(released(whole, "vocabulary"), _ddl(_WHOLE | told))
    chunks = rows.where(giant).mapInArrow(cut, _ddl(_CUT)).repartition("document", "number")
    done = scratch.keep(chunks.mapInArrow(released(passed, "vocabulary"), _ddl(_PASSED | told)), "passed")
    # From here on only matrices and the ends of chunks are exchanged; what lies between stays where it was written.
    scored = done.select("document", "number", "matrix").groupBy("document").applyInArrow(entries, "document string, number int, scores binary")
    mapped = done.select("document", "number", "head", "tail", "body").join(scored, ["document", "number"]).mapInArrow(maps, _ddl(_ENDS))
    ends = mapped.groupBy("document").applyInArrow(states, _ddl(_OPEN)).mapInArrow(traced, _ddl(_STRETCH | told))
    # Written, so that no task of what follows has more than one Python worker at a time.
    ends = scratch.keep(ends, "ends")
    return at_once, ends.unionByName(done.select(*_STRETCH, *told)), done.where("number = 0").select("doc_id", "no_sign", "document")


def encode_ids(docs: DataFrame, model: str) -> DataFrame:
    """The ids of each row of ``docs`` (doc_id, text, ...): doc_id, document, chunk, ids, merge_ids.

    Both kinds of ids are unsigned 32-bit little-endian numbers in a row, as in ``packing.pack``. A
    giant document has a row for each stretch; its ids are those of its stretches in a row, by the number in ``chunk``, and ``document``
    tells which stretches belong together. Any other document is one row with chunk 0 and no ``document``. Defined cases as in ``encode``.
    """
    at_once, traces, whose = _pieces(docs, model, False)
    columns = ["doc_id", "document", "chunk", "ids", "merge_ids"]
    return at_once.select(*columns).unionByName(traces.join(whose, "document").select(*columns))


def _by_bytes(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``IDS_HELD`` bytes of a binary column, one row at least."""
    ends = np.cumsum([0 if x is None else x for x in pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + IDS_HELD, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """All columns of ``encoded`` (chunk, ids, ...) and ``decoded``, the text of the column ``ids``; a column of that name is replaced.

    Chunk 0 loses the blank in front; the stretches of a giant document, joined by their numbers, are its text.
    Null ids have no text. Bytes that are no UTF-8 become the replacement character.
    """
    plain = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in (part for b in batches for part in _by_bytes(b, ids)):
            yield batch.append_column("decoded", pa.array(_decoded(v, batch, ids), pa.string()))

    return plain.mapInArrow(run, with_fields(plain, decoded="string"))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Digests of the ids that ``encode_ids`` gives and of their decoding, for each row of ``docs`` (doc_id, text, ...): doc_id, n_ids, ids_crc32, n_merge_ids, merge_ids_crc32, round_trip.

    ids are those of the best path, merge ids those of the library; both CRCs are over unsigned
    32-bit little-endian ids. round_trip tells whether decoding the ids gives the text. Defined
    cases: a null or empty text has no ids and a round trip; a blank sign in a text decodes to a space, so its round trip fails.
    Rows that repeat are encoded each, ids may be null or repeat. An empty table gives an empty
    result. Other columns are ignored.
    """
    at_once, traces, whose = _pieces(docs, model, True)
    columns = [c for pair in _DIGESTS.values() for c in pair]

    def joined(group: pa.Table) -> pa.Table:
        rows, out = group.sort_by("chunk").to_pylist(), {"document": pa.array(group.column("document")[:1].to_pylist())}
        for n, crc in _DIGESTS.values():
            size = total = 0
            for r in rows:
                total, size = crc32_joined(total, r[crc], 4 * r[n]), size + r[n]
            out |= {n: pa.array([size], pa.int64()), crc: pa.array([total], pa.int64())}
        return pa.table(out | {"round_trip": pa.array([all(r["fine"] for r in rows)])})

    giants = traces.groupBy("document").applyInArrow(joined, f"document string, {', '.join(f'{c} bigint' for c in columns)}, round_trip boolean")
    giants = giants.join(whose, "document").select("doc_id", *columns, (F.col("round_trip") & F.col("no_sign")).alias("round_trip"))
    return at_once.select("doc_id", *columns, F.col("fine").alias("round_trip")).unionByName(giants)


def _ddl(columns: dict[str, pa.DataType]) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{c} {names[k]}" for c, k in columns.items())


def _batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), columns.values(), strict=True)], names=list(columns))
