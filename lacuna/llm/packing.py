"""Packing documents into sequences: best-fit decreasing over token counts.

1. Tokenise: each task encodes its documents (ids of a public tokenizer, then an end id) and
   cuts overlong ones into full windows and a rest. It numbers its pieces within each length.
2. Plan: best-fit decreasing needs only how many pieces of each length there are, at most as
   many numbers as a window has tokens, whatever the corpus. A segment tree indexed by
   remaining capacity finds the tightest open window that a length fits; windows with equal
   contents are handled together, as runs.
3. Place: the pieces of a length are numbered through the whole table from the tasks' counts. What came
   before a task is noted for the readers of its pieces, a number for each length, so each piece finds its run, window and offset
   by binary search, and neither pieces nor a table that grows with the tasks are exchanged. Nothing is sorted or grouped by
   length, so a length that a third of all documents share is no hot key.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.shared import Notes, Scratch, heavy, released, runs_of, session_of, write_notes

WINDOW = 2048
END_ID = 1
#: Words, and parts of words, that a worker remembers the ids of, in each of two generations.
WORDS_HELD = 120_000
#: Pieces that a task hands on together.
ROWS_HELD = 1024
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
#: Characters whose lower case and composed form are plain for certain: ASCII and the letters of Latin-1.
_PLAIN = re.compile(r"[\x20-~\t-\rÀ-ÖØ-öø-ÿ]*")
#: The tokenizer's own cut (fixed values), for lower-cased plain text.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """For each of the first 256 characters, its UTF-8 bytes as byte-level BPE writes them: each
    byte as a printable character, namely itself or one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    letter = [chr(b if b in plain else next(others)) for b in range(256)]
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class Remembered(dict):
    """What a function gave, for its recent arguments: two generations of ``WORDS_HELD`` at most."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= WORDS_HELD:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordEncoder:
    """Ids of texts by a word-wise tokenizer, from the ids of their words.

    The tokenizer drops blanks and no token spans one, so a text's ids are those of its parts in
    a row. Plain text is cut and written here, as the tokenizer's own first steps would do it, and
    its parts go straight to the merge model; other words go through the whole tokenizer. Ids of
    recent parts are remembered as bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.letters = _byte_letters()
        self.words, self.parts = Remembered(self._word), Remembered(self._part)

    def _part(self, part: str) -> bytes:
        return _bytes([t.id for t in self.merge(part if part.isascii() else part.translate(self.letters))])

    def _word(self, word: str) -> bytes:
        return _bytes(self.whole.encode(word, add_special_tokens=False).ids)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return self._plain(text)
        return b"".join([self._plain(w) if _PLAIN.fullmatch(w) and "<|" not in w else self.words[w] for w in _BLANK.split(text)])


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class CapacityTree:
    """A segment tree over capacities 0..size: how many open windows have each, and the smallest sufficient one."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = np.zeros(2 * self.leaves, np.int64)

    def add(self, capacity: int, count: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += count
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that an open window has."""
        at = need + self.leaves
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


@dataclass
class PackingPlan:
    """For each length, runs of pieces: from which number on, the first window, and the offset there.

    ``step`` is how many pieces of the run share a window: piece k of a run lies in window
    ``first + k // step`` at ``offset + k % step * length``.
    """

    starts: dict[int, list[int]] = field(default_factory=dict)
    runs: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)  # first window, offset, step
    used: list[tuple[int, int, int]] = field(default_factory=list)  # windows from, to, tokens in each

    def place(self, length: int, number: int) -> tuple[int, int]:
        at = bisect_right(self.starts[length], number) - 1
        first, offset, step = self.runs[length][at]
        k = number - self.starts[length][at]
        return first + k // step, offset + k % step * length


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> PackingPlan:
    """Pack ``counts[length]`` pieces of each length: the longest first, each into the tightest open window."""
    plan, tree, next_window = PackingPlan(), CapacityTree(window), 0
    open_runs: dict[int, list[tuple[int, int]]] = {}  # capacity: runs of windows (first, how many)

    def open_up(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_runs.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)
        elif n:
            plan.used.append((first, first + n, window))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, number = counts[length], 0
        starts, runs = plan.starts.setdefault(length, []), plan.runs.setdefault(length, [])
        while left and (capacity := tree.tightest(length)) is not None:
            # A window that got one piece is the tightest for the next of that length, so each is filled before the next.
            first, n = open_runs[capacity].pop()
            step = capacity // length
            full = min(n, left // step)
            rest = left - full * step if full < n and left < n * step else 0
            tree.add(capacity, -n)
            starts.append(number)
            runs.append((first, window - capacity, step))
            open_up(capacity - step * length, first, full)
            open_up(capacity - rest * length, first + full, 1 if rest else 0)
            used = full + bool(rest)
            open_up(capacity, first + used, n - used)
            number, left = number + full * step + rest, left - full * step - rest
        if left:  # no open window has room: new ones, each filled with this length before the next
            step = window // length
            starts.append(number)
            runs.append((next_window, 0, step))
            full, rest = divmod(left, step)
            open_up(window - step * length, next_window, full)
            if rest:
                open_up(window - rest * length, next_window + full, 1)
            next_window += full + bool(rest)
    plan.used += [(first, first + n, window - capacity) for capacity, rows in open_runs.items() for first, n in rows]
    return plan


def padded_length(tokens: int, window: int = WINDOW) -> int:
    """A sequence is padded to the window, unless its length is a power of two."""
    return tokens if tokens & (tokens - 1) == 0 else window


_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("task", T.IntegerType()),
        T.StructField("number", T.LongType()),
    ]
)


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of each document, numbered within each length and task; with ``with_ids`` their ids too."""
    schema = T.StructType([*_PIECES.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, seen = _encoder(tokenizer), TaskContext.get().partitionId(), [0] * (window + 1)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                doc_id, text = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                ids = encoder.ids(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    n = len(part) // 4
                    rows.append((doc_id, start, n, zlib.crc32(part), total, task, seen[n], *([part] if with_ids else [])))
                    seen[n] += 1
                if len(rows) >= ROWS_HELD:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(released(run, "_encoder"), schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.record_batch([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(zip(*rows, strict=True), schema.fields, strict=True)], names=schema.names)


@heavy
@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """For each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length (and ids).

    Defined cases: a null or empty text is one piece, the end id. Rows that repeat are packed
    each. Null ids stay null. An empty table packs to nothing. Other columns are ignored.
    """
    scratch = Scratch(session_of(docs), "packing")
    found = scratch.keep(pieces(docs, tokenizer, window, with_ids), "pieces")
    counts = scratch.keep(found.groupBy("length", "task").agg(F.count("*").alias("n")), "counts")
    # At most one row for each length: the window bounds what the driver gets.
    plan = best_fit_decreasing({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)
    before = counts.select("length", "task", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    folder = scratch.path("before")
    write_notes(before, "task", folder)
    schema = T.StructType([f for f in found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").schema.fields] + [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "padded_length")] + [f for f in found.schema.fields if f.name == "ids"])
    used = sorted(plan.used)
    firsts = np.array([a for a, _, _ in used], np.int64)
    tokens = np.array([n for _, _, n in used], np.int64)

    def by_length(noted: pa.Table) -> np.ndarray:
        out = np.zeros(window + 1, np.int64)
        out[noted.column("length").to_numpy()] = noted.column("before").to_numpy()
        return out

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = Notes(folder)
        for task, batch in (run for whole in batches for run in runs_of(whole, "task")):
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy() + notes.of(task, by_length)[length]
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                at = np.searchsorted(plan.starts[n], number[mine], side="right") - 1
                first, start, step = np.array(plan.runs[n], np.int64)[at].T
                k = number[mine] - np.array(plan.starts[n], np.int64)[at]
                sequence[mine], offset[mine] = first + k // step, start + k % step * n
            held = tokens[np.searchsorted(firsts, sequence, side="right") - 1]
            padded = np.where(held & (held - 1), window, held)
            same = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            rest = [batch.column("ids")] if with_ids else []
            yield pa.record_batch([*same, pa.array(sequence), pa.array(offset), pa.array(padded), *rest], names=schema.names)

    return found.mapInArrow(released(place), schema)


def default_tokenizer() -> str:
    """The path of the public word-wise tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the corpus pipeline: a row for each piece, with its ids. Defined cases as in ``pack``."""
    return pack(docs, default_tokenizer(), with_ids=True)
