"""N-gram Jaccard join: near-duplicate documents by T-occurrence search.

Two documents link if their sets of word shingles have a Jaccard similarity of at least
``PERCENT``; the result is the connected components of all links. No similar pair is missed:

1. Documents with equal sets are one class, known by 128 bits of a digest of all members. A fixed-size table of counts, summed
   over the whole corpus, orders shingles from rare to frequent.
2. Let a set of n need an overlap of T = ceil(0.8 n). By that order, two sets that link share l of the first n - T + l shingles of each, for any l.
   With l = n - T + 1, a set that has fewer than that of its smallest possible partner (of T shingles) in common with any others can't link: it is dropped. For that the
   first shingles of all sets are exchanged once, packed by ranges of hashes; what is left are sets that are mostly made of what others have too.
3. Of these, the first n - T + 1 shingles are posted. Those that share one get an edge to the first of them, not to each other, so edges are as many as postings at
   most. The components of these edges are neighbourhoods: what links lies in the same one.
4. Sets come together by neighbourhood, and there DivideSkip finds the links: of the inverted lists of a set's members the longest
   are set aside, the short ones are merged by a heap that skips what can't come often enough, and what comes often enough is looked up
   in the long lists by binary search. A search leaves out what the set is joined with already, so a group of
   many similar sets needs few long searches and gives as many links as it has sets.
5. A neighbourhood of more than ``BLOCK_SHINGLES`` is searched in blocks of about that size, by bands of set size (sets
   that link are in the same band or in neighbouring ones). Most of a large group is one component by then; only sets outside it are
   asked of the other blocks.
6. Links merge to components by smallest labels and pointer jumping.

Texts are not exchanged: the sets that are left after step 2 are built where their texts are read again.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.shared import Notes, Scratch, hot_join, noted_runs, picked_rows, placed, released, runs_of, session_of, write_row_notes
from lacuna.llm.shingles import shingle_set

PERCENT = 80
#: The count table has 2 ** SKETCH_BITS counters, in blocks of 2 ** SKETCH_BLOCK_BITS.
SKETCH_BITS, SKETCH_BLOCK_BITS = 22, 12
#: Shingles of the sets that are searched together.
BLOCK_SHINGLES = 1 << 20
#: Links that a task collapses at a time, postings that it packs at a time, and postings of a range of hashes.
CHUNK, PACKED, RANGE = 1 << 20, 1 << 18, 1 << 20
#: Sets whose counts are summed together.
OWNERS = 1 << 16
#: Entries of short lists up to which the heap merges them; more are merged by sorting their runs, which does the same in arrays.
HEAP_ENTRIES = 1 << 10


# -- sets -----------------------------------------------------------------------------------


def required(n: int) -> int:
    """The smallest overlap of a set of n with any set that it links to."""
    return -(-PERCENT * n // 100)


def required_pair(a: int, b: np.ndarray) -> np.ndarray:
    """The smallest overlap i with 100 i >= PERCENT (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def digest_of(shingles: np.ndarray) -> bytes:
    """The identity of a set: 128 bits of a digest of all its members."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _short(digest: bytes) -> int:
    """64 bits of the identity, for counts and neighbourhoods. If two sets share these bits, their neighbourhoods are one, and shingles that only they
    share count for one of them; a link could be lost only between two such sets (2 ** -64 for a pair)."""
    return int.from_bytes(digest[:8], "little", signed=True)


_ROW = "doc_id bigint, file string, row bigint, n bigint, digest binary, short bigint, block int, counts binary"


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, then the task's count table in blocks."""
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in _ROW.split(", ")]
    for batch in batches:
        n, digests = [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py())
            np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            n.append(len(s))
            digests.append(digest_of(s) if len(s) else None)
        rows, short = batch.num_rows, [None if d is None else _short(d) for d in digests]
        kept = [batch.column(c) for c in ("doc_id", "file", "row")]
        yield pa.record_batch([*kept, *[pa.array(x, k) for x, k in zip((n, digests, short), kinds[3:6], strict=True)], pa.nulls(rows, kinds[6]), pa.nulls(rows, kinds[7])], names=names)
    blocks = counts.reshape(-1, 1 << SKETCH_BLOCK_BITS)
    used = np.flatnonzero(blocks.any(axis=1))
    if len(used):
        gone = [pa.nulls(len(used), k) for k in kinds[:6]]
        yield pa.record_batch([*gone, pa.array(used, kinds[6]), pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in used], kinds[7])], names=names)


def _sum_block(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64) for x in group.column("counts").to_pylist())
    total = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
    return pa.table({"block": group.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


class Order:
    """Shingles from rare to frequent, by the count of their place in the table, then by hash."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def first(self, s: np.ndarray, more: int) -> np.ndarray:
        """The first n - T + ``more`` shingles of a set."""
        count = self.counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        return s[np.lexsort((s, count))[: len(s) - required(len(s)) + more]]


# -- what can link at all -------------------------------------------------------------------

_POSTED = "part bigint, hashes binary, owners binary, several binary, shared binary, times binary"


def least_shared(n: str) -> str:
    """SQL: how many of its first shingles a set of ``n`` must share, by its smallest possible partner."""
    least = f"(({PERCENT} * {n} + 99) div 100)"
    return f"({least} - ({PERCENT} * {least} + 99) div 100 + 1)"


def _totals(owners: np.ndarray) -> tuple[bytes, bytes]:
    shared, times = np.unique(owners, return_counts=True)
    return shared.tobytes(), times.astype(np.int64).tobytes()


def _post(order, parts: int):
    """The first shingles of all sets, packed by ranges of hashes: those of one set of the task (``hashes`` and ``owners``), those of ``several``, and
    how many of the latter each set has (``shared``, ``times``)."""

    def packed(hashes: np.ndarray, owners: np.ndarray) -> pa.RecordBatch:
        at = np.lexsort((owners, hashes))
        hashes, owners = hashes[at], owners[at]
        start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        size = np.diff(np.append(start, len(hashes)))
        alone = np.repeat(size == 1, size)
        several, single = hashes[start[size > 1]], hashes[alone]
        edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
        cut, cut_several = (np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]).tolist() for x in (single, several))
        of_single, told = owners[alone], _totals(owners[~alone])
        # Ranges that are empty get no row, so rows are as many as postings at most; the totals go with the first.
        ranges = [(k, *x) for k, x in enumerate(zip(cut, cut[1:], cut_several, cut_several[1:])) if x[0] < x[1] or x[2] < x[3]]
        rows = [(k, single[a:b].tobytes(), of_single[a:b].tobytes(), several[c:d].tobytes(), *(told if i == 0 else (b"", b""))) for i, (k, a, b, c, d) in enumerate(ranges)]
        kinds = (pa.int64(), *[pa.binary()] * 5)
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _POSTED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners, held, seen = [], [], 0, set()  # a task posts equal sets once
        for batch in batches:
            for text in batch.column("text"):
                s = shingle_set(text.as_py())
                if not len(s) or (key := _short(digest_of(s))) in seen:
                    continue
                seen.add(key)
                hashes.append(order.value.first(s, len(s) - required(len(s)) + 1))
                owners.append(np.full(len(hashes[-1]), key))
                held += len(hashes[-1])
                if held >= PACKED:
                    yield packed(np.concatenate(hashes), np.concatenate(owners))
                    hashes, owners, held = [], [], 0
        if held:
            yield packed(np.concatenate(hashes), np.concatenate(owners))

    return run


_COUNTED = "part bigint, shared binary, times binary"


def _shared(owner_parts: int):
    """How many hashes of a range each set shares with others, packed by ranges of sets."""

    def run(group: pa.Table) -> pa.Table:
        hashes, owners, several = _column(group, "hashes", np.uint64), _column(group, "owners", np.int64), _column(group, "several", np.uint64)
        order = np.lexsort((owners, hashes))
        hashes, owners = hashes[order], owners[order]
        fresh = np.append(True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1]))[: len(hashes)]  # copies in other tasks
        hashes, owners = hashes[fresh], owners[fresh]
        start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))[: len(hashes)]
        size = np.diff(np.append(start, len(hashes)))
        more = np.isin(hashes[start], several) | (size > 1)
        shared, times = _summed(np.append(owners[np.repeat(more, size)], _column(group, "shared", np.int64)), np.append(np.ones(int(size[more].sum()), np.int64), _column(group, "times", np.int64)))
        part = shared.view(np.uint64) % np.uint64(owner_parts)
        rows = [(k, shared[part == k].tobytes(), times[part == k].tobytes()) for k in np.unique(part).tolist()]
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["part", "shared", "times"])

    return run


def _column(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(name)])


def _summed(shared: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(shared, return_inverse=True)
    return found, np.bincount(at, times, minlength=len(found)).astype(np.int64)


def _sum_shared(group: pa.Table) -> pa.Table:
    found, times = _summed(_column(group, "shared", np.int64), _column(group, "times", np.int64))
    return pa.table({"short": found, "k": times})


# -- neighbourhoods -------------------------------------------------------------------------


def _stars(hashes: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From postings: each hash with the least set that posts it, and edges from those sets to the others."""
    order = np.lexsort((short, hashes))
    hashes, short = hashes[order], short[order]
    start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    hub = np.repeat(short[start], np.diff(np.append(start, len(hashes))))
    apart = hub != short
    edges = np.unique(np.stack([hub[apart], short[apart]], axis=1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
    return hashes[start], short[start], edges[:, 0], edges[:, 1]


def _rows(hashes: np.ndarray, posts: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Postings (hash, a) and edges (a, b) in one batch."""
    none = pa.nulls
    return pa.record_batch([pa.concat_arrays([pa.array(hashes), none(len(a), pa.int64())]), pa.array(np.append(posts, a)), pa.concat_arrays([none(len(posts), pa.int64()), pa.array(b)])], names=["hash", "a", "b"])


def _post_left(order):
    """The first shingles of the sets that are left, collapsed by task: postings (hash, a) and edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, short, held = [], [], 0
        for batch in batches:
            for key, members in zip(batch.column("short").to_pylist(), batch.column("members"), strict=True):
                hashes.append(order.value.first(np.frombuffer(members.as_buffer(), np.uint64), 1).view(np.int64))
                short.append(np.full(len(hashes[-1]), key))
                held += len(hashes[-1])
            if held >= CHUNK:
                yield _rows(*_stars(np.concatenate(hashes), np.concatenate(short)))
                hashes, short, held = [], [], 0
        if held:
            yield _rows(*_stars(np.concatenate(hashes), np.concatenate(short)))

    return run


def _join_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from the postings of all tasks, which come sorted by hash; the last list of a chunk waits for its rest, as its least set."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column("hash").to_numpy(), batch.column("a").to_numpy()))
        if sum(len(h) for h, _ in held) >= CHUNK:
            hashes, posts, a, b = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = [(hashes[-1:], posts[-1:])]
            yield pa.record_batch({"a": a, "b": b})
    if held:
        _, _, a, b = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.record_batch({"a": a, "b": b})


# -- search ---------------------------------------------------------------------------------


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """What comes in ``need`` or more of the sorted lists, and in how many: a heap of the lists' heads, which skips
    over what fewer lists than that could still hold."""
    heap, place, out = [(x[0], i) for i, x in enumerate(lists)], [0] * len(lists), []
    heapq.heapify(heap)
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            out.append((top, len(popped)))
            following = top + 1
        else:
            while len(popped) < need - 1 and heap:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            following = heap[0][0]
        for i in popped:
            place[i] = bisect_left(lists[i], following, place[i])
            if place[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][place[i]], i))
    return out


class TOccurrence:
    """An index of sets that finds those with a required overlap, by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        order = np.argsort(every, kind="stable")  # owners stay in order within a list
        every, self.owner = every[order], owner[order]
        start = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        self.member, self.start = every[start], np.append(start, len(every))
        #: List and owner of each entry as one number, ascending.
        self.entry = np.repeat(np.arange(len(start)), np.diff(self.start)) * len(sets) + self.owner

    def search(self, query: np.ndarray, lo: int = 0, hi: int = 0) -> np.ndarray:
        """The places of all sets that are similar enough to the query, but for those from ``lo`` to ``hi``."""
        none, k, need = np.zeros(0, np.int64), len(self.size), required(len(query))
        at = np.minimum(np.searchsorted(self.member, query), len(self.member) - 1)
        at = at[self.member[at] == query]
        if len(at) < need:
            return none
        first, last = self.start[at], self.start[at + 1]
        out, back = (np.searchsorted(self.entry, at * k + x) for x in (lo, hi))
        length = last - first - (back - out)
        there = length > 0
        if there.sum() < need:
            return none
        order = np.flatnonzero(there)[np.argsort(length[there], kind="stable")]
        aside = min(int(need / (math.log2(max(2, int(length[order[-1]]))) + 1)), need - 1)
        short, long = order[: len(order) - aside], at[order[len(order) - aside :]]
        parts = [(first[i], out[i], back[i], last[i]) for i in short.tolist()]
        if length[short].sum() <= HEAP_ENTRIES:
            got = merge_skip([[*self.owner[a:b].tolist(), *self.owner[c:d].tolist()] for a, b, c, d in parts], need - aside)
            found, total = np.array([x for x, _ in got], np.int64), np.array([n for _, n in got], np.int64)
        else:
            found, total = np.unique(np.concatenate([self.owner[x:y] for a, b, c, d in parts for x, y in ((a, b), (c, d))]), return_counts=True)
            found, total = found[total >= need - aside].astype(np.int64), total[total >= need - aside]
        least = required_pair(len(query), self.size[found])
        for n, i in enumerate(long.tolist()):
            alive = total + (len(long) - n) >= least
            found, total, least = found[alive], total[alive], least[alive]
            if not len(found):
                return none
            asked = i * k + found
            total = total + (self.entry[np.minimum(np.searchsorted(self.entry, asked), len(self.entry) - 1)] == asked)
        return found[total >= least]


class Forest:
    """Union-find: the least member stands for a tree."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def links_within(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links among sets by which all that are connected are: a spanning forest of all links.

    First only sets are asked that no search has found yet. Then sets are numbered by component, so that what a set is joined with is
    one stretch of each list, and the others are asked for what lies outside it.
    """
    index, forest, links, asked = TOccurrence(sets), Forest(len(sets)), [], np.zeros(len(sets), bool)
    reached = np.zeros(len(sets), bool)

    def note(i: int, found: list[int]) -> None:
        links.extend((i, j) for j in found if forest.join(i, j))

    for i, s in enumerate(sets):
        if not reached[i]:
            asked[i], found = True, index.search(s, i, i + 1)
            reached[found] = True
            note(i, found.tolist())
    label = np.array([forest.root(i) for i in range(len(sets))])
    if asked.all() or (label == label[0]).all():
        return links
    order = np.argsort(label, kind="stable")
    index, by = TOccurrence([sets[i] for i in order]), label[order]
    for i in np.flatnonzero(~asked).tolist():
        lo, hi = np.searchsorted(by, label[i]), np.searchsorted(by, label[i], side="right")
        note(i, order[index.search(sets[i], int(lo), int(hi))].tolist())
    return links


def _units(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[list[pa.RecordBatch]]:
    """Rows that come sorted by unit, as the batches of one unit at a time."""
    held, last = [], None
    for batch in batches:
        for key, part in runs_of(batch, unit):
            if held and key != last:
                yield held
                held = []
            last = key
            held.append(part)
    if held:
        yield held


def _sets_of(parts: list[pa.RecordBatch]) -> tuple[list[bytes], list[np.ndarray]]:
    digests = [x for p in parts for x in p.column(p.schema.get_field_index("digest")).to_pylist()]
    return digests, [np.frombuffer(x.as_buffer(), np.uint64) for p in parts for x in p.column(p.schema.get_field_index("members"))]


def _search_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links within each unit."""
    for parts in _units(batches, "unit"):
        digests, sets = _sets_of(parts)
        links = links_within(sets) if len(sets) > 1 else []
        if links:
            yield pa.record_batch({"a": pa.array([digests[i] for i, _ in links], pa.binary()), "b": pa.array([digests[j] for _, j in links], pa.binary())})


def _search_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from queries to the sets of a unit that they are not joined with. A unit's own sets come first, then its queries."""
    unit, held, index, by, digests, forest = None, [], None, None, [], None
    for batch in batches:
        for key, whole in runs_of(batch, "unit"):
            if key != unit:
                unit, held, index = key, [], None
            for asking, part in runs_of(whole, "asking"):
                if not asking:
                    held.append(part)
                    continue
                if index is None:
                    found, sets = _sets_of(held)
                    labels = [x for p in held for x in p.column(p.schema.get_field_index("label")).to_pylist()]
                    order = sorted(range(len(sets)), key=lambda i: labels[i])
                    index, by, digests, told = TOccurrence([sets[i] for i in order]) if sets else None, [labels[i] for i in order], [found[i] for i in order], set()
                if index is None:
                    continue
                out = []
                for digest, s, label in zip(*_sets_of([part]), part.column(part.schema.get_field_index("label")).to_pylist(), strict=True):
                    lo = bisect_left(by, label)
                    hi = bisect_left(by, label + b"\0", lo)
                    for j in index.search(s, lo, hi).tolist():
                        if (label, by[j]) not in told:  # one link joins both components
                            told.add((label, by[j]))
                            out.append((digest, digests[j]))
                if out:
                    yield pa.record_batch({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([x for _, x in out], pa.binary())})


def _band(n: str) -> str:
    """Sets that link are in the same band of sizes or in neighbouring ones; a margin covers rounding."""
    return f"int(floor(ln({n}) / {math.log(100 / PERCENT) * (1 + 1e-9)!r}))"


def _blocked(members: DataFrame, scratch: Scratch) -> DataFrame:
    """``members`` (digest, n, neighbourhood) with the unit that each set is searched in, and the block of large ones."""
    total = members.count()
    sizes = members.groupBy("neighbourhood").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets")).where("sets > 1")
    sized = hot_join(members, scratch.keep(sizes, "sizes"), "neighbourhood", "sets", total, "inner")
    large = F.col("shingles") > BLOCK_SHINGLES
    sized = sized.withColumn("part", F.when(large, F.concat_ws(":", "neighbourhood", F.expr(_band("n")))).otherwise(F.col("neighbourhood").cast("string")))
    sized = scratch.keep(sized.withColumn("large", large).drop("shingles", "sets"), "sized")
    parts = sized.where("large").groupBy("part").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets"))
    parts = scratch.keep(parts.select("part", F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("bigint").alias("blocks"), "sets"), "bands")
    cut = hot_join(sized.where("large"), parts, "part", "sets", total, "inner").drop("sets")
    cut = cut.withColumn("unit", F.concat_ws(":", "part", F.pmod(F.xxhash64("digest"), F.col("blocks"))))
    return sized.where("not large").withColumn("unit", F.col("part")).unionByName(cut.drop("blocks"))


def _with_sets(texts: DataFrame, folder: str) -> DataFrame:
    """The sets of the rows noted."""

    def by_row(noted: pa.Table) -> dict[int, tuple[bytes, int]]:
        return dict(zip(noted.column("row").to_pylist(), zip(noted.column("digest").to_pylist(), noted.column("short").to_pylist(), strict=True), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = Notes(folder)
        for key, batch in (run for whole in batches for run in noted_runs(whole, "file", "row")):
            known = notes.of(key, by_row) or {}
            out = [(*known[row], shingle_set(text.as_py()).tobytes()) for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True) if row in known]
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["digest", "short", "members"])

    return texts.mapInArrow(released(run), "digest binary, short bigint, members binary")


def _by_unit(sets: DataFrame, *order: str) -> DataFrame:
    return sets.repartition("unit").sortWithinPartitions("unit", *order)


def _links_of_large(sets: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between the blocks of large neighbourhoods, from ``sets`` of those and the ``links`` within blocks."""

    def labelled(found: DataFrame, name: str) -> DataFrame:
        labels = components(found, scratch, name)
        known = sets.select("digest", "unit", "neighbourhood").join(labels, F.col("digest") == F.col("vertex"), "left")
        return scratch.keep(known.select("digest", "unit", "neighbourhood", F.coalesce("component", "digest").alias("label")), f"{name}-labels")

    def largest(known: DataFrame, *of: str) -> DataFrame:
        return known.groupBy(*of, "label").agg(F.count("*").alias("k")).groupBy(*of).agg(F.max(F.struct("k", "label")).alias("top")).select(*of, F.col("top.label").alias("label"))

    # The largest component of each block is asked for by the set that names it: this joins what is one large group.
    # If a neighbourhood has more of these than a block holds, they are searched in blocks again, and what names the largest components there comes together.
    turn, between, known = 0, None, labelled(links, "within")
    asked = largest(known, "unit").select(F.col("label").alias("digest")).distinct()
    while True:
        first = scratch.keep(sets.join(asked, "digest", "left_semi"), f"heads{turn}")
        volume = first.groupBy("neighbourhood").agg(F.ceil(F.sum(F.length("members")) / (8 * BLOCK_SHINGLES)).cast("bigint").alias("units"), F.count("*").alias("of"))
        volume = scratch.keep(volume, f"volumes{turn}")
        dealt = hot_join(first.drop("unit"), volume, "neighbourhood", "of", first.count(), "inner").drop("of")
        dealt = dealt.withColumn("unit", F.concat_ws("/", "neighbourhood", F.pmod(F.xxhash64("digest"), F.col("units")))).drop("units")
        found = scratch.keep(_by_unit(dealt, "digest").mapInArrow(_search_units, "a binary, b binary"), f"between{turn}")
        between = found if between is None else between.unionByName(found)
        known = labelled(links.unionByName(between), f"joined{turn}")
        several = dealt.select("digest", F.col("unit").alias("head_unit")).join(volume.where("units > 1"), F.regexp_extract("head_unit", "^[^/]*", 0) == F.col("neighbourhood").cast("string"))
        further = scratch.keep(several.join(known.select("digest", "label"), "digest").groupBy("head_unit", "label").agg(F.count("*").alias("k")).groupBy("head_unit").agg(F.max(F.struct("k", "label")).alias("top")).select(F.col("top.label").alias("digest")).distinct(), f"asked{turn}")
        if further.count() in (0, asked.count()):
            break
        asked, turn = further, turn + 1
    # Every link that is missing has an end outside the largest component of its neighbourhood.
    top = scratch.keep(known.groupBy("neighbourhood", "label").agg(F.count("*").alias("k")).groupBy("neighbourhood").agg(F.max(F.struct("k", "label")).alias("t")).select(F.col("t.label").alias("label"), F.col("t.k").alias("k"), F.lit(True).alias("is_top")), "top")
    others = hot_join(known.select("digest", "label"), top, "label", "k", known.count()).where("is_top IS NULL").select("digest", "label")
    blocks = known.select("unit").distinct().select("unit", F.regexp_extract("unit", "^(.*):", 1).alias("band"))
    near = F.explode(F.expr("transform(array(-1, 0, 1), d -> concat(regexp_extract(part, '^(.*):', 1), ':', int(regexp_extract(part, ':([0-9]+)$', 1)) + d))"))
    asking = sets.join(others, "digest").drop("unit").withColumn("band", near).join(blocks, "band").select("unit", F.lit(True).alias("asking"), "digest", "members", "label")
    own = sets.join(known.select("digest", "label"), "digest").select("unit", F.lit(False).alias("asking"), "digest", "members", "label")
    across = _by_unit(own.unionByName(asking), "asking", "digest").mapInArrow(_search_across, "a binary, b binary")
    return between.unionByName(scratch.keep(across, "across"))


# -- components -----------------------------------------------------------------------------


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, ``CHUNK`` at a time, as links from the smallest vertex of each component to the others."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def told(kind: pa.DataType) -> pa.RecordBatch:
        pairs = [(r, x) for x in parent if (r := root(x)) != x]
        return pa.record_batch({"a": pa.array([a for a, _ in pairs], kind), "b": pa.array([b for _, b in pairs], kind)})

    kind, held = None, 0
    for batch in batches:
        kind, held = batch.column(0).type, held + batch.num_rows
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if held >= CHUNK:
            yield told(kind)
            parent.clear()
            held = 0
    if parent:
        yield told(kind)


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """vertex, component: the smallest vertex that links reach, for each vertex that has a link.

    Tasks contract their own links first. Then each round takes the smallest label among the neighbours, then the label of that label.
    """
    links = links.select("a", "b").where("a != b")
    links = scratch.keep(links.mapInArrow(released(_contracted), links.schema), f"{name}-contracted")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = scratch.keep(both, f"{name}-links")
    labels = both.groupBy(F.col("a").alias("vertex")).agg(F.min(F.least("a", "b")).alias("component"), F.count("*").alias("degree"))
    labels, step, total = scratch.keep(labels, f"{name}-0"), 0, both.count()
    while True:
        # Hubs of stars, and labels that many vertices have, are hot keys.
        of_b = labels.select(F.col("vertex").alias("b"), F.col("component").alias("near"), "degree")
        near = hot_join(both, of_b, "b", "degree", total, "inner").groupBy(F.col("a").alias("vertex")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "vertex").select("vertex", F.col("component").alias("before"), F.least("component", "near").alias("now"), "degree")
        lower = scratch.keep(lower, f"{name}-lower-{step}")
        jump = lower.groupBy("now").agg(F.count("*").alias("of")).join(labels.select(F.col("vertex").alias("now"), F.col("component").alias("of_label")), "now")
        after = hot_join(lower, scratch.keep(jump, f"{name}-jump-{step}"), "now", "of", total).select("vertex", "before", F.least("now", F.coalesce("of_label", "now")).alias("component"), "degree")
        step += 1
        after = scratch.keep(after, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-lower-{step - 1}", f"{name}-jump-{step - 1}")
        changed = not after.where("component != before").isEmpty()
        labels = after.select("vertex", "component", "degree")
        if not changed:
            return labels.select("vertex", "component")


# -- the operator ---------------------------------------------------------------------------


def _grouped(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """For each row of ``texts`` (doc_id, file, row, text): doc_id, file, row, n_shingles, component_id, stays."""
    spark = session_of(texts)
    first = scratch.keep(texts.mapInArrow(released(_first_pass), _ROW), "first")
    rows = first.where("block IS NULL").select("doc_id", "file", "row", "n", "digest", "short")
    blocks = first.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(_sum_block, "block int, counts binary")
    counts = np.zeros((1 << (SKETCH_BITS - SKETCH_BLOCK_BITS), 1 << SKETCH_BLOCK_BITS), np.uint32)
    for r in blocks.collect():  # 16 MB at any size of the corpus
        counts[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    order = spark.sparkContext.broadcast(Order(counts.reshape(-1)))

    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "file", "row")).alias("first")
    classes = rows.where("digest IS NOT NULL").groupBy("digest", "short", "n").agg(least, F.count("*").alias("copies"))
    classes = scratch.keep(classes, "classes")

    volume = classes.agg(F.sum("n").alias("n"), F.count("*").alias("sets")).first()
    parts = max(1, -(-(volume["n"] or 0) * 2 * (100 - PERCENT) // (100 * RANGE)))
    counted = texts.select("text").mapInArrow(released(_post(order, parts)), _POSTED).groupBy("part").applyInArrow(_shared(max(1, -(-volume["sets"] // OWNERS))), _COUNTED)
    shared = counted.groupBy("part").applyInArrow(_sum_shared, "short bigint, k bigint")
    left = classes.join(shared, "short").where(f"k >= {least_shared('n')}")
    left = scratch.keep(left.select("digest", "short", "n", F.col("first.file").alias("file"), F.col("first.row").alias("row")), "left")
    write_row_notes(left.select("file", "row", "digest", "short"), "file", "row", scratch.path("left-notes"))
    sets = scratch.keep(_with_sets(texts.select("file", "row", "text"), scratch.path("left-notes")), "sets")

    posted = scratch.keep(sets.mapInArrow(released(_post_left(order)), "hash bigint, a bigint, b bigint"), "posted")
    lists = posted.where("hash IS NOT NULL").select("hash", "a").repartition("hash").sortWithinPartitions("hash")
    edges = posted.where("hash IS NULL").select("a", "b").unionByName(lists.mapInArrow(_join_lists, "a bigint, b bigint"))
    near = components(edges, scratch, "near").withColumnsRenamed({"vertex": "short", "component": "neighbourhood"})
    members = scratch.keep(left.join(near, "short").select("digest", "n", "neighbourhood"), "members")
    units = _blocked(members, scratch).select("digest", "unit", "part", "neighbourhood", "large")
    sets = scratch.keep(sets.drop("short").join(units, "digest"), "united")
    scratch.drop("sets", "posted")
    links = scratch.keep(_by_unit(sets, "digest").mapInArrow(released(_search_units), "a binary, b binary"), "links")
    order.destroy()  # all that uses it is written
    of_large = sets.where("large")
    if not of_large.isEmpty():
        links = links.unionByName(_links_of_large(of_large, links, scratch))
    labels = components(links, scratch, "all")
    scratch.drop("united", "members")

    found = classes.join(labels, F.col("digest") == F.col("vertex"), "left").select("digest", "copies", "first", F.coalesce("component", "digest").alias("component"))
    found = scratch.keep(found, "found")
    chosen = scratch.keep(found.groupBy("component").agg(F.min("first").alias("chosen"), F.count("*").alias("of")), "chosen")
    told = hot_join(found.drop("first"), chosen, "component", "of", classes.count(), "inner").select("digest", "copies", "chosen")
    told = scratch.keep(told, "told")
    columns = ["doc_id", "file", "row", F.col("n").alias("n_shingles")]
    with_set = hot_join(rows.where("digest IS NOT NULL"), told, "digest", "copies", rows.count(), "inner")
    stays = (F.col("file") == F.col("chosen.file")) & (F.col("row") == F.col("chosen.row"))
    empty = rows.where("digest IS NULL").select(*columns, F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return with_set.select(*columns, F.col("chosen.doc_id").alias("component_id"), stays.alias("stays")).unionByName(empty)


def _placed_texts(docs: DataFrame, file: str, row: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(file).alias("file"), F.col(row).alias("row"), "text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id, stays.

    component_id is the smallest doc_id that links reach, the row's own included. Defined cases: a
    text that is null, empty or without words has an empty set and links with nothing; one of
    fewer than five words has one shingle, the whole sequence. Null ids count as larger than all others, so a
    component has a null id only if all its rows do. Rows that repeat are rows of their own and
    share their component. ``stays`` is true for one row with the smallest doc_id of each component
    and for all rows with an empty set. Very long texts are read in pieces, whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(session_of(docs), "near-duplicates")
    return _grouped(_placed_texts(*placed(docs.select("doc_id", "text"), scratch)), scratch).drop("file", "row")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the corpus pipeline: of each group of near duplicates one row with the smallest id stays.

    Defined cases as in ``near_duplicates``; all columns of ``docs`` keep their names and values.
    """
    scratch = Scratch(spark, "one-of-each")
    rows, file, row = placed(docs, scratch)
    gone = _grouped(_placed_texts(rows, file, row), scratch).where(~F.col("stays")).select(F.col("file").alias(file), F.col("row").alias(row))
    return picked_rows(rows, file, row, gone, scratch, "gone", False)
