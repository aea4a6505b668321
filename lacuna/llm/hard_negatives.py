"""Hard negatives by dual-tree search over inner products.

Vectors are rounded down to whole multiples of 1/``SCALE``, so that scores are exact integers. Anchors and candidates are each
put into trees: balls that are halved along their widest direction. For a pair of nodes, with centres a and b
and radii r and s, every inner product of a member of one and a member of the other lies in
a.b - r|b| - s|a| - rs ... a.b + r|b| + s|a| + rs. A pair whose interval can't give any anchor of the node a row that it
still wants is dropped with all its rows; pairs of leaves are scored exactly.

Two searches. *Positives*: the rows of an anchor's own label with the largest scores; a node wants what may beat the worst kept so far of
any of its anchors. *Negatives*: for each positive p of an anchor, the rows of other labels in the window ``low`` p ... ``high`` p;
a node wants what may fall into the window of any of its anchors' positives, above the worst kept there so far.
Nodes whose rows all have one label are dropped in whole where that label can't be wanted.

Scale: the candidates stay in their partitions, in trees of bounded size, built once for each search. Anchors lie in
files in the shared folder, in the order of a coarse partition of space learned on a bounded sample, so that a part of
them (``ANCHOR_ROWS``) is close together; every task reads them part by part, with the least score that a positive must
have (the worst of the best in the sample), and gives for each anchor what it wants of its own rows. The work is anchors times partitions
where vectors are random ones, as no bound prunes these; less where they form clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.llm.shared import Scratch, open_folder, released, session_of

SCALE = 256
#: Bytes of a tree of candidates, anchors searched together, rows of a leaf.
TREE_BYTES, ANCHOR_ROWS, LEAF = 48 << 20, 1024, 48
#: Rows of the sample that gives cells and first bounds, at most; cells.
SAMPLE_ROWS, CELLS = 4096, 64
#: Up to here float64 has every integer.
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


@dataclass
class Tree:
    """Rows in the order of the leaves; nodes with their rows' range, children, ball, and label if all rows have the same."""

    vectors: np.ndarray  # integers, as float64 or, if products don't fit there, as Python's integers
    order: np.ndarray
    lo: list[int]
    hi: list[int]
    left: list[int]  # -1: a leaf; the right child is the next number
    centre: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    label: list  # None: several


def grow(vectors: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> Tree:
    with np.errstate(over="ignore"):
        rough = vectors.astype(float)
    order = np.arange(len(rough))
    lo, hi, left, centres, radii, only = [0], [len(rough)], [-1], [], [], []
    at = 0
    while at < len(lo):
        rows = order[lo[at] : hi[at]]
        own = rough[rows]
        with np.errstate(over="ignore", invalid="ignore"):
            centre = own.mean(axis=0)
            away = own - centre
            apart = (away * away).sum(axis=1)
        centres.append(centre)
        radii.append(float(np.sqrt(apart.max())) if len(rows) else 0.0)
        same = len(rows) > 0 and (labels[rows] == labels[rows[0]]).all()
        only.append(labels[rows[0]] if same else None)
        if len(rows) > leaf and 0 < radii[-1] < np.inf:
            far = away[np.argmax(apart)]
            middle = len(rows) // 2
            order[lo[at] : hi[at]] = rows[np.argpartition(away @ far, middle)]
            left[at] = len(lo)
            lo += [lo[at], lo[at] + middle]
            hi += [lo[at] + middle, hi[at]]
            left += [-1, -1]
        at += 1
    centre = np.array(centres)
    with np.errstate(over="ignore"):
        norm = np.sqrt((centre * centre).sum(axis=1))
    return Tree(vectors[order], order, lo, hi, left, centre, norm, np.array(radii), only)


def _bounds(a: Tree, i: np.ndarray, b: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval of each node pair's inner products, widened by what float64 may lose."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle = (a.centre[i] * b.centre[j]).sum(axis=1)
        reach = a.radius[i] * b.norm[j] + b.radius[j] * a.norm[i] + a.radius[i] * b.radius[j]
        slack = 1e-9 * ((a.norm[i] + a.radius[i]) * (b.norm[j] + b.radius[j]) + 1)
        least, most = middle - reach - slack, middle + reach + slack
    # Scores are cut to 64 bits; what float64 can't hold bounds nothing.
    return np.fmin(np.where(np.isnan(least), -np.inf, least), _LONG / 2), np.fmax(np.where(np.isnan(most), np.inf, most), -_LONG / 2)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ b.T
    return np.clip(out, -_LONG, _LONG) if out.dtype == object else out


class Kept:
    """For each window of an anchor, the best rows so far: by score, then by the smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.rows: list[list[tuple]] = [[] for _ in low]  # (-score, id, place)
        self.worst = low.copy()

    def offer(self, window: int, scores: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        held = self.rows[window] + [(-s, i, p) for s, i, p in zip(scores.tolist(), ids.tolist(), places.tolist())]
        held.sort(key=lambda x: x[:2])
        self.rows[window] = held[: self.k]
        if len(held) >= self.k:
            self.worst[window] = max(self.low[window], -self.rows[window][-1][0])


def search(anchors: Tree, anchor_ids: np.ndarray, anchor_labels: np.ndarray, owner: np.ndarray, kept: Kept, rows: Tree, ids: np.ndarray, labels: np.ndarray, same_label: bool) -> int:
    """Fill ``kept`` with rows of the tree. Gives the number of products formed.

    ``owner`` has each window's anchor by its place in the tree, ascending; ids and labels are in the order of the given rows.
    """
    formed, stack = 0, [(0, 0)]
    first = np.searchsorted(owner, np.arange(len(anchors.order) + 1))
    while stack:
        i, j = stack.pop()
        one, other = anchors.label[i], rows.label[j]
        if one is not None and other is not None and (one == other) != same_label:
            continue
        lo, hi = first[anchors.lo[i]], first[anchors.hi[i]]
        least, most = _bounds(anchors, np.array([i]), rows, np.array([j]))
        if not ((kept.worst[lo:hi] <= most[0]) & (kept.high[lo:hi] >= least[0])).any():
            continue
        if anchors.left[i] < 0 and rows.left[j] < 0:
            part, where = slice(anchors.lo[i], anchors.hi[i]), rows.order[rows.lo[j] : rows.hi[j]]
            scores = products(anchors.vectors[part], rows.vectors[rows.lo[j] : rows.hi[j]])
            formed += scores.size
            mine = anchors.order[part]
            fits = (anchor_labels[mine][:, None] == labels[where]) == same_label
            if same_label:
                fits &= anchor_ids[mine][:, None] != ids[where]
            line = owner[lo:hi] - anchors.lo[i]
            wanted = fits[line] & (scores[line] >= kept.worst[lo:hi, None]) & (scores[line] <= kept.high[lo:hi, None])
            for w in np.flatnonzero(wanted.any(axis=1)):
                hit = wanted[w]
                kept.offer(lo + w, scores[line[w]][hit], ids[where[hit]], where[hit])
        elif rows.left[j] < 0 or (anchors.left[i] >= 0 and anchors.radius[i] * rows.norm[j] > rows.radius[j] * anchors.norm[i]):
            stack += [(anchors.left[i], j), (anchors.left[i] + 1, j)]
        else:  # the half with the larger bound last, so first: it lifts what the other must beat
            both = np.array([rows.left[j], rows.left[j] + 1])
            upper = _bounds(anchors, np.array([i, i]), rows, both)[1]
            stack += [(i, int(x)) for x in both[np.argsort(upper)]]
    return formed


# -- tables ---------------------------------------------------------------------------------


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and the vector, as array<double> of whole numbers; rows that take no part are left out."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), v.alias("vector")
    )


def _read(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = batch.column("vector")
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    given = flat.flatten().to_numpy(zero_copy_only=False)
    given = given.reshape(batch.num_rows, len(given) // max(1, batch.num_rows))
    with np.errstate(over="ignore"):
        whole = np.floor(given * SCALE)
    if not np.isfinite(whole).all() or (whole.shape[1] and np.abs(whole).max(initial=0) ** 2 * whole.shape[1] >= _EXACT / 4):
        exact = [[int(np.floor(x * SCALE)) if abs(x) < 1e300 else int(x) * SCALE for x in row] for row in given.tolist()]
        whole = np.array(exact, dtype=object).reshape(given.shape)
    return batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), whole


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64, or both as Python's integers."""
    if a.dtype == b.dtype:
        return a, b
    return tuple(x if x.dtype == object else np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape) for x in (a, b))


def _trees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, Tree]]:
    held: list[pa.RecordBatch] = []

    def tree():
        ids, labels, whole = _read(pa.Table.from_batches(held))
        return ids, labels, grow(whole, labels)

    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield tree()
            held = []
    if sum(b.num_rows for b in held):
        yield tree()


def _parts(folder: str, rows: int) -> Iterator[pa.Table]:
    files, base = open_folder(folder)
    for info in sorted(files.get_file_info(pafs.FileSelector(base)), key=lambda x: x.path):
        if info.base_name.endswith(".parquet") and not info.base_name.startswith(("_", ".")):
            for batch in pq.ParquetFile(files.open_input_file(info.path)).iter_batches(rows):
                if batch.num_rows:
                    yield pa.Table.from_batches([batch])


def _search_all(candidates: DataFrame, asked: str, k: int, low: int, high: int, same_label: bool) -> DataFrame:
    """For each anchor in the files at ``asked``, and each of its windows, the best rows of each tree of candidates.

    A row without an anchor says how many products a task formed for a part of the anchors.
    """
    size, anchor_rows = TREE_BYTES, ANCHOR_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, tree in _trees(batches, size):
            for part in _parts(asked, anchor_rows):
                anchor_ids, anchor_labels, whole = _read(part)
                mine = grow(whole, anchor_labels)
                mine.vectors, tree.vectors = _alike(mine.vectors, tree.vectors)
                if same_label:
                    floor = part.column("floor").to_pylist()
                    windows = [(p, 0, -_LONG if floor[a] is None else floor[a], _LONG) for p, a in enumerate(mine.order)]
                else:
                    sums = part.column("sums").to_pylist()
                    windows = [(p, n, -(-low * s // 100), high * s // 100) for p, a in enumerate(mine.order) for n, s in enumerate(sums[a])]
                kind = object if tree.vectors.dtype == object else float
                kept = Kept(np.array([w[2] for w in windows], kind), np.array([w[3] for w in windows], kind), k)
                formed = search(mine, anchor_ids, anchor_labels, np.array([w[0] for w in windows]), kept, tree, ids, labels, same_label)
                out = [(int(anchor_ids[mine.order[p]]), n, i, int(-s)) for (p, n, _, _), found in zip(windows, kept.rows) for s, i, _ in found]
                out.append((None, None, None, formed))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor_id", "window", "vec_id", "score"])

    return candidates.mapInArrow(released(run), "anchor_id bigint, window int, vec_id bigint, score bigint")


_NONE = "SELECT 0L AS anchor_id, 0L AS positive_id, 0 AS rank, 0L AS negative_id, 0L AS positive_score, 0L AS negative_score, 0L AS products WHERE false"


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and each of its best ``positives``: the best ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of the positive.

    ``rows`` and ``anchors`` have vec_id, embedding and label. Gives anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score,
    and products, the number of inner products formed by both searches.

    Defined cases: rows take no part whose id, label or vector is null or whose vector holds null or non-finite components;
    empty vectors score 0. Rows are compared with anchors of the same vector length. An anchor's own id is never its positive; of anchors that share an
    id the smallest label and vector is taken; of rows that repeat each counts. Scores beyond 64 bits count as the nearest number of 64 bits. Other columns are ignored.
    """
    spark, scratch = session_of(rows), Scratch(session_of(rows), "negatives")
    good = usable(rows)
    asked = usable(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.label", "x.vector")
    asked = scratch.keep(asked, "anchors")
    sizes = [r["n"] for r in asked.select(F.size("vector").alias("n")).distinct().orderBy("n").collect()]
    found = [_of_length(good.where(F.size("vector") == n), asked.where(F.size("vector") == n), n, positives, negatives, low, high, Scratch(spark, "negatives")) for n in sizes]
    return reduce(DataFrame.unionByName, found) if found else spark.sql(_NONE)


def _of_length(good: DataFrame, asked: DataFrame, n: int, positives: int, negatives: int, low: int, high: int, scratch: Scratch) -> DataFrame:
    spark = session_of(good)
    total = good.count()
    share = int(min(1.0, 1.2 * SAMPLE_ROWS / max(1, total)) * (1 << 30)) + 1
    drawn = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < share).limit(2 * SAMPLE_ROWS).toArrow().sort_by("vec_id").slice(0, SAMPLE_ROWS)
    held = spark.sparkContext.broadcast(drawn)  # SAMPLE_ROWS vectors at most

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each anchor's cell, and the least score that its positives have: the last of the best in the sample."""
        ids, labels, sample = _read(held.value)
        for batch in batches:
            if batch.num_rows:
                own, label, whole = _read(batch)
                whole, other = _alike(whole, sample)
                scores = products(whole, other) if len(ids) else np.zeros((len(own), 0))
                cells = np.argmax(scores[:, :CELLS].astype(float), axis=1) if len(ids) else np.zeros(len(own), int)
                floor = []
                for line, i, of in zip(scores, own, label):
                    mine = np.sort(line[(labels == of) & (ids != i)])
                    floor.append(int(mine[-positives]) if len(mine) >= positives else None)
                yield batch.append_column("cell", pa.array(cells, pa.int32())).append_column("floor", pa.array(floor, pa.int64()))

    ready = asked.mapInArrow(prepare, "vec_id bigint, label bigint, vector array<double>, cell int, floor bigint")
    ready = scratch.keep(ready.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id"), "ready")
    hits = scratch.keep(_search_all(good, scratch.path("ready"), positives, low, high, True), "positives")
    best = W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = hits.where("anchor_id IS NOT NULL").withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    lists = chosen.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))  # ``positives`` entries at most
    wide = ready.join(lists, ready["vec_id"] == lists["anchor_id"]).select("vec_id", "label", "vector", "cell", F.col("found.vec_id").alias("positives"), F.col("found.score").alias("sums"))
    wide = scratch.keep(wide.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id"), "windows")
    misses = scratch.keep(_search_all(good, scratch.path("windows"), negatives, low, high, False), "negatives")
    formed = (hits.where("anchor_id IS NULL").agg(F.sum("score")).first()[0] or 0) + (misses.where("anchor_id IS NULL").agg(F.sum("score")).first()[0] or 0)
    each = W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    ranked = misses.where("anchor_id IS NOT NULL").withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= negatives)
    named = wide.select(F.col("vec_id").alias("anchor"), "positives", "sums")
    return ranked.join(named, ranked["anchor_id"] == named["anchor"]).select(
        "anchor_id",
        F.element_at("positives", F.col("window") + 1).alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        F.element_at("sums", F.col("window") + 1).alias("positive_score"),
        F.col("score").alias("negative_score"),
        F.lit(formed).cast("bigint").alias("products"),
    )
