"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred, rotated and cut to signs. The rotation is learned (iterative
quantisation: alternate between the signs and the rotation that fits them best) on a bounded
sample, again and again from different starts, which gives ``SUBSTRINGS`` times 16 bits.

Search: a code is split into substrings, each with an index of its own. If substring j is probed with all
values that differ in at most t_j bits, every code that differs in at most r = sum(t_j + 1) - 1 of all bits is retrieved
(the pigeonhole principle); raising r by one raises one t_j. All rows retrieved, also those beyond r, are reranked by the
cosine of the vectors themselves, in double precision. Many substrings probed within one or two bits find a near code far more often
than a far one, so r is calibrated on the sample: the least with which ``COVER`` of the true neighbours are
retrieved. A query that finds too few rows is searched again with a larger r, in the end with all bits. How many
rows were retrieved comes with the result.

Scale: vectors stay in their partitions, which each build their own indexes in blocks. Queries lie in
files in the shared folder; every task reads them in parts of bounded size for each of its blocks, and gives the best k of each query and block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.llm.shared import Scratch, open_folder, session_of

#: Rows that rotations and radius are learned from at most, and queries among them for the radius.
SAMPLE_ROWS, SAMPLE_QUERIES = 8192, 256
SUBSTRINGS, SUBSTRING_BITS, ITERATIONS = 192, 16, 4
#: Share of true neighbours in the sample that the radius must retrieve.
COVER = 0.97
#: Rows that are indexed together, and rows times queries that are looked at together.
BLOCK_ROWS, PAIRS_HELD = 32_768, 1 << 25


@dataclass(frozen=True)
class CodeModel:
    mean: np.ndarray
    planes: np.ndarray  # length of a vector x bits; bits are a multiple of SUBSTRING_BITS
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Rows of unsigned 16-bit substrings."""
        bits = (unit(vectors) - self.mean) @ self.planes > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components stay finite and above zero.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Each pair's product is summed in the same order, so equal vectors get equal scores."""
    return (unit(one[None, :]) * unit(many)).sum(axis=1)


def probe_radii(radius: int, substrings: int) -> np.ndarray:
    """Within how many bits each substring is probed (-1: not at all), so that every code within the radius is retrieved."""
    base, more = divmod(radius + 1 - substrings, substrings)
    return np.minimum(base + (np.arange(substrings) < more), SUBSTRING_BITS)


def radius_needed(apart: np.ndarray) -> np.ndarray:
    """The least radius with which probing retrieves a code whose substrings are so far apart (last axis)."""
    m = apart.shape[-1]
    return (m * apart + np.arange(m)).min(axis=-1)


def learn(sample: np.ndarray, k: int, seed: int = 0) -> CodeModel:
    """Rotations and radius from a sample of vectors."""
    x = unit(sample)
    size, bits = x.shape[1], SUBSTRINGS * SUBSTRING_BITS
    mean = x.mean(axis=0)
    centred = x - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
    turned = centred @ axes
    rng = np.random.default_rng(seed)
    planes = []
    while len(planes) * size < bits:
        rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
        for _ in range(ITERATIONS):
            u, _, v = np.linalg.svd(np.sign(turned @ rotation).T @ turned)
            rotation = (u @ v).T
        planes.append(axes @ rotation)
    model = CodeModel(mean, np.hstack(planes)[:, :bits], 0)
    asked = rng.permutation(len(x))[:SAMPLE_QUERIES]
    similar = x[asked] @ x.T
    similar[np.arange(len(asked)), asked] = -np.inf
    nearest = np.argsort(-similar, axis=1)[:, : min(k, len(x) - 1)]
    if not nearest.size:
        return replace(model, radius=bits)
    codes = model.codes(sample)
    apart = np.bitwise_count(codes[asked][:, None, :] ^ codes[nearest]).astype(np.int64)
    return replace(model, radius=int(np.quantile(radius_needed(apart), COVER, method="higher")))


@lru_cache(maxsize=SUBSTRING_BITS + 1)
def flips(most: int) -> np.ndarray:
    """All substrings with at most so many bits set: what a probe is combined with."""
    every = np.arange(1 << SUBSTRING_BITS, dtype=np.uint16)
    return every[np.bitwise_count(every) <= most]


class BlockIndex:
    """The substring indexes of a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in codes.T]
        self.starts = [np.append(0, np.cumsum(np.bincount(c, minlength=1 << SUBSTRING_BITS))).astype(np.int32) for c in codes.T]

    def retrieved(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """Which rows probing retrieves for each query: all within the radius, and others."""
        found = np.zeros((len(queries), len(self.codes)), bool)
        radii = probe_radii(radius, self.codes.shape[1])
        if radii.min() >= SUBSTRING_BITS:
            found[:] = True
            return found
        for j in np.flatnonzero(radii >= 0):
            starts, probes = self.starts[j], queries[:, j][:, None] ^ flips(int(radii[j]))
            first = starts[probes]
            size = starts[probes.astype(np.int32) + 1] - first
            hit = size > 0
            first, size, query = first[hit], size[hit], np.nonzero(hit)[0]
            at = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
            found[np.repeat(query, size), self.order[j][at]] = True
        return found

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The places of all codes that differ from ``code`` in at most ``radius`` bits."""
        candidates = np.flatnonzero(self.retrieved(code[None, :], radius)[0])
        return candidates[np.bitwise_count(self.codes[candidates] ^ code).sum(axis=1) <= radius]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and the vector as array<double>; vectors that take no part are left out."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)


_NONE = "SELECT 0L AS query_id, 0 AS rank, 0L AS vec_id, 0D AS score, 0L AS retrieved WHERE false"


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each query: query_id, rank (from 1), vec_id, score; the largest cosine first, then the smaller vec_id. And how many rows were retrieved and reranked for it.

    ``rows`` and ``queries`` have vec_id and embedding. Defined cases: rows whose id is null and
    vectors that are null, empty, all zero, or hold nulls or non-finite components take no part.
    A query finds rows of its own vector's length; each length that occurs is searched by itself. A query never finds rows of its own id. Rows that repeat are found each; of queries that share
    an id the smallest vector is asked. With no usable rows the result is empty. Other columns are ignored.
    """
    spark, scratch = session_of(rows), Scratch(session_of(rows), "neighbours")
    good = usable(rows)
    asked = scratch.keep(usable(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    sizes = good.groupBy(F.size("vector").alias("n")).count().join(asked.select(F.size("vector").alias("n")).distinct(), "n", "left_semi").orderBy("n").collect()
    if not sizes:
        return spark.sql(_NONE)
    of = [(size, F.size("vector") == size["n"]) for size in sizes]
    return reduce(DataFrame.unionByName, [_search_length(good.where(own), asked.where(own), size, k, Scratch(spark, "neighbours")) for size, own in of])


def _search_length(good: DataFrame, asked: DataFrame, size: Row, k: int, scratch: Scratch) -> DataFrame:
    """The search among usable rows of one length; ``size`` has the length and the count of rows."""
    spark = session_of(good)
    # A sample by a hash of the id; the bound on the hash keeps about SAMPLE_ROWS at any size.
    share = min(1.0, 1.2 * SAMPLE_ROWS / size["count"])
    drawn = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * SAMPLE_ROWS).collect()
    drawn.sort(key=lambda r: (r["vec_id"], r["vector"]))
    sample = np.array([r["vector"] for r in drawn[:SAMPLE_ROWS]], float).reshape(-1, size["n"])
    model = learn(sample if len(sample) else np.eye(size["n"]), k)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = model.codes(_matrix(batch.column("vector")))
                yield batch.append_column("code", pa.array([c.tobytes() for c in codes], pa.binary()))

    index = scratch.keep(good.mapInArrow(encode, "vec_id bigint, vector array<double>, code binary"), "index")
    wanted, radius, bits, step, results = min(k, size["count"] - 1), model.radius, model.planes.shape[1], 0, []
    while True:
        scratch.keep(asked.select("vec_id", "vector"), f"asked{step}")
        results.append(scratch.keep(_best_of_blocks(index, scratch.path(f"asked{step}"), replace(model, radius=radius), k), f"found{step}"))
        if radius >= SUBSTRING_BITS * SUBSTRINGS + SUBSTRINGS:
            break
        enough = results[-1].where("vec_id IS NOT NULL").groupBy("query_id").count().where(F.col("count") >= wanted).select("query_id")
        short = scratch.keep(asked.join(enough, asked["vec_id"] == enough["query_id"], "left_anti"), f"short{step}")
        if short.isEmpty():
            break
        # Once more with a bit more in each substring, then with all.
        asked, radius, step = short, radius + SUBSTRINGS if not step else bits + SUBSTRINGS, step + 1
        results[-1] = results[-1].join(enough, "query_id", "left_semi")
    everything = reduce(DataFrame.unionByName, results)
    counts = everything.groupBy("query_id").agg(F.sum("retrieved").alias("retrieved"))
    ranked = everything.drop("retrieved").where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).join(counts, "query_id").select("query_id", "rank", "vec_id", "score", "retrieved")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _best_of_blocks(index: DataFrame, asked: str, model: CodeModel, k: int) -> DataFrame:
    """The best k rows of each block for each query in the files at ``asked``; and, with no row, how many were retrieved."""
    held = session_of(index).sparkContext.broadcast(model)  # planes: 24 KB for each component of a vector

    def queries(rows: int) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(asked)
        for info in sorted(files.get_file_info(pafs.FileSelector(base)), key=lambda x: x.path):
            if info.base_name.endswith(".parquet") and not info.base_name.startswith(("_", ".")):
                yield from pq.ParquetFile(files.open_input_file(info.path)).iter_batches(max(1, PAIRS_HELD // rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for block in _blocks(batches):
            row_ids, rows = block.column("vec_id").to_numpy(), _matrix(block.column("vector").chunk(0))
            inside = BlockIndex(np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint16).reshape(len(row_ids), -1))
            units = unit(rows)
            for part in queries(len(row_ids)):
                out: list[tuple] = []
                ids, vectors = part.column("vec_id").to_numpy(), _matrix(part.column("vector"))
                for query, vector, hits in zip(ids.tolist(), vectors, inside.retrieved(model.codes(vectors), model.radius), strict=True):
                    found = np.flatnonzero(hits)
                    found = found[row_ids[found] != query]
                    out.append((query, None, None, len(found)))
                    if len(found) > k:
                        rough = units[found] @ unit(vector[None, :])[0]
                        found = found[rough >= np.partition(rough, -k)[-k] - 1e-9]
                    if len(found):
                        scores = cosines(vector, rows[found])
                        out += [(query, int(row_ids[found[i]]), float(scores[i]), 0) for i in _best(row_ids[found], scores, k)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["query_id", "vec_id", "score", "retrieved"])

    return index.mapInArrow(run, "query_id bigint, vec_id bigint, score double, retrieved bigint")
