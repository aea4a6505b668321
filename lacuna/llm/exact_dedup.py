"""Exact dedup with counting quotient filters.

Each partition counts the 64-bit fingerprints of its normalised texts in counting quotient
filters, one for each block of the fingerprint space. The filters of a block merge losslessly,
by sorted remainders, so a fingerprint that came once in the whole table is known to be unique
and its row needs nothing more. Fingerprints that came more often route to byte verification:
only the texts behind them are grouped, by their bytes.

Scale: the filters carry about eight bytes for each distinct fingerprint of a partition, and there are
as many blocks as keep about a million fingerprints in each, so no key can be hot. Rows are known by
their file and number there. The rows behind repeated fingerprints are noted by file and picked as the files are read
again, so only texts that repeat are exchanged, and before that each task has collapsed its own
copies: a group with a third of all rows arrives as one row for each task. What a group's rows are told
goes to those of large groups by a broadcast of bounded size (``shared.hot_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import quotient_filter as cqf
from lacuna.llm.shared import BLANK, Scratch, hot_join, picked_rows, placed, released, session_of

#: Fingerprints that a task holds before it folds them into sorted distinct ones.
_FOLD = 1 << 20


def normalised(text: Column) -> Column:
    """Each run of blanks becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def _partition_filters(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, counts, waiting, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            fresh = np.concatenate([prints, *waiting])
            return cqf.summed(fresh, np.append(counts, np.ones(len(fresh) - len(counts), np.int64)))

        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held += batch.num_rows
            if held >= _FOLD:
                prints, counts = folded()
                waiting, held = [], 0
        prints, counts = folded()
        if len(prints):
            blocks = cqf.block_of(prints, bits)
            edges = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), len(blocks))
            for lo in range(0, len(edges) - 1, 256):
                spans = list(zip(edges[lo : lo + 256], edges[lo + 1 : lo + 257], strict=False))
                yield pa.record_batch({"block": pa.array([int(blocks[a]) for a, _ in spans], pa.int32()), "filter": pa.array([cqf.build(prints[a:b], counts[a:b], bits) for a, b in spans], pa.binary())})

    return run


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """From a frame with a bigint column ``fp`` and so many rows: each fingerprint that came more than once, and how often."""
    bits = cqf.block_bits(rows)

    def merge_block(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        prints, counts = cqf.entries(block, cqf.merged(block, group.column("filter").to_pylist(), bits), bits)
        again = counts > 1
        return pa.table({"fp": pa.array(prints[again].view(np.int64)), "copies": pa.array(counts[again])})

    filters = prints.select("fp").mapInArrow(released(_partition_filters(bits)), "block int, filter binary")
    return filters.groupBy("block").applyInArrow(merge_block, "fp bigint, copies bigint")


def _judged(docs: DataFrame, file: str, row: str, scratch: Scratch) -> DataFrame:
    """For each row of ``docs`` with their places: doc_id, file, row, keep_id, group_size, kept, text_sha256."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("norm"), F.col(file).alias("file"), F.col(row).alias("row"))
    sha, fp = F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), F.xxhash64("norm").alias("fp")
    rows = scratch.keep(text.select("doc_id", "file", "row", sha, fp), "rows")
    total = rows.count()
    repeated = scratch.keep(repeated_fingerprints(rows, total), "repeated")
    suspects = scratch.keep(hot_join(rows, repeated, "fp", "copies", total, "inner").drop("copies"), "suspects")
    # Byte verification: the texts behind a repeated fingerprint, grouped by their bytes.
    texts = picked_rows(text.select("norm", "file", "row"), "file", "row", suspects, scratch, "suspects", True)
    distinct_texts = texts.groupBy("norm").agg(F.count("*").alias("n"))
    verified = distinct_texts.where("n > 1").select(sha).groupBy("sha").agg(F.count("*").alias("texts"))
    verified = verified.select("sha", F.assert_true(F.col("texts") == 1, F.lit("two texts share a SHA-256")).alias("fine"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "file", "row")).alias("first")
    groups = suspects.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("size"), first)
    groups = groups.join(verified, "sha").where(F.col("fine").isNull())
    groups = scratch.keep(groups.select("sha", "keep_id", "size", F.col("first.file").alias("keep_file"), F.col("first.row").alias("keep_row")), "groups")
    alone = F.col("size").isNull()
    return hot_join(rows, groups, "sha", "size", total).select(
        "doc_id",
        "file",
        "row",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | ((F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after each run of blanks became one space. The row
    with the smallest doc_id stays. Defined cases: a null text counts as the empty text, so all
    null, empty texts form one group; a text of blanks only is one space. Null ids rank after
    all others; keep_id is null only if the whole group has none. Rows that repeat with text and
    id are rows of their own: just one of them is kept. An empty table gives an empty result.
    Other columns, whatever their names, are ignored.
    """
    scratch = Scratch(session_of(docs), "exact-dedup")
    return _judged(*placed(docs.select("doc_id", "text"), scratch), scratch).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def first_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the corpus pipeline: of equal texts the row with the smallest doc_id stays, just one of each group.

    Defined cases as in ``exact_dedup``: rows without an id go before others only where the whole group has none, rows that share
    id and text are copies of each other, null and empty texts are equal. All columns of ``docs`` stay as they are, whatever their names.
    """
    scratch = Scratch(spark, "first-of-each")
    rows, file, row = placed(docs, scratch)
    gone = _judged(rows, file, row, scratch).where(~F.col("kept")).select(F.col("file").alias(file), F.col("row").alias(row))
    return picked_rows(rows, file, row, gone, scratch, "gone", False)
