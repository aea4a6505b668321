"""Quality classifier by compression.

Two Zstandard dictionaries are built from labelled text, one from good and one from bad
documents. A text that compresses better with the good dictionary resembles good text. The evidence is one number: the
difference of both compressed sizes, normalised by the size of the text. Texts are compressed in blocks of ``BLOCK`` bytes, each
by itself, so what a block owes to the dictionaries is not hidden by what it repeats of blocks before it, and the
evidence means the same at any length. A text that repeats itself within its blocks needs few bytes with either
dictionary: its difference is small for its size, which good text never has.

A logistic curve over that number, fitted on labelled texts that the dictionaries have not seen, gives a probability of
label 1. Short texts vary more, so the curve is fitted for each of a few bands of length (``BANDS``), drawn to the
curve over all lengths where a band has few texts.

Training takes a bounded sample of labelled rows (``TRAIN_ROWS`` for each label, chosen by a
hash of the id, and of these as many whole texts as ``TRAIN_BYTES`` hold); scoring reads every whole text, on the executors,
with a model of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.shared import free_name, id_crc32, released, session_of, table, with_fields

#: Labelled rows of each label that training reads at most, and bytes of their texts; texts are taken whole or not at all.
TRAIN_ROWS, TRAIN_BYTES = 4000, 48 << 20
#: Bytes that are compressed together, and bytes of a dictionary.
BLOCK, DICT_BYTES = 768, 262_144
#: Bytes of a text from which on the next curve holds.
BANDS = (128, 512, 2048)
LEVEL = 3
HOLD_OUT, HOLD_OUT_REST = 5, 0
ACCEPT = 0.3


def evidence_of(data: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """The normalised difference: bytes that the good dictionary saves against the bad one, for each byte of the text."""
    view = memoryview(data)
    blocks = [view[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
    return sum(len(bad.compress(x)) - len(good.compress(x)) for x in blocks) / max(len(data), 1)


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and, for each band of length, the logistic curve: weight and offset."""

    good: bytes
    bad: bytes
    curves: tuple[tuple[float, float], ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [_compressor(x) for x in (self.good, self.bad)]

    def evidence(self, texts: list[str | None], tools: list[zstandard.ZstdCompressor]) -> np.ndarray:
        """For each text the normalised difference and its length in bytes."""
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            if data:
                out[i] = evidence_of(data, *tools), len(data)
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        weight, offset = np.array(self.curves)[band_of(evidence[:, 1])].T
        return _curve(evidence[:, 0] * weight + offset)


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, sizes, side="right")


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or, where there is too little text to train one, that text itself."""
    whole = [t.encode("utf-8", "surrogatepass") for t in texts]
    samples = [t[at : at + 8 * BLOCK] for t in whole for at in range(0, len(t), 8 * BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def _curve(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, towards: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float]:
    """Newton's method with a prior that draws weight and offset to given ones."""
    x, start = np.column_stack([x, np.ones(len(x))]), np.array(towards)
    w = start.copy()
    for _ in range(60):
        p = _curve(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (p - y) + ridge * (w - start))
        w = w - step / max(1.0, np.abs(step).max() / 20)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def fit(texts: list[str | None], labels: list[int]) -> QualityModel:
    """Every second text of each label builds the dictionaries, the others fit the curves.

    With one label or none there is nothing to tell apart: the score is the share of label 1,
    with one more of each label.
    """
    of = {q: [t or "" for t, y in zip(texts, labels, strict=True) if y == q] for q in (0, 1)}
    if not of[0] or not of[1]:
        return QualityModel(b"", b"", ((0.0, math.log((len(of[1]) + 1) / (len(of[0]) + 1))),) * (len(BANDS) + 1))
    model = QualityModel(_dictionary(of[1][::2]), _dictionary(of[0][::2]), ())
    seen = [(t, q) for q in (0, 1) for t in (of[q][1::2] or of[q])]
    x, y = model.evidence([t for t, _ in seen], model.compressors()), np.array([q for _, q in seen], float)
    overall, band = _logistic(x[:, 0], y), band_of(x[:, 1])
    return QualityModel(model.good, model.bad, tuple(_logistic(x[band == k, 0], y[band == k], 0.1, overall) for k in range(len(BANDS) + 1)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on labelled documents that are not held out, ``rows`` of each label at most.

    Labels that are null or other than 0 and 1, and null ids, are left out; of labels that share an id the smallest holds, and of documents
    that share one the smallest text. The sample is taken by a hash of the id before texts are read, so two small
    lists of ids travel, then the sizes of their texts, then the whole texts that ``TRAIN_BYTES`` hold.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("labelled"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isin(0, 1) & F.col("labelled").isNotNull() & (id_crc32(F.col("labelled"), HOLD_OUT) != HOLD_OUT_REST))
    known = known.groupBy("labelled").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("labelled"), F.col("labelled")]
    taken = known.where("quality = 0").orderBy(*order).limit(rows).unionByName(known.where("quality = 1").orderBy(*order).limit(rows))
    # Both sides of the union are bounded by a parameter, so this side may be broadcast.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(taken), F.col("doc_id") == F.col("labelled"))
    size = F.octet_length("text").cast("bigint")
    sizes = sample.groupBy("labelled").agg(F.min(F.struct(size.alias("n"), F.xxhash64("text").alias("h"))).alias("x"), F.first("quality").alias("quality")).select("labelled", "quality", "x.n", "x.h").orderBy(*order).collect()
    held, chosen = {0: 0, 1: 0}, []
    for r in sizes:
        if held[r.quality] + r.n <= TRAIN_BYTES:
            held[r.quality] += r.n
            chosen.append((r.labelled, r.quality, r.n, r.h))
    if not chosen:
        return fit([], [])
    picks = session_of(docs).createDataFrame(chosen, "labelled bigint, quality int, n bigint, h bigint")
    same = (F.col("doc_id") == F.col("labelled")) & (size == F.col("n")) & (F.xxhash64("text") == F.col("h"))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picks), same)
    got = texts.groupBy("labelled").agg(F.first("text").alias("text"), F.first("quality").alias("quality")).orderBy("labelled").collect()
    return fit([r.text for r in got], [r.quality for r in got])


def score(docs: DataFrame, model: QualityModel, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and ``name`` (double, 0 to 1).

    The whole text is compressed. A null or empty text has no evidence and gets the shortest band's curve's
    value at zero. Rows that repeat are scored each. A column of that name in ``docs`` is replaced.
    """
    held = session_of(docs).sparkContext.broadcast(model)  # two dictionaries: 512 KB at any size of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = held.value.compressors()
        for batch in batches:
            texts = (x.as_py() for x in batch.column(batch.schema.get_field_index("text")))
            found = np.concatenate([held.value.evidence([t], tools) for t in texts] or [np.zeros((0, 2))])
            yield batch.append_column(name, pa.array(held.value.score(found)))

    plain = docs.drop(name)
    return plain.mapInArrow(released(run), with_fields(plain, **{name: "double"}))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, ...): doc_id, held_out, score, predicted.

    Defined cases: a null text counts as empty and is scored as in ``score``; very long texts are compressed whole, block by
    block. Rows that repeat, and rows without an id (not held out unless crc32 of the empty text says so), are scored each. Labels
    that are null, not 0 or 1 or without an id teach nothing; without labels of both kinds every score is the share of label 1. An empty
    table gives an empty result. Other columns of either table are ignored, whatever their names.
    """
    slim = docs.select("doc_id", "text")
    out = score(slim, train(docs, labels))
    return out.select(
        "doc_id",
        (id_crc32(F.col("doc_id"), HOLD_OUT) == HOLD_OUT_REST).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"),
    )


def keep_accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the corpus pipeline: the documents that the classifier does not reject.

    Defined cases as in ``classify``; rows that repeat stay or go together, and all columns of ``docs`` keep their names and values.
    """
    name = free_name(docs, "quality_score")
    return score(docs, train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), name).where(F.col(name) >= ACCEPT).select(*docs.columns)
