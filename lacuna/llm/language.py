"""Language identification: sparse multinomial logistic regression on character n-grams.

A text's features are TF-IDF weights of its character 1- to 3-grams (lower-cased; each run of
characters that are no letters counts as one blank), hashed into a fixed table and normalised by
their sum. Document frequencies are counted over all texts that may be learned from. FTRL-proximal with elastic-net
penalties learns the weights from a bounded sample of whole texts, which leaves most of
them exactly zero; a temperature, fitted on labelled texts that training has not seen,
calibrates the probabilities.

Because the features are normalised by a sum, a text's logits are a ratio of two sums over its
n-grams. Scoring needs no feature vector: it adds up table rows, slice by slice, so a text of any
length is read as a whole in bounded memory. Training texts are reduced to their counts where they are read.
"""

from __future__ import annotations

import os
import re
import sys
import tempfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.shared import free_name, heavy, id_crc32, released, session_of, table, with_fields

#: Labelled rows of each language that training reads at most, each as a whole.
TRAIN_ROWS = 1200
TABLE_BITS = 17
EPOCHS, BATCH = 3, 16
#: Beyond so many languages the model holds only the weights that are not zero.
DENSE = 64
#: Texts whose features are held between epochs.
FEATURES_HELD = 10_000
#: Training state of more bytes lies in a temporary file of the driver, as the counts of sample texts always do.
IN_MEMORY = 1 << 28
#: Texts of which probabilities are formed together.
TOGETHER = 1 << 12
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-3, 1e-4
HOLD_OUT, HOLD_OUT_REST = 3, 1
ACCEPT = 0.5
UNKNOWN = "und"
SLICE = 1 << 16
#: Counters of document frequencies that travel together.
BLOCK = 1 << 12
_LETTER = re.compile(r"[^\W\d_]")
#: Odd multipliers of the hash, one for each place in an n-gram.
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@heavy
@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or 32 if it is no letter."""
    letters = (ord(c.lower()) if (c := chr(i)).isalpha() and len(c.lower()) == 1 else i if c.isalpha() else 32 for i in range(sys.maxunicode + 1))
    return np.fromiter(letters, np.uint32, sys.maxunicode + 1)


def grams(text: str) -> np.ndarray:
    """Table places of all 1-, 2- and 3-grams of a text, with repetition."""
    codes = _fold()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == 32
    blank[1:] &= blank[:-1]
    blank[0] = False
    codes = codes[~blank]
    one = codes * _MIX[0]
    two = one[:-1] + codes[1:] * _MIX[1] + np.uint32(0x9E37)
    three = two[:-1] + codes[2:] * _MIX[2]
    return (np.concatenate([one, two, three]) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - TABLE_BITS)


def slices(text: str) -> Iterator[str]:
    """Pieces of a long text; they overlap by two characters, so that no 3-gram is lost (the shorter ones there count twice)."""
    for at in range(0, max(len(text), 1), SLICE):
        yield text[max(0, at - 2) : at + SLICE]


@dataclass(frozen=True)
class SparseTable:
    """Rows of which only the entries that are not zero are held: those of row i from ``starts[i]`` to ``starts[i + 1]``."""

    width: int
    starts: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def total(self, places: np.ndarray) -> np.ndarray:
        """The sum of the rows at these places."""
        place, count = np.unique(places, return_counts=True)
        sizes = self.starts[place + 1] - self.starts[place]
        at = np.repeat(self.starts[place] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.column[at], self.value[at] * np.repeat(count, sizes), minlength=self.width)


def _table(idf: np.ndarray, weights: Callable[[np.ndarray], np.ndarray], classes: int) -> np.ndarray | SparseTable:
    """Rows of idf times weights, and idf."""
    def rows(places: np.ndarray) -> np.ndarray:
        return np.column_stack([idf[places, None] * weights(places), idf[places]]).astype(np.float32)

    if classes <= DENSE:
        return rows(np.arange(len(idf)))
    sizes, columns, values = [], [], []
    for lo in range(0, len(idf), 1 << 12):
        part = rows(np.arange(lo, min(lo + (1 << 12), len(idf))))
        there = part != 0
        sizes.append(there.sum(axis=1))
        columns.append(np.nonzero(there)[1].astype(np.int32))
        values.append(part[there])
    return SparseTable(classes + 1, np.append(0, np.cumsum(np.concatenate(sizes))), np.concatenate(columns), np.concatenate(values))


@dataclass(frozen=True)
class LanguageModel:
    """``table`` has a row for each hashed n-gram: its idf times the weight of each language, and its idf."""

    languages: tuple[str, ...]
    table: np.ndarray | SparseTable
    bias: np.ndarray
    temperature: float

    def logits_of(self, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """As ``logits``, from a text's counts."""
        total = self.table.total(np.repeat(place, count)) if isinstance(self.table, SparseTable) else count @ self.table[place].astype(float)
        return total[:-1] / max(total[-1], 1e-12) + self.bias

    def logits(self, text: str) -> np.ndarray:
        if isinstance(self.table, SparseTable):
            total = sum(self.table.total(grams(part)) for part in slices(text))
            return total[:-1] / max(total[-1], 1e-12) + self.bias
        total = np.zeros(self.table.shape[1])
        for part in slices(text):
            rows = self.table[grams(part)]
            total += np.ones(len(rows), np.float32) @ rows
        return total[:-1] / max(total[-1], 1e-12) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; ``und`` and 0 if there is no letter to go by."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The table places of a whole text's n-grams, and how often each comes."""
    total = np.zeros(1 << TABLE_BITS, np.int64) if len(text) > SLICE else None
    if total is None:
        return np.unique(grams(text), return_counts=True)
    for part in slices(text):
        total += np.bincount(grams(part), minlength=len(total))
    place = np.flatnonzero(total)
    return place, total[place]


def _zeros(shape: tuple[int, int]) -> np.ndarray:
    if 8 * shape[0] * shape[1] <= IN_MEMORY:
        return np.zeros(shape)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, np.float64, "w+", shape=shape)


def _ftrl(features: Callable[[int], tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]:
    """FTRL-proximal over mini-batches. Features are scaled up so that the penalties bite on rare n-grams only."""
    size = 1 << TABLE_BITS
    z, n = _zeros((size + 1, classes)), _zeros((size + 1, classes))
    order = np.random.default_rng(0)

    def weights(place: np.ndarray) -> np.ndarray:
        zz = z[place]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[place])) / ALPHA + L2))

    for _ in range(EPOCHS):
        shuffled = order.permutation(len(target))
        for lo in range(0, len(target), BATCH):
            batch = shuffled[lo : lo + BATCH]
            rows = [features(int(i)) for i in batch]
            place = np.concatenate([np.append(place, size) for place, _ in rows])  # the last place is the bias
            values = [np.append(value * SCALE, 1.0)[:, None] for _, value in rows]
            used, where = np.unique(place, return_inverse=True)
            where = np.split(where, np.cumsum([len(x) for x in values])[:-1])  # no place comes twice in a text
            w = weights(used)
            error = softmax(np.array([(value * w[at]).sum(axis=0) for value, at in zip(values, where, strict=True)]))
            error[np.arange(len(batch)), target[batch]] -= 1
            g = np.zeros_like(w)
            for value, at, e in zip(values, where, error, strict=True):
                g[at] += value * e
            g /= len(batch)
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / ALPHA
            z[used] += g - sigma * w
            n[used] += g * g
    return lambda places: weights(places) * SCALE, weights(np.array([size]))[0]


SCALE = 30.0


def _temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    def loss(t: float) -> float:
        p = np.empty(len(target))
        for lo in range(0, len(p), TOGETHER):
            y = target[lo : lo + TOGETHER]
            p[lo : lo + TOGETHER] = softmax(logits[lo : lo + TOGETHER] / np.exp(t))[np.arange(len(y)), y]
        return -np.log(np.maximum(p, 1e-12)).mean()

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(texts: list[str], languages: list[str]) -> LanguageModel:
    """Fit on texts as they are, with the document frequencies among themselves."""
    counts = [counted(t) for t in texts]
    df = np.zeros(1 << TABLE_BITS)
    for place, _ in counts:
        df[place] += 1
    return fit_counts(counts, languages, df, len(texts))


class HeldCounts(Sequence):
    """The counts of texts, in a temporary file of the driver: none of them stays in memory."""

    def __init__(self):
        self._file, self._at, self._end = tempfile.TemporaryFile(buffering=0), [], 0

    def add(self, places: bytes, counts: bytes) -> None:
        """One more text: its places as int32, its counts as int64."""
        self._file.write(counts + places)
        self._at.append((self._end, len(places) // 4))
        self._end += len(places) + len(counts)

    def arranged(self, order: np.ndarray) -> HeldCounts:
        """The same texts in another order; the file is shared."""
        out = object.__new__(HeldCounts)
        out._file, out._at, out._end = self._file, [self._at[i] for i in order], self._end
        return out

    def __len__(self) -> int:
        return len(self._at)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at, n = self._at[k]
        data = os.pread(self._file.fileno(), 12 * n, at)
        return np.frombuffer(data, np.int32, n, 8 * n), np.frombuffer(data, np.int64, n)


def fit_counts(counts: Sequence[tuple[np.ndarray, np.ndarray]], languages: list[str], df: np.ndarray, documents: int) -> LanguageModel:
    """Four of five texts train the weights, the others the temperature (all, if there are under 20)."""
    names = tuple(sorted(set(languages)))
    if not names:
        return LanguageModel((), np.zeros((1 << TABLE_BITS, 1), np.float32), np.zeros(0), 1.0)
    target = np.searchsorted(names, languages)
    apart = np.arange(len(counts)) % 5 == 4 if len(counts) >= 20 else np.zeros(len(counts), bool)
    seen = np.flatnonzero(~apart)
    idf = np.log((1 + documents) / (1 + df)) + 1

    def features(k: int) -> tuple[np.ndarray, np.ndarray]:
        place, count = counts[seen[k]]
        value = count * idf[place]
        return place, value / max(value.sum(), 1e-12)

    weights, bias = _ftrl(lru_cache(FEATURES_HELD)(features), target[seen], len(names))
    model = LanguageModel(names, _table(idf, weights, len(names)), bias, 1.0)
    rest = np.flatnonzero(apart) if apart.any() else seen
    logits = _zeros((len(rest), len(names)))
    for k, i in enumerate(rest):
        logits[k] = model.logits_of(*counts[i])
    return LanguageModel(names, model.table, bias, _temperature(logits, target[rest]))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a task's texts each n-gram comes, in blocks of counters, and (block -1) how many texts there are."""
    df, texts = np.zeros(1 << TABLE_BITS, np.int64), 0
    for batch in batches:
        for value in batch.column(0):
            text, texts = value.as_py(), texts + 1
            there = np.zeros(len(df), bool)
            for part in slices(text):
                there[grams(part)] = True
            df += there
    blocks = df.reshape(-1, BLOCK)
    used = [-1, *np.flatnonzero(blocks.any(axis=1)).tolist()]
    yield pa.record_batch({"block": pa.array(used, pa.int32()), "counts": pa.array([zlib.compress((np.array([texts]) if i < 0 else blocks[i]).tobytes(), 1) for i in used], pa.binary())})


def _summed(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in group.column("counts").to_pylist())
    return pa.table({"block": group.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with a letter, as their counts: a row has no more of them than the table has places."""
    for batch in batches:
        rows = [(r["lang"], r["h"], r["doc_id"], *counted(r["text"])) for r in batch.to_pylist() if _LETTER.search(r["text"])]
        if rows:
            lang, h, doc_id, places, counts = zip(*rows, strict=True)
            yield pa.record_batch({"lang": pa.array(lang, pa.string()), "h": pa.array(h, pa.int64()), "doc_id": pa.array(doc_id, pa.int64()), "places": pa.array([p.astype(np.int32).tobytes() for p in places], pa.binary()), "counts": pa.array([c.astype(np.int64).tobytes() for c in counts], pa.binary())})


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on documents with a language that are not held out, ``rows`` of each language at most.

    A language is a value of ``lang`` that is not null. Texts that are null or have no letter teach no language; document
    frequencies are counted over all others that are not held out. The sample follows a hash of id and text, so rows that share an id are not
    drawn together; rows that share both are drawn once. Texts become counts on the executors, those travel.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (id_crc32(F.col("doc_id"), HOLD_OUT) != HOLD_OUT_REST))
    known = known.select("lang", F.col("doc_id").cast("bigint"), "text")
    blocks = known.select("text").mapInArrow(released(_document_frequencies, "_fold"), "block int, counts binary").groupBy("block").applyInArrow(_summed, "block int, counts binary").collect()
    df, documents = np.zeros((1 << TABLE_BITS) // BLOCK * BLOCK).reshape(-1, BLOCK), 0
    for r in blocks:  # 1 MB at any size of the corpus
        found = np.frombuffer(r["counts"], np.int64)
        if r["block"] < 0:
            documents = int(found[0])
        else:
            df[r["block"]] = found
    drawn = F.pmod(F.col("h"), F.lit(1 << 30)) < F.col("below")
    top = known.select("lang", F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text")
    sample = top.join(F.broadcast(_share(known, rows)), "lang").where(drawn).select("lang", "h", "doc_id", "text")
    got = sample.mapInArrow(_counts, "lang string, h bigint, doc_id bigint, places binary, counts binary")
    got = got.groupBy("lang", "h", "doc_id").agg(F.first("places").alias("places"), F.first("counts").alias("counts")).orderBy("lang", "h", "doc_id")
    held, languages, taken = HeldCounts(), [], 0
    for r in got.toLocalIterator():  # a partition at a time: all of them grow with the number of languages
        taken = taken + 1 if languages and languages[-1] == r["lang"] else 1
        if taken <= rows:
            held.add(r["places"], r["counts"])
            languages.append(r["lang"])
    shuffled = np.random.default_rng(0).permutation(len(held))
    return fit_counts(held.arranged(shuffled), [languages[i] for i in shuffled], df.reshape(-1), documents)


def _share(known: DataFrame, rows: int) -> DataFrame:
    """For each language the bound on the hash below which about ``rows`` documents lie."""
    counted = known.groupBy("lang").agg(F.count("*").alias("n"))
    return counted.select("lang", F.ceil(F.least(F.lit(1.0), F.lit(1.15 * rows) / F.col("n")) * F.lit(1 << 30)).alias("below"))


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All columns of ``docs`` and the language and its probability, in columns of these names; such columns are replaced."""
    held = session_of(docs).sparkContext.broadcast(model)  # 2.6 MB with four languages, at any size of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [held.value.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            yield batch.append_column(names[0], pa.array([x for x, _ in got], pa.string())).append_column(names[1], pa.array([x for _, x in got], pa.float64()))

    plain = docs.drop(*names)
    return plain.mapInArrow(released(run, "_fold"), with_fields(plain, **dict(zip(names, ("string", "double"), strict=True))))


def predict_languages(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, lang, ...): doc_id, held_out, lang_pred, score.

    Defined cases: null texts and texts without a letter get ``und`` and 0, as does every text where no language
    could be learned. Very long texts are read whole, slice by slice. Rows that repeat are predicted each; rows without an id teach nothing. Of
    languages that are equally likely the first by name is given. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    out = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (id_crc32(F.col("doc_id"), HOLD_OUT) == HOLD_OUT_REST).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage of the corpus pipeline: documents whose language is recognised with some certainty.

    Defined cases as in ``predict_languages``; rows that repeat stay or go together, and all columns of ``docs`` keep their names and values.
    """
    names = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    out = identify(docs, train(table(spark, sf_dir, "documents")), names)
    return out.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= ACCEPT)).select(*docs.columns)
