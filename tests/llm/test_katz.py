"""Katz backoff against its definition, word by word, on small tables with awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import chunks, entries, katz


def brute(rows, order):
    """Rows of (id, text, learned): what fit_and_score gives, from the definitions; and P(word | context)."""
    texts = [(i, learned, re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [None]) for i, t, learned in rows]
    counts = defaultdict(Counter)
    for _, learned, t in texts:
        s = ["<s>", *t]
        for j, w in enumerate(t if learned else []):
            for k in range(min(order - 1, j + 1) + 1):
                counts[tuple(s[j + 1 - k : j + 1])][w] += 1
    few = [Counter() for _ in range(order)]
    for h, f in counts.items():
        few[len(h)].update(f.values())
    left = [katz.discounts([f[r] for r in range(1, katz.DISCOUNTED + 2)]) for f in few]
    tokens, words = sum(counts[()].values()), len(counts[()])

    def kept(h, w):
        c = counts[h][w]
        return (left[len(h)][c] if c <= katz.DISCOUNTED else 1) * c

    @cache
    def whole_and_mass(h):
        total = sum(counts[h].values())
        taken = total - sum(kept(h, w) for w in counts[h])
        return (total, taken / total) if taken > 1e-12 else (total + 1, 1 / (total + 1))

    def p(w, h):
        if not h and not tokens:
            return 1.0
        if h not in counts:
            return p(w, h[1:])
        whole, mass = whole_and_mass(h)
        if w in counts[h]:
            return kept(h, w) / whole
        return weight(h) * p(w, h[1:]) if h else mass

    @cache
    def weight(h):
        return whole_and_mass(h)[1] / (1 - sum(p(x, h[1:]) for x in counts[h]))

    out = []
    for i, learned, t in texts:
        s = ["<s>", *t]
        score = sum(math.log10(p(w, tuple(s[j + 1 - min(order - 1, j + 1) : j + 1]))) for j, w in enumerate(t))
        base = sum(math.log10((counts[()].get(w, 0) + 1) / (tokens + words + 1)) for w in t)
        out.append((i, learned, len(t), sum(w in counts[()] for w in t), tokens, base, score))
    return out, p, counts


RND = random.Random(1)
VOCABULARY = ["The", "the", "of", "a", "b", *(f"w{k}" for k in range(40)), "über", "x" * 300]
ROWS = [(k, " ".join(RND.choices(VOCABULARY, [1 / (j + 1) for j in range(len(VOCABULARY))], k=RND.randint(0, 60))), RND.random() < 0.7) for k in range(120)]
ROWS += [(None, None, True), (7, "", False), (7, " \t", False), (900, "never seen the words of", False), (901, "a a a a a a", True), (901, "a a a a a a", True)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, l boolean").withColumns({c: F.lit(1) for c in ("few", "row_id", "learned", "chunk")}).repartition(3)


def same(got, rows, order):
    got = [tuple(r) for r in got.select("doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    def key(r):
        return r[0] is None, r[0] or 0, r[2], r[3], round(r[5], 6)

    want = brute(rows, order)[0]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize(("order", "spread", "chunk", "piece"), [(1, 1 << 21, 1 << 20, 1 << 20), (2, 1 << 21, 1 << 20, 1 << 20), (3, 40, 1 << 20, 1 << 20), (2, 20, 300, 40), (3, 30, 700, 60)])
def test_scores(spark, monkeypatch, order, spread, chunk, piece):
    """Also with contexts spread over buckets and texts cut into many pieces and chunks."""
    monkeypatch.setattr(katz, "BUCKET_TOKENS", spread)
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(chunks, "PIECE_BYTES", piece)
    same(katz.fit_and_score(frame(spark, ROWS), F.col("l"), order)[0], ROWS, order)


def test_probabilities_sum_to_one():
    _, p, counts = brute(ROWS, 3)
    for h in [(), *RND.sample(sorted(counts, key=str), 40)]:
        assert sum(p(w, h) for w in [*counts[()], b"unknown"]) == pytest.approx(1, rel=1e-9)


def test_stored_model_scores_alike(spark):
    docs = frame(spark, ROWS)
    scores, model = katz.fit_and_score(docs, F.col("l"), 3)
    again = model.score(docs)
    rounded = [Counter((r.doc_id, r.n_tokens, round(r.score, 8)) for r in x.collect()) for x in (scores, again)]
    assert rounded[0] == rounded[1]
    _, _, counts = brute(ROWS, 3)
    assert model.ngrams(2).count() == sum(len(f) for h, f in counts.items() if len(h) == 1)
    weights = model.contexts(2)
    assert weights.count() == sum(len(h) == 1 for h in counts) and weights.where("backoff > 0").count() == weights.count()


def test_nothing_to_learn_from(spark):
    rows = [(i, t, False) for i, t, _ in ROWS[:20]]
    same(katz.fit_and_score(frame(spark, rows), F.col("l"))[0], rows, 2)
    same(katz.fit_and_score(frame(spark, rows), F.lit(None).cast("boolean"))[0], rows, 2)
    assert katz.fit_and_score(frame(spark, rows).where("false"), F.lit(True))[0].count() == 0


def test_query(spark):
    got = entries.op11_katz_lm(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in docs]
    same(got.withColumn("learned", ~F.col("held_out")), rows, 2)
    sums = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_pack_and_cut():
    rng = np.random.default_rng(3)
    arrays = [np.arange(5), np.array([-3, 1 << 40]), rng.random(7), np.zeros(0, np.int64), rng.integers(0, 1 << 64, 4, np.uint64), np.array([True, False]), np.array([1.5])]
    for a, b in zip(arrays, chunks.unpack(chunks.pack(*arrays))):
        assert a.dtype == b.dtype and (a == b).all()
    text = " ".join(f"w{k}" for k in range(200)).encode() + b" " + b"y" * 500 + b" end"
    for overlap in (0, 1, 3):
        words = []
        for data, ahead, _ in chunks.cut(text, katz.WORDS, overlap, 50):
            words += data.split()[ahead:]
        assert words == text.split()
