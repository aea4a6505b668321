"""Collocations against counting every phrase, on small tables with awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import chunks, collocations


def brute(rows, least, longest, covered, limit):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        scored = []
        for p, a in candidates.items():
            if not inside[p] * 100 >= covered * a:
                score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def texts(seed, n, words):
    rnd = random.Random(seed)
    vocabulary = ["The", "the", "a", *(f"w{k}" for k in range(30)), "größe", "Ä" * 3, "naïve"]
    for _ in range(n):
        yield "".join(rnd.choices(vocabulary, [1 / (j + 1) for j in range(len(vocabulary))])[0] + rnd.choice([" ", "  ", "\t", " ", " ", ", ", ".\n", "\r\n", "\x0b"]) for _ in range(rnd.randint(0, words)))


ROWS = [(t, lang) for k, lang in enumerate(["en", "de", None, "und", "en"]) for t in texts(k, 60, 80)]
ROWS += [(None, "en"), ("", "fr"), (" \t.", "fr"), ("a a a a a a a b a b a b a b " * 40, "en"), ("a a a a a a a b a b a b a b " * 40, "en"), ("x" * 3000 + " lonely", "en"), ("In New York. In New York! " * 30, "en"), ("in new york city " * 8, "en")]


@pytest.mark.parametrize(("least", "hot", "chunk", "piece"), [(10, 1 << 21, 1 << 20, 1 << 20), (10, 60, 1 << 20, 1 << 20), (3, 200, 600, 50), (10, 5, 900, 80)])
def test_against_every_phrase(spark, monkeypatch, least, hot, chunk, piece):
    """Also with pivots that are hot, and texts cut into many pieces and chunks."""
    monkeypatch.setattr(collocations, "HOT_WORDS", hot)
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(chunks, "PIECE_BYTES", piece)
    docs = spark.createDataFrame(ROWS, "text string, lang string").withColumns({c: F.lit(1) for c in ("doc_id", "words", "chunk", "count", "row_id")}).repartition(3)
    got = collocations.collocations(docs, least, 5, 100, 40)
    assert sorted(tuple(r) for r in got.collect()) == brute(ROWS, least, 5, 100, 40)


def test_no_rows_and_other_bounds(spark):
    docs = spark.createDataFrame(ROWS, "text string, lang string")
    assert collocations.collocations(docs.where("false")).count() == 0
    assert sorted(tuple(r) for r in collocations.collocations(docs, 8, 3, 90, 5).collect()) == brute(ROWS, 8, 3, 90, 5)


def test_each_occurrence_has_one_fragment():
    rng = np.random.default_rng(4)
    rank, opens = rng.integers(-1, 6, 400), rng.random(400) < 0.1
    opens[0] = True
    at, left, right = collocations.fragments(rank, opens, np.ones(400, bool), 4)
    found = Counter((p - x, p + y) for p, lo, hi in zip(at, left, right) for x in range(lo + 1) for y in range(hi + 1) if 1 <= x + y <= 4)
    want = Counter((i, j) for i in range(400) for j in range(i + 1, min(400, i + 5)) if (rank[i : j + 1] >= 0).all() and not opens[i + 1 : j + 1].any())
    assert found == want
