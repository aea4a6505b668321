"""Dual-tree search for hard negatives against every pair, on small tables with awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import entries, hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, score bigint, window int, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def brute(rows, is_anchor, k=5, m=5, low=80):
    """Lists of (anchor, positive score, negative score, negative): ids of positives of equal score and id are one."""
    good = [(i, l, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v, l in rows if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, l, v in good:
        if is_anchor(i):
            asked[i] = min(asked.get(i, (l, v)), (l, v))
    for a, (l, v) in asked.items():
        top = 2**63 - 1
        scored = [(-max(-top, min(top, sum(x * y for x, y in zip(v, w)))), i, m) for i, m, w in good if len(w) == len(v)]
        best = sorted((s, i) for s, i, other in scored if other == l and i != a)[:k]
        for s, i in best:
            fits = sorted((t, j) for t, j, other in scored if other != l and low * -s <= 100 * -t <= 100 * -s)[:m]
            out += [(a, i, n + 1, j, -s, -t) for n, (t, j) in enumerate(fits)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_awkward_rows(spark):
    rnd = random.Random(5)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(6)], k % 3) for k in range(150)]
    rows += [(k, [round(rnd.random(), 1)] * 6, k % 4) for k in range(200, 260)]  # many ties
    rows += [(300, None, 1), (301, [1.0, None] * 3, 1), (302, [math.nan] * 6, 1), (303, [math.inf] * 6, 1), (304, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(310, [1.0, 2.0], 0), (320, [3.0, 4.0], 0), (330, [1.0, 1.9], 1), (340, [0.0] * 6, 0), (350, [], 0), (351, [], 0), (352, [], 1)]
    rows += [(210, [0.3] * 6, 2), (210, [0.2] * 6, 1), (211, [0.5] * 6, 3)]  # ids that repeat
    docs = frame(spark, rows)
    got = hard_negatives.hard_negatives(docs, docs.where("vec_id % 10 = 0"))
    assert result(got) == brute(rows, lambda i: i % 10 == 0)
    assert hard_negatives.hard_negatives(docs.where("false"), docs).count() == hard_negatives.hard_negatives(docs, docs.where("false")).count() == 0


def test_huge_components(spark):
    rows = [(k, [1e200 * (k % 5 - 2), 3.0 * k, -1e9], k % 2) for k in range(40)] + [(100 + k, [1e8, 2e8 + k, 1e8 * (k % 3)], k % 2) for k in range(40)]
    docs = frame(spark, rows)
    assert result(hard_negatives.hard_negatives(docs, docs.where("vec_id % 4 = 0"))) == brute(rows, lambda i: i % 4 == 0)


def test_node_pairs_are_pruned(spark):
    """In clusters far apart, most products are never formed; results are whole."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 30, (40, 16))
    rows = [(k, (centres[k % 40] + rng.normal(0, 0.5, 16)).tolist(), (k // 40) % 4) for k in range(4000)]
    docs = frame(spark, rows).coalesce(1)
    got = hard_negatives.hard_negatives(docs, docs.where("vec_id % 20 = 0")).cache()
    anchors = sum(k % 20 == 0 for k, _, _ in rows)
    assert result(got) == brute(rows, lambda i: i % 20 == 0)
    assert got.first()["products"] < 2 * anchors * len(rows) / 4
    got.unpersist()


@pytest.mark.parametrize("same", [True, False])
def test_bounds_hold_for_all_members(same):
    rng = np.random.default_rng(9)
    a, b = (hard_negatives.grow(np.floor(rng.normal(0, 50, (200, 5))), rng.integers(0, 2, 200), 8) for _ in range(2))
    for i in range(len(a.lo)):
        for j in range(0, len(b.lo), 7):
            low, high = hard_negatives._bounds(a, np.array([i]), b, np.array([j]))
            products = a.vectors[a.lo[i] : a.hi[i]] @ b.vectors[b.lo[j] : b.hi[j]].T
            assert low[0] <= products.min() and products.max() <= high[0]


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows]
    got = entries.op12_hard_negatives(spark, "/root/testdata/sf0.001")
    assert result(got.withColumn("x", F.lit(0))) == brute(rows, lambda i: i % 100 == 0)
