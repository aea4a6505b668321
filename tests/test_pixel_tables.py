"""Operators on pixel tables against the kernels and against visiting every pixel."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import pixels as px
from lacuna.operators import regions as rg
from lacuna.operators import thresholds as th
from lacuna.raster import basics as b


def table(spark, images, value="gray", kind="int"):
    rows = [(k, y, x, v) for k, image in images.items() for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame([(k, y, x, float(v) if kind == "double" else int(v)) for k, y, x, v in rows], f"image_id int, y int, x int, {value} {kind}")


def drawn(seed, n=12):
    rng = np.random.default_rng(seed)
    out = {k: np.clip(rng.normal(rng.choice([40, 120, 200], (9, 11), p=rng.dirichlet([1, 1, 1])), 12), 0, 255).astype(np.uint8) for k in range(n)}
    return out | {100: np.full((4, 5), 7, np.uint8), 101: np.repeat([[3], [250]], 4, axis=1).astype(np.uint8), 102: np.array([[0, 1, 2], [0, 0, 2]], np.uint8)}


def test_otsu_and_separability_equal_the_kernels(spark):
    images = drawn(1)
    for r in th.otsu(th.histogram(table(spark, images))).collect():
        level = b.otsu(images[r.image_id])
        assert r.threshold == level and r.separability == pytest.approx(b.separability(images[r.image_id], level), abs=1e-9)


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_multi_otsu_equals_the_kernel(spark, classes):
    images = drawn(2, 6)
    for r in th.multi_otsu(th.histogram(table(spark, images)), classes).collect():
        try:
            want = b.multi_otsu(images[r.image_id], classes)
        except ValueError:
            want = None
        assert r.thresholds == want


def test_dark_level_falls_back_to_otsu(spark):
    images = drawn(3, 2)
    got = {r.image_id: r.threshold for r in th.dark_level(table(spark, images), "multiotsu", 1, 3, offset=1.5).collect()}
    assert got[101] == b.otsu(images[101]) + 1.5 and got[100] == 1.5
    assert all(got[k] == b.multi_otsu(images[k], 3)[1] + 1.5 for k in (0, 1))
    shares = {r.image_id: r.threshold for r in th.dark_level(table(spark, images), "percentile", share=0.25).collect()}
    assert shares[0] == pytest.approx(np.percentile(images[0], 25))


def test_dark_regions_are_those_of_sql_beyond_bytes_at_ties_and_with_few_levels(spark, tmp_path):
    import duckdb

    from lacuna.plans import catalog

    rng = np.random.default_rng(6)
    vectors = [(rng.normal(0, 0.02, 64)).tolist() for _ in range(400)]  # few levels: splits that are equal only as rounded
    vectors += [[-0.7 if k % 7 == 0 else 0.9 if k % 5 == 0 else k / 300 for k in range(64)], [0.1] * 64, [0.1, 0.2] * 32]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("pixel_otsu", "pixel_separability", "pixel_multi_otsu", "pixel_dark_regions"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want) and want, name


def test_texture_without_two_kinds(spark):
    rng = np.random.default_rng(4)
    images = {0: np.concatenate([rng.random(60), 9 + rng.random(60)]).reshape(10, 12), 1: np.zeros((5, 5)), 2: np.full((5, 5), 3.0)}
    got = {r.image_id: (r.threshold, r.separable) for r in th.texture_level(table(spark, images, "t", "double"), "t", 0.99, 0.5).collect()}
    assert got[0][1] and 0.9 < got[0][0] < 9.1 and got[1] == got[2] == (math.inf, False)


@pytest.mark.parametrize(("shape", "radius"), [((7, 9), 1), ((7, 9), 3), ((5, 4), 6), ((1, 6), 2), ((6, 1), 4), ((2, 2), 5), ((3, 3), 0)])
def test_local_moments_equal_mirrored_windows(spark, shape, radius):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, shape)

    def fold(i, n):
        i = i % max(1, 2 * (n - 1)) if n > 1 else 0
        return i if i < n else 2 * (n - 1) - i

    got = {(r.y, r.x): (r.mean, r.mean_square) for r in px.local_moments(table(spark, {0: image}), *shape, radius).collect()}
    for y in range(shape[0]):
        for x in range(shape[1]):
            near = np.array([image[fold(y + dy, shape[0]), fold(x + dx, shape[1])] for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)], float)
            assert got[y, x] == pytest.approx((near.mean(), (near * near).mean()))


def test_windows_do_not_multiply_rows(spark):
    plan = px.local_std(table(spark, {0: np.zeros((4, 4), int)}), 4, 4, 50)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2


def labels_of(image):
    return {0: image}


def test_merge_close_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    for gap in (0, 1, 3):
        image = b.label(rng.random((24, 30)) < 0.08)
        where = [np.argwhere(image == k) for k in range(1, image.max() + 1)]
        head = list(range(len(where)))
        for i in range(len(where)):
            for j in range(i):
                if np.abs(where[i][:, None] - where[j][None]).max(axis=2).min() <= gap + 1:
                    low, high = sorted((head[i], head[j]))
                    head = [low if h == high else h for h in head]
        number = {h: k for k, h in enumerate(sorted(set(head)), 1)}
        lab = table(spark, {0: image}, "label").where("label > 0")
        got = {(r.y, r.x): r.label for r in rg.merge_close(lab, gap).collect()}
        assert got == {(int(y), int(x)): number[head[k]] for k, at in enumerate(where) for y, x in at}


def test_slivers(spark):
    original = np.array([[1, 1, 1, 1, 1, 1, 0, 2, 2, 3]])
    split = np.array([[1, 1, 1, 2, 4, 4, 0, 5, 6, 7]])
    lab = lambda a: table(spark, {0: a}, "label").where("label > 0")
    got = sorted((r.x, r.label) for r in rg.undo_slivers(lab(split), lab(original), 0.2).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (7, 3), (8, 4), (9, 5)]
    outside = rg.undo_slivers(lab(split), lab(np.array([[1] * 6 + [0] * 4])), 0.9)
    assert sorted((r.x, r.label) for r in outside.collect()) == [*((x, 1) for x in range(6)), (7, 2), (8, 3), (9, 4)]


def test_islands_and_contrast(spark):
    gray = np.full((10, 10), 180)
    gray[:, :3] = 40  # resin
    gray[2:4, 1] = 60  # an island in it that looks like resin
    gray[6:8, 1] = 175  # and one that looks like the specimen
    resin = gray == 40
    parts = px.components(table(spark, {0: ~resin}, "m").where("m = 1").select("image_id", "y", "x"), 10)
    pixels, dark = table(spark, {0: gray}), table(spark, {0: resin}, "m").where("m = 1").select("image_id", "y", "x")
    roles = lambda **how: sorted((r.root, r.area_px, r.role) for r in rg.assign_islands(parts, pixels, dark, 100, **how).collect())
    assert roles(least=0.02) == [(3, 70, "specimen"), (21, 2, "resin"), (61, 2, "specimen")]
    assert roles(least=0.05)[2][2] == roles(least=0.0, largest_only=True)[2][2] == "dropped"
    assert rg.material_contrast(pixels, dark).first().contrast == 140.0
    assert rg.material_contrast(pixels, dark.where("false")).first().contrast == 0.0
    assert rg.median_gray(spark.createDataFrame([(0, 1), (0, 2), (0, 2), (0, 9)], "image_id int, gray int"), "image_id").first().median == 2.0


def test_rim_regions(spark):
    table_ = spark.createDataFrame([(0, 1, 0.5, 0.3, 0.9), (1, 1, 0.5, 0.3, 0.9), (1, 2, 0.4, 0.2, 0.2), (1, 3, 0.4, 0.01, 0.2), (2, 1, 0.001, 0.5, 0.1)], "image_id int, root int, area_frac double, contact_frac double, depth_frac double")
    assert sorted((r.image_id, r.root) for r in rg.rim_regions(table_, 0.01, 0.05, 0.5).collect()) == [(0, 1), (1, 2)]
    corner = rg.regions(spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 0)], "image_id int, y int, x int, root int"), 4, 6).withColumn("c", F.col("contact_frac") * 20).first()
    assert corner.c == pytest.approx(3) and corner.depth_frac == 0


def test_label_at_asks_few_cells_and_equals_all_pixels(spark, tmp_path):
    rng = np.random.default_rng(5)
    images = {k: rng.integers(0, 4, (11, 9)) * (rng.random((11, 9)) < 0.15) for k in range(4)}
    labels = table(spark, images, "label").where("label > 0")
    points = [(n, int(rng.integers(0, 5)), float(rng.integers(-40, 130)) / 10, float(rng.integers(-40, 150)) / 10) for n in range(400)]
    spark.createDataFrame(points, "point_id int, image_id int, px double, py double").write.parquet(f"{tmp_path}/points")
    out = px.label_at(labels, spark.read.parquet(f"{tmp_path}/points"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan

    def nearest(k, x, y):
        near = [((yy, xx) != (round(y), round(x)), (xx - x) ** 2 + (yy - y) ** 2, yy, xx, int(v)) for (yy, xx), v in np.ndenumerate(images.get(k, np.zeros((0, 0)))) if v and abs(yy - round(y)) <= 3 and abs(xx - round(x)) <= 3]
        return min([n for n in near if not n[0] or n[1] <= 9], default=(0, 0, 0, 0, 0))[4]

    assert {r.point_id: r.label for r in out.collect()} == {n: nearest(k, x, y) for n, k, x, y in points}


def test_components_connect_runs_and_equal_the_kernel(spark, monkeypatch):
    rng = np.random.default_rng(9)
    masks = {k: rng.random((7, 150)) < (0.45 if k % 2 else 0.9) for k in range(4)}
    kept = []
    monkeypatch.setattr(px, "checkpointed", lambda df, real=px.checkpointed: kept.append(real(df)) or kept[-1])
    got = px.components(table(spark, masks, "set").where("set = 1"), 150)
    found = {(r.image_id, r.y, r.x): r.root for r in got.collect()}
    for k, mask in masks.items():
        labels = b.label(mask)
        first = {int(v): int(np.flatnonzero(labels.ravel() == v)[0]) for v in np.unique(labels[mask])}
        assert {(y, x): v for (i, y, x), v in found.items() if i == k} == {(int(y), int(x)): first[int(labels[y, x])] for y, x in zip(*np.nonzero(mask))}
    assert max(df.count() for df in kept[:-1]) < len(found)  # no table of pixels, nor of their neighbours, goes through the rounds


def test_components_across_stripes_are_those_of_the_kernel_and_one_stripe_needs_no_rounds(spark, monkeypatch):
    from lacuna.raster import basics

    rng, masks = np.random.default_rng(5), {}
    for k in range(6):
        masks[k] = rng.random((21, 17)) < (0.35, 0.5, 0.65)[k % 3]
    masks[6] = np.zeros((21, 17), bool)
    masks[6][::2] = True
    masks[6][1::4, -1] = masks[6][3::4, 0] = True  # one line that winds through all stripes
    rows = [(k, int(y), int(x)) for k, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    table = spark.createDataFrame(rows, "image_id bigint, y int, x int")
    expected = set()
    for k, m in masks.items():
        labels = basics.label(m)
        least = {n: int(np.flatnonzero(labels.ravel() == n)[0]) for n in range(1, labels.max() + 1)}
        expected |= {(k, int(y), int(x), least[labels[y, x]]) for y, x in zip(*np.nonzero(m), strict=True)}
    kept, calls = px.checkpointed, []
    monkeypatch.setattr(px, "checkpointed", lambda df: calls.append(1) or kept(df))
    whole = px.components(table, 17)
    assert {tuple(r) for r in whole.collect()} == expected and whole.count() == len(rows)
    assert len(calls) == 2
    monkeypatch.setattr(px, "STRIPE", 3)
    cut = px.components(table, 17)
    assert {tuple(r) for r in cut.collect()} == expected and cut.count() == len(rows) and cut.schema == whole.schema
