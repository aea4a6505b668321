"""Batch runs over files: what is computed, what is found done, failures as rows."""

import struct
import zlib

import numpy as np
import pytest

from lacuna.operators import filters as fl
from lacuna.plans import stages as bt
from lacuna.raster import detection, segmentation

SEGMENTATION = segmentation.Segmentation(method="full_frame")
DETECTION = detection.Detection(strict_method="otsu_masked", strict_floor=10.0, split=False)


def png(gray):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + row.tobytes() for row in gray)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def micrograph(seed, holes):
    gray = np.full((60, 80), 190 - seed, np.uint8)
    y, x = np.mgrid[:60, :80]
    for k in range(holes):
        gray[(y - 12 - 30 * (k // 3)) ** 2 + (x - 14 - 25 * (k % 3)) ** 2 <= (5 + k) ** 2] = 30
    return png(gray)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"probe {k}.png").write_bytes(micrograph(k, k + 1))
    (tmp_path / "in" / "copy.png").write_bytes(micrograph(0, 1))
    (tmp_path / "in" / "broken.png").write_bytes(b"no image")
    (tmp_path / "in" / "notes.txt").write_text("x")
    return tmp_path


def counts(spark, folder, run):
    log = bt.StageTables(spark, f"file://{folder}/stages").log().where(f"run = '{run}'").collect()
    return {r["stage"]: (r["computed"], r["reused"], r["failed"]) for r in log}


def batch(spark, folder, name, filters=fl.DEFAULT, found=DETECTION):
    tables = bt.run(spark, f"file://{folder}/in", f"file://{folder}/stages", SEGMENTATION, found, filters, name)
    return [sorted(t.collect(), key=str) for t in tables]


def test_only_what_is_new_is_computed(spark, folder):
    images, objects, failures = batch(spark, folder, "first")
    assert counts(spark, folder, "first") == {"files": (5, 0, 0), "results": (4, 0, 1), "judged": (3, 0, 0)}
    assert {r["name"] for r in images} == {"probe 0.png", "probe 1.png", "probe 2.png", "copy.png"} and [r["name"] for r in failures] == ["broken.png"]
    assert [r["pore_count"] for r in sorted(images, key=lambda r: r["name"])] == [1, 1, 2, 3]
    again = batch(spark, folder, "again")
    assert counts(spark, folder, "again") == {"files": (0, 5, 0), "results": (0, 4, 1), "judged": (0, 3, 0)} and again == [images, objects, failures]
    strict = (fl.Setting("min_area", True, {"min_area_px": 150.0}),)
    fewer = batch(spark, folder, "filters", strict)[0]
    assert counts(spark, folder, "filters") == {"files": (0, 5, 0), "results": (0, 4, 1), "judged": (3, 0, 0)}
    assert sum(r["pore_count"] for r in fewer) < sum(r["pore_count"] for r in images)
    (folder / "in" / "probe 1.png").write_bytes(micrograph(9, 4))
    (folder / "in" / "broken.png").unlink()
    changed = batch(spark, folder, "changed")
    assert counts(spark, folder, "changed") == {"files": (1, 3, 0), "results": (1, 2, 0), "judged": (1, 2, 0)} and changed[2] == []
    assert {r["name"]: r["pore_count"] for r in changed[0]}["probe 1.png"] == 4
    assert batch(spark, folder, "changed") == changed  # the same run once more takes its own place
    stages = bt.StageTables(spark, f"file://{folder}/stages")
    assert {r["stage"] for r in stages.settings().collect()} == {"results", "judged"} and stages.log().where("run = 'changed'").count() == 3
    assert stages.table("results", bt._RESULTS).count() == 5


def test_folder_without_images(spark, folder):
    for p in (folder / "in").iterdir():
        if p.suffix == ".png":
            p.unlink()
    assert batch(spark, folder, "none") == [[], [], []]


def test_keys_follow_what_matters():
    keys = {bt.key_of(SEGMENTATION, DETECTION), bt.key_of(SEGMENTATION, detection.Detection()), bt.key_of(SEGMENTATION, DETECTION, list(fl.DEFAULT)), bt.key_of(SEGMENTATION, DETECTION, list(fl.DEFAULT[:1]))}
    assert len(keys) == 4 and bt.key_of(SEGMENTATION, DETECTION) in keys


def test_small_images_are_spread_over_tasks_and_no_pixels_are_joined(spark, tmp_path, monkeypatch):
    rows = [(str(k), f"{k}.png", 8, 8, bytes([k]) * 64) for k in range(40)]
    images = spark.createDataFrame(rows, "image_id string, name string, height int, width int, gray binary")
    images = images.withColumn("sha", bt.content_key(images))
    seen, kernels = [], bt.im.analysed
    monkeypatch.setattr(bt.im, "analysed", lambda given, *settings: seen.append(given) or kernels(given, *settings))
    found = bt.StageTables(spark, f"file://{tmp_path}", "one").analysed(images, SEGMENTATION, DETECTION)
    assert seen[0].rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism  # one, where few bytes are put together
    assert {(r["image_id"], r["name"]) for r in found.collect()} == {(str(k), f"{k}.png") for k in range(40)}
