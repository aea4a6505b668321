"""Files placed by executors: all or none; result folders; the correction store."""

import csv
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from lacuna.sources import correction_store as cs
from lacuna.sources import placed_files as pf
from lacuna.sources import result_folders as rf


def tree(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in sorted(path.rglob("*")) if p.is_file() and not p.name.endswith(".crc")}


def test_files_are_placed_replaced_and_deleted(spark, tmp_path):
    rows = [(f"d{k % 3}/f{k}.txt", str(k).encode() * 1000) for k in range(30)] + [("ä ö/ü.txt", b"")]
    frame = lambda r: spark.createDataFrame(r, "file string, content binary").repartition(4)
    pf.place(frame(rows), f"file://{tmp_path}/out")
    assert tree(tmp_path / "out") == dict(rows)
    pf.place(frame([("d0/f0.txt", b"new"), ("d0/f3.txt", None), ("never/was.txt", None)]), f"file://{tmp_path}/out")
    want = dict(rows) | {"d0/f0.txt": b"new"}
    del want["d0/f3.txt"]
    assert tree(tmp_path / "out") == want


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    broken = F.udf(lambda k: None if k < 5 else 1 // 0, "string")
    rows = spark.range(10).repartition(3).select(F.concat(F.lit("f"), "id", F.coalesce(broken("id"), F.lit(""))).alias("file"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="Division|division"):
        pf.place(rows, f"file://{tmp_path}/out")
    assert tree(tmp_path) == {}
    with pytest.raises(Exception, match="not a file under the root"):
        pf.place(spark.createDataFrame([("../up.txt", b"x"), ("ok.txt", b"y")], "file string, content binary"), f"file://{tmp_path}/out")
    assert tree(tmp_path) == {}


def test_result_folders(spark, tmp_path):
    table = spark.createDataFrame([("a.tif", 2, 'say "no"; or'), ("a.tif", 10, None), ("b.tif", 1, "")], "bild string, label int, grund string")
    folders = spark.createDataFrame([("a.tif", "a"), ("b.tif", "b"), ("c.tif", "c_2")], "name string, folder string")
    log = spark.createDataFrame([("a.tif", "run1", "---- started")], "name string, run string, text string")
    rf.write({"verworfen.csv": table}, folders, f"file://{tmp_path}", "filter: []\n", log)
    found = tree(tmp_path)
    assert set(found) == {"a/verworfen.csv", "b/verworfen.csv", "c_2/verworfen.csv", "a/einstellungen.yaml", "b/einstellungen.yaml", "c_2/einstellungen.yaml", "a/log/run1.txt"}
    text = found["a/verworfen.csv"].decode("utf-8-sig")
    assert found["a/verworfen.csv"].startswith(b"\xef\xbb\xbfbild;label;grund\r\n") and text.endswith("\r\n")
    assert list(csv.reader(io.StringIO(text, newline=""), delimiter=";")) == [["bild", "label", "grund"], ["a.tif", "2", 'say "no"; or'], ["a.tif", "10", ""]]
    assert found["c_2/verworfen.csv"].decode("utf-8-sig") == "bild;label;grund\r\n"
    rf.write({}, folders.limit(1), f"file://{tmp_path}", "", log.withColumn("run", F.lit("run2")))
    assert len(tree(tmp_path)) == 8


def test_result_folders_are_read_where_they_are_listed(spark, tmp_path):
    folders = spark.createDataFrame([(f"p{k}.tif", f"p{k}") for k in range(300)], "name string, folder string")
    log = spark.createDataFrame([("p7.tif", "run1", "---- started")], "name string, run string, text string")
    rf.write({}, folders, f"file://{tmp_path}/out", "filter: []\n", log)
    more = folders.unionByName(spark.createDataFrame([("gone.tif", "gone")], "name string, folder string"))
    tasks = []
    for root in (f"file://{tmp_path}/out", f"file://{tmp_path}/out/"):
        rows = rf.read(more, root).withColumn("task", F.spark_partition_id()).collect()
        assert {r.file: bytes(r.content) for r in rows} == tree(tmp_path / "out") and len(rows) == 301
        tasks.append(len({r.task for r in rows}))
    assert min(tasks) > 1  # few bytes are not put into one task


def test_result_folders_list_nothing_at_the_driver(spark):
    """Listing by the reader of files took a job of a task for each folder, up to 10,000 tasks."""
    from lacuna.plans import catalog

    found = catalog.QUERIES["result_folders"](spark, "/root/testdata/sf0.001")
    assert not found.inputFiles() or not any("poren.csv" in f for f in found.inputFiles())
    assert found.count() == 2 * spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()


def test_correction_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("Probe 1+%.tif", "x.y.png", "ä.bmp"):
        (tmp_path / "in" / name).write_bytes(name.encode())
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/in").select("path", "content", F.lit(0).alias("seq"))
    names = spark.createDataFrame([(hashlib.sha1(n.encode()).hexdigest(), n) for n in ("Probe 1+%.tif", "x.y.png", "ä.bmp")], "sha1 string, name string")
    images = cs.keyed(files.join(names, F.sha1("content") == F.col("sha1"))).select("key", "name")
    keys = {r.name: r.key for r in images.collect()}
    assert keys["x.y.png"] == "x.y_" + hashlib.sha1(b"x.y.png").hexdigest()[:12]
    log = spark.createDataFrame([(keys["Probe 1+%.tif"], 1, "zeichnen", 1.5, 2.0, [[0.0, 0.0], [1.0, 2.0]]), (keys["Probe 1+%.tif"], 0, "entfernen", 3.0, 4.0, None), (keys["ä.bmp"], 5, "aufnehmen", 0.5, 0.25, None)], cs.LOG)
    store, former = f"file://{tmp_path}/store", f"file://{tmp_path}/former"
    assert cs.load(spark, store, former).count() == 0
    cs.save(log, images, store)
    got = sorted(tuple(r) for r in cs.load(spark, store).collect())
    assert got == sorted([(keys["Probe 1+%.tif"], 0, "entfernen", 3.0, 4.0, None), (keys["Probe 1+%.tif"], 1, "zeichnen", 1.5, 2.0, [[0.0, 0.0], [1.0, 2.0]]), (keys["ä.bmp"], 0, "aufnehmen", 0.5, 0.25, None)])
    data = json.loads((tmp_path / "store" / f"{keys['ä.bmp']}.json").read_text("utf-8"))
    assert data == {"bild": "ä.bmp", "korrekturen": [{"aktion": "aufnehmen", "x": 0.5, "y": 0.25}]}
    # The former folder counts only where the store has nothing; no corrections means no file.
    cs.save(log.withColumn("action", F.lit("bereich")), images, former)
    cs.save(log.where(F.col("key") == keys["ä.bmp"]), images.where(F.col("name") == "Probe 1+%.tif"), store)
    assert not (tmp_path / "store" / f"{keys['Probe 1+%.tif']}.json").exists()
    both = {(r.key, r.action) for r in cs.load(spark, store, former).collect()}
    assert both == {(keys["ä.bmp"], "aufnehmen"), (keys["Probe 1+%.tif"], "bereich")}
    (tmp_path / "store" / "broken_0.json").write_text("{")
    assert cs.load(spark, store).count() == 1
