"""Sinks, settings files and streams."""

from pyspark.sql import functions as F

from lacuna.operators import filters as fl
from lacuna.operators import statistics as stat
from lacuna.sources import csv_tables, settings_file
from lacuna.streaming import corrections as stream


def test_csv_dialect_round_trip(spark, tmp_path):
    rows = [(f"probe;{k}", f'a "quoted" {k}', None if k % 3 else "1,5") for k in range(20)]
    path = f"file://{tmp_path}/t.csv"
    csv_tables.write(spark.createDataFrame(rows, "bild string, grund string, wert string").repartition(3), path)
    raw = (tmp_path / "t.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfbild;grund;wert\r\n") and list(tmp_path.iterdir()) == [tmp_path / "t.csv"]
    back = spark.read.format("result_table").load(path).collect()
    assert sorted(tuple(r) for r in back) == sorted((a, b, c or "") for a, b, c in rows)


def test_settings_file(tmp_path, monkeypatch):
    base, own = tmp_path / "base.yaml", tmp_path / "own.yaml"
    base.write_text("a: {x: 1, y: 2.0}\nf: [1, 2]\n")
    own.write_text("a: {y: 3}\ng: true\n")
    tree = settings_file.load(base, own)
    assert tree == {"a": {"x": 1, "y": 3.0}, "f": [1, 2], "g": True} and isinstance(tree["a"]["y"], float)
    settings_file.save(tree, base, own)
    assert settings_file.load(base, own) == tree
    settings_file.save(settings_file.load(base), base, own)
    assert not own.exists()
    other = tmp_path / "other.yaml"
    other.write_text("z: 1\n")
    monkeypatch.setenv(settings_file.VARIABLE, str(other))
    assert settings_file.load(base, own) == {"z": 1}


def test_stream_recomputes_touched_images_only(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "entfernen", 1), (2, 1, "aufnehmen", 2)], "image_id int, seq int, action string, label int")
    log.write.parquet(f"{tmp_path}/log")
    judged = spark.range(1, 4).select(F.col("id").cast("int").alias("image_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("label"))
    judged = judged.select("*", F.when(F.col("label") == 2, "scratch").alias("filter_name"), F.when(F.col("label") == 2, "x").alias("reason"), (10.0 * F.col("label")).alias("area_px"), F.lit(False).alias("touches_image_edge"), F.lit(False).alias("touches_specimen_edge"), F.lit(1.0).alias("equivalent_diameter_px"))
    images = spark.range(1, 4).select(F.col("id").cast("int").alias("image_id"), F.lit(100).alias("specimen_area_px"), F.lit(1.0).alias("um_per_px"))
    seen = {}
    source = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    q = stream.follow(source, lambda: spark.read.parquet(f"{tmp_path}/log"), judged, images, lambda t, n: seen.update({r.image_id: (r.pore_count, r.pore_area_px) for r in t.collect()}), f"{tmp_path}/checkpoint")
    q.awaitTermination()
    assert seen == {1: (0, 0.0), 2: (2, 30.0)}
    assert {r.image_id for r in stat.per_image(images, judged).collect()} == {1, 2, 3} and fl.available()


def test_stream_of_folds_equals_the_whole_log(spark, tmp_path):
    """Entries that come late, out of order and again; each batch reads itself only."""
    import random

    from lacuna.operators import corrections as co

    rnd = random.Random(4)
    entries = [(k % 5, k, rnd.choice(["aufnehmen", "entfernen"]), rnd.randrange(6)) for k in range(120)]
    shuffled = rnd.sample(entries, len(entries)) + entries[:30]
    schema = "image_id int, seq int, action string, label int"
    judged = spark.range(5).select(F.col("id").cast("int").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("label"))
    rejected = (F.col("label") + F.col("image_id")) % 2 == 0
    judged = judged.select("*", F.when(rejected, "scratch").alias("filter_name"), F.when(rejected, "x").alias("reason"), (10.0 * F.col("label") + 1).alias("area_px"), F.lit(False).alias("touches_image_edge"), F.lit(False).alias("touches_specimen_edge"), F.lit(1.0).alias("equivalent_diameter_px"))
    images = spark.range(5).select(F.col("id").cast("int").alias("image_id"), F.lit(100).alias("specimen_area_px"), F.lit(1.0).alias("um_per_px"))
    seen = {}
    for n, lo in enumerate(range(0, len(shuffled), 50)):
        spark.createDataFrame(shuffled[lo : lo + 50], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/log")
        q = stream.follow_folds(source, judged, images, lambda t, k: seen.update({r.image_id: (r.pore_count, r.pore_area_px, r.rejected_count) for r in t.collect()}), f"{tmp_path}/checkpoint")
        q.awaitTermination()
        want = stat.per_image(images, co.apply_points(judged, spark.createDataFrame(list(set(shuffled[: lo + 50])), schema)))
        assert seen == {r.image_id: (r.pore_count, r.pore_area_px, r.rejected_count) for r in want.collect()}
