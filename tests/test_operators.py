"""Cases worked out by hand: guards of formulas and filters, texts, corrections, settings."""

import math

import pytest
from pyspark.sql import functions as F

from lacuna.functions import formulas as fm
from lacuna.functions import text as tx
from lacuna.operators import corrections as co
from lacuna.operators import filters as fl
from lacuna.operators import scale as sc
from lacuna.operators import settings as st
from lacuna.operators import statistics as stat


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_formula_guards(spark):
    r = one(spark, c=fm.circularity(F.lit(5.0), F.lit(0.0)), f=fm.feret_roundness(F.lit(5.0), F.lit(0.0)), a=fm.aspect_ratio(F.lit(5.0), F.lit(0.0)), s=fm.solidity(F.lit(5.0), F.lit(0.0)), p=fm.porosity_pct(F.lit(5.0), F.lit(0)), d=fm.pore_density(F.lit(5), F.lit(0.0)), n=fm.length_um(F.lit(5.0), F.lit(None).cast("double")))
    assert (r.c, r.f, r.a, r.s, r.p, r.d, r.n) == (0.0, None, math.inf, 0.0, None, None, None)


def test_scale_from_bar_needs_a_length(spark):
    assert one(spark, s=fm.scale_from_bar(F.lit(100.0), F.lit(50.0))).s == 2.0
    with pytest.raises(Exception, match="no length"):
        one(spark, s=fm.scale_from_bar(F.lit(100.0), F.lit(0.0)))


def test_formats(spark):
    cases = [(0.125, 2), (2.5, 0), (3.5, 0), (1234567.0, 1), (0.05, 1), (-1.005, 2), (math.inf, 1)]
    rows = spark.createDataFrame(cases, "x double, d int").collect()
    for r in rows:
        assert one(spark, t=tx.fixed(F.lit(r.x), r.d)).t == f"{r.x:.{r.d}f}"
    assert one(spark, t=tx.rounded(F.lit(2.5), 0)).t == 2.0


def _object(spark, **changes):
    base = {"image_id": 1, "label": 1, "area_px": 100.0, "perimeter_px": 40.0, "equivalent_diameter_px": 11.3, "feret_max_px": 12.0, "major_axis_px": 12.0, "minor_axis_px": 11.0, "solidity": 0.9, "bbox_w": 12, "bbox_h": 11, "mean_intensity": 40.0, "contrast": 50.0, "touches_image_edge": False, "touches_specimen_edge": False}
    row = {**base, **changes}
    df = spark.createDataFrame([row])
    for name in ("um_per_px", "specimen_edge_distance_px", "specimen_area_px"):
        if name not in changes:
            df = df.withColumn(name, F.lit(None).cast("double"))
    return df


@pytest.mark.parametrize(
    "changes, name",
    [
        ({}, None),
        ({"equivalent_diameter_px": 3.9}, "min_diameter"),
        ({"major_axis_px": 40.0, "minor_axis_px": 4.0}, "scratch"),
        ({"major_axis_px": 40.0, "minor_axis_px": 0.0}, "scratch"),
        ({"major_axis_px": 40.0, "minor_axis_px": 4.0, "solidity": 0.5}, None),
        ({"major_axis_px": 40.0, "minor_axis_px": 4.0, "um_per_px": 2.0}, None),
        ({"solidity": 0.3}, "compactness"),
        ({"solidity": 0.3, "area_px": 24.0}, None),
        ({"feret_max_px": 60.0}, "roundness"),
        ({"feret_max_px": 0.0}, None),
    ],
)
def test_default_chain(spark, changes, name):
    assert fl.apply(_object(spark, **changes)).first().filter_name == name


def test_order_decides_and_unknown_names_fail(spark):
    both = {"solidity": 0.3, "feret_max_px": 60.0}
    first, second = fl.Setting("roundness", True, {"min_roundness": 0.2}), fl.Setting("compactness", True, {"min_solidity": 0.4})
    assert fl.apply(_object(spark, **both), (first, second)).first().filter_name == "roundness"
    assert fl.apply(_object(spark, **both), (second, first)).first().filter_name == "compactness"
    with pytest.raises(KeyError):
        fl.verdict((fl.Setting("nonsense"),))


def test_own_rule_can_be_registered(spark):
    @fl.rule("always")
    def always(p):
        """Rejects all."""
        return fl.Hit(F.lit(True), F.lit("so"))

    assert fl.apply(_object(spark), (fl.Setting("always"),)).first().reason == "so"
    assert fl.describe("always") == "Rejects all."


def test_grouping_compares_with_the_first_member(spark):
    rows = [(1, 1, 100.0, "a", 1.0, 1.0), (1, 2, 100.06, "b", 0.85, 1.0), (1, 3, 100.12, "a", 1.0, 0.0)]
    r = sc.votes(spark.createDataFrame(rows, "candidate_id int, seq int, value_um double, engine string, weight double, ocr_confidence double")).first()
    assert r.groups == 2 and r.value_um == 100.0 and not r.consensus


def test_consensus_ends_the_asking(spark):
    rows = [(1, k, 100.0, "a", 1.0, 1.0) for k in range(6)]
    assert sc.readings_asked(spark.createDataFrame(rows, "candidate_id int, seq int, value_um double, engine string, weight double, ocr_confidence double")).first().asked == 2


def test_asking_covers_every_reading(spark, tmp_path):
    from lacuna.plans import catalog
    from lacuna.plans.fixtures import view

    # Candidate 3 straddles event 500, candidates 4 to 6 come after it only.
    rows = [(k, 3 if 490 <= k < 510 else k % 3 if k < 500 else 4 + k % 3, float(k % 7 * 60 if k % 3 else 130)) for k in range(0, 900, 7)] + [(k, 3, 130.0 + 100 * (k == 505)) for k in (493, 499, 505, 510)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    readings = {}
    for r in view(spark, str(tmp_path), "readings").orderBy("seq").collect():
        readings.setdefault(r.candidate_id, []).append(r)

    def asked(rs):
        for k in [*range(2, len(rs), 2), len(rs)]:
            same = all(abs(rs[0].value_um - r.value_um) <= 0.001 * max(rs[0].value_um, r.value_um) for r in rs[:k])
            if same and sum(r.weight * (0.5 + 0.5 * r.ocr_confidence) for r in rs[:k]) >= sc.CONSENSUS_WEIGHT:
                return k
        return len(rs)

    got = catalog.QUERIES["scale_readings_asked"](spark, str(tmp_path)).collect()
    assert {r.candidate_id: r.asked for r in got} == {c: asked(rs) for c, rs in readings.items()} and len(got) == 7


def test_undo_replays_as_a_stack(spark):
    log = spark.createDataFrame([(1, 1, "entfernen", 5), (1, 2, "entfernen", 6), (1, 3, co.UNDO, 0), (1, 4, "aufnehmen", 7), (1, 5, co.UNDO, 0), (1, 6, co.UNDO, 0), (1, 7, co.UNDO, 0)], "image_id int, seq int, action string, label int")
    assert co.undone(log).count() == 0
    assert [r.label for r in co.undone(log.where("seq < 5")).orderBy("seq").collect()] == [5, 7]


def test_replay_at_once_equals_replay_step_by_step(spark):
    judged = spark.createDataFrame([(1, k, None if k % 2 else "scratch", None if k % 2 else "x") for k in range(1, 7)], "image_id int, label int, filter_name string, reason string")
    log = [(1, 1, "entfernen", 1), (1, 2, "aufnehmen", 2), (1, 3, "aufnehmen", 1), (1, 4, "entfernen", 2)]
    schema = "image_id int, seq int, action string, label int"
    whole = co.apply_points(judged, spark.createDataFrame(log, schema)).orderBy("label").collect()
    step = judged
    for entry in log:
        step = co.apply_points(step, spark.createDataFrame([entry], schema)).select("image_id", "label", "filter_name", "reason")
    assert [(r.label, r.filter_name) for r in whole] == [(r.label, r.filter_name) for r in step.orderBy("label").collect()]


def test_settings(spark):
    base, own = {"a": {"x": 1, "y": 2.0}, "f": [1, 2]}, {"a": {"x": 1.0, "y": 3}, "g": True}
    assert {r.path for r in st.deviations(st.table(spark, base), st.table(spark, own)).collect()} == {"a.y", "g"}
    assert st.nested([tuple(r) for r in st.overlaid(st.table(spark, base), st.table(spark, own)).collect()]) == {"a": {"x": 1.0, "y": 3}, "f": [1, 2], "g": True}
    assert st.adapted({"a": {"x": 1.0, "y": 3}, "g": True}, base) == {"a": {"x": 1, "y": 3.0}, "g": True}


def test_no_curve_for_few_or_equal_values(spark):
    few = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3)] + [(2, 5.0)] * 9, "k int, v double")
    assert stat.density_curve(few, "k", "v").count() == 0
    assert {(r.k, r.classes) for r in stat.class_layout(few, "k", "v").collect()} == {(1, 3), (2, 1)}


def test_folders_never_meet(spark):
    from lacuna.plans import evaluations as ev

    paths = ["d/a.tif", "e/A.png", "e/a_2.tif", "f/a.bmp", "f/b.tif", "g/a_2.tif"]
    got = {r.path: r.folder for r in ev.output_folders(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {"d/a.tif": "a", "e/A.png": "A_2", "e/a_2.tif": "a_2_2", "f/a.bmp": "a_3", "f/b.tif": "b", "g/a_2.tif": "a_2_3"}


def test_a_failing_evaluation_is_a_row(spark, tmp_path):
    from lacuna.plans import evaluations as ev

    (tmp_path / "one.py").write_text("def per_image(f):\n    return 1 / 0\n")
    (tmp_path / "_two.py").write_text("raise SystemExit\n")
    (tmp_path / "three.py").write_text("ACTIVE = False\n")
    assert [m.__name__ for m in ev.modules(tmp_path)] == ["one"]

    def bad(frame):
        if frame["image_id"].iloc[0] == 2:
            raise ValueError("no")
        return frame[["area_px"]]

    rows = ev.for_each_image(spark.createDataFrame([(1, 5.0), (2, 6.0)], "image_id int, area_px double"), bad, "area_px double").collect()
    assert {r.image_id: (r.area_px, "ValueError" in (r.error or "")) for r in rows} == {1: (5.0, False), 2: (None, True)}


def test_line_of_a_scale(spark):
    rows = [(0.5123456, "100 µm", 200.0, 100.0, "ocr", 0.934), (2.0, "", None, None, "override", 1.0), (1e-7, None, 0.0, 0.0, "ocr", 0.125)]
    t = spark.createDataFrame(rows, "um double, label string, bar double, value double, source string, confidence double")
    got = t.select("um", tx.describe_scale(*(F.col(c) for c in t.columns)).alias("line")).collect()
    assert {r.um: r.line for r in got} == {
        0.5123456: '0.512346 µm/px  "100 µm"  Balken 200 px  = 100 µm  [ocr, 93%]',
        2.0: "2 µm/px  [override, 100%]",
        1e-7: "1e-07 µm/px  = 0 µm  [ocr, 12%]",
    }


def test_undo_goes_through_no_frame_that_ends_behind_all_rows(spark):
    log = spark.range(1, 3001).select(F.lit(1).alias("image_id"), F.col("id").alias("seq"), F.when(F.col("id") % 4 == 0, co.UNDO).otherwise("entfernen").alias("action"), F.col("id").alias("label"))
    out = co.undone(log)
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    stack = []
    for k in range(1, 3001):
        stack.pop() if k % 4 == 0 else stack.append(k)
    assert [r.seq for r in out.orderBy("seq").collect()] == stack


def test_shapes_are_rounded_as_by_sql_at_ties(spark, tmp_path):
    import duckdb

    from lacuna.plans import catalog

    # With no discount the area comes back as it is; these lie half way between two numbers of six digits.
    rows = [(1, k, 1, k, "2020-01-01", (k + 0.5) / 1e6, 1.0, 0.0, 0.01 * (k % 9), "R", "O") for k in range(1, 4001)]
    names = "l_suppkey bigint, l_orderkey bigint, l_linenumber int, l_partkey bigint, l_shipdate string, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.label: r.hull_guard for r in catalog.QUERIES["formula_shapes"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == dict(c.execute(f"SELECT label, hull_guard FROM ({catalog.ORACLE['formula_shapes']})").fetchall()) and len(got) == 4000


def test_six_digits_are_those_of_the_exact_value():
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(5)
    halves = (draw.integers(0, 2_000_000, 20_000) + 0.5) / 10.0 ** draw.integers(0, 10, 20_000)  # half way between two numbers of six digits, or next to it
    edges = [np.nextafter(float(f"1e{k}"), s) for k in range(-6, 9) for s in (0, 1e9)] + [0.0, -0.0, 1e5, 1e6, 999_999.4, 999_999.5, 9.9999995e-5, 5e-324, 1e300, np.inf, -np.inf, np.nan]
    values = np.concatenate([halves, -halves, np.nextafter(halves, 1e9), draw.random(20_000) * 10 ** draw.uniform(-6, 8, 20_000), draw.integers(-999, 999, 1000) / 4, edges])
    want = ["" if v != v else f"{v:.6g}".replace(".", ",") for v in values.tolist()]
    assert tx.six_digits(pa.array(values)).to_pylist() == want
    assert tx.six_digits(pa.array([None, 1.5, 100_000.5], pa.float64())).to_pylist() == ["", "1,5", "100000"]
    assert tx.six_digits(pa.array([], pa.float64())).to_pylist() == []
