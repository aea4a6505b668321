"""The three result tables, with the columns and texts of their CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import formulas as fm
from lacuna.functions.text import significant6, yes_no


def _n(x) -> Column:
    return significant6(F.col(x).cast("double") if isinstance(x, str) else x.cast("double"))


def pore_table(judged: DataFrame, names: DataFrame) -> DataFrame:
    """One row for each counted object (24 columns). ``names``: image_id, name."""
    um, d = F.col("um_per_px"), "equivalent_diameter_px"
    rows = judged.where(F.col("filter_name").isNull()).join(names.select("image_id", "name"), "image_id")
    return rows.select(
        F.col("name").alias("bild"),
        "label",
        _n("area_px").alias("flaeche_px"),
        _n(fm.area_um2("area_px", um)).alias("flaeche_um2"),
        _n(d).alias("aequivalentdurchmesser_px"),
        _n(fm.length_um(d, um)).alias("aequivalentdurchmesser_um"),
        _n("perimeter_px").alias("umfang_px"),
        _n("feret_max_px").alias("feret_max_px"),
        _n(fm.length_um("feret_max_px", um)).alias("feret_max_um"),
        _n("major_axis_px").alias("hauptachse_px"),
        _n("minor_axis_px").alias("nebenachse_px"),
        _n(fm.circularity("area_px", "perimeter_px")).alias("rundheit"),
        _n(fm.aspect_ratio("major_axis_px", "minor_axis_px")).alias("seitenverhaeltnis"),
        _n("solidity").alias("soliditaet"),
        _n("eccentricity").alias("exzentrizitaet"),
        _n("orientation_deg").alias("orientierung_grad"),
        _n("centroid_x_px").alias("schwerpunkt_x_px"),
        _n("centroid_y_px").alias("schwerpunkt_y_px"),
        _n("mean_intensity").alias("grauwert_mittel"),
        _n("min_intensity").alias("grauwert_min"),
        _n("contrast").alias("kontrast"),
        yes_no(F.col("touches_image_edge")).alias("am_bildrand"),
        yes_no(F.col("touches_specimen_edge")).alias("am_probenrand"),
        _n("specimen_edge_distance_px").alias("abstand_probenrand_px"),
    )


def image_table(per_image: DataFrame) -> DataFrame:
    """One row for each image (16 columns), from ``statistics.per_image``; what is unknown there is empty."""
    have = set(per_image.columns)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in have else F.lit("")

    warnings = F.coalesce(F.array_join("warnings", " | "), F.lit("")) if "warnings" in have else F.lit("")
    excluded = F.col("excluded_area_px") if "excluded_area_px" in have else F.lit(0)
    return per_image.select(
        F.col("name").alias("bild"),
        F.col("width").alias("breite_px"),
        F.col("height").alias("hoehe_px"),
        _n("um_per_px").alias("um_per_px"),
        text("label_text").alias("massstab_text"),
        F.col("specimen_area_px").alias("probenflaeche_px"),
        _n("specimen_area_mm2").alias("probenflaeche_mm2"),
        excluded.cast("bigint").alias("ausgeschlossen_px"),
        F.col("pore_count").alias("porenzahl"),
        _n("pore_area_px").alias("porenflaeche_px"),
        _n("porosity_pct").alias("porositaet_pct"),
        _n("porosity_pct_excl_edge").alias("porositaet_pct_ohne_randporen"),
        _n("pore_density_per_mm2").alias("porendichte_pro_mm2"),
        _n("largest_diameter_um").alias("groesste_pore_um"),
        F.col("rejected_count").alias("verworfen"),
        warnings.alias("warnungen"),
    )


def rejected_table(judged: DataFrame, names: DataFrame) -> DataFrame:
    """One row for each rejected object, with the reason (10 columns). An infinite aspect ratio is left empty."""
    aspect = fm.aspect_ratio("major_axis_px", "minor_axis_px")
    rows = judged.where(F.col("filter_name").isNotNull()).join(names.select("image_id", "name"), "image_id")
    return rows.select(
        F.col("name").alias("bild"),
        "label",
        F.col("filter_name").alias("filter"),
        F.col("reason").alias("grund"),
        _n("area_px").alias("flaeche_px"),
        _n("equivalent_diameter_px").alias("durchmesser_px"),
        _n(F.when(aspect != float("inf"), aspect)).alias("seitenverhaeltnis"),
        _n("solidity").alias("soliditaet"),
        _n(fm.feret_roundness("area_px", "feret_max_px")).alias("rundheit"),
        _n("minor_axis_px").alias("nebenachse_px"),
    )
