"""Own evaluations, the run log, output folders, and the list that a viewer shows."""

from __future__ import annotations

import importlib.util
import traceback
from collections.abc import Callable
from pathlib import Path
from types import ModuleType

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import formulas as fm
from lacuna.functions.text import rounded

# -- evaluation modules -------------------------------------------------------------------------


def modules(folder: Path) -> list[ModuleType]:
    """Python files that do not start with an underscore and are not switched off by ``ACTIVE = False``, by name."""
    found = []
    for path in sorted(folder.glob("*.py")):
        if not path.name.startswith("_"):
            spec = importlib.util.spec_from_file_location(path.stem, path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            if getattr(module, "ACTIVE", True):
                found.append(module)
    return found


def for_each_image(objects: DataFrame, evaluate: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a function on the objects of each image. Its rows get ``image_id`` and ``error``: a failing image is a row with its trace, the run goes on."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    kind = objects.schema["image_id"].dataType.simpleString()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            out = evaluate(frame)[names].copy()
            out["error"] = None
        except Exception:  # noqa: BLE001
            out = pd.DataFrame({n: [None] for n in names} | {"error": [traceback.format_exc(limit=3)]})
        out.insert(0, "image_id", key[0])
        return out

    return objects.groupBy("image_id").applyInPandas(run, f"image_id {kind}, {schema}, error string")


def for_the_run(table: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A function of the whole table of images."""
    return evaluate(table)


# -- log, folders, view -------------------------------------------------------------------------


def run_log(per_image: DataFrame, run_id: str) -> DataFrame:
    """A line for each image of a run, to be appended to a log table."""
    return per_image.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("at"), "image_id", "pore_count", "porosity_pct", "rejected_count")


def output_folders(images: DataFrame) -> DataFrame:
    """path, folder: the file's stem, with _2, _3 ... where that is taken, whatever the case, by an earlier path.

    A made-up name can meet a real one, but only within names that share what is left without such
    endings. Where no two names of such a family are equal nothing has to be made up, and each file's name is its own; the
    others are numbered in order, a family by one task.
    """

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for path, stem in frame.sort_values("path")[["path", "stem"]].itertuples(index=False):
            name, k = stem, 2
            while name.lower() in taken:
                name, k = f"{stem}_{k}", k + 1
            taken.add(name.lower())
            out.append((path, name))
        return pd.DataFrame(out, columns=["path", "folder"])

    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    family = F.regexp_replace(F.lower(stem), r"(_\d+)+$", "")
    named = images.select("path", stem.alias("stem"), family.alias("family"))
    twice = named.groupBy("family", F.lower("stem").alias("name")).agg(F.count("*").alias("n")).where("n > 1").select("family").distinct()
    alone = named.join(twice, "family", "left_anti").select("path", F.col("stem").alias("folder"))
    return alone.unionByName(named.join(twice, "family").groupBy("family").applyInPandas(number, "path string, folder string"))


# What the list calls the state of an object, and what a hand did to it.
KEPT, REJECTED = "behalten", "verworfen"
BY_HAND = {"removed": "entfernt", "restored": "aufgenommen"}


def viewer_list(corrected: DataFrame) -> DataFrame:
    """Counted and rejected objects in one list, after corrections (``corrections.apply_points``). Its order, the largest first, is the reader's to ask for."""
    um, number = F.col("um_per_px"), lambda c: rounded(c, 3)
    manual = F.when(F.col("counted_before") & ~F.col("counted"), BY_HAND["removed"]).when(~F.col("counted_before") & F.col("counted"), BY_HAND["restored"])
    return corrected.select(
        "image_id",
        "label",
        F.when(F.col("counted"), KEPT).otherwise(REJECTED).alias("status"),
        F.when(~F.col("counted"), F.concat_ws(" - ", "filter_name", "reason")).alias("reason"),
        manual.alias("manual"),
        number(F.col("area_px")).alias("area_px"),
        number(fm.area_um2("area_px", um)).alias("area_um2"),
        number(F.col("equivalent_diameter_px")).alias("diameter_px"),
        number(F.col("equivalent_diameter_px") * um).alias("diameter_um"),
        number(fm.circularity("area_px", "perimeter_px")).alias("circularity"),
        number(F.col("solidity")).alias("solidity"),
        number(F.col("contrast")).alias("contrast"),
        "touches_image_edge",
        "touches_specimen_edge",
    )


