"""Geometry and porosity formulas as columns. Unknown stays null; divisions are guarded one by one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def equivalent_diameter(area) -> Column:
    """Of the circle with the same area."""
    return F.sqrt(4 * _c(area) / F.pi())


def length_um(length, um_per_px) -> Column:
    return _c(length) * _c(um_per_px)


def area_um2(area, um_per_px) -> Column:
    return _c(area) * _c(um_per_px) * _c(um_per_px)


def circularity(area, perimeter) -> Column:
    """0 where there is no perimeter."""
    return F.when(_c(perimeter) <= 0, 0.0).otherwise(4 * F.pi() * _c(area) / (_c(perimeter) * _c(perimeter)))


def feret_roundness(area, feret) -> Column:
    """Null where there is no diameter."""
    return F.when(_c(feret) > 0, 4 * _c(area) / (F.pi() * _c(feret) * _c(feret)))


def aspect_ratio(major, minor) -> Column:
    """Infinite where the minor axis has no length."""
    return F.when(_c(minor) <= 0, F.lit(float("inf"))).otherwise(_c(major) / _c(minor))


def solidity(area, hull_area) -> Column:
    return F.when(_c(hull_area) <= 0, 0.0).otherwise(_c(area) / _c(hull_area))


def porosity_pct(pore_area, specimen_area) -> Column:
    return F.when(_c(specimen_area) > 0, 100.0 * _c(pore_area) / _c(specimen_area))


def pore_density(count, area_mm2) -> Column:
    """Per square millimetre; null for an area that is unknown or zero."""
    return F.when(_c(area_mm2) != 0, _c(count) / _c(area_mm2))


def area_mm2(area, um_per_px) -> Column:
    return area_um2(area, um_per_px) / 1e6


def px_per_um(um_per_px) -> Column:
    return 1.0 / _c(um_per_px)


def length_px(length_in_um, um_per_px) -> Column:
    return _c(length_in_um) / _c(um_per_px)


def area_px(area_in_um2, um_per_px) -> Column:
    return _c(area_in_um2) / (_c(um_per_px) * _c(um_per_px))


def scale_from_bar(value_um, bar_px) -> Column:
    """Micrometres a pixel; a bar without length is an error."""
    return F.when(_c(bar_px) > 0, _c(value_um) / _c(bar_px)).otherwise(F.raise_error(F.lit("a scale bar has no length")).cast("double"))


def with_warning(warnings, confidence, text: str, factor: float = 1.0) -> tuple[Column, Column]:
    """Warnings with one more, and the confidence scaled and held in 0 to 1."""
    return F.array_append(_c(warnings), F.lit(text)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(confidence) * factor))


def is_trustworthy(warnings, confidence) -> Column:
    return (F.size(_c(warnings)) == 0) & (_c(confidence) >= 0.8)


def extent(area, box_area) -> Column:
    """The share of its bounding box that an object fills; null for an empty box."""
    return F.when(_c(box_area) > 0, _c(area) / _c(box_area))


def specimen_fraction(area, width, height) -> Column:
    """0 for an empty image."""
    total = _c(width) * _c(height)
    return F.when(total > 0, _c(area) / total).otherwise(0.0)


# -- boxes: struct<x, y, w, h> with the origin at the top left --------------------------------


def box(x, y, w, h) -> Column:
    return F.struct(_c(x).cast("int").alias("x"), _c(y).cast("int").alias("y"), _c(w).cast("int").alias("w"), _c(h).cast("int").alias("h"))


def box_from_corners(x1, y1, x2, y2) -> Column:
    return box(x1, y1, _c(x2) - _c(x1), _c(y2) - _c(y1))


def box_area(b) -> Column:
    return _c(b)["w"] * _c(b)["h"]


def box_center(b) -> Column:
    return F.struct((_c(b)["x"] + _c(b)["w"] / 2).alias("x"), (_c(b)["y"] + _c(b)["h"] / 2).alias("y"))


def box_aspect(b) -> Column:
    return F.when(_c(b)["h"] == 0, F.lit(float("inf"))).otherwise(_c(b)["w"] / _c(b)["h"])


def box_padded(b, pad, width=None, height=None) -> Column:
    """Grown on all sides; held within the image where its size is given, and never of negative size."""
    b = _c(b)
    left, top, right, bottom = b["x"] - pad, b["y"] - pad, b["x"] + b["w"] + pad, b["y"] + b["h"] + pad
    if width is not None:
        left, right = F.greatest(F.lit(0), left), F.least(_c(width), right)
    if height is not None:
        top, bottom = F.greatest(F.lit(0), top), F.least(_c(height), bottom)
    return box(left, top, F.greatest(F.lit(0), right - left), F.greatest(F.lit(0), bottom - top))


def box_contains(outer, inner) -> Column:
    o, i = _c(outer), _c(inner)
    return (o["x"] <= i["x"]) & (o["y"] <= i["y"]) & (o["x"] + o["w"] >= i["x"] + i["w"]) & (o["y"] + o["h"] >= i["y"] + i["h"])


def box_union(a, b) -> Column:
    a, b = _c(a), _c(b)
    return box_from_corners(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["x"] + a["w"], b["x"] + b["w"]), F.greatest(a["y"] + a["h"], b["y"] + b["h"]))
