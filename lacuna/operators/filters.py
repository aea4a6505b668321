"""Rules that reject measured objects, and the ordered chain of them.

A rule builds two columns: whether it fires, and the reason in words. The chain is a ``coalesce`` in a
narrow projection: the first rule that fires decides, there is no shuffle and no UDF. Name and reason
are columns of their own, so queries that only need the verdict never build a text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import formulas as fm
from lacuna.functions.text import fixed, general, percent

#: Below so many pixels an object has no shape to judge by (fixed value).
SHAPE_PIXELS = 25

@dataclass(frozen=True)
class Hit:
    """Whether a rule fires (null counts as no), and why."""

    fires: Column
    reason: Column


Rule = Callable[[dict[str, float]], Hit]
_RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    """Register a rule; own ones may be added in the same way."""

    def add(build: Rule) -> Rule:
        _RULES[name] = build
        return build

    return add


def available() -> list[str]:
    return sorted(_RULES)


def describe(name: str) -> str:
    """The first paragraph of a rule's text."""
    return " ".join((_RULES[name].__doc__ or "").split("\n\n", 1)[0].split())


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _optional(value: Column, digits: int, unit: str) -> Column:
    return F.when(value.isNotNull(), _text(" (", fixed(value, digits), f" {unit})")).otherwise("")


def _aspect() -> Column:
    return fm.aspect_ratio("major_axis_px", "minor_axis_px")


def _shaped() -> Column:
    return F.col("area_px") >= SHAPE_PIXELS


@rule("min_area")
def min_area(p: dict[str, float]) -> Hit:
    """Objects of fewer pixels are noise."""
    least = p.get("min_area_px", 0.0)
    return Hit(F.col("area_px") < least, _text("Fläche ", fixed(F.col("area_px"), 0), f" px unter {general(least)} px", _optional(fm.area_um2("area_px", "um_per_px"), 1, "µm²")))


@rule("max_area")
def max_area(p: dict[str, float]) -> Hit:
    """Objects that fill more than a share of the specimen; without a specimen nothing is rejected."""
    most = p.get("max_area_frac", 1.0)
    share = F.when(F.col("specimen_area_px") > 0, F.col("area_px") / F.col("specimen_area_px"))
    return Hit(share > most, _text("Fläche ", percent(share, 1), f" der Probe über {most:.0%}"))


@rule("aspect_ratio")
def aspect_ratio(p: dict[str, float]) -> Hit:
    """Objects that are too elongated; a minor axis of zero counts as infinitely so."""
    most = p.get("max_aspect_ratio", float("inf"))
    return Hit(_aspect() > most, _text("Seitenverhältnis ", fixed(_aspect(), 1), f" über {general(most)}"))


@rule("circularity")
def circularity(p: dict[str, float]) -> Hit:
    """Objects whose outline is too ragged."""
    least, c = p.get("min_circularity", 0.0), fm.circularity("area_px", "perimeter_px")
    return Hit(c < least, _text("Rundheit ", fixed(c, 2), f" unter {general(least)}"))


@rule("solidity")
def solidity(p: dict[str, float]) -> Hit:
    """Objects that fill too little of their convex hull."""
    least = p.get("min_solidity", 0.0)
    return Hit(F.col("solidity") < least, _text("Solidität ", fixed(F.col("solidity"), 2), f" unter {general(least)}"))


@rule("contrast")
def contrast(p: dict[str, float]) -> Hit:
    """Objects that stand out too little from the background."""
    least = p.get("min_contrast", 0.0)
    return Hit(F.col("contrast") < least, _text("Kontrast ", fixed(F.col("contrast"), 0), f" Graustufen unter {general(least)}"))


@rule("intensity")
def intensity(p: dict[str, float]) -> Hit:
    """Objects that are too bright."""
    most = p.get("max_mean_intensity", 255.0)
    return Hit(F.col("mean_intensity") > most, _text("mittlerer Grauwert ", fixed(F.col("mean_intensity"), 0), f" über {general(most)}"))


@rule("min_diameter")
def min_diameter(p: dict[str, float]) -> Hit:
    """Objects too small to be measured."""
    least, d = p.get("min_diameter_px", 0.0), F.col("equivalent_diameter_px")
    return Hit(d < least, _text("Durchmesser ", fixed(d, 1), f" px unter {general(least)} px", _optional(fm.length_um(d, "um_per_px"), 2, "µm")))


@rule("scratch")
def scratch(p: dict[str, float]) -> Hit:
    """Objects that are long, thin and straight. The width is judged in micrometres where a limit and a scale are known."""
    ratio, limit_um, limit_px = p.get("min_aspect_ratio", 4.0), p.get("max_width_um"), p.get("max_width_px", 0.0)
    width_um = F.coalesce(fm.length_um("minor_axis_px", "um_per_px"), F.lit(0.0))
    scaled = F.col("um_per_px").isNotNull() if limit_um is not None else F.lit(False)
    thin = F.when(scaled, width_um <= (limit_um or 0.0)).otherwise(F.col("minor_axis_px") <= limit_px)
    width = F.when(scaled, _text(fixed(width_um, 2), " µm")).otherwise(_text(fixed(F.col("minor_axis_px"), 1), " px"))
    hit = (_aspect() >= ratio) & thin & (F.col("solidity") >= p.get("min_solidity", 0.6))
    return Hit(hit, _text("Schleifriefe: Breite ", width, " bei Seitenverhältnis ", fixed(_aspect(), 1), " und Solidität ", fixed(F.col("solidity"), 2)))


@rule("roundness")
def roundness(p: dict[str, float]) -> Hit:
    """Objects too small for their longest diameter; only from a size on at which shape means something."""
    least, r = p.get("min_roundness", 0.0), fm.feret_roundness("area_px", "feret_max_px")
    return Hit(_shaped() & (r < least), _text("Rundheit ", fixed(r, 2), f" unter {general(least)}"))


@rule("compactness")
def compactness(p: dict[str, float]) -> Hit:
    """As solidity, but only from a size on at which shape means something."""
    least = p.get("min_solidity", 0.0)
    return Hit(_shaped() & (F.col("solidity") < least), _text("Solidität ", fixed(F.col("solidity"), 2), f" unter {general(least)}"))


@rule("edge_distance")
def edge_distance(p: dict[str, float]) -> Hit:
    """Objects in a strip along the specimen's edge; an unknown distance keeps the object."""
    least, d = p.get("min_distance_px", 0.0), F.col("specimen_edge_distance_px")
    return Hit(d < least, _text(fixed(d, 0), f" px vom Probenrand, unter {general(least)} px"))


@rule("extent")
def extent(p: dict[str, float]) -> Hit:
    """Objects that fill too little of their bounding box; only from a size on at which shape means something."""
    least, e = p.get("min_extent", 0.0), fm.extent("area_px", F.col("bbox_w") * F.col("bbox_h"))
    return Hit(_shaped() & (e < least), _text("Füllgrad der Box ", fixed(e, 2), f" unter {general(least)}"))


@rule("edge")
def edge(p: dict[str, float]) -> Hit:
    """Objects cut by the image's edge or, if asked for, at the specimen's edge."""
    at_image = F.lit(bool(p.get("image_edge", 1.0))) & F.col("touches_image_edge")
    at_specimen = F.lit(bool(p.get("specimen_edge", 0.0))) & F.col("touches_specimen_edge")
    return Hit(at_image | at_specimen, F.when(at_image, "am Bildrand angeschnitten").otherwise("am Probenrand - vermutlich Ausbruch aus der Präparation"))


@dataclass(frozen=True)
class Setting:
    name: str
    enabled: bool = True
    params: dict[str, float] = field(default_factory=dict)


# The default chain.
DEFAULT = (
    Setting("min_diameter", True, {"min_diameter_px": 4.0}),
    Setting("scratch", True, {"min_aspect_ratio": 4.0, "max_width_um": 4.0, "max_width_px": 4.0, "min_solidity": 0.6}),
    Setting("compactness", True, {"min_solidity": 0.40}),
    Setting("roundness", True, {"min_roundness": 0.20}),
    Setting("extent", False, {"min_extent": 0.30}),
    Setting("min_area", False, {"min_area_px": 6.0}),
    Setting("max_area", False, {"max_area_frac": 0.5}),
    Setting("aspect_ratio", False, {"max_aspect_ratio": 8.0}),
    Setting("edge", False, {"image_edge": 1.0, "specimen_edge": 0.0}),
    Setting("edge_distance", False, {"min_distance_px": 10.0}),
    Setting("circularity", False, {"min_circularity": 0.3}),
    Setting("solidity", False, {"min_solidity": 0.6}),
    Setting("contrast", False, {"min_contrast": 15.0}),
)


def hit(name: str, params: dict[str, float]) -> Hit:
    if name not in _RULES:
        raise KeyError(f"unknown filter {name}; known are {', '.join(available())}")
    return _RULES[name](params)


def verdict(settings: tuple[Setting, ...] = DEFAULT) -> tuple[Column, Column]:
    """Name and reason of the first enabled rule that fires, in the settings' order; both null for counted objects."""
    none = F.lit(None).cast("string")
    hits = [(s.name, hit(s.name, s.params)) for s in settings if s.enabled]
    return F.coalesce(*[F.when(h.fires, n) for n, h in hits], none, none), F.coalesce(*[F.when(h.fires, h.reason) for _, h in hits], none, none)


def apply(objects: DataFrame, settings: tuple[Setting, ...] = DEFAULT) -> DataFrame:
    """Objects with ``filter_name`` and ``reason``, both null for counted ones."""
    name, why = verdict(settings)
    return objects.select(*[c for c in objects.columns if c not in ("filter_name", "reason")], name.alias("filter_name"), why.alias("reason"))
