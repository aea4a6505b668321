"""Scale recognition from readings of a label: voting, consensus, confidence, and overrides by file name.

Readings of a candidate are few (engines times picture versions), so they are folded in an ordered
array; grouping compares with the first member of a group and is not transitive, which rules out a GROUP BY.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import formulas as fm

# Fixed values.
SAME_VALUE = 0.001
CONSENSUS_WEIGHT = 1.5
HARD_BOUNDS = (1e-6, 1e12)
EXPECTED_BOUNDS = (1e-3, 1e3)
SHARES = {"geometry": 0.35, "ocr": 0.30, "agreement": 0.35}


def vote(weight: Column, confidence: Column) -> Column:
    """An unsure reading counts less, but never nothing."""
    return weight * (0.5 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= SAME_VALUE * F.greatest(F.abs(a), F.abs(b))


def _ordered(readings: DataFrame, key: str) -> DataFrame:
    r = readings.withColumn("vote", vote(F.col("weight"), F.col("ocr_confidence")))
    return r.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "value_um", "engine", "weight", "ocr_confidence", "vote"))).alias("readings"))


def groups(readings: Column) -> Column:
    """array<struct<first value, votes, n, best>>: each reading joins the first group whose first value is close to its own."""
    kind = "array<struct<value_um:double,votes:double,n:int,best_confidence:double,best_weight:double,best_engine:string>>"

    def add(acc: Column, r: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda g: close(g["value_um"], r["value_um"])), F.lit(True))
        own = F.struct(r["value_um"].alias("value_um"), r["vote"].alias("votes"), F.lit(1).alias("n"), r["ocr_confidence"].alias("best_confidence"), r["weight"].alias("best_weight"), r["engine"].alias("best_engine"))

        def grown(g: Column, i: Column) -> Column:
            better = (r["ocr_confidence"] > g["best_confidence"]) | ((r["ocr_confidence"] == g["best_confidence"]) & (r["weight"] > g["best_weight"]))
            more = F.struct(
                g["value_um"].alias("value_um"),
                (g["votes"] + r["vote"]).alias("votes"),
                (g["n"] + 1).alias("n"),
                F.when(better, r["ocr_confidence"]).otherwise(g["best_confidence"]).alias("best_confidence"),
                F.when(better, r["weight"]).otherwise(g["best_weight"]).alias("best_weight"),
                F.when(better, r["engine"]).otherwise(g["best_engine"]).alias("best_engine"),
            )
            return F.when(i == at - 1, more).otherwise(g)

        return F.when(at > 0, F.transform(acc, grown)).otherwise(F.concat(acc, F.array(own))).cast(kind)

    return F.aggregate(readings, F.array().cast(kind), add)


def votes(readings: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Per candidate: the winning group (the first of equally strong ones), its share, the groups, and whether there is a consensus."""
    g = _ordered(readings, key).withColumn("groups", groups(F.col("readings")))
    total = F.aggregate("groups", F.lit(0.0), lambda a, x: a + x["votes"])
    strongest = F.array_max(F.transform("groups", lambda x, i: F.struct(x["votes"].alias("votes"), (-i).alias("o"), x.alias("g"))))
    won = strongest["g"]
    return g.select(
        key,
        won["value_um"].alias("value_um"),
        (won["votes"] / F.when(total != 0, total).otherwise(1.0)).alias("agreement"),
        won["best_confidence"].alias("ocr_confidence"),
        won["best_engine"].alias("engine"),
        F.size("groups").alias("groups"),
        F.size("readings").alias("readings"),
        ((F.size("groups") == 1) & (won["votes"] >= CONSENSUS_WEIGHT)).alias("consensus"),
    )


def readings_asked(readings: DataFrame, key: str = "candidate_id", per_variant: int = 2) -> DataFrame:
    """How many readings of each candidate are needed before a consensus ends the asking.

    ``per_variant`` readings belong to a picture version; asking ends after a version with a consensus.
    """
    g = _ordered(readings, key)
    n = F.size("readings")
    steps = F.transform(F.sequence(F.lit(1), F.ceil(n / per_variant).cast("int")), lambda k: F.least(k * per_variant, n))
    counts = F.array_sort(steps)

    def agreed(k: Column) -> Column:
        gs = groups(F.slice("readings", F.lit(1), k))
        return (F.size(gs) == 1) & (F.get(gs, F.lit(0))["votes"] >= CONSENSUS_WEIGHT)

    return g.select(key, F.coalesce(F.get(F.filter(counts, agreed), F.lit(0)), n).alias("asked"))


def confidence(geometry: Column, ocr: Column, agreement: Column, corrected: Column, um_per_px: Column) -> Column:
    """From how it looks, how sure the reading was and how much the readings agree; null beyond the hard bounds."""
    c = SHARES["geometry"] * geometry + SHARES["ocr"] * ocr + SHARES["agreement"] * agreement
    c = F.when(corrected, c * 0.8).otherwise(c)
    c = F.when(um_per_px.between(*EXPECTED_BOUNDS), c).otherwise(c * 0.9)
    return F.when(um_per_px.between(*HARD_BOUNDS), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def overlay_score(bar: Column, has_label: Column, centred: Column, tight: Column) -> Column:
    """A candidate's score from its bar's and what is around it, 1 at most."""
    return F.least(F.lit(1.0), bar + F.when(has_label, 0.25).otherwise(0.0) + 0.1 * centred + 0.05 * tight)


def override(name: Column, patterns: list[tuple[str, float]]) -> Column:
    """The scale of the first pattern found in a file name; null if none is."""
    hits = [F.when(name.rlike(p), F.lit(float(um))) for p, um in patterns]
    return F.coalesce(*hits) if hits else F.lit(None).cast("double")


def resolve(candidates: DataFrame, key: str = "image_id") -> DataFrame:
    """Of the candidates of an image with a scale, the one with the highest score; the first of equals."""
    rated = candidates.where(F.col("um_per_px").isNotNull())
    best = rated.groupBy(key).agg(F.max(F.struct("score", (-F.col("seq")).alias("o"), "um_per_px", "confidence")).alias("top"))
    return best.select(key, "top.um_per_px", "top.confidence", "top.score")


def overlay_pixels(x: Column, y: Column, box: Column, pad: int, width: Column, height: Column) -> Column:
    """Whether a pixel belongs to the overlay; false without a box."""
    b = fm.box_padded(box, pad, width, height)
    inside = (x >= b["x"]) & (x < b["x"] + b["w"]) & (y >= b["y"]) & (y < b["y"] + b["h"])
    return F.coalesce(inside, F.lit(False))


