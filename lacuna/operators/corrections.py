"""Manual corrections on measured objects, from an ordered log.

Point corrections only switch an object between counted and rejected, so the last one for an object
decides: a window-free ``max_by``, combined before the exchange. Areas and drawings change pixels;
they are replayed image by image in ``lacuna.raster.replay``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacuna.functions.text import rounded

RESTORE, REMOVE, DRAW, AREA, UNDO = "aufnehmen", "entfernen", "zeichnen", "bereich", "rueckgaengig"
MANUAL, MANUAL_REASON = "von_hand", "von Hand entfernt"


def apply_points(judged: DataFrame, log: DataFrame) -> DataFrame:
    """Objects after corrections: counted_before, counted, filter_name, reason follow the last action for each.

    ``judged``: image_id, label, filter_name, reason, ...; ``log``: image_id, seq, action, label.
    An action that finds the object in the wanted state leaves its reason as it is.
    """
    # Rejected by hand, or by hand again after a restoration: else the automatic reason stands.
    last = log.groupBy("image_id", "label").agg(F.max_by("action", "seq").alias("last_action"), F.count_if(F.col("action") == RESTORE).alias("restorations"))
    rows = judged.join(last, ["image_id", "label"], "left")
    before = F.col("filter_name").isNull()
    now = F.coalesce(F.col("last_action") == RESTORE, before)
    by_hand = ~now & (before | (F.coalesce("restorations", F.lit(0)) > 0))
    kept = [c for c in judged.columns if c not in ("filter_name", "reason")]
    return rows.select(
        *kept,
        before.alias("counted_before"),
        now.alias("counted"),
        F.when(by_hand, MANUAL).when(~now, F.col("filter_name")).alias("filter_name"),
        F.when(by_hand, MANUAL_REASON).when(~now, F.col("reason")).alias("reason"),
    )


def outcome(corrected: DataFrame, log: DataFrame) -> DataFrame:
    """Per image: how many objects were removed and restored, and how many corrections met no object."""
    changed = corrected.groupBy("image_id").agg(F.count(F.when(F.col("counted_before") & ~F.col("counted"), 1)).alias("removed"), F.count(F.when(~F.col("counted_before") & F.col("counted"), 1)).alias("restored"))
    missed = log.join(corrected.select("image_id", "label"), ["image_id", "label"], "left_anti").groupBy("image_id").agg(F.count("*").alias("missed"))
    images = changed.join(missed, "image_id", "full_outer")
    return images.select("image_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("removed", "restored", "missed")])


def stored_corrections(judged: DataFrame, log: DataFrame, has_area: bool = False) -> DataFrame:
    """What a log of wanted states leaves stored: per object the last one, only if it differs from the automatic state.

    With an area among the corrections everything is stored, as the area may have removed the object.
    """
    last = log.groupBy("image_id", "label").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))
    rows = last.join(judged.select("image_id", "label", F.col("filter_name").isNull().alias("automatic")), ["image_id", "label"])
    wanted = F.col("action") == RESTORE
    return rows.where((wanted != F.col("automatic")) | F.lit(has_area)).select("image_id", "seq", "action", "label")


def undone(log: DataFrame) -> DataFrame:
    """A log with ``rueckgaengig`` entries, replayed as a stack: the corrections that stand, in order of ``seq``.

    The height of the stack after each entry is a running sum that never falls below nothing; a correction stands
    if the stack is never lower afterwards than it was with it on top. Two sorts by image, no list of the log: what comes
    later is a running minimum from the end, as a frame that ends behind all rows is gone through anew for each of them.
    """
    so_far = W.partitionBy("image_id").orderBy("seq")
    later = W.partitionBy("image_id").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)
    rows = log.withColumn("_sum", F.sum(F.when(F.col("action") == UNDO, -1).otherwise(1)).over(so_far))
    rows = rows.withColumn("_height", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(so_far)))
    rows = rows.withColumn("_least", F.min("_height").over(later))
    stands = (F.col("action") != UNDO) & (F.coalesce("_least", "_height") >= F.col("_height"))
    return rows.where(stands).select("image_id", "seq", "action", "label")


def to_json(action: Column, x: Column, y: Column, points: Column) -> Column:
    """The stored form: coordinates with two decimals; points only if there are any."""
    rounded_points = F.transform(points, lambda p: F.array(rounded(p["x"], 2), rounded(p["y"], 2)))
    return F.to_json(F.struct(action.alias("aktion"), rounded(x, 2).alias("x"), rounded(y, 2).alias("y"), F.when(F.size(points) > 0, rounded_points).alias("punkte")))


def from_json(stored: Column) -> Column:
    return F.from_json(stored, "aktion string, x double, y double, punkte array<array<double>>")


def anchor(points: Column) -> Column:
    """The mean of an outline's corners; an outline needs three."""
    n = F.size(points)
    mean = F.struct((F.aggregate(points, F.lit(0.0), lambda a, p: a + p["x"]) / n).alias("x"), (F.aggregate(points, F.lit(0.0), lambda a, p: a + p["y"]) / n).alias("y"))
    return F.when(n >= 3, mean)
