"""Settings as flattened tables (path, value): overlay, deviations, differences."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ORDER = "[]"  # ends the path that holds the order of a list of named things


def _named(value) -> bool:
    return isinstance(value, list) and bool(value) and all(isinstance(x, dict) and "name" in x for x in value)


def flattened(tree: dict, prefix: str = "", by_name: bool = False) -> list[tuple[str, str]]:
    """Paths with JSON values; lists are values as a whole.

    With ``by_name`` a list of things with names (the filters) is taken apart by name instead, and a row of its own holds the order of the names.
    """
    rows = []
    for key, value in tree.items():
        path = f"{prefix}{key}"
        if by_name and _named(value):
            rows.append((path + ORDER, json.dumps([str(x["name"]) for x in value], ensure_ascii=False)))
            rows += flattened({str(x["name"]): x for x in value}, f"{path}.", True)
        else:
            rows += flattened(value, f"{path}.", by_name) if isinstance(value, dict) and value else [(path, json.dumps(value, ensure_ascii=False, sort_keys=True))]
    return rows


def nested(rows: list[tuple[str, str]]) -> dict:
    out: dict = {}
    for path, value in rows:
        *above, last = path.split(".")
        at = out
        for key in above:
            at = at.setdefault(key, {})
        at[last] = json.loads(value)
    return out


def table(spark: SparkSession, tree: dict, by_name: bool = False) -> DataFrame:
    return spark.createDataFrame(flattened(tree, by_name=by_name), "path string, value string")


def same(a, b):
    """Numbers are compared by value, everything else, truth values included, as it is written."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.eqNullSafe(b))


def overlaid(base: DataFrame, own: DataFrame) -> DataFrame:
    """The base with own values in place of its own; unknown paths are kept."""
    b, o = base.withColumnRenamed("value", "base"), own.withColumnRenamed("value", "own")
    return b.join(o, "path", "full_outer").select("path", F.coalesce("own", "base").alias("value"))


def deviations(base: DataFrame, own: DataFrame) -> DataFrame:
    """Own values that differ from the base."""
    b = base.withColumnRenamed("value", "base")
    return own.join(b, "path", "left").where(F.col("base").isNull() | ~same(F.col("base"), F.col("value"))).select("path", "value")


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old, new where they differ; null where a path is missing.

    Of tables made ``by_name``, the order of names is told only where the same names stand in another order; else the values of
    each name tell what changed.
    """
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "path", "full_outer")
    differ = F.col("old").isNull() | F.col("new").isNull() | ~same(F.col("old"), F.col("new"))
    before, after = (F.array_sort(F.array_distinct(F.from_json(c, "array<string>"))) for c in ("old", "new"))
    moved = F.coalesce((before == after) & (F.col("old") != F.col("new")), F.lit(False))
    return both.where(F.when(F.col("path").endswith(ORDER), moved).otherwise(differ)).select("path", "old", "new")


def change_lines(changes: DataFrame) -> DataFrame:
    """path, line of ``differences``: ``path: old -> new``, with texts as they are and ``-`` for what is missing or null."""

    def shown(c: str):
        text = F.when(F.col(c).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), F.col(c), F.lit("}")), "v string")["v"]).otherwise(F.col(c))
        return F.when(F.col(c).isNull() | (F.col(c) == "null"), "-").otherwise(text)

    path, moved = F.col("path"), F.col("path").endswith(ORDER)
    name = F.when(moved, F.substring(path, F.lit(1), F.length(path) - len(ORDER))).otherwise(path)
    line = F.when(moved, F.concat(name, F.lit(": Reihenfolge geändert"))).otherwise(F.concat(name, F.lit(": "), shown("old"), F.lit(" -> "), shown("new")))
    return changes.select(name.alias("path"), line.alias("line"))


def adapted(own, template):
    """Own values in the types of the template: whole and decimal numbers follow it, truth values stay, unknown keys stay."""
    if isinstance(own, dict) and isinstance(template, dict):
        return {k: adapted(v, template[k]) if k in template else v for k, v in own.items()}
    if isinstance(own, bool) or isinstance(template, bool):
        return own
    if isinstance(template, float) and isinstance(own, int):
        return float(own)
    if isinstance(template, int) and isinstance(own, float) and own.is_integer():
        return int(own)
    return own
