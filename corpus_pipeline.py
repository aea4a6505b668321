"""A training-data pipeline over ``documents``: quality, language, exact and near duplicates, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next stage's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm.exact_dedup import first_of_each
from lacuna.llm.language import keep_identified
from lacuna.llm.near_duplicates import one_of_each
from lacuna.llm.packing import pack_stage
from lacuna.llm.quality import keep_accepted
from lacuna.llm.shared import Scratch, table

STAGES = [
    ("quality classifier", keep_accepted),
    ("language ID", keep_identified),
    ("exact dedup", first_of_each),
    ("n-gram Jaccard join", one_of_each),
    ("packing", pack_stage),
]

#: Learned models, components and packing are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table: a row for each packed piece."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(k))
        if k > 1:
            scratch.drop(str(k - 2))
    return docs
