"""Proxy tables over the synthetic TPC-H-like data: measured objects, images, pixels, corrections, readings.

The SQL is common to Spark and the oracle, apart from how an array is unnested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OBJECTS = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate,
             l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS label FROM {lineitem}),
b AS (SELECT l_suppkey AS image_id, CAST(label AS INT) AS label, l_quantity AS area_px, sqrt(4*l_quantity/pi()) AS d, 1+20*l_tax AS k,
             l_discount, l_linenumber, l_partkey, l_orderkey, l_returnflag, l_linestatus FROM n)
SELECT image_id, label, area_px, d AS equivalent_diameter_px,
  2*sqrt(pi()*area_px)*(1+10*l_discount) AS perimeter_px,
  d*k AS feret_max_px, d*k AS major_axis_px,
  CASE WHEN l_linenumber=7 AND l_discount=0 THEN CAST(0 AS DOUBLE) ELSE d/k END AS minor_axis_px,
  1-7*l_discount AS solidity,
  CAST(l_partkey%1000 AS DOUBLE)/1000 AS eccentricity, CAST(l_orderkey%180 AS DOUBLE)-90 AS orientation_deg,
  CAST(l_orderkey%1000 AS DOUBLE)+CAST(0.25 AS DOUBLE) AS centroid_x_px, CAST(l_partkey%150 AS DOUBLE) AS centroid_y_px,
  CAST(floor(d*k) AS INT)+1 AS bbox_w, CAST(floor(d/k) AS INT)+CAST(l_linenumber AS INT) AS bbox_h,
  CAST(l_partkey%256 AS DOUBLE) AS mean_intensity, CAST(l_partkey%101 AS DOUBLE) AS min_intensity, CAST(l_partkey%60 AS DOUBLE) AS contrast,
  l_returnflag='R' AS touches_image_edge, l_linestatus='O' AS touches_specimen_edge,
  CASE WHEN l_returnflag='N' THEN NULL ELSE CAST(l_orderkey%40 AS DOUBLE) END AS specimen_edge_distance_px,
  CASE WHEN l_suppkey_%5=0 THEN NULL ELSE CAST(0.25 AS DOUBLE)*(1+l_suppkey_%4) END AS um_per_px
FROM (SELECT *, image_id AS l_suppkey_ FROM b) c
"""

IMAGES = """
SELECT s_suppkey AS image_id, concat('probe_', CAST(s_suppkey AS STRING), '.tif') AS name,
  200+10*CAST(s_suppkey%7 AS INT) AS width, 150 AS height,
  CASE WHEN s_suppkey%7=0 THEN CAST(0 AS BIGINT) ELSE CAST(200+10*(s_suppkey%7) AS BIGINT)*150-500*(s_suppkey%11) END AS specimen_area_px,
  CASE WHEN s_suppkey%5=0 THEN NULL ELSE CAST(0.25 AS DOUBLE)*(1+s_suppkey%4) END AS um_per_px
FROM {supplier}
"""

_PIXEL = "CAST(floor((i-1)/8) AS INT) AS y, CAST((i-1)%8 AS INT) AS x, CAST(floor((CAST(v AS DOUBLE)+0.6)*200) AS INT) AS gray"
PIXELS_SPARK = f"SELECT vec_id AS image_id, {_PIXEL} FROM (SELECT vec_id, v, p+1 AS i FROM {{embeddings}} LATERAL VIEW posexplode(embedding) t AS p, v) q"
PIXELS_ORACLE = f"SELECT vec_id AS image_id, {_PIXEL} FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) q"

CORRECTIONS = """
SELECT user_id%10+1 AS image_id, CAST(row_number() OVER (PARTITION BY user_id%10 ORDER BY ts, event_id) AS INT) AS seq,
  CASE event_type WHEN 'view' THEN 'aufnehmen' WHEN 'signup' THEN 'aufnehmen' ELSE 'entfernen' END AS action,
  CAST(event_id%400+1 AS INT) AS label FROM {events}
"""

READINGS = """
SELECT user_id AS candidate_id, event_id AS seq,
  (floor(value/100)*100+50)*(1+CAST(0.0006 AS DOUBLE)*(event_id%3)) AS value_um,
  CASE WHEN event_id%2=0 THEN 'rapidocr' ELSE 'tesseract' END AS engine,
  CASE WHEN event_id%2=0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS weight,
  CAST(event_id%11 AS DOUBLE)/10 AS ocr_confidence
FROM {events}
"""

_SOURCE = {"objects": (OBJECTS, "lineitem"), "images": (IMAGES, "supplier"), "pixels": (PIXELS_SPARK, "embeddings"), "corrections": (CORRECTIONS, "events"), "readings": (READINGS, "events")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the proxy tables."""
    sql, source = _SOURCE[name]
    return spark.sql(sql, **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def oracle_views(*names: str) -> str:
    """The same tables as common table expressions of the oracle."""
    parts = []
    for name in names:
        sql, source = _SOURCE[name]
        parts.append(f"{name} AS ({PIXELS_ORACLE if name == 'pixels' else sql.replace('{' + source + '}', source)})")
    return "WITH RECURSIVE " + ",\n".join(parts)
