"""Drawings derived from the driver's tables. The text is valid in Spark and DuckDB;
``{table}`` marks a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SEG = """
SELECT drawing_id, seg_id,
  CASE WHEN flip THEN x1 ELSE x0 END AS sx, CASE WHEN flip THEN y1 ELSE y0 END AS sy,
  CASE WHEN flip THEN x0 ELSE x1 END AS ex, CASE WHEN flip THEN y0 ELSE y1 END AS ey
FROM (SELECT drawing_id, seg_id, flip, x0, y0,
        CASE WHEN up THEN x0 ELSE x0 + len END AS x1, CASE WHEN up THEN y0 + len ELSE y0 END AS y1
      FROM (SELECT l_suppkey AS drawing_id,
              CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS BIGINT) AS seg_id,
              CAST((l_partkey % 64) * 4 AS DOUBLE) AS x0, CAST((l_orderkey % 16) * 4 AS DOUBLE) AS y0,
              CAST(1 AS DOUBLE) + l_quantity % 6 AS len, l_returnflag = 'R' AS up, l_linestatus = 'F' AS flip
            FROM {lineitem}) a) b"""
JIT = f"""
SELECT drawing_id, seg_id, sx + (seg_id % 8) / CAST(64 AS DOUBLE) AS sx, sy + ((seg_id * 3) % 5) / CAST(64 AS DOUBLE) AS sy,
  ex + ((seg_id + 3) % 8) / CAST(64 AS DOUBLE) AS ex, ey + ((seg_id + 2) % 7) / CAST(64 AS DOUBLE) AS ey
FROM ({SEG}) s"""
SQ = """
SELECT p_partkey % 20 AS drawing_id, p_partkey AS id, CAST(floor(p_partkey / CAST(20 AS DOUBLE)) AS BIGINT) % 5 AS cell, CAST(p_size AS DOUBLE) AS half FROM {part}"""
RECT = """
SELECT drawing_id, id, x0, y0, x0 + w AS x1, y0 + h AS y1
FROM (SELECT p_partkey % 7 AS drawing_id, p_partkey AS id,
        CAST((p_partkey % 13) * 3 AS DOUBLE) + (p_partkey % 4) / CAST(8 AS DOUBLE) AS x0,
        CAST((CAST(floor(p_partkey / CAST(13 AS DOUBLE)) AS BIGINT) % 5) * 5 AS DOUBLE) AS y0,
        CAST(1 + p_size % 3 AS DOUBLE) AS w, CAST(3 + p_size % 2 AS DOUBLE) AS h FROM {part}) a"""
POLY = """
SELECT vec_id, i, (CAST(10 AS DOUBLE) + 5 * e) * cos(2 * pi() * i / 64) AS x, (CAST(10 AS DOUBLE) + 5 * e) * sin(2 * pi() * i / 64) AS y
FROM (SELECT vec_id, i, CAST(e AS DOUBLE) AS e FROM {embeddings_long}) a"""
ARC = """
SELECT id, x0, y0, x0 + dx AS x1, y0 + dy AS y1, b
FROM (SELECT o_orderkey AS id, CAST(o_custkey % 50 AS DOUBLE) AS x0, CAST(o_orderkey % 40 AS DOUBLE) AS y0,
        CAST(1 + o_orderkey % 7 AS DOUBLE) AS dx, CAST(o_custkey % 5 AS DOUBLE) AS dy, CAST((o_orderkey % 15) - 7 AS DOUBLE) / 4 AS b
      FROM {orders}) a WHERE b <> 0"""
DIAG = """
SELECT user_id AS drawing_id, event_id AS diag_ord, CASE event_type WHEN 'error' THEN 'OPEN_GAP' WHEN 'signup' THEN 'AMBIGUOUS_JUNCTION' WHEN 'view' THEN 'DESPECKLED' WHEN 'click' THEN 'COMMON_EDGE' ELSE 'CONTOURS_WELDED' END AS code
FROM {events} WHERE value > 60"""
PX = """
SELECT l_suppkey AS drawing_id, CAST(floor(l_extendedprice / 500) AS BIGINT) % 256 AS gray FROM {lineitem}"""
ENTITY = """
SELECT user_id AS drawing_id, event_id AS ent_id, CASE event_type WHEN 'purchase' THEN 'LINE' WHEN 'view' THEN 'MTEXT' WHEN 'signup' THEN '3DFACE' WHEN 'error' THEN 'DIMENSION' ELSE 'ARC' END AS kind
FROM {events}"""
ALL = {"seg": SEG, "jit": JIT, "sq": SQ, "rect": RECT, "poly": POLY, "arc": ARC, "diag": DIAG, "px": PX, "entity": ENTITY}

#: One row an element, in each engine's words.
LONG_SPARK = "(SELECT vec_id, pos AS i, e FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, e)"
LONG_DUCK = "(SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS e FROM embeddings)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = ALL[name].replace("{embeddings_long}", LONG_SPARK)
    tables = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def duck(name: str) -> str:
    text = ALL[name].replace("{embeddings_long}", LONG_DUCK)
    return re.sub(r"\{(\w+)\}", r"\1", text)
