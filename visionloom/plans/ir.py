"""The relational image model, and projections of the benchmark tables onto it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ["uid", "rel_path", "source_id", "width", "height", "split", "grp", "sha1", "ord"]
ANNOTATIONS = ["image_uid", "category", "kind", "x1", "y1", "x2", "y2", "score"]


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def images(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").selectExpr(
        "concat('o', CAST(o_orderkey AS STRING)) uid",
        "concat('img/', left(o_orderpriority, 1), '/', CAST(o_orderkey AS STRING), '.jpg') rel_path",
        "concat('src', left(o_orderpriority, 1)) source_id",
        "CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 53 = 0 THEN 24 WHEN o_orderkey % 89 = 0 THEN 6400 ELSE 320 + 32 * (o_orderkey % 11) END AS INT) width",
        "CAST(240 + 24 * (o_custkey % 7) AS INT) height",
        "CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'O' THEN 'val' WHEN o_orderkey % 2 = 0 THEN 'test' END split",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('cust_', CAST(o_custkey AS STRING)) END grp",
        "sha1(CAST((o_orderkey * 7919 + o_custkey) % 12000 AS STRING)) sha1",
        "CAST(o_orderkey AS BIGINT) ord",
    )


def annotations(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").join(load(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    x1, y1 = "CAST(l_partkey % 5 * 80 - 10 AS DOUBLE)", "l_suppkey % 3 * 60"
    box = lambda e, n: f"CASE WHEN l_linenumber <> 7 THEN {e} END {n}"
    return rows.selectExpr(
        "concat('o', CAST(l_orderkey AS STRING)) image_uid",
        "CASE WHEN l_linenumber % 3 = 0 THEN lower(p_type) ELSE p_type END category",
        "CASE WHEN l_linenumber = 7 THEN 'image' ELSE 'bbox' END kind",
        box(x1, "x1"),
        box(f"CAST({y1} + 10 AS DOUBLE)", "y1"),
        box(f"{x1} + CASE WHEN l_partkey % 41 = 0 THEN 0.0D ELSE ceil(l_quantity / 10) * 40 END", "x2"),
        box(f"CAST({y1} + 40 AS DOUBLE)", "y2"),
        "l_discount score",
        "CAST(l_linenumber AS BIGINT) ord",
    )


#: The same projections for DuckDB, as common table expressions.
SQL = """
im AS (SELECT concat('o', CAST(o_orderkey AS STRING)) AS uid,
  concat('img/', left(o_orderpriority, 1), '/', CAST(o_orderkey AS STRING), '.jpg') AS rel_path,
  concat('src', left(o_orderpriority, 1)) AS source_id,
  CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 53 = 0 THEN 24 WHEN o_orderkey % 89 = 0 THEN 6400 ELSE 320 + 32 * (o_orderkey % 11) END AS INT) AS width,
  CAST(240 + 24 * (o_custkey % 7) AS INT) AS height,
  CASE WHEN o_orderstatus = 'F' THEN 'train' WHEN o_orderstatus = 'O' THEN 'val' WHEN o_orderkey % 2 = 0 THEN 'test' END AS split,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('cust_', CAST(o_custkey AS STRING)) END AS grp,
  sha1(CAST((o_orderkey * 7919 + o_custkey) % 12000 AS STRING)) AS sha1, CAST(o_orderkey AS BIGINT) AS ord FROM orders),
an AS (SELECT concat('o', CAST(l_orderkey AS STRING)) AS image_uid,
  CASE WHEN l_linenumber % 3 = 0 THEN lower(p_type) ELSE p_type END AS category,
  CASE WHEN l_linenumber = 7 THEN 'image' ELSE 'bbox' END AS kind,
  CASE WHEN l_linenumber <> 7 THEN CAST(l_partkey % 5 * 80 - 10 AS DOUBLE) END AS x1,
  CASE WHEN l_linenumber <> 7 THEN CAST(l_suppkey % 3 * 60 + 10 AS DOUBLE) END AS y1,
  CASE WHEN l_linenumber <> 7 THEN CAST(l_partkey % 5 * 80 - 10 AS DOUBLE) + CASE WHEN l_partkey % 41 = 0 THEN 0.0 ELSE ceil(l_quantity / 10) * 40 END END AS x2,
  CASE WHEN l_linenumber <> 7 THEN CAST(l_suppkey % 3 * 60 + 40 AS DOUBLE) END AS y2, l_discount AS score, CAST(l_linenumber AS BIGINT) AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
