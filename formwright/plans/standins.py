"""Buildings, parcels and labels derived from the given tables, in Spark and in the SQL of the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.functions import geometry as g

#: Side of a parcel; parcels lie on a grid of five by five.
SIDE = 1100


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buildings(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """building_id, block_id, height, row_pos, x0, y0, parts: an L-shape for each customer; placed: moved into its parcel's cell."""
    key = F.col("c_custkey").cast("long")
    x0, y0 = (key * 7919 % 10007) % 997, (key * 104729 % 10009) % 991
    if placed:
        x0, y0 = x0 + SIDE * (F.col("c_nationkey") % 5), y0 + SIDE * F.floor(F.col("c_nationkey") / 5)
    base = read(spark, sf_dir, "customer").select(
        key.alias("building_id"), F.col("c_nationkey").cast("long").alias("block_id"), F.col("c_acctbal").cast("double").alias("height"), key.alias("row_pos"),
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (6 + key % 17).cast("double").alias("w"), (5 + key % 11).cast("double").alias("h"))
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    shell = g.ring((x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h))
    return base.withColumn("parts", F.array(F.array(shell))).drop("w", "h")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id, class_id, level1, name, parts: one square cell for each nation, its class the region."""
    key = F.col("n_nationkey").cast("long")
    x, y = (SIDE * (key % 5)).cast("double"), (SIDE * F.floor(key / 5)).cast("double")
    shell = g.ring((x, y), (x + SIDE, y), (x + SIDE, y + SIDE), (x, y + SIDE))
    return read(spark, sf_dir, "nation").select(key.alias("block_id"), F.col("n_regionkey").cast("int").alias("class_id"), (F.col("n_regionkey") + 1).cast("double").alias("level1"), F.col("n_name").alias("name"), F.array(F.array(shell)).alias("parts"))


#: The same in SQL: bld, vtx (vertices) and side (sides) of the footprints in local coordinates.
BLD = """
bld AS (SELECT c_custkey::BIGINT AS building_id, c_nationkey::BIGINT AS block_id, c_acctbal::DOUBLE AS height,
  (((c_custkey::BIGINT * 7919) % 10007) % 997)::DOUBLE AS x0, (((c_custkey::BIGINT * 104729) % 10009) % 991)::DOUBLE AS y0,
  (6 + c_custkey % 17)::DOUBLE AS w, (5 + c_custkey % 11)::DOUBLE AS h FROM customer)"""
VTX = (
    BLD
    + """,
vtx AS (SELECT building_id, block_id, i, x0 + fx * w AS x, y0 + fy * h AS y FROM bld,
  (VALUES (0, 0::DOUBLE, 0::DOUBLE), (1, 1, 0), (2, 1, 0.5), (3, 0.5, 0.5), (4, 0.5, 1), (5, 0, 1)) AS t(i, fx, fy)),
side AS (SELECT *, coalesce(lead(x) OVER v, first_value(x) OVER v) AS x2, coalesce(lead(y) OVER v, first_value(y) OVER v) AS y2
  FROM vtx WINDOW v AS (PARTITION BY building_id ORDER BY i)),
shape AS (SELECT building_id, block_id, sum(x * y2 - x2 * y) / 2 AS area, sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS perimeter,
  sum((x + x2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) AS cx, sum((y + y2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) AS cy
  FROM side GROUP BY building_id, block_id)"""
)
