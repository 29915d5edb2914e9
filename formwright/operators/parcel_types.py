"""Parcels by the core form types of their buildings: dominated by one, or diverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_residential(label: Column, names: list[str], codes: dict[float, str]) -> Column:
    """The label is one of the names, or a number whose name is."""
    as_name = F.create_map(*[x for c, n in codes.items() for x in (F.lit(float(c)), F.lit(n))])[label.cast("string").try_cast("double")] if codes else F.lit(None).cast("string")
    return F.coalesce(label.cast("string").isin(*names), F.lit(False)) | F.coalesce(as_name.isin(*names), F.lit(False))


def parcel_types(buildings: DataFrame, block: str, kind: str, label: str, order: str, residential: Column, general: float = 0.50, homes: float = 0.60, least: int = 2, strict: bool = True) -> DataFrame:
    """block, label, is_residential, threshold_used, num_buildings, dominant_type, dominant_count, dominant_frac, config_type.

    The dominant type is the commonest, the first in row order of equals; the parcel is `dominant` where that type has `least` buildings and a share over the threshold (strictly),
    else `diverse`. Counts by block and type are combined before the shuffle, so a block of any size is a few rows.
    """
    counts = buildings.groupBy(block, kind).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by(label, order).alias("label"))
    per = counts.groupBy(block).agg(F.sum("n").alias("num_buildings"), F.max_by(F.struct(kind, "n"), F.struct("n", -F.col("first"))).alias("top"), F.min_by("label", "first").alias(label))
    out = per.select(block, label, "num_buildings", F.col(f"top.{kind}").alias("dominant_type"), F.col("top.n").alias("dominant_count"), (F.col("top.n") / F.col("num_buildings")).alias("dominant_frac"))
    out = out.withColumn("is_residential", residential).withColumn("threshold_used", F.when(F.col("is_residential"), F.lit(homes)).otherwise(F.lit(general)))
    over = F.col("dominant_frac") > F.col("threshold_used") if strict else F.col("dominant_frac") >= F.col("threshold_used")
    return out.withColumn("config_type", F.when((F.col("dominant_count") >= least) & over, "dominant").otherwise("diverse")).withColumn("dominant_frac", F.bround("dominant_frac", 4))


def config_counts(parcels: DataFrame) -> DataFrame:
    return parcels.groupBy("config_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "config_type")
