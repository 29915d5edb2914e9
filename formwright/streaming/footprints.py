"""Footprints that arrive over time (an extension): measured as they come, summed per parcel and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from formwright.operators.shapes import kept_shapes, simple_features


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 10) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def parcel_windows(stream: DataFrame, at: str = "at", late: str = "1 hour", window: str = "1 day", min_area: float = 30.0) -> DataFrame:
    """window_start, block_id, n_buildings, total_area: per parcel and window of arrival; rows later than `late` no longer count. Works on streams and on tables."""
    m = simple_features(stream).where(kept_shapes(F.col("area"), F.lit(1.0), min_area))
    if stream.isStreaming:
        m = m.withWatermark(at, late)
    out = m.groupBy(F.window(at, window).alias("w"), "block_id").agg(F.count("*").alias("n_buildings"), F.sum("area").alias("total_area"))
    return out.select(F.col("w.start").alias("window_start"), "block_id", "n_buildings", "total_area")
