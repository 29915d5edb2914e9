"""Tables in and out: stored bounds, feature text, and the manifest of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.operators.spatial import in_box, with_bounds


def curve_key(x: Column, y: Column) -> Column:
    """The place of a grid cell on a Z-order curve: the bits of two whole numbers (32 each, offset by 2**31), interleaved."""
    key = F.lit(0).cast("long")
    for v, at in ((x, 0), (y, 1)):
        spread = (v.cast("long") + F.lit(2**31)).bitwiseAND(F.lit(2**32 - 1))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            spread = spread.bitwiseOR(F.shiftleft(spread, shift)).bitwiseAND(F.lit(mask))
        key = key.bitwiseOR(F.shiftleft(spread, at))
    # Signed order is the curve's own once the top bit is turned.
    return key.bitwiseXOR(F.lit(-(2**63)))


def write_footprints(df: DataFrame, path: str, cell: float = 100.0, row_group_bytes: int = 16 << 20) -> None:
    """Parquet with bounds, along a Z-order curve over grid cells in and across files, so that a box filter leaves out most files and row groups."""
    b = with_bounds(df)
    at = curve_key(F.floor((F.col("minx") + F.col("maxx")) / 2 / cell), F.floor((F.col("miny") + F.col("maxy")) / 2 / cell))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b.withColumn("curve", at).repartitionByRange(n, "curve").sortWithinPartitions("curve").drop("curve").write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(path)


def read_footprints(spark: SparkSession, paths: list[str], box: tuple[float, float, float, float] | None = None, ids: tuple[str, list] | None = None) -> DataFrame:
    """Tiles of one layer, with a box or a list of ids that the scan filters by."""
    df = spark.read.parquet(*paths)
    df = df.where(in_box(*box)) if box else df
    return df.where(F.col(ids[0]).isin(ids[1])) if ids else df


def as_geojson(df: DataFrame, properties: list[str], parts: str = "parts") -> DataFrame:
    """One column, value: a GeoJSON feature in each row, for a text sink."""
    closed = F.transform(parts, lambda part: F.transform(part, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p.x, p.y))))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), closed.alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(feature).alias("value"))


def from_geojson(df: DataFrame, properties: str, value: str = "value") -> DataFrame:
    """The footprints again; properties: their types as DDL."""
    kind = f"properties struct<{properties}>, geometry struct<coordinates: array<array<array<array<double>>>>>"
    f = df.select(F.from_json(value, kind).alias("f"))
    ring = lambda r: F.transform(F.slice(r, 1, F.size(r) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select("f.properties.*", F.transform("f.geometry.coordinates", lambda part: F.transform(part, ring)).alias("parts"))


def record_run(spark: SparkSession, manifest: str, stage: str, path: str) -> None:
    """Append where a stage wrote, with the time: later stages ask the manifest, not the newest file."""
    spark.range(1).select(F.lit(stage).alias("stage"), F.lit(path).alias("path"), F.current_timestamp().alias("at"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss").alias("run_id")).write.mode("append").parquet(manifest)


def latest(runs: DataFrame, stage: str = "stage", path: str = "path", at: str = "at") -> DataFrame:
    """stage, path: the newest of each stage."""
    return runs.groupBy(stage).agg(F.max_by(path, F.struct(at, path)).alias(path))


def resolve_column(df: DataFrame, preferred: str, candidates: list[str]) -> str:
    """The configured column, else the first candidate that is there; none is an error."""
    for name in (preferred, *candidates):
        if name in df.columns:
            return name
    raise KeyError(f"none of {[preferred, *candidates]} among {df.columns}")


def column_with_values(df: DataFrame, candidates: list[str], values: list[str]) -> str | None:
    """The candidate column in which most of the values occur, or None where none does."""
    able = [c for c in candidates if c in df.columns]
    if not able:
        return None
    hits = df.agg(*[F.count_distinct(F.when(F.trim(F.col(c).cast("string")).isin(*values), F.trim(F.col(c).cast("string")))).alias(c) for c in able]).first()
    best = max(able, key=lambda c: hits[c])
    return best if hits[best] else None
