"""Shape metrics of footprints, and the rules that clean them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.functions import geometry as g
from formwright.functions import kernels as k

#: The ordered names of a building's features; Height goes in after the fifth where there is one.
FEATURES = (
    "area", "perimeter", "longest_chord", "mean_radius", "covered_area_ratio", "sbro", "lco", "bisector_orientation", "weighted_orientation", "complexity_index", "ipq",
    "fractality", "max_circularity", "gibbs_compactness", "elongation_index", "ellipticity", "solidity", "dcm", "exchange_index", "bci", "cross_moment_mu11", "variance_spreading",
)
_HULL = ("longest_chord", "lco", "sbro", "bisector_orientation", "gibbs_compactness", "elongation_index", "ellipticity", "solidity", "dcm", "exchange_index")


def feature_names(has_height: bool = False) -> list[str]:
    return [*FEATURES[:5], *(["height"] if has_height else []), *FEATURES[5:]]


def measured(df: DataFrame, parts: str = "parts") -> DataFrame:
    """df with area, perimeter, cx, cy and shell (the largest part's): what most metrics start from."""
    return df.select("*", g.measure(F.col(parts)).alias("_m"), g.largest_shell(F.col(parts)).alias("shell")).select("*", "_m.*").drop("_m")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out before costly work where its files are few: a table of more files than there are cores, or a plan that reads none, is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if 0 < len(df.inputFiles()) < cores else df


def _hull_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list[float]] = {n: [] for n in _HULL}
        footprints = [[[np.array([[p["x"], p["y"]] for p in r]).reshape(-1, 2) for r in part] for part in parts] for parts in batch.column(keys).to_pylist()]
        for rings, area in zip(footprints, batch.column(keys + 1).to_pylist(), strict=True):
            best = rings[0] if len(rings) == 1 else max(rings, key=lambda r: abs(k.polygon_area(r[0])))
            for n, v in k.hull_metrics(best[0], area).items():
                out[n].append(v)
        out["exchange_index"] = k.exchange_indices(footprints)
        yield pa.RecordBatch.from_arrays([*batch.columns[:keys], *(pa.array(out[n], pa.float64()) for n in _HULL)], names=[*batch.schema.names[:keys], *_HULL])


def hull_features(df: DataFrame, keys: list[str], parts: str = "parts") -> DataFrame:
    """keys and the metrics that need hull, rectangle, circle or clipping, one Arrow batch at a time."""
    narrow = spread(df.select(*keys, F.col(parts), g.area(F.col(parts)).alias("area")), *keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + "".join(f", {n} double" for n in _HULL)
    n = len(keys)
    return narrow.mapInArrow(lambda it: _hull_rows(it, n), kinds)


def simple_features(df: DataFrame, parts: str = "parts") -> DataFrame:
    """df with the metrics that column expressions give; all 0 for a shell of fewer than 3 points."""
    a, p, r, d, cx, cy = (F.col(c) for c in ("area", "perimeter", "shell", "_d", "cx", "cy"))
    m = measured(df, parts).select("*", g.radii(r, cx, cy).alias("_d"))
    made = {"complexity_index": g.complexity_index(a, p), "ipq": g.isoperimetric_quotient(a, p), "fractality": g.fractality(a, p), "weighted_orientation": g.weighted_orientation(r)} | g.vertex_metrics(r, d, a, cx, cy)
    return m.withColumns({n: F.when(F.size(r) >= 3, c).otherwise(0.0) for n, c in made.items()}).drop("_d")


_SIMPLE = tuple(n for n in FEATURES if n not in _HULL and n != "covered_area_ratio")


def building_features(df: DataFrame, keys: list[str], cover: DataFrame | None = None, parts: str = "parts") -> DataFrame:
    """keys and all features of FEATURES (covered_area_ratio from cover(keys, cell_area); 1 without). Expressions first, then the kernels on the same rows: only the cover is joined."""
    simple = simple_features(spread(df, *keys), parts)
    both = hull_features(simple.withColumnRenamed("area", "_area"), [*keys, "_area", *(n for n in _SIMPLE if n != "area")], parts).withColumnRenamed("_area", "area")
    if cover is None:
        return both.withColumn("covered_area_ratio", F.lit(1.0)).select(*keys, *FEATURES)
    ratio = F.when(F.col("cell_area") > 0, F.least(F.try_divide("area", "cell_area"), F.lit(1.0))).otherwise(1.0)
    return both.join(cover, keys, "left").withColumn("covered_area_ratio", ratio).select(*keys, *FEATURES)


def valid(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Footprints with at least one ring of three points; rings lose repeated neighbours and rings of fewer points go."""
    tidy = lambda r: F.filter(r, lambda p, i: (i == 0) | ~(p.eqNullSafe(r[i - 1])))
    opened = lambda r: F.when((F.size(r) > 1) & r[0].eqNullSafe(F.element_at(r, -1)), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r)
    rings = F.transform(F.filter(parts, lambda x: x.isNotNull() & (F.size(x) > 0)), lambda x: F.filter(F.transform(x, lambda r: opened(tidy(r))), lambda r: F.size(r) >= 3))
    return df.where(F.col(parts).isNotNull()).withColumn(parts, F.filter(rings, lambda x: F.size(x) > 0)).where(F.size(parts) > 0)


def kept_shapes(area: Column, elongation: Column, min_area: float = 30.0, max_elongation: float = 15.0, area_limit: float = 500.0) -> Column:
    """Big enough, and not both line-like and small (both strict)."""
    return (area >= min_area) & ~((elongation > max_elongation) & (area < area_limit))
