"""Preparation of layers: class recoding, name matching, and the attributes of merged buildings."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formwright.functions import kernels as k

from . import components

#: Land-use classes of the source map and the five that they become.
CLASS_RECODE = {0: 1, 1: 2, 2: 2, 3: 3, 4: 4, 5: 4, 6: 5, 7: 5, 8: 5, 9: 5, 10: 5}


def mapped(value: Column, table: dict) -> Column:
    return F.create_map(*map(F.lit, chain(*table.items())))[value]


def named(value: Column, table: dict) -> Column:
    """The text that table has for a value, else the value itself as text; null stays null."""
    return F.coalesce(mapped(value, table), value.cast("string"))


def unmapped(df: DataFrame, column: str, table: dict) -> DataFrame:
    """Distinct values of the column that the table lacks."""
    return df.where(~F.col(column).isin(*table)).select(column).distinct()


def recode(df: DataFrame, column: str, table: dict, to: str) -> DataFrame:
    """df with `to`; a value outside the table stops the job with its name."""
    value = mapped(F.col(column), table)
    return df.withColumn(to, F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"no class for {column} "), F.col(column).cast("string"))).cast("int")))


def match_names(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """wanted, name, kind (exact, part or missing). Both are short lists of names; only names without an exact match are searched for by part."""
    n = names.select(F.trim("name").alias("name")).distinct()
    exact = wanted.join(n, F.trim("wanted") == F.col("name")).select("wanted", "name", F.lit("exact").alias("kind"))
    rest = wanted.join(exact.select("wanted"), "wanted", "left_anti")
    key = F.trim("wanted")
    part = rest.join(F.broadcast(n), F.col("name").contains(key) | key.contains(F.col("name"))).select("wanted", "name", F.lit("part").alias("kind"))
    return wanted.join(exact.unionByName(part), "wanted", "left").select("wanted", "name", F.coalesce("kind", F.lit("missing")).alias("kind"))


def merge_attributes(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """One row per group: greatest height (0 without any), other columns of the first row by row_pos, ids joined in that order."""
    joined = df.join(groups, key)
    others = [c for c in df.columns if c not in (key, "height", "row_pos")]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_pos", F.col(key).cast("string").alias("id")))), lambda s: s.id), "|")
    return joined.groupBy("group_id").agg(
        F.coalesce(F.max("height"), F.lit(0.0)).alias("height"), *[F.min_by(c, "row_pos").alias(c) for c in others], ids.alias("building_ids"), F.count("*").alias("n_buildings"), F.min_by(key, "row_pos").alias("first_id")
    )


def big_enough(df: DataFrame, group: str, least: int = 4) -> DataFrame:
    """Rows of the groups that have at least `least` rows."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(group))).where(F.col("_n") >= least).drop("_n")


def _rings(parts: list) -> list[list[np.ndarray]]:
    return [[np.array([[p["x"], p["y"]] for p in r], dtype=float).reshape(-1, 2) for r in part] for part in ([] if parts is None else parts)]


def _points(parts: list[list[np.ndarray]]) -> list:
    return [[[{"x": float(x), "y": float(y)} for x, y in r] for r in part] for part in parts]


_ARROW_PARTS = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
_PARTS = "array<array<array<struct<x: double, y: double>>>>"


_SIDES = pa.list_(pa.float64())


def dissolve(df: DataFrame, group: str, parts: str = "parts", cell: float = 100.0) -> DataFrame:
    """group, parts: the union of each group's footprints. A footprint alone in its group never moves.

    A group is cut by a grid: a task unites what one cell has of it, however many cells the group spans. Unions of neighbouring cells differ from the whole only by the sides
    on the line between them, and those are opposite: a grouping by line and cell leaves what does not cancel. The sides that are left, the outline itself, are linked to rings.
    """
    from . import spatial

    kind = df.schema[group].dataType.simpleString()
    several = df.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1").select(group)
    single = df.join(several, group, "left_anti").select(group, parts)
    shapes = spatial.with_bounds(df.join(several, group, "left_semi").select(F.col(group).alias("grp"), F.col(parts).alias("shape")), "shape")
    cut = shapes.select("grp", "shape", F.inline(spatial.cells(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), cell)))

    def unite(rows: pa.Table) -> pa.Table:
        gx, gy = (rows.column(c)[0].as_py() for c in ("gx", "gy"))
        border = k.cell_border([spatial.as_rings(p) for p in rows.column("shape").to_pylist()], gx, gy, cell)
        # Sides on the cell's border carry their line's place: axis they run along, line, cell along it.
        made = [(None, None, None, border)]
        for axis, (at, along) in enumerate(((gy, gx), (gx, gy))):
            for line in (at, at + 1):
                on = (border[:, 1 - axis] == line * cell) & (border[:, 3 - axis] == line * cell)
                made.append((axis, line, along, border[on]))
                border = border[~on]
        made[0] = (None, None, None, border)
        made = [m for m in made if len(m[3])]
        return pa.table({"grp": pa.array([rows.column("grp")[0].as_py()] * len(made), rows.schema.field("grp").type), **{n: pa.array([m[i] for m in made], pa.int64()) for i, n in enumerate(("axis", "line", "along"))}, "sides": pa.array([m[3].ravel().tolist() for m in made], _SIDES)})

    def cancel(rows: pa.Table) -> pa.Table:
        axis = rows.column("axis")[0].as_py()
        left = k.cancelled(np.concatenate([np.array(v).reshape(-1, 4) for v in rows.column("sides").to_pylist()]), axis)
        return rows.slice(0, 1).select(["grp"]).append_column("sides", pa.array([left.ravel().tolist()], _SIDES))

    def link(rows: pa.Table) -> pa.Table:
        every = np.concatenate([np.array(v, dtype=float).reshape(-1, 4) for v in rows.column("sides").to_pylist()])
        whole = k.assemble([((a, b), (c, d)) for a, b, c, d in every.tolist()], cell)
        return pa.table({group: rows.slice(0, 1).column("grp"), parts: pa.array([_points(whole)], _ARROW_PARTS)})

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = lambda d, *keys: d.repartition(n, *keys).groupBy(*keys)
    united = components.stored(by(cut, "grp", "gx", "gy").applyInArrow(unite, f"grp {kind}, axis long, line long, along long, sides array<double>"), "united")
    seams = by(united.where("axis IS NOT NULL"), "grp", "axis", "line", "along").applyInArrow(cancel, f"grp {kind}, sides array<double>")
    outlines = united.where("axis IS NULL").select("grp", "sides").unionByName(seams)
    return single.unionByName(by(outlines, "grp").applyInArrow(link, f"`{group}` {kind}, `{parts}` {_PARTS}"))


def clip_to_areas(df: DataFrame, key: str, areas: DataFrame, cell: float, parts: str = "parts") -> DataFrame:
    """key, parts: the footprints cut to the union of the areas (parts); those outside go.

    Areas are covered by grid tiles. A footprint whose tiles are all inside passes untouched; one that also has border tiles gets those tiles' pieces of outlines, and is cut only if one of their sides comes near it.
    """
    from . import spatial

    tiles = spatial.area_tiles(areas.select("parts").withColumn("area_id", F.monotonically_increasing_id()), "area_id", cell)
    inner = F.bool_or(F.col("rings").isNull())
    tiles = tiles.groupBy("gx", "gy").agg(inner.alias("inner"), F.collect_list("rings").alias("pieces"))  # areas that meet in a tile
    tiles = tiles.select("gx", "gy", "inner", F.when(F.col("inner"), F.array().cast("array<array<array<struct<x: double, y: double>>>>")).otherwise(F.col("pieces")).alias("pieces"))
    b = spatial.with_bounds(df.select(key, F.col(parts).alias("parts")))
    on = b.select(key, F.size(grid := spatial.cells(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), cell)).alias("n"), F.inline(grid))
    met = on.join(tiles, ["gx", "gy"]).groupBy(key, "n").agg(F.count_if("inner").alias("inside"), F.collect_list(F.struct("gx", "gy", "inner", "pieces")).alias("tiles"))
    met = met.select(key, F.when(F.col("inside") < F.col("n"), F.col("tiles")).alias("tiles"))
    both = b.select(key, "parts").join(met, key)
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def cut(shape: list, around: list) -> list:
        mine = spatial.as_rings(shape)
        areas = [[np.array([[t["gx"], t["gy"]], [t["gx"] + 1, t["gy"]], [t["gx"] + 1, t["gy"] + 1], [t["gx"], t["gy"] + 1]]) * cell] for t in around if t["inner"]]
        areas += [rings for t in around for rings in spatial.as_rings(t["pieces"])]
        every = np.concatenate([r for rings in mine for r in rings])
        low, high = every.min(axis=0), every.max(axis=0)
        ends = np.concatenate([np.stack([r, np.roll(r, -1, axis=0)], axis=1) for rings in areas for r in rings])
        if not ((ends.max(axis=1) >= low) & (ends.min(axis=1) <= high)).all(axis=1).any():  # no outline near it: all in or all out
            return shape if k._inside_any(every[:1], areas)[0] else []
        return _points(k.overlay(mine, areas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [cut(p, t) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.list_(pa.list_(point))))], names=[key, parts])

    kind = df.schema[key].dataType.simpleString()
    clipped = both.where("tiles IS NOT NULL").mapInArrow(run, f"`{key}` {kind}, `{parts}` {_PARTS}").where(F.size(parts) > 0)
    return both.where("tiles IS NULL").select(key, F.col("parts").alias(parts)).unionByName(clipped)


def repair(df: DataFrame, keys: list[str], parts: str = "parts") -> DataFrame:
    """keys and parts: footprints whose sides cross become what lies inside them (even-odd); sound ones pass as they are, and what is left without area goes."""

    def crossed(rings: list[np.ndarray]) -> bool:
        a = np.concatenate([r for r in rings if len(r)]) if rings else np.zeros((0, 2))
        b = np.concatenate([np.roll(r, -1, axis=0) for r in rings if len(r)]) if rings else a
        side = lambda o, u, v: (u[..., 0] - o[..., 0]) * (v[..., 1] - o[..., 1]) - (u[..., 1] - o[..., 1]) * (v[..., 0] - o[..., 0])
        p, q, r, s = a[:, None], b[:, None], a[None], b[None]
        return bool(((side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)).any())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        n = len(keys)
        for batch in batches:
            fixed = [_points([q for rings in _rings(p) for q in (k.overlay([rings]) if crossed(rings) else [rings])]) for p in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(fixed, pa.list_(pa.list_(pa.list_(point))))], names=[*keys, parts])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, parts).mapInArrow(run, f"{kinds}, {parts} {_PARTS}").where(F.size(parts) > 0)
