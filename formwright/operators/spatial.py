"""Spatial joins as equi-joins on grid cells followed by an exact test; no plan compares all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formwright.functions import geometry as g
from formwright.functions import kernels as k

_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def cells(low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float) -> Column:
    """ARRAY<STRUCT<gx, gy>> of all grid cells that a box touches."""
    at = lambda v: F.floor(v / size).cast("long")
    xs, ys = F.sequence(at(low_x), at(high_x)), F.sequence(at(low_y), at(high_y))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("gx"), y.alias("gy")))))


def with_bounds(df: DataFrame, parts: str = "parts") -> DataFrame:
    """df with minx, miny, maxx, maxy columns: stored with a table, they let a box filter skip row groups."""
    b = g.bounds(F.col(parts))
    return df.withColumns({c: b[c] for c in ("minx", "miny", "maxx", "maxy")})


def in_box(low_x: float, low_y: float, high_x: float, high_y: float) -> Column:
    """Boxes that meet the given one: plain comparisons on the stored bounds, which reach the scan."""
    return (F.col("minx") <= high_x) & (F.col("maxx") >= low_x) & (F.col("miny") <= high_y) & (F.col("maxy") >= low_y)


def total_bounds(df: DataFrame, pad: float = 0.0, parts: str = "parts") -> DataFrame:
    """One row: the box of all footprints, padded."""
    b = with_bounds(df, parts)
    return b.agg((F.min("minx") - pad).alias("minx"), (F.min("miny") - pad).alias("miny"), (F.max("maxx") + pad).alias("maxx"), (F.max("maxy") + pad).alias("maxy"))


def as_rings(parts: list | None) -> list[list[np.ndarray]]:
    """A footprint's parts, as Arrow gives them, as arrays of points."""
    return [[np.array([[p["x"], p["y"]] for p in r], dtype=float).reshape(-1, 2) for r in part] for part in parts or []]


def area_tiles(areas: DataFrame, key: str, cell: float, parts: str = "parts") -> DataFrame:
    """key, gx, gy, rings: the grid tiles that each area covers. rings is null for a tile wholly inside, else the piece of the outline within the tile (even-odd).

    So no outline is copied to what it is compared with: what lies in an inner tile needs no test, and a border tile's piece is as long as the outline is there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, area in zip(batch.column(0), batch.column(1), strict=True):
                rows = [(*t[:4], None if t[4] is None else [[{"x": x, "y": y} for x, y in r.tolist()] for r in t[4]]) for t in k.area_tiles(as_rings(area.as_py()), cell)]
                for at in range(0, len(rows), 1_000):
                    columns = list(zip(*rows[at : at + 1_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([one.as_py()] * len(columns[0]), batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], _RINGS)], names=[key, "gx0", "gx1", "gy0", "gy1", "rings"])

    kind = areas.schema[key].dataType.simpleString()
    blocks = areas.select(key, parts).mapInArrow(run, f"`{key}` {kind}, gx0 long, gx1 long, gy0 long, gy1 long, rings array<array<struct<x: double, y: double>>>")
    columns = blocks.select(key, F.explode(F.sequence("gx0", F.col("gx1") - 1)).alias("gx"), "gy0", "gy1", "rings")
    return columns.select(key, "gx", F.explode(F.sequence("gy0", F.col("gy1") - 1)).alias("gy"), "rings")


def points_within(points: DataFrame, areas: DataFrame, point_id: str, area_id: str, cell: float, order: str | None = None) -> DataFrame:
    """point_id, area_id: the first area (by `order`, or area_id) that each point lies within; points in none are dropped.

    points: point_id, x, y. areas: area_id, parts. An area's holes are outside it, and so is its outline: a point on a side is not within. A point meets only what areas have of its grid tile: inner tiles hold it without a test, border tiles by their piece of the outline. Points of a crowded tile spread by AQE.
    """
    tiles = area_tiles(areas, area_id, cell)
    ranked = tiles.join(areas.select(area_id, F.col(order).alias("_order")), area_id) if order else tiles.withColumn("_order", F.col(area_id))
    p = points.select(F.col(point_id), "x", "y", F.floor(F.col("x") / cell).cast("long").alias("gx"), F.floor(F.col("y") / cell).cast("long").alias("gy"))
    hits = F.aggregate("rings", F.lit(0), lambda n, r: n + F.when(g.contains(r, F.col("x"), F.col("y")), 1).otherwise(0))
    # A tile's piece of the outline is cut at the tile's border, so whether a point is on the outline is told by the sides themselves.
    outline = on_side_cells(sides(areas, area_id), 0.0, cell).groupBy(area_id, "gx", "gy").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("sides"))
    ranked = ranked.join(outline, [area_id, "gx", "gy"], "left")
    between = lambda v, a, b: v.between(F.least(a, b), F.greatest(a, b))
    on = lambda s: between(F.col("x"), s.ax, s.bx) & between(F.col("y"), s.ay, s.by) & ((s.bx - s.ax) * (F.col("y") - s.ay) == (s.by - s.ay) * (F.col("x") - s.ax))
    found = p.join(ranked, ["gx", "gy"]).where((F.col("rings").isNull() | (hits % 2 == 1)) & ~F.coalesce(F.exists("sides", on), F.lit(False)))
    return found.groupBy(point_id).agg(F.min_by(area_id, F.struct("_order", area_id)).alias(area_id))


def pairs_within(points: DataFrame, point_id: str, distance: float, group: list[str] = ()) -> DataFrame:
    """group, a, b, dist for all pairs a < b of points (of one group) no farther apart than distance.

    Pairs are found tile by tile, each from the candidates in a strip around a few points: see `neighbours`.
    """
    from .neighbours import pairs

    return pairs(points, point_id, distance, list(group))


def on_side_cells(rows: DataFrame, distance: float, size: float) -> DataFrame:
    """rows (ax, ay, bx, by) with gx and gy: a row for each grid cell that the side a to b, grown by distance, may touch: those of its box whose square lies near enough to its line."""
    grown = distance * (1 + 1e-9) + 1e-9
    at = lambda f, v, sign: F.expr(f"CAST(floor(({f}(a{v}, b{v}) {sign} {grown!r}D) / {size!r}D) AS BIGINT)")
    dealt = rows.withColumns({"_x0": at("least", "x", "-"), "_x1": at("greatest", "x", "+"), "_y0": at("least", "y", "-"), "_y1": at("greatest", "y", "+")})
    columns = dealt.select("*", F.explode(F.expr("sequence(_x0, _x1)")).alias("gx"))
    tiles = columns.select("*", F.explode(F.expr("sequence(_y0, _y1)")).alias("gy"))
    off = f"abs((bx - ax) * ((gy + 0.5D) * {size!r}D - ay) - (by - ay) * ((gx + 0.5D) * {size!r}D - ax))"
    reach = f"({size / 2!r}D * (abs(bx - ax) + abs(by - ay)) + {grown!r}D * sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))) * (1 + 1e-9D) + 1e-6D"
    return tiles.where(f"{off} <= {reach}").select(*rows.columns, "gx", "gy")


def sides(footprints: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """key, ax, ay, bx, by: a row for each side of all rings."""
    each = F.flatten(F.transform(F.flatten(F.col(parts)), g.edges))
    return footprints.select(key, F.explode(each).alias("s")).select(key, *[F.col(f"s.{e}.{v}").alias(f"{e}{v}") for e in "ab" for v in "xy"])


def _sides_meet(distance: float) -> str:
    """Whether the sides (ax, ay)-(bx, by) and (cx, cy)-(dx, dy) cross, or an end of one comes within distance of the other."""
    turn = lambda o, u, v: f"(({u}x - {o}x) * ({v}y - {o}y) - ({u}y - {o}y) * ({v}x - {o}x))"

    def near(p: str, s: str, e: str) -> str:
        dx, dy = f"({e}x - {s}x)", f"({e}y - {s}y)"
        t = f"least(greatest((({p}x - {s}x) * {dx} + ({p}y - {s}y) * {dy}) / greatest({dx} * {dx} + {dy} * {dy}, 1e-300D), 0D), 1D)"
        x, y = f"({s}x + {t} * {dx} - {p}x)", f"({s}y + {t} * {dy} - {p}y)"
        return f"sqrt({x} * {x} + {y} * {y}) <= {distance!r}D"

    cross = f"({turn('a', 'b', 'c')} * {turn('a', 'b', 'd')} < 0 AND {turn('c', 'd', 'a')} * {turn('c', 'd', 'b')} < 0)"
    return " OR ".join([cross, near("a", "c", "d"), near("b", "c", "d"), near("c", "a", "b"), near("d", "a", "b")])


def box_pairs(footprints: DataFrame, key: str, distance: float, cell: float, large: Column | None = None) -> DataFrame:
    """a < b: pairs of footprints whose boxes come within distance of each other, each once; only keys and bounds are shuffled. large: only pairs of which one has this."""
    low, high = ("minx", "miny"), ("maxx", "maxy")
    grown = distance * (1 + 1e-9) + 1e-9
    b = with_bounds(footprints).select(F.col(key).alias("k"), *low, *high, (F.lit(True) if large is None else large).alias("large"))
    # The cell of the grown corner is a column of its own: a pair counts in the greater of two such, the same integers by which it was dealt.
    b = b.select("*", *[F.floor((F.col(c) - grown) / cell).cast("long").alias(f"c{c[-1]}") for c in low])
    last = [F.floor((F.col(c) + grown) / cell).cast("long") for c in high]
    b = b.select("*", F.explode(F.sequence("cx", last[0])).alias("gx"), F.sequence("cy", last[1]).alias("ys")).select("*", F.explode("ys").alias("gy")).drop("ys")
    l, r = (b.select("gx", "gy", *[F.col(c).alias(f"{c}_{n}") for c in ("k", *low, *high, "cx", "cy", "large")]) for n in "ab")
    near = [(F.col(f"min{v}_a") - grown <= F.col(f"max{v}_b")) & (F.col(f"min{v}_b") - grown <= F.col(f"max{v}_a")) for v in "xy"]
    once = (F.col("gx") == F.greatest("cx_a", "cx_b")) & (F.col("gy") == F.greatest("cy_a", "cy_b"))
    both = l.where("large_a").join(r, ["gx", "gy"]).where("k_a < k_b OR (k_a > k_b AND NOT large_b)").where(near[0] & near[1] & once)
    return both.select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"))


def touching_pairs(footprints: DataFrame, key: str, distance: float = 0.0, cell: float = 100.0) -> DataFrame:
    """a < b: pairs of footprints that come within distance of each other (0: share a point). What stands free in a courtyard does not touch the building around it.

    Footprints of a few points within the size of a cell meet in tiles, see `touching`; pairs with a larger one are found over an index of sides, see `_with_large`.
    """
    return _touching(footprints, key, distance, cell, False)


def touching_links(footprints: DataFrame, key: str, distance: float = 0.0, cell: float = 100.0) -> DataFrame:
    """a < b: links that lead to the same components as touching_pairs; of small footprints no more than there are in each tile."""
    return _touching(footprints, key, distance, cell, True)


def _touching(footprints: DataFrame, key: str, distance: float, cell: float, linked: bool) -> DataFrame:
    from . import touching

    found = touching.by_tiles(footprints, key, float(distance), float(cell), linked)
    if not touching.any_large(footprints, float(cell)):
        return found
    return found.unionByName(_with_large(footprints, key, distance, cell, ~touching.is_small(F.col("parts"), g.bounds(F.col("parts")), float(cell))))


def _with_large(footprints: DataFrame, key: str, distance: float, cell: float, large: Column) -> DataFrame:
    """touching_pairs of which one has `large`.

    First keys and boxes alone give candidate pairs. For those there is an index over sides: each side goes to the grid cells near its line, the sides of a grown by the distance, so two sides within it
    share a cell whatever the rounding. Where no sides meet, one footprint can only hold a part of the other whole: a point of each part is tested. All are column expressions; whole shapes move only for the last test.
    """
    from .components import stored

    distance, cell = float(distance), float(cell)
    pairs = stored(box_pairs(footprints, key, distance, cell, large), "box-pairs")
    ends = ("ax", "ay", "bx", "by")

    def index(name: str, names: tuple, by: float) -> DataFrame:
        wanted = footprints.select(F.col(key).alias(name), "parts").join(pairs.select(name).distinct(), name, "left_semi")
        return on_side_cells(sides(wanted, name), by, cell).select(F.col(name), *[F.col(c).alias(n) for c, n in zip(ends, names, strict=True)], "gx", "gy")

    l, r = index("a", ends, distance), index("b", ("cx", "cy", "dx", "dy"), 0.0)
    slack = distance * (1 + 1e-9) + 1e-9
    boxes = " AND ".join(f"greatest(a{v}, b{v}) + {slack!r}D >= least(c{v}, d{v}) AND greatest(c{v}, d{v}) + {slack!r}D >= least(a{v}, b{v})" for v in "xy")
    sides_near = pairs.join(l, "a").join(r, ["b", "gx", "gy"]).where(boxes)
    meet = stored(sides_near.where(_sides_meet(distance)).select("a", "b").distinct(), "meeting")
    apart = pairs.join(meet, ["a", "b"], "left_anti")
    both = apart.select(F.col("a").alias("held"), F.col("b").alias("whole")).unionByName(apart.select(F.col("b").alias("held"), F.col("a").alias("whole")))
    corner = F.transform("parts", lambda part: part[0][0])
    points = footprints.select(F.col(key).alias("held"), F.explode(corner).alias("p")).select("held", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    box = with_bounds(footprints).select(F.col(key).alias("whole"), "minx", "miny", "maxx", "maxy")
    boxed = both.join(points, "held").join(box, "whole").where(F.col("x").between(F.col("minx"), F.col("maxx")) & F.col("y").between(F.col("miny"), F.col("maxy")))
    inside = F.exists("parts", lambda rings: F.aggregate(rings, F.lit(0), lambda n, r: n + F.when(g.contains(r, F.col("x"), F.col("y")), 1).otherwise(0)) % 2 == 1)
    held = boxed.select("held", "whole", "x", "y").join(footprints.select(F.col(key).alias("whole"), "parts"), "whole").where(inside)
    return meet.unionByName(held.select(F.least("held", "whole").alias("a"), F.greatest("held", "whole").alias("b")).distinct())


def squared_distances(values: Column, centres: list[list[float]]) -> Column:
    """The squared distance of values to each centre; centres are few and go into the plan."""
    sq = lambda c: F.aggregate(F.zip_with(values, F.array(*map(F.lit, c)), lambda v, m: (v - m) * (v - m)), F.lit(0.0), lambda s, d: s + d)
    return F.array(*[sq([float(x) for x in c]) for c in centres])


def nearest(points: DataFrame, keys: list[str], values: Column, centres: list[list[float]]) -> DataFrame:
    """keys, nearest (index of the centre at least distance, the lowest of equals), dist; centres are few and go into the plan."""
    return points.select(*keys, squared_distances(values, centres).alias("_d")).select(*keys, (F.array_position("_d", F.array_min("_d")) - 1).cast("int").alias("nearest"), F.sqrt(F.array_min("_d")).alias("dist"))


def first_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the first by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def clip_to_box(df: DataFrame, low_x: float, low_y: float, high_x: float, high_y: float, parts: str = "parts") -> DataFrame:
    """Footprints cut to a box, in column expressions: each ring is cut by the four half-planes in turn; rings left with less than three points go."""

    def half(r: Column, axis: str, limit: float, keep_low: bool) -> Column:
        other = "y" if axis == "x" else "x"
        inside = lambda p: (p[axis] <= limit) if keep_low else (p[axis] >= limit)

        def cut(e: Column) -> Column:
            t = F.try_divide(F.lit(limit) - e.a[axis], e.b[axis] - e.a[axis])
            across = F.struct(*[(F.lit(float(limit)) if c == axis else e.a[other] + t * (e.b[other] - e.a[other])).alias(c) for c in ("x", "y")])
            here = F.when(inside(e.a), F.array(e.a)).otherwise(F.array().cast("array<struct<x: double, y: double>>"))
            strict = ((e.a[axis] < limit) & (e.b[axis] > limit)) | ((e.a[axis] > limit) & (e.b[axis] < limit))
            return F.concat(here, F.when(strict, F.array(across)).otherwise(F.array().cast("array<struct<x: double, y: double>>")))

        return F.flatten(F.transform(g.edges(r), cut))

    rings = F.col(parts)
    for axis, limit, low in (("x", high_x, True), ("x", low_x, False), ("y", high_y, True), ("y", low_y, False)):
        df = df.withColumn(parts, _each_ring(rings, lambda r, axis=axis, limit=limit, low=low: half(r, axis, limit, low)))
    return df.withColumn(parts, F.filter(F.transform(parts, lambda part: F.filter(part, lambda r: F.size(r) >= 3)), lambda part: F.size(part) > 0)).where(F.size(parts) > 0)


def _each_ring(parts: Column, f) -> Column:
    return F.transform(parts, lambda part: F.transform(part, lambda r: f(r)))
