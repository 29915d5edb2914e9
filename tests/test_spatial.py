"""Spatial joins, cuts and unions against brute force on made shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formwright.functions import geometry as g
from formwright.functions import kernels as k
from formwright.operators import cleaning, graphs, spatial

PARTS = "array<array<array<struct<x: double, y: double>>>>"


def box(x, y, w, h):
    return np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], dtype=float)


def as_parts(parts):
    return [[[(float(x), float(y)) for x, y in r] for r in rings] for rings in parts]


def shapes(spark, rows):
    return spark.createDataFrame([(i, as_parts(p)) for i, p in rows], f"k long, parts {PARTS}")


def segment_gap(a, b, c, d):
    def point(p, s, e):
        v = e - s
        t = np.clip((p - s) @ v / max(v @ v, 1e-300), 0, 1)
        return np.hypot(*(s + t * v - p))

    turn = lambda o, u, v: (u - o)[0] * (v - o)[1] - (u - o)[1] * (v - o)[0]
    if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
        return 0.0
    return min(point(a, c, d), point(b, c, d), point(c, a, b), point(d, a, b))


def gap(p, q):
    """Distance of two footprints, 0 where one holds a point of the other."""
    if any(k._inside_any(r[0][:1], q)[0] for r in p) or any(k._inside_any(r[0][:1], p)[0] for r in q):
        return 0.0
    sides = lambda parts: [(r[i], r[(i + 1) % len(r)]) for rings in parts for r in rings for i in range(len(r))]
    return min(segment_gap(*s, *t) for s in sides(p) for t in sides(q))


def test_pairs_at_cell_borders(spark):
    """Two squares 5 apart, the right one at many places: a pair at every distance over 5, whatever the cells."""
    at = [205, 410, 420, 820, 1000.1, 99.99]
    rows = [(2 * i + n, [[box(x + 10_000 * i - (0 if n else 15), 0, 10, 10)]]) for i, x in enumerate(at) for n in (0, 1)]
    for distance, cell, some in ((5.0, 100.0, True), (10, 100, True), (20.0, 37.5, True), (4.9, 100.0, False)):
        got = {(r.a, r.b) for r in spatial.touching_pairs(shapes(spark, rows), "k", distance, cell).collect()}
        assert got == ({(2 * i, 2 * i + 1) for i in range(len(at))} if some else set())


@pytest.mark.parametrize(("distance", "cell"), [(0, 100), (3, 7.3), (12.5, 50)])
def test_pairs_against_brute_force(spark, distance, cell):
    rng = np.random.default_rng(int(distance * 10 + cell))
    made = []
    for i in range(60):
        x, y, w, h = *rng.uniform(-150, 150, 2), *rng.uniform(2, 45, 2)
        c, s = np.cos(t := rng.uniform(0, 6)), np.sin(t)
        turn = lambda r: (r - [x, y]) @ np.array([[c, s], [-s, c]]) + [x, y]  # noqa: B023, E731
        parts = [[turn(box(x, y, w, h)), *([turn(box(x + w / 4, y + h / 4, w / 2, h / 2))] if i % 3 == 0 else [])]]
        made.append((i, parts + ([[turn(box(x + w + 2, y, 3, 3))]] if i % 7 == 0 else [])))
    want = {(i, j) for i, p in made for j, q in made if i < j and gap(p, q) <= distance}
    assert want == {(r.a, r.b) for r in spatial.touching_pairs(shapes(spark, made), "k", distance, cell).collect()}
    assert len(want) > 20


def test_cells_in_holes_and_parts(spark):
    points = [(1, n, float(x), float(y)) for n, (x, y) in enumerate([(1, 1), (9, 1), (9, 9), (1, 9), (5, 2)])]
    df = spark.createDataFrame([*points, *((2, n, x, y) for _, n, x, y in points), (3, 0, 1.0, 1.0)], "block_id long, node long, x double, y double")
    square, far = [box(0, 0, 10, 10)], [box(20, 0, 10, 10)]
    parcels = shapes(spark, [(1, [[*square, box(4, 4, 2, 2)]]), (2, [square, far]), (9, [square])]).withColumnRenamed("k", "block_id")
    got = {r.block_id: r.a for r in graphs.voronoi_cells(df, parcels).groupBy("block_id").agg(F.sum("cell_area").alias("a")).collect()}
    assert got == {1: pytest.approx(96), 2: pytest.approx(200), 3: 1.0}


def test_single_cells_against_a_raster():
    """Cells by counting raster points nearest to each site within a parcel with a hole and a second part."""
    rng = np.random.default_rng(2)
    parts = [[box(0, 0, 40, 40), box(10, 12, 9, 9)], [box(50, 5, 20, 20)]]
    sites = rng.uniform(0, 60, (12, 2))
    step = 0.1
    raster = np.stack(np.meshgrid(np.arange(step / 2, 70, step), np.arange(step / 2, 40, step)), axis=-1).reshape(-1, 2)
    raster = raster[k._inside_any(raster, parts)]
    owner = ((raster[:, None] - sites[None]) ** 2).sum(axis=2).argmin(axis=1)
    want = np.bincount(owner, minlength=12) * step * step
    got = k.voronoi_shares(sites, parts)
    assert np.abs(got - want)[want > 0].max() < 3 and got[want > 0].sum() == pytest.approx(1600 - 81 + 400, abs=1)


def star(n, size, waves=40):
    t = 2 * np.pi * np.arange(n) / n
    return np.stack([size * np.cos(t), size * np.sin(t)], axis=1) * (1 + 0.05 * np.sin(waves * t))[:, None]


def test_long_outlines(spark):
    """An outline of 100,000 points: points and footprints meet its tiles, not the outline."""
    outline, hole = star(100_000, 3_000), box(-500, -500, 700, 700)
    areas = shapes(spark, [(7, [[outline, hole]])])
    rng = np.random.default_rng(1)
    at = rng.uniform(-3_300, 3_300, (400, 2))
    inside = k._inside_any(at, [[outline, hole]])
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "p long, x double, y double")
    assert {r.p for r in spatial.points_within(points, areas, "p", "k", 100.0).collect()} == set(np.flatnonzero(inside).tolist())
    squares = shapes(spark, [(i, [[box(x, y, 20, 20)]]) for i, (x, y) in enumerate(at)])
    got = {r.k: r.a for r in cleaning.clip_to_areas(squares, "k", areas, 100.0).select("k", g.area(F.col("parts")).alias("a")).collect()}
    for i, (x, y) in enumerate(at):
        want = sum(k.polygon_area(k.clip_convex(r, box(x, y, 20, 20))) for r in k.turned_rings([[outline, hole]]))
        assert got.get(i, 0.0) == pytest.approx(want, abs=1e-2)


def test_union_of_a_long_chain(spark):
    """A chain of 10,000 footprints over 60 km is one polygon with its true area and corners; holes and slanted sides too."""
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("grp"), (F.col("id") * 6.0).alias("x"), (F.col("id") % 2 * 4.0).alias("y"))
    x, y = F.col("x"), F.col("y")
    chain = chain.select("grp", F.array(F.array(g.ring((x, y), (x + 8, y), (x + 8, y + 6), (x, y + 6)))).alias("parts"))
    frame = shapes(spark, [(2, [[box(0, 0, 400, 20)]]), (2, [[box(0, 0, 20, 400)]]), (2, [[box(380, 0, 20, 400)]]), (2, [[box(0, 380, 400, 20)]]), (2, [[box(190, 190, 30, 30)]]), (3, [[star(50, 130, 5)]])])
    turned = star(60, 150, 7)
    pair = shapes(spark, [(4, [[turned]]), (4, [[turned + [90, 40]]])])
    rows = chain.unionByName(frame.unionByName(pair).withColumnRenamed("k", "grp"))
    out = {r.grp: r for r in cleaning.dissolve(rows, "grp", cell=50.0).select("grp", "parts", g.area(F.col("parts")).alias("a")).collect()}
    assert out[1].a == pytest.approx(n * 48 - (n - 1) * 2 * 2) and len(out[1].parts) == 1 and len(out[1].parts[0][0]) == 8 * (n - 1) + 4 - 4 * (n - 1)
    assert out[2].a == pytest.approx(400 * 400 - 360 * 360 + 900) and sorted(len(p) for p in out[2].parts) == [1, 2]
    assert len(out[3].parts[0][0]) == 50
    whole = k.overlay([[turned], [turned + [90, 40]]])
    assert out[4].a == pytest.approx(sum(map(k.polygon_area, k.turned_rings(whole))), abs=1e-3) and len(out[4].parts[0][0]) == len(whole[0][0])


def test_triangulation_by_walking():
    rng = np.random.default_rng(8)
    for p in (rng.random((3_000, 2)) * 1e4, np.unique(rng.integers(0, 25, (600, 2)), axis=0).astype(float), np.repeat(np.arange(40.0), 2).reshape(40, 2) * [1, 0] + [[0, i % 2 * 1e-3] for i in range(40)]):
        t = k.delaunay(p)
        assert sum(abs(k.polygon_area(p[list(x)])) for x in t) == pytest.approx(abs(k.polygon_area(k.convex_hull(p))))
        assert len(t) <= 2 * len(p) - 5


@pytest.mark.parametrize("cell", [10.0, 4.0, 7.3])
def test_points_on_an_outline_are_not_within(spark, cell):
    """Whatever the tiles: on sides, corners and the rim of a hole; inner tile borders and points next to a side count."""
    areas = shapes(spark, [(1, [[box(0, 0, 10, 10), box(4, 4, 2, 2)]]), (2, [[box(10, 0, 10, 10)]]), (3, [[np.array([[0, 20], [20, 20], [20, 40]], dtype=float)]])])
    on = [(0, 5), (5, 0), (10, 5), (5, 10), (0, 0), (10, 0), (4, 5), (5, 4), (6, 5), (5, 6), (4, 4), (10, 30), (0, 20), (20, 30)]
    within = {(5, 2): 1, (4, 3): 1, (8, 8): 1, (1e-9, 5): 1, (10 + 1e-9, 5): 2, (11, 30 + 0.5): 3, (12, 28): 3}
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate([*on, *within])], "p long, x double, y double")
    got = {r.p: r.k for r in spatial.points_within(points, areas, "p", "k", cell).collect()}
    assert got == {len(on) + i: a for i, a in enumerate(within.values())}


@pytest.mark.parametrize("distance", [0.0, 4.0])
def test_large_and_odd_footprints_touch_too(spark, distance):
    """Small footprints meet in tiles, a long outline and a wide one by their sides; null and empty shapes meet nothing. Links lead to the components of the pairs."""
    from formwright.operators import components

    rng = np.random.default_rng(6)
    made = [(i, [[box(*rng.uniform(-90, 90, 2), *rng.uniform(2, 12, 2))]]) for i in range(120)] + [(200, [[star(90, 12, 5) + [60, 60]]]), (201, [[box(-80, -2, 130, 3)]]), (202, [[star(80, 9, 4)]])]
    want = {(i, j) for i, p in made for j, q in made if i < j and gap(p, q) <= distance}
    odd = [(300, None), (301, []), (302, [[[]]]), (303, [[[(1.0, 1.0), (None, 2.0), (3.0, 1.0)]]])]
    df = spark.createDataFrame([*((i, as_parts(p)) for i, p in made), *odd[:2]], f"k long, parts {PARTS}")
    assert want == {(r.a, r.b) for r in spatial.touching_pairs(df, "k", distance, 40.0).collect()} and len(want) > 30
    pairs = spark.createDataFrame(sorted(want), "a long, b long")
    groups = lambda p: sorted(components.connected(p, df, "k").collect())
    assert groups(spatial.touching_links(df, "k", distance, 40.0)) == groups(pairs)
    from formwright.operators import touching
    import pyarrow as pa

    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    rows, boxes = touching.small_ones(pa.array([None if p is None else [[[None if v is None else {"x": v[0], "y": v[1]} for v in r] for r in part] for part in p] for _, p in [*odd, (1, [[[(1.0, 2.0), (3.0, 5.0)]]])]], kind), 40.0)
    assert rows.tolist() == [4] and boxes.tolist() == [[1.0, 2.0, 3.0, 5.0]]


def test_links_are_few(spark):
    """Of 400 footprints on one heap there are 79,800 pairs, and links no more than footprints in each tile; the same for points."""
    from formwright.operators import components, neighbours

    heap = shapes(spark, [(i, [[box(i % 20 / 10, i // 20 / 10, 9, 9)]]) for i in range(400)])
    links = spatial.touching_links(heap, "k")
    assert 0 < links.count() < 400 * 4 and {r.group_id for r in components.connected(links, heap, "k").collect()} == {0}
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(i, i % 2, float(x), float(y)) for i, (x, y) in enumerate(rng.random((600, 2)) * 300)], "id long, g int, x double, y double")
    groups = lambda p: sorted(components.connected(p, points, "id").collect())
    links, pairs = neighbours.links(points, "id", 17.0, ["g"]), neighbours.pairs(points, "id", 17.0, ["g"])
    assert groups(links) == groups(pairs) and links.count() < pairs.count()


def test_union_of_a_heap_goes_a_few_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    made = [[box(*np.floor(rng.random(2) * 60), 6 + rng.integers(9), 5 + rng.integers(9))] for _ in range(150)]
    area = lambda whole: sum(map(k.polygon_area, k.turned_rings(whole)))
    want, sizes, overlay = area(k.overlay(made)), [], k.overlay
    monkeypatch.setattr(k, "overlay", lambda left, *a: sizes.append(sum(map(len, (r for rings in left for r in rings)))) or overlay(left, *a))
    assert area(k.heap_union(made)) == pytest.approx(want) and max(sizes) < 300
    assert k.cell_border([[m] for m in made], 0, 0, 100.0).shape[1] == 4 and max(sizes) < 300
