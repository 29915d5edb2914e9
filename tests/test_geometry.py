"""Shapes with known answers, and laws of metrics under motion and scale."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formwright.functions import geometry as g
from formwright.functions import kernels as k

SQUARE = np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]])
T = 2 * math.pi * np.arange(64) / 64
ROUND = np.stack([np.cos(T), np.sin(T)], axis=1)


def test_square():
    m = k.hull_metrics(SQUARE, 1.0)
    assert m["longest_chord"] == pytest.approx(math.sqrt(2))
    assert m["elongation_index"] == pytest.approx(1) and m["solidity"] == pytest.approx(1)
    assert m["dcm"] == pytest.approx(2 / math.pi)


def test_circle_limits():
    a = abs(k.polygon_area(ROUND))
    m = k.hull_metrics(ROUND, a)
    assert m["dcm"] == pytest.approx(1, abs=2e-3)
    assert k.exchange_indices([[[ROUND]]])[0] == pytest.approx(0, abs=5e-3)


def test_turned_rectangle():
    c, s = math.cos(math.pi / 6), math.sin(math.pi / 6)
    r = np.array([[0, 0], [2, 0], [2, 1], [0, 1.0]]) @ np.array([[c, s], [-s, c]])
    long_, short, angle = k.smallest_rectangle(k.convex_hull(r))
    assert (long_, short) == pytest.approx((2, 1)) and angle == pytest.approx(math.pi / 6)


def test_degenerate_rings():
    assert set(k.hull_metrics(np.array([[0, 0], [1, 1.0]]), 0.0).values()) == {0.0}
    line = np.array([[0, 0], [1, 0], [2, 0.0]])
    assert k.hull_metrics(line, 0.0)["longest_chord"] == 2
    assert k.exchange_indices([[[line]], []]).tolist() == [0.0, 0.0]


def test_hole_and_two_parts(spark):
    rows = [(1, [[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]]]), (2, [[[(0, 0), (1, 0), (1, 1), (0, 1)]], [[(5, 5), (7, 5), (7, 7), (5, 7)]]])]
    df = spark.createDataFrame([(i, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in part] for part in parts]) for i, parts in rows], "id int, parts array<array<array<struct<x: double, y: double>>>>")
    from pyspark.sql import functions as F

    p = F.col("parts")
    got = {r.id: r for r in df.select("id", g.area(p).alias("a"), g.perimeter(p).alias("p"), g.centroid(p).alias("c"), F.size(g.largest_shell(p)).alias("n"), g.largest_shell(p)[0].x.alias("x")).collect()}
    assert (got[1].a, got[1].p) == (15, 20) and got[1].c.x == pytest.approx((16 * 2 - 1.5) / 15)
    assert (got[2].a, got[2].p, got[2].x) == (5, 12, 5)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 200)), min_size=4, max_size=40, unique=True))
def test_triangulation_has_empty_circles(points):
    p = np.array(points, dtype=float)
    tri = k.delaunay(p)
    for a, b, c in tri:
        q = p[[a, b, c]]
        turn = np.sign((q[1] - q[0])[0] * (q[2] - q[0])[1] - (q[1] - q[0])[1] * (q[2] - q[0])[0])
        d = q[:, None] - p[None]
        s = (d**2).sum(axis=2)
        inside = s[0] * (d[1, :, 0] * d[2, :, 1] - d[2, :, 0] * d[1, :, 1]) - s[1] * (d[0, :, 0] * d[2, :, 1] - d[2, :, 0] * d[0, :, 1]) + s[2] * (d[0, :, 0] * d[1, :, 1] - d[1, :, 0] * d[0, :, 1])
        assert (turn * inside <= 0).all()
    if len(tri):
        area = sum(abs(k.polygon_area(p[list(t)])) for t in tri)
        assert area == pytest.approx(abs(k.polygon_area(k.convex_hull(p))))


@settings(max_examples=30, deadline=None)
@given(st.floats(0, 6.28), st.floats(0.5, 20), st.floats(-500, 500), st.floats(-500, 500))
def test_metrics_under_motion_and_scale(turn, size, dx, dy):
    shape = np.array([[0, 0], [9, 0], [9, 4], [5, 4], [5, 7], [0, 7.0]])
    r = np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]])
    moved = size * shape @ r + [dx, dy]
    a, b = k.hull_metrics(shape, 48.0), k.hull_metrics(moved, 48.0 * size**2)
    for name in ("solidity", "dcm", "gibbs_compactness", "ellipticity", "elongation_index"):
        assert b[name] == pytest.approx(a[name], rel=1e-6)
    assert b["longest_chord"] == pytest.approx(size * a["longest_chord"], rel=1e-9)
    e = k.exchange_indices([[[shape]], [[moved]]])
    assert e[0] == pytest.approx(e[1], abs=2e-3)


def test_circle_cover_agrees_with_clipping():
    rng = np.random.default_rng(3)
    t = 2 * math.pi * np.arange(k.CIRCLE_SIDES) / k.CIRCLE_SIDES
    for _ in range(20):
        w, h = rng.uniform(3, 30, 2)
        shape = np.array([[0, 0], [w, 0], [w, h / 2], [w / 2, h / 2], [w / 2, h], [0, h]]) + rng.uniform(0, 100, 2)
        circle = k.polygon_centroid(shape) + math.sqrt(0.75 * w * h / math.pi) * np.stack([np.cos(t), np.sin(t)], axis=1)
        want = 1 - abs(k.polygon_area(k.clip_convex(shape, circle))) / abs(k.polygon_area(circle))
        assert k.exchange_indices([[[shape]]])[0] == pytest.approx(want, abs=1e-9)


def test_cells_fill_the_parcel():
    p = np.random.default_rng(5).integers(0, 100, (30, 2)).astype(float)
    p = np.unique(p, axis=0)
    shares = k.voronoi_shares(p, np.array([[0, 0], [100, 0], [100, 100], [0, 100.0]]))
    assert shares.sum() == pytest.approx(10_000) and (shares > 0).all()
    assert k.voronoi_shares(p[:3], SQUARE).tolist() == [1 / 3] * 3 and len(k.voronoi_shares(p[:0], SQUARE)) == 0
