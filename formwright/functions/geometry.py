"""Planar geometry as column expressions, so that shape metrics stay inside Spark's generated code.

A ring is ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>> without the closing point. A footprint is ARRAY<ARRAY<ring>>: parts, each
with its shell first and then its holes. All angles are folded into [0, pi).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def fold(angle: Column) -> Column:
    """An undirected angle in [0, pi)."""
    turned = F.pmod(angle, F.lit(math.pi))
    return F.when(turned >= math.pi, 0.0).otherwise(turned)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def edges(r: Column) -> Column:
    """STRUCT<a, b> for each side of the ring, the last back to the first point."""
    after = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.zip_with(r, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _cross(e: Column) -> Column:
    return e.a.x * e.b.y - e.b.x * e.a.y


def side_length(e: Column) -> Column:
    return F.sqrt((e.b.x - e.a.x) * (e.b.x - e.a.x) + (e.b.y - e.a.y) * (e.b.y - e.a.y))


def ring_area_signed(r: Column) -> Column:
    return _total(F.transform(edges(r), _cross)) / 2


def ring_length(r: Column) -> Column:
    return _total(F.transform(edges(r), side_length))


def _sums(**fields: Column) -> Column:
    return F.struct(*[v.alias(n) for n, v in fields.items()])


def measure(parts: Column) -> Column:
    """STRUCT<area, perimeter, cx, cy> of a footprint, in one pass over its sides: holes count against their shell; without area the centre is the mean of the first shell's points."""
    zero = F.lit(0.0)
    of_ring = lambda r: F.aggregate(
        edges(r),
        _sums(c=zero, x=zero, y=zero, p=zero),
        lambda s, e: _sums(c=s.c + _cross(e), x=s.x + (e.a.x + e.b.x) * _cross(e), y=s.y + (e.a.y + e.b.y) * _cross(e), p=s.p + side_length(e)),
    )
    # A shell counts with positive, a hole with negative area, whichever way it turns.
    turned = lambda s, i: _sums(c=F.abs(s.c) * F.when(i == 0, 1.0).otherwise(-1.0), x=s.x * F.signum(s.c) * F.when(i == 0, 1.0).otherwise(-1.0), y=s.y * F.signum(s.c) * F.when(i == 0, 1.0).otherwise(-1.0), p=s.p)
    rings = F.flatten(F.transform(parts, lambda rs: F.transform(F.transform(rs, of_ring), turned)))
    first = parts[0][0]
    mean = lambda axis: _total(F.transform(first, lambda v: v[axis])) / F.greatest(F.size(first), F.lit(1))
    return F.aggregate(
        rings,
        _sums(c=zero, x=zero, y=zero, p=zero),
        lambda s, r: _sums(c=s.c + r.c, x=s.x + r.x, y=s.y + r.y, p=s.p + r.p),
        lambda s: _sums(area=s.c / 2, perimeter=s.p, cx=F.coalesce(F.try_divide(s.x, 3 * s.c), mean("x")), cy=F.coalesce(F.try_divide(s.y, 3 * s.c), mean("y"))),
    )


def area(parts: Column) -> Column:
    """Shells less holes, summed over parts."""
    return measure(parts).area


def perimeter(parts: Column) -> Column:
    """Boundary length, holes included."""
    return measure(parts).perimeter


def centroid(parts: Column) -> Column:
    """Area-weighted over shells and holes."""
    m = measure(parts)
    return F.struct(m.cx.alias("x"), m.cy.alias("y"))


def largest_shell(parts: Column) -> Column:
    """The shell of the part with the most area, the first of equals; vertex metrics are taken on it."""
    tagged = F.transform(parts, lambda rings, i: F.struct(F.abs(ring_area_signed(rings[0])).alias("a"), (-i).alias("i"), rings[0].alias("r")))
    return F.when(F.size(parts) == 1, parts[0][0]).otherwise(F.array_max(tagged).r)


def bounds(parts: Column) -> Column:
    """STRUCT<minx, miny, maxx, maxy>."""
    points = F.flatten(F.flatten(parts))
    of = lambda f, axis: f(F.transform(points, lambda p: p[axis]))
    return F.struct(of(F.array_min, "x").alias("minx"), of(F.array_min, "y").alias("miny"), of(F.array_max, "x").alias("maxx"), of(F.array_max, "y").alias("maxy"))


def contains(r: Column, x: Column, y: Column) -> Column:
    """Ray casting: whether the point lies inside the ring (even-odd)."""
    crosses = lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < (e.b.x - e.a.x) * F.coalesce(F.try_divide(y - e.a.y, e.b.y - e.a.y), F.lit(0.0)) + e.a.x)
    return F.size(F.filter(edges(r), crosses)) % 2 == 1


def translate_to_origin(parts: Column) -> Column:
    """The footprint moved so that its centroid is (0, 0)."""
    c = centroid(parts)
    return F.transform(parts, lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((p.x - c.x).alias("x"), (p.y - c.y).alias("y")))))


def complexity_index(a: Column, p: Column) -> Column:
    return F.coalesce(F.try_divide(p, a), F.lit(0.0))


def isoperimetric_quotient(a: Column, p: Column) -> Column:
    return F.coalesce(F.try_divide(4 * math.pi * a, p * p), F.lit(0.0))


def fractality(a: Column, p: Column) -> Column:
    return F.when((a > 0) & (p > 1), 1 - F.ln(F.when(a > 0, a)) / (2 * F.ln(F.when(p > 1, p)))).otherwise(0.0)


def radii(r: Column, cx: Column, cy: Column) -> Column:
    return F.transform(r, lambda v: F.sqrt((v.x - cx) * (v.x - cx) + (v.y - cy) * (v.y - cy)))


def vertex_metrics(r: Column, d: Column, a: Column, cx: Column, cy: Column) -> dict[str, Column]:
    """Mean radius, largest circularity, boundary compactness, cross moment and spread of the ring's vertices about a centre at distances d."""
    n = F.size(r)
    share = lambda v: F.coalesce(F.try_divide(100 * v, _total(d)), F.lit(0.0))
    return {
        "mean_radius": F.coalesce(F.try_divide(_total(d), n), F.lit(0.0)),
        "max_circularity": F.coalesce(F.try_divide(F.sqrt(a / math.pi), F.array_max(d)), F.lit(1.0)),
        "bci": _total(F.transform(d, lambda v: F.abs(share(v) - 100.0 / n))),
        "cross_moment_mu11": _total(F.transform(r, lambda v: (v.x - cx) * (v.y - cy))),
        "variance_spreading": F.coalesce(F.try_divide(_total(F.transform(d, lambda v: v * v)), n), F.lit(0.0)),
    }


def weighted_orientation(r: Column) -> Column:
    """Mean of side angles, each folded and weighing its length; sides of no length don't count."""
    zero = F.lit(0.0)
    return F.aggregate(
        edges(r),
        _sums(t=zero, p=zero),
        lambda s, e: _sums(t=s.t + side_length(e) * fold(F.atan2(e.b.y - e.a.y, e.b.x - e.a.x)), p=s.p + side_length(e)),
        lambda s: F.coalesce(F.try_divide(s.t, s.p), zero),
    )
