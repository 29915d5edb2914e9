"""Numpy geometry for what column expressions cannot say: hulls, rectangles, circles, clipping, triangulation."""

from __future__ import annotations

import math

import numpy as np

CIRCLE_SIDES = 256


def fold(angle: float) -> float:
    turned = angle % math.pi
    return 0.0 if turned >= math.pi else turned


def polygon_area(p: np.ndarray) -> float:
    """Signed."""
    if len(p) < 3:
        return 0.0
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def polygon_centroid(p: np.ndarray) -> np.ndarray:
    a = polygon_area(p)
    if abs(a) < 1e-12:
        return p.mean(axis=0)
    q = np.roll(p, -1, axis=0)
    c = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    return ((p + q) * c[:, None]).sum(axis=0) / (6 * a)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise from the lowest of the leftmost points; points on a side are left out."""
    pts = sorted({(float(x), float(y)) for x, y in points})
    if len(pts) < 3:
        return np.array(pts)

    def half(sequence):
        out: list[tuple[float, float]] = []
        for x, y in sequence:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    return np.array(half(pts) + half(reversed(pts)))


def longest_chord(hull: np.ndarray) -> tuple[float, float, int, int]:
    """Length, folded angle and ends of the longest chord: the first in row order of equals."""
    d = np.sqrt(((hull[:, None] - hull[None]) ** 2).sum(axis=2))
    i, j = divmod(int(np.argmax(d)), len(hull))
    dx, dy = hull[j] - hull[i]
    return float(d[i, j]), fold(math.atan2(dy, dx)), i, j


def smallest_rectangle(hull: np.ndarray) -> tuple[float, float, float]:
    """Long side, short side and folded angle of the long side of the rectangle of least area; (1, 1, 0) where there is none."""
    if len(hull) < 3:
        return 1.0, 1.0, 0.0
    side = np.roll(hull, -1, axis=0) - hull
    angle = np.arctan2(side[:, 1], side[:, 0])
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    u, v = c * hull[:, 0] + s * hull[:, 1], -s * hull[:, 0] + c * hull[:, 1]
    w, h = np.ptp(u, axis=1), np.ptp(v, axis=1)
    k = int(np.argmin(np.round(w * h, 9)))
    turned = angle[k] if w[k] >= h[k] else angle[k] + math.pi / 2
    return float(max(w[k], h[k])), float(min(w[k], h[k])), fold(float(turned))


def enclosing_circle(hull: np.ndarray) -> tuple[float, float, float]:
    """Centre and radius of the smallest enclosing circle, point by point over the hull."""

    def through(*p):
        if len(p) == 2:
            c = (p[0] + p[1]) / 2
            return c, float(np.hypot(*(p[0] - c)))
        (ax, ay), (bx, by), (cx, cy) = p
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if abs(d) < 1e-12:
            i, j = max(((0, 1), (0, 2), (1, 2)), key=lambda ij: np.hypot(*(p[ij[0]] - p[ij[1]])))
            return through(p[i], p[j])
        ux = ((ax * ax + ay * ay) * (by - cy) + (bx * bx + by * by) * (cy - ay) + (cx * cx + cy * cy) * (ay - by)) / d
        uy = ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by * by) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d
        c = np.array([ux, uy])
        return c, float(np.hypot(*(p[0] - c)))

    out = lambda q, c, r: np.hypot(*(q - c)) > r * (1 + 1e-10) + 1e-12
    c, r = hull[0], 0.0
    for i in range(1, len(hull)):
        if out(hull[i], c, r):
            c, r = hull[i], 0.0
            for j in range(i):
                if out(hull[j], c, r):
                    c, r = through(hull[i], hull[j])
                    for k in range(j):
                        if out(hull[k], c, r):
                            c, r = through(hull[i], hull[j], hull[k])
    return float(c[0]), float(c[1]), r


def clip_convex(polygon: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a polygon inside a convex counter-clockwise window; areas are right also where parts join along a side."""
    out = polygon
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(out):
            break
        out = _inner(out, (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0]))
    return out


def _inner(ring: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The part of a ring where d, linear over the plane and given at its points, is not negative."""
    if (d >= 0).all():
        return ring
    q, dq = np.roll(ring, -1, axis=0), np.roll(d, -1)
    cross = ((d > 0) & (dq < 0)) | ((d < 0) & (dq > 0))
    t = np.divide(d, d - dq, out=np.zeros_like(d), where=cross)
    both = np.stack([ring, ring + (q - ring) * t[:, None]], axis=1)
    return both[np.stack([d >= 0, cross], axis=1)]


def half(ring: np.ndarray, axis: int, limit: float, low: bool) -> np.ndarray:
    """The part of a ring below (or above) a limit of one coordinate; new points lie on the limit to the last bit."""
    d = limit - ring[:, axis] if low else ring[:, axis] - limit
    if (d >= 0).all():
        return ring
    q, dq = np.roll(ring, -1, axis=0), np.roll(d, -1)
    cross = ((d > 0) & (dq < 0)) | ((d < 0) & (dq > 0))
    # From the lower to the upper end, so that a side is cut at one point from both sides of the limit.
    turned = (ring[:, axis] > q[:, axis])[:, None]
    a, b = np.where(turned, q, ring), np.where(turned, ring, q)
    t = np.divide(limit - a[:, axis], b[:, axis] - a[:, axis], out=np.zeros_like(d), where=cross)
    new = a + (b - a) * t[:, None]
    new[:, axis] = limit
    return np.stack([ring, new], axis=1)[np.stack([d >= 0, cross], axis=1)]


def turned_rings(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """All rings, shells counter-clockwise and holes clockwise, so that their signed areas add up."""
    return [r if (polygon_area(r) > 0) == (n == 0) else r[::-1] for rings in parts for n, r in enumerate(rings) if len(r) >= 3]


def area_tiles(parts: list[list[np.ndarray]], size: float):
    """Yields (gx0, gx1, gy0, gy1, rings): blocks of grid tiles wholly inside (rings is None), and single tiles on the border with their piece of the outline.

    The outline is halved at a line of tiles again and again, so a point takes part in as many cuts as there are halvings, not tiles.
    """
    rings = turned_rings(parts)
    if not rings:
        return
    points = np.concatenate(rings)
    (x0, y0), (x1, y1) = np.floor(points.min(axis=0) / size), np.floor(points.max(axis=0) / size)
    work = [(rings, int(x0), int(x1) + 1, int(y0), int(y1) + 1)]
    while work:
        rings, gx0, gx1, gy0, gy1 = work.pop()
        box = (gx0 * size, gx1 * size), (gy0 * size, gy1 * size)
        rim = all(np.logical_or.reduce([(r[:, k] == v) & (np.roll(r[:, k], -1) == v) for k in (0, 1) for v in box[k]]).all() for r in rings)
        if rim:
            if sum(map(polygon_area, rings)) > (box[0][1] - box[0][0]) * (box[1][1] - box[1][0]) / 2:
                yield gx0, gx1, gy0, gy1, None
        elif gx1 - gx0 == 1 and gy1 - gy0 == 1:
            yield gx0, gx1, gy0, gy1, rings
        else:
            wide = gx1 - gx0 >= gy1 - gy0
            at = (gx0 + gx1) // 2 if wide else (gy0 + gy1) // 2
            for low in (True, False):
                part = [c for r in rings if len(c := half(r, 0 if wide else 1, at * size, low)) >= 3]
                if part:
                    work.append((part, at if wide and not low else gx0, at if wide and low else gx1, at if not wide and not low else gy0, at if not wide and low else gy1))


def covered_by_circle(a: np.ndarray, b: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each directed side a to b (about the centre): the signed area that its triangle with the centre has in common with the circle polygon of that radius.

    In each wedge between two corners of the circle polygon its border is one chord, and the distance of a point of the side in chord lengths is linear
    along the side, so every wedge is a closed form; summed over the sides of a ring this is the area in common, whatever the ring's shape.
    """
    turn = 2 * math.pi / CIRCLE_SIDES
    d, step = b - a, math.sin(turn)
    begin = np.arctan2(a[:, 1], a[:, 0])
    sweep = np.arctan2(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0], (a * b).sum(axis=1))
    first = np.floor(np.minimum(begin, begin + sweep) / turn - 1e-9).astype(int)
    count = np.floor(np.maximum(begin, begin + sweep) / turn + 1e-9).astype(int) - first + 1
    side = np.repeat(np.arange(len(a)), count)
    wedge = first[side] + np.arange(len(side)) - np.repeat(np.cumsum(count) - count, count)
    cross_at = lambda v, w: np.cos(w * turn) * v[side, 1] - np.sin(w * turn) * v[side, 0]
    (ca, cd), (na, nd) = ((cross_at(a, w), cross_at(d, w)) for w in (wedge, wedge + 1))
    # Along the side, cross(ray, point) = c + s * slope: at least 0 at the wedge's own ray, at most 0 at the next.
    low, high = np.zeros(len(side)), np.ones(len(side))
    for c, slope in ((ca, cd), (-na, -nd)):
        root = np.divide(-c, slope, out=np.zeros_like(c), where=slope != 0)
        low = np.where(slope > 0, np.maximum(low, root), np.where((slope == 0) & (c < 0), np.inf, low))
        high = np.where(slope < 0, np.minimum(high, root), high)
    some = low < high
    side, low, high, ca, cd, na, nd = (v[some] for v in (side, low, high, ca, cd, na, nd))
    at = lambda s: (a[side, 0] + s * d[side, 0], a[side, 1] + s * d[side, 1])
    far = lambda s: ((ca + s * cd) - (na + s * nd)) / (step * radius[side])
    (px, py), (qx, qy), rp, rq = at(low), at(high), far(low), far(high)
    fp, fq = 1 / np.maximum(rp, 1.0), 1 / np.maximum(rq, 1.0)
    px, py, qx, qy = px * fp, py * fp, qx * fq, qy * fq
    cross = (rp < 1) != (rq < 1)
    x, y = at(low + (high - low) * np.divide(1 - rp, rq - rp, out=np.zeros_like(rp), where=cross))
    part = np.where(cross, px * y - py * x + x * qy - y * qx, px * qy - py * qx) / 2
    return np.bincount(side, part, minlength=len(a))


def exchange_indices(footprints: list[list[list[np.ndarray]]], chunk: int = 20_000) -> np.ndarray:
    """For each footprint (parts of shell and holes): 1 less the share of the circle of equal area at the centroid that it covers; 0 without area."""
    starts, ends, radius, owner = [], [], [], []
    area = np.zeros(len(footprints))
    for i, parts in enumerate(footprints):
        rings = [(r if (polygon_area(r) > 0) == (n == 0) else r[::-1]) for part in parts for n, r in enumerate(part) if len(r) >= 3]
        weights = np.array([polygon_area(r) for r in rings])
        area[i] = weights.sum() if rings else 0.0
        if area[i] <= 0:
            continue
        c = sum(w * polygon_centroid(r) for w, r in zip(weights, rings, strict=True)) / area[i]
        for r in rings:
            starts.append(r - c)
            ends.append(np.roll(r, -1, axis=0) - c)
            radius += [math.sqrt(area[i] / math.pi)] * len(r)
            owner += [i] * len(r)
    if not owner:
        return np.zeros(len(footprints))
    a, b, rad, own = np.concatenate(starts), np.concatenate(ends), np.array(radius), np.array(owner)
    common = np.concatenate([covered_by_circle(a[k : k + chunk], b[k : k + chunk], rad[k : k + chunk]) for k in range(0, len(a), chunk)])
    circle = area / math.pi * CIRCLE_SIDES / 2 * math.sin(2 * math.pi / CIRCLE_SIDES)
    inside = np.bincount(own, common, minlength=len(footprints))
    return np.where(area > 0, 1 - np.divide(inside, circle, out=np.zeros_like(inside), where=circle > 0), 0.0)


def bisector_orientation(hull: np.ndarray, i: int, j: int, lco: float) -> float:
    """Direction of the bisector at the hull point farthest from the chord (i, j); square to the chord where there is none."""
    a, b = hull[i], hull[j]
    off = np.abs((b[0] - a[0]) * (hull[:, 1] - a[1]) - (b[1] - a[1]) * (hull[:, 0] - a[0]))
    k = int(np.argmax(off))
    u, v = a - hull[k], b - hull[k]
    nu, nv = np.hypot(*u), np.hypot(*v)
    if off[k] <= 1e-12 or nu <= 1e-12 or nv <= 1e-12:
        return fold(lco + math.pi / 2)
    w = u / nu + v / nv
    return fold(lco + math.pi / 2) if np.hypot(*w) <= 1e-12 else fold(math.atan2(w[1], w[0]))


def hull_metrics(shell: np.ndarray, area: float) -> dict[str, float]:
    """The metrics that need hull, rectangle or circle; all 0 for a shell of fewer than 3 points."""
    if len(shell) < 3:
        return dict.fromkeys(("longest_chord", "lco", "sbro", "bisector_orientation", "gibbs_compactness", "elongation_index", "ellipticity", "solidity", "dcm"), 0.0)
    hull = convex_hull(shell)
    chord, lco, i, j = longest_chord(hull)
    long_, short, sbro = smallest_rectangle(hull)
    x, y, _ = enclosing_circle(hull)
    radius = float(np.hypot(hull[:, 0] - x, hull[:, 1] - y).max())
    across = -math.sin(lco) * shell[:, 0] + math.cos(lco) * shell[:, 1]
    hull_area = abs(polygon_area(hull))
    return {
        "longest_chord": chord,
        "lco": lco,
        "sbro": sbro,
        "bisector_orientation": bisector_orientation(hull, i, j, lco) if len(hull) >= 3 else fold(lco + math.pi / 2),
        "gibbs_compactness": 4 * area / (math.pi * chord * chord) if chord > 0 else 0.0,
        "elongation_index": long_ / short if short > 0 else 1.0,
        "ellipticity": float(np.ptp(across)) / chord if chord > 0 else 1.0,
        "solidity": area / hull_area if hull_area > 0 else 1.0,
        "dcm": area / (math.pi * radius * radius) if radius > 0 else 0.0,
    }


def curve_order(points: np.ndarray, bits: int = 16) -> np.ndarray:
    """Indexes of the points in the order in which a Hilbert curve over their box meets them."""
    low, span = points.min(axis=0), max(float(np.ptp(points, axis=0).max()), 1e-300)
    x, y = ((points - low) / span * (2**bits - 1)).astype(np.int64).T
    key = np.zeros(len(points), dtype=np.int64)
    for k in range(bits - 1, -1, -1):
        bx, by = (x >> k) & 1, (y >> k) & 1
        key = (key << 2) | ((3 * bx) ^ by)
        flip = (by == 0) & (bx == 1)
        mask = (1 << k) - 1
        x, y = np.where(flip, mask - (x & mask), x & mask), np.where(flip, mask - (y & mask), y & mask)
        swap = by == 0
        x, y = np.where(swap, y, x), np.where(swap, x, y)
    return np.argsort(key, kind="stable")


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of three ascending point indexes) by incremental insertion; of cocircular choices the one that the order of insertion gives.

    Points go in along a space-filling curve, and each is found by a walk from the last one's triangle, which is near. Points must be pairwise distinct.
    Fewer than three, or all on a line: none. Tests of circle and side are exact for whole-number coordinates up to 2**20.
    """
    n = len(points)
    if n < 3:
        return np.zeros((0, 3), dtype=np.int64)
    p = points - np.floor(points.min(axis=0))
    order = curve_order(p).tolist()
    q = [tuple(v) for v in p.tolist()]

    def side(a: int, b: int, c: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = q[a], q[b], q[c]
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    start = next((k for k in range(2, n) if side(order[0], order[1], order[k]) != 0), None)
    if start is None:
        return np.zeros((0, 3), dtype=np.int64)
    a, b, c = order[0], order[1], order[start]
    if side(a, b, c) < 0:
        b, c = c, b
    # Directed side to the point across from it, counter-clockwise; a ghost point at infinity (index n) closes the hull, so no far corner bends the circles.
    tri: dict[tuple[int, int], int] = {}

    def add(x: int, y: int, z: int) -> None:
        tri[x, y], tri[y, z], tri[z, x] = z, x, y

    def inside(x: int, y: int, z: int, d: int) -> bool:
        if x == n or y == n or z == n:
            while z != n:
                x, y, z = y, z, x
            s = side(x, y, d)
            if s != 0:
                return s > 0
            return min(q[x], q[y]) < q[d] < max(q[x], q[y])
        dx, dy = q[d]
        (ax, ay), (bx, by), (cx, cy) = q[x], q[y], q[z]
        ax, ay, bx, by, cx, cy = ax - dx, ay - dy, bx - dx, by - dy, cx - dx, cy - dy
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0

    def found(x: int, y: int, d: int) -> tuple[int, int, int]:
        """A triangle that d spoils, by a walk from the one on the directed side (x, y), which has no ghost."""
        z = tri[x, y]
        for _ in range(4 * n):
            for u, v in ((x, y), (y, z), (z, x)):
                if side(u, v, d) < 0:
                    w = tri[v, u]
                    if w == n:
                        return v, u, n
                    x, y, z = v, u, w
                    break
            else:
                return x, y, z
        return next((u, v, w) for (u, v), w in tri.items() if inside(u, v, w, d))  # rounding can lead a walk in a circle

    for t in ((a, b, c), (b, a, n), (c, b, n), (a, c, n)):
        add(*t)
    last = (a, b)
    for k in range(2, n):
        if k == start:
            continue
        d = order[k]
        x, y, z = found(*last, d)
        if not inside(x, y, z, d):  # on the line of a hull side, beyond it
            x, y, z = next((u, v, w) for (u, v), w in tri.items() if inside(u, v, w, d))
        del tri[x, y], tri[y, z], tri[z, x]
        border, work = [], [(y, x), (z, y), (x, z)]
        while work:
            u, v = work.pop()
            w = tri.get((u, v))
            if w is None:
                continue
            if inside(u, v, w, d):
                del tri[u, v], tri[v, w], tri[w, u]
                work += [(w, v), (u, w)]
            else:
                border.append((v, u))
        for u, v in border:
            add(u, v, d)
        last = next((u, v) for u, v in border if u != n and v != n)
        if tri[last] == n:
            last = last[::-1]
    triangles = {tuple(sorted((u, v, w))) for (u, v), w in tri.items() if n not in (u, v, w)}
    return np.array(sorted(triangles), dtype=np.int64).reshape(-1, 3)


def sure_triangles(points: np.ndarray, fans: list[list[tuple]], box: tuple[np.ndarray, float] | None) -> np.ndarray:
    """Triangles (rows of three point indexes, counter-clockwise) of the points that stay whatever lies outside the box (low corner, side; None: nothing does).

    fans holds for each point the triangles around it that are already known, as the places (bx, by, cx, cy) of their other corners, counter-clockwise; the points within those
    may be missing here. A new triangle that covers known ones goes.
    """
    t = delaunay(points)
    if not len(t):
        return t
    a, b, c = points[t[:, 0]], points[t[:, 1]], points[t[:, 2]]
    turn = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    t = np.where(turn[:, None] > 0, t, t[:, [0, 2, 1]])
    if box is not None:
        u, v = b - a, c - a
        uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            middle = np.stack([v[:, 1] * uu - u[:, 1] * vv, u[:, 0] * vv - v[:, 0] * uu], axis=1) / (2 * turn[:, None])
            radius = np.hypot(*middle.T)[:, None]
            (low, side), slack = box, 1e-9 * box[1]
            near = a + middle - low
            inside = ((near - radius > slack) & (near + radius < side - slack)).all(axis=1)
        t = t[inside]
    keep = np.ones(len(t), dtype=bool)
    for i, corners in enumerate(t.tolist()):
        gx, gy = points[corners].mean(axis=0)
        for at in corners:
            x, y = points[at]
            if any((bx - x) * (gy - y) - (by - y) * (gx - x) >= 0 and (gx - x) * (cy - y) - (gy - y) * (cx - x) >= 0 for bx, by, cx, cy in fans[at]):
                keep[i] = False
                break
    return t[keep]


def voronoi_shares(points: np.ndarray, parcel: np.ndarray | list[list[np.ndarray]]) -> np.ndarray:
    """Area of each point's Voronoi cell within the parcel (a ring, or parts of shell and holes); parcel area / n for fewer than 4 points or an empty cell.

    A cell is what the half-planes against the point's Delaunay neighbours leave of the parcel's box; those of a convex cell are all that bound it. The cell is convex, so
    it cuts every ring of the parcel, and what it cuts from holes counts against what it cuts from shells.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0)
    rings = turned_rings([[parcel]] if isinstance(parcel, np.ndarray) else parcel)
    total = sum(map(polygon_area, rings))
    even = total / n
    if n < 4 or not rings:
        return np.full(n, even)
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b, c in delaunay(points).tolist():
        near[a] |= {b, c}
        near[b] |= {a, c}
        near[c] |= {a, b}
    every = np.concatenate(rings)
    (x0, y0), (x1, y1) = every.min(axis=0).tolist(), every.max(axis=0).tolist()
    q = points.tolist()
    shares = np.full(n, even)
    for i in range(n):
        cell = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        px, py = q[i]
        for j in sorted(near[i] or set(range(n)) - {i}):
            dx, dy = q[j][0] - px, q[j][1] - py
            mid = dx * (px + dx / 2) + dy * (py + dy / 2)
            s = [x * dx + y * dy - mid for x, y in cell]
            if max(s) <= 0:
                continue
            rows = []
            for k, (x, y) in enumerate(cell):
                sp, sq = s[k - 1], s[k]
                if (sp < 0 < sq) or (sq < 0 < sp):
                    (ox, oy), t = cell[k - 1], sp / (sp - sq)
                    rows.append((ox + (x - ox) * t, oy + (y - oy) * t))
                if sq <= 0:
                    rows.append((x, y))
            cell = rows
            if len(cell) < 3:
                break
        if len(cell) >= 3:
            window = np.array(cell)
            a = sum(polygon_area(clip_convex(r, window)) for r in rings)
            shares[i] = a if a > 0 else even
    return shares


def _inside_any(points: np.ndarray, footprints: list[list[np.ndarray]]) -> np.ndarray:
    """Whether each point lies in any footprint (even-odd over its rings)."""
    out = np.zeros(len(points), dtype=bool)
    for rings in footprints:
        odd = np.zeros(len(points), dtype=bool)
        for r in rings:
            a, b = r, np.roll(r, -1, axis=0)
            across = (a[None, :, 1] > points[:, None, 1]) != (b[None, :, 1] > points[:, None, 1])
            with np.errstate(divide="ignore", invalid="ignore"):
                x = (b[:, 0] - a[:, 0]) * (points[:, None, 1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
            odd ^= (across & (points[:, None, 0] < x)).sum(axis=1) % 2 == 1
        out |= odd
    return out


def overlay(left: list[list[np.ndarray]], right: list[list[np.ndarray]] | None = None, digits: int = 6) -> list[list[np.ndarray]]:
    """Union of the footprints on the left or, with a right side, its intersection with the union of those; parts of shell and holes.

    A footprint is its rings. All sides are cut where they meet; a piece is on the border of the result where the result lies on one of its two sides only, and such pieces
    join to rings with the result on their left. Coordinates are rounded to `digits`, which also joins what lies that close.
    """
    every = [r for side in (left, right or []) for rings in side for r in rings if len(r) >= 3]
    if not left or not every or (right is not None and not right):
        return []
    a = np.round(np.concatenate(every), digits)
    b = np.round(np.concatenate([np.roll(r, -1, axis=0) for r in every]), digits)
    keep = (a != b).any(axis=1)
    a, b = a[keep], b[keep]
    d = b - a
    pieces: set[tuple] = set()
    for i in range(len(a)):
        w = a - a[i]
        turn = d[i, 0] * d[:, 1] - d[i, 1] * d[:, 0]
        at = [0.0, 1.0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (w[:, 0] * d[:, 1] - w[:, 1] * d[:, 0]) / turn
            u = (w[:, 0] * d[i, 1] - w[:, 1] * d[i, 0]) / turn
        meets = (np.abs(turn) > 1e-12) & (t > 0) & (t < 1) & (u >= -1e-9) & (u <= 1 + 1e-9)
        at += t[meets].tolist()
        n = d[i] @ d[i]
        along = np.abs(turn) <= 1e-12
        for p in (a[along], b[along]):  # collinear sides cut each other at their ends
            off = np.abs((p - a[i]) @ np.array([-d[i, 1], d[i, 0]])) <= 10.0**-digits * math.sqrt(n)
            s = (p - a[i]) @ d[i] / n
            at += s[off & (s > 0) & (s < 1)].tolist()
        cuts = np.round(a[i] + np.array(sorted(set(at)))[:, None] * d[i], digits)
        for p, q in zip(map(tuple, cuts[:-1]), map(tuple, cuts[1:]), strict=True):
            if p != q:
                pieces.add((p, q) if p < q else (q, p))
    if not pieces:
        return []
    s = np.array(sorted(pieces))
    middle, along = s.mean(axis=1), s[:, 1] - s[:, 0]
    length = np.sqrt((along**2).sum(axis=1, keepdims=True))
    normal = np.stack([-along[:, 1], along[:, 0]], axis=1) / length * np.minimum(length * 1e-3, 10.0 ** (1 - digits))
    sides = []
    for p in (middle + normal, middle - normal):
        hit = _inside_any(p, left)
        sides.append(hit if right is None else hit & _inside_any(p, right))
    on, off = sides
    return assemble([(p, q) if l else (q, p) for (p, q), l, r in zip(s.tolist(), on, off, strict=True) if l != r])


def assemble(border: list, grid: float | None = None) -> list[list[np.ndarray]]:
    """Parts of shell and holes from directed sides that have the inside on their left. Points on a side go; with a grid, also those that its lines left there, whose coordinates are rounded."""
    follow: dict[tuple, list[tuple]] = {}
    for p, q in border:
        follow.setdefault(tuple(p), []).append(tuple(q))
    rings = []
    for start in sorted(follow):
        while start in follow:
            ring, here, last = [start], follow[start].pop(), start
            if not follow[start]:
                del follow[start]
            while here != start:
                ring.append(here)
                back = math.atan2(last[1] - here[1], last[0] - here[0])
                # At a point where rings touch, turn as far to the right as can be: rings then touch but never cross.
                choices = follow.get(here)
                if not choices:
                    break
                nxt = min(choices, key=lambda q: (back - math.atan2(q[1] - here[1], q[0] - here[0])) % (2 * math.pi) or 2 * math.pi)
                choices.remove(nxt)
                if not choices:
                    del follow[here]
                here, last = nxt, here
            if len(ring) >= 3 and here == start:
                p = np.array(ring)
                before, after = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
                turn = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0])
                bent = turn > 1e-12
                if grid is not None:
                    on_line = (np.abs(p - np.round(p / grid) * grid) < 1e-9).any(axis=1)
                    bent &= ~on_line | (turn > 4e-6 * np.hypot(*before.T) + 4e-6 * np.hypot(*after.T))
                rings.append(p[bent] if bent.sum() >= 3 else p)
    shells = [r for r in rings if polygon_area(r) > 0]
    parts = [[r] for r in sorted(shells, key=lambda r: abs(polygon_area(r)))]
    for h in (r for r in rings if polygon_area(r) < 0):
        probe = h.mean(axis=0, keepdims=True) if _inside_any(h.mean(axis=0, keepdims=True), [[h]])[0] else h[:1]
        home = next((part for part in parts if _inside_any(probe, [[part[0]]])[0]), None)
        if home is not None:
            home.append(h)
    return parts


def heap_union(footprints: list[list[np.ndarray]], few: int = 12) -> list[list[np.ndarray]]:
    """overlay of many footprints: neighbours along a Z-order curve are united a few at a time, again and again, so the work grows with the footprints and not with the square of their sides; whatever does not shrink goes to one last overlay."""
    while len(footprints) > few:
        ends = np.array([[r[0].min(axis=0), r[0].max(axis=0)] for r in footprints])
        middle = ends.mean(axis=1)
        at = ((middle - middle.min(axis=0)) / max(np.ptp(middle, axis=0).max(), 1e-300) * 1023).astype(int)
        code = np.zeros(len(at), dtype=int)
        for bit in range(10):
            code |= ((at[:, 0] >> bit) & 1) << (2 * bit) | ((at[:, 1] >> bit) & 1) << (2 * bit + 1)
        order = np.argsort(code, kind="stable")
        united = [part for a in range(0, len(order), few) for part in overlay([footprints[i] for i in order[a : a + few]])]
        if len(united) > 0.8 * len(footprints):
            return overlay(united)
        footprints = united
    return overlay(footprints)


def cell_border(footprints: list[list[list[np.ndarray]]], gx: int, gy: int, size: float) -> np.ndarray:
    """Directed sides (rows x1, y1, x2, y2, the inside on the left) of the union of footprints within one grid cell."""
    inside = []
    for parts in footprints:
        for rings in parts:
            cut = []
            for r in rings:
                for axis, limit, low in ((0, (gx + 1) * size, True), (0, gx * size, False), (1, (gy + 1) * size, True), (1, gy * size, False)):
                    r = half(r, axis, limit, low) if len(r) else r
                if len(r) >= 3:
                    cut.append(r)
            if cut:
                inside.append(cut)
    union = heap_union(inside)
    sides = [np.hstack([r, np.roll(r, -1, axis=0)]) for part in union for n, r in enumerate(part)]
    return np.concatenate(sides) if sides else np.zeros((0, 4))


def cancelled(sides: np.ndarray, axis: int) -> np.ndarray:
    """Of directed sides on one line, along `axis`, what is left when opposite ones cancel."""
    a, b = sides[:, axis], sides[:, 2 + axis]
    ends = np.unique(np.concatenate((a, b)))
    low, high = np.searchsorted(ends, np.minimum(a, b)), np.searchsorted(ends, np.maximum(a, b))
    net = np.zeros(len(ends), dtype=np.int64)
    np.add.at(net, low, np.sign(b - a).astype(np.int64))
    np.add.at(net, high, -np.sign(b - a).astype(np.int64))
    net = np.cumsum(net)[:-1]
    at = np.flatnonzero(net)
    out = np.empty((len(at), 4))
    out[:, 1 - axis] = out[:, 3 - axis] = sides[0, 1 - axis]
    out[:, axis] = np.where(net[at] > 0, ends[at], ends[at + 1])
    out[:, 2 + axis] = np.where(net[at] > 0, ends[at + 1], ends[at])
    return out
