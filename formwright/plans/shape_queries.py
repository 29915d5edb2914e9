"""Queries on the shapes of single buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from formwright.functions import geometry as g
from formwright.operators import shapes

from .registry import query
from .standins import BLD, VTX, buildings, parcels


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(f"""WITH {VTX},
kept AS (SELECT * FROM shape JOIN bld USING (building_id, block_id) WHERE area >= 30 AND NOT (greatest(w, h) / least(w, h) > 15 AND area < 500))
SELECT r_name AS class_name, count(*) AS n_buildings, round(avg(area), 6) AS mean_area, round(avg(perimeter), 6) AS mean_perimeter, round(avg(perimeter / area), 6) AS mean_complexity,
  round(avg(4 * pi() * area / (perimeter * perimeter)), 6) AS mean_ipq, round(avg(1 - ln(area) / (2 * ln(perimeter))), 6) AS mean_fractality
FROM kept JOIN nation ON block_id = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def shape_by_class(spark, sf_dir):
    """Mean shape of the cleaned buildings of each functional class."""
    b = shapes.simple_features(buildings(spark, sf_dir))
    box = g.bounds(F.col("parts"))
    long_, short = F.greatest(box.maxx - box.minx, box.maxy - box.miny), F.least(box.maxx - box.minx, box.maxy - box.miny)
    kept = b.where(shapes.kept_shapes(F.col("area"), long_ / short))
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("int").alias("class_id"), F.col("r_name").alias("class_name"))
    named = kept.join(parcels(spark, sf_dir).select("block_id", "class_id"), "block_id").join(regions, "class_id")
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return named.groupBy("class_name").agg(F.count("*").alias("n_buildings"), mean("area", "mean_area"), mean("perimeter", "mean_perimeter"), mean("complexity_index", "mean_complexity"), mean("ipq", "mean_ipq"), mean("fractality", "mean_fractality"))


@query(f"""WITH {VTX} SELECT building_id, round(area, 6) AS area, round(perimeter, 6) AS perimeter, round(cx, 6) AS cx, round(cy, 6) AS cy, round(perimeter / area, 6) AS complexity_index,
  round(4 * pi() * area / (perimeter * perimeter), 6) AS ipq, round(1 - ln(area) / (2 * ln(perimeter)), 6) AS fractality FROM shape""")
def shape_basic(spark, sf_dir):
    """Area, perimeter, centroid and the ratios of both."""
    names = ("area", "perimeter", "cx", "cy", "complexity_index", "ipq", "fractality")
    return rounded(shapes.simple_features(buildings(spark, sf_dir)), *names).select("building_id", *names)


@query(f"""WITH {VTX},
r AS (SELECT building_id, area, x - cx AS dx, y - cy AS dy, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM vtx JOIN shape USING (building_id)),
t AS (SELECT *, sum(d) OVER (PARTITION BY building_id) AS total, count(*) OVER (PARTITION BY building_id) AS n FROM r)
SELECT building_id, round(avg(d), 6) AS mean_radius, round(sqrt(any_value(area) / pi()) / max(d), 6) AS max_circularity, round(sum(abs(100 * d / total - 100.0::DOUBLE / n)), 6) AS bci,
  round(sum(dx * dy), 6) AS cross_moment_mu11, round((sum(dx * dx) + sum(dy * dy)) / count(*), 6) AS variance_spreading FROM t GROUP BY building_id""")
def shape_vertex_stats(spark, sf_dir):
    """Metrics of the vertices about the centroid."""
    names = ("mean_radius", "max_circularity", "bci", "cross_moment_mu11", "variance_spreading")
    return rounded(shapes.simple_features(buildings(spark, sf_dir)), *names).select("building_id", *names)


@query(f"""WITH {VTX},
o AS (SELECT building_id, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len, CASE WHEN atan2(y2 - y, x2 - x) < 0 THEN atan2(y2 - y, x2 - x) + pi() WHEN atan2(y2 - y, x2 - x) >= pi() THEN 0 ELSE atan2(y2 - y, x2 - x) END AS a FROM side)
SELECT building_id, round(sum(len * CASE WHEN a >= pi() THEN 0 ELSE a END) / sum(len), 6) AS weighted_orientation FROM o GROUP BY building_id""")
def weighted_orientation(spark, sf_dir):
    """Mean angle of the sides, weighing their lengths."""
    return rounded(shapes.simple_features(buildings(spark, sf_dir)), "weighted_orientation").select("building_id", "weighted_orientation")


@query(f"""WITH {VTX} SELECT a.building_id, round(max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS longest_chord,
  round(4 * any_value(area) / (pi() * max((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS gibbs_compactness
FROM vtx a JOIN vtx b USING (building_id) JOIN shape s ON s.building_id = a.building_id GROUP BY a.building_id""")
def longest_chord(spark, sf_dir):
    """Longest chord of the hull and the compactness by it."""
    return rounded(shapes.hull_features(buildings(spark, sf_dir), ["building_id"]), "longest_chord", "gibbs_compactness").select("building_id", "longest_chord", "gibbs_compactness")


@query(f"""WITH {VTX},
c AS (SELECT a.building_id, a.x - b.x AS dx, a.y - b.y AS dy, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM vtx a JOIN vtx b USING (building_id) WHERE a.i < b.i),
m AS (SELECT building_id, max(d2) AS d2, count(*) FILTER (d2 = top) AS n, arg_max(atan2(dy, dx), d2) AS a FROM (SELECT *, max(d2) OVER (PARTITION BY building_id) AS top FROM c) GROUP BY building_id)
SELECT building_id, round(CASE WHEN a < 0 THEN a + pi() WHEN a >= pi() THEN 0 ELSE a END, 6) AS lco FROM m WHERE n = 1""")
def chord_orientation(spark, sf_dir):
    """Folded angle of the longest chord, where one chord is longest: the two diagonals of an L-shape's box differ unless it has a square notch only."""
    b = shapes.hull_features(buildings(spark, sf_dir), ["building_id"]).select("building_id", "lco")
    return rounded(b, "lco").select("building_id", "lco")


@query(f"""WITH {VTX}, hull AS (SELECT building_id, w * h - w * h / 8 AS hull_area, least(w * h, 9e9) AS box FROM bld)
SELECT building_id, round(area / hull_area, 6) AS solidity FROM shape JOIN hull USING (building_id)""")
def hull_solidity(spark, sf_dir):
    """Area over hull area; an L-shape's hull leaves out a triangle of an eighth of its box."""
    return rounded(shapes.hull_features(buildings(spark, sf_dir), ["building_id"]), "solidity").select("building_id", "solidity")


@query(f"""WITH {VTX}, hullv AS (SELECT building_id, i, x, y FROM vtx WHERE i <> 3),
hs AS (SELECT *, coalesce(lead(x) OVER v, first_value(x) OVER v) AS x2, coalesce(lead(y) OVER v, first_value(y) OVER v) AS y2 FROM hullv WINDOW v AS (PARTITION BY building_id ORDER BY i)),
dirs AS (SELECT building_id, i, atan2(y2 - y, x2 - x) AS t FROM hs),
ext AS (SELECT d.building_id, d.i, max(cos(t) * x + sin(t) * y) - min(cos(t) * x + sin(t) * y) AS u, max(-sin(t) * x + cos(t) * y) - min(-sin(t) * x + cos(t) * y) AS v FROM dirs d JOIN hullv p ON p.building_id = d.building_id GROUP BY d.building_id, d.i),
best AS (SELECT building_id, min(round(u * v, 6)) AS box FROM ext GROUP BY building_id)
SELECT building_id, count(DISTINCT round(greatest(u, v) / least(u, v), 6)) AS n_shapes, round(min(greatest(u, v) / least(u, v)), 5) AS elongation_low, round(max(greatest(u, v) / least(u, v)), 5) AS elongation_high,
  elongation_low AS elongation, any_value(0.75 * w * h >= 60 AND NOT (greatest(u, v) / least(u, v) > 2.03 AND 0.75 * w * h < 150)) AS kept
FROM ext JOIN best USING (building_id) JOIN bld USING (building_id) WHERE round(u * v, 6) = box GROUP BY building_id HAVING n_shapes = 1""")
def hull_mbr_elongation(spark, sf_dir):
    """Side ratio of the smallest rotated rectangle by the kernel, and the cleaning rule on it, where rectangles of least area over all hull sides agree on the ratio."""
    b = buildings(spark, sf_dir).select("building_id", "parts")
    shell = F.filter(b.parts[0][0], lambda p, i: i != 3)
    hull = b.withColumn("hull", shell)
    turned = hull.select("building_id", "hull", F.explode(F.transform(g.edges(F.col("hull")), lambda e: F.atan2(e.b.y - e.a.y, e.b.x - e.a.x))).alias("t"))
    span = lambda f: F.array_max(F.transform("hull", f)) - F.array_min(F.transform("hull", f))
    c, s = F.cos("t"), F.sin("t")
    ext = turned.select("building_id", span(lambda p: c * p.x + s * p.y).alias("u"), span(lambda p: -s * p.x + c * p.y).alias("v"))
    ratio = F.greatest("u", "v") / F.least("u", "v")
    ext = ext.select("building_id", F.round(F.col("u") * F.col("v"), 6).alias("box"), ratio.alias("ratio"))
    best = ext.groupBy("building_id").agg(F.min("box").alias("least"))
    out = ext.join(best, "building_id").where("box = least").groupBy("building_id").agg(F.countDistinct(F.round("ratio", 6)).alias("n_shapes"), F.round(F.min("ratio"), 5).alias("elongation_low"), F.round(F.max("ratio"), 5).alias("elongation_high"))
    kernel = shapes.hull_features(b.withColumn("size", g.area(F.col("parts"))), ["building_id", "size"])
    rule = shapes.kept_shapes(F.col("size"), F.col("elongation_index"), 60.0, 2.03, 150.0)
    return out.where("n_shapes = 1").join(kernel.select("building_id", F.round("elongation_index", 5).alias("elongation"), rule.alias("kept")), "building_id")


@query(f"""WITH {BLD} SELECT building_id, round(0.75 * w * h, 6) AS area FROM bld WHERE 0.75 * w * h >= 30 AND NOT (greatest(w, h) / least(w, h) > 1.5 AND 0.75 * w * h < 100)""")
def clean_filter(spark, sf_dir):
    """The area and elongation rules, with limits that these small shapes meet."""
    b = shapes.measured(shapes.valid(buildings(spark, sf_dir)))
    box = g.bounds(F.col("parts"))
    long_, short = F.greatest(box.maxx - box.minx, box.maxy - box.miny), F.least(box.maxx - box.minx, box.maxy - box.miny)
    return rounded(b.where(shapes.kept_shapes(F.col("area"), long_ / short, 30, 1.5, 100)), "area").select("building_id", "area")


@query(f"""WITH {VTX}, dist AS (SELECT building_id, a, b, r FROM (
  SELECT p.building_id, (p.x + q.x) / 2 AS a, (p.y + q.y) / 2 AS b, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) / 2 AS r FROM vtx p JOIN vtx q USING (building_id) WHERE p.i < q.i
  UNION ALL SELECT building_id, ((ax*ax+ay*ay)*(by_-cy)+(bx*bx+by_*by_)*(cy-ay)+(cx*cx+cy*cy)*(ay-by_))/d, ((ax*ax+ay*ay)*(cx-bx)+(bx*bx+by_*by_)*(ax-cx)+(cx*cx+cy*cy)*(bx-ax))/d,
    sqrt(pow(ax-((ax*ax+ay*ay)*(by_-cy)+(bx*bx+by_*by_)*(cy-ay)+(cx*cx+cy*cy)*(ay-by_))/d,2)+pow(ay-((ax*ax+ay*ay)*(cx-bx)+(bx*bx+by_*by_)*(ax-cx)+(cx*cx+cy*cy)*(bx-ax))/d,2))
  FROM (SELECT p.building_id, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_, s.x AS cx, s.y AS cy, 2*(p.x*(q.y-s.y)+q.x*(s.y-p.y)+s.x*(p.y-q.y)) AS d FROM vtx p JOIN vtx q USING (building_id) JOIN vtx s USING (building_id) WHERE p.i < q.i AND q.i < s.i) WHERE d <> 0)),
ok AS (SELECT d.building_id, a, b, any_value(r) AS r FROM dist d JOIN vtx v ON v.building_id = d.building_id GROUP BY d.building_id, a, b, r HAVING max(sqrt((v.x - a) * (v.x - a) + (v.y - b) * (v.y - b)) - r) <= 1e-7)
SELECT building_id, round(any_value(area) / (pi() * min(r) * min(r)), 5) AS dcm FROM ok JOIN shape USING (building_id) GROUP BY building_id""")
def enclosing_circle_dcm(spark, sf_dir):
    """Area over that of the smallest enclosing circle; the SQL enumerates pairs and triples."""
    return rounded(shapes.hull_features(buildings(spark, sf_dir), ["building_id"]), "dcm", digits=5).select("building_id", "dcm")


#: The share of the circle of equal area that an L-shape covers, by its width and height: the border of the common area is what of each border lies inside the other.
_EXCHANGE = """
g AS (SELECT DISTINCT w, h, 5 * w / 12 AS cx, 5 * h / 12 AS cy, sqrt(0.75 * w * h / pi()) AS r FROM bld),
arc AS (SELECT w, h, k, cx + r * cos(2 * pi() * k / 256) AS px, cy + r * sin(2 * pi() * k / 256) AS py, r * (cos(2 * pi() * (k + 1) / 256) - cos(2 * pi() * k / 256)) AS vx, r * (sin(2 * pi() * (k + 1) / 256) - sin(2 * pi() * k / 256)) AS vy FROM g, range(256) AS t(k)),
el AS (SELECT w, h, i, fx * w AS ax, fy * h AS ay, gx * w AS dx, gy * h AS dy FROM g, (VALUES (0, 0::DOUBLE, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE), (1, 1, 0, 0, 0.5), (2, 1, 0.5, -0.5, 0), (3, 0.5, 0.5, 0, 0.5), (4, 0.5, 1, -0.5, 0), (5, 0, 1, 0, -1)) AS t(i, fx, fy, gx, gy)),
cut AS (SELECT w, h, i, ax * dy - ay * dx AS area2, vx * (ay - py) - vy * (ax - px) AS c0, vx * dy - vy * dx AS c1 FROM el JOIN arc USING (w, h)),
shell AS (SELECT w, h, any_value(area2) * greatest(0, least(1, min(CASE WHEN c1 < 0 THEN -c0 / c1 WHEN c1 = 0 AND c0 < 0 THEN -1 ELSE 1 END)) - greatest(0, max(CASE WHEN c1 > 0 THEN -c0 / c1 ELSE 0 END))) AS part FROM cut GROUP BY w, h, i),
rim AS (SELECT w, h, px * vy - py * vx AS area2, CASE WHEN vx > 0 THEN (x1 - px) / vx WHEN vx < 0 THEN (x2 - px) / vx ELSE 0 END AS t1, CASE WHEN vx > 0 THEN (x2 - px) / vx WHEN vx < 0 THEN (x1 - px) / vx ELSE 1 END AS t2,
  CASE WHEN vy > 0 THEN (y1 - py) / vy WHEN vy < 0 THEN (y2 - py) / vy ELSE 0 END AS t3, CASE WHEN vy > 0 THEN (y2 - py) / vy WHEN vy < 0 THEN (y1 - py) / vy ELSE 1 END AS t4
  FROM (SELECT *, 0 AS x1, w AS x2, 0 AS y1, h / 2 AS y2 FROM arc UNION ALL SELECT *, 0, w / 2, h / 2, h FROM arc)),
common AS (SELECT w, h, sum(part) / 2 AS area FROM (SELECT w, h, part FROM shell UNION ALL SELECT w, h, area2 * greatest(0, least(1, t2, t4) - greatest(0, t1, t3)) FROM rim) GROUP BY w, h),
exchange AS (SELECT w, h, 1 - common.area / (r * r * 128 * sin(2 * pi() / 256)) AS exchange_index FROM common JOIN g USING (w, h))"""


@query(f"""WITH {VTX}, {_EXCHANGE},
rad AS (SELECT building_id, area, x - cx AS dx, y - cy AS dy, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM vtx JOIN shape USING (building_id)),
tot AS (SELECT *, sum(d) OVER (PARTITION BY building_id) AS total, count(*) OVER (PARTITION BY building_id) AS n FROM rad),
stat AS (SELECT building_id, avg(d) AS mean_radius, sqrt(any_value(area) / pi()) / max(d) AS max_circularity, sum(abs(100 * d / total - 100.0::DOUBLE / n)) AS bci, sum(dx * dy) AS cross_moment_mu11, (sum(dx * dx) + sum(dy * dy)) / count(*) AS variance_spreading FROM tot GROUP BY building_id),
turn AS (SELECT building_id, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len, CASE WHEN atan2(y2 - y, x2 - x) < 0 THEN atan2(y2 - y, x2 - x) + pi() ELSE atan2(y2 - y, x2 - x) END AS a FROM side),
lean AS (SELECT building_id, sum(len * CASE WHEN a >= pi() THEN 0 ELSE a END) / sum(len) AS weighted_orientation FROM turn GROUP BY building_id),
hullv AS (SELECT building_id, i, x, y FROM vtx WHERE i <> 3),
hs AS (SELECT *, coalesce(lead(x) OVER v, first_value(x) OVER v) AS x2, coalesce(lead(y) OVER v, first_value(y) OVER v) AS y2 FROM hullv WINDOW v AS (PARTITION BY building_id ORDER BY i)),
ext AS (SELECT d.building_id, d.i, any_value(t) AS t, max(cos(t) * x + sin(t) * y) - min(cos(t) * x + sin(t) * y) AS u, max(-sin(t) * x + cos(t) * y) - min(-sin(t) * x + cos(t) * y) AS v FROM (SELECT building_id, i, atan2(y2 - y, x2 - x) AS t FROM hs) d JOIN hullv p ON p.building_id = d.building_id GROUP BY d.building_id, d.i),
box AS (SELECT building_id, arg_min({{'t': CASE WHEN u >= v THEN t ELSE t + pi() / 2 END, 'e': greatest(u, v) / least(u, v)}}, {{'a': round(u * v, 9), 'i': i}}) AS m FROM ext GROUP BY building_id),
chord AS (SELECT building_id, sqrt(w * w + h * h) AS c, atan2(h, -w) AS a FROM bld),
across AS (SELECT building_id, any_value(c) AS c, any_value(a) AS a, (max(-sin(a) * x + cos(a) * y) - min(-sin(a) * x + cos(a) * y)) / any_value(c) AS ellipticity FROM vtx JOIN chord USING (building_id) GROUP BY building_id)
SELECT building_id, block_id, round(area, 6) AS area, round(perimeter, 6) AS perimeter, round(c, 6) AS longest_chord, round(mean_radius, 6) AS mean_radius, 1.0::DOUBLE AS covered_area_ratio,
  round(CASE WHEN m.t - pi() * floor(m.t / pi()) >= pi() THEN 0 ELSE m.t - pi() * floor(m.t / pi()) END, 6) AS sbro, round(across.a, 6) AS lco, round(pi() / 4, 6) AS bisector_orientation, round(weighted_orientation, 6) AS weighted_orientation,
  round(perimeter / area, 6) AS complexity_index, round(4 * pi() * area / (perimeter * perimeter), 6) AS ipq, round(1 - ln(area) / (2 * ln(perimeter)), 6) AS fractality, round(max_circularity, 6) AS max_circularity, round(4 * area / (pi() * c * c), 6) AS gibbs_compactness,
  round(m.e, 6) AS elongation_index, round(ellipticity, 6) AS ellipticity, round(area / (w * h * 7 / 8), 6) AS solidity, round(4 * area / (pi() * c * c), 6) AS dcm, round(exchange_index, 6) AS exchange_index, round(bci, 6) AS bci, round(cross_moment_mu11, 6) AS cross_moment_mu11, round(variance_spreading, 6) AS variance_spreading
FROM shape JOIN bld USING (building_id, block_id) JOIN stat USING (building_id) JOIN lean USING (building_id) JOIN box USING (building_id) JOIN across USING (building_id) JOIN exchange USING (w, h)""")
def building_feature_matrix(spark, sf_dir):
    """All 22 features of every building; for an L-shape many have closed forms, and the SQL states each on its own."""
    out = shapes.building_features(buildings(spark, sf_dir), ["building_id", "block_id"])
    return rounded(out, *shapes.FEATURES)


@query(f"""WITH {BLD} SELECT building_id, round(-5 * w / 12, 6) AS minx, round(-5 * h / 12, 6) AS miny, round(7 * w / 12, 6) AS maxx, round(7 * h / 12, 6) AS maxy, round(0.75 * w * h, 6) AS area FROM bld""")
def moved_to_origin(spark, sf_dir):
    """Footprints moved to their own centroid, with the box that they then have: the gallery of samples."""
    b = buildings(spark, sf_dir).select("building_id", g.translate_to_origin(F.col("parts")).alias("parts"))
    box = g.bounds(F.col("parts"))
    return b.select("building_id", *[F.round(box[c], 6).alias(c) for c in ("minx", "miny", "maxx", "maxy")], F.round(g.area(F.col("parts")), 6).alias("area"))
