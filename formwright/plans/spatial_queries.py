"""Spatial joins, merging and layer preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from formwright.functions import geometry as g
from formwright.operators import cleaning, components, neighbours, shapes, spatial

from formwright.sources import tables

from .registry import query
from .standins import BLD, SIDE, buildings, parcels, read


def anchors(spark, sf_dir, placed=False):
    return buildings(spark, sf_dir, placed).select("building_id", "block_id", F.col("x0").alias("x"), F.col("y0").alias("y"))


_PLACED = f"""{BLD}, pts AS (SELECT building_id, x0 + {SIDE} * (block_id % 5) - CASE WHEN building_id % 37 = 0 THEN 5000 ELSE 0 END + w / 2.4 AS x, y0 + {SIDE} * (block_id // 5) + h / 2.4 AS y FROM bld)"""


@query(f"""WITH {_PLACED} SELECT building_id, n_nationkey::BIGINT AS block_id FROM pts JOIN nation
  ON x > {SIDE} * (n_nationkey % 5) AND x < {SIDE} * (n_nationkey % 5 + 1) AND y > {SIDE} * (n_nationkey // 5) AND y < {SIDE} * (n_nationkey // 5 + 1)""")
def point_in_parcel(spark, sf_dir):
    """Each building point's parcel; unmatched points drop."""
    key = F.col("c_custkey").cast("long")
    w, h = (6 + key % 17).cast("double"), (5 + key % 11).cast("double")
    b = buildings(spark, sf_dir, placed=True).join(read(spark, sf_dir, "customer").select(key.alias("building_id"), w.alias("w"), h.alias("h")), "building_id")
    pts = b.select("building_id", (F.col("x0") - F.when(F.col("building_id") % 37 == 0, 5000).otherwise(0) + F.col("w") / 2.4).alias("x"), (F.col("y0") + F.col("h") / 2.4).alias("y"))
    return spatial.points_within(pts, parcels(spark, sf_dir), "building_id", "block_id", SIDE)


@query(f"""WITH {BLD} SELECT a.block_id, a.building_id AS a, b.building_id AS b, round(sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0)), 6) AS dist
FROM bld a JOIN bld b ON a.block_id = b.block_id AND a.building_id < b.building_id WHERE (a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0) <= 3600""")
def dwithin_pairs(spark, sf_dir):
    """Pairs of one block no farther apart than 60."""
    out = spatial.pairs_within(anchors(spark, sf_dir), "building_id", 60.0, ["block_id"])
    return out.withColumn("dist", F.round("dist", 6))


_BOXES = f"""{BLD}, box AS (SELECT building_id, x0 + {SIDE} * (block_id % 5) AS lx, y0 + {SIDE} * (block_id // 5) AS ly, w, h FROM bld),
rect AS (SELECT building_id, lx, ly, lx + w AS hx, ly + h / 2 AS hy FROM box UNION ALL SELECT building_id, lx, ly, lx + w / 2, ly + h FROM box),
touch AS (SELECT DISTINCT p.building_id AS a, q.building_id AS b FROM rect p JOIN rect q ON p.building_id < q.building_id AND p.lx <= q.hx AND q.lx <= p.hx AND p.ly <= q.hy AND q.ly <= p.hy)"""


@query(f"WITH {_BOXES} SELECT a, b FROM touch")
def touching_buildings(spark, sf_dir):
    """Pairs of footprints that share a point; an L-shape is two boxes in the SQL."""
    return spatial.touching_pairs(buildings(spark, sf_dir, placed=True), "building_id")


_COURTYARD = "WITH k AS (SELECT s_suppkey::BIGINT AS k FROM supplier) SELECT 2 * k AS a, 2 * k + 1 AS b FROM k WHERE k % 4 {test} UNION ALL SELECT p.k * 2, q.k * 2 FROM k p JOIN k q ON q.k = p.k + 1 WHERE {next}"


def courtyards(spark, sf_dir):
    """For each supplier a square building around a courtyard of 80 by 80, 110 from the next, and a square inside the courtyard: free of it, at its wall, or reaching into it."""
    key = F.col("s_suppkey").cast("long")
    x, y = (key * 110).cast("double"), F.lit(0.0)
    square = lambda at, low, high: g.ring((at + low, y + low), (at + high, y + low), (at + high, y + high), (at + low, y + high))
    low = F.when(key % 4 == 0, 13.0).when(key % 4 == 1, 10.0).when(key % 4 == 2, 5.0).otherwise(25.0)
    rows = read(spark, sf_dir, "supplier").select(key.alias("k"), square(x, F.lit(0.0), F.lit(100.0)).alias("shell"), square(x, F.lit(10.0), F.lit(90.0)).alias("yard"), square(x, low, F.lit(40.0)).alias("inner"))
    around = rows.select((F.col("k") * 2).alias("building_id"), F.array(F.array("shell", "yard")).alias("parts"))
    return around.unionByName(rows.select((F.col("k") * 2 + 1).alias("building_id"), F.array(F.array("inner")).alias("parts")))


@query(_COURTYARD.format(test="IN (1, 2)", next="false"))
def touching_across_courtyards(spark, sf_dir):
    """Buildings in a courtyard touch the one around them only where they reach its wall."""
    return spatial.touching_pairs(courtyards(spark, sf_dir), "building_id")


@query(_COURTYARD.format(test="IN (0, 1, 2)", next="true"))
def close_across_courtyards(spark, sf_dir):
    """The same within a distance of 10: neighbours in the row, and what stands 3 from the wall of its courtyard, too."""
    return spatial.touching_pairs(courtyards(spark, sf_dir), "building_id", 10.0)


@query(f"""WITH RECURSIVE {_BOXES}, sym AS (SELECT a, b FROM touch UNION ALL SELECT b, a FROM touch),
reach AS (SELECT building_id AS node, building_id AS label FROM bld UNION SELECT s.b, r.label FROM reach r JOIN sym s ON s.a = r.node WHERE r.label < s.b)
SELECT node AS building_id, min(label) AS group_id FROM reach GROUP BY node""")
def merge_components(spark, sf_dir):
    """Groups of buildings that touch, directly or through others."""
    b = buildings(spark, sf_dir, placed=True)
    return components.connected(spatial.touching_links(b, "building_id"), b, "building_id")


@query(f"""WITH RECURSIVE {BLD}, sym AS (SELECT p.building_id AS a, q.building_id AS b FROM bld p JOIN bld q ON p.block_id = q.block_id AND p.building_id <> q.building_id AND (p.x0 - q.x0) * (p.x0 - q.x0) + (p.y0 - q.y0) * (p.y0 - q.y0) <= 1600),
reach AS (SELECT building_id AS node, building_id AS label FROM bld UNION SELECT s.b, r.label FROM reach r JOIN sym s ON s.a = r.node WHERE r.label < s.b),
grp AS (SELECT node AS building_id, min(label) AS group_id FROM reach GROUP BY node)
SELECT group_id, any_value(block_id) AS block_id, round(max(height), 6) AS height, string_agg(building_id::VARCHAR, '|' ORDER BY building_id) AS building_ids, count(*) AS n_buildings, min(building_id) AS first_id
FROM grp JOIN bld USING (building_id) GROUP BY group_id""")
def merge_close_buildings(spark, sf_dir):
    """Buildings of a block no farther apart than 40 become one: greatest height, ids joined in row order."""
    b = buildings(spark, sf_dir)
    links = neighbours.links(anchors(spark, sf_dir), "building_id", 40.0, ["block_id"])
    merged = cleaning.merge_attributes(b.drop("parts"), components.connected(links, b, "building_id"), "building_id")
    return merged.select("group_id", "block_id", F.round("height", 6).alias("height"), "building_ids", "n_buildings", "first_id")


@query(f"""WITH RECURSIVE {_BOXES}, sym AS (SELECT a, b FROM touch UNION ALL SELECT b, a FROM touch),
reach AS (SELECT building_id AS node, building_id AS label FROM bld UNION SELECT s.b, r.label FROM reach r JOIN sym s ON s.a = r.node WHERE r.label < s.b),
grp AS (SELECT node AS building_id, min(label) AS group_id FROM reach GROUP BY node),
r AS (SELECT group_id, 2 * lx AS x1, 2 * hx AS x2, 2 * ly AS y1, 2 * hy AS y2 FROM rect JOIN grp USING (building_id)),
cell AS (SELECT DISTINCT group_id, x, y FROM r, range(0, 60) AS i(dx), range(0, 40) AS j(dy), LATERAL (SELECT x1 + dx AS x, y1 + dy AS y) WHERE x1 + dx < x2 AND y1 + dy < y2)
SELECT group_id, round(count(*) / 4.0, 4)::DOUBLE AS area, round(avg(x + 0.5) / 2 + 1e-7, 4) AS cx, round(avg(y + 0.5) / 2 + 1e-7, 4) AS cy FROM cell GROUP BY group_id""")
def dissolved_groups(spark, sf_dir):
    """The union of each group of touching buildings, its area and centroid; the SQL counts quarter units."""
    b = buildings(spark, sf_dir, placed=True)
    groups = components.connected(spatial.touching_links(b, "building_id"), b, "building_id")
    out = cleaning.dissolve(b.select("building_id", "parts").join(groups, "building_id"), "group_id")
    return shapes.measured(out).select("group_id", F.round("area", 4).alias("area"), *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("cx", "cy")])


@query(f"""WITH {_BOXES}, x AS (SELECT building_id, h, w, greatest(0, least(w, 3000 - lx)) AS cw, lx, ly FROM box WHERE lx < 3000 AND ly < 3300)
SELECT building_id, round(least(w, cw) * h / 2 + least(w / 2, cw) * h / 2, 4) AS area FROM x""")
def clip_to_polygons(spark, sf_dir):
    """Footprints cut to two touching districts."""
    b = buildings(spark, sf_dir, placed=True)
    areas = spark.createDataFrame([("west", 0.0, 1500.0), ("east", 1500.0, 3000.0)], "name string, x0 double, x1 double")
    x0, x1, lo, hi = F.col("x0"), F.col("x1"), F.lit(-50.0), F.lit(3300.0)
    areas = areas.select(F.array(F.array(g.ring((x0, lo), (x1, lo), (x1, hi), (x0, hi)))).alias("parts"))
    out = cleaning.clip_to_areas(b, "building_id", areas, 500.0)
    return out.select("building_id", F.round(g.area(F.col("parts")), 4).alias("area"))


@query(f"""WITH {_BOXES}, x AS (SELECT building_id, least(w, greatest(0, 3000 - lx)) AS cw, w, h, lx FROM box WHERE lx < 3000 AND ly < 3300)
SELECT building_id, round(least(w, cw) * h / 2 + least(w / 2, cw) * h / 2, 6) AS area FROM x""")
def clip_to_district(spark, sf_dir):
    """Footprints cut to a district's box; boxes that cannot meet it never reach the cutting."""
    b = spatial.with_bounds(buildings(spark, sf_dir, placed=True)).where(spatial.in_box(-100.0, -100.0, 3000.0, 3300.0))
    b = b.where((F.col("minx") < 3000) & (F.col("miny") < 3300))
    out = spatial.clip_to_box(b, -100.0, -100.0, 3000.0, 4400.0)
    return out.select("building_id", F.round(g.area(F.col("parts")), 6).alias("area"))


@query(f"""WITH {BLD}, p AS (SELECT x0 + {SIDE} * (block_id % 5) AS lx, y0 + {SIDE} * (block_id // 5) AS ly, w, h FROM bld)
SELECT min(lx) - 20 AS minx, min(ly) - 20 AS miny, max(lx + w) + 20 AS maxx, max(ly + h) + 20 AS maxy FROM p""")
def layer_bounds(spark, sf_dir):
    """The padded box of a layer."""
    return spatial.total_bounds(buildings(spark, sf_dir, placed=True), 20.0)


@query("""SELECT n_nationkey::BIGINT AS block_id, n_regionkey::INT AS class_id, CASE WHEN n_nationkey % 11 = 0 THEN 1 WHEN n_nationkey % 11 IN (1, 2) THEN 2 WHEN n_nationkey % 11 = 3 THEN 3 WHEN n_nationkey % 11 IN (4, 5) THEN 4 ELSE 5 END AS level1 FROM nation""")
def class_recode(spark, sf_dir):
    """Eleven source classes to five; a class outside the map stops the run."""
    p = parcels(spark, sf_dir).withColumn("source_class", (F.col("block_id") % 11).cast("int"))
    return cleaning.recode(p, "source_class", cleaning.CLASS_RECODE, "level1").select("block_id", "class_id", F.col("level1").cast("int").alias("level1"))


@query("""SELECT DISTINCT n_regionkey::INT + 8 AS unmapped FROM nation WHERE n_regionkey + 8 NOT BETWEEN 0 AND 10""")
def recode_unmapped(spark, sf_dir):
    """Source classes that the map lacks."""
    p = parcels(spark, sf_dir).withColumn("source_class", (F.col("class_id") + 8).cast("int"))
    return cleaning.unmapped(p, "source_class", cleaning.CLASS_RECODE).select(F.col("source_class").alias("unmapped"))


@query("""WITH wanted(w) AS (VALUES ('NATION_7'), ('ION_12'), ('ATLANTIS'), (' NATION_3 '), ('NEW NATION_24 TOWN')), n AS (SELECT DISTINCT trim(n_name) AS name FROM nation),
exact AS (SELECT w, name FROM wanted JOIN n ON trim(w) = name), rest AS (SELECT w FROM wanted WHERE w NOT IN (SELECT w FROM exact)),
part AS (SELECT w, name FROM rest JOIN n ON contains(name, trim(w)) OR contains(trim(w), name)),
found AS (SELECT w, name, 'exact' AS kind FROM exact UNION ALL SELECT w, name, 'part' FROM part)
SELECT w AS wanted, name, coalesce(kind, 'missing') AS kind FROM wanted LEFT JOIN found USING (w)""")
def name_match(spark, sf_dir):
    """District names: exact, else either containing the other; names without a match are reported."""
    wanted = spark.createDataFrame([(x,) for x in ("NATION_7", "ION_12", "ATLANTIS", " NATION_3 ", "NEW NATION_24 TOWN")], "wanted string")
    return cleaning.match_names(wanted, parcels(spark, sf_dir).select("name").distinct())


@query("""SELECT n_nationkey::BIGINT AS block_id, tile FROM nation, (VALUES ('west', 0), ('east', 1)) AS t(tile, odd) WHERE n_nationkey % 2 = odd""")
def tile_union(spark, sf_dir):
    """Tiles of one layer read and put together by column name."""
    p = parcels(spark, sf_dir)
    west = p.where("block_id % 2 = 0").select("block_id", F.lit("west").alias("tile"))
    east = p.where("block_id % 2 = 1").select(F.lit("east").alias("tile"), "block_id")
    return west.unionByName(east)


@query(f"""WITH {BLD} SELECT count(*) AS n, round(sum(0.75 * w * h) / 1e6, 9) AS km2 FROM bld JOIN nation ON block_id = n_nationkey WHERE n_name IN ('NATION_3', 'NATION_7', 'NATION_12', 'NATION_20')""")
def selected_area(spark, sf_dir):
    """Total area of the buildings in selected districts, in square kilometres."""
    names = parcels(spark, sf_dir).where(F.col("name").isin("NATION_3", "NATION_7", "NATION_12", "NATION_20")).select("block_id")
    b = buildings(spark, sf_dir).join(names, "block_id", "left_semi")
    return b.agg(F.count("*").alias("n"), F.round(F.sum(g.area(F.col("parts"))) / 1e6, 9).alias("km2"))


@query(f"""WITH {BLD} SELECT building_id, round(CASE WHEN building_id % 10 = 0 THEN w * h / 2 ELSE 0.75 * w * h END, 5) AS area, CASE WHEN building_id % 10 = 0 THEN 2 ELSE 1 END AS n_parts FROM bld""")
def repaired_shapes(spark, sf_dir):
    """Every tenth footprint is a bow tie, which comes apart into its two halves."""
    b = buildings(spark, sf_dir)
    box = g.bounds(F.col("parts"))
    tie = F.array(F.array(g.ring((box.minx, box.miny), (box.maxx, box.maxy), (box.maxx, box.miny), (box.minx, box.maxy))))
    rows = b.select("building_id", F.when(F.col("building_id") % 10 == 0, tie).otherwise(F.col("parts")).alias("parts"))
    out = cleaning.repair(rows, ["building_id"])
    return out.select("building_id", F.round(g.area(F.col("parts")), 5).alias("area"), F.size("parts").alias("n_parts"))


@query("""SELECT n_nationkey::BIGINT AS block_id, n_name AS name FROM nation WHERE n_name IN ('NATION_3', 'NATION_7', 'NATION_20')""")
def district_selection(spark, sf_dir):
    """Parcels of the named districts, in whichever column holds the names."""
    names = ["NATION_3", "NATION_7", "NATION_20"]
    p = parcels(spark, sf_dir).withColumn("code", F.col("block_id").cast("string"))
    column = tables.column_with_values(p, ["code", "name", "district"], names)
    return p.where(F.trim(F.col(column)).isin(names)).select("block_id", F.col(column).alias("name"))


@query(f"WITH {BLD} SELECT block_id, count(*) AS n_buildings, round(max(height), 6) AS height FROM bld GROUP BY block_id HAVING count(*) >= 60")
def big_blocks(spark, sf_dir):
    """Blocks of at least sixty buildings, with their greatest height."""
    b = cleaning.big_enough(buildings(spark, sf_dir).drop("parts"), "block_id", 60)
    return b.groupBy("block_id").agg(F.count("*").alias("n_buildings"), F.round(F.max("height"), 6).alias("height"))
