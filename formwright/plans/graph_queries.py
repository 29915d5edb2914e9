"""Block graphs: triangulation, thresholds, cells, message passing."""

from __future__ import annotations

from pyspark.sql import functions as F

from formwright.config import Model
from formwright.operators import classifier, graphs, messages, neighbours

from .registry import query
from .standins import BLD, SIDE, buildings, parcels


def points(spark, sf_dir):
    return buildings(spark, sf_dir).select("block_id", F.col("building_id").alias("node"), F.col("x0").alias("x"), F.col("y0").alias("y"))


_EDGES = f"""{BLD}, pts AS (SELECT block_id, min(building_id) AS node, x0::BIGINT AS x, y0::BIGINT AS y FROM bld GROUP BY ALL),
tri AS (SELECT a.block_id, a.node AS p, b.node AS q, c.node AS r, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn
  FROM pts a JOIN pts b ON a.block_id = b.block_id AND a.node < b.node JOIN pts c ON c.block_id = b.block_id AND b.node < c.node WHERE (b.x - a.x) * (c.y - a.y) <> (b.y - a.y) * (c.x - a.x)),
del AS (SELECT t.* FROM tri t WHERE NOT EXISTS (SELECT 1 FROM pts d WHERE d.block_id = t.block_id AND d.node NOT IN (t.p, t.q, t.r) AND
  sign(t.turn) * (((ax-d.x)*(ax-d.x)+(ay-d.y)*(ay-d.y))*((bx-d.x)*(cy-d.y)-(cx-d.x)*(by_-d.y)) - ((bx-d.x)*(bx-d.x)+(by_-d.y)*(by_-d.y))*((ax-d.x)*(cy-d.y)-(cx-d.x)*(ay-d.y)) + ((cx-d.x)*(cx-d.x)+(cy-d.y)*(cy-d.y))*((ax-d.x)*(by_-d.y)-(bx-d.x)*(ay-d.y))) > 0)),
edge AS (SELECT DISTINCT block_id, a, b, sqrt(d2)::DOUBLE AS dist FROM (SELECT block_id, p AS a, q AS b, (ax-bx)*(ax-bx)+(ay-by_)*(ay-by_) AS d2 FROM del UNION ALL SELECT block_id, p, r, (ax-cx)*(ax-cx)+(ay-cy)*(ay-cy) FROM del UNION ALL SELECT block_id, q, r, (bx-cx)*(bx-cx)+(by_-cy)*(by_-cy) FROM del))"""


@query(f"WITH {_EDGES} SELECT block_id, a, b, round(dist, 6) AS dist FROM edge")
def delaunay_edges(spark, sf_dir):
    """Unique sides of each block's triangulation; the SQL tests every triple for an empty circle."""
    return graphs.delaunay_edges(points(spark, sf_dir)).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_EDGES}, e AS (SELECT * FROM edge WHERE dist <= 200) SELECT block_id, a AS src, b AS dst, round(dist, 6) AS dist FROM e UNION ALL SELECT block_id, b, a, round(dist, 6) FROM e")
def delaunay_edges_thresholded(spark, sf_dir):
    """Edges no longer than 200, both directions."""
    e = graphs.threshold(graphs.delaunay_edges(points(spark, sf_dir)), 200.0)
    return graphs.symmetric(e).withColumn("dist", F.round("dist", 6))


_PAIRS = f"""{BLD}, near AS (SELECT p.block_id, p.building_id AS a, q.building_id AS b, sqrt((p.x0 - q.x0) * (p.x0 - q.x0) + (p.y0 - q.y0) * (p.y0 - q.y0)) AS dist FROM bld p JOIN bld q
  ON p.block_id = q.block_id AND p.building_id < q.building_id WHERE (p.x0 - q.x0) * (p.x0 - q.x0) + (p.y0 - q.y0) * (p.y0 - q.y0) <= 14400)"""


#: Length up to which two buildings of a block have an edge.
NEAR = 120.0


def near(spark, sf_dir):
    return neighbours.pairs(points(spark, sf_dir), "node", NEAR, ["block_id"])


@query(f"WITH {_PAIRS} SELECT round(quantile_cont(dist, 0.95), 6) AS threshold FROM near")
def edge_quantile_threshold(spark, sf_dir):
    """The automatic threshold: the 95th percentile of all lengths."""
    return graphs.quantile_within(points(spark, sf_dir), "node", NEAR, ["block_id"], 0.95, 200.0).select(F.round("threshold", 6).alias("threshold"))


@query(f"""WITH {_PAIRS}, s AS (SELECT min(dist) AS lo, max(dist) AS hi, (max(dist) - min(dist)) / 100 AS w FROM near),
c AS (SELECT least(floor((dist - lo) / w), 99)::INT AS bin, count(*) AS n FROM near, s GROUP BY bin)
SELECT bin::INT AS bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, coalesce(n, 0)::BIGINT AS n FROM range(100) AS t(bin) CROSS JOIN s LEFT JOIN c USING (bin)""")
def edge_histogram(spark, sf_dir):
    """A hundred equal-width bins of edge lengths."""
    return graphs.histogram_within(points(spark, sf_dir), "node", NEAR, ["block_id"]).withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query(f"""WITH {_PAIRS}, n AS (SELECT block_id, count(*) AS num_nodes FROM bld GROUP BY block_id HAVING count(*) >= 4), e AS (SELECT block_id, count(*) AS num_edges FROM near GROUP BY block_id)
SELECT block_id, num_nodes, num_edges, n_regionkey::INT AS label, r_name AS label_name FROM n JOIN e USING (block_id) JOIN nation ON block_id = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def block_stats(spark, sf_dir):
    """Nodes, edges and label of each block."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("int").alias("label"), F.col("r_name").alias("label_name"))
    labels = parcels(spark, sf_dir).select("block_id", F.col("class_id").alias("label")).join(regions, "label")
    nodes = graphs.node_table(buildings(spark, sf_dir).drop("parts"))
    edges = neighbours.pair_counts(points(spark, sf_dir), "node", NEAR, ["block_id"])
    return graphs.counted_stats(nodes, edges.withColumnRenamed("n", "num_edges"), labels).select("block_id", "num_nodes", "num_edges", "label", "label_name")


@query(f"""WITH {BLD}, r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY building_id) - 1 AS k, count(*) OVER (PARTITION BY block_id) AS n FROM bld)
SELECT block_id, k::INT AS node_idx, building_id FROM r WHERE n >= 4""")
def graph_nodes(spark, sf_dir):
    """Nodes of the graphs: blocks of at least four buildings, numbered in row order."""
    return graphs.node_table(buildings(spark, sf_dir).drop("parts")).select("block_id", F.col("node_idx").cast("int").alias("node_idx"), "building_id")


@query(f"WITH {_PAIRS} SELECT block_id, a, b, round(1 / (dist + 1e-6), 6) AS inverse, round(dist, 6) AS raw FROM near")
def edge_weights(spark, sf_dir):
    """Edge weights by distance."""
    e = near(spark, sf_dir)
    return graphs.edge_weights(e, "inverse").select("block_id", "a", "b", neighbours.rounded(F.col("weight"), 6).alias("inverse"), neighbours.rounded(F.col("dist"), 6).alias("raw"))


def _block_centres(spark, sf_dir):
    """A point for every building in its block's cell."""
    return points(spark, sf_dir).select("block_id", "node", (F.col("x") + SIDE * (F.col("block_id") % 5)).alias("x"), (F.col("y") + SIDE * F.floor(F.col("block_id") / 5)).alias("y"))


@query(f"""WITH {_EDGES}, p AS (SELECT block_id, node, x::DOUBLE + {SIDE} * (block_id % 5) AS x, y::DOUBLE + {SIDE} * (block_id // 5) AS y FROM pts),
near AS (SELECT block_id, a AS i, b AS j FROM edge UNION ALL SELECT block_id, b, a FROM edge),
box AS (SELECT block_id, node, unnest([0, 1, 2, 3]) AS k, {SIDE} * (block_id % 5) AS x0, {SIDE} * (block_id // 5) AS y0 FROM p),
line AS (SELECT i, q.x - p.x AS nx, q.y - p.y AS ny, (q.x * q.x + q.y * q.y - p.x * p.x - p.y * p.y) / 2 AS c FROM near JOIN p ON p.node = i JOIN p q ON q.node = j
  UNION ALL SELECT node, [-1, 1, 0, 0][k + 1], [0, 0, -1, 1][k + 1], [-x0, x0 + {SIDE}, -y0, y0 + {SIDE}][k + 1] FROM box),
meet AS (SELECT a.i, a.nx, a.ny, a.c, -a.ny AS dx, a.nx AS dy, a.c * a.nx / (a.nx * a.nx + a.ny * a.ny) AS px, a.c * a.ny / (a.nx * a.nx + a.ny * a.ny) AS py, b.nx AS mx, b.ny AS my, b.c AS d FROM line a JOIN line b ON a.i = b.i AND (a.nx, a.ny, a.c) <> (b.nx, b.ny, b.c)),
span AS (SELECT i, nx, ny, c, px * dy - py * dx AS area2, max(CASE WHEN mx * dx + my * dy < -1e-12 THEN (d - mx * px - my * py) / (mx * dx + my * dy) ELSE -1e18 END) AS lo,
  min(CASE WHEN mx * dx + my * dy > 1e-12 THEN (d - mx * px - my * py) / (mx * dx + my * dy) WHEN abs(mx * dx + my * dy) <= 1e-12 AND d - mx * px - my * py < -1e-9 THEN -1e19 ELSE 1e18 END) AS hi
  FROM meet GROUP BY i, nx, ny, c, px, py, dx, dy),
cell AS (SELECT i AS node, sum(CASE WHEN hi > lo THEN area2 * (hi - lo) ELSE 0 END) / 2 AS area FROM span GROUP BY i),
same AS (SELECT block_id, x0, y0, count(*) AS n, min(building_id) AS node FROM bld GROUP BY ALL), few AS (SELECT block_id, count(*) AS n FROM same GROUP BY block_id)
SELECT b.block_id, b.building_id AS node, round(CASE WHEN few.n < 4 THEN {SIDE * SIDE}::DOUBLE / few.n ELSE cell.area END / same.n, 3) AS cell_area
FROM bld b JOIN same ON same.block_id = b.block_id AND same.x0 = b.x0 AND same.y0 = b.y0 JOIN few ON few.block_id = b.block_id LEFT JOIN cell ON cell.node = same.node""")
def voronoi_cover(spark, sf_dir):
    """The cell of each building in its parcel; the SQL measures every cell from the spans of its own border lines."""
    cells = graphs.voronoi_cells(_block_centres(spark, sf_dir), parcels(spark, sf_dir))
    return cells.select("block_id", "node", F.round("cell_area", 3).alias("cell_area"))


_X = f"""{_PAIRS}, feat AS (SELECT block_id, building_id AS node, ((building_id * 31) % 17)::DOUBLE / 16 AS f0, ((building_id * 7) % 13)::DOUBLE / 12 AS f1 FROM bld),
both_ AS (SELECT block_id, a AS src, b AS dst FROM near UNION ALL SELECT block_id, b, a FROM near UNION ALL SELECT block_id, node, node FROM feat),
deg AS (SELECT dst AS node, count(*)::DOUBLE AS d FROM both_ GROUP BY dst)"""


def _features(spark, sf_dir):
    n = F.col("node")
    return points(spark, sf_dir).select("block_id", "node", F.col("x").alias("px"), F.col("y").alias("py"), F.array(((n * 31) % 17).cast("double") / 16, ((n * 7) % 13).cast("double") / 12).alias("x"))


@query(f"""WITH {_X}, agg AS (SELECT e.dst AS node, sum(f0 / sqrt(s.d * t.d)) AS g0, sum(f1 / sqrt(s.d * t.d)) AS g1 FROM both_ e JOIN feat f ON f.node = e.src JOIN deg s ON s.node = e.src JOIN deg t ON t.node = e.dst GROUP BY e.dst)
SELECT node, round(greatest(0.5 * g0 - 0.25 * g1 + 0.1, 0), 6) AS h0, round(greatest(g0 + 0.75 * g1 - 0.2, 0), 6) AS h1, round(greatest(-0.5 * g0 + g1, 0), 6) AS h2 FROM agg""")
def gcn_layer(spark, sf_dir):
    """One graph convolution with fixed weights, as joins and sums."""
    out = messages.gcn_layer_within(_features(spark, sf_dir), NEAR, [[0.5, 1.0, -0.5], [-0.25, 0.75, 1.0]], [0.1, -0.2, 0.0])
    return out.select("node", *[F.round(F.greatest(F.col("h")[i], F.lit(0.0)), 6).alias(f"h{i}") for i in range(3)])


@query(f"""WITH {_X}, s AS (SELECT block_id, node, tanh(f0 - f1) AS score, row_number() OVER (PARTITION BY block_id ORDER BY f0 - f1 DESC, node) AS k, count(*) OVER (PARTITION BY block_id) AS n FROM feat)
SELECT block_id, node, round(score, 6) AS score FROM s WHERE k <= ceil(0.3 * n)""")
def sagpool_topk(spark, sf_dir):
    """The 0.3 share of each graph's nodes with the best scores, rounded up."""
    x = _features(spark, sf_dir).withColumn("score", F.col("x")[0] - F.col("x")[1])
    return messages.top_share(x, 0.3).select("block_id", "node", F.round(F.tanh("score"), 6).alias("score"))


@query(f"""WITH {_X}, keep AS (SELECT node FROM (SELECT node, row_number() OVER (PARTITION BY block_id ORDER BY f0 - f1 DESC, node) AS k, count(*) OVER (PARTITION BY block_id) AS n FROM feat) WHERE k <= ceil(0.3 * n))
SELECT block_id, a AS src, b AS dst FROM near WHERE a IN (FROM keep) AND b IN (FROM keep)""")
def induced_edges(spark, sf_dir):
    """Edges between the nodes that a pooling keeps."""
    x = _features(spark, sf_dir).withColumn("score", F.col("x")[0] - F.col("x")[1])
    e = near(spark, sf_dir).select("block_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    return messages.induced(e, messages.top_share(x, 0.3))


@query(f"""WITH {_X} SELECT block_id, round(avg(f0), 6) AS mean0, round(avg(f1), 6) AS mean1, round(max(f0), 6) AS max0, round(max(f1), 6) AS max1 FROM feat GROUP BY block_id""")
def readout(spark, sf_dir):
    """Mean and greatest of each feature over a graph's nodes, side by side."""
    out = messages.readout(_features(spark, sf_dir), 2)
    return out.select("block_id", *[F.round(F.col("out")[i], 6).alias(n) for i, n in enumerate(("mean0", "mean1", "max0", "max1"))])


@query(f"WITH {_X}, d AS (SELECT dst AS node, src, block_id FROM both_ WHERE src <> dst) SELECT block_id, node, array_to_string(list_sort(list(src)), ',') AS neighbours FROM d GROUP BY block_id, node")
def adjacency(spark, sf_dir):
    """Neighbour lists of nodes, ascending."""
    return neighbours.listed(points(spark, sf_dir), "node", NEAR, ["block_id"])


#: A small network with fixed weights, drawn by a rule.
_SMALL = Model(hidden_dim=2, output_dim=2)
_WEIGHTS, _STATS = classifier.start(2, _SMALL, seed=7)
_WEIGHTS = {n: v + 0.05 * (len(n) % 3 + 1) * (1 if v.ndim == 1 else 0) for n, v in _WEIGHTS.items()}
_STATS = {n: v + (0.1 if n.endswith("mean") else 0.5) for n, v in _STATS.items()}


def _forward_sql() -> str:
    """The network of _SMALL and its weights in SQL, one column for each of a node's two numbers."""
    num = lambda name, *at: f"({float(_WEIGHTS[name][at] if name in _WEIGHTS else _STATS[name][at])!r})::FLOAT::DOUBLE"
    dot = lambda columns, name, j: " + ".join(f"{c} * {num(name, i, j)}" for i, c in enumerate(columns))
    norm = lambda e, name, j: f"greatest(0, (({e}) - {num(name + '_mean', j)}) / sqrt({num(name + '_var', j)} + 1e-5) * {num(name + '_g', j)} + {num(name + '_b', j)})"
    sql = f"WITH {_X}, n0 AS (SELECT block_id, node, f0 AS x0, f1 AS x1 FROM feat), e0 AS (SELECT block_id, a AS src, b AS dst FROM near UNION ALL SELECT block_id, b, a FROM near)"
    for k in range(3):
        pair = ", ".join(f"{norm(dot(('a0', 'a1'), f'gcn{k}_w', j) + f' + {num(f"gcn{k}_b", j)}', f'bn{k}', j)} AS h{j}" for j in (0, 1))
        sql += f""", l{k} AS (SELECT block_id, src, dst FROM e{k} UNION ALL SELECT block_id, node, node FROM n{k}), d{k} AS (SELECT dst AS node, count(*)::DOUBLE AS d FROM l{k} GROUP BY dst),
g{k} AS (SELECT l.block_id, l.dst AS node, sum(x0 / sqrt(s.d * t.d)) AS a0, sum(x1 / sqrt(s.d * t.d)) AS a1 FROM l{k} l JOIN n{k} n ON n.node = l.src JOIN d{k} s ON s.node = l.src JOIN d{k} t ON t.node = l.dst GROUP BY l.block_id, l.dst),
h{k} AS (SELECT block_id, node, {pair} FROM g{k}), q{k} AS (SELECT e.dst AS node, sum(h0) AS q0, sum(h1) AS q1 FROM e{k} e JOIN h{k} h ON h.node = e.src GROUP BY e.dst),
s{k} AS (SELECT h.*, {dot(('h0', 'h1'), f'pool{k}_root', 0)} + {dot(('coalesce(q0, 0)', 'coalesce(q1, 0)'), f'pool{k}_near', 0)} + {num(f'pool{k}_b', 0)} AS score FROM h{k} h LEFT JOIN q{k} USING (node)),
r{k} AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY score DESC, node) AS place, count(*) OVER (PARTITION BY block_id) AS n FROM s{k}),
n{k + 1} AS (SELECT block_id, node, h0 * tanh(score) AS x0, h1 * tanh(score) AS x1 FROM r{k} WHERE place <= ceil({_SMALL.pool_ratio} * n)), e{k + 1} AS (SELECT * FROM e{k} WHERE src IN (SELECT node FROM n{k + 1}) AND dst IN (SELECT node FROM n{k + 1})),
o{k} AS (SELECT block_id, avg(x0) AS o{4 * k}, avg(x1) AS o{4 * k + 1}, max(x0) AS o{4 * k + 2}, max(x1) AS o{4 * k + 3} FROM n{k + 1} GROUP BY block_id)"""
    z = [f"o{i}" for i in range(12)]
    sql += ", z0 AS (SELECT block_id, " + ", ".join(f"{dot(z, 'jk_w', j)} + {num('jk_b', j)} AS z{j}" for j in range(4)) + " FROM o0 JOIN o1 USING (block_id) JOIN o2 USING (block_id))"
    for k, wide in enumerate((2, 1)):
        columns = [f"z{i}" for i in range(4 if k == 0 else 2)]
        sql += f", z{k + 1} AS (SELECT block_id, " + ", ".join(f"{norm(dot(columns, f'fc{k}_w', j) + f' + {num(f"fc{k}_b", j)}', f'hbn{k}', j)} AS z{j}" for j in range(wide)) + f" FROM z{k})"
    return sql + " SELECT block_id, " + ", ".join(f"round({dot(['z0'], 'out_w', j)} + {num('out_b', j)}, 6) AS logit{j}" for j in (0, 1)) + " FROM z2"


@query(_forward_sql())
def graph_forward(spark, sf_dir):
    """The whole network over every block's graph, with fixed weights, as joins and sums."""
    out = messages.forward_within(_features(spark, sf_dir), NEAR, classifier.parameter_table(spark, _WEIGHTS), classifier.parameter_table(spark, _STATS), _SMALL)
    return out.select("block_id", *[F.round(F.col("logits")[j], 6).alias(f"logit{j}") for j in (0, 1)])
