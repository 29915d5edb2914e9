"""Types, importances and parcel labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from formwright.config import CLASS_NAMES, Clustering
from formwright.operators import clustering as cl
from formwright.operators import explaining as ex
from formwright.operators import parcel_types as pt
from formwright.operators import spatial

from .registry import query
from .standins import BLD, VTX, buildings, parcels, read
from .stats_queries import COLS, metrics

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


def vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query(f"""WITH {_E}, d AS (SELECT vec_id, unnest(range(64)) AS i, unnest(x) AS v, label FROM e), c AS (SELECT label, i, round(avg(v), 6) AS v FROM d GROUP BY ALL),
m AS (SELECT label, list(v ORDER BY i) AS m FROM c GROUP BY label), q AS (SELECT vec_id, label, list_distance(x, m) AS dist FROM (SELECT vec_id, x FROM e) JOIN m ON TRUE)
SELECT vec_id, arg_min(label, dist)::INT AS nearest, round(min(dist), 6) AS dist FROM q GROUP BY vec_id""")
def kmeans_assign(spark, sf_dir):
    """The nearest of given centres (the means of the ten labels)."""
    v = vectors(spark, sf_dir)
    centres = [r.m for r in v.groupBy("label").agg(F.array(*[F.round(F.avg(F.col("x")[i]), 6) for i in range(64)]).alias("m")).orderBy("label").collect()]  # ten labels
    return spatial.nearest(v, ["vec_id"], F.col("x"), centres).withColumn("dist", F.round("dist", 6))


_SIL = """p AS (SELECT a.vec_id, {l1} AS own, {l2} AS other, a.vec_id = b.vec_id AS self, list_distance(a.x, b.x) AS d FROM e a JOIN e b ON TRUE),
g AS (SELECT vec_id, own, other, sum(d) AS s, count(*) AS n FROM p GROUP BY ALL),
h AS (SELECT vec_id, sum(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b, sum(CASE WHEN own = other THEN n END) AS size FROM g GROUP BY vec_id)"""


@query(f"WITH {_E}, {_SIL.format(l1='a.label', l2='b.label')} SELECT 'label' AS name, round(avg(CASE WHEN size = 1 THEN 1 ELSE (b - a) / greatest(a, b) END), 6) AS score FROM h")
def silhouette(spark, sf_dir):
    """Mean Euclidean silhouette of the given labels."""
    return cl.silhouettes(vectors(spark, sf_dir), "vec_id", "x", ["label"]).withColumn("score", F.round("score", 6))


def _sil(k):
    return f"SELECT {k} AS k, (SELECT round(avg(CASE WHEN size = 1 THEN 1 ELSE (b - a) / greatest(a, b) END), 6) FROM (WITH {_SIL.format(l1=f'a.label % {k}', l2=f'b.label % {k}')} SELECT * FROM h)) AS score"


@query(f"WITH {_E}, s AS ({' UNION ALL '.join(map(_sil, (2, 3, 4, 5)))}) SELECT k::INT AS k, score FROM s ORDER BY score DESC, k LIMIT 1")
def best_k(spark, sf_dir):
    """The K of the best silhouette, the smallest of equals."""
    ks = (2, 3, 4, 5)
    v = vectors(spark, sf_dir).withColumns({f"k{k}": F.col("label") % k for k in ks})
    s = cl.silhouettes(v, "vec_id", "x", [f"k{k}" for k in ks]).select(F.substring("name", 2, 1).cast("int").alias("k"), F.round("score", 6).alias("score"))
    return cl.best_k(s)


@query()
def k_search(spark, sf_dir):
    """Embed by principal components, find clusters for each K, score them in feature space."""
    v = vectors(spark, sf_dir)
    mean, components = cl.pca(v, "x", 64)
    from formwright.operators.components import stored

    e = stored(v.select("vec_id", "x", cl.project(F.col("x"), mean, components).alias("e")), "embedded")
    c = Clustering()
    out = cl.search_k(e, "vec_id", "e", "x", range(c.min_k, c.max_k + 1), most=c.k_search_max_samples)
    return out.select("k", F.round("score", 4).alias("score"), F.round("largest_frac", 4).alias("largest_frac"))


@query(f"""WITH {_E}, d AS (SELECT vec_id, x[1] - avg(x[1]) OVER () AS a, x[2] - avg(x[2]) OVER () AS b FROM e), c AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM d),
l AS (SELECT *, (aa + bb) / 2 + sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS top FROM c), u AS (SELECT ab / sqrt(ab * ab + (top - aa) * (top - aa)) AS vx, (top - aa) / sqrt(ab * ab + (top - aa) * (top - aa)) AS vy FROM l)
SELECT vec_id, round((a * vx + b * vy) * sign(CASE WHEN abs(vx) >= abs(vy) THEN vx ELSE vy END), 6) AS score FROM d, u""")
def pca_scores(spark, sf_dir):
    """Scores on the first principal component of two features, centred."""
    v = vectors(spark, sf_dir).withColumn("x", F.slice("x", 1, 2))
    mean, components = cl.pca(v, "x", 2, 1)
    return v.select("vec_id", F.round(cl.project(F.col("x"), mean, components)[0], 6).alias("score"))


_T = f"{VTX}, t AS (SELECT building_id, block_id, building_id % 5 + 1 AS kind, area, perimeter, perimeter / area AS complexity_index FROM shape)"
_Z = f"""{_T}, z AS (SELECT kind, (area - avg(area) OVER ()) / stddev_samp(area) OVER () AS a, (perimeter - avg(perimeter) OVER ()) / stddev_samp(perimeter) OVER () AS p, (complexity_index - avg(complexity_index) OVER ()) / stddev_samp(complexity_index) OVER () AS c FROM t),
zm AS (SELECT kind, unnest([0, 1, 2]) AS position, unnest(['area', 'perimeter', 'complexity_index']) AS feature, unnest([avg(a), avg(p), avg(c)]) AS z FROM z GROUP BY kind)"""


def typed(spark, sf_dir):
    return metrics(spark, sf_dir).withColumn("kind", F.col("building_id") % 5 + 1)


@query(f"WITH {_Z} SELECT kind, feature, round(z, 6) AS z FROM zm")
def type_zmeans(spark, sf_dir):
    """Mean z-score of each feature in each type."""
    return cl.type_zmeans(typed(spark, sf_dir), "kind", COLS).select("kind", "feature", F.round("z", 6).alias("z"))


@query(f"""WITH {_Z}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(z) DESC, position) AS k FROM zm)
SELECT kind, 'T' || kind || ': ' || string_agg(CASE WHEN z >= 0 THEN 'High-' ELSE 'Low-' END || feature, '/' ORDER BY k) AS name FROM r WHERE k <= 2 GROUP BY kind""")
def type_zmean_names(spark, sf_dir):
    """Names of types by their two most unusual features."""
    return cl.type_names(cl.type_zmeans(typed(spark, sf_dir), "kind", COLS), "kind", 2)


@query(f"""WITH {_Z}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(z) DESC, position) AS k FROM zm), f AS (SELECT feature, min(kind * 100 + k) AS first FROM r WHERE k <= 2 GROUP BY feature)
SELECT row_number() OVER (ORDER BY first)::INT AS position, feature FROM f""")
def core_feature_set(spark, sf_dir):
    """Features that mark any type, in order."""
    return cl.core_features(cl.type_zmeans(typed(spark, sf_dir), "kind", COLS), "kind", 2)


@query("""WITH v AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), m AS (SELECT label, avg(a) AS ma, avg(b) AS mb FROM v GROUP BY label),
d AS (SELECT label, vec_id, sqrt((a - ma) * (a - ma) + (b - mb) * (b - mb)) AS dist FROM v JOIN m USING (label))
SELECT label, vec_id, round(dist, 6) AS dist, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rank FROM d) WHERE rank <= 30""")
def representatives(spark, sf_dir):
    """The thirty rows of each type nearest to its mean in the embedding."""
    out = cl.representatives(vectors(spark, sf_dir), "label", F.slice("x", 1, 2), 2, "vec_id", 30)
    return out.withColumn("dist", F.round("dist", 6))


@query(f"""WITH {_T} SELECT n_regionkey::INT AS class_id, {', '.join(f'round(count(*) FILTER (kind = {k})::DOUBLE / count(*), 6) AS kind_{k}' for k in range(1, 6))} FROM t JOIN nation ON block_id = n_nationkey GROUP BY n_regionkey""")
def class_type_crosstab(spark, sf_dir):
    """Shares of types in each functional class."""
    t = typed(spark, sf_dir).join(parcels(spark, sf_dir).select("block_id", "class_id"), "block_id")
    out = cl.crosstab(t, "class_id", "kind", [1, 2, 3, 4, 5])
    return out.select("class_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(f"""WITH {_T}, s AS (SELECT min(area) AS a0, max(area) AS a1, min(perimeter) AS p0, max(perimeter) AS p1, min(complexity_index) AS c0, max(complexity_index) AS c1 FROM t)
SELECT kind, round(avg((area - a0) / (a1 - a0)), 6) AS area, round(avg((perimeter - p0) / (p1 - p0)), 6) AS perimeter, round(avg((complexity_index - c0) / (c1 - c0)), 6) AS complexity_index FROM t, s GROUP BY kind""")
def minmax_profile(spark, sf_dir):
    """Radar profile of types."""
    out = cl.minmax_profile(typed(spark, sf_dir), "kind", COLS)
    return out.select("kind", *[F.round(c, 6).alias(c) for c in COLS])


@query(f"""WITH {_T}, c AS (SELECT kind, count(*) AS n FROM t GROUP BY kind) SELECT max(n) AS largest, round(max(n)::DOUBLE / sum(n), 9) AS largest_frac FROM c""")
def largest_cluster(spark, sf_dir):
    """Size and share of the largest type."""
    c = typed(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    return c.agg(F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 9).alias("largest_frac"))


@query("""WITH g AS (SELECT label AS k, max(embedding[1])::DOUBLE AS score, (label % 4)::DOUBLE * 0.31 AS largest_frac FROM embeddings GROUP BY label) SELECT k, round(score, 6) AS score, round(largest_frac, 6) AS largest_frac FROM g ORDER BY largest_frac < 0.90 DESC, score DESC LIMIT 1""")
def guarded_grid(spark, sf_dir):
    """The best row of a grid whose largest cluster doesn't hold nearly all rows."""
    v = vectors(spark, sf_dir).groupBy(F.col("label").alias("k")).agg(F.max(F.col("x")[0]).alias("score"))
    grid = v.withColumn("largest_frac", (F.col("k") % 4) * F.lit(0.31))
    return cl.guarded_best(grid).withColumns({c: F.round(c, 6) for c in ("score", "largest_frac")})


_W = f"{BLD}, w AS (SELECT building_id, block_id, CASE WHEN (building_id * 31) % 10 < 4 + block_id % 4 THEN 1 + block_id % 3 ELSE 1 + building_id % 7 END AS kind, n_regionkey + 1 AS level FROM bld JOIN nation ON block_id = n_nationkey)"


@query(f"""WITH {_W}, c AS (SELECT block_id, kind, count(*) AS n, min(building_id) AS first, any_value(level) AS level FROM w GROUP BY block_id, kind),
r AS (SELECT *, sum(n) OVER (PARTITION BY block_id) AS total, row_number() OVER (PARTITION BY block_id ORDER BY n DESC, first) AS k FROM c)
SELECT block_id, (level::INT || '.0') AS level1, total::BIGINT AS num_buildings, kind AS dominant_type, n AS dominant_count, round_even(n::DOUBLE / total, 4) AS dominant_frac, level = 1 AS is_residential,
  CASE WHEN level = 1 THEN 0.6 ELSE 0.5 END::DOUBLE AS threshold_used, CASE WHEN n >= 2 AND n::DOUBLE / total > CASE WHEN level = 1 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END THEN 'dominant' ELSE 'diverse' END AS config_type FROM r WHERE k = 1""")
def plot_config(spark, sf_dir):
    """Each parcel dominated by one type or diverse; homes need a larger share."""
    return _plots(spark, sf_dir)


def _plots(spark, sf_dir):
    b = buildings(spark, sf_dir).drop("parts").join(parcels(spark, sf_dir).select("block_id", F.col("level1").cast("string").alias("level1")), "block_id")
    kind = F.when((F.col("building_id") * 31) % 10 < 4 + F.col("block_id") % 4, 1 + F.col("block_id") % 3).otherwise(1 + F.col("building_id") % 7)
    homes = pt.is_residential(F.col("level1"), ["居住"], CLASS_NAMES)
    return pt.parcel_types(b.withColumn("kind", kind), "block_id", "kind", "level1", "row_pos", homes)


@query(f"""WITH {_W}, c AS (SELECT block_id, kind, count(*) AS n, any_value(level) AS level FROM w GROUP BY block_id, kind), r AS (SELECT block_id, max(n) AS n, sum(n) AS total, any_value(level) AS level FROM c GROUP BY block_id)
SELECT CASE WHEN n >= 2 AND n::DOUBLE / total > CASE WHEN level = 1 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END THEN 'dominant' ELSE 'diverse' END AS config_type, count(*) AS n FROM r GROUP BY 1""")
def config_type_counts(spark, sf_dir):
    """How many parcels of each kind."""
    return pt.config_counts(_plots(spark, sf_dir))


_S = "s AS (SELECT label AS class_id, 'f' || i AS feature, abs(v) AS score, vec_id FROM (SELECT vec_id, label, unnest(range(6)) AS i, unnest(embedding[1:6]::DOUBLE[]) AS v FROM embeddings))"


def scores(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select("vec_id", F.col("label").alias("class_id"), F.posexplode(F.slice("x", 1, 6)).alias("i", "v")).select("vec_id", "class_id", F.concat(F.lit("f"), F.col("i").cast("string")).alias("feature"), F.abs("v").alias("score"))


_I = f"{_S}, imp AS (SELECT class_id, feature, avg(score) AS importance FROM s GROUP BY ALL), top AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY importance DESC, feature) AS rank FROM imp)"


@query(f"WITH {_I} SELECT class_id, feature, round(importance, 6) AS importance, rank::INT AS rank FROM top WHERE rank <= 3")
def importance_topk(spark, sf_dir):
    """The three best features of each class."""
    out = ex.top_features(ex.class_importance(scores(spark, sf_dir), "class_id"), "class_id", 3)
    return out.withColumn("importance", F.round("importance", 6))


@query(f"WITH {_I} SELECT class_id, feature, round((importance - min(importance) OVER w) / (max(importance) OVER w - min(importance) OVER w), 6) AS importance FROM imp WINDOW w AS (PARTITION BY class_id)")
def importance_rownorm(spark, sf_dir):
    """Importances scaled within each class."""
    return ex.row_normalised(ex.class_importance(scores(spark, sf_dir), "class_id"), "class_id").withColumn("importance", F.round("importance", 6))


@query(f"""WITH {_I}, g AS (SELECT feature, avg(score) AS importance FROM s GROUP BY feature), c AS (SELECT DISTINCT feature FROM top WHERE rank <= 2)
SELECT feature, round(importance, 6) AS importance, row_number() OVER (ORDER BY importance DESC, feature)::INT AS rank FROM c JOIN g USING (feature)""")
def global_feature_set(spark, sf_dir):
    """The union of the classes' best features by overall importance."""
    s = scores(spark, sf_dir)
    maps = s.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "score"))).alias("scores"))
    out = ex.global_feature_set(ex.class_importance(s, "class_id"), "class_id", ex.global_importance(maps), 2)
    return out.withColumn("importance", F.round("importance", 6))


_N = f"{BLD}, g AS (SELECT building_id, block_id, ((building_id * 31) % 97)::DOUBLE / (96 + 10 * (block_id % 2)) AS score FROM bld)"


@query(f"""WITH {_N}, r AS (SELECT *, max(CASE WHEN score >= 0.98 THEN 1 ELSE 0 END) OVER w AS over_, count(*) OVER w AS n, row_number() OVER (PARTITION BY block_id ORDER BY score DESC, building_id) AS k FROM g WINDOW w AS (PARTITION BY block_id))
SELECT block_id, building_id, round(score, 6) AS score FROM r WHERE (over_ = 1 AND score >= 0.98) OR (over_ = 0 AND k <= greatest(1, round_even(0.25 * n, 0)))""")
def gs_selection(spark, sf_dir):
    """Key buildings of parcels: over the threshold, or a quarter of the parcel."""
    n = buildings(spark, sf_dir).select("block_id", "building_id", (((F.col("building_id") * 31) % 97).cast("double") / (96 + 10 * (F.col("block_id") % 2))).alias("score"))
    return ex.selected_nodes(n, "block_id", "score", "building_id", 0.98).withColumn("score", F.round("score", 6))


@query("""SELECT c_custkey::BIGINT AS building_id, c_custkey || '|' || (c_custkey + 1) AS ids, (c_custkey + 1)::BIGINT AS primary_id FROM customer WHERE c_custkey % 9 = 0 OR (c_custkey + 1) % 9 = 0""")
def gs_semi_filter(spark, sf_dir):
    """Merged buildings of which any part is a key building."""
    key = F.col("c_custkey").cast("long")
    rows = read(spark, sf_dir, "customer").select(key.alias("building_id"), F.concat_ws("|", key.cast("string"), (key + 1).cast("string")).alias("ids"))
    wanted = read(spark, sf_dir, "customer").select(F.explode(F.array(key, key + 1)).alias("id")).where("id % 9 = 0").distinct()
    return ex.holding_any(rows, "ids", wanted, "id").withColumn("primary_id", ex.primary_id(F.col("ids")))


@query("""SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k <= 20""")
def class_quota(spark, sf_dir):
    """The first twenty graphs of each class."""
    return ex.quota(vectors(spark, sf_dir).select("vec_id", "label"), "label", "vec_id", 20)


@query("""SELECT event_type AS message, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, message LIMIT 5""")
def error_counts(spark, sf_dir):
    """The commonest failure messages."""
    return ex.error_counts(read(spark, sf_dir, "events").select(F.col("event_type").alias("message")), "message")


@query("""SELECT quality AS class_id, count(*) AS total, count(*) FILTER (quality = toxic) AS correct, count(*) FILTER (quality = toxic AND doc_id % 3 = 0) AS explained FROM labels GROUP BY quality""")
def class_counters(spark, sf_dir):
    """Graphs of each class: all, correctly predicted, and explained."""
    rows = read(spark, sf_dir, "labels").withColumnRenamed("quality", "class_id")
    return ex.class_counters(rows, "class_id", F.col("class_id") == F.col("toxic"), F.col("doc_id") % 3 == 0)


@query("""SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id DESC))::INT AS rank FROM embeddings QUALIFY rank <= 4""")
def first_of_type(spark, sf_dir):
    """The first four rows of each type: the gallery's samples."""
    return cl.top_by(vectors(spark, sf_dir).select("label", "vec_id"), "label", [F.desc("vec_id")], 4)
