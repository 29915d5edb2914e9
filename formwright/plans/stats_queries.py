"""Scaling, encoding, metrics and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from formwright.operators import shapes, statistics as st

from .registry import query
from .standins import VTX, buildings, parcels, read

_SHAPE = f"{VTX}, m AS (SELECT building_id, block_id, area, perimeter, perimeter / area AS complexity_index FROM shape)"
COLS = ["area", "perimeter", "complexity_index"]


def metrics(spark, sf_dir):
    return shapes.simple_features(buildings(spark, sf_dir)).select("building_id", "block_id", *COLS)


_FLOATED = f"{_SHAPE}, f AS (SELECT building_id, area::FLOAT::DOUBLE AS area, perimeter::FLOAT::DOUBLE AS perimeter, complexity_index::FLOAT::DOUBLE AS complexity_index FROM m)"


@query(f"""WITH {_FLOATED} SELECT building_id, round((area - avg(area) OVER ()) / stddev_pop(area) OVER (), 5) AS area, round((perimeter - avg(perimeter) OVER ()) / stddev_pop(perimeter) OVER (), 5) AS perimeter,
  round((complexity_index - avg(complexity_index) OVER ()) / stddev_pop(complexity_index) OVER (), 5) AS complexity_index FROM f""")
def standard_scale(spark, sf_dir):
    """Features by their mean and population deviation, from FLOAT values."""
    df = metrics(spark, sf_dir)
    scaled = st.standardise(df, st.as_scaler(st.scaler_table(df, COLS)))
    return scaled.select("building_id", *[F.round(c, 5).alias(c) for c in COLS])


@query(f"""WITH {_FLOATED} SELECT feature, round(mean, 5) AS mean, round(CASE WHEN std > 0 THEN std ELSE 1 END, 5) AS scale FROM (
  SELECT 'area' AS feature, avg(area) AS mean, stddev_pop(area) AS std FROM f UNION ALL SELECT 'perimeter', avg(perimeter), stddev_pop(perimeter) FROM f UNION ALL SELECT 'complexity_index', avg(complexity_index), stddev_pop(complexity_index) FROM f)""")
def scaler_table(spark, sf_dir):
    """The scaler as a table."""
    t = st.scaler_table(metrics(spark, sf_dir), COLS)
    return t.select("feature", F.round("mean", 5).alias("mean"), F.round("scale", 5).alias("scale"))


@query(f"WITH {_FLOATED} SELECT building_id, round(area, 3) AS area, round(perimeter, 3) AS perimeter, round(complexity_index, 3) AS complexity_index FROM f")
def scale_round_trip(spark, sf_dir):
    """Scaled and scaled back: the values again."""
    df = metrics(spark, sf_dir)
    s = st.as_scaler(st.scaler_table(df, COLS))
    return st.unscale(st.standardise(df, s), s).select("building_id", *[F.round(c, 3).alias(c) for c in COLS])


@query(f"""WITH {_SHAPE} SELECT building_id, round((area - avg(area) OVER ()) / stddev_pop(area) OVER (), 6) AS area_pop, round((perimeter - avg(perimeter) OVER ()) / stddev_samp(perimeter) OVER (), 6) AS perimeter_samp FROM m""")
def zscore(spark, sf_dir):
    """z-scores with population and with sample deviation."""
    df = metrics(spark, sf_dir)
    both = st.zscores(st.zscores(df, ["area"]), ["perimeter"], sample=True)
    return both.select("building_id", F.round("area", 6).alias("area_pop"), F.round("perimeter", 6).alias("perimeter_samp"))


@query(f"""WITH {_SHAPE}, l AS (SELECT 'area' AS f, area AS v FROM m UNION ALL SELECT 'perimeter', perimeter FROM m UNION ALL SELECT 'constant', 7 FROM m)
SELECT f AS feature_name, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, count(DISTINCT round(v, 9)) AS n_unique, count(DISTINCT v) <= 1 AS is_constant_like FROM l GROUP BY f""")
def feature_summary(spark, sf_dir):
    """Count, moments, range and constancy of each feature."""
    df = metrics(spark, sf_dir).select(F.round("area", 9).alias("area"), F.round("perimeter", 9).alias("perimeter"), F.lit(7.0).alias("constant"))
    out = st.feature_summary(df, ["area", "perimeter", "constant"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "max")})


@query("""WITH d AS (SELECT DISTINCT (n_regionkey * 5 + 1)::DOUBLE::VARCHAR AS label FROM nation) SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS idx FROM d""")
def label_encode(spark, sf_dir):
    """Labels numbered in the order of their text: 11.0 comes before 6.0."""
    p = parcels(spark, sf_dir).withColumn("level", ((F.col("class_id") * 5) + 1).cast("double"))
    return st.label_index(p, "level").select("label", F.col("idx").cast("int").alias("idx"))


@query("SELECT c_nationkey::BIGINT AS block_id, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM customer GROUP BY c_nationkey")
def class_distribution(spark, sf_dir):
    """Counts and shares of classes."""
    return st.class_distribution(buildings(spark, sf_dir), "block_id").withColumn("share", F.round("share", 9))


_TRUE = "SELECT quality AS t, toxic AS p FROM labels"


def truth(spark, sf_dir):
    return read(spark, sf_dir, "labels").select(F.col("quality").alias("t"), F.col("toxic").alias("p"))


@query(f"""WITH l(x) AS (VALUES (0), (1), (2)), o AS ({_TRUE}) SELECT a.x::INT AS true, b.x::INT AS pred, (SELECT count(*) FROM o WHERE t = a.x AND p = b.x) AS n FROM l a, l b""")
def confusion_matrix(spark, sf_dir):
    """All pairs of the label set, zeros included."""
    return st.confusion(truth(spark, sf_dir), "t", "p", [0, 1, 2])


_REPORT = f"""o AS ({_TRUE}), l AS (SELECT t AS label FROM o UNION SELECT p FROM o),
c AS (SELECT label, (SELECT count(*) FROM o WHERE t = label) AS support, (SELECT count(*) FROM o WHERE p = label) AS predicted, (SELECT count(*) FROM o WHERE t = label AND p = label) AS hits FROM l),
r AS (SELECT *, CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS recall FROM c),
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"""


@query(f"WITH {_REPORT} SELECT label, support, predicted, hits, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM rep")
def per_class_accuracy(spark, sf_dir):
    """Support, precision, recall and F1 of each class."""
    out = st.class_report(truth(spark, sf_dir), "t", "p")
    return out.select("label", "support", "predicted", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_REPORT} SELECT round(sum(hits)::DOUBLE / sum(support), 9) AS accuracy, round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
  round(sum(precision * support) / sum(support), 9) AS weighted_precision, round(sum(recall * support) / sum(support), 9) AS weighted_recall, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM rep""")
def prf_metrics(spark, sf_dir):
    """Accuracy, macro and weighted averages."""
    out = st.overall_metrics(st.class_report(truth(spark, sf_dir), "t", "p"))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


_HASH = "(c_custkey::BIGINT * 7919) % 10007 * 100003 + c_custkey"


@query(f"""WITH r AS (SELECT n_regionkey AS label, row_number() OVER (PARTITION BY n_regionkey ORDER BY ({_HASH}) % 64, {_HASH}) - 1 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT label::INT AS class_id, (k % 10)::INT AS fold, count(*) AS n FROM r GROUP BY ALL""")
def stratified_fold_counts(spark, sf_dir):
    """Rows of each class in each of ten folds."""
    b = buildings(spark, sf_dir).select("building_id", "block_id").join(parcels(spark, sf_dir).select("block_id", "class_id"), "block_id")
    key = F.col("building_id") * 7919 % 10007 * 100003 + F.col("building_id")
    return st.stratified_folds(b, "class_id", key, 10).groupBy("class_id", "fold").agg(F.count("*").alias("n"))


@query(f"""WITH h AS (SELECT c_custkey, n_regionkey AS label, {_HASH} AS k FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY k % 64, k) - 1) % 10 AS f FROM h),
i AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY k % 64, k) - 1) % 9 AS g FROM o WHERE f <> 3)
SELECT c_custkey::BIGINT AS building_id, CASE WHEN g = 0 THEN 'val' ELSE 'train' END AS part FROM i UNION ALL SELECT c_custkey, 'test' FROM o WHERE f = 3""")
def train_val_test(spark, sf_dir):
    """The 80/10/10 split of one outer fold."""
    b = buildings(spark, sf_dir).select("building_id", "block_id").join(parcels(spark, sf_dir).select("block_id", "class_id"), "block_id")
    key = F.col("building_id") * 7919 % 10007 * 100003 + F.col("building_id")
    return st.train_val_test(b, "class_id", key, 10, 3).select("building_id", "part")


@query("""WITH f AS (SELECT label AS fold, avg(embedding[1]) AS a, max(embedding[2])::DOUBLE AS b FROM embeddings GROUP BY label), l AS (SELECT 'accuracy' AS metric, a AS v FROM f UNION ALL SELECT 'macro_f1', b FROM f)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM l GROUP BY metric""")
def fold_summary(spark, sf_dir):
    """Mean and sample deviation of metrics over folds."""
    e = read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("fold")).agg(F.avg(F.col("embedding")[0].cast("double")).alias("accuracy"), F.max(F.col("embedding")[1]).cast("double").alias("macro_f1"))
    return st.fold_summary(e, ["accuracy", "macro_f1"]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE ELSE value END AS x FROM events),
m AS (SELECT median(x) AS med FROM v WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)) SELECT event_id, round(CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN med ELSE x END, 6) AS x FROM v, m""")
def median_fill(spark, sf_dir):
    """Values that are not finite become the median."""
    x = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).otherwise(F.col("value"))
    return st.fill_with_median(read(spark, sf_dir, "events").select("event_id", x.alias("x")), ["x"]).select("event_id", F.round("x", 6).alias("x"))


@query("""SELECT c_custkey::BIGINT AS building_id, TRY_CAST(CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE (c_custkey / 4.0)::VARCHAR END AS DOUBLE) AS height FROM customer""")
def numeric_coercion(spark, sf_dir):
    """Texts to numbers, null where there is none."""
    key = F.col("c_custkey").cast("long")
    text = F.when(key % 5 == 0, "n/a").otherwise((key / 4.0).cast("string"))
    return read(spark, sf_dir, "customer").select(key.alias("building_id"), st.to_number(text).alias("height"))
