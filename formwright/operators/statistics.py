"""Scaling, encoding, summaries and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import stored

TINY = 1e-12
#: Up to so many values a quantile is taken in one aggregate.
SMALL = 5_000_000


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean_<c> and std_<c> (population) of each column, values first rounded to FLOAT as the feature matrix stores them."""
    as_float = lambda c: F.col(c).cast("float").cast("double")
    return df.agg(*[f for c in columns for f in (F.avg(as_float(c)).alias(f"mean_{c}"), F.stddev_pop(as_float(c)).alias(f"std_{c}"))])


def scaler_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, scale: a standard deviation of 0 scales by 1."""
    row = moments(df, columns)
    each = [F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"), F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(1.0).alias("scale")) for c in columns]
    return row.select(F.inline(F.array(*each)))


def standardise(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns less mean over scale; what is not finite becomes 0. The scaler has one row for each feature."""
    clean = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
    return df.withColumns({c: clean((F.col(c).cast("float").cast("double") - m) / s) for c, (m, s) in scaler.items()})


def unscale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: F.col(c) * s + m for c, (m, s) in scaler.items()})


def as_scaler(table: DataFrame) -> dict[str, tuple[float, float]]:
    return {r.feature: (r["mean"], r.scale) for r in table.collect()}


def zscores(df: DataFrame, columns: list[str], sample: bool = False) -> DataFrame:
    """Columns as z-scores: population deviation with 1 for none, or sample deviation with 1e-12 for none."""
    f = F.stddev_samp if sample else F.stddev_pop
    row = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), f(c).alias(f"_s_{c}"))])
    scale = lambda c: F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) < TINY, TINY if sample else 1.0).otherwise(F.col(f"_s_{c}"))
    joined = df.join(F.broadcast(row))  # one row
    return joined.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in columns}).drop(*row.columns)


def feature_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature_name, count, mean, std (population), min, max, n_unique, is_constant_like, constants first, then few values, then small spread."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature_name"), F.col(c).cast("double").alias("v")) for c in columns])))
    out = long.groupBy("feature_name").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.countDistinct("v").alias("n_unique"))
    return out.withColumn("is_constant_like", (F.col("n_unique") <= 1) | (F.coalesce("std", F.lit(0.0)) < TINY)).orderBy(F.desc("is_constant_like"), "n_unique", "std", "feature_name")


def to_number(c: Column) -> Column:
    """A number, or null where the text is none."""
    return c.try_cast("double")


def label_index(df: DataFrame, column: str) -> DataFrame:
    """label, idx: distinct labels in the order of their text, from 0."""
    distinct = df.select(F.col(column).cast("string").alias("label")).where("label IS NOT NULL").distinct()
    return distinct.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1)


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """Label, count and share of all."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def confusion(df: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """true, pred, n for every pair of the given labels, zeros included; labels are a short fixed list."""
    found = df.groupBy(F.col(truth).alias("true"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n"))
    kind = df.schema[truth].dataType
    every = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], f"true {kind.simpleString()}, pred {kind.simpleString()}")
    return every.join(found, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, support, predicted, hits, precision, recall, f1 for each label seen in either column; a ratio without a base is 0."""
    rows = df.select(F.inline(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("h")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("h")))))
    c = rows.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("h").alias("hits"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("support"))})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overall_metrics(report: DataFrame) -> DataFrame:
    """One row: accuracy (also micro F1), macro and weighted precision, recall and F1, from a class report."""
    n = F.sum("support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / n).alias(f"weighted_{c}")
    return report.agg((F.sum("hits") / n).alias("accuracy"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[weighted(c) for c in ("precision", "recall", "f1")])


#: Runs that a label's rows are ranked in, so that no task sorts a whole label.
RANK_RUNS = 64


def stratified_folds(df: DataFrame, label: str, key: Column, k: int, name: str = "fold") -> DataFrame:
    """df with a fold from 0 to k - 1: the rows of each label are numbered in the order of (key mod RANK_RUNS, key) and dealt in turn, so a label's folds differ by one row at most.

    key: a whole-number hash. Each run of a label is numbered apart and moved up by the rows of the runs before it.
    """
    rows = df.withColumn("_key", key).withColumn("_run", F.pmod("_key", F.lit(RANK_RUNS)))
    counts = rows.groupBy(label, "_run").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = rows.join(counts.select(label, "_run", before.alias("_before")), [label, "_run"])
    rank = F.row_number().over(Window.partitionBy(label, "_run").orderBy("_key")) - 1 + F.col("_before")
    return moved.withColumn(name, (rank % k).cast("int")).drop("_key", "_run", "_before")


def train_val_test(df: DataFrame, label: str, key: Column, splits: int = 10, fold: int = 0) -> DataFrame:
    """df with part: test is the outer fold; of the rest, the first of nine inner folds is val (80/10/10 for ten splits)."""
    outer = stratified_folds(df, label, key, splits, "_outer")
    rest = stratified_folds(outer.where(F.col("_outer") != fold), label, key, 9, "_inner")
    parts = rest.withColumn("part", F.when(F.col("_inner") == 0, "val").otherwise("train")).drop("_inner")
    return parts.unionByName(outer.where(F.col("_outer") == fold).withColumn("part", F.lit("test"))).drop("_outer")


def fold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, std (sample; null for one fold)."""
    long = folds.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def exact_quantile(df: DataFrame, column: str, quantile: float, small: int = SMALL) -> float | None:
    """The quantile of a column's values, linear between neighbours; null values don't count, and without any it is None.

    Up to `small` values it is one aggregate. Beyond, that would hold every distinct value in one task: values are then dealt out by sampled
    ranges, and the two ranks that are needed are read from the one or two ranges that hold them.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    if values.count() <= small:
        return values.agg(F.percentile("v", F.lit(quantile))).first()[0]
    dealt = stored(values.withColumn("id", F.monotonically_increasing_id()).repartitionByRange("v", "id").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = sorted(tuple(r) for r in dealt.groupBy("part").count().collect())  # one row for each partition
    rank = quantile * (sum(n for _, n in sizes) - 1)
    found = []
    for want in (int(rank), min(int(rank) + 1, sum(n for _, n in sizes) - 1)):
        part = None
        for part, n in sizes:
            if want < n:
                break
            want -= n
        order = F.row_number().over(Window.partitionBy("part").orderBy("v", "id"))
        found.append(dealt.where(F.col("part") == part).withColumn("at", order).where(F.col("at") == want + 1).first().v)
    return found[0] + (found[1] - found[0]) * (rank - int(rank))


def fill_with_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, NaN and infinite values become their column's median of the others."""
    good = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    medians = {c: exact_quantile(df.select(good(c).alias("good")), "good", 0.5) for c in columns}
    return df.withColumns({c: F.coalesce(good(c), F.lit(medians[c])) for c in columns})
