"""What explanations of single parcels add up to: importances, selections, global feature sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import top_by


def class_importance(scores: DataFrame, kind: str) -> DataFrame:
    """kind, feature, importance: mean of each feature's score over the class's explanations; scores: kind, feature, score."""
    return scores.groupBy(kind, "feature").agg(F.avg("score").alias("importance"))


def global_importance(explanations: DataFrame, map_column: str = "scores") -> DataFrame:
    """feature, importance: mean over all explanations, a feature that one lacks counting 0."""
    n = explanations.agg(F.count("*").alias("n"))
    sums = explanations.select(F.explode(map_column).alias("feature", "score")).groupBy("feature").agg(F.sum("score").alias("s"))
    return sums.join(F.broadcast(n)).select("feature", (F.col("s") / F.col("n")).alias("importance"))


def row_normalised(importance: DataFrame, kind: str) -> DataFrame:
    """Importances of each class scaled to [0, 1]; a class without range is divided by 1."""
    w = Window.partitionBy(kind)
    span = F.max("importance").over(w) - F.min("importance").over(w)
    return importance.withColumn("importance", (F.col("importance") - F.min("importance").over(w)) / F.when(span > 0, span).otherwise(1.0))


def top_features(importance: DataFrame, kind: str, k: int = 3) -> DataFrame:
    """The k best features of each class with their rank; of equals the smaller feature."""
    return top_by(importance, kind, [F.desc("importance"), "feature"], k)


def global_feature_set(importance: DataFrame, kind: str, overall: DataFrame, k: int = 3) -> DataFrame:
    """feature, importance, rank: the union of the classes' best, ordered by their overall importance."""
    chosen = top_features(importance, kind, k).select("feature").distinct()
    found = chosen.join(overall, "feature")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")))


def selected_nodes(nodes: DataFrame, graph: str, score: str, key: str, threshold: float = 0.90, share: float = 0.25) -> DataFrame:
    """Nodes at or over the threshold; in a graph that has none, the best max(1, round(share * n)) of them (halves to even)."""
    w = Window.partitionBy(graph)
    marked = nodes.withColumns({"_over": F.max((F.col(score) >= threshold).cast("int")).over(w), "_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(F.desc(score), key))})
    most = F.greatest(F.lit(1), F.bround(F.col("_n") * share, 0).cast("int"))
    return marked.where(((F.col("_over") == 1) & (F.col(score) >= threshold)) | ((F.col("_over") == 0) & (F.col("_k") <= most))).drop("_over", "_n", "_k")


def quota(rows: DataFrame, kind: str, order: str, most: int = 100) -> DataFrame:
    """The first `most` rows of each class in dataset order."""
    return top_by(rows, kind, [order], most, "_rank").drop("_rank")


def id_parts(ids: Column) -> Column:
    """The parts of `a|b`, blanks dropped."""
    return F.filter(F.transform(F.split(ids, r"\|"), lambda p: F.trim(p)), lambda p: p != "")


def primary_id(ids: Column) -> Column:
    """The last part, as a number where it is one."""
    return F.try_element_at(id_parts(ids), F.lit(-1)).try_cast("long")


def holding_any(rows: DataFrame, ids: str, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of which any id part is among wanted.key: a semi-join on the parts, then one on the rows."""
    hit = rows.select(ids, F.explode(id_parts(F.col(ids))).alias("_part")).join(wanted.select(F.col(key).cast("string").alias("_part")), "_part", "left_semi").select(ids).distinct()
    return rows.join(hit, ids, "left_semi")


def error_counts(failed: DataFrame, message: str, n: int = 5) -> DataFrame:
    """The commonest messages."""
    return failed.groupBy(message).agg(F.count("*").alias("n")).orderBy(F.desc("n"), message).limit(n)


def class_counters(rows: DataFrame, kind: str, correct: Column, explained: Column) -> DataFrame:
    """kind, total, correct, explained: how far the graphs of each class came."""
    return rows.groupBy(kind).agg(F.count("*").alias("total"), F.count_if(correct).alias("correct"), F.count_if(correct & explained).alias("explained"))
