"""One city from footprints and parcels to form types: stages that write tables and record them in a manifest.

A stage reads what the manifest names, so any stage can run again later, alone, in another process.
"""

from __future__ import annotations

import argparse
import functools
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.config import CLASS_NAMES, Config, load
from formwright.operators import classifier as gc
from formwright.operators import cleaning, components, graphs, shapes, spatial, transfer
from formwright.operators import clustering as cl
from formwright.operators import explaining as ex
from formwright.operators import parcel_types as pt
from formwright.operators import statistics as st
from formwright.sources import tables


@dataclass
class Run:
    """Where a run's tables are. buildings: building_id, block_id, height, row_pos, parts; parcels: block_id, label, parts."""

    spark: SparkSession
    folder: str
    config: Config

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        tables.record_run(self.spark, f"{self.folder}/manifest", name, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def get(self, name: str) -> DataFrame:
        runs = tables.latest(self.spark.read.parquet(f"{self.folder}/manifest").where(F.col("stage") == name)).collect()
        if not runs:
            raise FileNotFoundError(f"no stage of {self.folder} has written {name}")
        return self.spark.read.parquet(runs[0].path)


def clean(run: Run, buildings: DataFrame) -> DataFrame:
    """Touching footprints merged, then the small and the line-like ones dropped."""
    c = run.config.cleaning
    b = components.stored(shapes.valid(buildings), "valid")
    if c.enable_merge:
        groups = components.stored(components.connected(spatial.touching_links(b, "building_id", c.merge_buffer_distance), b, "building_id"), "groups")
        merged = cleaning.merge_attributes(b.drop("parts"), groups, "building_id")
        joined = cleaning.dissolve(b.select("building_id", "parts").join(groups, "building_id"), "group_id")
        b = merged.join(joined, "group_id").select(F.col("group_id").alias("building_id"), "block_id", "height", F.col("first_id").alias("row_pos"), "building_ids", "parts")
    m = shapes.measured(b)
    m = m.join(shapes.hull_features(b, ["building_id"]).select("building_id", "elongation_index"), "building_id")
    return run.put("cleaned", m.where(shapes.kept_shapes(F.col("area"), F.col("elongation_index"), c.min_area, c.max_elongation, c.elongation_area_limit)).select(*b.columns))


def build(run: Run, buildings: DataFrame, parcels: DataFrame) -> None:
    """Scaled features, nodes, edges and graph rows."""
    c = run.config.graph
    labels = run.put("labels", st.label_index(parcels, "label"))
    b = cleaning.big_enough(buildings.join(parcels.select("block_id"), "block_id", "left_semi"), "block_id", c.min_buildings_per_block)
    b = components.stored(b.join(parcels.select("block_id", F.col("label").cast("string").alias("label")), "block_id"), "kept")
    centres = components.stored(shapes.measured(b).select("block_id", F.col("building_id").alias("node"), F.col("cx").alias("x"), F.col("cy").alias("y")), "centres")
    cover = graphs.voronoi_cells(centres, parcels).select(F.col("node").alias("building_id"), "cell_area")
    feats = shapes.building_features(b, ["building_id"], cover)
    names = shapes.feature_names(run.config.data.has_height)
    feats = run.put("features", feats.join(b.select("building_id", "block_id", "row_pos", "label", F.coalesce("height", F.lit(0.0)).alias("height")), "building_id"))
    run.put("feature_summary", st.feature_summary(feats, names))
    scaler = run.put("scaler", st.scaler_table(feats, names))
    scaled = run.put("examine", st.standardise(feats, st.as_scaler(scaler)))
    nodes = run.put("nodes", graphs.node_table(scaled, least=c.min_buildings_per_block).select("block_id", F.col("node_idx").cast("int").alias("node_idx"), "building_id", F.array(*names).alias("x")))
    raw = components.stored(graphs.delaunay_edges(centres), "raw-edges")
    limit = graphs.edge_quantile(raw, c.auto_quantile, c.distance_threshold).first()[0] if c.threshold_mode == "auto" else c.distance_threshold
    at = nodes.select("block_id", "building_id", "node_idx")
    ends = graphs.threshold(raw, limit).join(at.select("block_id", F.col("building_id").alias("a"), F.col("node_idx").alias("na")), ["block_id", "a"])
    ends = ends.join(at.select("block_id", F.col("building_id").alias("b"), F.col("node_idx").alias("nb")), ["block_id", "b"])
    edges = run.put("edges", ends.select("block_id", F.col("na").alias("a"), F.col("nb").alias("b"), "dist"))
    y = parcels.select("block_id", F.col("label").cast("string").alias("label")).join(labels, "label").select("block_id", F.col("idx").alias("y"))
    run.put("block_stats", graphs.block_stats(nodes, edges, y))
    run.put("graphs", gc.graph_rows(nodes, graphs.symmetric(edges), y))


def train(run: Run) -> None:
    """Cross-validation; the parameters of the fold with the least validation loss are kept."""
    how, model, g = run.config.training, run.config.model, run.get("graphs")
    width = len(shapes.feature_names(run.config.data.has_height))
    folds = range(1 if how.quick_fold else how.n_splits)
    parts = [components.stored(st.train_val_test(g, "y", F.xxhash64("graph_id", F.lit(how.seed)), how.n_splits, fold), "parts").withColumn("fold", F.lit(fold)) for fold in folds]
    every = functools.reduce(DataFrame.unionByName, parts)
    batches = gc.mini_batches(every.where("part <> 'test'").withColumn("train", F.col("part") == "train"), how.batch_size, how.seed)
    best, rows = None, []
    for fold, (params, stats, loss) in gc.fit(components.stored(batches, "batches"), width, model, how).items():
        m = st.overall_metrics(st.class_report(gc.predict(parts[fold].where("part = 'test'"), params, stats, model), "y", "pred")).first()
        rows.append((fold, loss, m.accuracy, m.macro_f1, m.weighted_f1))
        best = (loss, params, stats) if best is None or loss < best[0] else best
    run.put("folds", run.spark.createDataFrame(rows, "fold int, best_val_loss double, accuracy double, macro_f1 double, weighted_f1 double"))
    run.put("fold_summary", st.fold_summary(run.get("folds"), ["accuracy", "macro_f1", "weighted_f1"]))
    run.put("params", gc.parameter_table(run.spark, best[1]))
    run.put("stats", gc.parameter_table(run.spark, best[2]))


def explain(run: Run) -> None:
    """Importances per class and over all, and the key buildings of parcels, from correctly classified graphs."""
    how, model, g = run.config.explainer, run.config.model, run.get("graphs")
    names = shapes.feature_names(run.config.data.has_height)
    params, stats = gc.from_table(run.get("params")), gc.from_table(run.get("stats"))
    right = run.put("predictions", gc.predict(g, params, stats, model)).where("pred = y").select("graph_id", "y")
    masks = run.put("masks", gc.explain(g.join(right, ["graph_id", "y"], "left_semi"), params, stats, model, how).join(right, "graph_id"))
    run.put("failures", ex.error_counts(masks.where("error IS NOT NULL"), "error"))
    good = ex.quota(masks.where("error IS NULL"), "y", "graph_id", how.max_samples_per_class)
    scores = good.select("graph_id", "y", F.posexplode("features").alias("i", "score")).withColumn("feature", F.array(*map(F.lit, names))[F.col("i")])
    importance = run.put("importance", ex.class_importance(scores, "y"))
    overall = scores.groupBy("feature").agg(F.avg("score").alias("importance"))
    run.put("global_features", ex.global_feature_set(importance, "y", overall, how.top_k))
    keys = ex.selected_nodes(good.select("graph_id", F.posexplode("nodes").alias("node_idx", "score")), "graph_id", "score", "node_idx", how.gs_threshold, how.gs_top_frac)
    run.put("key_buildings", keys.join(run.get("nodes").select(F.col("block_id").alias("graph_id"), "node_idx", "building_id"), ["graph_id", "node_idx"]).select("graph_id", "building_id", "score"))


def cluster(run: Run) -> None:
    """Core form types from key buildings, their names, features and representatives; then the type of every building."""
    c, names = run.config.clustering, shapes.feature_names(run.config.data.has_height)
    found = [r.feature for r in run.get("global_features").select("feature").collect()] if c.feature_source == "fs_from_explainer" else []  # at most all features
    names = cl.feature_subset(names, c.feature_source, found, c.custom_features)
    rows = run.get("examine")
    key = rows.join(run.get("key_buildings").select("building_id").distinct(), "building_id", "left_semi") if c.use_gs_buildings else rows
    key = components.stored(st.fill_with_median(key, names).withColumn("x", cl.matrix(key, names)), "key")
    mean, axes = cl.pca(key, "x", len(names))
    placed = components.stored(key.withColumn("e", cl.project(F.col("x"), mean, axes)), "placed")
    search = run.put("k_search", cl.search_k(placed, "building_id", "e", "x", range(c.min_k, c.max_k + 1), most=c.k_search_max_samples))
    centres = cl.kmeans(placed, "e", cl.best_k(search).first().k)
    typed = placed.join(spatial.nearest(placed, ["building_id"], F.col("e"), centres).select("building_id", (F.col("nearest") + 1).alias("kind")), "building_id")
    typed = run.put("key_types", typed.select("building_id", "block_id", "label", "kind", "e", *names))
    z = components.stored(cl.type_zmeans(typed, "kind", names), "z")
    run.put("type_names", cl.type_names(z, "kind", c.name_top_n))
    run.put("core_features", cl.core_features(z, "kind", c.top_n_per_type))
    run.put("representatives", cl.representatives(typed, "kind", F.col("e"), 2, "building_id", c.num_representative))
    everyone = rows.withColumn("x", cl.matrix(rows, names)).withColumn("e", cl.project(F.col("x"), mean, axes))
    run.put("types", spatial.nearest(everyone, ["building_id", "block_id", "label", "row_pos"], F.col("e"), centres).withColumn("kind", F.col("nearest") + 1))


def types(run: Run) -> DataFrame:
    """Every parcel dominated by one type, or diverse."""
    p = run.config.parcel_types
    homes = pt.is_residential(F.col("label"), list(p.residential_names), CLASS_NAMES)
    out = run.put("parcel_types", pt.parcel_types(run.get("types"), "block_id", "kind", "label", "row_pos", homes, p.general_threshold, p.residential_threshold, p.min_buildings))
    run.put("config_counts", pt.config_counts(out))
    return out


def run_city(spark: SparkSession, config: Config, buildings: DataFrame, parcels: DataFrame, folder: str) -> Run:
    """The stages that the config turns on, in order; each stage's failure is the run's failure."""
    run, on = Run(spark, folder, config), config.stages
    b = clean(run, buildings) if on.clean else buildings
    if on.build:
        build(run, b, parcels)
    for wanted, stage in ((on.train, train), (on.explain, explain), (on.cluster, cluster), (on.types, types)):
        if wanted:
            stage(run)
    return run


def transfer_city(source: Run, target: Run) -> DataFrame:
    """Predictions of the source's model on the target's graphs, by the source's scaler and labels: block_id, y (source index or -1), pred, prob, correct."""
    names = shapes.feature_names(source.config.data.has_height)
    own, other = st.as_scaler(target.get("scaler")), st.as_scaler(source.get("scaler"))
    g = target.get("graphs").withColumn("x", F.transform("x", lambda v: transfer.rescaled(v.cast("array<double>"), names, own, other).cast("array<float>")))
    out = gc.predict(g, gc.from_table(source.get("params")), gc.from_table(source.get("stats")), source.config.model)
    told = transfer.relabelled(out, "y", target.get("labels"), source.get("labels"), "true")
    return told.select(F.col("graph_id").alias("block_id"), F.col("true").alias("y"), "pred", "prob", (F.col("true") == F.col("pred")).alias("correct"))


def main() -> None:
    args = argparse.ArgumentParser(description="Run a city: footprints and parcels in, form types out.")
    for name in ("--config", "--buildings", "--parcels", "--out"):
        args.add_argument(name, required=True)
    a = args.parse_args()
    spark = SparkSession.builder.appName("formwright").getOrCreate()
    run_city(spark, load(a.config), spark.read.parquet(a.buildings), spark.read.parquet(a.parcels), a.out)


if __name__ == "__main__":
    main()
