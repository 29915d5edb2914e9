"""The staged run, transfer to the same city, and the stream of footprints."""

from dataclasses import replace

from pyspark.sql import functions as F

from formwright.config import Config, Explainer, Model, Stages, Training
from formwright.plans import city
from formwright.plans.standins import buildings, parcels
from formwright.streaming import footprints


def test_city_and_transfer(spark, sf_dir, tmp_path):
    c = Config(model=Model(hidden_dim=8), training=Training(epochs=1, n_splits=3, quick_fold=True, batch_size=8), explainer=Explainer(explain_epochs=2), stages=Stages(clean=True))
    c = replace(c, clustering=replace(c.clustering, min_k=3, max_k=4, use_gs_buildings=False, feature_source="all"))
    p = parcels(spark, sf_dir).withColumn("label", F.col("level1").cast("string"))
    run = city.run_city(spark, c, buildings(spark, sf_dir, placed=True).drop("x0", "y0"), p, f"file://{tmp_path}/run")
    out = run.get("parcel_types").collect()
    assert len(out) == run.get("nodes").select("block_id").distinct().count() and {r.config_type for r in out} <= {"dominant", "diverse"}
    assert run.get("types").count() == run.get("examine").count()
    told = city.transfer_city(run, run)
    own = {r.graph_id: (r.y, r.pred) for r in run.get("predictions").collect()}
    assert {r.block_id: (r.y, r.pred) for r in told.collect()} == own


def test_stream_equals_table(spark, sf_dir, tmp_path):
    rows = buildings(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("building_id") * 3_600))
    folder = f"file://{tmp_path}/in"
    rows.repartition(3).write.parquet(folder)
    stream = footprints.parcel_windows(footprints.arriving(spark, folder, rows.schema), late="400 days")
    q = stream.writeStream.format("memory").queryName("arrived").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = spark.table("arrived"), footprints.parcel_windows(rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
