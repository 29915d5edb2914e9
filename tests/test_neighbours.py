"""Neighbours found tile by tile are those of all pairs, and what only counts or sums them writes no pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formwright.operators import graphs, messages, neighbours
from formwright.plans import registry  # before any module of queries
from formwright.plans import graph_queries


@pytest.fixture(params=[4_096, 40], ids=["tiles", "crowded tiles"])
def cloud(request, spark, monkeypatch):
    """Points of two groups, some in one place, some without a place or group; all pairs of theirs within 30."""
    monkeypatch.setattr(neighbours, "MOST", request.param)
    monkeypatch.setattr(neighbours, "AT_ONCE", 4_000 if request.param == 40 else 500_000)
    r = np.random.default_rng(3)
    xy = np.concatenate([r.random((150, 2)) * 200 - 100, np.round(r.random((60, 2)) * 9) * 10, [[30.0, 0.0], [0.0, 0.0], [0.0, 0.0]]])
    group, ids = r.integers(0, 2, len(xy)), r.permutation(len(xy))
    rows = [(int(g), int(i), float(x), float(y), [float(i), 1.0 / (int(i) + 1)]) for g, i, (x, y) in zip(group, ids, xy)]
    odd = [(0, 900, None, 1.0, [5.0, 1.0]), (0, 901, float("nan"), 1.0, [5.0, 1.0]), (1, 902, float("inf"), 1.0, [5.0, 1.0]), (None, 903, 1.0, 1.0, [5.0, 1.0])]
    df = spark.createDataFrame([*rows, *odd], "grp int, id long, x double, y double, v array<double>")
    d = np.hypot(*(xy[:, None] - xy).transpose(2, 0, 1))
    near = (d <= 30) & (group[:, None] == group) & ~np.eye(len(xy), dtype=bool)
    return df, rows, near, d


def test_pairs_and_counts(cloud):
    df, rows, near, d = cloud
    want = {(rows[i][0], rows[i][1], rows[j][1]): d[i, j] for i, j in zip(*np.nonzero(near)) if rows[i][1] < rows[j][1]}
    got = neighbours.pairs(df, "id", 30.0, ["grp"]).collect()
    assert len(got) == len(want) and all(abs(want[r.grp, r.a, r.b] - r.dist) < 1e-9 for r in got)
    assert {r.grp: r.n for r in neighbours.pair_counts(df, "id", 30.0, ["grp"]).collect()} == {g: sum(k[0] == g for k in want) for g in (0, 1)}


@pytest.mark.parametrize("weight", ["none", "inverse", "raw"])
def test_sums(cloud, weight):
    df, rows, near, d = cloud
    w = near * {"none": np.ones_like(d), "inverse": 1 / (d + 1e-6), "raw": d}[weight]
    v = np.array([r[4] for r in rows])
    got = {r.id: r for r in neighbours.sums(df, "id", 30.0, ["grp"], "v", weight).collect()}
    assert set(got) == {r[1] for r in rows} | {900, 901, 902} | ({903} & set(got))
    for i, r in enumerate(rows):
        assert got[r[1]].n == near[i].sum() and np.allclose(got[r[1]].sums, w[i] @ v)
    assert got[900].n == 0 and got[901].sums == [0.0, 0.0]


def test_lists(cloud):
    df, rows, near, _ = cloud
    want = {rows[i][1]: ",".join(map(str, sorted(rows[j][1] for j in np.flatnonzero(near[i])))) for i in range(len(rows)) if near[i].any()}
    assert {r.id: r.neighbours for r in neighbours.listed(df, "id", 30.0, ["grp"]).collect()} == want


@pytest.mark.parametrize("small", [5_000_000, 20])
def test_lengths(cloud, small, monkeypatch):
    df, rows, near, d = cloud
    monkeypatch.setattr(neighbours, "BINS", 16)
    lengths = d[near & (np.arange(len(d))[:, None] < np.arange(len(d)))]
    for share in (0.0, 0.37, 0.95, 1.0):
        assert neighbours.quantile(df, "id", 30.0, ["grp"], share, small) == pytest.approx(np.quantile(lengths, share), rel=1e-12)
    pairs = neighbours.pairs(df, "id", 30.0, ["grp"])
    assert sorted(graphs.histogram_within(df, "id", 30.0, ["grp"]).collect()) == sorted(graphs.histogram(pairs).collect())
    none = df.where("id < 0")
    assert neighbours.quantile(none, "id", 30.0, ["grp"], 0.5) is None and [r.n for r in graphs.histogram_within(none, "id", 30.0, ["grp"]).collect()] == [0] * 100


def test_convolution_over_points_is_that_over_edges(cloud):
    df, *_ = cloud
    nodes = df.where("grp IS NOT NULL").select(F.col("grp").alias("block_id"), F.col("id").alias("node"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("v").alias("x"))
    edges = graphs.symmetric(neighbours.pairs(df.withColumnRenamed("grp", "block_id"), "id", 30.0, ["block_id"]))
    w, b = [[0.5, 1.0], [-0.25, 0.75]], [0.1, -0.2]
    want = {r.node: r.h for r in messages.gcn_layer(nodes, edges, w, b).collect()}
    got = {r.node: r.h for r in messages.gcn_layer_within(nodes, 30.0, w, b).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in got)


@pytest.mark.parametrize("weight", ["none", "inverse"])
def test_network_over_points_is_that_over_edges(spark, cloud, weight):
    from formwright.config import Model
    from formwright.operators import classifier as gc

    df, *_ = cloud
    model = Model(hidden_dim=4, output_dim=3, edge_weight=weight)
    params, stats = (gc.parameter_table(spark, p) for p in gc.start(2, model))
    nodes = df.where("grp IS NOT NULL").select(F.col("grp").alias("block_id"), F.col("id").alias("node"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("v").alias("x"))
    edges = graphs.symmetric(neighbours.pairs(df.withColumnRenamed("grp", "block_id"), "id", 30.0, ["block_id"]))
    want = {r.block_id: r.logits for r in messages.forward(nodes, edges, params, stats, model).collect()}
    got = {r.block_id: r.logits for r in messages.forward_within(nodes, 30.0, params, stats, model).collect()}
    assert set(got) == set(want) == {0, 1} and all(np.allclose(got[k], want[k]) for k in got)


@pytest.mark.parametrize("name", ["graph_forward", "block_stats", "edge_histogram", "edge_quantile_threshold", "gcn_layer", "adjacency"])
def test_sums_over_edges_make_no_edges(spark, sf_dir, monkeypatch, name):
    def made(*_):
        raise AssertionError("a table of pairs")

    monkeypatch.setattr(graph_queries, "near", made)
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_edges_are_neither_joined_nor_rounded_by_decimals(spark, sf_dir):
    plan = registry.QUERIES["edge_weights"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "ax#" not in plan


def test_assembly_holds_no_row_of_all_edges(spark, sf_dir, monkeypatch):
    from formwright.operators import classifier

    def made(*_):
        raise AssertionError("a row with a block's edges")

    monkeypatch.setattr(classifier, "graph_rows", made)
    assert registry.QUERIES["graph_assembly"](spark, sf_dir).count() > 0
