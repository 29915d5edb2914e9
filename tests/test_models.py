"""The classifier's gradients and laws, and small laws of statistics and clustering."""

import numpy as np
import pytest

from formwright.config import Config, Explainer, Model, Training, from_dict
from formwright.operators import classifier as gc
from formwright.operators import clustering as cl
from formwright.operators import statistics as st


def graph(i, n, rng):
    e = rng.integers(0, n, (2 * n, 2))
    e = e[e[:, 0] != e[:, 1]]
    s, d = np.concatenate((e[:, 0], e[:, 1])), np.concatenate((e[:, 1], e[:, 0]))
    return {"graph_id": i, "y": i % 3, "x": rng.standard_normal((n, 4)).tolist(), "src": s.tolist(), "dst": d.tolist(), "dist": np.ones(len(s)).tolist()}


def test_gradients():
    rng = np.random.default_rng(0)
    graphs = [graph(i, 6 + i, rng) for i in range(6)]
    model = Model(hidden_dim=8, output_dim=3, dropout=0.0)
    p, s = gc.start(4, model)
    loss = lambda q: gc.loss_and_gradient(graphs, q, s, model, 0.1, np.random.default_rng(1))
    _, g, _ = loss(p)
    for name in p:
        i = tuple(rng.integers(0, n) for n in p[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][i] += 1e-6
        down[name][i] -= 1e-6
        assert g[name][i] == pytest.approx((loss(up)[0] - loss(down)[0]) / 2e-6, rel=1e-3, abs=1e-7)


def test_node_order_does_not_matter():
    rng = np.random.default_rng(2)
    a = graph(0, 9, rng)
    order = rng.permutation(9)
    place = np.argsort(order)
    b = a | {"x": [a["x"][i] for i in order], "src": place[a["src"]].tolist(), "dst": place[a["dst"]].tolist()}
    model = Model(hidden_dim=8, output_dim=3)
    p, s = gc.start(4, model)
    from formwright.functions import tape as t

    out = [gc.forward(gc.side_by_side([x]), {k: t.Node(v) for k, v in p.items()}, s, model)[0].value for x in (a, b)]
    assert np.allclose(*out)
    assert gc.node_mask(a, p, s, model, Explainer(explain_epochs=3)).shape == (9, 4)


def test_parameters_as_a_table(spark):
    p, _ = gc.start(4, Model(hidden_dim=8, output_dim=3))
    back = gc.from_table(gc.parameter_table(spark, p))
    assert all(np.allclose(back[k], p[k], atol=1e-6) for k in p)


def test_silhouette_of_single_points(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 0, 0), (1, [1.0, 0.0], 0, 0), (2, [9.0, 0.0], 1, 0)], "id long, x array<double>, a int, b int")
    got = {r.name: r.score for r in cl.silhouettes(df, "id", "x", ["a", "b"]).collect()}
    assert got["b"] == 0 and got["a"] == pytest.approx((1 - 1 / 9 + 1 - 1 / 8 + 1) / 3)


def test_silhouette_covers_all_rows(spark, monkeypatch):
    import inspect

    for name, few in (("BLOCK", 40), ("SLAB", 16), ("CLUSTERS", 3), ("SAMPLE", 50)):
        if hasattr(cl, name):
            monkeypatch.setattr(cl, name, few)
    rng = np.random.default_rng(4)
    x, a = rng.normal(size=(300, 3)), rng.integers(0, 5, 300)
    a[7] = 9  # alone in its cluster
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in range(300):
        inner = d[i, a == a[i]].sum() / max((a == a[i]).sum() - 1, 1)
        outer = min(d[i, a == c].mean() for c in set(a.tolist()) - {a[i]})
        want.append(1.0 if (a == a[i]).sum() == 1 else (outer - inner) / max(outer, inner))
    df = spark.createDataFrame([(i, x[i].tolist(), int(a[i]), 0) for i in range(300)], "id long, x array<double>, a int, b int")
    assert "most" not in inspect.signature(cl.silhouettes).parameters
    got = {r.name: r.score for r in cl.silhouettes(df, "id", "x", ["a", "b"]).collect()}
    assert got["b"] == 0 and got["a"] == pytest.approx(np.mean(want), abs=1e-9)
    assert not cl.silhouettes(df.limit(0), "id", "x", ["a"]).collect()


def test_queries_do_their_whole_job(spark, sf_dir, monkeypatch):
    from dataclasses import replace

    from formwright.config import Explainer, Training
    from formwright.plans import cluster_queries as cq
    from formwright.plans import model_queries as mq

    assert (mq.HOW.epochs, mq.HOW.patience) == (Training().epochs, Training().patience)
    asked = {}
    monkeypatch.setattr(cl, "search_k", lambda *a, **b: asked.update(ks=list(a[4]), **b) or spark.createDataFrame([(4, 0.5, 0.5)], "k int, score double, largest_frac double"))
    cq.k_search(spark, sf_dir)
    assert asked == {"ks": list(range(4, 21)), "most": 20_000}
    monkeypatch.setattr(mq, "HOW", replace(mq.HOW, epochs=1))
    assert [r.fold for r in mq.gnn_cv(spark, sf_dir).select("fold").orderBy("fold").collect()] == list(range(mq.HOW.n_splits))
    explain = gc.explain
    monkeypatch.setattr(gc, "explain", lambda *a: asked.update(how=a[-1]) or explain(*a))
    mq.explain_masks(spark, sf_dir)
    assert asked["how"] == Explainer()


def test_folds_are_balanced(spark):
    from pyspark.sql import functions as F

    df = spark.range(1003).withColumn("y", F.col("id") % 3)
    n = [r["count"] for r in st.stratified_folds(df, "y", F.xxhash64("id"), 10).groupBy("y", "fold").count().collect()]
    assert len(n) == 30 and max(n) - min(n) <= 1


def test_config():
    c = from_dict({"graph": {"distance_threshold": 150}, "parcel_types": {"residential_names": ["a"]}})
    assert c.graph.distance_threshold == 150 and c.graph.min_buildings_per_block == 4 and c.parcel_types.residential_names == ("a",)
    with pytest.raises(KeyError):
        from_dict({"graph": {"nope": 1}})
    assert Config().training.n_splits == 10


def test_empty_tables(spark, sf_dir):
    from formwright.operators import graphs, shapes, spatial
    from formwright.plans.standins import buildings

    none = buildings(spark, sf_dir).where("false")
    assert shapes.building_features(none, ["building_id"]).count() == 0
    assert spatial.touching_pairs(none, "building_id").count() == 0
    assert graphs.delaunay_edges(none.select("block_id", none.building_id.alias("node"), none.x0.alias("x"), none.y0.alias("y"))).count() == 0


def test_unmapped_class_stops_the_run(spark):
    from formwright.operators.cleaning import CLASS_RECODE, recode

    with pytest.raises(Exception, match="no class for c 77"):
        recode(spark.createDataFrame([(77,)], "c int"), "c", CLASS_RECODE, "to").collect()


def test_shapefile_round_trip(spark, tmp_path):
    import struct

    from formwright.sources.shapefiles import read_shapefiles

    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    body = struct.pack("<i4d", 5, 0, 0, 2, 2) + struct.pack("<ii", 1, 5) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "t.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    field = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([8]) + b"\0" * 15
    (tmp_path / "t.dbf").write_bytes(b"\3\0\0\0" + struct.pack("<IHH", 1, 65, 9) + b"\0" * 20 + field + b"\r" + b" " + b"tower   ")
    row = read_shapefiles(spark, f"file://{tmp_path}").first()
    assert row.attributes == {"name": "tower"} and len(row.parts[0][0]) == 4
    (tmp_path / "t.shp").write_bytes((tmp_path / "t.shp").read_bytes() + struct.pack(">ii", 2, len(body) // 2) + body)  # more shapes than records
    assert sorted((r.record, r.attributes) for r in read_shapefiles(spark, f"file://{tmp_path}").collect()) == [(0, {"name": "tower"}), (1, {})]


def test_shapefile_layer(spark, tmp_path):
    """Holes by containment wherever they stand, several ranges of a tile, chosen columns, too long values, and a reader that needs no mounted folder."""
    from formwright.sources import shapefiles

    sq = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    rows = [(k, f"n{k}", "é" * (k % 5), [[sq(10.0 * k, 0.0, 9.0), sq(10.0 * k + 1, 1.0, 2.0)], [sq(10.0 * k, 20.0, 5.0)]]) for k in range(23)] + [(23, None, "x", None)]
    df = spark.createDataFrame(rows, "id int, name string, note string, parts array<array<array<struct<x: double, y: double>>>>")
    shapefiles.write_shapefiles(df.repartition(2), f"file://{tmp_path}/layer")
    back = shapefiles.read_shapefiles(spark, f"{tmp_path}/layer", ["id", "note"], records=4)
    assert back.rdd.getNumPartitions() >= 6
    got = {int(r.attributes["id"]): r for r in back.collect()}
    assert len(got) == 24 and got[23].parts is None and got[4].attributes == {"id": "4", "note": "é" * 4}
    for k in range(23):
        assert sorted(len(p) for p in got[k].parts) == [1, 2] and {len(r) for p in got[k].parts for r in p} == {4}
        assert [set(map(tuple, r)) for r in next(p for p in got[k].parts if len(p) == 2)] == [set(sq(10.0 * k, 0.0, 9.0)), set(sq(10.0 * k + 1, 1.0, 2.0))]
    assert shapefiles.read_remote_tiles(spark, f"file://{tmp_path}/layer").count() == 24
    with pytest.raises(Exception, match="raise the option width"):
        shapefiles.write_shapefiles(df, f"{tmp_path}/narrow", width=2)


def test_stored_layer_skips_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    from formwright.operators import spatial
    from formwright.plans.standins import buildings
    from formwright.sources import tables

    b = buildings(spark, "/root/testdata/sf0.1", placed=True).select("building_id", "block_id", "parts")
    tables.write_footprints(b, f"file://{tmp_path}/layer", row_group_bytes=32_000)
    box = (1_200.0, 1_200.0, 1_700.0, 1_600.0)
    found = tables.read_footprints(spark, [f"file://{tmp_path}/layer"], box)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = found.select("building_id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(minx" in plan and "GreaterThanOrEqual(maxy" in plan
    groups = []
    for f in tmp_path.glob("layer/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        groups += [{n: meta.row_group(k).column(at[n]).statistics for n in ("minx", "maxx", "miny", "maxy")} for k in range(meta.num_row_groups)]
    met = [s for s in groups if s["minx"].min <= box[2] and s["maxx"].max >= box[0] and s["miny"].min <= box[3] and s["maxy"].max >= box[1]]
    assert len(groups) > 40, len(groups)
    assert len(met) < len(groups) / 5, (len(met), len(groups))
    assert found.count() == spatial.with_bounds(b).where(spatial.in_box(*box)).count() > 0


def test_overlay_areas():
    from formwright.functions import kernels as k

    box = lambda x, y, w, h: np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], dtype=float)
    area = lambda parts: sum(k.polygon_area(p[0]) - sum(abs(k.polygon_area(h)) for h in p[1:]) for p in parts)
    assert area(k.overlay([[box(0, 0, 2, 2)], [box(1, 1, 2, 2)]])) == 7 and len(k.overlay([[box(0, 0, 2, 2)], [box(2, 0, 2, 2)]])[0][0]) == 4
    frame = [[box(0, 0, 6, 1)], [box(0, 5, 6, 1)], [box(0, 0, 1, 6)], [box(5, 0, 1, 6)]]
    assert area(k.overlay(frame)) == 20 and [len(p) for p in k.overlay(frame)] == [2]
    assert area(k.overlay(frame, [[box(0, 0, 3, 3)]])) == 5 and k.overlay(frame, [[box(9, 9, 1, 1)]]) == []
    rng = np.random.default_rng(1)
    for _ in range(40):
        p, q = ([[box(*rng.uniform(0, 10, 2), *rng.uniform(1, 6, 2)) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])]] for t in rng.uniform(0, 0.4, 2))
        assert area(k.overlay(p + q)) + area(k.overlay(p, q)) == pytest.approx(area(p) + area(q), abs=1e-3)


def test_quantile_by_ranks(spark):
    from formwright.operators import statistics

    for rows in ([3.0], [1.0, 2.0, 2.0, 9.0], [float(i * 37 % 101) for i in range(1000)] + [5.0] * 700):
        df = spark.createDataFrame([(v,) for v in [*rows, None]], "v double")
        for q in (0.0, 0.25, 0.5, 0.95, 1.0):
            assert statistics.exact_quantile(df, "v", q, small=0) == pytest.approx(statistics.exact_quantile(df, "v", q))
    assert statistics.exact_quantile(df.where("false"), "v", 0.5) is None


def test_folds_train_side_by_side(spark):
    """Each fold gets its own model, as good as when it is trained alone; a fold without validation graphs is refused."""
    from pyspark.sql import functions as F

    rows = [(i, i % 2, [[float(4 * (i % 2) - 2), 0.1 * i, 1.0, 0.0]] * 3, [0, 1], [1, 0], [1.0, 1.0]) for i in range(16)]
    graphs = spark.createDataFrame(rows, gc._GRAPH)
    folds = graphs.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("fold")).withColumn("train", F.when(F.col("fold") == 0, F.col("graph_id") % 8 < 6).otherwise(F.col("graph_id") % 8 >= 2))
    model, how = Model(hidden_dim=8, output_dim=2, dropout=0.0), Training(epochs=40, local_epochs=10, batch_size=4, learning_rate=0.02)
    batches = gc.mini_batches(folds, how.batch_size, how.seed).coalesce(1)
    both, alone = gc.fit(batches, 4, model, how), gc.fit(batches.where("fold = 1"), 4, model, how)
    assert sorted(both) == [0, 1] and both[0][2] < 0.6
    assert both[1][2] == pytest.approx(alone[1][2])
    pred = gc.predict(graphs, *both[0][:2], model).collect()
    assert all(r.pred == r.y for r in pred)
    with pytest.raises(ValueError):
        gc.fit(batches.where("train"), 4, model, how)


def test_forward_as_joins_equals_the_classifier(spark):
    """Two paths and a lone node, random weights: the tables give the logits of the batch code."""
    from formwright.functions import tape as t
    from formwright.operators import messages

    rng = np.random.default_rng(4)
    model = Model(hidden_dim=4, output_dim=3, edge_weight="inverse")
    params, stats = gc.start(3, model, seed=3)
    params = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32).astype(float) for k, v in params.items()}
    stats = {k: (v + rng.uniform(0, 0.3, v.shape)).astype(np.float32).astype(float) for k, v in stats.items()}
    graphs, nodes, edges = [], [], []
    for gid, n in enumerate((12, 7, 1)):
        x = rng.normal(size=(n, 3)).astype(np.float32)
        src, dst = [*range(n - 1), *range(1, n)], [*range(1, n), *range(n - 1)]
        dist = [*(1.0 + k % 3 for k in range(n - 1))] * 2
        graphs.append({"graph_id": gid, "y": 0, "x": x.tolist(), "src": src, "dst": dst, "dist": dist})
        nodes += [(gid, k, x[k].tolist()) for k in range(n)]
        edges += [(gid, *e) for e in zip(src, dst, dist, strict=True)]
    want, _ = gc.forward(gc.side_by_side(graphs), {k: t.Node(v) for k, v in params.items()}, stats, model)
    out = messages.forward(spark.createDataFrame(nodes, "block_id long, node int, x array<float>"), spark.createDataFrame(edges, "block_id long, src int, dst int, dist double"), gc.parameter_table(spark, params), gc.parameter_table(spark, stats), model)
    got = {r.block_id: r.logits for r in out.collect()}
    assert np.abs(np.array([got[k] for k in range(3)]) - want.value).max() < 1e-5


def test_silhouettes_in_rounds(spark, monkeypatch):
    """Many small rounds, slabs and flushes give the definition's scores; an empty table gives none."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 3)) + 4 * rng.integers(0, 3, (90, 1))
    labels = np.stack([rng.integers(0, 4, 90), np.where(np.arange(90) == 7, 99, x[:, 0] > 3)], axis=1).astype(int)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for own in labels.T:
        each = []
        for i, c in enumerate(own):
            means = {k: d[i, own == k].sum() / max((own == k).sum() - (k == c), 1) for k in set(own)}
            a, b = means.pop(c), min(means.values())
            each.append(1.0 if (own == c).sum() == 1 else (b - a) / max(a, b))
        want.append(np.mean(each))
    df = spark.createDataFrame([(i, x[i].tolist(), *map(int, labels[i])) for i in range(90)], "k int, x array<double>, one int, two int")
    for names in (("SENT", 60), ("BLOCK", 7), ("SLAB", 5), ("CLUSTERS", 2)):
        monkeypatch.setattr(cl, *names)
    got = {r.name: r.score for r in cl.silhouettes(df, "k", "x", ["one", "two"]).collect()}
    assert [got["one"], got["two"]] == pytest.approx(want)
    assert cl.silhouettes(df.where("false"), "k", "x", ["one"]).count() == 0


def test_steps_over_graphs_are_quick_and_the_same():
    """A step over 400,000 edges takes well under a second; graphs from Arrow are those of rows; sums by bins are those of np.add.at."""
    import time

    import pyarrow as pa

    from formwright.functions import tape as t

    rng = np.random.default_rng(5)
    rows = [graph(i, 7 + i, rng) for i in range(5)]
    kind = pa.struct([("graph_id", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.list_(pa.float32()))), ("src", pa.list_(pa.int32())), ("dst", pa.list_(pa.int32())), ("dist", pa.list_(pa.float64()))])
    one, two = gc.side_by_side(rows[1:4]), gc.from_arrow(pa.array(rows, kind)[1:4])
    assert one.ids == two.ids and one.n == two.n and all(np.allclose(getattr(one, f), getattr(two, f)) for f in ("x", "src", "dst", "dist", "graph", "y"))
    model = Model(hidden_dim=8, output_dim=3)
    p, s = gc.start(4, model)
    logits = lambda b, x=None: gc.forward(b, {k: t.Node(v) for k, v in p.items()}, s, model, x=x)[0].value
    assert np.allclose(logits(one), logits(one, t.Node(one.x))) and one.mixed is not None and np.allclose(logits(one), logits(two))
    at, v = rng.integers(0, 50, 400), rng.standard_normal((400, 3))
    want = np.zeros((50, 3))
    np.add.at(want, at, v)
    assert np.array_equal(t.scattered(at, v, 50), want)
    e = rng.integers(0, 3_000, (400_000, 2))
    big = gc.Batch(rng.standard_normal((3_000, 4)), e[:, 0], e[:, 1], np.ones(len(e)), np.zeros(3_000, int), np.array([1]), [0], 1)
    gc.gradient_of(big, p, s, model, 0.1, np.random.default_rng(1))
    began = time.process_time()
    for _ in range(5):
        gc.gradient_of(big, p, s, model, 0.1, np.random.default_rng(1))
    assert time.process_time() - began < 1.0


def test_graphs_of_places_are_those_of_edges(spark):
    """Rows with places and a reach give the same steps as rows with all edges, and don't hold them."""
    from pyspark.sql import functions as F

    from formwright.operators import graphs, neighbours

    rng = np.random.default_rng(11)
    nodes = [(b, i, float(x), float(y), [float(v) for v in rng.standard_normal(3)]) for b in (1, 2) for i, (x, y) in enumerate(rng.random((40, 2)) * 60)] + [(3, 0, 0.0, 0.0, [1.0] * 3), (3, 1, 99.0, 0.0, [1.0] * 3)]
    df = spark.createDataFrame(nodes, "block_id long, node_idx int, px double, py double, x array<double>")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "block_id long, y int")
    edges = graphs.symmetric(neighbours.pairs(df.select("block_id", "node_idx", F.col("px").alias("x"), F.col("py").alias("y")), "node_idx", 20.0, ["block_id"]))
    whole, placed = gc.graph_rows(df, edges, labels), gc.placed_graphs(df, labels, 20.0)
    assert "src" not in placed.columns and {r.graph_id for r in placed.collect()} == {1, 2}
    p, s = gc.start(3, Model(hidden_dim=8))
    told = lambda g: {r.graph_id: (r.pred, pytest.approx(r.prob)) for r in gc.predict(g, p, s, Model(hidden_dim=8)).collect()}
    assert told(whole) == {k: (a, b.expected) for k, (a, b) in told(placed).items()}
    how = Training(epochs=2, batch_size=8)
    fold = lambda g: gc.mini_batches(g.select(F.lit(0).alias("fold"), F.explode(F.array(F.lit(True), F.lit(False))).alias("train"), *g.columns), 8, 1)
    one, two = (gc.fit(fold(g), 3, Model(hidden_dim=8, dropout=0.0), how)[0][2] for g in (whole, placed))
    assert one == pytest.approx(two)
