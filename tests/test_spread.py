"""Work that is spread over tasks gives what one task would give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formwright.functions import kernels as k
from formwright.operators import components, graphs


def expected(p):
    t = k.delaunay(p)
    return {tuple(e) for e in np.sort(np.concatenate((t[:, [0, 1]], t[:, [0, 2]], t[:, [1, 2]])), axis=1).tolist()}


@pytest.mark.parametrize("kind", ["even", "clustered", "line", "strip"])
def test_large_blocks_are_triangulated_by_cells(spark, kind):
    r = np.random.default_rng(5)
    p = {
        "even": r.random((3000, 2)) * 1000,
        "clustered": np.concatenate([r.normal(c, 3, (700, 2)) for c in (0.0, 40.0, 900.0)] + [r.random((300, 2)) * 1000]),
        "line": np.stack([np.arange(1500.0), np.arange(1500.0)], axis=1),
        "strip": r.random((1500, 2)) * (1000, 2),
    }[kind]
    rows = [(7, i, float(x), float(y)) for i, (x, y) in enumerate(p)]
    small = [(8, 10_000 + i, float(x), float(y)) for i, (x, y) in enumerate(p[:20])]
    df = spark.createDataFrame([*rows, *small, (7, -1, None, 1.0), (7, 99_999, *rows[0][2:])], "block_id long, node long, x double, y double")
    got = graphs.delaunay_edges(df, task_points=200).collect()
    assert len(got) == len({(e.block_id, e.a, e.b) for e in got})
    assert {(e.a, e.b) for e in got if e.block_id == 7} == expected(p)
    assert {(e.a - 10_000, e.b - 10_000) for e in got if e.block_id == 8} == expected(p[:20])
    assert all(abs(e.dist - np.hypot(*(p[e.a] - p[e.b]))) < 1e-9 for e in got if e.block_id == 7)


@pytest.mark.parametrize("chunk", [3, 1_000_000])
def test_components_over_many_tasks(spark, chunk):
    r = np.random.default_rng(chunk)
    chain = r.permutation(200)
    pairs = [(int(a), int(b)) for a, b in zip(chain[:-1], chain[1:])] + [(300, 301), (301, 300), (302, 302), (400, 403), (403, 401)]
    df = spark.createDataFrame([*pairs, (500, None)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(600)], "id long")
    spark.conf.set("spark.sql.adaptive.enabled", "false" if chunk == 3 else "true")
    try:
        got = {x.id: x.group_id for x in components.connected(df, nodes, "id", chunk).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = {i: i for i in range(600)} | {i: 0 for i in range(200)} | {301: 300, 401: 400, 403: 400}
    assert got == want


def test_components_of_text_keys_and_of_none(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    nodes = spark.createDataFrame([(v,) for v in "abcxyz"], "id string")
    assert {x.id: x.group_id for x in components.connected(df, nodes, "id").collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    assert components.connected(df.limit(0), nodes, "id").where(F.col("id") != F.col("group_id")).count() == 0
