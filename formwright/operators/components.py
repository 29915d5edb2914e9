"""Connected components of a table of pairs, for merging buildings that touch or lie close."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder of spark.checkpoint.dir. Where that is unset, a temporary folder in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="formwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage is cut and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Pairs that one task unites at a time: bounds its memory.
CHUNK = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the pairs and the smallest node that pairs lead each to, without nodes that are their own."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[left], parent[right])
        after = parent.copy()
        # A tree hangs itself below the smallest tree next to it, then every node points to its own root again.
        np.minimum.at(after, parent[left], low)
        np.minimum.at(after, parent[right], low)
        while (above := after[after]).tobytes() != after.tobytes():
            after = above
        if after.tobytes() == parent.tobytes():
            break
        parent = after
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def united(pairs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node, label (label < node): stars that connect what the pairs (a, b) connect, one for each component of at most some `chunk` pairs of a task.

    Never more rows than pairs. Few pairs are one task's, so their stars are the components; of many pairs, ranges of a are united, which are near each other where keys follow a layer's order.
    """
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            node, label = roots(table.column("a").to_numpy(), table.column("b").to_numpy())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(node, table.schema.field("a").type), pa.array(label, table.schema.field("a").type)], names=["node", "label"])

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= chunk:
                yield flush()
        if held:
            yield flush()

    return pairs.where("a <> b").select("a", F.col("b").cast(kind).alias("b")).repartitionByRange("a").mapInArrow(run, f"node {kind}, label {kind}")


def connected(pairs: DataFrame, nodes: DataFrame, key: str, chunk: int = CHUNK) -> DataFrame:
    """key, group_id: the smallest key that pairs (a, b) lead to; nodes without pairs are groups of their own.

    Tasks first unite the pairs that they hold. Where their stars meet, every round passes the smallest label over each star's sides and then to the label's own label, so chains halve; rounds end
    when no label moves. Pairs with a null are no pairs.
    """
    stars = stored(united(stored(pairs.select("a", "b").dropna(), "pairs"), chunk), "stars")
    several = stars.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    inner = stars.select(F.col("label").alias("node")).join(stars.select("node"), "node", "left_semi")
    labels = stars if several.unionByName(inner).isEmpty() else _passed(stars)
    return nodes.select(key).join(labels.select(F.col("node").alias(key), "label"), key, "left").select(key, F.coalesce("label", key).alias("group_id"))


def _passed(stars: DataFrame) -> DataFrame:
    """node, label: the smallest node that stars (node, label) lead to."""
    sides = stars.select(F.col("node").alias("a"), F.col("label").alias("b"))
    links = stored(sides.unionByName(sides.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")

    def hop(now: DataFrame) -> DataFrame:
        """node, label from node, label: the smallest label around, then that label's own."""
        seen = links.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        near = now.join(seen, "node").select("node", F.least("label", "near").alias("next"))
        jump = now.select(F.col("node").alias("next"), F.col("label").alias("far"))
        return near.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"))

    while True:  # two hops for each table that is written
        after = stored(hop(hop(labels)).join(labels.select("node", F.col("label").alias("before")), "node"), "labels")
        if after.where("label <> before").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
