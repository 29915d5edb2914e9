"""Exact dedup by content sort.

Sampled splitters range-partition the texts (by first characters, digest and doc_id, so that a group of copies of
any size spreads over as many partitions as it needs), Spark's external sort places equal texts next to each
other, and each text is compared in full with its neighbour. Groups that cross a partition's border are joined
afterwards from one summary row for each end of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, smaller_batches, table

#: First characters that go before the digest in the sort key; bounds what the sampled splitters weigh on the driver.
PREFIX_CHARS = 32
_RUN = "doc_id long, text_sha256 string, part int, run long, keep_id long, group_size long, at_edge boolean"


def _runs(batches: Iterator[pa.RecordBatch], keep_largest: bool) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours in one sorted partition. What is held at a time: one batch, and the ids of the run that is open."""
    part = TaskContext.get().partitionId()
    ids: list[int | None] = []
    last: tuple[str, str] | None = None
    run = 0

    def close(edge: bool) -> pa.RecordBatch:
        n = len(ids)
        known = [i for i in ids if i is not None]
        keep = (max if keep_largest else min)(known) if known else None
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([last[0]] * n), pa.array([part] * n, pa.int32()), pa.array([run] * n, pa.int64()),
             pa.array([keep] * n, pa.int64()), pa.array([n] * n, pa.int64()), pa.array([edge] * n)],
            names=["doc_id", "text_sha256", "part", "run", "keep_id", "group_size", "at_edge"])

    out: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        text, sha, doc = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        same = pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_pylist()
        starts = [0, *(i + 1 for i, x in enumerate(same) if not x), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a == 0 and last is not None and text[0].as_py() == last[1]:
                ids += doc[a:b]
                continue
            if last is not None:
                out.append(close(run == 0))
                run += 1
            ids, last = doc[a:b], (sha[a].as_py(), text[a].as_py())
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if last is not None:
        yield close(True)


def exact_groups(docs: DataFrame, keep_largest: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their characters are identical; a null text counts as empty. Of equal texts the row with the
    smallest doc_id stays, or the largest. Rows that repeat a doc_id all count for group_size; where the kept doc_id
    itself repeats within its group, each of its rows says kept, as nothing tells them apart. A null doc_id is kept only in a group
    that has no other. An empty table gives an empty result; other columns are not read.
    """
    smaller_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha"), "doc_id")
    spread = [F.substring("text", 1, PREFIX_CHARS), F.col("sha"), F.col("doc_id")]
    ordered = rows.repartitionByRange(*spread).sortWithinPartitions(F.substring("text", 1, PREFIX_CHARS), "sha", "text", "doc_id")
    runs = saved(ordered.mapInArrow(lambda it: _runs(it, keep_largest), _RUN), "content-runs")
    # At most two runs of a partition touch its ends: this table has at most two rows for each partition, whatever the input.
    edge = runs.where("at_edge").groupBy("text_sha256", "part", "run").agg(F.max("keep_id").alias("keep"), F.max("group_size").alias("n"))
    best = F.max("keep") if keep_largest else F.min("keep")
    joined = edge.groupBy("text_sha256").agg(best.alias("all_keep"), F.sum("n").alias("all_n"))
    whole = runs.where("NOT at_edge").select("doc_id", "keep_id", "group_size", "text_sha256")
    split = (
        runs.where("at_edge").join(F.broadcast(joined), "text_sha256")
        .select("doc_id", F.col("all_keep").alias("keep_id"), F.col("all_n").alias("group_size"), "text_sha256")
    )
    return whole.unionByName(split).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep_largest: bool = True) -> DataFrame:
    """The documents without their exact copies, all columns kept, whatever their names.

    Null texts count as empty. Of equal texts the row with the largest doc_id stays, or the smallest; rows that repeat both doc_id and text become one. A null
    doc_id stays only where its text has no other. An empty table gives an empty result.
    """
    kept = exact_groups(docs, keep_largest).where("kept").select(F.col("doc_id").alias("of_id"), F.col("text_sha256").alias("of_text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn("sha", F.sha2(F.coalesce(F.col("doc.text"), F.lit("")).cast("binary"), 256))
    found = rows.join(kept, F.col("doc.doc_id").eqNullSafe(F.col("of_id")) & (F.col("sha") == F.col("of_text")), "left_semi")
    return found.withColumn("id", F.col("doc.doc_id")).dropDuplicates(["id", "sha"]).select("doc.*")


def op9_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"), keep_largest=True)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
