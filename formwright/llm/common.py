"""Shared helpers: scratch tables in the cluster's shared folder and vectorised hashing of words."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes at a time; bounds a Python worker's memory.
CHUNK_BYTES = 2_000_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 2**64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one in local mode only: elsewhere executors could not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="formwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later jobs start from files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one run in the shared folder, dropped as soon as nothing needs them, so that the disk holds few stages at a time."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later job reads, and let Spark's cleaner delete the shuffle files of finished jobs."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        for wait in (0.3, 0.0):  # the last job's plan is let go a moment after it ends
            gc.collect()
            jvm.System.gc()
            time.sleep(wait)


def whole_texts(df: DataFrame) -> DataFrame:
    """doc_id and text alone, null texts as empty ones; other columns of the input, whatever their names, stay out."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: A key with more rows than this is hot; up to so many hot keys (some 40 bytes each) go to every task.
HOT_KEY, MOST_HOT = 2_000, 200_000


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None, hot: int = HOT_KEY) -> DataFrame:
    """left joined with right on `on`, where few keys may hold most rows of left: the rows of a hot key are dealt over parts by their hash, and right's row for it is repeated for each part.

    left must be cheap to read twice. counts: rows of left for each key, in a column n, where they are known. Beyond MOST_HOT hot keys Spark's own
    splitting of skewed joins is left to it. The result has the columns of left.join(right, on, how).
    """
    if counts is None:
        counts = left.groupBy(*on).agg(F.count("*").alias("n"))
    parts = saved(counts.where(F.col("n") > hot).select(*on, F.ceil(F.col("n") / hot).cast("int").alias("parts__")), "hot-keys")
    if not 0 < parts.count() <= MOST_HOT:
        return left.join(right, on, how)
    part = F.when(F.col("parts__").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("parts__"))).cast("int")
    dealt = left.join(F.broadcast(parts), on, "left").withColumn("part__", part).drop("parts__")
    copies = right.join(F.broadcast(parts), on, "left").withColumn("part__", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts__") - 1, F.lit(0))))).drop("parts__")
    return dealt.join(copies, [*on, "part__"], how).drop("part__")


def smaller_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Let no Arrow batch of this session hold more rows than this: a worker and its JVM each hold a few batches at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, rows)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one piece holds about `size` bytes of text (one document at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        if not len(sizes):
            continue
        part = np.cumsum(sizes) // size
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def unit(h: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1] from 64-bit hashes."""
    return ((h >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if len(_powers.get(key, ())) < n:
        p = np.full(max(n, CHUNK_BYTES + CHUNK_BYTES // 4), base, dtype=_U)
        p[0] = 1
        _powers[key] = np.cumprod(p, dtype=_U)
    return _powers[key][:n]


#: True for the bytes that part words: ASCII white space.
WHITE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8))
#: True for all bytes but a-z and those of letters outside ASCII.
NOT_LETTER = ~((np.arange(256) >= 128) | ((np.arange(256) >= ord("a")) & (np.arange(256) <= ord("z"))))


def word_hashes(texts: list[bytes], parting: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts; first[i]:first[i + 1] are those of text i; byte starts and ends in the joined texts.

    A word is a maximal run of bytes that don't part words. The hash of a word is a difference of prefix sums
    of a polynomial, so the cost is a few passes over the bytes whatever the words.
    """
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = ~parting[buf]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(buf)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum((buf.astype(_U) + _U(1)) * _power(_BASE, n), dtype=_U, out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * _power(_BASE_INV, n)[starts]) if len(starts) else np.zeros(0, dtype=_U)
    return h, np.searchsorted(starts, offsets[: len(texts) + 1]), starts, ends


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words and the index of their text; a text of fewer words, but one at least, is one shingle."""
    counts = np.diff(first)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), runs)
    if not len(doc):
        return np.zeros(0, dtype=_U), doc
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + first[:-1][doc]
    size = np.minimum(counts, width)[doc]
    h = np.zeros(len(doc), dtype=_U)
    for k in range(width):
        inside = k < size
        word = words[np.where(inside, at + k, at)]
        h = np.where(inside, mix(h * _U(0x100000001B3) + word + _U(k + 1)), h)
    return h, doc
