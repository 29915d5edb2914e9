"""Core form types: embedding, K-means, silhouette, the choice of K, names and representatives of types."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import zscores

#: Points that the search for K and the layout are run on, those with the smallest hash of their key.
SAMPLE = 20_000
#: For silhouettes: numbers that a round sends to every task (64 MB), rows that a task compares with so many of them at a time, and clusters whose sums it holds.
SENT, SLAB, BLOCK, CLUSTERS = 8_000_000, 1_000, 4_000, 1_000
#: K-means fits that run at a time.
FITS = 8


def matrix(df: DataFrame, columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def bounded_sample(df: DataFrame, key: str, most: int = SAMPLE) -> DataFrame:
    """At most `most` rows, the same on every run."""
    return df.orderBy(F.xxhash64(key), key).limit(most)


def pca(df: DataFrame, x: str, width: int, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the k leading components (rows): the second moments are one aggregation of width * (width + 3) / 2 sums; signs make each largest loading positive."""
    i, j = np.triu_indices(width)
    sums = df.agg(F.count("*").alias("n"), *[F.avg(F.col(x)[a]).alias(f"m{a}") for a in range(width)])
    row = sums.first()
    if not row.n:
        return np.zeros(width), np.zeros((k, width))
    mean = np.array([row[f"m{a}"] for a in range(width)])
    moved = df.select(F.transform(x, lambda v, n: v - F.array(*map(F.lit, mean.tolist()))[n]).alias("v"))
    products = moved.agg(*[F.sum(F.col("v")[int(a)] * F.col("v")[int(b)]).alias(f"p{a}_{b}") for a, b in zip(i, j, strict=True)]).first()
    cov = np.zeros((width, width))
    for a, b in zip(i, j, strict=True):
        cov[a, b] = cov[b, a] = products[f"p{a}_{b}"] / max(row.n - 1, 1)
    _, vectors = np.linalg.eigh(cov)
    top = vectors[:, ::-1][:, :k].T
    return mean, top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])[:, None]


def project(x: Column, mean: np.ndarray, components: np.ndarray) -> Column:
    """The centred projection, as an expression: the model goes into the plan."""
    dot = lambda c: F.aggregate(F.zip_with(F.zip_with(x, F.array(*map(F.lit, mean.tolist())), lambda v, m: v - m), F.array(*map(F.lit, c.tolist())), lambda v, w: v * w), F.lit(0.0), lambda s, d: s + d)
    return F.array(*[dot(c) for c in components])


def kmeans_each(df: DataFrame, x: str, ks: Iterable[int], restarts: int = 10, iterations: int = 300, seed: int = 42) -> dict[int, list[list[float]]]:
    """For each k, the centres of the best of several starts, ordered by size of cluster (largest first), then by place, so that ids don't depend on the start.

    All fits share one cached table, FITS of them at a time: each is a row of short jobs that leave most cores idle.
    """
    data = df.select(array_to_vector(F.col(x).cast("array<double>")).alias("features")).persist()

    def one(job: tuple[int, int]) -> tuple[int, float, list[list[float]]]:
        k, r = job
        model = KMeans(k=k, maxIter=iterations, tol=1e-4, seed=seed + r).fit(data)
        centres, sizes = [c.tolist() for c in model.clusterCenters()], model.summary.clusterSizes
        order = sorted(range(len(centres)), key=lambda c: (-sizes[c], tuple(centres[c])))
        return k, model.summary.trainingCost, [centres[c] for c in order]

    best: dict[int, tuple[float, list[list[float]]]] = {}
    try:
        data.count()
        with ThreadPoolExecutor(FITS) as pool:
            for k, cost, centres in pool.map(inheritable_thread_target(df.sparkSession)(one), [(k, r) for k in ks for r in range(restarts)]):
                if k not in best or cost < best[k][0]:
                    best[k] = cost, centres
    finally:
        data.unpersist()
    return {k: centres for k, (_, centres) in best.items()}


def kmeans(df: DataFrame, x: str, k: int, restarts: int = 10, iterations: int = 300, seed: int = 42) -> list[list[float]]:
    return kmeans_each(df, x, [k], restarts, iterations, seed)[k]


def _distance_sums(batches: Iterator[pa.RecordBatch], sent, names: list[str]) -> Iterator[pa.RecordBatch]:
    """row, name, own, cluster, s: for each row the summed distance to those of each cluster among the rows that were sent.

    Sums leave when a slab has met all of them, or its CLUSTERS-th cluster, so one row may come in parts.
    """
    ids, points, codes = sent.value
    norms = (points**2).sum(axis=1)
    for batch in batches:
        rows = batch.column(0).to_numpy(zero_copy_only=False)
        xs = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        own = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for a in range(0, len(rows), SLAB):
            r, x, mine = rows[a : a + SLAB], xs[a : a + SLAB], own[a : a + SLAB]
            sums: dict[tuple[int, int], np.ndarray] = {}

            def flush() -> Iterator[pa.RecordBatch]:
                for (j, cluster), total in sums.items():  # noqa: B023
                    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array([names[j]] * len(r), pa.string()), pa.array(mine[:, j]), pa.array(np.full(len(r), cluster)), pa.array(total)], names=["row", "name", "own", "cluster", "s"])  # noqa: B023
                sums.clear()  # noqa: B023

            for c in range(0, len(ids), BLOCK):
                i, q, code = ids[c : c + BLOCK], points[c : c + BLOCK], codes[c : c + BLOCK]
                d = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + norms[None, c : c + BLOCK] - 2 * x @ q.T, 0))
                at = np.minimum(np.searchsorted(i, r), len(i) - 1)
                same = np.flatnonzero(i[at] == r)
                d[same, at[same]] = 0
                for j in range(len(names)):
                    for cluster in np.unique(code[:, j]).tolist():
                        part = d[:, code[:, j] == cluster].sum(axis=1)
                        sums[j, cluster] = sums[j, cluster] + part if (j, cluster) in sums else part
                if len(sums) >= CLUSTERS:
                    yield from flush()
            yield from flush()


def silhouettes(df: DataFrame, key: str, x: str, labels: list[str]) -> DataFrame:
    """name, score: for each label column, the mean Euclidean silhouette over all rows.

    A point alone in its cluster scores 1; fewer than two clusters score 0. A null label is a cluster of its own. The work grows with the square of the rows. Rows are sent to all tasks in rounds of about
    SENT numbers, a size that does not depend on the table, and every round is a pass over the stored rows: no row is shuffled, only each row's sums for its clusters.
    """
    from .components import stored

    spread = df.select(x, *labels).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = spread.select(F.monotonically_increasing_id().alias("row"), F.col(x).cast("array<double>").alias("x"), F.array(*[F.xxhash64(name) for name in labels]).alias("codes"))
    rows = stored(rows, "silhouette-rows")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    rounds = -(-size.n * ((size.width or 0) + len(labels)) // SENT) or 1
    sums = None
    for k in range(rounds):
        part = rows.where(F.pmod(F.xxhash64("row"), F.lit(rounds)) == k).toArrow().sort_by("row")
        flat = lambda c, width: part.column(c).combine_chunks().flatten().to_numpy().reshape(part.num_rows, width)  # noqa: B023, E731
        sent = df.sparkSession.sparkContext.broadcast((part.column("row").to_numpy(), flat("x", size.width or 0), flat("codes", len(labels))))
        made = rows.mapInArrow(lambda it, sent=sent: _distance_sums(it, sent, labels), "row long, name string, own long, cluster long, s double")
        sums = made if sums is None else sums.unionByName(made)
    sums = stored(sums.groupBy("row", "name", "own", "cluster").agg(F.sum("s").alias("s")), "silhouette-sums")
    sizes = rows.select(F.inline(F.arrays_zip(F.array(*map(F.lit, labels)).alias("name"), F.col("codes").alias("cluster")))).groupBy("name", "cluster").agg(F.count("*").alias("n"))
    at = sums.join(sizes, ["name", "cluster"])
    mine, inner = F.col("own") == F.col("cluster"), F.col("s") / F.greatest(F.col("n") - 1, F.lit(1))
    each = at.groupBy("name", "row").agg(F.max(F.when(mine, inner)).alias("a"), F.max(F.when(mine, F.col("n"))).alias("n"), F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("b"))
    top = F.greatest("a", "b")
    score = F.when(F.col("b").isNull(), 0.0).when(F.col("n") == 1, 1.0).when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return each.groupBy("name").agg(F.avg(score).alias("score"))


def best_k(scores: DataFrame) -> DataFrame:
    """The row (k, score) with the greatest score, the smallest k of equals."""
    return scores.agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"), F.max("score").alias("score"))


def search_k(df: DataFrame, key: str, embedded: str, features: str, ks: range, restarts: int = 10, most: int = SAMPLE) -> DataFrame:
    """k, score, largest_frac: clusters are found in the embedding and scored in the feature space, on one bounded sample."""
    from .components import stored
    from .spatial import squared_distances

    sample = stored(bounded_sample(df.select(*dict.fromkeys((key, embedded, features))), key, most), "k-sample")
    away = {f"k{k}": squared_distances(F.col(embedded), centres) for k, centres in kmeans_each(sample, embedded, ks, restarts).items()}
    labelled = stored(sample.withColumns(away).withColumns({name: F.array_position(name, F.array_min(name)) - 1 for name in away}), "k-labels")
    scores = silhouettes(labelled, key, features, [f"k{k}" for k in ks]).select(F.substring("name", 2, 9).cast("int").alias("k"), "score")
    share = labelled.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("c")) for k in ks]))).groupBy("k", "c").agg(F.count("*").alias("n"))
    return scores.join(share.groupBy("k").agg((F.max("n") / F.sum("n")).alias("largest_frac")), "k")


def guarded_best(grid: DataFrame, limit: float = 0.90) -> DataFrame:
    """The best row of a grid by score among those whose largest cluster is below the limit; among all where none is."""
    rank = F.struct((F.col("largest_frac") < limit).alias("sound"), F.col("score"))
    return grid.agg(F.max_by(F.struct(*grid.columns), rank).alias("best")).select("best.*")


def type_zmeans(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """kind, feature, z: mean z-score (sample deviation) of each feature in each type."""
    z = zscores(df, columns, sample=True)
    means = z.groupBy(kind).agg(*[F.avg(c).alias(c) for c in columns])
    return means.select(kind, F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("z")) for i, c in enumerate(columns)])))


def type_means(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """kind, n and the mean of each (scaled) feature in each type; nulls don't count, a type of none has a null mean."""
    return df.groupBy(kind).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def feature_subset(names: list[str], source: str, explained: list[str] = (), custom: list[str] = ()) -> list[str]:
    """The features that types are made of, in the order of names: those that explanations found (fs_from_explainer), all, or the listed ones (custom). Unknown names are dropped; none left: all."""
    if source not in ("fs_from_explainer", "all", "custom"):
        raise ValueError(f"unknown feature source {source}")
    wanted = {"fs_from_explainer": explained, "all": names, "custom": custom}[source]
    return [n for n in names if n in set(wanted)] or list(names)


def top_by(df: DataFrame, group: str, order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank from 1. Spark cuts each group to n rows before the shuffle where the plan allows."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= n)


def type_names(zmeans: DataFrame, kind: str, n: int = 2) -> DataFrame:
    """kind, name: `T<k>: High-x/Low-y` from the features whose z is farthest from 0 (0 counts as high)."""
    top = top_by(zmeans, kind, [F.desc(F.abs("z")), "position"], n)
    part = F.concat(F.when(F.col("z") >= 0, "High-").otherwise("Low-"), F.col("feature"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("p")))), lambda s: s.p)
    return top.groupBy(kind).agg(F.concat(F.lit("T"), F.col(kind).cast("string"), F.lit(": "), F.array_join(parts, "/")).alias("name"))


def core_features(zmeans: DataFrame, kind: str, n: int = 4) -> DataFrame:
    """position, feature: the tops of all types put together in the order of type and rank, each once."""
    top = top_by(zmeans, kind, [F.desc(F.abs("z")), "position"], n).drop("position")
    first = top.groupBy("feature").agg(F.min(F.struct(kind, "rank")).alias("first"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first"))).select("position", "feature")


def representatives(df: DataFrame, kind: str, x: Column, width: int, key: str, n: int = 30) -> DataFrame:
    """kind, key, dist, rank: the rows of each type nearest to its mean."""
    rows = df.select(kind, key, x.cast("array<double>").alias("x"))
    means = rows.groupBy(kind).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("m"))
    dist = F.sqrt(F.aggregate(F.zip_with("x", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    return top_by(rows.join(F.broadcast(means), kind).select(kind, key, dist.alias("dist")), kind, ["dist", key], n)


def crosstab(df: DataFrame, row: str, column: str, columns: list) -> DataFrame:
    """One row per `row` value with the share of each listed `column` value; 0 for none."""
    counts = df.groupBy(row).pivot(column, columns).agg(F.count(F.lit(1))).fillna(0)
    total = sum((F.col(str(c)) for c in columns), F.lit(0))
    return counts.select(row, *[F.coalesce(F.try_divide(F.col(str(c)), total), F.lit(0.0)).alias(f"{column}_{c}") for c in columns])


def minmax_profile(df: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Mean per type of features scaled to [0, 1] over all rows."""
    span = df.agg(*[x for c in columns for x in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))])
    width = lambda c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")).otherwise(1e-12)
    return df.join(F.broadcast(span)).groupBy(kind).agg(*[F.avg((F.col(c) - F.col(f"_lo_{c}")) / width(c)).alias(c) for c in columns])
