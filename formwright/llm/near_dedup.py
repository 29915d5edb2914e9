"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is a set of weighted shingles. Every shingle is a Poisson process whose rate is its weight: its points
arrive at times, and for slots, drawn from the shingle's hash alone. A slot's signature is the shingle that
arrives there first; two documents agree in a slot with the probability Jaccard similarity of their weights.
Points later than the time by which all slots are nearly surely full are never drawn.

A link needs the similarity in probability Jaccard or in plain Jaccard of the shingles. A document that repeats shingles has two
signatures, one with its weights and one with all weights 1, so that pairs close in either sense share a bucket; where no shingle repeats, both are one.

Documents with equal weighted shingles are one class from the start, so groups of copies cost one row each. In a
bucket of a band, every member is first compared with the bucket's smallest member. Buckets whose members are then
still in several components are dealt in blocks: each pair of blocks is dealt by itself, compares all members
across components and returns only links. A pair within one component adds no link between classes.
Verification is exact on the low 32 bits of the shingles' hashes: two texts of 500 shingles each have a false one in common with a chance of 0.00006.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, saved, shingles, skew_join, smaller_batches, table, text_chunks, unit, whole_texts, word_hashes
from .graph import components

WORDS = 5
SIMILARITY = 0.8
#: Members of one block of a bucket, and shingles that are compared at a time.
BLOCK, SLAB = 64, 16_384
#: 24 bands of 5 slots: a pair at 0.8 shares a bucket with probability 0.9999.
BANDS, ROWS = 24, 5
_U = np.uint64


def weighted_shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (32 bits and more of their hash, ascending in each text), their counts, and where each text's begin."""
    h, first, _, _ = word_hashes([t.lower().encode() for t in texts])
    s, doc = shingles(h, first, words)
    key = np.sort((doc.astype(_U) << _U(40)) | (s >> _U(24)))
    if not len(key):
        return key, np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    counts = np.diff(np.concatenate((at, [len(key)])))
    key = key[at]
    begin = np.searchsorted(key, np.arange(len(texts) + 1).astype(_U) << _U(40))
    return key & _U((1 << 40) - 1), counts, begin


def signatures(elements: np.ndarray, weights: np.ndarray, begin: np.ndarray, slots: int) -> np.ndarray:
    """One row of `slots` elements for each document: the first arrivals. Documents without elements get zeros."""
    n = len(begin) - 1
    sizes = np.diff(begin)
    doc = np.repeat(np.arange(n), sizes)
    best, sig = np.full(n * slots, np.inf), np.zeros(n * slots, dtype=_U)
    total = np.bincount(doc, weights, minlength=n)
    until = np.divide(slots * (np.log(slots) + 3.0), total, out=np.zeros(n), where=total > 0)
    todo = sizes > 0
    while todo.any():
        pick = todo[doc]
        e, w, d = elements[pick], weights[pick], doc[pick]
        t, points, k = np.zeros(len(e)), [], 0
        while len(e):
            r = mix(e * _U(0x9E3779B97F4A7C15) + _U((k + 1) * 0xD1B54A32D192ED03 % 2**64))
            t = t - np.log(unit(r)) / w
            early = t <= until[d]
            e, w, d, t, r, k = e[early], w[early], d[early], t[early], r[early], k + 1
            points.append((d * slots + ((mix(r ^ _U(0xA0761D6478BD642F)) >> _U(32)) * _U(slots) >> _U(32)).astype(np.int64), t, e))
        slot, time, element = (np.concatenate(x) for x in zip(*points, strict=True))
        np.minimum.at(best, slot, time)
        first = best[slot] == time
        sig[slot[first]] = element[first]
        todo &= np.isinf(best.reshape(n, slots)).any(axis=1)
        until = np.where(todo, until * 2, until)
    return sig.reshape(n, slots)


def _bands(sig: np.ndarray) -> np.ndarray:
    """One hash for each band of signatures (texts, bands, rows)."""
    h = np.zeros(sig.shape[:2], dtype=_U)
    for k in range(sig.shape[2]):
        h = mix(h * _U(0x100000001B3) + sig[:, :, k] + _U(1))
    return h


def _sketch(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """doc_id, a digest of the weighted shingles, and two hashes for each band: by weights, and by weights of 1."""
    for batch in text_chunks(batches):
        texts = batch.column(1).to_pylist()
        ids, counts, begin = weighted_shingles(texts, words)
        by_weight = _bands(signatures(ids, 1.0 + np.log(counts), begin, bands * rows).reshape(len(texts), bands, rows))
        plain = by_weight.copy()
        repeats = np.flatnonzero(np.add.reduceat(np.append(counts > 1, False), begin[:-1]) * (np.diff(begin) > 0)) if len(texts) else begin[:0]
        if len(repeats):
            mine = np.isin(np.repeat(np.arange(len(texts)), np.diff(begin)), repeats)
            first = np.concatenate(([0], np.cumsum(np.diff(begin)[repeats])))
            plain[repeats] = _bands(signatures(ids[mine], np.ones(int(mine.sum())), first, bands * rows).reshape(len(repeats), bands, rows))
        keys = [None if a == b else hashlib.blake2b(ids[a:b].tobytes() + counts[a:b].tobytes(), digest_size=16).digest() for a, b in zip(begin[:-1], begin[1:], strict=True)]
        both = np.concatenate((by_weight, plain), axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(both.view(np.int64).ravel()), 2 * bands).cast(pa.list_(pa.int64()))],
            names=["doc_id", "same", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        ids, counts, begin = weighted_shingles(batch.column(1).to_pylist(), words)
        low = (ids & _U(0xFFFFFFFF)).astype(np.uint32)
        cut = list(zip(begin[:-1], begin[1:], strict=True))
        many = [counts[a:b].astype(np.uint32).tobytes() if (counts[a:b] > 1).any() else b"" for a, b in cut]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([low[a:b].tobytes() for a, b in cut], pa.binary()), pa.array(many, pa.binary())], names=["id", "ids", "counts"])


def similarity(ids_a: bytes, counts_a: bytes, ids_b: bytes, counts_b: bytes) -> float:
    """The larger of the Jaccard similarity of the shingles and the probability Jaccard of their weights 1 + ln(count), both exact."""
    a, b = np.frombuffer(ids_a, np.uint32), np.frombuffer(ids_b, np.uint32)
    if not len(a) or not len(b):
        return 0.0
    if not counts_a and not counts_b:
        both = len(np.intersect1d(a, b))
        return both / (len(a) + len(b) - both)
    wa = 1 + np.log(np.frombuffer(counts_a, np.uint32)) if counts_a else np.ones(len(a))
    wb = 1 + np.log(np.frombuffer(counts_b, np.uint32)) if counts_b else np.ones(len(b))
    _, ia, ib = np.intersect1d(a, b, return_indices=True)
    plain = len(ia) / (len(a) + len(b) - len(ia))
    if not len(ia):
        return 0.0
    x, y = wa[ia], wb[ib]
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()  # ratio 0 and infinity
    below = only_a + np.cumsum(x)[np.searchsorted(ratio, ratio, "right") - 1]
    above = only_b + y.sum() - np.cumsum(y)[np.searchsorted(ratio, ratio, "right") - 1]
    return max(plain, float((1.0 / (below / x + above / y)).sum()))


def _verify(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(2, 6)]
        good = [min(len(i), len(j)) >= least * max(len(i), len(j)) * 0.5 and similarity(i, p, j, q) >= least for i, p, j, q in zip(*cols, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _block_links(left: list, right: list, band: int, least: float) -> list[tuple[int, int]]:
    """Links between members of two blocks that are in different components and meet in no earlier band."""
    x, y = ([np.frombuffer(m["ids"], np.uint32) for m in side] for side in (left, right))
    nx, ny = (np.array([len(v) for v in side]) for side in (x, y))
    comp = np.array([m["comp"] for m in left])[:, None] != np.array([m["comp"] for m in right])[None, :]
    once = np.array([m["id"] for m in left])[:, None] != np.array([m["id"] for m in right])[None, :]
    bx, by = (np.array([m["bands"] for m in side]) for side in (left, right))
    first = np.full(comp.shape, -1)
    half = bx.shape[1] // 2
    for k in range(half - 1, -1, -1):
        for u, v in ((k, k), (k, k + half), (k + half, k), (k + half, k + half)):
            first[bx[:, u][:, None] == by[:, v][None, :]] = k
    todo = comp & once & (first == band)
    if not todo.any():
        return []
    every, ex = np.unique(np.concatenate(x), return_inverse=True)
    in_y, ey = np.unique(np.concatenate(y), return_inverse=True)
    common, cx, cy = np.intersect1d(every, in_y, return_indices=True)
    to_x, to_y = np.full(len(every), -1), np.full(len(in_y), -1)
    to_x[cx], to_y[cy] = np.arange(len(common)), np.arange(len(common))
    rows, cols = (np.repeat(np.arange(len(n)), n) for n in (nx, ny)), (to_x[ex], to_y[ey])
    (rx, ry), both = rows, np.zeros(comp.shape)
    for a in range(0, len(common), SLAB):
        mx, my = np.zeros((len(x), SLAB), np.float32), np.zeros((len(y), SLAB), np.float32)
        for m, r, c in ((mx, rx, cols[0]), (my, ry, cols[1])):
            inside = (c >= a) & (c < a + SLAB)
            m[r[inside], c[inside] - a] = 1
        both += mx @ my.T
    plain = both / (nx[:, None] + ny[None, :] - both)
    good = todo & (plain >= least)
    for i, j in np.argwhere(todo & ~good & (both > 0)):
        if left[i]["counts"] or right[j]["counts"]:
            good[i, j] = similarity(left[i]["ids"], left[i]["counts"], right[j]["ids"], right[j]["counts"]) >= least
    return [(left[i]["id"], right[j]["id"]) for i, j in np.argwhere(good)]


def _blocks(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for k in range(batch.num_rows):
            found += _block_links(batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), batch.column(0)[k].as_py(), least)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ((), ()))], names=["a", "b"])


def near_duplicates(docs: DataFrame, words: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, class_id, same_id, kept.

    same_id: the smallest doc_id with the same weighted shingles; class_id: the smallest doc_id that links of similarity
    `least` or more lead to; kept: doc_id is class_id. Words are runs without white space, lower-cased; a text of
    fewer than `words` words is one shingle. A text without words, null included, is its own class. Rows that
    repeat a doc_id all stay; with different texts they count as one document that has the links of each text. Rows with a null doc_id are classes of their own (null). An empty table gives an empty result.
    """
    smaller_batches(docs.sparkSession)
    texts = whole_texts(docs)
    sketch = saved(texts.mapInArrow(lambda it: _sketch(it, words, bands, rows), "doc_id long, same binary, bands array<long>"), "sketches")
    known = sketch.where("same IS NOT NULL AND doc_id IS NOT NULL")
    firsts = saved(known.groupBy("same").agg(F.min("doc_id").alias("same_id"), F.any_value("bands").alias("bands"), F.count("*").alias("n")), "sets")
    entries = F.array_distinct(F.transform("bands", lambda h, i: F.struct((i % bands).cast("int").alias("band"), h.alias("h"))))
    buckets = saved(firsts.select(F.col("same_id").alias("id"), F.inline(entries)), "entries")
    heads = saved(buckets.groupBy("band", "h").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1"), "heads")
    members = saved(skew_join(buckets, heads.drop("n"), ["band", "h"], counts=heads), "buckets")
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    found = texts.join(wanted, "doc_id").dropDuplicates(["doc_id", "text"])
    sets = saved(found.mapInArrow(lambda it: _shingle_sets(it, words), "id long, ids binary, counts binary"), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda s: sets.select(F.col("id").alias(s), F.col("ids").alias(f"ids_{s}"), F.col("counts").alias(f"counts_{s}"))
        pairs = saved(pairs, "pairs")
        times = pairs.groupBy("b").agg(F.count("*").alias("n"))
        full = skew_join(pairs.join(side("a"), "a"), side("b"), ["b"], counts=times).select("a", "b", "ids_a", "counts_a", "ids_b", "counts_b")
        return saved(full.mapInArrow(lambda it: _verify(it, least), "a long, b long"), "verified")

    def apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        """The pairs whose ends are not known to be in one component."""
        of = lambda s: comp.select(F.col("node").alias(s), F.col("comp").alias(f"comp_{s}"))
        at = skew_join(pairs.join(of("a"), "a", "left"), of("b"), ["b"], "left", counts=pairs.groupBy("b").agg(F.count("*").alias("n")))
        return at.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b")

    stars = saved(members.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), "stars")
    links = verified(stars.groupBy("a").agg(F.min("b").alias("b")))
    comp = saved(components(links), "components")
    links = links.unionByName(verified(apart(stars, comp)))
    comp = saved(components(links), "components")
    # Buckets whose members are still in several components: compare across components, block by block.
    at = saved(members.join(comp, members.id == comp.node, "left").select("band", "h", "id", F.coalesce("comp", "id").alias("comp")), "placed")
    mixed = at.groupBy("band", "h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high")
    mixed = saved(mixed.select("band", "h", "n", F.ceil(F.col("n") / BLOCK).alias("blocks")), "open-buckets")
    cut = skew_join(at, mixed.drop("n"), ["band", "h"], counts=mixed).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    full = cut.join(sets, "id").join(firsts.select(F.col("same_id").alias("id"), "bands"), "id")
    blocks = saved(full.groupBy("band", "h", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("id", "comp", "bands", "ids", "counts")).alias("m")), "blocks")
    # Each block meets itself and those after it. Pairs are dealt by all four keys, so neither a bucket nor a block is one task's work.
    pairs = blocks.select("band", "h", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    side = lambda s, k: blocks.select("band", "h", F.col("block").alias(k), F.col("m").alias(s))
    pairs = skew_join(pairs.join(side("l", "i"), ["band", "h", "i"]), side("r", "j"), ["band", "h", "j"], counts=pairs.groupBy("band", "h", "j").agg(F.count("*").alias("n")), hot=BLOCK)
    more = saved(pairs.select("band", "l", "r").mapInArrow(lambda it: _blocks(it, least), "a long, b long"), "block-links")
    if not more.isEmpty():
        comp = saved(components(links.unionByName(more)), "components")
    classes = firsts.select("same", "same_id", "n").join(comp, F.col("same_id") == F.col("node"), "left").select("same", "same_id", F.coalesce("comp", "same_id").alias("class_id"), "n")
    classes = saved(classes, "classes")
    out = skew_join(known.select("doc_id", "same"), classes.drop("n"), ["same"], counts=classes.select("same", "n")).select("doc_id", "class_id", "same_id")
    # Texts without words, and rows without doc_id, are their own classes and meet nothing.
    lone = sketch.where("same IS NULL OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("same_id"))
    return out.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of which each near-duplicate class keeps its smallest doc_id; all columns kept. Rows with a null doc_id stay."""
    dropped = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")


def op1_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
