"""Best-fit packing of tokenized documents after a dominance reduction.

Lengths are whole numbers up to the capacity, so a packing problem of any size is a histogram of at most `capacity`
counts. The plan is made on that histogram: sets that provably dominate all alternatives (Martello and Toth) are fixed,
whole counts at a time, and best fit by descending length places the remainder. A plan is a short list of
intervals of ranks within a length; every piece finds its place from its own rank, in parallel.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, smaller_batches, table, text_chunks, whole_texts

CAPACITY = 2048
END_ID = 0
#: Counts of documents by length are put by this many bits in a rank's key.
_RANK_BITS = 48


def _encoder(name: str):
    """Text to ids as the tokenizer file name.json gives them without its post-processing; its added tokens, such as <|endoftext|>, are one id each.

    The merges come from name.tiktoken, the same vocabulary as ranks, several times faster; tests hold both equal.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode(text, allowed_special="all") if any(t in text for t in added) else encoding.encode_ordinary(text)


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str) -> Iterator[pa.RecordBatch]:
    encode, part = _encoder(vocabulary), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, dtype=np.int64)
    for batch in text_chunks(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.array([*encode(text), END_ID], dtype="<u4")
            first = len(ids) % capacity or capacity
            for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                piece = ids[start : first if k == 0 else start + capacity]
                rows.append((doc, k, start, len(piece), zlib.crc32(piece.tobytes()), part, int(seen[len(piece)])))
                seen[len(piece)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()], strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])


def reduce_dominated(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, taking their items out of counts; returns (lengths, how many sequences).

    A set F that holds item s dominates every feasible set with s whose other items can be shared out into F's other
    items. So s goes alone if nothing fits with it; with c - s, as anything beside s totals c - s at most; and with the
    largest t that fits, if no two items beside s total more than t and no three fit.
    """
    fixed = []

    def take(lengths: tuple[int, ...], n: int) -> None:
        fixed.append((lengths, n))
        for x in lengths:
            counts[x] -= n

    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            if not counts[s]:
                continue
            left = capacity - s
            if left and counts[left]:
                n = counts[s] // 2 if left == s else min(counts[s], counts[left])
                if n:
                    take((s, left), n)
                    changed = True
            if not counts[s]:
                continue
            counts[s] -= 1
            sizes = [x for x in range(1, left + 1) if counts[x]]
            least = [x for x in sizes for _ in range(min(3, counts[x]))][:3]
            counts[s] += 1
            if not sizes:
                take((s,), counts[s])
                changed = True
            elif len(least) < 3 or sum(least) > left:
                t = sizes[-1]
                pair, hi = 0, len(sizes) - 1
                for lo, x in enumerate(sizes):
                    while hi >= 0 and x + sizes[hi] > left:
                        hi -= 1
                    if hi < lo:
                        break
                    k = hi if hi > lo or counts[x] > 1 else hi - 1
                    if k > lo or (k == lo and counts[x] > 1):
                        pair = max(pair, x + sizes[k])
                if t >= pair:
                    take((s, t), counts[s] // 2 if t == s else min(counts[s], counts[t]))
                    changed = True
    return [x for x in fixed if x[1]]


def best_fit(counts: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit by descending length on whole counts; returns ([(length, how many in a row)], how many sequences)."""
    room: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    order: list[int] = []

    def put(left: int, pattern: list[tuple[int, int]], n: int) -> None:
        if n:
            if left not in room:
                room[left] = []
                insort(order, left)
            room[left].append((pattern, n))

    for s in range(capacity, 0, -1):
        c = counts[s]
        while c:
            at = bisect_left(order, s)
            if at == len(order):
                left, pattern, n = capacity, [], -(-c // (capacity // s))
            else:
                left = order[at]
                pattern, n = room[left].pop()
                if not room[left]:
                    del room[left], order[at]
            fit = left // s
            full = min(n, c // fit)
            put(left - fit * s, [*pattern, (s, fit)], full)
            c -= full * fit
            n -= full
            if n and c:
                rest = min(c, fit)
                put(left - rest * s, [*pattern, (s, rest)], 1)
                c, n = c - rest, n - 1
            if pattern:
                put(left, pattern, n)
        counts[s] = 0
    return [x for groups in room.values() for x in groups]


def packing_plan(counts: list[int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, items in a row in one sequence, first sequence, offset): where the ranks of each length go."""
    counts = list(counts)
    groups = [([(x, 1) for x in lengths], n) for lengths, n in reduce_dominated(counts, capacity)]
    groups += best_fit(counts, capacity)
    rank, plan, sequence = [0] * (capacity + 1), [], 0
    for pattern, n in groups:
        offset = 0
        for s, fit in pattern:
            plan.append((s, rank[s], fit, sequence, offset))
            rank[s] += n * fit
            offset += s * fit
        sequence += n
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)


def _place(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (plan[:, 0] << _RANK_BITS) | plan[:, 1]
    for batch in batches:
        length = batch.column(3).to_numpy(zero_copy_only=False)
        rank = batch.column(5).to_numpy(zero_copy_only=False)
        row = plan[np.searchsorted(keys, (length << _RANK_BITS) | rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
        at = rank - row[:, 1]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + at // np.maximum(row[:, 2], 1)), pa.array(row[:, 4] + at % np.maximum(row[:, 2], 1) * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids, then id 0; a name of an added token in a text, such as <|endoftext|>, is that token. A null or empty text is the one id 0. A document of more than
    `capacity` ids is cut from its end into pieces of `capacity`; what is left is its first piece. Rows that repeat a doc_id, or have none, are
    documents of their own. An empty table gives an empty result; only doc_id and text are read.
    """
    smaller_batches(docs.sparkSession)
    made = whole_texts(docs).mapInArrow(lambda it: _pieces(it, capacity, vocabulary), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")
    pieces = saved(made, "pieces")
    dealt = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = [0] * (capacity + 1)
    for length, n in dealt.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    plan = packing_plan(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(lambda it: _place(it, plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
