"""Packing of tokenized documents into sequences without padding, as a cutting-stock problem solved by column generation.

A sequence costs no padding where it is full or as long as a power of two. A pattern is a multiset of lengths that total just that; the linear program over the
histogram of lengths has a variable for each pattern, how often it is used, and one for each length, how many of its pieces are cut. A sequence
costs 1; a cut piece costs the share of a sequence that it fills, and CUT times that share. Patterns come by pricing: a knapsack by dynamic programming, at the program's
dual prices, finds the pattern that gains most for every total at once. The first patterns are those of a greedy packing. Rounded down, and filled up by a knapsack on what is left, the patterns
are intervals of ranks within lengths, so every piece finds its place from its own rank.

A piece that no pattern holds is cut into parts by the bits of its length. Parts laid end to end by descending size fill sequences without a gap and end at powers of two, so
nothing is ever padded. The plan depends on counts by length only, at most `capacity` numbers however many documents there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, smaller_batches, table, text_chunks, whole_texts
from .packing import END_ID, _encoder

CAPACITY = 1024
#: What it costs to cut pieces that would fill a sequence.
CUT = 1.0
#: Column generation ends when no pattern can gain this share of the cost any more, or after so many patterns; either way the plan packs everything.
GAP, MOST_PATTERNS = 1e-3, 500


def parts_of(length: int) -> list[int]:
    """The powers of two that make up a length, descending."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def totals(capacity: int) -> list[int]:
    """Totals without padding: the capacity and the powers of two below it."""
    return [1 << k for k in range((capacity - 1).bit_length()) if 1 << k < capacity] + [capacity]


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every total up to capacity the greatest worth of items (any number of each) that total just that, and the last item taken."""
    best, last = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -1)
    best[0] = 0.0
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        if n := upto[c]:
            got = best[c - sizes[:n]] + worth[:n]
            k = int(got.argmax())
            best[c], last[c] = got[k], k
    return best, last


class Program:
    """The linear program by revised simplex, from the basis in which everything is cut; right sides are slightly unequal, so that no step stands still."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.sizes = capacity, np.flatnonzero(counts)
        m = len(self.sizes)
        self.row = {int(s): k for k, s in enumerate(self.sizes)}
        self.cut = self.sizes / capacity * (1 + CUT)
        self.inverse, self.cost = np.eye(m), self.cut.copy()
        self.use = counts[self.sizes] * (1 + 1e-7 * (np.arange(m) % 97 + 1) / 97)
        self.basis: list[dict[int, int] | None] = [None] * m
        self.price = self.cost @ self.inverse

    def _pivot(self, rows: list[int], times: np.ndarray, cost: float, pattern: dict[int, int] | None, least: float) -> bool:
        gain = float(self.price[rows] @ times) - cost
        if gain <= least:
            return False
        column = self.inverse[:, rows] @ times
        ratio = np.where(column > 1e-9, self.use / np.where(column > 1e-9, column, 1), np.inf)
        leave = int(ratio.argmin())
        step = ratio[leave]
        self.use -= step * column
        self.use[leave] = step
        pivot = self.inverse[leave] / column[leave]
        self.inverse -= np.outer(column, pivot)
        self.inverse[leave] = pivot
        self.cost[leave], self.basis[leave] = cost, pattern
        self.price -= gain * pivot
        return True

    def enter(self, pattern: dict[int, int], least: float) -> bool:
        """Take the pattern into the basis, if it gains more than `least` at the prices of now."""
        return self._pivot([self.row[s] for s in pattern], np.array(list(pattern.values()), dtype=float), 1.0, pattern, least)

    def cut_again(self, least: float) -> int:
        """Take cut columns back into the basis where a price is above what cutting costs."""
        return sum(self._pivot([int(k)], np.ones(1), self.cut[k], None, least) for k in np.flatnonzero(self.price > self.cut + least))

    def priced(self, width: int) -> tuple[float, list[dict[int, int]]]:
        """The best worth of a pattern at the prices of now, and the `width` best patterns that hold different lengths or totals."""
        best, last = knapsack(self.sizes, self.price, self.capacity)
        ends = [(best[t], t, 0) for t in totals(self.capacity)]
        ends += [(best[self.capacity - s] + self.price[k], self.capacity - int(s), int(s)) for k, s in enumerate(self.sizes)]
        found, seen = [], set()
        for worth, c, s in sorted(ends, reverse=True)[:width]:
            if worth <= 1:
                break
            made = {s: 1} if s else {}
            while c:
                s = int(self.sizes[last[c]])
                made[s] = made.get(s, 0) + 1
                c -= s
            if (key := tuple(sorted(made.items()))) not in seen:
                seen.add(key)
                found.append(made)
        return max(e[0] for e in ends), found


def patterns(counts: np.ndarray, capacity: int, first: list[dict[int, int]], gap: float = GAP, most: int = MOST_PATTERNS, width: int = 40) -> tuple[list[dict[int, int]], np.ndarray, np.ndarray]:
    """Column generation from the patterns of a first packing: patterns {length: how many}, how often each is used, and the price of each length."""
    program = Program(counts, capacity)
    for p in first:
        program.enter(p, 0)
    entered = 0
    while entered < most and len(program.sizes):
        while program.cut_again(gap / 10):
            pass
        worth, found = program.priced(width)
        # Farley's bound: prices over the best worth are feasible, so the cost cannot fall below cost / worth.
        if worth <= 1 + gap:
            break
        entered += sum(program.enter(p, gap / 10) for p in found)
    used = [(p, x) for p, x in zip(program.basis, program.use, strict=True) if p]
    price = np.zeros(capacity + 1)
    price[program.sizes] = program.price
    return [p for p, _ in used], np.array([x for _, x in used]), price


def _fill(left: np.ndarray, price: np.ndarray, capacity: int) -> dict[int, int] | None:
    """Of the items left, a pattern that is full and worth most; None where no items total just the capacity."""
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    taken: list[tuple[int, np.ndarray]] = []
    for s in np.flatnonzero(left)[::-1]:
        s = int(s)
        for _ in range(min(int(left[s]), capacity // s)):
            more = best[:-s] + price[s]
            better = more > best[s:] + 1e-12
            if not better.any():
                break
            best[s:] = np.where(better, more, best[s:])
            taken.append((s, better))
    if best[capacity] == -np.inf:
        return None
    made: dict[int, int] = {}
    c = capacity
    for s, better in reversed(taken):
        if c >= s and better[c - s]:
            made[s] = made.get(s, 0) + 1
            c -= s
    return made


def _take(left: np.ndarray, chosen: list, p: dict[int, int], n: int) -> None:
    if n > 0:
        chosen.append((p, n))
        for s, k in p.items():
            left[s] -= n * k


def fill_up(left: np.ndarray, price: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, how often) until what is left has no full pattern: first full pairs, as good as anything else with their larger length, then by the knapsack."""
    chosen: list[tuple[dict[int, int], int]] = []
    for s in range(capacity // 2, 0, -1):
        n = int(left[s] // 2 if 2 * s == capacity else min(left[s], left[capacity - s]))
        _take(left, chosen, {s: 2} if 2 * s == capacity else {s: 1, capacity - s: 1}, n)
    while (p := _fill(left, price, capacity)) is not None:
        _take(left, chosen, p, min(int(left[s] // k) for s, k in p.items()))
    return chosen


def cutting_plan(counts: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the ranks of each length go: rows (length, first rank, items in a row in one sequence, first sequence, offset), per length the first rank that is cut, and how many sequences that is.

    The ranks that are cut go to the sequences after those of the rows, by cut_places.
    """
    sizes = np.arange(capacity + 1)
    whole = np.array(counts, dtype=np.int64)
    full = int(whole[capacity])
    whole[capacity] = 0
    left = whole.copy()
    chosen = fill_up(left, (sizes / capacity) ** 2, capacity)  # long ones first
    found, often, price = patterns(whole.astype(float), capacity, [p for p, _ in chosen])
    rounded, rest = [], whole.copy()
    for p, x in zip(found, often, strict=True):
        _take(rest, rounded, p, min(int(x + 1e-4), *(int(rest[s] // k) for s, k in p.items())))
    rounded += fill_up(rest, np.maximum(price, 1e-6), capacity)
    if rest @ sizes <= left @ sizes:  # rounding can lose more than the program gains where counts are small
        chosen, left = rounded, rest
    left[capacity] = full
    _take(left, chosen, {capacity: 1}, full)
    # A power of two alone is a sequence without padding too.
    for s in totals(capacity)[:-1]:
        _take(left, chosen, {s: 1}, int(left[s]))
    rank, rows, sequence = [0] * (capacity + 1), [], 0
    for p, n in chosen:
        offset = 0
        for s, k in sorted(p.items(), reverse=True):
            rows.append((s, rank[s], k, sequence, offset))
            rank[s] += n * k
            offset += s * k
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5), np.array(rank, dtype=np.int64), sequence


def cut_places(counts: list[int], first_cut: np.ndarray, capacity: int) -> np.ndarray:
    """base[length, k]: the place, in parts laid end to end, of the part of 2**k of the first cut piece of that length; the next such pieces' follow it."""
    base = np.zeros((capacity + 1, capacity.bit_length()), dtype=np.int64)
    at = 0
    for k in range(capacity.bit_length() - 1, -1, -1):
        for s in range(1, capacity + 1):
            if s >> k & 1:
                base[s, k] = at
                at += (counts[s] - int(first_cut[s])) << k
    return base


#: Counts of pieces by length are put by this many bits in a rank's key.
_RANK_BITS = 48
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part_crcs array<long>, part int, nth long"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str) -> Iterator[pa.RecordBatch]:
    encode, part = _encoder(vocabulary), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, dtype=np.int64)
    kinds = [*[pa.int64()] * 5, pa.list_(pa.int64()), pa.int32(), pa.int64()]
    for batch in text_chunks(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.array([*encode(text), END_ID], dtype="<u4")
            for start in range(0, len(ids), capacity):
                piece = ids[start : start + capacity]
                cuts = np.cumsum(parts_of(len(piece)))[:-1]
                crcs = [zlib.crc32(x.tobytes()) for x in np.split(piece, cuts)]
                rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), crcs, part, int(seen[len(piece)])))
                seen[len(piece)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _PIECE.split(", ")])


class Places:
    """Sequence and offset of a piece by its length and rank, or of the parts that it is cut into."""

    def __init__(self, counts: list[int], capacity: int):
        self.capacity = capacity
        self.plan, self.first_cut, self.sequences = cutting_plan(counts, capacity)
        self.keys = (self.plan[:, 0] << _RANK_BITS) | self.plan[:, 1]
        self.base = cut_places(counts, self.first_cut, capacity)
        n = np.array(counts, dtype=np.int64)
        # The last sequence of parts is not full: it ends at the bits of what is left, each a sequence of its own.
        self.full, rest = divmod(int(((n - self.first_cut) * np.arange(capacity + 1)).sum()), capacity)
        self.ends = np.cumsum([0, *parts_of(rest)])

    def whole(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.plan[np.searchsorted(self.keys, (length << _RANK_BITS) | rank, "right") - 1]
        at = rank - row[:, 1]
        return row[:, 3] + at // row[:, 2], row[:, 4] + at % row[:, 2] * length

    def part(self, length: int, rank: int, size: int) -> tuple[int, int]:
        place = int(self.base[length, size.bit_length() - 1]) + (rank - int(self.first_cut[length])) * size
        k, offset = divmod(place, self.capacity)
        if k == self.full:
            j = int(np.searchsorted(self.ends, offset, "right")) - 1
            return self.sequences + k + j, offset - int(self.ends[j])
        return self.sequences + k, offset


def _place(batches: Iterator[pa.RecordBatch], places: Places) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _PLACED.split(", ")]
    for batch in batches:
        length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 6))
        whole = rank < places.first_cut[length]
        if whole.any():
            kept = batch.filter(pa.array(whole))
            yield pa.RecordBatch.from_arrays([*kept.columns[:5], *map(pa.array, places.whole(length[whole], rank[whole]))], names=names)
        rows = []
        for r in batch.filter(pa.array(~whole)).to_pylist():
            start = r["start"]
            for size, crc in zip(parts_of(r["length"]), r["part_crcs"], strict=True):
                rows.append((r["doc_id"], start, size, crc, r["doc_tokens"], *places.part(r["length"], r["rank"], size)))
                start += size
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def pack_cutting(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. capacity is a power of two.

    A document is its token ids, then id 0; a null or empty text is the one id 0. Every `capacity` ids are a piece, and what is left at the end is one more, which the plan keeps whole
    or cuts by the bits of its length. No sequence needs padding: each is full or as long as a power of two. Rows that repeat a doc_id, or have none,
    are documents of their own. An empty table gives an empty result; only doc_id and text are read.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    smaller_batches(docs.sparkSession)
    pieces = saved(whole_texts(docs).mapInArrow(lambda it: _pieces(it, capacity, vocabulary), _PIECE), "pieces")
    dealt = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = [0] * (capacity + 1)
    for length, n in dealt.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    places = Places(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part_crcs", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(lambda it: _place(it, places), _PLACED)


def op12_cutting_stock_packing(spark, sf_dir):
    return pack_cutting(table(spark, sf_dir, "documents"))
