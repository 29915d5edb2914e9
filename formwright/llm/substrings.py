"""Byte substrings that repeat across documents, by column-wise construction over many documents' pieces.

The collection's Burrows-Wheeler transform and common prefixes are built column by column: each round puts one symbol in front of
every string of the collection, from its end to its start. A round's new suffixes take their places in the sorted suffixes so far by
the symbols' ranks in the transform, and the common prefixes beside them follow from the least one between the places they came from.
After the last round, windows of WINDOW bytes are equal exactly where neighbours have a common prefix as long.

A collection is bounded, so that one task can hold it; the strings are pieces of documents, not whole ones, as the longest document
would need a round for each of its bytes. Windows are dealt by their anchor, the smallest hash of their runs of GRAM
bytes, which equal windows share; neighbouring windows with one anchor are one piece. Only anchors that two different texts have
are sent, and equal pieces travel as one with their smallest doc_id. An anchor with very many distinct pieces is dealt over several collections, whose
windows are then merged by their bytes. What passes between jobs are sorted shuffle files and tables in the shared folder, written and read in sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BASE_INV, MOST_HOT, Scratch, _power, mix, skew_join, smaller_batches, table, text_chunks

WINDOW, GRAM = 50, 20
#: Bytes of text that one pass over windows takes; it holds some ten 8-byte numbers for each.
CHUNK = 1_000_000
#: Bytes of one collection (a piece more at most), and anchors of one bucket of the sharing test.
BATCH_BYTES, BUCKET = 400_000, 2_000_000
#: Bytes of text for one task of the shuffles; the session's number of partitions is the least.
TASK_BYTES = 32_000_000
#: Windows of one piece: as many as can share one place of an anchor; longer runs, as periodic text has, are cut.
PIECE = WINDOW - GRAM + 1
#: Of pieces with one anchor, windows whose runs of NEAR bytes have a smallest hash that no other piece has are equal to none, and stay out of the construction.
NEAR = 40
#: An anchor with more distinct pieces than this is dealt over several collections.
HOT_SEGMENTS = 4_000
_U = np.uint64


def segments(texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, of PIECE windows at most: text index, first window's start in the text, windows in the run, anchor."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(buf)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none, none, none, none.astype(_U)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum((buf.astype(_U) + _U(1)) * _power(_BASE, n), dtype=_U, out=sums[1:])
    low = mix((sums[gram:] - sums[:-gram]) * _power(_BASE_INV, n)[: n - gram + 1])
    span, width = 1, window - gram + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: -(width - span)], low[width - span :])
    doc = np.repeat(np.arange(len(texts)), sizes)
    whole = doc[: len(low)] == doc[window - 1 :]
    if not whole.any():
        return none, none, none, none.astype(_U)
    change, begins, ends = low[1:] != low[:-1], whole.copy(), whole.copy()  # no windows across texts: a gap parts those of two texts
    begins[1:] &= change | ~whole[:-1]
    ends[:-1] &= change | ~whole[1:]
    begin = np.flatnonzero(begins)
    count = np.flatnonzero(ends) + 1 - begin
    pieces = (count + PIECE - 1) // PIECE
    before = PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    first = np.repeat(begin, pieces) + before
    return doc[first], first - offsets[doc[first]], np.minimum(np.repeat(count, pieces) - before, PIECE), low[first]


_PACK = np.dtype([("rest", "<u4"), ("doc", "<u2"), ("text", "<i8")])  # the text's hash tells copies from different texts


def _anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """For each chunk: its documents' keys (bucket -1), and for each bucket its anchors packed with their document's place in the chunk."""
    serial = TaskContext.get().partitionId() << 32
    for batch in text_chunks(batches, size=CHUNK):
        for a in range(0, batch.num_rows, 65_536):
            part = batch.slice(a, 65_536)
            d, _, _, anchor = segments([t.encode() for t in part.column(2).to_pylist()])
            serial += 1
            keys = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1).astype("<i8")
            rows = [(-1, keys.tobytes())]
            bucket = ((anchor >> _U(32)) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            packed = np.empty(len(order), dtype=_PACK)
            packed["rest"], packed["doc"] = anchor[order] & _U(0xFFFFFFFF), d[order]
            packed["text"] = keys[d[order], 1]
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1)) if len(order) else np.zeros(buckets + 1, np.int64)
            rows += [(b, packed[ends[b] : ends[b + 1]].tobytes()) for b in np.unique(bucket).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([serial] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", "bucket", "data"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, in sorted order, the anchors that two different texts have, chunk by chunk."""
    held: list[tuple[int, np.ndarray]] = []
    bucket = None

    def flush() -> pa.RecordBatch:
        rest = np.concatenate([p["rest"] for _, p in held])
        order = np.argsort(rest, kind="stable")
        text = np.concatenate([p["text"] for _, p in held])[order]
        new = np.concatenate(([True], rest[order][1:] != rest[order][:-1]))
        other = np.concatenate(([False], text[1:] != text[:-1])) & ~new
        both = np.zeros(len(rest), dtype=bool)
        group = np.cumsum(new) - 1
        both[order] = (np.bincount(group, other) > 0)[group]
        cut = np.cumsum([0, *(len(p) for _, p in held)])
        out = [(c, x.tobytes()) for (c, p), a, b in zip(held, cut[:-1], cut[1:], strict=True) if len(x := p[both[a:b]])]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["chunk", "bucket", "data"])

    for batch in batches:
        for chunk, b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and held:
                yield flush()
                held = []
            bucket = b
            held.append((chunk, np.frombuffer(data, dtype=_PACK)))
    if held:
        yield flush()


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared anchors (bucket and rest) of each document of a chunk; a chunk's keys come first."""
    keys, parts, chunk = None, [], None

    def flush() -> pa.RecordBatch | None:
        if keys is None or not parts:
            return None
        doc = np.concatenate([p["doc"] for _, p in parts])
        value = np.concatenate([(np.int64(b) << 32) | p["rest"].astype(np.int64) for b, p in parts])
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        ends = np.concatenate((first[1:], [len(doc)]))
        owner = keys[doc[first]]
        return pa.RecordBatch.from_arrays([pa.array(owner[:, 0]), pa.array(owner[:, 1]), pa.array([value[a:b].astype("<i8").tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], names=["doc_id", "row", "anchors"])

    for batch in batches:
        for c, b, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != chunk:
                if (done := flush()) is not None:
                    yield done
                keys, parts, chunk = None, [], c
            if b < 0:
                keys = np.frombuffer(data, dtype="<i8").reshape(-1, 2)
            else:
                parts.append((b, np.frombuffer(data, dtype=_PACK)))
    if (done := flush()) is not None:
        yield done


def _occurrences(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The segments of each document that start with a shared anchor."""
    for batch in text_chunks(batches, size=CHUNK):
        raw = [t.encode() for t in batch.column(2).to_pylist()]
        d, start, count, anchor = segments(raw)
        if not len(d):
            continue
        value = (((anchor >> _U(32)) % _U(buckets)) << _U(32)) | (anchor & _U(0xFFFFFFFF))
        known = [np.frombuffer(x, dtype="<i8").view(_U) for x in batch.column(3).to_pylist()]
        ends = np.searchsorted(d, np.arange(len(raw) + 1))
        keep = np.concatenate([np.isin(value[ends[i] : ends[i + 1]], known[i]) for i in range(len(raw))])
        d, start, count, anchor = d[keep], start[keep], count[keep], anchor[keep]
        text = [raw[i][s : s + c + WINDOW - 1] for i, s, c in zip(d.tolist(), start.tolist(), count.tolist(), strict=True)]
        ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(ids[d], pa.int64()), pa.array(rows[d], pa.int64()), pa.array(start, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(text, pa.binary())], names=["doc_id", "row", "start", "anchor", "segment"])


#: The symbol before a string's start; no byte of UTF-8.
_NONE = 255


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi] for each pair, from minima over 2, 4, 8, ... neighbours."""
    level = np.frexp((hi - lo).astype(np.float32))[1] - 1
    n, most = len(values), int(level.max(initial=0))
    every = np.empty((most + 1, n), dtype=values.dtype)
    every[0] = values
    for k in range(most):
        h = 1 << k
        np.minimum(every[k, : n - 2 * h + 1], every[k, h : n - h + 1], out=every[k + 1, : n - 2 * h + 1])
    flat = every.reshape(-1)
    start = level.astype(np.int64) * n
    return np.minimum(flat[start + lo], flat[start + hi - (1 << level)])


def collection_order(buf: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where the suffixes of all strings buf[begin : begin + size] start, in sorted order (a string's end sorts first, then by string), and each one's common prefix with the one before, counted up to `most`.

    Column by column: the arrays hold the sorted suffixes of up to j symbols, their common prefixes, and the symbols before them (the collection's
    transform). The symbols in stable order say which suffix each suffix with one symbol more comes from; those not there yet are put in.
    """
    n = len(begin)
    if n + int(size.sum()) >= 1 << 24:
        raise ValueError("a collection holds less than 2**24 symbols")
    begin = begin.astype(np.int32)
    at, lcp = (begin + size).astype(np.int32), np.zeros(n, dtype=np.uint8)
    symbol = np.where(size > 0, buf[np.maximum(at - 1, 0)], _NONE).astype(np.uint8)
    pending, owner = np.flatnonzero(size > 0), np.flatnonzero(size > 0)
    while len(pending):
        total = len(at)
        # Symbol and place in one number: sorting these is a stable order of the symbols. A collection has far less than 2**24 symbols.
        placed = np.sort((symbol.astype(np.uint32) << np.uint32(24)) | np.arange(total, dtype=np.uint32))
        ranked = total - np.count_nonzero(symbol == _NONE)
        wanted = (symbol[pending].astype(np.uint32) << np.uint32(24)) | pending.astype(np.uint32)
        order = np.argsort(wanted)
        wanted, source, who = wanted[order], pending[order], owner[order]
        put = np.searchsorted(placed, wanted)  # ranks of the new suffixes among all that start with a symbol
        # The common prefix of a suffix with the one before it in its symbol's pile: one more than the least between their sources.
        after = put + 1
        changed = np.sort(np.concatenate((put, after[np.append(after[:-1] != put[1:], after[-1] < ranked)])))
        inside = changed[1:] if changed[0] == 0 else changed
        last, this = placed[inside - 1], placed[inside]
        same = (last ^ this) < np.uint32(1 << 24)
        inside, last, this = inside[same], last[same], this[same]
        lo, hi = ((x & np.uint32(0xFFFFFF)).astype(np.int64) + 1 for x in (last, this))
        least = _least_between(lcp, lo, hi)
        # Suffixes so far keep their order around the new ones; the first n places are the ends of strings.
        stays = np.ones(total + len(put), dtype=bool)
        stays[n + put] = False
        here = at[source] - 1
        before = np.where(here > begin[who], buf[np.maximum(here - 1, 0)], _NONE)
        grown = []
        for old, fresh in ((at, here), (lcp, 0), (symbol, before)):
            values = np.empty(len(stays), dtype=old.dtype)
            values[stays] = old
            values[n + put] = fresh
            grown.append(values)
        at, lcp, symbol = grown
        lcp[n + changed] = 0
        lcp[n + inside] = np.minimum(least, most - 1) + 1
        left = here > begin[who]
        pending, owner = (n + put)[left], who[left]
    return at, lcp


def _least_first(texts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each text: the text, its place there, the smallest `first` of any text that has an equal window, and whether it is the first of its equals."""
    lengths = np.array([len(t) for t in texts])
    begin = np.cumsum(lengths) - lengths
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    at, lcp = collection_order(buf, begin, lengths)
    who = np.searchsorted(begin, at, "right") - 1
    at, group = at[len(texts) :], np.cumsum(lcp < WINDOW)[len(texts) :]  # the first places are the texts' ends
    who = who[len(texts) :]
    whole = at + WINDOW <= begin[who] + lengths[who]
    at, group, who = at[whole], group[whole], who[whole]
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else group
    least = np.repeat(np.minimum.reduceat(first[who], heads), np.diff(np.concatenate((heads, [len(who)])))) if len(group) else group
    head = np.zeros(len(who), dtype=bool)
    head[heads] = True
    order = np.argsort(at)
    return who[order], (at - begin[who])[order], least[order], head[order]


_RUNS = "h1 long, h2 long, runs array<struct<a: int, b: int, first: long>>"
_RUN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("first", pa.int64())]))
_SINGLE = "h1 long, h2 long, at int, bytes binary, first long, last long, head boolean"


def _collections(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[list[tuple]]:
    """Rows (key, part, h1, h2, segment, first, last), which come in order, in bounded lists that part no key and part."""
    held, size, key = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key and size >= batch_bytes:
                yield held
                held, size = [], 0
            key = row[:2]
            held.append(row)
            size += len(row[4])
    if held:
        yield held


def _meeting(texts: list[bytes], anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece, the first and the end of the stretch of its windows that may be equal to one of another piece with its anchor; begin and end are equal where none may."""
    d, start, count, near = segments(texts, gram=NEAR)
    key = mix(near) ^ anchors.view(_U)[d]
    order = np.lexsort((d, key))
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    other = np.concatenate(([False], d[order][1:] != d[order][:-1])) & ~new
    group = np.cumsum(new) - 1
    meets = np.zeros(len(d), dtype=bool)
    meets[order] = (np.bincount(group, other) > 0)[group]
    d, start, end = d[meets], start[meets], (start + count)[meets]  # a piece's stretches come in order
    heads = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if len(d) else d
    begins, ends = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    begins[d[heads]], ends[d[heads]] = start[heads], end[np.append(heads[1:], len(d)) - 1] if len(d) else end
    return begins, ends


def _first_documents(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """For each distinct piece, runs of windows with the smallest doc_id that any equal window has."""
    for held in _collections(batches, batch_bytes):
        keys = np.array([h[0] for h in held])
        edge = keys[1:] != keys[:-1]
        alone = np.concatenate(([True], edge)) & np.concatenate((edge, [True]))  # an anchor with one piece has nothing to compare
        rows = {i: [{"a": 0, "b": len(held[i][4]) - WINDOW + 1, "first": held[i][5]}] for i in np.flatnonzero(alone).tolist() if held[i][5] < held[i][6]}
        some = np.flatnonzero(~alone)
        if len(some):
            texts, first = [held[i][4] for i in some.tolist()], np.array([held[i][5] for i in some.tolist()])
            windows = np.array([len(x) for x in texts]) - WINDOW + 1
            offset = np.cumsum(windows) - windows
            who, at, least = np.repeat(some, windows), np.arange(windows.sum()) - np.repeat(offset, windows), np.repeat(first, windows)
            begin, end = _meeting(texts, keys[some])
            meet = np.flatnonzero(begin < end)
            if len(meet):
                parts = [texts[i][a : b + WINDOW - 1] for i, a, b in zip(meet.tolist(), begin[meet].tolist(), end[meet].tolist(), strict=True)]
                part, place, low, _ = _least_first(parts, first[meet])
                least[(offset + begin)[meet][part] + place] = low
            heads = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (least[1:] != least[:-1]))))
            ends = np.concatenate((heads[1:], [len(who)]))
            useful = least[heads] < np.array([h[6] for h in held])[who[heads]]  # some document that holds it comes after the first one
            for a, b in zip(heads[useful].tolist(), ends[useful].tolist(), strict=True):
                rows.setdefault(int(who[a]), []).append({"a": int(at[a]), "b": int(at[b - 1]) + 1, "first": int(least[a])})
        yield pa.RecordBatch.from_arrays([pa.array([held[i][2] for i in rows], pa.int64()), pa.array([held[i][3] for i in rows], pa.int64()), pa.array(list(rows.values()), _RUN_TYPE)], names=["h1", "h2", "runs"])


def _first_windows(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """For anchors that are dealt over several collections: each window with its bytes and the smallest doc_id in its collection; one of equals is the head."""
    for held in _collections(batches, batch_bytes):
        who, at, least, head = _least_first([h[4] for h in held], np.array([h[5] for h in held]))
        h1, h2, last = (np.array([h[k] for h in held])[who] for k in (2, 3, 6))
        raw = pa.array([held[i][4][k : k + WINDOW] for i, k in zip(who.tolist(), at.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(at, pa.int32()), raw, pa.array(least, pa.int64()), pa.array(last, pa.int64()), pa.array(head)], names=["h1", "h2", "at", "bytes", "first", "last", "head"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw, spans = text.encode(), []
            for a, b in sorted((r["a"], min(r["b"], len(raw))) for r in ranges or []):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            kept, end = [], 0
            for a, b in spans:
                kept.append(raw[end:a])
                end = b
            kept = b"".join([*kept, raw[end:]])
            rows.append((doc, len(raw), len(raw) - len(kept), len(spans), kept, [{"a": a, "b": b} for a, b in spans]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])


def remove_repeats(docs: DataFrame, hot_segments: int = HOT_SEGMENTS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept (bytes), spans (removed, end exclusive).

    A byte goes if a string of WINDOW bytes that covers it also starts in a document with a smaller doc_id; strings are those of the input, and
    never cross documents. A null text counts as empty; a text shorter than WINDOW loses nothing. Rows that repeat a doc_id don't
    take from each other. A row with a null doc_id has no place in the order: it loses nothing and takes nothing. An empty table gives an empty result; only doc_id and text are read.
    Copies of whole texts, and equal pieces, are told by 128 bits of hash; that two different texts share an anchor, by 64. Bytes are compared in the construction.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text")).select("doc_id", "row", "text")
    long_ = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW))
    size = long_.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(64, int(size / 16 / BUCKET))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    smaller_batches(spark)
    scratch = Scratch(spark)
    # A copy of a text with a smaller doc_id goes as a whole, and adds nothing to what its first copy has.
    digest = scratch.save(long_.select("doc_id", "row", F.xxhash64(F.lit(1), "text").alias("row2")), "digests")
    again = digest.groupBy("row", "row2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    again = scratch.save(again.select("row", "row2", "first", "n"), "again")
    copies = scratch.save(skew_join(digest, again.drop("n"), ["row", "row2"], counts=again).where("doc_id > first").select("doc_id", "row").distinct(), "copies")
    scratch.drop("digests", "again")
    anchors = scratch.save(long_.mapInArrow(lambda it: _anchors(it, buckets), "chunk long, bucket int, data binary"), "anchors")
    shared = anchors.where("bucket >= 0").repartition(tasks, "bucket").sortWithinPartitions("bucket").select("chunk", "bucket", "data").mapInArrow(_shared, "chunk long, bucket int, data binary")
    chunks = shared.unionByName(anchors.where("bucket < 0")).repartition(tasks, "chunk").sortWithinPartitions("chunk", "bucket")
    marked = scratch.save(chunks.mapInArrow(_by_document, "doc_id long, row long, anchors binary"), "marked")
    scratch.drop("anchors")
    lookup = marked.join(copies, ["doc_id", "row"], "left_anti").dropDuplicates(["doc_id", "row"])
    found = long_.join(lookup, ["doc_id", "row"]).select("doc_id", "row", "text", "anchors")
    cut = found.mapInArrow(lambda it: _occurrences(it, buckets), "doc_id long, row long, start int, anchor long, segment binary")
    cut = scratch.save(cut, "segments")
    scratch.drop("marked")
    digests = {"h1": F.xxhash64("segment"), "h2": F.xxhash64(F.lit(1), "segment")}
    places = scratch.save(cut.withColumns(digests).select("doc_id", "row", "start", "h1", "h2"), "places")
    distinct = scratch.save(cut.groupBy("anchor", "segment").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).withColumns(digests), "distinct")
    scratch.drop("segments")
    columns = ["anchor", "part", "h1", "h2", "segment", "first", "last"]
    hot = scratch.save(distinct.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > hot_segments).select("anchor", F.ceil(F.col("k") / hot_segments).cast("int").alias("parts")), "hot")
    hot = F.broadcast(hot) if hot.count() <= MOST_HOT else hot
    told = distinct.join(hot, "anchor", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.col("h1"), F.col("parts"))).cast("int"))
    batched = lambda df: df.select(*columns).repartition(tasks, "anchor", "part").sortWithinPartitions("anchor", "part")
    runs = batched(told.where("parts IS NULL")).mapInArrow(lambda it: _first_documents(it, batch_bytes), _RUNS)
    single = scratch.save(batched(told.where("parts IS NOT NULL")).mapInArrow(lambda it: _first_windows(it, batch_bytes), _SINGLE), "windows")
    least = scratch.save(single.where("head").groupBy("bytes").agg(F.min("first").alias("least"), F.count("*").alias("n")), "least")
    lone = skew_join(single, least.drop("n"), ["bytes"]).where("least < last").groupBy("h1", "h2").agg(F.collect_list(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"), F.col("least").alias("first"))).alias("runs"))
    firsts = scratch.save(runs.unionByName(lone), "firsts")
    counts = distinct.select("h1", "h2", "n")
    covered = F.filter("runs", lambda r: r.first < F.col("doc_id"))
    ranges = skew_join(places, firsts, ["h1", "h2"], counts=counts).select("doc_id", "row", F.inline(F.transform(covered, lambda r: F.struct((F.col("start") + r.a).alias("a"), (F.col("start") + r.b + (WINDOW - 1)).alias("b")))))
    per_doc = scratch.save(ranges.groupBy("doc_id", "row").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "ranges")
    scratch.drop("distinct", "hot", "windows", "least", "places", "firsts")
    all_of_it = copies.select("doc_id", "row", F.array(F.struct(F.lit(0).alias("a"), F.lit(2**31 - 1).alias("b"))).alias("ranges"))
    whole = texts.join(per_doc.unionByName(all_of_it), ["doc_id", "row"], "left").select("doc_id", "text", "ranges")
    return whole.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<a: long, b: long>>")


def op2_substring_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(documents: list[tuple[int, str]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """The contract word for word, for tests: doc_id to (bytes, removed, spans, digest)."""
    first: dict[bytes, int] = {}
    for doc, text in documents:
        raw = text.encode()
        for i in range(len(raw) - window + 1):
            s = raw[i : i + window]
            first[s] = min(first.get(s, doc), doc)
    out = {}
    for doc, text in documents:
        raw = text.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - window + 1):
            if first[raw[i : i + window]] < doc:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1).sum())
        kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
        out[doc] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out
