"""Substring dedup over sliding sentence spans.

From every sentence a run starts: the shortest one of several whole sentences that together reach a least number of words,
so that neither short shouts nor stock phrases count, and two long sentences are enough. A run is told by 128 bits of hash of its
sentences' 128-bit hashes. A run that a text repeats is one row with all its places there. A global aggregation finds the first place of every run
that occurs more than once; sentences that any other occurrence covers are removed. Only hashes and places are shuffled for this; texts move once,
to be rebuilt. The first places of very common runs go to every task, so no task gets all occurrences of one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, mix, saved, smaller_batches, table, text_chunks

#: A run has this many sentences at least, and this many words at least.
SENTENCES, WORDS = 2, 20
#: A run in more documents than this is hot; the first places of up to so many hot runs (40 bytes each) go to every task.
HOT_RUN, BROADCAST_RUNS = 2_000, 200_000
_U = np.uint64
#: A sentence is a stretch up to and with its closing marks or line end; sentences join up to the whole text.
_END = np.isin(np.arange(256), np.frombuffer(b".!?\n", dtype=np.uint8))
#: White space at a sentence's ends does not count when sentences are compared.
_BARE = b" \t\r\n"
_B1, _B2 = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)


def _cut(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts joined: the starts and ends of their sentences, the words of each sentence, and where each text's sentences begin."""
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if not len(buf):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(len(raw) + 1, dtype=np.int64)
    end = _END[buf]
    new = np.concatenate(([True], end[:-1] & ~end[1:]))
    new[offsets[:-1][sizes > 0]] = True
    starts = np.flatnonzero(new)
    word = ~WHITE[buf]
    begins = word & np.concatenate(([True], ~word[:-1]))
    begins[starts] = word[starts]
    counted = np.concatenate(([0], np.cumsum(begins)))
    ends = np.concatenate((starts[1:], [len(buf)]))
    return starts, ends, counted[ends] - counted[starts], np.searchsorted(starts, offsets)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=_U)
    p[:1] = 1
    return np.cumprod(p, dtype=_U)


def _run_hash(sentence: np.ndarray, at: np.ndarray, to: np.ndarray, base: np.uint64) -> np.ndarray:
    """A hash of sentences at..to (exclusive), as a difference of prefix sums of a polynomial in their hashes."""
    sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(mix(sentence) * _powers(base, len(sentence)), dtype=_U)))
    back = _powers(_U(pow(int(base), -1, 2**64)), len(sentence) + 1)
    return mix((sums[to] - sums[at]) * back[at] + (to - at).astype(_U))


def _runs(batches: Iterator[pa.RecordBatch], sentences: int, words: int) -> Iterator[pa.RecordBatch]:
    """Each document's different runs, with the ascending indexes of the sentences that they start at."""
    for batch in text_chunks(batches, "text"):
        raw = [t.encode() for t in batch.column(2).to_pylist()]
        starts, ends, counts, first = _cut(raw)
        n = np.arange(len(starts))
        joined = b"".join(raw)
        digests = b"".join(xxhash.xxh3_128_digest(joined[a:b].strip(_BARE)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
        both = np.frombuffer(digests, dtype=">u8").astype(_U).reshape(-1, 2)
        before = np.concatenate(([0], np.cumsum(counts)))
        doc = np.repeat(np.arange(len(raw)), np.diff(first))
        to = np.maximum(np.searchsorted(before, before[:-1] + words, "left"), n + sentences)
        whole = np.flatnonzero(to <= first[1:][doc]) if len(n) else n
        h1, h2 = (_run_hash(both[:, k], whole, to[whole], base).view(np.int64) for k, base in ((0, _B1), (1, _B2)))
        order = np.lexsort((h2, h1, doc[whole]))
        whole, h1, h2 = whole[order], h1[order], h2[order]
        owner = doc[whole]
        new = np.ones(len(whole), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        head = np.flatnonzero(new)
        at = pa.ListArray.from_arrays(pa.array(np.append(head, len(whole)).astype(np.int32)), pa.array((whole - first[owner]).astype(np.int32)))
        cols = [pa.array(h1[head]), pa.array(h2[head]), batch.column(0).take(pa.array(owner[head])), batch.column(1).take(pa.array(owner[head])), at, pa.array((to[whole] - whole)[head].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, names=["h1", "h2", "doc_id", "row", "at", "n"])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, "text"):
        raw = [t.encode() for t in batch.column(1).to_pylist()]
        starts, ends, _, first = _cut(raw)
        joined, removed, kept = b"".join(raw), [], []
        for i, ranges in enumerate(batch.column(2).to_pylist()):
            a, b = int(first[i]), int(first[i + 1])
            gone = np.zeros(b - a + 1, dtype=np.int64)
            for r in ranges or []:
                for at in r["at"]:
                    gone[at] += 1
                    gone[at + r["n"]] -= 1
            out = np.cumsum(gone)[:-1] > 0
            removed.append(np.flatnonzero(out).astype(np.int32))
            stays = np.flatnonzero(~out) + a
            kept.append(b"".join(joined[x:y] for x, y in zip(starts[stays].tolist(), ends[stays].tolist(), strict=True)).decode() if out.any() else batch.column(1)[i].as_py())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first).astype(np.int32)), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=["doc_id", "n_sentences", "removed", "kept_text"])


def sentence_dedup(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, hot_run: int = HOT_RUN) -> DataFrame:
    """One row per input row: doc_id, n_sentences, removed (ascending indexes from 0), kept_text.

    A run starts at each sentence and ends with the first that brings it to `sentences` sentences and `words` words; a text's last sentences that don't
    reach both start none. Words are parted by ASCII white space. Of equal runs the one with the smallest (doc_id, index) is the
    first and stays, even where it overlaps removed ones; all others go, in the same document too. Null and empty texts have no sentence.
    Rows that repeat a doc_id are taken as one document each, ordered by a hash of text; rows that repeat doc_id and text are one occurrence. A null doc_id
    sorts first. An empty table gives an empty result; only doc_id and text are read.
    """
    smaller_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("row"), text.alias("text"))
    places = saved(rows.mapInArrow(lambda it: _runs(it, sentences, words), "h1 long, h2 long, doc_id long, row long, at array<int>, n int"), "sentence-runs")
    place = F.struct("doc_id", "row", F.col("at")[0].alias("at"))
    first = saved(places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.sum(F.size("at")).alias("times"), F.count("*").alias("docs")).where("times > 1").drop("times"), "repeated-runs")
    hot = first.where(F.col("docs") > hot_run).drop("docs")
    small = hot.count() <= BROADCAST_RUNS
    if small:  # common runs meet their first place where they are; the others are joined
        told = places.join(F.broadcast(hot.withColumnRenamed("first", "hot")), ["h1", "h2"], "left")
        known = told.where("hot IS NOT NULL").select("doc_id", "row", "at", "n", F.col("hot").alias("first"))
        rest, cold = told.where("hot IS NULL").drop("hot"), first.where(F.col("docs") <= hot_run).drop("docs")
    else:
        known, rest, cold = None, places, first.drop("docs")
    others = rest.join(cold, ["h1", "h2"]).select("doc_id", "row", "at", "n", "first")
    others = others if known is None else others.unionByName(known)
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))  # all places of a run go but its first one
    others = others.withColumn("at", F.when(own, F.slice("at", 2, F.size("at"))).otherwise(F.col("at"))).where(F.size("at") > 0)
    per_doc = others.groupBy("doc_id", "row").agg(F.collect_set(F.struct("at", "n")).alias("ranges"))
    per_doc = per_doc.select(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row"), "ranges")
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("row") == F.col("of_row")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(_rebuilt, "doc_id long, n_sentences int, removed array<int>, kept_text string")


def op3_sentence_span_dedup(spark, sf_dir):
    out = sentence_dedup(table(spark, sf_dir, "documents"))
    removed = F.array_join(F.transform("removed", lambda i: i.cast("string")), ",")
    return out.select("doc_id", F.col("n_sentences").cast("long").alias("n_sentences"), F.size("removed").cast("long").alias("n_removed"), removed.alias("removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "kept_text")


ORACLE = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+$') AS pieces FROM documents),
flat AS (SELECT doc_id, unnest(range(len(pieces))) AS i, unnest(pieces) AS piece FROM docs),
bare AS (SELECT doc_id, i, piece, regexp_replace(piece, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS s, len(regexp_extract_all(piece, '[^ \t\n\v\f\r]+')) AS w FROM flat),
summed AS (SELECT doc_id, i, piece, s, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS cw FROM bare),
lists AS (SELECT doc_id, list(s ORDER BY i) AS all_s FROM bare GROUP BY doc_id),
reach AS (SELECT doc_id, cw, min(i) AS e FROM summed GROUP BY doc_id, cw),
ended AS (SELECT a.doc_id, a.i, greatest(r.e, a.i + {SENTENCES - 1}) AS e FROM (SELECT doc_id, i, cw - w + {WORDS} AS goal FROM summed) a ASOF JOIN reach r ON a.doc_id = r.doc_id AND a.goal <= r.cw),
runs AS (SELECT x.doc_id, i, e, all_s[i + 1 : e + 1] AS run FROM ended x JOIN lists USING (doc_id) WHERE e < len(all_s)),
told AS (SELECT doc_id, i, e, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS k FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, e + 1)) AS i FROM told WHERE n > 1 AND k > 1),
marked AS (SELECT b.doc_id, b.i, b.piece, g.i IS NOT NULL AS out FROM bare b LEFT JOIN gone g ON b.doc_id = g.doc_id AND b.i = g.i),
sums AS (SELECT doc_id, count(*) FILTER (out) AS n_removed, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (out), '') AS removed, coalesce(string_agg(piece, '' ORDER BY i) FILTER (NOT out), '') AS kept_text FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(d.pieces)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed, sha256(coalesce(kept_text, '')) AS kept_sha256, coalesce(kept_text, '') AS kept_text
FROM docs d LEFT JOIN sums USING (doc_id)
"""
