"""Document fingerprints by a homomorphic multiset hash.

Every paragraph is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors, lane by lane,
modulo 2**16. So the order of paragraphs doesn't matter, and a paragraph is put in or taken out by one addition. A
vector has two parts: EQUAL lanes from an extendable-output hash of the whole paragraph, for equality; and LIKE lanes to
which the paragraph's runs of words each add or take one at a hashed place, for likeness. Lanes of likeness are read as
signed 16-bit numbers: a lane that the same runs move beyond 32767 wraps, as all lanes do, so likeness says little about such texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, mix, shingles, smaller_batches, table, word_hashes

EQUAL, LIKE = 64, 256
#: Words of a run, within one paragraph.
WORDS = 3
#: Documents of one range of the neighbour pass, and the most ranges; their ends are all that reaches the driver. Beyond, ranges
#: grow, but a task streams its ranges in order and holds CHUNK_BYTES of text.
DOCS_PER_PART, MOST_PARTS = 1_000, 100_000
_U = np.uint64


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of EQUAL + LIKE 16-bit lanes for each text. Paragraphs are lines; blank ones and white space at their ends don't count."""
    out = np.zeros((len(texts), EQUAL + LIKE), dtype=np.uint16)
    paragraphs, owner = [], []
    for i, text in enumerate(texts):
        lines = [p for p in (line.strip() for line in text.split("\n")) if p]
        paragraphs += lines
        owner += [i] * len(lines)
    if not paragraphs:
        return out
    raw = [p.encode() for p in paragraphs]
    own = np.array(owner)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    wide = np.frombuffer(b"".join(hashlib.shake_128(p).digest(2 * EQUAL) for p in raw), dtype="<u2").reshape(-1, EQUAL)
    out[own[first], :EQUAL] = np.add.reduceat(wide, first, axis=0, dtype=np.uint16)
    words, begin, _, _ = word_hashes(raw)
    h, par = shingles(words, begin, WORDS)
    h = mix(h ^ _U(0x5851F42D4C957F2D))
    lane = ((h >> _U(32)) * _U(LIKE) >> _U(32)).astype(np.int64)
    sign = np.where(h & _U(1), 1, -1)
    sums = np.bincount(own[par] * LIKE + lane, sign, minlength=len(texts) * LIKE)
    out[:, EQUAL:] = sums.astype(np.int64).astype(np.uint16).reshape(len(texts), LIKE)
    return out


def insert(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    return fingerprint + fingerprints([paragraph])[0]


def delete(fingerprint: np.ndarray, paragraph: str) -> np.ndarray:
    return fingerprint - fingerprints([paragraph])[0]


def shown(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype("<u2").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in [0, 1]: 1 for equal fingerprints; else the share of word runs in common that the LIKE lanes estimate, 2 a.b / (a.a + b.b)."""
    x, y = a[:, EQUAL:].view(np.int16).astype(np.float64), b[:, EQUAL:].view(np.int16).astype(np.float64)
    scale = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    near = np.divide(2 * (x * y).sum(axis=1), scale, out=np.zeros(len(x)), where=scale > 0)
    return np.where((a == b).all(axis=1), 1.0, np.clip(near, 0.0, 1.0))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint (base64 of its lanes). A null text counts as empty: all lanes 0. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shown(f) for f in fingerprints(batch.column(1).to_pylist())], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", F.coalesce("text", F.lit(""))).mapInArrow(run, "doc_id long, fingerprint string")


_EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _flush(rows: list[tuple[int | None, str]], following: list[str]) -> pa.RecordBatch:
    texts = [t for _, t in rows]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
    own, changed = fingerprints(texts), fingerprints(edited)
    other = [i for i, n in enumerate(following) if i + 1 == len(rows) or n is not texts[i + 1]]
    nxt = np.concatenate((own[1:], own[:1]))
    nxt[other] = fingerprints([following[i] for i in other])
    cols = [[d for d, _ in rows], [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited], [shown(f) for f in own], [shown(f) for f in changed], likeness(own, changed), likeness(own, nxt)]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _EDITS.split(", ")])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in descending order; a lent row ends its range and only serves as the next of the row before it."""
    part, held = None, None
    rows, following, size = [], [], 0
    for batch in batches:
        for p, doc, text, lent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                part, held = p, None
            if held is not None:
                rows.append(held)
                following.append(text)
                size += len(held[1]) + len(text)
                if size > CHUNK_BYTES:
                    yield _flush(rows, following)
                    rows, following, size = [], [], 0
            held = None if lent else (doc, text)
    if rows:
        yield _flush(rows, following)


def _range_code(ids: list[int], hashes: list[int]):
    """For (id, h): twice the number of its range, plus 1 where it is the range's last key."""
    b_id, b_h = np.array(ids, dtype=np.int64), np.array(hashes, dtype=np.int64)

    @F.pandas_udf("long")
    def code(doc: pd.Series, h: pd.Series) -> pd.Series:
        x, y = doc.to_numpy(), h.to_numpy()
        at, to = np.searchsorted(b_id, x, "left"), np.searchsorted(b_id, x, "right")
        for i in np.flatnonzero(to > at):
            at[i] += np.searchsorted(b_h[at[i] : to[i]], y[i], "left")
        last = (b_id[np.minimum(at, len(b_id) - 1)] == x) & (b_h[np.minimum(at, len(b_id) - 1)] == y)
        return pd.Series(2 * at + last)

    return code


def edited_neighbours(docs: DataFrame, docs_per_part: int = DOCS_PER_PART, most_parts: int = MOST_PARTS) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many, or all, of the next document's, in descending
    order of doc_id (rows that repeat a doc_id: by a hash of text; null ids last); after the last comes the first. One document alone is its own next. A null text counts as
    empty. Ranges of doc_id are dealt to tasks, each with a second copy of the row that follows its last one, so texts move once. An empty table gives an empty result; only doc_id and text are read.
    """
    smaller_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"id": F.coalesce("doc_id", F.lit(-(2**63))), "h": F.xxhash64("text")})
    keys = rows.select("id", "h")
    parts = min(max(1, -(-keys.count() // docs_per_part)), most_parts)
    ends = keys.repartitionByRange(parts, "id", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.max(F.struct("id", "h")).alias("last"))
    bounds = sorted((r.last.id, r.last.h) for r in ends.collect())  # one row for each range: most_parts at most
    code = _range_code(*map(list, zip(*(bounds or [(0, 0)]), strict=True)))
    own = F.struct(F.floor(F.col("code") / 2).cast("long").alias("part"), F.lit(False).alias("lent"))
    lent = F.struct(((F.floor(F.col("code") / 2) + 1) % max(1, len(bounds))).cast("long").alias("part"), F.lit(True).alias("lent"))
    dealt = rows.withColumn("code", code("id", "h")).select("doc_id", "text", "id", "h", F.inline(F.when(F.col("code") % 2 == 1, F.array(own, lent)).otherwise(F.array(own))))
    ordered = dealt.repartition(max(1, len(bounds)), "part").sortWithinPartitions("part", "lent", F.desc("id"), F.desc("h"))
    return ordered.select("part", "doc_id", "text", "lent").mapInArrow(_edits, _EDITS)


def op4_multiset_fingerprints(spark, sf_dir):
    return edited_neighbours(table(spark, sf_dir, "documents"))
