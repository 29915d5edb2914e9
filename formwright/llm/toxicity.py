"""Toxic passages by maximum-scoring segments.

Every token has a log-odds of toxic against clean documents under a Dirichlet prior that is the labelled corpus's own token
distribution. Odds are shrunk towards 0 by SHRINK of their standard deviations, so a token scores as much as its
counts surely say; a token that says nothing surely, or was never seen, scores 0, and every token also pays DRIFT.
A linear scan of a text finds all its maximal scoring segments. Their scores are set against the extreme-value law of segments in
clean text (rate lambda from the token scores, size K from clean texts), and the surprise of a text's segments together is
calibrated to a probability. K and the calibration come from texts that the odds were not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_LETTER, saved, smaller_batches, table, text_chunks, whole_texts, word_hashes

#: Most labelled rows that the model is fitted on (those with the smallest hash of doc_id); everything else covers all rows.
TRAIN_ROWS = 30_000
#: Prior mass as a share of the training tokens; standard deviations by which odds shrink; what each token pays.
PRIOR, SHRINK, DRIFT = 0.1, 2.0, 0.05
#: One part of the labels is held out of everything: crc32(doc_id) mod FOLDS is 0.
FOLDS = 5
_U = np.uint64


@dataclass(frozen=True)
class ToxicityModel:
    """Token hashes ascend; scores go with them. Only tokens whose shrunk odds are not 0 are held: each is in several labelled texts, so their number is bounded by TRAIN_ROWS texts."""

    hashes: np.ndarray
    scores: np.ndarray
    rate: float
    size: float
    intercept: float
    slope: float


def maximal_segments(at: np.ndarray, gain: np.ndarray, loss: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a text, given the tokens that gain, their gains, and the loss of all tokens before each since the last one.

    Linear (Ruzzo and Tompa): a candidate joins the nearest earlier one that starts lower, if that ends lower. Each candidate keeps
    a link to its nearest earlier one that starts lower, so no other is looked at twice.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    total = 0.0
    for p, g, x in zip(at.tolist(), gain.tolist(), loss.tolist(), strict=True):
        total += x
        start, begin = p, total
        total += g
        j = len(low) - 1
        while j >= 0 and low[j] >= begin:
            j = link[j]
        while j >= 0 and high[j] < total:
            start, begin, up = first[j], low[j], link[j]
            del first[j:], last[j:], low[j:], high[j:], link[j:]
            j = up
        first.append(start)
        last.append(p)
        low.append(begin)
        high.append(total)
        link.append(j)
    return [(a, b, h - lo) for a, b, lo, h in zip(first, last, low, high, strict=True)]


def surprise(scores: np.ndarray, tokens: np.ndarray, rate: float, size: float) -> np.ndarray:
    """Minus the log of the chance that clean text of so many tokens has a segment of such a score: -log(1 - exp(-K n exp(-lambda S)))."""
    expected = size * np.maximum(tokens, 1) * np.exp(-rate * np.minimum(scores, 700.0 / rate))
    return -np.log(np.maximum(-np.expm1(-expected), 1e-300))


def _letters(text: str) -> str:
    """Lower-cased, and a space for every character outside ASCII that is no letter: what NOT_LETTER then parts are runs of letters by code point."""
    text = text.lower()
    if text.isascii():
        return text
    for c in {c for c in set(text) if c > "\x7f" and not c.isalpha()}:  # few kinds in a text, and replace() is far faster than translate()
        text = text.replace(c, " ")
    return text


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch's texts, and where each text's begin: the one cut for training and scoring."""
    h, first, _, _ = word_hashes([_letters(t).encode() for t in batch.column(1).to_pylist()], NOT_LETTER)
    return h, first


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For training: for each token, how many of a piece's texts hold it, by half (0, 1) and label."""
    for batch in text_chunks(batches):
        h, first = _tokens(batch)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
        held = pd.DataFrame({"token": h.view(np.int64), "doc": doc}).drop_duplicates()
        kind = (2 * batch.column(3).to_numpy(zero_copy_only=False) + batch.column(2).to_numpy(zero_copy_only=False))[held["doc"].to_numpy()]
        n = held.assign(**{f"n{k}": (kind == k).astype(np.int64) for k in range(4)}).drop(columns="doc").groupby("token", as_index=False).sum()
        yield pa.RecordBatch.from_pandas(n, preserve_index=False)


def _segments(batches: Iterator[pa.RecordBatch], models: list[tuple[np.ndarray, np.ndarray]], which: int | None):
    """Batch, then for each text its segments and its count of tokens. models: token hashes and scores; which: the column that says which of them a row gets."""
    for batch in text_chunks(batches):
        h, first = _tokens(batch)
        pick = np.zeros(batch.num_rows, np.int64) if which is None else batch.column(which).to_numpy(zero_copy_only=False)
        owner = np.repeat(pick, np.diff(first))
        score = np.full(len(h), -DRIFT)
        for k, (hashes, scores) in enumerate(models):
            if len(hashes):
                where = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                score += np.where((hashes[where] == h) & (owner == k), scores[where], 0.0)
        sums = np.concatenate(([0.0], np.cumsum(score)))
        gains = np.flatnonzero(score > 0)
        cut = np.searchsorted(gains, first)
        before = np.concatenate(([0], gains[:-1] + 1)) if len(gains) else gains
        found = []
        for i in range(batch.num_rows):
            at = gains[cut[i] : cut[i + 1]]
            since = np.maximum(before[cut[i] : cut[i + 1]], first[i])
            found.append(maximal_segments(at - first[i], score[at], sums[at] - sums[since]) if len(at) else [])
        yield batch, found, np.diff(first)


def _statistics(batches: Iterator[pa.RecordBatch], models: list, rates: list[float]) -> Iterator[pa.RecordBatch]:
    """For training: label, half, tokens, and the scores of the segments over the level from which the extreme-value law is used. Each half is scored by the other's odds."""
    for batch, found, tokens in _segments(batches, models, 3):
        level = [1.0 / rates[k] for k in batch.column(3).to_pylist()]
        scores = [[s for _, _, s in x if s >= least] for x, least in zip(found, level, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(tokens, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=["toxic", "half", "tokens", "scores"])


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first_token", pa.int64()), ("last_token", pa.int64()), ("score", pa.float64())]))
    level = 1.0 / model.rate
    for batch, found, tokens in _segments(batches, [(model.hashes, model.scores)], None):
        strong = [[x for x in f if x[2] >= level] for f in found]
        evidence = _evidence([[s for _, _, s in f] for f in strong], tokens, model.rate, model.size)
        score = 1.0 / (1.0 + np.exp(-(model.intercept + model.slope * evidence)))
        # Significant: fewer than one such segment is expected in clean text of this length.
        spans = [[{"first_token": a, "last_token": b, "score": s} for a, b, s in f if model.rate * s > np.log(max(model.size * n, 1.0))] for f, n in zip(strong, tokens.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(spans, kind)], names=["doc_id", "score", "segments"])


def _evidence(scores: list[list[float]], tokens: np.ndarray, rate: float, size: float) -> np.ndarray:
    """A text's summed surprise, on a log scale: what is far beyond doubt adds little more."""
    n = np.array([len(s) for s in scores], dtype=np.int64)
    each = surprise(np.array([x for s in scores for x in s]), np.repeat(tokens, n), rate, size)
    return np.log1p(np.bincount(np.repeat(np.arange(len(n)), n), each, minlength=len(n)))


def _calibrate(x: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic regression by Newton steps with a weak ridge."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (toxic - p) - 1e-3 * w
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), grad)
        w += np.clip(step, -2, 2)
    return float(w[0]), max(float(w[1]), 0.0)


def _odds(t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shrunk log-odds of each token from the toxic and clean texts that hold it, and its share of clean text."""
    n_t, n_c = t.sum(), c.sum()
    if not n_t or not n_c:
        return np.zeros(len(t)), np.zeros(len(t))
    prior = PRIOR * (n_t + n_c)
    a = np.maximum(t + c, 0.5) * (prior / (n_t + n_c))
    odds = np.log((t + a) / (n_t + prior - t - a)) - np.log((c + a) / (n_c + prior - c - a))
    sure = np.maximum(np.abs(odds) - SHRINK * np.sqrt(1 / (t + a) + 1 / (c + a)), 0.0)
    return np.sign(odds) * sure, (c + a) / (n_c + prior)


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """lambda: the positive root of E[exp(lambda s)] = 1 over tokens of clean text, whose mean score is negative."""
    low, high = 1e-6, 50.0
    s, rest = scores - DRIFT, max(1 - share.sum(), 0.0)
    for _ in range(100):
        mid = (low + high) / 2
        value = (share * np.exp(np.clip(mid * s, None, 200))).sum() + rest * np.exp(-mid * DRIFT)
        low, high = (mid, high) if value < 1 else (low, mid)
    return max(low, 0.05)


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most `train_rows` labelled documents whose crc32(doc_id) mod FOLDS is not 0."""
    able = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    chosen = able.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    return whole_texts(docs).join(F.broadcast(chosen), "doc_id")  # at most train_rows rows of two numbers


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows. Without both labels in each half of it, every text scores the share of toxic labels, or 0."""
    smaller_batches(docs.sparkSession)
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("long").alias("half")
    rows = saved(training_rows(docs, labels, train_rows).select("doc_id", "text", F.col("toxic").cast("long").alias("toxic"), half), "toxic-training")
    counts = rows.mapInArrow(_counts, "token long, n0 long, n1 long, n2 long, n3 long").groupBy("token").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
    # A token that fewer than 3 texts hold has no sure odds whatever they are: it scores 0, as a token never seen does.
    known = counts.where("n0 + n1 + n2 + n3 > 2").toArrow()
    token = known.column("token").to_numpy().view(_U)
    n = np.stack([known.column(f"n{k}").to_numpy() for k in range(4)]).astype(np.float64)
    order = np.argsort(token)
    token, n = token[order], n[:, order]

    def odds(t: np.ndarray, c: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], float]:
        score, share = _odds(t, c)
        use = score != 0
        return (token[use], score[use]), _rate(score[use], share[use])

    # The model at place k judges half k: it comes from the other half.
    (one, rate_one), (two, rate_two) = odds(n[3], n[2]), odds(n[1], n[0])
    (hashes, scores), rate = odds(n[1] + n[3], n[0] + n[2])
    judged = rows.mapInArrow(lambda it: _statistics(it, [one, two], [rate_one, rate_two]), "toxic long, half long, tokens long, scores array<double>").toArrow()  # at most train_rows rows
    toxic = judged.column("toxic").to_numpy().astype(np.float64)
    share = toxic.mean() if len(toxic) else 0.0
    flat = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not len(hashes) or not len(one[0]) or not len(two[0]):
        return ToxicityModel(hashes[:0], scores[:0], 1.0, 1.0, flat, 0.0)
    side, tokens, found = judged.column("half").to_numpy(), judged.column("tokens").to_numpy(), judged.column("scores").to_pylist()
    evidence, sizes = np.zeros(len(toxic)), []
    for k, own in enumerate((rate_one, rate_two)):
        mine = np.flatnonzero(side == k)
        clean = [i for i in mine if not toxic[i]]
        sizes.append((sum(len(found[i]) for i in clean) + 1) / (tokens[clean].sum() + 1) * np.e)
        evidence[mine] = _evidence([found[i] for i in mine], tokens[mine], own, sizes[k])
    intercept, slope = _calibrate(evidence, toxic)
    return ToxicityModel(hashes, scores, rate, float(np.mean(sizes)), intercept, slope)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per input row: doc_id, score in (0, 1), predicted (score of 0.5 or more), segments (spans of letter-run tokens, and their scores).

    A null or empty text has no segment and scores as any text without one. Only doc_id and text are read; repeated rows and null ids are scored as they come.
    """
    smaller_batches(docs.sparkSession)
    scored = whole_texts(docs).mapInArrow(lambda it: _score(it, model), "doc_id long, score double, segments array<struct<first_token: long, last_token: long, score: double>>")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "segments")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic; all columns kept. The verdict on a doc_id is that on any of its rows; null ids stay."""
    rejected = score(docs, fit(docs, labels)).where("predicted = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti")


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))
