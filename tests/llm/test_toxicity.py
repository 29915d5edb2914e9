"""Toxicity: segments by definition, whole scores against a plain version, held-out labels."""

import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from formwright.llm import toxicity


def slow_segments(score):
    """Maximal scoring segments by their definition: split at the best segment, again and again."""
    if not len(score):
        return []
    total = np.concatenate(([0], np.cumsum(score)))
    best = max(((total[b] - total[a], -(b - a), -a) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    a = -best[2]
    b = a - best[1]
    return [*slow_segments(score[:a]), (a, b - 1), *[(x + b, y + b) for x, y in slow_segments(score[b:])]]


def segments(score):
    at = np.flatnonzero(score > 0)
    sums = np.concatenate(([0.0], np.cumsum(score)))
    return toxicity.maximal_segments(at, score[at], sums[at] - sums[np.concatenate(([0], at[:-1] + 1)) if len(at) else at])


def test_segments_match_definition():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        score = np.where(rng.random(n) < 0.4, rng.uniform(0.1, 2, n), -rng.uniform(0.05, 0.6, n))
        got = segments(score)
        assert [(a, b) for a, b, _ in got] == slow_segments(score)
        assert [s for _, _, s in got] == pytest.approx([score[a : b + 1].sum() for a, b, _ in got])


def test_segments_in_linear_time():
    def took(n):
        began = time.process_time()
        for score in (np.tile([1.0, -1.5], n), np.concatenate([np.tile([0.5, -0.6], n // 2), np.tile([0.5, -0.4], n // 2)]), np.where(np.arange(2 * n) % 2 == 0, 1.0 + np.arange(2 * n) / n, -1.2)):
            assert segments(score)
        return time.process_time() - began

    took(1000)
    assert took(160_000) < 100 * max(took(10_000), 0.02)  # 256 times if quadratic, 16 if linear


def plain_score(text, model):
    """A whole document's score, token by token, by another tokeniser and the definition of its segments."""
    from formwright.llm.common import NOT_LETTER, word_hashes

    tokens = re.findall(r"[^\W\d_]+", text.lower())
    known = dict(zip(model.hashes.tolist(), model.scores.tolist(), strict=True))
    score = np.array([known.get(int(word_hashes([t.encode()], NOT_LETTER)[0][0]), 0.0) - toxicity.DRIFT for t in tokens])
    total = 0.0
    for a, b in slow_segments(score):
        s = score[a : b + 1].sum()
        if s >= 1 / model.rate:
            total -= np.log(-np.expm1(-model.size * len(tokens) * np.exp(-model.rate * s)))
    return 1 / (1 + np.exp(-(model.intercept + model.slope * np.log1p(total))))


def test_whole_documents_against_brute_force(spark):
    big = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{big}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{big}/labels.parquet"))
    some = docs.where("length(text) BETWEEN 20 AND 900 AND doc_id % 25 = 3")
    texts = {r.doc_id: r.text for r in some.collect()}
    got = {r.doc_id: r.score for r in toxicity.score(some, model).collect()}
    assert len(got) > 50 and max(got.values()) > 0.8
    for i, text in texts.items():
        assert got[i] == pytest.approx(plain_score(text, model), rel=1e-6), i


def test_held_out_labels(spark, duck):
    big = "/root/testdata/sf0.1"
    rows = toxicity.op7_toxicity(spark, big).toPandas()
    labels = duck.sql(f"SELECT doc_id, toxic FROM '{big}/labels.parquet'").df()
    held = rows.merge(labels, on="doc_id")
    held = held[held.held_out]
    assert (zlib.crc32(str(held.doc_id.iloc[0]).encode()) % 5) == 0
    yes, no = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    auc = ((yes[:, None] > no).mean()) + 0.5 * ((yes[:, None] == no).mean())
    # Some 5 % of the toxic labels are on texts that hold no word other toxic texts share.
    assert auc > 0.95 and (yes >= 0.5).mean() > 0.9 and (no < 0.5).mean() > 0.98


def test_cuts_alike_in_training_and_scoring(spark):
    texts = [f"lamp river {w} stone" for w in ("“zorg”", "zorg…", "zorg\u00a0", "！zorg—", "हिन्दी", "e\u0301zorg")]
    docs = spark.createDataFrame([(i, "plain river lamp stone " + ("zorg हिन्दी zorg" if i % 2 else "quiet market")) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    (found,) = toxicity._segments(iter([batch]), [(model.hashes, model.scores)], None)
    assert all(found[1]), found[1]


def test_odd(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(i, 0, int(i in (4, 6, 7))) for i in (1, 3, 4, 6, 7, 9, 12)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd_documents, labels)
    rows = toxicity.score(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(no_documents, model).count() == 0
    blank = toxicity.fit(no_documents, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd_documents, blank).collect())
    assert toxicity.drop_toxic(odd_documents, labels).columns == odd_documents.columns
    very_long = spark.createDataFrame([(1, "so you are a bad bad one " * 200_000)], "doc_id long, text string")
    assert toxicity.score(very_long, toxicity.ToxicityModel(np.sort(np.array([7], np.uint64)), np.ones(1), 1.0, 1.0, 0.0, 1.0)).count() == 1
