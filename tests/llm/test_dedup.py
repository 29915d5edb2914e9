"""Exact, near, substring and sentence dedup against plain versions."""

import hashlib
from collections import Counter, defaultdict

import pytest

from formwright.llm import exact_dedup, graph, near_dedup, sentence_spans, substrings


def shingle_set(text, n=5):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes(texts, least=0.8):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    at, common, root = defaultdict(list), Counter(), {i: i for i in texts}
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    for ids in at.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= least:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_exact_odd(odd_documents, no_documents):
    rows = exact_dedup.exact_groups(odd_documents, keep_largest=True).collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: r for r in rows}
    assert (by[1].keep_id, by[2].keep_id, by[1].group_size) == (2, 2, 2)
    assert (by[6].keep_id, by[8].kept, by[14].group_size, by[14].keep_id) == (8, True, 3, 14)
    assert by[None].keep_id is None and by[None].kept
    assert by[9].text_sha256 == hashlib.sha256(odd_documents.where("doc_id = 9").first().text.encode()).hexdigest()
    assert exact_dedup.exact_groups(no_documents).count() == 0
    kept = exact_dedup.drop_copies(odd_documents, keep_largest=False)
    assert kept.columns == odd_documents.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 6, 7, 9, 10, 11, 12, 13, 16]


def test_exact_runs_across_partitions(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id % 50) end as text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = exact_dedup.exact_groups(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = defaultdict(list)
    for i in range(4000):
        want["hot" if i % 3 == 0 else f"t{i % 50}"].append(i)
    for r in rows:
        ids = want["hot" if r.doc_id % 3 == 0 else f"t{r.doc_id % 50}"]
        assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), r.doc_id == min(ids))


def test_near_against_brute_force(documents, texts):
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents).collect()}
    assert got == classes(texts)


def test_near_odd(odd_documents, no_documents):
    by = {r.doc_id: r for r in near_dedup.near_duplicates(odd_documents).collect()}
    assert by[7].class_id == 6 and by[8].same_id == 6 and by[5].class_id == 4 and not by[5].kept
    assert all(by[i].class_id == i for i in (1, 2, 3, 9, 11, 16)) and by[14].class_id == 10
    assert by[None].class_id is None and by[None].kept
    assert near_dedup.near_duplicates(no_documents).count() == 0
    assert near_dedup.one_of_each(odd_documents).columns.count("score") == 1


def test_similarity_is_probability_jaccard():
    import numpy as np

    ids = lambda *x: np.array(x, np.uint32).tobytes()
    assert near_dedup.similarity(ids(1, 2, 3), b"", ids(2, 3, 4), b"") == pytest.approx(0.5)
    x, y = {1: 1 + np.log(4), 2: 1.0}, {1: 1.0, 2: 1.0, 3: 1.0}
    want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for d in {*x} & {*y})
    got = near_dedup.similarity(ids(1, 2), ids(4, 1), ids(1, 2, 3), b"")
    assert got == pytest.approx(max(want, 2 / 3))


def test_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    ids = np.sort(rng.choice(1 << 40, 300, replace=False)).astype(np.uint64)
    both = np.concatenate((ids[:200], ids[100:]))
    w = np.ones(len(both))
    sig = near_dedup.signatures(both, w, np.array([0, 200, 400]), 2000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(1 / 3, abs=0.05)
    heavy = near_dedup.signatures(both, np.concatenate((np.full(200, 3.0), np.ones(200))), np.array([0, 200, 400]), 2000)
    assert (heavy[0] == heavy[1]).mean() == pytest.approx(1 / 3, abs=0.05)


def test_open_buckets_are_compared_in_blocks(spark):
    from made_texts import prose

    base = prose(9, 150).split()
    rows = []
    for i in range(200):
        w = list(base)
        for k in range(i % 14):
            w[(i * 37 + k * 29) % 150] = f"z{i}x{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(dict(rows))


def test_near_with_repeated_shingles_in_one_text(spark):
    """Plain similarity over 0.8 where the weights differ much: the bands by weights alone would miss many."""
    rows = []
    for k in range(80):
        base = [f"w{k}x{i}" for i in range(130)]
        rows.append((2 * k, " ".join(base)))
        rows.append((2 * k + 1, " ".join(base + base[20:50] * 12)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(dict(rows)) and sum(got[2 * k + 1] == 2 * k for k in range(80)) == 80


def test_near_catches_planted_edits(spark):
    """Texts with words changed, dropped and put in, up to similarity 0.8 in shingles of five words, and large groups of them."""
    import random

    from made_texts import prose

    rnd = random.Random(3)
    rows, planted = [], []
    for k in range(150):
        words = prose(100 + k, rnd.randint(60, 400)).split()
        rows.append((20 * k, " ".join(words)))
        for c in range(1, 3 if k else 20):
            w = list(words)
            for _ in range(max(1, len(w) // 60)):
                at = rnd.randrange(len(w))
                w[at : at + 1] = rnd.choice(([], [f"new{at}"], [w[at], f"put{at}"]))
            rows.append((20 * k + c, " ".join(w)))
            a, b = shingle_set(rows[-1][1]), shingle_set(" ".join(words))
            if len(a & b) / len(a | b) >= 0.8:
                planted.append((20 * k + c, 20 * k))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(planted) > 150 and sum(got[a] == got[b] for a, b in planted) >= 0.99 * len(planted)


def test_hot_keys_are_split(spark):
    from formwright.llm.common import skew_join

    left = spark.range(5_000).selectExpr("id", "if(id % 3 = 0, 0, id) as k")
    right = spark.range(2_000).selectExpr("id as k", "id * 2 as v")
    for how in ("inner", "left"):
        got = skew_join(left, right, ["k"], how, hot=100)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)] + [(300, 300 + k) for k in range(1, 50)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[200] == got[150] == 100 and got[349] == 300
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substrings_against_brute_force(documents, texts):
    want = substrings.brute_force(list(texts.items()))
    for hot, size in ((4_000, 400_000), (2, 5_000)):
        out = substrings.remove_repeats(documents, hot_segments=hot, batch_bytes=size)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect()}
        assert got == want


def test_substrings_odd(odd_documents, no_documents, spark):
    rows = substrings.remove_repeats(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: r for r in rows}
    known = {r.doc_id: r.text or "" for r in odd_documents.collect() if r.doc_id is not None}
    want = substrings.brute_force(list(known.items()))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans) for i, r in by.items() if i is not None} == {i: w[:3] for i, w in want.items()}
    assert by[None].n_removed == 0 and by[14].n_removed == by[14].n_bytes
    assert substrings.remove_repeats(no_documents).count() == 0


def test_pieces_that_share_no_window_stay_out_of_the_construction(monkeypatch):
    import random

    import pyarrow as pa

    rnd = random.Random(3)
    letters = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    phrases, passages = [letters(26) for _ in range(6)], [letters(58) for _ in range(6)]
    texts = [(letters(70) + rnd.choice(phrases) + letters(70) + (rnd.choice(passages) + letters(60) if i % 8 == 0 else "")).encode() for i in range(240)] + [b"ab" * 90, b"x" + b"ab" * 60]
    owners, starts, counts, anchors = substrings.segments(texts)
    places = defaultdict(list)
    for i, s, c, anchor in zip(owners.tolist(), starts.tolist(), counts.tolist(), anchors.view("int64").tolist()):
        places[anchor, texts[i][s : s + c + 49]].append(i)
    keys = sorted(k for k in places if len({i for (a, _), own in places.items() if a == k[0] for i in own}) > 1)
    rows = [(a, 0, h, h, piece, min(places[a, piece]), max(places[a, piece])) for h, (a, piece) in enumerate(keys)]
    data = pa.table([pa.array(c) for c in zip(*rows)], names=["anchor", "part", "h1", "h2", "segment", "first", "last"])
    plain, sent = substrings._least_first, []
    monkeypatch.setattr(substrings, "_least_first", lambda some, first: (sent.append(sum(map(len, some))), plain(some, first))[1])
    got = {r["h1"]: {k: x["first"] for x in r["runs"] for k in range(x["a"], x["b"])} for b in substrings._first_documents(iter(data.to_batches()), 400_000) for r in b.to_pylist()}
    least = {}
    for _, _, _, _, piece, first, _ in rows:
        for k in range(len(piece) - 49):
            least[piece[k : k + 50]] = min(first, least.get(piece[k : k + 50], first))
    want = {h: {k: v for k in range(len(piece) - 49) if (v := least[piece[k : k + 50]]) < last} for _, _, h, _, piece, _, last in rows}
    assert got == {h: runs for h, runs in want.items() if runs} and len(got) > 20
    assert 0 < sum(sent) < 0.5 * sum(len(r[4]) for r in rows)


def test_collection_order_against_sorting():
    import numpy as np

    rng = np.random.default_rng(2)
    for letters, most in ((2, 50), (2, 3), (4, 5), (200, 50)):
        for _ in range(30):
            strings = [bytes(rng.integers(0, letters, rng.integers(0, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 12))]
            strings += strings[:2]
            size = np.array([len(x) for x in strings])
            begin = np.cumsum(size) - size
            buf = np.frombuffer(b"".join(strings) or b"x", np.uint8)
            at, lcp = substrings.collection_order(buf, begin, size, most)
            want = sorted(((x[k:], i, int(begin[i]) + k) for i, x in enumerate(strings) for k in range(len(x) + 1)), key=lambda r: (r[0], r[1], r[2]))
            got = [bytes(buf[a:e]) for a, e in zip(at.tolist(), (at + [len(w[0]) for w in want]).tolist())]
            assert got == [w[0] for w in want] and sorted(at.tolist()) == sorted(w[2] for w in want)
            common = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert lcp.tolist() == [0, *(min(most, common(x[0], y[0])) for x, y in zip(want, want[1:]))]


def test_sentences_match_sql(spark, sf_dir, duck):
    from row_checks import same_rows

    same_rows(sentence_spans.op3_sentence_span_dedup(spark, sf_dir).toPandas(), duck.sql(sentence_spans.ORACLE).df())


def test_sentences_odd(odd_documents, no_documents, spark):
    rows = sentence_spans.sentence_dedup(odd_documents).collect()
    assert len(rows) == odd_documents.count() and {r.doc_id: r.n_sentences for r in rows}[1] == 0
    assert sentence_spans.sentence_dedup(no_documents).count() == 0
    df = spark.createDataFrame([(1, "A b. C d. E f. G h."), (2, "X. A b.  C d. E f. Y."), (3, "A b. C d."), (4, "OH!! OH!! OH!! OH!!")], "doc_id long, text string")
    by = {r.doc_id: r for r in sentence_spans.sentence_dedup(df, words=5).collect()}
    assert by[1].removed == [] and by[2].removed == [1, 2, 3] and by[2].kept_text == "X. Y." and by[3].kept_text == "A b. C d." and by[4].removed == []


def slow_sentences(documents, least_sentences, least_words):
    """The definition word for word: doc_id to removed indexes."""
    import re

    first, places = {}, []
    for doc, text in sorted(documents):
        pieces = re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$", text)
        bare = [p.strip(" \t\r\n") for p in pieces]
        size = [len(re.findall(r"[^ \t\n\r\f\v]+", p)) for p in pieces]
        for i in range(len(pieces)):
            e, words = i, 0
            while e < len(pieces) and (words < least_words or e - i < least_sentences):
                words += size[e]
                e += 1
            if words >= least_words and e - i >= least_sentences:
                run = tuple(bare[i:e])
                first.setdefault(run, (doc, i))
                places.append((run, doc, i, e))
    gone = defaultdict(set)
    for run, doc, i, e in places:
        if first[run] != (doc, i):
            gone[doc].update(range(i, e))
    return gone


def test_sentences_against_brute_force(documents, texts):
    for hot in (2_000, 1):
        for least in ((2, 20), (3, 1), (1, 4)):
            want = slow_sentences(texts.items(), *least)
            got = {r.doc_id: r.removed for r in sentence_spans.sentence_dedup(documents, *least, hot_run=hot).collect()}
            assert {i: set(r) for i, r in got.items() if r} == dict(want)


def test_sentences_repeated_line_goes_once_from_each_document(spark):
    import pyarrow as pa

    line = " ".join(f"word{k}" for k in range(12)) + ".\n"
    rows = [(i, line * (3 + i) + f"Number {i} ends here, not like any other one does." + line * i) for i in range(6)]
    data = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "row", "text"])
    runs = [r for b in sentence_spans._runs(iter([data]), 2, 20) for r in b.to_pylist()]
    keys = [(r["doc_id"], r["h1"], r["h2"]) for r in runs]
    assert len(keys) == len(set(keys))  # so a join makes no more rows than documents have different runs
    assert max((r["at"] for r in runs if r["doc_id"] == 5), key=len) == [0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12]
    want = slow_sentences(rows, 2, 20)
    twice = spark.createDataFrame([*rows, rows[0], rows[5]], "doc_id long, text string")
    for hot in (2_000, 1):
        got = sentence_spans.sentence_dedup(twice, hot_run=hot).collect()
        assert len(got) == 8 and all(set(r.removed) == want[r.doc_id] for r in got)


def test_sentences_catch_planted_passages(spark):
    """Passages of over 50 words, put anywhere into other texts, cut sentences at both ends; clean texts with shouts and stock lines stay."""
    import random

    from made_texts import WORDS, prose

    rnd = random.Random(5)

    def story(n):
        out = []
        while sum(len(s.split()) for s in out) < n:
            out.append(" ".join(rnd.choice(WORDS) + str(rnd.randrange(500)) for _ in range(rnd.randint(3, 22))).capitalize() + ".")
        return " ".join(out)

    rows, planted = [], []
    for k in range(60):
        passage = story(51)
        for c in range(4):
            i = 4 * k + c
            rows.append((i, f"{prose(1000 + i, rnd.randint(5, 80))} {passage} {prose(5000 + i, rnd.randint(5, 80))}"))
            if c:
                planted.append(i)
    clean = range(1000, 1200)
    rows += [(i, f"{story(120)} All rights reserved. {' '.join('OH!! NO!! YES!!'.split())} {story(60)}\nLicensed under the Stone License, Version 2.0.") for i in clean]
    got = {r.doc_id: r.removed for r in sentence_spans.sentence_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(got[i]) for i in planted) >= 0.95 * len(planted)
    assert not any(got[i] for i in clean) and not any(got[4 * k] for k in range(60))
