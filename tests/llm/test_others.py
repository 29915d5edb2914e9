"""Fingerprints, packing, URL rules, toxicity, mixing, personal data, and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
from row_checks import same_rows

from formwright.llm import fingerprint, mixing, packing, pii, url_filter


def edits(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        yield i, t, t[: len(t) - len(t) // 2] + n[: len(t) // 2], n


def test_fingerprints_against_brute_force(documents, texts):
    for size in (7, 10_000):
        got = {r.doc_id: r for r in fingerprint.edited_neighbours(documents, docs_per_part=size).collect()}
        for i, t, e, n in edits(texts.items()):
            a, b, c = fingerprint.fingerprints([t, e, n])
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.shown(a), fingerprint.shown(b))
            assert r.near_edited == fingerprint.likeness(a[None], b[None])[0] and r.near_next == fingerprint.likeness(a[None], c[None])[0]


def test_fingerprint_laws():
    a, b, c = "first line here", "second line there", "third one is this"
    f = lambda *lines: fingerprint.fingerprints(["\n".join(lines)])[0]
    assert (f(a, b, c) == f(c, a, b)).all() and (f(a, b) != f(a, a, b)).any()
    assert (fingerprint.insert(f(a, b), c) == f(a, b, c)).all() and (fingerprint.delete(f(a, b, c), b) == f(a, c)).all()
    assert not fingerprint.fingerprints(["", " \n "]).any()


def test_fingerprints_odd(odd_documents, no_documents):
    rows = fingerprint.edited_neighbours(odd_documents, docs_per_part=3).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprint.edited_neighbours(no_documents).count() == 0
    assert fingerprint.edited_neighbours(odd_documents.where("doc_id = 9")).first().near_next == 1
    assert fingerprint.fingerprint_documents(odd_documents).count() == odd_documents.count()


def test_packing_round_trip(documents, texts, odd_documents, no_documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = {1: "<|endoftext|>", 2: "a <|endoftext|><|endoftext|> b\n<|endoftext|", 3: "<|ENDOFTEXT|> <|endoftext|>s " * 900, 4: None}
    odd = documents.sparkSession.createDataFrame(list(special.items()), "doc_id long, text string")
    for df, known in ((odd, {i: t or "" for i, t in special.items()}), (documents, texts), (odd_documents.where("doc_id <> 14 AND doc_id IS NOT NULL"), {r.doc_id: r.text or "" for r in odd_documents.collect()})):
        rows = packing.pack(df).collect()
        by, places = {}, {}
        for r in rows:
            by.setdefault(r.doc_id, []).append(r)
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for i, pieces in by.items():
            ids = np.array([*tokenizer.encode(known[i], add_special_tokens=False).ids, 0], dtype="<u4")
            pieces.sort(key=lambda r: r.piece)
            assert sum(r.length for r in pieces) == len(ids) and all(r.length == 2048 for r in pieces[1:])
            for r in pieces:
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        for spans in places.values():
            end = 0
            for offset, length in sorted(spans):
                assert offset == end
                end += length
            assert end <= 2048
        assert len(places) <= -(-sum(r.length for r in rows) // 2048) + 3
    assert packing.pack(no_documents).count() == 0
    assert packing.pack(odd_documents).count() >= odd_documents.count()


def fewest(items, capacity):
    """Exact bin packing of a few items."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] >= items[k]:
                place(k + 1, [*bins[:j], bins[j] - items[k], *bins[j + 1 :]])
        place(k + 1, [*bins, capacity - items[k]])

    place(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    rng = np.random.default_rng(4)
    for _ in range(60):
        items = rng.integers(1, 31, rng.integers(1, 9)).tolist()
        counts = np.bincount(items, minlength=31).tolist()
        rest = list(counts)
        fixed = packing.reduce_dominated(rest, 30)
        left = [s for s, n in enumerate(rest) for _ in range(n)]
        assert sum(n for _, n in fixed) + (fewest(left, 30) if left else 0) == fewest(items, 30)
        plan = packing.packing_plan(counts, 30)
        assert plan[:, 0].tolist() == sorted(plan[:, 0].tolist())


def test_url_rules(spark, sf_dir, duck, no_documents):
    same_rows(url_filter.op6_url_filter(spark, sf_dir).toPandas(), duck.sql(url_filter.ORACLE).df())
    rows = [(1, None), (2, ""), (3, "no-scheme.com/en/1"), (4, "HTTP://A.Example.COM/en/77?x#y"), (5, "http://example.com/en/8"), (6, "x://com"), (7, "http://notcom/en/1"), (8, "http://a.com?/en/"), (9, "http://É.net/de/8\n"), (None, "http://b.net/de/")]
    pages = spark.createDataFrame([(*r, "html", "v") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow")
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("a.example.com", "/en/77", "example.com/en/7", "allow")
    assert got[5].rule == "com/en/" and got[6].rule is None and got[7].rule is None and got[8].path == "" and got[None].rule == "net/de/"
    assert got[9].host == "É.net" and got[9].path == "/de/8\n"
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    same_rows(url_filter.judge_urls(pages, rules, local_rules=1).toPandas(), url_filter.judge_urls(pages, rules).toPandas())
    assert url_filter.judge_urls(pages, []).where("rule IS NULL").count() == 10 and url_filter.judge_urls(pages.where("false"), rules).count() == 0


def test_urls_of_any_length():
    """A host of very many labels, or a very long path, makes no more keys than the rules' own lengths allow."""
    import time

    began = time.process_time()
    keys = url_filter.candidates("a." * 300_000 + "example.com", "/en/7" + "x" * 1_000_000, [4, 5], 2)
    assert keys == ["example.com/en/7", "example.com/en/", "com/en/7", "com/en/"] and time.process_time() - began < 2


def test_url_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b) % 3)
    files = url_filter.write_rules(tmp_path / "r", [("a.b/c", "block"), ("d.e/f", "allow"), ("g.h/i", "block")])
    assert len(files) == 6
    found = url_filter.DigestArray(str(tmp_path / "r"))
    at = found.probe([b"d.e/f", b"x.y/z", b"g.h/i"])
    assert at[1] == -1 and found.verdicts[at[0]] == 0 and found.verdicts[at[2]] == 1


def test_mixing(spark, sf_dir, duck, odd_documents, no_documents):
    same_rows(mixing.op8_poisson_mixing(spark, sf_dir).toPandas(), duck.sql(mixing.ORACLE).df())
    out = mixing.poisson_mix(odd_documents)
    assert set(out.columns) == set(odd_documents.columns) and mixing.poisson_mix(no_documents).count() == 0
    rates = spark.createDataFrame([("s1", 900.0), (None, 0.0)], "source string, rate double")
    n = mixing.poisson_mix(odd_documents, rates).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in n} == {i for i in range(1, 17) if i % 3} - {15} and all(r["count"] % 900 < 150 or r["count"] % 900 > 750 for r in n)


def test_mixing_reaches_its_targets(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', 10) as text", "case when id % 10 < 7 then 'a' else 'b' end as source")
    n = {r.source: r["count"] for r in mixing.poisson_mix(docs, mixing.repetition_rates(docs, 0.0)).groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(10_000, rel=0.05) and n["b"] == pytest.approx(10_000, rel=0.05)


def test_personal_data_base_spans(documents, texts, odd_documents, no_documents):
    from formwright.llm.pii import base_spans, brute_force_base

    tricky = ["a@b.c@d.ef", "x@@y.com", "..a@b-c.d.", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "+1 (555) 123-4567 ext", "+12", "4111 1111 1111 1111-", "4111-1111-1111-1112", "9" * 5_000, "+1+1 23456789", "😀 a@b.co", "@a.b", "a@b", "a%b@c.d..e"]
    for t in [*tricky, *texts.values()]:
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t))
        assert hashlib.sha256(shown.encode()).hexdigest() == brute_force_base(t), t[:80]
    rows = pii.personal_data(documents).collect()
    for r in rows:
        base = [(s.kind, s.start, s.end) for s in r.spans if s.base]
        assert base == base_spans(texts[r.doc_id])
    assert pii.personal_data(odd_documents).count() == odd_documents.count() and pii.personal_data(no_documents).count() == 0


def test_weak_supervision_finds_reliabilities():
    rng = np.random.default_rng(8)
    truth = rng.random(20_000) < 0.4
    right = (0.95, 0.9, 0.8, 0.6, 0.7)
    votes = np.stack([np.where(rng.random(len(truth)) < 0.2, 0, np.where((rng.random(len(truth)) < p) == truth, 1, -1)) for p in right], axis=1)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, rel = pii.estimate(patterns, counts.astype(float))
    assert ((post[back.ravel()] > 0.5) == truth).mean() > 0.94
    assert rel[0, 1, 2] / rel[0, 1, [0, 2]].sum() == pytest.approx(0.95, abs=0.02)


def plain_spans(rows, least=0.5):
    """All spans kept, by a second version: candidates one by one, EM on single votes, classifier scores by dictionaries."""
    found = []
    for i, text in rows:
        base = pii.base_spans(text)
        taken, loose = [(a, b) for _, a, b in base], []
        for kind, pattern in pii._LOOSE:
            for m in pattern.finditer(text):
                if not any(a < m.end() and m.start() < b for a, b in taken):
                    loose.append((kind, m.start(), m.end()))
                    taken.append((m.start(), m.end()))
        found += [(i, s, True, pii.votes(s[0], text, s[1], s[2], True), pii.features(s[0], text, s[1], s[2])) for s in base]
        found += [(i, s, False, pii.votes(s[0], text, s[1], s[2], False), pii.features(s[0], text, s[1], s[2])) for s in loose]
    target = np.zeros(len(found))
    for kind in pii.KINDS:
        mine = [k for k, f in enumerate(found) if f[1][0] == kind]
        if mine:
            target[mine] = pii.estimate(np.array([found[k][3] for k in mine]), np.ones(len(mine)))[0]
    w = pii.logistic([f[4] for f in found], target)
    return {(i, *s) for i, s, is_base, _, cells in found if is_base or 1 / (1 + np.exp(-sum(w[c] for c in cells))) >= least}


def test_added_spans_against_brute_force(spark):
    """Right candidates are added, wrong ones are not, and all is as a plain version says."""
    rows, right, wrong = [], [], []

    def put(text, value, kind, good):
        at = text.index(value)
        (right if good else wrong).append((len(rows), kind, at, at + len(value)))

    for i in range(120):
        phone, mail, card, bad = f"(0{i % 9}1) 555 {1000 + 7 * i}", f"amy{i} [at] site{i % 7} [dot] org", f"4111 1111. 1111 {1000 + i}", f"from at and. Of{'abcdefgh'[i % 8]}"
        text = f"please call {phone} today, mail bob{i}@site.com or write to {mail} now. And went {bad} the lamp; order {card} was late. 4111 1111 1111 1111"
        put(text, phone, "phone", True)
        put(text, mail, "email", True)
        put(text, bad, "email", False)
        put(text, card, "card", False)
        rows.append((i, text))
    got = {(r.doc_id, s.kind, s.start, s.end) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans}
    assert got == plain_spans(rows)
    assert sum(s in got for s in right) >= 0.95 * len(right) and sum(s in got for s in wrong) <= 0.05 * len(wrong)


def test_gazetteers():
    known = {"+44 20 7946 0958": 1, "+49 1": -1, "+1 212 555 1234": 1, "+1 212 555 123": -1, "+999 12345678": -1, "(020) 7946 0958": 1, "212-555-1234": 1, "112-555-1234": 0}
    for value, want in known.items():
        assert pii._known_phone(value, pii._digits(value)) == want, value
    for value, want in {"4111111111111111": 1, "378282246310005": 1, "2223003122003222": 1, "30569309025904": 1, "411111111111111": -1, "9111111111111111": -1, "2721000000000004": -1}.items():
        assert pii._known_card(value) == want, value
    for value, want in {"8.8.8.8": 1, "127.0.0.1": -1, "198.19.1.1": -1, "203.0.113.9": -1, "239.1.1.1": -1, "192.168.1.1": 0, "172.32.0.1": 1, "172.31.0.1": 0, "1.2.3.256": -1, "0099.1.1.1": 1, "2a02:26f7:1:2:3:4:5:6": 1, "2001:db8:1:2:3:4:5:6": -1, "fe80:0:0:0:1:2:3:4": -1}.items():
        assert pii._known_address(value) == want, value
    assert pii._named("amy.lee@site.org", "From Amy: ") and not pii._named("amy@site.org", "From amy and Bob ")


def test_written_out_forms_of_each_kind(spark):
    """Precision and recall of added spans on planted forms: IPv6 addresses and dotted cards, national phones, spelled mailboxes; and what only looks like them."""
    rows, right, wrong = [], {k: set() for k in pii.KINDS}, {k: set() for k in pii.KINDS}

    def luhned(body):
        return next(f"{body}{d}" for d in range(10) if pii.luhn(f"{body}{d}"))

    for i in range(150):
        card = luhned(f"4{5_000_000_000 + 7_919 * i:014d}")
        bad = card[:-1] + str((int(card[-1]) + 1) % 10)
        dotted = lambda c: ".".join(c[k : k + 4] for k in range(0, 16, 4))
        parts = [
            ("ip", f"2a02:{i + 16:x}:1f:{i:x}:0:a{i % 10}:b:c{i % 7}", True, "server at {} is up. "), ("ip", f"{i % 90 + 10}:{i % 60:02d}:{i % 50 + 10}:{i % 40 + 10}:11", False, "lap time {} was slow. "),
            ("card", dotted(card), True, "paid by card {} today. "), ("card", dotted(bad), False, "serial no {} is void. "),
            ("phone", f"(0{i % 9}1) 555 {1000 + 7 * i}", True, "call {} now. "), ("email", f"amy{i} [at] site{i % 7} [dot] org", True, "write to {} please. "), ("email", f"look at and. Then{'abcdefgh'[i % 8]}", False, "we {} went. "),
        ]
        text = ""
        for kind, value, good, frame in parts:
            at = len(text) + frame.index("{}")
            text += frame.format(value)
            (right if good else wrong)[kind].add((i, at, at + len(value)))
        rows.append((i, text + "Mail bob@site.com, 8.8.4.4, +44 20 7946 0958, 4111 1111 1111 1111."))
    got = [(s.kind, (r.doc_id, s.start, s.end)) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans if not s.base]
    for kind in pii.KINDS:
        added = {p for k, p in got if k == kind}
        assert len(added & right[kind]) >= 0.95 * len(right[kind]), kind
        assert len(added & right[kind]) >= 0.95 * len(added), (kind, len(added))


def test_personal_data_in_very_long_texts():
    import time

    long_ = "call 01 555 1234 now 5.6.7.8 and " * 30_000
    began = time.process_time()
    base = pii.base_spans(long_)
    assert len(pii.loose_spans(long_, base)) == 30_000 and len(base) == 30_000 and time.process_time() - began < 20


def test_hint_leaves_out_no_span(texts):
    import pyarrow as pa

    bare = ["write to amy at site.org", "write to amy at site dot org", "amy(at)site.org", "host fe:ab:cd:ef:aa:bb:cc:dd is up", "amy [at] site [dot] org", "she sat at home", "at a: b: c", *texts.values()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(bare)), pa.int64()), pa.array(bare)], names=["doc_id", "text"])
    (found,) = pii._find(iter([batch]))
    for text, spans in zip(bare, found.column(1).to_pylist(), strict=True):
        base = pii.base_spans(text)
        assert [(s["kind"], s["start"], s["end"]) for s in spans] == base + pii.loose_spans(text, base), text[:80]
    assert all(found.column(1).to_pylist()[:5])


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with extra columns named as helpers inside the operators are or were."""
    names = "_id _of _sha sha of_id of_text doc id n parts cdf of_source part__ parts__ _mix_source a b comp node head same bands n0 token".split()
    rows = [(i, f"lamp river stone {i % 3} market quiet", f"s{i % 2}", *[i] * len(names)) for i in range(12)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'{n} long' for n in names)}")


def test_clashing_columns(clashing, spark):
    from formwright.llm import exact_dedup, near_dedup, sentence_spans, substrings, toxicity

    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    kept = exact_dedup.drop_copies(clashing, keep_largest=False)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2] and all(r._sha == r.doc_id for r in kept.collect())
    mixed = mixing.poisson_mix(clashing)
    assert mixed.columns == [*clashing.columns, "copy", "shuffle_key"] and all(r._mix_source == r.doc_id == r.cdf for r in mixed.collect())
    assert toxicity.drop_toxic(clashing, labels).columns == near_dedup.one_of_each(clashing).columns == clashing.columns
    for out in (sentence_spans.sentence_dedup(clashing), substrings.remove_repeats(clashing), packing.pack(clashing), pii.personal_data(clashing), fingerprint.edited_neighbours(clashing)):
        assert out.count() == 12


def test_mixing_with_many_sources(spark, monkeypatch):
    docs = spark.range(600).selectExpr("id as doc_id", "repeat('x', 5) as text", "if(id % 3 = 0, null, concat('s', id % 7)) as source")
    want = sorted(map(tuple, mixing.poisson_mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(tuple, mixing.poisson_mix(docs).collect()), key=str) == want


def plain_mix(rows):
    """Copies by the definition: the rates, one uniform number a document, and the Poisson distribution summed up."""
    from collections import Counter
    from math import exp

    mass = Counter()
    for r in rows:
        mass[r.source] += len(r.text or "")
    powers, total = sum(m**mixing.TEMPERATURE for m in mass.values() if m), sum(mass.values())
    out = Counter()
    for r in rows:
        rate = mass[r.source] ** mixing.TEMPERATURE / powers * total / mass[r.source]
        u = (int(hashlib.md5(f"{mixing.SEED}:{r.doc_id}:0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = c = exp(-rate)
        k = 0
        while c < u:
            k += 1
            p *= rate / k
            c += p
        out[r.doc_id] += k
    return out


def test_pipeline(spark, sf_dir, texts):
    from collections import Counter

    import corpus_pipeline as cp
    from test_dedup import classes
    from tokenizers import Tokenizer

    from formwright.llm import toxicity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = docs
    seen = []
    for name, stage in cp.STAGES[:3]:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
        seen.append((name, before, {r.doc_id: r.text for r in kept.collect()}))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    assert set(seen[0][2]) == set(texts) - bad
    assert set(seen[1][2]) == {min(i for i, u in seen[1][1].items() if u == t) for t in seen[1][1].values()}
    assert set(seen[2][2]) == set(classes(seen[2][1]).values())
    mixed = cp.STAGES[3][1](spark, kept, sf_dir)
    copies = plain_mix(kept.collect())
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == +copies
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in seen[2][2].items()}
    places, total = {}, Counter()
    for r in cp.run(spark, sf_dir).collect():
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total[r.doc_id] += r.length
    assert total == Counter({i: n * size[i] for i, n in copies.items() if n})
    for spans in places.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans[:-1])]).tolist() and sum(n for _, n in spans) <= packing.CAPACITY


def test_pipeline_odd(spark, odd_documents, clashing, tmp_path):
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(i, 0, int(i in (4, 6))) for i in range(12)], "doc_id long, quality int, toxic int")
    for k, docs in enumerate((odd_documents, clashing, clashing.where("false"), odd_documents.where("doc_id = 9"))):
        folder = str(tmp_path / str(k))
        labels.write.parquet(f"{folder}/labels.parquet")
        docs.write.parquet(f"{folder}/documents.parquet")
        out = cp.run(spark, folder)
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() >= 0
        assert (k != 2) or out.count() == 0
