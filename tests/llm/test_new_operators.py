"""Conversation repair, cutting-stock packing and spelling variants against plain versions of their contracts."""

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from row_checks import same_rows

from formwright.llm import conversation_repair, cutting, packing, spelling

LEGAL = {"su", "ua", "au"}


def plain_repair(rows: list[tuple]) -> list[tuple]:
    """The contract in plain Python over (conv_id, turn, role, text): every sequence of edits by shortest paths over (row, initials' state)."""
    show = lambda v: " " if v is None else str(v)
    convs: dict = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        draw = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        convs[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    out = []
    for conv, items in convs.items():
        items.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        known, faults = set(), []
        for _, role, text in items:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not body else "d" if (role, text) in known else "-" if body[-1] in ".!?" else "t")
            known.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(items, items[1:], strict=False)]
        turns = {t for t, _, _ in items if t is not None}
        # States of the initials so far: "" nothing, "s", "u" odd, "a" even.
        heap, best = [(0, "", 0, "", ())], {}
        while heap:
            cost, audit, k, state, lines = heapq.heappop(heap)
            if (k, state) in best:
                continue
            best[k, state] = (cost, audit, lines)
            for role in ("user", "assistant"):
                if role[0] == ("a" if state == "u" else "u"):
                    heapq.heappush(heap, (cost + 2, audit + "I", k, role[0], (*lines, f"{role}:")))
            if k < len(items):
                _, own, text = items[k]
                heapq.heappush(heap, (cost + 3, audit + "D", k + 1, state, lines))
                if faults[k] not in "bd":
                    late = faults[k] == "t"
                    for role, letter, price in ((own, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                        i = role[:1]
                        if (i == "s" and state == "" and letter == "K") or (i == "a" and state == "u") or (i == "u" and state != "u"):
                            heapq.heappush(heap, (cost + price + late, audit + letter, k + 1, i, (*lines, f"{role}:{text}")))
        cost, audit, lines = min(best[len(items), s] for s in ("", "a") if (len(items), s) in best)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), sum(p not in LEGAL for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


CONVERSATION = ["conv_id", "turn", "role", "text"]


@pytest.fixture(scope="session")
def conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@pytest.fixture(scope="session")
def odd_conversations(spark):
    """Null and empty fields, repeated rows and turns, roles beside the grammar, a long conversation and clashing column names."""
    rows = [(1, None, None, None), (1, 2, "user", "Hi."), (1, 2, "user", "Hi."), (1, 2, "assistant", "Hm"), (1, 9, "tool", "x" * 100_000), (2, 0, "", "Empty role."), (2, 1, "system", ""), (None, 0, "user", "No id."), (None, None, "assistant", "Yes?"), (3, 4, "user", " \t"), (-7, -3, "umpire", "é…"), (-7, 5, "assistant", "漢字 😀!")]
    rows += [(8, t, ("user", "assistant", "system", "user")[t * 7 % 4], f"line {t % 61}" + "." * (t % 3)) for t in range(400)] + [(8, 17, "user", "again.")] * 30
    rows += [(k, 0, "user", "x.") for k in range(100, 160)]
    data = [(*r, 1, "x", True, "z") for r in rows]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, copies int, audit string, first boolean, done string")


def repaired(df, longest):
    return sorted((tuple(r) for r in conversation_repair.repair_conversations(df, longest).collect()), key=repr)


@pytest.mark.parametrize("longest", [2, 2_000])
def test_repair(conversations, odd_conversations, longest):
    for df in (conversations, odd_conversations):
        assert repaired(df, longest) == sorted(plain_repair([tuple(r) for r in df.select(*CONVERSATION).collect()]), key=repr)
    assert repaired(conversations.where("false"), longest) == []


def test_conversation_cut_over_tasks(spark):
    """One conversation over all partitions, with turns that repeat far apart, beside others."""
    rows = [(k % 3 or 5, k, ("user", "assistant")[k % 5 % 2], f"text {k % 97}.") for k in range(3_000)] + [(5, 70_000, "user", "text 1.")] * 500
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16)
    assert repaired(df, 50) == sorted(plain_repair(rows), key=repr)


def test_stretches_join_to_the_whole():
    """By what may follow: tops 2 and 5 wait for the same, and so do 4 and 7."""
    least = lambda t: [min((t[k] for k in same if k in t), default=None) for same in ((0,), (1,), (2, 5), (4, 7))]
    rng = np.random.default_rng(5)
    for _ in range(60):
        codes = "".join("sua "[rng.integers(4)] + "DT--"[rng.integers(4)] for _ in range(9))
        cut = 2 * int(rng.integers(0, 10))
        left = conversation_repair.parse(codes[:cut])
        assert least(conversation_repair.joined(left, {b: conversation_repair.parse(codes[cut:], b) for b in left})) == least(conversation_repair.parse(codes))


def test_cutting_round_trip(documents, texts, odd_documents, no_documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = odd_documents.where("doc_id <> 14 AND doc_id IS NOT NULL")
    for df, known in ((documents, texts), (odd, {r.doc_id: r.text or "" for r in odd.collect()})):
        rows = cutting.pack_cutting(df).collect()
        by, places = defaultdict(list), defaultdict(list)
        for r in rows:
            by[r.doc_id].append(r)
            places[r.sequence_id].append((r.offset, r.length))
        assert set(by) == set(known)
        for i, pieces in by.items():
            ids = np.array([*tokenizer.encode(known[i], add_special_tokens=False).ids, 0], dtype="<u4")
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        for spans in places.values():
            end = 0
            for offset, length in sorted(spans):
                assert offset == end and length > 0
                end += length
            assert end <= 1024 and end & (end - 1) == 0  # no padding
    assert cutting.pack_cutting(no_documents).count() == 0
    assert sum(r.length for r in cutting.pack_cutting(odd_documents).collect()) == sum(len(packing._encoder("byte_bpe_50k")(r.text or "")) + 1 for r in odd_documents.collect())


def test_cutting_plan():
    rng = np.random.default_rng(3)
    for capacity, case in ((16, [0] * 17), (16, [0, *[3] * 16]), (64, rng.integers(0, 9, 65)), (64, np.where(np.arange(65) == 43, 10**9, 0)), (64, rng.integers(0, 10**6, 65))):
        counts = [0, *map(int, case[1:])]
        plan, first_cut, sequences = cutting.cutting_plan(counts, capacity)
        used = np.zeros(sequences if sequences < 10**5 else 0, dtype=int)
        by_length = Counter()
        for k, (length, first, fit, sequence, _) in enumerate(plan.tolist()):
            after = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else first_cut[length]
            assert first == by_length[length]
            by_length[length] += after - first
            if len(used):
                used[sequence : sequence + (after - first) // fit] += fit * length
        assert all(u & (u - 1) == 0 and u <= capacity for u in used.tolist()) and all(first_cut[s] <= n for s, n in enumerate(counts))
    # A program with an exact answer cuts nothing: every 10 goes with two 3, and the 5, 6, 5 together.
    assert (cutting.cutting_plan([50 if s in (3, 5) else 25 if s in (6, 10) else 0 for s in range(17)], 16)[1] == [50 if s in (3, 5) else 25 if s in (6, 10) else 0 for s in range(17)]).all()


def plain_spellings(rows):
    counts, low = Counter(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run if h % 97 else run[:k] + run[k + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near, holes = defaultdict(set), defaultdict(list)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].append(w)
            if (v := w[:k] + w[k + 1 :]) in words:
                near[w].add(v)
                near[v].add(w)
    for same in holes.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), words.get(form.get(w), -1)) for w, n in words.items())


def spelled(df, **how):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.group_spellings(df, **how).collect())


def test_spellings(documents, texts):
    assert spelled(documents) == plain_spellings(texts.items())


def test_spellings_odd(spark, odd_documents, no_documents):
    long_ = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(3_000))
    made = [(1, "colour colour colour color colours Colours colours couleur àéîõü àéîõü ÀÉÎÕÜ àéîõü àéîõü àéîõ÷ àéîõ÷ àéîõ÷ " * 5), (2, None), (3, ""), (None, "colour 3x colour"), (4, " ".join([long_, long_, long_, long_[:700] + long_[701:], long_[:-1], long_[:-1] + "é"] * 5)), (5, "aaaaaa aaaaa aaaaaaa aaaba " * 9), (5, "aaaaaa aaaaa aaaaaaa aaaba " * 9), (6, "a" * 20 + "-" + "a" * 21)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in made], "doc_id long, text string, word string, n int, run string")
    for how in ({}, {"round_blocks": 3}):
        assert spelled(df, **how) == plain_spellings(made)
    assert spelled(odd_documents) == plain_spellings([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert spelled(no_documents) == []


def test_spelling_filters_miss_nothing(monkeypatch, spark):
    """Probes in small pieces find what whole ones find; words of a hub all reach their root."""
    hub = "abcdefgh"
    variants = {hub[:k] + c + hub[k + 1 :] for k in range(8) for c in "xyzé"} | {hub[:k] + hub[k + 1 :] for k in range(8)}
    rows = [(9_000 + k, " ".join([w] * 3)) for k, w in enumerate(sorted(variants))] + [(k, " ".join([hub] * 40)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = spelled(df)
    assert whole == plain_spellings(rows) and Counter(r[2] for r in whole)[hub] > 35
    words = np.frombuffer(hub.encode() * 3, dtype=np.uint8).reshape(3, 8)
    probe = spelling.Probe(0, np.full((8, 8), 2**64 - 1, dtype=np.uint64), {8: (0, 4), 7: (4, 4)})
    found = lambda: sorted((int(r), w) for rows, made in spelling.edits(words, probe) for r, w in zip(rows, made, strict=True))
    once = found()
    assert len(once) == len(set(once)) == 3 * (8 + sum(int((spelling.LETTERS > x).sum()) for x in hub.encode()))
    monkeypatch.setattr(spelling, "PROBES", 200)
    assert found() == once


def test_new_operators_match_sql(spark, sf_dir, duck):
    same_rows(conversation_repair.op11_conversation_repair(spark, sf_dir).toPandas(), duck.sql(conversation_repair.ORACLE).df())
    same_rows(spelling.op13_spelling_variants(spark, sf_dir).toPandas(), duck.sql(spelling.ORACLE).df())
