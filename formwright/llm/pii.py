"""Personal data spans by weak supervision.

Fixed patterns give the base spans. Looser patterns give further candidates (phones without a plus, written-out
e-mail addresses, cards and addresses that a fixed pattern cut or split). On every candidate, labelers vote yes, no or
nothing: the fixed pattern, a check of the value, a gazetteer
(numbering plans, issuers' ranges, address blocks, top-level domains), the words and names before it, and its form. Votes are counted
by kind and pattern over all documents; for each kind, expectation-maximisation on the counts estimates how reliable each labeler is, without
labels. Its posteriors train a logistic span classifier that reads the span itself and the words around it, not the votes,
and decides on the candidates. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, smaller_batches, table, text_chunks

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits does, as all starts within one run succeed or fail alike after it.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]{1,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[.\x20-]{1,2}[0-9]{4}){2}[.\x20-]{1,2}[0-9]{1,7}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
)
#: Every pattern's match holds one of these: texts without any are not looked at further.
_HINT = re.compile(r"[0-9@]|:[0-9A-Fa-f]{1,4}:|(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]")
# Generic and country top-level domains.
_TLDS = frozenset(
    "com org net edu gov mil int info biz name pro mobi app dev online site shop store blog cloud xyz tech email me tv io ai co cc "
    "ad ae af ag al am ao ar at au az ba bb bd be bg bh bo br by bz ca ch ci cl cm cn cr cu cy cz de dk do dz ec ee eg es et eu fi fj fr gb ge gh gr gt hk hn hr hu id ie il in iq ir is it jm jo jp ke kg kh kr kw kz la lb lk lt lu lv "
    "ma md mk ml mm mn mo mt mu mv mx my na ng ni nl no np nz om pa pe ph pk pl pr ps pt py qa ro rs ru rw sa se sg si sk sn sv sy th tn tr tw tz ua ug uk us uy uz ve vn za zm zw".split()
)
# Dialling codes with the least and most digits of a national number behind them.
_DIAL = {
    "1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "43": (6, 13),
    "44": (9, 10), "45": (8, 8), "46": (7, 10), "47": (8, 8), "48": (9, 9), "49": (6, 11), "51": (8, 9), "52": (10, 10), "54": (10, 11), "55": (10, 11), "56": (9, 9), "57": (8, 10), "58": (10, 10), "60": (8, 10),
    "61": (9, 9), "62": (8, 12), "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "98": (10, 10),
    "212": (9, 9), "216": (8, 8), "234": (8, 10), "254": (9, 9), "351": (9, 9), "352": (6, 9), "353": (7, 9), "354": (7, 9), "358": (6, 10), "359": (8, 9), "370": (8, 8), "371": (8, 8), "372": (7, 8), "380": (9, 9), "381": (8, 9),
    "385": (8, 9), "386": (8, 8), "420": (9, 9), "421": (9, 9), "852": (8, 8), "880": (8, 10), "886": (8, 9), "961": (7, 8), "962": (8, 9), "966": (8, 9), "971": (8, 9), "972": (8, 9),
}
# Ranges of first digits of card issuers, and the lengths of their numbers.
_ISSUERS = (
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("300", "305", (14, 16, 17, 18, 19)), ("36", "36", (14, 15, 16, 17, 18, 19)), ("38", "39", (14, 16, 17, 18, 19)),
    ("3528", "3589", (16, 17, 18, 19)), ("6011", "6011", (16, 17, 18, 19)), ("62", "62", (16, 17, 18, 19)), ("644", "649", (16, 17, 18, 19)), ("65", "65", (16, 17, 18, 19)), ("50", "50", (13, 14, 15, 16, 17, 18, 19)), ("56", "59", (13, 14, 15, 16, 17, 18, 19)),
)
# Address blocks that no host on the public net has: this net, loopback, link-local, documentation, benchmarks, multicast and reserved.
_RESERVED = ("0.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "192.0.2.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3")
_PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
_FOR = {
    "email": re.compile(r"mail|contact|write|reach|schreib|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|client|adresse", re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel\b|tel[.:]|call|mobile|fax|whatsapp|anruf|appel|llam", re.I),
}
_AGAINST = re.compile(r"version|isbn|token|secret|serial|order|invoice|chapter|section|page|build|release", re.I)
#: Characters before a candidate that the context labeler reads.
CONTEXT = 30
LABELERS = 5
#: Hashed features of the span classifier; most candidates that it is trained on, those with the smallest hash of place (all of them are decided on).
FEATURES, TRAIN_SPANS = 4_096, 100_000
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches from their @: the local part is the whole run before it, back to the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The contract's spans, by kind and then start; positions in code points."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _known_phone(value: str, digits: str) -> int:
    """By numbering plans: a dialling code with a national number of its length; without a plus, a trunk 0 or an area and exchange that may not begin with 0 or 1."""
    if value[0] == "+":
        return 1 if any(_DIAL[digits[:n]][0] <= len(digits) - n <= _DIAL[digits[:n]][1] for n in (1, 2, 3) if digits[:n] in _DIAL) else -1
    if digits[:1] == "0":
        return 1 if 9 <= len(digits) <= 12 else 0
    return 1 if len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789" else 0


def _known_card(digits: str) -> int:
    """By issuer: a number in a range of first digits that has one of that range's lengths."""
    return 1 if any(low <= digits[: len(low)] <= high and len(digits) in sizes for low, high, sizes in _ISSUERS) else -1


def _known_address(value: str) -> int:
    """By address blocks: no for reserved ones, nothing for private ones, yes for what a public host may have."""
    if ":" in value:
        first = value.split(":")[0].lower().rjust(4, "0")
        return 1 if first[0] in "23" and not value.lower().startswith("2001:db8") else -1
    parts = [int(p) for p in value.split(".")]
    if len(parts) != 4 or max(parts) > 255:
        return -1
    inside = lambda blocks: any(_number(parts) >> (32 - bits) == net >> (32 - bits) for net, bits in blocks)
    return -1 if inside(_NO_HOST) else 0 if inside(_HOME) else 1


def _number(parts: list[int]) -> int:
    return parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]


def _blocks(shown: tuple[str, ...]) -> list[tuple[int, int]]:
    return [(_number([int(p) for p in net.split(".")]), int(bits)) for net, bits in (x.split("/") for x in shown)]


_NO_HOST, _HOME = _blocks(_RESERVED), _blocks(_PRIVATE)


def _named(value: str, before: str) -> bool:
    """Whether a piece of the mailbox stands as a capitalised word before it, as a name does."""
    box = re.split(r"@|\(at\)|\[at\]| at ", value)[0]
    pieces = {p.lower() for p in re.findall("[A-Za-z]{3,}", box)}
    return any(w.lower() in pieces for w in re.findall(r"\b[A-Z][a-z]{2,}", before))


def votes(kind: str, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """Yes (1), no (-1) or nothing (0) of each labeler: fixed pattern, digit check, gazetteer, context, form."""
    value, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = _digits(value)
    if kind == "email":
        spelled = bool(re.search(r"[(\[](?:at|dot)[)\]]| at .* dot ", value))
        check = 1 if "@" in value or spelled else -1 if re.search(r"\. ", value) else 0
        gazetteer = 1 if re.split(r"[. \])]+", value.rstrip(" ])"))[-1].lower() in _TLDS else -1
        form = -1 if len(value) > 80 or re.search(r"\. ?[A-Z]", value) else 1 if "@" in value or spelled or re.match(r"[A-Za-z]*[0-9._+]", value) else 0
    elif kind == "ip":
        parts = value.split(".")
        check = (1 if all(int(p) <= 255 for p in parts) else -1) if len(parts) == 4 and all(p.isdigit() for p in parts) else 1 if value.count(":") == 7 else 0
        gazetteer = _known_address(value)
        form = -1 if any(len(p) > 1 and p[0] == "0" for p in parts) or value.count(":") not in (0, 7) else 1
    elif kind == "card":
        check = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        gazetteer = _known_card(digits)
        form = 1 if len({c for c in value if not c.isdigit()}) <= 1 else -1
    else:
        check = 1 if 9 <= len(digits) <= 15 else -1 if not 7 <= len(digits) <= 15 else 0
        gazetteer = _known_phone(value, digits)
        form = 1 if value.count("(") == value.count(")") and ".." not in value else -1
    context = 1 if _FOR[kind].search(before) or (kind == "email" and _named(value, before)) else -1 if _AGAINST.search(before) else 0
    return (1 if base else 0, check, gazetteer, context, form)


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates beside the base spans: what the looser patterns find and no base span or earlier candidate overlaps. Linear in spans but for the sort."""
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out = []
    for kind, pattern in _LOOSE:
        k, new = 0, []
        for m in pattern.finditer(text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or m.end() <= taken[k][0]:
                new.append((m.start(), m.end()))
        out += [(kind, a, b) for a, b in new]
        taken = sorted(taken + new)
    return out


_WORD = re.compile(r"\w+")


def features(kind: str, text: str, start: int, end: int) -> list[int]:
    """Hashed features of a span: its shape, parts and length, and the words around it; each for its kind."""
    value = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", value))))
    before, after = _WORD.findall(text[max(0, start - CONTEXT) : start].lower()), _WORD.findall(text[end : end + CONTEXT].lower())
    digits = _digits(value)
    names = [
        "bias", f"shape {shape[:40]}", f"length {min(len(value) // 4, 20)}", f"digits {len(digits)}", f"first {digits[:1]}", f"last {re.split(r'[^A-Za-z0-9]+', value.rstrip(' ])'))[-1].lower()}",
        f"luhn {len(digits) >= 13 and luhn(digits)}", *(f"has {c}" for c in sorted(set(re.sub(r"[A-Za-z0-9]", "", value)))), *(f"before {w}" for w in before[-3:]), *(f"after {w}" for w in after[:2]),
    ]
    return sorted({zlib.crc32(f"{kind} {n}".encode()) % FEATURES for n in names})


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])
_FOUND = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean, votes: string, features: array<int>>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches):
        rows = []
        for text in batch.column(1).to_pylist():
            spans = []
            if _HINT.search(text):
                base = base_spans(text)
                for is_base, found in ((True, base), (False, loose_spans(text, base))):
                    spans += [{"kind": k, "start": a, "end": b, "base": is_base, "votes": ",".join(map(str, votes(k, text, a, b, is_base))), "features": features(k, text, a, b)} for k, a, b in found]
            rows.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM for two hidden classes and independent labelers on counted vote patterns (-1, 0, 1).

    Returns the posterior of `personal` for each pattern, and reliabilities[labeler, class, vote + 1]. The start is the majority vote, and the prior counts
    hold every labeler to be right more often than not, so the classes cannot swap.
    """
    n, k = patterns.shape
    post = 1.0 / (1.0 + np.exp(-patterns.sum(axis=1)))
    prior = np.array([[3.0, 1.0, 1.0], [1.0, 1.0, 3.0]])
    rel = np.zeros((k, 2, 3))
    for _ in range(rounds):
        for c, w in enumerate((counts * (1 - post), counts * post)):
            for j in range(k):
                tally = prior[c] + np.bincount(patterns[:, j] + 1, w, minlength=3)
                rel[j, c] = tally / tally.sum()
        share = (counts * post).sum() + 1.0, (counts * (1 - post)).sum() + 1.0
        odds = np.full(n, np.log(share[0] / share[1]))
        for j in range(k):
            odds += np.log(rel[j, 1, patterns[:, j] + 1] / rel[j, 0, patterns[:, j] + 1])
        new = 1.0 / (1.0 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, rel


def logistic(cells: list[list[int]], target: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on sparse 0/1 features with soft targets, by gradient steps scaled for each feature (Adagrad)."""
    owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    column = np.concatenate([np.asarray(c, dtype=np.int64) for c in cells])
    w, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(np.bincount(owner, w[column], minlength=len(cells)), -30, 30)))
        grad = np.bincount(column, (p - target)[owner], minlength=FEATURES) / len(cells) + ridge * w
        seen += grad * grad
        w -= 0.5 * grad / np.sqrt(seen)
    return w


def train(found: DataFrame, train_spans: int = TRAIN_SPANS) -> np.ndarray | None:
    """The span classifier's weights, or None without any candidate. EM takes the counts of all candidates (at most 4 * 3**5 cells); the classifier at most train_spans of them."""
    every = found.select("doc_id", F.inline("spans"))
    cells = every.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
    posterior = {}
    for kind in KINDS:
        own = [c for c in cells if c.kind == kind]
        if own:
            post, _ = estimate(np.array([[int(v) for v in c.votes.split(",")] for c in own]), np.array([c.n for c in own], dtype=float))
            posterior |= {(kind, c.votes): p for c, p in zip(own, post, strict=True)}
    if not posterior:
        return None
    some = every.select("kind", "votes", "features", F.xxhash64("doc_id", "start", "kind").alias("h"), "doc_id", "start").orderBy("h", "doc_id", "start", "kind").limit(train_spans).select("kind", "votes", "features").collect()
    return logistic([r.features for r in some], np.array([posterior[r.kind, r.votes] for r in some]))


def _decide(batches: Iterator[pa.RecordBatch], weights: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate(KINDS)}
    kind = pa.list_(pa.struct([*[(n, _SPAN.field(n).type) for n in ("kind", "start", "end", "base", "votes")], ("probability", pa.float64())]))
    for batch in batches:
        rows = []
        for spans in batch.column(1).to_pylist():
            told = [{n: s[n] for n in ("kind", "start", "end", "base", "votes")} | {"probability": float(1 / (1 + np.exp(-np.clip(weights[s["features"]].sum(), -30, 30))))} for s in spans]
            rows.append(sorted((s for s in told if s["base"] or s["probability"] >= least), key=lambda s: (order[s["kind"]], s["start"], s["end"])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])


def personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end, base, votes, probability) by kind and start.

    Base spans all stay; a candidate stays where the classifier gives it `least` or more. A null text counts as empty and has no span; repeated rows and null ids stay as
    they come. Without any candidate in the table nothing is trained. Only doc_id and text are read.
    """
    smaller_batches(docs.sparkSession)
    found = saved(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_find, _FOUND), "spans")
    weights = train(found)
    weights = np.zeros(FEATURES) if weights is None else weights
    return found.mapInArrow(lambda it: _decide(it, weights, least), "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean, votes: string, probability: double>>")


def op10_personal_data(spark, sf_dir):
    out = personal_data(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.base)
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(k) for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def brute_force_base(text: str) -> str:
    """The base spans by the contract's patterns as they stand, for tests: the hex digest of the joined spans."""
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))]
    out += [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(_digits(m[0])) <= 15]
    return hashlib.sha256(",".join(out).encode()).hexdigest()
