"""URL rules in a sorted digest array.

A rule is a host and a path; it fits its host and all subdomains where the url's path starts with the rule's. The 64-bit
xxhash digests of all rules are one ascending array in a file that every executor gets once and maps into memory. A
url is looked up by the digests of its host's suffixes with prefixes of its path of the lengths that rules have; hits of
the binary search are confirmed against the stored strings, so that a collision changes nothing.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rules up to this number are one mapped file (some 100 bytes each, made on the driver); beyond it they are joined.
LOCAL_RULES = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the registered query: rule (host and path), verdict.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: empty where there is no `://`."""
    whole = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(whole, "://") > 0, F.substring(whole, F.instr(whole, "://") + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def write_rules(stem: Path, rules: list[tuple[str, str]]) -> list[Path]:
    """Files that start with stem: the sorted digests, and in the same order the rules' strings, their offsets and verdicts (1: block)."""
    known = sorted({r: v for r, v in sorted(rules, key=lambda x: x[1] == "block")}.items(), key=lambda x: xxhash.xxh64_intdigest(x[0].encode()))
    raw = [r.encode() for r, _ in known]
    arrays = {
        "digests": np.array([xxhash.xxh64_intdigest(r) for r in raw], dtype=np.uint64),
        "offsets": np.cumsum([0, *map(len, raw)]).astype(np.int64),
        "verdicts": np.array([v == "block" for _, v in known], dtype=np.uint8),
        "strings": np.frombuffer(b"".join(raw) or b"\0", dtype=np.uint8),
        "lengths": np.array(sorted({len(r.partition("/")[2]) + 1 for r, _ in known if "/" in r}), dtype=np.int64),
        "labels": np.array([max((r.partition("/")[0].count(".") + 1 for r, _ in known), default=0)], dtype=np.int64),
    }
    for name, values in arrays.items():
        np.save(f"{stem}-{name}.npy", values)
    return [Path(f"{stem}-{name}.npy") for name in arrays]


def candidates(host: str, path: str, lengths: list[int], most_labels: int) -> list[str]:
    """Keys of all rules that could fit, the longest first. No rule's host has more than most_labels labels, so longer suffixes are not made."""
    labels = host.rsplit(".", most_labels)
    tail = labels[-most_labels:]
    suffixes = [".".join(tail[k:]) for k in range(len(tail))]
    found = [s + path[:n] for s in suffixes for n in lengths if n <= len(path)]
    return sorted(found, key=len, reverse=True)


class DigestArray:
    def __init__(self, stem: str):
        load = lambda name: np.load(f"{stem}-{name}.npy", mmap_mode="r")
        self.digests, self.offsets, self.verdicts, self.strings = map(load, ("digests", "offsets", "verdicts", "strings"))
        self.lengths, self.most_labels = load("lengths").tolist(), int(load("labels")[0])

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key in the array, or -1."""
        h = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))
        lo, hi = np.searchsorted(self.digests, h, "left"), np.searchsorted(self.digests, h, "right")
        out = np.full(len(keys), -1, dtype=np.int64)
        for i in np.flatnonzero(hi > lo):
            for k in range(lo[i], hi[i]):
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == keys[i]:
                    out[i] = k
        return out


def _judge(batches: Iterator[pa.RecordBatch], stem: str, default: str) -> Iterator[pa.RecordBatch]:
    rules = DigestArray(SparkFiles.get(stem))
    for batch in batches:
        keys, owner = [], []
        for i, (host, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            mine = candidates(host, path, rules.lengths, rules.most_labels)
            keys += mine
            owner += [i] * len(mine)
        found = rules.probe([k.encode() for k in keys])
        rule, verdict = [None] * batch.num_rows, [default] * batch.num_rows
        for j in np.flatnonzero(found >= 0):
            if rule[owner[j]] is None:
                rule[owner[j]], verdict[owner[j]] = keys[j], "block" if rules.verdicts[found[j]] else "allow"
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str]], default: str = "allow", local_rules: int = LOCAL_RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule (the longest that fits, or null), verdict (block or allow).

    rules: (rule, verdict); of a rule given twice, block counts. Rules of one length that both fit: the longer host wins. A url that no rule fits
    gets `default`. A null url, or one without `://`, has empty host and path. Repeated rows and null ids stay as they come; other
    columns are not read. No rules, or no pages, are no special case.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not isinstance(rules, list) and rules.count() > local_rules:
        return _joined(parts, rules, default)
    if not isinstance(rules, list):
        rules = [tuple(r) for r in rules.select("rule", "verdict").collect()]
    stem = f"rules-{uuid.uuid4().hex}"
    for file in write_rules(Path(tempfile.mkdtemp()) / stem, rules):
        spark.sparkContext.addFile(str(file))  # made on the driver; Spark carries it to every executor, none reads the driver's folder
    return parts.mapInArrow(lambda it: _judge(it, stem, default), "page_id long, host string, path string, rule string, verdict string")


def _joined(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same answer for rule sets of any size: each distinct host and path meets its candidate rules in a join on digest and string."""
    known = rules.groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("blocks")).withColumn("digest", F.xxhash64("rule"))
    urls = parts.select("host", "path").distinct()
    of_host, of_path = F.substring_index("rule", "/", 1), F.length("rule") - F.length(F.substring_index("rule", "/", 1))
    most, longest = known.agg(F.coalesce(F.max(F.size(F.split(of_host, r"\."))), F.lit(1)), F.coalesce(F.max(of_path), F.lit(1))).first()
    labels = F.size(F.split("host", r"\."))
    suffix = F.transform(F.sequence(F.lit(1), F.least(labels, F.lit(most))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))  # no rule has more labels, or a longer path
    prefix = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length("path"), F.lit(longest)), F.lit(1))), lambda n: F.substring("path", 1, n))
    keys = urls.withColumn("s", F.explode(suffix)).withColumn("p", F.explode(prefix)).where("p <> ''")
    keys = keys.select("host", "path", F.concat("s", "p").alias("rule"), F.length("s").alias("n")).withColumn("digest", F.xxhash64("rule"))
    best = keys.join(known, ["digest", "rule"]).groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("size"), "n", "rule", "blocks")).alias("best"))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.blocks"), "block").otherwise("allow")
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


_VALUES = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in RULES)
ORACLE = rf"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '(?s)^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(r, length(regexp_extract(r, '(?s)^[^/?#]*')) + 1), '(?s)^[^?#]*') AS path FROM rest),
rules(h, p, rule, verdict) AS (VALUES {_VALUES}),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN fits USING (page_id)
"""
