"""Grouping of spelling variants: words one edit apart, and the more frequent form that each leads to.

A word's whole neighbourhood of edits is generated and probed against Bloom filters of the vocabulary; only what they let pass is shuffled to
an exact join with the vocabulary. Of each pair one side is enough, so a word generates its deletions and the replacements by a later character.
All words of one length are a matrix of Latin-1 bytes, and the hash of an edited word follows from the word's own by prefix sums, so
no edited word is written out unless it passes.

The filters are split blocked ones: for each length so many 512-bit blocks, one bit in each of a block's eight lanes for a word. They are built by an
aggregation, and go to the tasks by at most ROUND_BLOCKS blocks at a time (a proven size); a vocabulary of more blocks takes more rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, saved, skew_join, table

LEAST_LENGTH, LEAST_COUNT, FACTOR = 5, 3, 2
#: Characters of words: a-z and those of U+00C0 to U+00FF; A-Z are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], dtype=np.uint8)
#: One occurrence in so many is misspelt by the contract.
EDITED = 97
#: Bits of filter for a word, and blocks (of 64 bytes) that one round sends to every task: 64 MB.
BITS, ROUND_BLOCKS = 16, 1_000_000
#: Probes that a task makes at a time.
PROBES = 2_000_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the runs of all whole texts, one in EDITED misspelt by its hash with doc_id, that have LEAST_LENGTH code points and LEAST_COUNT occurrences at least."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("doc", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    less = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    words = runs.select(F.when(F.col("h") % EDITED == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=_U)
    p[0] = 1
    return np.cumprod(p, dtype=_U)


def _terms(words: np.ndarray) -> np.ndarray:
    """For words of one length as rows of bytes: what each byte adds to its word's hash, before mixing."""
    return (words.astype(_U) + _U(1)) * _powers(_BASE, words.shape[1])


def _slots(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash among so many, and bits that choose within the lanes."""
    h = mix(h)
    return ((h >> _U(32)) * _U(blocks)) >> _U(32), mix(h ^ _BASE)


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row indexes, and the matrix of bytes, of the words of each length."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    sizes = np.array([len(w) for w in raw], dtype=np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join(raw[i] for i in rows), dtype=np.uint8).reshape(len(rows), size)


def _filter_bits(batches: Iterator[pa.RecordBatch], blocks: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, words in _by_length(batch.column(0)):
            first, count = blocks[words.shape[1]]
            block, bits = _slots(_terms(words).sum(axis=1, dtype=_U), count)
            lanes = [(_U(1) << ((bits >> _U(6 * k)) & _U(63))).view(np.int64) for k in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64) + first), *map(pa.array, lanes)], names=["block", *(f"lane{k}" for k in range(8))])


def filters(words: DataFrame, blocks: dict[int, tuple[int, int]]) -> DataFrame:
    """block, lane0 to lane7: the blocks of the filters of all lengths; blocks has the first block and the number of blocks of each length."""
    bits = words.select("word").mapInArrow(lambda it: _filter_bits(it, blocks), "block long, " + ", ".join(f"lane{k} long" for k in range(8)))
    return bits.groupBy("block").agg(*[F.bit_or(f"lane{k}").alias(f"lane{k}") for k in range(8)])


class Probe:
    """The blocks low to high of the filters, for probes by hash."""

    def __init__(self, low: int, lanes: np.ndarray, blocks: dict[int, tuple[int, int]]):
        self.low, self.lanes, self.blocks = low, lanes, blocks

    def hits(self, h: np.ndarray, size: int) -> np.ndarray:
        """Indexes of the hashes of words of this size that the blocks hold."""
        first, count = self.blocks[size]
        block, bits = _slots(h, count)
        block = block.astype(np.int64) + (first - self.low)
        at = np.flatnonzero((block >= 0) & (block < len(self.lanes))) if first < self.low or first + count > self.low + len(self.lanes) else np.arange(len(h))
        for k in range(8):
            at = at[(self.lanes[block[at], k] >> ((bits[at] >> _U(6 * k)) & _U(63))) & _U(1) == 1]
        return at


def edits(words: np.ndarray, probe: Probe) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(rows, edited words): for words of one length, the deletions and the replacements by a later letter that the filters let pass."""
    n, size = words.shape
    step = max(1, PROBES // (size * len(LETTERS)))
    for a in range(0, n, step):
        part = words[a : a + step]
        for low in range(0, size, wide := max(1, PROBES // len(LETTERS))):
            at = np.arange(low, min(size, low + wide))
            terms = _terms(part)
            whole = terms.sum(axis=1, dtype=_U)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
            if size in probe.blocks:
                power = _powers(_BASE, size)[at]
                kept = terms[:, at]
                bare = whole[:, None] - kept
                row, place, letter = np.nonzero(part[:, at][:, :, None] < LETTERS)
                h = bare[row, place] + (LETTERS[letter].astype(_U) + _U(1)) * power[place]
                hit = probe.hits(h, size)
                found.append((row[hit], at[place[hit]], LETTERS[letter[hit]]))
            if size - 1 in probe.blocks:
                before = np.cumsum(terms, axis=1, dtype=_U)
                fresh = np.ones(part.shape, dtype=bool)
                fresh[:, 1:] = part[:, 1:] != part[:, :-1]  # deletions within a run of one letter are the same
                row, place = np.nonzero(fresh[:, at])
                place = at[place]
                h = (before[row, place] - terms[row, place]) + (whole[row] - before[row, place]) * _INVERSE
                hit = probe.hits(h, size - 1)
                found.append((row[hit], place[hit], None))
            for row, place, letter in found:
                made = []
                for k in range(len(row)):
                    w = part[row[k]].tobytes()
                    made.append((w[: place[k]] + (b"" if letter is None else bytes([letter[k]])) + w[place[k] + 1 :]).decode("latin-1"))
                yield row + a, made


def _passing(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    probe = Probe(*sent.value)
    for batch in batches:
        for rows, words in _by_length(batch.column(0)):
            for row, made in edits(words, probe):
                if made:
                    at = pa.array(rows[row])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(made, pa.string())], names=["word", "n", "other"])


def near_words(words: DataFrame, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """word, n, other, other_n: each pair of words one edit apart, once. words (word, n) must be a stored table."""
    spark = words.sparkSession
    lengths = words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).orderBy("size")
    blocks, total = {}, 0
    # A row for each length: fewer than the square root of the characters of all words, as their lengths differ.
    for size, n in lengths.toLocalIterator():
        blocks[size] = (total, -(-n * BITS // 512))
        total += blocks[size][1]
    stored = saved(filters(words, blocks).repartitionByRange("block").sortWithinPartitions("block"), "filters")
    passed = None
    for low in range(0, max(total, 1), round_blocks):
        part = stored.where((F.col("block") >= low) & (F.col("block") < low + round_blocks)).toArrow()
        lanes = np.zeros((min(round_blocks, total - low), 8), dtype=_U)
        at = part.column(0).to_numpy() - low
        for k in range(8):
            lanes[at, k] = part.column(k + 1).to_numpy().view(_U)
        sent = spark.sparkContext.broadcast((low, lanes, blocks))
        spread = words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        made = saved(spread.mapInArrow(lambda it, sent=sent: _passing(it, sent), "word string, n long, other string"), "passed")
        sent.unpersist()
        passed = made if passed is None else passed.unionByName(made)
    return passed.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root from word, form: every pointer is followed by its own pointer until none moves; forms grow twofold at least, so some six rounds do."""
    ways = saved(forms.select("word", F.col("form").alias("to")), "ways")
    while True:
        onward = ways.select(F.col("word").alias("to"), F.col("to").alias("further"))
        after = saved(skew_join(ways, onward, ["to"], "left").select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "ways")
        ways = after.select("word", "to")
        if after.where("moved").isEmpty():
            return ways.select("word", F.col("to").alias("root"))


def group_spellings(docs: DataFrame, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    form is the near word (one insert, delete or replacement) of largest n, ties to the smallest, if that is FACTOR times the word's n at least; root is where forms lead.
    A null or empty text has no words; a null doc_id counts as an empty string where occurrences are misspelt; repeated rows count each. A table without words gives an empty result; only doc_id and text are read.
    """
    words = saved(vocabulary(docs.select("doc_id", "text")), "vocabulary")
    pairs = near_words(words, round_blocks)
    both = F.inline(F.array(*[F.struct(F.col(a).alias("word"), F.col(b).alias("n"), F.col(c).alias("near"), F.col(d).alias("near_n")) for a, b, c, d in (("word", "n", "other", "other_n"), ("other", "other_n", "word", "n"))]))
    seen = pairs.select(both).unionByName(words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    found = seen.groupBy("word", "n").agg(F.count("near").alias("n_near"), best.alias("best"))
    chosen = -F.col("best.less") >= FACTOR * F.col("n")
    forms = saved(found.select("word", "n", "n_near", F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(forms.where("form IS NOT NULL"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir):
    return group_spellings(table(spark, sf_dir, "documents"))


#: crc32 of a text, for DuckDB: the byte table by its rule, and a fold over the text's bytes.
CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"


def crc_sql(text: str) -> str:
    """SQL for the crc32 of the SQL expression text; t is CRC_TABLE's."""
    byte = f"('0x' || substr(hex({text}), 2 * k + 1, 2))::BIGINT"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex({text})) // 2), lambda k: {byte})), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE = f"""WITH RECURSIVE {CRC_TABLE},
run AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents) GROUP BY ALL),
drawn AS (SELECT run, c, {crc_sql("doc_id || ':' || run")} AS h FROM run, crc),
vocab AS (SELECT w AS word, sum(c)::BIGINT AS n FROM (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w FROM drawn) WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
gap AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
less AS (SELECT DISTINCT g.word, v.word AS near FROM gap g JOIN vocab v ON v.word = g.a || g.b),
near AS (SELECT p.word, q.word AS near FROM gap p JOIN gap q ON p.i = q.i AND p.a = q.a AND p.b = q.b AND p.word <> q.word UNION SELECT word, near FROM less UNION SELECT near, word FROM less),
best AS (SELECT near.word, count(*) AS n_near, arg_min({{'w': near, 'n': v.n}}, {{'n': -v.n, 'w': near}}) AS f FROM near JOIN vocab v ON v.word = near.near GROUP BY near.word),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 2 * v.n THEN f.w END AS form, CASE WHEN f.n >= 2 * v.n THEN f.n END AS form_n FROM vocab v LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM form UNION ALL SELECT way.word, form.form FROM way JOIN form ON form.word = way.at WHERE form.form IS NOT NULL)
SELECT form.word, form.form, way.at AS root, form.n, form.n_near, form.form_n FROM form JOIN way ON way.word = form.word JOIN form last ON last.word = way.at AND last.form IS NULL"""
