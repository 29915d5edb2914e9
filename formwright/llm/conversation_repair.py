"""Repair of the turn structure of conversations by generalised LR parsing of their roles.

The role grammar is `(s?(ua)+)?`, as rules: whole -> nothing | pairs | s pairs; pairs -> u a | pairs u a. Its LR(0) table drives a
graph-structured stack: heads share their tails, every row may be kept, deleted or given another role and empty rows may be put in anywhere,
and heads with equal stack tops merge into the one of least (cost, audit). What may follow depends in this grammar on the top alone, and of two
audits of equal cost over the same rows none begins the other (what is longer holds inserts that cost more), so the least merged
audit stays least whatever follows, and stretches of a conversation can be parsed apart and joined by their tops.

Rows are spread by a sort on conversation and turn, so a conversation of any length is cut over tasks. A conversation that ends where its task
has all of it, within LONGEST rows, is finished there. All others go on row by row: their repeated rows are found by an aggregation, each stretch in a task becomes a
small table (top before, top after) -> (cost, audit), one conversation's tables are joined in order, and its rows stream past its audit once more.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import saved, smaller_batches, table
from .spelling import CRC_TABLE, crc_sql

#: Rows of a conversation that one task takes together; longer ones are parsed in stretches of this many rows.
LONGEST = 2_000
#: The LR(0) table. States: 0 start, 1 after s, 2 after u, 3 u a done, 4 pairs, 5 pairs u, 6 pairs u a done, 7 s pairs.
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 4: {"u": 5}, 5: {"a": 6}, 7: {"u": 5}}
POPPED = {3: 2, 6: 3}
GOTO = {0: 4, 1: 7}
ACCEPTED = (0, 4, 7)
#: A stack for each top, as (top, rest).
BASE = {0: (0, None), 1: (1, (0, None)), 2: (2, (0, None)), 4: (4, (0, None)), 5: (5, (4, (0, None))), 7: (7, (1, (0, None)))}
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
ROLE = {"u": "user", "a": "assistant"}
_SEEN = re.compile(r"[^\x20\x09-\x0D]")
_ENDED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
LEGAL = {"su", "ua", "au"}


def after(stack: tuple, symbol: str) -> tuple:
    """The stack once symbol is shifted and what is then complete is reduced."""
    stack = (SHIFT[stack[0]][symbol], stack)
    if stack[0] in POPPED:
        for _ in range(POPPED[stack[0]]):
            stack = stack[1]
        stack = (GOTO[stack[0]], stack)
    return stack


def _merge(heads: dict, stack: tuple, cost: int, audit: str) -> bool:
    now = heads.get(stack[0])
    if now is None or (cost, audit) < now[:2]:
        heads[stack[0]] = (cost, audit, stack)
        return True
    return False


def _inserted(heads: dict) -> dict:
    """heads with all that inserts lead to."""
    work = list(heads.values())
    while work:
        cost, audit, stack = work.pop()
        for symbol in SHIFT[stack[0]]:
            if symbol in ROLE and _merge(heads, to := after(stack, symbol), cost + INSERT, audit + "I"):
                work.append(heads[to[0]])
    return heads


@lru_cache(maxsize=200_000)
def parse(codes: str, begin: int = 0) -> dict[int, tuple[int, str]]:
    """top -> least (cost, audit) over rows given as pairs of characters, role initial and fault (D: must go, T: truncated, -: none), from the stack with top `begin`."""
    heads = {begin: (0, "", BASE[begin])}
    for k in range(0, len(codes), 2):
        initial, fault = codes[k], codes[k + 1]
        late = TRUNCATED if fault == "T" else 0
        made: dict = {}
        for cost, audit, stack in _inserted(heads).values():
            _merge(made, stack, cost + DELETE, audit + "D")
            if fault == "D":
                continue
            for symbol in SHIFT[stack[0]]:
                if symbol == initial:
                    _merge(made, after(stack, symbol), cost + late, audit + "K")
                if symbol in ROLE:
                    _merge(made, after(stack, symbol), cost + REROLE + late, audit + "R")
        heads = made
    return {top: (cost, audit) for top, (cost, audit, _) in _inserted(heads).items()}


def joined(left: dict, right: dict[int, dict]) -> dict:
    """The table of two stretches: left by its tops, right[begin] by its own."""
    out: dict = {}
    for middle, (cost, audit) in left.items():
        for top, (more, rest) in right[middle].items():
            if top not in out or (cost + more, audit + rest) < out[top]:
                out[top] = (cost + more, audit + rest)
    return out


class Repair:
    """Writes a repaired conversation's hash as its rows pass by; letters of the audit come in stretches."""

    def __init__(self):
        self.stack, self.sha, self.first = BASE[0], hashlib.sha256(), True
        self.letters, self.at = "", 0

    def _line(self, role: str, text: str) -> None:
        self.sha.update((("" if self.first else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.first = False

    def _demanded(self) -> str:
        return next(x for x in SHIFT[self.stack[0]] if x in ROLE)

    def inserts(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self._line(ROLE[symbol := self._demanded()], "")
            self.stack = after(self.stack, symbol)
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter != "D":
            symbol = role[0] if letter == "K" else self._demanded()
            self._line(role if letter == "K" else ROLE[symbol], text)
            self.stack = after(self.stack, symbol)

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def fault_of(text: str, repeated: bool) -> str:
    """b(lank), d(uplicate), t(runcated) or -: the first that holds."""
    if not _SEEN.search(text):
        return "b"
    if repeated:
        return "d"
    return "-" if _ENDED.search(text) else "t"


def code_of(role: str, fault: str) -> str:
    return (role[:1] or " ") + {"b": "D", "d": "D", "t": "T", "-": "-"}[fault]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after damage, equal rows counted; drawn by crc32 of `conv_id:turn`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    role, text = blank("role"), blank("text")
    made = rows.select("conv_id", "turn", draw.alias("draw"), role.alias("role"), text.alias("text")).where("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = made.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("draw") == 3, 2).otherwise(1).alias("n"))
    return made.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))


#: Code points of a text by which rows of one turn are dealt; the sort within a task is by the whole text.
_DEALT_BY = 64


def ordered(rows: DataFrame) -> DataFrame:
    """rows sorted by conversation and turn (nulls first), then role and text; one conversation may lie in several partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys: list[Column] = [F.col("conv_id"), F.col("turn"), F.col("role")]
    return rows.repartitionByRange(n, *keys, F.substring("text", 1, _DEALT_BY)).sortWithinPartitions(*keys, F.col("text"))


_DONE = "conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Tally:
    """Counts over rows in order; `turns` are distinct ones that are not null, `first` and `last` the role initials at its ends."""

    def __init__(self):
        self.min_turn = self.max_turn = self.last_turn = self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def row(self, turn, role: str, fault: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.min_turn = turn if self.min_turn is None else self.min_turn
            self.max_turn = self.last_turn = turn
            self.turns += 1
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"

    def gaps(self) -> int:
        return 0 if self.min_turn is None else self.max_turn - self.min_turn + 1 - self.turns


def _finished(rows: list[tuple]) -> tuple:
    """The result for a conversation whose rows (turn, role, text, copies) are all here."""
    tally, seen, codes = Tally(), set(), []
    for turn, role, text, copies in rows:
        fresh = (role, text) not in seen
        seen.add((role, text))
        for k in range(copies):
            fault = fault_of(text, k > 0 or not fresh)
            tally.row(turn, role, fault)
            codes.append(code_of(role, fault))
    cost, audit = min(v for top, v in parse("".join(codes)).items() if top in ACCEPTED)
    repair = Repair()
    repair.letters = audit
    for _, role, text, copies in rows:
        for _ in range(copies):
            repair.row(role, text)
    return tally.gaps(), tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit, repair.digest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _close(batches: Iterator[pa.RecordBatch], schema: pa.Schema, longest: int) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie in this partition alone and are short; rows of all others."""
    none, out = (None,) * 8, []
    held: list[tuple] = []  # rows of the conversation at hand
    count, here, first, open_ = 0, None, True, False

    def rest() -> list[tuple]:
        return [(here, False, *none, *r) for r in held]

    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held or open_:
                if conv != here:
                    out += rest() if first or open_ else [(here, True, *_finished(held), None, None, None, None)]
                    held, count, first, open_ = [], 0, False, False
            here = conv
            held.append(tuple(row))
            count += row[3]
            if count > longest:
                out += rest()
                held, open_ = [], True
            if len(out) >= 1_000:
                yield _batch(out, schema)
                out = []
    out += rest()  # the last one may go on in the next partition
    if out:
        yield _batch(out, schema)


def _stretches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, longest: int) -> Iterator[pa.RecordBatch]:
    """For each conversation in this partition one row of tables and counts (at = -1), and its rows with their places."""
    part = TaskContext.get().partitionId()
    out, here, begun = [], None, False
    tally, codes, tables, at = Tally(), [], None, 0

    def cut() -> None:
        nonlocal codes, tables
        word = "".join(codes)
        more = {begin: parse(word, begin) for begin in BASE}
        tables = more if tables is None else {begin: joined(t, more) for begin, t in tables.items()}
        codes = []

    def whole() -> tuple:
        cut()
        flat = [(b, top, cost, audit) for b, t in tables.items() for top, (cost, audit) in t.items()]
        counts = (tally.min_turn, tally.max_turn, tally.turns, tally.blank, tally.duplicate, tally.truncated, tally.illegal, tally.first, tally.last)
        return (here, part, -1, *counts, *([x[k] for x in flat] for k in range(4)), None, None, None)

    for batch in batches:
        for conv, turn, role, text, copies, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begun and conv != here:
                out.append(whole())
                tally, codes, tables, at = Tally(), [], None, 0
            here, begun = conv, True
            for k in range(copies):
                fault = fault_of(text, k > 0 or not first)
                tally.row(turn, role, fault)
                codes.append(code_of(role, fault))
                if len(codes) >= longest:
                    cut()
            out.append((here, part, at, *(None,) * 13, role, text, copies))
            at += 1
            if len(out) >= 1_000:
                yield _batch(out, schema)
                out = []
    if begun:
        out.append(whole())
    if out:
        yield _batch(out, schema)


def _choose(rows: list[dict]) -> tuple[tuple, list[tuple]]:
    """Counts, cost and audit of a conversation from its stretches in order; and the letters of each stretch."""
    tables = []
    for r in rows:
        t: dict = {}
        for b, top, cost, audit in zip(r["begins"], r["tops"], r["costs"], r["audits"], strict=True):
            t.setdefault(b, {})[top] = (cost, audit)
        tables.append(t)
    # Least (cost, lengths) first by whole audits; then each stretch's letters are read off by the tops on the way.
    ways = {0: (0, "", ())}
    for t in tables:
        made: dict = {}
        for middle, (cost, audit, cuts) in ways.items():
            for top, (more, rest) in t[middle].items():
                if top not in made or (cost + more, audit + rest) < made[top][:2]:
                    made[top] = (cost + more, audit + rest, (*cuts, len(audit) + len(rest)))
        ways = made
    cost, audit, cuts = min(v for top, v in ways.items() if top in ACCEPTED)
    letters = [audit[a:b] for a, b in zip((0, *cuts[:-1]), cuts, strict=True)]
    illegal = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    known = [r for r in rows if r["turns"]]
    # A turn at the end of one stretch and the begin of the next is one turn.
    turns = sum(r["turns"] for r in known) - sum(a["max_turn"] == b["min_turn"] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1]["max_turn"] - known[0]["min_turn"] + 1 - turns if known else 0
    return (gaps, *(sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")), illegal, cost, audit), letters


def _letters(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Stretches of whole conversations to rows (conv_id, part, counts, cost, audit, letters): the first stretch of each carries the result."""
    held: list[dict] = []

    def done() -> pa.RecordBatch:
        result, letters = _choose(held)
        return _batch([(r["conv_id"], r["part"], *(result if k == 0 else (None,) * 7), word) for k, (r, word) in enumerate(zip(held, letters, strict=True))], schema)

    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["conv_id"] != r["conv_id"]:
                yield done()
                held = []
            held.append(r)
    if held:
        yield done()


def _hashes(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Letters and rows of conversations, in order, to results."""
    out, here, result, repair = [], None, None, None
    for batch in batches:
        for conv, at, role, text, copies, letters, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if result is None or conv != here:
                if result is not None:
                    out.append((here, *result, repair.digest()))
                here, result, repair = conv, tuple(counts), Repair()
            if at < 0:
                repair.inserts()
                repair.letters, repair.at = letters, 0
            else:
                for _ in range(copies):
                    repair.row(role, text)
        if len(out) >= 1_000:
            yield _batch(out, schema)
            out = []
    if result is not None:
        out.append((here, *result, repair.digest()))
    if out:
        yield _batch(out, schema)


def _mapped(df: DataFrame, run, ddl: str, *more) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return df.mapInArrow(lambda it: run(it, schema, *more), ddl)


def repair_conversations(rows: DataFrame, longest: int = LONGEST) -> DataFrame:
    """One row for each conv_id of the input: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first, as the contract has it. Null and empty fields: a null conv_id is a conversation like others; a null turn comes first and counts for no gap;
    null role or text is one space; a role without a first letter is never legal and cannot be kept. Rows of one turn are taken by role, then text; equal rows lie side by side. Conversations
    without rows after damage have zeros, an empty audit and the hash of nothing; an empty table gives an empty one. Columns other than conv_id, turn, role and text are not read.
    """
    smaller_batches(rows.sparkSession)
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    done = _DONE.format(conv=conv)
    named = [c.split()[0] for c in done.split(", ")]
    closed = saved(_mapped(ordered(damaged(rows)), _close, done.replace(", gaps", ", done boolean, gaps") + f", turn {turn}, role string, text string, copies long", longest), "closed")
    left = closed.where("NOT done").select("conv_id", "turn", "role", "text", "copies")
    # A row is the first of its role and text where no row of an earlier turn has both; equal rows are one row here.
    turns = left.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("least"))
    firsts = turns.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("x"), F.col("least.turn").alias("t"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("x"))
    marked = left.join(firsts, same, "left").select("conv_id", "turn", "role", "text", "copies", F.col("r").isNotNull().alias("first"))
    counts = f"min_turn {turn}, max_turn {turn}, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
    tables = "begins array<int>, tops array<int>, costs array<long>, audits array<string>"
    pieces = saved(_mapped(ordered(marked), _stretches, f"conv_id {conv}, part int, at long, {counts}, {tables}, role string, text string, copies long", longest), "stretches")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = pieces.where("at < 0").drop("at", "role", "text", "copies").repartition(n, "conv_id").sortWithinPartitions("conv_id", "part")
    result = ", ".join(done.split(", ")[1:-1])
    letters = _mapped(heads, _letters, f"conv_id {conv}, part int, {result}, letters string")
    stream = letters.withColumns({"at": F.lit(-1).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "copies": F.lit(None).cast("long")})
    stream = stream.unionByName(pieces.where("at >= 0").select("conv_id", "part", "at", "role", "text", "copies"), allowMissingColumns=True)
    stream = stream.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "at").select("conv_id", "at", "role", "text", "copies", "letters", *named[1:-1])
    hashed = _mapped(stream, _hashes, done)
    known = closed.where("done").select(*named).unionByName(hashed)
    gone = rows.select("conv_id").distinct().join(known.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
    empty = {c: F.lit(0).cast("long") for c in named[1:-2]} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return known.unionByName(gone.withColumns(empty))


def op11_conversation_repair(spark, sf_dir):
    return repair_conversations(table(spark, sf_dir, "conversations"))


def _oracle() -> str:
    """The contract for DuckDB. A state (nothing yet, after s, after u, after a) is a text of its cost, audit and repaired lines, so that least() is by cost, then audit."""
    mark = "chr(1)"

    def edit(x: str, cost: str, letter: str, line: str = "''") -> str:
        return f"lpad((substr({x}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({x}, 10, position({mark} IN {x}) - 10) || '{letter}' || substr({x}, position({mark} IN {x})) || {line}"

    def least(*ways: str) -> str:
        return f"least({', '.join(ways)})"

    insert = lambda x, role: edit(x, "2", "I", f"chr(10) || '{role}:'")
    keep = lambda x, initial: f"CASE WHEN NOT forced AND initial = '{initial}' THEN {edit(x, 'late', 'K', 'chr(10) || role || chr(58) || text')} END"
    rerole = lambda x, role: f"CASE WHEN NOT forced THEN {edit(x, '2 + late', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"
    drop = lambda x: edit(x, "3", "D")
    before_u = ("s0", "s1", "a")
    return f"""WITH RECURSIVE {CRC_TABLE},
drawn AS (SELECT conv_id, turn, role, text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations), crc),
kept AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE d <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM kept),
fault AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '-' END AS fault,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) || substr(role, 1, 1) AS pair FROM ranked),
line AS (SELECT conv_id, k, role, text, initial, fault IN ('b', 'd') AS forced, (fault = 't')::INT AS late FROM fault),
tally AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM fault GROUP BY conv_id),
begun AS (SELECT conv_id, 0::BIGINT AS k, '000000000' || {mark} AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS u0, NULL::VARCHAR AS a0 FROM tally),
way AS (SELECT conv_id, k, s0, s1, {insert("s0", "user")} AS u, {insert("u1", "assistant")} AS a FROM (SELECT *, {insert("s0", "user")} AS u1 FROM begun)
  UNION ALL SELECT conv_id, k, s0, s1, u1, {least("a0", insert("u1", "assistant"))} FROM (SELECT *, {least("u0", insert("s0", "user"), insert("s1", "user"), insert("a0", "user"))} AS u1 FROM (
    SELECT way.conv_id, line.k, {drop("s0")} AS s0, {least(drop("s1"), keep("s0", "s"))} AS s1, {least(drop("u"), *(keep(x, "u") for x in before_u), *(rerole(x, "user") for x in before_u))} AS u0, {least(drop("a"), keep("u", "a"), rerole("u", "assistant"))} AS a0
    FROM way JOIN line ON line.conv_id = way.conv_id AND line.k = way.k + 1))),
done AS (SELECT tally.*, least(s0, a) AS x FROM way JOIN tally ON tally.conv_id = way.conv_id AND tally.n = way.k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(x, 1, 9)::BIGINT, 0) AS cost,
  coalesce(substr(x, 10, position({mark} IN x) - 10), '') AS audit, sha256(coalesce(substr(x, position({mark} IN x) + 2), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN done USING (conv_id)"""


ORACLE = _oracle()
