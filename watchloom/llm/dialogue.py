"""Repair of conversation structure by weighted interval parsing.

Method
------
A conversation's rows become symbols: the role's first character and the row's first
fault (blank, duplicate, truncated).  The legal forms, an optional system row and
then pairs of user and assistant, are an automaton of four states; the repair
grammar in Chomsky normal form has a nonterminal [p, q] for each pair of states:

* ``[p, q] -> [p, r] [r, q]`` for every r,
* ``[p, q] -> row``: Keep (0) or Rerole to user or assistant (2) where that step
  leads from p to q, Delete (3) where p = q; a blank or duplicate row can only be
  deleted, and a truncated row that stays costs 1 more,
* insertion closure: each row cell is closed on both sides by the cheapest
  Inserts (2 each) between states.

A span's cell holds for each [p, q] the least (cost, audit), where the audit is the
edits' initials.  Cells are combined bottom-up by span length, 1, 2, 4, ...: two
neighbouring spans give one of twice the length.  One split a span is enough, as the
rules have every r: whatever the split, the cell is the minimum over all edits of
the span (the tests hold it against all splits).  Least audits combine, too: two
edits of one span with the same cost and states never have audits of which one
begins with the other, as the longer one would only add Inserts.

Rows are dealt out by ranges of (conversation, turn, ...), so that a conversation
however long is parsed in many tasks; a task makes one cell of each conversation's
rows in its range, and a conversation's cells, one a range at most, are combined at
the end.  Duplicates are told by a grouped minimum.  Only the repaired rows of a
conversation go through one task, as a stream in order, for their digest is a chain.

Defined results: a null role or text is one space.  Rows are ordered by (turn, role,
digest of role and text), nulls first, so ties and repeated rows have one result.
Rows with a null conv_id are one conversation.  An empty role has no initial and is
never kept.  A row's role is read by its first character, so any role that begins
with u counts as a user's.  An empty table gives no rows.  Further columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.textops import pieces, saved

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What a row is, by its first fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)

# States: nothing yet, after the system row, after a user's, after an assistant's row.
_STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_STATES = range(4)
_END = (0, 3)
_PAIRS = [(p, q) for p in _STATES for q in _STATES]
#: Characters that make no word.
_BLANKS = " \t\n\x0b\x0c\r"

Cell = list[tuple[int, str] | None]  # by 4 * p + q


def _closed_under_inserts() -> Cell:
    """The cheapest runs of Inserts between states (users and assistants only)."""
    cell: Cell = [(0, "") if p == q else None for p, q in _PAIRS]
    for _ in _STATES:
        for p in _STATES:
            for (a, c), b in _STEPS.items():
                got = cell[4 * p + a]
                if c != "s" and got is not None:
                    new = (got[0] + INSERT, got[1] + "I")
                    old = cell[4 * p + b]
                    if old is None or new < old:
                        cell[4 * p + b] = new
    return cell


def _joined_pairs() -> list[tuple[int, list[tuple[int, int]]]]:
    """For each [p, q] that edits can reach, the cells of [p, r] and [r, q]."""
    reach = {(p, q) for p, q in _PAIRS if p == q or q >= 2 or (p, q) == (0, 1)}
    return [(4 * p + q, [(4 * p + r, 4 * r + q) for r in _STATES if (p, r) in reach and (r, q) in reach]) for p, q in _PAIRS if (p, q) in reach]


_JOINS = _joined_pairs()
_INSERTS = _closed_under_inserts()


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = [None] * 16
    for at, ways in _JOINS:
        best = None
        for i, j in ways:
            a, b = left[i], right[j]
            if a is not None and b is not None:
                cost = a[0] + b[0]
                # audits are put together only where costs don't decide
                if best is None or cost < best[0]:
                    best = (cost, a[1] + b[1])
                elif cost == best[0]:
                    best = min(best, (cost, a[1] + b[1]))
        out[at] = best
    return out


def row_cell(initial: str, fault: int) -> Cell:
    """The cell of one row, closed under Inserts."""
    cell: Cell = [None] * 16

    def offer(p: int, q: int, cost: int, edit: str) -> None:
        old = cell[4 * p + q]
        if old is None or (cost, edit) < old:
            cell[4 * p + q] = (cost, edit)

    for p in _STATES:
        offer(p, p, DELETE, "D")
        if fault in (SOUND, CUT):
            stays = TRUNCATED if fault == CUT else 0
            for (a, c), q in _STEPS.items():
                if a == p:
                    if c == initial:
                        offer(p, q, stays, "K")
                    if c != "s":
                        offer(p, q, REROLE + stays, "R")
    return combined(combined(_INSERTS, cell), _INSERTS)


#: Cells of all kinds of rows.
_ROWS = {(c, fault): row_cell(c, fault) for c in ("s", "u", "a", "") for fault in range(4)}


class Span:
    """Cells of neighbouring rows as they come, of span lengths that are powers of two, the longest first."""

    def __init__(self) -> None:
        self.cells: list[tuple[int, Cell]] = []

    def add(self, cell: Cell, length: int = 1) -> None:
        self.cells.append((length, cell))
        while len(self.cells) > 1 and self.cells[-1][0] >= self.cells[-2][0]:
            (n, b), (m, a) = self.cells.pop(), self.cells.pop()
            self.cells.append((m + n, combined(a, b)))

    def whole(self) -> Cell:
        """The cell of all rows; of no rows, what Inserts alone do."""
        out: Cell | None = None
        for _, cell in reversed(self.cells):
            out = cell if out is None else combined(cell, out)
        return out or _INSERTS


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(x for q in _END if (x := cell[q]) is not None)


def applied(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the repaired rows: the audit's edits on (role, text) in order."""
    place, system = 0, 0
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        wanted = "assistant" if (place - system) % 2 else "user"
        if edit != "K":
            role = wanted
        elif place == 0 and role[:1] == "s":
            system = 1
        place += 1
        yield role, text, edit


# --- tables


def plain(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text."""
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated and made the user's by crc32(conv_id:turn) % 20; a null is one space there."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    x = plain(turns).withColumn("_what", what).where("_what <> 0")
    text = F.when(F.col("_what") == 1, F.lit("")).when(F.col("_what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_what") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.expr("if(_what = 3, array(1, 2), array(1))"))
    return x.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def digest() -> Column:
    """128 bits of a row's role and text."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, row, initial, fault) of plain rows: a written table without texts."""
    end = F.substring(F.rtrim("text", F.lit(_BLANKS)), -1, 1)
    blank = F.rtrim("text", F.lit(_BLANKS)) == ""
    x = rows.select("conv_id", "turn", "role", digest().alias("digest"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    x = saved(x.withColumn("row", F.monotonically_increasing_id()))
    first = x.where(~F.col("blank")).groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), F.col("first.row").alias("_first"))
    y = x.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("_first") != F.col("row"), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    return saved(y.select("conv_id", "turn", "role", "digest", "row", "initial", fault.alias("fault")))


_BLOCK = "first_turn long, last_turn long, turns long, first string, last string, illegal long, blank long, duplicate long, truncated long, rows long, costs array<long>, audits array<string>"
_FIELDS = [f.split()[0] for f in _BLOCK.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.string())]


class Block:
    """What is known of some neighbouring rows of a conversation: counts, ends and the span's cell."""

    def __init__(self) -> None:
        self.first_turn = self.last_turn = self.first = self.last = None
        self.turns = self.illegal = self.rows = 0
        self.faults = [0, 0, 0, 0]
        self.span = Span()

    def meets(self, first: str) -> None:
        if self.rows and self.last + first not in ("su", "ua", "au"):
            self.illegal += 1

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.meets(initial)
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        if not self.rows:
            self.first = initial
        self.last = initial
        self.rows += 1
        self.faults[fault] += 1
        self.span.add(_ROWS[initial if initial in ("s", "u", "a") else "", fault])

    def add_block(self, b: dict[str, Any]) -> None:
        """The block of the rows that follow."""
        self.meets(b["first"])
        if b["first_turn"] is not None:
            self.turns += b["turns"] - (b["first_turn"] == self.last_turn)
            self.last_turn = b["last_turn"]
            if self.first_turn is None:
                self.first_turn = b["first_turn"]
        self.last = b["last"]
        self.illegal += b["illegal"]
        for fault, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated")):
            self.faults[fault] += b[name]
        self.rows += b["rows"]
        self.span.add([None if c is None else (c, a) for c, a in zip(b["costs"], b["audits"], strict=True)], b["rows"])

    def values(self) -> list[Any]:
        cell = self.span.whole()
        return [self.first_turn, self.last_turn, self.turns, self.first, self.last, self.illegal, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.rows, [x and x[0] for x in cell], [x and x[1] for x in cell]]


def block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered (range, conv_id, turn, initial, fault) -> a block for each conversation in the range."""
    now: tuple[Any, Any] | None = None
    block, done = Block(), []

    def out(rows: list[Any]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), *_TYPES], strict=True)], names=["conv_id", "range", *_FIELDS])

    for batch in batches:
        at, conv, turn, initial, fault = (c.to_pylist() for c in batch.columns)
        for a, c, t, i, f in zip(at, conv, turn, initial, fault, strict=True):
            if now != (a, c):
                if block.rows:
                    done.append([now[1], now[0], *block.values()])
                    if len(done) >= 1000:
                        yield out(done)
                        done = []
                now, block = (a, c), Block()
            block.add(t, i, f)
    if block.rows:
        done.append([now[1], now[0], *block.values()])
    if done:
        yield out(done)


_PARSED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, blocks in order) -> _PARSED."""
    for batch in batches:
        for part in pieces(batch, 1 << 20, 500):
            rows = []
            for conv, blocks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                whole = Block()
                for b in blocks:
                    whole.add_block(b)
                cost, audit = cheapest(whole.span.whole())
                gaps = 0 if whole.first_turn is None else whole.last_turn - whole.first_turn + 1 - whole.turns
                rows.append((conv, gaps, whole.faults[BLANK], whole.faults[DUPLICATE], whole.faults[CUT], whole.illegal, cost, audit))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 7, pa.string()], strict=True)], names=[f.split()[0] for f in _PARSED.split(", ")])


def parsed(rows: DataFrame) -> DataFrame:
    """_PARSED for each conversation of plain rows: its faults and cheapest repair."""
    order = ["conv_id", "turn", "role", "digest", "row"]
    dealt = symbols(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = dealt.select(F.spark_partition_id().alias("range"), "conv_id", "turn", "initial", "fault").mapInArrow(block_batches, f"conv_id long, range int, {_BLOCK}")
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("range", *_FIELDS))).alias("blocks"))
    return whole.mapInArrow(parse_batches, _PARSED)


_REPAIRED = "conv_id long, place long, role string, text string, edit string"


def repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered (conv_id, audit, role, text), each conversation's audit before its rows -> _REPAIRED."""

    def out(rows: list[Any]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], names=["conv_id", "place", "role", "text", "edit"])

    stream = (row for batch in batches for part in pieces(batch) for row in zip(*(x.to_pylist() for x in part.columns), strict=True))
    done, size = [], 0
    for conv, own in groupby(stream, itemgetter(0)):
        audit = next(own)[1]
        for place, (role, text, edit) in enumerate(applied(audit, ((role, text) for _, _, role, text in own))):
            done.append((conv, place, role, text, edit))
            size += len(text) + 100
            if size > 1 << 20:
                yield out(done)
                done, size = [], 0
    if done:
        yield out(done)


def repaired(rows: DataFrame, parse: DataFrame) -> DataFrame:
    """_REPAIRED: the rows of each conversation after its edits, in order within a partition.

    A conversation's rows come to one task in order, as a stream; they aren't collected.
    """
    none = lambda kind: F.lit(None).cast(kind)
    heads = parse.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), "audit")
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", digest().alias("digest"), "text", none("string").alias("audit"))
    stream = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return stream.select("conv_id", "audit", "role", "text").mapInArrow(repair_batches, _REPAIRED)


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered repaired rows -> (conv_id, repaired_sha256) of their ``role:text`` lines."""

    def out(rows: list[Any]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], names=["conv_id", "repaired_sha256"])

    stream = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
    done = []
    for conv, own in groupby(stream, itemgetter(0)):
        sha = hashlib.sha256()
        for i, (_, role, text) in enumerate(own):
            sha.update((("\n" if i else "") + f"{role}:{text}").encode())
        done.append((conv, sha.hexdigest()))
        if len(done) >= 1000:
            yield out(done)
            done = []
    if done:
        yield out(done)


def report(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """Faults, cheapest repair and the repaired text's digest for each conversation of turns, of which rows are left.

    A conversation of which no row is left has zeros, an empty audit and the digest of nothing.
    """
    rows = plain(rows)
    parse = saved(parsed(rows))
    digests = repaired(rows, parse).mapInArrow(digest_batches, "conv_id long, repaired_sha256 string")
    key = lambda df: df.withColumn("_known", F.col("conv_id").isNotNull()).withColumn("conv_id", F.coalesce("conv_id", F.lit(0)))
    out = key(turns.select(F.col("conv_id").cast("long")).distinct()).join(key(parse), ["conv_id", "_known"], "left").join(key(digests), ["conv_id", "_known"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.when(F.col("_known"), F.col("conv_id")).alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
