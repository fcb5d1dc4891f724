"""Relations with cardinality: assertions and transfers, decided one after another for each key.

Each decision depends on what was accepted before, so the requests of a key, an
entity's relations of one type (for types with many holders: to one target), are
folded in order.  They come sorted by Spark's shuffle and are read as a stream; what
is held is the set of accepted intervals of the current key, never its requests.

Outcomes of an assertion of [valid_from, valid_to): ``inserted``; ``replayed``, the
same event asserts what it asserted; ``conflict_start``, the same event with another
start; ``conflict_pair``, another event holds the pair over a common time;
``conflict_holder``, another target is held over a common time by a type with a
single holder; ``unknown_type``.  Of a transfer at valid_from: ``transferred``;
``multi_holder``; ``no_active``, nobody holds an open interval; ``conflict_holder``,
the target holds it already; ``conflict_end``, not after the holder's start;
``unknown_type``.  An interval that ends before it begins is an ``invalid_interval``.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Relation types and how many holders one may have at a time.
CARDINALITY = {"member_of": "multi", "belongs_to": "multi", "assigned_to": "single", "managed_by": "single"}

_FOREVER = 1 << 62
_COLUMNS = "from_id long, type string, to_id long, event_id long, action string, valid_from timestamp, valid_to timestamp, arrival long, known boolean"
_OUT = _COLUMNS.replace("known boolean", "outcome string, closes long")


class Held:
    """Accepted intervals of one key: [start, end) -> (target, event), disjoint for each target."""

    def __init__(self, single: bool):
        self.single = single
        self.by_event: dict[tuple[int, int], int] = {}
        # (start, end, target, event) in order; intervals of one key never overlap
        self.intervals: list[tuple[int, int, int, int]] = []

    def overlapping(self, start: int, end: int) -> list[tuple[int, int, int, int]]:
        at = bisect_left(self.intervals, (start, -1, 0, 0))
        got = [self.intervals[at - 1]] if at and self.intervals[at - 1][1] > start else []
        while at < len(self.intervals) and self.intervals[at][0] < end:
            got.append(self.intervals[at])
            at += 1
        return got

    def keep(self, start: int, end: int, target: int, event: int) -> None:
        self.by_event[target, event] = start
        insort(self.intervals, (start, end, target, event))

    def assertion(self, target: int, event: int, start: int, end: int) -> str:
        stored = self.by_event.get((target, event))
        if stored is not None:
            return "replayed" if stored == start else "conflict_start"
        others = self.overlapping(start, end)
        if any(o[2] == target for o in others):
            return "conflict_pair"
        if others:
            return "conflict_holder"
        self.keep(start, end, target, event)
        return "inserted"

    def transfer(self, target: int, event: int, start: int) -> tuple[str, int | None]:
        """The outcome, and the event of the relation that it closes."""
        last = self.intervals[-1] if self.intervals else None
        if last is None or last[1] != _FOREVER:
            return "no_active", None
        if last[2] == target:
            return "conflict_holder", None
        if start <= last[0]:
            return "conflict_end", None
        self.intervals[-1] = (last[0], start, last[2], last[3])
        self.keep(start, _FOREVER, target, event)
        return "transferred", last[3]


def fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests in order of (key, known first, arrival) -> the same with their outcomes."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.timestamp("us", "UTC"), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in _OUT.split(", ")]

    def micros(column: pa.Array) -> list[int | None]:
        return column.cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_pylist()

    def rows() -> Iterator[tuple[Any, ...]]:
        for b in batches:
            yield from zip(*(micros(b.column(i)) if i in (5, 6) else b.column(i).to_pylist() for i in range(b.num_columns)), strict=True)

    def out(done: list[tuple[Any, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    done = []
    for (_, kind, target), own in groupby(rows(), lambda r: (r[0], r[1], r[2] if CARDINALITY.get(r[1]) != "single" else None)):
        single = CARDINALITY.get(kind) == "single"
        held = Held(single)
        for r in own:
            _, _, target, event, action, start, end, _, known = r
            closes = None
            if known:
                held.keep(start, _FOREVER if end is None else end, target, event)
                continue
            if kind not in CARDINALITY:
                outcome = "unknown_type"
            elif end is not None and end <= start:
                outcome = "invalid_interval"
            elif action == "transfer" and not single:
                outcome = "multi_holder"
            elif action == "transfer":
                outcome, closes = held.transfer(target, event, start)
            else:
                outcome = held.assertion(target, event, start, _FOREVER if end is None else end)
            done.append((*r[:8], outcome, closes))
            if len(done) >= 5000:
                yield out(done)
                done = []
    if done:
        yield out(done)


def decide(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """requests(from_id, type, to_id, event_id, action, valid_from, valid_to, arrival) with outcome, and closes: the event whose relation a transfer ends.

    ``action`` is ``assert`` or ``transfer``; requests of a key are taken by arrival,
    ties by event id.  ``known`` has the relations that hold already, of the same
    columns but action and arrival.  Requests with a null id or start are left out.
    """
    columns = [c.split()[0] for c in _COLUMNS.split(", ")]
    x = requests.withColumn("known", F.lit(False)).select(*columns)
    if known is not None:
        x = x.unionByName(known.withColumn("known", F.lit(True)).withColumn("action", F.lit("assert")).withColumn("arrival", F.lit(None).cast("long")).select(*columns))
    x = x.where("from_id is not null and to_id is not null and event_id is not null and valid_from is not null and type is not null")
    single = F.col("type").isin(*[t for t, c in CARDINALITY.items() if c == "single"])
    key = F.when(~single, F.col("to_id"))
    order = ["from_id", "type", F.asc_nulls_first("_key"), F.desc("known"), "arrival", "event_id", "to_id", "valid_from", "valid_to"]
    dealt = x.withColumn("_key", key).repartition("from_id", "type", "_key").sortWithinPartitions(*order)
    return dealt.select(*columns).mapInArrow(fold_batches, _OUT)


def accepted(decided: DataFrame) -> DataFrame:
    """The relations that decisions leave: inserted and transferred ones, ended by the transfers that close them."""
    ok = decided.where("outcome in ('inserted', 'transferred')").withColumn("valid_to", F.when(F.col("outcome") == "inserted", F.col("valid_to")))
    ends = ok.where("closes is not null").select("from_id", "type", F.col("closes").alias("event_id"), F.col("valid_from").alias("_end"))
    x = ok.join(ends, ["from_id", "type", "event_id"], "left").withColumn("valid_to", F.coalesce("valid_to", "_end"))
    return x.select("from_id", "type", "to_id", "event_id", "valid_from", "valid_to")
