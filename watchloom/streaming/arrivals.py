"""What becomes of each arrival: the bounded window state of each entity, folded in arrival order.

An entity holds at most ``windows`` open windows of at most ``contributions`` events;
each decision depends on the ones before.  Arrivals are range-partitioned by (entity,
arrival) into blocks of about ``block_rows`` rows, so a hot entity's arrivals are
sorted by many tasks and never together.  Blocks are folded in steps: the first
block of every entity at once, then the second ones with the state that the first
left, and so on; only entities with several blocks take part in later steps.  The
carried state is small (its bounds) and lies in the shared folder between steps.

Dispositions: ``future_rejected`` (later than its receipt by more than the limit; the
state is not touched), ``late_rejected`` (its window is closed, or older than all open
ones while there is no room), ``duplicate`` (the window has the id), ``capacity_rejected``
(the window is full), ``late_accepted`` (behind the watermark, in an open window),
``added``.  Backfill gets what was late (``window_closed``, ``beyond_retention``) and
each event of a window that made room for a newer one (``window_evicted``).

Rows with a null entity, id, time or receipt are left out.  Ties in arrival are
ordered by event id and time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.streaming.windows import shared_folder

OUT_SCHEMA = "kind string, entity_id long, event_id long, arrival long, value string, window_start long, state string"
_NEVER = -(1 << 62)


@dataclass(frozen=True)
class Bounds:
    """Times in seconds."""

    window: int = 600
    lateness: int = 600
    idle: int = 300
    future: int = 300
    windows: int = 16
    contributions: int = 1024


@dataclass
class State:
    """An entity's state; times are microseconds."""

    newest: int = _NEVER
    received: int = _NEVER
    floor: int = _NEVER
    #: start of each open window -> its event ids, in order
    windows: dict[int, list[int]] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps([self.newest, self.received, self.floor, [[k, v] for k, v in self.windows.items()]])

    @staticmethod
    def of(text: str) -> State:
        newest, received, floor, windows = json.loads(text)
        return State(newest, received, floor, {int(k): v for k, v in windows})

    def arrive(self, event: int, at: int, received: int, bounds: Bounds) -> tuple[str, list[tuple[int, int, str]]]:
        """The disposition, and (event, window, reason) of what goes to backfill."""
        second = 1_000_000
        if at > received + bounds.future * second:
            return "future_rejected", []
        if self.received != _NEVER and received - self.received >= bounds.idle * second:
            self.floor = max(self.floor, received - bounds.lateness * second)
        mark = max(self.newest - bounds.lateness * second, self.floor)
        size = bounds.window * second
        start, lost = at // size * size, []
        if start not in self.windows:
            if mark >= start + size:
                return "late_rejected", [(event, start, "window_closed")]
            if len(self.windows) >= bounds.windows:
                oldest = min(self.windows)
                if start <= oldest:
                    return "late_rejected", [(event, start, "beyond_retention")]
                lost = [(e, oldest, "window_evicted") for e in self.windows.pop(oldest)]
            self.windows[start] = []
        own = self.windows[start]
        if event in own:
            return "duplicate", lost
        if len(own) >= bounds.contributions:
            return "capacity_rejected", lost
        own.append(event)
        self.newest, self.received = max(self.newest, at), received
        return ("late_accepted" if at < mark else "added"), lost


def folded(bounds: Bounds):
    """A function over batches: rows by entity, each entity's state first, then its arrivals in order -> OUT_SCHEMA.

    Entities follow one another in a stream: a call and two frames for each of them cost more than the fold.
    """
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(c, kinds[kind]) for c, kind in (x.split() for x in OUT_SCHEMA.split(", "))])

    def batch(out: list[tuple[Any, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True))
        out: list[tuple[Any, ...]] = []
        for entity, own in groupby(rows, lambda r: r[0]):
            state = State()
            for _, event, at, received, arrival, before in own:
                if before is not None:
                    state = State.of(before)
                    continue
                told, lost = state.arrive(event, at, received, bounds)
                out.append(("arrival", entity, event, arrival, told, None, None))
                out += [("backfill", entity, e, arrival, why, start, None) for e, start, why in lost]
                if len(out) >= 10_000:
                    yield batch(out)
                    out = []
            out.append(("state", entity, None, None, None, None, state.text()))
        if out:
            yield batch(out)

    return fold


def dispositions(events: DataFrame, bounds: Bounds = Bounds(), block_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(arrivals with their disposition, backfill) of events(entity_id, event_id, ts, received_at, arrival), arrival a number that orders them."""
    spark = events.sparkSession
    base = shared_folder(spark)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    x = events.select(*(F.col(c).cast("long").alias(c) for c in ("entity_id", "event_id", "arrival")), micros("ts").alias("at"), micros("received_at").alias("received")).dropna()
    blocks = max(1, -(-x.count() // block_rows))
    x.repartitionByRange(blocks, "entity_id", "arrival", "event_id", "at").withColumn("block", F.spark_partition_id()).write.parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("block"))
    rows.select("entity_id", "block").distinct().withColumn("step", place).write.parquet(f"{base}/steps")
    steps = spark.read.parquet(f"{base}/steps")
    last = steps.agg(F.max("step")).first()[0] or 0
    columns = ["entity_id", "event_id", "at", "received", "arrival"]
    state = spark.createDataFrame([], "entity_id long, state string")
    for step in range(1, last + 1):
        own = rows.join(steps.where(F.col("step") == step).select("entity_id", "block"), ["entity_id", "block"])
        # a state whose entity has no further block is no longer carried
        before = state.join(steps.where(F.col("step") == step).select("entity_id"), "entity_id", "left_semi")
        both = own.select(*columns, F.lit(None).cast("string").alias("state")).unionByName(before, allowMissingColumns=True)
        dealt = both.repartition("entity_id").sortWithinPartitions("entity_id", F.col("state").isNull(), "arrival", "event_id", "at")
        dealt.mapInArrow(folded(bounds), OUT_SCHEMA).write.parquet(f"{base}/out/step={step}")
        state = spark.read.schema(OUT_SCHEMA).parquet(f"{base}/out/step={step}").where("kind = 'state'").select("entity_id", "state")
    out = spark.read.schema(f"{OUT_SCHEMA}, step int").parquet(f"{base}/out") if last else spark.createDataFrame([], f"{OUT_SCHEMA}, step int")
    told = out.where("kind = 'arrival'").select("entity_id", "event_id", "arrival", F.col("value").alias("disposition"))
    lost = out.where("kind = 'backfill'").select("entity_id", "event_id", "arrival", F.col("value").alias("reason"), F.timestamp_micros("window_start").alias("window_start"))
    return told, lost
