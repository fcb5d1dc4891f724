"""Streaming job: events -> window features, findings, revisions and risk, from one query.

State is kept by entity (``transformWithState``): its retained events, the frames of
its findings (revision, content, live score) and its windows.  A micro-batch's events
of an entity are put into the state, and only the windows that they can change are
judged again, by the two account rules: a burst of failures in a window, and a
success after failures.  What changed becomes a frame at the next revision, with the
change of the entity's live risk.  An event-time timer, one for an entity, closes windows
and clears the state of entities that stay away.

One query has several outputs: each micro-batch writes frames, risk, closed windows
and backfill to folders of its own batch number, so a batch that is run again after
a crash overwrites what it had written and nothing is there twice.

What is kept, from the newest event of the entity: ``lateness`` for late events, one
window, and the lookback before it; so each window that an accepted event touches is
judged on all its events, however many: an entity's state holds 24 bytes an event, and the
evidence of a finding is as long as its failures.  Older arrivals go to backfill
(``beyond_retention``).  Who has to bound the state by events as well can give
``most_events``: beyond it the oldest go to backfill (``evicted``), and a window that
would need them stays as it was judged.  There is no such bound otherwise.

Defined results: events without time, id or entity are left out; an event id counts
once while it is kept, and later copies are late by then; ties are ordered by id.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from watchloom.operators import analysis as A
from watchloom.streaming.windows import shared_folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT_SCHEMA = "kind string, entity_id long, rule_id string, window_start timestamp, at timestamp, revision int, operation string, score double, amount double, attempts long, failures long, hash string, evidence array<long>, event_id long, reason string"
#: Columns of each output.
OUTPUTS = {
    "frames": ["entity_id", "rule_id", "window_start", "at", "revision", "operation", "score", "failures", "hash", "evidence"],
    "risk": ["entity_id", "rule_id", "window_start", "at", "revision", "operation", "amount"],
    "windows": ["entity_id", "window_start", "revision", "attempts", "failures"],
    "backfill": ["entity_id", "event_id", "at", "reason"],
}
UNKNOWN, FAILURE, SUCCESS = range(3)
_SECOND = 1_000_000


@dataclass(frozen=True)
class Rules:
    """Window, lookback and lateness in seconds; the least failures of a burst and before a success; scores."""

    window: int = 86_400
    lookback: int = 3 * 86_400
    lateness: int = 3_600
    burst: int = 3
    before_success: int = 3
    success_score: float = 0.9
    #: A bound of an entity's kept events, which costs findings; none: all of the time above are kept.
    most_events: int | None = None

    @property
    def kept(self) -> int:
        return self.lateness + self.window + self.lookback


@dataclass
class Kept:
    """An entity's retained events in (time, id) order; times are microseconds."""

    times: np.ndarray
    ids: np.ndarray
    outcomes: np.ndarray
    #: Windows that need events before this time are not judged any more.
    floor: int

    @staticmethod
    def nothing(floor: int) -> Kept:
        return Kept(*(np.empty(0, np.int64) for _ in range(3)), floor)

    def put(self, times: np.ndarray, ids: np.ndarray, outcomes: np.ndarray) -> np.ndarray:
        """Adds events with new ids; returns their times."""
        _, first = np.unique(ids, return_index=True)
        new = np.sort(first[~np.isin(ids[first], self.ids)])
        t, i, o = np.r_[self.times, times[new]], np.r_[self.ids, ids[new]], np.r_[self.outcomes, outcomes[new]]
        order = np.lexsort((i, t))
        self.times, self.ids, self.outcomes = t[order], i[order], o[order]
        return times[new]

    def drop(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes out the n oldest events."""
        gone = self.ids[:n], self.times[:n]
        if n:
            self.floor = max(self.floor, int(self.times[n - 1]) + 1)
        self.times, self.ids, self.outcomes = self.times[n:], self.ids[n:], self.outcomes[n:]
        return gone


def touched(times: np.ndarray, rules: Rules) -> list[int]:
    """Starts of the windows that events at these times can change: their own, and those of successes in the lookback after them."""
    size = rules.window * _SECOND
    first = times // size
    last = (times + rules.lookback * _SECOND) // size
    return sorted({int(w) * size for d in range(rules.lookback // rules.window + 2) for w in np.unique(first[first + d <= last] + d)})


def judged(kept: Kept, start: int, rules: Rules) -> list[tuple[str, int, float, int, list[int]]]:
    """(rule, time, score, failures, evidence) of a window's findings."""
    out, end, back = [], start + rules.window * _SECOND, rules.lookback * _SECOND
    first, a, b = np.searchsorted(kept.times, [start - back, start, end])
    bad = first + np.flatnonzero(kept.outcomes[first:b] == FAILURE)
    own = bad[np.searchsorted(bad, a) :]
    if len(own) >= rules.burst:
        out.append(("failure-burst", end, min(1.0, len(own) / 5), len(own), np.sort(kept.ids[own]).tolist()))
    good = a + np.flatnonzero(kept.outcomes[a:b] == SUCCESS)
    # events are in order, so the failures before a success are those at smaller places
    lo = np.searchsorted(bad, np.searchsorted(kept.times, kept.times[good] - back))
    hi = np.searchsorted(bad, good)
    enough = np.flatnonzero(hi - lo >= rules.before_success)
    if len(enough):
        k = enough[0]
        before, i = bad[lo[k] : hi[k]], good[k]
        out.append(("failure-then-success", int(kept.times[i]), rules.success_score, len(before), [*kept.ids[before].tolist(), int(kept.ids[i])]))
    return out


def content(at: int, failures: int, evidence: list[int]) -> str:
    return hashlib.sha256(f"{at}|{failures}|{','.join(map(str, evidence))}".encode()).hexdigest()


@dataclass
class Entity:
    """An entity's state; it is read and written as one value, as each call to the state store costs more than the judging."""

    kept: Kept
    newest: int | None
    #: the one timer that is registered, in milliseconds
    timer: int | None
    #: (rule, window start) -> (revision, operation, hash, score)
    frames: dict[tuple[str, int], tuple[int, str, str, float]]
    #: window start -> (revision, attempts, failures)
    windows: dict[int, tuple[int, int, int]]

    @staticmethod
    def of(state: tuple[Any, ...] | None) -> Entity:
        if state is None:
            return Entity(Kept.nothing(-(1 << 62)), None, None, {}, {})
        kept = Kept(*(np.frombuffer(x, np.int64) for x in state[:3]), state[3])
        frames, windows = json.loads(state[6])
        return Entity(kept, state[4], state[5], {(rule, at): tuple(x) for rule, at, *x in frames}, {at: tuple(x) for at, *x in windows})

    def value(self) -> tuple[Any, ...]:
        k = self.kept
        text = json.dumps([[[*at, *x] for at, x in self.frames.items()], [[at, *x] for at, x in self.windows.items()]])
        return k.times.tobytes(), k.ids.tobytes(), k.outcomes.tobytes(), k.floor, self.newest, self.timer, text

    def due(self, rules: Rules) -> int | None:
        """When the entity has to be looked at next: a window closes, or all that is kept becomes useless."""
        ends = [(start + rules.window * _SECOND) // 1000 for start, x in self.windows.items() if x[0] == 0]
        if self.newest is not None and (len(self.kept.times) or self.frames or self.windows):
            ends.append((self.newest + 2 * rules.kept * _SECOND) // 1000)
        return min(ends, default=None)


class AccountFindings(StatefulProcessor):
    """State and output of one entity; see the module's text."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entity", "times binary, ids binary, outcomes binary, floor long, newest long, timer long, judged string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.batches(key, self.taken(Entity.of(self.state.get()), rows, timerValues.getCurrentWatermarkInMs()))

    def taken(self, e: Entity, rows: Iterator[pd.DataFrame], now: int) -> Iterator[dict[str, Any]]:
        """Rows to put out for the events of a batch; then the state is written."""
        rules, kept, got = self.rules, e.kept, []
        oldest = -(1 << 62) if e.newest is None else e.newest - rules.lateness * _SECOND
        for df in rows:
            times, ids, outcomes = (df[c].to_numpy(np.int64) for c in ("at", "event_id", "code"))
            late = times < oldest
            yield from (self.row("backfill", at=t, event_id=i, reason="beyond_retention") for t, i in zip(times[late].tolist(), ids[late].tolist(), strict=True))
            if late.all():
                continue
            got.append((times[~late], ids[~late], outcomes[~late]))
            top = int(times[~late].max())
            e.newest = top if e.newest is None else max(e.newest, top)
            if rules.most_events is not None and len(kept.times) + sum(len(x[0]) for x in got) > rules.most_events:
                # what goes has been judged before
                yield from self.said(e, got, now)
                ids, times = kept.drop(max(0, len(kept.times) - rules.most_events))
                yield from (self.row("backfill", at=t, event_id=i, reason="evicted") for i, t in zip(ids.tolist(), times.tolist(), strict=True))
        yield from self.said(e, got, now)
        if e.newest is not None:
            kept.drop(int(np.searchsorted(kept.times, e.newest - rules.kept * _SECOND)))
            self.forget(e)
            self.put(e)

    def said(self, e: Entity, got: list[tuple[np.ndarray, np.ndarray, np.ndarray]], now: int) -> Iterator[dict[str, Any]]:
        """Puts the events got so far into the state, and what changes by them."""
        new = e.kept.put(*(np.concatenate(x) for x in zip(*got, strict=True))) if got else np.empty(0, np.int64)
        got.clear()
        yield from self.judge(e, new)
        yield from self.count(e, new, now)

    def put(self, e: Entity, fired: int | None = None) -> None:
        """Writes the state, with its one timer; a timer that has fired is taken away by Spark."""
        due = e.due(self.rules)
        if due != e.timer:
            if e.timer is not None and e.timer != fired:
                self.handle.deleteTimer(e.timer)
            if due is not None:
                self.handle.registerTimer(due)
            e.timer = due
        self.state.update(e.value())

    def judge(self, e: Entity, new: np.ndarray) -> Iterator[dict[str, Any]]:
        for start in touched(new, self.rules):
            if start - self.rules.lookback * _SECOND < e.kept.floor:
                continue
            found = {f[0]: f for f in judged(e.kept, start, self.rules)}
            for rule in ("failure-burst", "failure-then-success"):
                old = e.frames.get((rule, start))
                live = old[3] if old and old[1] == "upsert" else 0.0
                if rule in found:
                    _, at, score, failures, evidence = found[rule]
                    digest = content(at, failures, evidence)
                    if old and old[1] == "upsert" and old[2] == digest:
                        continue
                    operation = "upsert"
                elif old and old[1] == "upsert":
                    at, score, failures, evidence, digest, operation = start + self.rules.window * _SECOND, 0.0, 0, [], old[2], "retracted"
                else:
                    continue
                revision = (old[0] if old else 0) + 1
                e.frames[rule, start] = (revision, operation, digest, score)
                yield self.row("frames", rule_id=rule, window_start=start, at=at, revision=revision, operation=operation, score=score, amount=score - live, failures=failures, hash=digest, evidence=evidence)

    def count(self, e: Entity, new: np.ndarray, watermark: int) -> Iterator[dict[str, Any]]:
        """Counts of the new events' windows; a window that is closed already comes again at the next revision."""
        size, kept = self.rules.window * _SECOND, e.kept
        for start in sorted({int(w) * size for w in np.unique(new // size)}):
            if start < kept.floor:
                continue
            a, b = np.searchsorted(kept.times, [start, start + size])
            attempts, failures = int(b - a), int((kept.outcomes[a:b] == FAILURE).sum())
            revision = e.windows[start][0] if start in e.windows else 0
            if revision or (start + size) // 1000 <= watermark:
                revision += 1
                yield self.row("windows", window_start=start, revision=revision, attempts=attempts, failures=failures)
            e.windows[start] = (revision, attempts, failures)

    def forget(self, e: Entity) -> None:
        """Frames and closed windows that no accepted event can change any more."""
        last = e.newest - self.rules.kept * _SECOND
        e.frames = {at: x for at, x in e.frames.items() if at[1] >= last}
        e.windows = {start: x for start, x in e.windows.items() if start >= last or x[0] == 0}

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out, size = timerValues.getCurrentWatermarkInMs(), [], self.rules.window * _SECOND
        e = Entity.of(self.state.get())
        for start, (revision, attempts, failures) in sorted(e.windows.items()):
            if revision == 0 and (start + size) // 1000 <= now:
                e.windows[start] = (1, attempts, failures)
                out.append(self.row("windows", window_start=start, revision=1, attempts=attempts, failures=failures))
        if e.newest is not None and (e.newest + 2 * self.rules.kept * _SECOND) // 1000 <= now:
            # nobody came for so long that each kept event is useless; the newest time stays for late arrivals
            e = Entity(Kept.nothing(e.kept.floor), e.newest, e.timer, {}, {})
        self.put(e, expiredTimerInfo.getExpiryTimeInMs())
        yield from self.batches(key, out)

    @staticmethod
    def row(kind: str, **values: Any) -> dict[str, Any]:
        return {"kind": kind} | values

    @staticmethod
    def batches(key: Any, rows: Iterable[dict[str, Any]], most: int = 500, most_ids: int = 100_000) -> Iterator[pd.DataFrame]:
        """Rows as text, many in a value: a frame of each entity's rows in all their columns costs more than the judging.

        A value ends with the row that brings its evidence to that many ids.
        """
        held: list[dict[str, Any]] = []
        ids = 0
        for r in rows:
            held.append(r)
            ids += len(r.get("evidence", ()))
            if len(held) == most or ids >= most_ids:
                yield pd.DataFrame({"entity_id": [int(key[0])], "said": [json.dumps(held)]})
                held, ids = [], 0
        if held:
            yield pd.DataFrame({"entity_id": [int(key[0])], "said": [json.dumps(held)]})


def told(said: DataFrame) -> DataFrame:
    """Rows of OUT_SCHEMA from the processor's texts."""
    kinds = [c.split(" ") for c in OUT_SCHEMA.split(", ")]
    text = ", ".join(f"{c} {'long' if kind == 'timestamp' else kind}" for c, kind in kinds if c != "entity_id")
    x = said.select("entity_id", F.explode(F.from_json("said", f"array<struct<{text.replace(' ', ': ').replace(',:', ',')}>>")).alias("x"))
    return x.select(*("entity_id" if c == "entity_id" else (F.timestamp_micros(f"x.{c}") if kind == "timestamp" else F.col(f"x.{c}")).alias(c) for c, kind in kinds))


def findings(events: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """All outputs of the job in one stream of OUT_SCHEMA; events(event_id, ts, entity_id, outcome, ...) is a stream.

    Timers follow the column ``received``, if there is one, else ``ts``.  Spark leaves out
    rows that its watermark has passed, so a stream whose entities are at different
    times should have ``received``, by which no row is late.
    """
    clock = "received" if "received" in events.columns else "ts"
    x = events.where("event_id is not null and ts is not null and entity_id is not null").withWatermark(clock, f"{rules.lateness} seconds")
    code = F.when(F.col("outcome") == "failure", FAILURE).when(F.col("outcome") == "success", SUCCESS).otherwise(UNKNOWN)
    x = x.select(clock, F.col("entity_id").cast("long").alias("entity_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id"), code.alias("code"))
    return told(x.groupBy("entity_id").transformWithStateInPandas(AccountFindings(rules), "entity_id long, said string", "Append", "EventTime"))


def write_outputs(folder: str):
    """A foreachBatch function: each output of a batch to <folder>/<output>/batch=<number>, over what an earlier try left."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for name, columns in OUTPUTS.items():
                held.where(F.col("kind") == ("frames" if name == "risk" else name)).select(*columns).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        finally:
            held.unpersist()

    return write


def start(events: DataFrame, folder: str, checkpoint: str, rules: Rules = Rules(), available_now: bool = False) -> StreamingQuery:  # noqa: B008
    """Runs the job with outputs below folder.  The state store is RocksDB, which keyed state with timers needs."""
    spark, key = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        out = findings(events, rules).writeStream.foreachBatch(write_outputs(folder)).outputMode("append").option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if available_now else out).start()
    finally:
        spark.conf.set(key, before)


def written(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the OUTPUTS, of all batches."""
    kinds = dict(c.split(" ") for c in OUT_SCHEMA.split(", "))
    return spark.read.schema(", ".join(f"{c} {kinds[c]}" for c in OUTPUTS[name]) + ", batch long").parquet(f"{folder}/{name}")


def current(frames: DataFrame) -> DataFrame:
    """The latest frame of each (entity, rule, window) that isn't retracted."""
    cols = [c for c in frames.columns if c not in ("entity_id", "rule_id", "window_start")]
    last = frames.groupBy("entity_id", "rule_id", "window_start").agg(F.max_by(F.struct(*cols), "revision").alias("x"))
    return last.select("entity_id", "rule_id", "window_start", "x.*").where("operation = 'upsert'")


def entity_risk(risk: DataFrame, at: str) -> DataFrame:
    """Decayed risk of each entity at a time, from the stream's contributions."""
    return A.entity_risk(risk, at)


def replay(events: DataFrame, rounds: int, rules: Rules = Rules()) -> str:  # noqa: B008
    """Events with an arrival round (column ``round``) through the job, a restart for each round; the outputs' folder."""
    spark = events.sparkSession
    base = shared_folder(spark)
    cols = [c for c in ("event_id", "ts", "entity_id", "outcome", "received") if c in events.columns]
    for n in range(rounds):
        events.where(F.col("round") == n).select(*cols).write.parquet(f"{base}/arrivals/round={n}")
        stream = spark.readStream.schema(events.select(*cols).schema).option("recursiveFileLookup", "true").parquet(f"{base}/arrivals")
        start(stream, f"{base}/out", f"{base}/checkpoint", rules, available_now=True).awaitTermination()
    return f"{base}/out"
