"""Dispositions: each bound, and a hot entity in many blocks against one fold."""

import datetime as dt
import random

from watchloom.streaming import arrivals as B

SCHEMA = "entity_id long, event_id long, ts timestamp, received_at timestamp, arrival long"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
BOUNDS = B.Bounds(window=600, lateness=1800, idle=10**9, windows=3, contributions=2)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def micros(t):
    return int((t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def test_each_bound():
    state = B.State()
    ask = lambda event, minute, received=None: state.arrive(event, micros(at(minute)), micros(at(minute if received is None else received)), BOUNDS)[0]
    assert [ask(1, 100), ask(1, 100), ask(2, 101), ask(3, 102)] == ["added", "duplicate", "added", "capacity_rejected"]
    assert ask(4, 120, 110) == "future_rejected" and ask(5, 105.1, 100) == "future_rejected" and ask(6, 95, 103) == "added"
    assert ask(7, 112) == "added"
    # three windows are open, and this one, though not closed, is older than all
    assert state.arrive(8, micros(at(85)), micros(at(112)), BOUNDS) == ("late_rejected", [(8, micros(at(80)), "beyond_retention")])
    told, lost = state.arrive(9, micros(at(135)), micros(at(135)), BOUNDS)
    assert told == "added" and [x[0] for x in lost] == [6] and lost[0][2] == "window_evicted"
    assert ask(10, 104, 136) == "capacity_rejected" and state.arrive(12, micros(at(99)), micros(at(136)), BOUNDS)[1][0][2] == "window_closed"
    assert state.arrive(13, micros(at(50)), micros(at(136)), BOUNDS) == ("late_rejected", [(13, micros(at(50)), "window_closed")])
    assert ask(14, 150) == "added" and ask(15, 119, 151) == "late_accepted"
    quiet = B.State()
    bounds = B.Bounds(window=600, lateness=600, idle=300)
    assert quiet.arrive(1, micros(at(0)), micros(at(0)), bounds)[0] == "added"
    assert quiet.arrive(2, micros(at(1)), micros(at(60)), bounds)[0] == "late_accepted"  # idle for an hour, but its window is open still
    assert quiet.arrive(3, micros(at(15)), micros(at(60)), bounds)[0] == "late_rejected"
    assert B.State.of(quiet.text()) == quiet


def test_hot_entity_in_many_blocks(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        entity = 1 if rng.random() < 0.7 else rng.randrange(2, 40)
        ts = at(i * 0.7 - rng.choice([0, 0, 0, 8, 25, 90]))
        rows.append((entity, i if rng.random() < 0.95 else i - 1, ts, at(i * 0.7 - (10 if i % 97 == 0 else 0)), i))
    rows += [(None, 1, at(0), at(0), 1), (1, None, at(0), at(0), 1), (1, 1, None, at(0), 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    told, lost = B.dispositions(df, BOUNDS, block_rows=150)
    got = {(r.entity_id, r.event_id, r.arrival): r.disposition for r in told.collect()}
    gone = sorted((r.entity_id, r.event_id, r.arrival, r.reason) for r in lost.collect())
    states, wanted, left = {}, {}, []
    for entity, event, ts, received, arrival in rows[:3000]:
        what, out = states.setdefault(entity, B.State()).arrive(event, micros(ts), micros(received), BOUNDS)
        wanted[entity, event, arrival] = what
        left += [(entity, e, arrival, why) for e, _, why in out]
    assert got == wanted and gone == sorted(left)
    assert set(wanted.values()) == {"added", "late_accepted", "duplicate", "late_rejected", "future_rejected", "capacity_rejected"}
    assert {x[3] for x in left} == {"window_closed", "beyond_retention", "window_evicted"}
    assert B.dispositions(df.limit(0))[0].count() == 0


def test_running_maximum_in_blocks(spark):
    """Two levels of maxima give the plain running maximum, for a hot entity, null entities and ties of value."""
    from pyspark.sql import functions as F

    from watchloom.operators.analysis import with_running_max

    rng = random.Random(12)
    rows = [(rng.choice([1, 1, 1, 2, None]), i * i, rng.choice([None, rng.randrange(50)])) for i in range(400)]
    got = {r.arrival: r.top for r in with_running_max(spark.createDataFrame(rows, "entity long, arrival long, v int"), "top", F.col("v"), "arrival", "entity", block_rows=20).collect()}
    best = {}
    for entity, arrival, v in rows:
        assert got[arrival] == best.get(entity)
        if v is not None:
            best[entity] = max(v, best.get(entity, v))
    assert with_running_max(spark.createDataFrame([], "entity long, arrival long, v int"), "top", F.col("v"), "arrival", "entity").count() == 0


def test_entities_are_folded_as_a_stream():
    """Rows of many entities in one call, an entity over two batches, a carried state first; before, a call took one entity."""
    import pyarrow as pa

    first, second = (micros(at(m)) for m in (0, 1))
    carried = B.State()
    carried.arrive(7, first, first, BOUNDS)
    rows = [(1, None, None, None, None, carried.text()), (1, 7, second, second, 2, None), (1, 8, second, second, 3, None), (2, 7, first, first, 1, None)]
    kinds = [pa.int64()] * 5 + [pa.string()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds, strict=True)], names=list("abcdef")) for part in (rows[:2], rows[2:])]
    out = [tuple(r.values())[:5] for b in B.folded(BOUNDS)(iter(batches)) for r in b.to_pylist()]
    assert [x for x in out if x[0] == "arrival"] == [("arrival", 1, 7, 2, "duplicate"), ("arrival", 1, 8, 3, "added"), ("arrival", 2, 7, 1, "added")]
    assert [x[1] for x in out if x[0] == "state"] == [1, 2]
