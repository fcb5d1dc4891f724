"""The findings stream: against the batch rules, over restarts and a crash, at its bounds."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import rows

import __spark_entry__ as entry
from watchloom.operators import analysis as A
from watchloom.streaming import findings as L
from watchloom.streaming.windows import shared_folder

SCHEMA = "event_id long, ts timestamp, entity_id long, outcome string, round int"
RULES = L.Rules(window=3600, lookback=7200, lateness=600)
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def stream_of(spark, folder):
    return spark.readStream.schema("event_id long, ts timestamp, entity_id long, outcome string").option("recursiveFileLookup", "true").parquet(folder)


@pytest.fixture(scope="module")
def arrivals(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        minute = i * 0.9
        late = rng.choice([0, 0, 0, 3, 8])
        rows.append((i, at(minute), i % 3, rng.choice(["failure", "failure", "success", None]), int((minute + late) // 300)))
    rows.append((5, at(4.5), 5 % 3, "failure", 0))  # an event id that comes again
    return spark.createDataFrame(rows, SCHEMA).cache()


def batch_findings(events):
    x = events.dropDuplicates(["event_id"])
    burst = A.failure_burst(x, RULES.burst, "1 hour").select("entity_id", F.lit("failure-burst").alias("rule_id"), "window_start", "failures", "evidence")
    after = A.failure_then_success(x, RULES.before_success, "2 hours", "1 hour").select("entity_id", F.lit("failure-then-success").alias("rule_id"), "window_start", "failures", "evidence")
    return {tuple(r[:3]): (r.failures, r.evidence) for r in burst.union(after).collect()}


def test_stream_gives_the_batch_findings(spark, arrivals):
    folder = L.replay(arrivals, 3, RULES)
    frames = L.written(spark, folder, "frames")
    got = {tuple(r[:3]): (r.failures, r.evidence) for r in L.current(frames).select("entity_id", "rule_id", "window_start", "failures", "evidence").collect()}
    assert got == batch_findings(arrivals) and len(got) > 20
    # revisions of a finding have no gap, and the live amounts add up to the last score
    each = frames.groupBy("entity_id", "rule_id", "window_start").agg(F.max("revision").alias("top"), F.count(F.lit(1)).alias("n"))
    assert each.where("top <> n").count() == 0 and each.where("top > 1").count() > 0
    live = L.written(spark, folder, "risk").agg(F.sum("amount")).first()[0]
    assert live == pytest.approx(L.current(frames).agg(F.sum("score")).first()[0])
    assert L.written(spark, folder, "backfill").count() == 0


def test_crash_between_write_and_commit(spark, arrivals, monkeypatch):
    base = shared_folder(spark)
    rows = arrivals.drop("round")
    rows.where("event_id < 500").write.parquet(f"{base}/in/a")
    whole = L.write_outputs

    def crashing(folder):
        write = whole(folder)

        def then_die(batch, number):
            write(batch, number)
            raise RuntimeError("lost after the write, before the commit")

        return then_die

    monkeypatch.setattr(L, "write_outputs", crashing)
    with pytest.raises(Exception, match="lost after the write"):
        L.start(stream_of(spark, f"{base}/in"), f"{base}/out", f"{base}/cp", RULES, available_now=True).awaitTermination()
    monkeypatch.setattr(L, "write_outputs", whole)
    rows.where("event_id >= 500").write.parquet(f"{base}/in/b")
    for _ in range(2):  # a restart without news changes nothing
        L.start(stream_of(spark, f"{base}/in"), f"{base}/out", f"{base}/cp", RULES, available_now=True).awaitTermination()
        frames = L.written(spark, f"{base}/out", "frames")
        assert frames.count() == frames.dropDuplicates(["entity_id", "rule_id", "window_start", "revision"]).count()
        got = {tuple(r[:3]): (r.failures, r.evidence) for r in L.current(frames).select("entity_id", "rule_id", "window_start", "failures", "evidence").collect()}
        assert got == batch_findings(arrivals)


def test_bounds_go_to_backfill(spark):
    rows = [(i, at(i), 1, "failure", 0, at(i)) for i in range(100)] + [(200, at(20), 1, "failure", 1, at(101)), (201, at(99), 1, "success", 1, at(101))]
    folder = L.replay(spark.createDataFrame(rows, SCHEMA + ", received timestamp"), 2, L.Rules(window=3600, lookback=7200, lateness=600, most_events=40))
    got = {(r.event_id, r.reason) for r in L.written(spark, folder, "backfill").collect()}
    assert {i for i, why in got if why == "evicted"} == set(range(61))
    assert {i for i, why in got if why == "beyond_retention"} == {200} and (201, "evicted") not in got
    # the windows were judged before their events went
    frames = {(r.rule_id, r.window_start): r.failures for r in L.current(L.written(spark, folder, "frames")).collect()}
    assert frames["failure-burst", at(0)] == 60 and frames["failure-burst", at(60)] == 40


def test_a_vanished_finding_is_retracted():
    """Only the processor's own state decides: a finding whose window has no finding any more gets a tombstone."""
    import numpy as np

    kept = L.Kept(np.array([1, 2, 3]), np.array([1, 2, 3]), np.array([L.FAILURE] * 3), -(1 << 62))
    assert [f[0] for f in L.judged(kept, 0, RULES)] == ["failure-burst"]
    kept.outcomes[0] = L.UNKNOWN
    assert L.judged(kept, 0, RULES) == []


def test_few_calls_to_the_state_store():
    """An entity with many windows costs one read, one write and one timer a batch; before, each window took several calls."""
    import types

    import numpy as np
    import pandas as pd

    calls, held, timers = [], {}, set()
    state = types.SimpleNamespace(get=lambda: calls.append("get") or held.get("x"), update=lambda x: calls.append("update") or held.update(x=x))
    handle = types.SimpleNamespace(getValueState=lambda *_: state, registerTimer=lambda t: calls.append("timer") or timers.add(t), deleteTimer=lambda t: calls.append("timer") or timers.remove(t))
    x = L.AccountFindings(RULES)
    x.init(handle)
    hours = np.arange(200) * 3_600_000_000 // 4
    clock = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    first = pd.DataFrame({"at": hours, "event_id": np.arange(200), "code": [L.FAILURE] * 200})
    rows = [r for df in x.handleInputRows((1,), iter([first]), clock(0)) for r in df.said]
    assert len(rows) == 1 and calls == ["get", "timer", "update"] and len(timers) == 1
    calls.clear()
    due = timers.pop()
    closed = "".join(r for df in x.handleExpiredTimer((1,), clock(48 * 3_600_000), types.SimpleNamespace(getExpiryTimeInMs=lambda: due)) for r in df.said)
    assert closed.count('"windows"') == 48 and calls == ["get", "timer", "update"] and len(timers) == 1
    again = L.Entity.of(held["x"])
    assert again.due(RULES) == again.timer == timers.pop() and L.Entity.of(again.value()).windows == again.windows


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """A user with more events in the first round than the ten thousand that once were the bound, of whom late ones and a new day come in the second."""
    folder = tmp_path_factory.mktemp("busy")
    kinds = ["error", "view", "purchase", "view", "click"]
    x = [(i, dt.datetime(2024, 1, 10, 6) + dt.timedelta(seconds=i * 5), 1 if i % 100 else 2, kinds[i * 7 % 11 % 5], 1.0, "{}") for i in range(14_000)]
    spark.createDataFrame(x, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["f18_stream_findings", "f18_stream_windows"])
def test_no_event_of_a_busy_entity_is_dropped(spark, busy, name):
    folder, c = busy
    df = entry.queries()[name](spark, folder)
    want = c.execute(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_one_window_of_very_many_events_is_judged_in_order():
    """Successes without failures enough before them cost no pass over all failures; evidence goes out in pieces."""
    import time

    import numpy as np

    n = 200_000
    kept = L.Kept(np.arange(2 * n), np.arange(2 * n), np.repeat([L.SUCCESS, L.FAILURE], n), -(1 << 62))
    then = time.monotonic()
    assert [(f[0], f[3]) for f in L.judged(kept, 0, RULES)] == [("failure-burst", n)]
    assert time.monotonic() - then < 20
    kept.outcomes[-1] = L.SUCCESS
    burst, after = L.judged(kept, 0, RULES)
    assert burst[3] == after[3] == n - 1 and after[4] == [*range(n, 2 * n)]
    out = [{"kind": "frames", "evidence": after[4]}] * 3 + [{"kind": "windows"}] * 700
    said = [x for df in L.AccountFindings.batches((1,), iter(out)) for x in df.said]
    assert [x.count('"kind"') for x in said] == [1, 1, 1, 500, 200]
