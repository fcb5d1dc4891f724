"""The interval join on one hot identifier, attribution by each reason, relations that never overlap."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from watchloom.operators import attribution as R
from watchloom.operators import relations as L

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_hot_identifier(spark):
    """10 000 intervals and 100 000 events of one identifier: about their sum of pairs is looked at, not their product."""
    base = F.lit("2024-01-01").cast("timestamp")
    n = F.col("id")
    intervals = spark.range(10_000).select(F.lit("k").alias("key"), n.alias("holder"), (base + F.make_dt_interval(mins=n.cast("int") * 10)).alias("valid_from"), (base + F.make_dt_interval(mins=n.cast("int") * 10 + 10)).alias("valid_to"))
    events = spark.range(100_000).select(n.alias("event"), F.lit("k").alias("key"), (base + F.make_dt_interval(mins=n.cast("int"))).alias("at"))
    began = time.time()
    got = R.interval_join(events, intervals, ["key"], "at")
    assert got.where("holder = event div 10").count() == 100_000 == got.count()
    assert time.time() - began < 60
    blocks = R.blocks_of(intervals, ["key"])
    per_block = R.in_blocks(intervals, blocks, ["key"]).groupBy("_block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert per_block[0] <= 64 and per_block[1] <= 12_000


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(3)
    intervals = [(rng.choice("abc"), i, at(s := rng.randrange(5000)), rng.choice([None, at(s + rng.randrange(1, 900)), at(s + 1)])) for i in range(400)] + [("d", 900, at(0), None)]
    events = [(i, rng.choice(["a", "b", "c", "d", "z", None]), rng.choice([at(rng.randrange(-100, 6000)), None])) for i in range(500)]
    left = spark.createDataFrame(events, "event long, key string, at timestamp")
    right = spark.createDataFrame(intervals, "key string, holder long, valid_from timestamp, valid_to timestamp")
    wanted = {(e, h) for e, k, t in events for k2, h, a, b in intervals if k == k2 and t is not None and a <= t and (b is None or t < b)}
    assert {(r.event, r.holder) for r in R.interval_join(left, right, ["key"], "at", per_block=4).collect()} == wanted
    kept = R.interval_join(left, right, ["key"], "at", "left", per_block=4).collect()
    assert {(r.event, r.holder) for r in kept if r.holder is not None} == wanted and {r.event for r in kept} == set(range(500))
    assert all(r.known == sum(k == r.key for k, *_ in intervals) for r in kept)
    assert R.interval_join(left, right.limit(0), ["key"], "at", "left").count() == 500


def test_reasons_and_trail(spark):
    known = [("sid", "s1", "ent:a", True, at(0), None), ("name", "bob", "ent:a", False, at(0), at(100)), ("name", "bob", "ent:b", False, at(100), None), ("name", "eve", "ent:c", False, at(0), at(10)), ("name", "two", "ent:d", False, at(0), None), ("name", "two", "ent:e", False, at(0), None)]
    roles = [
        (1, "sid", "s1", at(5), True, True, None), (1, "name", "bob", at(5), True, True, None), (2, "name", "bob", at(200), True, True, None), (3, "name", "eve", at(50), True, True, None), (4, "name", "nobody", at(5), True, True, None),
        (5, None, None, at(5), False, True, None), (6, None, None, at(5), True, False, None), (7, "name", "two", at(5), True, True, None), (8, "sid", "s1", at(150), True, True, None), (8, "name", "bob", at(150), True, True, None), (9, "sid", "s1", at(5), True, True, R.FAILED),
    ]
    entities = spark.createDataFrame(known, "kind string, canonical string, entity_id string, strong boolean, valid_from timestamp, valid_to timestamp")
    asked = spark.createDataFrame(roles, "role long, kind string, canonical string, at timestamp, identified boolean, valid boolean, failure string")
    got = {r.role: r for r in R.adjudicate(asked, entities, ["kind", "canonical"], ["role"], "at").collect()}
    assert {k: (r.state, r.reason, r.entity_id, r.confidence) for k, r in got.items()} == {
        1: ("resolved", None, "ent:a", 1.0), 2: ("resolved", None, "ent:b", 0.8), 3: ("unresolved", R.NOT_ACTIVE, None, 0.0), 4: ("unresolved", R.NO_MATCH, None, 0.0), 5: ("unresolved", R.NO_IDENTIFIERS, None, 0.0),
        6: ("unresolved", R.INVALID, None, 0.0), 7: ("ambiguous", R.SEVERAL, None, 0.0), 8: ("ambiguous", R.CONFLICT, None, 0.0), 9: ("unresolved", R.FAILED, None, 0.0),
    }
    assert got[1].trail == ["resolved_by_strong_identifier", "strong_identifier_priority_over_weak", "multiple_identifiers_agree"]
    assert got[7].candidates == ["ent:d", "ent:e"] and got[2].valid_from == at(100)


@pytest.mark.parametrize("kind", ["assigned_to", "member_of"])
def test_accepted_relations_never_overlap(spark, kind):
    rng = random.Random(11)
    rows = [(rng.randrange(4), kind, rng.randrange(3), i if rng.random() < 0.9 else i - 1, rng.choice(["assert", "assert", "transfer"]), at(s := rng.randrange(3000)), rng.choice([None, at(s + rng.randrange(-5, 300))]), i) for i in range(600)]
    asked = spark.createDataFrame(rows, "from_id long, type string, to_id long, event_id long, action string, valid_from timestamp, valid_to timestamp, arrival long")
    decided = L.decide(asked)
    outcomes = {r.outcome for r in decided.select("outcome").distinct().collect()}
    assert {"inserted", "conflict_pair", "invalid_interval"} <= outcomes and ("transferred" in outcomes) == (kind == "assigned_to")
    assert decided.count() == 600
    by = {}
    for r in L.accepted(decided).collect():
        by.setdefault((r.from_id, None if kind == "assigned_to" else r.to_id), []).append((r.valid_from, r.valid_to or dt.datetime.max))
    for own in by.values():
        own.sort()
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))


def test_known_relations_and_replay(spark):
    cols = "from_id long, type string, to_id long, event_id long, valid_from timestamp, valid_to timestamp"
    known = spark.createDataFrame([(1, "assigned_to", 7, 1, at(0), None), (2, "assigned_to", 7, 1, at(0), at(10))], cols)
    asked = spark.createDataFrame(
        [(1, "assigned_to", 7, 1, at(0), None, 1), (1, "assigned_to", 7, 1, at(1), None, 2), (1, "assigned_to", 8, 2, at(5), None, 3), (2, "assigned_to", 8, 3, at(10), None, 4), (3, "owns", 1, 4, at(0), None, 5), (None, "assigned_to", 1, 5, at(0), None, 6)], cols + ", arrival long"
    ).withColumn("action", F.lit("assert"))
    got = {r.arrival: r.outcome for r in L.decide(asked, known).collect()}
    assert got == {1: "replayed", 2: "conflict_start", 3: "conflict_holder", 4: "inserted", 5: "unknown_type"}
    assert L.decide(asked.limit(0), known).count() == 0


def test_roles_are_not_written_thrice(spark):
    """Two distinct counts expanded each row of a role to three before the shuffle."""
    asked = spark.createDataFrame([(1, "a", at(1)), (1, "b", at(1))], "role int, canonical string, at timestamp")
    entities = spark.createDataFrame([("a", 7, True, at(0), None), ("b", 7, True, at(0), None)], "canonical string, entity_id long, strong boolean, valid_from timestamp, valid_to timestamp")
    got = R.adjudicate(asked, entities, ["canonical"], ["role"], "at")
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first().trail == ["resolved_by_strong_identifier", "strong_identifier_priority_over_weak", "multiple_identifiers_agree"]


def test_requests_to_close_are_dealt_by_their_number(spark):
    """Tasks grow in number with the requests, not in size."""
    from watchloom.operators import occurrences as O

    rel = spark.createDataFrame([(i, at(0), None) for i in range(100)], "relation_id long, valid_from timestamp, valid_to timestamp")
    asked = spark.createDataFrame([(i, n, at(5 * n)) for i in range(101) for n in range(2)], "relation_id long, n int, at timestamp")
    got = O.close_relations(rel, asked, ["at", "n"], task_rows=10)
    assert got.rdd.getNumPartitions() == 21
    assert {(r.outcome, r["count"]) for r in got.groupBy("outcome").count().collect()} == {("invalid_end", 100), ("closed", 100), ("missing", 2)}
