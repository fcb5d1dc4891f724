"""Contract cases of standard events, event sinks and the golden vector of window features.

Fixed values: the cases' inputs and codes, and the golden vector, are those of the contract.
"""

import json

from pyspark.sql import functions as F

from watchloom.operators import analysis, publishing
from watchloom.sources import ingest, standard

RAW = "raw_event_id string, organization_id string, vendor_name string, vendor_product string, vendor_dataset string, release_id string, payload string"
CONN = {"ts": 1.5, "uid": "C", "id.orig_h": "10.0.0.1", "id.resp_h": "::1", "proto": "TCP", "orig_bytes": 12.0, "resp_bytes": 3}


def events_of(spark, *rows):
    data = [(str(i), "t", v, "p", d, "r", json.dumps(p)) for i, (v, d, p) in enumerate(rows)]
    return sorted(standard.standard_events(spark.createDataFrame(data, RAW)).collect(), key=lambda r: int(r.raw_event_id))


def windows(code, **data):
    return {"@timestamp": "2024-01-01T00:00:00Z", "winlog": {"provider_name": "Microsoft-Windows-Security-Auditing", "channel": "Security", "event_id": code, "computer_name": "pc", "event_data": data}}


def test_contract_cases(spark):
    got = events_of(
        spark, ("zeek", "zeek.dns", CONN), ("zeek", "zeek.conn", CONN | {"id.orig_h": 42}), ("zeek", "zeek.conn", CONN | {"ts": "yesterday"}), ("other", "x", {}), ("Microsoft", "w", windows(4625, TargetUserName="u")),
        ("zeek", "zeek.conn", CONN), ("zeek", "zeek.http", CONN | {"_path": "conn"}), ("zeek", "zeek.ssl", CONN), ("zeek", "zeek.http", CONN | {"host": "h", "status_code": 500}),
    )
    assert [r.error_code for r in got] == ["UIM_DNS_QUERY_REQUIRED", "UIM_ZEEK_ENDPOINTS_REQUIRED", "UIM_EVENT_TIME_INVALID", "EVENT_UNSUPPORTED", None, None, "DIP_ZEEK_DATASET_MISMATCH", "UIM_TLS_SERVER_NAME_REQUIRED", None]
    assert (got[4].domain, got[4].outcome, got[4].user.name) == ("authentication", "failure", "u")
    assert (got[5].bytes, got[5].transport, got[5].destination_ip, got[8].outcome, got[8].path) == (15, "tcp", "::1", "failure", "/")


def test_windows_roles(spark):
    group = windows(4728, SubjectUserName="admin", TargetUserName="group", TargetSid="S-2", MemberName="new")
    both = windows(4648, SubjectUserName="a", TargetUserName="b", IpAddress="::FFFF:10.0.0.7")
    got = events_of(spark, ("microsoft", "w", group), ("microsoft", "w", both), ("microsoft", "w", windows(4624, IpAddress="nowhere")), ("microsoft", "w", windows(4662)), ("microsoft", "w", windows(4768, TargetUserName="k", Status="0x6")))
    assert (got[0].user.name, got[0].target.name, got[0].group.id) == ("admin", "new", "S-2")
    assert (got[1].user.name, got[1].target.name, got[1].source_ip) == ("a", "b", "::FFFF:10.0.0.7")
    assert got[2].quality.reasons == ["missing_user_identity", "invalid_source_ip"] and got[2].quality.status == "partial"
    assert got[3].error_code == "UIM_ACTOR_REQUIRED" and got[4].outcome == "failure"


def test_addresses(spark):
    texts = {"10.0.0.1": True, "10.0.0.256": False, "010.0.0.1": False, "a.b": False, "::": True, "::1": True, "fe80::1": True, "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7": False, "1::2::3": False, "12345::": False, ":1": False, "": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.ok for r in df.select("t", standard.is_ip(F.col("t")).alias("ok")).collect()} == texts


def test_events_are_written_once(spark, tmp_path):
    path = str(tmp_path / "events")
    df = spark.createDataFrame([(1, "dns", "2024-01-01", 1), (2, "web", "2024-01-02", 2)], "event_id int, domain string, ts string, value int").withColumn("ts", F.col("ts").cast("timestamp"))
    ingest.write_events(df, path)
    ingest.write_events(df.unionByName(df.withColumn("event_id", F.col("event_id") + 2)), path)
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]
    again = ingest.new_events(df.withColumn("value", F.when(F.col("event_id") == 1, 9).otherwise(F.col("value"))), spark.read.parquet(path))
    assert {r.event_id: r.outcome_ for r in again.collect()} == {1: "conflict", 2: "duplicate"}
    bad = spark.createDataFrame([("q1", "2024-01-01"), ("q1", "2024-01-01")], "quarantine_id string, occurred_at string").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    for _ in range(2):
        ingest.write_quarantine(bad, str(tmp_path / "quarantine"))
    assert spark.read.parquet(str(tmp_path / "quarantine")).count() == 1


def test_golden_features(spark):
    rows = [("e1", 1, "failure", "d1", "10.0.0.1"), ("e2", 2, "failure", "d1", "10.0.0.1"), ("e3", 3, "success", "d2", "10.0.0.2"), ("e4", 5, "failure", "d1", "10.0.0.1"), ("e5", 6, None, "d2", "10.0.0.2"), ("e6", 7, "failure", "d1", "10.0.0.2"), ("e7", 8, "success", "d2", "10.0.0.2")]
    df = spark.createDataFrame([("u", i, f"2026-10-12 00:{m:02}:00", o, h, p) for i, m, o, h, p in rows], "entity_id string, event_id string, ts string, outcome string, host_id string, source_ip string").withColumn("ts", F.col("ts").cast("timestamp"))
    r = analysis.auth_features(df, "10 minutes").first()
    assert (r.attempts, r.failures, round(r.failure_rate, 9), r.distinct_devices, r.distinct_ips, r.failure_then_success) == (7, 4, round(4 / 7, 9), 2, 2, 2)


def test_future_and_late_at_their_limits(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:05:00", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:05:01", "2024-01-01 00:00:00")], "id string, ts string, got string").select("id", F.col("ts").cast("timestamp").alias("ts"), F.col("got").cast("timestamp").alias("got"))
    assert {r.id: r.future for r in analysis.split_future(df, "got").collect()} == {"a": False, "b": True}


def test_risk_policies(spark):
    x = spark.createDataFrame([("u", "fast", 1.0, "2024-01-01"), ("v", "slow", 1.0, "2024-01-01")], "entity_id string, rule_id string, amount double, at string")
    policies = spark.createDataFrame([("fast", 1.0, 10.0)], "rule_id string, half_life_days double, zero_after_days double")
    assert {r.entity_id: r.risk for r in publishing.risk_by_policy(x, policies, "2024-01-04").collect()} == {"u": 0.125, "v": 0.5 ** (3 / 7)}
