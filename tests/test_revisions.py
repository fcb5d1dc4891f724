"""Retractions pass the result contract, negative ages raise, identities escape as JSON does, ranges count hours, cold starts of new versions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from watchloom.operators import analysis as A
from watchloom.operators import publishing as P
from watchloom.operators import search as S


def test_frames_pass_the_contract(spark):
    now = spark.createDataFrame([("k1", "e1", 1, "upsert", "h1", 0.5), ("k2", "e2", 1, "upsert", "h2", 0.4)], "business_key string, entity_id string, revision int, operation string, hash string, score double")
    verdicts = spark.createDataFrame([("k1", "e1", 0.7, "h9")], "business_key string, entity_id string, score double, hash string")
    frames = A.recompute(now, verdicts, "2024-01-30")
    assert {(r.business_key, r.revision, r.operation) for r in frames.collect()} == {("k1", 2, "upsert"), ("k2", 2, "retracted")}
    x = frames.select(F.col("business_key").alias("object_id"), "revision", "operation", F.lit("g1").alias("generation"), F.lit("2024-01-01").cast("timestamp").alias("window_start"), F.struct("score").alias("document"))
    checked = P.validate_results(P.to_envelopes(x, "anomaly", "org", "ns", "rule", "1.0.0", "run"), "org", "ns")
    assert checked.where("error_code is not null").count() == 0
    live = A.risk_contributions(now.select(*frames.columns[:-1]).withColumn("at", F.lit("2024-01-29").cast("timestamp")).unionByName(frames))
    assert {(r.business_key, r.revision): (r.kind, round(r.amount, 6)) for r in live.collect()} == {("k1", 1): ("positive", 0.5), ("k1", 2): ("compensation", 0.2), ("k2", 1): ("positive", 0.4), ("k2", 2): ("reversal", -0.4)}
    with pytest.raises(Exception, match="after the time of risk"):
        A.entity_risk(live, "2024-01-29 12:00:00").collect()


def test_contribution_identity_is_that_of_ascii_json(spark):
    keys = ['a"|b', "né€", "x\U0001f600y", " \x7f", ""]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(P.contribution_id(F.lit("org"), F.col("k"), F.lit(3), F.lit("upsert"))).collect()
    wanted = ["rc:" + hashlib.sha256(json.dumps(["org", k, 3, "upsert"], separators=(",", ":")).encode()).hexdigest() for k in keys]
    assert [r[0] for r in got] == wanted


def test_range_of_31_days(spark):
    df = spark.createDataFrame([("2024-01-05",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert S.scope(df, "t", "2024-01-01", "2024-02-01").count() == 1
    for start, end in (("2024-01-01 00:00:00", "2024-02-01 23:00:00"), ("2024-01-02", "2024-01-01")):
        with pytest.raises(ValueError, match="31 days"):
            S.scope(df, "t", start, end)


def test_cold_starts(spark):
    cols = "organization_id string, model_id string, version string, status string, hash string, created_at string"
    stored = spark.createDataFrame([("o", "m", "1.0", "ready", "h", "1"), ("o", "c", "1.0", "cold_start", "h", "1")], cols)
    new = spark.createDataFrame([("o", "m", "1.1", "cold_start", "x", "2"), ("o", "c", "1.0", "cold_start", "x", "2"), ("p", "m", "1.0", "ready", "x", "2")], cols)
    got = {(r.organization_id, r.model_id): (r.outcome, r.supersedes) for r in P.publish_models(stored, new).collect()}
    assert got == {("o", "m"): ("published", "1.0"), ("o", "c"): ("refreshed", None), ("p", "m"): ("published", None)}
    over = P.publish_models(stored, new.where("version = '1.1'").withColumn("version", F.lit("1.0"))).first()
    assert over.outcome == "refused"
