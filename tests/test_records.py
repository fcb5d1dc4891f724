"""Small cases of entity upkeep, the sample store and risk objects that the tables don't hold."""

from pyspark.sql import functions as F

from watchloom.operators import occurrences, records
from watchloom.sources import ingest


def test_unknown_key_and_empty_tables(spark):
    known = spark.createDataFrame([("a", False, 1, None)], "key string, strong boolean, valid_from int, valid_to int")
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 5), (None, 5)], "key string, at int")
    got = {(r.key, r.at): r.outcome for r in occurrences.transfer_weak(known, asked, ["at"]).collect()}
    assert got == {("a", 1): "invalid_end", ("a", 2): "closed", ("a", 3): "no_active_occurrence", ("b", 5): "no_active_occurrence", (None, 5): "no_active_occurrence"}
    assert occurrences.transfer_weak(known, asked.limit(0), ["at"]).count() == 0


def test_bare_endpoint_spellings(spark):
    df = spark.createDataFrame([('{"ts": 1.5, "orig_h": "10.0.0.1", "resp_h": "10.0.0.2", "orig_p": 5, "resp_p": 80}',)], "payload string")
    r = ingest.normalize_conn(df).first()
    assert (r.source_ip, r.destination_ip, r.source_port, r.destination_port, r.error_code) == ("10.0.0.1", "10.0.0.2", 5, 80, None)


def test_close_twice(spark):
    rel = spark.createDataFrame([(1, 1, None), (2, 1, 4)], "relation_id int, valid_from int, valid_to int")
    asked = spark.createDataFrame([(1, 3, 0), (1, 3, 1), (1, 5, 2), (2, 4, 3), (2, 9, 4), (3, 1, 5)], "relation_id int, at int, n int")
    got = {r.n: r.outcome for r in occurrences.close_relations(rel, asked, ["at", "n"]).collect()}
    assert got == {0: "closed", 1: "unchanged", 2: "conflict", 3: "unchanged", 4: "conflict", 5: "missing"}


def test_samples_of_one_batch(spark):
    store = spark.createDataFrame([], "id int, revision int, hash string")
    new = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 2, "y")], "id int, revision int, hash string")
    assert sorted(r.outcome for r in records.merge_samples(store, new).collect()) == ["corrected", "idempotent", "inserted"]


def test_risk_halves_and_ends(spark):
    rows = [("u", "k", 1, 0.9, "2024-01-01"), ("u", "l", 1, 0.0, "2024-01-08"), ("u", "m", 1, 0.0, "2024-02-01")]
    x = spark.createDataFrame(rows, "entity_id string, business_key string, revision int, amount double, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.business_key: (r.object_revision, round(r.risk, 9)) for r in records.risk_objects(x).collect()}
    assert got == {"k": (1, 0.9), "l": (2, 0.45), "m": (3, 0.0)}
