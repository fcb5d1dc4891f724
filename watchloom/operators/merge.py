"""Versioned merges, append-only history and idempotent receipts: the one place for their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_versioned(state: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Outcome of each incoming row(key, revision, hash) against state and the rows before it.

    written: the first row of the key or a higher revision; noop: the revision and
    content that stand; conflict: that revision with other content; stale: lower.
    Order inside the batch is (revision, hash), so the outcome does not depend on
    arrival.  Shuffles by key.
    """
    old = state.select(key, F.col("revision").alias("r0"), F.col("hash").alias("h0"))
    by = Window.partitionBy(key).orderBy("revision", "hash")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    x = incoming.join(old, key, "left").withColumn("_r", F.max("revision").over(before)).withColumn("_h", F.min_by("hash", F.struct(-F.col("revision"), "hash")).over(before))
    use = F.coalesce(F.col("_r") > F.col("r0"), F.col("r0").isNull() & F.col("_r").isNotNull())
    r, h = F.when(use, F.col("_r")).otherwise(F.col("r0")), F.when(use, F.col("_h")).otherwise(F.col("h0"))
    outcome = F.when(r.isNull() | (F.col("revision") > r), "written").when(F.col("revision") < r, "stale").when(F.col("hash") == h, "noop").otherwise("conflict")
    return x.withColumn("outcome", outcome).drop("r0", "h0", "_r", "_h")


def merged_state(state: DataFrame, outcomes: DataFrame, key: str = "id") -> DataFrame:
    """The highest written revision of each key, else the one that stood."""
    rows = state.unionByName(outcomes.where("outcome = 'written'").drop("outcome"), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("revision"), "hash"))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def append_history(history: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Outcome (appended, noop, conflict) of rows that go to an append-only history; shuffles by key."""
    old = history.select(*key, F.col("hash").alias("h0"))
    first = F.min("hash").over(Window.partitionBy(*key))
    x = incoming.withColumn("_f", first).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("hash"))).join(old, key, "left")
    stands = F.coalesce("h0", "_f")
    return x.withColumn("outcome", F.when(F.col("hash") != stands, "conflict").when(F.col("h0").isNull() & (F.col("_n") == 1), "appended").otherwise("noop")).drop("h0", "_f", "_n")


def classify_receipts(df: DataFrame, key: list[str], time: str, order: str) -> DataFrame:
    """First arrival accepted; later: duplicate if content and context are equal, else conflict."""
    w = Window.partitionBy(*key).orderBy(time, order)
    first = F.first(F.struct("hash", "context")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("_f", first)
    return out.withColumn("outcome", F.when(F.col("_n") == 1, "accepted").when(F.struct("hash", "context") == F.col("_f"), "duplicate").otherwise("conflict")).drop("_n", "_f")


def register(existing: DataFrame, new: DataFrame, key: list[str], content: str) -> DataFrame:
    """Immutable registrations (spaces, rule versions): inserted, idempotent or conflict."""
    old = existing.select(*key, F.col(content).alias("_old"))
    first = F.min(content).over(Window.partitionBy(*key))
    x = new.withColumn("_first", first).join(old, key, "left")
    stands = F.coalesce("_old", "_first")
    return x.withColumn("outcome", F.when(F.col(content) != stands, "conflict").when(F.col("_old").isNull(), "inserted").otherwise("idempotent")).drop("_old", "_first")
