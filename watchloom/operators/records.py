"""Closed feature records: rules on them, complete days, the sample store, and risk objects of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.operators.analysis import entity_risk
from watchloom.operators.merge import merge_versioned


def complete_days(samples: DataFrame, deadline: str, *by: str) -> DataFrame:
    """Distinct UTC days of the samples (window_start) that had ended by the deadline."""
    day = F.date_trunc("day", F.col("window_start"))
    ended = day + F.expr("interval 1 day") <= F.lit(deadline).cast("timestamp")
    return samples.groupBy(*by).agg(F.countDistinct(F.when(ended, day)).alias("complete_days"))


def record_rules(records: DataFrame, n: int) -> DataFrame:
    """A row for each record and rule that holds: a sequence with n failures, or n failures."""
    burst = F.col("failures") >= n
    rules = F.array(F.when(burst & (F.col("failure_then_success") >= 1), F.lit("failure_then_success")), F.when(burst, F.lit("failure_burst")))
    return records.withColumn("rule", F.explode(F.array_compact(rules)))


def merge_samples(store: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Outcome of each sample: inserted, corrected (a higher revision), idempotent, stale_revision or conflict."""
    x = merge_versioned(store, incoming, key).join(store.select(key, F.lit(True).alias("_known")), key, "left")
    first = F.row_number().over(Window.partitionBy(key).orderBy("revision", "hash")) == 1
    written = F.when(F.col("_known").isNull() & first, "inserted").otherwise("corrected")
    named = F.when(F.col("outcome") == "written", written).when(F.col("outcome") == "noop", "idempotent").when(F.col("outcome") == "stale", "stale_revision").otherwise("conflict")
    return x.withColumn("outcome", named).drop("_known")


def risk_view(contributions: DataFrame, at: str) -> DataFrame:
    """Entities with risk left at a time."""
    return entity_risk(contributions, at).where("risk > 0")


def risk_objects(contributions: DataFrame, half_days: float = 7.0, zero_days: int = 30) -> DataFrame:
    """For each contribution: its place in the entity's chain (the object's revision) and the entity's risk at its time.

    The decayed sum over a range of time is a running sum of amounts grown from the
    entity's first contribution, scaled back: one sort of an entity's rows, no self-join.
    Growth stays finite for chains of up to 19 years at a half-life of 7 days.
    """
    entity = Window.partitionBy("entity_id")
    seconds = F.unix_seconds(F.col("at").cast("timestamp"))
    x = contributions.withColumn("_s", seconds).withColumn("_age", (seconds - F.min(seconds).over(entity)) / 86400 / half_days)
    near = entity.orderBy("_s").rangeBetween(-zero_days * 86400, 0)
    risk = F.sum(F.col("amount") * F.pow(F.lit(2.0), "_age")).over(near) * F.pow(F.lit(0.5), "_age")
    place = F.row_number().over(entity.orderBy("_s", "business_key", "revision"))
    return x.withColumn("risk", F.greatest(F.lit(0.0), risk)).withColumn("object_revision", place).drop("_s", "_age")
