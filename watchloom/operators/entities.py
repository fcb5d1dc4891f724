"""Identifiers, entities, attribution over validity intervals, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.values import stable_id

# Identifier kinds from the strongest to the weakest; agent_id is the last strong one.
KINDS = ("sid", "guid", "device_uuid", "agent_id", "ntname", "upn", "email", "username", "hostname", "ip")
PRIORITY = {k: len(KINDS) - i for i, k in enumerate(KINDS)}


def normalize_identifiers(df: DataFrame) -> DataFrame:
    """(kind, value) in canonical form; invalid ones are null with a reason; strong from agent_id on."""
    v, kind = F.trim("value"), F.col("kind")
    low = F.lower(v)
    plain = F.btrim(low, F.lit("{}"))
    form = (
        F.when(kind == "sid", F.when(F.upper(v).rlike(r"^S-\d+(-\d+)+$"), F.upper(v)))
        .when(kind.isin("guid", "device_uuid"), F.when(plain.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), plain))
        .when(kind == "ntname", F.when(low.rlike(r"^[^\\]+\\[^\\]+$"), low))
        .when(kind.isin("upn", "email"), F.when(low.rlike(r"^[^@\s]+@[^@\s]+$"), low))
        .when(kind == "hostname", F.nullif(F.rtrim(low, F.lit(".")), F.lit("")))
        .when(kind == "ip", F.when(low.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}$") | low.rlike("^[0-9a-f:]*:[0-9a-f:.]+$"), F.regexp_replace(low, "^::ffff:", "")))
        .when(kind.isin("agent_id", "username"), F.nullif(low, F.lit("")))
    )
    reason = F.when(~kind.isin(*KINDS), "kind_unknown").when(v.isNull() | (v == ""), "value_missing").when(form.isNull(), "value_invalid")
    return df.withColumn("canonical", form).withColumn("reason", reason).withColumn("strong", kind.isin(*KINDS[:4]))


def select_canonical(df: DataFrame, key: str) -> DataFrame:
    """The strongest identifier of each observation; two values of one kind are a contradiction."""
    rank = F.element_at(F.create_map(*[x for k, p in PRIORITY.items() for x in (F.lit(k), F.lit(p))]), F.col("kind"))
    kinds = df.where("canonical is not null").groupBy(key, "kind").agg(F.min("canonical").alias("canonical"), (F.countDistinct("canonical") > 1).alias("twice"))
    return kinds.groupBy(key).agg(F.max_by(F.struct("kind", "canonical"), rank).alias("x"), F.max("twice").alias("contradiction")).select(key, "x.kind", "x.canonical", "contradiction")


def register_entities(seen: DataFrame, known: DataFrame, org: str) -> DataFrame:
    """New occurrences: the first sighting of each key that has no open one; a closed key gets the next number."""
    first = seen.groupBy("entity_type", "space", "canonical").agg(F.min("ts").alias("valid_from"))
    base = known.groupBy("entity_type", "space", "canonical").agg(F.max("occurrence").alias("last"), F.max(F.col("valid_to").isNull().cast("int")).alias("open"))
    new = first.join(base, ["entity_type", "space", "canonical"], "left").where("open is null or open = 0").withColumn("occurrence", (F.coalesce("last", F.lit(0)) + 1).cast("int"))
    key = F.when(F.col("occurrence") > 1, F.concat("canonical", F.lit("#"), F.col("occurrence").cast("string"))).otherwise(F.col("canonical"))
    return new.select(stable_id("ent", "entity-v1", F.lit(org), F.col("entity_type"), F.col("space"), key).alias("entity_id"), "entity_type", "space", "canonical", "occurrence", "valid_from")


def history_intervals(df: DataFrame, key: list[str], start: str, tie: list[str]) -> DataFrame:
    """Half-open validity [valid_from, valid_to) of each holder until the next one of its key; empty ones dropped."""
    w = Window.partitionBy(*key).orderBy(start, *tie)
    x = df.withColumn("valid_from", F.col(start)).withColumn("valid_to", F.lead(start).over(w))
    return x.where("valid_to is null or valid_from < valid_to")


def in_interval(t: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (t >= F.col(start)) & (F.col(end).isNull() | (t < F.col(end)))


def overlapping(rel: DataFrame, key: list[str], row: list[str]) -> DataFrame:
    """Adds overlaps: an earlier interval of the same key is still open when this one starts.  One sort a key, no self-join."""
    end = F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp"))
    before = F.max(end).over(Window.partitionBy(*key).orderBy("valid_from", *row).rowsBetween(Window.unboundedPreceding, -1))
    return rel.withColumn("overlaps", F.coalesce(before > F.col("valid_from"), F.lit(False)))


def relations_at(rel: DataFrame, at: str) -> DataFrame:
    return rel.where(in_interval(F.lit(at).cast("timestamp")))


def role_counts(attributions: DataFrame, start: str, end: str) -> DataFrame:
    """Resolved attributions by entity and role in [start, end)."""
    t = F.col("ts")
    x = attributions.where((F.col("state") == "resolved") & (t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp")))
    return x.groupBy("entity_id", "role").agg(F.count(F.lit(1)).alias("n"))


def single_entity_features(attributions: DataFrame, rel: DataFrame, start: str, end: str, ends: tuple[str, str] = ("source_id", "target_id")) -> DataFrame:
    """Resolved attributions in [start, end) by role and in all, and the relations at the end, of either direction.

    Entities without relations keep their counts; both sides are grouped before they meet.
    """
    roles = role_counts(attributions, start, end).groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("by_role"), F.sum("n").alias("resolved_total"))
    held = relations_at(rel, end).select(F.explode(F.array_distinct(F.array(*ends))).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("relations"))
    return roles.join(held, "entity_id", "left").withColumn("relations", F.coalesce("relations", F.lit(0)))
