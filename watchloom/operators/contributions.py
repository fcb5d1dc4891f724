"""Roles of events, attribution identities, contributions and their contract, spaces, relation transfer, history pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.operators.attribution import UNREGISTERED
from watchloom.functions.values import first_failing, stable_id
from watchloom.operators.search import keyset

ROLES = ("actor", "target", "group", "host", "source_device", "destination_device")
STATES = ("resolved", "unresolved", "ambiguous")


def normalize_space(df: DataFrame, column: str = "space") -> DataFrame:
    """df with the canonical name of an identity space (null if it can't be one) and error_code."""
    name = F.lower(F.trim(column))
    ok = name.rlike("^[a-z0-9][a-z0-9._-]{0,127}$")
    return df.withColumn("space_name", F.when(ok, name)).withColumn("error_code", F.when(~F.coalesce(ok, F.lit(False)), "SPACE_NAME_INVALID"))


def roles_from_events(events: DataFrame, account_space: str, device_space: str) -> DataFrame:
    """(event_id, event_time, role, entity_type, space, kind, value): an identifier of each role that an event names.

    events(event_id, event_time, user, target, group: struct<id, name>, host_name, source_ip, destination_ip)
    """
    given = lambda c: F.nullif(F.trim(c), F.lit(""))

    def one(role: str, kind: Column, value: Column, account: bool) -> Column:
        row = F.struct(F.lit(role).alias("role"), F.lit("account" if account else "device").alias("entity_type"), F.lit(account_space if account else device_space).alias("space"), kind.alias("kind"), value.alias("value"))
        return F.when(value.isNotNull(), row)

    found = []
    for role, column in (("actor", "user"), ("target", "target"), ("group", "group")):
        name = given(F.col(column)["name"])
        shape = F.when(F.contains(name, F.lit("\\")), "ntname").when(F.contains(name, F.lit("@")), "upn").otherwise("username")
        found += [one(role, F.lit("sid"), given(F.col(column)["id"]), True), one(role, shape, name, True)]
    found += [one("host", F.lit("hostname"), given(F.col("host_name")), False), one("source_device", F.lit("ip"), given(F.col("source_ip")), False), one("destination_device", F.lit("ip"), given(F.col("destination_ip")), False)]
    rows = events.where(given(F.col("event_id").cast("string")).isNotNull() & F.col("event_time").isNotNull())
    return rows.select("event_id", "event_time", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("event_id", "event_time", "x.*")


def force_unresolved(df: DataFrame, registered: DataFrame, on: list[str]) -> DataFrame:
    """df(state, entity_id, reason, ...) where a row whose space is not registered is unresolved, whatever was found."""
    x = df.join(registered.select(*on).distinct().withColumn("_known", F.lit(True)), on, "left")
    lost = F.col("_known").isNull()
    return x.withColumn("state", F.when(lost, "unresolved").otherwise(F.col("state"))).withColumn("entity_id", F.when(~lost, F.col("entity_id"))).withColumn("reason", F.when(lost, UNREGISTERED).otherwise(F.col("reason"))).drop("_known")


def with_attribution_id(df: DataFrame, mapping_version: str) -> DataFrame:
    """df(event_id, role, state, entity_id, canonical_key, candidates array<string>) with attribution_id, which any of these changes."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    snapshot = F.concat_ws("|", "role", "state", blank("entity_id"), blank("canonical_key"), F.array_join(F.array_sort("candidates"), ","))
    return df.withColumn("attribution_id", stable_id("att", "attribution-v1", F.col("event_id"), snapshot, F.lit(mapping_version)))


def contributions(df: DataFrame, organization: str) -> DataFrame:
    """df(event_id, event_time, state, entity_id, reason, ...) with partition_key and error_code; nothing is filtered.

    Resolved rows are keyed by their entity, all others by state and reason.
    """
    resolved = F.col("state") == "resolved"
    key = F.when(resolved, F.concat_ws(":", F.lit(organization), "entity_id")).otherwise(F.concat_ws(":", F.lit(organization), F.lit("unresolved"), "state", F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown_reason"))))
    code = first_failing((F.col("state").isin(*STATES), "STATE_INVALID"), (~resolved | F.col("entity_id").startswith("ent:"), "RESOLVED_WITHOUT_ENTITY"), (resolved | (F.coalesce("entity_id", F.lit("")) == ""), "UNRESOLVED_WITH_ENTITY"))
    return df.withColumn("organization_id", F.lit(organization)).withColumn("error_code", code).withColumn("partition_key", F.when(code.isNull(), key))


def validate_contributions(df: DataFrame, organization: str) -> DataFrame:
    """df with disposition: eligible (resolved actors, for the account scenarios), skipped (valid others) or rejected, and error_code."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    resolved = F.col("state") == "resolved"
    actor = resolved & (F.col("role") == "actor")
    code = first_failing(
        (F.col("schema_version") == "1.0.0", "SCHEMA_UNSUPPORTED"), (F.col("organization_id") == organization, "CROSS_TENANT"), (has("event_id"), "EVENT_ID_REQUIRED"), (F.col("event_time").isNotNull(), "EVENT_TIME_REQUIRED"),
        (F.col("attribution_id").startswith("att:"), "ATTRIBUTION_ID_INVALID"), (F.col("role").isin(*ROLES), "ROLE_UNKNOWN"), (F.col("state").isin(*STATES), "STATE_UNKNOWN"), (~resolved | F.col("entity_id").startswith("ent:"), "ENTITY_REQUIRED"),
        (resolved | ~has("entity_id"), "ENTITY_FORBIDDEN"), (resolved | has("reason"), "REASON_REQUIRED"), (has("partition_key"), "PARTITION_KEY_REQUIRED"), (~actor | has("outcome"), "OUTCOME_REQUIRED"),
    )
    return df.withColumn("error_code", code).withColumn("disposition", F.when(code.isNotNull(), "rejected").when(actor, "eligible").otherwise("skipped"))


def new_attributions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that an insert-only store still lacks, one of each (organization_id, attribution_id)."""
    key = ["organization_id", "attribution_id"]
    return new.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def transfer_relations(relations: DataFrame, requests: DataFrame) -> DataFrame:
    """relations(relation_id, from_entity, relation_type, to_entity, valid_from, valid_to) after requests(from_entity, relation_type, to_entity, at): the open one ends and a new one begins at the same instant.

    A request that is not after the open relation's start changes nothing.  One request for a relation at a time.
    """
    key = ["from_entity", "relation_type"]
    x = relations.join(requests.select(*key, F.col("to_entity").alias("_to"), "at"), key, "left")
    moved = F.col("valid_to").isNull() & (F.col("at") > F.col("valid_from")) & (F.col("_to") != F.col("to_entity"))
    x = x.withColumn("_moved", F.coalesce(moved, F.lit(False)))
    closed = x.withColumn("valid_to", F.when(F.col("_moved"), F.col("at")).otherwise(F.col("valid_to"))).select(*relations.columns)
    opened = x.where("_moved").withColumn("to_entity", F.col("_to")).withColumn("relation_id", F.concat_ws("@", "relation_id", F.date_format("at", "yyyyMMddHHmmss")))
    opened = opened.withColumn("valid_from", F.col("at")).withColumn("valid_to", F.lit(None).cast("timestamp")).select(*relations.columns)
    return closed.unionByName(opened)


def list_attributions(df: DataFrame, entity: str, time: str, key: str, after: tuple | None = None, n: int = 50) -> DataFrame:
    """A page of an entity's attributions, newest first."""
    x = df.where(F.col("entity_id") == entity)
    return (x.where(keyset([(time, False), (key, False)], after)) if after else x).orderBy(F.desc(time), F.desc(key)).limit(n)


def recent_samples(df: DataFrame, entity: str, n: int = 50) -> DataFrame:
    """The latest windows of an entity, the highest revision of each."""
    last = F.row_number().over(Window.partitionBy("window_start").orderBy(F.desc("revision")))
    return df.where(F.col("entity_id") == entity).withColumn("_n", last).where("_n = 1").drop("_n").orderBy(F.desc("window_start")).limit(min(n, 50))


def baselines_for(models: DataFrame, entity: str) -> DataFrame:
    """Models whose sample range names the entity."""
    return models.where(F.array_contains("sample_range.entities", entity))
