"""Result envelopes, their contract and replay; model publishing; risk identities and policies; feedback intake; audit pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.values import first_failing
from watchloom.operators.merge import merge_versioned
from watchloom.operators.search import keyset

OBJECTS = ("feature", "baseline", "anomaly", "risk_event", "entity_risk")


def to_envelopes(df: DataFrame, object_type: str, organization: str, namespace: str, rule_id: str, rule_version: str, run_id: str) -> DataFrame:
    """df(object_id, revision, operation, generation, window_start, document struct) as result envelopes of version 2."""
    c = F.lit
    return df.select(
        c("2.0.0").alias("contract_version"), c(object_type).alias("object_type"), "object_id", F.col("revision").cast("long").alias("revision"), "operation", "generation", c(organization).alias("organization_id"), c(namespace).alias("namespace"),
        c(rule_id).alias("rule_id"), c(rule_version).alias("rule_version"), c(run_id).alias("run_id"), "window_start", F.date_format("window_start", "yyyy-MM-dd").alias("date_key"), F.array().cast("array<struct<object_type:string,object_id:string>>").alias("input_refs"), F.to_json("document").alias("document"),
    )


def validate_results(df: DataFrame, organization: str, namespace: str) -> DataFrame:
    """df of envelopes with the code of the first rule that a row breaks."""
    size = lambda col, n: F.octet_length(F.coalesce(F.col(col), F.lit(""))).between(1, n)
    tenant = lambda col: F.col(col).rlike("^[A-Za-z0-9_-]{1,64}$")
    code = first_failing(
        (F.col("contract_version") == "2.0.0", "CONTRACT_UNSUPPORTED"), (F.col("object_type").isin(*OBJECTS), "OBJECT_TYPE_UNSUPPORTED"), (size("object_id", 256), "OBJECT_ID_INVALID"), (F.col("revision") >= 1, "REVISION_INVALID"),
        (F.col("operation").isin("upsert", "retracted"), "OPERATION_UNSUPPORTED"), (size("generation", 128), "GENERATION_INVALID"), (tenant("organization_id") & tenant("namespace"), "TENANT_MALFORMED"),
        ((F.col("organization_id") == organization) & (F.col("namespace") == namespace), "TENANT_MISMATCH"), (size("rule_id", 256), "RULE_ID_INVALID"), (F.col("rule_version").rlike(r"^\d+\.\d+\.\d+$"), "RULE_VERSION_INVALID"), (size("run_id", 256), "RUN_ID_INVALID"),
        (F.col("window_start").isNotNull(), "WINDOW_START_INVALID"), (F.col("date_key") == F.date_format("window_start", "yyyy-MM-dd"), "DATE_KEY_MISMATCH"), (F.col("input_refs").isNotNull(), "INPUT_REFS_REQUIRED"),
        (F.forall("input_refs", lambda r: (F.coalesce(r["object_type"], F.lit("")) != "") & (F.coalesce(r["object_id"], F.lit("")) != "")), "INPUT_REF_INVALID"), (F.expr("try_variant_get(try_parse_json(document), '$', 'map<string,variant>') is not null"), "DOCUMENT_INVALID"),
    )
    return df.withColumn("error_code", code)


def migrate_v1(df: DataFrame) -> DataFrame:
    """df(result_id, rule_id, rule_version, run_id, document JSON) as envelopes of version 2; without an explicit window start error_code, never a guess."""
    raw = F.coalesce(F.nullif(F.get_json_object("document", "$.detection.window.start"), F.lit("")), F.get_json_object("document", "$.window_start"))
    at = F.when(raw.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(raw))
    x = df.withColumn("window_start", at).withColumn("error_code", F.when(at.isNull(), "LEGACY_WINDOW_MISSING"))
    c = F.lit
    return x.withColumn("contract_version", c("2.0.0")).withColumn("object_type", c("anomaly")).withColumn("object_id", F.col("result_id")).withColumn("revision", c(1)).withColumn("operation", c("upsert")).withColumn("generation", c("legacy-v1")).withColumn("date_key", F.date_format("window_start", "yyyy-MM-dd")).drop("result_id")


def replay_results(results: DataFrame, state: DataFrame) -> DataFrame:
    """(outcome, n) of all results(id, revision, hash, error_code) played against state: written, stale, noop, conflict, skipped (invalid)."""
    played = merge_versioned(state, results.where("error_code is null").select("id", "revision", "hash"))
    return played.select("outcome").unionByName(results.where("error_code is not null").select(F.lit("skipped").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def export_aggregation(df: DataFrame, fmt: str, order: list[str]) -> DataFrame:
    """One JSON line of the rows of an aggregation (a bounded result, such as 10 000 groups); CSV is refused."""
    if fmt != "ndjson":
        raise ValueError("an aggregation is exported as one JSON line only")
    rest = [c for c in df.columns if c not in order]
    return df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *rest)))).alias("line"))


def project(df: DataFrame, kind: str, key: str, columns: list[str]) -> DataFrame:
    """Projection documents of entities, relations or attributions: identity, revision, document and its content hash."""
    document = F.to_json(F.struct(*sorted(columns)))
    return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col("revision"), document.alias("document"), F.sha2(document, 256).alias("hash"))


def publish_models(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Outcome of new(model_id, version, status, hash, created_at) models: published (and whom it supersedes), idempotent, conflict, refreshed (a cold start over the cold start of its version) or refused (a cold start over a version in another state).

    A version is immutable; a cold start of a new version is recorded whatever other
    versions are.  Where the tables have organization_id, it is part of the key.  One
    version of a model is published once a batch.
    """
    key = [c for c in ("organization_id", "model_id") if c in new.columns]
    same = stored.select(*key, "version", F.col("hash").alias("_hash"), F.col("status").alias("_status"))
    last = stored.groupBy(*key).agg(F.max(F.struct("created_at", "version")).alias("_l")).select(*key, F.col("_l.version").alias("_last"))
    x = new.join(same, [*key, "version"], "left").join(last, key, "left")
    cold, there = F.col("status") == "cold_start", F.col("_hash").isNotNull()
    outcome = F.when(cold & there & (F.col("_status") != "cold_start"), "refused").when(F.col("_hash") == F.col("hash"), "idempotent").when(cold & there, "refreshed").when(there, "conflict").otherwise("published")
    return x.withColumn("outcome", outcome).withColumn("supersedes", F.when(outcome == "published", F.col("_last"))).drop("_hash", "_status", "_last")


def contribution_id(organization: Column, key: Column, revision: Column, operation: Column) -> Column:
    """rc:sha256 of the compact JSON list of its parts, all but ASCII as escapes of UTF-16 units."""
    units = lambda x: F.lower(F.hex(F.encode(x, "UTF-16BE")))
    escaped = lambda x: F.concat(F.lit("\\u"), F.left(units(x), F.lit(4)), F.when(F.length(units(x)) > 4, F.concat(F.lit("\\u"), F.right(units(x), F.lit(4)))).otherwise(""))
    plain = lambda c: F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", "")
    # escapes, printable ASCII, and one character each of all else
    parts = lambda c: F.regexp_extract_all(plain(c), F.lit(r"(\\u[0-9A-F]{4}|\\.|[\x20-\x5b\x5d-\x7e]+|[^\x20-\x7e])"))
    written = lambda x: F.when(x.startswith("\\u"), F.lower(x)).when(x.rlike(r"^[\x20-\x7e]"), x).otherwise(escaped(x))
    quoted = lambda c: F.array_join(F.transform(parts(c), written), "")
    return F.concat(F.lit("rc:"), F.sha2(F.concat(F.lit("["), F.concat_ws(",", quoted(organization), quoted(key), revision.cast("string"), quoted(operation)), F.lit("]")), 256))


def risk_by_policy(contributions: DataFrame, policies: DataFrame, at: str, half_days: float = 7.0, zero_days: float = 30.0) -> DataFrame:
    """Decayed risk of each entity where rules have decay policies(rule_id, half_life_days, zero_after_days) of their own, a small table."""
    x = contributions.join(policies, "rule_id", "left")
    half, zero = F.coalesce("half_life_days", F.lit(half_days)), F.coalesce("zero_after_days", F.lit(zero_days))
    age = (F.unix_micros(F.lit(at).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 86400e6
    left = F.when(age < 0, F.raise_error(F.lit("a contribution lies after the time of risk"))).when(age > zero, 0.0).otherwise(F.col("amount") * F.pow(F.lit(0.5), age / half))
    return x.groupBy("entity_id").agg(F.greatest(F.lit(0.0), F.sum(left)).alias("risk"))


def split_tenants(contributions: DataFrame) -> DataFrame:
    """Entities that contributions of several organizations name: each is an error."""
    return contributions.groupBy("entity_id").agg(F.count_distinct("organization_id").alias("organizations")).where("organizations > 1")


def accept_feedback(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Outcome of new feedback: inserted, replayed (its idempotency key is known or came earlier) or rejected with error_code."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    short = lambda c, n: F.octet_length(F.coalesce(F.col(c), F.lit(""))) <= n
    missed = F.col("feedback_type") == "false_negative"
    code = first_failing(
        (F.col("feedback_type").isin("true_positive", "false_positive", "false_negative", "inconclusive") & short("anomaly_id", 256) & short("rule_id", 256) & short("entity_id", 256) & short("reason", 2000) & (F.size(F.coalesce("event_ids", F.array())) <= 100), "FEEDBACK_INVALID"),
        (~has("idempotency_key") | F.octet_length("idempotency_key").between(8, 128), "IDEMPOTENCY_KEY_INVALID"), (missed | has("anomaly_id") | has("target_case_id"), "TARGET_REQUIRED"), (~missed | has("rule_id") & has("entity_id") & has("reason"), "FALSE_NEGATIVE_INCOMPLETE"),
        (F.forall(F.coalesce("event_ids", F.array()), lambda e: F.octet_length(F.coalesce(e, F.lit(""))).between(1, 256)), "EVENT_ID_INVALID"),
    )
    x = new.withColumn("error_code", code)
    keyed = ["organization_id", "idempotency_key"]
    known = existing.where("idempotency_key is not null").select(*keyed).distinct().withColumn("_there", F.lit(True))
    first = F.row_number().over(Window.partitionBy(*keyed, F.col("error_code").isNull()).orderBy("created_at", "id"))
    x = x.withColumn("_n", F.when(has("idempotency_key"), first).otherwise(1)).join(known, keyed, "left")
    return x.withColumn("outcome", F.when(F.col("error_code").isNotNull(), "rejected").when(F.col("_there") | (F.col("_n") > 1), "replayed").otherwise("inserted")).drop("_n", "_there")


def feedback_dataset(evaluation: DataFrame, limit: int = 1000, since: str | None = None, **equal) -> DataFrame:
    """The oldest rows of the evaluation view that fit the filters, at most 1000."""
    for k, v in equal.items():
        evaluation = evaluation.where(F.col(k) == v)
    x = evaluation.where(F.col("created_at") >= F.lit(since).cast("timestamp")) if since else evaluation
    return x.orderBy("created_at", "feedback_id").limit(limit if 1 <= limit <= 1000 else 1000)


def audit_page(df: DataFrame, resource_type: str, resource_id: str, after: tuple | None = None, n: int = 50) -> DataFrame:
    """A page of what happened to a resource, newest first, after the cursor (occurred_at, id)."""
    if not 1 <= n <= 100:
        raise ValueError("a page has 1 to 100 rows")
    x = df.where((F.col("resource_type") == resource_type) & (F.col("resource_id") == resource_id))
    return (x.where(keyset([("occurred_at", False), ("id", False)], after)) if after else x).orderBy(F.desc("occurred_at"), F.desc("id")).limit(n)


def idle_advance(entities: DataFrame, now: str, idle: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """entities(entity_id, max_time, last_received) with the watermark: of an entity silent for so long at least now less the lateness."""
    at = F.lit(now).cast("timestamp")
    floor = F.when(at - F.expr(f"interval {idle}") >= F.col("last_received"), at - F.expr(f"interval {lateness}"))
    return entities.withColumn("watermark", F.greatest(F.col("max_time") - F.expr(f"interval {lateness}"), floor))


def cap_history(df: DataFrame, time: str, key: str, most: int = 10_000) -> DataFrame:
    """df with retained: whether the row is among the latest ones that an entity's state keeps; all others go to backfill."""
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc(time), F.desc(key)))
    return df.withColumn("retained", place <= most)
