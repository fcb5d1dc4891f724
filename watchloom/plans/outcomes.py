"""Registered queries of attribution, contributions, result envelopes, model publishing, risk policies, feedback intake and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.operators import contributions as C
from watchloom.operators import publishing as P
from watchloom.operators import search as S
from watchloom.plans.registry import T, events, query, r6, table

L = F.lit


def eid():
    return F.col("event_id")


# --- search


@query("SELECT event_id, event_type FROM events")
def q04_fields(spark, sf_dir):
    return S.fields(table(spark, sf_dir, "events"), ["event_id", "event_type"])


@query("SELECT event_id, user_id, value FROM events ORDER BY user_id, value DESC, event_id LIMIT 200")
def q07_sort(spark, sf_dir):
    return S.head(S.sort(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), [("user_id", True), ("value", False), ("event_id", True)]), 200)


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 17")
def q08_head(spark, sf_dir):
    return S.head(S.sort(table(spark, sf_dir, "events").select("event_id"), [("event_id", False)]), 17)


@query("SELECT event_id, 'partial' AS quality FROM events WHERE event_id % 3 = 0")
def q17_quality(spark, sf_dir):
    return S.with_quality_status(table(spark, sf_dir, "events").select("event_id", F.when(eid() % 3 == 0, "partial").otherwise("qualified").alias("quality")), "partial")


# --- entities and attributions


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type || '.' || user_id END AS space_name, CASE WHEN event_id % 4 = 0 THEN 'SPACE_NAME_INVALID' END AS error_code FROM events")
def e02_normalize_space(spark, sf_dir):
    name = F.when(eid() % 4 == 0, F.concat(L("-"), "event_type")).otherwise(F.concat(L("  "), F.upper("event_type"), L("."), F.col("user_id").cast("string"), L(" ")))
    return C.normalize_space(table(spark, sf_dir, "events").select("event_id", name.alias("space"))).select("event_id", "space_name", "error_code")


@query("""WITH n AS (SELECT c_custkey, 'space' || c_nationkey AS name, CASE WHEN c_custkey % 5 = 0 THEN 'device' ELSE 'account' END AS kind FROM customer), f AS (SELECT name, min(kind) AS first FROM n GROUP BY name)
SELECT c_custkey, CASE WHEN kind <> CASE WHEN name IN ('space1', 'space2') THEN 'account' ELSE first END THEN 'conflict' WHEN name IN ('space1', 'space2') THEN 'idempotent' ELSE 'inserted' END AS outcome FROM n JOIN f USING (name)""")
def e04_register_spaces(spark, sf_dir):
    from watchloom.operators import merge as M

    new = table(spark, sf_dir, "customer").select("c_custkey", F.concat(L("space"), F.col("c_nationkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 5 == 0, "device").otherwise("account").alias("kind"))
    known = new.where("name in ('space1', 'space2')").select("name", L("account").alias("kind")).distinct()
    return M.register(known, new, ["name"], "kind").select("c_custkey", "outcome")


def role_events(spark, sf_dir):
    user = F.struct(F.when(eid() % 3 == 0, F.concat(L("S-1-"), F.col("user_id").cast("string"))).alias("id"), F.when(eid() % 4 == 0, L("dom\\bob")).when(eid() % 4 == 1, L("bob@x")).when(eid() % 4 == 2, L("bob")).alias("name"))
    none = F.struct(L(None).cast("string").alias("id"), L(None).cast("string").alias("name"))
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("event_time"), user.alias("user"), none.alias("target"), none.alias("group"), F.when(eid() % 2 == 0, "pc").alias("host_name"), L("10.0.0.1").alias("source_ip"), L("").alias("destination_ip"))


@query(r"""SELECT role, kind, value, count(*) AS n FROM (SELECT 'actor' AS role, 'sid' AS kind, 'S-1-' || user_id AS value FROM events WHERE event_id % 3 = 0
 UNION ALL SELECT 'actor', ['ntname', 'upn', 'username'][event_id % 4 + 1], ['dom\bob', 'bob@x', 'bob'][event_id % 4 + 1] FROM events WHERE event_id % 4 < 3
 UNION ALL SELECT 'host', 'hostname', 'pc' FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'source_device', 'ip', '10.0.0.1' FROM events) GROUP BY ALL""")
def e07_roles(spark, sf_dir):
    return C.roles_from_events(role_events(spark, sf_dir), "acct", "dev").groupBy("role", "kind", "value").agg(F.count(L(1)).alias("n"))


def attributed(spark, sf_dir):
    state = F.when(eid() % 3 == 0, "resolved").when(eid() % 3 == 1, "ambiguous").otherwise("unresolved")
    ent = F.concat(L("ent:"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        eid().cast("string").alias("event_id"), F.col("ts").alias("event_time"), F.when(eid() % 2 == 0, "actor").otherwise("host").alias("role"), state.alias("state"), F.when(eid() % 3 == 0, ent).alias("entity_id"), F.col("event_type").alias("space"), F.when(eid() % 3 == 1, "multiple").alias("reason"),
        L("k").alias("canonical_key"), F.when(eid() % 3 == 2, F.array().cast("array<string>")).otherwise(F.array(L("ent:z"), ent)).alias("candidates"))


_ATT = """attr AS (SELECT event_id, user_id, event_type, CASE event_id % 2 WHEN 0 THEN 'actor' ELSE 'host' END AS role, ['resolved', 'ambiguous', 'unresolved'][event_id % 3 + 1] AS state, CASE WHEN event_id % 3 = 0 THEN 'ent:' || user_id END AS entity_id, CASE WHEN event_id % 3 = 1 THEN 'multiple' END AS reason FROM events)"""


@query(f"WITH {_ATT} SELECT event_id::VARCHAR AS event_id, CASE WHEN event_type = 'view' THEN 'unresolved' ELSE state END AS state, CASE WHEN event_type <> 'view' THEN entity_id END AS entity_id, CASE WHEN event_type = 'view' THEN 'identity_space_unregistered' ELSE reason END AS reason FROM attr")
def e09_forced_unresolved(spark, sf_dir):
    x = attributed(spark, sf_dir)
    return C.force_unresolved(x, x.where("space <> 'view'"), ["space"]).select("event_id", "state", "entity_id", "reason")


@query(f"""WITH {_ATT}, s AS (SELECT event_id::VARCHAR AS i, role || '|' || state || '|' || coalesce(entity_id, '') || '|k|' || CASE event_id % 3 WHEN 2 THEN '' ELSE 'ent:' || user_id || ',ent:z' END AS snap FROM attr)
SELECT i AS event_id, 'att:' || sha256('14:attribution-v1' || strlen(i) || ':' || i || strlen(snap) || ':' || snap || '2:v1') AS attribution_id FROM s""")
def e10_attribution_id(spark, sf_dir):
    return C.with_attribution_id(attributed(spark, sf_dir), "v1").select("event_id", "attribution_id")


@query(f"WITH {_ATT} SELECT CASE WHEN state = 'resolved' THEN 'org:' || entity_id ELSE 'org:unresolved:' || state || ':' || coalesce(reason, 'unknown_reason') END AS partition_key, count(*) AS n FROM attr GROUP BY ALL")
def e11_contributions(spark, sf_dir):
    return C.contributions(attributed(spark, sf_dir), "org").where("error_code is null").groupBy("partition_key").agg(F.count(L(1)).alias("n"))


@query("SELECT event_id::VARCHAR AS attribution_id FROM events WHERE event_id % 4 <> 0")
def e12_store_attributions(spark, sf_dir):
    new = table(spark, sf_dir, "events").select(L("org").alias("organization_id"), eid().cast("string").alias("attribution_id"))
    return C.new_attributions(new.where("attribution_id % 4 = 0"), new.unionByName(new.where("attribution_id % 2 = 0"))).select("attribution_id")


@query(f"""WITH r AS (SELECT c_custkey::VARCHAR AS relation_id, c_custkey, 'n' || c_nationkey AS to_entity, TIMESTAMP '2024-01-01' AS valid_from FROM customer)
SELECT relation_id, to_entity, {T.format('valid_from')} AS valid_from, CASE WHEN c_custkey % 3 = 0 THEN '2024-02-01 00:00:00' END AS valid_to FROM r
UNION ALL SELECT relation_id || '@20240201000000', 'new', '2024-02-01 00:00:00', NULL FROM r WHERE c_custkey % 3 = 0""")
def e15_transfer_relations(spark, sf_dir):
    k = F.col("c_custkey")
    rel = table(spark, sf_dir, "customer").select(k.cast("string").alias("relation_id"), k.cast("string").alias("from_entity"), L("assigned_to").alias("relation_type"), F.concat(L("n"), F.col("c_nationkey").cast("string")).alias("to_entity"), L("2024-01-01").cast("timestamp").alias("valid_from"), L(None).cast("timestamp").alias("valid_to"))
    # a transfer that is not after the start changes nothing
    asked = rel.where("relation_id % 3 < 2").select("from_entity", "relation_type", L("new").alias("to_entity"), F.when(F.expr("relation_id % 3 = 0"), L("2024-02-01")).otherwise(L("2023-01-01")).cast("timestamp").alias("at"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return C.transfer_relations(rel, asked).select("relation_id", "to_entity", text("valid_from"), text("valid_to"))


@query("SELECT event_id, event_type FROM events WHERE user_id = 7 AND (ts < TIMESTAMP '2024-01-20' OR ts = TIMESTAMP '2024-01-20' AND event_id < 0) ORDER BY ts DESC, event_id DESC LIMIT 30")
def e19_list_attributions(spark, sf_dir):
    import datetime

    x = events(spark, sf_dir)
    return C.list_attributions(x, 7, "ts", "event_id", (datetime.datetime(2024, 1, 20), 0), 30).select("event_id", "event_type")


@query(f"SELECT {T.format('w')} AS window_start, revision, n FROM (SELECT date_trunc('hour', ts) AS w, 1 + count(*) // 2 AS revision, count(*) AS n FROM events WHERE user_id = 7 GROUP BY 1) ORDER BY window_start DESC LIMIT 50")
def e21_recent_samples(spark, sf_dir):
    x = events(spark, sf_dir).groupBy("entity_id", F.date_trunc("hour", "ts").alias("window_start")).agg(F.count(L(1)).alias("n")).withColumn("revision", F.floor(1 + F.floor(F.col("n") / 2)))
    x = x.unionByName(x.withColumn("revision", F.col("revision") - 1))
    return C.recent_samples(x, 7).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "revision", "n")


@query("SELECT event_type AS model_id, count(DISTINCT user_id) AS entities FROM events GROUP BY event_type HAVING count(*) FILTER (user_id = 7) > 0")
def j07_baselines_for(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model_id")).agg(F.struct(F.collect_set("user_id").alias("entities")).alias("sample_range"))
    return C.baselines_for(m, 7).select("model_id", F.size("sample_range.entities").cast("long").alias("entities"))


# --- contributions, streams


@query("SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 5 = 0 THEN 'ROLE_UNKNOWN' WHEN event_id % 3 <> 0 AND event_id % 3 = 2 THEN 'REASON_REQUIRED' WHEN event_id % 3 = 0 AND event_id % 2 = 0 AND event_type = 'view' THEN 'OUTCOME_REQUIRED' END AS error_code, CASE WHEN event_id % 5 = 0 OR event_id % 3 = 2 OR event_id % 6 = 0 AND event_type = 'view' THEN 'rejected' WHEN event_id % 6 = 0 THEN 'eligible' ELSE 'skipped' END AS disposition FROM events")
def f16_validate_contributions(spark, sf_dir):
    x = C.contributions(C.with_attribution_id(attributed(spark, sf_dir), "v1"), "org").drop("error_code").withColumn("schema_version", L("1.0.0"))
    x = x.withColumn("role", F.when(F.expr("event_id % 5 = 0"), "owner").otherwise(F.col("role"))).withColumn("outcome", F.when(F.col("space") != "view", "success"))
    return C.validate_contributions(x, "org").select("event_id", "error_code", "disposition")


@query(f"WITH m AS (SELECT user_id AS entity_id, max(ts) AS t FROM events GROUP BY 1) SELECT entity_id, {T.format('''CASE WHEN t <= TIMESTAMP '2024-01-29 23:55:00' THEN greatest(t, TIMESTAMP '2024-01-30') ELSE t END - INTERVAL 10 MINUTE''')} AS watermark FROM m")
def f08_idle_advance(spark, sf_dir):
    x = events(spark, sf_dir).groupBy("entity_id").agg(F.max("ts").alias("max_time")).withColumn("last_received", F.col("max_time"))
    return P.idle_advance(x, "2024-01-30").select("entity_id", F.date_format("watermark", "yyyy-MM-dd HH:mm:ss").alias("watermark"))


@query("SELECT user_id AS entity_id, least(count(*), 20) AS kept, greatest(count(*) - 20, 0) AS backfilled FROM events GROUP BY 1")
def f11_state_caps(spark, sf_dir):
    x = P.cap_history(events(spark, sf_dir), "ts", "event_id", 20)
    return x.groupBy("entity_id").agg(F.count_if("retained").alias("kept"), F.count_if(~F.col("retained")).alias("backfilled"))


# --- results


def results(spark, sf_dir):
    x = events(spark, sf_dir).select(F.concat(L("a:"), eid().cast("string")).alias("object_id"), (eid() % 4 + 1).alias("revision"), L("upsert").alias("operation"), L("g1").alias("generation"), F.col("ts").alias("window_start"), F.struct("value").alias("document"))
    return P.to_envelopes(x, "anomaly", "org", "ns", "rule", "1.0.0", "run")


@query("SELECT 'a:' || event_id AS object_id, strftime(ts, '%Y-%m-%d') AS date_key, event_id % 4 + 1 AS revision, 'anomaly' AS object_type FROM events")
def f17_envelopes(spark, sf_dir):
    return results(spark, sf_dir).select("object_id", "date_key", "revision", "object_type")


@query("SELECT 'a:' || event_id AS object_id, CASE WHEN event_id % 4 = 0 THEN 'REVISION_INVALID' WHEN event_id % 5 = 0 THEN 'TENANT_MISMATCH' WHEN event_id % 7 = 0 THEN 'RULE_VERSION_INVALID' WHEN event_id % 11 = 0 THEN 'DATE_KEY_MISMATCH' WHEN event_id % 13 = 0 THEN 'DOCUMENT_INVALID' END AS error_code FROM events")
def s16_validate_results(spark, sf_dir):
    n = F.split("object_id", ":")[1].cast("long")
    x = results(spark, sf_dir).withColumn("revision", F.col("revision") - 1).withColumn("organization_id", F.when(n % 5 == 0, "other").otherwise("org")).withColumn("rule_version", F.when(n % 7 == 0, "one").otherwise("1.0.0"))
    x = x.withColumn("date_key", F.when(n % 11 == 0, "2020-01-01").otherwise(F.col("date_key"))).withColumn("document", F.when(n % 13 == 0, "[1]").otherwise(F.col("document")))
    return P.validate_results(x, "org", "ns").select("object_id", "error_code")


@query("SELECT event_id::VARCHAR AS object_id, CASE WHEN event_id % 3 < 2 THEN strftime(ts, '%Y-%m-%d') END AS date_key, CASE WHEN event_id % 3 = 2 THEN 'LEGACY_WINDOW_MISSING' END AS error_code FROM events")
def s17_migrate_v1(spark, sf_dir):
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    document = F.when(eid() % 3 == 0, F.to_json(F.struct(F.struct(F.struct(at.alias("start")).alias("window")).alias("detection")))).when(eid() % 3 == 1, F.to_json(F.struct(at.alias("window_start")))).otherwise("{}")
    x = table(spark, sf_dir, "events").select(eid().cast("string").alias("result_id"), L("r").alias("rule_id"), L("1.0.0").alias("rule_version"), L("run").alias("run_id"), document.alias("document"))
    return P.migrate_v1(x).select("object_id", "date_key", "error_code")


@query("SELECT CASE WHEN event_id % 7 = 0 THEN 'skipped' WHEN event_id % 3 <> 0 THEN 'written' WHEN event_id % 2 = 0 THEN 'stale' ELSE 'noop' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def s18_replay_results(spark, sf_dir):
    x = table(spark, sf_dir, "events").select(eid().alias("id"), L(2).alias("revision"), F.sha2("props", 256).alias("hash"), F.when(eid() % 7 == 0, "REVISION_INVALID").alias("error_code"))
    state = x.where("id % 3 = 0").select("id", F.expr("if(id % 2 = 0, 3, 2)").alias("revision"), "hash")
    return P.replay_results(x, state)


@query("""SELECT '[' || string_agg('{"event_type":"' || event_type || '","n":' || n || '}', ',' ORDER BY event_type) || ']' AS line FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def s20_export_aggregation(spark, sf_dir):
    return P.export_aggregation(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(L(1)).alias("n")), "ndjson", ["event_type"])


@query("""SELECT 'entity' AS kind, c_custkey::VARCHAR AS id, sha256('{"c_nationkey":' || c_nationkey || ',"revision":1}') AS hash FROM customer""")
def s15_projections(spark, sf_dir):
    return P.project(table(spark, sf_dir, "customer").withColumn("revision", L(1)), "entity", "c_custkey", ["revision", "c_nationkey"]).select("kind", "id", "hash")


# --- models, risk, feedback


@query("""SELECT p_partkey AS model_id, CASE p_partkey % 5 WHEN 0 THEN 'idempotent' WHEN 1 THEN 'conflict' WHEN 2 THEN 'published' WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 'published' ELSE 'refused' END ELSE 'refreshed' END AS outcome, CASE WHEN p_partkey % 5 = 2 OR p_partkey % 10 = 8 THEN '1.0' END AS supersedes FROM part""")
def b07_publish_models(spark, sf_dir):
    k = F.col("p_partkey")
    new = table(spark, sf_dir, "part").select(k.alias("model_id"), F.when(k % 5 == 2, "1.1").when(k % 10 == 8, "1.1").otherwise("1.0").alias("version"), F.when(k % 5 >= 3, "cold_start").otherwise("ready").alias("status"), F.when(k % 5 == 0, "h").otherwise("other").alias("hash"), L("2024-02-01").alias("created_at"))
    stored = new.select("model_id", L("1.0").alias("version"), F.when(F.col("model_id") % 5 == 4, "cold_start").otherwise("ready").alias("status"), L("h").alias("hash"), L("2024-01-01").alias("created_at"))
    return P.publish_models(stored, new).select("model_id", "outcome", "supersedes")


@query("SELECT 'baseline' AS object_type, p_partkey::VARCHAR AS object_id, '2024-01-01' AS date_key FROM part WHERE p_partkey % 2 = 0")
def b10_baseline_envelopes(spark, sf_dir):
    new = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("model_id"), L("1.0").alias("version"), L("ready").alias("status"), L("h").alias("hash"), L("2024-02-01").alias("created_at"))
    fresh = P.publish_models(new.where("model_id % 2 = 1"), new).where("outcome = 'published'")
    x = fresh.select(F.col("model_id").cast("string").alias("object_id"), L(1).alias("revision"), L("upsert").alias("operation"), L("g1").alias("generation"), L("2024-01-01").cast("timestamp").alias("window_start"), F.struct("version", "status").alias("document"))
    return P.to_envelopes(x, "baseline", "org", "ns", "rule", "1.0.0", "run").select("object_type", "object_id", "date_key")


@query("""WITH x AS (SELECT event_id, event_id % 3 + 1 AS revision, CASE WHEN event_id % 4 = 0 THEN 'one' ELSE 'two' END AS hash FROM events)
SELECT CASE WHEN revision = 3 THEN 'written' WHEN revision < 2 THEN 'stale' WHEN hash = 'one' THEN 'noop' ELSE 'conflict' END AS outcome, count(*) AS n FROM x GROUP BY ALL""")
def r04_apply_frames(spark, sf_dir):
    from watchloom.operators import merge as M

    x = table(spark, sf_dir, "events").select(eid().alias("business_key"), (eid() % 3 + 1).alias("revision"), F.when(eid() % 4 == 0, "one").otherwise("two").alias("hash"))
    state = x.select("business_key", L(2).alias("revision"), L("one").alias("hash"))
    return M.merge_versioned(state, x, "business_key").groupBy("outcome").agg(F.count(L(1)).alias("n"))


@query("""SELECT event_id, 'rc:' || sha256('["org","' || event_type || '\\"|",' || event_id % 3 || ',"upsert"]') AS contribution_id FROM events""".replace("\\\\", "\\"))
def r08_contribution_id(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", P.contribution_id(L("org"), F.concat("event_type", L('"|')), eid() % 3, L("upsert")).alias("contribution_id"))


@query("""SELECT user_id AS entity_id, round(greatest(0, sum(CASE WHEN age > CASE WHEN event_type = 'view' THEN 10 ELSE 30 END THEN 0 ELSE value * pow(0.5, age / CASE WHEN event_type = 'view' THEN 1 ELSE 7 END) END)), 6) AS risk FROM (SELECT *, (epoch_us(TIMESTAMP '2024-02-05') - epoch_us(ts)) / 86400e6 AS age FROM events) GROUP BY 1""")
def r10_risk_by_policy(spark, sf_dir):
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("rule_id"), F.col("value").alias("amount"), F.col("ts").alias("at"))
    policies = spark.createDataFrame([("view", 1.0, 10.0)], "rule_id string, half_life_days double, zero_after_days double")
    return P.risk_by_policy(x, policies, "2024-02-05").select("entity_id", r6("risk").alias("risk"))


@query("SELECT user_id AS entity_id, 2::BIGINT AS organizations FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 40 = 0) > 1")
def r13_split_tenants(spark, sf_dir):
    return P.split_tenants(table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.when(eid() % 40 == 0, "b").otherwise("a").alias("organization_id")))


@query("""SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'rejected' WHEN event_id % 2 = 0 THEN 'replayed' ELSE 'inserted' END AS outcome, CASE WHEN event_id % 5 <> 0 THEN NULL WHEN event_id % 3 = 0 THEN 'FALSE_NEGATIVE_INCOMPLETE' WHEN event_id % 3 = 1 THEN 'FEEDBACK_INVALID' ELSE 'TARGET_REQUIRED' END AS error_code FROM events""")
def v05_accept_feedback(spark, sf_dir):
    bad = eid() % 5 == 0
    kind = F.when(bad & (eid() % 3 == 0), "false_negative").when(bad & (eid() % 3 == 1), "maybe").otherwise("true_positive")
    x = table(spark, sf_dir, "events").select(eid().alias("id"), L("org").alias("organization_id"), kind.alias("feedback_type"), F.when(~bad, "anom:1").alias("anomaly_id"), L(None).cast("string").alias("target_case_id"), L("r").alias("rule_id"), L(None).cast("string").alias("entity_id"), L("why").alias("reason"), F.array(L("e1")).alias("event_ids"), F.concat(L("key-0000-"), eid().cast("string")).alias("idempotency_key"), F.col("ts").alias("created_at"))
    return P.accept_feedback(x.where("id % 2 = 0"), x).select("id", "outcome", "error_code")


@query("SELECT doc_id AS feedback_id, 'quality' AS feedback_type FROM labels WHERE quality = 1 ORDER BY doc_id LIMIT 1000")
def v03_feedback_dataset(spark, sf_dir):
    x = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("feedback_id"), F.when(F.col("quality") == 1, "quality").otherwise("other").alias("feedback_type"), L("2024-01-01").cast("timestamp").alias("created_at"))
    return P.feedback_dataset(x, feedback_type="quality").select("feedback_id", "feedback_type")


@query("SELECT event_id AS id, event_type AS action FROM events WHERE user_id = 3 AND (ts, event_id) < (TIMESTAMP '2024-01-20', 0) ORDER BY ts DESC, event_id DESC LIMIT 40")
def v10_audit_page(spark, sf_dir):
    import datetime

    x = table(spark, sf_dir, "events").select(eid().alias("id"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("occurred_at"), L("case").alias("resource_type"), F.col("user_id").cast("string").alias("resource_id"))
    return P.audit_page(x, "case", "3", (datetime.datetime(2024, 1, 20), 0), 40).select("id", "action")
