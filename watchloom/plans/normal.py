"""Registered queries of raw envelopes, standard events, sinks and public views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.functions import values as V
from watchloom.plans.registry import query, table
from watchloom.sources import ingest as I
from watchloom.sources import standard as N

CODES = [e[0] for e in N.WINDOWS_EVENTS] + ["9999"]


def raw_rows(spark, sf_dir) -> DataFrame:
    """Raw envelopes made from events: Windows records, sensor records of four kinds (some shipped), other vendors; faults by event_id."""
    i, k = F.col("event_id"), F.col("event_id") % 8
    code = F.element_at(F.array(*map(F.lit, CODES)), (i % len(CODES) + 1).cast("int"))
    data = F.struct(F.when(i % 3 != 0, "actor").alias("SubjectUserName"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("TargetUserName"), F.lit("S-1-5").alias("TargetSid"), F.lit("member").alias("MemberName"), F.when(i % 2 == 0, "0x0").otherwise("0x6").alias("Status"), F.when(i % 5 == 0, "::ffff:10.0.0.9").when(i % 5 == 1, "nowhere").otherwise("-").alias("IpAddress"))
    winlog = F.struct(F.when(code == "1102", "Microsoft-Windows-Eventlog").otherwise("Microsoft-Windows-Security-Auditing").alias("provider_name"), F.when(i % 11 != 0, "Security").otherwise("System").alias("channel"), code.cast("int").alias("event_id"), F.when(i % 13 != 0, "pc1").alias("computer_name"), data.alias("event_data"))
    windows = F.to_json(F.struct(F.lit("2024-01-01T00:00:00.5Z").alias("@timestamp"), winlog.alias("winlog")))
    kind = F.element_at(F.array(*map(F.lit, ("conn", "dns", "http", "ssl"))), (i % 4 + 1).cast("int"))
    sensor = F.to_json(F.struct((i % 1000).cast("double").alias("ts"), F.when(i % 3 != 0, "C1").alias("uid"), F.when(i % 7 == 0, "a.b").otherwise("10.0.0.1").alias("id.orig_h"), F.lit("fe80::1").alias("id.resp_h"), F.lit("TCP").alias("proto"), (i * 1.0).alias("orig_bytes"), F.lit(5).alias("resp_bytes"), F.when(i % 9 != 0, "x.example").alias("query"), F.lit("h.example").alias("host"), F.when(i % 2 == 0, 404).alias("status_code"), F.lit("s.example").alias("server_name")))
    framed = F.to_json(F.struct(F.struct(F.lit("filebeat").alias("type")).alias("agent"), F.struct(F.concat(F.lit("zeek."), F.when(i % 5 != 0, kind).otherwise("other")).alias("dataset"), sensor.alias("original")).alias("event"), F.when(i % 6 != 0, sensor).otherwise("another").alias("message")))
    payload = F.when(k < 3, windows).when(k < 5, sensor).when(k == 5, framed).when(k == 6, "{broken").otherwise("{}")
    return table(spark, sf_dir, "events").select(
        i.alias("raw_event_id"), F.lit("tenant").alias("organization_id"), F.when(k < 3, "Microsoft").when(k < 6, "zeek").when(k == 6, "zeek").otherwise("acme").alias("vendor_name"), F.lit("p").alias("vendor_product"),
        F.when(k < 3, "windows.security").otherwise(F.concat(F.lit("zeek."), kind)).alias("vendor_dataset"), F.lit("r1").alias("release_id"), payload.alias("payload"),
    )


_W = ", ".join(f"('{c}', '{d}', '{g}', '{a}', {'NULL' if o is None else repr(o)}, '{t}')" for c, d, g, a, o, t in N.WINDOWS_EVENTS)
_C = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
_TARGET, _GROUP = (", ".join(f"'{c}'" for c in x) for x in (N.TARGET_IS_USER, N.GROUP_CHANGES))
#: The standard events of raw_rows in SQL.
STANDARD = f"""w(code, domain, category, action, told, type) AS (VALUES {_W}),
e AS (SELECT *, event_id AS i, event_id % 8 AS k, {_C}[event_id % {len(CODES)} + 1] AS code, ['conn', 'dns', 'http', 'ssl'][event_id % 4 + 1] AS kind FROM events),
win AS (SELECT e.i, w.domain, w.category, w.action, CASE WHEN code IN ('4768', '4769', '4776') THEN CASE WHEN i % 2 = 0 THEN 'success' ELSE 'failure' END ELSE told END AS outcome, w.type,
  CASE WHEN code IN ({_TARGET}) THEN 'u' || user_id WHEN i % 3 <> 0 THEN 'actor' END AS user_name,
  CASE WHEN code IN ({_GROUP}) THEN 'member' WHEN code = '4648' OR w.domain IN ('directory', 'iam') AND code NOT IN ({_TARGET}) THEN 'u' || user_id END AS target_name,
  CASE WHEN code IN ({_GROUP}) THEN 'u' || user_id END AS group_name, CASE WHEN i % 5 = 0 THEN '10.0.0.9' END AS source_ip,
  CASE WHEN i % 11 = 0 THEN 'EVENT_UNSUPPORTED' WHEN i % 13 = 0 THEN 'DIP_WINDOWS_COMPUTER_MISSING' WHEN w.domain IS NULL THEN 'EVENT_UNSUPPORTED' END AS error_code, i % 5 = 1 AS bad_ip FROM e LEFT JOIN w USING (code) WHERE k < 3),
winq AS (SELECT *, concat_ws(',', CASE WHEN user_name IS NULL AND target_name IS NULL AND user_id_missing THEN 'missing_user_identity' END, CASE WHEN bad_ip THEN 'invalid_source_ip' END) AS reasons FROM (SELECT *, target_name IS NULL AS user_id_missing FROM win)),
sen AS (SELECT i, CASE kind WHEN 'conn' THEN 'network' WHEN 'dns' THEN 'dns' WHEN 'http' THEN 'web' ELSE 'tls' END AS domain, CASE kind WHEN 'http' THEN 'web' ELSE 'network' END AS category,
  CASE kind WHEN 'conn' THEN 'network-connection' WHEN 'dns' THEN 'dns-response' WHEN 'http' THEN 'http-request' ELSE 'tls-session' END AS action, CASE WHEN kind = 'http' AND i % 2 = 0 THEN 'failure' ELSE 'unknown' END AS outcome,
  CASE kind WHEN 'conn' THEN 'network.connection' WHEN 'dns' THEN 'dns.response' WHEN 'http' THEN 'web.request' ELSE 'tls.session' END AS type, CASE WHEN i % 7 = 0 THEN 'a.b' ELSE '10.0.0.1' END AS source_ip,
  CASE WHEN k = 5 AND i % 5 = 0 THEN 'DIP_ZEEK_DATASET_MISMATCH' WHEN k = 5 AND i % 6 = 0 THEN 'DIP_ZEEK_ORIGINAL_MISMATCH' WHEN i % 7 = 0 THEN 'UIM_ZEEK_ENDPOINTS_REQUIRED' WHEN kind = 'dns' AND i % 9 = 0 THEN 'UIM_DNS_QUERY_REQUIRED' END AS error_code,
  CASE WHEN i % 3 = 0 THEN 'missing_source_session_id' ELSE '' END AS reasons FROM e WHERE k BETWEEN 3 AND 5),
std AS (SELECT i, domain, category, action, outcome, type, user_name, target_name, group_name, source_ip, error_code, reasons FROM winq
  UNION ALL SELECT i, domain, category, action, outcome, type, NULL, NULL, NULL, source_ip, error_code, reasons FROM sen
  UNION ALL SELECT i, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE k WHEN 6 THEN 'DIP_JSON_INVALID' ELSE 'EVENT_UNSUPPORTED' END, NULL FROM e WHERE k > 5)"""
GOOD = "error_code IS NULL"


@query(f"WITH {STANDARD} SELECT i AS raw_event_id, error_code, CASE WHEN {GOOD} THEN domain END AS domain FROM std")
def n01_dispatch(spark, sf_dir):
    return N.standard_events(raw_rows(spark, sf_dir)).select("raw_event_id", "error_code", F.when(F.col("error_code").isNull(), F.col("domain")).alias("domain"))


@query("SELECT event_id AS raw_event_id, CASE WHEN event_id % 8 = 6 THEN 'DIP_JSON_INVALID' WHEN event_id % 8 = 5 AND event_id % 5 = 0 THEN 'DIP_ZEEK_DATASET_MISMATCH' WHEN event_id % 8 = 5 AND event_id % 6 = 0 THEN 'DIP_ZEEK_ORIGINAL_MISMATCH' END AS error_code FROM events WHERE event_id % 8 BETWEEN 3 AND 6")
def n02_unwrap(spark, sf_dir):
    return N.unwrap_shipped(raw_rows(spark, sf_dir).where("vendor_name = 'zeek'")).select("raw_event_id", "error_code")


@query(f"WITH {STANDARD} SELECT i AS raw_event_id, action, outcome, user_name, target_name, group_name, source_ip FROM winq WHERE {GOOD}")
def n07_windows(spark, sf_dir):
    x = N.standard_events(raw_rows(spark, sf_dir).where("vendor_name = 'Microsoft'")).where(GOOD)
    return x.select("raw_event_id", "action", "outcome", F.col("user.name").alias("user_name"), F.col("target.name").alias("target_name"), F.col("group.name").alias("group_name"), "source_ip")


@query(f"WITH {STANDARD} SELECT 'evt:' || sha256('event-v1|' || i || '|' || type) AS event_id, type AS event_type, domain, category, 'g1' AS generation, i::VARCHAR AS raw_id FROM std WHERE {GOOD}")
def n09_base_fields(spark, sf_dir):
    return N.standard_events(raw_rows(spark, sf_dir)).where(GOOD).select("event_id", "event_type", "domain", F.col("category")[0].alias("category"), "generation", F.col("provenance.raw_event_id").alias("raw_id"))


@query(f"""WITH {STANDARD} SELECT i AS raw_event_id, CASE WHEN error_code IS NOT NULL THEN error_code WHEN i % 17 = 0 THEN 'UIM_COMMON_REQUIRED_FIELD_MISSING' WHEN i % 19 = 0 THEN 'UIM_DOMAIN_UNSUPPORTED' WHEN i % 23 = 0 THEN 'UIM_EVENT_OUTCOME_INVALID' WHEN i % 29 = 0 THEN 'UIM_QUALITY_DETAILS_INVALID' END AS error_code FROM std WHERE domain IS NOT NULL""")
def n11_contract(spark, sf_dir):
    i = F.col("raw_event_id")
    # (a payload that can't be read has no domain of its own)
    x = N.standard_events(raw_rows(spark, sf_dir)).where("domain is not null and not error_code <=> 'DIP_JSON_INVALID'")
    x = x.withColumn("organization_id", F.when(i % 17 != 0, F.col("organization_id"))).withColumn("domain", F.when(i % 19 != 0, F.col("domain")).otherwise("mail")).withColumn("outcome", F.when(i % 23 != 0, F.col("outcome")).otherwise("maybe"))
    broken = F.struct(F.when(F.col("quality.status") == "qualified", "partial").otherwise("qualified").alias("status"), F.col("quality.reasons").alias("reasons"), F.col("quality.usable_for").alias("usable_for"))
    return N.validate_events(x.withColumn("quality", F.when(i % 29 != 0, F.col("quality")).otherwise(broken))).select("raw_event_id", "error_code")


@query(f"WITH {STANDARD} SELECT domain, CASE WHEN category = 'iam' OR domain IN ('authentication', 'session') THEN '2024-01-01' ELSE '1970-01-01' END AS day, count(*) AS n FROM std WHERE {GOOD} GROUP BY ALL")
def n13_route(spark, sf_dir):
    return N.route(N.standard_events(raw_rows(spark, sf_dir))).groupBy("domain", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'TENANT_MISMATCH' WHEN event_id % 5 = 0 THEN 'REQUIRED_FIELD_MISSING' WHEN event_type = 'view' THEN 'OUTCOME_INVALID' WHEN event_id % 7 = 0 THEN 'CATEGORY_INVALID' END AS error_code FROM events""")
def n16_auth_contract(spark, sf_dir):
    i, c = F.col("event_id"), F.lit
    x = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("event_time"), F.when(i % 3 == 0, "other").otherwise("tenant").alias("organization_id"), c("event").alias("kind"), F.when(i % 5 != 0, "logon").alias("action"), c("a").alias("dataset"), c("v").alias("vendor_dataset"), c("1.0.0").alias("schema_version"), F.when(F.col("event_type") == "view", "seen").otherwise("success").alias("outcome"), c("partial").alias("quality"), c("authentication").alias("domain"), F.when(i % 7 == 0, F.array(c("iam"))).otherwise(F.array(c("iam"), c("authentication"))).alias("category"))
    return N.validate_auth_events(x, "tenant").select("event_id", "error_code")


@query(f"WITH {STANDARD} SELECT 'evt:' || sha256('event-v1|' || i || '|' || type) AS event_id, domain, action, source_ip, CASE WHEN i % 8 < 3 THEN 'Microsoft' ELSE 'zeek' END AS vendor, CASE WHEN reasons = '' THEN 'qualified' ELSE 'partial' END AS quality, CASE WHEN reasons = '' THEN '' ELSE reasons END AS reasons FROM std WHERE {GOOD}")
def n17_public_events(spark, sf_dir):
    x = N.public_events(N.standard_events(raw_rows(spark, sf_dir)), "tenant")
    assert not {"payload", "provenance", "raw_event_id"} & set(x.columns)
    return x.select("event_id", "domain", "action", "source_ip", F.col("vendor.name").alias("vendor"), F.col("quality.status").alias("quality"), F.array_join("quality.reasons", ",").alias("reasons"))


@query("SELECT event_id AS raw_event_id, 'zeek' AS vendor_name FROM events WHERE event_id % 8 = 6")
def n19_public_raw(spark, sf_dir):
    return N.public_other(raw_rows(spark, sf_dir).where("payload = '{broken'")).select("raw_event_id", "vendor_name")


# --- envelopes and sinks


def envelopes(spark, sf_dir) -> DataFrame:
    """Envelopes of events with faults by event_id; props is the payload."""
    i, c = F.col("event_id"), F.lit
    x = table(spark, sf_dir, "events").select("event_id", c("1.0.0").alias("schema_version"), F.when(i % 3 == 0, "other").otherwise("tenant").alias("organization_id"), c("ns").alias("namespace"), c("s1").alias("source_instance_id"), F.when(i % 5 == 0, "ctx_x").otherwise("ctx_" + "ab" * 16).alias("source_context_id"),
        i.cast("string").alias("source_position"), c(None).cast("string").alias("delivery_position"), c("e1").alias("source_epoch"), c("v").alias("vendor_name"), c("p").alias("vendor_product"), c("d").alias("vendor_dataset"), F.col("ts").alias("received_at"), c("r1").alias("release_id"),
        F.when(i % 7 == 0, "[1]").otherwise(F.col("props")).alias("payload"), c("json").alias("encoding"))
    wanted = V.stable_id("raw", "raw-v1", *[F.col(k) for k in ("organization_id", "source_instance_id", "vendor_dataset", "source_epoch", "source_position")])
    return I.with_payload_hash(x).withColumn("raw_event_id", F.when(i % 11 == 0, "raw:0").otherwise(wanted)).withColumn("payload_hash", F.when(i % 13 == 0, "0").otherwise(F.col("payload_hash")))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ENVELOPE_SCOPE_MISMATCH' WHEN event_id % 5 = 0 THEN 'ENVELOPE_LINEAGE_INVALID' WHEN event_id % 7 = 0 THEN 'ENVELOPE_PAYLOAD_INVALID' WHEN event_id % 11 = 0 THEN 'ENVELOPE_ID_MISMATCH' WHEN event_id % 13 = 0 THEN 'ENVELOPE_HASH_MISMATCH' END AS error_code FROM events""")
def s03_validate_envelopes(spark, sf_dir):
    return I.validate_envelopes(envelopes(spark, sf_dir), "tenant", "ns").select("event_id", "error_code")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'winlogbeat-v1:' || lower(hex('pc' || event_id)) || ':' || lower(hex('security')) || ':' || event_id || ':2024-01-01T00:00:00.5Z' WHEN 1 THEN 'filebeat-v2:fp:' || event_id WHEN 2 THEN 'filebeat-v1:dev:ino:' || event_id ELSE 'topic:0:' || event_id END AS source_position FROM events""")
def s04_source_position(spark, sf_dir):
    i, k = F.col("event_id"), F.col("event_id") % 4
    win = F.struct(F.lit("2024-01-01T00:00:00.500Z").alias("@timestamp"), F.struct(F.concat(F.lit("PC"), i.cast("string")).alias("computer_name"), F.lit("Security").alias("channel"), i.alias("record_id")).alias("winlog"))
    log = lambda mark: F.struct(F.struct(i.alias("offset"), F.struct(F.lit("dev").alias("device_id"), F.lit("ino").alias("inode"), mark.alias("fingerprint")).alias("file")).alias("log"))
    payload = F.when(k == 0, F.to_json(win)).when(k == 1, F.to_json(log(F.lit("fp")))).when(k == 2, F.to_json(log(F.lit(None).cast("string")))).otherwise("{}")
    return I.with_source_position(table(spark, sf_dir, "events").select("event_id", payload.alias("payload"), F.concat(F.lit("topic:0:"), i.cast("string")).alias("delivery_position"))).select("event_id", "source_position")


@query("""SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN sha256('{"a":' || event_id || '.50,"agent":{"id":"x"},"log":{"file":{},"offset":1},"t":"' || event_type || '","u":"a\\u0026b\\u003cé"}') WHEN event_id % 14 = 0 THEN sha256('[1e2,"x"]') END AS payload_hash FROM events""")
def s06_payload_hash(spark, sf_dir):
    i = F.col("event_id").cast("string")
    flat = F.concat(F.lit('{"t": "'), F.col("event_type"), F.lit('", "log": {"offset": 1, "file": {"inode": '), i, F.lit(', "path": "p", "device_id": 4}}, "agent": {"ephemeral_id": "e'), i, F.lit('", "id": "x"}, "a": 1, "u": "a&b<\\u00e9", "a": '), i, F.lit(".50}"))
    return I.with_payload_hash(table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 14 == 0, ' [ 1e2, "x" ] ').when(F.col("event_id") % 7 == 0, "{no json").otherwise(flat).alias("payload"))).select("event_id", "payload_hash")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'EVENT_JSON_INVALID' WHEN 1 THEN 'EVENT_TIMESTAMP_INVALID' WHEN 2 THEN 'EVENT_AGENT_REQUIRED' WHEN 3 THEN 'EVENT_DATASET_REQUIRED' WHEN 4 THEN 'EVENT_SIZE' END AS error_code FROM events""")
def s09_validate_shipped(spark, sf_dir):
    k = F.col("event_id") % 6
    rec = F.to_json(F.struct(F.when(k == 1, "yesterday").otherwise("2024-01-01T00:00:00Z").alias("@timestamp"), F.struct(F.when(k == 2, "other").otherwise("filebeat").alias("type"), F.lit("8").alias("version"), F.lit("a").alias("id")).alias("agent"), F.struct(F.when(k != 3, "zeek.conn").alias("dataset")).alias("event")))
    return I.validate_shipped(table(spark, sf_dir, "events").select("event_id", F.when(k == 0, "{").when(k == 4, "").otherwise(rec).alias("value"))).select("event_id", "error_code")


@query("""WITH a AS (SELECT event_id, value, 0 AS again FROM events UNION ALL SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value + 1 ELSE value END, 1 FROM events WHERE event_id % 2 = 0)
SELECT CASE WHEN again = 0 AND event_id % 3 <> 0 THEN 'created' WHEN again = 0 THEN 'duplicate' WHEN event_id % 4 = 0 THEN 'conflict' ELSE 'duplicate' END AS outcome, count(*) AS n FROM a WHERE again = 0 OR event_id % 3 = 0 GROUP BY ALL""")
def s10_event_sink(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "value", F.col("event_type").alias("domain"))
    stored = I.new_events(e.where("event_id % 3 = 0")).select("event_id", "day", "hash")
    again = e.where("event_id % 2 = 0 and event_id % 3 = 0").withColumn("value", F.when(F.col("event_id") % 4 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return I.new_events(e.unionByName(again), stored).groupBy(F.col("outcome_").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'topic:' || event_id % 3 || ':' || event_id AS letter_key, 'DIP' AS stage, 'EVENT_UNSUPPORTED' AS code, sha256(props) AS payload_hash FROM events WHERE event_id % 10 = 0""")
def s12_dead_letters(spark, sf_dir):
    i = F.col("event_id")
    x = table(spark, sf_dir, "events").where("event_id % 10 = 0").select(F.lit("topic").alias("topic"), (i % 3).alias("partition"), i.alias("offset"), F.lit("k").alias("key"), F.col("props").alias("value"), i.cast("string").alias("object_id"), F.lit("EVENT_UNSUPPORTED").alias("error_code"))
    return I.to_dead_letters(x, "DIP", "error_code", "error_code").select("letter_key", F.col("failure.stage").alias("stage"), F.col("failure.code").alias("code"), "payload_hash")
