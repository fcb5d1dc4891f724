"""Registered queries of finding documents, the older rule, result views and features of single entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions import values as V
from watchloom.operators import analysis as A
from watchloom.operators import entities as E
from watchloom.operators import findings as G
from watchloom.plans.registry import BURST, EV, HOLD, T, events, holders, query

L = F.lit
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"

V1 = f"""{EV}, f AS (SELECT a.entity_id, a.event_id, a.ts, time_bucket(INTERVAL 30 MINUTE, a.ts) AS w, list(b.event_id::VARCHAR) AS e, count(*) AS failures FROM ev a JOIN ev b ON a.entity_id = b.entity_id AND b.outcome = 'failure'
 AND b.ts >= a.ts - INTERVAL 3 DAY AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) WHERE a.outcome = 'success' GROUP BY ALL HAVING count(*) >= 3),
 v1 AS (SELECT *, 'anom:' || sha256('tenant|' || entity_id || '|' || {ISO.format('w')} || '|auth.failure-then-success@1.0.0') AS finding_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, w ORDER BY ts, event_id) AS n FROM f) WHERE n = 1)"""


@query(f"""WITH {BURST.format(n=3)} SELECT entity_id, {ISO.format('w')} AS window_start, {ISO.format("w + INTERVAL 1 DAY")} AS at, failures AS threshold_over, len(e) AS evidence_count, failures || ' failures in one day' AS summary,
 CASE WHEN entity_id % 5 = 0 THEN 'explanation_missing' WHEN entity_id % 7 = 0 THEN 'features_missing' END AS violation FROM bu""")
def d05_finding_documents(spark, sf_dir):
    burst = A.failure_burst(events(spark, sf_dir), 3, "1 day").withColumn("window_end", F.col("at"))
    x = A.to_findings(burst, "tenant", "failure-burst", "g1", L(0.9))
    reasons = F.when(F.col("entity_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(L("AUTH_FAILURE_BURST")))
    version = F.when(F.col("entity_id") % 7 != 0, "v1")
    summary = F.concat(F.col("failures").cast("string"), L(" failures in one day"))
    got = G.finding_documents(x, "tenant", "g1", F.col("rule_id"), L("1.0.0"), L("high"), F.create_map(L("failures"), L(3)), F.create_map(L("failures"), F.col("failures")), version, reasons, summary)
    d = F.col("document")
    return got.select("entity_id", d["detection"]["window"]["start"].alias("window_start"), d["@timestamp"].alias("at"), d["features"]["values"]["failures"].alias("threshold_over"), d["evidence"]["count"].cast("long").alias("evidence_count"), d["explanation"]["summary"].alias("summary"), "violation")


@query(f"WITH {V1} SELECT entity_id, {T.format('w')} AS window_start, {T.format('ts')} AS at, failures, array_to_string(list_sort(list_append(e, event_id::VARCHAR)), ',') AS evidence, finding_id, failures || ' failed logins followed by a successful login within 30 minutes' AS summary FROM v1")
def d08_failure_then_success_v1(spark, sf_dir):
    x = G.failure_then_success_v1(events(spark, sf_dir), "tenant", 3, "3 days")
    return x.select("entity_id", V.text_time(F.col("window_start")).alias("window_start"), V.text_time(F.col("at")).alias("at"), "failures", F.array_join("evidence", ",").alias("evidence"), "finding_id", "summary")


@query(f"""WITH {V1} SELECT finding_id AS result_id, 'auth.failure-then-success' AS rule_id, '1.0.0' AS rule_version, '{{"entity":"' || entity_id || '","score":1.0}}' AS document FROM v1""")
def d10_business_view(spark, sf_dir):
    x = G.failure_then_success_v1(events(spark, sf_dir), "tenant", 3, "3 days")
    analysis = F.struct(F.concat(L("replay:"), F.col("finding_id")).alias("run_id"))
    results = x.select(F.col("finding_id").alias("result_id"), L(G.RULE_V1).alias("rule_id"), L(G.VERSION_V1).alias("rule_version"), F.struct(F.col("entity_id").cast("string").alias("entity"), "score", analysis.alias("analysis")).alias("document"))
    return G.business_view(results).withColumn("document", F.to_json("document"))


@query(f"""WITH {EV}, {HOLD}, r AS (SELECT entity_id, count(*) AS resolved_total, count(*) FILTER (outcome = 'failure') AS failures FROM ev WHERE outcome <> 'unknown' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL),
 e AS (SELECT supp AS entity_id, part FROM h WHERE valid_from <= TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20')), b AS (SELECT entity_id FROM e UNION ALL SELECT part FROM e WHERE part <> entity_id), c AS (SELECT entity_id, count(*) AS n FROM b GROUP BY ALL)
SELECT r.entity_id, resolved_total, failures, coalesce(n, 0) AS relations FROM r LEFT JOIN c USING (entity_id)""")
def e17_entity_features(spark, sf_dir):
    x = events(spark, sf_dir).withColumn("role", F.col("outcome")).withColumn("state", F.when(F.col("outcome") != "unknown", "resolved").otherwise("unresolved"))
    got = E.single_entity_features(x, holders(spark, sf_dir), "2024-01-05", "2024-01-20", ("part", "entity_id"))
    return got.select("entity_id", "resolved_total", F.coalesce(F.try_element_at("by_role", L("failure")), L(0)).alias("failures"), "relations")
